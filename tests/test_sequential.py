"""Operators with state against plain loops."""

import math
import random
import re
import unicodedata
from collections import Counter

from dossier.functions import text as tx
from dossier.operators import dedupe, scoring, segment
from dossier.plans import catalog

SF = "/root/testdata/sf0.001"


def test_sections_state_machine(spark):
    table = {n: (d, m, c) for n, d, m, c in segment.HEADERS}

    def classify(n):
        if n == segment.STOP:
            return ("stop",)
        if n in segment.EXCLUDED:
            return ("excluded",)
        if n == segment.DONE:
            return ("done",)
        if n == segment.ONGOING:
            return ("ongoing",)
        for name, found in table.items():
            if n == name or (len(name) >= 12 and n.startswith(name) and n.count(")") <= n.count("(")):
                return ("section", *found)
        return None

    fold = lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c)).strip()
    pool = ["Projetos de", "pesquisa", "Livros publicados", "Bancas", "Orientações e supervisões concluídas", "Orientações e supervisões em andamento", "Iniciação científica", "abc 2020.", "", "Currículo Lattes", "Organização de evento)", "Artigos completos publicados em", "periódicos", "fim"]
    rng = random.Random(5)
    docs = [(k, "\n".join(rng.choice(pool + (["Totais de produção"] if k % 3 == 0 else [])) for _ in range(rng.randint(0, 40)))) for k in range(60)]
    noise = lambda s: s in segment.NOISE_LINES
    want = set()
    for k, text in docs:
        rows, current, suffix, i, found = [x.strip() for x in text.split("\n")], None, "", 0, {}
        while i < len(rows):
            line = rows[i]
            if noise(line):
                i += 1
                continue
            if not fold(line):
                if current is not None:
                    found[current].append((i, ""))
                i += 1
                continue
            c, used = classify(fold(line)), 1
            if c is None and i + 1 < len(rows) and line.count(")") <= line.count("(") and rows[i + 1] and not noise(rows[i + 1]):
                two = classify(fold(line + " " + rows[i + 1]))
                if two and two[0] in ("section", "excluded"):
                    c, used = two, 2
            if c is None:
                if current is not None:
                    found[current].append((i, line))
            elif c[0] == "stop":
                break
            elif c[0] == "section":
                title = f"Orientações - {c[1]}{suffix}" if c[3] else c[1]
                suffix = suffix if c[3] else ""
                current = (i, title, c[2])
                found[current] = []
            else:
                suffix = {"excluded": "", "done": " (concluídas)", "ongoing": " (em andamento)"}[c[0]]
                current = None
            i += used
        want |= {(k, s[0], s[1], s[2], n, x) for s, body in found.items() if any(t for _, t in body) for n, x in body}
    got = segment.sections(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.sec_no, r.title, r.mode, r.line_no, r.line) for r in got} == want


def test_global_assignment(spark):
    rng = random.Random(2)
    rows = []
    for f in range(300):
        for rank, (e, s) in enumerate(sorted({rng.randint(0, 40): round(rng.choice([0.3, 0.4, 0.5, 0.52, 0.9]), 2) for _ in range(rng.randint(1, 4))}.items(), key=lambda x: (-x[1], x[0])), 1):
            rows.append((f, e, s, rank))
    by = {}
    for f, e, s, _ in rows:
        by.setdefault(f, []).append((e, s))
    cover = {}
    for r in by.values():
        if r[0][1] >= 0.35:
            cover[r[0][0]] = cover.get(r[0][0], 0) + 1
    want = set()
    for f in sorted(by):
        r = by[f]
        if r[0][1] < 0.35:
            continue
        pick = r[0]
        if len(r) > 1 and r[0][1] - r[1][1] <= 0.08 and cover.get(r[0][0], 0) >= 2 and cover.get(r[1][0], 0) == 0 and r[1][1] >= 0.35:
            pick = r[1]
            cover[r[0][0]] -= 1
            cover[r[1][0]] = 1
        want.add((f, *pick))
    df = spark.createDataFrame([(p, *r) for r in rows for p in ("a", "b")], "profile_id string, file_id long, entry_id long, score double, rank int").where("profile_id = 'a' or file_id < 200")
    got = [tuple(r) for r in scoring.assign(df).select("profile_id", "file_id", "entry_id", "score").collect()]
    assert {r[1:] for r in got if r[0] == "a"} == want and len(got) == len(set(got))
    alone = df.where("profile_id = 'b'")
    assert {r for r in got if r[0] == "b"} == {tuple(r) for r in scoring.assign(alone).select("profile_id", "file_id", "entry_id", "score").collect()}


def test_committee_levels_defer(spark):
    rows = ["Mestrado", "1. 2. Doutorado", *["Participação em banca de B"] * 3, "Mestrado", "Participação em banca de C"]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(rows)], "body int, line_no int, line string")
    got = {r.line_no: r.level for r in segment.committee_levels(df, ["body"]).collect()}
    assert got == {2: "Mestrado", 3: "Mestrado", 4: "Doutorado", 6: "Mestrado"}


def plain_levels(rows):
    """By the entries that are still to come before each waiting marker."""
    text, starts = "\n".join(rows), [0]
    for r in rows:
        starts.append(starts[-1] + len(r) + 1)
    begins = [m.start() for m in re.finditer(r"Participaç[ãa]o\s+em\s+banca\s+de", text, re.I)]
    out, level, queue, fresh, marked = [], "", [], True, False
    for k, r in enumerate(rows):
        norm = "".join(c for c in unicodedata.normalize("NFD", r.lower()) if not unicodedata.combining(c)).strip()
        numbers = re.match(r"(\d{1,3}\.\s*)*", norm)[0]
        name = segment.LEVELS.get(norm[len(numbers) :])
        if name is None:
            if any(starts[k] <= b < starts[k + 1] for b in begins) and queue:
                queue.pop()
                if not queue:
                    level, waiting = waiting, None
            out.append(level)
            fresh = False
        else:
            marked = True
            out.append(None)
            if fresh and "." in numbers and level and not queue:
                waiting, queue = name, [None] * (numbers.count(".") + 1)
            else:
                level, queue, fresh = name, [], True
    return [None if v is None or (marked and not v) else v for v in out]


def test_committee_levels_against_a_loop(spark):
    rng = random.Random(12)
    pool = ["Mestrado", "Doutorado", "1. Mestrado", "1. 2. Doutorado", "1.2.3. Graduação", "Exame de qualificação de Mestrado", "Participação em banca de A", "x Participação em", "banca de B", "", "1. Participação em banca de C. Participacao em banca de D", "texto\u0001", "PARTICIPAÇÃO EM BANCA DE E"]
    bodies = [[rng.choice(pool) for _ in range(rng.randint(0, 25))] for _ in range(300)]
    df = spark.createDataFrame([(b, k, x) for b, rows in enumerate(bodies) for k, x in enumerate(rows)], "body int, line_no int, line string")
    got = {(r.body, r.line_no): r.level for r in segment.committee_levels(df, ["body"]).collect()}
    want = {(b, k): v for b, rows in enumerate(bodies) for k, v in enumerate(plain_levels(rows)) if v is not None}
    assert got == want and {"Doutorado", ""} <= set(want.values())


def test_institutions_by_their_rules(spark):
    rows = [("Universidade X, Brasil Horista", "Universidade X"), ("UNIVERSIDADE INTEGRAL", "UNIVERSIDADE INTEGRAL"), ("Instituto Y, Brasil, Campus", "Instituto Y, Campus"), ("Faculdade ZDedicação  exclusiva ", "Faculdade Z"), ("Universidade, Brasil.", "Universidade")]
    df = spark.createDataFrame(rows, "line string, want string")
    assert all(r.got == r.want for r in df.select("want", tx.institution_name(df.line).alias("got")).collect())
    keys = spark.createDataFrame([("Universidade Á-UFX", "universidade a"), ("Universidade A - U", "universidade a - u"), ("A - BC - DE", "a - bc"), ("A - ABCDEFGHIJK", "a - abcdefghijk"), ("A - UF, fim", "a - uf, fim")], "name string, want string")
    assert all(r.got == r.want for r in keys.select("want", tx.institution_key(keys.name).alias("got")).collect())
    lines = spark.createDataFrame([("Portaria 12 da Universidade B", False), ("Regime na Faculdade", False), ("2 Instituto", False), ("Fundação C", True), ("Carga horária: Universidade", False)], "line string, want boolean")
    assert all(r.got == r.want for r in lines.select("want", tx.is_institution(lines.line).alias("got")).collect())


def test_year_anchor_keeps_type_with_its_entry(spark):
    lines = ["Primeiro trabalho, 2023.", "(Congresso) Título.", "Palavras-chave: x", "Outro 2020. Citações: 1 | 1", "Fim"]
    df = spark.createDataFrame([(1, k, x, "Banca") for k, x in enumerate(lines)], "body int, line_no int, line string, kind string")
    got = [r.chunk for r in segment.split_year_anchor(df, ["body"]).orderBy("chunk_no").collect()]
    assert got == ["Primeiro trabalho, 2023. (Congresso) Título. Palavras-chave: x", "Outro 2020. Citações: 1 | 1", "Fim"]


def plain_normal(s):
    folded = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isalnum() else " " for c in folded).split())


def plain_meaningful(s):
    return [w for w in plain_normal(s).split() if len(w) >= 4 and w not in tx.STOPWORDS and not w.isnumeric()]


def plain_text_score(cert, title, venue, idf, unknown):
    words, sig, said = set(cert.split()), plain_meaningful(title), plain_normal(title).split()
    weight = lambda ws: sum(idf.get(w, unknown) for w in ws)
    met = [w for w in sig if w in words]
    most = min(len(said), 10)
    longest = max((n for n in range(2, most + 1) if any(" ".join(said[i : i + n]) in cert for i in range(len(said) - n + 1))), default=0) if met else 0
    phrase, cover = longest / max(most, 1), weight(met) / weight(sig) if sig else 0
    score = max(phrase, cover) if len(sig) >= 3 else phrase
    if len(met) < 2 and phrase < 0.6:
        score = 0
    vsig = plain_meaningful(venue)
    vmet = [w for w in vsig if w in words]
    vcover = weight(vmet) / weight(vsig) if vsig else 0
    if score < 0.4 and vcover >= 0.6 and len(vmet) >= 2:
        score = vcover * 0.8
    elif vcover >= 0.5 and score >= 0.3:
        score = min(1, score + 0.1)
    return min(1, score)


def plain_ids(t):
    pairs = {m[1] + ("/" + re.findall(r"(?:19|20)\d{2}", m[2])[-1] if m[2] else "") for m in re.finditer(r"portaria\s*(?:n[º°o.]?\s*)?(\d{2,6})([\s\S]{0,50}?\b(?:19|20)\d{2}\b)?", t, re.I)}
    calls = {x.replace(" ", "") for x in re.findall(r"edital\s*(?:n[º°o.]?\s*)?(\d{1,4}\s*/\s*\d{2,4})", t, re.I)}
    issns = {x.replace(" ", "").upper() for x in re.findall(r"issn[:\s]*(\d{4}\s*-\s*\d{3}[\dxX])", t, re.I)}
    return pairs, calls, issns, {x.lower() for x in re.findall(r"(10\.\d{4,}/[^\s,;]+)", t, re.I)}


def plain_pair_score(f, e, idf, unknown, now):
    """All rules of one pair, in the order in which they are stated."""
    t = f.text[:4000]
    pairs, calls, issns, dois = plain_ids(t)
    low = t.lower()
    if e.kind in ("Artigo", "Livro/Capítulo") and not (any(x in low for x in ("issn", "isbn", "doi")) or re.search(r"10\.\d{4,}/", t)):
        return 0
    if e.kind in ("Orientação", "Formação") and (pairs or "portaria" in low):
        return 0
    ordinance = 0
    for c in pairs:
        for x in e.portaria.split():
            (cn, _, cy), (en, _, ey) = c.partition("/"), x.partition("/")
            if cn == en:
                ordinance = max(ordinance, 0.95 if not cy or not ey else 0.99 if cy == ey else 0)
    known = True
    if ordinance:
        score = ordinance
    elif calls & set(e.edital.split()):
        score = 0.99
    elif dois & set(e.doi.split()):
        score = 1.0
    else:
        known = bool(calls & set(e.edital.split()))
        score = plain_text_score(plain_normal(t), e.title, e.venue, idf, unknown)
        if score > 0.2 and issns & set(e.issn.split()):
            score = min(1, score + 0.15)
    if score > 0 and e.year > 0 and f.years:
        last = now if e.end_year == 0 else e.end_year
        period = (e.end_year >= e.year or e.end_year == 0) and (e.end_year != 0 or last > e.year)
        last = last if period else e.year
        if any(e.year <= y <= last for y in f.years):
            score = min(1, score + 0.06)
        elif min(min(abs(y - e.year), abs(y - last)) for y in f.years) >= 3:
            score *= 0.8
    if not known:
        score = min(0.97, score + (0.2 if e.kind in f.folder_kinds and score > 0 else 0))
    return min(1, score)


def test_pair_scores_against_a_loop(spark):
    files, entries, rejected = (t.collect() for t in catalog.pair_tables(spark, SF))
    refused = {tuple(r) for r in rejected}
    df = Counter(w for e in entries for w in set(plain_meaningful(e.title)))
    idf = {w: math.log(max(len(entries), 1) / (1 + n)) + 0.5 for w, n in df.items()}
    want = {}
    for f in files:
        for e in entries:
            if (f.cert_key, e.hash_key) not in refused and (s := plain_pair_score(f, e, idf, math.log(len(idf) or 2) + 0.5, 2024)) >= 0.35:
                want[f.file_id, e.entry_id] = s
    got = {(r.file_id, r.entry_id): r.score for r in catalog.pair_scores(spark, SF).collect()}
    assert len(want) > 100 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_dedupe_is_idempotent(spark):
    e = catalog._raw_entries(spark, SF)
    first = dedupe.deduped(e, ["section_id"])
    assert sorted(r.entry_id for r in first.collect()) == sorted(r.entry_id for r in dedupe.deduped(first, ["section_id"]).collect())


def test_bare_number_is_no_run(spark):
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(["246.", "6.", "a", "7.", "8.", "9."])], "body int, line_no int, line string")
    assert [r.line for r in segment.detached_numbers(df, ["body"]).orderBy("line_no").collect()] == ["a"]
    assert segment.detached_numbers(df.where("line_no < 3"), ["body"]).count() == 3


def test_normal_of_words(spark):
    assert tx.ACCENTED and len(tx.ACCENTED) == len(tx.PLAIN)
