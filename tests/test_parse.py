"""Whole texts to entries: each way of reading and each split, by example and against plain loops."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier.operators import dedupe, parse, segment

GROUP = ["body"]


def body(spark, *bodies, kind="Artigo", committee=False):
    rows = [(b, k, x, kind, committee) for b, lines in enumerate(bodies) for k, x in enumerate(lines)]
    return spark.createDataFrame(rows, "body int, line_no int, line string, kind string, committee boolean")


def test_each_split_is_reached(spark):
    df = body(
        spark,
        ["1.", "2.", "SILVA, A. Participação em banca de Ana Lima. Tese um, 2019. (Letras) Universidade X.", "Participação em", "banca de Bia Reis. 3. Tese dois, 2020. (Letras) Universidade Y."],
        ["1. Participação em banca de Caio. Um, 2018. (A) Z.", "mais", "2.", "Participação em banca de Davi. Dois, 2017. (B) W."],
        ["2010 - 2012 Curso de escrita", "antes 2013 -", "Atual Curso de leitura"],
        ["1. 2. Um texto qualquer, 2001.", "Outro texto, 2002.", "Palavras-chave: x"],
        committee=True,
    )
    got = {r.body: (r.split, r.joined) for r in parse.bodies(df, GROUP).collect()}
    assert [got[k][0] for k in range(4)] == ["committee", "number", "period", "year"]
    assert "1." not in got[0][1] and got[1][1].startswith("1. ")
    found = [(r.body, r.entry_order, r.title, r.venue, r.year) for r in parse.generic(df, GROUP).orderBy("body", "entry_order").collect()]
    assert found[:4] == [(0, 0, "Ana Lima", "Universidade X", 2019), (0, 1, "Bia Reis", "Universidade Y", 2020), (1, 0, "Caio", "", 2018), (1, 1, "Davi", "W", 2017)]
    assert [(b, t) for b, _, t, _, _ in found[4:]] == [(2, "Curso de escrita antes"), (2, "Curso de leitura"), (3, "Um texto qualquer, 2001."), (3, "Outro texto, 2002. Palavras-chave: x")]


def test_periods_date_their_entries(spark):
    got = parse.generic(body(spark, ["2010 - 2012 Membro de revista de 1999", "2013 - Atual Membro de outra"], kind="Corpo editorial"), GROUP).orderBy("entry_order").collect()
    assert [(r.title, r.year, r.kind) for r in got] == [("Membro de revista de 1999", 2012, "Corpo editorial"), ("Membro de outra", 2013, "Corpo editorial")]


def test_short_and_undated_chunks_are_none(spark):
    got = parse.generic(body(spark, ["1. curto", "2. sem ano mas curto demais", "3. " + "longo " * 12, "4. com ano 2020"]), GROUP).orderBy("entry_order").collect()
    assert [r.entry_order for r in got] == [2, 3]


def plain_bodies(lines):
    """Split and chunks of one body, by a loop over its lines."""
    lines = [x for x in lines if x not in segment.NOISE_LINES]
    values = [int(m[1]) if (m := re.fullmatch(r"\s*(\d{1,3})\.\s*", x)) else None for x in lines if x]
    if any(a is not None and b == a + 1 for a, b in zip(values, values[1:], strict=False)):
        lines = [x for x in lines if not re.fullmatch(r"\s*\d{1,3}\.\s*", x)]
    starts = lambda x: re.match(r"\s*\d{1,3}\.(\s+\S|\s*$)", x)
    period = re.compile(r"\b\d{4}\s*-\s*(?:\d{4}|[Aa]tual)\b")
    cluster, text = any(re.match(r"\s*(\d{1,3}\.\s+){2,}", x) for x in lines), " ".join(lines)
    if not cluster and sum(bool(starts(x)) for x in lines) >= 2:
        out = []
        for x in filter(None, lines):
            if starts(x) or not out:
                out.append([])
            out[-1].append(re.sub(r"^\s*\d{1,3}\.\s*", "", x))
        return "number", [" ".join(x) for x in out]
    at = [m.start() for m in period.finditer(text)]
    if not cluster and len(at) >= 2:
        return "period", [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]
    return "year", None


def test_splits_against_a_loop(spark):
    rng = random.Random(8)
    pool = ["1.", "2.", "3.", "7.", "", "1. Um texto", "2. Outro texto", "12.", "texto solto 2001.", "2010 - 2012 algo", "fim em 2019 -", "2020 e mais", "2003 - Atual x", "Currículo Lattes", "1. 2. 3. junto", "345.páginas"]
    some = [[rng.choice(pool[: rng.choice([6, 9, 16])]) for _ in range(rng.randint(1, 9))] for _ in range(400)]
    found = parse.bodies(body(spark, *some), GROUP)
    split = {r.body: r.split for r in found.collect()}
    parts = {}
    for r in parse.chunks(found, GROUP).where("split <> 'year'").orderBy("body", "chunk_no").collect():
        parts.setdefault(r.body, []).append(r.chunk)
    for k, lines in enumerate(some):
        want = plain_bodies(lines)
        if any(x not in segment.NOISE_LINES for x in lines):
            assert split[k] == want[0], lines
            if want[1] is not None:
                assert parts[k] == want[1], lines
    assert {"number", "period", "year"} <= set(split.values())


def test_awards(spark):
    got = parse.awards(body(spark, ["2023 2017 Prêmio de Melhor Tese", "da Universidade", "menção honrosa do Instituto", "Grande área: Letras"], ["2020", "Medalha de ouro da", "cidade.", "2018", "Prêmio 2011 menor.", "Outro prêmio sem ano."]), GROUP)
    rows = [(r.body, r.entry_order, r.title, r.year) for r in got.orderBy("body", "entry_order").collect()]
    assert rows == [
        (0, 0, "Prêmio de Melhor Tese", 2023), (0, 1, "da Universidade", 2017), (0, 2, "menção honrosa do Instituto", 2017),
        (1, 0, "Medalha de ouro da cidade.", 2020), (1, 1, "Prêmio 2011 menor.", 2018), (1, 2, "Outro prêmio sem ano.", 2018),
    ]


RECORD = [
    "Universidade Federal do Norte - UFN, Brasil", "2015 - Atual Vínculo: Servidor, Enquadramento funcional: Professor, Regime: x", "Outras informações: PORTARIA N 2891, DE 06 DE OUTUBRO DE 2022", "Atividades",
    "08/2019 - 12/2020 Direção e administração", "Cargos ocupados:", "10/05/2019 - Coordenador do curso, PORTARIA N 77, de 2019", "resto da linha", "03/2021 - Atual Graduação, Filosofia", "Disciplinas ministradas:", "Lógica formal",
    "Disciplinas ministradas: Ética 2018", "Instituto de Artes", "2001 - 2004 Vínculo: Bolsista", "Universidade Federal do Norte", "1999 - 2000 Vínculo: Livre, Enquadramento funcional: Monitor",
]


def test_professional_record(spark):
    got = parse.professional(body(spark, RECORD, ["nada aqui"]), GROUP)
    rows = [(r.title, r.kind, r.year, r.end_year, r.venue, r.portaria) for r in got.where("body = 0").orderBy("entry_order").collect()]
    north = "Universidade Federal do Norte - UFN"
    assert rows == [
        (f"Professor — {north}", "Vínculo institucional", 2015, 0, north, "2891/2022"), ("Coordenador do curso", "Atividade administrativa", 2019, 2020, north, "77/2019"),
        ("Lógica formal", "Disciplina ministrada", 2021, 0, north, ""), ("Ética 2018", "Disciplina ministrada", 2018, 0, north, ""),
        ("Vínculo institucional — Instituto de Artes", "Vínculo institucional", 2001, 2004, "Instituto de Artes", ""), ("Monitor — Universidade Federal do Norte", "Vínculo institucional", 1999, 2000, "Universidade Federal do Norte", ""),
    ]
    assert [(r.title, r.raw_text) for r in got.where("body = 1").collect()] == [("Atuação profissional", "nada aqui")]
    grouped = [(r.label, r.entry_order, r.title) for r in parse.by_institution(got.where("body = 0"), GROUP).orderBy("label_order", "entry_order").collect()]
    assert grouped == [
        (f"{north} - Vínculo institucional", 0, f"Professor — {north}"), (f"{north} - Vínculo institucional", 1, "Monitor — Universidade Federal do Norte"), (f"{north} - Atividades administrativas", 0, "Coordenador do curso"),
        (f"{north} - Disciplinas ministradas", 0, "Lógica formal"), (f"{north} - Disciplinas ministradas", 1, "Ética 2018"), ("Instituto de Artes - Vínculo institucional", 0, "Vínculo institucional — Instituto de Artes"),
    ]


CV = """Ana Souza Lima
Endereço para acessar este CV: http://x
Formação acadêmica/titulação
2017 - 2021 Doutorado em Filosofia.
Universidade Federal, UF, Brasil
Atuação profissional
Universidade Federal
2015 - Atual Vínculo: Servidor, Enquadramento funcional: Professor
Projetos de
pesquisa
2019 - Atual Um projeto de nome bastante longo
Descrição: texto 2020
Prêmios e títulos
Prêmio de melhor tese, Universidade, 2018.
Artigos completos publicados em periódicos
1. SOUZA, ANA. Primeiro artigo da revista. Revista de Letras, v. 3, 2019.
2. SOUZA, ANA. Segundo artigo da revista. Revista de Letras, v. 4, 2020.
3. Lima, 2020.
Participação em eventos
1. Conferencista no(a) Congresso de Letras. Título da fala, 2017. (Congresso)
2. Semana de Filosofia e Letras, 2016. (Encontro)
Organização de evento
SOUZA, A.. Semana de Lógica, 2020. (Congresso, Organização de evento)
SOUZA, A.. Semana de Ética, 2021. (Congresso, Organização de evento)
Participação em banca de trabalhos de conclusão
Mestrado
1. Participação em banca de Bia. Tese um sobre coisas, 2019. (Letras) Universidade X.
Doutorado
1. Participação em banca de Caio Reis. Tese dois, 2018. (Letras) Universidade Y.
Educação e Popularização de C&T
Artigos completos publicados em periódicos
1. SOUZA, ANA. Primeiro artigo da revista. Revista de Letras, v. 3, 2019.
2. SOUZA, ANA. Terceiro artigo da revista. Revista de Letras, v. 5, 2021.
Totais de produção
1. depois do fim, 2020"""


def test_whole_text(spark):
    got = parse.cv_entries(spark.createDataFrame([(1, CV), (2, None), (3, "nada")], "doc_id long, text string"))
    rows = [(r.section, r.title, r.year) for r in got.orderBy("doc_id", "section_order", "entry_order").collect()]
    assert rows == [
        ("Formação acadêmica/titulação", "Doutorado em Filosofia — Universidade Federal", 2021),
        ("Atuação profissional - Universidade Federal - Vínculo institucional", "Professor — Universidade Federal", 2015),
        ("Projetos de pesquisa", "Um projeto de nome bastante longo", 2020),
        ("Prêmios e títulos", "Prêmio de melhor tese, Universidade, 2018.", 2018),
        ("Artigos completos publicados em periódicos", "Primeiro artigo da revista.", 2019),
        ("Artigos completos publicados em periódicos", "Segundo artigo da revista.", 2020),
        ("Artigos completos publicados em periódicos", "Terceiro artigo da revista.", 2021),
        ("Participação em Eventos - Apresentação", "Conferencista no(a) Congresso de Letras.", 2017),
        ("Participação em Eventos - Ouvinte", "Semana de Filosofia e Letras, 2016.", 2016),
        ("Organização de eventos", "Semana de Lógica", 2020),
        ("Organização de eventos", "Semana de Ética", 2021),
        ("Participação em bancas (trabalhos de conclusão) - Mestrado", "Bia", 2019),
        ("Participação em bancas (trabalhos de conclusão) - Doutorado", "Caio Reis", 2018),
    ], rows


def test_projects_and_events_fall_back(spark):
    text = "\n".join(["Projetos de pesquisa", "2019 - 2020 Projeto sem descrição nenhuma", "2021 - Atual Outro projeto sem descrição", "Projetos de extensão", "2001 - 2002 Vínculo: Bolsista de algo", "2003 - 2004 Outro vínculo", "Organização de evento", "SOUZA, A.. Semana de Lógica, 2020. (Congresso, Organização de evento)"])
    got = [(r.section, r.title, r.kind, r.year) for r in parse.cv_entries(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("section_order", "entry_order").collect()]
    assert got == [("Projetos de pesquisa", "Projeto sem descrição nenhuma", "Projeto", 2020), ("Projetos de pesquisa", "Outro projeto sem descrição", "Projeto", 2021), ("Organização de eventos", "SOUZA, A.. Semana de Lógica, 2020.", "Organização de evento", 2020)], got


def test_bodies_by_title(spark):
    text = "Livros publicados\nb1\nBancas\nx\nProgramas de computador\np\nLivros publicados\nb2\n\nb3"
    found = segment.by_title(segment.bodies(segment.sections(spark.createDataFrame([(1, text)], "doc_id long, text string"))))
    assert [(r.title, r.place, r.bodies) for r in found.orderBy("place").collect()] == [("Livros publicados", 0, ["b1", "b2\n\nb3"]), ("Programas de computador", 1, ["p"])]


def slow_merge(bodies):
    """Bodies of (text, title, year) merged one by one, each entry held against all kept before its body."""

    def without(found):
        out = []
        for k, e in enumerate(found):
            if all((e[2], e[0]) != (x[2], x[0]) for x in found[:k]):
                out.append(e)
        return [e for e in out if not (len(e[0]) >= 30 and re.search(r"(19|20)\d\d$", e[0]) and any(x[2] == e[2] and len(x[0]) > len(e[0]) + 4 and x[0].startswith(e[0]) for x in out))]

    kept = []
    for new in bodies:
        old = list(kept)
        for n, t, y in new:
            same = False
            for o, u, _ in old:
                prefix = (len(o[:60]) == 60 and o[:60] in n) or (len(n[:60]) == 60 and n[:60] in o)
                title = (len(u[:30]) >= 15 and u[:30] in n) or (len(t[:30]) >= 15 and t[:30] in o)
                same = same or o == n or (prefix and title)
            if not same:
                kept.append((n, t, y))
        kept = without(kept)
    return kept


@pytest.mark.parametrize("most", [2000, 0])
def test_merge_against_a_loop(spark, most):
    rng = random.Random(10)
    words = "alfa beta gama delta letra norma prosa verso".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    heads = [say(14) for _ in range(3)]
    rows, want = [], {}
    for section in range(60):
        bodies = []
        for b in range(rng.randint(1, 11)):
            new = []
            for k in range(rng.randint(0, 5)):
                text = rng.choice(heads) + " " + say(rng.randint(0, 3)) if rng.random() < 0.6 else say(rng.randint(2, 12))
                text = " ".join(text.split()) + rng.choice(["", " 2019", " 2019 fim da linha"])
                title = rng.choice([text[:40].strip(), say(4)])
                new.append((text, title, rng.choice([2018, 2019])))
                rows.append((section, b, k, *new[-1]))
            bodies.append(new)
        want[section] = slow_merge(bodies)
    df = spark.createDataFrame(rows, "section int, sec_no int, entry_order int, raw_text string, title string, year int")
    got = {}
    for r in dedupe.merge_bodies(df, ["section"], most=most).orderBy("section", "entry_order").collect():
        got.setdefault(r.section, []).append((r.raw_text, r.title, r.year))
    assert {k: v for k, v in want.items() if v} == got


def test_small_sections_share_passes(spark):
    """Sections go on over batches of any size, and no call is made for each of them."""
    rng = random.Random(12)
    rows = sorted((rng.choice([None, 1, 2, 3, 4, 5]) or 0, b, k, f"texto {rng.randint(0, 3)}") for b in range(3) for k in range(20))
    cols = {"section": [r[0] or None for r in rows], "sec_no": [r[1] for r in rows], "entry_order": [r[2] for r in rows], "_norm": [r[3] for r in rows], "_title": ["t"] * 60, "_year": [2019] * 60}
    table = pa.table(cols)
    got = [[r for b in dedupe.section_passes(iter(table.to_batches(max_chunksize=n)), ["section"], "sec_no") for r in b.to_pylist()] for n in (1, 2, 7, 60)]
    want, seen = [], set()
    for r in table.to_pylist():
        if (r["section"], r["_norm"]) not in seen:
            seen.add((r["section"], r["_norm"]))
            want.append(r)
    assert all(x == want for x in got)
    df = spark.createDataFrame([(k, 0, 0, "a", "b", 2019) for k in range(50)], "section int, sec_no int, entry_order int, raw_text string, title string, year int")
    out = dedupe.merge_bodies(df, ["section"])
    assert out.count() == 50 and "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()


def test_marked(spark):
    df = spark.createDataFrame([("a 2001 - 2002 b 2003 - Atual c",), ("none",)], "t string")
    assert [r[0] for r in df.select(segment.marked(F.col("t"), segment.PERIOD)).collect()] == [["2001 - 2002 b ", "2003 - Atual c"], []]


def test_large_sections_merge_in_linear_work(spark):
    """Ten thousand entries of two bodies, of which the second repeats half of the first, and a group of copies."""
    name = lambda k: " ".join(f"{w}{k % m}" for w, m in (("norma", 97), ("prosa", 89), ("verso", 83), ("letra", 79), ("gama", 73), ("delta", 71), ("beta", 67), ("alfa", 61), ("fim", 59), ("obra", 53)))
    rows = [(1, 0, k, name(k), name(k), 2019) for k in range(5000)] + [(1, 1, k, name(k + 2500), name(k + 2500), 2019) for k in range(5000)] + [(1, 1, 6000 + k, "igual " * 20, "igual", 2019) for k in range(2000)]
    df = spark.createDataFrame(rows, "section int, sec_no int, entry_order int, raw_text string, title string, year int").repartition(4)
    got = dedupe.merge_bodies(df, ["section"]).collect()
    assert len(got) == 7501 and sorted(r.entry_order for r in got) == list(range(7501))
    edges = dedupe.related(df.selectExpr("*", "monotonically_increasing_id() as _uid", "trim(raw_text) as _norm", "title as _title", "year as _year"), ["section"])
    assert edges.count() < 10 * len(rows)
