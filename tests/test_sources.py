"""Order of lines and rows over many tasks, archives written, read and imported, and folder listings."""

import gzip
import json
import random

import pytest

from dossier.operators.order import numbered
from dossier.sources import files as src


def test_lines_keep_their_order_over_splits_and_files(spark, tmp_path):
    rng = random.Random(1)
    want, row = {}, 0
    for name, n in (("b.tsv", 900), ("a.tsv", 400), ("c/d.tsv", 1)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        lines = [f"{name} {k} " + "x" * rng.randint(0, 300) for k in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        want[name] = lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = src.numbered_lines(spark, str(tmp_path)).collect()
        splits = spark.read.option("recursiveFileLookup", True).text(str(tmp_path)).select("_metadata.file_block_start", "_metadata.file_path").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert splits > 3
    for name, lines in want.items():
        assert [r.value for r in sorted((r for r in got if r.file.endswith(name)), key=lambda r: r.line_no)] == lines
    ordered = sorted(got, key=lambda r: r.row_no)
    assert [r.row_no for r in ordered] == list(range(len(got)))
    assert [r.value for r in ordered] == [x for name in ("a.tsv", "b.tsv", "c/d.tsv") for x in want[name]]


def test_last_row_of_a_ranking_wins(spark, tmp_path):
    (tmp_path / "1.tsv").write_text("".join(f"1234{k % 50:04d}\tT{k % 50}\tA\tB{k // 50 % 5}\n" for k in range(5000)))
    (tmp_path / "2.tsv").write_text("12340007\tT7\tA\tA1\nshort\tline\n")
    rows = src.read_ranking(spark, str(tmp_path), "2017_2020").collect()
    last = {}
    for r in sorted(rows, key=lambda r: r.row_no):
        last[r.issn] = r.estrato
    assert len(rows) == 5001 and last["12340007"] == "A1" and last["12340008"] == f"B{(4958 // 50) % 5}"


@pytest.mark.parametrize("keys", [["g"], []])
def test_numbers_of_a_group_that_many_tasks_share(spark, keys):
    rng = random.Random(2)
    rows = [(None if k % 10 == 0 else 1 if k % 3 else k % 7, rng.randint(0, 50), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g int, x int, k int").repartition(5)
    got = numbered(df, keys, ["x", "k"], "n").collect()
    seen = {}
    for r in sorted(got, key=lambda r: (r.x, r.k)):
        key = r.g if keys else 0
        seen[key] = seen.get(key, 0) + 1
        assert r.n == seen[key]
    assert len(got) == 3000 and got[0].__fields__ == ["g", "x", "k", "n"]
    assert numbered(df.where("false"), keys, ["x", "k"], "n").count() == 0


def tables(spark):
    profiles = spark.createDataFrame([(1, "Ana", 'a "b"\nc'), (2, "Ana", None), (3, "Ana (2)", "],\"sections\":["), (4, "Rui", "")], "profile_id long, name string, raw_text string")
    sections = spark.createDataFrame([(1, 10, "S", 0), (1, 11, 'T "x"', 1), (2, 12, "Vazia", 0)], "profile_id long, section_id long, title string, section_order long")
    entries = spark.createDataFrame([(10, 100, 0, 'diz "]}", \n,"entries":[', 2019), (10, 101, 1, "b", 0), (11, 102, 0, "", 2001)], "section_id long, entry_id long, entry_order int, raw_text string, year int")
    links = spark.createDataFrame([(1, 100, "/o/a.pdf", "files/a.pdf", True, 1), (1, 100, "/o/b.pdf", None, False, 0), (1, None, "/o/c.pdf", "files/c.pdf", False, 0), (3, None, "/o/d.pdf", None, False, 0)], "profile_id long, entry_id long, file_path string, bundled_relative_path string, is_confirmed boolean, cert_order int")
    rejected = spark.createDataFrame([(1, 'f "1"', "h||x"), (1, "f2", "h"), (1, "f2", "h")], "profile_id long, cert_key string, hash_key string")
    return profiles, sections, entries, links, rejected


def written(spark, tmp_path):
    src.write_archives(src.manifest_lines(*tables(spark)), str(tmp_path / "out"))
    return src.read_archives(spark, str(tmp_path / "out"))


def test_archives_are_json_and_read_back(spark, tmp_path):
    lines = written(spark, tmp_path)
    by = {}
    for r in lines.orderBy("profile", "line_no").collect():
        by.setdefault(r.profile, []).append(r.value)
    whole = {k: json.loads("\n".join(v)) for k, v in by.items()}
    assert whole["1"]["rejectedLinks"] == ['f "1"||h||x', "f2||h"] and whole["1"]["rawText"] == 'a "b"\nc'
    assert [[e["rawText"] for e in s["entries"]] for s in whole["1"]["sections"]] == [['diz "]}", \n,"entries":[', "b"], [""]]
    assert [c["originalFilePath"] for c in whole["1"]["sections"][0]["entries"][0]["certificates"]] == ["/o/b.pdf", "/o/a.pdf"]
    assert whole["1"]["sections"][0]["entries"][0]["certificateStatus"] == "confirmed" and whole["1"]["limboCertificates"][0]["originalFilePath"] == "/o/c.pdf"
    assert whole["2"]["sections"] == [{"title": "Vazia", "order": 0, "entries": []}] and whole["4"]["sections"] == []
    assert max(len(v) for x in by.values() for v in x) < 700
    parts = src.archived(lines)
    made_elsewhere = src.parts_of(spark.createDataFrame([(k, json.dumps(v)) for k, v in whole.items()], "profile string, manifest string"))
    for fn, drop in ((src.archived_entries, ["section_line", "line_no"]), (src.archived_files, ["line_no", "file_no"]), (src.archived_rejections, [])):
        a, b = (sorted(map(str, fn(p).drop(*drop).collect())) for p in (parts, made_elsewhere))
        assert a == b and a
    assert src.archived_rejections(parts).where("cert_key = 'f \"1\"' and hash_key = 'h||x'").count() == 1


def test_archives_in_waves_and_many_files(spark, tmp_path, monkeypatch):
    """Compressed, a large profile over several files, equal files in limbo, and read back without a shuffle of the lines."""
    for name, n in (("WAVE_LINES", 1), ("BLOCK_LINES", 3)):
        monkeypatch.setattr(src, name, n)
    profiles, sections, _, _, rejected = tables(spark)
    entries = spark.createDataFrame([(10 + k % 2, k, 200 - k, f"e{k}", 2000) for k in range(200)], "section_id long, entry_id long, entry_order int, raw_text string, year int")
    links = [(None, k % 150, f"/o/{k}.pdf", k % 2 == 0, k) for k in range(300)] + [(1, None, "/o/same.pdf", False, 0)] * 3 + [(1, None, f"/o/l{k}.pdf", False, k) for k in range(40)]
    links = spark.createDataFrame(links, "profile_id long, entry_id long, file_path string, is_confirmed boolean, cert_order int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        src.write_archives(src.manifest_lines(profiles, sections, entries, links, rejected), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "out" / "profile_id=1").glob("part-*"))
    assert len(files) > 1 and all(f.name.endswith(".txt.gz") for f in files)
    whole = json.loads("".join(gzip.decompress(f.read_bytes()).decode() for f in files))
    assert [[e["rawText"] for e in s["entries"]] for s in whole["sections"]] == [[f"e{k}" for k in range(199 - 1 + p, -1, -2)] for p in (0, 1)]
    assert all([c["originalFilePath"] for c in e["certificates"]] == [f"/o/{k}.pdf" for k in (n, n + 150)] for s in whole["sections"] for e in s["entries"] if (n := int(e["rawText"][1:])) < 150)
    limbo = [c["originalFilePath"] for c in whole["limboCertificates"]]
    assert limbo[:4] == ["/o/l0.pdf"] + ["/o/same.pdf"] * 3 and limbo[4:] == [f"/o/l{k}.pdf" for k in range(1, 40)]
    parts = src.archived(src.read_archives(spark, str(tmp_path / "out")))
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan
    made_elsewhere = src.parts_of(spark.createDataFrame([("1", json.dumps(whole))], "profile string, manifest string"))
    got, want = (sorted(map(str, src.archived_files(p.where("profile = '1'")).drop("line_no", "file_no").collect())) for p in (parts, made_elsewhere))
    assert got == want and len(got) == 343


def test_imports_have_free_names_and_new_ids(spark, tmp_path):
    parts = src.archived(written(spark, tmp_path))
    names = spark.createDataFrame([("Ana",), ("Ana (4)",), (None,)], "name string")
    bundled = spark.createDataFrame([("1", "files/a.pdf"), ("1", "curriculo.pdf"), ("2", "files/c.pdf")], "profile string, inner string")
    t = {k: [r.asDict() for r in v.collect()] for k, v in src.import_archives(parts, names, "/base", bundled).items()}
    named = {r["profile_id"]: r for r in t["profiles"]}
    assert {k: r["name"] for k, r in named.items()} == {"import-1": "Ana (3)", "import-2": "Ana (5)", "import-3": "Ana (2)", "import-4": "Rui"}
    assert named["import-1"]["pdf_path"] == "/base/Ana (3)/Currículo Lattes.pdf" and named["import-2"]["pdf_path"] is None and named["import-2"]["save_path"] == "/base/Ana (5)"
    paths = {r["file_path"]: r for r in t["links"]}
    assert set(paths) == {"/base/Ana (3)/Comprovantes Importados/a.pdf", "/o/b.pdf", "/o/c.pdf", "/o/d.pdf"}
    section = {r["section_id"]: r for r in t["sections"]}
    assert len(section) == 3 and all(e["section_id"] in section for e in t["entries"]) and len({e["entry_id"] for e in t["entries"]}) == 3
    entry = {r["entry_id"]: r for r in t["entries"]}
    assert entry[paths["/o/b.pdf"]["entry_id"]]["raw_text"].startswith("diz") and paths["/o/c.pdf"]["entry_id"] is None
    assert all(section[e["section_id"]]["profile_id"] == "import-1" for e in t["entries"]) and len(t["rejected"]) == 2
    again = src.write_archives(src.manifest_lines(*src.import_archives(parts, names, "/base", bundled).values()), str(tmp_path / "again"))
    assert again is None and src.archived_entries(src.archived(src.read_archives(spark, str(tmp_path / "again")))).count() == 3


def test_free_names_against_a_loop(spark):
    rng = random.Random(3)
    for seed in range(4):
        pool = ["Ana", "Ana (2)", "Ana (3)", "Ana (10)", "Rui", "Rui (2)", "Ana (02)", "Ana (1)"]
        taken = {rng.choice(pool) for _ in range(seed * 2)}
        wishes = [(k, rng.choice(pool)) for k in range(40)]
        got = {r.wish: r.name for r in src.free_names(spark.createDataFrame([(t,) for t in taken], "name string"), spark.createDataFrame(wishes, "wish int, wanted string")).collect()}
        used, want, rest = set(taken), {}, []
        for k, w in wishes:
            if w in used:
                rest.append((k, w))
            else:
                used.add(w)
                want[k] = w
        for k, w in rest:
            n = next(n for n in range(2, 99) if f"{w} ({n})" not in used)
            want[k] = f"{w} ({n})"
            used.add(want[k])
        assert got == want and len(set(got.values())) == 40 and not set(got.values()) & taken


def test_many_files_are_listed_by_tasks(spark, tmp_path):
    for d in range(40):
        folder = tmp_path / f"f{d % 8}" / f"_g{d}"
        folder.mkdir(parents=True)
        for k in range(500):
            (folder / f"_{k}.pdf").touch()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "a.pdf").touch()
    (tmp_path / "f0" / ".b.pdf").touch()
    (tmp_path / "f0" / "c.txt").touch()
    (tmp_path / "top.JPG").touch()
    got = src.scan_folder(spark, str(tmp_path))
    assert got.count() == 20_001 and got.where("path like '%top.JPG'").count() == 1
    (tmp_path / "none").mkdir()
    assert src.scan_folder(spark, str(tmp_path / "none")).count() == 0
