"""The folder stream reads each file once; windowed bands agree in batch and stream form."""

import datetime
import random

import pytest

from dossier.operators import links as link_rules
from dossier.sources import files
from dossier.streaming import folder
from dossier.streaming import links as link_stream


def test_new_files_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("um\ndois")
    folder.write_new(folder.new_texts(spark, src), out, mark).awaitTermination(60)
    (tmp_path / "in" / "b.txt").write_text("tres")
    folder.write_new(folder.new_texts(spark, src), out, mark).awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["tres", "um\ndois"]


def test_windowed_bands(spark):
    day = datetime.datetime(2024, 1, 1, 5)
    df = spark.createDataFrame([(day, 0.95), (day, 0.5), (day + datetime.timedelta(days=1), 0.1)], "ts timestamp, score double")
    got = [(r.confident, r.guess, r["none"]) for r in folder.windowed_bands(df).orderBy("window").collect()]
    assert got == [(1, 1, 0), (0, 0, 1)]


def test_sources(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for n in ("b.PDF", ".hidden.pdf", "c.txt", "x/a.png"):
        (tmp_path / n).write_text("data")
    assert [r.name for r in files.scan_folder(spark, str(tmp_path)).collect()] == ["b.PDF", "a.png"]
    (tmp_path / "r.tsv").write_text("12345678\tTITLE\tFILOSOFIA\tA1\nshort\tline\n")
    r = files.read_ranking(spark, str(tmp_path / "r.tsv"), "2017_2020").collect()
    assert [(x.quad, x.issn, x.title, x.area, x.estrato) for x in r] == [("2017_2020", "12345678", "TITLE", "FILOSOFIA", "A1")]
    m = spark.createDataFrame([("a", "manifest.json"), ("a", "d/manifest.json"), ("b", "d/manifest.json"), ("c", "d/e/manifest.json")], "archive string, inner string")
    assert sorted(map(tuple, files.first_manifest(m).collect())) == [("a", "manifest.json"), ("b", "d/manifest.json")]
    pages = spark.createDataFrame([(1, 0, "short"), (2, 0, "a text that is long enough"), (2, 5, "not read")], "file_id int, page_no int, text string")
    assert sorted((x.file_id, x.needs_ocr) for x in files.text_layer(pages).collect()) == [(1, True), (2, False)]


@pytest.mark.parametrize(("cut", "order"), [(1, "log"), (6, "log"), (6, "any"), (13, "again")])
def test_link_state_in_any_cut(spark, tmp_path, cut, order):
    """Micro-batches in any cut and order, with events that come twice, leave the links that the whole log does."""
    rng = random.Random(cut)
    kinds = ["confirm", "suggest", "skip", "undo", "combo", "delete"]
    log = [(rng.choice([1, 1, 1, *range(2, 30)]), k, rng.choice(kinds), rng.choice([None, 0, 1, 2, 3])) for k in range(600)]
    log = [(f, k, kind, 1 if e is None and kind in ("confirm", "suggest", "combo", "delete") else e) for f, k, kind, e in log]
    ddl = "file_id long, seq long, kind string, entry_id long"
    want = {tuple(r) for r in link_rules.state(spark.createDataFrame(log, ddl)).collect()}
    sent = list(log) if order == "log" else rng.sample(log, len(log))
    sent += rng.sample(log, 200) if order == "again" else []
    for k in range(cut):
        spark.createDataFrame(sent[k::cut] if order == "any" else sent[k * len(sent) // cut : (k + 1) * len(sent) // cut], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, batches = str(tmp_path / "out"), []

    def keep(df, k):
        batches.append(k)
        df.write.mode("append").parquet(out)

    link_stream.link_updates(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination(120)
    got = {tuple(r) for r in link_stream.latest(spark.read.parquet(out)).collect()}
    assert got == want and len(batches) >= cut
