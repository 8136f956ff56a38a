"""Sources and sinks: file listings, texts, ranking tables and profile archives."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dossier.functions import text as tx
from dossier.sources.shared import few, remove, removed, shared_folder, shuffles_dropped, stored

#: Extensions of files that may prove an entry.
EXTENSIONS = ("pdf", "jpg", "jpeg", "png", "tiff", "tif", "heic")
RANKING = "issn string, title string, area string, estrato string"
FILE = "struct<originalFilePath:string,bundledRelativePath:string,extractedText:string,confidence:double,isConfirmed:boolean,isRejected:boolean,importDate:timestamp,order:int>"
ENTRY = (
    "struct<rawText:string,title:string,kind:string,year:int,authors:string,venue:string,doi:string,isbn:string,portaria:string,issn:string,edital:string,"
    f"endYear:int,order:int,certificateStatus:string,certificates:array<{FILE}>>"
)
MANIFEST = (
    "formatVersion int, name string, pdfPath string, importDate timestamp, lastUpdated timestamp, savePath string, rawText string, rejectedLinks array<string>,"
    f" sections array<struct<title:string,order:bigint,entries:array<{ENTRY}>>>, limboCertificates array<{FILE}>, includesFiles boolean"
)
#: Characters of a text layer that count as text; pages read of it.
LEAST_TEXT, TEXT_PAGES = 20, 5
#: Files whose sums of lines are sent to all executors at most; lines of a block that share a join key; waves that archives are written in at most, from so many lines on each.
MOST_FILES, BLOCK_LINES, WAVES, WAVE_LINES = 100_000, 4096, 8, 200_000


def listed(files: DataFrame) -> DataFrame:
    """path and its parts, of files with a known extension that aren't hidden, by path."""
    found = files.select("path", tx.file_parts(F.col("path")).alias("f")).where(F.col("f.extension").isin(*EXTENSIONS) & ~F.startswith("f.name", F.lit(".")))
    return found.select("path", "f.*").orderBy("path")


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Files below a folder at any depth, without their content; hidden ones are left out, folders that begin with "." too.

    A folder that executors see as their own file system is listed by tasks, level by level: each level's folders are a table, of which tasks
    list a share. Elsewhere Spark's own distributed listing does it, which leaves out names that begin with "_".
    """
    if "://" in folder and not folder.startswith("file:"):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
        return listed(found)
    root = folder.removeprefix("file://").rstrip("/")
    level = stored(spark.createDataFrame([(root, True)], "path string, is_folder boolean"))
    levels = []
    while not (folders := level.where("is_folder")).isEmpty():
        level = stored(folders.select("path").repartition(spark.sparkContext.defaultParallelism).mapInPandas(_inside, "path string, is_folder boolean"))
        levels.append(level.where("not is_folder").select("path"))
    return listed(reduce(DataFrame.unionByName, levels))


def _inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What stands in each folder, hidden names and links to folders left out."""
    for batch in batches:
        for folder in batch["path"]:
            with os.scandir(folder) as found:
                rows = [(x.path, x.is_dir(follow_symlinks=False)) for x in found if not x.name.startswith(".")]
            yield pd.DataFrame(rows, columns=["path", "is_folder"])


def texts_of(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each text file below a folder, a row for each whole file; files without any text are left out."""
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).where(F.length(tx.strip(F.col("text"))) > 0)


def extracted(files: DataFrame, layers: DataFrame) -> DataFrame:
    """``files`` (path, is_pdf, is_image) with text and how it was got: a layer of its own ("layer"), by recognition ("ocr", still without text), or none.

    ``layers``: path, text, needs_ocr, as ``text_layer`` has them.
    """
    joined = files.join(layers, "path", "left")
    has = F.col("is_pdf") & ~F.coalesce("needs_ocr", F.lit(True))
    how = F.when(has, "layer").when(F.col("is_pdf") | F.col("is_image"), "ocr").otherwise("none")
    return joined.select(*files.columns, F.when(has, F.col("text")).otherwise("").alias("text"), how.alias("source"))


def text_layer(pages: DataFrame) -> DataFrame:
    """file_id and text of the first pages, and whether it is too short to do without character recognition."""
    first = pages.where(F.col("page_no") < TEXT_PAGES)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    return first.groupBy("file_id").agg(joined.alias("text")).withColumn("needs_ocr", F.length(tx.strip(F.col("text"))) < LEAST_TEXT)


def match_text(text: Column, name: Column) -> Column:
    """What a file is matched by: its text and its name with marks as spaces."""
    return F.concat(F.coalesce(text, F.lit("")), F.lit(" \n "), F.translate(name, "_-", "  "))


def scanned(files: DataFrame) -> DataFrame:
    """``files`` (path, root, text) as the scores take them: file_id, cert_key, text, years, folder_kinds and has_text.

    A file is matched by its text and its name; its years are those of its name, else of its text; its folder below the root
    hints at kinds.
    """
    name = tx.file_parts(F.col("path"))["stem"]
    said = F.translate(name, "_-", "  ")
    text = F.coalesce("text", F.lit(""))
    below = F.substring(F.regexp_replace("path", "/[^/]*$", ""), F.length("root") + 1, F.length("path"))
    years = tx.year_set(said)
    return files.select(F.col("path").alias("file_id"), name.alias("cert_key"), match_text(text, name).alias("text"), F.when(F.size(years) > 0, years).otherwise(tx.year_set(text)).alias("years"), tx.folder_kinds(below).alias("folder_kinds"), (text != "").alias("has_text"))


def numbered_lines(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """file, line_no (from 0, in the file), row_no (from 0, files in the order of their paths) and value of each line of text files below ``path``.

    Lines are read in splits, in any order: each split's lines are counted, and the sums of the counts before a split, of
    which there are few, place its lines. Only these sums meet the lines. ``by_folder``: the files of a folder, by name, are one text, in which line_no counts.
    """
    at = F.monotonically_increasing_id()
    raw = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), at.alias("at"))
    splits = raw.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    text = F.regexp_replace("file", "/[^/]*$", "") if by_folder else F.col("file")
    placed = splits.withColumns({"in_text": before(Window.partitionBy(text).orderBy("file", "start")), "in_file": before(Window.partitionBy("file").orderBy("start"))})
    files = splits.groupBy("file").agg(F.sum("n").alias("n")).withColumn("in_all", before(Window.orderBy("file"))).drop("n")
    placed = placed.join(files, "file").withColumn("in_all", F.col("in_all") + F.col("in_file")).drop("n", "in_file")
    placed = F.broadcast(placed) if len(raw.inputFiles()) <= MOST_FILES else placed
    line = F.col("at") - F.col("first")
    return raw.join(placed, ["file", "start"]).select("file", (line + F.col("in_text")).alias("line_no"), (line + F.col("in_all")).alias("row_no"), "value")


def read_ranking(spark: SparkSession, path: str, quad: str) -> DataFrame:
    """A period's ranking table (tab-separated, gzip or plain, one file or several): quad, row_no (in the order of the files and their lines), issn, title, area, estrato."""
    raw = numbered_lines(spark, path).select(F.split("value", "\t").alias("f"), "row_no").where(F.size("f") >= 4)
    return raw.select(F.lit(quad).alias("quad"), "row_no", *[F.col("f")[k].alias(c.split(" ")[0]) for k, c in enumerate(RANKING.split(", "))])


def _fields(df: DataFrame, ddl: str, given: dict[str, Column]) -> list[Column]:
    """The fields of a struct, from the columns of ``df`` of that name with underscores unless ``given``; those it lacks are null."""
    out = []
    for f in StructType.fromDDL(f"x {ddl}").fields[0].dataType.fields:
        name = re.sub("([A-Z])", r"_\1", f.name).lower()
        value = given.get(f.name, F.col(name) if name in df.columns else F.lit(None))
        out.append(value.cast(f.dataType).alias(f.name))
    return out


def with_commas(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """``df`` with comma: false for the first row of each ``group`` by ``order``, of equal ones for any one. Rows are numbered only where there are such equals, and only these."""
    key = F.struct(*order)
    low = few(stored(df.groupBy(group).agg(F.min(key).alias("low"))))
    d = df.join(low, group).withColumn("is_low", key.eqNullSafe(F.col("low"))).drop("low")
    if d.where("is_low").groupBy(group).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return d.withColumn("comma", ~F.col("is_low")).drop("is_low")
    first = d.where("is_low").withColumn("comma", F.row_number().over(Window.partitionBy(group).orderBy("is_low")) > 1)
    return d.where("not is_low").withColumn("comma", F.lit(True)).unionByName(first).drop("is_low")


def manifest_lines(profiles: DataFrame, sections: DataFrame, entries: DataFrame, links: DataFrame, rejected: DataFrame | None = None) -> Iterator[DataFrame]:
    """profile_id, place, section, step, k, id (which, and then value, they are sorted by) and value: the lines of each profile's manifest, which together are one JSON text.

    A line opens a profile, holds a refused link, opens a section, holds an entry with its files, closes a section, holds a
    file in limbo, or closes the profile; so no row holds more than an entry. Columns are named as in MANIFEST, with underscores; those that a
    table lacks are null. ``links`` without an entry_id are the profile's limbo; others need no profile_id. ``rejected``: profile_id, cert_key, hash_key.
    Each kind of line is a table of its own, made when the one before has been written, so that what one kind shuffles is gone by then.
    """
    id_type = entries.schema["entry_id"].dataType
    as_text = lambda text: F.when(F.col("comma"), F.concat(F.lit(","), text)).otherwise(text)

    def line(df: DataFrame, place: int, value: Column, section: Column | int = 0, step: Column | int = 0, k: Column | int = 0, id_: Column | None = None) -> DataFrame:
        of = lambda x, kind: (F.lit(x) if isinstance(x, int) else x).cast(kind)
        return df.select("profile_id", F.lit(place).alias("place"), of(section, "long").alias("section"), of(step, "int").alias("step"), of(k, "long").alias("k"), (F.lit(None) if id_ is None else id_).cast(id_type).alias("id"), value.alias("value"))

    turn = F.when(F.col("comma"), 2).otherwise(1)
    file = F.struct(*_fields(links, FILE, {"order": F.col("cert_order"), "originalFilePath": F.col("file_path") if "file_path" in links.columns else F.col("file_name")}))
    s = sections.withColumn("s_no", F.row_number().over(Window.partitionBy("profile_id").orderBy("section_order", "section_id")))
    s = stored(s.select("profile_id", "section_id", "title", "section_order", "s_no"))
    head = F.to_json(F.struct(*_fields(profiles, f"struct<{HEAD_FIELDS}>", {"formatVersion": F.lit(1), "includesFiles": F.col("includes_files") if "includes_files" in profiles.columns else F.lit(False)})))
    opened = F.to_json(F.struct("title", F.col("section_order").alias("order")))
    frame = [
        line(profiles, 0, F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"rejectedLinks":['))),
        line(profiles, 2, F.lit('],"sections":[')),
        line(s.withColumn("comma", F.col("s_no") > 1), 3, as_text(F.concat(F.substring(opened, F.lit(1), F.length(opened) - 1), F.lit(',"entries":['))), F.col("s_no")),
        line(s, 3, F.lit("]}"), F.col("s_no"), 3),
        line(profiles, 4, F.lit('],"limboCertificates":[')),
        line(profiles, 6, F.lit("]}")),
    ]
    if rejected is not None:
        text = F.to_json(F.array(F.concat_ws("||", "cert_key", "hash_key")))
        r = stored(rejected.select("profile_id", F.substring(text, F.lit(2), F.length(text) - 2).alias("x")).distinct())
        frame.append(line(with_commas(r, "profile_id", F.col("x")), 1, as_text(F.col("x")), step=turn))
    yield reduce(DataFrame.unionByName, frame)
    if rejected is not None:
        removed(r)
    certs = links.where("entry_id is not null").groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cert_order", file.alias("v")))), lambda x: x["v"]).alias("certificates"))
    e = entries.join(few(s.select("section_id", "profile_id", "s_no")), "section_id")
    e = with_commas(e, "section_id", F.col("entry_order"), F.col("entry_id"))
    e = e.join(certs, "entry_id", "left").withColumn("certificates", F.coalesce("certificates", F.array().cast(f"array<{FILE}>")))
    status = F.when(F.exists("certificates", lambda c: c["isConfirmed"]), "confirmed").when(F.size("certificates") > 0, "suggested").otherwise("none")
    held = F.to_json(F.struct(*_fields(e, ENTRY, {"order": F.col("entry_order"), "certificateStatus": status, "certificates": F.col("certificates")})))
    yield line(e, 3, as_text(held), F.col("s_no"), turn, F.col("entry_order"), F.col("entry_id"))
    limbo = stored(links.where("entry_id is null").select("profile_id", "cert_order", F.to_json(file).alias("x")), compression="zstd")
    yield line(with_commas(limbo, "profile_id", F.col("cert_order"), F.col("x")), 5, as_text(F.col("x")), step=turn, k=F.col("cert_order"))
    removed(limbo)


def write_archives(lines: Iterable[DataFrame], folder: str) -> None:
    """``manifest_lines`` as compressed text files, below ``profile_id=`` a profile's id; a profile's files by name, one after the other, are its JSON text.

    Lines are stored as they come, by waves of profiles; then each wave is sorted by ranges, which many tasks share, and written, and its stored lines go.
    So the lines are never shuffled all at once.
    """
    spark = SparkSession.active()
    kept = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    order = ["profile_id", "place", "section", "step", "k", "id"]
    with shuffles_dropped(spark):
        for part in lines:
            part.withColumn("wave", F.pmod(F.xxhash64("profile_id"), F.lit(WAVES)).cast("int")).write.mode("append").option("compression", "zstd").partitionBy("wave").parquet(kept)
        found = spark.read.parquet(kept)
        n = min(WAVES, -(-found.count() // WAVE_LINES)) or 1
        for wave in range(n):
            held = found.where((F.col("wave") >= wave * WAVES // n) & (F.col("wave") < (wave + 1) * WAVES // n))
            dealt = held.repartitionByRange(*order, F.substring("value", 1, 100)).sortWithinPartitions(*order, "value")
            dealt.select("profile_id", "value").write.mode("append").option("compression", "gzip").partitionBy("profile_id").text(folder)
            for k in range(wave * WAVES // n, (wave + 1) * WAVES // n):
                remove(spark, f"{kept}/wave={k}")
        remove(spark, kept)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """profile (the text of the id), line_no and value of each line of the archives below ``folder``, stored."""
    found = numbered_lines(spark, folder, by_folder=True)
    return stored(found.select(F.url_decode(F.regexp_extract("file", "profile_id=([^/]*)/", 1)).alias("profile"), "line_no", "value"), compression="zstd")


def archived(lines: DataFrame) -> DataFrame:
    """profile, line_no, part (profile, rejected, section, entry or limbo) and value (JSON) of what ``read_archives`` has, with the line of its section.

    Which part a line is in is told by the last line before it that opens or closes one. These lines, of which there are few, are the bounds of
    stretches; each line meets the stretches of its block of BLOCK_LINES lines alone, so lines are not shuffled.
    """
    v = F.col("value")
    mark = F.when(F.endswith(v, F.lit(',"rejectedLinks":[')), "rejected").when(v == '],"sections":[', "section").when(F.endswith(v, F.lit(',"entries":[')), "entry").when(v == '],"limboCertificates":[', "limbo").when(v == "]}", "section")
    closed = lambda tail, end: F.concat(F.substring(v, F.lit(1), F.length(v) - len(tail)), F.lit(end))
    w = Window.partitionBy("profile").orderBy("line_no")
    bounds = stored(lines.select("profile", "line_no", mark.alias("place")).where("place is not null"))
    section = F.last(F.when(F.col("place") == "entry", F.col("line_no")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = bounds.withColumns({"until": F.coalesce(F.lead("line_no").over(w), F.col("line_no") + 1), "section_line": section})
    block = lambda x: F.floor(x / BLOCK_LINES)
    spans = few(stored(spans.withColumnRenamed("line_no", "since").withColumn("block", F.explode(F.sequence(block(F.col("since")), block(F.col("until") - 1))))))
    within = (F.col("line_no") >= F.col("since")) & (F.col("line_no") < F.col("until"))
    l = lines.withColumns({"block": block(F.col("line_no")), "mark": mark}).join(spans, ["profile", "block"]).where(within)  # noqa: E741
    part = F.when(F.col("mark").isNull(), F.col("place")).when(F.col("mark") == "rejected", "profile").when(F.col("mark") == "entry", "section")
    text = F.when(F.col("mark") == "rejected", closed(',"rejectedLinks":[', "}")).when(F.col("mark") == "entry", closed(',"entries":[', "}")).otherwise(v)
    return l.select("profile", "line_no", part.alias("part"), F.regexp_replace(text, "^,", "").alias("value"), F.when(part.isin("section", "entry"), F.col("section_line")).alias("section_line")).where("part is not null")


def parts_of(manifests: DataFrame) -> DataFrame:
    """As ``archived``, of manifests made elsewhere (profile, manifest: a whole JSON text)."""
    m = manifests.select("profile", F.from_json("manifest", MANIFEST).alias("m"))
    row = lambda df, line, part, value, section=None: df.select("profile", F.lit(line).cast("long").alias("line_no") if isinstance(line, int) else line.cast("long").alias("line_no"), F.lit(part).alias("part"), F.to_json(value).alias("value"), (F.lit(None) if section is None else section).cast("long").alias("section_line"))
    lists = ("sections", "limboCertificates", "rejectedLinks")
    head = m.select("profile", F.col("m").dropFields(*lists).alias("h"))
    s = m.select("profile", F.posexplode("m.sections").alias("k", "s")).withColumn("at", (F.col("k") + 1).cast("long") * (1 << 31))
    e = s.select("profile", "at", F.posexplode("s.entries").alias("k", "e"))
    refused = m.select("profile", F.posexplode("m.rejectedLinks").alias("k", "x")).select("profile", F.col("k").alias("line_no"), F.to_json(F.array("x")).alias("x"))
    refused = refused.select("profile", F.col("line_no").cast("long").alias("line_no"), F.lit("rejected").alias("part"), F.substring("x", F.lit(2), F.length("x") - 2).alias("value"), F.lit(None).cast("long").alias("section_line"))
    limbo = m.select("profile", F.posexplode("m.limboCertificates").alias("k", "f"))
    rows = [row(head, 0, "profile", F.col("h")), row(s, F.col("at"), "section", F.struct("s.title", F.col("s.order").alias("order")), F.col("at")), row(e, F.col("at") + 1 + F.col("k"), "entry", F.col("e"), F.col("at")), refused, row(limbo, F.col("k"), "limbo", F.col("f"))]
    return reduce(DataFrame.unionByName, rows)


#: Fields of a manifest beside its lists.
HEAD_FIELDS = ",".join(f"{name}:{kind}" for name, kind in (x.split(" ", 1) for x in MANIFEST.split(", ")) if not kind.startswith("array"))


def archived_entries(parts: DataFrame) -> DataFrame:
    """profile, section_line, section_title, section_order, line_no and entry of each entry of ``archived``."""
    s = few(stored(parts.where("part = 'section'").select("profile", "section_line", F.from_json("value", "title string, `order` bigint").alias("s"))))
    e = parts.where("part = 'entry'").select("profile", "section_line", "line_no", F.from_json("value", ENTRY).alias("entry"))
    return e.join(s, ["profile", "section_line"]).select("profile", "section_line", F.col("s.title").alias("section_title"), F.col("s.order").alias("section_order"), "line_no", "entry")


def archived_files(parts: DataFrame) -> DataFrame:
    """profile, section_title and line_no of the entry (both null in limbo), file_no and the fields of each file of ``archived``."""
    linked = archived_entries(parts).select("profile", "section_title", "line_no", F.posexplode("entry.certificates").alias("file_no", "f"))
    limbo = parts.where("part = 'limbo'").select("profile", F.lit(None).cast("string").alias("section_title"), F.lit(None).cast("long").alias("line_no"), F.col("line_no").cast("int").alias("file_no"), F.from_json("value", FILE).alias("f"))
    return linked.unionByName(limbo).select("profile", "section_title", "line_no", "file_no", "f.*")


def archived_rejections(parts: DataFrame) -> DataFrame:
    """profile, cert_key and hash_key of each refused link of ``archived``."""
    x = parts.where("part = 'rejected'").select("profile", F.get_json_object(F.concat(F.lit('{"x":'), "value", F.lit("}")), "$.x").alias("x"))
    return x.select("profile", F.substring_index("x", "||", 1).alias("cert_key"), F.regexp_replace("x", "(?s)^.*?\\|\\|", "").alias("hash_key"))


#: The curriculum in a bundle, its name when unpacked, and the folder of unpacked files.
BUNDLED_CV, UNPACKED_CV, UNPACKED = "curriculo.pdf", "Currículo Lattes.pdf", "Comprovantes Importados"


def import_archives(parts: DataFrame, names: DataFrame, base: str, bundled: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables profiles, sections, entries, links and rejected of many archives at once, as ``manifest_lines`` takes them.

    ``parts`` as ``archived`` has them. Names are free of those in ``names`` and of each other, see ``free_names``; ids are new: an archive's, and
    in it those of its lines. Files that a bundle holds (``bundled``: profile, inner) are found below the new profile's
    folder in ``base``, others where they were; so is the curriculum.
    """
    heads = parts.where("part = 'profile'").select("profile", F.from_json("value", HEAD_FIELDS.replace(":", " ").replace(",", ", ")).alias("h"))
    named = free_names(names, heads.select(F.col("profile").alias("wish"), F.col("h.name").alias("wanted"))).select(F.col("wish").alias("profile"), "name")
    named = few(stored(named))
    new_id = F.concat(F.lit("import-"), "profile")
    folder = F.concat(F.lit(base.rstrip("/") + "/"), "name")
    held = (bundled if bundled is not None else parts.sparkSession.createDataFrame([], "profile string, inner string")).select("profile", "inner").distinct()
    held = few(stored(held))
    cv = held.where(F.col("inner") == BUNDLED_CV).select("profile", F.lit(True).alias("has_cv"))
    heads = heads.join(named, "profile").join(cv, "profile", "left")
    profiles = heads.select(new_id.alias("profile_id"), "name", F.when(F.col("has_cv"), F.concat(folder, F.lit("/" + UNPACKED_CV))).otherwise(F.col("h.pdfPath")).alias("pdf_path"), F.col("h.importDate").alias("import_date"), F.col("h.lastUpdated").alias("last_updated"), folder.alias("save_path"), F.col("h.rawText").alias("raw_text"))
    line_id = lambda c: F.concat_ws("-", new_id, F.col(c).cast("string"))
    sections = parts.where("part = 'section'").select(line_id("section_line").alias("section_id"), new_id.alias("profile_id"), F.from_json("value", "title string, `order` bigint").alias("s")).select("section_id", "profile_id", "s.title", F.col("s.order").alias("section_order"))
    e = archived_entries(parts)
    plain = [F.col(f"entry.{f.name}").alias({"order": "entry_order"}.get(f.name, re.sub("([A-Z])", r"_\1", f.name).lower())) for f in StructType.fromDDL(f"x {ENTRY}").fields[0].dataType.fields if f.name != "certificates"]
    entries = e.select(line_id("line_no").alias("entry_id"), line_id("section_line").alias("section_id"), *plain)
    f = archived_files(parts).join(named, "profile").join(held.withColumn("there", F.lit(True)), (F.col("inner") == F.col("bundledRelativePath")) & (held["profile"] == named["profile"]), "left").drop(held["profile"])
    path = F.when(F.col("there"), F.concat(folder, F.lit(f"/{UNPACKED}/"), F.regexp_extract("bundledRelativePath", "([^/]*)$", 1))).otherwise(F.col("originalFilePath"))
    links = f.select(new_id.alias("profile_id"), F.when(F.col("line_no").isNotNull(), line_id("line_no")).alias("entry_id"), path.alias("file_path"), F.col("extractedText").alias("extracted_text"), "confidence", F.col("isConfirmed").alias("is_confirmed"), F.col("isRejected").alias("is_rejected"), F.col("importDate").alias("import_date"), F.col("order").alias("cert_order"))
    rejected = archived_rejections(parts).select(new_id.alias("profile_id"), "cert_key", "hash_key")
    return {"profiles": profiles, "sections": sections, "entries": entries, "links": links, "rejected": rejected}


def first_manifest(files: DataFrame) -> DataFrame:
    """archive and the path of its manifest: at its root, or one folder below."""
    depth = F.size(F.split("inner", "/"))
    return files.where((F.col("inner") == "manifest.json") | F.col("inner").rlike("^[^/]+/manifest\\.json$")).groupBy("archive").agg(F.min_by("inner", F.struct(depth, "inner")).alias("manifest"))


def free_names(names: DataFrame, wishes: DataFrame) -> DataFrame:
    """wish and a name for each row of ``wishes`` (wish, wanted), free of ``names`` (name) and of each other.

    The first wish of a free name, by ``wish``, has the name itself; the k-th further one has it with the k-th number, from 2 on, that no
    name has after it. Numbers in use are islands, and each tells how many free ones come before it; so the k-th free one is found
    by ordering wishes and numbers in use together.
    """
    taken = names.select("name").where("name is not null").distinct()
    w = wishes.select("wish", "wanted").withColumn("k", F.row_number().over(Window.partitionBy("wanted").orderBy("wish")))
    w = w.join(taken.select(F.col("name").alias("wanted"), F.lit(True).alias("hit")), "wanted", "left").withColumn("k", F.when(F.col("hit"), F.col("k")).otherwise(F.col("k") - 1)).drop("hit")
    plain = w.where("k = 0").select("wish", F.col("wanted").alias("name"))
    everyone = taken.unionByName(plain.select("name"))
    number = F.regexp_extract("name", " \\(([1-9]\\d{0,8})\\)$", 1).try_cast("int")
    used = everyone.select(F.regexp_extract("name", "^(?s)(.*) \\([1-9]\\d{0,8}\\)$", 1).alias("wanted"), number.alias("n")).where("n >= 2")
    used = used.withColumn("k", F.col("n") - F.row_number().over(Window.partitionBy("wanted").orderBy("n")) - 1)
    both = w.where("k > 0").select("wanted", "k", "wish", F.lit(0).alias("island")).unionByName(used.select("wanted", "k", F.lit(None).cast(wishes.schema["wish"].dataType).alias("wish"), F.lit(1).alias("island")))
    passed = F.sum("island").over(Window.partitionBy("wanted").orderBy("k", "island").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = both.withColumn("n", F.col("k") + 1 + passed).where("island = 0").select("wish", F.concat("wanted", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("name"))
    return plain.unionByName(numbered)


def unique_name(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted and a name that is free for it: itself, or with the least " (n)", n from 2, that isn't taken; one for each wanted name."""
    w = wanted.select("wanted").distinct()
    return w.select("wanted").join(free_names(names, w.select(F.col("wanted").alias("wish"), "wanted")).withColumnRenamed("wish", "wanted"), "wanted")


def profiles_by_name(profiles: DataFrame) -> DataFrame:
    return profiles.orderBy("name", "profile_id")
