"""Report manifests: which page holds what, and the table of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.operators.order import numbered

#: Lines of the first page of contents and of each further one.
FIRST, NEXT = 30, 36


def in_period(year: Column, start: int | None = None, end: int | None = None) -> Column:
    """Entries of an unknown year always pass."""
    ok = F.lit(True)
    if start is not None:
        ok = ok & (year >= start)
    if end is not None:
        ok = ok & (year <= end)
    return (year <= 0) | ok


def toc_pages(lines: Column) -> Column:
    return F.when(lines <= FIRST, 1).otherwise(1 + F.ceil((lines - FIRST) / NEXT)).cast("int")


def toc_place(line: Column) -> Column:
    """Page of contents, from 1, that holds a line counted from 0."""
    return F.when(line < FIRST, 1).otherwise(2 + F.floor((line - FIRST) / NEXT)).cast("int")


def scale_to_fit(width: Column, height: Column, room_w: float, room_h: float, rotation: Column) -> Column:
    """Factor that fits a page into a room; pages turned by a quarter change their sides."""
    turned = rotation.isin(90, 270)
    return F.least(room_w / F.when(turned, height).otherwise(width), room_h / F.when(turned, width).otherwise(height))


def manifest(entries: DataFrame, files: DataFrame, by: str = "profile_id", start: int | None = None, end: int | None = None, sections: list[str] | None = None, cv_pages: DataFrame | None = None, include_toc: bool = True) -> DataFrame:
    """The pages of each profile's report: page, kind, title, file_id, file_page, shows_number.

    ``entries``: profile_id, section_title, section_order, entry_order, entry_id, label, year, n_confirmed. ``files``:
    entry_id, file_id, cert_order, pages (0: missing or unreadable), is_confirmed. ``cv_pages``: profile_id, pages.
    A section has a divider, each entry a header, then the pages of its confirmed files; entries without a
    confirmed file, and sections without such entries, are left out. No or an empty list of sections means all.
    Pages of contents come first and count in the numbers; reports without a page don't come out at all. Many tasks share the pages of a
    large report, see ``numbered``.
    """
    e = entries.where(in_period(F.col("year"), start, end) & (F.col("n_confirmed") > 0))
    if sections:
        e = e.where(F.col("section_title").isin(sections))
    last, none = F.lit(2**31 - 1), F.lit(None)
    entry = e.select(by, "section_order", "section_title", "entry_order", "entry_id", F.lit(0).alias("cert_order"), none.cast("string").alias("file_id"), F.lit(0).alias("file_page"), F.lit("entry").alias("kind"), F.col("label").alias("title"))
    pages = (
        e.select(by, "section_order", "section_title", "entry_order", "entry_id")
        .join(files.where("is_confirmed and pages > 0"), "entry_id")
        .select(by, "section_order", "section_title", "entry_order", "entry_id", (F.col("cert_order") + 1).alias("cert_order"), F.col("file_id").cast("string").alias("file_id"), F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("file_page"), F.lit("file").alias("kind"), F.lit("").alias("title"))
    )
    divider = e.groupBy(by, "section_order", "section_title").agg(F.lit(-1).alias("entry_order"), F.lit("").alias("entry_id")).select(by, "section_order", "section_title", "entry_order", "entry_id", F.lit(0).alias("cert_order"), none.cast("string").alias("file_id"), F.lit(0).alias("file_page"), F.lit("section").alias("kind"), F.col("section_title").alias("title"))
    body = entry.withColumn("entry_id", F.col("entry_id").cast("string")).unionByName(pages.withColumn("entry_id", F.col("entry_id").cast("string"))).unionByName(divider)
    if cv_pages is not None:
        cv = cv_pages.select(by, F.lit(-1).cast("long").alias("section_order"), F.lit("").alias("section_title"), F.lit(-1).alias("entry_order"), F.lit("").alias("entry_id"), F.lit(0).alias("cert_order"), none.cast("string").alias("file_id"), F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("file_page"), F.lit("cv").alias("kind"), F.lit("").alias("title"))
        body = body.unionByName(cv)
    places = ["section_order", "section_title", "entry_order", "entry_id", "cert_order", "file_id", "file_page"]
    body = numbered(body, [by], places, "place")
    if include_toc:
        lines = body.groupBy(by).agg(toc_pages(F.count_if(F.col("kind").isin("section", "entry"))).alias("front"))
        body = body.join(lines, by)
    front = F.col("front") if include_toc else F.lit(0)
    return body.select(by, (front + F.col("place")).cast("int").alias("page"), "kind", "title", "file_id", F.when(F.col("file_page") > 0, F.col("file_page")).alias("file_page"), (F.col("kind") != "section").alias("shows_number"))


def contents(pages: DataFrame, by: str = "profile_id") -> DataFrame:
    """Lines of the table of contents: toc_page, line, level, title and page."""
    lines = numbered(pages.where(F.col("kind").isin("section", "entry")), [by], ["page"], "place")
    return lines.withColumn("line", (F.col("place") - 1).cast("int")).select(by, toc_place(F.col("line")).alias("toc_page"), "line", (F.col("kind") == "entry").cast("int").alias("level"), "title", "page")
