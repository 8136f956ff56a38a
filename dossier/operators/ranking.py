"""Journal ranks: a cascade of lookups by ISSN, title, ISSN of an equal title, and similar titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import text as tx
from dossier.sources.shared import cut

#: Periods in their order, and what a similar title must share.
QUADS = ("2016_2019", "2017_2020", "2021_2024")
SHARED_WORDS, SHARE, WORD_CHARS = 2, 0.8, 3


def areas(ranks: DataFrame) -> DataFrame:
    return ranks.select("area").distinct().orderBy("area")


def _title_words(title):
    return F.array_distinct(F.filter(F.split(title, " "), lambda w: F.length(w) >= WORD_CHARS))


def lookups(ranks: DataFrame, area: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """By ISSN and by title the last row's rank of an area; by title the ISSN of all areas.

    ``ranks``: quad, row_no, issn, title, area, estrato. Of a title's ISSNs the last of a period counts, and that
    of the first period that has one.
    """
    mine = ranks.where((F.col("area") == area) & (F.col("estrato") != ""))
    by_issn = mine.where("issn <> ''").groupBy("quad", "issn").agg(F.max_by("estrato", "row_no").alias("estrato"))
    by_title = mine.where("title <> ''").groupBy("quad", "title").agg(F.max_by("estrato", "row_no").alias("estrato"))
    place = F.array_position(F.array(*map(F.lit, QUADS)), F.col("quad"))
    cross = ranks.where("title <> '' and issn <> ''").groupBy("quad", "title").agg(F.max_by("issn", "row_no").alias("issn"))
    return by_issn, by_title, cross.groupBy("title").agg(F.min_by("issn", place).alias("cross_issn"))


def similar(venues: DataFrame, ranks: DataFrame, area: str) -> DataFrame:
    """entry_id and estrato of the best similar title: at least SHARED_WORDS words and SHARE of the shorter one.

    Of equal shares the earliest row counts. Distinct titles and venues meet, not rows. What shares enough words
    with the shorter of two shares one of its rarest, n + 1 less the least that must agree; so only those are join
    keys on the shorter's side, and a frequent word never meets itself.
    """
    ranked = ranks.where((F.col("area") == area) & (F.col("estrato") != "") & (F.col("title") != ""))
    titles = ranked.groupBy("quad", "title").agg(F.min_by("estrato", "row_no").alias("estrato"), F.min("row_no").alias("row_no"))
    mine = venues.select("entry_id", "quad", tx.norm_title(F.col("venue")).alias("title"))
    df = titles.select(F.explode(_title_words(F.col("title"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))

    def with_words(rows: DataFrame) -> DataFrame:
        each = rows.select("quad", "title", F.explode(_title_words(F.col("title"))).alias("word")).join(df, "word", "left")
        o = each.groupBy("quad", "title").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word"))).alias("o"))
        o = o.withColumns({"n": F.size("o"), "w": F.transform("o", lambda x: x["word"])}).where(F.col("n") >= SHARED_WORDS)
        least = F.greatest(F.lit(SHARED_WORDS), F.ceil(F.round(F.col("n") * SHARE, 6))).cast("int")
        return cut(o.select("quad", "title", "n", "w", F.slice("w", F.lit(1), F.col("n") - least + 1).alias("rare")))

    left, right = with_words(mine.select("quad", "title").distinct()), with_words(titles)
    side = lambda rows, keys, as_: rows.select("quad", F.explode(keys).alias("word"), F.struct("title", "n", "w").alias(as_))
    shorter = side(left, "rare", "v").join(side(right, "w", "t"), ["quad", "word"]).where("v.n <= t.n")
    longer = side(left, "w", "v").join(side(right, "rare", "t"), ["quad", "word"]).where("v.n > t.n")
    met = shorter.unionByName(longer).select("quad", "v", "t").distinct()
    both = F.size(F.array_intersect("v.w", "t.w"))
    good = met.withColumn("both", both).withColumn("share", F.col("both") / F.least("v.n", "t.n")).where((F.col("both") >= SHARED_WORDS) & (F.col("share") >= SHARE))
    good = good.select("quad", F.col("v.title").alias("venue"), F.col("t.title").alias("title"), "share").join(titles, ["quad", "title"])
    best = good.groupBy("quad", "venue").agg(F.max_by("estrato", F.struct("share", -F.col("row_no"))).alias("near"))
    return mine.withColumnRenamed("title", "venue").join(best, ["quad", "venue"]).select("entry_id", "near")


def classify(entries: DataFrame, ranks: DataFrame, area: str) -> DataFrame:
    """entry_id, quadriennium, estrato (null: unranked) and how it was found. ``entries``: entry_id, venue, issn, year."""
    by_issn, by_title, cross = lookups(ranks, area)
    e = entries.select("entry_id", "venue", tx.quad_key(F.col("year")).alias("quad"), tx.norm_issn(F.col("issn")).alias("issn"), tx.norm_title(tx.journal_name(F.col("venue"))).alias("title"))
    e = e.join(by_issn.withColumnRenamed("estrato", "r_issn"), ["quad", "issn"], "left")
    e = e.join(by_title.withColumnRenamed("estrato", "r_title"), ["quad", "title"], "left")
    e = e.join(cross, "title", "left").join(by_issn.select("quad", F.col("issn").alias("cross_issn"), F.col("estrato").alias("r_cross")), ["quad", "cross_issn"], "left")
    exact = F.coalesce("r_issn", "r_title", "r_cross")
    open_ = e.where(exact.isNull()).select("entry_id", "venue", "quad")
    e = e.join(similar(open_, ranks, area), "entry_id", "left")
    how = F.when(F.col("r_issn").isNotNull(), "issn").when(F.col("r_title").isNotNull(), "title").when(F.col("r_cross").isNotNull(), "cross").when(F.col("near").isNotNull(), "similar")
    return e.select("entry_id", F.translate("quad", "_", "-").alias("quadriennium"), F.coalesce(exact, "near").alias("estrato"), how.alias("how"))


def best_of(table: DataFrame, by: list[str], order: list) -> DataFrame:
    return table.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def with_ranks(entries: DataFrame, ranked: DataFrame) -> DataFrame:
    """``entries`` of a report with the rank of each article (null for other kinds, and for unranked ones)."""
    return entries.join(ranked.select("entry_id", "estrato"), "entry_id", "left").withColumn("estrato", F.when(F.col("kind") == "Artigo", F.col("estrato")))
