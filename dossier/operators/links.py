"""Links between files and entries: an event log and its state, statuses, coverage and re-import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.operators.order import numbered

#: Entries of one part of a title's list.
PICKED = 1000
#: Kinds of events that leave a file linked (others leave it without its main link), and those of one more entry of a file.
LINKING, EXTRA = ("confirm", "suggest"), ("combo", "delete")


def status(confirmed: Column, linked: Column) -> Column:
    """Status of an entry from its numbers of confirmed and of all links."""
    return F.when(confirmed > 0, "confirmed").when(linked > 0, "suggested").otherwise("none")


def entry_status(entries: DataFrame, links: DataFrame) -> DataFrame:
    """``entries`` with n_links, n_confirmed and status. ``links``: entry_id, is_confirmed."""
    n = links.where("entry_id is not null").groupBy("entry_id").agg(F.count(F.lit(1)).alias("n_links"), F.count_if("is_confirmed").alias("n_confirmed"))
    return entries.join(n, "entry_id", "left").fillna(0, ["n_links", "n_confirmed"]).withColumn("status", status(F.col("n_confirmed"), F.col("n_links")))


def rollup(statuses: DataFrame, levels: list[str]) -> DataFrame:
    """Counts by status at each of ``levels``, in total, and the covered share; null marks a level summed over."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("none", "suggested", "confirmed")]
    out = statuses.rollup(*levels).agg(*counts, F.count(F.lit(1)).alias("n_total"), F.grouping_id().alias("level"))
    return out.withColumn("coverage", F.when(F.col("n_total") > 0, F.col("n_confirmed") / F.col("n_total")).otherwise(0.0))


def pending(statuses: DataFrame) -> DataFrame:
    return statuses.where("status <> 'confirmed'")


def limbo(links: DataFrame) -> DataFrame:
    """Files without an entry that nobody rejected."""
    return links.where("entry_id is null and not is_rejected")


def next_order(entries: DataFrame, links: DataFrame) -> DataFrame:
    """entry_id and the next free place for a file."""
    top = links.groupBy("entry_id").agg(F.max("cert_order").alias("top"))
    return entries.select("entry_id").join(top, "entry_id", "left").select("entry_id", (F.coalesce("top", F.lit(-1)) + 1).alias("next_order"))


def state(events: DataFrame) -> DataFrame:
    """The links that a log leaves: file_id, entry_id (null: the file is without one) and is_confirmed.

    ``events``: file_id, seq, kind, entry_id. A file's main link is that of its last confirm or suggest, or none after a
    skip, an undo or a delete of it. A combo links the file to one more entry, confirmed, unless that is its main one; a
    later delete of the pair takes it away. Last events are maxima, so a busy file's log is summed in part.
    """
    of_pair = F.col("kind").isin(*EXTRA)
    main = events.where(F.col("kind") != "combo").groupBy("file_id").agg(
        F.max_by(F.struct("kind", "entry_id"), F.when(F.col("kind") != "delete", F.col("seq"))).alias("e"), F.max(F.when(F.col("kind") != "delete", F.col("seq"))).alias("at")
    )
    last = events.where(of_pair & F.col("entry_id").isNotNull()).groupBy("file_id", "entry_id").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("at"))
    gone = last.where("kind = 'delete'").select("file_id", F.col("entry_id").alias("deleted"), F.col("at").alias("deleted_at"))
    linked = F.col("e.kind").isin(*LINKING)
    main = main.select("file_id", "at", F.when(linked, F.col("e.entry_id")).alias("entry_id"), F.coalesce(F.col("e.kind") == "confirm", F.lit(False)).alias("is_confirmed"))
    hit = (F.col("m.file_id") == F.col("g.file_id")) & (F.col("m.entry_id") == F.col("g.deleted")) & (F.col("g.deleted_at") > F.col("m.at"))
    main = main.alias("m").join(gone.alias("g"), hit, "left")
    main = main.select("m.file_id", F.when(F.col("g.deleted").isNull(), F.col("m.entry_id")).alias("entry_id"), (F.col("m.is_confirmed") & F.col("g.deleted").isNull()).alias("is_confirmed"))
    more = last.where("kind = 'combo'").select("file_id", "entry_id").join(main.where("entry_id is not null").select("file_id", "entry_id"), ["file_id", "entry_id"], "left_anti")
    return main.unionByName(more.withColumn("is_confirmed", F.lit(True)))


def confirm_suggested(pending_: DataFrame, confident: float = 0.90) -> DataFrame:
    """Events that confirm all suggestions of at least ``confident``: file_id, kind, entry_id. ``pending_``: file_id, entry_id, score."""
    return pending_.where((F.col("score") >= confident) & F.col("entry_id").isNotNull()).select("file_id", F.lit("confirm").alias("kind"), "entry_id")


def confirm_entry(links: DataFrame, entries: DataFrame) -> DataFrame:
    """``links`` with all those of ``entries`` (entry_id) confirmed."""
    chosen = entries.select("entry_id", F.lit(True).alias("chosen")).distinct()
    return links.join(chosen, "entry_id", "left").withColumn("is_confirmed", F.col("is_confirmed") | F.coalesce("chosen", F.lit(False))).drop("chosen")


def delete_links(links: DataFrame, gone: DataFrame) -> DataFrame:
    """``links`` without those in ``gone`` (entry_id, or entry_id and file_id); the others of an entry close up."""
    key = [c for c in ("entry_id", "file_id") if c in gone.columns]
    return reorder(links.join(gone.select(*key).distinct(), key, "left_anti"))


def toggle(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """``links`` where those in ``chosen`` (entry_id, file_id) have changed between suggested and confirmed."""
    key = ["entry_id", "file_id"]
    marked = links.join(chosen.select(*key, F.lit(True).alias("chosen")).distinct(), key, "left")
    return marked.withColumn("is_confirmed", F.col("is_confirmed") != F.coalesce("chosen", F.lit(False))).drop("chosen")


MANUAL_SECTION = "Outros Documentos"


def delete_manual(sections: DataFrame, entries: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and links without the documents in ``gone`` (entry_id), where they were added by hand; links go with them."""
    manual = entries.join(sections.where(F.col("title") == MANUAL_SECTION).select("section_id"), "section_id", "left_semi").join(gone, "entry_id", "left_semi").select("entry_id")
    return entries.join(manual, "entry_id", "left_anti"), links.join(manual, "entry_id", "left_anti")


def add_manual(sections: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections, and entries for ``documents`` (profile_id, entry_id, title); a profile's section for them is made once, and stands last."""
    has = sections.where(F.col("title") == MANUAL_SECTION).select("profile_id", F.col("section_id").alias("there"))
    wanted = documents.select("profile_id").distinct().join(has, "profile_id", "left")
    new = wanted.where("there is null").select(F.concat_ws("-", "profile_id", F.lit("manual")).alias("section_id"), "profile_id", F.lit(MANUAL_SECTION).alias("title"), F.lit((1 << 63) - 1).alias("section_order"))
    all_ = sections.select("section_id", "profile_id", "title", "section_order").unionByName(new)
    at = all_.where(F.col("title") == MANUAL_SECTION).select("profile_id", "section_id")
    place = F.row_number().over(Window.partitionBy("profile_id").orderBy("entry_id")) - 1
    return all_, documents.join(at, "profile_id").withColumn("entry_order", place).withColumn("kind", F.lit("Documento"))


def reimport(old_entries: DataFrame, new_entries: DataFrame, links: DataFrame, rank_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and links after a text is read anew.

    ``old_entries``: entry_id, hash_key, section_title; ``new_entries`` also section_order and entry_order; ``links``:
    file_id, entry_id, text, is_confirmed. Entries added by hand stay with their files. A file goes to the first new entry
    of its old one's hash; one without such an entry that has text goes to its best ranked new entry of at least 0.90
    (``rank_table``), unconfirmed; what is left has no entry.
    """
    manual = old_entries.where(F.col("section_title") == MANUAL_SECTION)
    old = old_entries.select("entry_id", "hash_key", (F.col("section_title") == MANUAL_SECTION).alias("stays"))
    f = links.join(old, "entry_id", "left").withColumnRenamed("entry_id", "old_id")
    first = new_entries.groupBy("hash_key").agg(F.min(F.struct("section_order", "entry_order", "entry_id")).alias("e"))
    f = f.join(first.select("hash_key", F.col("e.entry_id").alias("by_hash")), "hash_key", "left")
    best = rank_table.where("rank = 1 and score >= 0.90").select("file_id", F.col("entry_id").alias("by_text"))
    f = f.join(best, "file_id", "left")
    usable = F.when(F.length(F.coalesce("text", F.lit(""))) > 0, F.col("by_text"))
    stays = F.coalesce("stays", F.lit(False))
    entry = F.when(stays, F.col("old_id")).otherwise(F.coalesce("by_hash", usable))
    kept = F.col("is_confirmed") & (stays | F.col("by_hash").isNotNull())
    return new_entries.select("entry_id", "hash_key", "section_title").unionByName(manual.select("entry_id", "hash_key", "section_title")), f.select("file_id", entry.alias("entry_id"), kept.alias("is_confirmed"))


def rejections(events: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct (file_id, hash_key) of refused suggestions: skipped, or confirmed for another entry.

    ``events`` also has suggested_id. Undoing a decision leaves what it taught.
    """
    refused = events.where("suggested_id is not null and (kind = 'skip' or (kind = 'confirm' and entry_id <> suggested_id))")
    return refused.join(entries.select(F.col("entry_id").alias("suggested_id"), "hash_key"), "suggested_id").select("file_id", "hash_key").distinct()


def without_rejected(pairs: DataFrame, rejected: DataFrame) -> DataFrame:
    return pairs.join(rejected, ["file_id", "hash_key"], "left_anti")


def relink(files: DataFrame, entries: DataFrame) -> DataFrame:
    """``files`` (file_id, hash_key) with the entry_id of the first new entry of that hash, or null."""
    first = entries.groupBy("hash_key").agg(F.min(F.struct("section_order", "entry_order", "entry_id")).alias("e"))
    return files.join(first, "hash_key", "left").select("file_id", "hash_key", F.col("e.entry_id").alias("entry_id"))


def relink_fallback(left: DataFrame, rank_table: DataFrame, least: float = 0.90) -> DataFrame:
    """For files that ``relink`` left without an entry: the best ranked one of at least ``least``, or null."""
    best = rank_table.where((F.col("rank") == 1) & (F.col("score") >= least)).select("file_id", F.col("entry_id").alias("best"))
    return left.join(best, "file_id", "left").select("file_id", F.coalesce("entry_id", "best").alias("entry_id"))


def reorder(links: DataFrame) -> DataFrame:
    """``links`` with cert_order dense from 0 in each entry, by order and then import date."""
    w = Window.partitionBy("entry_id").orderBy("cert_order", "import_date", "file_id")
    return links.withColumn("cert_order", F.row_number().over(w) - 1)


def move(links: DataFrame, moves: DataFrame) -> DataFrame:
    """``links`` where each file in ``moves`` (entry_id, file_id, to) takes place ``to`` of its entry, and the others close up."""
    dense = reorder(links).join(moves, ["entry_id", "file_id"], "left")
    key = F.when(F.col("to").isNull(), F.col("cert_order") * 2).otherwise(F.col("to") * 2 + F.when(F.col("to") > F.col("cert_order"), 1).otherwise(-1))
    w = Window.partitionBy("entry_id").orderBy("key", "file_id")
    return dense.withColumn("key", key).withColumn("cert_order", F.row_number().over(w) - 1).drop("key", "to")


def readable(files: DataFrame) -> DataFrame:
    """Files with text that are without an entry: those that a re-match may help."""
    return files.where((F.length(F.coalesce("text", F.lit(""))) > 0) & F.col("entry_id").isNull())


def existing(links: DataFrame, listing: DataFrame) -> DataFrame:
    """``links`` whose file is still there."""
    return links.join(listing.select("path").distinct(), "path", "left_semi")


def picker(sections: DataFrame, entries: DataFrame, size: int = PICKED) -> DataFrame:
    """title, part (from 0) and entries (ids in order) of each section title: what a file can be linked to by hand.

    A title's list comes in parts of ``size`` entries, numbered by counts of each task, so no task holds a whole one; ordered by
    title and part they are the menu.
    """
    joined = entries.join(sections.select("section_id", "title"), "section_id").select("title", "entry_order", "entry_id")
    placed = numbered(joined, ["title"], ["entry_order", "entry_id"], "place").withColumn("part", F.floor((F.col("place") - 1) / size))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "entry_id"))), lambda x: x["entry_id"])
    return placed.groupBy("title", "part").agg(listed.alias("entries"))


def confirmed_entries(statuses: DataFrame) -> DataFrame:
    """One row: how many entries have a confirmed file, whatever period a report is of."""
    return statuses.agg(F.count_if(F.col("status") == "confirmed").alias("n_entries"))


def cascade(profiles: DataFrame, sections: DataFrame, entries: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, ...]:
    """All tables after the profiles in ``gone`` (profile_id) and what hangs on them are deleted."""
    keep = lambda t: t.join(gone, "profile_id", "left_anti")
    left = keep(sections)
    return keep(profiles), left, entries.join(left.select("section_id"), "section_id", "left_semi"), keep(links)


def unlink_deleted(links: DataFrame, entries: DataFrame) -> DataFrame:
    """``links`` whose entry is gone become files without one."""
    there = entries.select("entry_id", F.lit(True).alias("there"))
    return links.join(there, "entry_id", "left").withColumn("entry_id", F.when(F.col("there"), F.col("entry_id"))).drop("there")


def incremental(found: DataFrame, linked: DataFrame) -> DataFrame:
    """Paths found that are not linked yet."""
    return found.join(linked.select("path").distinct(), "path", "left_anti")
