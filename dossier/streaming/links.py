"""The links that a log of events leaves, kept as state of a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dossier.operators.links import EXTRA, LINKING

EVENT = "file_id long, seq long, kind string, entry_id long"
UPDATE = "file_id long, version long, entry_id long, is_confirmed boolean"


def absorbed(held: dict, seq: int, kind: str, entry: int | None) -> None:
    """Takes an event into a file's state: its last decision, and its last extra link or deletion of each entry.

    All are maxima by seq, so events may come in any order and more than once.
    """
    if kind != "combo":
        held["decided"] = True
    if kind not in EXTRA and seq >= held.get("main", [seq])[0]:
        held["main"] = [seq, kind, entry]
    if kind in EXTRA and entry is not None and seq >= held.setdefault("pairs", {}).get(str(entry), [seq])[0]:
        held["pairs"][str(entry)] = [seq, kind]


def links_of(held: dict) -> list[tuple[int | None, bool]]:
    """Entry and confirmation of each link of a file: the rules of ``operators.links.state``."""
    at, kind, entry = held.get("main", [-1, None, None])
    pairs = held.get("pairs", {})
    entry = entry if kind in LINKING else None
    confirmed = kind == "confirm"
    last = pairs.get(str(entry))
    if last and last[1] == "delete" and last[0] > at:
        entry, confirmed = None, False
    out = [(entry, confirmed)] if held.get("decided") else []
    return out + [(int(e), True) for e, (_, k) in pairs.items() if k == "combo" and int(e) != entry]


def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's events without those that others of it outdate, so that a busy file sends few."""
    for batch in batches:
        part = batch["kind"].isin(EXTRA)
        newest = lambda rows, by: rows.loc[rows.groupby(by, dropna=False)["seq"].idxmax()]
        yield pd.concat([newest(batch[~part], ["file_id"]), newest(batch[part], ["file_id", "entry_id", "kind"])])


def link_updates(events: DataFrame) -> DataFrame:
    """The links of each file that new events are about: file_id, version (how often they have been told), entry_id (null: none) and is_confirmed.

    ``events``: a stream of file_id, seq, kind and entry_id. The last version of a file holds all its links, whatever way the
    log was cut into micro-batches; see ``latest``.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        for batch in batches:
            for seq, kind, entry in zip(batch["seq"], batch["kind"], batch["entry_id"], strict=True):
                absorbed(held, int(seq), kind, None if pd.isna(entry) else int(entry))
        held["version"] = held.get("version", 0) + 1
        state.update((json.dumps(held),))
        rows = [(key[0], held["version"], entry, confirmed) for entry, confirmed in links_of(held)]
        out = pd.DataFrame(rows, columns=["file_id", "version", "entry_id", "is_confirmed"])
        yield out.astype({"file_id": "int64", "version": "int64", "entry_id": "Int64", "is_confirmed": "bool"})

    e = events.select(F.col("file_id").cast("long"), F.col("seq").cast("long"), "kind", F.col("entry_id").cast("long")).where("file_id is not null and seq is not null")
    few = e.mapInPandas(reduced, EVENT)
    return few.groupBy("file_id").applyInPandasWithState(update, UPDATE, "held string", "update", GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame) -> DataFrame:
    """file_id, entry_id and is_confirmed of each file's last version among ``updates``, as ``operators.links.state`` has them."""
    last = updates.groupBy("file_id").agg(F.max("version").alias("version"))
    return updates.join(last, ["file_id", "version"]).select("file_id", "entry_id", "is_confirmed").distinct()
