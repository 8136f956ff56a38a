"""Lists of what a file can be linked to by hand."""

import random

import duckdb

from dossier.operators import links
from dossier.plans import catalog

SF = "/root/testdata/sf0.001"


def test_picker_groups_by_title_and_sorts(spark):
    rng = random.Random(2)
    sections = [(k, rng.choice(["A", "B", "C", None])) for k in range(30)]
    entries = [(rng.randrange(33), n, rng.randrange(20)) for n in range(500)]
    titles = dict(sections)
    wanted = {}
    for s, n, at in sorted(entries, key=lambda e: (e[2], e[1])):
        if s in titles:
            wanted.setdefault(titles[s], []).append(n)
    got = links.picker(spark.createDataFrame(sections, "section_id long, title string"), spark.createDataFrame(entries, "section_id long, entry_id long, entry_order long"), 7).collect()
    assert all(0 < len(r.entries) <= 7 for r in got)
    found = {}
    for r in sorted(got, key=lambda r: r.part):
        found.setdefault(r.title, []).extend(r.entries)
    assert found == wanted


def test_entry_picker_has_a_sorted_list_for_each_title(spark):
    con = duckdb.connect()
    pairs = con.sql(f"select c_mktsegment, o_orderkey from '{SF}/orders.parquet' join '{SF}/customer.parquet' on c_custkey = o_custkey order by all").fetchall()
    wanted = {}
    for title, order in pairs:
        wanted.setdefault(title, []).append(str(order))
    got = [(r.title, r.entries.split(",")) for r in catalog.QUERIES["entry_picker"](spark, SF).collect()]
    assert sorted(got) == sorted(wanted.items())
