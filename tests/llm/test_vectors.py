"""The operators on embeddings against plain loops: their queries on whole tables, and rows of every odd kind."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from dossier.llm import codebooks, negatives, queries, vector_dedup
from dossier.llm.oracles import ORACLES

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, label long, embedding array<double>"
NAN, INF = float("nan"), float("inf")


def vectors(n, seed, dim=8, spread=3):
    """Ties, repeated rows, copies, near copies, missing parts, other lengths, and numbers from the very small to the very large."""
    rng = random.Random(seed)
    whole = lambda: [rng.randint(-spread, spread) / 4 for _ in range(dim)]
    rows = [(k, rng.randrange(4), whole()) for k in range(n)]
    rows += [(n + k, rng.randrange(4), list(rows[k % 7][2])) for k in range(30)]
    rows += [(n + 40 + k, rows[k % 5][1], [v * (1 + rng.random() / 20) + 0.01 for v in rows[k % 5][2]]) for k in range(30)]
    rows += [rows[3], rows[3], rows[0], (5, 1, whole()), (None, 1, whole()), (None, None, whole()), (900, None, whole()), (1000, 2, None), (1001, 2, [])]
    rows += [(1100, 2, [NAN] * dim), (1101, 1, [1.0] * (dim - 1) + [None]), (1102, 1, [INF] + [0.0] * (dim - 1)), (1103, 3, [0.0] * dim), (1200, 0, [1.0, 2.0]), (1201, 0, [2.0, 4.1]), (1300, 1, [0.5, 0.25])]
    rng.shuffle(rows)
    return rows


HUGE = [(0, 0, [1e300, 1.0]), (1, 0, [3e300, 2.0]), (2, 1, [1e300, -1.0]), (3, 1, [1e-310, 1e-310]), (4, 1, [2e-310, 2.1e-310]), (5, 0, [1e12, 1e12]), (6, 1, [1e12, 1e12]), (100, 1, [0.0, 1.0])]


def wide(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.selectExpr("'x' as row", "*", "1 as uid", "2 as dim", "'p' as payload", "3 as code", "4 as rank", "struct(1 as `x y`) as `s.t`", "'t' as `tick``s`", "5 as score", "6 as n_links", "7 as near")


def sound(x):
    return x is not None and all(v is not None and math.isfinite(v) for v in x)


def held(v, scale, most):
    p = v * scale
    return int(max(-most, min(most, math.floor(p) if math.isfinite(p) else math.copysign(most, p))))


def mined(rows):
    top = (1 << 63) - 1
    v = [(i, lab, [held(x, 256, top) for x in e]) for i, lab, e in rows if i is not None and lab is not None and sound(e)]
    dot = lambda a, b: max(-top, min(top, sum(x * y for x, y in zip(a, b, strict=True))))
    out = []
    for i, lab, a in v:
        if i % 100:
            continue
        scored = sorted((-dot(a, c), j, other) for j, other, c in v if len(c) == len(a))
        for p, j, _ in [s for s in scored if s[2] == lab and s[1] != i][:5]:
            window = [s for s in scored if s[2] != lab and 80 * -p <= 100 * -s[0] <= 100 * -p]
            out += [(i, j, k + 1, s[1], -p, -s[0]) for k, s in enumerate(window[:5])]
    return sorted(out)


@pytest.mark.parametrize(("seed", "anchors"), [(1, 1024), (2, 2)])
def test_hard_negatives_against_a_loop(spark, monkeypatch, seed, anchors):
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    rows = vectors(210, seed)
    got = negatives.hard_negatives(wide(spark, rows))
    want = mined(rows)
    assert len(want) > 30 and sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(negatives, "MOST_BYTES", 0)
    assert sorted(map(tuple, negatives.hard_negatives(wide(spark, rows)).collect())) == want


def test_hard_negatives_odd(spark):
    assert sorted(map(tuple, negatives.hard_negatives(wide(spark, HUGE)).collect())) == mined(HUGE)
    empty = negatives.hard_negatives(wide(spark, HUGE).where("false"))
    assert empty.count() == 0 and len(empty.columns) == 6
    assert negatives.hard_negatives(wide(spark, [(0, 1, [1.0]), (1, 2, [1.0])])).count() == 0  # no positive
    assert negatives.scores(np.array([[1 << 40, 1]]), np.array([[1 << 40, 5], [3, 1 << 62]])).tolist() == [[(1 << 63) - 1, (3 << 40) + (1 << 62)]]


def lloyd(rows, parts=4, size=256, rounds=4):
    most = (1 << 31) - 1
    v = [(i, lab, [held(x, 1024, most) for x in e]) for i, lab, e in rows if sound(e)]
    named = sorted((i, x) for i, _, x in v if i is not None)[:size]
    dim = len(named[0][1]) if named else 0
    fits = [r for r in v if dim and dim % parts == 0 and len(r[2]) == dim]
    none = [(i, lab, None, None) for i, lab, x in v if not (dim and dim % parts == 0 and len(x) == dim)]
    if not fits:
        return sorted(none, key=str), []
    sub = dim // parts
    cut = lambda x, p: x[p * sub : (p + 1) * sub]
    books = [[cut(x, p) for _, x in named if len(x) == dim] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        at = [[near(cut(x, p), books[p])[1] for _, _, x in fits] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(r[2], p) for r, k in zip(fits, at[p], strict=True) if k == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    done = []
    for i, lab, x in fits:
        best = [near(cut(x, p), books[p]) for p in range(parts)]
        done.append((i, lab, [e for _, e in best], min(sum(d for d, _ in best), (1 << 63) - 1)))
    return sorted(done + none, key=str), books


@pytest.mark.parametrize(("seed", "size", "groups"), [(1, 256, 16), (2, 16, 4), (3, 3, 16)])
def test_product_codes_against_a_loop(spark, seed, size, groups):
    rows = vectors(150, seed, spread=40)
    got = codebooks.compress(wide(spark, rows), size=size, groups=groups)
    want, books = lloyd(rows, size=size)
    assert sorted([(r.vec_id, r.label, r.code, r.error) for r in got.rows.collect()], key=str) == want
    assert [b.tolist() for b in got.books] == books and None in [w[2] for w in want]
    by_label = {}
    for _, label, _, error in want:
        by_label[label] = by_label.get(label, 0) + (error or 0)
    assert all((r.label_error or 0) == by_label[r.label] for r in codebooks.with_label_error(got.rows).collect())


def test_product_codes_odd(spark):
    for rows in (HUGE, [(k, 0, [float(k)] * 3) for k in range(4)], [(None, 0, [1.0] * 4)], [(1, None, [])]):
        got, (want, books) = codebooks.compress(wide(spark, rows), parts=2 if rows is HUGE else 4), lloyd(rows, parts=2 if rows is HUGE else 4)
        assert sorted([(r.vec_id, r.label, r.code, r.error) for r in got.rows.collect()], key=str) == want
        assert [b.tolist() for b in got.books] == books
    empty = codebooks.compress(wide(spark, HUGE).where("false"))
    assert empty.rows.count() == 0 and empty.books == []


def test_bounds_skip_work_and_change_nothing():
    rng = np.random.default_rng(4)
    x = rng.integers(-1000, 1000, (40, 4))[rng.integers(0, 40, 3000)] * 8 + rng.integers(-40, 40, (3000, 4))
    book = codebooks.Codebook.first(x[:256], 16)
    near, low, total = np.zeros(len(x), int), np.zeros((len(x), len(book.groups)), np.float16), []
    for _ in range(5):
        near, least, low, work = book.nearest(x, near, low)
        d = ((x[:, None] - book.entries) ** 2).sum(2)
        assert (near == d.argmin(1)).all() and (least == d.min(1)).all()
        own = np.arange(256) == near[:, None]
        for g, members in enumerate(book.groups):
            nearest_other = np.sqrt(np.where(own[:, members], np.inf, d[:, members]).min(1))
            assert (low[:, g].astype(float) <= nearest_other).all()
        total.append(work)
        sums = np.array([x[near == e].sum(0) // max((near == e).sum(), 1) if (near == e).any() else book.entries[e] for e in range(256)])
        book = book.moved(sums)
    assert total[0] > len(x) * 256 and max(total[2:]) < len(x) * 256 / 2


def linked(rows, least=0.98):
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    scaled = [[math.ldexp(x, -math.frexp(max(map(abs, e)))[1]) for x in e] if sound(e) and any(e) else None for _, _, e in rows]
    link = {k: [] for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if scaled[a] and scaled[b] and rows[a][1] is not None and rows[a][1] == rows[b][1] and len(scaled[a]) == len(scaled[b]) and (cos(scaled[a], scaled[b]) >= least):
                link[a].append(b)
                link[b].append(a)
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            todo += (new := [b for b in link[todo.pop()] if b not in seen])
            seen |= set(new)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        first = min(ids) if ids else None
        out.append((rows[a][0], len(link[a]), first, rows[a][0] == first))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "tile"), [(1, 4096), (2, 7)])
def test_vector_links_against_a_loop(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(vector_dedup, "TILE_ROWS", tile)
    rows = vectors(160, seed, dim=4, spread=2)
    want = linked(rows)
    assert sum(w[1] for w in want) > 100 and sorted(map(tuple, vector_dedup.near_vectors(wide(spark, rows)).collect()), key=str) == want
    assert sorted(map(tuple, vector_dedup.near_vectors(wide(spark, HUGE)).collect()), key=str) == linked(HUGE)
    assert vector_dedup.near_vectors(wide(spark, HUGE).where("false")).count() == 0


@pytest.mark.parametrize("dim", [3, 64, 1500])
def test_error_bounds_hold(dim):
    rng = np.random.default_rng(dim)
    u, _ = vector_dedup.units(rng.normal(size=(60, dim)) ** 3)
    q, step, error = vector_dedup.quantised(u)
    approximate = (q.astype(float) @ q.T.astype(float)) * step[:, None] * step
    assert (np.abs(u @ u.T - approximate) <= error * (1 + error[:, None]) + error[:, None]).all()


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_vector_codes", "op13_vector_dedup"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names and len(want) > 0
    assert sorted(map(str, got[names].itertuples(index=False, name=None))) == sorted(map(str, want[names].itertuples(index=False, name=None)))


def test_codebook_digest(spark):
    found = codebooks.compress(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert [b.shape for b in found.books] == [(256, 16)] * 4
    assert found.sha256() == hashlib.sha256(",".join(str(v) for b in found.books for e in b.tolist() for v in e).encode()).hexdigest()
