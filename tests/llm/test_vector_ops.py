"""Operators on embeddings against brute force, and on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratakv.llm import crosspolytope, vptree

VECTORS = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


@pytest.fixture(scope="module")
def clustered():
    """Clusters of close vectors, exact copies, scaled copies, and noise, under few labels."""
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for c in range(12):
        center = rng.normal(size=24)
        for _ in range(40 if c == 0 else 12):
            v = center + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.12, 0.3])
            rows.append((n, (v * rng.choice([1.0, 2.0])).astype(np.float32).tolist(), int(c % 3)))
            n += 1
    for _ in range(60):
        rows.append((n, rng.normal(size=24).astype(np.float32).tolist(), int(rng.integers(0, 3))))
        n += 1
    rows += [(n + i, rows[0][1], 0) for i in range(30)]
    return rows


ODD = [
    (1000, None, 0),
    (1001, [], 0),
    (1002, [0.0] * 24, 0),
    (1003, [float("nan")] + [1.0] * 23, 0),
    (1004, [float("inf")] + [1.0] * 23, 0),
    (1005, [None] + [1.0] * 23, 0),
    (1006, [1.0] * 24, None),
    (1007, [1.0] * 24, None),
    (1050, [1.0] * 7, 0),
    (None, [1.0] * 24, 0),
]


def usable(v, d=24):
    return v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    return float(np.add.reduce(a * b) / (np.sqrt(np.add.reduce(a * a)) * np.sqrt(np.add.reduce(b * b))))


def nearest_brute(rows, every, k):
    live = [(i, v) for i, v, _ in rows if i is not None and v and usable(v, len(v))]
    out = {}
    for q, v in live:
        if q % every == 0:
            found = sorted((-cosine(v, w), i) for i, w in live if i != q and len(w) == len(v))[:k]
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return {q: found for q, found in out.items() if found}


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_factor_one_is_exact(spark, clustered, monkeypatch):
    monkeypatch.setattr(vptree, "LEAF", 8)
    monkeypatch.setattr(vptree, "GROUP", 2)
    rows = clustered + ODD
    trees = vptree.build(frame(spark, rows), shard_rows=64)
    assert trees.where("d = 24").count() > 2
    queries = frame(spark, rows).where("vec_id % 10 = 0")
    got = by_query(vptree.nearest(trees, queries, 5, factor=1.0, block=7))
    want = nearest_brute(rows, 10, 5)
    assert got.keys() == want.keys()
    for q, found in want.items():
        assert [(r, i) for r, i, _ in got[q]] == [(r, i) for r, i, _ in found]
        assert [s for *_, s in got[q]] == pytest.approx([s for *_, s in found], abs=1e-12)


def test_lengths_magnitudes_and_repeated_ids(spark):
    """Each length has its own neighbours; tiny and huge vectors take part; one id may have two vectors."""
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=2 + i % 3) * 10.0 ** rng.choice([-200, -3, 0, 150])).tolist(), 0) for i in range(120)]
    rows += [(0, [1.0, -1.0], 0), (50, [1e-320] * 2, 0), (50, [1e-320] * 2, 0), (7, [5.0, 5.0], 0), (8, [5.0, 5.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in vptree.search_table(df, every=50, factor=1.0).collect()]
    want = []
    live = [(i, np.array(v) / np.abs(v).max()) for i, v, _ in rows]
    for q, v in {(i, tuple(v)) for i, v in live if i % 50 == 0}:
        found = sorted((-round(cosine(v, w), 12), i) for i, w in live if i != q and len(w) == len(v))[:5]
        want += [(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(found)]
    assert sorted(got) == sorted(want)


def test_recall_with_relaxed_pruning(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = by_query(vptree.search_table(frame(spark, rows)))
    want = {}
    live = [(i, np.asarray(v, dtype=float)) for i, v, _ in rows]
    for q, v in live:
        if q % 50 == 0:
            want[q] = [i for _, i in sorted((-cosine(v, w), i) for i, w in live if i != q)[:5]]
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i, _ in got[q]} & set(want[q])) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize(("inner", "share"), [(3, 0.25), (6, 0.7)])
def test_chosen_factors_skip_most_where_vectors_have_structure(inner, share):
    """Vectors of 64 components on surfaces of few dimensions: a part of the distances, recall of 0.95."""
    rng = np.random.default_rng(0)
    data = rng.normal(size=(4000, inner)) @ rng.normal(size=(inner, 64)) + rng.normal(size=(4000, 64)) * 0.01
    data = vptree.scaled(data)
    tree, ids = vptree.Tree(vptree.unit(data)), np.arange(len(data))
    factor = vptree.choose_factor(tree, data, 5, 0)
    asked = ids[::20]
    exact, _ = vptree.search(tree, data, ids, data[asked], asked, 5, 1.0)
    found, seen = vptree.search(tree, data, ids, data[asked], asked, 5, factor)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found.id, exact.id, strict=True)]) >= 0.95
    assert seen < share * len(asked) * len(data)


def test_larger_factors_skip_more():
    rng = np.random.default_rng(0)
    data = np.concatenate([rng.normal(size=(1, 8)) + rng.normal(size=(200, 8)) * 0.1 for _ in range(20)])
    tree, ids = vptree.Tree(vptree.unit(data)), np.arange(len(data))
    costs = [vptree.search(tree, data, ids, data[:50], ids[:50], 5, f)[1] for f in (1.0, 2.0, 8.0)]
    assert costs[0] < 50 * len(data)
    assert costs[0] >= costs[1] >= costs[2]


def test_few_rows(spark):
    assert vptree.search_table(frame(spark, [])).count() == 0
    assert vptree.search_table(frame(spark, [(0, [1.0, 0.0], 1)])).count() == 0
    got = by_query(vptree.search_table(frame(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.0], 1)])))
    assert [i for _, i, _ in got[0]] == [2, 1]
    odd = frame(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1)]).withColumn("id", F.lit("clash")).withColumn("shard", F.lit("clash"))
    assert vptree.search_table(odd).count() == 1


def links_brute(rows):
    n, up = {}, {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    live = []
    for i, v, label in rows:
        if i is None:
            continue
        n.setdefault(i, 0)
        up.setdefault(i, i)
        if label is not None and v is not None and usable(v, len(v)) and len(v):
            for j, w, other in live:
                if other == label and len(w) == len(v) and cosine(v, w) >= 0.98:
                    n[i] += 1
                    n[j] += 1
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
            live.append((i, v, label))
    return {(i, n[i], find(i), find(i) == i) for i in n}


@pytest.mark.parametrize(("block", "dense"), [(512, 64), (5, 0.1), (5, 1e-9)])
def test_embedding_links_match_brute_force(spark, clustered, monkeypatch, block, dense):
    """Also with buckets of many blocks, and with tables of two and of four rotations."""
    monkeypatch.setattr(crosspolytope, "BLOCK", block)
    monkeypatch.setattr(crosspolytope, "DENSE", dense)
    rows = clustered + ODD
    got = crosspolytope.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got if r["vec_id"] is not None} == links_brute(rows)
    assert all(r["component_id"] is None and r["kept"] and r["n_links"] == 0 for r in got if r["vec_id"] is None)


def test_embedding_links_of_few_rows(spark):
    assert crosspolytope.near_duplicates(frame(spark, [])).count() == 0
    rows = [(5, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (9, [1.0, 0.0], 2), (5, [1.0, 0.0], 1), (7, [-0.0, 1.0], 1), (8, [0.0, 1.0], 1)]
    odd = frame(spark, rows).withColumn("cls", F.lit("clash")).withColumn("v", F.lit("clash"))
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in crosspolytope.near_duplicates(odd).collect()}
    assert got == {(5, 2, 3), (3, 2, 3), (9, 0, 9), (7, 1, 7), (8, 1, 7)}


def test_tiny_and_huge_vectors_link(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, ((base + rng.normal(size=16) * 0.02) * size).tolist(), 1) for i, size in enumerate([1e-200] * 4 + [1e200] * 4 + [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in crosspolytope.near_duplicates(df).collect()} == {(i, 8, 0) for i in range(9)}


def test_blocks_of_many_near_copies_at_large_d():
    """Pairs at the threshold of 768 components, counted as plain products do; memory is bounded by strips."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=768)
    data = crosspolytope.scaled(base + rng.normal(size=(600, 768)) * 0.15)
    cls, part = np.arange(600), np.zeros(600, dtype=int)
    keys = np.zeros((600, 1, 1), dtype=np.int64)
    linked, a, b = crosspolytope.compare(0, 0, 0, cls, np.ones(600, dtype=int), part, keys, data)
    u = data / np.linalg.norm(data, axis=1, keepdims=True)
    close = (u @ u.T >= 0.98) & ~np.eye(600, dtype=bool)
    assert 0 < close.sum() < 600 * 599
    assert linked.tolist() == close.sum(axis=1).tolist()
    label = np.arange(600)
    while (new := np.minimum(label, np.where(close, label[None, :], 600).min(axis=1))).tolist() != label.tolist():
        label = new
    up = list(range(600))
    find = lambda x: x if up[x] == x else find(up[x])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert find(x) != find(y)
        up[max(find(x), find(y))] = min(find(x), find(y))
    assert [find(x) for x in range(600)] == label.tolist()


@pytest.mark.parametrize("d", [3, 24, 64, 768])
def test_rotations_keep_lengths_and_rarely_miss(d):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, d))
    if d == 64:
        assert np.allclose((crosspolytope.hadamard(x) ** 2).sum(axis=1), (x**2).sum(axis=1))
    r = rng.normal(size=x.shape)
    r -= (r * x).sum(axis=1, keepdims=True) / (x * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x / np.linalg.norm(x, axis=1, keepdims=True) + np.sqrt(1 - 0.98**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    agree = [(crosspolytope.axes(x, t)[:, :, None] == crosspolytope.axes(y, t)[:, None, :]).any(axis=(1, 2)).mean() for t in range(4)]
    assert 1 - np.mean(agree) < crosspolytope.miss(d)
    for depth in (1, 2):
        n = crosspolytope.tables(depth, d)
        a, b = crosspolytope.bucket_keys(x, depth, n), crosspolytope.bucket_keys(y, depth, n)
        assert a.shape[1:] == (n, 2**depth)
        assert (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).all()
