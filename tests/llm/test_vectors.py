import pickle
import random

import numpy as np
import pytest
from keyfold.llm import components, near_vectors, top_k, vectors
from keyfold.session import staged


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "PIVOTS", 4)
    monkeypatch.setattr(top_k, "LEAF", 4)
    monkeypatch.setattr(top_k, "QUERIES", 3)


def table(spark, vecs):
    return spark.createDataFrame([(i, v, 0, "x", 1.0) for i, v in vecs], "vec_id long, embedding array<float>, label int, id string, dist double")


def sample(seed, n=160, dim=6):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)).astype(np.float32)
    base[n // 2:] = base[rng.integers(0, 8, n - n // 2)] + rng.normal(size=(n - n // 2, dim)).astype(np.float32) * 0.05
    vecs = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    odd = [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] * dim, [None] + [1.0] * (dim - 1), [1.0, 2.0], [float(x) for x in base[3]], [3e38] * dim]
    return vecs + [(n + k, v) for k, v in enumerate(odd)] + [(5, vecs[5][1]), (None, vecs[1][1])]


def good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_near_duplicates(spark):
    vecs = sample(1)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_duplicates(table(spark, vecs)).collect()}
    own = {i: np.array(np.float32(v), np.float64) for i, v in vecs if i is not None and good(v) and any(v)}
    links = {i: {j for j in own if j != i and len(own[i]) == len(own[j]) and own[i] @ own[j] / np.linalg.norm(own[i]) / np.linalg.norm(own[j]) >= 0.95} for i in own}
    assert sum(map(len, links.values())) > 100
    for i in {i for i, _ in vecs}:
        seen, todo = {i}, [i]
        while todo:
            more = links.get(todo.pop(), set()) - seen
            seen |= more
            todo += more
        least = None if i is None else min(seen)
        assert got[i] == (len(links.get(i, ())), least, i is None or least == i), i
    assert near_vectors.near_duplicates(table(spark, vecs).limit(0)).count() == 0


def test_near_vectors_are_stored_once(spark, monkeypatch):
    kept, plans = {}, {}

    def keep(df, label, *more):
        plans[label] = df._jdf.queryExecution().executedPlan().toString().splitlines()
        kept[label] = staged(df, label, *more)
        return kept[label]

    monkeypatch.setattr(near_vectors, "staged", keep)
    vecs = sample(1)
    near_vectors.links(table(spark, vecs))
    used = {i for i, v in vecs if i is not None and good(v) and any(v)}
    stored = [i for r in kept["blocks"].collect() for i in np.frombuffer(r["ids"], "<i8").tolist()]
    assert kept["blocks"].count() > 4 and sorted(stored) == sorted(used)
    assert all("(id" in line for line in plans["links"] if "Exchange" in line)


def test_near_double_vectors(spark):
    angles = np.arccos(0.95) + np.array([-1e-9, 1e-9]) * np.array([[1], [3], [10]])
    vecs = [(0, [2.0, 0.0])] + [(i, [3 * float(np.cos(a)), 3 * float(np.sin(a))]) for i, a in enumerate(angles.ravel(), 1)]
    frame = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_duplicates(frame).collect()}
    assert got == {0: 3, 1: 6, 2: 5, 3: 6, 4: 5, 5: 6, 6: 5}


def test_top_k(spark):
    vecs = sample(2)
    got = {}
    for r in top_k.top_k(table(spark, vecs), k=7, every=10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    own = {i: [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v] for i, v in vecs if i is not None and good(v)}
    want = {}
    for q in own:
        if q % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(own[q], v)), i) for i, v in own.items() if i != q)[:7]
            want[q] = {rank: (max(min(-s, 2**63 - 1), -(2**63) + 2), i) for rank, (s, i) in enumerate(scores, 1)}
    assert got == want
    assert top_k.top_k(table(spark, vecs).limit(0)).count() == 0
    two = top_k.top_k(table(spark, [(0, [1.0]), (100, [2.0])]))
    assert sorted(map(tuple, two.collect())) == [(0, 1, 100, 1024 * 2048), (100, 1, 0, 1024 * 2048)]


def test_top_k_sends_no_trees(spark):
    found = top_k.top_k(table(spark, sample(2)), k=7, every=10)
    plan = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("Broadcast" in line for line in plan)
    assert all("(query_id" in line for line in plan if "Exchange" in line)


@pytest.mark.parametrize("scale", [1, 1e3, 1e6, 1e30])
def test_cover_tree_pickled(scale):
    points = np.floor(np.random.default_rng(5).normal(size=(200, 5)) * scale)
    tree = top_k.CoverTree(np.arange(200), points)
    back = pickle.loads(pickle.dumps(tree))
    for name in ("ids", "points", "spans", "kids", "radii", "centres", "norms", "longest"):
        assert np.array_equal(getattr(tree, name), getattr(back, name)), name
    assert back.points.dtype == np.float64 and len(pickle.dumps(tree)) < 200 * 5 * 8 + 200 * 64


def test_cover_tree_covers():
    rng = np.random.default_rng(3)
    points = np.floor(rng.normal(size=(200, 5)) * 1000)
    points[50:80] = points[0]
    tree = top_k.CoverTree(np.arange(200), points)
    assert sorted(tree.ids.tolist()) == list(range(200))
    for node, (begin, end) in enumerate(tree.spans):
        assert np.linalg.norm(tree.points[begin:end] - tree.centres[node], axis=1).max() <= tree.radii[node] + 1e-9
        a, b = tree.kids[node]
        if a < b:
            assert [tuple(s) for s in tree.spans[a:b]][0][0] == begin and tree.spans[b - 1][1] == end


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000, k) for k in range(400, 460)] + [(k, k + 1) for k in range(2000, 2060)] + [(7, 7), (None, 3), (4, None)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    forest = components.Forest(3000)
    for a, b in edges:
        if a is not None and b is not None:
            forest.join(a, b)
    assert got == {i: forest.root(i) for e in edges for i in e if i is not None and forest.root(i) != i}
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0
