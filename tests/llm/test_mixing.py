import random
import re
from fractions import Fraction

import pytest
from keyfold.llm import mixing


def plain_targets(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed, free, total = {}, set(order), sum(sizes.values())
    while True:
        rest, all_weight = Fraction(total - sum(fixed.values())), sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] > cap * sizes[s] * all_weight}
        if not over:
            return {**fixed, **{s: rest * weight[s] / all_weight for s in free}}
        fixed.update({s: cap * sizes[s] for s in over})
        free -= over


@pytest.mark.parametrize("seed", [1, 2])
def test_taken(spark, documents, seed):
    rng = random.Random(seed)
    texts = [" ".join("w" for _ in range(rng.choice([0, 1, 3, 40, 300]))) for _ in range(300)] + [None, "", "\t\n ", "a b c", "x " * 5000] + ["same words here"] * 5
    sources = ["b", "a", "é", "Z", None, "aa", "tiny"] if seed == 1 else ["only"]
    docs = documents(texts, sources)
    docs = docs.unionByName(docs.where("doc_id < 4"))
    rows = mixing.taken(docs).collect()
    assert len(rows) == len(texts) + 4
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    want, taken = plain_targets(sizes), {}
    for r in rows:
        assert r["size"] == size(texts[r["doc_id"]]) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(want[r["source"]]))
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    again = mixing.taken(docs.repartition(3)).collect()
    assert sorted(map(repr, ((r["doc_id"], r["taken"]) for r in again))) == sorted(map(repr, ((r["doc_id"], r["taken"]) for r in rows)))


def test_mixture_blocks(spark, documents):
    docs = documents([" ".join(["w"] * k) for k in (1000, 300, 7, 129, 2500)], ["a", "b"])
    mixture, members = mixing.mix(docs)
    rows = mixture.collect()
    by_slot = {}
    for r in rows:
        by_slot.setdefault((r["source_no"], r["rank"]), []).append(r["words"])
    assert all(sum(w) <= mixing.BLOCK for w in by_slot.values())
    assert sum(sum(w) == mixing.BLOCK for w in by_slot.values()) >= len(by_slot) - 2
    positions = [r["position"] for r in rows if r["position"] is not None]
    half = [r["source_no"] for r in rows if r["position"] is not None and r["position"] < max(positions) / 2]
    assert {0, 1} == set(half)  # sources alternate along the schedule


def test_empty(spark, documents):
    assert mixing.taken(documents(["a"]).limit(0)).count() == 0
    assert [r["taken"] for r in mixing.taken(documents([None, ""])).collect()] == [0, 0]
