import itertools
import random
import re

import numpy as np
import pytest
from keyfold.llm import filter_audit

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    """Per row the letters it fails, one rule at a time."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found = set()
        if len(words) < 50:
            found.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            found.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            found.add("C")
        if re.search(r"[#$%&*|]", text):
            found.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows):
            found.add("E")
        out.append(found)
    return out


def plain(rows, labels):
    failed, out = fails(rows), {}
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    for part in {s or "" for _, _, s in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = set(mine)
            for step, f in enumerate(order, 1):
                gone = {i for i in left if f in failed[i]}
                left -= gone
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in failed[i] for i in mine) - len(gone), sum(failed[i] == {f} for i in mine),
                    sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["#tag", "LOUD", "A&B"]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 and texts:
            texts.append(rng.choice(texts))
        else:
            texts.append(" ".join(rng.choice(words[:rng.choice([5, 300, 300, 303])]) for _ in range(rng.choice([3, 49, 50, 80, 120]))))
    texts += [None, "", "", "x " * 5000, "ABC" * 40, "É" * 60]
    return [(rng.choice([i, i, i, max(i - 1, 0)]), t, rng.choice(["a", "a", "b", None, ""])) for i, t in enumerate(texts)] + [(None, "", "a"), (None, texts[0], "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed, 120)
    labels = [(i, random.Random(i).choice([0, 1, None]), random.Random(-i).choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 1), (None, 1, 1), (10**6, 1, 0)]
    docs = spark.createDataFrame([(*r, "y", 3) for r in rows], "doc_id long, text string, source string, part string, mask int").repartition(5)
    ratings = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in filter_audit.audit(docs, ratings).collect()}
    assert got == plain(rows, labels)


def test_ranges_and_common_copies(spark, monkeypatch):
    """Lists of several ranges, and texts with more copies than the broadcast's share."""
    monkeypatch.setattr(filter_audit, "RANGE_BITS", 3)
    monkeypatch.setattr(filter_audit, "HOT_SHARE", 4)
    rows = [(i, "same text" if i % 3 else f"own {i % 7}", "ab"[i % 2]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in filter_audit.audit(docs, none).collect()}
    assert got == plain(rows, [])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []


def test_merges():
    rng = np.random.default_rng(5)
    for _ in range(300):
        lists = [np.unique(rng.integers(0, rng.choice([5, 50, 500]), rng.integers(0, 60))) for _ in range(rng.integers(0, 6))]
        everything = set().union(*map(set, (x.tolist() for x in lists)))
        merged = filter_audit.union(lists)
        assert merged.tolist() == sorted(everything)
        for x in lists:
            other = filter_audit.union([y for y in lists if y is not x])
            assert filter_audit.difference(x, other).tolist() == sorted(set(x.tolist()) - set(other.tolist()))


def test_too_many_filters(spark):
    with pytest.raises(ValueError):
        filter_audit.interactions(spark.range(1), spark.range(1), "ABCDEFG")
