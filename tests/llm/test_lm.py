import math
import random
import zlib
from collections import Counter

import pytest
from keyfold.llm import lm


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def test_scores(spark, documents, monkeypatch):
    monkeypatch.setattr(lm, "RANGE", 50)
    monkeypatch.setattr(lm, "CHUNK", 900)
    monkeypatch.setattr(lm, "BLOCK", 70)
    monkeypatch.setattr("keyfold.llm.common.SLICE_BYTES", 300)
    rng = random.Random(8)
    lexicon = [rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(40)]
    follows = {w: rng.sample(lexicon, 3) for w in lexicon}
    texts = []
    for _ in range(120):
        w, out = rng.choice(lexicon), []
        for _ in range(rng.randint(0, 40)):
            out.append(w if rng.random() > 0.02 else f"new{rng.random()}")
            w = rng.choice(follows[w])
        texts.append(" ".join(out))
    texts += [None, "", "A É b\tC", texts[0], "x " * 4000]
    rows = {r["doc_id"]: r for r in lm.scores(documents(texts).repartition(3)).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in enumerate(texts)}
    uni, bi = Counter(), Counter()
    for i, t in tokens.items():
        if not held(i):
            uni.update(t)
            bi.update(zip([b"\n", *t], t))
    n, v = sum(uni.values()), len(uni)
    obs = Counter()
    for (h, w), c in bi.items():
        obs[(int(math.log2(uni[h])), int(lm._bins((c - 1) / max(uni[h] - 1, 1))), int(lm._bins((uni[w] - 1) / (n - 1))))] += c
    weights = lm.learn([(*k, c) for k, c in obs.items()], v)
    assert all(abs(sum(x) - 1) < 1e-9 for x in weights.values())
    for i, t in tokens.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(t), sum(uni[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        total = 0.0
        for h, w in zip([b"\n", *t], t):
            bucket = int(math.log2(uni[h] + 1))
            l2, l1, l0 = weights.get(min(bucket, max(weights)), [1 / 3] * 3)
            if not uni[h]:
                l2, l1, l0 = 0, l1 / (l1 + l0), l0 / (l1 + l0)
            total += math.log10(l2 * bi[h, w] / max(uni[h], 1) + l1 * uni[w] / n + l0 / (v + 1))
        assert r["score"] == pytest.approx(total)
    test = [r for i, r in rows.items() if held(i) and i < 120]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)  # it has learned what follows what


def test_odd_tables(spark, documents):
    assert lm.scores(documents(["a"]).limit(0)).count() == 0
    only = next(i for i in range(100) if held(i))
    r = lm.scores(documents(["a b"] * (only + 1)).where(f"doc_id = {only}")).first()
    assert (r["train_tokens"], r["n_known"], r["n_tokens"]) == (0, 0, 3) and math.isfinite(r["score"])
    null = lm.scores(spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_tokens"]) for r in null} == {(None, 3), (1, 1)}


def test_packing():
    import numpy as np

    x = np.array([0, 1, 255, 256, 2**40, 5], np.int64)
    assert lm.unpack(lm.pack(x, "<i8"), "<i8").tolist() == x.tolist()
    assert lm.unpack(lm.pack(x[:0], "<i8"), "<i8").tolist() == []


def test_pairs_use_the_whole_hash(monkeypatch):
    """Pairs whose hashes differ in any bit keep different keys in their ranges."""
    import numpy as np
    import zstandard

    monkeypatch.setattr(lm, "mixed", lambda x: np.arange(len(x), dtype=np.uint64) + np.uint64(0xABCDEF12_34000000))
    tokens = np.array([0, 1, 2, 0, 2, 1, 1, 3], np.int32)
    row = {"docs": [0], "lengths": lm.pack(np.array([8]), "<i4"), "tokens": lm.pack(tokens, "<i4"), "names": zstandard.compress(b"a b c \n")}
    for ranges in (1, 200, 12_500, 1_000_003):
        c = lm.Chunk(row, ranges)
        assert len({(r, k) for r, a, b in c.ranges for k in c.keys[a:b].tolist()}) == len(c.keys) == 8
        assert all((c.keys[a:b][1:] > c.keys[a:b][:-1]).all() for _, a, b in c.ranges)
        assert np.cumsum(lm.unpack(lm.pack(np.diff(c.keys, prepend=np.uint64(0)), "<u8"), "<u8")).tolist() == c.keys.tolist()
