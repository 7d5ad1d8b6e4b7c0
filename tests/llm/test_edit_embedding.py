import hashlib
import random

import numpy as np
import pytest
from keyfold.llm import edit_embedding as ee


def plain_digits(text):
    """One walk, a step at a time, and its drawn steps."""
    bits, _ = ee._moves()
    codes = [*map(ord, text)]
    places, at = [], 0
    while at < len(codes):
        places.append(at)
        at += int(bits[(len(places) - 1) % ee.PERIOD][(codes[at] ^ codes[at] >> 8) % 255])
    keys, _ = ee._draws()
    out = []
    for digit in range(ee.SAMPLES):
        mine = [k - (digit << 41) for k in keys.tolist() if k >> 41 == digit]
        step = max(s for s in mine if s < max(len(places), 1))
        place = places[step] if places else 0
        total = 0
        for i in range(ee.SHOWN):
            code = codes[place + i] if place + i < len(codes) else 0x110000
            total = (total * 0x100000001B3 + code + 1) % 2**64
        shown = int(ee.mixed(np.array([total], np.uint64))[0])
        salt = (step + (digit << 41)) * 0x9E3779B97F4A7C15 % 2**64
        out.append(int(ee.mixed(np.array([(shown + salt) % 2**64], np.uint64))[0]) >> 60)
    return out


def text_of(rng, n):
    words = ["".join(rng.choice("abcdefghilmnoprstuéß") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    out = ""
    while len(out) < n:
        out += rng.choice(words) + " "
    return out[:n]


def changed(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        i, kind = rng.randrange(len(out)), rng.random()
        if kind < 1 / 3:
            del out[i]
        elif kind < 2 / 3:
            out.insert(i, rng.choice("xyz"))
        else:
            out[i] = rng.choice("xyz")
    return "".join(out)


def test_walks_agree():
    rng = random.Random(3)
    texts = ["", "a", "ab", "日本語", "😀" * 3, *[text_of(rng, n) for n in (5, 100, 101, 1500, 9000)]]
    together = ee.embedded(texts)
    for t, digits in zip(texts, together, strict=True):
        assert digits.tolist() == plain_digits(t)
        assert ee._alone(ee.codes_of(t)).tolist() == digits.tolist() or not t
        assert ee._together([ee.codes_of(t)])[0].tolist() == digits.tolist()


def test_likeness_follows_edits():
    rng = random.Random(1)
    few, many, far = [], [], []
    for _ in range(30):
        t = text_of(rng, 2000)
        a, b, c, d = ee.embedded([t, changed(rng, t, 5), changed(rng, t, 100), text_of(rng, 2000)])
        few.append(ee.likeness(a[None], b[None])[0])
        many.append(ee.likeness(a[None], c[None])[0])
        far.append(ee.likeness(a[None], d[None])[0])
    assert np.mean(few) > 0.8 and np.median(few) > 0.9 and 0.15 < np.mean(many) < 0.5 and max(far) < 0.1
    assert np.percentile(few, 10) > max(far)


def test_draws_are_uniform():
    for length in (1, 7, 1000, 10**6):
        steps = ee.drawn(np.array([length]))[0]
        assert steps.min() >= 0 and steps.max() < length
        assert length < 100 or 0.4 < steps.mean() / length < 0.6


def plain(rows):
    order = sorted(rows, key=lambda r: r[0])
    out = {}
    for (i, t), (_, f) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        e = t[:len(t) - half] + f[:half]
        a, b, c = plain_digits(t), plain_digits(e), plain_digits(f)
        near = lambda x, y: max(0.0, (sum(p == q for p, q in zip(x, y, strict=True)) / 256 - 1 / 16) / (15 / 16))
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(f"{d:x}" for d in a), "".join(f"{d:x}" for d in b), pytest.approx(near(a, b)), pytest.approx(near(a, c)))
    return out


COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.parametrize("parts", [1, 7])
def test_neighbours(spark, documents, parts, monkeypatch):
    rng = random.Random(parts)
    texts = [text_of(rng, n) for n in (40, 1, 300, 0, 77, 6000, 12)] + ["", None, "dü", "dü", text_of(rng, 301)]
    docs = documents(texts).repartition(parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts == 1)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in ee.neighbours(docs).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain([(i, t or "") for i, t in enumerate(texts)])


def test_odd_tables(spark, documents):
    assert ee.neighbours(documents(["x"]).limit(0)).collect() == []
    one = ee.neighbours(documents(["abcdefgh"])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdabcd").hexdigest() and one["near_next"] == 1
    twice = spark.createDataFrame([(5, "a"), (5, "b"), (None, "c"), (None, None), (9, "a")], "doc_id long, text string")
    rows = ee.neighbours(twice).collect()
    assert sorted((r["doc_id"] is None, r["n_chars"]) for r in rows) == [(False, 1)] * 3 + [(True, 0), (True, 1)]
    assert len({r["fingerprint"] for r in rows}) == 4


def test_near_groups(spark):
    rng = random.Random(8)
    rows, group = [], {}
    for g in range(12):
        t = text_of(rng, 1500)
        for k in range(rng.choice([1, 2, 6])):
            i = len(rows)
            rows.append((i, t if k == 1 else changed(rng, t, 2) if k else t))
            group.setdefault(g, []).append(i)
    rows += [(100, None), (None, rows[0][1])]
    marked = ee.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["component_id"] for r in ee.near_groups(marked).collect()}
    of = {i: g for g, members in group.items() for i in members}
    assert all(of[i] == of[got[i]] for i in of)  # different texts stay apart
    assert np.mean([got[i] == min(group[of[i]]) for i in of]) > 0.9
    assert all(got[m[1]] == m[0] for m in group.values() if len(m) > 1)  # equal texts
    assert got[100] == 100 and got[None] == 0
    pair = marked.limit(2).collect()
    a, b = (np.array([[int(c, 16) for c in r["fingerprint"]]]) for r in pair)
    df = spark.createDataFrame([(pair[0]["fingerprint"], pair[1]["fingerprint"])], "a string, b string")
    assert df.select(ee.likeness_of(df["a"], df["b"])).first()[0] == pytest.approx(ee.likeness(a, b)[0])
