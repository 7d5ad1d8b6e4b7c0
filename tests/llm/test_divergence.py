import random
import re
from collections import Counter, defaultdict

import pytest
from keyfold.llm import divergence
from pyspark.sql import functions as F


def plain(rows, ranks=200):
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [((lang or ""), (source or ""), [t.translate(small) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in found}:
        mine, docs = [x for x in found if x[0] == lang], Counter()
        for _, _, ts in mine:
            docs.update(set(ts))
        kept = {t for t, d in docs.items() if d >= 3}
        counts, whole = defaultdict(Counter), Counter()
        for _, source, ts in mine:
            counts[source].update(t for t in ts if t in kept)
            whole.update(t for t in ts if t in kept)
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        for source in counts:
            pairs = [(sum(f(share(counts[source], t), share(counts[o], t)) for t in kept), o) for o in counts if o != source]
            for rank, (v, o) in enumerate(sorted(pairs, key=lambda x: (-x[0], x[1].encode())), 1):
                out.append((lang, source, "pair", o, v, rank))
            top = [(f(share(counts[source], t), share(whole, t)), t) for t in counts[source] if share(counts[source], t) > share(whole, t)]
            for rank, (v, t) in enumerate(sorted(top, key=lambda x: (-x[0], x[1].encode()))[:ranks], 1):
                out.append((lang, source, "term", t, v, rank))
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefghkz" for b in "aeiouéßя"] + ["Ab", "AB", "日本", "\U0001F600x", "�z", "x1y", "a-b", "it's"]
    rows = [(" ".join(rng.choice(words[:rng.choice([20, 80, 88])]) for _ in range(rng.choice([0, 3, 40, 150]))), rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s2", "s3", "", None])) for _ in range(n)]
    return rows + [(None, "en", "blank"), ("", "fr", "x"), ("rare words", "fr", "y"), ("a " * 3000, "en", "s1"), (rows[0][0], "en", "s2")] * 2


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, rows_of, seed, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50 * seed)
    rows = made(seed, 80)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, n long, term int").repartition(3)
    assert sorted(rows_of(divergence.audit(docs), *COLUMNS)) == plain(rows)


def test_ranks_end_inside_ties(spark, rows_of):
    """More terms of one value than ranks: the first in UTF-8 order fill them."""
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "zyxwvuéя" for b in "abcdef" for c in "ghijkl"]
    rows = [(" ".join(rng.sample(words, len(words))), "en", "one")] * 3 + [("other thing here", "en", "two")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = sorted(rows_of(divergence.audit(docs), *COLUMNS))
    assert got == plain(rows) and sum(r[2] == "term" and r[1] == "one" for r in got) == 200


def test_large_counts_stay_exact(spark):
    big = 7 * 10**17 + 123
    row = spark.range(1).select(divergence.share(F.lit(big), F.lit(9 * 10**17), F.lit(11))).first()
    assert row[0] == 1 + 10**9 * (big + 1) // (9 * 10**17 + 11)
    p, q = 1 + 10**9, 3
    assert spark.range(1).select(divergence.divergence(F.lit(p), F.lit(q))).first()[0] == (p - q) ** 2 // q


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
