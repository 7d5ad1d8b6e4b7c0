import itertools
import random

import numpy as np
import pytest
from keyfold.llm import ngram_join
from keyfold.llm.components import Forest


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def plain(texts):
    sets, forest = [shingles(t) for t in texts], Forest(len(texts))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            forest.join(i, j)
    return {i: (len(s), forest.root(i)) for i, s in enumerate(sets)}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyzuvw") + rng.choice(["", "k", "q"])
    text = lambda n: [word() for _ in range(n)]
    passage, texts = text(30), []
    for _ in range(12):
        base = text(rng.randint(6, 90))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(passage + text(rng.randint(0, 14))) for _ in range(25)]
    texts += [None, "", " \t", "one two", "One  TWO", "one two three", "é É", texts[0].upper(), "a b", "w " * 3000, "a b c d e", "A b C d e"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, documents, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "STAR", 6)
    monkeypatch.setattr(ngram_join, "RANGE", 300)
    monkeypatch.setattr(ngram_join, "EXTRA", [25, 6, 3][seed - 1])
    texts = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.groups(documents(texts)).collect()}
    assert got == plain(texts)


def test_odd_tables(spark, documents):
    assert ngram_join.groups(documents(["a"]).limit(0)).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u"), (3, "q r s t u")], "doc_id long, text string")
    got = sorted(ngram_join.groups(rows).collect(), key=repr)
    assert [(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None] == [(1, 1), (1, 1), (2, 1), (2, 1), (3, 1)]
    assert len(got) == 6


def test_trie_alone():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 25))).astype(np.uint64) for _ in range(120)]
    sets += [sets[0], sets[1][:-1] if len(sets[1]) > 1 else sets[1]]
    forest, want = ngram_join.trie_links(sets, 75), Forest(len(sets))
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            want.join(i, j)
    assert [forest.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]
