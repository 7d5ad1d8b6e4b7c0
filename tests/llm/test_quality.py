import os
import random

import numpy as np
import pytest
from keyfold.llm import quality

DATA = "/root/testdata/sf0.1"


def made(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeiou") + rng.choice("rstln") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    texts, grades = [], []
    for _ in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        kind = rng.choice(["good", "good", "good", "toxic", "caps", "marks", "repeat"])
        if kind == "toxic":
            t[rng.randrange(len(t))] = rng.choice(["vile", "nasty"])
        if kind == "caps":
            t = [w.upper() for w in t]
        if kind == "marks":
            t = [w + rng.choice(["***", "$$$"]) for w in t]
        if kind == "repeat":
            t = [w for w in t[:10] for _ in range(8)]
        texts.append(" ".join(t))
        grades.append({"good": 2, "toxic": 1}.get(kind, 0))
    return texts, grades


def test_held_out_accuracy(spark, documents):
    texts, grades = made(1, 1200)
    docs = documents(texts)
    labels = spark.createDataFrame([(i, int(g > 0), int(g == 1), "x") for i, g in enumerate(grades) if i < 600] + [(3, None, 0, "x"), (None, 1, 1, "y"), (10**6, 1, 0, "z")],
                                   "doc_id long, quality int, toxic int, text string")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 1200
    right = [got[i]["keep"] == (g == 2) for i, g in enumerate(grades) if i >= 600]
    assert np.mean(right) > 0.97
    mean = [np.mean([got[i]["expected_grade"] for i in range(600, 1200) if grades[i] == g]) for g in (0, 1, 2)]
    assert mean == sorted(mean)
    model = quality.fit(quality.rated(docs, labels), 3)
    kept = {r["doc_id"] for r in quality.keep(docs, model, 0.5).collect()}
    assert kept == {i for i, r in got.items() if r["keep"]}


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the given tables")
def test_given_ratings(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(quality.rated(docs, labels.where("doc_id % 3 <> 0")), 3)
    rest = quality.score(docs.where("doc_id % 3 = 0"), model).join(labels, "doc_id").toPandas()
    clean, poor = rest[(rest.quality == 1) & (rest.toxic == 0)], rest[rest.quality == 0]
    assert (clean["tail"] >= 0.5).mean() > 0.98 and (poor["tail"] < 0.5).mean() > 0.9


def test_odd_tables(spark, documents):
    docs = documents([None, "", "word", "word"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, none).collect()
    assert len(got) == 4 and len({r["tail"] for r in got}) == 1
    assert quality.classify(docs.limit(0), none).count() == 0


def test_probabilities():
    model = quality.Model(np.zeros(1), np.array([-1.0, 2.0]))
    p = model.grades(np.array([-3.0, 0.0, 5.0]))
    assert np.allclose(p.sum(1), 1) and (p >= 0).all() and (np.diff(p @ np.arange(3)) > 0).all()
