import hashlib
import os
import re
import struct

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from keyfold.llm import bpe, ngram_join, pipeline, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small set of tables: clean, poor and repeated documents of two sources, with nulls."""
    import random

    rng = random.Random(11)
    lexicon = ["".join(rng.choice("aeiou") + rng.choice("rstln") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(400):
        words = [rng.choice(lexicon) for _ in range(rng.randint(20, 80))]
        grade = rng.choice([0, 2, 2, 2])
        if grade == 0:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "en", "ab"[i % 3 > 0], 0))
        labels.append((i, int(grade > 0), 0))
    for k in range(40):
        docs.append((400 + k, docs[k][1] + " tail" * (k % 2), "en", "a", 0))
    docs += [(500, None, "en", "a", 0), (501, "", "de", None, 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "source_mixing", "byte_level_bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(quality.rated(docs, spark.read.parquet(f"{folder}/labels.parquet")), 3)
    good = pipeline.quality_stage(spark, docs, folder)
    assert good.columns == COLUMNS
    want = {r["doc_id"] for r in quality.score(docs, model).where("tail >= 0.5").collect()}
    assert {r["doc_id"] for r in good.collect()} == want and 250 < len(want) < 400

    one = pipeline.ngram_stage(spark, good, folder)
    groups = {r["doc_id"]: r["component_id"] for r in ngram_join.groups(good).collect()}
    kept = {r["doc_id"]: r["text"] for r in one.collect()}
    assert one.columns == COLUMNS and set(kept) == {i for i, c in groups.items() if i == c} and len(kept) < len(want)

    mixed = pipeline.mixing_stage(spark, one, folder)
    rows, sources = mixed.collect(), {r["doc_id"]: r["source"] for r in one.collect()}
    assert mixed.columns == COLUMNS
    size = {i: len(WORD.findall(t or "")) for i, t in kept.items()}
    taken = {}
    for r in rows:
        own, part = WORD.findall(kept[r["doc_id"]]), WORD.findall(r["text"])
        assert part and any(own[k:k + len(part)] == part for k in range(len(own) - len(part) + 1))
        taken[r["source"]] = taken.get(r["source"], 0) + len(part)
    total = sum(size.values())
    by = {s: sum(n for i, n in size.items() if sources[i] == s) for s in set(sources.values()) if s}
    weights = {"a": 5 / 7, "b": 2 / 7}
    for s in by:
        assert abs(taken[s] - min(3 * by[s], weights[s] * total)) < 0.1 * total

    out = pipeline.bpe_stage(spark, mixed, folder)
    with open(pipeline.tokenizer_path(), "rb") as file:
        ranks = bpe.parse_ranks(file.read())
    truth = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = sorted((r["doc_id"], r["text"]) for r in rows)
    for (i, text), r in zip(texts, sorted(out.collect(), key=lambda r: (r["doc_id"], truth.decode(r["ids"]))), strict=True):
        ids = truth.encode_ordinary(text)
        assert r["doc_id"] == i and r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_run(spark, folder):
    from keyfold.session import work_folder

    base = os.path.dirname(work_folder(spark, "x"))
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:2] == ["doc_id", "n_tokens"] and 0 < out.count()
    assert len(set(os.listdir(base)) - before) == 1  # the result; all tables in between are gone


def test_run_of_odd_tables(spark, tmp_path):
    """Nulls, repeats, clashing columns, and no rows at all."""
    rows = [(1, None, None, None, None, "x"), (1, "a b c", "en", "s", 5, "x"), (1, "a b c", "en", "s", 5, "y"), (None, "d e f g h i", "en", "s", 11, "z"), (2, "", "en", None, 0, "w")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, row string"
    for name, part in (("some", rows), ("none", [])):
        path = str(tmp_path / name)
        spark.createDataFrame(part, kinds).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        out = corpus_pipeline.run(spark, path)
        assert out.columns[:2] == ["doc_id", "n_tokens"] and (name == "some" or out.count() == 0)


def test_ngram_stage_keeps_rows(spark):
    """Repeated ids and null ids: one row of each group stays."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(7, text(0)), (7, text(0)), (7, text(1)), (None, text(0)), (None, text(2)), (None, text(2)), (9, text(2) + " tail"), (3, text(3)), (None, text(4)), (None, text(4)), (8, ""), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.ngram_stage(spark, docs, "")
    want = [(7, text(0)), (7, text(1)), (9, text(2) + " tail"), (3, text(3)), (None, text(4)), (8, ""), (8, ""), (None, None)]
    assert kept.columns == COLUMNS
    assert sorted([(r["doc_id"], r["text"]) for r in kept.collect()], key=repr) == sorted(want, key=repr)
    assert pipeline.ngram_stage(spark, docs.limit(0), "").count() == 0


def test_mixing_stage_takes_whole_documents(spark):
    """No text is cut; a source passes its target by less than a document."""
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(90 + i)), "en", "ab"[i % 4 == 0], i) for i in range(40)]
    rows = pipeline.mixing_stage(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    by = {d[0]: d for d in docs}
    assert all(tuple(r) == by[r["doc_id"]] for r in rows)
    total = sum(90 + i for i in range(40))
    for source, weight in (("a", 5 / 7), ("b", 2 / 7)):
        target = weight * total
        assert target - 1 <= sum(len(r["text"].split()) for r in rows if r["source"] == source) < target + 130
