"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(t_k - w.x): one weight vector over hashed text features is shared by all
grades, and ordered thresholds cut its scale. The expected grade and the tail probability of the
best grade serve selection. The model is fitted on a bounded sample of rated documents, the same at
every run; its weights (2**DIM_BITS numbers) travel to the tasks and every document is scored where
it lies, without a shuffle.

Features are the distinct words without marks around them, their beginnings, and levels of a few
ratios: capitals, marks, separators, immediate repeats, repeated five-word runs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .shingles import joined

#: Bits of a feature's number; rated documents the model is fitted on at most; least documents of a feature.
DIM_BITS, SAMPLE, RARE = 18, 6000, 5
#: Words whose features a worker keeps until its partition ends.
KEPT = 150_000
#: Penalties that may choose the features; the weak one that then fits them; ratings that judge the strong ones.
STRONG, WEAK, JUDGES = (1.6e-2, 8e-3, 4e-3, 2e-3), 2e-4, 2000
#: Rounds and step of the choice and of the fit at most; ratings of one in FOLDS documents judge the penalties;
#: times that features left out are tried again.
CHOICE, FIT, FOLDS, CHECKS = (300, 0.1), (600, 0.3), 4, 2
_LEVELS = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75])
_RATIOS = ("capitals", "marks", "separators", "repeats", "runs")
_EDGES = re.compile(r"^\W+|\W+$")
_MASK = (1 << DIM_BITS) - 1


def _number(kind: str, value: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}") & _MASK


_LEVEL_NUMBERS = np.array([[_number(name, str(level)) for level in range(len(_LEVELS))] for name in _RATIOS])


class Words(dict):
    """Per word as written: its two feature numbers and flags, in one integer."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        text = token.decode("utf-8", "replace")
        bare = _EDGES.sub("", text)
        letters = [c for c in bare if c.isalpha()]
        flags = (len(letters) > 1 and bare.isupper()) | (len(text) - len(bare) > 1) << 1 | (not bare) << 2
        low = bare.lower()
        value = self[token] = _number("word", low) | _number("begin", low[:4]) << DIM_BITS | flags << 2 * DIM_BITS | (xxhash.xxh3_64_intdigest(low) & 0xFFFFFF) << (2 * DIM_BITS + 3)
        return value


WORDS = Words()


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a whole text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").split()
    if not tokens:
        return _LEVEL_NUMBERS[:, 0]
    codes = np.fromiter(map(WORDS.__getitem__, tokens), np.int64, len(tokens))
    flags = codes >> 2 * DIM_BITS
    ratios = [(flags & 1).mean(), (flags >> 1 & 1).mean(), (flags >> 2 & 1).mean(), (codes[1:] == codes[:-1]).mean() if len(codes) > 1 else 0.0]
    runs = joined(codes.astype(np.uint64), 5) if len(codes) >= 5 else codes[:1]
    ratios.append(1 - len(np.unique(runs)) / len(runs))
    levels = np.searchsorted(_LEVELS, ratios, side="right") - 1
    bare = codes[flags >> 2 & 1 == 0]
    return np.unique(np.concatenate([bare & _MASK, bare >> DIM_BITS & _MASK, _LEVEL_NUMBERS[np.arange(len(levels)), levels]]))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, score: np.ndarray) -> np.ndarray:
        """Probabilities of the grades, a row per score."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))
        return np.diff(below, axis=1, prepend=0, append=1)


class _Ratings:
    """Rated documents as one sparse 0/1 matrix of the features that occur often enough."""

    def __init__(self, rows: list[tuple[np.ndarray, int]], grades: int):
        self.grades, self.number = grades, len(rows)
        self.grade = np.array([g for _, g in rows])
        self.counts = np.bincount(self.grade, minlength=grades) + 0.5
        weight = self.counts[self.grade] ** -0.35  # rarer grades weigh more
        self.weight = weight / weight.sum()
        own = np.repeat(np.arange(self.number), [len(f) for f, _ in rows])
        used, index = np.unique(np.concatenate([f for f, _ in rows]), return_inverse=True)
        live = np.bincount(index) >= min(RARE, max(self.number // 10, 1))
        stays = live[index]
        self.used, self.index, self.own = used[live], (np.cumsum(live) - 1)[index[stays]], own[stays]

    def start(self) -> tuple[np.ndarray, np.ndarray]:
        share = np.cumsum(self.counts)[:-1] / self.counts.sum()
        return np.zeros(len(self.used)), np.log(share / (1 - share))

    def slopes(self, score: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document: chance of its grade, slope of the loss by its score; slopes by the thresholds."""
        at, grade = np.arange(self.number), self.grade
        below = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - score[:, None], -500, 500)))
        full = np.c_[np.zeros(self.number), below, np.ones(self.number)]
        slope = full * (1 - full)
        p = np.maximum(full[at, grade + 1] - full[at, grade], 1e-12)
        up = self.weight * (slope[at, grade + 1] - slope[at, grade]) / p
        move = np.array([(self.weight / p * (np.where(grade == k + 1, slope[:, k + 1], 0) - np.where(grade == k, slope[:, k + 1], 0))).sum() for k in range(self.grades - 1)])
        return p, up, move

    def gradient(self, w: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
        _, up, _ = self.slopes(np.bincount(self.own, weights=w[self.index], minlength=self.number), thresholds)
        return np.bincount(self.index, weights=up[self.own], minlength=len(w))

    def train(self, w: np.ndarray, thresholds: np.ndarray, live: np.ndarray, penalty: float, rounds: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """Proximal gradient steps scaled per weight, on the `live` features; ends early once the loss stands still."""
        stays = live[self.index]
        index, own = (np.cumsum(live) - 1)[self.index[stays]], self.own[stays]
        x, seen, seen_t, last = w[live], np.full(int(live.sum()), 1e-12), np.full(self.grades - 1, 1e-8), np.inf
        for turn in range(rounds):
            p, up, move = self.slopes(np.bincount(own, weights=x[index], minlength=self.number), thresholds)
            if turn % 25 == 24:
                loss = -(self.weight * np.log(p)).sum() + penalty * np.abs(x).sum()
                if last - loss < 1e-5 * max(loss, 1e-3) and turn > 100:
                    break
                last = loss
            step = np.bincount(index, weights=up[own], minlength=len(x))
            seen += step * step
            pace = rate / np.sqrt(seen)
            x = x - pace * step
            x = np.sign(x) * np.maximum(np.abs(x) - pace * penalty, 0)
            seen_t += move * move
            thresholds = np.maximum.accumulate(thresholds - 0.3 / np.sqrt(seen_t) * move)
        out = np.zeros(len(w))
        out[live] = x
        return out, thresholds

    def model(self, penalty: float) -> Model:
        """Features are tried whose slope can overcome the penalty, first from zero weights, then from
        those found; then the weak penalty fits the chosen ones."""
        w, thresholds = self.start()
        live = np.zeros(len(w), bool)
        for _ in range(CHECKS):
            more = np.abs(self.gradient(w, thresholds)) > penalty * (1 if live.any() else 0.5)
            if not (more & ~live).any():
                break
            live |= more
            w, thresholds = self.train(w, thresholds, live, penalty, *CHOICE)
        if w.any():
            w, thresholds = self.train(w, thresholds, w != 0, WEAK, *FIT)
        weights = np.zeros(1 << DIM_BITS)
        weights[self.used] = w
        return Model(weights, thresholds)


def fit(rows: list[tuple[np.ndarray, int]], grades: int) -> Model:
    """Maximum likelihood in two passes: a strong L1 penalty chooses the features, a weak one then
    fits those. The strong penalty is the one of STRONG whose model, fitted to the first JUDGES
    ratings without every FOLDS-th, makes those likeliest; the larger of equals. For all ratings
    it falls as their number grows, so that a feature needs the backing of as many documents as before."""
    if len({g for _, g in rows}) < 2:
        counts = np.bincount([g for _, g in rows], minlength=grades) + 0.5
        share = np.cumsum(counts)[:-1] / counts.sum()
        return Model(np.zeros(1 << DIM_BITS), np.log(share / (1 - share)))
    judges = rows[:JUDGES]
    rest, held = [r for i, r in enumerate(judges) if i % FOLDS], judges[::FOLDS]
    best, penalty = -np.inf, STRONG[0]
    if len({g for _, g in rest}) > 1:
        ratings, grade = _Ratings(rest, grades), np.array([g for _, g in held])
        for p in STRONG:
            model = ratings.model(p)
            chance = model.grades(np.array([model.weights[f].sum() for f, _ in held]))[np.arange(len(held)), grade]
            likely = np.log(np.maximum(chance, 1e-6)).sum()
            if likely > best:
                best, penalty = likely, p
    return _Ratings(rows, grades).model(penalty * max(len(rest), 1) / len(rows))


def rated(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[np.ndarray, int]]:
    """Features and grade of at most `sample` rated documents: 0 poor, 1 good but toxic, 2 good.

    Of several ratings of a document the lowest counts; ratings with a null are left out."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [features(t).astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "grade": batch.column("grade"), "features": pa.array(found, pa.list_(pa.int32()))})
        WORDS.clear()

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")  # at most `sample` rows
    rows = texts.mapInArrow(run, "doc_id long, grade int, features array<int>").orderBy("doc_id").toArrow()
    values, grades = rows["features"].to_pylist(), rows["grade"].to_pylist()
    return [(np.array(f, np.int64), g) for f, g in zip(values, grades, strict=True)]


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, expected_grade, tail (probability of the best grade)."""
    kind = docs.schema[id_col].dataType.simpleString()
    weights = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32))  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scores = np.array([weights.value[features(t)].sum(dtype=np.float64) for t in batch.column("text").to_pylist()])
            p = model.grades(scores)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "expected_grade": p @ np.arange(p.shape[1]), "tail": p[:, -1]})
        WORDS.clear()

    model = Model(np.zeros(0), model.thresholds)
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        run, f"id {kind}, expected_grade double, tail double").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, model: Model, least: float, *, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose tail probability is at least `least`."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            scores = np.array([weights.value[features(t)].sum(dtype=np.float64) for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(model.grades(scores)[:, -1] >= least))
        WORDS.clear()

    weights = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32))
    model = Model(np.zeros(0), model.thresholds)
    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, *, least: float = 0.5) -> DataFrame:
    """Fit and score: doc_id, expected_grade, tail, keep.

    Null and empty texts have only the lowest levels of the ratios; repeated rows score alike; without
    ratings of at least two grades all documents get the grades' shares. An empty table gives
    an empty result; columns other than doc_id and text are ignored."""
    model = fit(rated(docs, labels), 3)
    return score(docs, model).withColumn("keep", F.col("tail") >= least)
