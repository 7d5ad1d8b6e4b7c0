"""Document fingerprints by a randomised edit embedding.

A pointer walks over a text: at each step the text shows the few characters at the pointer, and a
random bit, the same for all texts with that step and character, moves the pointer on or not. Texts
of a small edit distance soon walk together again, so their walks differ in few steps: edit distance
becomes Hamming distance. The fingerprint samples the walk: for each of SAMPLES digits a step is
drawn, uniform among the walk's steps and shared by walks of other lengths as far as they
have it, and 4 bits of what the walk shows there are kept. Two fingerprints agree in as many digits as
the walks agree in steps, but for one chance in sixteen, which `likeness` takes out.

Near texts are found by bit-sampled banding: bands of some digits meet in a shuffle, each
text is held against the first of its band, and whole fingerprints verify the pair.

Walks of one length are walked together with numpy, a step at a time; very long texts alone.
Only the shown characters of drawn steps are kept of a walk, so a long text needs no room."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, staged
from .components import components
from .shingles import mixed

#: Digits of a fingerprint; characters that a step shows; steps until the random bits repeat.
SAMPLES, SHOWN, PERIOD = 256, 4, 4096
#: Bands and digits of a band; likeness of a verified pair.
BANDS, WIDTH, NEAR = 32, 8, 0.75
#: Cells of the walks that a task holds at once.
CELLS = 3 << 20
#: Fewer texts than these are walked alone, unless they are short.
FEW = 40
_END, _ODD = 0x110000, np.uint64(0x9E3779B97F4A7C15)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
_FAR = 41


@lru_cache(1)
def _moves() -> tuple[np.ndarray, list[bytes]]:
    """Random bits by step and class of character; the last class is the end, which holds the pointer."""
    bits = (mixed(np.arange(1, PERIOD * 256 + 1, dtype=np.uint64) * _ODD) >> np.uint64(63)).astype(np.uint8).reshape(PERIOD, 256)
    bits[:, 255] = 0
    return bits, [row.tobytes() for row in bits]


@lru_cache(1)
def _draws() -> tuple[np.ndarray, np.ndarray]:
    """Per digit the steps that are drawn as walks get longer, below 2**40: (digit << 41 | step, sorted; first entry of each digit).

    A walk's digit takes the last of them within the walk. The next one after step r is m with chance
    (r + 1) / m / (m + 1), which makes the last one below any length uniform."""
    keys = []
    for digit in range(SAMPLES):
        step, turn = 0, 0
        while step < 1 << 40:
            keys.append(digit << _FAR | step)
            turn += 1
            u = (int(mixed(np.array([digit * 1000 + turn], np.uint64) * _ODD)[0] >> np.uint64(11)) + 1) / (1 << 53)
            step = max(step + 1, int((step + 1) / u))
    return np.array(keys, np.int64), np.arange(SAMPLES, dtype=np.int64) << _FAR


def drawn(lengths: np.ndarray) -> np.ndarray:
    """Drawn steps of walks of these lengths, a row per walk; step 0 of a walk without steps."""
    keys, digits = _draws()
    at = np.searchsorted(keys, digits[None, :] + np.maximum(lengths, 1)[:, None]) - 1
    return keys[at] - digits[None, :]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _classes(codes: np.ndarray) -> np.ndarray:
    return ((codes ^ codes >> 8) % 255).astype(np.uint8)


def _shown(codes: np.ndarray) -> np.ndarray:
    """Hash of the characters from each place on; `codes` ends with SHOWN ends."""
    total = np.zeros(len(codes) - SHOWN + 1, np.uint64)
    for i in range(SHOWN):
        total = total * np.uint64(0x100000001B3) + codes[i:len(total) + i].astype(np.uint64) + np.uint64(1)
    return mixed(total)


def _digits(shown: np.ndarray, steps: np.ndarray) -> np.ndarray:
    _, digits = _draws()
    return (mixed(shown + (steps.astype(np.uint64) + digits.astype(np.uint64)[None, :]) * _ODD) >> np.uint64(60)).astype(np.uint8)


def _together(texts: list[np.ndarray]) -> np.ndarray:
    """Digits of texts of about one length, walked step by step."""
    bits, _ = _moves()
    end = np.full(SHOWN, _END, np.uint32)
    flat = np.concatenate([x for t in texts for x in (t, end)])
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + SHOWN) - lengths - SHOWN
    ends = starts + lengths
    classes = _classes(flat)
    classes[flat == _END] = 255
    walk = np.empty((2 * int(lengths.max()) + 128, len(texts)), np.intp)
    walk[0], step = starts, 0
    kind, move = np.empty(len(texts), np.uint8), np.empty(len(texts), np.uint8)
    while not (walk[step] == ends).all():
        if step + 65 > len(walk):
            walk = np.concatenate([walk, np.empty((len(walk) // 4 + 64, len(texts)), np.intp)])
        for step in range(step, step + 64):
            classes.take(walk[step], out=kind, mode="clip")
            bits[step % PERIOD].take(kind, out=move, mode="clip")
            np.add(walk[step], move, out=walk[step + 1])
        step += 1
    steps = (walk[:step] < ends).sum(0)
    chosen = drawn(steps)
    shown = _shown(np.concatenate([flat, end]))
    return _digits(shown[walk[chosen, np.arange(len(texts))[:, None]]], chosen)


def _alone(text: np.ndarray) -> np.ndarray:
    """Digits of one long text; of its walk only a period at a time is held."""
    _, moves = _moves()
    classes, end = _classes(text).tobytes() + b"\xff", len(text)
    place, chosen = np.zeros(SAMPLES, np.int64), np.zeros(SAMPLES, np.int64)
    at = begin = 0
    while at < end:
        walk = [at, *[at := at + move[classes[at]] for move in moves]]
        last = drawn(np.array([begin + (PERIOD if at < end else walk.index(end))]))[0]
        new = last >= begin
        chosen[new], place[new] = last[new], [walk[i] for i in (last[new] - begin).tolist()]
        begin += PERIOD
    shown = _shown(np.concatenate([text, np.full(SHOWN, _END, np.uint32)]))
    return _digits(shown[place][None, :], chosen[None, :])[0]


def embedded(texts: list[str]) -> np.ndarray:
    """Fingerprint digits, a row per text; equal texts are walked once."""
    distinct = {t: i for i, t in enumerate(dict.fromkeys(texts))}
    out = np.empty((len(distinct), SAMPLES), np.uint8)
    codes = [codes_of(t) for t in distinct]
    order, begin = sorted(range(len(codes)), key=lambda i: len(codes[i])), 0
    while begin < len(order):
        least, end = len(codes[order[begin]]), begin
        while end < len(order) and (most := len(codes[order[end]])) <= least + least // 3 + 32 and (end == begin or (end - begin + 1) * (2 * most + 192) <= CELLS):
            end += 1
        group = order[begin:end]
        if least > 1000 and len(group) < FEW:  # a step of numpy calls costs more than single steps
            for i in group:
                out[i] = _alone(codes[i])
        else:
            out[group] = _together([codes[i] for i in group])
        begin = end
    return out[[distinct[t] for t in texts]]


def written(digits: np.ndarray) -> list[str]:
    return [row.tobytes().decode() for row in _HEX[digits]]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal digits without the equal ones to be had by chance, 0 to 1; a row per pair."""
    return np.maximum(((a == b).mean(1) - 1 / 16) / (15 / 16), 0.0)


def likeness_of(a: Column, b: Column) -> Column:
    """`likeness` of two fingerprint columns."""
    agree = F.aggregate(F.sequence(F.lit(1), F.lit(SAMPLES)), F.lit(0), lambda n, i: n + (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))).cast("int"))
    return F.greatest((agree / SAMPLES - 1 / 16) / (15 / 16), F.lit(0.0))


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


# --- tables ------------------------------------------------------------------------------

_RESULT = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_RESULT_DDL = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _results(texts: list[str], following: list[str], digits: np.ndarray, next_digits: np.ndarray) -> list[pa.Array]:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    after = embedded(changed)
    columns = ([len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
               written(digits), written(after), likeness(digits, after), likeness(digits, next_digits))
    return [pa.array(c, t) for c, (_, t) in zip(columns, _RESULT, strict=True)]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) where the rows lie. Null texts are empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(written(embedded(batch.column("text").to_pylist())), pa.string())], ["id", "fingerprint"])

    return docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).mapInArrow(
        run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next larger doc_id, after the last the first; null ids come
    first, rows of one id follow by a hash of their texts, and a single document follows itself. Rows are
    dealt by ranges of ids and sorted, so each has its next one beside it; only the ends
    of the ranges meet in a join, a row per range. Null texts are empty; empty texts and texts of any
    length have fingerprints, equal texts equal ones; an empty table gives an empty result; other
    columns are ignored."""
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = texts.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    names = ["doc_id", *[n for n, _ in _RESULT], "place", "part", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None

        def end(place: int) -> pa.RecordBatch:
            doc_id, text, digits = held
            values = [doc_id, None, None, written(digits)[0], None, None, None, place, part, text]
            types = [pa.int64(), *[t for _, t in _RESULT], pa.int32(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in slices(batches, "text"):
            ids, found = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            digits = embedded(found)
            if held is None:
                held = ids[0], found[0], digits[:1]
                yield end(1)
            else:
                ids, found, digits = [held[0], *ids], [held[1], *found], np.concatenate([held[2], digits])
            if len(ids) > 1:
                n = len(ids) - 1
                yield pa.RecordBatch.from_arrays([pa.array(ids[:-1], pa.int64()), *_results(found[:-1], found[1:], digits[:-1], digits[1:]),
                                                  pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.nulls(n, pa.string())], names)
            held = ids[-1], found[-1], digits[-1:]
        if held:
            yield end(2)

    walked = staged(ordered.mapInArrow(run, f"doc_id long, {_RESULT_DDL}, place int, part long, text string"), "walked")
    ranges = sorted(r[0] for r in walked.where("place = 1").select("part").collect())  # numbers of the ranges
    follows = docs.sparkSession.createDataFrame(list(zip(ranges, [*ranges[1:], *ranges[:1]], strict=True)), "part long, next_part long")
    first = walked.where("place = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    ends = walked.where("place = 2").select("doc_id", "part", "text").join(follows, "part").join(first, "next_part").select("doc_id", "text", "next_text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1):
            found, following = batch.column("text").to_pylist(), batch.column("next_text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_results(found, following, embedded(found), embedded(following))], names[:7])

    whole = walked.where("place = 0").select(*names[:7])
    return whole.unionByName(ends.mapInArrow(finish, f"doc_id long, {_RESULT_DDL}")).withColumnRenamed("doc_id", id_col)


def near_groups(marked: DataFrame, *, id_col: str = "doc_id", least: float = NEAR) -> DataFrame:
    """(id, component_id) per row of (id, fingerprint): the smallest id among rows reached by verified pairs.

    Equal fingerprints are one node. Each node meets the first node of every band, and the pair
    counts if their likeness is `least` or more; pairs at 0.75 share one of the bands with a chance of
    98 %, at 0.9 practically always. Null fingerprints stay alone; a null id stands for no group."""
    kind = marked.schema[id_col].dataType.simpleString()
    named = marked.select(marked[id_col].alias("id"), "fingerprint")
    nodes = staged(named.where("fingerprint is not null and id is not null").groupBy("fingerprint").agg(F.min("id").alias("node")), "nodes")
    band = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.substring("fingerprint", i * WIDTH + 1, WIDTH).alias("key")) for i in range(BANDS)])).alias("b")
    bands = nodes.select("node", band).select("node", "b.band", "b.key")
    centres = bands.groupBy("band", "key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pairs = bands.join(centres, ["band", "key"]).where("node > centre").select("node", "centre").distinct()
    print_of = lambda n: nodes.select(F.col("node").alias(n), F.col("fingerprint").alias(f"{n}_print"))
    verified = pairs.join(print_of("node"), "node").join(print_of("centre"), "centre").where(likeness_of(F.col("node_print"), F.col("centre_print")) >= least)
    found = components(verified.select(F.col("node").alias("src"), F.col("centre").alias("dst")))
    merged = nodes.join(found, nodes["node"] == found["id"], "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    return named.join(merged, "fingerprint", "left").select(F.col("id").alias(id_col), F.coalesce("component_id", "id").cast(kind).alias("component_id"))
