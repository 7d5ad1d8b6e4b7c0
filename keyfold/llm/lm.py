"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

P(w|h) = l2 c(h,w)/c(h) + l1 c(w)/N + l0/(V+1), with weights by the frequency bucket of the
context h. The weights are learned by expectation-maximisation on deleted counts: every training
token is held out of the counts that predict it. All counts are taken over all training documents.

Documents become chunks: a local word list and the texts as numbers in it. Words meet their
counts in one shuffle and go back to their chunks. Word pairs are counted per chunk first, so a
frequent pair is one entry of each chunk, then travel packed by hash range and come back as counts.
Two walks over the chunks follow, one for the statistics of the weights (a histogram of
bounded size), one for the scores. Pairs are told apart by all 64 bits of a hash: the range and the
64 bits that it leaves."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, staged, words
from .shingles import mixed

#: The end of a text, also the context of its first word; no word holds a line end.
END = b"\n"
#: Bytes of text after which a chunk ends, pairs of a hash range.
CHUNK, RANGE = 6 << 20, 400_000
#: Tokens of a chunk looked at together.
BLOCK = 1 << 18
#: Bins per doubling in the histogram of estimates, and rounds of expectation-maximisation.
FINE, ROUNDS = 4, 60
_FOLDS, _TEST = 5, 1


def pack(values: np.ndarray, kind: str) -> bytes:
    """Numbers byte by byte of their width, compressed."""
    raw = np.ascontiguousarray(values, kind)
    return zstandard.compress(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes(), 1)


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % _FOLDS == _TEST


def chunks(docs: DataFrame) -> DataFrame:
    """Staged rows (chunk, size, docs, lengths, tokens, names, counts): tokens number the local words,
    the most frequent first; `counts` are those in training documents."""
    fields = pa.schema([("chunk", pa.int64()), ("size", pa.int64()), ("docs", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("lengths", "tokens", "names", "counts")]])

    def run(batches):
        number, part = 0, TaskContext.get().partitionId()

        def flush(ids, parts, index):
            lengths = np.array([len(p) for p in parts], np.int32)
            tokens = np.concatenate(parts)
            order = np.argsort(-np.bincount(tokens, minlength=len(index)), kind="stable")
            rank = np.empty(len(index), np.int32)
            rank[order] = np.arange(len(index))
            tokens = rank[tokens]
            train = np.repeat([not held_out(i) for i in ids], lengths)
            counts = np.bincount(tokens[train], minlength=len(index))
            names = list(index)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((
                [part << 32 | number], [len(tokens)], [ids], [pack(lengths, "<i4")], [pack(tokens, "<i4")],
                [zstandard.compress(b" ".join([names[i] for i in order.tolist()]), 3)], [pack(counts, "<i8")]), fields, strict=True)], schema=fields)

        ids, parts, index, held = [], [], {}, 0
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tokens = [*words(text), END]
                put = index.setdefault
                parts.append(np.fromiter((put(w, len(index)) for w in tokens), np.int32, len(tokens)))
                ids.append(doc_id)
                held += len((text or "").encode("utf-8", "surrogatepass"))
                if held > CHUNK:
                    yield flush(ids, parts, index)
                    ids, parts, index, held, number = [], [], {}, 0, number + 1
        if ids:
            yield flush(ids, parts, index)

    return staged(docs.mapInArrow(run, "chunk long, size long, docs array<long>, lengths binary, tokens binary, names binary, counts binary"), "chunks")


def word_counts(chunked: DataFrame) -> DataFrame:
    """Staged (chunk, found, tokens, types): training counts of a chunk's words, in their order; the
    sums and numbers of counts of the words that no earlier chunk has."""

    def each(batches):
        for row in rows_of(batches):
            names = zstandard.decompress(row["names"]).split(b" ")
            for begin in range(0, len(names), 50_000):
                part = names[begin:begin + 50_000]
                yield pa.RecordBatch.from_pydict({"chunk": np.full(len(part), row["chunk"]), "pos": np.arange(begin, begin + len(part), dtype=np.int32),
                                                  "word": pa.array(part, pa.binary()), "n": unpack(row["counts"], "<i8")[begin:begin + 50_000]})

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pos, count, first = (table[c].to_numpy() for c in ("pos", "count", "first"))
        inorder = np.empty(len(pos), np.int64)
        inorder[pos] = count
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "found": pa.array([pack(inorder, "<i8")], pa.binary()),
                         "tokens": [int(count[first].sum())], "types": [int((count[first] > 0).sum())]})

    same = Window.partitionBy("word")
    split = chunked.select("chunk", "names", "counts").mapInArrow(each, "chunk long, pos int, word binary, n long")
    counted = split.select("chunk", "pos", F.sum("n").over(same).alias("count"), (F.min("chunk").over(same) == F.col("chunk")).alias("first"))
    return staged(counted.groupBy("chunk").applyInArrow(gather, "chunk long, found binary, tokens long, types long"), "words")


def rows_of(batches):
    """Rows as dictionaries, one at a time: a chunk is large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


class Chunk:
    """A chunk with its distinct pairs in the order of their keys."""

    def __init__(self, row: dict, ranges: int):
        self.docs, self.lengths, self.tokens = row["docs"], unpack(row["lengths"], "<i4"), unpack(row["tokens"], "<i4")
        names = zstandard.decompress(row["names"]).split(b" ")
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
        end = names.index(END)
        context = np.r_[np.int32(end), self.tokens[:-1]]  # a text follows the end of the one before
        self.context = context
        pairs, pair_of = np.unique(context.astype(np.int64) * len(hashes) + self.tokens, return_inverse=True)
        key = mixed(hashes[pairs // len(hashes)] * np.uint64(0x9E3779B97F4A7C15) + hashes[pairs % len(hashes)])
        order = np.argsort(key, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.pair_of, key = place[pair_of], key[order]
        self.train = np.repeat([not held_out(i) for i in self.docs], self.lengths)
        self.counts = np.bincount(self.pair_of[self.train], minlength=len(key))
        high = (key >> np.uint64(32)) * np.uint64(ranges)
        ranged = (high >> np.uint64(32)).astype(np.int64)
        self.keys = high << np.uint64(32) | key & np.uint64(0xFFFFFFFF)  # what the range leaves of the high half, and the low half
        starts = np.flatnonzero(np.r_[True, ranged[1:] != ranged[:-1]])
        self.ranges = list(zip(ranged[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True))


def pair_counts(chunked: DataFrame, ranges: int) -> DataFrame:
    """Staged (chunk, range, found): training counts of a chunk's pairs in a hash range, in the order of their keys."""
    fields = [("range", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]

    def send(batches):
        for row in rows_of(batches):
            c = Chunk(row, ranges)
            out = [(r, row["chunk"], pack(np.diff(c.keys[a:b], prepend=np.uint64(0)), "<u8"), pack(c.counts[a:b], "<i8")) for r, a, b in c.ranges]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True), fields, strict=True)], [n for n, _ in fields])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpack(k, "<u8")) for k in table["keys"].to_pylist()]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([unpack(c, "<i8") for c in table["counts"].to_pylist()]))[at].astype(np.int64)
        found = np.split(total, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"chunk": table["chunk"], "range": table["range"], "found": pa.array([pack(f, "<i8") for f in found], pa.binary())})

    sent = chunked.select("chunk", "docs", "lengths", "tokens", "names").mapInArrow(send, "range int, chunk long, keys binary, counts binary")
    return staged(sent.groupBy("range").applyInArrow(add, "chunk long, range int, found binary"), "pairs")


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(context, 0) + 1)).astype(np.int64)


def _bins(p: np.ndarray) -> np.ndarray:
    """Logarithmic bin of each estimate; a number below all others for zero."""
    return np.where(p > 0, np.floor(np.log2(np.where(p > 0, p, 1)) * FINE), -(1 << 20)).astype(np.int64)


def learn(rows: list[tuple[int, int, int, int]], types: int) -> dict[int, np.ndarray]:
    """Weights (l2, l1, l0) by bucket from (bucket, bin of p2, bin of p1, tokens)."""
    table, weights = np.array(rows, np.int64).reshape(-1, 4), {}
    value = lambda b: np.where(b > -(1 << 20), 2.0 ** (np.maximum(b, -2000) / FINE + 0.5 / FINE), 0.0)
    for bucket in np.unique(table[:, 0]).tolist():
        mine = table[table[:, 0] == bucket]
        p = np.c_[value(mine[:, 1]), value(mine[:, 2]), np.full(len(mine), 1 / (types + 1))]
        l = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            share = p * l
            l = (share / share.sum(1, keepdims=True) * mine[:, 3:]).sum(0) / mine[:, 3].sum()
            l = np.maximum(l, 1e-6) / np.maximum(l, 1e-6).sum()
        weights[bucket] = l
    return weights


def scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training leaves out the rows whose crc32 of the id, modulo 5, is 1; a null id is training. Null
    or empty texts are one end token. Repeated rows count each time; an empty table gives an empty
    result; without training tokens every word is unknown. Other columns are ignored."""
    chunked = chunks(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")))
    counted = word_counts(chunked)
    total = F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))
    tokens, types = counted.agg(*total).first()
    everything = chunked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = max(1, math.ceil(everything / RANGE))
    answers = counted.select("chunk", F.lit(-1).alias("range"), "found").unionByName(pair_counts(chunked, ranges))
    texts = chunked.select("chunk", "docs", "lengths", "tokens", "names")

    def met(left: pa.Table, right: pa.Table):
        """A chunk, and by blocks of its tokens the counts of their pairs, contexts and words."""
        c = Chunk(left.to_pylist()[0], ranges)
        found = dict(zip(right["range"].to_pylist(), right["found"].to_pylist(), strict=True))
        word = unpack(found[-1], "<i8")
        pair = np.concatenate([unpack(found[r], "<i8") for r, _, _ in c.ranges])
        spans = [slice(a, a + BLOCK) for a in range(0, len(c.tokens), BLOCK)]
        return c, ((at, pair[c.pair_of[at]], word[c.context[at]], word[c.tokens[at]]) for at in spans)

    def deleted(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        c, blocks = met(left, right)
        kinds, numbers = [], []
        for at, *counts in blocks:
            pair, context, word = (x[c.train[at]] - 1 for x in counts)
            binned = (_bucket(context) << 48) + (-_bins(pair / np.maximum(context, 1)) << 24) - _bins(word / max(tokens - 1, 1))
            kind, number = np.unique(binned, return_counts=True)
            kinds.append(kind)
            numbers.append(number)
        kinds, at = np.unique(np.concatenate(kinds), return_inverse=True)
        number = np.bincount(at, weights=np.concatenate(numbers), minlength=len(kinds)).astype(np.int64)
        return pa.table({"bucket": kinds >> 48, "b2": -(kinds >> 24 & 0xFFFFFF), "b1": -(kinds & 0xFFFFFF), "n": number})

    histogram = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(deleted, "bucket long, b2 long, b1 long, n long")
    weights = learn([tuple(r) for r in histogram.groupBy("bucket", "b2", "b1").agg(F.sum("n")).collect()], types)
    table = np.full((max(weights, default=0) + 1, 3), 1 / 3)
    for bucket, l in weights.items():
        table[bucket] = l

    def score(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        c, blocks = met(left, right)
        base, score, known = np.empty(len(c.tokens)), np.empty(len(c.tokens)), np.empty(len(c.tokens), np.int64)
        for at, pair, context, word in blocks:
            l = table[np.minimum(_bucket(context), len(table) - 1)]
            l = np.where(context[:, None] > 0, l, np.c_[0 * l[:, 0], l[:, 1] / (l[:, 1] + l[:, 2]), l[:, 2] / (l[:, 1] + l[:, 2])])
            score[at] = np.log10(l[:, 0] * pair / np.maximum(context, 1) + l[:, 1] * word / max(tokens, 1) + l[:, 2] / (types + 1))
            base[at] = np.log10((word + 0.5) / (tokens + 0.5 * (types + 1)))
            known[at] = word > 0
        starts = np.cumsum(c.lengths) - c.lengths
        sums = lambda x: np.add.reduceat(x, starts)
        return pa.table({"doc_id": pa.array(c.docs, pa.int64()), "held_out": [held_out(i) for i in c.docs], "n_tokens": c.lengths.astype(np.int64), "n_known": sums(known),
                         "train_tokens": np.full(len(c.docs), tokens, np.int64), "base_score": sums(base), "score": sums(score)})

    out = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc_id", id_col)
