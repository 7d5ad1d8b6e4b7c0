"""Byte-level BPE by the `tokenizers` library over Arrow batches.

Ranks become a BPE model over the printable stand-ins of bytes: the library merges pairs,
so every split of a token into two known parts is listed at the token's rank. Decoding
reverses the byte table; a character cut between two tokens belongs to the token that
holds its last byte. Rows stay in their partitions; a task holds one slice of texts.

A null or empty text has no tokens and decodes to nothing. Very long texts are encoded
whole. Repeated rows are encoded alike; empty tables give empty results; other columns are ignored."""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices


@lru_cache(1)
def byte_table() -> list[str]:
    """The stand-in of each byte: itself where printable, else the next code point from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


def parse_ranks(data: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


#: Parts a worker keeps encoded until its partition ends, and characters of the longest such part.
SEEN, SHORT = 400_000, 48
_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace()]
_UNEVEN = [" " + c for c in _BLANKS] + [c + " " for c in _BLANKS if c != " "]
_LONE_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: Between a letter or number and a mark, before a blank, and after a lone line end: also never joined.
_INNER = re.compile(r"(?<=[^\W_])(?=[^\w\s])|(?<=\S)(?=\n)|(?<=\S\n)(?=\w)")


def cut_text(text: str | None) -> list[str]:
    """Parts of a text that are encoded apart; all but the first begin with their blank."""
    if not text:
        return []
    if text[0] == " " or text[-1] == " " or any([pair in text for pair in _UNEVEN]):
        first, *rest = _LONE_BLANK.split(text)
    else:
        first, *rest = text.split(" ")
    return [first, *[" " + part for part in rest]]


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        table = byte_table()
        show = lambda token: "".join([table[b] for b in token])
        merges = [(show(token[:i]), show(token[i:])) for token in sorted(ranks, key=ranks.get)
                  for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={show(t): r for t, r in ranks.items()}, merges=merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        back = {c: b for b, c in enumerate(table)}
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for shown, rank in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.pieces[rank] = bytes([back[c] for c in shown])

        self.whole: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def packed(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text, little-endian with 32 bits.

        The split pattern never joins two characters across a lone blank between non-blanks,
        so a text is cut there, and parts met before are not encoded again."""
        texts = [cut_text(t) for t in texts]
        new = list(set().union(*texts).difference(self.whole))
        cut = [_INNER.split(p) for p in new]
        inner = list(set().union(*cut).difference(self.inner))
        encodings = self.tokenizer.encode_batch_fast(inner, add_special_tokens=False)
        self.inner.update(zip(inner, [struct.pack(f"<{len(e)}I", *e.ids) for e in encodings], strict=True))
        get = self.inner.__getitem__
        self.whole.update(zip(new, [b"".join(map(get, p)) for p in cut], strict=True))
        get = self.whole.__getitem__
        out = [b"".join(map(get, parts)) for parts in texts]
        for cache in (self.whole, self.inner):
            if len(cache) > SEEN:
                cache.clear()
        for part in [p for p in new if len(p) > SHORT]:
            self.whole.pop(part, None)
        for part in [p for p in inner if len(p) > SHORT]:
            self.inner.pop(part, None)
        return out

    def forget(self) -> None:
        """Drop the kept parts: a worker goes on with other work."""
        self.whole.clear()
        self.inner.clear()

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        return [np.frombuffer(x, "<u4").tolist() for x in self.packed(texts)]

    def decode(self, ids: Iterable[int]) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids])

    def offsets(self, ids: Iterable[int]) -> list[tuple[int, int]]:
        """Begin and end of each token in characters; both count a character once its last byte is there."""
        reader, at, out = codecs.getincrementaldecoder("utf-8")("replace"), 0, []
        for i in ids:
            begin = at
            at += len(reader.decode(self.pieces[i]))
            out.append((begin, at))
        return out

    def token_texts(self, ids: Iterable[int]) -> list[str]:
        """Text of each token; a cut character is empty but in the token that ends it."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        return [reader.decode(self.pieces[i]) for i in ids]


@lru_cache(1)
def _loaded(data: bytes) -> ByteBPE:
    return ByteBPE(parse_ranks(data))


def _shared(df: DataFrame, path: str):
    """The rank file, under 1 MB for 50,000 tokens, read once on the driver and broadcast."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids; with `offsets` also begins and ends in characters."""
    data, kind = _shared(docs, path), docs.schema[id_col].dataType.simpleString()
    extra = ", begins array<int>, ends array<int>" if offsets else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(data.value)
        for batch in slices(batches, "text"):
            ids = bpe.encode(batch.column(1).to_pylist())
            columns = {"id": batch.column(0), "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))}
            if offsets:
                spans = [bpe.offsets(x) for x in ids]
                columns |= {n: pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int32())) for k, n in enumerate(("begins", "ends"))}
            yield pa.RecordBatch.from_pydict(columns)
        bpe.forget()

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens long, ids array<int>{extra}").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the decoded text; bytes that are no character become U+FFFD. Null ids decode to nothing."""
    data, kind = _shared(encoded, path), encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(data.value)
        for batch in batches:
            texts = [bpe.decode(x or ()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(
        run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Round trip per row: id, n_tokens, SHA-256 of the ids (little-endian, 32 bits) and of the
    decoded bytes; with `ids` the ids too."""
    data, kind, whole = _shared(docs, path), docs.schema[id_col].dataType.simpleString(), ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(data.value)
        for batch in slices(batches, "text"):
            ids = [np.frombuffer(x, "<u4") for x in bpe.packed(batch.column(1).to_pylist())]
            columns = {
                "id": batch.column(0), "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x.tolist())).hexdigest() for x in ids], pa.string())}
            if whole:
                columns["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)
        bpe.forget()

    extra = ", ids array<int>" if ids else ""
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}").withColumnRenamed("id", id_col)
