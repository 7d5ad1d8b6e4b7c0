import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from keyfold.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "aa", "b", " ", "  ", "\n", "\n\n", "\t", "ab", "the", "=", "--", "é", "ß", "中", "😀", "\u2003", "\u200b", "0", "00", "'s", "'S", "_", "\r\n", "İ", "\u0300",
         "<|endoftext|>", "ha", "\x85", "\x1c", ".", "word,\nWord", "\n ", " \n"]


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return bpe.parse_ranks(file.read())


@pytest.fixture(scope="module")
def model(ranks):
    return bpe.ByteBPE(ranks)


@pytest.fixture(scope="module")
def truth(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_tiktoken(model, truth):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(6000)]
    texts += [c * k for c in "a =\n" for k in (1, 2, 3, 17, 200)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(40)) for _ in range(500)]
    texts.append("long " * 20000)
    assert model.encode(texts) == [truth.encode_ordinary(t) for t in texts]
    assert [model.decode(i).decode() for i in model.encode(texts)] == texts


def test_offsets_and_cut_characters(model):
    text = "naïve 😀𝒳 中文"
    ids = model.encode([text])[0]
    spans, texts = model.offsets(ids), model.token_texts(ids)
    assert "".join(texts) == text and spans[-1][1] == len(text)
    assert [text[a:b] for a, b in spans] == texts
    assert any(t == "" for t in texts)


def test_rows(spark, documents, truth):
    texts = ["Hello world", None, "", "Hello world", "x" * 300_000, "späte Wörter 😀"]
    docs = documents(texts)
    got = {r["doc_id"]: r for r in bpe.digests(docs, PATH).collect()}
    for i, text in enumerate(texts):
        ids = truth.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = bpe.encode(docs, PATH, offsets=True)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded, PATH).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.digests(docs.limit(0), PATH).count() == 0
