import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from credlens.llm import bpe, pretokens

RANKS = P.path("byte_bpe_50k.tiktoken")
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CHARS = st.sampled_from(list("abstrevlmdé'  \n\t1²½-_.,!€  ßñ中\U0001f600́"))
TEXTS = st.lists(st.one_of(st.text(CHARS, max_size=40), st.text(max_size=20)), max_size=5)


def parts(texts, spaced):
    tokens, counts = pretokens.split(pa.array(texts, pa.string()), spaced)
    tokens, out, at = tokens.to_pylist(), [], 0
    for n in counts:
        out.append(tokens[at:at + n])
        at += n
    return out


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_split_is_the_pattern(texts):
    ranks = bpe.load_ranks(RANKS)
    for text, tokens in zip(texts, parts(texts, True), strict=True):
        assert "".join(tokens) == text
        assert [i for x in tokens for i in bpe.encode_word(x.encode(), ranks)] == own().encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(CHARS, max_size=40), max_size=5))
def test_split_of_long_known_characters(texts):
    assert parts(texts, True) == [regex.findall(P.PATTERN, t) for t in texts]
    assert parts(texts, False) == [regex.findall(PLAIN, t) for t in texts]


def test_split_slices_and_nulls():
    a = pa.array(["x y", None, "", "it's", "'ll"], pa.string()).slice(1)
    tokens, counts = pretokens.split(a, True)
    assert tokens.to_pylist() == ["it", "'s", "'ll"] and counts.tolist() == [0, 0, 2, 1]


@lru_cache
def own():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.binary(min_size=1, max_size=30), st.text("abcthein ", min_size=65, max_size=300).map(str.encode)))
def test_word_merges(word):
    ranks = bpe.load_ranks(RANKS)
    assert bpe.encode_word(word, ranks) == own()._encode_single_piece(word)
    assert bpe._encode_long(word, ranks) == own()._encode_single_piece(word)


TABLE = [(1, "It's the end.\n\n  Yes, 1234 'll"), (2, None), (3, ""), (4, "the " * 30000), (5, "a" * 5000),
         (6, "中文 текст ñandú \U0001f600"), (6, "中文 текст ñandú \U0001f600"), (None, "no id"), (8, " \n\t "),
         (9, "<|endoftext|>")]


@pytest.mark.parametrize("block", [1, 64, 8 << 20])
def test_encode_decode(spark, block):
    docs = spark.createDataFrame([(a, b, "x", "y") for a, b in TABLE], "doc_id long, text string, ids string, block string")
    got = bpe.digests(bpe.encode(docs, RANKS, block), RANKS).collect()
    want = []
    for k, t in TABLE:
        ids = own().encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_round_trip(spark):
    docs = spark.createDataFrame(TABLE, "doc_id long, text string")
    got = bpe.decode(bpe.encode(docs, RANKS, 64), RANKS).collect()
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in got), key=str) == sorted(((k, (t or "").encode()) for k, t in TABLE), key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.encode(docs, RANKS), RANKS).collect() == []


@pytest.mark.parametrize("top", [0, 191, 192, 193, 70_000, bpe.LARGEST - 1, bpe.LARGEST, 1 << 31])
def test_codes_round_trip(top):
    codes = np.array([0, 5, 191, 192, 193, 65_727, 65_728, top, top // 2], np.uint32)
    codes = codes[codes <= top]
    assert bpe.unpack_codes(bpe.pack_codes(codes, top + 1)).tolist() == codes.tolist()
    assert bpe.unpack_codes(bpe.pack_codes(codes[:0], 0)).tolist() == []
