import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from credlens.llm import packing

PATH = P.path("word_bpe_49k.json")
CHARS = st.sampled_from(list("abstrevlmdéÉİıß'  \n\t1²½ªº-_.,!€\x85 ΣÀñ中\U0001f600́<|>"))


MARKED = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext", "a", " ", "É", "\u0301", "'s"]),
                  max_size=8).map("".join)


def tokenizer():
    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(CHARS, max_size=40), st.text(max_size=30), MARKED), max_size=4))
def test_ids_are_the_tokenizers(texts):
    ids, ends = packing.WordIds(PATH).texts(pa.array(texts, pa.string()))
    t = tokenizer()
    for k, x in enumerate(texts):
        assert ids[ends[k]:ends[k + 1]].tolist() == t.encode(x, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1023), min_size=1, max_size=60))
def test_windows_hold_every_piece_once(sizes):
    w = packing.windows(sizes, 2048)
    assert sorted(i for x in w for i in x) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in x) <= 2048 for x in w)


def test_differencing_balances():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 500, 1000).tolist()
    sums = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 100)]
    assert max(sums) - min(sums) < 0.02 * np.mean(sums)


TABLE = [(1, "Hello world"), (2, None), (3, ""), (4, "word " * 9000), (5, "a b"), (5, "a b"), (None, "x"), (7, " \n ")] + \
    [(k, "lorem ipsum dolor " * (k % 97)) for k in range(10, 300)]


def check(rows, table):
    t = tokenizer()
    want = {}
    for k, x in table:
        want.setdefault(k, []).append(t.encode(x or "", add_special_tokens=False).ids + [1])
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert set(by_doc) == set(want)
    for k, lists in want.items():
        ids = lists[0]
        assert sum(r.length for r in by_doc[k]) == sum(map(len, lists))
        for r in by_doc[k]:
            assert r.doc_tokens == len(ids)
            piece = np.array(ids[r.start:r.start + r.length], "<u4").tobytes()
            assert bytes(r.ids) == piece and zlib.crc32(piece) >= 0
    return by_seq


def test_pack(spark):
    docs = spark.createDataFrame([(a, b, 1) for a, b in TABLE], "doc_id long, text string, start int")
    check(packing.pack(docs, PATH).collect(), TABLE)
    check(packing.pack(docs.repartition(3), PATH, block_pieces=7).collect(), TABLE)
    assert packing.pack(docs.limit(0), PATH).collect() == []


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, PATH).drop("ids").collect()
    tokens, sequences = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert tokens / (sequences * 2048) > 0.99
