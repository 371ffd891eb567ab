"""Byte-level BPE over a global shuffle of distinct words.

Texts are split into pre-tokens in blocks of documents.  A block codes its
pre-tokens by position as numbers of its distinct words; the words, dealt by
hash into buckets, go to one shuffle, where every distinct word of the corpus
is merged once, and their ids go back to the block, which puts the documents
together by position.  What moves is one coded block and, per block and
bucket, one packed list of distinct words: a word that fills a third of all
texts costs one entry per block, so no bucket is hot, and no table of all
words is ever held or broadcast.  Decoding joins the token-byte table (as many
entries as the vocabulary, a fixed bound).

Defined results: null and empty texts have no tokens; repeated rows are
encoded each; a text of any length is one sequence; a null doc_id stays null;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions
from .pretokens import ragged, split, text_blocks

#: Bytes of text in a block (a longer document is a block of its own).
BLOCK_BYTES = 16 << 20
#: Bytes of text that are split at a time, and ids in one output batch.
SPLIT_BYTES, OUT_IDS = 1 << 20, 1 << 19
#: Beyond this many bytes a word is merged with a heap.
HEAP_FROM = 64


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank (the leftmost of
    equals) merges until none has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > HEAP_FROM:
        return _encode_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    pair = [ranks.get(word[i:i + 2]) for i in range(len(word) - 1)]
    while True:
        best, at = None, -1
        for i, r in enumerate(pair):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
        del pair[at]
        if at < len(pair):
            pair[at] = ranks.get(parts[at] + parts[at + 1])
        if at:
            pair[at - 1] = ranks.get(parts[at - 1] + parts[at])


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end = list(range(1, n + 1))        # of the part that begins here
    before = list(range(-1, n - 1))    # where the previous part begins
    alive = [True] * n

    def rank(i: int) -> int | None:
        j = end[i]
        return ranks.get(word[i:end[j]]) if j < n else None

    heap = [(r, i, end[end[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
        for k in (i, before[i]):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, end[end[k]]))
    return [ranks[word[i:end[i]]] for i in range(n) if alive[i]]


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays, byte planes apart, compressed."""
    import zstandard

    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(-1, a.itemsize).T
        out.append(zstandard.compress(np.ascontiguousarray(planes).tobytes(), 9))
    sizes = np.array([len(x) for x in out], "<u8").tobytes()
    return sizes + b"".join(out)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    sizes = np.frombuffer(data[:8 * len(kinds)], "<u8")
    at, out = 8 * len(kinds), []
    for size, kind in zip(sizes, kinds, strict=True):
        raw = np.frombuffer(zstandard.decompress(data[at:at + int(size)]), np.uint8)
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel())
        at += int(size)
    return out


#: Codes below take one byte; the others an escape byte, with their upper bits, and two.
ESCAPE = 192
LARGEST = ESCAPE + ((256 - ESCAPE) << 16)


def pack_codes(codes: np.ndarray, n_words: int) -> bytes:
    """Codes by frequency in one or three bytes, compressed (in four, where a
    block has more words than that can tell apart)."""
    if n_words > LARGEST:
        return b"\0" + _pack(codes)
    big = codes >= ESCAPE
    rest = codes[big] - np.uint32(ESCAPE)
    first = codes.astype(np.uint8)
    first[big] = ESCAPE + (rest >> 16)
    return b"\1" + _pack(first, (rest & 0xFFFF).astype("<u2"))


def unpack_codes(data: bytes) -> np.ndarray:
    if data[0] == 0:
        return _unpack(data[1:], "<u4")[0]
    first, rest = _unpack(data[1:], "u1", "<u2")
    codes, big = first.astype(np.uint32), first >= ESCAPE
    codes[big] = ESCAPE + ((codes[big] - ESCAPE) << 16) + rest
    return codes


CODED = "route long, block long, kind int, part int, data binary"
CODED_ARROW = pa.schema([("route", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()),
                         ("part", pa.int32()), ("data", pa.binary())])
WORDS, DOCS = 0, 1


def _split_in_portions(texts: pa.ChunkedArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(coded tokens, number of tokens of each text), split ``SPLIT_BYTES`` at a time."""
    parts, counts = [], [np.zeros(0, np.int64)]
    whole = pa.table([texts, texts], ["_", "text"])
    for t in text_blocks(whole.to_batches(), SPLIT_BYTES):
        tokens, n = split(t.column(1).combine_chunks(), spaced=True)
        parts.append(tokens.dictionary_encode())
        counts.append(n)
    coded = pa.chunked_array(parts, pa.dictionary(pa.int32(), pa.large_string())).unify_dictionaries()
    return coded.combine_chunks(), np.concatenate(counts)


def _code(block_bytes: int, buckets: int):
    """(doc_id, text) -> rows of packed words by bucket, and the coded block."""
    def run(batches):
        task = TaskContext.get().partitionId()
        for number, t in enumerate(text_blocks(batches, block_bytes)):
            block = (task << 32) | number
            coded, counts = _split_in_portions(t.column(1))
            words, indices = coded.dictionary, coded.indices.to_numpy()
            bucket = (pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
                      % np.uint64(buckets)).astype(np.int64)
            # words go by bucket, in order (they compress well); codes by frequency
            keys = pa.table([pa.array(bucket), words], ["bucket", "word"])
            order = pc.sort_indices(keys, [("bucket", "ascending"), ("word", "ascending")]).to_numpy()
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            frequent = np.argsort(-np.bincount(indices, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[frequent] = np.arange(len(words), dtype=np.uint32)
            words, bucket = words.take(pa.array(order)), bucket[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            rows = []
            offsets = np.frombuffer(words.buffers()[1], np.int64) if len(words) else None
            for lo, hi in itertools.pairwise(edges) if len(words) else ():
                raw = memoryview(words.buffers()[2])[offsets[lo]:offsets[hi]]
                rows.append((int(bucket[lo]), block, WORDS, int(bucket[lo]),
                             _pack(np.diff(offsets[lo:hi + 1]).astype("<u4"), np.frombuffer(raw, np.uint8))))
            ids = t.column(0).combine_chunks()
            known = pc.is_valid(ids).to_numpy(zero_copy_only=False).astype(np.uint8)
            rows.append((block * 7919 + 1, block, DOCS, 0,
                         _pack(pc.fill_null(ids, 0).to_numpy(), known, counts.astype("<u4"), place[frequent],
                               np.frombuffer(pack_codes(rank[indices], len(words)), np.uint8))))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, CODED_ARROW, strict=True)],
                                             schema=CODED_ARROW)
    return run


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _encode_buckets(ranks_path: str):
    """Rows sorted by bucket: every distinct word of a bucket is merged once."""
    def run(batches):
        ranks, bucket, memo = load_ranks(ranks_path), None, {}
        for r in _one_by_one(batches):
            data = r["data"]
            if r["kind"] == WORDS:
                if r["route"] != bucket:
                    bucket, memo = r["route"], {}
                sizes, raw = _unpack(data, "<u4", "u1")
                raw, at, flat, n = raw.tobytes(), 0, [], []
                for size in sizes.tolist():
                    word = raw[at:at + size]
                    at += size
                    ids = memo.get(word)
                    if ids is None:
                        ids = memo[word] = encode_word(word, ranks)
                    flat += ids
                    n.append(len(ids))
                data = _pack(np.array(n, "<u4"), np.array(flat, "<u4"))
            yield pa.RecordBatch.from_pylist([{**r, "data": data}], CODED_ARROW)
    return run


ENCODED = "doc_id long, ids array<int>"


def _reassemble(batches):
    """Rows sorted by block, its words' ids before its coded documents."""
    sizes, flats, block = [], [], None
    for r in _one_by_one(batches):
        if r["block"] != block:
            block, sizes, flats = r["block"], [], []
        if r["kind"] == WORDS:
            n, flat = _unpack(r["data"], "<u4", "<u4")
            sizes.append(n)
            flats.append(flat)
            continue
        doc_ids, known, counts, place, packed = _unpack(r["data"], "<i8", "u1", "<u4", "<u4", "u1")
        codes = unpack_codes(packed.tobytes())
        n = np.concatenate([np.zeros(0, np.int64), *sizes]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint32), *flats]).astype(np.int32)
        if len(place) != len(n):
            raise ValueError("a block lacks words")
        begin = (np.cumsum(n) - n)[place]
        n = n[place]
        edges = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        at = 0
        while at < len(doc_ids):
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + OUT_IDS, side="right")) - 1)
            part = codes[edges[at]:edges[to]]
            ids = ragged(flat, begin, n, part)
            cuts = np.concatenate([[0], np.cumsum(n[part])])[edges[at:to + 1] - edges[at]]
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_ids[at:to], mask=known[at:to] == 0), lists], ["doc_id", "ids"])
            at = to
        sizes, flats = [], []


def encode(docs: DataFrame, ranks_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, ids (array<int>) for every row of ``docs`` (doc_id, text)."""
    n = shuffle_partitions(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    coded = source.mapInArrow(_code(block_bytes, 2 * n), CODED)
    words = coded.repartition(n, "route").sortWithinPartitions("kind", "route")
    encoded = words.mapInArrow(_encode_buckets(ranks_path), CODED).drop("route")
    blocks = encoded.repartition(n, "block").sortWithinPartitions("block", "kind", "part")
    return blocks.mapInArrow(_reassemble, ENCODED)


def byte_table(ranks_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all tokens joined, where each begins, how long each is)."""
    ranks = load_ranks(ranks_path)
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    by_id = [b""] * len(sizes)
    for token, k in ranks.items():
        by_id[k], sizes[k] = token, len(token)
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(sizes) - sizes, sizes


def _lists(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(values, where each list begins and the last ends) of column 1."""
    ids = b.column(1)
    edges = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + len(ids) + 1]
    return ids.values.to_numpy(), edges


def _decoded(b: pa.RecordBatch, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
    values, edges = _lists(b)
    return [ragged(*table, values[lo:hi]).tobytes() for lo, hi in itertools.pairwise(edges)]


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the decoded bytes of ``encode``'s rows."""
    def run(batches):
        table = byte_table(ranks_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_decoded(b, table), pa.binary())], ["doc_id", "decoded"])
    return encoded.mapInArrow(run, "doc_id long, decoded binary")


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``decode`` and digests in one pass."""
    def run(batches):
        table = byte_table(ranks_path)
        texts = [f"{k} ".encode() for k in range(len(table[2]))]
        sizes = np.array([len(x) for x in texts])
        names = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes
        for b in batches:
            values, edges = _lists(b)
            ids = [hashlib.sha256(ragged(*names, values[lo:hi]).tobytes()[:-1]).hexdigest()
                   for lo, hi in itertools.pairwise(edges)]
            raw = [hashlib.sha256(x).hexdigest() for x in _decoded(b, table)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(edges).astype(np.int64)), pa.array(ids), pa.array(raw)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
