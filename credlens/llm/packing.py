"""Packing documents into training sequences by Karmarkar-Karp differencing.

A document's ids (with the end id) are cut into full windows, which are
sequences as they are, halves and quarters of a window, and a remainder.
Pieces are gathered in blocks of bounded number as a task streams its rows,
and every block is divided into windows by multiway differencing: partial
partitions, each a vector of window sums, are merged two at a time, the two
with the widest spread first, largest sums meeting smallest.  Where a window
exceeds the capacity, the window count rises and the block is divided again.
Nothing is shuffled: blocks lie inside a task's rows.

Pre-tokens are encoded once per task and word.  A special token that
a text holds literally is one id, as the tokenizer has it.

Defined results: null and empty texts are the end id alone; repeated rows are
packed each; a document of any length is cut, none is dropped; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import ragged, split, text_blocks

WINDOW = 2048
END_ID = 1
#: Smallest half of a window that is cut off, and pieces in a block.
LEAST_CUT, BLOCK_PIECES = 512, 1024
TEXT_BYTES = 4 << 20
#: Words that the tokenizer gets as one line, and words whose ids a task remembers.
LINE_WORDS, MEMO_WORDS = 512, 1 << 20
#: Texts of these characters are in normal form C, and lower-case by ``str.lower``.
LATIN = re.compile("[^\x00-ɏ]")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """(tokenizer, whether an id ends a word, its special tokens in one pattern)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    vocabulary = out.get_vocab()
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    last[[i for t, i in vocabulary.items() if t.endswith(out.model.end_of_word_suffix)]] = True
    special = {t.content: i for i, t in out.get_added_tokens_decoder().items() if t.special}
    return out, last, special


class WordIds:
    """Ids of texts, as the tokenizer gives them without adding special tokens.

    Words not met before are encoded in lines of ``LINE_WORDS``; the ids that
    end a word part them again.  Special tokens that stand in a text part it
    before anything else."""

    def __init__(self, path: str):
        self.tokenizer, self.last, self.special = _tokenizer(path)
        self.mark = re.compile("|".join(map(re.escape, self.special)) or "(?!)")
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of distinct words among the known ones, which they join."""
        if len(self.known) > MEMO_WORDS:
            self._forget()
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(at.is_null())
        out = at.to_numpy(zero_copy_only=False)
        if len(new):
            out = np.where(np.isnan(out), 0, out).astype(np.int64)
            out[at.is_null().to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
            flat, sizes = self._words(new)
            self.known = pa.concat_arrays([self.known, new])
            self.flat, self.sizes = np.append(self.flat, flat), np.append(self.sizes, sizes)
        return out.astype(np.int64)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        n = len(words)
        offsets = np.append(np.arange(0, n, LINE_WORDS), n).astype(np.int64)
        lines = pc.binary_join(pa.LargeListArray.from_arrays(offsets, words), pa.scalar(" ", words.type)).to_pylist()
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ends = [np.flatnonzero(self.last[x]) + 1 for x in ids]
        for k, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if len(ends[k]) != hi - lo:        # a word without ids, or with an end inside: word by word
                own = [e.ids for e in self.tokenizer.encode_batch_fast(words[lo:hi].to_pylist(), add_special_tokens=False)]
                ids[k], ends[k] = np.array([i for x in own for i in x], np.uint32), np.cumsum([len(x) for x in own])
        sizes = [np.diff(e, prepend=0) for e in ends]
        return np.concatenate(ids or [np.zeros(0, np.uint32)]), np.concatenate(sizes or [np.zeros(0, np.int64)])

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and the last's end)."""
        parts, after, last_part = [], [], []
        for t in column.to_pylist():
            if t is not None and "<" in t and self.mark.search(t):
                found = [m for m in self.mark.finditer(t)]
                edges = [0, *(x for m in found for x in m.span()), len(t)]
                parts += [t[edges[k]:edges[k + 1]] for k in range(0, len(edges), 2)]
                after += [self.special[m.group()] for m in found]
            else:
                parts.append(t)
            after.append(-1)
            last_part.append(len(parts))
        normal = [t if t is None else t.lower() if t.isascii() or not LATIN.search(t)
                  else self.tokenizer.normalizer.normalize_str(t) for t in parts]
        tokens, counts = split(pa.array(normal, pa.string()), spaced=False)
        coded = tokens.dictionary_encode()
        codes = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        flat, sizes = self.flat, self.sizes
        ids = ragged(flat, np.cumsum(sizes) - sizes, sizes, codes) if len(codes) else np.zeros(0, np.uint32)
        ends = np.append(0, np.cumsum(sizes[codes]))[np.cumsum(counts)]
        after = np.array(after, np.int64)
        marked = after >= 0
        if marked.any():
            ids = np.insert(ids, ends[marked], after[marked].astype(np.uint32))
            ends = ends + np.cumsum(marked)
        return ids, np.append(0, ends[np.array(last_part, np.int64) - 1])


def difference(sizes: list[int], m: int) -> list[list[int]]:
    """Karmarkar-Karp: the indices of ``sizes`` in ``m`` windows of near-equal sums."""
    # a partial partition: window sums, descending, and the tree node of each window
    left, right = [0] + [-1 - i for i in range(len(sizes))], [0] * (len(sizes) + 1)
    heap = []
    for i, s in enumerate(sizes):
        sums, nodes = np.zeros(m, np.int64), np.zeros(m, np.int64)
        sums[0], nodes[0] = s, i + 1
        heap.append((-s if m > 1 else 0, i, sums, nodes))
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        sums, other = a + b[::-1], nb[::-1]
        nodes = np.where(na == 0, other, na)
        both = np.flatnonzero((na != 0) & (other != 0))
        nodes[both] = np.arange(len(left), len(left) + len(both))
        left += na[both].tolist()
        right += other[both].tolist()
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), number, sums, nodes[order]))
        number += 1
    out = []
    for node in heap[0][3].tolist():
        found, stack = [], [node] if node else []
        while stack:
            k = stack.pop()
            if left[k] < 0:
                found.append(-1 - left[k])
            else:
                stack += [right[k], left[k]]
        out.append(found)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; their number rises until all fit."""
    m = -(-sum(sizes) // capacity)
    while True:
        out = difference(sizes, m)
        over = sum(max(0, sum(sizes[i] for i in w) - capacity) for w in out)
        if not over:
            return [w for w in out if w]
        m += max(1, -(-over // capacity))


PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                   ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                   ("ids", pa.binary())])
PIECE_SQL = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, "
             "offset long, ids binary")


def cuts(n: int, window: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, length): full windows, then the rest as falling halves of the
    window down to ``least`` and what remains.  The small remainders let the
    differencing level the windows."""
    start, size = 0, window
    while size >= least:
        while n - start >= size:
            yield start, size
            start += size
        size //= 2
    if n > start:
        yield start, n - start


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, least_cut: int = LEAST_CUT,
         block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """One row per piece: doc_id, start and length in its document's ids,
    doc_tokens, sequence_id, offset there, and the ids (binary, unsigned
    32 bits, little-endian)."""
    def run(batches):
        words, sequence, held = WordIds(tokenizer_path), TaskContext.get().partitionId() << 32, []

        def rows_of(pieces):
            nonlocal sequence
            for w in windows([p[2] for p in pieces], window):
                offset = 0
                for i in sorted(w):
                    doc, start, length, n, ids = pieces[i]
                    yield doc, start, length, n, sequence, offset, ids
                    offset += length
                sequence += 1

        def batch(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip(cols, PIECE, strict=True)], schema=PIECE)

        for t in text_blocks(batches, TEXT_BYTES):
            ids, ends = words.texts(t.column(1).combine_chunks())
            out, out_ids = [], 0
            for doc, lo, hi in zip(t.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                own = np.append(ids[lo:hi], np.uint32(END_ID)).astype("<u4")
                for start, length in cuts(len(own), window, least_cut):
                    data = own[start:start + length].tobytes()
                    if length == window:
                        out.append((doc, start, length, len(own), sequence, 0, data))
                        sequence += 1
                    else:
                        held.append((doc, start, length, len(own), data))
                    out_ids += length
                    if len(held) == block_pieces:
                        out += rows_of(held)
                        held = []
                    if out and out_ids > 1 << 20:
                        yield batch(out)
                        out, out_ids = [], 0
            if out:
                yield batch(out)
        if held:
            yield batch(list(rows_of(held)))

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, PIECE_SQL)
