"""Benchmark passages in documents, by suffix arrays of the documents.

Documents are dealt into shards of about ``SHARD_BYTES``; a longer text is
taken in portions that overlap by a window less one word, so no place is cut.
A shard's words become ids, and the suffixes that begin with a word of some
item are sorted by their first ``ORDER`` words: the shard's suffix array.
Every suffix of every item is then found by binary search.  Its neighbours in
the array give its longest verbatim match, and where that is a window or
longer, the interval that shares the window holds all places of it.

The items are the stated query set.  They are read in blocks of at most
``ITEM_BYTES`` of text, one pass over the documents a block; a longer item is
cut into pieces that overlap by a window less one word.

Defined results: words are runs of letters A-Z (in lower case), digits and
everything beyond ASCII; null and empty texts have no words; items without
item_id take no part, items of one id count once; repeated rows and rows
without doc_id are documents of their own; an empty table gives no rows, and
without items nothing is hit; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_places, place_of, placed, scratch
from .pretokens import ragged, text_blocks

#: Words of a window, and words by which suffixes are sorted (a power of two, no less).
WINDOW, ORDER = 10, 16
SHARD_BYTES, PORTION_WORDS, ITEM_BYTES, PIECE_WORDS = 4 << 20, 1 << 20, 4 << 20, 4096
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in order, number of words of each)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    word = _WORD[raw]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = ends[:-1][ends[:-1] < len(raw)]
    start[first] |= word[first]
    at = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(at, ends))
    letters = _LOWER[raw[word]]
    offsets = np.append((np.cumsum(word) - word)[at], len(letters)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters.tobytes())])
    return words, counts


class Items:
    """A block of items: ids of their words, and all their suffixes.

    ``need`` is the length that counts: a window, or the whole of a shorter
    item; suffixes shorter than that are the ends of windows found before."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        words, counts = words_of(pa.array(texts, pa.string()))
        coded = words.dictionary_encode()
        self.known = coded.dictionary
        self.words = np.append(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.full(ORDER, -1, np.int32))
        self.ids = ids
        self.item = np.repeat(np.arange(len(counts)), counts)
        stop = np.cumsum(counts)
        self.at = np.arange(len(self.item))
        self.left = stop[self.item] - self.at
        self.need = np.minimum(window, counts)[self.item]

    def block(self) -> np.ndarray:
        """The first ``ORDER`` words of every suffix, -1 beyond its end."""
        out = self.words[self.at[:, None] + np.arange(ORDER)]
        out[np.arange(ORDER) >= self.left[:, None]] = -1
        return out


def suffix_array(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``starts`` sorted by the ``ORDER`` words from each on.  ``words`` ends in
    ``ORDER`` times -1, which sorts first; ranks of 1, 2, 4, ... words double."""
    rank = words.astype(np.int64) + 1
    size = 1
    while size < ORDER:
        pair = rank[:-size] * (rank.max() + 1) + rank[size:]
        rank = np.append(np.unique(pair, return_inverse=True)[1], np.zeros(size, np.int64))
        size *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def _compare(words: np.ndarray, at: np.ndarray, query: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(-1, 0 or 1: the suffix at ``at`` against the first ``size`` words of its
    query, words they share)."""
    sign, same, open_ = np.zeros(len(at), np.int8), np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for d in range(ORDER):
        open_ &= d < size
        if not open_.any():
            break
        a, b = words[at + d], query[:, d]
        differ = open_ & (a != b)
        sign[differ] = np.where(a[differ] < b[differ], -1, 1)
        open_ &= ~differ
        same += open_
    return sign, same


def bounds(words: np.ndarray, array: np.ndarray, query: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of all queries at once: the first place in ``array`` that
    is not before (``after``: behind) the suffixes that begin with the query."""
    low, high = np.zeros(len(query), np.int64), np.full(len(query), len(array))
    while (go := np.flatnonzero(low < high)).size:
        mid = (low[go] + high[go]) // 2
        sign, _ = _compare(words, array[mid], query[go], size[go])
        before = sign <= 0 if after else sign < 0
        low[go] = np.where(before, mid + 1, low[go])
        high[go] = np.where(before, high[go], mid)
    return low


def find(words: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Search all item suffixes in one shard, whose ``words`` are ids of the items'
    words (-1: another word, or the end of a text) with ``ORDER`` times -1 behind.

    Returns (words of the longest match, up to ``ORDER``, of every suffix; suffix
    and place of every occurrence of a window)."""
    query = items.block()
    array = suffix_array(words, np.flatnonzero(words >= 0))
    if not len(array) or not len(query):
        none = np.zeros(0, np.int64)
        return np.zeros(len(query), np.int64), none, none
    low = bounds(words, array, query, np.minimum(items.left, ORDER), False)
    longest = np.zeros(len(query), np.int64)
    for near in (low - 1, low):
        there = np.flatnonzero((near >= 0) & (near < len(array)))
        _, same = _compare(words, array[near[there]], query[there], np.minimum(items.left, ORDER)[there])
        longest[there] = np.maximum(longest[there], same)
    full = np.flatnonzero((longest >= items.need) & (items.left >= items.need))
    first = bounds(words, array, query[full], items.need[full], False)
    count = bounds(words, array, query[full], items.need[full], True) - first
    return longest, np.repeat(full, count), ragged(array, first, count, np.arange(len(full)))


def extend(words: np.ndarray, places: np.ndarray, items: Items, suffixes: np.ndarray) -> np.ndarray:
    """Words of the longest verbatim match of each suffix at each place."""
    size = items.need[suffixes].copy()
    go = np.arange(len(places))
    while len(go):
        more = size[go] < items.left[suffixes[go]]
        go = go[more]
        go = go[words[places[go] + size[go]] == items.words[items.at[suffixes[go]] + size[go]]]
        size[go] += 1
    return size


def item_blocks(benchmark: DataFrame, window: int) -> Iterator[tuple[list[str], list[str]]]:
    """(ids, texts) of the items in blocks of at most ``ITEM_BYTES`` and a piece."""
    step = PIECE_WORDS - window + 1

    def pieces(batches):
        for b in batches:
            for k in range(b.num_rows):
                words, counts = words_of(b.column(1).slice(k, 1))
                texts = [words.slice(at, PIECE_WORDS) for at in range(0, max(1, int(counts[0]) - window + 1), step)]
                texts = [b" ".join(t.to_pylist()).decode() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * len(texts), pa.string()),
                                                  pa.array(texts, pa.string())], ["item_id", "text"])
    spark = benchmark.sparkSession
    path = scratch(spark, "items")
    benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("string"), F.col("text").cast("string")) \
        .mapInArrow(pieces, "item_id string, text string").write.parquet(path)
    ids, texts, size = [], [], 0
    for row in spark.read.parquet(path).toLocalIterator():
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text.encode())
        if size >= ITEM_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


MATCHES = "item_id string, item_word long, doc_word long, n_words long"
HITS = "file string, row long, doc_id long, n_words long, hit array<int>, items array<string>"


def _pass(shared, window: int, all_rows: bool, matches: bool):
    """(doc_id, text, file, row) -> a row a document (the hit ones unless
    ``all_rows``), or a row for every longest match."""
    def portions(words: np.ndarray):
        step = PORTION_WORDS
        for at in range(0, max(1, len(words)), step):
            yield at, np.append(words[at:at + step + window - 1], np.full(ORDER, -1, np.int32))

    def run(batches):
        items = Items(*shared.value, window)
        for block in text_blocks(batches, SHARD_BYTES):
            block = block.combine_chunks()
            text = block.column(1).combine_chunks()
            words, counts = words_of(text)
            # -1 behind every text: no match goes on there
            ids = pc.fill_null(pc.index_in(words, items.known), -1).to_numpy(zero_copy_only=False).astype(np.int32)
            owner = np.repeat(np.arange(len(counts)), counts)
            flat = np.full(len(ids) + len(counts), -1, np.int32)
            flat[np.arange(len(ids)) + owner] = ids
            first = np.cumsum(counts + 1) - counts - 1
            places, suffixes, sizes = [], [], []
            for at, part in portions(flat):
                _, s, p = find(part, items)
                s, p = s[p < PORTION_WORDS], p[p < PORTION_WORDS]      # the overlap's places belong to the next portion
                if matches:
                    sizes.append(extend(flat_end(flat), p + at, items, s))
                places.append(p + at)
                suffixes.append(s)
            places, suffixes = np.concatenate(places), np.concatenate(suffixes)
            doc = np.searchsorted(first, places, "right") - 1
            if matches:
                yield from _match_rows(block, items, doc, places - first[doc], suffixes, np.concatenate(sizes))
            else:
                yield _document_rows(block, items, counts, first, places, suffixes, doc, all_rows)

    def flat_end(flat):
        return np.append(flat, np.full(ORDER, -1, np.int32))
    return run


def _match_rows(block, items, doc, word, suffix, size):
    """One row a match that no longer match of the item holds: where the words before differ or there are none."""
    begins = (items.at[suffix] - word) * (len(block) + 1) + doc       # equal along one diagonal of one text
    order = np.lexsort((word, begins, items.item[suffix]))
    same = np.append(False, (begins[order][1:] == begins[order][:-1]) & (np.diff(word[order]) == 1)
                     & (np.diff(items.item[suffix][order]) == 0))
    keep = order[~same]
    yield pa.RecordBatch.from_arrays([
        block.column(2).take(pa.array(doc[keep])).combine_chunks(), block.column(3).take(pa.array(doc[keep])).combine_chunks(),
        block.column(0).take(pa.array(doc[keep])).combine_chunks(),
        pa.array([items.ids[k] for k in items.item[suffix[keep]].tolist()], pa.string()),
        pa.array(items.at[suffix[keep]] - np.searchsorted(items.item, items.item[suffix[keep]])),
        pa.array(word[keep]), pa.array(size[keep])],
        ["file", "row", "doc_id", "item_id", "item_word", "doc_word", "n_words"])


def _document_rows(block, items, counts, first, places, suffixes, doc, all_rows):
    n = len(counts)
    # words inside occurrences: the running count of occurrences begun and not ended
    total = int((counts + 1).sum())
    inside = np.zeros(total + 1, np.int64)
    np.add.at(inside, places, 1)
    np.add.at(inside, places + items.need[suffixes], -1)
    hit = np.flatnonzero(np.cumsum(inside)[:total] > 0)
    hit_doc = np.searchsorted(first, hit, "right") - 1
    pairs = np.unique(doc * len(items.ids) + items.item[suffixes]) if len(doc) else np.zeros(0, np.int64)
    item_doc, item = np.divmod(pairs, max(1, len(items.ids)))
    rows = np.arange(n) if all_rows else np.unique(hit_doc)

    def lists(owner, values, kind):
        size = np.bincount(owner, minlength=n)[rows]
        offsets = np.append(0, np.cumsum(size)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
    take = pa.array(rows)
    return pa.RecordBatch.from_arrays([
        block.column(2).take(take).combine_chunks(), block.column(3).take(take).combine_chunks(),
        block.column(0).take(take).combine_chunks(), pa.array(counts[rows].astype(np.int64)),
        lists(hit_doc, (hit - first[hit_doc]).astype(np.int32), pa.int32()),
        lists(item_doc, [items.ids[k] for k in item.tolist()], pa.string())],
        ["file", "row", "doc_id", "n_words", "hit", "items"])


def _source(docs: DataFrame) -> DataFrame:
    """The rows with their places; ``docs`` is ``placed``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *place_of(docs))


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """file, row, doc_id, item_id, item_word, doc_word, n_words: every verbatim
    match of a window or more that cannot be extended (of a cut item, a row a piece)."""
    docs = placed(docs)
    found = None
    for block in item_blocks(benchmark, window):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        here = _source(docs).mapInArrow(_pass(shared, window, False, True), "file string, row long, doc_id long, " + MATCHES)
        found = here if found is None else found.unionByName(here)
    return found if found is not None else docs.sparkSession.createDataFrame([], "file string, row long, doc_id long, " + MATCHES)


def hit_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """file, row, doc_id, n_words, hit (word numbers), items (ids): a row a document."""
    docs = placed(docs)
    spark = docs.sparkSession
    base = scratch(spark, "decontaminate")
    n = 0
    for block in item_blocks(benchmark, window):
        shared = spark.sparkContext.broadcast(block)
        _source(docs).mapInArrow(_pass(shared, window, n == 0, False), HITS).write.parquet(f"{base}/{n}")
        shared.unpersist()
        n += 1
    if n == 0:
        shared = spark.sparkContext.broadcast(([], []))
        return _source(docs).mapInArrow(_pass(shared, window, True, False), HITS)
    if n == 1:
        return spark.read.parquet(f"{base}/0")
    # a document has at most one row a block of items
    return spark.read.parquet(*[f"{base}/{k}" for k in range(n)]).groupBy("file", "row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list("hit")).alias("hit"), F.flatten(F.collect_list("items")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per row of ``docs``."""
    items = F.array_distinct("items")
    hit = F.size(F.array_distinct("hit")).cast("long")
    return hit_documents(docs, benchmark, window).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, all columns."""
    docs = placed(docs)
    gone = hit_documents(docs, benchmark, window).filter("size(hit) > 0").select("file", "row")
    return drop_places(docs, gone)
