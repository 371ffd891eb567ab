"""Terms of a batch of posts, counted with Arrow and numpy inside tasks.

A batch is a list of kept words per post; its terms are these words and the
pairs of neighbours.  Batches are worked off in pieces of a bounded number of
words, whole posts each, so a task holds one piece whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a piece (one post at least).
PIECE_WORDS = 1 << 20
#: Hash buckets that bound the occurrences of their terms (a power of two).
BUCKETS = 1 << 20


def pieces(words: pa.Array, size: int = PIECE_WORDS) -> Iterator[pa.Array]:
    """Slices of ``words`` (lists) of about ``size`` words, a post at least."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(words):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield words.slice(at, to - at)
        at = to


def terms(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The post (its place in ``words``) and the term, for every occurrence."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    post, flat = np.repeat(np.arange(len(words)), lengths), words.flatten()
    pair = post[1:] == post[:-1]
    if not pair.any():
        return post, flat
    here = pa.array(pair)
    pairs = pc.binary_join_element_wise(flat[:-1].filter(here), flat[1:].filter(here), pa.scalar(" ", flat.type))
    return np.concatenate([post, post[1:][pair]]), pa.concat_arrays([flat, pairs])


def numbered(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The post and the number of the term, for every occurrence, and the w
    distinct words: word i has number i, the pair of i and j w + i * w + j."""
    lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    post, coded = np.repeat(np.arange(len(words)), lengths), words.flatten().dictionary_encode()
    at, w = coded.indices.to_numpy(zero_copy_only=False).astype("int64"), len(coded.dictionary)
    first = np.flatnonzero(post[1:] == post[:-1])
    return np.concatenate([post, post[first]]), np.concatenate([at, w + at[first] * w + at[first + 1]]), coded.dictionary


def buckets(number: np.ndarray, words: pa.Array) -> np.ndarray:
    """The hash bucket of every term, the same in every task."""
    w = len(words)
    h = pd.util.hash_array(np.asarray(words.to_pylist(), object), categorize=False)
    pair = number >= w
    i, j = np.divmod(number[pair] - w, max(1, w))
    out = np.empty(len(number), "uint64")
    out[~pair] = h[number[~pair]]
    out[pair] = (h[i] * np.uint64(0x9E3779B97F4A7C15) + h[j]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (out >> np.uint64(65 - BUCKETS.bit_length())).astype("int64")


def loads(batches: Iterator[pa.Array]) -> np.ndarray:
    """The occurrences of terms in every bucket; no term of a bucket has more."""
    out = np.zeros(BUCKETS, "int64")
    for words in batches:
        for piece in pieces(words):
            _, number, table = numbered(piece)
            out += np.bincount(buckets(number, table), minlength=BUCKETS)
    return out


def heavy_frequencies(words: pa.Array, heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """As ``frequencies``, for the terms whose bucket is set in ``heavy``; text is
    made of their numbers only."""
    for piece in pieces(words):
        post, number, table = numbered(piece)
        there = heavy[buckets(number, table)]
        if not there.any():
            continue
        found, code = np.unique(number[there], return_inverse=True)
        _, code, tf = counted(post[there], code, len(found))
        w = len(table)
        i, j = np.divmod(found[found >= w] - w, w)
        pairs = pc.binary_join_element_wise(table.take(pa.array(i)), table.take(pa.array(j)), pa.scalar(" ", table.type))
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([table.take(pa.array(found[found < w])), pairs]), pa.array(np.bincount(code, minlength=len(found)), pa.int64()),
             pa.array(np.bincount(code, tf, len(found)).astype("int64"))], names=["term", "df", "cf"])


def counted(post: np.ndarray, code: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(post, code, tf), once for each post and code, in this order; negative codes are left out."""
    there = code >= 0
    both, tf = np.unique(post[there] * width + code[there], return_counts=True)
    return both // width, both % width, tf


def frequencies(words: pa.Array) -> Iterator[pa.RecordBatch]:
    """(term, df, cf) of each piece: its posts with the term and all its occurrences."""
    for piece in pieces(words):
        post, found = terms(piece)
        if not len(found):
            continue
        coded = found.dictionary_encode()
        width = len(coded.dictionary)
        _, code, tf = counted(post, coded.indices.to_numpy().astype("int64"), width)
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary, pa.array(np.bincount(code, minlength=width), pa.int64()),
             pa.array(np.bincount(code, tf, width).astype("int64"))], names=["term", "df", "cf"])


def _weights(piece: pa.Array, vocabulary: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(post, place in the vocabulary, weight), in this order, of a piece's terms."""
    post, found = terms(piece)
    code = pc.fill_null(pc.index_in(found, value_set=vocabulary.cast(found.type)), -1).to_numpy().astype("int64")
    post, code, tf = counted(post, code, max(1, len(vocabulary)))
    v = tf * idf[code]
    norm = np.sqrt(np.bincount(post, v * v, len(piece)))
    return post, code, v / norm[post]


def _by_post(post: np.ndarray, n: int, columns: dict[str, pa.Array]) -> pa.Array:
    """Lists of structs, a list a post, of rows ordered by post."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(post, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def weighted(words: pa.Array, vocabulary: pa.Array, idf: np.ndarray, more: dict[str, np.ndarray]) -> pa.Array:
    """For every post the list of its terms of the ``vocabulary``, in the
    vocabulary's order, with the weight (tf * idf, of length one over the post)
    and the term's values in ``more``."""
    out = []
    for piece in pieces(words):
        post, code, weight = _weights(piece, vocabulary, idf)
        out.append(_by_post(post, len(piece), {"term": vocabulary.take(pa.array(code)), "weight": pa.array(weight)}
                            | {n: pa.array(x[code]) for n, x in more.items()}))
    fields = [("term", pa.string()), ("weight", pa.float64()), *[(n, pa.float64()) for n in more]]
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct(fields)))


#: Contributions that are as large after rounding to 12 digits differ by less than this.
NEAR = 2e-12


def contributions(words: pa.Array, vocabulary: pa.Array, idf: np.ndarray, coef: np.ndarray, top_n: int) -> pa.Array:
    """For every post the sum of its terms' contributions (coef * weight), and the
    (term, contribution) that can be among the ``top_n`` lowest (``low``) or highest
    (``high``): those, and what may equal the last of them when rounded, but none
    that stays below zero, or above, after it."""
    out = []
    for piece in pieces(words):
        post, code, weight = _weights(piece, vocabulary, idf)
        value, n = coef[code] * weight, len(piece)
        sides = []
        for sign in (-1, 1):
            some = np.flatnonzero(sign * value > -NEAR)
            ranked = some[np.lexsort((-sign * value[some], post[some]))]
            of = post[ranked]
            begin = np.searchsorted(of, np.arange(n))
            at, last = np.arange(len(ranked)) - begin[of], np.full(n, -NEAR)
            last[of[at == top_n - 1]] = sign * value[ranked[at == top_n - 1]]
            near = ranked[(at < top_n) | (sign * value[ranked] >= last[of] - NEAR)]
            near = np.sort(near)
            sides.append(_by_post(post[near], n, {"term": vocabulary.take(pa.array(code[near])), "contribution": pa.array(value[near])}))
        out.append(pa.StructArray.from_arrays([pa.array(np.bincount(post, value, n)), *sides], names=["margin", "low", "high"]))
    side = pa.list_(pa.struct([("term", pa.string()), ("contribution", pa.float64())]))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([("margin", pa.float64()), ("low", side), ("high", side)]))
