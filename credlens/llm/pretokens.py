"""Splitting whole batches of texts into pre-tokens, as numpy over code points.

Two patterns, both exact (tests compare them with the two libraries):
``spaced`` is the byte-level one, whose tokens take one leading space and keep
all white space; ``plain`` drops white space and gives every number character
a token of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: What may follow an apostrophe that begins a token.
ENDINGS_1, ENDINGS_2 = "stmd", ("re", "ve", "ll")


EVERY = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def _in_tiktoken(pattern: str) -> str:
    """All characters that ``pattern`` matches, by tiktoken's expressions."""
    import tiktoken

    e = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([k]): k for k in range(256)},
                          special_tokens={})
    return bytes(e.encode_ordinary(EVERY)).decode()


def _in_tokenizers(pattern: str) -> str:
    """The same by the expressions of the tokenizers library."""
    from tokenizers import Regex, pre_tokenizers

    found = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(EVERY)
    return "".join(x for x, _ in found)


@lru_cache(maxsize=2)
def class_table(spaced: bool) -> np.ndarray:
    """The class of every code point, as the library that defines the tokens
    sees it: their Unicode versions differ in recent characters."""
    matched = _in_tiktoken if spaced else _in_tokenizers
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        out[np.frombuffer(matched(pattern).encode("utf-32-le"), np.uint32)] = c
    return out


def split(texts: pa.Array, spaced: bool) -> tuple[pa.Array, np.ndarray]:
    """(tokens of all texts in order, number of tokens of each text).

    Null texts count as empty.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[ends[0]:ends[-1]] if len(texts) else memoryview(b"")
    ends = ends - ends[0] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)
    n_bytes = len(raw)
    if not n_bytes:
        return pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)
    cp = np.frombuffer(bytes(data).decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(cp) == n_bytes:
        at, edges = np.arange(n_bytes, dtype=np.int64), ends
    else:
        lead = (raw & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        edges = np.searchsorted(at, ends)
    c = class_table(spaced)[cp]
    first = np.zeros(len(cp) + 1, bool)
    first[edges] = True
    before = np.empty_like(c)
    before[0], before[1:] = 0, c[:-1]
    before[first[:-1]] = 0
    start = before != c
    if spaced:
        after = np.empty_like(c)
        after[-1], after[:-1] = 0, c[1:]
        after[first[1:]] = 0
        space = c == SPACE
        after_space = np.zeros(len(cp), bool)
        after_space[1:] = cp[:-1] == 32
        after_space &= before == SPACE
        start = np.where(space, start | ((after != SPACE) & (after != 0)), start & ~after_space)
    else:
        start |= c == NUMBER
    mark = np.flatnonzero((cp == 39) & start)
    if len(mark):
        _contractions(cp, first, start, mark)
    starts = np.flatnonzero(start)
    owner = np.searchsorted(edges, starts, side="right") - 1
    offsets = np.append(at[starts], n_bytes).astype(np.int64)
    tokens = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    if not spaced:
        keep = c[starts] != SPACE
        tokens, owner = tokens.filter(pa.array(keep)), owner[keep]
    return tokens, np.bincount(owner, minlength=len(texts))


def _contractions(cp: np.ndarray, first: np.ndarray, start: np.ndarray, mark: np.ndarray) -> None:
    """Make ``'s`` and the like tokens where the apostrophe begins one."""
    n = len(cp)
    padded = np.append(cp, [0, 0])
    one, two = padded[mark + 1], padded[mark + 2]
    in_1 = ~first[mark + 1]
    in_2 = in_1 & ~first[np.minimum(mark + 2, n)] & (mark + 2 < n)
    size = np.zeros(len(mark), np.int64)
    for x in ENDINGS_2:
        size[in_2 & (one == ord(x[0])) & (two == ord(x[1]))] = 3
    for x in ENDINGS_1:
        size[in_1 & (one == ord(x))] = 2
    mark, size = mark[size > 0], size[size > 0]
    start[mark + 1] = False
    start[(mark + 2)[size == 3]] = False
    then = mark + size
    start[then[then < n]] = True


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The slices ``flat[starts[k]:starts[k] + sizes[k]]`` for k of ``pick``, joined."""
    n = sizes[pick]
    total = int(n.sum())
    if not total:
        return flat[:0]
    begin = np.cumsum(n) - n
    return flat[np.repeat(starts[pick] - begin, n) + np.arange(total)]


def text_blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Rows regrouped into blocks of about ``size`` bytes of column 1 (text)."""
    held, n = [], 0
    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy()
        at = 0
        for k, x in enumerate(lengths):
            n += int(x)
            if n >= size:
                yield pa.Table.from_batches([*held, b.slice(at, k + 1 - at)])
                held, n, at = [], 0, k + 1
        if at < b.num_rows:
            held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)
