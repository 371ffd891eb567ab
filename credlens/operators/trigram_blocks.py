"""Trigrams of a batch of clean texts, counted with numpy inside tasks.

Batches are worked off in pieces of a bounded number of characters, whole texts
each.  A trigram is a number: its characters' places in an alphabet, three
digits to the alphabet's base, so few characters need one table look-up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of a piece (one text at least), and entries of a look-up table.
PIECE_CHARS, TABLE = 1 << 20, 1 << 22


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, windows): the places of some texts that are neither NULL nor empty, and
    the characters of " text " one after the other with the row of each."""
    size = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype("int64")
    rows = np.flatnonzero(size)
    ends = np.cumsum(size[rows] + 2)
    at = 0
    while at < len(rows):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PIECE_CHARS, side="right")))
        some = rows[at:to]
        joined = "".join(f" {t} " for t in texts.take(pa.array(some)).to_pylist())
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        yield np.repeat(some, size[some] + 2), chars
        at = to


def _digits(chars: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """The place of each character in the sorted ``alphabet``, 1 up, 0 where it is not in it."""
    table = np.zeros(max(int(chars.max()), int(alphabet[-1])) + 1, "int64")
    table[alphabet] = np.arange(1, len(alphabet) + 1)
    return table[chars]


def _windows(row: np.ndarray, digits: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of every trigram that lies in one text."""
    inside = row[2:] == row[:-2]
    return row[2:][inside], ((digits[:-2] * base + digits[1:-1]) * base + digits[2:])[inside]


def counts(langs: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each piece; texts without a language take no part."""
    coded = langs.dictionary_encode()
    lang = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype("int64")
    for row, chars in pieces(pc.if_else(pc.is_valid(langs), texts, pa.scalar(None, texts.type))):
        alphabet = np.flatnonzero(np.bincount(chars))
        base = len(alphabet) + 1
        row, number = _windows(row, _digits(chars, alphabet), base)
        both = lang[row] * base ** 3 + number
        if len(coded.dictionary) * base ** 3 <= TABLE:
            n = np.bincount(both)
            both = np.flatnonzero(n)
            n = n[both]
        else:
            both, n = np.unique(both, return_counts=True)
        number = both % base ** 3
        made = [alphabet[number // base ** k % base - 1] for k in (2, 1, 0)]
        grams = np.stack(made, axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(both // base ** 3)), pa.array([grams[i:i + 3] for i in range(0, len(grams), 3)], pa.string()),
             pa.array(n.astype("int64"))], names=["lang", "gram", "n"])


class Profiles:
    """Trigrams of languages with what each adds to a text's score."""

    def __init__(self, rows: Sequence[tuple[str, str, int]]):
        """``rows``: (lang, gram, what it adds)."""
        self.langs = sorted({r[0] for r in rows})
        self.alphabet = np.array(sorted({ord(c) for _, g, _ in rows for c in g}), "int64")
        self.base = len(self.alphabet) + 1
        place = {chr(c): k + 1 for k, c in enumerate(self.alphabet.tolist())}
        number = [(place[g[0]] * self.base + place[g[1]]) * self.base + place[g[2]] for _, g, _ in rows]
        self.numbers, at = np.unique(np.array(number, "int64"), return_inverse=True)
        self.up, self.n = (np.zeros((len(self.numbers), len(self.langs))) for _ in range(2))
        lang = [self.langs.index(r[0]) for r in rows]
        np.add.at(self.up, (at, lang), [r[2] for r in rows])
        np.add.at(self.n, (at, lang), 1)

    def _found(self, number: np.ndarray) -> np.ndarray:
        if self.base ** 3 <= TABLE:
            table = np.full(self.base ** 3, -1, "int32")
            table[self.numbers] = np.arange(len(self.numbers))
            return table[number]
        at = np.minimum(np.searchsorted(self.numbers, number), len(self.numbers) - 1)
        return np.where(self.numbers[at] == number, at, -1)

    def scores(self, texts: pa.Array) -> pa.Array:
        """For every text the list of (lang, score) of the languages of which it holds a trigram."""
        score, hits = (np.zeros((len(texts), len(self.langs))) for _ in range(2))
        for row, chars in pieces(texts) if len(self.langs) else ():
            row, number = _windows(row, _digits(chars, self.alphabet), self.base)
            found = self._found(number)
            row, found = row[found >= 0], found[found >= 0]
            if not len(row):
                continue
            low, width = int(row[0]), int(row[-1] - row[0]) + 1
            for k in range(len(self.langs)):
                score[low:low + width, k] += np.bincount(row - low, self.up[found, k], width)
                hits[low:low + width, k] += np.bincount(row - low, self.n[found, k], width)
        post, lang = np.nonzero(hits)
        ends = np.concatenate([[0], np.cumsum(np.bincount(post, minlength=len(texts)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(np.array(self.langs, object)[lang] if len(lang) else [], pa.string()),
             pa.array(score[post, lang].astype("int64"))], names=["lang", "score"]))
