"""Matches of many patterns in a block of texts, by where the words of the patterns stand.

Most patterns of a workload are words, alone or with .* between two, held to the start or the end, or a choice of such
(regexplan.arms). Every word of every pattern is found in a block in one pass a word length: hashes of all windows of that
length are looked up among the words', and what is found is compared letter by letter. A pattern is then answered from
the lists of its words, without looking at a text. Other patterns are tried one by one on the texts that hold the trigrams
they need.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from lodevec.plans import regexplan

#: Bytes of text that a block should have; hashes take eight times as much.
BLOCK_BYTES = 4 << 20
_BITS = 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.zeros(0, "i8")


def blocks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together, and cut, to blocks of about BLOCK_BYTES of column str and at most so many rows."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for b in batches:
        step = max(1, min(rows, len(b) * BLOCK_BYTES // max(1, b.column("str").nbytes)))
        for i in range(0, len(b), step):
            part = b.slice(i, step)
            more = part.column("str").nbytes
            if held and (n + len(part) > rows or size + more > BLOCK_BYTES):
                yield pa.concat_batches(held)
                held, n, size = [], 0, 0
            held.append(part)
            n, size = n + len(part), size + more
    if held:
        yield pa.concat_batches(held)


class Patterns:
    """Valid patterns, made ready once a task."""

    def __init__(self, patterns: list[str], case_sensitive: bool = False) -> None:
        arms = [regexplan.arms(p) for p in patterns]
        form = str if case_sensitive else str.lower
        words = sorted({form(w) for a in arms if a for arm in a for w in arm[1:3] if w})
        number = {w: i for i, w in enumerate(words)}
        self.arms = [a and [(s, number[form(v)], number[form(w)] if w else -1, e) for s, v, w, e in a] for a in arms]
        self.other = {i: (regexplan.compiled(p, case_sensitive).search, regexplan.required(p)) for i, (p, a) in enumerate(zip(patterns, arms)) if not a}
        code = np.arange(256, dtype="u1")
        self.fold = code if case_sensitive else np.where((code >= 65) & (code <= 90), code + 32, code).astype("u1")
        self.length = np.array([len(w) for w in words], "i8")
        self.base, self.tables = np.uint64(0xD6E8FEB86659FD93), {}
        while not self._tables(words):
            self.base += np.uint64(2)

    def _tables(self, words: list[str]) -> bool:
        """Of each length: a filter by the hash's first bits, hashes in order, their words' numbers and letters. False
        where two words have one hash."""
        for n in sorted(set(self.length.tolist())):
            numbers = np.flatnonzero(self.length == n)
            letters = np.frombuffer("".join(words[i] for i in numbers).encode(), "u1").reshape(-1, n)
            h = np.zeros(len(numbers), "u8")
            for j in range(n):
                h = h * self.base + letters[:, j]
            by = np.argsort(h)
            if (h[by][1:] == h[by][:-1]).any():
                return False
            may = np.zeros(1 << _BITS, "?")
            may[(h * _MIX) >> np.uint64(64 - _BITS)] = True
            self.tables[n] = may, h[by], numbers[by], letters[by]
        return True

    def block(self, texts: pa.Array) -> Block:
        return Block(self, texts)


class Block:
    """Texts in which the patterns' words have been found. A null matches nothing."""

    def __init__(self, patterns: Patterns, texts: pa.Array) -> None:
        self.patterns, self.n, self.texts, self.held = patterns, len(texts), texts, None
        flat = texts.fill_null("").cast(pa.large_string())
        _, ends, data = flat.buffers()
        ends = np.frombuffer(ends, "i8")[flat.offset : flat.offset + self.n + 1] if self.n else np.zeros(1, "i8")
        data = np.frombuffer(data, "u1")[ends[0] : ends[-1]] if data is not None else np.zeros(0, "u1")
        ends = ends - ends[0]
        data = patterns.fold[data]
        at, word, row = self._found(data, ends)
        feeds = np.flatnonzero(data == 10)
        self.row_of, line = None, row
        if len(feeds):  # .* stays within a line
            starts = np.concatenate([ends[:-1], feeds + 1])
            rows = np.concatenate([np.arange(self.n), np.searchsorted(ends[1:], feeds, "right")])
            by = np.lexsort((rows, starts))
            self.row_of, line = rows[by], np.searchsorted(starts[by], at, "right") - 1
        key = word * (self.n + len(feeds)) + line
        by = np.argsort(key, kind="stable")
        at, word, row, line, key = at[by], word[by], row[by], line[by], key[by]
        new = np.ones(len(key), "?")
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(key))[: len(first)] - 1
        word, row = word[first], row[first]
        self.line, self.head, self.tail = line[first], at[first], at[last]
        self.begins = self.head == ends[row]
        self.closes = self.tail + patterns.length[word] == ends[row + 1]
        self.bound = np.searchsorted(word, np.arange(len(patterns.length) + 1)).tolist()

    def _found(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, word, text) of every occurrence, places of a word in order."""
        got, n, p = [(_NONE, _NONE, _NONE)], len(data), self.patterns
        h = np.zeros(n, "u8")
        for size in range(1, min(n, max(p.tables, default=0)) + 1):
            h = h[: n - size + 1]
            h *= p.base
            h += data[size - 1 :]
            if size not in p.tables:
                continue
            may, hashes, numbers, letters = p.tables[size]
            at = np.flatnonzero(may[(h * _MIX) >> np.uint64(64 - _BITS)])
            k = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
            same = hashes[k] == h[at]
            at, k = at[same], k[same]
            text = np.searchsorted(ends[1:], at, "right")
            same = at + size <= ends[text + 1]
            for j in range(size):
                same &= data[at + j] == letters[k, j]
            got.append((at[same], numbers[k[same]], text[same]))
        return tuple(np.concatenate(c) for c in zip(*got))

    def _lines(self, start: bool, a: int, b: int, end: bool) -> np.ndarray:
        lo, hi = self.bound[a], self.bound[a + 1]
        if b < 0:
            if not (start or end):
                return self.line[lo:hi]
            fits = self.begins[lo:hi] if start else self.closes[lo:hi]
            if start and end:
                fits = fits & self.closes[lo:hi] & (self.head[lo:hi] == self.tail[lo:hi])
            return self.line[lo:hi][fits]
        lo2, hi2 = self.bound[b], self.bound[b + 1]
        if lo == hi or lo2 == hi2:
            return _NONE
        x, y = self.line[lo:hi], self.line[lo2:hi2]
        if len(x) <= len(y):
            k = np.searchsorted(y, x)
            i = np.flatnonzero(y[np.minimum(k, len(y) - 1)] == x)
            i, k = i + lo, k[i] + lo2
        else:
            i = np.searchsorted(x, y)
            k = np.flatnonzero(x[np.minimum(i, len(x) - 1)] == y)
            i, k = i[k] + lo, k + lo2
        fits = self.head[i] + self.patterns.length[a] <= self.tail[k]
        if start:
            fits &= self.begins[i]
        if end:
            fits &= self.closes[k]
        return self.line[i[fits]]

    def rows(self, pattern: int) -> np.ndarray:
        """Places of the texts that match the pattern of this number, in order."""
        arms = self.patterns.arms[pattern]
        if not arms:
            return self._tried(*self.patterns.other[pattern])
        got = [g for arm in arms if len(g := self._lines(*arm))]
        if not got:
            return _NONE
        if len(got) == 1 and self.row_of is None:
            return got[0]
        found = np.concatenate(got)
        if self.row_of is not None:
            found = self.row_of[found]
        if len(found) < 1000:
            return np.unique(found)
        held = np.zeros(self.n, "?")
        held[found] = True
        return np.flatnonzero(held)

    def _tried(self, search, plan: regexplan.Dnf) -> np.ndarray:
        if self.held is None:
            self.texts = self.texts.to_pylist()
            self.held = regexplan.postings([t or "" for t in self.texts])
        t = self.texts
        return np.array(sorted(i for i in regexplan.allowed(self.held, plan, self.n) if t[i] is not None and search(t[i])), "i8")
