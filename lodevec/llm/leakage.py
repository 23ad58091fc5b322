"""Test items that stand in documents, by a generalised suffix automaton over the items' words.

The automaton of all items is built once; a document's words stream through it and at each word the automaton knows
the longest run ending there that is part of some item. Where that run grows by a word, the items that hold it stay the
same and no suffix of it that is long enough is held by others, nothing is looked up; else the states of such suffixes
are visited.

Items are read on the driver and their automata go to every task, so the words of all items together are bounded
(MOST_WORDS): evaluation sets are small beside a corpus. Documents are read once, whatever the items.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of all items (about 200 bytes each in a task), and those of one automaton.
MOST_WORDS, GROUP_WORDS = 5_000_000, 200_000
_WORD = re.compile(r"[^\W_]+")


def spans(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end): maximal runs of letters and digits, lower-cased."""
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


class Automaton:
    """Suffix automaton of several word sequences. items[v] are the sequences that hold the words of state v."""

    def __init__(self, sequences: list[tuple[int, list[str]]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.size = {item: len(words) for item, words in sequences}
        held: list[set[int]] = [set()]
        for item, words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                held.extend(set() for _ in range(len(self.link) - len(held)))
                held[last].add(item)
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            held[self.link[v]] |= held[v]
        held[0] = set()
        self.items = [tuple(sorted(h)) for h in held]
        #: of each state the nearest suffix that more items hold
        self.wider = [0] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=lambda v: self.length[v]):
            u = self.link[v]
            self.wider[v] = u if len(self.items[u]) > len(self.items[v]) or not u else self.wider[u]

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, c: int) -> int:
        """The state that p leads to by c, holding nothing longer than p and c."""
        q = self.step[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.step[last]:
            return self._split(last, c)
        cur = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, c)
        return cur

    def longest(self, words: list[str], least: int) -> tuple[dict[int, int], list[tuple[int, int]]]:
        """({item: longest run of words shared with it, from least on}, [(first, last) word of each maximal run])."""
        best: dict[int, int] = defaultdict(int)
        runs: list[tuple[int, int]] = []
        v = n = seen = 0  # seen: the state of the word before, if its run was long enough
        step, link, length, known = self.step, self.link, self.length, self.vocabulary.get

        def note(v: int, n: int) -> None:
            while n >= least:
                for item in self.items[v]:
                    if n > best[item]:
                        best[item] = n
                v = self.wider[v]
                n = length[v]

        before = 0
        for at, w in enumerate(words):
            c = known(w)
            nxt = None
            if c is not None:
                while v and c not in step[v]:
                    v = link[v]
                    n = length[v]
                nxt = step[v].get(c)
            if nxt is None:
                v = n = 0
            else:
                v, n = nxt, n + 1
            if seen and not (n == before + 1 and self.items[v] == self.items[seen] and length[self.wider[seen]] < least):
                note(seen, before)
            seen, before = (v, n) if n >= least else (0, 0)
            if seen:
                if runs and runs[-1][1] == at - 1 and runs[-1][0] <= at - n + 1:
                    runs[-1] = (runs[-1][0], at)
                else:
                    runs.append((at - n + 1, at))
        if seen:
            note(seen, before)
        return best, runs


def automata(items: DataFrame) -> list[Automaton]:
    """Automata of (item_id, passage). Null passages and those without words are left out; of an item_id given more
    than once all passages count. The items are held-out test material, read in groups of GROUP_WORDS words; more than
    MOST_WORDS in all raise ValueError."""
    out, group, n, total = [], [], 0, 0
    for r in items.select("item_id", "passage").filter("passage is not null and item_id is not null").toLocalIterator():
        words = [w for w, _, _ in spans(r.passage)]
        if n and n + len(words) > GROUP_WORDS:
            out.append(Automaton(group))
            group, n = [], 0
        total += len(words)
        if total > MOST_WORDS:
            raise ValueError(f"items of more than {MOST_WORDS} words; look for them in parts")
        group.append((r.item_id, words))
        n += len(words)
    return [*out, Automaton(group)] if group else out


def leaks(documents: DataFrame, items: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, item_id, words, item_words): items of which a document holds `least` or more consecutive words, with
    the longest such run. Null and blank texts and documents without an id give nothing. Equal documents each give their own rows."""
    spark = documents.sparkSession
    made = [spark.sparkContext.broadcast(a) for a in automata(items)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, text in zip(pdf.doc_id, pdf.text):
                names = [w for w, _, _ in spans(text)]
                got: dict[tuple[int, int], int] = {}
                for a in made:
                    for item, n in a.value.longest(names, least)[0].items():
                        key = item, a.value.size[item]
                        got[key] = max(n, got.get(key, 0))
                rows += [(d, item, n, size) for (item, size), n in got.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "item_words"])

    return documents.filter("text is not null and doc_id is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, item_id long, words int, item_words int")


def cleaned(documents: DataFrame, items: DataFrame, least: int = 12, most_share: float = 0.5) -> DataFrame:
    """(doc_id, text, removed_words, dropped) of the documents that hold leaked runs.

    Runs of `least` or more words are cut out of the text. Where they make up more than most_share of the document's
    words, the whole document is dropped: its text is null and dropped is true.
    """
    spark = documents.sparkSession
    made = [spark.sparkContext.broadcast(a) for a in automata(items)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, text in zip(pdf.doc_id, pdf.text):
                words = spans(text)
                names = [w for w, _, _ in words]
                gone = {i for a in made for s, e in a.value.longest(names, least)[1] for i in range(s, e + 1)}
                if gone:
                    keep, at = [], 0
                    for i in sorted(gone):
                        if i - 1 not in gone:
                            keep.append(text[at : words[i][1]])
                        at = words[i][2]
                    drop = len(gone) > most_share * len(words)
                    rows.append((d, None if drop else "".join(keep) + text[at:], len(gone), drop))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "removed_words", "dropped"])

    return documents.filter("text is not null and doc_id is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, text string, removed_words int, dropped boolean")
