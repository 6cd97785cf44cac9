"""Held-out test texts inside training texts, by suffix arrays of the training side.

Both sides are brought to plain words: compatibility forms, look-alike letters, invisible characters, markup,
case and punctuation are folded away. Every shard of training texts becomes one suffix array over word numbers
(only words of the tests have numbers, every other word ends a match); every test suffix is looked up in it by
binary search, which gives its verbatim matches of three words and more with their places; every match is then followed to
its full length, so the longest verbatim match of an item in a text is known with its place (:func:`leak_locations`). Matches near one
diagonal of (text, test item) are added up, and what may hold two successive sentences is aligned word by word.

The filter before the alignment loses nothing: of n words with at most n/5 edits, at most n/5 + 1 runs stay
untouched, so runs of three words and more hold at least 0.4 n - 2 words.

Defined results: null and empty texts carry nothing; a first sentence that two items share is an instruction and
doesn't count; an item with fewer than two sentences of its own can't leak; copies of a text are cases of their
own; the tests are looked up in blocks of items, so their number is not limited.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts that look like Latin ones (fixed values).
_LOOK_ALIKE = str.maketrans(
    "аеорсухіјѕһԁԛԝьвнкмтгѡӏүαεορυνικτχγωβηζμρσ" "АВЕЗКМНОРСТУХІЈЅԌԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ıɑɡɩʏոսցհօքԍʋꞓɴʀꮃ",
    "aeopcyxijshdqwbbhkmtrwlyaeopuviktxywbhzupo" "ABE3KMHOPCTYXIJSGQWABEZHIKMNOPTYX" "iagiynugnoqgvcnrw",
)
_INVISIBLE = re.compile(r"[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿￹-￻\U000e0000-\U000e0fff]|[̀-ͯ]")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>|<!--.*?-->", re.S)
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
_HYPHENED = re.compile(r"(?<=[a-z])[-‐‑]\s*\n\s*(?=[a-z])")
_QUOTE_MARK = re.compile(r"^[ \t]*(?:>[ \t]?)+|^[ \t]*(?:[-*+]|\d+[.)])[ \t]+", re.M)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_SENTENCE_END = re.compile(r"(?<=[.!?])[\"'”’)]*\s+(?=\S)")
LEAST_RUN = 3
MOST_IN_ONE = 0.34  #: edits in one of the two sentences, as a share of its words
_BITS = 20  # bits of a word number in a key of three words


def plain_words(text: str) -> list[str]:
    """The words of a text as the search sees them."""
    t = html.unescape(text)
    t = unicodedata.normalize("NFKC", t).translate(_LOOK_ALIKE)
    t = _INVISIBLE.sub("", unicodedata.normalize("NFD", t))
    t = _LINK.sub(r"\1", _TAG.sub("", t)).lower()
    t = _QUOTE_MARK.sub("", _HYPHENED.sub("", t))
    return [w.replace("'", "").replace("’", "") for w in _WORD.findall(re.sub(r"[*`~]|(?<!\w)_|_(?!\w)", "", t).replace("_", " "))]


class TestSet:
    """Own sentences of test items as word numbers."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str]], instructions: set[tuple[str, ...]] | None = None) -> None:
        split = {i: [tuple(plain_words(s)) for s in _SENTENCE_END.split(t)] for i, t in items if t}
        shared = instructions if instructions is not None else instruction_sentences(items)
        self.ids: dict[str, int] = {}
        self.pairs: list[tuple[int, np.ndarray, int]] = []  # item, words of two successive sentences, length of the first
        for i, sentences in split.items():
            own = [s for k, s in enumerate(sentences) if s and not (k == 0 and s in shared)]
            for a, b in zip(own, own[1:]):
                self.pairs.append((i, np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in a + b], dtype=np.int64), len(a)))
        if len(self.ids) >= 1 << _BITS:
            raise ValueError("too many words in a block of tests")
        # every suffix of every pair, cut to three words, as one sorted list of keys
        keys, where = [], []
        for p, (_, words, _) in enumerate(self.pairs):
            k = _keys(words)
            keys.append(k)
            where += [(p, q) for q in range(len(k))]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        self.where = np.array(where, dtype=np.int64).reshape(-1, 2)
        self.need = np.array([max(LEAST_RUN, int(np.ceil(0.4 * len(w) - 2))) for _, w, _ in self.pairs], dtype=np.int64)
        self.len = np.array([len(w) for _, w, _ in self.pairs], dtype=np.int64)
        self.item = np.array([i for i, _, _ in self.pairs], dtype=np.int64)
        # the words of all pairs in one row; -1 ends a pair
        self.begin = np.cumsum([0, *(len(w) + 1 for _, w, _ in self.pairs)])
        self.row = np.concatenate([x for _, w, _ in self.pairs for x in (w, [-1])]) if self.pairs else np.zeros(0, dtype=np.int64)


def instruction_sentences(items: list[tuple[int, str]]) -> set[tuple[str, ...]]:
    """First sentences that at least two items have."""
    first = Counter(tuple(plain_words(_SENTENCE_END.split(t)[0])) for _, t in items if t)
    return {s for s, n in first.items() if n > 1}


def _keys(words: np.ndarray) -> np.ndarray:
    """Three successive word numbers in one integer; 0 where one of them is no test word."""
    if len(words) < 3:
        return np.zeros(0, dtype=np.int64)
    a, b, c = words[:-2], words[1:-1], words[2:]
    k = (a << (2 * _BITS)) | (b << _BITS) | c
    k[(a == 0) | (b == 0) | (c == 0)] = 0
    return k


def _align(doc: np.ndarray, test: np.ndarray) -> int:
    """Fewest word edits that turn some stretch of the text into the test."""
    n = len(doc)
    row = np.zeros(n + 1, dtype=np.int64)  # a match may begin anywhere
    at = np.arange(n + 1)
    for w in test:
        new = np.empty(n + 1, dtype=np.int64)
        new[0] = row[0] + 1
        np.minimum(row[:-1] + (doc != w), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - at) + at  # words put in
    return int(row.min())


class Shard:
    """The suffix array of some texts; :meth:`search` yields (number of the text, item)."""

    def __init__(self, tests: TestSet, texts: list[str]) -> None:
        self.tests = tests
        get = tests.ids.get
        rows = [np.fromiter((get(w, 0) for w in plain_words(t)), dtype=np.int64) for t in texts]
        gap = np.zeros(1, dtype=np.int64)
        self.starts = np.cumsum([0, *(len(r) + 1 for r in rows)])
        self.words = np.concatenate([x for r in rows for x in (r, gap)]) if rows else np.zeros(0, dtype=np.int64)
        keys = _keys(self.words)
        live = np.nonzero(keys)[0]
        # only suffixes that begin with three words of some test can match: the rest is left out before sorting
        self.at = live[np.isin(keys[live], tests.keys)] if len(live) else live
        self.keys = keys[self.at]

    def _ranges(self, most_hits: int) -> Iterator[tuple[int, int]]:
        """Stretches of suffixes with a bounded number of matches; they overlap by more than any test is long."""
        known, often = np.unique(self.tests.keys, return_counts=True)
        total = np.cumsum(often[np.searchsorted(known, self.keys)])
        overlap = 2 * int(self.tests.len.max()) + 64
        i = 0
        while i < len(self.at):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most_hits, "right")))
            yield i, j
            if j >= len(self.at):
                return
            i = max(i + 1, min(j, int(np.searchsorted(self.at, self.at[j] - overlap))))

    def _follow(self, p: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The full length of matches that begin at word q of pair p and at word ``at`` of the texts."""
        there = self.tests.begin[p] + q
        length = np.full(len(at), LEAST_RUN, dtype=np.int64)
        live = np.arange(len(at))
        while len(live):
            a, b = at[live] + length[live], there[live] + length[live]
            same = (a < len(self.words)) & (self.words[np.minimum(a, len(self.words) - 1)] == self.tests.row[b])
            live = live[same]
            length[live] += 1
        return length

    def locations(self, most_edits: float = 0.2, most_hits: int = 4_000_000) -> Iterator[tuple[int, int, int, int]]:
        """(number of the text, item, first word, words): the longest verbatim match of each leaked item, the first of equal ones."""
        best: dict[tuple[int, int], tuple[int, int]] = {}

        def note(p: np.ndarray, q: np.ndarray, at: np.ndarray) -> None:
            d, item, n = np.searchsorted(self.starts, at, "right") - 1, self.tests.item[p], self._follow(p, q, at)
            order = np.lexsort((at, -n, item, d))
            d, item, n, at = d[order], item[order], n[order], at[order]
            first = np.concatenate([[True], (d[1:] != d[:-1]) | (item[1:] != item[:-1])])
            for x in np.nonzero(first)[0]:
                key, one = (int(d[x]), int(item[x])), (-int(n[x]), int(at[x] - self.starts[d[x]]))
                best[key] = min(best.get(key, one), one)

        for key in list(self.search(most_edits, most_hits, note)):
            n, at = best[key]
            yield (*key, at, -n)

    def search(self, most_edits: float = 0.2, most_hits: int = 4_000_000, note=None) -> Iterator[tuple[int, int]]:
        t = self.tests
        found: set[tuple[int, int]] = set()
        if not len(self.at) or not len(t.keys):
            return
        for i, j in self._ranges(most_hits):
            order = np.argsort(self.keys[i:j], kind="stable")
            suffixes, ordered = self.at[i:j][order], self.keys[i:j][order]
            lo, hi = np.searchsorted(ordered, t.keys, "left"), np.searchsorted(ordered, t.keys, "right")
            m = hi - lo
            if not m.sum():
                continue
            which = np.repeat(np.arange(len(m)), m)
            at = suffixes[np.repeat(lo, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            if note is not None:
                note(t.where[which, 0], t.where[which, 1], at)
            yield from self._verify(t.where[which, 0], t.where[which, 1], at, most_edits, found)

    def _verify(self, p: np.ndarray, q: np.ndarray, at: np.ndarray, most_edits: float, found: set[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Matches (pair, word in it, word of the texts) -> leaks."""
        t = self.tests
        d, diag = np.searchsorted(self.starts, at, "right") - 1, (at - q + 1024) // 12
        p, d, diag, at = np.unique(np.stack([p, d, diag, at]), axis=1)  # in this order
        # words covered by the matches on a diagonal band: each match adds the words that the one before didn't cover
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1]) | (diag[1:] != diag[:-1])])
        add = np.where(new, LEAST_RUN, np.minimum(LEAST_RUN, np.diff(at, prepend=at[0])))
        first = np.nonzero(new)[0]
        covered = np.add.reduceat(add, first)
        bp, bd, bdiag = p[first], d[first], diag[first]
        # a match may drift over band borders by the words put in or left out: add the neighbouring bands
        total = covered.copy()
        same = (bp[1:] == bp[:-1]) & (bd[1:] == bd[:-1]) & (bdiag[1:] - bdiag[:-1] == 1)
        total[1:] += np.where(same, covered[:-1], 0)
        total[:-1] += np.where(same, covered[1:], 0)
        for i in np.nonzero(total >= t.need[bp])[0]:
            item, words, cut = t.pairs[bp[i]]
            key = (int(bd[i]), item)
            if key in found:
                continue
            begin = int(bdiag[i]) * 12 - 1024
            a, b = max(self.starts[bd[i]], begin - 24), min(self.starts[bd[i] + 1] - 1, begin + len(words) + 36)
            doc = self.words[a:b]
            # both sentences must be there: a quotation of one beside a text that only resembles the other is none
            if _align(doc, words) <= most_edits * len(words) and all(_align(doc, x) <= MOST_IN_ONE * len(x) for x in (words[:cut], words[cut:])):
                found.add(key)
                yield key


def find_leaks(documents: DataFrame, items: DataFrame, most_edits: float = 0.2, block: int = 5000, shard_chars: int = 4_000_000) -> DataFrame:
    """documents(doc_id, text) x items(item_id, text) -> distinct (doc_id, item_id)."""
    return leak_locations(documents, items, most_edits, block, shard_chars, places=False).select("doc_id", "item_id").distinct()


def leak_locations(documents: DataFrame, items: DataFrame, most_edits: float = 0.2, block: int = 5000, shard_chars: int = 4_000_000, places: bool = True) -> DataFrame:
    """(doc_id, item_id, first_word, words): where the longest verbatim match of each leaked item lies, in words of the plain text.

    Repeated documents give their rows once per copy of the row; callers that want them once drop duplicates.
    """
    tests = [(r[0], r[1]) for r in items.select("item_id", "text").dropDuplicates(["item_id"]).orderBy("item_id").collect()] if _bounded(items) else None
    if tests is None:
        raise ValueError("the test side is larger than a test set can be")
    shared = instruction_sentences(tests)
    sc = documents.sparkSession.sparkContext
    out = None
    for i in range(0, max(1, len(tests)), block):
        given = sc.broadcast((tests[i : i + block], shared))

        def run(batches: Iterator[pd.DataFrame], given=given) -> Iterator[pd.DataFrame]:
            t = TestSet(*given.value)

            def flush(ids: list, texts: list) -> pd.DataFrame:
                hits: list = []
                if t.pairs:
                    shard = Shard(t, texts)
                    hits = sorted(shard.locations(most_edits)) if places else sorted({(*x, 0, 0) for x in shard.search(most_edits)})
                return pd.DataFrame({"doc_id": [ids[h[0]] for h in hits], "item_id": [h[1] for h in hits], "first_word": [h[2] for h in hits], "words": [h[3] for h in hits]}, dtype="int64")

            ids, texts, chars = [], [], 0
            for b in batches:
                for doc_id, text in zip(b["doc_id"], b["text"]):
                    ids.append(doc_id)
                    texts.append(text)
                    chars += len(text)
                    if chars >= shard_chars:
                        yield flush(ids, texts)
                        ids, texts, chars = [], [], 0
            if texts:
                yield flush(ids, texts)

        part = documents.select("doc_id", "text").where("text is not null and text <> ''").mapInPandas(run, "doc_id bigint, item_id bigint, first_word bigint, words bigint")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents that carry no test item."""
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")


#: A test set has at most so many items; they are collected, cut into blocks and sent to the executors.
MOST_ITEMS = 1_000_000


#: ... and so many characters.
MOST_CHARS = 1_000_000_000


def _bounded(items: DataFrame) -> bool:
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    return n <= MOST_ITEMS and chars <= MOST_CHARS


def leaked_per_item(leaks: DataFrame) -> DataFrame:
    return leaks.groupBy("item_id").agg(F.count("*").alias("documents"))
