"""Token budgets: how many tokens texts hold under an existing vocabulary, in total per slice.

The pieces of a public vocabulary are put into a double-array trie; each normalized segment (a word with the
blanks before it) gets the number of pieces on its best Viterbi path. Only the count is kept. A piece of
rank r costs log(r + ``_SHIFT``), which makes the paths those of a unigram model with Zipf weights; against
the vocabulary's own tokenizer the totals are an estimate, and the README has its measured error.

Defined results: null and empty texts hold no tokens; characters outside the vocabulary count one token
per UTF-8 byte (byte fallback); repeated rows and overlapping lines of a file count once.
"""

from __future__ import annotations

import math
import re

from .tokenizers import sentencepiece_pieces

_SHIFT = 300.0
_SPACE = "▁"
_SEGMENT = re.compile(r"▁+[^▁\n]*|[^▁\n]+|\n")
_CACHE = 200_000


class DoubleArray:
    """Double-array trie over characters; each end of a piece holds its number."""

    def __init__(self, pieces: list[tuple[str, int]]) -> None:
        seen: dict[str, int] = {}
        for p, _ in pieces:
            for c in p:
                seen[c] = seen.get(c, 0) + 1
        # frequent characters get small codes, which keeps the children of a node close together
        self.codes = {c: i + 1 for i, c in enumerate(sorted(seen, key=lambda c: (-seen[c], c)))}
        tree: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for p, number in pieces:
            at = 0
            for c in p:
                code = self.codes[c]
                nxt = tree[at].get(code)
                if nxt is None:
                    nxt = tree[at][code] = len(tree)
                    tree.append({})
                    ends.append(-1)
                at = nxt
            ends[at] = number
        size = 2 * len(tree) + max(self.codes.values(), default=0) + 2
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        free = tail = max(self.codes.values(), default=0) + 1  # so that every base is positive; nodes with one child fill the holes, wider ones go on where the last of them found room
        queue = [(0, 0)]
        for node, slot in queue:  # grows while it is walked
            self.value[slot] = ends[node]
            kids = tree[node]
            if not kids:
                continue
            codes = list(kids)
            first, last = min(codes), max(codes)
            while free < len(self.check) and self.check[free] >= 0:
                free += 1
            b = (free if len(codes) == 1 else max(free, tail)) - first
            while True:
                if b + last >= len(self.check):
                    more = b + last + 1 - len(self.check) + 1024
                    self.base += [0] * more
                    self.check += [-1] * more
                    self.value += [-1] * more
                if all(self.check[b + c] < 0 for c in codes):
                    break
                b += 1
            if len(codes) > 1:
                tail = max(tail, b + first)
            self.base[slot] = b
            for c in codes:
                self.check[b + c] = slot
                queue.append((kids[c], b + c))


class Counter:
    """Counts the pieces of texts under a unigram vocabulary."""

    def __init__(self, pieces: list[str]) -> None:
        usable = [(p, i) for i, p in enumerate(pieces) if p and not re.fullmatch(r"<[^<>]*>", p)]
        self.trie = DoubleArray(usable)
        self.cost = [math.log(i + _SHIFT) for i in range(len(pieces))]
        self.cache: dict[str, int] = {}

    def segment(self, s: str) -> int:
        got = self.cache.get(s)
        if got is None:
            got = self._viterbi(s)
            if len(self.cache) >= _CACHE:
                self.cache.clear()
            if len(s) <= 64:
                self.cache[s] = got
        return got

    def _viterbi(self, s: str) -> int:
        base, check, value, cost = self.trie.base, self.trie.check, self.trie.value, self.cost
        codes = [self.trie.codes.get(c, 0) for c in s]
        n = len(s)
        inf = math.inf
        best, count = [inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        size = len(check)
        for i in range(n):
            b = best[i]
            slot, k = 0, i
            hit = False
            while k < n:
                code = codes[k]
                if not code:
                    break
                nxt = base[slot] + code
                if nxt >= size or check[nxt] != slot:
                    break
                slot = nxt
                k += 1
                v = value[slot]
                if v >= 0:
                    hit = hit or k == i + 1
                    x = b + cost[v]
                    if x < best[k]:
                        best[k], count[k] = x, count[i] + 1
            if not hit and b + 30.0 < best[i + 1]:
                best[i + 1], count[i + 1] = b + 30.0, count[i] + len(s[i].encode("utf-8", "surrogatepass"))
        return count[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        s = _SPACE + text.replace(" ", _SPACE)
        return sum(map(self.segment, _SEGMENT.findall(s)))


def load_counter(path: str | None = None) -> Counter:
    return Counter([p for p, _ in sentencepiece_pieces(path)])


def file_domain(file: str) -> str:
    """What a file is for, by its path: tests, documentation, configuration, scripts, data or source."""
    parts = file.replace("\\", "/").lower().split("/")
    dirs, name = set(parts[:-1]), parts[-1]
    ext = name.rsplit(".", 1)[-1] if "." in name else ""
    if dirs & {"test", "tests", "__tests__", "spec", "specs"} or name.startswith("test_") or re.search(r"[._-](?:test|spec)\.\w+$", name):
        return "tests"
    if ext in {"md", "rst", "txt", "adoc"} or dirs & {"doc", "docs"}:
        return "documentation"
    if ext in {"yaml", "yml", "toml", "ini", "cfg", "conf", "json", "xml", "properties"}:
        return "configuration"
    if ext in {"sh", "bash", "ps1", "bat"} or dirs & {"scripts", "tools"}:
        return "scripts"
    return "source"
