"""Viterbi segmentation of strings over a bounded word list."""

from __future__ import annotations

import math
import re

from .tokenizers import sentencepiece_pieces

_UNKNOWN = 9.0


class WordModel:
    """Words by rank of a public vocabulary: a word of rank r costs log(r + 10); an unexplained character ``_UNKNOWN``."""

    def __init__(self, pieces: list[str], least: int = 3) -> None:
        self.cost: dict[str, float] = {}
        for rank, p in enumerate(pieces):
            w = p.replace("▁", "").lower()
            if len(w) >= least and w.isascii() and w.isalpha() and w not in self.cost:
                self.cost[w] = math.log(rank + 10)
        self.longest = max(map(len, self.cost), default=1)

    def residual(self, text: str) -> tuple[int, int]:
        """(characters that no word explains, the longest run of them); digits and letters alike, other signs part."""
        total = longest = 0
        for token in re.findall(r"[A-Za-z0-9]+", text):
            for part in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", token):
                if part.isdigit():
                    gap = [len(part)] if len(part) > 4 else []
                else:
                    gap = self._gaps(part.lower())
                total += sum(gap)
            # runs cross the case changes inside a token: what counts is how much of the token is explained
            run = self._run(token)
            longest = max(longest, run)
        return total, longest

    def _best(self, w: str) -> list[tuple[int, int, bool]]:
        n = len(w)
        best, back = [0.0] + [math.inf] * n, [(0, False)] * (n + 1)
        for i in range(n):
            if best[i] + _UNKNOWN < best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + _UNKNOWN, (i, False)
            for j in range(i + 3, min(n, i + self.longest) + 1):
                c = self.cost.get(w[i:j])
                if c is not None and best[i] + c < best[j]:
                    best[j], back[j] = best[i] + c, (i, True)
        out, j = [], n
        while j:
            i, word = back[j]
            out.append((i, j, word))
            j = i
        return out[::-1]

    def _gaps(self, w: str) -> list[int]:
        return [j - i for i, j, word in self._best(w) if not word]

    def _run(self, token: str) -> int:
        run = longest = 0
        for i, j, word in self._best(token.lower()):
            run = 0 if word and j - i >= 4 else run + (j - i)
            longest = max(longest, run)
        return longest


def word_model(path: str | None = None) -> WordModel:
    return WordModel([p for p, _ in sentencepiece_pieces(path)])
