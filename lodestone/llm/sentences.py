"""Sentence boundaries across languages and scripts.

A text is cut into blocks first (headings, list items, paragraphs; fenced code gives nothing), then every block
is walked as a lattice of gaps: each terminator opens a gap, and the gap is taken or left by its neighbours.

* Spaced scripts: the lattice of terminators with closing quotes; abbreviations, ordinals, initials, versions
  and ellipses leave a gap closed, unless what follows opens a sentence.
* Spaceless scripts: the clauses on both sides of a mark are segmented over a dictionary lattice (the words of a public
  vocabulary that are written in such scripts, a word's cost by its rank). A gap outside quotations is taken unless a linking
  particle opens the clause behind it and no final particle closes the one before; behind a closing quotation or bracket
  it is taken unless a linking word goes on. In Thai a blank between two Thai letters is a gap.

Marks inside quotations, brackets and code spans open no gap for the sentence around them.

Defined results: null and empty texts, and blocks without a letter or digit, give no rows; copies with one id
give one set of rows; positions count code points.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata

#: Abbreviations that never end a sentence inside a block, since something always follows (fixed values, lower case).
_NEVER = {
    "dr", "mr", "mrs", "ms", "prof", "st", "sr", "sra", "srta", "dra", "m", "mm", "mme", "mlle", "mgr", "hr", "fr", "frau", "herr", "gen", "rev", "capt", "col", "lt", "sgt", "ing",
    "e.g", "i.e", "cf", "vs", "viz", "approx", "ca", "z", "z.b", "d.h", "d", "bzw", "inkl", "exkl", "vgl", "sog", "evtl", "ggf", "bspw", "u", "o", "p", "pp", "env", "aprox", "ej", "ex", "p.ex", "p.ej", "resp", "incl",
    "fig", "figs", "abb", "eq", "sec", "sect", "chap", "ch", "vol", "art", "tab", "ref", "refs", "no", "nos", "nr", "núm", "num", "n", "v", "ver", "vers", "abs", "kap", "pág", "pag", "s", "डॉ", "श्री", "प्रो", "क्र", "सं", "रू", "รศ", "ดร", "นพ",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
}
#: Of these, such as need a number behind them; without one they are plain words.
_BEFORE_NUMBER = {"no", "nos", "nr", "núm", "num", "n", "v", "ver", "vers", "fig", "figs", "abb", "eq", "sec", "sect", "chap", "ch", "vol", "art", "tab", "ref", "refs", "abs", "kap", "pág", "pag", "s", "p", "pp", "ca", "env", "approx", "aprox", "क्र", "सं"}
_MAY_END = {"etc", "usw", "usf", "a.m", "p.m", "a. m", "p. m", "u.s", "u.k", "e.u", "u.n", "min", "max", "sec", "hr", "hrs", "dept", "inc", "ltd", "co", "corp", "jr", "b", "h", "al", "ff", "std", "sek", "mio", "mrd", "tel", "u.a", "o.ä", "uvm", "ee.uu", "av", "est"}
_MONTHS = {"januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember", "jahrhundert", "jh", "etage", "stock", "klasse", "kapitel", "auflage"}
#: Marks (fixed values).
_HARD = "。！？!?｡．।॥؟۔።᠃"
_SOFT = "."
_ELLIPSIS = "…"
_CLOSERS = "\"”’»›)]}」』）】》〉］｝“‘'"
_PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", "［": "］", "{": "}", "»": "«", "‚": "‘’"}
#: Words that go on with what stands before them (fixed values).
_LINKING = {"と", "という", "といった", "って", "は", "が", "を", "に", "の", "で", "も", "など", "から", "まで", "へ", "や", "的", "地", "得", "之后", "以后", "之後", "以後", "时", "時", "等", "等等", "后", "後", "为", "為", "是", "都", "这", "那", "的时候", "的時候", "ที่"}
#: Particles that go on even behind a mark that stands outside a quotation, such as one that belongs to a name (fixed values).
_PARTICLES = {"と", "という", "といった", "って", "が", "を", "に", "の", "は", "も", "的"}
#: Words that close a sentence (fixed values).
_FINAL = {"吗", "嗎", "呢", "吧", "了", "啊", "呀", "哦", "嘛", "か", "ね", "よ", "な", "わ", "ぞ", "さ", "です", "ます", "ません", "でした", "ました", "ください", "た", "だ", "る", "い", "う", "ない", "ですか", "ますか", "ですね", "でしょう", "ましょう", "ครับ", "ค่ะ", "คะ", "นะ", "นะคะ"}

_FENCE = re.compile(r"^[ \t]{0,12}(?:>[ \t]*)*(?:[-*+][ \t]+)?(?:```|~~~)")
_HEADING = re.compile(r"^[ \t]{0,3}(?:>[ \t]*)*(#{1,6})(?:[ \t]+|$)")
_ITEM = re.compile(r"^[ \t]*(?:>[ \t]*)*(?:([-*+•‣◦–])|(\d{1,4})[.)、．])(?:[ \t]+(?:\[[ xX]\][ \t]+)?|$)")
_QUOTED = re.compile(r"^[ \t]*(?:>[ \t]?)+")
_MARKUP_EDGE = "*_~"


def blocks(text: str) -> list[list[tuple[int, int]]]:
    """Blocks of a text, each the spans of its lines (without markers); a heading is a block with one span and a None at its end."""
    out: list[list] = []
    now: list[tuple[int, int]] = []
    at, fenced, number, in_list = 0, False, 0, False

    def close() -> None:
        nonlocal now
        if now:
            out.append(now)
        now = []

    for line in text.split("\n"):
        start, end = at, at + len(line)
        at = end + 1
        if _FENCE.match(line):
            mark = line.lstrip(" \t>-*+")[:3]
            if not fenced:
                close()
                # a fence that opens and closes on one line
                fenced = mark if line.count(mark) < 2 else False
            elif fenced == mark:
                fenced = False
            in_list = False
            continue
        if fenced:
            continue
        if not line.strip():
            close()
            continue
        if m := _HEADING.match(line):
            close()
            tail = re.search(r"[ \t]+#+[ \t]*$", line)
            out.append([(start + m.end(), start + (tail.start() if tail and tail.start() >= m.end() else len(line))), None])
            in_list = False
            continue
        m = _ITEM.match(line)
        if m and (m.group(1) or not now or int(m.group(2)) == 1 or in_list and int(m.group(2)) == number + 1):
            close()
            number, in_list = int(m.group(2) or 0), True
            now = [(start + m.end(), end)]
            continue
        if not now:
            in_list = False
        q = _QUOTED.match(line)
        now.append((start + (q.end() if q else 0), end))
    close()
    return out


def _is_thai(c: str) -> bool:
    return "฀" <= c <= "๿"


def _spaceless(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "一" <= c <= "鿿" or "㐀" <= c <= "䶿" or "ｦ" <= c <= "ﾟ"


def _protected(s: str) -> list[bool]:
    """Places inside quotations, brackets and code spans (their closing signs excluded)."""
    inside = [False] * len(s)

    def cover(a: int, b: int) -> None:
        for k in range(a + 1, b):
            inside[k] = True

    for m in re.finditer(r"(`+)(?!`)(?:(?!\1).)+?\1", s, re.S):
        for k in range(m.start(), m.end()):
            inside[k] = True
    code = list(inside)
    for m in re.finditer(r"\bhttps?://[^\s<>\"'）】」]+", s):
        end = m.end()
        while end > m.start() and s[end - 1] in ".,;:!?)":
            end -= 1
        for k in range(m.start(), end):
            inside[k] = code[k] = True
    open_at: list[tuple[str, int]] = []
    straight = None
    for i, c in enumerate(s):
        if code[i]:
            continue
        if c == '"':
            opens = (i == 0 or s[i - 1].isspace() or s[i - 1] in "([{") and i + 1 < len(s) and s[i + 1].isalnum()
            if straight is None and (i == 0 or not s[i - 1].isalnum()) and i + 1 < len(s) and not s[i + 1].isspace():
                straight = i
            elif straight is not None and opens:
                straight = i  # the one before never closed
            elif straight is not None:
                cover(straight, i)
                straight = None
            continue
        for k in range(len(open_at) - 1, -1, -1):
            if c in _PAIRS[open_at[k][0]]:
                cover(open_at[k][1], i)
                del open_at[k:]
                break
        else:
            if c in _PAIRS:
                open_at.append((c, i))
    return inside


class Lattice:
    """Viterbi segmentation of spaceless text: a word of rank r costs log(r + 10), a character that no word holds ``unknown``."""

    def __init__(self, words: list[str], unknown: float = 14.0) -> None:
        self.cost: dict[str, float] = {}
        for rank, w in enumerate(words):
            self.cost.setdefault(w, math.log(rank + 10))
        self.longest = max(map(len, self.cost), default=1)
        self.unknown = unknown

    def words(self, clause: str) -> list[str]:
        n = len(clause)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        get = self.cost.get
        for i in range(n):
            here = best[i]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                c = get(clause[i:j])
                if c is None:
                    if j > i + 1:
                        continue
                    c = self.unknown
                if here + c < best[j]:
                    best[j], back[j] = here + c, i
        out, j = [], n
        while j:
            out.append(clause[back[j] : j])
            j = back[j]
        return out[::-1]


@functools.lru_cache(1)
def lattice() -> Lattice:
    """The words of a public vocabulary for many languages that are written without spaces, and the listed particles."""
    from .tokenizers import byte_pieces

    return Lattice([*sorted(_LINKING | _FINAL), *(w for w in byte_pieces() if all(map(_spaceless, w)))])


@functools.lru_cache(1 << 16)
def _ends(clause: str) -> tuple[str, str]:
    """The first and the last word of a clause."""
    w = lattice().words(clause)
    return w[0], w[-1]


def _word_after(s: str, i: int) -> str | None:
    """The first word of the clause that begins at i; None where no spaceless script begins."""
    j = i
    while j < len(s) and _spaceless(s[j]):
        j += 1
    return _ends(s[i:j])[0] if j > i else None


def _word_before(s: str, i: int) -> str | None:
    """The last word of the clause that ends before i."""
    j = i
    while j > 0 and _spaceless(s[j - 1]):
        j -= 1
    return _ends(s[j:i])[1] if j < i else None


def _quote_goes_on(s: str, after: int) -> bool:
    """Whether what stands behind a closed quotation belongs to the sentence around it."""
    return s[after] in "，、,；;：:" or _word_after(s, after) in _LINKING


def _name_goes_on(s: str, mark: int, after: int) -> bool:
    """Whether a mark outside quotations belongs to a name: a particle follows at once and no final word stands before."""
    return _word_after(s, after) in _PARTICLES and _word_before(s, mark) not in _FINAL


def _opens(s: str, i: int) -> bool:
    """Whether what stands at i can open a sentence of a spaced script: no small letter, no linking sign."""
    while i < len(s) and s[i] in "\"“„«‹([{¿¡'’‘`*_~»":
        if s[i] in "¿¡":
            return True
        i += 1
    return i < len(s) and not s[i].islower() and s[i] not in ",;:)]}-–—/&%=+"


def _last_token(s: str, i: int) -> str:
    """The run of letters, digits and inner marks that ends right before i."""
    a = i
    while a > 0 and not s[a - 1].isspace() and s[a - 1] not in "([{\"“„«‚'’‘`*—–/":
        a -= 1
    return s[a:i]


def _dot_ends(s: str, dot: int, after: int, lower_style: bool) -> bool:
    """Whether the full stop at ``dot``, with what stands from ``after`` on (first non-blank), ends a sentence."""
    token = _last_token(s, dot)
    word = token.lower()
    nxt = s[after]
    spaced = after > dot + 1
    opens = _opens(s, after)
    if not token:
        return opens
    number_next = nxt.isdigit() or unicodedata.category(nxt) == "Nd"
    in_path = s[dot - len(token) - 1 : dot - len(token)] == "/"
    if not in_path and (word in _NEVER or "." in word and word.replace(".", "").isalpha() and all(len(x) == 1 for x in word.split(".")) and word not in _MAY_END):
        if word in _BEFORE_NUMBER and word not in {"p", "s", "ca", "env", "approx", "aprox"}:
            # "no" is also a word: only a number behind it makes it an abbreviation
            return not number_next and opens
        return False
    if len(token) == 1 and token.isalpha():
        # initials and the second half of "z. B."
        before = s[:dot - 1].rstrip()
        if before.endswith("."):
            return word in {"b", "h", "m"} and opens and word != "b" and word != "h"
        return opens and not token.isupper()
    if word in _MAY_END:
        return opens and not number_next
    if token[-1].isdigit():
        follower = re.match(r"[\"“„«]?([^\W\d_]+)", s[after:])
        if follower and follower.group(1).lower() in _MONTHS:
            return False
        if not spaced:
            return nxt.isalpha() and nxt.isupper() and "." not in token[-3:]
        if not opens and not lower_style and re.search(r"\b(?:am|vom|zum|der|den|dem|im|ab|bis|des)\s*$", s[: dot - len(token)]):
            return False
        return True
    if not spaced:
        # a blank was left out: a word, a stop, a capitalised word
        return nxt.isupper() and after + 1 < len(s) and (s[after + 1].islower() or s[after + 1].isspace()) and (token[-1].islower() or token[-1] in ")]")
    return True


def cut_block(s: str) -> list[tuple[int, int]]:
    """Spans of the sentences of one block of running text."""
    n = len(s)
    inside = _protected(s)
    gaps: list[int] = []
    lower_style = bool(re.match(r"\s*[a-zà-ÿ]", s))
    i = 0
    while i < n:
        c = s[i]
        if c.isspace() and 0 < i:
            j = i
            while j < n and s[j].isspace():
                j += 1
            if j < n and _is_thai(s[i - 1]) and _is_thai(s[j]) and not inside[i]:
                gaps.append(i)
            i = j
            continue
        if c not in _HARD and c != _SOFT and c != _ELLIPSIS:
            i += 1
            continue
        j = i
        while j < n and (s[j] in _HARD or s[j] in "._…" and s[j] != "_"):
            j += 1
        run = s[i:j]
        # a run inside a quotation or bracket may still end right before its closing sign
        quoted = inside[i]
        k = j
        while k < n and s[k] in _CLOSERS and not (s[k] in "“‘" and (k + 1 < n and s[k + 1].isalnum())) and not (s[k] == '"' and not quoted and k + 1 < n and s[k + 1].isalnum()):
            k += 1
        # French sets a blank before the closing guillemet
        m = re.match(r"[   ]»", s[j : j + 2])
        if k == j and m and quoted:
            k = j + 2
        closed = k > j
        if quoted and (not closed or k < n and inside[k - 1]):
            i = j
            continue
        after = k
        while after < n and s[after].isspace():
            after += 1
        if after >= n:
            break
        ideographic = run[-1] in "。！？｡．" or (run[-1] in "…" and _spaceless(s[i - 1] if i else " "))
        if quoted:
            # the quotation ends with its own mark: the sentence around it goes on unless a new one is opened
            if ideographic or _spaceless(s[after]):
                take = s[k - 1] not in ")）]】" and not _quote_goes_on(s, after)
            else:
                take = k < n and s[k].isspace() and _opens(s, after) and s[k - 1] not in ")]}"
        elif ideographic:
            take = after > k or not _name_goes_on(s, i, after)
        elif run[-1] == _ELLIPSIS or run.endswith(".."):
            take = (k < n and s[k].isspace() or _spaceless(s[after])) and _opens(s, after)
        elif run == ".":
            if k < n and k == after and not (s[k].isalpha() and s[k].isupper()) and not (_spaceless(s[k]) and _spaceless(s[i - 1] if i else " ")):
                take = False
            elif closed and s[k - 1] in ")]":
                take = _dot_ends(s, i, after, lower_style) if s[i - 1] not in ")]" else True
            else:
                take = _dot_ends(s, i, after, lower_style)
        elif run[-1] in "।॥؟۔።᠃":
            take = True
        else:  # ! and ?
            take = k < n and s[k].isspace() and s[after] not in ",;:)" or k == after and (s[after].isupper() or _spaceless(s[after]) or s[after] in "¿¡«„“`")
        if take:
            gaps.append(k)
        i = k
    spans, a = [], 0
    for g in [*gaps, n]:
        x, y = a, g
        while x < y and s[x].isspace():
            x += 1
        while y > x and s[y - 1].isspace():
            y -= 1
        if y > x:
            if any(ch.isalnum() for ch in s[x:y]):
                spans.append((x, y))
            elif spans and not any(ch.isalnum() for ch in s[x:y]):
                spans[-1] = (spans[-1][0], y)
        a = g
    return spans


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans (from, to) of the sentences of a text, in code points."""
    out: list[tuple[int, int]] = []
    for b in blocks(text):
        if b[-1] is None:
            (x, y) = b[0]
            while x < y and text[x].isspace():
                x += 1
            while y > x and text[y - 1].isspace():
                y -= 1
            if any(ch.isalnum() for ch in text[x:y]):
                out.append((x, y))
            continue
        # the lines of a block are one stretch; what lies between them (line feeds, quote marks) is white
        a, z = b[0][0], b[-1][1]
        if all(n[0] == m[1] + 1 for m, n in zip(b, b[1:])):
            stretch = text[a:z]
        else:
            chars = [" "] * (z - a)
            for x, y in b:
                chars[x - a : y - a] = text[x:y]
            stretch = "".join(chars)
        out += [(a + x, a + y) for x, y in cut_block(stretch)]
    return out


def sentence_rows(documents):
    """documents(doc_id, text) -> doc_id, start_pos, end_pos."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ids, starts, ends = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x, y in sentences(text) if text else ():
                    ids.append(doc_id)
                    starts.append(x)
                    ends.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "start_pos", "end_pos"])

    return documents.select("doc_id", "text").where("text is not null").mapInArrow(run, "doc_id bigint, start_pos int, end_pos int")
