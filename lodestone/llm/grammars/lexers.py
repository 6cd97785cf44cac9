"""Lexers: text to tokens. What no token begins with is a :class:`LexError`."""

from __future__ import annotations

import re

from .engine import LexError, Tokens

_PUNCT = r"\.\.\.|=>|->|::|:=|<-|&\^=|&\^|<<=|\.\.=|\.\.|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%=<>!~^&|?:;,.(){}\[\]@#$\\]"


class Lexer:
    """White space and comments are skipped; ``words`` become their own kind."""

    def __init__(self, words: str, number: str, string: str, comment: str, name: str = r"[^\W\d]\w*", punct: str = _PUNCT, space: str = r"[ \t\r\f\v]+") -> None:
        self.words = frozenset(words.split())
        self.re = re.compile(f"(?P<space>{space})|(?P<nl>\n)|(?P<comment>{comment})|(?P<str>{string})|(?P<name>{name})|(?P<num>{number})|(?P<punct>{punct})", re.S)

    def run(self, text: str) -> Tokens:
        out = Tokens()
        put_k, put_t, put_b, put_p = out.kinds.append, out.texts.append, out.breaks.append, out.places.append
        words, match = self.words, self.re.match
        at, n, broke = 0, len(text), False
        while at < n:
            m = match(text, at)
            if not m:
                raise LexError(at)
            kind = m.lastgroup
            if kind == "space":
                pass
            elif kind == "nl":
                broke = True
            elif kind == "comment":
                broke = broke or "\n" in m.group()
            else:
                s = m.group()
                put_k(s if kind == "punct" or s in words else {"name": "NAME", "num": "NUM", "str": "STR"}[kind])
                put_t(s)
                put_b(broke)
                put_p(at)
                broke = False
            at = m.end()
        out.put("EOF", "", True, n)
        return out


_C_COMMENT = r"//[^\n]*|/\*.*?\*/"
_C_NUMBER = r"(?:0[xX][0-9a-fA-F_']+(?:\.[0-9a-fA-F]*)?(?:[pP][-+]?\d+)?|0[bB][01_']+|0[oO][0-7_]+|(?:\d[\d_']*)?\.\d[\d_]*(?:[eE][-+]?\d+)?|\d[\d_']*(?:\.(?![.\w])|\.(?=[eE]\d))?(?:[eE][-+]?\d+)?)[a-zA-Z]{0,4}\d{0,3}(?![\w])"
_DQ = r"\"(?:[^\"\\\n]|\\.)*\""
_SQ = r"'(?:[^'\\\n]|\\.)*'"

JAVA = Lexer(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null",
    r"(?:0[xX][0-9a-fA-F_.]+(?:[pP][-+]?\d+)?|0[bB][01_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][-+]?\d+)?|\d[\d_]*\.?(?:[eE][-+]?\d+)?)[lLfFdD]?(?!\w)", r"\"\"\"[ \t]*\n(?:[^\\]|\\.)*?\"\"\"|" + _DQ + r"|'(?:[^'\\\n]|\\[^u\n]\d{0,2}|\\u+[0-9a-fA-F]{4})'", _C_COMMENT, name=r"[^\W\d]\w*|\$[\w$]*",
)
GO_WORDS = "break default func interface select case defer go map struct chan else goto package switch const fallthrough if range type continue for import return var"
_GO = Lexer(GO_WORDS, r"(?:0[xX][0-9a-fA-F_.]+(?:[pP][-+]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][-+]?\d+)?|\d[\d_]*\.?(?:[eE][-+]?\d+)?)i?(?!\w)", r"`[^`]*`|" + _DQ + r"|'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'", _C_COMMENT)
C = Lexer(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Complex _Noreturn _Alignas _Alignof _Atomic _Static_assert _Thread_local _Generic __attribute__ __extension__ __inline __inline__ __restrict __asm__ asm",
    _C_NUMBER, r"(?:u8|[uUL])?" + _DQ + r"|[uUL]?'(?:[^'\\\n]|\\.)+'", _C_COMMENT + r"|(?:(?<=\n)|(?<![\s\S]))[ \t]*\#(?:[^\n\\]|\\.|/\*.*?\*/)*",
)
RUST = Lexer(
    "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn",
    r"(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][-+]?[\d_]+)?)(?:[iuf](?:8|16|32|64|128|size))?(?!\w)",
    r"b?r(?P<h>\#*)\".*?\"(?P=h)|b?c?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\(?:[^xu\n]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}))'|'[^\W\d]\w*(?!')", r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/)*\*/", name=r"r\#[^\W\d]\w*|[^\W\d]\w*",
)
JSON = Lexer("true false null", r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.])", r"\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\"", r"(?!)", name=r"[A-Za-z]+", punct=r"[{}\[\]:,]", space=r"[ \t\r]+")


def lex_rust(text: str) -> Tokens:
    t = RUST.run(re.sub(r"^\ufeff?(#!(?!\s*\[)[^\n]*)?", lambda m: " " * len(m.group()), text))
    for i, s in enumerate(t.texts):
        if t.kinds[i] == "STR" and s[0] == "'" and (len(s) < 3 or s[-1] != "'"):
            t.kinds[i] = "LIFETIME"
    return t


def lex_go(text: str) -> Tokens:
    """With the semicolons that line ends stand for."""
    t, out = _GO.run(text), Tokens()
    ends = {"NAME", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
    last = ""
    for k, s, b, p in zip(t.kinds, t.texts, t.breaks, t.places):
        if b and last in ends:
            out.put(";", ";", False, p)
        out.put(k, s, b, p)
        last = k
    return out


_JS_WORDS = "break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false"
_JS = Lexer(
    _JS_WORDS,
    r"(?:0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][-+]?\d+)?|\d[\d_]*n|\d[\d_]*\.?(?:[eE][-+]?\d+)?)(?![\w$])",
    r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'", r"//[^\n]*|/\*.*?\*/|<!--[^\n]*", name=r"(?:[^\W\d]|[$]|\\u[0-9a-fA-F]{4})(?:\w|[$\u200c\u200d])*|\#(?:[^\W\d]|[$])(?:\w|[$])*",
    punct=r"\.\.\.|\?\.(?!\d)|=>|===|!==|\*\*=|&&=|\|\|=|\?\?=|<<=|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\*\*|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%=<>!~^&|?:;,.(){}\[\]@]", space=r"[ \t\r\f\v\xa0\ufeff\u2028\u2029\u2000-\u200a\u3000\u1680\u202f\u205f]+",
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_VALUE_ENDS = {"NAME", "NUM", "STR", "REGEX", "TPL", "TPL2", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"}


def lex_js(text: str) -> Tokens:
    """Regular expressions where a value can begin; templates as heads, middles and tails."""
    out = Tokens()
    words, match = _JS.words, _JS.re.match
    at, n, broke, last = 0, len(text), False, ""
    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else n
    curly: list[str] = []  # what each open { belongs to

    def template(i: int, head: bool) -> tuple[int, str]:
        while i < n:
            c = text[i]
            if c == "\\":
                i += 2
            elif c == "`":
                return i + 1, "TPL" if head else "TPL2"
            elif c == "$" and text.startswith("${", i):
                curly.append("`")
                return i + 2, "TPL0" if head else "TPL1"
            else:
                i += 1
        raise LexError(at)

    while at < n:
        c = text[at]
        start = at
        if c == "`":
            at, last = template(at + 1, True)
            out.put(last, "`", broke, start)
            broke = False
            continue
        if c == "}" and curly and curly[-1] == "`":
            curly.pop()
            at, last = template(at + 1, False)
            out.put(last, "`", broke, start)
            broke = False
            continue
        if c == "/" and last not in _VALUE_ENDS and (m := _REGEX.match(text, at)):
            kind = "REGEX"
        else:
            m = match(text, at)
            if not m:
                raise LexError(at)
            kind = m.lastgroup
        at = m.end()
        if kind == "space":
            continue
        if kind == "nl":
            broke = True
            continue
        s = m.group()
        if kind == "comment":
            broke = broke or "\n" in s
            continue
        if kind == "punct":
            if s == "{":
                curly.append("{")
            elif s == "}" and curly:
                curly.pop()
            kind = s
        elif kind != "REGEX":
            kind = s if s in words else {"name": "PRIVATE" if s[0] == "#" else "NAME", "num": "NUM", "str": "STR"}[kind]
        # a word behind a dot is a plain name
        if last in (".", "?.") and kind in words:
            kind = "NAME"
        out.put(kind, s, broke, start)
        broke, last = False, kind
    if "`" in curly:
        raise LexError(n)
    out.put("EOF", "", True, n)
    return out


_PY_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
_PY_STRING = r"(?i:(?:[bru]|br|rb)?)(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
_PY = Lexer(
    _PY_WORDS,
    r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][-+]?\d(?:_?\d)*)?[jJ]?|(?:\d(?:_?\d)*)\.?(?:[eE][-+]?\d(?:_?\d)*)?[jJ]?)(?!\w)",
    _PY_STRING, r"\#[^\n]*|\\\r?\n", punct=r"\.\.\.|->|:=|\*\*=|//=|<<=|>>=|==|!=|<=|>=|\*\*|//|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%=<>~^&|:;,.(){}\[\]@]",
)
_F_START = re.compile(r"(?i:f|fr|rf)(\"\"\"|'''|\"|')")


def _f_string(text: str, at: int, m: re.Match) -> int:
    """The offset behind a formatted string; replacement fields may hold strings and brackets again."""
    quote, n = m.group(1), len(text)
    raw = "r" in text[at : m.start(1)].lower()
    i = m.end()
    while i < n:
        c = text[i]
        if c == "\\" and not raw or c == "\\" and i + 1 < n:
            i += 2
        elif text.startswith(quote, i):
            return i + len(quote)
        elif c == "\n" and len(quote) == 1:
            break
        elif text.startswith("{{", i) or text.startswith("}}", i):
            i += 2
        elif c == "{":
            depth, i = 1, i + 1
            spec = False
            filled = False
            while depth and i < n:
                c = text[i]
                if spec and text.startswith(quote, i):
                    raise LexError(at)
                if not spec and c in "\"'":
                    s = _F_START.match(text, i) or re.compile(_PY_STRING, re.S).match(text, i)
                    if not s:
                        raise LexError(at)
                    i = s.end()
                    filled = True
                    continue
                if c in "([{":
                    depth += 1
                    spec = spec and c != "{"
                elif c in ")]}":
                    depth -= 1
                    if depth == 1 and c == "}":
                        spec = True
                elif c == ":" and depth == 1:
                    spec = True
                elif c == "\n" and len(quote) == 1 and spec:
                    raise LexError(at)
                elif not c.isspace():
                    filled = True
                i += 1
            if depth or not filled:
                raise LexError(at)
        elif c == "}":
            raise LexError(i)
        else:
            i += 1
    raise LexError(at)


def lex_python(text: str) -> Tokens:
    """With NEWLINE, INDENT and DEDENT; indentation that mixes tabs and blanks inconsistently is an error."""
    out = Tokens()
    words, match = _PY.words, _PY.re.match
    text = text.replace("\r\n", "\n") if "\r" in text else text
    at, n = (1 if text.startswith("\ufeff") else 0), len(text)
    depth: list[str] = []
    indents = [(0, 0)]
    fresh = True
    while at < n:
        if fresh and not depth:
            m = re.compile(r"[ \t\f]*").match(text, at)
            lead, end = m.group(), m.end()
            if end < n and text[end] in "\n#":
                stop = text.find("\n", end)
                at = n if stop < 0 else stop + 1
                continue
            if end >= n:
                at = n
                break
            lead = lead.rsplit("\f", 1)[-1]
            col = alt = 0
            for c in lead:
                col = (col // 8 + 1) * 8 if c == "\t" else col + 1
                alt += 1
            top = indents[-1]
            if (col > top[0]) != (alt > top[1]) or (col == top[0]) != (alt == top[1]):
                raise LexError(at)
            if col > top[0]:
                indents.append((col, alt))
                out.put("INDENT", "", False, end)
            while col < indents[-1][0]:
                indents.pop()
                out.put("DEDENT", "", False, end)
            if (col, alt) != indents[-1]:
                raise LexError(end)
            at, fresh = end, False
            continue
        if (f := _F_START.match(text, at)) and not (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
            stop = _f_string(text, at, f)
            out.put("STR", "f", False, at)
            at = stop
            continue
        m = match(text, at)
        if not m:
            raise LexError(at)
        kind, s = m.lastgroup, m.group()
        if kind == "nl":
            if not depth:
                out.put("NEWLINE", "", False, at)
                fresh = True
        elif kind in ("space", "comment"):
            pass
        else:
            if kind == "punct":
                if s in "([{":
                    depth.append(s)
                elif s in ")]}":
                    if not depth or depth.pop() != {")": "(", "]": "[", "}": "{"}[s]:
                        raise LexError(at)
                kind = s
            else:
                kind = s if s in words else {"name": "NAME", "num": "NUM", "str": "STR"}[kind]
            out.put(kind, s, False, at)
        at = m.end()
    # an open bracket leaves the last line without its end, which no rule takes
    if not depth and out.kinds and out.kinds[-1] not in ("NEWLINE", "DEDENT"):
        out.put("NEWLINE", "", False, n)
    for _ in indents[1:]:
        out.put("DEDENT", "", False, n)
    out.put("EOF", "", True, n)
    return out


_TOML_SPACE = re.compile(r"[ \t]+|#[^\n\x00-\x08\x0b-\x1f\x7f]*")
_TOML_STRING = re.compile(r"\"\"\"(?:[^\\]|\\.)*?\"{3,5}|'''.*?'{3,5}|\"(?:[^\"\\\n\x00-\x08\x0b-\x1f\x7f]|\\(?:[btnfre\"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}))*\"|'[^'\n]*'", re.S)
_TOML_VALUE = re.compile(
    r"(?:true|false|[-+]?(?:inf|nan)|\d{4}-\d{2}-\d{2}(?:[Tt ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:[Zz]|[-+]\d{2}:\d{2})?)?|\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[-+]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][-+]?\d(?:_?\d)*)?)(?=[\s,\]}#]|$)"
)
_TOML_BARE = re.compile(r"[A-Za-z0-9_-]+")


def lex_toml(text: str) -> Tokens:
    out = Tokens()
    text = text.replace("\r\n", "\n")
    at, n = 0, len(text)
    value = False  # whether a value is due
    stack: list[str] = []
    while at < n:
        c = text[at]
        if m := _TOML_SPACE.match(text, at):
            at = m.end()
            continue
        if c == "\n":
            if not stack or stack[-1] == "{":
                out.put("NL", "", False, at)
                value = False
            at += 1
            continue
        multi = text[at : at + 3] in ('"""', "'''")
        if c in "\"'":
            m = _TOML_STRING.match(text, at)
            if not m:
                raise LexError(at)
            out.put("MSTR" if multi else "STR", m.group(), False, at)
            value = bool(stack) and stack[-1] == "["
            at = m.end()
            continue
        if value and (m := _TOML_VALUE.match(text, at)):
            out.put("VALUE", m.group(), False, at)
            value = bool(stack) and stack[-1] == "["
            at = m.end()
            continue
        if not value and (m := _TOML_BARE.match(text, at)):
            out.put("BARE", m.group(), False, at)
            at = m.end()
            continue
        if c not in "=.,[]{}":
            raise LexError(at)
        out.put(c, c, False, at)
        if c == "=":
            value = True
        elif c == "[" and value:
            stack.append("[")
        elif c == "{" and value:
            stack.append("{")
            value = False
        elif c in "]}" and stack:
            stack.pop()
            value = bool(stack) and stack[-1] == "["
        elif c == ",":
            value = bool(stack) and stack[-1] == "["
        at += 1
    out.put("NL", "", False, n)
    out.put("EOF", "", True, n)
    return out


_Y_PLAIN_KEY = re.compile(r"(?:\?(?=\s)|(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=\S))(?:[^:#\n]|:(?=[^\s])|(?<=\S)#)*?)[ \t]*:(?=[ \t]|$)")
_Y_QUOTED = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", re.S)
_Y_QUOTED_KEY = re.compile(r"(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\n]|'')*'|<<)[ \t]*:(?=[ \t]|$)")
_Y_PROPS = re.compile(r"(?:(?:&[^\s,\[\]{}]+|![^\s,\[\]{}]*)(?=[ \t]|$)[ \t]*)+")
_Y_ALIAS = re.compile(r"\*[^\s,\[\]{}]+")
_Y_BLOCK = re.compile(r"[|>](?:[-+]?[1-9]?|[1-9][-+])[ \t]*(?:[ \t]#.*)?$")
_Y_FLOW = re.compile(r"(?P<space>[ \t\n]+|(?<![^\s])\#[^\n]*)|(?P<q>\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*')|(?P<punct>[\[\]{},]|:(?=[\s,\[\]{}]|$)|(?<=[\"'])\:|\?(?=\s))|(?P<plain>(?:[^\s\[\]{},:#\"'&*!|>%@`?-]|[-?:](?=[^\s\[\]{},])|[&*!])(?:[^\[\]{},:#\n]|:(?=[^\s,\[\]{}])|(?<=\S)#)*)", re.S)


def lex_yaml(text: str) -> Tokens:
    """Block structure by columns: KEY, DASH, SCALAR, flow signs, INDENT and DEDENT."""
    out = Tokens()
    text = text.replace("\r\n", "\n").lstrip("\ufeff")
    n = len(text)
    cols: list[int] = [-1]
    kinds_at: list[str] = ["top"]
    at = 0

    def line_end(i: int) -> int:
        e = text.find("\n", i)
        return n if e < 0 else e

    def level(col: int, kind: str, place: int) -> None:
        while col < cols[-1] or col == cols[-1] and kinds_at[-1] == "seq" and kind == "map":
            cols.pop()
            kinds_at.pop()
            out.put("DEDENT", "", False, place)
        if col > cols[-1] or col == cols[-1] and kinds_at[-1] == "map" and kind == "seq":
            # a deeper collection may only open where a value is due
            cols.append(col)
            kinds_at.append(kind)
            out.put("INDENT", "", False, place)

    def close_all(place: int) -> None:
        while len(cols) > 1:
            cols.pop()
            kinds_at.pop()
            out.put("DEDENT", "", False, place)

    def after_value(i: int) -> int:
        e = line_end(i)
        rest = text[i:e]
        if rest.strip() and not re.match(r"[ \t]+#|[ \t]*$", rest):
            raise LexError(i)
        return e

    def continued(i: int, parent: int) -> int:
        """Further lines of a plain scalar: deeper than its parent, no key, no comment."""
        e = line_end(i)
        while e < n:
            s = e + 1
            f = line_end(s)
            line = text[s:f]
            body = line.strip()
            if not body:
                g = f
                while g < n and not text[g + 1 : line_end(g + 1)].strip():
                    g = line_end(g + 1)
                nxt = text[g + 1 : line_end(g + 1)] if g < n else ""
                if not nxt.strip() or len(nxt) - len(nxt.lstrip(" ")) <= parent:
                    return e
                e = g
                continue
            col = len(line) - len(line.lstrip(" "))
            if col <= parent or body.startswith("#") or re.match(r"(?:---|\.\.\.)(?:\s|$)", line):
                return e
            if re.search(r":(?:\s|$)", re.sub(r"\s#.*$", "", body)):
                raise LexError(s)
            e = f
            if re.search(r"\s#", body):
                return e
        return e

    def value(i: int, parent: int, inline: bool) -> int:
        """Lexes the value that begins at i on this line; gives the end of its last line."""
        m = _Y_PROPS.match(text, i)
        if m:
            i = m.end()
            if i >= line_end(i) or text[i] == "\n":
                return line_end(i)
        c = text[i]
        if c in "\"'":
            m = _Y_QUOTED.match(text, i)
            if not m:
                raise LexError(i)
            body = m.group()
            if "\n" in body and any(x.strip() and len(x) - len(x.lstrip(" ")) <= parent for x in body.split("\n")[1:]):
                raise LexError(i)
            if c == '"' and re.search(r"\\(?![0abt\tnvfre \"/\\N_LPxuU\n])", re.sub(r"\\\\", "", body)):
                raise LexError(i)
            out.put("SCALAR", "", False, i)
            return after_value(m.end())
        if c in "[{":
            depth, start = [], i
            while True:
                m = _Y_FLOW.match(text, i)
                if i >= n or not m:
                    raise LexError(start if i >= n else i)
                if m.lastgroup == "punct":
                    s = m.group()
                    out.put(s, s, False, i)
                    if s in "[{":
                        depth.append("]" if s == "[" else "}")
                    elif s in "]}":
                        if depth.pop() != s:
                            raise LexError(i)
                elif m.lastgroup == "space":
                    tail = m.group()
                    if "\n" in tail and m.end() < n and m.end() - tail.rfind("\n") - i - 1 <= parent and text[m.end()] not in "]}":
                        raise LexError(m.end())
                else:
                    out.put("FLOW", "", False, i)
                i = m.end()
                if not depth:
                    return after_value(i)
        if c in "|>":
            if not _Y_BLOCK.match(text[i : line_end(i)]):
                raise LexError(i)
            out.put("SCALAR", "", False, i)
            e = line_end(i)
            while e < n:
                f = line_end(e + 1)
                line = text[e + 1 : f]
                if line.strip() and len(line) - len(line.lstrip(" ")) <= parent:
                    break
                e = f
            return e
        if m := _Y_ALIAS.match(text, i):
            out.put("SCALAR", "", False, i)
            return after_value(m.end())
        if c in "@`%" or c in ",]}" or c in "-?:" and (i + 1 >= n or text[i + 1].isspace()):
            raise LexError(i)
        e = line_end(i)
        plain = re.sub(r"[ \t]#.*$", "", text[i:e])
        if inline and re.search(r":(?:\s|$)", plain):
            raise LexError(i)
        out.put("SCALAR", "", False, i)
        return e if len(plain) < e - i else continued(i, parent)

    while at < n:
        e = line_end(at)
        line = text[at:e]
        body = line.lstrip(" ")
        col = len(line) - len(body)
        if not body.strip() or body.lstrip("\t").startswith("#"):
            at = e + 1
            continue
        if col == 0 and re.match(r"(?:---|\.\.\.)(?:\s|$)", line):
            close_all(at)
            out.put("DOC", "", False, at)
            rest = line[3:].lstrip()
            if line.startswith("---") and rest and not rest.startswith("#"):
                at = value(at + line.index(rest, 3), -1, False) + 1
            else:
                at = e + 1
            continue
        if col == 0 and line.startswith("%"):
            at = e + 1
            continue
        if body.startswith("\t"):
            raise LexError(at)
        i, c = at + col, col
        first = True
        while True:
            rest = text[i:e]
            if re.match(r"-(?:[ \t]|$)", rest):
                level(c, "seq", i)
                out.put("DASH", "-", False, i)
                m = re.compile(r"-[ \t]*").match(text, i, e)
                c, i, first = c + m.end() - i, m.end(), False
                if i >= e or text[i] == "#":
                    at = e + 1
                    break
                continue
            p = _Y_PROPS.match(text, i, e)
            k = p.end() if p else i
            m = _Y_QUOTED_KEY.match(text, k, e) or _Y_PLAIN_KEY.match(text, k, e) or re.compile(r"\*\S+[ \t]+:(?=[ \t]|$)").match(text, k, e)
            if m:
                level(c, "map", i)
                out.put("KEY", "", False, i)
                i = m.end()
                while i < e and text[i] in " \t":
                    i += 1
                if i >= e or text[i] == "#":
                    at = e + 1
                else:
                    at = value(i, cols[-1], True) + 1
                break
            # a scalar without a key: the text of a document or of a list item, or a line that fits nowhere
            if first and c <= cols[-1]:
                while c < cols[-1]:
                    cols.pop()
                    kinds_at.pop()
                    out.put("DEDENT", "", False, i)
            at = value(i, cols[-1], False) + 1
            break
    close_all(n)
    out.put("EOF", "", True, n)
    return out
