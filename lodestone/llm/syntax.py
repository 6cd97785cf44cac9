"""Source files that don't parse: whole token streams against bundled grammars.

Every language has a lexer and a grammar as text (:mod:`.grammars`); the grammar becomes a table-driven predictive
parser once per process. A file is valid if its whole token stream is taken; else the line of the first token
that no alternative gets past is reported. Files of any depth are parsed in full.

Defined results: an empty file is valid but for JSON, whose grammar needs a value; extensions without a grammar are
never reported; bytes that lines can't hold don't occur, since the text comes decoded.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from .grammars import lexers, rules
from .grammars.engine import LexError, Parser, Tokens

_LANGUAGES: dict[str, tuple[Callable[[str], Tokens], str]] = {
    "py": (lexers.lex_python, rules.PYTHON),
    "js": (lexers.lex_js, rules.JAVASCRIPT),
    "ts": (lexers.lex_js, rules.TYPESCRIPT),
    "go": (lexers.lex_go, rules.GO),
    "java": (lexers.JAVA.run, rules.JAVA),
    "rs": (lexers.lex_rust, rules.RUST),
    "c": (lexers.C.run, rules.C),
    "json": (lexers.JSON.run, rules.JSON),
    "yaml": (lexers.lex_yaml, rules.YAML),
    "toml": (lexers.lex_toml, rules.TOML),
}


@functools.lru_cache(None)
def _parser(ext: str) -> Parser:
    return Parser(_LANGUAGES[ext][1], "file")


def extension(file: str) -> str | None:
    """The extension, if it has a grammar."""
    name = file.replace("\\", "/").rsplit("/", 1)[-1]
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return ext if ext in _LANGUAGES else None


def grammar_error(ext: str, text: str) -> int | None:
    """The offset of the first error."""
    try:
        tokens = _LANGUAGES[ext][0](text)
    except LexError as e:
        return e.place
    return _parser(ext).parse(tokens)


def first_error(file: str, text: str) -> tuple[int, str] | None:
    """(line, what stands there) of the first error of a file, or None."""
    ext = extension(file)
    if ext is None:
        return None
    at = grammar_error(ext, text)
    if at is None:
        return None
    line = text.count("\n", 0, at) + 1
    return line, text[at : at + 24].split("\n", 1)[0]
