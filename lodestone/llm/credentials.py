"""Usable credentials embedded in source and configuration files.

A literal is judged in its context: what it is assigned to or passed as (a name split into words), the place
in an address, a command or a header, or its own format. The literal is segmented into dictionary words by
Viterbi; a long unexplained residual near such a context is a secret, and so is a password-like mix of words
with digits. Known digest formats, public keys, placeholders, documented examples and references to the
environment or to a secret store are excluded.

Defined results: an empty text has no credentials; a line counts once; a private key of several lines counts
at its BEGIN line and is masked as a whole; masking keeps every length and all else.
"""

from __future__ import annotations

import base64
import bisect
import functools
import re

from .segment import WordModel, word_model

#: Words of a name that make it the name of a credential (fixed values).
_STRONG = {"password", "passwd", "pwd", "pw", "pass", "passphrase", "passcode", "secret", "token", "apikey", "credential", "credentials", "auth", "authorization", "bearer", "seed", "pin", "key", "pem", "jwt", "cookie", "creds"}
#: Words of a name that make it speak of something else (fixed values).
_OTHER = {"path", "file", "field", "label", "sha", "sha1", "sha256", "md5", "hash", "digest", "checksum", "uuid", "integrity", "commit", "public", "selector", "regex", "pattern", "prefix", "header", "hint", "example", "id", "fingerprint", "etag", "dir", "column", "placeholder", "type", "len", "count", "url"}
_PLACEHOLDER = re.compile(
    r"^[\W_]*$|^(.)\1{3,}$|<[^<>]*>|\$\{|\$\(|\{\{|%\(|^(?-i:%[sd])$|^%\w$|^\$\w+$|^\{\w*\}$|^@\w+@$|\b(?:process\.env|os\.environ|getenv|env\.|vault[:/]|secretsmanager|keyring|ssm:)|"
    r"^(?:todo|fixme|tbd|dummy|none|null|nil|true|false|test|testing|foo|bar|foobar|secret|token|password|passwd|pass|key|hidden|redacted|n/?a|empty|default|unset|string|value|your|my|admin|root|user|hunter2|letmein|example)[\W_\d]*$|"
    r"^(?:your|my|the|an?|insert|replace|change|put|enter|set|fill|add|use|not|fake|sample|demo|placeholder|example)[-_ ]?(?:me|real|with|this|here|in|your|api|secret|token|key|password|a|the)?(?:[-_ ].*)?$|x{4,}|\*{3,}|\.{3,}",
    re.I,
)
_TOKEN = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}(?![A-Za-z0-9])|gl(?:pat|rt|dt|ptt)-[\w-]{18,}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|xox[abeoprs]-[\w-]{16,}|xapp-[\w-]{20,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[\w-]{35}|ya29\.[\w-]{20,}|SG\.[\w-]{16,}\.[\w-]{16,}|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{40,}|dop_v1_[a-f0-9]{40,}|hf_[A-Za-z0-9]{30,}|sk-[\w-]{32,}"
    r"|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,})"
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<body>(?:(?!-----BEGIN)[\s\S])*?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)")
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.-]*://(?P<user>[^\s/:@\"'`<>?#]*):(?P<pw>[^\s/@\"'`<>]+)@[\w.\[-]")
_PARAM = re.compile(r"[?&;](?P<name>[\w.-]+)=(?P<value>[^\s&\"'`<>#;]+)")
_FLAG = re.compile(r"(?<![\w-])--?(?P<name>[A-Za-z][\w-]*)[= ]+(?P<q>[\"']?)(?P<value>[^\s\"'`]+)")
_USERPW = re.compile(r"(?:(?<=\s)-u|--user|--proxy-user)[= ]+[\"']?[\w.@-]+:(?P<value>[^\s\"'`]+)")
#: Prose that speaks of a credential, in a comment or a text.
_PROSE = re.compile(r"^\s*(?:#|//|/\*|\*|--|<!--|;)|^[A-Za-z]+(?: [\w'-]+){4,}[^=(){};\[\]]*$")
_PROSE_WORD = re.compile(r"(?i)\b(?:tokens?|keys?|secrets?|password|passwd|pwd|pass|passphrase|phrase|pin|credentials?|login|log-in|vault)\b")
_PIECE = re.compile(r"[^\s\"'`,;()<>{}]{8,}")
_JOINED_WORDS = re.compile(r"^[A-Za-z]+[-_.+][A-Za-z]+\d{3,}\W{0,2}$|^[A-Za-z]+(?:[-.+][A-Za-z]+){2,}[-.+]\d+$")
#: A pass phrase of plain words with a number at the end of a line of prose.
_PHRASE = re.compile(r"(?:\bis|[:/])\s+(?P<value>(?:[a-z]+ ){3,}\d{1,4})\s*(?:\*/|-->)?$")
_BARE = re.compile(r"(?:^|[\s`\"'(,;{\[])(?:export\s+|set\s+)?(?P<name>[A-Za-z_][\w.-]*)\s*=\s*(?P<value>(?:(?i:bearer|basic)\s+)?[^\s\"'`<>(){}\[\];,&]+)")
_YAML = re.compile(r"^\s*(?:-\s+)?(?P<name>[A-Za-z_][\w.-]*)\s*:\s+(?P<value>[^\s\"'`|>{\[&*#][^\n]*?)(?:\s+#.*)?$")
_LITERAL = re.compile(r"(?P<q>[\"'`])(?P<value>(?:(?!(?P=q))[^\\\n]|\\.)*)(?P=q)")
_CONCAT = re.compile(r"(?:\"[^\"\\\n]*\"|'[^'\\\n]*')(?:\s*\+\s*(?:\"[^\"\\\n]*\"|'[^'\\\n]*'))+")
#: What stands between a name and its literal, read backwards from the literal, so that a line of any length is read once: an
#: assignment, a type in between, a comparison, a colon or a comma after a quoted name.
_TO_NAME = re.compile(r"[bruf]{0,2}\s*(?:>=|=:|==|=!|=|:)\s*(?:[&\w\[\]<>|' ]+?\s*:)?\s*\]?[\"'`]?(?:\]\w*\[)?(?P<name>[\w$.-]*[A-Za-z_$])")
_TO_QUOTED = re.compile(r"\s*,\s*[\"'`](?P<name>[\w.-]*[A-Za-z_])[\"'`]")
#: A literal that something is compared with: only a long residual counts there.
_TO_COMPARE = re.compile(r"\s*==?[=!]|\s*\(slauqe\b|\s*,[^()]*\(\w*erapmoc\b")
_TO_CALL = re.compile(r"\s*,\s*[\"'`](?P<user>[^\"'`]+)[\"'`]\s*\(\s*(?P<call>\w+)")
_LOGIN = re.compile(r"login|log_?in|connect|open_?link|auth\w*|sign_?in|dial|bind", re.I)
_HINT = re.compile(r"pass|pwd|\bpw\b|_pw|pw_|Pw|PW|secret|token|key|auth|cred|bearer|seed|login|link|connect|\bpin\b|pem|jwt|://|AKIA|ASIA|AIza|eyJ|gl\w+-|gh\w_|xox|sk[-_]|basic |-u |cookie|PRIVATE|npm_|hf_|SG\.|dial|bind|phrase|vault", re.I)
_HEX = re.compile(r"^[0-9a-fA-F]+$")
_UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


@functools.lru_cache(1)
def _model() -> WordModel:
    return word_model()


def _words(name: str) -> list[str]:
    return [w.lower() for w in _NAME_WORDS.findall(name)]


def _secret_name(name: str) -> bool:
    words = _words(name)
    joined = {a + b for a, b in zip(words, words[1:])}
    named = set(words) & _STRONG or joined & {"apikey", "passphrase", "password"} or any(w.startswith("apikey") or w.endswith(("password", "passwd")) for w in words)
    return bool(named) and not _speaks_of_other(name)


def _speaks_of_other(name: str) -> bool:
    return bool(set(_words(name)) & _OTHER or re.search(r"md5|sha_?\d|crc32", name, re.I))


def _from_store(value: str) -> bool:
    return bool(_PLACEHOLDER.search(value)) or "EXAMPLE" in value.upper()


def _is_path(value: str) -> bool:
    return bool(re.match(r"^(?:~|\.{1,2})?/[\w./-]*$|^[\w-]+(?:/[\w.-]+)+\.\w{1,5}$|^(?:vault|secret|secrets|kv|ssm)/", value))


def _basic(value: str) -> bool:
    try:
        user, _, pw = base64.b64decode(value + "=" * (-len(value) % 4)).decode("utf-8").partition(":")
    except ValueError:
        return False
    return bool(user.isprintable() and pw) and not _from_store(pw)


def _unexplained(value: str) -> bool:
    """A literal of one piece, most of which no words explain."""
    return len(value) >= 20 and not re.search(r"\s", value) and _model().residual(value)[1] >= min(16, len(value) // 2)


def _dense(value: str) -> bool:
    """A piece of letters mixed with digits and signs."""
    digits, both = sum(c.isdigit() for c in value), bool(re.search(r"[a-z].*[A-Z]|[A-Z].*[a-z]", value)) and len(value) >= 10
    return len(re.findall(r"[A-Za-z]", value)) >= 3 and (digits >= 2 or digits == 1 and both) and bool(re.search(r"[!#%^&*@$~?+]", value)) and not re.search(r"[=\[\]|]|&&", value)


def usable(value: str, named: bool) -> bool:
    """Whether the literal is a credential; ``named``: its context names one."""
    v = value.strip()
    scheme = re.match(r"^(bearer|basic|token|apikey)\s+(\S+)$", v, re.I)
    if scheme:
        v, named = scheme.group(2).strip(), True
        if scheme.group(1).lower() == "basic":
            return _basic(v)
    if _from_store(v):
        return False
    if _TOKEN.search(v):
        return True
    if not named or len(v) < 6:
        return False
    if re.search(r"^data:|^sha(?:1|256|384|512)-|-----BEGIN|^ssh-(?:rsa|ed25519)|^https?://|^\w+://", v) or _is_path(v) or _UUID.match(v):
        return False
    if _HEX.match(v) and not v.isdigit():
        return len(v) >= 16
    digits, letters = sum(c.isdigit() for c in v), sum(c.isalpha() for c in v)
    blanks = v.count(" ")
    if blanks:
        # pass phrases: several plain words with a number or sign, but no sentence
        return blanks >= 3 and digits > 0 and not v.endswith((".", ":", "?")) and not re.search(r"[(){}:]", v)
    total, run = _model().residual(v)
    if digits and letters:
        return len(v) >= 8 and (digits >= 2 or run >= 5 or bool(_JOINED_WORDS.match(v)))
    if letters and not digits:
        if re.search(r"[\[\](){}=<>]", v):
            return False
        other = sum(not c.isalnum() and c not in "._-" for c in v)
        return run >= 8 or total >= 8 and any(c.isupper() for c in v) and any(c.islower() for c in v) or other >= 1 and len(v) >= 10 and total >= 4
    return False


def _in_line(line: str) -> list[tuple[int, int]]:
    """Spans (from, to) of the credentials in one line; keys in PEM form are found elsewhere."""
    if not _HINT.search(line):
        return []
    out: list[tuple[int, int]] = []

    def put(m: re.Match, named: bool, group: str = "value") -> None:
        if usable(m.group(group), named):
            out.append(m.span(group))

    for m in _URL.finditer(line):
        pw = m.group("pw")
        if not _from_store(pw) and not re.match(r"^[{$%:<\[]", pw) and len(pw) >= 4:
            out.append(m.span("pw"))
    for m in _PARAM.finditer(line):
        put(m, _secret_name(m.group("name")))
    for m in _FLAG.finditer(line):
        put(m, _secret_name(m.group("name")))
    for m in _USERPW.finditer(line):
        put(m, True)
    literals = list(_LITERAL.finditer(line))
    starts = [0, 0, *(m.start() for m in literals)]

    def begin(at: int) -> int:
        """Where the context of a literal begins: the literal before the last one."""
        return starts[max(0, bisect.bisect_left(starts, at) - 2)]

    for m in _CONCAT.finditer(line):
        # one literal in several pieces
        pieces = list(_LITERAL.finditer(line, m.start(), m.end()))
        name = _name_before(_TO_NAME, line[begin(m.start()) : m.start()][::-1])
        if name and not _speaks_of_other(name) and usable("".join(x.group("value") for x in pieces), _secret_name(name)):
            out += [x.span("value") for x in pieces]
    for m in literals:
        if len(m.group("value")) < 6:
            continue
        if (inner := re.match(r"([A-Za-z_][\w.-]*)=(.+)$", m.group("value"))) and usable(inner.group(2), _secret_name(inner.group(1))):
            out.append((m.start("value") + inner.start(2), m.end("value")))
            continue
        before = line[begin(m.start()) : m.start()][::-1]
        if (c := _TO_CALL.match(before)) and _LOGIN.search(c.group("call")[::-1]):
            put(m, True)
            continue
        name = _name_before(_TO_NAME, before) or _name_before(_TO_QUOTED, before)
        named = bool(name) and _secret_name(name)
        if name and _speaks_of_other(name):
            continue
        if not named and _TO_COMPARE.match(before) and _unexplained(m.group("value")):
            named = True
        put(m, named)
    if _PROSE.match(line) and _PROSE_WORD.search(line) and not re.search(r"(?i)\b(?:sha-?\d*|md5|commit|digest|checksum|uuid|public|hash)\b", line):
        for m in _PIECE.finditer(line):
            v = m.group().rstrip(".:") if not _JOINED_WORDS.match(m.group()) else m.group()
            if "://" in v or "=" in v or _is_path(v) or _from_store(v) or _UUID.match(v):
                continue
            hex_key = _HEX.match(v) and len(v) >= 24 and not v.isdigit()
            if hex_key or _unexplained(v) or _dense(v) or _JOINED_WORDS.match(v) and len(v) >= 10 or len(v) >= 12 and _model().residual(v)[1] >= 9 and sum(c.isdigit() for c in v) >= 2:
                out.append((m.start(), m.start() + len(v)))
        for m in _PHRASE.finditer(line):
            put(m, True)
    for m in _BARE.finditer(line):
        put(m, _secret_name(m.group("name")))
    if m := _YAML.match(line):
        put(m, _secret_name(m.group("name")))
    for m in _TOKEN.finditer(line):
        if not _from_store(m.group()):
            out.append(m.span())
    return _merged(out)


def _name_before(pattern: re.Pattern, backwards: str) -> str | None:
    m = pattern.match(backwards)
    return m.group("name")[::-1] if m else None


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_credentials(text: str) -> list[tuple[int, int]]:
    """Spans (from, to) of all credentials of a text, in order."""
    spans: list[tuple[int, int]] = []
    if "PRIVATE KEY" in text:
        for m in _PEM.finditer(text):
            body = re.sub(r"\\[nrt]|[^A-Za-z0-9+/=]", "", m.group("body"))
            said = re.sub(r"[A-Za-z0-9+/=]{40,}|\\[nrt]", "", m.group("body")).strip()  # what isn't key material
            if len(body) >= 40 and not (re.search(r"[A-Za-z]", said) and _from_store(said)):
                spans.append(m.span("body"))
    keys = list(spans)
    at = 0
    for line in text.split("\n"):
        if not any(a <= at <= b for a, b in keys):
            spans += [(at + a, at + b) for a, b in _in_line(line)]
        at += len(line) + 1
    return _merged(spans)


def lines_of(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """1-based lines on which the credentials begin."""
    out, line, at = [], 1, 0
    for a, _ in spans:
        line += text.count("\n", at, a)
        at = a
        # the body of a key starts after its BEGIN mark, which may end its line
        begins = line - 1 if text[max(0, a - 64) : a].rstrip("\n").endswith("-----") and text[a - 1 : a] == "\n" else line
        out.append(begins)
    return sorted(set(out))


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with every credential's letters and digits starred; line feeds and escapes stay."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], re.sub(r"(\\[nrt\"'\\])|[^\s]", lambda m: m.group(1) or "*", text[a:b])]
        at = b
    return "".join([*out, text[at:]])
