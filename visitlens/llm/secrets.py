"""Secret scan: fixed patterns, and an assignment-aware lexer that follows constants to sensitive names.

The lexer reads source and configuration text of any kind into pairs of a name and a value: `name = "x"`, `name: x`,
`"name": "x"`, `name => 'x'`, `export NAME=x`, `<name>x</name>` and `set("name", "x")`. A value is literals and names
joined by `+` or `.`. Constants are carried along: a name bound to a literal hands it to every name bound to it later.
A literal is reported when a sensitive name receives it and it looks like a secret, wherever it was written.
"""

from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARACTERS = 6

# The lexer's own tables: weights of the words inside a name, and values that only stand for a secret.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 3, "credentials": 3,
    "private": 1, "access": 1, "auth": 1, "api": 1, "key": 1, "signing": 1, "encryption": 1, "bearer": 2, "client": 0,
}
HARMLESS = {"length": 3, "len": 3, "count": 3, "min": 2, "max": 2, "name": 2, "path": 2, "file": 2, "url": 2, "field": 2, "label": 2, "hint": 2, "public": 2, "type": 2}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|undefined|changeme|example|placeholder|your.*|<.*>|\$\{.*\}|%\(.*\).*)$")
LEAST_SCORE = 3.0
LEAST_CHARACTERS = 6

QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
NAME = r"[A-Za-z_$][A-Za-z0-9_$]*(?:[.\-][A-Za-z0-9_$]+)*"
PAIR = re.compile(
    rf"""(?<![A-Za-z0-9_$.\-])(?P<key>{NAME})["']?[\t\x20]*(?::=|=>|==?|:)[\t\x20]*(?=[^\s=])|<(?P<tag>{NAME})>(?=[^<\s])"""
    rf"""|\b(?:set|put|setProperty|setenv|define)\([\t\x20]*["'](?P<arg>{NAME})["'][\t\x20]*,[\t\x20]*""")
VALUE = re.compile(rf"""(?P<quoted>{QUOTED})|(?P<bare>[^\s"'<>,;(){{}}\[\]|&=]+=*)""")
JOINT = re.compile(r"""[\t\x20]*(?:[+]|[.](?=[\t\x20]*["'$]))[\t\x20]*""")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
KINDS = {"assign": 0, "access": 1, "hex": 2, "lexed": 3}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and not overlapping per kind."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARACTERS]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS[s[2]]))


def name_score(name: str) -> float:
    """How much a name calls for a secret, from the words it is made of."""
    words = [w.lower() for w in WORD.findall(name)]
    score = sum(SENSITIVE.get(w, 0) for w in words) + (2 if {"api", "key"} <= set(words) or {"private", "key"} <= set(words) else 0)
    return score - sum(HARMLESS.get(w, 0) for w in words)


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: 0 for placeholders, up to 2 for long mixed strings."""
    if len(value) < LEAST_CHARACTERS or PLACEHOLDER.match(value) or re.search(r"\s", value):
        return 0.0
    counts = [value.count(c) for c in set(value)]
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts)
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(2.0, 0.5 + (entropy > 2.5) * 0.5 + (kinds >= 2) * 0.5 + (len(value) >= 16) * 0.5) if entropy > 1.5 else 0.0


def _parts(text: str, at: int) -> list[tuple[str, int, int, bool]]:
    """(string, start, end, is it a literal) of the value at `at`."""
    parts = []
    while m := VALUE.match(text, at):
        if m["quoted"] is not None:
            parts.append((m["quoted"][1:-1], m.start() + 1, m.end() - 1, True))
        else:
            parts.append((m["bare"], m.start(), m.end(), False))
        joint = JOINT.match(text, m.end())
        if not joint:
            break
        at = joint.end()
    return parts


def _literals(parts: list) -> dict[tuple[int, int], str]:
    """The strings by (start, end) that a value is made of, each once, in the order of their first use.

    A part is a string or the parts of a constant. These are shared, not copied, and entered once, so a constant that is
    joined with itself again and again costs no more than its strings.
    """
    out, entered, left = {}, {id(parts)}, [iter(parts)]
    while left:
        for part in left[-1]:
            if isinstance(part, tuple):
                out.setdefault(part[1:], part[0])
            elif id(part) not in entered:
                entered.add(id(part))
                left.append(iter(part))
                break
        else:
            left.pop()
    return out


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, "lexed") of the literals that sensitive names receive, directly or through constants.

    A value joined by `+` or `.` is scored as its strings put together, each literal of the text once.
    """
    constants: dict[str, list] = {}
    found = set()
    for m in PAIR.finditer(text):
        name = m["key"] or m["tag"] or m["arg"]
        parts = _parts(text, m.end())
        if not parts:
            continue
        received = [constants[value] if not literal and value in constants else (value, start, end) for value, start, end, literal in parts]
        score = name_score(name)
        if score > 0:
            strings = _literals(received)
            quality = literal_score("".join(strings.values()))
            if quality and score + quality >= LEAST_SCORE:
                found.update(span for span, value in strings.items() if value)
        # A value that is one bare word may be a constant or prose: only literals and constants are handed on.
        constants[name] = received if any(p[3] or p[0] in constants for p in parts) else []
    return [(start, end, "lexed") for start, end in found]


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text in code points, end exclusive, ordered by start, then kind."""
    if not text:
        return []
    spans = base_spans(text)
    if "=" in text or ":" in text or "<" in text or "(" in text:
        spans += lexed_spans(text)
    return sorted(spans, key=lambda s: (s[0], KINDS[s[2]], s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, `n_assign`, `n_access`, `n_hex`, `n_lexed`, `base_sha256` and `spans`.

    Spans read `kind:start:end` in code points. A null or empty text has none. Repeated rows give equal rows; an empty
    table gives an empty one; other columns of the input are not used. Texts of any length are read whole.
    """
    @F.pandas_udf(", ".join(f"n_{kind} long" for kind in KINDS) + ", base_sha256 string, spans string")
    def found(texts: pd.Series) -> pd.DataFrame:
        spans = [scan(text) for text in texts]
        base = [[s for s in own if s[2] != "lexed"] for own in spans]
        out = {f"n_{kind}": [sum(s[2] == kind for s in own) for own in spans] for kind in KINDS}
        out["base_sha256"] = [hashlib.sha256(joined(own).encode()).hexdigest() for own in base]
        out["spans"] = [joined(own) for own in spans]
        return pd.DataFrame(out)

    return docs.select(docs[id_col], found(docs[text_col]).alias("found")).select(id_col, "found.*")
