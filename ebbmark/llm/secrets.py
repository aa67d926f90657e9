"""Secrets in whole texts: fixed patterns, and an assignment-aware lexer.

Base patterns find ``assign``, ``access`` and ``hex`` spans. The method reads source and configuration
syntax as name-literal pairs (``name = "x"``, ``name: x``, ``name: type = "x"``, ``name := 'x' + other``, keyword
arguments, JSON members, literals in three quotes or backticks, bracketed items and arguments, ``setName("x")``,
``define('NAME', 'x')``, XML elements, indented blocks after ``name: |``), propagates constants through names and concatenations in text order (a name used before
it is bound stands for what it is bound to next), and scores every literal by the most sensitive name it reaches and by its own look (length, entropy, placeholders). A
literal that scores SCORE or more, and lies in no base span, is a ``literal`` span. Bracketed items, arguments
and lines of a block stand each for themselves; dotted or underscored words there are names, not secrets. Names, literals and
concatenations may be of any length; the lexer passes over a text once, and a concatenation refers to
its parts instead of copying them.

Nulls and edges: a null text is empty; a text without a colon or equals sign has no pairs; repeated rows
are scanned each; an empty table gives no rows; docs keep their columns, one named spans is replaced.
Offsets are code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbmark.llm.batches import bounded

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CUES = ("passw", "secret", "token", "api")

#: How sensitive a target name is, by its parts.
SENSITIVE = {
    "password": 1.0,
    "passwd": 1.0,
    "passphrase": 1.0,
    "mnemonic": 1.0,
    "seedphrase": 1.0,
    "pwd": 0.9,
    "secret": 1.0,
    "token": 0.9,
    "apikey": 1.0,
    "credential": 0.9,
    "credentials": 0.9,
    "bearer": 0.9,
    "auth": 0.7,
    "private": 0.7,
    "signing": 0.7,
    "encryption": 0.7,
    "access": 0.5,
    "key": 0.6,
    "salt": 0.6,
    "dsn": 0.6,
}
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "dummy", "sample", "xxxx", "none", "null", "true", "false", "todo")
SCORE = 0.5

#: String literals: in one or three quotes, or in backticks; those of three quotes and backticks may hold line breaks.
_LITERAL = r"""(?:[bBrRuUfF]{1,2}(?=["'])|@(?=["]))?(?:"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*+"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*+'{3}|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`)"""
#: Literals within brackets, as arguments or items; a member name of an object is none.
_ITEMS = rf"[(\[{{]\s*+(?P<%s>{_LITERAL}(?!\s*+(?::|=>))(?:\s*+[,+]?\s*+{_LITERAL})*+)"
#: A type between the name and its equals sign.
_TYPE = r"\??:[ \t]*+&?(?:'[a-z]++[ \t])?[A-Za-z_][A-Za-z0-9_.\[\]<>|?]*+[ \t]*+(?==)"
#: A name with or without a value: a name without one is passed over whole, which keeps the scan linear. What
#: brackets, elements and blocks hold is looked at but not passed over, as it may hold pairs itself.
_PAIR = re.compile(
    rf"""<(?P<tag>[A-Za-z_][A-Za-z0-9_.:\-]*+)>(?=(?P<body>[^<]*+)</(?P=tag)>)"""
    rf"""|(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)(?:(?={_ITEMS % "args"})"""
    rf"""|["'\[\]]{{0,3}}[ \t]*+(?:{_TYPE})?(?::=|=>|=|:)(?![=/])[ \t]*+"""
    rf"""(?:(?=(?:[A-Za-z_][A-Za-z0-9_.]*+[ \t]*+)?{_ITEMS % "items"})|(?P<block>[|>][+\-0-9]{{0,2}}[ \t]*+\n)"""
    rf"""|(?P<value>(?:{_LITERAL}|[A-Za-z0-9_+/][A-Za-z0-9_+/.=\-]*+(?![(\["'`]))(?:\s*+\+\s*+(?:{_LITERAL}|[A-Za-z_][A-Za-z0-9_.]*+)|[ \t]*+\\\n[ \t]*+{_LITERAL})*+)))?"""
)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*")
_TERM = re.compile(rf"{_LITERAL}|[^\s+\"'`\\][^\s\"'`]*")
_QUOTE = re.compile(r"""[A-Za-z@]{0,2}("{3}|'{3}|["'`])""")
#: Functions whose argument says where a secret is and not what it is.
_LOOKS_UP = re.compile(r"(?:get|load|read|fetch|find|has|is|delete|describe|require|check|validate)(?![a-z])")
_WORDS = re.compile(r"[A-Za-z]+(?:[_.\-/:][A-Za-z]+)*")
_PHRASE = re.compile(r"[A-Za-z]+(?:[ ][A-Za-z]+){3,}")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    best = max((SENSITIVE.get(p, 0.0) for p in parts + joined), default=0.0)
    two = sum(SENSITIVE.get(p, 0.0) for p in parts) if len(parts) > 1 else best
    return min(1.0, max(best, two))


class Look(NamedTuple):
    """What literal_score needs of a text that may be too long to write out, as parts add up."""

    counts: dict[str, float]  # of each character, times 2 ** power
    n: float
    power: int
    held: bool  # holds a placeholder
    head: str
    tail: str


#: Names whose value is a run of plain words, and what such a run of four words or more scores.
PHRASES, PHRASE_SCORE = ("passphrase", "mnemonic", "seedphrase"), 0.8


def name_holds_phrase(name: str) -> bool:
    low = "".join(_PARTS.findall(name)).lower()
    return any(p in low for p in PHRASES)


_EDGE = max(map(len, PLACEHOLDERS)) - 1


def look(value: str) -> Look:
    low = value.lower()
    return Look({c: float(k) for c, k in Counter(value).items()}, float(len(value)), 0, any(p in low for p in PLACEHOLDERS), low[:_EDGE], low[-_EDGE:])


def together(x: Look, y: Look) -> Look:
    """The look of x followed by y."""
    power = max(x.power, y.power)
    a, b = math.ldexp(1.0, x.power - power), math.ldexp(1.0, y.power - power)
    counts = {c: k * a for c, k in x.counts.items()}
    for c, k in y.counts.items():
        counts[c] = counts.get(c, 0.0) + k * b
    n = x.n * a + y.n * b
    if n > 2.0**200:
        counts, n, power = {c: k * 2.0**-100 for c, k in counts.items()}, n * 2.0**-100, power + 100
    seam = x.tail + y.head
    return Look(counts, n, power, x.held or y.held or any(p in seam for p in PLACEHOLDERS), (x.head + y.head)[:_EDGE], (x.tail + y.tail)[-_EDGE:])


def literal_score(value: str | Look) -> float:
    v = value if isinstance(value, Look) else look(value)
    if (v.n < 8 and not v.power) or v.held or any(c in v.counts for c in "<>${} \t"):
        return 0.0
    entropy = -sum(k / v.n * math.log2(k / v.n) for k in v.counts.values() if k / v.n)
    mixed = sum(any(map(f, v.counts)) for f in (str.isdigit, str.isupper, str.islower)) + any(not c.isalnum() for c in v.counts)
    return min(1.0, entropy / 3.5) * (0.4 if mixed == 1 else 0.8 if mixed == 2 else 1.0)


def _carried(marks: list[float], below: list[list[int]]) -> None:
    """Give every node the highest mark of the nodes that lead to it: from the highest mark down, each node is
    reached once, also where names refer to each other in a circle."""
    done = [False] * len(marks)
    for i in sorted(range(len(marks)), key=marks.__getitem__, reverse=True):
        mark, todo = marks[i], [i]
        if mark <= 0:
            return
        while todo:
            j = todo.pop()
            if not done[j]:
                done[j], marks[j] = True, mark
                todo += below[j]


def _items(text: str, m: re.Match) -> tuple[str, list[tuple[int, int]]]:
    """The name and the literals (start, end) of a pair whose value is bracketed, an element, a block or arguments.

    Of arguments, a first literal that is itself a sensitive name is the name of those after it
    (``define('AUTH_KEY', '...')``); else the function's name counts, unless it only looks something up.
    """
    if m["args"] is None and not name_score(m["tag"] or m["name"]):
        return "", []
    if m["tag"] is not None:
        a, b = m.span("body")
        inner = text[a:b].strip()
        a += len(text[a:b]) - len(text[a:b].lstrip())
        return m["tag"].rpartition(":")[2], [(a, a + len(inner))] if inner else []
    if m["block"] is not None:
        line = text.rfind("\n", 0, m.start()) + 1
        depth, at, out = len(text[line : m.start()]) - len(text[line : m.start()].lstrip(" \t-")), m.end("block"), []
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            inner = text[at:end].strip()
            start = at + len(text[at:end]) - len(text[at:end].lstrip())
            if inner and start - at <= depth:
                break
            out += [(start, start + len(inner))] if inner else []
            at = end + 1
        return m["name"], out
    group = "args" if m["args"] is not None else "items" if m["items"] is not None else None
    if group is None:
        return m["name"], []
    out = []
    for t in re.finditer(_LITERAL, m[group]):
        quote = _QUOTE.match(t[0])
        out.append((m.start(group) + t.start() + quote.end(), m.start(group) + t.end() - len(quote[1])))
    if group == "items":
        return m["name"], out
    first = text[slice(*out[0])]
    if len(out) > 1 and _NAME.fullmatch(first) and name_score(first):
        return first, out[1:]
    name = m["name"].rpartition(".")[2]
    return name, [] if _LOOKS_UP.match(name) else out


def literals(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of each literal that reaches a sensitive name.

    Literals and values are nodes; a value points to the nodes it is made of, a name used before it is bound to
    its later value. The weights of names go down to the literals along these links, each followed once.
    """
    bound: dict[str, tuple[int, Look]] = {}
    waiting: dict[str, list[int]] = {}  # nodes of names not bound yet
    forward: list[tuple[int, int]] = []
    spans: list[tuple[int, int] | None] = []
    below: list[list[int]] = []
    weights: list[float] = []
    scores: list[float] = []

    def node(span: tuple[int, int] | None, parts: list[int], weight: float, score: float) -> int:
        spans.append(span)
        below.append(parts)
        weights.append(weight)
        scores.append(score)
        return len(spans) - 1

    for m in _PAIR.finditer(text):
        if m["value"] is None:
            named, each = _items(text, m)
            weight = name_score(named) if each else 0.0
            if weight:
                # items stand each for themselves; words that name something are no secrets
                node(None, [node(x, [], 0.0, 0.0) for x in each if not _WORDS.fullmatch(text, *x)], weight, 0.0)
            continue
        name, base, parts, whole = m["name"], m.start("value"), [], None
        for t in _TERM.finditer(m["value"]):
            a, b, term = base + t.start(), base + t.end(), t[0]
            quote = _QUOTE.match(term)
            if not quote and term in bound:
                part, seen = bound[term]
            else:
                a, b = (a + quote.end(), b - len(quote[1])) if quote else (a, b)
                part, seen = node((a, b), [], 0.0, 0.0), look(text[a:b])
                if not quote and _NAME.fullmatch(term):
                    waiting.setdefault(term, []).append(part)
            parts.append(part)
            whole = seen if whole is None else together(whole, seen)
        whole = whole or look("")
        weight = name_score(name)
        score = weight * literal_score(whole) if weight else 0.0
        if weight and len(parts) == 1 and spans[parts[0]] and name_holds_phrase(name) and _PHRASE.fullmatch(text, *spans[parts[0]]):
            score = max(score, PHRASE_SCORE)
        value = node(None, parts, weight, score)
        bound[name] = value, whole
        for use in waiting.pop(name, ()):
            if use != parts[0] or len(parts) > 1:  # not the name on its own right side
                spans[use] = None
                forward.append((use, value))
    for use, value in forward:
        below[use] = [*below[use], value]
    _carried(weights, below)
    _carried(scores, below)
    out: dict[tuple[int, int], float] = {}
    for i, span in enumerate(spans):
        if span is not None and weights[i] and span[1] > span[0]:
            score = max(scores[i], weights[i] * literal_score(text[span[0] : span[1]]))
            if score >= SCORE:
                out[span] = max(score, out.get(span, 0.0))
    return sorted((*span, score) for span, score in out.items())


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    if not text:
        return []
    out = []
    low = text.lower()
    if any(c in low for c in CUES):
        out += [("assign", *m.span(), 1.0) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span(), 1.0) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span(), 1.0) for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        base = sorted((a, b) for _, a, b, _ in out)
        out += [("literal", a, b, s) for a, b, s in literals(text) if not any(x < b and a < y for x, y in base)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def found(docs: DataFrame) -> DataFrame:
    """docs with ``spans``: array of (kind, start, end, score), by start and kind."""
    bounded(docs.sparkSession)

    @F.pandas_udf("array<struct<kind string, start long, end long, score double>>")
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([spans_of(t) for t in texts])

    return docs.withColumn("spans", scan.asNondeterministic()("text"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS[:3]]
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found(docs).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
