"""Personal data in whole texts: fixed patterns, and a trained character-level tagger.

Base patterns find ``email``, ``ip``, ``card`` and ``phone`` spans. The method is a bidirectional LSTM
with CRF transitions over characters. It is trained on the driver from labelled spans: windows around
the base spans of at most TRAIN_DOCS documents (the least by hash among those with an @ or a digit), the
same windows with the entity rewritten in other forms (spelled-out or defanged addresses, numbers
without + or with other separators), and windows with numbers that are no personal data. It then reads
every text as overlapping windows of WINDOW characters, one every STRIDE, reconciled over the whole text:
each character takes its tag from the window in which it lies farthest from an edge, so each window owns the
STRIDE characters in its middle. Runs of one kind that are plausible (digit counts, Luhn, number ranges) and
lie in no base span are ``seq_`` spans.

A run is settled as its longest plausible part: with the rest of the words at its ends and what a bracketed dot
joins to them, without it, or without up to three words at either end. A number with a date, a time of day or the
check sum of an ISBN is neither phone nor card.

Only windows that can matter are computed, with the result of computing all: a plausible run holds a digit,
an @ or an ``at`` between blanks or brackets, or reaches into a word that does, so the owners of those words
are decoded, and then, as long as a run reaches the edge of what is decoded, the window beyond it.

Nulls and edges: a null text is empty; with no usable document the tagger learns from made-up windows
alone; repeated rows are scanned each; an empty table gives no rows; texts may be of any length; docs keep
their columns, one named spans is replaced. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbmark.llm import tagger
from ebbmark.llm.batches import bounded
from ebbmark.llm.secrets import joined

KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, *(f"seq_{k}" for k in KINDS))
#: Bounds of the training sample: documents, characters of each, base spans of each, and windows around base
#: spans in all; then the number of made-up windows. Reading texts has no such bounds.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_SPANS, TRAIN_BASE, TRAIN_MADE = 300, 20_000, 6, 300, 2000
WINDOW, STRIDE, DECODE = 80, 40, 512
_EDGE = (WINDOW - STRIDE) // 2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_BLANK = re.compile(r"\s")
#: A calendar date, as it may stand in a longer number.
_DATE = re.compile(
    r"(?<![0-9])(?:(?:19|20)[0-9]{2}(?P<a>[-./]?)(?:0?[1-9]|1[0-2])(?P=a)(?:0?[1-9]|[12][0-9]|3[01])"
    r"|(?:0?[1-9]|[12][0-9]|3[01])(?P<b>[-./])(?:0?[1-9]|1[0-2])(?P=b)(?:19|20)[0-9]{2}"
    r"|(?:0?[1-9]|1[0-2])(?P<c>[-./])(?:0?[1-9]|[12][0-9]|3[01])(?P=c)(?:19|20)[0-9]{2})(?![0-9])"
)
#: More of a spelled-out domain.
_DOTS = re.compile(r"(?:\s?[\[({]dot[\])}]\s?[\w-]+)+", re.IGNORECASE)
#: What every plausible span holds: a digit, an @, or an at between blanks or brackets.
_ANCHOR = re.compile(r"[0-9@]|[\s\[({]at(?=[\s\])}])", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, in linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((a, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)]
    if not _DIGITS.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x) <= 9 + len(x) - len(x.lstrip("0")) and int(x[-9:]) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _made(kind: str, rng: random.Random) -> str:
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(a, b)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        name = rng.choice([word(3, 8), word(3, 8), f"{word(1, 8)}{rng.choice('._-')}{word(3, 8)}"])
        return f"{name}{num(rng.choice([0, 0, 1, 2]))}@{word(3, 8)}.{rng.choice(['com', 'org', 'net', 'de', 'example.com'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        head = rng.choice("3456") + num(14)
        return head + next(d for d in "0123456789" if luhn(head + d))
    return f"+{rng.randint(1, 99)} {num(3)} {num(3)} {num(4)}"


def _rewritten(kind: str, s: str, rng: random.Random) -> str:
    if kind == "email":
        at, dot = rng.choice([("@", "."), (" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" at ", "."), (" (at) ", " (dot) "), ("{at}", "{dot}")])
        if at == "@":
            return s
        out = s.replace("@", at)
        out = out[: out.index(at) + len(at)] + out[out.index(at) + len(at) :].replace(".", dot)
        return out.upper() if rng.random() < 0.2 else out
    digits = "".join(_DIGITS.findall(s))
    if kind == "ip":
        return s.replace(".", rng.choice([".", "[.]", "(.)"]))
    if kind == "card":
        sep = rng.choice(["", " ", "-", ".", "/", "_"])
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    d = digits[-10:].rjust(10, "5")
    if rng.random() < 0.3:  # groups of any size, by one separator
        sep, out, rest = rng.choice("/ -."), "0" * rng.randint(1, 2), d
        while len(rest) > 5:
            k = rng.randint(2, 4)
            out, rest = out + rest[:k] + sep, rest[k:]
        return out + rest
    return rng.choice([s, f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"00{digits[:2]} {d[:3]} {d[3:]}", f"+{digits[:2]}/{d[:4]}/{d[4:]}"])


def _nothing(rng: random.Random) -> str:
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice(
        [
            f"{rng.randint(1900, 2030)}-{num(2)}-{num(2)}",
            f"{num(2)}:{num(2)}:{num(2)}",
            f"{num(1)},{num(3)}.{num(2)}",
            f"v{num(1)}.{num(1)}.{num(2)}",
            "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(12, 40))),
            num(rng.randint(1, 8)),
            num(16),
            f"{num(2)}/{num(2)}/{num(4)}",
            f"{num(1)}.{num(1)}",
            f"{num(2)},{num(3)},{num(3)}",
            f"section {num(1)}.{num(2)}.{num(1)}",
            f"{rng.choice(['look', 'sit', 'met', 'arrive'])} at {rng.choice(['home', 'noon', 'the gate', 'last'])}. Then",
            f"AKIA{num(4)}XK{num(3)}",
            "@" + rng.choice(["home", "work", "user1"]),
            f"{num(3)} at {num(2)}",
        ]
    )


#: By their share in many languages.
LETTERS = "aaaabccddddeeeeeeefghhiiiiiklllmmnnnnnooooopprrrrrsssssttttttuuvwyz"
#: Words that may stand before personal data in made-up windows.
CUES = {"email": ("mail", "write to", "contact", "mail me at"), "ip": ("host", "server", "from", "address"), "card": ("card", "pay with", "number"), "phone": ("call", "phone", "tel", "or")}


def training_windows(texts: list[str], seed: int = 11, made: int = TRAIN_MADE) -> tuple[np.ndarray, np.ndarray]:
    """Character ids and BIO tags (0, then 1 + 2k and 2 + 2k of kind k)."""
    rng, xs, ys = random.Random(seed), [], []

    def add(left: str, kind: str | None, s: str, right: str) -> None:
        pre = rng.randint(4, max(5, WINDOW - len(s) - 4)) if len(s) < WINDOW - 10 else 2
        left = left[-pre:] if pre else ""
        window = (left + s + right)[:WINDOW]
        y = np.zeros(WINDOW, np.int64)
        if kind:
            k = KINDS.index(kind)
            y[len(left) : min(WINDOW, len(left) + len(s))] = 2 + 2 * k
            y[len(left)] = 1 + 2 * k
        xs.append(tagger.codes(window, WINDOW))
        ys.append(y)

    plain = [t for t in texts if len(t) > 200] or ["some words stand here and more of them follow until the end of the line. " * 4]
    for t in texts:
        for kind, a, b in base_spans(t)[:TRAIN_SPANS]:
            left, right = t[max(0, a - WINDOW) : a], t[b : b + WINDOW]
            if not base_spans(left) and not base_spans(right):
                add(left, kind, t[a:b], right)
    xs, ys = xs[:TRAIN_BASE], ys[:TRAIN_BASE]
    for i in range(made):
        t = rng.choice(plain)
        a = rng.randrange(max(1, len(t) - 2 * WINDOW))
        left, right = re.sub(r"[0-9@+]", "x", t[a : a + WINDOW]), re.sub(r"[0-9@+]", "x", t[a + WINDOW : a + 2 * WINDOW])
        if rng.random() < 0.5:  # words of other languages than the sample's
            left, right = (" ".join("".join(rng.choice(LETTERS) for _ in range(rng.choice([1, 2, 2, 3, 3, 4, 5, 6, 8]))) for _ in range(WINDOW // 3)) for _ in range(2))
        kind = KINDS[i % 5] if i % 5 < 4 else None
        cue = rng.choice(CUES[kind] if kind else ("on", "since", "is", "about")) + rng.choice([" ", ": ", " is "]) if rng.random() < 0.5 else ""
        gap = rng.choice([" ", "\n", " (", ", "])
        add(left + gap + cue, kind, _rewritten(kind, _made(kind, rng), rng) if kind else _nothing(rng), rng.choice([" ", ". ", ", ", ")", "\n"]) + right)
    return np.array(xs), np.array(ys)


def plausible(kind: str, s: str) -> bool:
    digits = "".join(_DIGITS.findall(s))
    if kind == "email":
        s = re.sub(r"(?i)\s?[\[({]dot[\])}]\s?|\sdot\s", ".", s)  # also before the at
        whole = re.fullmatch(r"(?i)[\w.%+-]+\s?[\[({]?(?:@|at)[\])}]?\s?[\w-]+(?:\s?[\[({]?(?:\.|dot)[\])}]?\s?[\w-]+)+", s)
        return whole is not None and ("@" in s or re.search(r"(?i)[\s\[({]at[\s\])}]", s) is not None)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(x) < 4 and int(x) < 256 for x in parts) and not re.search(r"[A-Za-z]", s)
    if re.search(r"[A-Za-z:]", s) or _DATE.search(s) or _is_book(s, digits):
        return False
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and (s[0] in "+(" or len(re.findall(r"[^0-9]+", s)) >= 2)


def _is_book(s: str, digits: str) -> bool:
    """Whether a number in groups is an ISBN: 13 digits from 978 or 979 on, or 10 in four groups, by the check sum."""
    if len(digits) == 13 and digits[:3] in ("978", "979"):
        return sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(digits)) % 10 == 0
    return re.fullmatch(r"(?:[0-9]+[- ]){3}[0-9]", s) is not None and len(digits) == 10 and sum(int(d) * (10 - i) for i, d in enumerate(digits)) % 11 == 0


def _anchored(text: str) -> Iterator[tuple[int, int]]:
    """The words that hold an anchor, and the blank before an at that is a word of its own."""
    done = 0
    for m in _ANCHOR.finditer(text):
        if m.start() >= done:
            a = m.start()
            if text[a].isspace():
                yield a, a + 1
            else:
                a, done = _token(text, a, a)
                yield a, done


def _zones(texts: list[str], model: dict, whole: bool) -> dict[tuple[int, int], np.ndarray]:
    """Tags of the characters that each decoded window owns, by (text, window)."""
    owner = lambda j: max(0, (j - _EDGE) // STRIDE)
    todo = {(i, w) for i, t in enumerate(texts) for a, b in ([(0, len(t))] if whole else _anchored(t)) for w in range(owner(a), owner(b - 1) + 1)}
    out: dict[tuple[int, int], np.ndarray] = {}
    while todo:
        keys, todo = sorted(todo), set()
        for a in range(0, len(keys), DECODE):
            some = keys[a : a + DECODE]
            x = np.array([tagger.codes(texts[i][w * STRIDE : w * STRIDE + WINDOW], WINDOW) for i, w in some])
            for (i, w), row in zip(some, tagger.decode(model, x)):
                z = row[_EDGE if w else 0 : min(_EDGE + STRIDE, len(texts[i]) - w * STRIDE)]
                out[i, w] = z
                if len(z) and z[0] and w:
                    todo.add((i, w - 1))
                if len(z) and z[-1] and w * STRIDE + _EDGE + STRIDE < len(texts[i]):
                    todo.add((i, w + 1))
        todo -= out.keys()
    return out


def _token(text: str, a: int, b: int) -> tuple[int, int]:
    """a and b moved out to the blanks around them."""
    while a and not text[a - 1].isspace():
        a -= 1
    m = _BLANK.search(text, b)
    return a, m.start() if m else len(text)


def _settled(text: str, a: int, b: int, kinds: list[str]) -> tuple[str, int, int] | None:
    """The longest plausible part, as the first of these kinds that it can be, of text[a:b] with the rest of
    the words at its ends, without it, and without up to three words at either end."""
    words = [(a + m.start(), a + m.end()) for m in re.finditer(r"\S+", text[a:b])]
    first, last = (words[0][0], words[-1][1]) if words else (a, b)
    out = _token(text, first, last)
    begins, ends = {out[0], *(w[0] for w in words[:4])}, {out[1], *(w[1] for w in words[-4:])}
    if m := _DOTS.match(text, out[1]):
        ends.add(m.end())
    for x, y in sorted(((x, y) for x in begins for y in ends if x < y), key=lambda p: (p[0] - p[1], p[0])):
        while x < y and not (text[x].isalnum() or text[x] in "+("):
            x += 1
        while y > x and not text[y - 1].isalnum():
            y -= 1
        for kind in kinds if x < y else ():
            if plausible(kind, text[x:y]):
                return kind, x, y
    return None


def tagged(texts: list[str], model: dict, whole: bool = False) -> list[list[tuple[str, int, int]]]:
    """The tagger's plausible spans of each text. ``whole`` decodes all windows, with the same result.

    A run of tagged characters is a span of the kind that most of them show, or else of another that it can be.
    """
    runs: list[list[list]] = [[] for _ in texts]  # start, end, kind of each character
    for (i, w), z in sorted(_zones(texts, model, whole).items()):
        base = w * STRIDE + (_EDGE if w else 0)
        for j in np.flatnonzero(z).tolist():
            kind, inside = divmod(int(z[j]) - 1, 2)
            if runs[i] and runs[i][-1][1] == base + j and (inside or not texts[i][base + j - 1].isspace()):
                runs[i][-1][1] += 1
                runs[i][-1][2].append(kind)
            else:
                runs[i].append([base + j, base + j + 1, [kind]])
    out = []
    for t, found in zip(texts, runs):
        by = [(a, b, [KINDS[k] for k, _ in Counter(ks).most_common()]) for a, b, ks in found]
        spans: list[tuple[str, int, int]] = []
        for a, b, first in by:
            s = _settled(t, a, b, first + [k for k in KINDS if k not in first])
            if s and not (spans and s[1] < spans[-1][2]):
                spans.append(s)
        out.append(spans)
    return out


def fit(docs: DataFrame) -> dict:
    """The tagger, trained on at most TRAIN_DOCS documents."""
    some = docs.select("text").filter(F.col("text").rlike(r"@|[0-9]{2}")).withColumn("h", F.xxhash64("text"))
    # numbers first, texts of the chosen ones after: each partition sends no more than TRAIN_DOCS longs
    least = [r["h"] for r in some.select("h").distinct().orderBy("h").limit(TRAIN_DOCS).collect()]
    rows = some.filter(F.col("h").isin(least)).groupBy("h").agg(F.min(F.substring("text", 1, TRAIN_CHARS)).alias("text")).orderBy("h").collect()
    x, y = training_windows([r["text"] for r in rows])
    return tagger.train(x, y, 1 + 2 * len(KINDS), epochs=10, batch=64, rate=0.025)


def spans_of(texts: list[str | None], model: dict) -> list[list[tuple[str, int, int]]]:
    whole = [t or "" for t in texts]
    out = []
    for base, extra in zip(map(base_spans, whole), tagged(whole, model)):
        held = sorted((a, b) for _, a, b in base)
        more = [(f"seq_{k}", a, b) for k, a, b in extra if not any(x < b and a < y for x, y in held)]
        out.append(sorted(base + more, key=lambda s: (s[1], ALL.index(s[0]))))
    return out


def found(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """docs with ``spans``: array of (kind, start, end), by start and kind."""
    bounded(docs.sparkSession)
    scan = partial(spans_of, model=fit(docs) if model is None else model)

    @F.pandas_udf("array<struct<kind string, start long, end long>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series(scan(list(texts)), dtype=object)

    return docs.withColumn("spans", spans.asNondeterministic()("text"))


def digest(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: ~s["kind"].startswith("seq_"))
    return found(docs, model).select("doc_id", *map(of, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
