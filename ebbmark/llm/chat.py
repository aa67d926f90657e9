"""Transcript parsing: a hidden Markov model recovers speakers, then turns are rendered canonically.

A transcript is text whose turns may or may not begin with a speaker marker (``User:``, ``### Assistant``,
``Q:``, ``bot>`` ...). States are (role, first line or later line). Each line shows categorical
features: the role its marker names, whether a blank line stands before it, whether it asks, its length
class. Start, transition and emission counts are gathered from all labelled transcripts as one small
table of sums (states x feature values, fixed size) and smoothed by adding one; Viterbi then finds the
most likely roles, and every turn is rendered as ``<|role|>``, its lines, the first without the marker of its role, ``<|end|>``.

A conversation of any length is decoded as one: a long one is kept as several rows, each row's best scores
between any two states are a small matrix, the matrices of a conversation chained in order settle the state
at every border (as in Viterbi itself), and each row is then decoded between its two border states. Turns
that run over a border are rendered without a break, so the rows' renderings joined by line breaks are the
rendering of the whole. What one task gathers of a conversation is 42 numbers for every ``part`` turns.

Nulls and edges: a null or blank text has no turns and renders as ''; a conversation of blank turns has a row
with no roles; a role outside system, user and assistant counts as user when fitting; a null turn number
counts as 0, turns of one number go by role and text, repeated rows are turns each; a null conv_id is one
conversation; without labelled rows all parameters are flat but for markers; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbmark.core.tables import small, table
from ebbmark.llm.batches import bounded

ROLES = ("system", "user", "assistant")
#: Speaker markers by role, compared in lower case.
MARKERS = {
    "system": ("system", "system prompt", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "me", "you"),
    "assistant": ("assistant", "ai", "bot", "model", "agent", "answer", "a"),
}
_ROLE_OF = {m: i for i, r in enumerate(ROLES) for m in MARKERS[r]}
_MARK = re.compile(r"^\s*(?:#{1,4}\s*|\*{1,2}|\[|<\|?)?([A-Za-z ]{1,14}?)(?:\*{0,2}\s*[:>]|\|?>|\])\*{0,2}[ \t]*")
_HEAD = re.compile(r"^\s*#{1,4}\s*([A-Za-z ]{1,14}?)\s*$")
#: Values that each feature takes: marker (none or a role), blank line before, asks, length class.
SIZES = (4, 2, 2, 5)
STATES = 2 * len(ROLES)
WIDTH = sum(SIZES)


def lines_of(text: str | None) -> list[tuple[str, int, bool, str]]:
    """(content without marker, marker role or -1, blank line before, whole line) of each line that is not blank."""
    out, blank = [], False
    for line in (text or "").split("\n"):
        if not line.strip():
            blank = True
            continue
        role, rest = -1, line
        if (m := _MARK.match(line) or _HEAD.match(line)) and (r := _ROLE_OF.get(m[1].strip().lower())) is not None:
            role, rest = r, line[m.end() :]
        out.append((rest, role, blank, line))
        blank = False
    return out


def features(lines: list[tuple[str, int, bool, str]]) -> np.ndarray:
    """Feature values per line."""
    rows = [(role + 1, int(blank), int(rest.rstrip().endswith("?")), min(4, len(rest) // 120)) for rest, role, blank, _ in lines]
    return np.array(rows, np.int64).reshape(-1, len(SIZES))


def _scores(x: np.ndarray, emit: np.ndarray) -> np.ndarray:
    at = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
    return emit[:, x + at].sum(axis=2).T


def viterbi(x: np.ndarray, start: np.ndarray, step: np.ndarray, emit: np.ndarray, before: int = -1, end: int = -1) -> np.ndarray:
    """The likeliest states; logs of start (S), step (S, S) and emit (S, WIDTH). ``before`` and ``end`` fix the
    state before the first line and that of the last."""
    if not len(x):
        return np.empty(0, np.int64)
    scores = _scores(x, emit)
    back = np.zeros((len(x), len(start)), np.int8)
    best = (start if before < 0 else step[before]) + scores[0]
    for t in range(1, len(x)):
        ways = best[:, None] + step
        back[t] = ways.argmax(axis=0)
        best = ways.max(axis=0) + scores[t]
    path = np.empty(len(x), np.int64)
    path[-1] = best.argmax() if end < 0 else end
    for t in range(len(x) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def across(x: np.ndarray, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """(1 + S, S): best scores of these lines by their last state, from the start and from each state before."""
    scores = _scores(x, emit)
    best = np.vstack([start, step]) + scores[0]
    for row in scores[1:]:
        best = (best[:, :, None] + step).max(axis=1) + row
    return best


def borders(blocks: list[np.ndarray]) -> list[int]:
    """The state of the last line of each block, on the best path through all of them."""
    sums = [blocks[0][0]]
    for m in blocks[1:]:
        sums.append((sums[-1][:, None] + m[1:]).max(axis=0))
    out = [int(sums[-1].argmax())]
    for m, before in zip(blocks[:0:-1], sums[-2::-1]):
        out.append(int((before + m[1:, out[-1]]).argmax()))
    return out[::-1]


def render(lines: list[tuple[str, int, bool, str]], path: np.ndarray, opened: bool = False, last: bool = True) -> tuple[list[str], str]:
    """Roles of the turns that begin here, and the text. A marker is taken off only where a turn of its role
    begins; any other line is written as it is, so that no text is lost. ``opened``: a turn stands open from the row before;
    ``last``: no row follows, so the last turn is closed."""
    roles, out = [], []
    for (rest, role, blank, line), state in zip(lines, path):
        begins = state % 2 == 0 or not (roles or opened)
        if not begins or role != state // 2:
            rest = line
        if begins:
            if roles or opened:
                out.append("<|end|>")
            roles.append(ROLES[state // 2])
            out.append(f"<|{roles[-1]}|>")
        elif blank:
            out.append("")
        if rest or not out or out[-1][:2] != "<|":
            out.append(rest)
    return roles, "\n".join(out + ["<|end|>"] * (last and bool(roles or opened)))


def counts(transcripts: DataFrame) -> np.ndarray:
    """Sums over labelled transcripts(text, roles, n_lines): roles and counted non-blank lines of each turn."""
    size = STATES * (1 + STATES + WIDTH)

    @F.pandas_udf("array<long>")
    def of(text: pd.Series, roles: pd.Series, n_lines: pd.Series) -> pd.Series:
        out = []
        at = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
        for t, rs, ns in zip(text, roles, n_lines):
            table = np.zeros((STATES, 1 + STATES + WIDTH), np.int64)
            x = features(lines_of(t))
            states = [2 * (ROLES.index(r) if r in ROLES else 1) + (i > 0) for r, n in zip(rs, ns) for i in range(n)]
            for i, s in enumerate(states[: len(x)]):
                if i == 0:
                    table[s, 0] += 1
                else:
                    table[states[i - 1], 1 + s] += 1
                table[s, 1 + STATES + x[i] + at] += 1
            out.append(table.ravel())
        return pd.Series(out)

    cells = bounded(transcripts.sparkSession) and transcripts.select(F.posexplode(of.asNondeterministic()("text", "roles", "n_lines")).alias("cell", "n"))
    sums = np.zeros(size)
    for r in cells.filter("n > 0").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sums[r["cell"]] = r["n"]
    return sums.reshape(STATES, -1)


def parameters(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logs of start, step and emit. A marker opens a turn, so a later line never carries one."""
    start = np.log(sums[:, 0] + np.tile([1.0, 1e-3], len(ROLES)))
    step = sums[:, 1 : 1 + STATES] + 1.0
    for a in range(STATES):
        for b in range(1, STATES, 2):
            if a // 2 != b // 2:
                step[a, b] = 1e-9  # a later line follows a line of its own role
    emit = sums[:, 1 + STATES :] + 1.0
    for s in range(STATES):
        emit[s, 1:4] -= 0.99  # a marker seldom names another role
        if s % 2 == 0:
            emit[s, [1 + r for r in range(len(ROLES)) if r != s // 2]] = 1e-9  # a turn that begins with a marker is of its role
            emit[s, 1 + s // 2] += 8
    at = 0
    for n in SIZES:
        emit[:, at : at + n] /= emit[:, at : at + n].sum(axis=1, keepdims=True)
        at += n
    return start - np.log(np.exp(start).sum()), np.log(step / step.sum(axis=1, keepdims=True)), np.log(emit)


def _carried(rows: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(conv_id, part, before, end, last) for the rows with lines of conversations that have several rows:
    the states before the row's first line (-1 for none) and of its last line."""
    several = rows.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("__c"))
    long = rows.join(small(table(several, "several")), F.col("conv_id").eqNullSafe(F.col("__c")), "left_semi")

    def scores(text: str | None) -> np.ndarray | None:
        first, later = (features(lines_of(gap + (text or ""))) for gap in ("", "\n\n"))
        return np.vstack([across(first, *model)[:1], across(later, *model)[1:]]).ravel() if len(first) else None

    @F.pandas_udf("array<double>")
    def matrix(texts: pd.Series) -> pd.Series:
        return pd.Series([scores(t) for t in texts])

    @F.pandas_udf("array<struct<part long, before int, end int, last boolean>>")
    def chain(blocks: pd.Series) -> pd.Series:
        out = []
        for bs in blocks:
            ends = borders([np.array(b["m"]).reshape(1 + STATES, STATES) for b in bs])
            out.append([{"part": b["part"], "before": before, "end": end, "last": i == len(bs) - 1} for i, (b, before, end) in enumerate(zip(bs, [-1, *ends], ends))])
        return pd.Series(out)

    each = long.select("conv_id", "part", matrix.asNondeterministic()("text").alias("m")).filter("m is not null")
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "m"))).alias("blocks"))
    return whole.select(F.col("conv_id").alias("__c"), F.explode(chain.asNondeterministic()("blocks")).alias("b")).select("__c", F.col("b.part").alias("__p"), "b.before", "b.end", "b.last")


def formatted(transcripts: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """transcripts with roles_found (array<string>) and rendered (string) from ``text``.

    Rows with conv_id and part are conversations whose text goes on from part to part; without these
    columns each row is one of its own.
    """
    bounded(transcripts.sparkSession)

    @F.pandas_udf("roles array<string>, rendered string")
    def parse(texts: pd.Series, before: pd.Series, end: pd.Series, last: pd.Series) -> pd.DataFrame:
        rows = []
        for t, b, e, z in zip(texts, before, end, last):
            lines = lines_of("\n\n" + (t or "") if b >= 0 else t)
            rows.append(render(lines, viterbi(features(lines), *model, before=b, end=e), b >= 0, z))
        return pd.DataFrame(rows, columns=["roles", "rendered"])

    kept = [c for c in transcripts.columns if c not in ("roles_found", "rendered")]
    if {"conv_id", "part"} <= set(kept):
        borders_of = table(_carried(transcripts, model), "borders")
        rows = transcripts.join(small(borders_of), F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("part") == F.col("__p")), "left")
    else:
        rows = transcripts.withColumns({"before": F.lit(None), "end": F.lit(None), "last": F.lit(None)})
    none = lambda c, v: F.coalesce(F.col(c).cast("int" if v else "boolean"), F.lit(v or True))
    out = rows.withColumn("__p", parse.asNondeterministic()("text", none("before", -1), none("end", -1), none("last", None)))
    return out.select(*kept, F.col("__p.roles").alias("roles_found"), F.col("__p.rendered").alias("rendered"))


def transcripts(turns: DataFrame, part: int = 256) -> DataFrame:
    """(conv_id, part, text, roles, n_lines): turns(conv_id, turn, role, text) written as raw transcripts.

    A conversation longer than ``part`` turns has several rows, by turn number. Two of three turns, chosen by
    hash, carry a marker, in one of four styles per conversation; the others only follow a blank line.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    names = [{"system": a, "user": b, "assistant": c} for a, b, c in (("System: ", "User: ", "Assistant: "), ("Instructions: ", "Human: ", "AI: "), ("Context: ", "Q: ", "A: "), ("[System] ", "[User] ", "[Bot] "))]
    mark = F.lit("")
    for i, by in enumerate(names):
        for role, m in by.items():
            mark = F.when((style == i) & (F.col("role") == role), m).otherwise(mark)
    said = F.coalesce("text", F.lit(""))
    line = F.concat(F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) > 0, mark).otherwise(F.lit("")), said)
    number = F.coalesce("turn", F.lit(0)).cast("long")
    one = turns.select("conv_id", number.alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), line.alias("line"), said.rlike(r"\S").alias("said"))
    one = one.withColumns({"part": F.floor(F.col("turn") / part), "n": F.size(F.filter(F.split("line", "\n"), lambda x: x.rlike(r"\S")))})
    spoken = F.when(F.col("said"), F.struct("turn", "role", "line", "n"))
    whole = one.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(spoken)).alias("t"))
    get = lambda f: F.transform("t", lambda x: x[f])
    return whole.select("conv_id", "part", F.array_join(get("line"), "\n\n").alias("text"), get("role").alias("roles"), get("n").alias("n_lines"))
