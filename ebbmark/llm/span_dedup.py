"""Substring dedup over sliding sentence spans.

A text is cut into sentences at line breaks and after ``.``, ``!`` or ``?`` before a blank; blanks that a
text begins with belong to its first sentence, but for a line break, which is a unit. A sentence of
more than PIECE words is cut further after every PIECE words from its start, so that a long one is several
units. Every run of RUN consecutive units is a span, whatever its length; it is compared lower-cased with
blanks collapsed. A span found more than once in the corpus keeps its first occurrence, by doc_id (null
first), text hash and position; the units of all other occurrences are removed, overlapping ones merged,
with the blanks that follow them. So a repeated passage is found from RUN of its units on: 3 sentences, or
one of more than 2 * PIECE words.

Spans travel as 128-bit hashes with their place. A span that a third of the corpus repeats is one row of
map-side minima; the minima are written, so that both sides of the join back to the places are plain
shuffles, which Spark splits where a key is hot.

Nulls and edges: a null text stays null, a blank one is one unit; rows that repeat doc_id and text are one
document and each get the same result; an empty table gives no rows; texts may be of any length; other
columns pass through, output columns replace those of the same name.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbmark.core.tables import table
from ebbmark.llm.batches import bounded

RUN, PIECE = 3, 16
_END = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
_PIECE = re.compile(rf"\s*(?:\S+\s+){{{PIECE}}}(?=\S)")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each unit; the end is the start of the next, so all of the text is covered."""
    cuts = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        while b - a > 2 * PIECE and (m := _PIECE.match(text, a, b)):
            out.append((a, m.end()))
            a = m.end()
        if a < b:
            out.append((a, b))
    return out


def spans(text: str) -> list[tuple[int, bytes]]:
    """(first unit, digest) of every span."""
    parts = [" ".join(text[a:b].lower().split()) for a, b in sentences(text)]
    return [(i, xxhash.xxh3_128_digest("\n".join(parts[i : i + RUN]).encode())) for i in range(len(parts) - RUN + 1)]


def _hasher():
    @F.pandas_udf("struct<h1:array<long>,h2:array<long>>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        found = [np.frombuffer(b"".join(x[1] for x in spans(t)) if t else b"", np.int64).reshape(-1, 2) for t in texts]
        return pd.DataFrame({"h1": [h[:, 0] for h in found], "h2": [h[:, 1] for h in found]})

    return cut.asNondeterministic()


def _cutter():
    @F.pandas_udf("struct<text:string,removed:array<struct<start:long,end:long>>>")
    def cut_out(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for t, g in zip(texts, gone):
            if t is None or g is None:
                rows.append((t, []))
                continue
            drop, keep, removed = set(g), [], []
            for i, (a, b) in enumerate(sentences(t)):
                if i not in drop:
                    keep.append(t[a:b])
                elif removed and removed[-1][1] == a:
                    removed[-1] = (removed[-1][0], b)
                else:
                    removed.append((a, b))
            rows.append(("".join(keep), removed))
        return pd.DataFrame(rows, columns=["text", "removed"])

    return cut_out.asNondeterministic()


def repeated_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, th, gone): the indexes of the units to remove, for each document that has any; th is the
    hash of the text."""
    bounded(docs.sparkSession)
    cut = docs.select("doc_id", F.xxhash64("text").alias("th"), _hasher()("text").alias("s"))
    rows = cut.select("doc_id", "th", F.posexplode(F.arrays_zip("s.h1", "s.h2")).alias("at", "x")).select("doc_id", "th", "at", "x.h1", "x.h2")
    rows = table(rows, "spans")
    # least id first, then the least place in it: plain minima that combine before the shuffle
    ids = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max(F.col("doc_id").isNull()).alias("has_null"))
    ids = table(ids.filter("n > 1").drop("n"), "repeats")
    in_first = F.when(F.col("has_null"), F.col("doc_id").isNull()).otherwise(F.col("doc_id") == F.col("first_id"))
    met = table(rows.join(ids, ["h1", "h2"]).select("doc_id", "th", "at", "h1", "h2", in_first.alias("in_first")), "met")
    place = F.struct("th", "at")
    first = table(met.filter("in_first").groupBy("h1", "h2").agg(F.min(place).alias("first")), "first")
    others = met.filter("not in_first").select("doc_id", "th", "at")
    later = met.filter("in_first").join(first, ["h1", "h2"]).filter(place != F.col("first")).select("doc_id", "th", "at")
    hit = others.unionByName(later).groupBy("doc_id", "th").agg(F.collect_set("at").alias("at"))
    return hit.select("doc_id", "th", F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x, x + RUN - 1)))).alias("gone"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated spans removed from ``text``; n_removed (units, long) and removed (code point ranges)."""
    gone = table(repeated_sentences(docs).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias("__gone")), "gone")
    names = [c for c in docs.columns if c not in ("n_removed", "removed")]
    keyed = docs.select(*names, F.xxhash64("text").alias("__h"))
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left")
    done = joined.withColumn("__x", _cutter()("text", "__gone"))
    out = [F.col("__x.text").alias("text") if c == "text" else F.col(c) for c in names]
    return done.select(*out, F.greatest(F.coalesce(F.size("__gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"), F.col("__x.removed").alias("removed"))


#: For texts whose blanks are ASCII; removed is start:end of each range.
SQL = r"""
with cut as materialized (
  select doc_id, list_filter(flatten(list_transform(
    string_split(regexp_replace(text, '([.!?]\s+|\s*\n\s*)', '\1' || chr(1), 'g'), chr(1)),
    lambda s: string_split(regexp_replace(s, '(\s*(?:\S+\s+){16})', '\1' || chr(1), 'g'), chr(1)))), lambda u: u <> '') as us
  from documents where text is not null),
unit as materialized (
  select doc_id, i, us[i] as u, trim(regexp_replace(lower(us[i]), '\s+', ' ', 'g'), ' ') as t from (select doc_id, us, unnest(range(1, len(us) + 1)) as i from cut)),
run as (select a.doc_id, a.i, a.t || chr(10) || b.t || chr(10) || c.t as s from unit a join unit b on b.doc_id = a.doc_id and b.i = a.i + 1 join unit c on c.doc_id = a.doc_id and c.i = a.i + 2),
later as (select doc_id, i, row_number() over (partition by s order by doc_id, i) as occurrence from run),
gone as materialized (select distinct doc_id, i + d.d as i from later cross join (values (0), (1), (2)) d(d) where occurrence > 1),
marked as materialized (
  select doc_id, i, u, g.i is not null as out, sum(length(u)) over (partition by doc_id order by i) as b, sum((g.i is null)::int) over (partition by doc_id order by i) as island
  from unit left join gone g using (doc_id, i)),
ranges as (select doc_id, min(b - length(u)) as a, max(b) as b from marked where out group by doc_id, island),
listed as (select doc_id, string_agg(a::varchar || ':' || b::varchar, ',' order by a) as removed from ranges group by doc_id),
body as (select doc_id, string_agg(u, '' order by i) filter (where not out) as text, count(*) filter (where out) as n from marked group by doc_id)
select d.doc_id, case when b.doc_id is null then d.text else coalesce(b.text, '') end as text, coalesce(b.n, 0)::bigint as n_removed, coalesce(l.removed, '') as removed
from documents d left join body b using (doc_id) left join listed l using (doc_id)
"""
