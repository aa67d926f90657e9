"""Line dedup over overlapping three-line windows, with DataFrame functions only.

A document's lines are its text cut at \\n; lines without a word are passed over (and stay). Every run
of three consecutive lines, compared after trimming, is a window. Windows found more than once in the
corpus keep their first occurrence, by doc_id (null first), text hash and position; the lines of all
later occurrences are removed, overlapping ones merged. What is removed thus stands in an earlier
place. A text of fewer lines has no window and does not change.

Nulls and edges: a null text stays null; rows that repeat doc_id and text are one document and each
get the same result; other columns pass through, and output columns replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbmark.core.tables import table

SPAN = 3


def _trimmed(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[\t-\r]", " "))


def _windows(docs: DataFrame, span: int) -> DataFrame:
    """(doc_id, th, at, lines, h1, h2): each window's 128-bit hash, the count of lines with words before
    it, and the indexes of its lines in the text."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), _trimmed(x).alias("t")))
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.filter(numbered, lambda x: x["t"] != "").alias("lines"))
    starts = lines.filter(F.size("lines") >= span).select("doc_id", "th", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - span)).alias("at"))
    parts = [F.get("lines", F.col("at") + i) for i in range(span)]
    hashes = [F.xxhash64(F.lit(seed), *(p["t"] for p in parts)).alias(h) for seed, h in ((1, "h1"), (2, "h2"))]
    return starts.select("doc_id", "th", "at", F.array(*(p["i"] for p in parts)).alias("lines"), *hashes)


def covered_lines(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, th, covered): for each document with repeats, the indexes of the lines to remove."""
    found = _windows(docs, span)
    place = F.struct("doc_id", "th", "at")
    repeated = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    later = found.join(repeated, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "th").agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("covered"))


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """docs with repeated windows removed from ``text``, and n_lines_removed (long)."""
    cover = table(covered_lines(docs, span).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("covered").alias("__gone")), "covered")
    names = [c for c in docs.columns if c != "n_lines_removed"]
    keyed = docs.select(*names, F.xxhash64("text").alias("__h"))
    joined = keyed.join(cover.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    joined = joined.withColumn("__lines", F.when(F.col("__gone").isNotNull(), lines))
    out = [text.alias("text") if c == "text" else F.col(c) for c in names]
    return joined.select(*out, F.greatest(F.coalesce(F.size("__gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_lines_removed"))


SQL = r"""
with l as materialized (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
m as materialized (select doc_id, i, line, trim(regexp_replace(line, '[\x09-\x0D]', ' ', 'g'), ' ') as t from l),
k as materialized (select doc_id, i, t, row_number() over (partition by doc_id order by i) - 1 as no from m where t <> ''),
w as materialized (select a.doc_id, a.no, a.t || chr(10) || b.t || chr(10) || c.t as win from k a join k b on b.doc_id = a.doc_id and b.no = a.no + 1 join k c on c.doc_id = a.doc_id and c.no = a.no + 2),
later as materialized (select doc_id, no, row_number() over (partition by win order by doc_id, no) as occurrence from w),
gone as materialized (select distinct doc_id, no + d.d as no from later cross join (values (0), (1), (2)) d(d) where occurrence > 1),
body as (
  select m.doc_id, string_agg(m.line, chr(10) order by m.i) filter (where g.no is null) as text, count(g.no)::bigint as n
  from m left join k using (doc_id, i) left join gone g on g.doc_id = m.doc_id and g.no = k.no group by m.doc_id)
select d.doc_id, case when b.doc_id is null then d.text else coalesce(b.text, '') end as text, coalesce(b.n, 0)::bigint as n_lines_removed
from documents d left join body b using (doc_id)
"""
