"""MinHash near-duplicates by a signature-coordinate inverted join.

Every distinct shingle set (class) is posted under each of its coordinate-value pairs. A pair of
classes is a candidate if it collides on at least ``matches`` of ``coords`` coordinates, found as in
a T-occurrence merge: a class is posted only under its rarest ``len - matches + 1`` keys (prefix), and
the common keys that are skipped there are counted from the two key lists when a candidate meets.
A candidate must also pass a bitmap test: shingles are hashed to 1024 parity bits, and two sets differ
in at least as many shingles as their bitmaps differ in bits, so no link fails it. What passes is
confirmed on the full shingle sets of the whole texts.

Groups of copies do not become all pairs. Equal sets are one class. Each class is first tried against
up to three leaders: of every posting list the class whose keys are the most common (the text most like
the others). What that links is one component, and later only classes of different components meet.

Texts that share a template but stay under the threshold fill posting lists without becoming a component.
A list with more than ``CROWD`` classes outside its largest component compares no pairs: its classes are
signed again with 256 coordinates, of which a link needs 172, and meet in the same way under these keys.
Unrelated parts of two texts then rarely reach the threshold, and a text's own parts are rare keys that
leave its prefix without the template's.

At similarity 0.8 a pair reaches fewer than 13 of 32 matches, or 172 of 256, with probability below 1e-6
each; that is the only way to lose a link.

Nulls and edges: a null or blank text has no set (n_shingles 0) and is linked with nothing; a text of
fewer words than a shingle is one shingle; null doc_ids are kept, never chosen as component_id unless
all in the component are null; repeated rows each get a row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbmark.core.tables import small, table
from ebbmark.llm.batches import bounded, held
from ebbmark.llm.components import components
from ebbmark.llm.words import WordHashes, shingles

BLOCK, LEADERS, SALTS = 512, 3, 16
#: Classes outside the largest component of a posting list up to which its pairs are compared.
CROWD = 256
#: Coordinates of the second signature.
FINE = 256
#: Keys of a coordinate whose counts reach the posts without a join.
TOPS = 4
#: 64-bit words of a parity bitmap.
WORDS = 16


def _signer(k: int, coords: int):
    rng = np.random.default_rng(20240229)
    mul = rng.integers(1, 2**63, coords, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, coords, dtype=np.uint64)
    place = np.arange(coords, dtype=np.int64) << 32

    @F.pandas_udf("n_shingles long, cls binary, keys array<long>, bits array<long>")
    def sign(texts: pd.Series) -> pd.DataFrame:
        cache = held(WordHashes)
        sets = [shingles(cache.of(t.encode().lower().split()), k) if t else shingles(np.empty(0, np.uint64), k) for t in texts]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        full = np.flatnonzero(sizes)
        keys = np.empty((len(full), coords), np.int64)
        if len(full):
            flat = np.concatenate([sets[i] for i in full])
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            for c in range(coords):
                low = np.minimum.reduceat((flat * mul[c] + add[c]) >> np.uint64(32), starts)
                keys[:, c] = low.astype(np.int64) + place[c]
        row = iter(keys)
        return pd.DataFrame(
            {
                "n_shingles": sizes,
                "cls": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "keys": [next(row) if n else None for n in sizes],
                "bits": [np.packbits(np.bincount((x >> np.uint64(20)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1).view(np.int64) if len(x) else None for x in sets],
            }
        )

    return sign.asNondeterministic()


def _confirmer(k: int, percent: int):
    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        cache, seen = held(WordHashes), {}

        def of(t: str) -> np.ndarray:
            if t not in seen:
                seen[t] = shingles(cache.of(t.encode().lower().split()), k)
            return seen[t]

        def test(a: np.ndarray, b: np.ndarray) -> bool:
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                return False
            both = len(np.intersect1d(a, b, assume_unique=True))
            return 100 * both >= percent * (len(a) + len(b) - both)

        return pd.Series([test(of(a), of(b)) for a, b in zip(left, right)], dtype=bool)

    return linked.asNondeterministic()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, coords: int = 32, matches: int = 13) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) for each row of docs(doc_id, text).

    Links texts whose shingle sets overlap by ``percent`` of their union or more. component_id is the
    smallest doc_id reachable; kept marks the rows with doc_id = component_id.
    ``text_key`` is a hash pair of the text.
    """
    spark = bounded(docs.sparkSession)
    texts = docs.select("doc_id", "text", F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b")).alias("text_key"))
    signed = table(texts.select("doc_id", "text_key", _signer(shingle, coords)("text").alias("s")).select("doc_id", "text_key", "s.*"), "signed")
    # min over a struct picks one row of the class; doc_id stands apart as nulls must not win
    classes = table(
        signed.filter("cls is not null")
        .groupBy("cls")
        .agg(F.min("doc_id").alias("first_id"), F.min(F.struct("text_key", "n_shingles", "keys", "bits")).alias("one"))
        .select(F.monotonically_increasing_id().alias("v"), "cls", "first_id", "one.*"),
        "classes",
    )
    signed = signed.drop("keys", "bits")
    lists = _lists(classes, classes, matches)
    confirm = _confirmer(shingle, percent)

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = table(pairs, "pairs")
        at = table(_texts_of(texts, classes, pairs.select(F.explode(F.array("x", "y")).alias("v")).distinct()), "texts")
        left, right = at.select(F.col("v").alias("x"), F.col("text").alias("tx")), at.select(F.col("v").alias("y"), F.col("text").alias("ty"))
        return table(pairs.join(left, "x").join(right, "y").filter(confirm("tx", "ty")).select("x", "y"), "links")

    first = confirmed(_tries(lists, percent))
    comp = components(first)
    pairs, crowded = _across(lists, comp, matches, percent, CROWD)
    if crowded.limit(1).count():
        least = _fewest(FINE, percent)
        again = _texts_of(texts, classes, crowded).select("v", _signer(shingle, FINE)("text")["keys"].alias("keys"))
        pairs = pairs.unionByName(_across(_lists(table(again, "fine"), classes, least), comp, least, percent)[0]).distinct()
    comp = components(first.unionByName(confirmed(pairs)))

    # linked classes and rows with a set meet their least id; the others never enter a join under a null key
    own = classes.select("v", "cls", "first_id")
    linked = own.join(comp, "v").withColumn("salt", F.pmod("v", F.lit(SALTS)).cast("int"))
    least = linked.groupBy("comp").agg(F.min("first_id").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = linked.join(table(least, "least"), ["comp", "salt"]).select("cls", "least")
    named = table(named.unionByName(own.join(comp, "v", "left_anti").select("cls", F.col("first_id").alias("least"))), "named")
    rows = signed.filter("cls is not null").join(named, "cls").select("doc_id", "text_key", "n_shingles", F.col("least").alias("component_id"))
    rows = rows.unionByName(signed.filter("cls is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id")))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _fewest(coords: int, percent: int) -> int:
    """The most matches that two texts at the threshold miss with probability below 1e-6."""
    p, below, t = percent / 100, 0.0, 0
    while (below := below + math.comb(coords, t) * p**t * (1 - p) ** (coords - t)) < 1e-6:
        t += 1
    return t


def _lists(keyed: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """(v, posted, common, size, bits) of keyed(v, keys): keys that two classes or more have, rarest first.

    Classes with fewer than ``matches`` such keys link with none and are left out.
    """
    # counts are written before they meet the posts: then both sides are plain shuffles, split where a key is hot
    counts = table(keyed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    # the TOPS most common keys of each coordinate go to the posts as a small constant, all others by a join
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("n"), "key"))
    found = counts.withColumn("at", F.shiftright("key", 32).cast("int")).withColumn("rank", rank).filter(F.col("rank") <= TOPS).collect()
    tops = [[] for _ in range(max((r["at"] for r in found), default=-1) + 1)]
    for r in found:
        tops[r["at"]].append((r["n"], r["key"]))
    known = keyed.sparkSession.createDataFrame([(tops,)], "tops array<array<struct<n: bigint, key: bigint>>>")
    of = F.transform("keys", lambda k, at: F.filter(F.coalesce(F.get("tops", at), F.array().cast("array<struct<n: bigint, key: bigint>>")), lambda t: t["key"] == k))
    keyed = keyed.select("v", "keys").crossJoin(F.broadcast(known)).select("v", "keys", F.flatten(of).alias("top"))
    posts = keyed.select("v", F.explode(F.array_except("keys", "top.key")).alias("key"))
    rest = posts.join(counts, "key").groupBy("v").agg(F.collect_list(F.struct("n", "key")).alias("rest"))
    posted = F.array_sort(F.when(F.col("rest").isNull(), F.col("top")).otherwise(F.concat("top", "rest")))
    lists = keyed.select("v", "top").join(rest, "v", "left").select("v", posted.alias("posted"))
    lists = lists.withColumn("common", F.aggregate("posted.n", F.lit(0).cast("long"), lambda total, n: total + n))
    return table(lists.filter(F.size("posted") >= matches).join(classes.select("v", F.col("n_shingles").alias("size"), "bits"), "v"), "lists")


def _texts_of(texts: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(v, text): one whole text for each class in ids(v)."""
    need = table(classes.select("v", "text_key").join(ids, "v"), "need")
    return texts.select("text_key", "text").join(small(need), "text_key").dropDuplicates(["v"]).select("v", "text")


def _may_link(left: str, right: str, percent: int) -> Column:
    """The bitmap test: |A xor B| <= (|A| + |B|) (100 - percent) / (100 + percent)."""
    differ = sum((F.bit_count(F.get(f"{left}bits", F.lit(i)).bitwiseXOR(F.get(f"{right}bits", F.lit(i)))) for i in range(WORDS)), F.lit(0))
    return differ * (100 + percent) <= (F.col(f"{left}size") + F.col(f"{right}size")) * (100 - percent)


def _tries(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of each class with the leaders that it collides with most."""
    posts = lists.select("v", "common", F.explode("posted.key").alias("key"))
    heads = table(posts.groupBy("key").agg(F.max(F.struct("common", "v")).alias("head")).select("key", F.col("head.v").alias("u")), "heads")
    hits = posts.join(heads, "key").filter("u <> v").groupBy("v", "u").agg(F.count("*").alias("hits"))
    best = hits.groupBy("v").agg(F.slice(F.sort_array(F.collect_list(F.struct("hits", "u")), asc=False), 1, LEADERS).alias("best"))
    pairs = best.select("v", F.explode("best.u").alias("u")).select(F.least("v", "u").alias("x"), F.greatest("v", "u").alias("y")).distinct()
    side = lambda k: lists.select(F.col("v").alias(k), F.col("bits").alias(f"{k}_bits"), F.col("size").alias(f"{k}_size"))
    return pairs.join(side("x"), "x").join(side("y"), "y").filter(_may_link("x_", "y_", percent)).select("x", "y")


def _across(lists: DataFrame, comp: DataFrame, matches: int, percent: int, crowd: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs (x, y) of classes with different comp, and the classes (v) of crowded lists.

    Within a posting list the largest component meets all others but not itself, so a list that one
    group of copies fills costs its other members times its length; both sides are dealt in blocks.
    Lists with more than ``crowd`` classes outside the largest component give no pairs here.
    A class is in as many lists as its prefix has keys, so what travels there is its bitmap; all its keys
    are joined only to the pairs that pass the bitmap test, each of them once.
    """
    rows = lists.join(comp, "v", "left").select(
        "v",
        F.coalesce("comp", "v").alias("comp"),
        "bits",
        "size",
        F.explode(F.slice("posted.key", 1, F.size("posted") - F.lit(matches - 1))).alias("key"),
    )
    sizes = (
        rows.groupBy("key", "comp")
        .agg(F.count("*").alias("n"))
        .groupBy("key")
        .agg(F.sum("n").alias("m"), F.count("*").alias("groups"), F.max(F.struct("n", "comp")).alias("top"))
        .filter("groups > 1")
        .select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"), F.col("top.comp").alias("main"), (F.col("m") - F.col("top.n")).alias("others"))
    )
    sizes = table(sizes, "sizes")
    full = F.lit(False) if crowd is None else F.col("others") > crowd
    crowded = table(rows.select("v", "key").join(sizes.filter(full).select("key"), "key").select("v").distinct(), "crowded")
    mixed = table(rows.join(sizes.filter(~full).drop("others"), "key"), "mixed")
    right = mixed.select("key", F.pmod(F.xxhash64("v"), "blocks").cast("int").alias("block"), *(F.col(c).alias(f"r_{c}") for c in ("v", "comp", "bits", "size", "main")))
    left = mixed.filter("comp <> main").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *(F.col(c).alias(f"l_{c}") for c in ("v", "comp", "bits", "size")))
    meets = (F.col("l_comp") != F.col("r_comp")) & ((F.col("r_comp") == F.col("r_main")) | (F.col("l_v") < F.col("r_v")))
    met = left.join(right, ["key", "block"]).filter(meets & _may_link("l_", "r_", percent)).select(F.least("l_v", "r_v").alias("x"), F.greatest("l_v", "r_v").alias("y"))
    side = lambda k: lists.select(F.col("v").alias(k), F.col("posted.key").alias(f"{k}_keys"))
    alike = F.size(F.array_intersect("x_keys", "y_keys")) >= matches
    return table(met.distinct(), "met").join(side("x"), "x").join(side("y"), "y").filter(alike).select("x", "y"), crowded


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that near_duplicates() keeps: one document of each group, its columns unchanged.

    Rows that repeat the kept doc_id and text are one document; one of them stays.
    """
    found = table(near_duplicates(docs, **how).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "kept"), "found")
    keyed = docs.withColumn("__k", F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__key"))
    stays = keyed.join(small(found.filter("not kept").select("__id", "__key").distinct()), same, "left_anti")
    repeated = found.filter("kept").groupBy("__id", "__key").count().filter("count > 1").drop("count")
    if repeated.limit(1).count():
        once = stays.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__k"])
        stays = stays.join(repeated, same, "left_anti").unionByName(once)
    return stays.select(*docs.columns)


SQL = r"""
with recursive w as materialized (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') as ws
  from documents),
sh as materialized (
  select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as s from w),
n as materialized (select doc_id, len(s)::bigint as n from sh),
e as materialized (select doc_id, unnest(s) as s from sh),
links as materialized (
  select x.doc_id as a, y.doc_id as b from e x join e y on x.s = y.s and x.doc_id <> y.doc_id
  join n nx on nx.doc_id = x.doc_id join n ny on ny.doc_id = y.doc_id
  group by x.doc_id, y.doc_id, nx.n, ny.n having 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
reach as (select doc_id as a, doc_id as c from documents union select l.b, r.c from reach r join links l on l.a = r.a),
comp as (select a as doc_id, min(c) as component_id from reach group by a)
select n.doc_id, n.n as n_shingles, comp.component_id, n.doc_id = comp.component_id as kept from n join comp using (doc_id)
"""
