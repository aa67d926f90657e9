"""URL filtering: fixed rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host. Beta-binomial priors shrink them down a hierarchy: the
corpus gives the prior of a public suffix, a suffix that of a registered domain, a domain that of a
host. A level's prior mean is the posterior mean of the level above; its strength is fitted by moments
from the spread of the rates of all units of the level (between 2 and 1000 pseudo-pages). A host is
blocked if the lower bound of its share of bad pages is over the limit: mean - z * sd of its beta
posterior, within 0.04 of the exact 5 % quantile for posteriors of ten pseudo-pages or more. So a host
with few labels is judged as its domain, and one without any by its domain alone.

A page's outcome is the label of the document that it shows, which its url names by number (outcomes_of).
A user name and a port count as parts of the host in results, and are left out of its domain; a host of
digits and dots is a domain and a suffix of its own; a public suffix has two labels if it ends in a
country's two letters after a label of SECOND.

Everything is counted over all labelled pages, one row per host after map-side sums; the joins on
domain and suffix carry one row per host or domain.

Rules: a rule fits its host and all subdomains if the url's path starts with the rule's path; the
longest wins. Nulls and edges: a url that is null or has no ``://`` has an empty host and path, no rule,
and is allowed; pages whose page_id repeats count once for each row; null outcomes are left out, and
repeated ones of a page count once, as bad if they disagree; rules of equal length go by host; an empty
table gives no rows, and without outcomes nothing but the rules blocks; further columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbmark.core.tables import small, table

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labels that make a public suffix together with a country's two letters.
SECOND = ("ac", "co", "com", "edu", "gov", "mil", "ne", "net", "or", "org")
LIMIT, Z = 0.5, 1.64
_BIG, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    plain = F.regexp_extract(rest, r"^([^?#]*)", 1)
    host = F.translate(F.regexp_extract(plain, r"^([^/]*)", 1), _BIG, _SMALL)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(plain, r"^[^/]*([\s\S]*)$", 1), F.lit(""))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule and rule_verdict (null if none fits). For lists of up to some hundred rules."""
    host, path = host_and_path(F.col("url"))
    out = pages.withColumns({"host": host, "path": path})
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return out.withColumns({"rule": none if rule is None else rule, "rule_verdict": none if verdict is None else verdict})


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): for pages whose url's path is a language and a document's number, that document's label."""
    number = F.regexp_extract("url", r"^[^:]*://[^/]*/[a-z]+/([0-9]{1,18})", 1)
    shown = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc_id")).filter("doc_id is not null")
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    return shown.join(known, "doc_id").select("page_id", "bad")


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    wide = name.rlike(rf"(^|\.)({'|'.join(SECOND)})\.[a-z][a-z]$")
    number = name.rlike(r"^[0-9.]+$")
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), 3), ".")
    size = F.when(wide, 2).otherwise(1)
    return F.when(number, name).otherwise(last(size + 1)), F.when(number, name).otherwise(last(size))


def _strength() -> Column:
    """Pseudo-pages of a level's prior, by moments over its units (n, bad, prior)."""
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2))
    expected = F.sum(F.col("prior") * (1 - F.col("prior")))
    pages = F.sum(F.col("n") * F.col("prior") * (1 - F.col("prior")))
    # E[n (rate - prior)^2] = prior (1 - prior) (1 + (n - 1) rho), and rho = 1 / (strength + 1)
    rho = (spread - expected) / F.nullif(pages - expected, F.lit(0.0))
    held = F.greatest(F.lit(1 / 1001), F.least(F.lit(1 / 3), F.coalesce(rho, F.lit(1 / 3))))
    return F.round(1 / held - 1, 9)


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, mean, bound) of every host of pages; outcomes is (page_id, bad as 0 or 1)."""
    host, _ = host_and_path(F.col("url"))
    known = outcomes.filter("bad is not null and page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = pages.select("page_id", host.alias("host")).join(known, "page_id", "left")
    hosts = seen.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = table(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # add-one keeps the corpus rate off 0 and 1
    corpus = suffixes.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("prior"))

    def posterior(units: DataFrame) -> DataFrame:
        level = units.filter("n > 0").agg(F.coalesce(_strength(), F.lit(2.0)).alias("k"))
        return units.withColumn("k", level.scalar()).withColumn("mean", (F.col("bad") + F.col("prior") * F.col("k")) / (F.col("n") + F.col("k")))

    top = posterior(suffixes.withColumn("prior", corpus.scalar())).select("suffix", F.col("mean").alias("prior"))
    mid = posterior(domains.join(top, "suffix")).select("domain", "suffix", F.col("mean").alias("prior"))
    low = posterior(hosts.join(mid, ["domain", "suffix"]))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("k") + 1))
    return low.select("host", "n", "bad", "mean", (F.col("mean") - Z * sd).alias("bound"))


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages(page_id, url)."""
    # the hosts' joins and the pages' share the host as key; copies of one host split as a skewed join
    known = table(reputation(pages, outcomes).select("host", (F.col("bound") > LIMIT).alias("bad_host")), "reputation")
    out = ruled(pages.select("page_id", "url"), rules).join(small(known), "host", "left")
    method = F.when((F.col("host") != "") & F.col("bad_host"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"))


_HOST = "coalesce(case when instr(url, '://') > 0 then translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end, '')"
_PATH = "coalesce(case when instr(url, '://') > 0 then regexp_extract(regexp_extract(substr(url, instr(url, '://') + 3), '^([^?#]*)', 1), '^[^/]*(.*)$', 1) else '' end, '')"
_K = """round(1 / greatest(1 / 1001.0::double, least(1 / 3.0::double, coalesce(
  (sum(n * pow(bad / n - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum(n * prior * (1 - prior)) - sum(prior * (1 - prior)), 0), 1 / 3.0::double))) - 1, 9)"""
_NUMBER = "case when regexp_extract(url, '^[^:]*://[^/]*/[a-z]+/([0-9]{1,18})', 1) <> '' then regexp_extract(url, '^[^:]*://[^/]*/[a-z]+/([0-9]{1,18})', 1)::bigint end"


def _level(name: str, source: str) -> str:
    return f"{name} as materialized (select u.*, (bad + prior * k) / (n + k) as mean, k from ({source}) u cross join (select coalesce({_K}, 2.0) as k from ({source}) where n > 0))"


SQL = f"""
with p as materialized (select page_id, {_HOST} as host, {_PATH} as path, {_NUMBER} as doc_id from pages),
known as (select doc_id, 1 - min(quality) as bad from labels where doc_id is not null group by doc_id),
outcome as materialized (select page_id, max(bad) as bad from p join known using (doc_id) where page_id is not null and bad is not null group by page_id),
h0 as (select host, count(o.bad) as n, coalesce(sum(o.bad), 0)::bigint as bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as name
  from p left join outcome o using (page_id) group by host),
h1 as (select *, string_split(name, '.') as ls, regexp_matches(name, '^[0-9.]+$') as number, case when regexp_matches(name, '(^|[.])({'|'.join(SECOND)})[.][a-z][a-z]$') then 2 else 1 end as size from h0),
hosts as materialized (select host, n, bad,
  case when number then name else array_to_string(ls[greatest(len(ls) - size + 1, 1):], '.') end as suffix,
  case when number then name else array_to_string(ls[greatest(len(ls) - size, 1):], '.') end as domain from h1),
domains as materialized (select domain, suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from hosts group by all),
suffixes as materialized (select suffix, sum(n)::bigint as n, sum(bad)::bigint as bad from domains group by all),
{_level("top", "select *, (select (sum(bad) + 1) / (sum(n) + 2) from suffixes) as prior from suffixes")},
{_level("mid", "select d.*, t.mean as prior from domains d join top t using (suffix)")},
{_level("low", "select h.*, m.mean as prior from hosts h join mid m using (domain, suffix)")},
v as (select host, mean - {Z} * sqrt(mean * (1 - mean) / (n + k + 1)) > {LIMIT} as bad_host from low),
r as (select page_id, host, path, case
  when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
  when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
  when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
  when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule from p)
select page_id, r.host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
  when r.host <> '' and bad_host then 'block' else 'allow' end as verdict from r join v using (host)
"""
