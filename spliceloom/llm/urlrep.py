"""URL filters: fixed rules first, then an empirical-Bayes host reputation.

DataFrame functions only. Labelled page outcomes (bad or not) are counted per host. A host's
rate of bad pages is shrunk towards its registered domain's, that towards its suffix's, and
that towards the rate of all labelled pages, each through a beta-binomial prior whose strength
is fitted by the method of moments over the level. A host is blocked when a lower bound of its
posterior rate exceeds a threshold.

Registered domain: the last two labels of the host. Suffix: its last label.

Defined results: a null url, or one without ``://``, has host and path ``''``; such pages share
the empty host, whose domain and suffix are empty too. A page with several outcome rows counts
each; a null outcome, and an outcome of no page, don't count. With no outcomes at all every
strength is its upper limit and every rate the neutral prior 1/2 of one pseudo-page, so nothing
is blocked while ``threshold`` is 0.5 or more. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceloom.session import written

#: (host and path as one string, verdict); the path starts at the first slash.
RULES: tuple[tuple[str, str], ...] = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Limits of a fitted prior strength, in pseudo-pages.
STRENGTH = (1.0, 1000.0)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.

    ``rules`` is a parameter of bounded length: it becomes one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        cut = text.index("/")
        h, p = text[:cut], text[cut:]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _level(counts: DataFrame, key: str) -> DataFrame:
    return counts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _strength(level: DataFrame) -> DataFrame:
    """One row: the beta-binomial strength that the spread of a level's rates implies."""
    n, b = F.col("n").cast("double"), F.col("bad").cast("double")
    s = level.filter("n > 0").agg(
        F.count("*").cast("double").alias("k"), F.sum(n).alias("sn"), F.sum(b).alias("sb"),
        F.sum(n * n).alias("snn"), F.sum(b * b / n).alias("sbb"),
    )
    p = F.col("sb") / F.col("sn")
    pq = p * (1 - p)
    spread = (F.col("sbb") - F.col("sb") * p - (F.col("k") - 1) * pq) / F.nullif(F.col("sn") - F.col("snn") / F.col("sn"), F.lit(0.0))
    m = F.when(spread > 0, pq / spread - 1).otherwise(F.lit(STRENGTH[1]))
    return s.select(F.coalesce(F.least(F.greatest(m, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])), F.lit(STRENGTH[1])).alias("m"))


def host_reputation(counts: DataFrame) -> DataFrame:
    """From (host, n, bad): every host with its posterior ``a`` and ``b``.

    All joins are between tables of hosts, domains and suffixes, never of pages; the fitted
    strengths and the overall rate are scalar subqueries of one row.
    """
    parts = F.split("host", r"\.")
    hosts = counts.withColumn("suffix", F.element_at(parts, -1)).withColumn(
        "domain", F.when(F.size(parts) > 1, F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(F.col("host"))
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = _level(domains, "suffix")
    overall = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("p"))
    m_s, m_d, m_h = (_strength(x).scalar() for x in (suffixes, domains, hosts.select("host", "n", "bad")))
    suffixes = suffixes.select("suffix", ((F.col("bad") + m_s * overall.scalar()) / (F.col("n") + m_s)).alias("p_s"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("bad") + m_d * F.col("p_s")) / (F.col("n") + m_d)).alias("p_d"))
    return hosts.join(domains, "domain").select(
        "host", (F.col("bad") + m_h * F.col("p_d")).alias("a"), (F.col("n") - F.col("bad") + m_h * (1 - F.col("p_d"))).alias("b")
    )


def lower_bound(a: Column, b: Column, z: float) -> Column:
    """Posterior mean less ``z`` standard deviations of Beta(a, b)."""
    return a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))


def url_filter(
    pages: DataFrame, outcomes: DataFrame, *, id_col: str = "page_id", url_col: str = "url", outcome_id: str = "page_id", outcome_bad: str = "bad",
    rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5, z: float = 1.645,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_bad_bound) of every page.

    ``outcomes`` holds a boolean ``outcome_bad`` per labelled page. Pages and outcomes meet in
    one join by id; pages and hosts in one join by host, whose hot keys adaptive execution
    splits. Host counts are summed before the shuffle.
    """
    seen = outcomes.filter(F.col(outcome_bad).isNotNull() & F.col(outcome_id).isNotNull()).groupBy(F.col(outcome_id).alias("o_id")).agg(
        F.count("*").alias("o_n"), F.sum(F.col(outcome_bad).cast("long")).alias("o_bad")
    )
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    counts = base.select("page_id", "host").join(seen, F.col("page_id") == F.col("o_id"), "left").groupBy("host").agg(
        F.coalesce(F.sum("o_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("o_bad"), F.lit(0)).alias("bad")
    )
    counts = written(counts, "host-counts")  # one row a host, read by every level
    bound = host_reputation(counts).select("host", lower_bound(F.col("a"), F.col("b"), z).alias("host_bad_bound"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    return base.join(bound, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("host_bad_bound") > threshold, "block").otherwise("allow")).alias("verdict"), "host_bad_bound",
    )


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page; a labelled page is bad if toxic or of low quality. ``labels`` go by page id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return url_filter(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


_STRENGTH_SQL = """(select coalesce(least(greatest(case when s > 0 then pq / s - 1 else 1000.0 end, 1.0), 1000.0), 1000.0) from (
  select p * (1 - p) as pq, (sbb - sb * p - (k - 1) * p * (1 - p)) / nullif(sn - snn / sn, 0) as s from (
    select *, sb / sn as p from (select count(*)::double k, sum(n)::double sn, sum(bad)::double sb, sum(n::double * n) snn,
      sum(bad::double * bad / n) sbb from {level} where n > 0))))"""

OP6_SQL = f"""
with base as (
  select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
seen as (select doc_id, count(*) o_n, sum(case when bad then 1 else 0 end) o_bad
  from (select doc_id, toxic = 1 or quality = 0 as bad from labels) where bad is not null and doc_id is not null group by doc_id),
hosts as (select *, string_split(host, '.')[-1] as suffix,
    case when len(string_split(host, '.')) > 1 then array_to_string(string_split(host, '.')[-2:], '.') else host end as domain
  from (select host, coalesce(sum(o_n), 0) n, coalesce(sum(o_bad), 0) bad from base left join seen on page_id = doc_id group by host)),
domains as (select domain, suffix, sum(n) n, sum(bad) bad from hosts group by domain, suffix),
suffixes as (select suffix, sum(n) n, sum(bad) bad from domains group by suffix),
st as (select {_STRENGTH_SQL.format(level="suffixes")} m_s, {_STRENGTH_SQL.format(level="domains")} m_d, {_STRENGTH_SQL.format(level="hosts")} m_h,
  (select (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) from suffixes) p),
rep as (select host, h.bad + m_h * p_d a, h.n - h.bad + m_h * (1 - p_d) b from hosts h join (
    select domain, m_h, (d.bad + m_d * p_s) / (d.n + m_d) p_d from domains d join (
      select suffix, (bad + m_s * p) / (n + m_s) p_s, m_d, m_h from suffixes, st) using (suffix)) using (domain)),
bound as (select host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound from rep),
ruled as (select *, case
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/7') then 'example.com/en/7'
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/de/8') then 'example.net/de/8'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/en/') then 'com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/de/') then 'net/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/es/') then 'org/es/' end as rule from base)
select page_id, host, path, rule, case
    when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 'block'
    when rule in ('example.com/en/7', 'net/de/') then 'allow'
    when bound > 0.5 then 'block' else 'allow' end as verdict
from ruled left join bound using (host)
"""
