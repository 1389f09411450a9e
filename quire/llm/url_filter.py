"""URL filter: rules first, else the host's reputation by empirical Bayes.

Labelled page outcomes (bad or not) are counted per host. Counts shrink
through beta-binomial priors from suffix to registered domain to host: each
level's mean is the prior mean of the level below, with a concentration fitted
by moments. A host is blocked if the lower bound of its posterior bad rate
exceeds a threshold. Everything is built-in DataFrame functions; only hosts,
not pages, take part in the model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, materialize, table

#: (verdict, host and path prefix)
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Suffixes of two labels under which names are registered; a parameter of ``reputation``.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "com.br", "co.in", "co.za", "com.mx", "com.cn")
THRESHOLD, Z = 0.5, 1.645

_ADDRESS = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _domain(host: Column, two_label: tuple[str, ...]) -> Column:
    """Registered domain: the suffix and one label more; user part and port do not count. An IPv4 address is its own."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    last_two = F.substring_index(bare, ".", -2)
    return F.when(bare.rlike(_ADDRESS), bare).when(last_two.isin(*two_label), F.substring_index(bare, ".", -3)).otherwise(last_two)


def _concentration(groups: DataFrame, prior: str) -> float:
    """Moment estimate of a beta-binomial's concentration around given prior means (weights: group sizes); a prior weighs one page at least."""
    p, m = F.col("k") / F.col("n"), F.col(prior)
    rows = groups.where("n > 0")
    n = rows.agg(F.sum("n")).first()[0]
    if not n:
        return 10.0
    w = F.col("n") / F.lit(float(n))
    spread = m * (1 - m) * w * (1 - w)
    s, within, between = rows.agg(F.sum(w * (p - m) * (p - m)), F.sum(spread / F.col("n")), F.sum(spread - spread / F.col("n"))).first()
    if not between or between <= 0:
        return 10.0
    share = min(max((s - within) / between, 1e-3), 0.5)
    return 1 / share - 1


def reputation(hosts: DataFrame, *, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """Posterior per host from ``hosts`` (host, k bad, n labelled): adds domain, suffix, mean, lower, blocked.

    Hosts without a label take their domain's posterior as prior, and so on up
    to the overall rate; without any label at all that rate is 0.5. ``hosts``
    holds each host once.
    """
    hosts = hosts.withColumn("domain", _domain(F.col("host"), two_label))
    hosts = hosts.withColumn("suffix", F.when((F.instr("domain", ".") > 0) & ~F.col("domain").rlike(_ADDRESS), F.expr("substring(domain, instr(domain, '.') + 1)")).otherwise(F.col("domain")))
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n")), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n")), "suffixes")
    k, n = suffixes.agg(F.sum("k"), F.sum("n")).first()
    overall = (k or 0) / n if n else 0.5
    suffixes = suffixes.withColumn("prior", F.lit(overall))
    c = _concentration(suffixes, "prior")
    suffixes = materialize(suffixes.select("suffix", ((F.col("k") + c * F.col("prior")) / (F.col("n") + c)).alias("prior")), "suffix-means")
    domains = materialize(lookup_join(domains, suffixes, "suffix"), "domain-priors")
    c = _concentration(domains, "prior")
    domains = materialize(domains.select("domain", ((F.col("k") + c * F.col("prior")) / (F.col("n") + c)).alias("prior")), "domain-means")
    hosts = materialize(lookup_join(hosts, domains, "domain"), "host-priors")
    c = _concentration(hosts, "prior")
    mean = (F.col("k") + c * F.col("prior")) / (F.col("n") + c)
    hosts = hosts.withColumn("mean", mean)
    lower = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + c + 1))
    return hosts.withColumn("lower", lower).withColumn("blocked", F.col("lower") > threshold)


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, *, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """Judge each row of ``pages`` (page_id, url): host, path, rule, verdict, posterior mean and lower bound.

    ``outcomes`` (page_id, bad) labels some pages; of repeated labels the worst
    counts, and each page row counts once. Null urls and urls without ``://``
    have empty host and path and are judged as one host. A rule fits its host
    and all subdomains if the path starts with the rule's; the longest rule
    wins, among equally long ones that with the longer host. Rows keep their
    number; extra columns are not read.
    """
    spark = pages.sparkSession
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    worst = outcomes.where("bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    counted = seen.select("page_id", "host").join(worst, "page_id", "left")
    hosts = counted.groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("k"), F.count("bad").alias("n"))
    known = reputation(materialize(hosts, "hosts"), threshold=threshold, z=z).select("host", "mean", "lower", "blocked")
    known = materialize(known.join(_rules_of(known.select("host"), rules, spark), "host", "left"), "host-verdicts")
    got = lookup_join(seen, known, "host")
    got = got.withColumn("hit", F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0)))
    return got.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"), "mean", "lower")


def _rules_of(hosts: DataFrame, rules, spark) -> DataFrame:
    """For each host its fitting rules, longest first. Hosts are expanded to their suffixes of as many labels as some rule has, never paired with all rules."""
    rows = [(r.split("/", 1)[0], "/" + r.split("/", 1)[1] if "/" in r else "", r, v) for v, r in rules]
    listed = spark.createDataFrame(rows, "suffix string, path string, rule string, verdict string")
    depths = sorted({r[0].count(".") + 1 for r in rows})
    last = F.array_distinct(F.array(*(F.substring_index("host", ".", -d) for d in depths)))
    suffixes = hosts.where("host <> ''").select("host", F.explode(last).alias("suffix"))
    item = F.struct((-F.length("rule")).alias("n"), (-F.length("suffix")).alias("h"), "path", "rule", "verdict")
    return suffixes.join(listed, "suffix").groupBy("host").agg(F.sort_array(F.collect_list(item)).alias("rules"))


def op2_url_reputation(spark, sf_dir):
    """Contract: page_id, host, path, rule, verdict of every page; outcomes are the labels under the page's number (quality 0 is bad)."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    judged = judge_urls(table(spark, sf_dir, "pages"), outcomes)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _level(name: str, groups: str, prior: str) -> str:
    """SQL for one level's concentration, the same formula as ``_concentration``."""
    return f"""{name}_sum as (select sum(n) as total from {groups}),
{name}_moments as (
  select sum(w * (p - m) * (p - m)) as s, sum(m * (1 - m) * w * (1 - w) / n) as within,
         sum(m * (1 - m) * w * (1 - w) - m * (1 - m) * w * (1 - w) / n) as between
  from (select n, n / total::double as w, k / n::double as p, {prior} as m from {groups}, {name}_sum where n > 0)),
{name}_c as (select case when between is null or between <= 0 then 10.0
  else 1 / least(greatest((s - within) / between, 1e-3), 0.5) - 1 end as c from {name}_moments)"""


def oracle() -> str:
    two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    rules = ", ".join(f"('{v}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{r}')" for v, r in RULES)
    return f"""
with seen as (
  select page_id,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') as host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
worst as (select doc_id as page_id, max(case when quality = 0 then 1 else 0 end) as bad from labels where quality is not null group by doc_id),
counted as (select host, coalesce(sum(bad), 0) as k, count(bad) as n from seen left join worst using (page_id) group by host),
plain as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as bare from counted),
bare as (select *, string_split(bare, '.') as parts from plain),
named as (select *, case when regexp_matches(bare, '{_ADDRESS}') then bare when array_to_string(parts[-2:], '.') in ({two}) then array_to_string(parts[-3:], '.') else array_to_string(parts[-2:], '.') end as domain from bare),
hosts as (select host, k, n, domain, case when contains(domain, '.') and not regexp_matches(domain, '{_ADDRESS}') then substr(domain, instr(domain, '.') + 1) else domain end as suffix from named),
domains as (select domain, suffix, sum(k) as k, sum(n) as n from hosts group by domain, suffix),
suffixes as (select suffix, sum(k) as k, sum(n) as n from domains group by suffix),
overall as (select case when sum(n) > 0 then sum(k) / sum(n)::double else 0.5 end as m0 from suffixes),
suffixes0 as (select suffix, k, n, m0 from suffixes, overall),
{_level("s", "suffixes0", "m0")},
suffixes1 as (select suffix, (k + c * m0) / (n + c) as m1 from suffixes0, s_c),
domains1 as (select domain, k, n, m1 from domains join suffixes1 using (suffix)),
{_level("d", "domains1", "m1")},
domains2 as (select domain, (k + c * m1) / (n + c) as m2 from domains1, d_c),
hosts2 as (select host, k, n, m2 from hosts join domains2 using (domain)),
{_level("h", "hosts2", "m2")},
judged as (select host, mean - {Z} * sqrt(mean * (1 - mean) / (n + c + 1)) > {THRESHOLD} as blocked
  from (select host, n, c, (k + c * m2) / (n + c) as mean from hosts2, h_c)),
rules(verdict, rhost, rpath, rule) as (values {rules}),
fits as (
  select page_id, seen.host, seen.path, rule, verdict,
    row_number() over (partition by page_id order by length(rule) desc, length(rhost) desc) as place
  from seen left join rules on (seen.host = rhost or ends_with(seen.host, '.' || rhost)) and starts_with(seen.path, rpath))
select page_id, host, path, rule, coalesce(verdict, case when blocked then 'block' else 'allow' end) as verdict
from fits join judged using (host) where place = 1
"""
