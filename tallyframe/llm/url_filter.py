"""URL filters by rules and empirical-Bayes host reputation; DataFrame operations only.

Pages that a rule decides are the labelled outcomes (blocked or allowed). Their blocked shares are shrunk through
beta-binomial priors: suffixes toward the whole, registered domains toward their suffix, hosts toward their domain. How
many pages a level's prior weighs is estimated from the level's own counts: by moments, from the spread of its groups
around their parents beyond binomial noise. A parent's share isn't known either: its posterior variance goes down to its
children, by the square of the weight that the prior has in their means, so a host without pages is no surer than what
is known of its domain or suffix. A page without a rule is blocked if its host's posterior share is above the threshold
even at its lower bound, DEVIATIONS posterior deviations below the mean. By Cantelli's inequality the share lies above that
with a probability of 1 - 1 / (1 + DEVIATIONS^2) = 0.8 at least, however few pages there are.

Defined cases: where no page under a suffix is labelled, nothing but other suffixes speaks about it, and its pages are allowed; a null url, or one without `://`, has an empty host and path and no rule; it is judged like any host
without labelled pages, by the prior of its level above. Without labelled pages every page is allowed. Repeated rows are
judged alike, and count as often as they stand in the table. A host without a dot is its own domain and suffix. A level
whose groups don't differ beyond noise, or without labelled pages, has the strongest prior, MOST_PAGES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lower_az

RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Deviations below the mean for the bound, and share from which a host is blocked.
DEVIATIONS, BLOCK_SHARE = 2.0, 0.5
#: Bounds of the pages that a level's prior weighs.
LEAST_PAGES, MOST_PAGES = 1.0, 1000.0
#: Suffixes of two labels under which domains are registered (fixed values, a parameter of the operator).
TWO_LABEL_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "com.br", "com.cn", "co.in", "co.jp", "ne.jp", "or.jp", "co.kr", "com.mx", "co.nz", "com.tr", "co.za")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null or a url without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = lower_az(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        fits = (F.concat(F.lit("."), host).endswith("." + name)) & path.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def suffix_and_domain(host: Column, two_labels=TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Public suffix (the last label, or two that are listed) and registered domain (one label more)."""
    last = [F.substring_index(host, ".", -k) for k in (1, 2, 3)]
    listed = last[1].isin(*two_labels)
    return F.when(listed, last[1]).otherwise(last[0]), F.when(listed, last[2]).otherwise(last[1])


def prior_pages(groups: DataFrame) -> DataFrame:
    """One row: pages that the prior of a level weighs. groups: n, k and parent (the share of the level above).

    With a correlation r of the outcomes in a group, (k - n p)^2 has the mean n p (1 - p) (1 + (n - 1) r), and the prior
    weighs 1 / r - 1 pages.
    """
    noise = F.col("n") * F.col("parent") * (1 - F.col("parent"))
    excess = F.sum(F.pow(F.col("k") - F.col("n") * F.col("parent"), 2) - noise)
    room = F.sum(noise * (F.col("n") - 1))
    pages = F.when((room > 0) & (excess > 0), room / excess - 1).otherwise(MOST_PAGES)
    return groups.agg(F.least(F.greatest(pages, F.lit(LEAST_PAGES)), F.lit(MOST_PAGES)).alias("pages"))


def shrink_level(groups: DataFrame) -> DataFrame:
    """groups (n, k, and the parent's share and variance) with their posterior share and variance."""
    held = groups.crossJoin(F.broadcast(prior_pages(groups)))
    held = held.withColumn("share", (F.col("k") + F.col("pages") * F.col("parent")) / (F.col("n") + F.col("pages")))
    own = F.col("share") * (1 - F.col("share")) / (F.col("n") + F.col("pages") + 1)
    return held.withColumn("variance", own + F.pow(F.col("pages") / (F.col("n") + F.col("pages")), 2) * F.col("parent_variance"))


def host_reputation(hosts: DataFrame, two_labels=TWO_LABEL_SUFFIXES) -> DataFrame:
    """host, share, low, known: posterior mean and lower bound of the blocked share, and the labelled pages under its suffix.

    hosts: host, n (labelled pages), k (blocked).
    """
    ending, domain = suffix_and_domain(F.col("host"), two_labels)
    hosts = hosts.select("host", "n", "k", domain.alias("domain"), ending.alias("suffix"))
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    above = lambda df, *keys: df.select(*keys, F.col("share").alias("parent"), F.col("variance").alias("parent_variance"))
    rate = F.coalesce(F.sum("k") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0))
    whole = hosts.agg(rate.alias("parent"), (rate * (1 - rate) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("parent_variance"))
    suffixes = shrink_level(hosts.groupBy("suffix").agg(*sums).crossJoin(F.broadcast(whole)))
    domains = shrink_level(hosts.groupBy("domain", "suffix").agg(*sums).join(above(suffixes, "suffix"), "suffix"))
    judged = shrink_level(hosts.join(above(domains, "domain"), "domain")).join(suffixes.select("suffix", F.col("n").alias("known")), "suffix")
    return judged.select("host", "share", (F.col("share") - DEVIATIONS * F.sqrt("variance")).alias("low"), "known")


def filter_urls(pages: DataFrame, rules=RULES, id: str = "page_id", url: str = "url", two_labels=TWO_LABEL_SUFFIXES) -> DataFrame:
    """id, host, path, rule, verdict for each row of pages.

    Counts by host are combined in each task before the shuffle. Only pages without a rule are joined to the hosts.
    """
    host, path = split_url(F.col(url))
    parts = pages.select(F.col(id).alias("i"), host.alias("host"), path.alias("path"))
    ruled = parts.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    ruled = ruled.select(F.col("i").alias(id), "host", "path", "found.rule", "found.verdict")
    hosts = ruled.groupBy("host").agg(F.count("verdict").alias("n"), F.count_if(F.col("verdict") == "block").alias("k"))
    blocked = checkpointed(host_reputation(checkpointed(hosts), two_labels).where((F.col("low") > BLOCK_SHARE) & (F.col("known") > 0)).select("host", F.lit("block").alias("method")))
    return ruled.join(blocked, "host", "left").select(id, "host", "path", "rule", F.coalesce("verdict", "method", F.lit("allow")).alias("verdict"))


def rule_sql(host: str, path: str, rules=RULES) -> tuple[str, str]:
    """CASE expressions of SQL for the longest rule and its verdict."""
    arms = [[], []]
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        fits = f"('.' || {host}) LIKE '%.{name}' AND starts_with({path}, '{slash}{start}')"
        for arm, value in zip(arms, (rule, verdict), strict=True):
            arm.append(f"WHEN {fits} THEN '{value}'")
    return f"CASE {' '.join(arms[0])} END", f"CASE {' '.join(arms[1])} END"


RULE_SQL, VERDICT_SQL = rule_sql("host", "path")
LAST = lambda k: f"array_to_string(list_slice(string_split(host, '.'), -{k}, -1), '.')"
LISTED = f"{LAST(2)} IN ({', '.join(repr(x) for x in TWO_LABEL_SUFFIXES)})"


def level_sql(name: str) -> str:
    """Two named queries: the pages that the prior of a level weighs, and its shares."""
    noise = "n * parent * (1 - parent)"
    excess, room = f"sum(pow(k - n * parent, 2) - {noise})", f"sum({noise} * (n - 1))"
    return f"""{name}_prior AS (SELECT least(greatest(CASE WHEN {room} > 0 AND {excess} > 0 THEN {room} / {excess} - 1 ELSE {MOST_PAGES} END, {LEAST_PAGES}), {MOST_PAGES}) AS pages FROM {name}),
{name}_means AS (SELECT *, (k + pages * parent) / (n + pages) AS share FROM {name}, {name}_prior),
{name}_shares AS (SELECT *, share * (1 - share) / (n + pages + 1) + pow(pages / (n + pages), 2) * above AS variance FROM {name}_means)"""


ORACLE_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
ruled AS (SELECT page_id, host, path, {RULE_SQL} AS rule, {VERDICT_SQL} AS decided FROM parts),
counts AS (
  SELECT host, CASE WHEN {LISTED} THEN {LAST(3)} ELSE {LAST(2)} END AS domain, CASE WHEN {LISTED} THEN {LAST(2)} ELSE {LAST(1)} END AS suffix,
    count(decided)::DOUBLE AS n, count(*) FILTER (decided = 'block')::DOUBLE AS k FROM ruled GROUP BY host),
rate AS (SELECT CASE WHEN sum(n) > 0 THEN sum(k) / sum(n) ELSE 0 END AS parent, sum(n) AS total FROM counts),
whole AS (SELECT parent, parent * (1 - parent) / (total + 1) AS above FROM rate),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(parent) AS parent, any_value(above) AS above FROM counts, whole GROUP BY suffix),
{level_sql("suffixes")},
domains AS (SELECT domain, sum(c.n) AS n, sum(c.k) AS k, any_value(s.share) AS parent, any_value(s.variance) AS above FROM counts c JOIN suffixes_shares s USING (suffix) GROUP BY domain),
{level_sql("domains")},
hosts AS (SELECT host, c.suffix, c.n, c.k, d.share AS parent, d.variance AS above FROM counts c JOIN domains_shares d USING (domain)),
{level_sql("hosts")}
SELECT page_id, r.host, path, rule,
  coalesce(decided, CASE WHEN h.share - {DEVIATIONS} * sqrt(h.variance) > {BLOCK_SHARE} AND s.n > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r JOIN hosts_shares h ON r.host = h.host JOIN suffixes s ON h.suffix = s.suffix
"""
