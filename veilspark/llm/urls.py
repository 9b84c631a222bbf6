"""URL filter: rules by host and path, else empirical-Bayes host reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import table, written

#: (verdict, rule): the rules of the query; a rule is a host and the start of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Under a country's two letters these labels are registries, not registrants: a rule for
#: suffixes of two labels (co.uk, com.mx, gov.in), whose registered domains have three.
REGISTRIES = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "govt", "gv", "id", "info", "ltd", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch", "school")
#: A host passes if the lower bound of its posterior, Z deviations under the mean, reaches THRESHOLD.
THRESHOLD, Z = 0.5, 1.645
#: Least and greatest correlation of outcomes within a unit, so that priors stay proper.
RHO = (0.001, 0.5)
#: Reputations of at most this many hosts are broadcast (about 100 bytes each); more are joined by shuffle.
BROADCAST_HOSTS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST, PATH = r"://([^/?#]*)", r"://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels, three where the last two are a
    country's registry. A port is no part of it; an address of numbers is its own domain."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    registry = (F.length(F.substring_index(name, ".", -1)) == 2) & F.substring_index(two, ".", 1).isin(*REGISTRIES) & F.contains(two, F.lit("."))
    return F.when(name.rlike(r"^[0-9.]+$"), name).when(registry, F.substring_index(name, ".", -3)).otherwise(two)


def suffix_of(domain: Column) -> Column:
    """What follows a domain's first dot; the domain itself if it has none or is an address of numbers."""
    return F.when((F.instr(domain, ".") > 0) & ~domain.rlike(r"^[0-9.]+$"), F.regexp_replace(domain, r"^[^.]*\.", "")).otherwise(domain)


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, start = text.split("/", 1)
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def correlation(units: DataFrame) -> Column:
    """Moment estimate of the correlation within the units of a level, from their n,
    their successes s and their prior mean m: E[n (s/n - m)^2 / (m (1 - m))] =
    1 + (n - 1) rho. Rounded, so that the order of the sums does not show."""
    var = F.col("m") * (1 - F.col("m"))
    excess = F.sum(F.when((F.col("n") > 0) & (var > 0), F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("m"), 2) / var - 1))
    spare = F.sum(F.when((F.col("n") > 0) & (var > 0), F.col("n") - 1))
    rho = F.when(spare > 0, excess / spare).otherwise(RHO[0])
    return F.round(F.least(F.greatest(F.coalesce(rho, F.lit(RHO[0])), F.lit(RHO[0])), F.lit(RHO[1])), 6)


def shrunk(units: DataFrame) -> DataFrame:
    """Posterior mean of each unit: its outcomes and kappa = 1/rho - 1 pseudo-outcomes at its prior mean."""
    rho = units.agg(correlation(units).alias("rho"))  # one row
    kappa = 1 / F.col("rho") - 1
    return units.crossJoin(F.broadcast(rho)).withColumn("kappa", kappa).withColumn("mean", (F.col("s") + F.col("kappa") * F.col("m")) / (F.col("n") + F.col("kappa"))).drop("rho")


def reputations(hosts: DataFrame, threshold: float = THRESHOLD, z: float = Z) -> DataFrame:
    """(host, n, s) -> (host, n, mean, bound, reputable).

    Beta-binomial shrinkage down the hierarchy: all outcomes, suffixes, registered
    domains, hosts; each level's prior is centred on the posterior mean of the level
    above and its strength is fitted by moments over all units of the level. bound is
    the mean less z standard deviations of the posterior beta distribution; near 0 and 1
    and for few outcomes that is rough, but never above the mean. Hosts are expected
    once each; hosts without outcomes have the prior; an empty table gives an empty one."""
    named = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain")))
    domains = named.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = suffixes.agg(((F.sum("s") + 1) / (F.sum("n") + 2)).alias("m"))  # one row
    top = written(shrunk(suffixes.crossJoin(F.broadcast(whole))).select(F.col("suffix").alias("_s"), F.col("mean").alias("m")), "suffixes")
    middle = written(shrunk(domains.join(top, F.col("suffix") == F.col("_s"))).select(F.col("domain").alias("_d"), F.col("mean").alias("m")), "domains")
    low = shrunk(named.join(middle, F.col("domain") == F.col("_d")))
    bound = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("kappa") + 1))
    return low.select("host", "n", "mean", bound.alias("bound"), (bound >= threshold).alias("reputable"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD, z: float = Z, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, n_host, bound) of every page.

    outcomes: (id, good), good 1 or 0. Hosts are summed before they are shuffled, so
    a hot host is one row a task; the pages themselves are not shuffled unless there
    are more than BROADCAST_HOSTS hosts, and then Spark splits a hot host's rows.
    Only ids and urls are read. Defined cases: null urls and urls without '://' have
    empty host and path, and the empty host has a reputation like any other; several
    outcomes of an id count as the worst; outcomes of unknown pages and null outcomes
    do not count; repeated rows are judged alike; without any outcome every host has
    the prior; other columns are ignored."""
    url = F.col(url_col)
    read = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = outcomes.where("good IS NOT NULL AND id IS NOT NULL").groupBy(F.col("id").alias("_id")).agg(F.min("good").alias("good"))
    labelled = read.join(known, F.col("id") == F.col("_id"), "left")
    hosts = written(labelled.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("s")), "hosts")  # pages are summed once, for all levels
    known_hosts = reputations(hosts, threshold, z).select(F.col("host").alias("_host"), "n", "bound", "reputable")
    many = hosts.count() > BROADCAST_HOSTS
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    judged = read.join(known_hosts if many else F.broadcast(known_hosts), F.col("host") == F.col("_host"))
    return judged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("reputable"), "allow").otherwise("block")).alias("verdict"), F.col("n").alias("n_host"), "bound")


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Page outcomes from the labels of the same number: good quality and not toxic."""
    return labels.select(F.col("doc_id").alias("id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))


def op1_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "pages"), outcomes_of(table(spark, sf_dir, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict", "n_host", F.round(F.col("bound") * 1000).cast("long").alias("bound_milli"))


def _sql_rules() -> tuple[str, str]:
    cases = [(text, said, *text.split("/", 1)) for said, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1]))]
    fits = [(f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{start}')", text, said) for text, said, own, start in cases]
    return tuple("CASE " + " ".join(f"WHEN {f} THEN '{(t, v)[k]}'" for f, t, v in fits) + " END" for k in (0, 1))


def _sql_level(name: str, units: str, key: str) -> str:
    var = "(m * (1 - m))"
    rho = f"round(least(greatest(coalesce(CASE WHEN sum(CASE WHEN n > 0 AND {var} > 0 THEN n - 1 END) > 0 THEN sum(CASE WHEN n > 0 AND {var} > 0 THEN n * pow(s / n - m, 2) / {var} - 1 END) / sum(CASE WHEN n > 0 AND {var} > 0 THEN n - 1 END) ELSE {RHO[0]} END, {RHO[0]}), {RHO[0]}), {RHO[1]}), 6)"
    return f"{name}_units AS ({units}), {name} AS (SELECT {key}, n, k AS kappa, (s + k * m) / (n + k) AS mean FROM {name}_units, (SELECT 1 / {rho} - 1 AS k FROM {name}_units))"


RULE_SQL, SAID_SQL = _sql_rules()
_REGISTRIES = ", ".join(f"'{x}'" for x in REGISTRIES)
ORACLE = f"""
WITH read AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '{HOST}', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '{PATH}', 1), '') AS path FROM pages),
known AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS s FROM read LEFT JOIN known ON page_id = doc_id GROUP BY host),
parts AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name FROM hosts),
two AS (SELECT *, string_split(name, '.') AS labels FROM parts),
named AS (SELECT host, n, s, CASE WHEN regexp_full_match(name, '[0-9.]+') THEN name WHEN len(labels) > 1 AND length(labels[-1]) = 2 AND labels[-2] IN ({_REGISTRIES}) THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS domain FROM two),
suffixed AS (SELECT *, CASE WHEN contains(domain, '.') AND NOT regexp_full_match(domain, '[0-9.]+') THEN regexp_replace(domain, '^[^.]*\\.', '') ELSE domain END AS suffix FROM named),
domain_sums AS (SELECT domain, suffix, sum(n) AS n, sum(s) AS s FROM suffixed GROUP BY ALL),
suffix_sums AS (SELECT suffix, sum(n) AS n, sum(s) AS s FROM domain_sums GROUP BY ALL),
{_sql_level("top", "SELECT suffix, n::DOUBLE AS n, s::DOUBLE AS s, (SELECT (sum(s) + 1) / (sum(n) + 2) FROM suffix_sums) AS m FROM suffix_sums", "suffix")},
{_sql_level("middle", "SELECT domain, d.n::DOUBLE AS n, d.s::DOUBLE AS s, mean AS m FROM domain_sums d JOIN top USING (suffix)", "domain")},
{_sql_level("low", "SELECT host, h.n::DOUBLE AS n, h.s::DOUBLE AS s, mean AS m FROM suffixed h JOIN middle USING (domain)", "host")},
bounds AS (SELECT host, n, mean - {Z} * sqrt(mean * (1 - mean) / (n + kappa + 1)) AS bound FROM low)
SELECT page_id, host, path, {RULE_SQL} AS rule, coalesce({SAID_SQL}, CASE WHEN bound >= {THRESHOLD} THEN 'allow' ELSE 'block' END) AS verdict, n::BIGINT AS n_host, round(bound * 1000)::BIGINT AS bound_milli
FROM read JOIN bounds USING (host)
"""
