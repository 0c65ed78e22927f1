"""URL filter: explicit rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes are counted by host, registered domain and suffix. Each level's rate is shrunk to the level above
it (global -> suffix -> domain -> host) by a beta-binomial prior whose strength is estimated from the spread between
groups; a page is allowed if the lower bound of its host's posterior reaches a threshold.

Rules may be many: up to INLINE of them are compared in one expression; a longer list is joined on the suffixes of each
different host and the prefixes of its paths that have the length of some rule's.

For its reputation a host is taken without user and port; addresses are domains and suffixes of their own. The domain is what
stands before the longest of the public suffixes that are given as a table; without one a short rule takes its place.

Defined cases: a null url, or one without "://", has empty host and path and falls to the global prior; urls of any length are
looked at whole; hosts without labels fall to their domain's posterior, then the suffix's; repeated labels of a page all count,
repeated pages each give a row; of rules as long as each other the last by (action, host, path) wins; without any label every
posterior is the uniform prior's; empty tables give no rows; extra columns of either input, whatever their names, are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Second-level names that count as part of a country's suffix, where no list of public suffixes is given.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Standard deviations below the posterior mean (the lower decile), and the bound a host must reach.
Z, THRESHOLD = 1.2816, 0.5
#: Limits of an estimated prior strength, in pseudo-observations.
WEAKEST, STRONGEST = 1.0, 200.0
#: Rules that are compared in one expression, at most.
INLINE = 256
#: A host with more than this part of all pages is broadcast with its bound.
HEAVY = 1000


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def server_of(host: Column) -> Column:
    """A host without user and port, to which outcomes are put down."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", "")


def is_address(host: Column) -> Column:
    return host.rlike(r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$")


def domain_of(host: Column) -> Column:
    """Last two labels of a host; three where the second is one of SECOND_LEVEL below a two-letter country; an address as it is."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    country = (n >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.try_element_at(parts, F.lit(-2)).isin(*SECOND_LEVEL)
    return F.when(is_address(host), host).when(country, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(domain: Column) -> Column:
    return F.when((F.instr(domain, ".") > 0) & ~is_address(domain), F.expr("substring(domain, instr(domain, '.') + 1)")).otherwise(domain)


def endings(host: Column) -> Column:
    """All endings of a host that start at a label, the whole host among them."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def _best(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, action), else null."""
    best = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(best)
    return best


def with_rules(placed: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """placed (host, path, ...) with r, struct(rule, action) of the longest fitting rule or null. rules: (action, host, path), a
    list or a table of any length."""
    if not isinstance(rules, DataFrame):
        if len(rules) <= INLINE:
            return placed.withColumn("r", _best(F.col("host"), F.col("path"), rules))
        rules = placed.sparkSession.createDataFrame(rules, "action string, host string, path string")
    table = rules.select("action", F.col("host").alias("ending"), F.col("path").alias("prefix")).where("action is not null and ending is not null and prefix is not null").distinct()
    lengths = [r[0] for r in table.select(F.length("prefix")).distinct().collect()]  # as many as the longest path has characters, at most
    urls = placed.select("host", "path").distinct()
    ends = urls.select("host", "path", F.explode(endings(F.col("host"))).alias("ending")).join(table.select("ending").distinct(), "ending", "left_semi")
    fitting = F.filter(F.array(*map(F.lit, sorted(lengths))), lambda n: n <= F.length("path"))
    cut = ends.select("host", "path", "ending", F.explode(F.transform(fitting, lambda n: F.left("path", n))).alias("prefix"))
    found = cut.join(table, ["ending", "prefix"]).groupBy("host", "path").agg(F.max_by(
        F.struct(F.concat("ending", "prefix").alias("rule"), "action"), F.struct(F.length("ending") + F.length("prefix"), "action", "ending", "prefix")).alias("r"))
    return placed.join(found, ["host", "path"], "left")


def _domains(hosts: DataFrame, suffixes: DataFrame | None) -> DataFrame:
    """hosts (host, ...) with domain and suffix. suffixes: public suffixes (suffix), the longest that ends a host counts; without
    them, or where none fits, the last label with SECOND_LEVEL names."""
    plain = hosts.withColumn("domain", domain_of(F.col("host")))
    plain = plain.withColumn("suffix", suffix_of(F.col("domain")))
    if suffixes is None:
        return plain
    known = suffixes.select(F.lower("suffix").alias("known")).distinct()
    ends = hosts.select("host").distinct().select("host", F.posexplode(endings(F.col("host"))).alias("at", "known")).join(known, "known")
    longest = ends.groupBy("host").agg(F.min(F.struct("at", "known")).alias("x"))
    labels = F.split("host", r"\.")
    own = F.when(F.col("x.at") > 0, F.array_join(F.slice(labels, F.col("x.at"), F.size(labels)), ".")).otherwise(F.col("host"))
    joined = plain.join(longest, "host", "left")
    return joined.withColumn("domain", F.when(F.col("x").isNotNull(), own).otherwise(F.col("domain"))).withColumn("suffix", F.coalesce("x.known", "suffix")).drop("x")


def _strengths(groups: DataFrame) -> tuple[float, float, float, float]:
    """Global rate and the prior strength below it, below suffixes and below domains, from one row of sums."""
    def spread(level: str, above: str) -> list[Column]:
        p, q = F.col(f"{level}_s") / F.col(f"{level}_n"), F.col(f"{above}_s") / F.col(f"{above}_n")
        w = F.col("n") / F.col(f"{level}_n")  # of each host row, so that a group counts once
        return [F.sum(F.col("n") * (p - q) ** 2).alias(f"v_{level}"), F.sum(w).alias(f"g_{level}"), F.sum(F.col("n") * q * (1 - q)).alias(f"b_{level}")]

    row = groups.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), *spread("suffix", "all"), *spread("domain", "suffix"), *spread("host", "domain")).first()
    if not row["n"]:
        return 0.5, 2.0, 2.0, 2.0
    out = [row["s"] / row["n"]]
    for level in ("suffix", "domain", "host"):
        inside = row[f"b_{level}"] / row["n"]  # variance of one outcome
        between = max(row[f"v_{level}"] / row["n"] - inside * row[f"g_{level}"] / row["n"], 1e-9)
        out.append(min(STRONGEST, max(WEAKEST, inside / between - 1)))
    return tuple(out)


def host_posteriors(hosts: DataFrame, outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, mean, bound, pages) for every host of `hosts` (host), pages being its rows there. outcomes: (host, good 0/1)."""
    # One row a host, before anything else moves: a host with a third of all pages is summed where it is read.
    by_host = _domains(outcomes.groupBy("host").agg(F.sum("good").cast("double").alias("s"), F.count("good").cast("double").alias("n")), suffixes).where("n > 0")
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("s").alias("domain_s"), F.sum("n").alias("domain_n"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("domain_s").alias("suffix_s"), F.sum("domain_n").alias("suffix_n"))
    total = by_suffix.agg(F.sum("suffix_s").alias("s"), F.sum("suffix_n").alias("n")).first()
    groups = (by_host.join(by_domain.drop("suffix"), "domain").join(by_suffix, "suffix")
              .withColumn("host_s", F.col("s")).withColumn("host_n", F.col("n"))
              .withColumn("all_s", F.lit(float(total["s"] or 0))).withColumn("all_n", F.lit(float(total["n"] or 1))))
    rate, k_suffix, k_domain, k_host = _strengths(groups)

    def shrink(s: str, n: str, mean: Column, k: float) -> Column:
        return (F.coalesce(F.col(s), F.lit(0.0)) + mean * k) / (F.coalesce(F.col(n), F.lit(0.0)) + k)

    every = _domains(hosts.groupBy("host").agg(F.count("*").alias("pages")), suffixes)
    joined = every.join(by_suffix, "suffix", "left").join(by_domain.drop("suffix"), "domain", "left").join(by_host.select("host", "s", "n"), "host", "left")
    joined = joined.withColumn("m_suffix", shrink("suffix_s", "suffix_n", F.lit(rate), k_suffix))
    joined = joined.withColumn("m_domain", shrink("domain_s", "domain_n", F.col("m_suffix"), k_domain))
    joined = joined.withColumn("mean", shrink("s", "n", F.col("m_domain"), k_host))
    seen = F.coalesce(F.col("n"), F.lit(0.0)) + k_host + 1
    return joined.select("host", "mean", (F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / seen)).alias("bound"), "pages")


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, threshold: float = THRESHOLD, suffixes: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) for every page; bound is null where a rule decides. outcomes: (page_id, good
    0/1), null good not counted."""
    host = host_of(pages["url"])
    placed = pages.select(pages["page_id"].alias("page_id"), host.alias("host"), path_of(pages["url"]).alias("path"), server_of(host).alias("server"))
    labelled = placed.select("page_id", F.col("server").alias("host")).join(outcomes.select("page_id", "good"), "page_id").select("host", "good")
    known = host_posteriors(placed.select(F.col("server").alias("host")), labelled, suffixes).withColumnRenamed("host", "server")
    # pages of few hosts go by a rule or by a broadcast: hosts with over 1/HEAVY of all pages, of which there are fewer than HEAVY
    heavy = known.where(F.col("pages") > placed.agg(F.count("*") / HEAVY).scalar()).select("server", F.col("bound").alias("heavy"))
    ruled = with_rules(placed, rules).join(F.broadcast(heavy), "server", "left")
    done = F.col("r").isNotNull() | F.col("heavy").isNotNull()
    spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("page_id", "path"), F.lit(1 << 20)).cast("string"))  # no host's key, so none waits for another
    light = known.select(F.col("server").alias("key"), F.col("bound").alias("light"))
    out = ruled.withColumn("key", F.when(done, spread).otherwise(F.col("server"))).join(light, "key", "left")
    bound = F.when(F.col("r").isNull(), F.coalesce("heavy", "light"))
    learned = F.when(bound >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.action"), learned).alias("verdict"), bound.alias("bound"))
