"""URL filters by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8  # hexadecimal digits of a digest that are joined on: four bytes


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a url; both empty where the url is null or has no ``://``."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def labels(host: Column) -> Column:
    """Number of a host's labels: its dots and one."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def suffixes(host: Column, counts: list[int]) -> Column:
    """The host's suffixes with so many labels, each cut from the right."""
    wanted = F.filter(F.array(*[F.lit(c) for c in counts]).cast("array<int>"), lambda c: c <= labels(host))
    return F.transform(wanted, lambda c: F.call_function("substring_index", host, F.lit("."), -c))


def hashed(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def met_by_digest(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of both sides with the same ``digest``: joined on four bytes of it, confirmed by all."""
    short = F.substring("digest", 1, PREFIX_DIGITS)
    right = known.select(*[F.col(c).alias(f"known_{c}") if c == "digest" else F.col(c) for c in known.columns], short.alias("prefix"))
    return asked.withColumn("prefix", short).join(right, "prefix").where(F.col("digest") == F.col("known_digest")).drop("prefix", "known_digest")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    ``rules`` has (host, path, verdict), hosts in lower case, paths from their slash. A rule fits its host and
    all subdomains, where the path begins with the rule's. The rule of the longest text host + path
    wins; of equal length the one of the longer host, then block before others, then the larger text.
    No fitting rule gives a null rule and the ``default`` verdict.

    Each different host is expanded once into its suffixes, of the numbers of labels that rules have, of
    which only four bytes of the SHA-256 meet those of the rules' hosts; each different (host, path)
    then into the suffixes found with the path's prefixes, at the lengths that rules of that suffix
    have, which meet the rules' in the same way. Those that meet are confirmed by the full digest.
    So the work for a url is linear in its length, whatever it looks like. The numbers of labels are
    read to the driver; n different ones take rules of n * n / 2 characters. The planner broadcasts
    the rules when they are small; otherwise the joins are by digest, which spreads the rules.

    Defined cases: a null url, or one without ``://``, has empty host and path and meets only rules with
    both empty; empty rules leave every page the default; rules with a null are ignored;
    repeated pages and rules are kept and harmless; other columns are ignored.
    """
    host, path = host_and_path(F.col(url))
    pages = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rules = rules.select("host", "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").distinct()
    counts = [r[0] for r in rules.select(labels(F.col("host"))).distinct().collect()]
    known = rules.withColumn("expression", F.concat("host", "path")).select(
        hashed(F.col("expression")).alias("digest"),
        F.struct(
            F.length("expression").alias("size"),
            F.length("host").alias("host_size"),
            (F.col("verdict") == "block").alias("blocks"),
            F.col("expression").alias("rule"),
            F.col("verdict"),
        ).alias("found"),
    )
    names = pages.select("host", "path").distinct()
    hosts = names.select("host").distinct().select("host", F.explode(suffixes(F.col("host"), counts)).alias("suffix"))
    roots = rules.select(F.col("host").alias("suffix")).distinct().select(hashed(F.col("suffix")).alias("digest"))
    fitting = met_by_digest(hosts.withColumn("digest", hashed(F.col("suffix"))), roots).select("host", "suffix")
    shapes = fitting.join(rules.select(F.col("host").alias("suffix"), F.length("path").alias("size")).distinct(), "suffix")
    shapes = shapes.withColumnRenamed("host", "of")
    asked = names.join(shapes, (F.col("host") == F.col("of")) & (F.length("path") >= F.col("size")))
    expression = F.concat(F.col("suffix"), F.substring(F.col("path"), F.lit(1), F.col("size")))
    met = met_by_digest(asked.select("host", "path", hashed(expression).alias("digest")), known)
    best = met.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(F.max("found").alias("found"))
    return pages.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict")
    )
