"""URL verdicts from listed rules and from mined token associations.

FP-growth mines the token combinations of labelled URLs; combinations that go with the bad
label often enough (confidence) and in enough URLs (support) become rules.  A URL has at most
eight tokens, so at ``min_support`` s there are at most 2**8 / s frequent sets: the mined table
is bounded whatever the input, and its inverted index (token to rules) becomes a map literal
in the scan, so that judging pages needs no join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=bad"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits: its host or a subdomain, and a path that starts like its."""
    def fits(rule):
        name, _, rest = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
    longest_first = sorted((r for _, r in rules), key=lambda r: (-len(r), r))
    return F.coalesce(*[F.when(fits(r), F.lit(r)) for r in longest_first], F.lit(None).cast("string"))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Up to eight distinct tokens: host, its last two labels, each of its first two labels,
    first path segment, file extension, names of the query's keys, a fragment."""
    labels = F.split(host, r"\.")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.array_sort(F.array_distinct(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))))
    segment, extension = F.regexp_extract(path, r"^/([^/]+)/", 1), F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)

    def token(kind, value):
        return F.when(value != "", F.concat(F.lit(f"{kind}="), value))
    return F.array_distinct(F.array_compact(F.array(
        token("host", host), token("domain", F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".")),
        token("first", F.element_at(labels, 1)), token("second", F.coalesce(F.try_element_at(labels, F.lit(2)), F.lit(""))),
        token("dir", segment), token("ext", F.lower(extension)), token("keys", F.array_join(keys, "+")),
        F.when(F.instr(url, "#") > 0, F.lit("fragment")))))


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.5) -> DataFrame:
    """(terms, confidence) from (tokens array<string>, bad boolean): combinations of tokens, of
    any size, of which at least ``min_confidence`` of the URLs are bad.  A rule that a smaller
    one makes needless (its terms are a part, its confidence no less) is pruned."""
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "terms array<string>, confidence double")
    labelled = labelled.where(F.col("bad").isNotNull() & (F.size("tokens") > 0))
    if labelled.isEmpty():
        return empty
    from pyspark.ml.fpm import FPGrowth

    baskets = labelled.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    rules = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets).associationRules
    rules = rules.where(F.col("consequent") == F.array(F.lit(BAD)))
    rules = rules.select(F.array_sort("antecedent").alias("terms"), "confidence").persist()
    # every proper part of a rule, by the bits of a number: at most 254 of eight tokens
    parts = rules.where("size(terms) > 1").select("terms", "confidence", F.explode(F.expr(
        "transform(sequence(1, shiftleft(1, size(terms)) - 2), n -> filter(terms, (t, i) -> shiftright(n, i) % 2 = 1))")).alias("part"))
    smaller = rules.select(F.col("terms").alias("part"), F.col("confidence").alias("least"))
    needless = parts.join(smaller, "part").where("least >= confidence").select("terms").distinct()
    return rules.join(needless, "terms", "left_anti")


def judge_urls(spark: SparkSession, pages: DataFrame, labelled: DataFrame, listed: list[tuple[str, str]],
               min_support: float = 0.005, min_confidence: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined_confidence.

    ``listed`` holds (verdict, rule) pairs such as ("block", "net/"); the longest that fits
    decides, else the mined rules do (block if any matches, allow if none).  ``labelled`` has
    url and bad.  A null url or one without ``://`` has an empty host and path and no tokens.
    Pages that repeat each get their row; pages with a null id are judged like others."""
    def parts(df, *more):
        u = F.col("url")
        return df.select(*more, u, host_of(u).alias("host"), path_of(u).alias("path"))
    learn = parts(labelled, "bad").select("bad", url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    mined = mine_rules(learn, min_support, min_confidence)
    # inverted index, each rule under its first term: at most 2**8 / min_support rules
    index: dict[str, list] = {}
    for r in mined.orderBy("terms").collect():
        index.setdefault(r["terms"][0], []).append(r)
    u, h, p = F.col("url"), F.col("host"), F.col("path")
    rows = parts(pages, "page_id").withColumn("tokens", url_tokens(u, h, p))
    rule_of = [F.struct(F.lit(term).alias("term"), F.array(*[
        F.struct(F.array(*[F.lit(t) for t in r["terms"]]).alias("terms"), F.lit(r["confidence"]).alias("confidence"))
        for r in found]).alias("found")) for term, found in sorted(index.items())]
    if rule_of:
        lookup = F.map_from_entries(F.array(*rule_of))
        candidates = F.flatten(F.array_compact(F.transform("tokens", lambda t: F.try_element_at(lookup, t))))
        matched = F.filter(candidates, lambda r: F.size(F.array_except(r["terms"], F.col("tokens"))) == 0)
        confidence = F.array_max(F.transform(matched, lambda r: r["confidence"]))
    else:
        confidence = F.lit(None).cast("double")
    rule = listed_rule(h, p, listed)
    verdict_of = reduce(lambda c, x: c.when(F.col("rule") == x[1], F.lit(x[0])), listed, F.when(F.lit(False), F.lit("")))
    return rows.select("page_id", "host", "path", rule.alias("rule"), confidence.alias("mined_confidence")).withColumn(
        "verdict", F.coalesce(verdict_of, F.when(F.col("mined_confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))))
