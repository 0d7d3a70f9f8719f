"""URL filters: path rules and an exact host list held in a Bloom filter cascade.

Keys are hosts and their parent domains. The corpus's key universe is known in
full, so a cascade answers exactly: level 1 is a Bloom filter of the listed
keys, level 2 of the unlisted keys that level 1 lets through, level 3 of the
listed keys that level 2 lets through, and so on until none is left. A key is
looked up level by level; the first level that does not hold it decides. The
filters are array constants in the plan, so judging is a projection, with no
join and no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.plans.store import materialize

#: (host, path, verdict) of the contract's rules; the longest that fits wins.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Listed hosts by default: these labels under these domains, with all their subdomains.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DOMAINS = ("example.com", "example.net", "example.org")
#: Longs that the levels of a cascade may put into a plan.
MOST_WORDS = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and its parent domains, the whole host first; none for an empty host."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


@dataclass
class Level:
    """One Bloom filter: ``hashes`` positions for each key among 64 * len(words) bits."""

    number: int
    hashes: int
    words: list[int]

    def holds(self, key: Column) -> Column:
        words = F.expr(f"cast(split('{','.join(map(str, self.words))}', ',') AS array<bigint>)")
        bits = 64 * len(self.words)

        def bit(j: int) -> Column:
            at = position(key, self.number, j, bits)
            return F.call_function("shiftright", F.get(words, (at / 64).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

        return reduce(lambda a, b: a & b, (bit(j) for j in range(self.hashes)))


def position(key: Column, level: int, j: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits))


def level_words(n: int, rate: float) -> int:
    """Longs of a Bloom filter of ``n`` keys with about this rate of false positives."""
    return max(1, math.ceil(n * -math.log(rate) / math.log(2) ** 2 / 64))


def build_level(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    """A Bloom filter of the ``n`` keys with about this rate of false positives."""
    size = level_words(n, rate)
    hashes = max(1, round(-math.log2(rate)))
    at = keys.select(F.explode(F.array(*[position(F.col("key"), number, j, 64 * size) for j in range(hashes)])).alias("at"))
    rows = at.selectExpr("int(at div 64) AS w", "shiftleft(1L, int(at % 64)) AS m").groupBy("w").agg(F.bit_or("m").alias("m")).collect()
    words = [0] * size
    for r in rows:
        words[r.w] = r.m
    return Level(number, hashes, words)


@dataclass
class Cascade:
    levels: list[Level]

    def holds(self, key: Column) -> Column:
        """Whether the key is listed; exact for every key of the universe that it was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k, level in reversed(list(enumerate(self.levels))):
            out = F.when(~level.holds(key), F.lit(k % 2 == 1)).otherwise(out)
        return out


def build_cascade(universe: DataFrame, listed: DataFrame, most_words: int = MOST_WORDS) -> Cascade:
    """A cascade for the keys of ``universe`` (key, distinct) that are in ``listed`` (key).

    Raises ValueError where the levels would put more than ``most_words`` longs
    into a plan; give the list in shards by hashed key then.
    """
    marked = universe.join(listed.select("key").distinct().withColumn("listed", F.lit(True)), "key", "left")
    marked = materialize(marked.select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "url-keys")
    n = {r.listed: r["count"] for r in marked.groupBy("listed").count().collect()}
    inside, outside = marked.filter("listed"), marked.filter("not listed")
    count, levels, words = n.get(True, 0), [], 0
    while count:
        rate = 0.5 if levels else min(0.5, max(count, 1) / (1.4 * max(n.get(False, 0), 1)))
        words += level_words(count, rate)
        if words > most_words:
            raise ValueError(f"the cascade takes more than {most_words} longs")
        level = build_level(inside, count, rate, len(levels))
        levels.append(level)
        inside, outside = outside.filter(level.holds(F.col("key"))), inside
        count = inside.count()
    return Cascade(levels)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(the longest rule that fits as host and path, its verdict), both null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def default_list(spark: SparkSession) -> DataFrame:
    return spark.sql("VALUES " + ", ".join(f"('{a}.{b}')" for a in LISTED_LABELS for b in LISTED_DOMAINS)).toDF("key")


def host_list(spark: SparkSession, path: str) -> DataFrame:
    """A list of hosts (key) from a text file of one host a line; blanks and lines after ``#`` are left out."""
    key = F.translate(F.btrim(F.split("value", "#")[0]), UPPER, LOWER)
    return spark.read.text(path).select(key.alias("key")).filter("key <> ''").distinct()


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, listed, verdict) for each row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest wins. Where none fits, a url is blocked if its host or a parent
    domain is listed. A null url, or one without ``://``, has an empty host and
    path and is allowed. Repeated rows are judged each; nulls in ``listed`` are
    ignored; rules of equal length never both fit one host and path. Extra
    columns are not read; very long urls are judged whole. An empty table gives
    no rows.
    """
    hosts = pages.select(host_of(F.col("url").cast("string")).alias("host")).distinct()
    universe = hosts.select(F.explode(domains_of(F.col("host"))).alias("key")).distinct()
    cascade = build_cascade(universe, listed.dropna(subset=["key"]))
    url = F.col("url").cast("string")
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    known = F.exists(domains_of(F.col("host")), cascade.holds)
    out = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), known.alias("listed"))
    return out.select("page_id", "host", "path", "rule", "listed", F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url; odd rows as in :func:`judge_urls`."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), default_list(spark)).drop("listed")


_FITS = "((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
_WHEN = "".join(f" WHEN {_FITS.format(h=h, p=p)} THEN '{{}}'".format(h + p) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
_VERDICT = "".join(f" WHEN rule = '{h + p}' THEN '{v}'" for h, p, v in RULES)
_LISTED = " OR ".join(f"host = '{a}.{b}' OR ends_with(host, '.{a}.{b}')" for a in LISTED_LABELS for b in LISTED_DOMAINS)
ORACLE_SQL = f"""WITH s AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
r AS (SELECT page_id, host, path, CASE{_WHEN} END AS rule FROM s)
SELECT page_id, host, path, rule, CASE{_VERDICT} WHEN {_LISTED} THEN 'block' ELSE 'allow' END AS verdict FROM r"""
