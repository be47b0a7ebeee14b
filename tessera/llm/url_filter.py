"""Operator 5: URL rules as a sort-merge range join (native DataFrame operations only).

A host's labels are reversed and each is followed by a dot (``www.example.org`` becomes ``org.example.www.``), so
that a rule's host and all its subdomains are one interval of keys: from ``org.example.`` up to ``org.example/``
(``/`` follows ``.`` in ASCII). Such intervals nest or are disjoint. One sorted sweep over rule starts, rule ends and
urls keeps the stack of open hosts, which is no deeper than a host has labels: a start pushes its host, an end restores the
stack beneath. Under each open host the same sweep runs over paths, whose intervals nest in the same way: what is open last
is the longest rule that fits."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, stash, table

Rule = tuple[str, str, str]  # host, path, verdict

#: The contract's rules.
RULES: list[Rule] = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """(host, path, verdict), hosts lower-cased. A list becomes one literal, a long one should be a table."""
    if isinstance(rules, DataFrame):
        found = rules.select("host", "path", "verdict")
    else:
        shape = "array<struct<host:string,path:string,verdict:string>>"
        text = json.dumps([dict(zip(("host", "path", "verdict"), r)) for r in rules])
        found = spark.range(1).select(F.inline(F.from_json(F.lit(text), shape)))
    return found.withColumn("host", F.translate("host", UPPER, LOWER))


def host_events(rules: DataFrame) -> DataFrame:
    """Two events a rule host, (zone, key, kind, open): kind 0 ends, 1 starts; open are the keys of the hosts that are open from
    there on, at most one a label. A zone is a top-level label."""
    own = rules.select("key").distinct()
    labels = F.split("key", r"\.")  # the last is empty
    above = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))
    nested = own.select("key", F.explode(above).alias("up")).join(own.select(F.col("key").alias("up")), "up")
    full = nested.groupBy("key").agg(F.array_sort(F.collect_list("up")).alias("open"))  # at most as many as the key has labels
    end = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    both = F.array(F.struct(F.col("key").alias("key"), F.lit(1).alias("kind"), F.col("open").alias("open")), F.struct(end.alias("key"), F.lit(0).alias("kind"), F.array_remove("open", F.col("key")).alias("open")))
    return full.select(F.split("key", r"\.")[0].alias("zone"), F.explode(both).alias("e")).select("zone", "e.*")


def path_events(rules: DataFrame) -> DataFrame:
    """Two events a rule, (key, edge, kind, top): top holds the innermost rule of the host that is open from there on. A
    path's interval goes up to the path and a byte that no text has."""
    one = rules.groupBy("key", "path").agg(F.max("host").alias("host"), F.max("verdict").alias("verdict"))
    cuts = one.filter(F.length("path") > 0).select("key", "path", F.explode(F.sequence(F.lit(0), F.length("path") - 1)).alias("k"))
    around = cuts.select("key", "path", F.substring("path", F.lit(1), F.col("k")).alias("up")).join(one.select("key", F.col("path").alias("up"), F.col("host").alias("h"), F.col("verdict").alias("v")), ["key", "up"])
    outer = around.groupBy("key", "path").agg(F.max_by(F.struct(F.col("h").alias("host"), F.col("up").alias("path"), F.col("v").alias("verdict")), F.length("up")).alias("outer"))
    rule, raw = F.struct("host", "path", "verdict"), F.col("path").cast("binary")
    both = F.array(F.struct(raw.alias("edge"), F.lit(1).alias("kind"), F.struct(rule.alias("rule")).alias("top")), F.struct(F.concat(raw, F.unhex(F.lit("FF"))).alias("edge"), F.lit(0).alias("kind"), F.struct(F.col("outer").alias("rule")).alias("top")))
    return one.join(outer, ["key", "path"], "left").select("key", F.explode(both).alias("e")).select("key", "e.*")


def _swept(rows: DataFrame, events: DataFrame, by: str, place: str, value: str) -> DataFrame:
    """``rows`` with the ``value`` of the last event at or before their ``place``, within ``by``. A value of ``by`` with more than
    a partition's share of the rows is dealt over as many salts as it holds shares, and its events go to each of them."""
    sizes = stash(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")), "sizes")
    share = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / partitions(rows.sparkSession)
    hot = F.broadcast(sizes.filter(F.col("n") > share).select(by, F.ceil(F.col("n") / F.lit(max(share, 1.0))).alias("salts")))  # fewer than there are partitions
    salts = F.coalesce("salts", F.lit(1).cast("bigint"))
    dealt = rows.join(hot, by, "left").withColumns({"salt": F.pmod(F.xxhash64("row"), salts), "kind": F.lit(2)}).drop("salts")
    spread = events.join(hot, by, "left").select(*events.columns, F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"))
    w = Window.partitionBy(by, "salt").orderBy(place, "kind").rowsBetween(Window.unboundedPreceding, 0)
    return dealt.unionByName(spread, allowMissingColumns=True).withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("kind = 2")


def filter_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: ``id_col``, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; of several the longest (host and
    path together, then host) wins, of equal rules the greatest verdict; without one the verdict is ``default`` and rule is
    null. A null url, or one without ``://``, has empty host and path and gets ``default``. Rows that repeat are judged each;
    ids may be null; other columns are ignored; an empty table gives an empty result. ``rules`` are a list or a table of (host,
    path, verdict); those without a host or a path fit nothing.

    Work and memory grow with urls times the open hosts of each, at most its labels, and with rules times their length."""
    found = rule_table(pages.sparkSession, rules).filter((F.col("host") != "") & F.col("path").isNotNull()).withColumn("key", host_key(F.col("host")))
    found = stash(found, "rules")
    urls = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), F.monotonically_increasing_id().alias("row"))
    urls = stash(urls.withColumn("key", host_key(F.col("host"))).withColumn("zone", F.substring_index("key", ".", 1)), "urls")
    hosts = stash(_swept(urls, host_events(found), "zone", "key", "open").select("row", "id", "host", "path", "open"), "open")
    some = F.coalesce(F.size("open") > 0, F.lit(False))
    asks = hosts.filter(some).select("row", "id", "host", "path", F.explode("open").alias("key"), F.col("path").cast("binary").alias("edge"))
    r = F.col("top.rule")
    fits = F.when(r.isNotNull(), F.struct((F.length(r["host"]) + F.length(r["path"])).alias("n"), F.length(r["host"]).alias("m"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict")))
    best = _swept(asks, path_events(found), "key", "edge", "top").groupBy("row", "id", "host", "path").agg(F.max(fits).alias("best"))
    judged = best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    rest = hosts.filter(~some).select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return judged.unionByName(rest)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`filter_urls` of ``pages`` by the contract's rules: page_id, host, path, rule, verdict."""
    return filter_urls(table(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                               ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT row_number() OVER () AS k, page_id,
             translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC NULLS LAST) AS rn
      FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE rn = 1
"""
