"""URL filtering by a sort-merge range join, in DataFrame functions only.

A host's labels, reversed and each closed by '.', make its canonical key:
``www.example.com`` gives ``com.example.www.``. A rule's host is then the
prefix of the keys of the host and all its subdomains, that is, the interval
[key, key with the last '.' raised to '/'). Intervals of prefixes nest or are
disjoint. One sorted sweep over rule starts, rule ends and points keeps the
stack of the rules that are open; each point takes the stack as it stands.

A first sweep over host keys finds each url's open rule hosts. A second one,
over host key and path within each of those, finds the innermost path rule.
The longest rule of all wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Stands between host key and path in the second sweep's keys; nothing sorts lower.
_SEP = "\x00"


def lowered(host: Column) -> Column:
    """A-Z alone in lower case."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without '://'."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    host = lowered(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def host_key(host: Column) -> Column:
    """Labels reversed, each closed by '.'; the empty host has the key '.'."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _sweep(points: DataFrame, rules: DataFrame, blocks: int, name: str) -> DataFrame:
    """Give each point ``_stack``: the nested rules open at its key, outermost first.

    ``points`` has a string ``_key``; ``rules`` has distinct strings ``_key``
    (a prefix each), ``_prefixes`` (all prefixes of it that a rule might be,
    itself included) and ``_load``.

    Between two neighbouring events, the start (the prefix itself) or end
    (the prefix and a byte above all of UTF-8) of a rule, the stack does not
    change, so an event carries the stack as it stands after it. Points and
    events are sorted together, and each point takes the last stack before
    it. The sort deals blocks of the key range, with a row hash behind the
    key, so that a hot key fills many blocks; the blocks are written to the
    shared folder, as another sample might set other bounds. The stack open
    where a block starts is that of the last event in the blocks before it.
    """
    chains = (
        rules.select(F.col("_key").alias("_own"), F.explode("_prefixes").alias("_key"))
        .join(rules.select("_key", "_load"), "_key")
        .groupBy("_own")
        .agg(F.array_sort(F.collect_list(F.struct("_key", "_load"))).alias("_stack"))
    )
    start = F.col("_own").cast("binary")
    events = chains.select(
        F.explode(
            F.array(
                F.struct(start.alias("_at"), F.col("_stack")),
                F.struct(F.concat(start, F.unhex(F.lit("FF"))).alias("_at"), F.slice("_stack", F.lit(1), F.size("_stack") - 1).alias("_stack")),
            )
        ).alias("e")
    ).select("e.*", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_mix"))
    fields = points.columns
    merged = (
        points.select(F.col("_key").cast("binary").alias("_at"), F.lit(1).alias("_kind"), F.xxhash64(*fields).alias("_mix"), F.struct(*fields).alias("_row"))
        .unionByName(events, allowMissingColumns=True)
        .repartitionByRange(blocks, "_at", "_kind", "_mix")
        .withColumn("_block", F.spark_partition_id())
    )
    merged = stored(merged, name)
    running = W.partitionBy("_block").orderBy("_at", "_kind", "_mix").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = merged.where("_kind = 0").groupBy("_block").agg(F.max_by("_stack", "_at").alias("_carry"))  # a row a block
    carried = last.withColumn("_to", F.coalesce(F.lead("_block").over(W.orderBy("_block")), F.lit(blocks)))
    carried = carried.select(F.explode(F.sequence(F.col("_block") + 1, "_to")).alias("_block"), "_carry")
    return (
        merged.withColumn("_open", F.last("_stack", ignorenulls=True).over(running))
        .where("_kind = 1")
        .join(F.broadcast(carried), "_block", "left")  # a row a block at most
        .select("_row.*", F.coalesce("_open", "_carry").alias("_stack"))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", blocks: int | None = None) -> DataFrame:
    """``id, host, path, rule, verdict`` for every row of ``pages``.

    ``rules`` has strings ``host, path, verdict``. A rule fits its host and
    all subdomains where the url's path starts with its own; the longest
    rule (host and path together, ties to the longer host) wins, and
    ``rule`` is its host and path; without one, ``rule`` is null and the
    verdict is ``default``. Of rules for one host and path, ``block`` wins.

    Null urls and urls without '://' have empty host and path and fit no
    rule but one for the empty host. Null ids are kept; repeated rows each
    get a row; urls of any length are judged whole; other columns are not
    read; empty tables give no rows, and without rules all get the default.
    """
    spark = pages.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = split_url(F.col("_url"))
    urls = (
        pages.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"))
        .select("_id", host.alias("host"), path.alias("path"))
        .groupBy("_id", "host", "path").agg(F.count("*").alias("_n"))
    )
    known = (
        rules.select(lowered(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("_hkey", host_key(F.col("host")))
    )
    labels = F.split("_key", r"\.", -1)
    hosts = known.select(F.col("_hkey").alias("_key"), F.lit(0).alias("_load")).distinct().withColumn(
        "_prefixes", F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))
    )
    framed = _sweep(urls.withColumn("_key", host_key(F.col("host"))), hosts, blocks, "url-hosts")
    framed = framed.select("_id", "host", "path", "_n", F.explode_outer(F.col("_stack._key")).alias("_frame"))

    base = F.concat(F.col("_hkey"), F.lit(_SEP))
    paths = known.select(
        F.concat(base, F.col("path")).alias("_key"),
        F.transform(F.sequence(F.lit(0), F.char_length("path")), lambda i: F.concat(base, F.substring(F.col("path"), F.lit(1), i))).alias("_prefixes"),
        F.struct(
            F.char_length(F.concat("host", "path")).alias("length"), F.char_length("host").alias("host_length"), F.concat("host", "path").alias("rule"), "verdict"
        ).alias("_load"),
    )
    judged = _sweep(framed.withColumn("_key", F.concat(F.coalesce("_frame", F.lit("")), F.lit(_SEP), F.col("path"))), paths, blocks, "url-paths")
    best = F.when(F.size("_stack") > 0, F.element_at("_stack", -1)["_load"])
    return (
        judged.select("_id", "host", "path", "_n", best.alias("_best"))
        .groupBy("_id", "host", "path")
        .agg(F.max("_best").alias("_best"), F.first("_n").alias("_n"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        .select(F.col("_id").alias(id_col), "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
    )


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a table, for short lists."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
