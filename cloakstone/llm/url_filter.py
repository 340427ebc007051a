"""URL allow and block rules as a sort-merge range join, in DataFrame operations only.

A rule (host, path) fits its host and every subdomain when the URL's path starts with the
rule's path.  Host labels are reversed, so ``m.example.org`` gives the keys ``org``,
``org.example`` and ``org.example.m``, each followed by a zero byte and the path.  A rule is
then the interval of all keys that start with its own, and such intervals are nested or
disjoint.  Interval starts, interval ends and URL keys are sorted together; a running count of
open intervals is the height of the stack of active rules, and the latest start that reached a
height is the rule on top of the stack there.  The sweep runs in range blocks: the open count
and the top at each height are carried from block to block, so neither a hot host nor a hot
rule meets in one task.

Cases: a null URL, or one without ``://``, has an empty host and path and fits no rule.  A rule
without a host fits nothing; a null path counts as empty.  Of several fitting rules the longest
(host and path together) wins, then the one with the longer host; of equal rules block wins.
Repeated pages are judged alike, each in its own row.  An empty table of pages or rules is valid.
Columns of the pages other than the URL and the kept ones are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cloakstone.llm.common import blocks, carried, lower_ascii

END, START, POINT = 0, 1, 2


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + F.lit(3))
    return F.when(at > 0, lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + F.lit(3))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(
        F.encode(F.concat_ws(".", labels), "UTF-8"), F.lit(b"\x00"), F.encode(path, "UTF-8")
    )


def _canonical(rules: DataFrame) -> DataFrame:
    """One row per (host, path), with the labels; of allow and block, block stays."""
    return (
        rules.select(
            lower_ascii(F.col("host")).alias("r_host"),
            F.coalesce("path", F.lit("")).alias("r_path"),
            F.lower("verdict").alias("r_verdict"),
        )
        .filter("r_host <> '' AND r_verdict IN ('allow', 'block')")
        .groupBy("r_host", "r_path")
        .agg(F.max("r_verdict").alias("r_verdict"))
        .withColumn("labels", _labels(F.col("r_host")))
    )


def _points(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Keys of distinct URLs at every host suffix that some rule names.

    No suffix has more labels than the longest rule host, so a host of very many dots
    adds a bounded number of rows.
    """
    most = rules.agg(F.max(F.size("labels")).alias("n")).first()["n"] or 0
    reach = F.least(F.size("labels"), F.lit(most))
    sliced = F.transform(F.sequence(F.lit(1), reach), lambda n: F.slice("labels", F.lit(1), n))
    named = rules.select(F.concat_ws(".", "labels").alias("suffix")).distinct()
    return (
        urls.withColumn("labels", _labels(F.col("host")))
        .filter((F.col("host") != "") & F.lit(most > 0))
        .select("host", "path", F.explode(sliced).alias("labels"))
        .withColumn("suffix", F.concat_ws(".", "labels"))
        .join(named, "suffix", "left_semi")
        .select(_key(F.col("labels"), F.col("path")).alias("key"), F.lit(POINT).alias("kind"), "host", "path")
    )


def _sweep(points: DataFrame, rules: DataFrame) -> DataFrame:
    """The innermost rule that is open at each point: host, path, rule."""
    rule = F.struct("r_host", "r_path", "r_verdict")
    nothing = F.lit(None).cast("string")
    starts = rules.select(
        _key(F.col("labels"), F.col("r_path")).alias("key"), F.lit(START).alias("kind"),
        nothing.alias("host"), nothing.alias("path"), rule.alias("rule"),
    )
    ends = starts.select(
        F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(END).alias("kind"), "host", "path",
        F.lit(None).cast(starts.schema["rule"].dataType).alias("rule"),
    )
    events = blocks(starts.unionByName(ends).unionByName(points, allowMissingColumns=True), "key", "kind")
    step = F.when(F.col("kind") == START, 1).when(F.col("kind") == END, -1).otherwise(0)
    events = events.withColumn("step", step)
    opened = carried(events.groupBy("block").agg(F.sum("step").alias("steps")), "steps")
    in_order = Window.partitionBy("block").orderBy("key", "kind")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    swept = events.join(opened, "block").withColumn("height", F.col("carry") + F.sum("step").over(so_far))
    at_height = Window.partitionBy("block", "height").orderBy("key", "kind")
    swept = swept.withColumn(
        "top", F.last("rule", ignorenulls=True).over(at_height.rowsBetween(Window.unboundedPreceding, 0))
    )
    # The last start of each height per block, carried to the blocks that follow it.
    lasting = swept.groupBy("block", "height").agg(
        F.max_by("rule", F.when(F.col("kind") == START, F.col("key"))).alias("last_rule")
    )
    earlier = Window.partitionBy("height").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = lasting.select("block", "height", F.last("last_rule", ignorenulls=True).over(earlier).alias("below"))
    return (
        swept.filter(f"kind = {POINT} AND height > 0")
        .join(before, ["block", "height"], "left")
        .select("host", "path", F.coalesce("top", "below").alias("rule"))
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow"
) -> DataFrame:
    """Judge every row of ``pages``: the kept columns, host, path, rule (or null) and verdict."""
    pages = pages.select(*[F.col(c) for c in keep], F.col(url).alias("__url"))
    pages = pages.select(*keep, host_of(F.col("__url")).alias("__h"), path_of(F.col("__url")).alias("__p"))
    pages = pages.fillna("", ["__h", "__p"])
    known = _canonical(rules)
    urls = pages.select(F.col("__h").alias("host"), F.col("__p").alias("path")).distinct()
    length = F.length("rule.r_host") + F.length("rule.r_path")
    best = (
        _sweep(_points(urls, known), known)
        .groupBy("host", "path")
        .agg(F.max_by("rule", F.struct(length, F.length("rule.r_host"))).alias("rule"))
        .select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("rule").alias("__rule"))
    )
    return pages.join(best, ["__h", "__p"], "left").select(
        *keep,
        F.col("__h").alias("host"),
        F.col("__p").alias("path"),
        F.concat("__rule.r_host", "__rule.r_path").alias("rule"),
        F.coalesce("__rule.r_verdict", F.lit(default)).alias("verdict"),
    )
