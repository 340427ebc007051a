"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches.  Each batch adds one run: a table sorted and bucketed by line hash
with the number of documents that hold the line and the largest id among them.  When a level has
``fanout`` runs they are merged into one run of the next level; runs share their buckets, so a
merge join reads them without moving rows.  A verdict merge-joins lines with the compacted runs and names the lines to drop:
those of at least ``min_chars`` code points found in ``min_docs`` documents or more, everywhere
but in the largest document that holds them.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; its hash
is the 128-bit MD5.

Cases: a null or empty text is one empty line.  Documents are told apart by doc_id; rows with one
id count once, and a row whose id is null is returned whole and not counted.  A line repeated
inside the keeping document stays as often as it is there.  A text whose lines all go becomes empty.
Columns with other names are carried along untouched by :func:`dedup_lines`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakstone.llm.common import BLANKS, lower_ascii
from cloakstone.sources.session import at_folder, keep, shared_folder


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def hashed_lines(docs: DataFrame, min_chars: int, batches: int) -> DataFrame:
    """Lines long enough to count: doc_id, row (a hash of the text), at, key, batch (of the id)."""
    lines = docs.filter("doc_id IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("row"), F.posexplode(split_lines(F.col("text"))).alias("at", "line")
    )
    lines = lines.withColumn("line", line_key(F.col("line"))).filter(F.length("line") >= min_chars)
    return lines.select(
        "doc_id", "row", "at", F.unhex(F.md5("line")).alias("key"),
        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"),
    )


class LineRuns:
    """The store of runs in the shared folder; a document's rows must come in one batch.

    Its files go when the session ends, or with :meth:`close` once results are written.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None, salts: int = 64):
        self.spark, self.fanout, self.salts = spark, fanout, salts
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
        at_folder(spark, self.folder, lambda files, target: files.deleteOnExit(target))
        self.levels: list[list[str]] = [[]]

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            run.repartition(self.buckets, "key")
            .write.bucketBy(self.buckets, "key").sortBy("key")
            .option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        )
        return name

    def _pair(self, one: str, two: str) -> DataFrame:
        """Two runs joined bucket by bucket, counts added; no exchange, because both share the bucketing."""
        other = self.spark.table(two).toDF("key", "more_docs", "more_keeper")
        return self.spark.table(one).join(other.hint("merge"), "key", "full").select(
            "key",
            (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more_docs", F.lit(0))).alias("n_docs"),
            F.greatest("keeper", "more_keeper").alias("keeper"),
        )

    def _merge(self, names: list[str]) -> str:
        """Merge runs into one, the youngest and smallest first."""
        while len(names) > 1:
            *rest, one, two = names
            names = [*rest, self._write(self._pair(one, two))]
            self._drop([one, two])
        return names[0]

    def add(self, lines: DataFrame) -> None:
        """Add a batch of hashed lines as a run of level 0; compact the levels that are full."""
        run = lines.select("key", "doc_id").distinct().groupBy("key").agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")
        )
        self.levels[0].append(self._write(run))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._merge(self.levels[level])
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            at_folder(self.spark, f"{self.folder}/{name}", lambda files, target: files.delete(target, True))

    def close(self) -> None:
        self._drop([name for level in self.levels for name in level])
        self.levels = [[]]

    def compacted(self) -> DataFrame:
        """Everything added as one run of the top level: key, n_docs, keeper."""
        names = [name for level in reversed(self.levels) for name in level]
        top = self._merge(names)
        self.levels = [[] for _ in self.levels[1:]] + [[top]]
        return self.spark.table(top)

    def doomed(self, lines: DataFrame, min_docs: int) -> DataFrame:
        """Lines of ``lines`` to drop: those of frequent keys outside the keeping document.

        A frequent key may be in a third of all lines, so each is joined under ``salts`` keys.
        """
        salts = F.array(*[F.lit(k) for k in range(self.salts)])
        frequent = self.compacted().filter(F.col("n_docs") >= min_docs).select("key", "keeper", F.explode(salts).alias("salt"))
        salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(self.salts)).cast("int"))
        return salted.join(frequent, ["key", "salt"]).filter("doc_id <> keeper").select("doc_id", "row", "at")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4) -> DataFrame:
    """``docs`` with its text cleaned, plus ``__n_lines`` (before) and ``__n_dropped``."""
    lines = hashed_lines(docs, min_chars, batches)
    lines = _by_batch(lines)
    runs = LineRuns(docs.sparkSession)
    for number in range(batches):
        runs.add(lines.filter(F.col("batch") == number))
    drops = (
        runs.doomed(lines, min_docs)
        .groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row"))
        .agg(F.collect_set("at").alias("__at"))
    )
    pieces = split_lines(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.col("__n_lines").cast("int") - 1), F.col("__at"))
    kept = F.concat_ws("\n", F.transform(left, lambda i: F.get("__lines", i)))
    joined = docs.join(
        drops, (docs["doc_id"] == drops["__id"]) & (F.xxhash64(docs["text"]) == drops["__row"]), "left"
    )
    joined = joined.withColumn("__lines", pieces).withColumn("__n_lines", F.array_size("__lines").cast("long"))
    return joined.select(
        *[F.when(F.col("__at").isNull(), F.col("text")).otherwise(kept).alias(c) if c == "text" else docs[c] for c in docs.columns],
        "__n_lines",
        F.coalesce(F.array_size("__at"), F.lit(0)).cast("long").alias("__n_dropped"),
    )


def _by_batch(lines: DataFrame) -> DataFrame:
    """The hashed lines settled once, one folder per batch."""
    return keep(lines, "lines", "batch")
