"""A keyed table of message versions that a stream upserts into, levelled and filtered by key.

Each batch adds a run: its versions, dealt into buckets by message and sorted, one file a bucket.  When
``fanout`` runs of a level have come together they are merged into one run of the next, keeping the newest version
of each key, so a version is rewritten once a level and the number of runs grows with the logarithm of the batches.

A run has a key filter per bucket: a bitmap of 16 bits a message, two of them set.  :meth:`Store.lookup`
tests the wanted messages against the bitmaps and reads only the files that can hold one.  Messages
reported closed leave for an archive at the next merge; their runs have no filter and no lookup sees
them, so what a batch reads depends on the open messages, not on the length of the stream.  A closed message
that is written again gets a new ``life``, and a reader takes all lives together.

What counts is a manifest per batch, written last; a repeated batch overwrites its run and its manifest.  Runs that no
recent manifest names are deleted after ``grace`` further batches.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakstone.sources.session import at_folder

MESSAGE = ["session_id", "thread_id", "id"]
VERSION = [*MESSAGE, "block", "life"]  # the newest batch of each is the valid one
KEYS = "session_id string, thread_id string, id string, block long, life long"
SCHEMA = f"{KEYS}, rows string, batch long"
PAGE = 1 << 15  # bits of one bitmap


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*MESSAGE), F.lit(buckets)).cast("int")


def _places(bits: Column) -> Column:
    """The two bits of a message in a bitmap of ``bits`` bits."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(salt), *MESSAGE), bits) for salt in (1, 2)])


def newest(versions: DataFrame) -> DataFrame:
    """The last version of every (message, block, life)."""
    last = F.max_by(F.struct("rows", "batch"), "batch")
    return versions.groupBy(*VERSION).agg(last.alias("v")).select(*VERSION, "v.rows", "v.batch")


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, fanout: int = 4, grace: int = 4) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets, self.fanout, self.grace = buckets, fanout, grace

    # --- manifests ---

    def manifest(self, before: int | None = None) -> dict:
        """The newest manifest, or the newest of a batch before ``before``."""
        found: list[int] = []

        def look(files, target) -> None:
            for f in files.globStatus(target) or []:
                found.append(int(f.getPath().getName().removesuffix(".json")))

        at_folder(self.spark, f"{self.path}/manifests/*.json", look)
        numbers = [n for n in found if before is None or n < before]
        if not numbers:
            return {"batch": -1, "runs": [], "retired": {}}
        content: list[str] = []

        def read(files, target) -> None:
            stream = files.open(target)
            content.append(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()

        at_folder(self.spark, f"{self.path}/manifests/{max(numbers)}.json", read)
        return json.loads(content[0])

    def _commit(self, manifest: dict) -> None:
        content = json.dumps(manifest).encode()

        def put(files, target) -> None:
            # Written beside and renamed, so a reader sees it whole or not at all.
            draft = target.suffix(".draft")
            out = files.create(draft, True)
            out.write(bytearray(content))
            out.close()
            files.delete(target, False)
            if not files.rename(draft, target):
                raise OSError(f"manifest {target} was not published")

        at_folder(self.spark, f"{self.path}/manifests/{manifest['batch']}.json", put)

    def _delete(self, folder: str) -> None:
        at_folder(self.spark, folder, lambda files, target: files.delete(target, True))

    # --- writing ---

    def write(self, versions: DataFrame, batch: int, closed: DataFrame | None = None) -> None:
        """Upsert a batch's versions; ``closed`` names (message, block, life) that will not be looked up again.

        A batch reads at most the runs it merges, and a row is merged once a level.
        """
        manifest = self.manifest(before=batch)
        if closed is not None:
            closed.select(*VERSION).write.mode("overwrite").parquet(f"{self.path}/closed/batch={batch}")
        runs = [*manifest["runs"], self._run(versions.withColumn("batch", F.lit(batch).cast("long")), f"L0-{batch}", 0, batch)]
        retired = {name: at for name, at in manifest["retired"].items() if at > batch - self.grace}
        gone = [name for name in manifest["retired"] if name not in retired]
        for is_open in (True, False):
            level = 0
            while True:
                runs = [r for r in runs if r["rows"]]
                merged = [r for r in runs if r["open"] == is_open and r["level"] == level]
                if len(merged) < self.fanout:
                    break
                level += 1
                runs = [r for r in runs if r not in merged] + self._merge(merged, level, batch, is_open)
                retired |= {r["name"]: batch for r in merged}
        self._commit({"batch": batch, "runs": runs, "retired": retired})
        for name in gone:
            self._delete(f"{self.path}/runs/run={name}")
            self._delete(f"{self.path}/filters/run={name}")

    def _merge(self, merged: list[dict], level: int, batch: int, is_open: bool) -> list[dict]:
        """Versions to the next level; closed ones leave the open runs for the archive."""
        first, latest = min(r["first"] for r in merged), newest(self._read(merged))
        if not is_open:
            return [self._run(latest, f"A{level}-{batch}", level, first, False)]
        # A version cannot be closed before it was written, so older closings say nothing about these runs.
        there: list[bool] = []
        at_folder(self.spark, f"{self.path}/closed", lambda files, target: there.append(files.exists(target)))
        if not there[0]:
            return [self._run(latest, f"L{level}-{batch}", level, first)]
        closings = self.spark.read.schema(f"{KEYS}, batch long").parquet(f"{self.path}/closed")
        closed = closings.where(F.col("batch") >= first).select(*VERSION).distinct()
        return [
            self._run(latest.join(closed, VERSION, "left_anti"), f"L{level}-{batch}", level, first),
            self._run(latest.join(closed, VERSION, "left_semi"), f"C{level}-{batch}", 0, first, False),
        ]

    def _run(self, versions: DataFrame, name: str, level: int, first: int, is_open: bool = True) -> dict:
        folder = f"{self.path}/runs/run={name}"
        dealt = versions.withColumn("bucket", _bucket(self.buckets)).repartition("bucket")
        dealt.sortWithinPartitions("bucket", *VERSION).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(folder)
        messages = written.select(*MESSAGE, "bucket").distinct()
        per_bucket = messages.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
        run = {"name": name, "level": level, "first": first, "open": is_open, "rows": per_bucket[0] or 0}
        if is_open and run["rows"]:
            run["pages"] = -(-16 * per_bucket[1] // PAGE)
            place = F.explode(_places(F.lit(run["pages"] * PAGE)))
            bits = messages.select("bucket", place.alias("place")).select(
                "bucket", F.call_function("div", "place", F.lit(PAGE)).alias("page"), (F.col("place") % PAGE).alias("bit")
            )
            pages = bits.groupBy("bucket", "page").agg(F.bitmap_construct_agg("bit").alias("bits"))
            pages.write.mode("overwrite").parquet(f"{self.path}/filters/run={name}")
        return run

    # --- reading ---

    def _read(self, runs: list[dict], only: dict[str, list[int]] | None = None) -> DataFrame:
        folders = []
        for run in runs:
            folder = f"{self.path}/runs/run={run['name']}"
            folders += [folder] if only is None else [f"{folder}/bucket={b}" for b in only.get(run["name"], [])]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", f"{self.path}/runs").parquet(*folders)

    def files_for(self, messages: DataFrame, batch: int | None = None) -> dict[str, list[int]]:
        """Buckets of each open run whose filter holds one of ``messages``: at most runs x buckets names."""
        runs = [r for r in self.manifest(None if batch is None else batch + 1)["runs"] if r["open"]]
        if not runs:
            return {}
        named = F.explode(F.array(*[F.struct(F.lit(r["name"]).alias("run"), F.lit(r["pages"]).alias("pages")) for r in runs]))
        asked = (
            messages.select(*MESSAGE).distinct().select(*MESSAGE, _bucket(self.buckets).alias("bucket"), named.alias("r"))
            .select(*MESSAGE, "bucket", "r.run", F.explode(_places(F.col("r.pages") * PAGE)).alias("place"))
            .withColumns({"page": F.call_function("div", "place", F.lit(PAGE)), "bit": F.col("place") % PAGE})
        )
        pages = self.spark.read.option("basePath", f"{self.path}/filters").parquet(
            *[f"{self.path}/filters/run={r['name']}" for r in runs]
        )
        byte = F.substring("bits", (F.call_function("div", "bit", F.lit(8)) + 1).cast("int"), F.lit(1))
        number = F.conv(F.hex(byte), 16, 10).cast("int")
        is_set = F.pmod(F.floor(number / F.pow(F.lit(2), F.col("bit") % 8)), F.lit(2)) == 1
        held = (
            asked.join(pages, ["run", "bucket", "page"]).where(is_set)
            .groupBy(*MESSAGE, "run", "bucket").agg(F.count_distinct("place").alias("n"))
            # Both places of a message may be one and the same bit.
            .join(asked.groupBy(*MESSAGE, "run").agg(F.count_distinct("place").alias("of")), [*MESSAGE, "run"]).where("n = of")
        )
        found: dict[str, list[int]] = {}
        for run, bucket in held.select("run", "bucket").distinct().collect():
            found.setdefault(run, []).append(bucket)
        return found

    def lookup(self, messages: DataFrame, batch: int | None = None) -> DataFrame:
        """Newest versions of all open blocks of ``messages`` as of ``batch``."""
        runs = self.manifest(None if batch is None else batch + 1)["runs"]
        held = self._read(runs, self.files_for(messages, batch))
        return newest(held.join(messages.select(*MESSAGE).distinct(), MESSAGE, "left_semi"))

    def versions(self) -> DataFrame:
        """Newest versions of everything, the archive included."""
        return newest(self._read(self.manifest()["runs"]))
