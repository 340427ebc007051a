"""A release log in which a report is released once, however often it is written.

A release is named by its session and the decision that allows it.  A writer first stores its rows in a
folder of its own, then publishes a small manifest that names the folder; what no manifest names does
not exist, so a writer lost half way leaves nothing visible.  A manifest is created, never replaced: its name is
the writer's token, so a retry under one token publishes nothing new.  Two writers with different tokens may publish
the same release; readers take it from the one published first, in the order of the manifests' numbers,
so everyone sees the same row.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakstone.sources.session import at_folder

RELEASE = ["session_id", "decided"]
SCHEMA = "session_id string, decided bigint, at bigint, title string, summary string, released_at timestamp"


def _manifests(spark: SparkSession, path: str) -> list[dict]:
    """Published manifests in their order; one small file each, so as many as there were writers."""
    lines: list[dict] = []
    read = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString

    def look(files, target) -> None:
        for f in files.globStatus(target) or []:
            stream = files.open(f.getPath())
            lines.append(json.loads(read(stream, "UTF-8")))
            stream.close()

    at_folder(spark, f"{path}/commits/*.json", look)
    return sorted(lines, key=lambda m: (m["number"], m["token"]))


def stage(releases: DataFrame, path: str) -> str:
    """Write releases (session_id, decided, at, title, summary) where no reader looks; returns the folder."""
    attempt = uuid.uuid4().hex
    rows = releases.select(*RELEASE, F.col("at").cast("bigint").alias("at"), "title", "summary", F.current_timestamp().alias("released_at"))
    rows.write.parquet(f"{path}/rows/attempt={attempt}")
    return attempt


def publish(spark: SparkSession, path: str, token: str, attempt: str) -> bool:
    """Make a staged folder visible under ``token``; False if a writer with this token has done so before."""
    number = 1 + max((m["number"] for m in _manifests(spark, path)), default=0)
    line = json.dumps({"token": token, "number": number, "attempt": attempt})
    won: list[bool] = []

    def put(files, target) -> None:
        draft = target.suffix(f".{attempt}.draft")
        out = files.create(draft, True)
        out.write(bytearray(line.encode()))
        out.close()
        # HDFS refuses to rename onto a file that is there, so of several writers one wins; where a store
        # replaces it, the last one does, and the release is still visible once.
        won.append(not files.exists(target) and files.rename(draft, target))
        files.delete(draft, False)

    at_folder(spark, f"{path}/commits/{token}.json", put)
    return bool(won[0])


def release(releases: DataFrame, path: str, token: str) -> bool:
    """Stage and publish what is not released yet; False if this token has published before."""
    spark = releases.sparkSession
    if any(m["token"] == token for m in _manifests(spark, path)):
        return False
    new = releases.join(released(spark, path).select(*RELEASE), RELEASE, "left_anti")
    return publish(spark, path, token, stage(new, path))


def released(spark: SparkSession, path: str) -> DataFrame:
    """Every release once: the row of the first manifest that has it."""
    manifests = _manifests(spark, path)
    if not manifests:
        return spark.createDataFrame([], SCHEMA)
    folders = [f"{path}/rows/attempt={m['attempt']}" for m in manifests]
    rows = spark.read.schema(f"{SCHEMA}, attempt string").option("basePath", f"{path}/rows").parquet(*folders)
    order = spark.createDataFrame([(m["attempt"], i) for i, m in enumerate(manifests)], "attempt string, place int")
    first = Window.partitionBy(*RELEASE).orderBy("place", "at", "title", "summary")
    ranked = rows.join(F.broadcast(order), "attempt").withColumn("nth", F.row_number().over(first))
    return ranked.where("nth = 1").drop("attempt", "place", "nth")
