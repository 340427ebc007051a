"""Table and text readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakstone.functions.text import as_text


_ROW = "_unread_row"


def read_text_csv(
    spark: SparkSession, path: str | list[str], columns: list[str] | None = None, multiline: bool = True
) -> DataFrame:
    """A CSV with every cell as written: all text, blanks as '', padding kept.

    No cell is lost: a row that does not fit the header stops the read, at the first action over
    it.  Quoted line breaks are read; ``multiline=False`` lets large files be split between tasks, and then
    a quote left open at the end of a line stops the read too.
    """
    reader = (
        spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _ROW)
    )
    if columns is None:
        columns = reader.csv(path).columns
    quoted = [c.replace("`", "``") for c in columns]
    rows = reader.schema(", ".join(f"`{c}` string" for c in [*quoted, _ROW])).csv(path)
    broken = F.col(_ROW).isNotNull()
    if not multiline:
        for c in quoted:  # an open quote runs on to the end of its line
            broken = broken | F.coalesce(F.col(f"`{c}`").startswith('"') & ~F.col(f"`{c}`").endswith('"'), F.lit(False))
    stop = F.raise_error(F.lit("a row of the CSV does not fit its header")).cast("string")
    return rows.select(
        *[F.when(broken, stop).otherwise(F.coalesce(f"`{c}`", F.lit(""))).alias(n) for c, n in zip(quoted, columns, strict=True)]
    )


def read_typed_csv(spark: SparkSession, path: str) -> DataFrame:
    """The same CSV with inferred types (one extra pass over the file)."""
    return spark.read.option("header", True).option("escape", '"').option("inferSchema", True).csv(path)


def dtype_names(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """RFC 4180 part files with a header; padding survives the round trip."""
    (
        df.write.mode(mode).option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_corpus(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """Lines of every existing path as ``(source, line)``, with the list of paths read.

    Undecodable bytes are replaced, not fatal; absent paths are skipped.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        found = hadoop.Path(path)
        matches = found.getFileSystem(conf).globStatus(found)
        return matches is not None and len(matches) > 0

    present = [path for path in paths if there(path)]
    if not present:
        return spark.createDataFrame([], "source string, line string"), []
    lines = spark.read.text(present)
    return lines.select(
        F.col("_metadata.file_path").alias("source"), F.make_valid_utf8("value").alias("line")
    ), present


def table_lines(df: DataFrame, separator: str = ",") -> Column:
    """A row of a table as one searchable line."""
    return F.concat_ws(separator, *[as_text(c) for c in df.columns])


def table_digest(df: DataFrame) -> DataFrame:
    """Content digest that ignores row and file order: rows and a sum of row hashes.

    Each field is hashed with its length in front, so no two tables collide by moving
    a separator; the sum of 60-bit slices of sha256 fits a decimal(38).
    """
    fields = [F.concat(F.length(as_text(c)).cast("string"), F.lit(":"), as_text(c)) for c in df.columns]
    row_hash = F.conv(F.substring(F.sha2(F.concat(*fields), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(row_hash), F.lit(0)).cast("string").alias("digest"),
    )


def append_release(
    spark: SparkSession, path: str, session_id: str, at: int, title: str, summary: str
) -> None:
    """Append one released report to the release log; ``at`` is the session's event number then."""
    row = spark.createDataFrame(
        [(session_id, at, title, summary)], "session_id string, at bigint, title string, summary string"
    )
    row.withColumn("released_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def append_releases(releases: DataFrame, path: str) -> None:
    """Append many released reports (session_id, at, title, summary) in one write."""
    rows = releases.select("session_id", F.col("at").cast("bigint").alias("at"), "title", "summary")
    rows.withColumn("released_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_documents(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document per row, null fields included so consumers see every key."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_scrubbed(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
