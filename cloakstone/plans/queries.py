"""The registered queries: each reads whole tables from a folder of parquet files."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakstone.functions.detectors import DETECTORS
from cloakstone.operators import approval, boundary, classify, deid, events, payload_table, scan, stats, values, verify
from cloakstone.plans.event_view import event_log, release_log
from cloakstone.plans.trial_view import COLUMNS, trial_view
from cloakstone.sources import releases
from cloakstone.sources.canary import Canary, read_candidates
from cloakstone.sources.event_log import parse_sequence, read_event_log, stream_event_log
from cloakstone.sources.paged import read_paged_history, write_pages
from cloakstone.sources.session import keep, shared_folder, tune
from cloakstone.sources.planting import mint_canary, plant, planted_counts
from cloakstone.sources.tables import (
    append_releases, dtype_names, read_corpus, read_text_csv, read_typed_csv, table_digest, write_csv, write_documents, write_scrubbed,
)
from cloakstone.streaming import live_values, merge, trace, turns
from cloakstone.streaming.store import MESSAGE, Store

# A fixed record for the registered queries (library runs mint a random one).
CANARY = Canary("900-00-9999", "Philomena Nightingale", 41, "STUDY-0000041")
CANARY_TEXT = '{"ssn":"900-00-9999","name":"Philomena Nightingale","row_index":41}'
# Strings that do occur in the documents, to give the planted-value search something to find.
PLANTED = {"phrase": "une le", "word": "hahaha", "empty": ""}
IDENTIFIERS = COLUMNS[:8]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @functools.wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(tune(spark), folder)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trial(spark: SparkSession, folder: str, keep_key: bool = False) -> DataFrame:
    return trial_view(table(spark, folder, "orders"), keep_key)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", "source")


def scrubbed(spark: SparkSession, folder: str) -> DataFrame:
    return deid.scrub(trial(spark, folder))


def log(spark: SparkSession, folder: str) -> DataFrame:
    return event_log(table(spark, folder, "conversations"))


def merged(spark: SparkSession, folder: str) -> DataFrame:
    return events.merge_events(log(spark, folder))


def visible(spark: SparkSession, folder: str) -> DataFrame:
    rows = events.visible_rows(merged(spark, folder))
    return rows.withColumn("text_id", F.concat_ws("/", "session_id", "thread_id", "id"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded: summation order differs between engines."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


# --- classification -------------------------------------------------------------------


@query
def classify_verdict(spark, folder):
    out = classify.classify(trial(spark, folder))
    return out.withColumn("ordinal", F.col("ordinal").cast("bigint")).drop("example")


@query
def classify_orders_columns(spark, folder):
    """Typing of every column of three tables: nothing in them is an identifier by accident."""
    out = None
    for name in ("orders", "customer", "supplier"):
        source = table(spark, folder, name)
        # Dates and doubles as both engines write them.
        columns = [F.col(c).cast("date").alias(c) if t.startswith("timestamp") else F.col(c).cast("decimal(18,2)").alias(c) if t == "double" else F.col(c) for c, t in source.dtypes]
        typed = classify.classify(source.select(*columns)).select(
            F.lit(name).alias("table_name"), "name", "dtype", "populated", "blank", "pii_type", "match_rate"
        )
        out = typed if out is None else out.union(typed)
    return out


@query
def detector_counts(spark, folder):
    """The match matrix itself: columns x detectors."""
    profile = classify.profile_columns(trial(spark, folder))
    return profile.select(
        F.col("column").alias("name"), "n_cells", "populated", "n_any",
        *[f"n_{d.pii_type}" for d in DETECTORS],
    )


@query
def verdict_columns(spark, folder):
    """The nested verdict document, flattened for comparison."""
    document = classify.verdict_document(classify.classify(trial(spark, folder)), "run-1")
    return document.select(
        F.col("schema_version").cast("bigint").alias("schema_version"), "run_id", "row_count", "column_count",
        F.array_join("pii_columns", ",").alias("pii_columns"), F.explode("columns").alias("c"),
    ).select("schema_version", "run_id", "row_count", "column_count", "pii_columns", "c.name", "c.pii_type")


@query
def output_backstop(spark, folder):
    """A verdict passes; the same text with cells of the table in it does not."""
    df = trial(spark, folder)
    allowed = classify.metadata_strings(df)
    output = classify.rendered(classify.verdict_document(classify.classify(df), "run-1"))
    clean = classify.exposed_values(df, output, allowed).select(F.lit("verdict").alias("output"), "*")
    unsafe = "site SITE-03 reports STUDY-0000041 and STUDY-0000042, Treatment arm, seen 1950-03-13"
    leaky = classify.exposed_values(df, unsafe, allowed).select(F.lit("leaky").alias("output"), "*")
    return clean.union(leaky)


# --- de-identification ----------------------------------------------------------------


@query
def scrub_trial(spark, folder):
    return scrubbed(spark, folder).withColumn("adverse_event", F.col("adverse_event").cast("bigint"))


@query
def scrub_by_verdict(spark, folder):
    """Columns chosen by the verdict: a renamed identifier is suppressed although no rule names it."""
    df = trial(spark, folder).withColumnRenamed("ssn", "remarks")
    found, _ = classify.identifier_columns(classify.classify(df))
    out = deid.scrub(df, identifiers=found)
    return out.withColumn("adverse_event", F.col("adverse_event").cast("bigint"))


@query
def scrub_summary(spark, folder):
    return deid.scrub_summary(trial(spark, folder))


@query
def dob_parse_failures(spark, folder):
    """Dates spoiled in known places: counted, never quoted."""
    df = trial(spark, folder, keep_key=True)
    i = F.col("i")
    spoiled = (
        F.when(i % 97 == 0, F.concat(F.lit("31/31/"), F.lit("1970")))
        .when(i % 89 == 0, "unknown").when(i % 83 == 0, F.concat(F.lit("  "), F.col("dob"), F.lit("\t")))
        .when(i % 79 == 0, "").when(i % 73 == 0, "2030-01-01").otherwise(F.col("dob"))
    )
    return deid.scrub_summary(df.withColumn("dob", spoiled).drop("i")).select(
        "row_count", "dob_unparsed", "dob_in_future"
    )


@query
def age_bands(spark, folder):
    return scrubbed(spark, folder).groupBy("age_band").agg(F.count(F.lit(1)).alias("n"))


@query
def pseudonyms_keyed(spark, folder):
    """Record numbers under a secret key."""
    return deid.scrub(trial(spark, folder), key=b"a key of the release").select("subject_pseudo_id", "site")


@query
def pseudonym_collisions(spark, folder):
    return deid.pseudonym_collisions(trial(spark, folder))


@query
def table_digest_trial(spark, folder):
    return table_digest(trial(spark, folder))


# --- verification ---------------------------------------------------------------------


def _verification(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("schema_version").cast("bigint").alias("schema_version"), "check", "row_count",
        F.array_join("columns", ",").alias("columns"),
        F.array_join(
            F.transform("surviving_identifier_columns", lambda c: F.concat_ws(":", c["name"], c["pii_type"])), ","
        ).alias("survivors"),
        "canary_present", "run_id", "passed", F.coalesce("error", F.lit("")).alias("error"),
    )


@query
def verify_scrubbed(spark, folder):
    return _verification(verify.verify(scrubbed(spark, folder), CANARY_TEXT, "run-1"))


@query
def verify_unscrubbed(spark, folder):
    df = plant(trial(spark, folder, keep_key=True), "i", CANARY.row_index, CANARY).drop("i")
    return _verification(verify.verify(df, CANARY_TEXT, "run-1"))


@query
def verify_without_canary(spark, folder):
    return _verification(verify.verify(scrubbed(spark, folder), None, "run-1", canary_required=True))


@query
def surviving_identifiers(spark, folder):
    """A renamed identifier and a shared code next to clean columns."""
    df = trial(spark, folder).select(
        F.col("ssn").alias("notes"), "site", F.col("subject_id").alias("ref"), F.lower("arm").alias("arm")
    )
    return verify.surviving_identifiers(df).drop("ordinal")


@query
def canary_exactly_once(spark, folder):
    df = plant(trial(spark, folder, keep_key=True), "i", CANARY.row_index, CANARY)
    return planted_counts(df, CANARY)


@query
def canary_survival(spark, folder):
    """Planted values as substrings of any cell of a row, free text included."""
    return verify.canary_counts(documents(spark, folder).select("text", "source"), PLANTED)


# --- leak scan ------------------------------------------------------------------------


@query
def pattern_hits(spark, folder):
    return scan.scan_text(documents(spark, folder), "doc_id", "text")


@query
def pattern_hits_pages(spark, folder):
    """The same over raw web pages, where years and numbers pass the cheap gates."""
    return scan.scan_text(table(spark, folder, "pages"), "page_id", "html")


@query
def pattern_hits_allowed(spark, folder):
    """The allow-list drops pattern hits; offsets stay those of the whole text."""
    hits = visible_hits(spark, folder)
    return hits.where("severity = 'pattern'").drop("severity")


def visible_hits(spark, folder):
    return scan.scan_text(
        visible(spark, folder), "text_id", "text", allow=["p5@example.com", "p18@example.com"]
    )


@query
def canary_scan(spark, folder):
    return scan.scan_text(documents(spark, folder), "doc_id", "text", PLANTED, patterns=())


@query
def pattern_summary(spark, folder):
    return scan.hit_summary(scan.raw_hits(documents(spark, folder), "doc_id", "text"))


@query
def document_verdicts(spark, folder):
    docs = documents(spark, folder)
    return scan.text_verdicts(docs, "doc_id", "text", scan.raw_hits(docs, "doc_id", "text", PLANTED))


@query
def redact_documents(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    return scan.redact(docs, "text", {"phrase": "une le"}).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("digest")
    )


@query
def pattern_candidates(spark, folder):
    hits = scan.raw_hits(documents(spark, folder), "doc_id", "text")
    return scan.pattern_candidates(hits).select(
        F.substring(F.sha2("candidate", 256), 1, 12).alias("fingerprint"),
        F.length("candidate").cast("bigint").alias("length"),
    )


@query
def adjudicate_candidates(spark, folder):
    """Identifier-shaped strings of the documents, looked for in the pages."""
    hits = scan.raw_hits(documents(spark, folder), "doc_id", "text")
    return values.adjudicate(
        scan.pattern_candidates(hits), table(spark, folder, "pages"), "page_id", "html"
    )


def _contained(spark, folder, bits):
    items = table(spark, folder, "benchmark").select(F.col("text").alias("value"))
    pairs = values.containment_pairs(documents(spark, folder), "doc_id", "text", items, bits)
    return pairs.select("doc_id", F.substring(F.sha2("value", 256), 1, 12).alias("fingerprint"), "occurrences")


@query
def value_scan_small(spark, folder):
    """Benchmark passages inside documents: the pairs."""
    return _contained(spark, folder, values.FILTER_BITS)


@query
def value_scan_anchored(spark, folder):
    """Identifier values of the trial inside the visible text of the event log, per column."""
    return values.value_scan(visible(spark, folder), "text_id", "text", trial(spark, folder), IDENTIFIERS)


@query
def value_scan_sliced(spark, folder):
    """The same with a filter so small that nearly everything passes it: the join settles it."""
    return values.value_scan(
        visible(spark, folder), "text_id", "text", trial(spark, folder), [*IDENTIFIERS, "no_such_column"], 1 << 18
    )


@query
def boundary_verdict(spark, folder):
    """The event log prints trial rows in places and has gaps, so the boundary does not hold."""
    return boundary.check_boundary(
        visible(spark, folder), "text_id", "text", CANARY, [trial(spark, folder)], IDENTIFIERS,
        gaps=events.sequence_gaps(log(spark, folder)),
    )


@query
def boundary_documents(spark, folder):
    """Documents hold lookalikes, but none of the trial's values."""
    return boundary.check_boundary(
        documents(spark, folder), "doc_id", "text", CANARY, [trial(spark, folder)], IDENTIFIERS,
        gaps=None,  # documents are no event log: they have no numbers
    )


@query
def leak_proof_summary(spark, folder):
    raw = trial(spark, folder)
    verdict = boundary.check_boundary(
        visible(spark, folder), "text_id", "text", CANARY, [raw, scrubbed(spark, folder)], IDENTIFIERS,
        gaps=events.sequence_gaps(log(spark, folder)),
    )
    return boundary.proof_summary(verdict, raw, IDENTIFIERS, events.thread_summary(log(spark, folder)))


@query
def aggregate_only_report(spark, folder):
    """The report table scanned for identifier shapes: no hit may come back."""
    report = stats.report_table(scrubbed(spark, folder), inference=False)
    flat = report.select(F.monotonically_increasing_id().alias("row"), F.to_json(F.struct("*")).alias("text"))
    hits = scan.raw_hits(flat, "row", "text", CANARY.values())
    return hits.agg(F.count(F.lit(1)).alias("hits"))


# --- event log ------------------------------------------------------------------------


def _conversation_log(spark, folder):
    return table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq")
    )


@query
def merge_deltas(spark, folder):
    return _digested(merged(spark, folder))


def _digested(messages):
    return messages.select(
        "session_id", "thread_id", "id", "type", "first_seq", "last_seq",
        F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("digest"), "reasoning",
    )


@query
def event_order(spark, folder):
    """Reading order: threads by first appearance, events by arrival within them."""
    ordered = events.reading_order(merged(spark, folder))
    return ordered.select("session_id", "thread_id", "id", "thread_first_seq", "first_seq", "position")


@query
def visible_text(spark, folder):
    return visible(spark, folder).select("text_id", "first_seq", "type", "text")


@query
def main_text(spark, folder):
    return events.main_text(merged(spark, folder))


@query
def thread_summary(spark, folder):
    return events.thread_summary(log(spark, folder))


@query
def session_summary(spark, folder):
    return events.session_summary(log(spark, folder))


@query
def last_sequence(spark, folder):
    """Highest sequence number per user of the event table, from its text form."""
    numbered = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("session_id"),
        parse_sequence(F.col("event_id").cast("string")).alias("seq"),
        F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("turn_id"),
        F.lit(None).cast("string").alias("sandbox_id"),
    )
    return events.session_summary(numbered).select("session_id", "last_sequence")


@query
def event_type_histogram(spark, folder):
    return events.type_histogram(table(spark, folder, "events"), "event_type")


@query
def log_type_histogram(spark, folder):
    return events.type_histogram(log(spark, folder))


@query
def sequence_gaps(spark, folder):
    return events.sequence_gaps(_conversation_log(spark, folder))


@query
def exec_results(spark, folder):
    return events.exec_results(merged(spark, folder)).drop("thread_id")


@query
def exec_failures(spark, folder):
    return events.exec_failures(events.exec_results(merged(spark, folder))).drop("thread_id")


def _payloads(spark, folder):
    results = events.exec_results(merged(spark, folder))
    return events.embedded_payloads(results, ["session_id", "id", "first_seq"], "output")


def _judged(spark, folder):
    return events.judged_payloads(_payloads(spark, folder), F.concat(F.lit("run-"), "session_id"))


@query
def embedded_payloads(spark, folder):
    return _payloads(spark, folder)


@query
def embedded_payloads_sql(spark, folder):
    """The same from outputs cut into short rows, by a table function that goes on from row to row."""
    results = events.exec_results(merged(spark, folder))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("output")), F.lit(37))
    key = F.struct("session_id", "id", "first_seq")
    pieces = results.select(F.to_json(key).alias("key"), "output", F.posexplode(starts).alias("seq", "start")).select(
        "key", "seq", F.substring("output", F.col("start"), F.lit(37)).alias("text")
    )
    named = F.from_json("key", "session_id string, id string, first_seq bigint")
    return payload_table.payloads_over(pieces).select(named.alias("k"), "ordinal", "payload").select("k.*", "ordinal", "payload")


@query
def bound_payloads(spark, folder):
    return events.bound_payloads(_judged(spark, folder), ["session_id"], ["first_seq", "ordinal"])


@query
def rejected_payloads(spark, folder):
    return events.rejected_payloads(_judged(spark, folder))


# --- streaming ------------------------------------------------------------------------


def _streamed(spark, folder, start, **options):
    """Write the log as JSON files, run a stream over them to the end, return its table."""
    run = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    log(spark, folder).repartition(4, "session_id").write.json(f"{run}/log")
    stream = stream_event_log(spark, f"{run}/log", 2)
    start(stream, f"{run}/table", f"{run}/checkpoint", **options).awaitTermination()
    return f"{run}/table"


@query
def stream_merge(spark, folder):
    """The event log merged incrementally, files arriving in several batches."""
    return _digested(merge.merged_view(spark, _streamed(spark, folder, merge.start_merge)))


@query
def stream_live_hits(spark, folder):
    """Pattern hits found while the log streams."""
    hits = merge.live_hits(spark, _streamed(spark, folder, merge.start_live_scan))
    return hits.drop("severity")


@query
def stream_gaps(spark, folder):
    """Numbers missing, counted over what the stream kept."""
    return merge.stream_gaps(spark, _streamed(spark, folder, merge.start_merge, block=16))


@query
def stream_verdict(spark, folder):
    """The verdict of a live scan whose messages cross blocks and batches; its log has gaps, so it fails."""
    table = _streamed(spark, folder, merge.start_live_scan, block=2)
    return merge.stream_verdict(spark, table, dropped_rows=0)  # no watermark, so nothing is ever late


@query
def event_log_roundtrip(spark, folder):
    """The log written with camelCase names and text numbers, read back and merged."""
    run = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    camel = {
        "seq": F.col("seq").cast("string"), "threadId": F.col("thread_id"), "reasoningContent": F.col("reasoning_content"),
        "toolCalls": F.col("tool_calls"), "turnId": F.col("turn_id"), "sandboxId": F.col("sandbox_id"),
    }
    kept = ["session_id", "id", "type", "content", "approval"]
    log(spark, folder).select(*kept, *[c.alias(n) for n, c in camel.items()]).write.json(run)
    return _digested(events.merge_events(read_event_log(spark, run)))


@query
def paged_history(spark, folder):
    """The log as pages, newest first: read up to a number as a stream's first part, then from there on, and merged."""
    path = _scratch(spark, "pages")
    write_pages(log(spark, folder), path, 20)
    whole, later = read_paged_history(spark, path), read_paged_history(spark, path, 100)
    return _digested(events.merge_events(whole.where("seq <= 100").unionByName(later)))


@query
def stream_value_scan(spark, folder):
    """Identifier values in the text merged by the stream."""
    rows = events.visible_rows(merge.merged_view(spark, _streamed(spark, folder, merge.start_merge)))
    rows = rows.withColumn("text_id", F.concat_ws("/", "session_id", "thread_id", "id"))
    return values.value_scan(rows, "text_id", "text", trial(spark, folder), IDENTIFIERS)


@query
def stream_resumed(spark, folder):
    """A stream stopped after the first files and started again from its checkpoint."""
    run = f"{shared_folder(spark)}/resume-{uuid.uuid4().hex}"
    events_log = log(spark, folder)
    for part in (0, 1):  # a session's events lie in both parts
        half = events_log.where(F.pmod(F.xxhash64("session_id", "seq"), F.lit(2)) == part)
        half.write.mode("append").json(f"{run}/log")
        stream = stream_event_log(spark, f"{run}/log", 4)
        merge.start_merge(stream, f"{run}/table", f"{run}/checkpoint").awaitTermination()
    return _digested(merge.merged_view(spark, f"{run}/table"))


@query
def stream_deduplicated(spark, folder):
    """Events written twice, made distinct while streaming; counted per session."""
    run = f"{shared_folder(spark)}/dedup-{uuid.uuid4().hex}"
    for _ in range(2):
        log(spark, folder).write.mode("append").json(f"{run}/log")
    timed = stream_event_log(spark, f"{run}/log").selectExpr("*", "timestamp_seconds(1000000000 + seq) AS at")
    kept = merge.deduplicated(timed, "at", "1000 days").select("session_id", "seq")
    writer = kept.writeStream.format("parquet").option("checkpointLocation", f"{run}/checkpoint")
    writer.trigger(availableNow=True).start(f"{run}/out").awaitTermination()
    rows = spark.read.schema("session_id string, seq bigint").parquet(f"{run}/out")
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_events"))


def _timed(spark, path):
    """A log's stream with an event time made of its numbers."""
    return stream_event_log(spark, path).selectExpr("*", "timestamp_seconds(1000000000 + seq) AS at")


def _clock(spark, seq):
    """An event of a session of its own that moves the event time on."""
    return spark.createDataFrame([("clock", seq, "clock", "clock")], "session_id string, seq long, id string, type string")


@query
def stream_evicted(spark, folder):
    """Three sessions in four end their turn: their messages leave the state, and all stay in the table."""
    run = f"{shared_folder(spark)}/turns-{uuid.uuid4().hex}"
    store = Store(spark, f"{run}/table", buckets=4)
    ends = (
        table(spark, folder, "conversations").where("(conv_id div 4) % 4 <> 3").selectExpr("string(conv_id div 4) AS session_id").distinct()
        .selectExpr("session_id", "2000000L AS seq", "concat('done-', session_id) AS id", "'turn.done' AS type")
    )
    for part in (log(spark, folder).unionByName(ends, allowMissingColumns=True), _clock(spark, 20_000_000)):
        part.write.mode("append").json(f"{run}/log")
        turns.start_turns(
            _timed(spark, f"{run}/log"), store.path, f"{run}/checkpoint", store=store, lateness="30 days", delay="1 hour",
            idle="1000 days", block=1 << 20,
        ).awaitTermination()
    gone = turns.evicted(spark, store.path).select(*MESSAGE, F.lit(True).alias("gone")).distinct()
    return turns.merged_messages(store).join(gone, MESSAGE, "left").select(
        *MESSAGE, "type", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("digest"),
        F.coalesce("gone", F.lit(False)).alias("evicted"),
    )


@query
def stream_late_verdict(spark, folder):
    """Some events come long after the clock has moved on: they are dropped, counted, and the stream fails."""
    run = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    store, ledger = Store(spark, f"{run}/table", buckets=4), turns.Ledger(spark, f"{run}/table")
    late = F.col("seq") % 7 == 3
    in_time = log(spark, folder).where(~late | (F.col("seq") > 400_000)).unionByName(_clock(spark, 3_000_000), allowMissingColumns=True)
    spark.streams.addListener(ledger)
    try:
        for part in (in_time, log(spark, folder).where(late & (F.col("seq") <= 400_000))):
            part.write.mode("append").json(f"{run}/log")
            turns.start_turns(
                _timed(spark, f"{run}/log"), store.path, f"{run}/checkpoint", store=store, lateness="30 days", block=1 << 20
            ).awaitTermination()
        ledger.wait(store.manifest()["batch"])
    finally:
        spark.streams.removeListener(ledger)
    return turns.verdict(store)


@query
def stream_trace(spark, folder):
    """The visible text of the log in deltas cut anywhere, masked while it streams, put together again."""
    run = f"{shared_folder(spark)}/trace-{uuid.uuid4().hex}"
    size = (F.pmod(F.xxhash64("text_id"), F.lit(40)) + 7).cast("int")
    starts = F.sequence(F.lit(1), F.length("text"), size)
    pieces = visible(spark, folder).select("session_id", "thread_id", "id", "text", size.alias("size"), F.posexplode(starts).alias("seq", "start"))
    deltas = pieces.select(
        "session_id", "thread_id", "id", F.col("seq").cast("long").alias("seq"), F.lit("model.message.delta").alias("type"),
        F.substring("text", F.col("start"), F.col("size")).alias("content"),
        (F.col("seq") * 3 * F.col("size") / F.length("text")).cast("int").alias("part"),
    )
    deltas = keep(deltas, "deltas", "part")  # read four times below
    clock = _clock(spark, 20_000_000).withColumns({"part": F.lit(3), "thread_id": F.lit("clock"), "content": F.lit(None).cast("string")})
    for part in range(4):  # a message's deltas arrive in several batches
        deltas.unionByName(clock).where(F.col("part") == part).drop("part").write.mode("append").json(f"{run}/log")
        trace.start_trace(
            _timed(spark, f"{run}/log"), f"{run}/trace", f"{run}/checkpoint", {"phrase": "une le"}, lateness="30 days"
        ).awaitTermination()
    return trace.trace_texts(spark, f"{run}/trace").select(
        F.concat_ws("/", "session_id", "thread_id", "id").alias("text_id"), "skipped",
        F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("digest"),
    )


@query
def stream_live_values(spark, folder):
    """Identifier values of the trial, found in the log's visible text while it streams in two parts."""
    run = f"{shared_folder(spark)}/values-{uuid.uuid4().hex}"
    known = keep(values.compared_cells(trial(spark, folder), IDENTIFIERS).select("value").distinct(), "known")  # for both parts
    for part in (0, 1):  # a message's events lie in both
        log(spark, folder).where(F.pmod(F.xxhash64("session_id", "seq"), F.lit(2)) == part).write.mode("append").json(f"{run}/log")
        live_values.start_live_values(
            _timed(spark, f"{run}/log"), f"{run}/live", f"{run}/checkpoint", known, block=64, buckets=4, lateness="30 days"
        ).awaitTermination()
    return live_values.found_values(spark, f"{run}/live")


# --- approval audit -------------------------------------------------------------------


def _outcomes(spark, folder):
    return approval.approval_outcomes(approval.decisions(log(spark, folder)))


@query
def approval_pending(spark, folder):
    return approval.pending_approvals(log(spark, folder))


@query
def approval_decisions(spark, folder):
    return approval.decisions(log(spark, folder))


@query
def approval_outcome(spark, folder):
    return _outcomes(spark, folder).withColumn("denials", F.array_join("denials", "|"))


@query
def release_reconciliation(spark, folder):
    releases = release_log(table(spark, folder, "conversations"))
    return approval.reconcile_releases(_outcomes(spark, folder), releases)


# --- statistics -----------------------------------------------------------------------

ARMS = ("outcome_measure", "arm", "treatment", "placebo")


@query
def arm_summary(spark, folder):
    return rounded(stats.arm_summary(scrubbed(spark, folder), "outcome_measure", "arm"))


@query
def welch_primary(spark, folder):
    return rounded(stats.welch(scrubbed(spark, folder), *ARMS))


@query
def welch_by_site(spark, folder):
    return rounded(stats.welch(scrubbed(spark, folder), *ARMS, by=["site", "age_band"]))


def _lineitem(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_extendedprice", "l_linestatus")
    return stats.welch(lines, "l_extendedprice", "l_linestatus", "F", "O")


@query
def welch_lineitem(spark, folder):
    return rounded(_lineitem(spark, folder))


@query
def welch_p(spark, folder):
    """p-value and 95% interval of the line item comparison."""
    tests = stats.welch_inference(_lineitem(spark, folder))
    return rounded(tests.select("p_value", "ci_low", "ci_high"), 5)


@query
def chi2_safety(spark, folder):
    """2 x 2, so Yates' correction applies."""
    counts = stats.contingency(scrubbed(spark, folder), "arm", "adverse_event")
    return rounded(stats.chi_square(counts, p_value=False))


@query
def chi2_orders(spark, folder):
    """3 x 5, no correction; the upper tail has a closed form at even degrees."""
    counts = stats.contingency(table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority")
    return rounded(stats.chi_square(counts))


@query
def chi2_by_site(spark, folder):
    counts = stats.contingency(scrubbed(spark, folder), "arm", "adverse_event", by=["site"])
    return rounded(stats.chi_square(counts, by=["site"], p_value=False))


@query
def contingency_safety(spark, folder):
    return stats.contingency(scrubbed(spark, folder), "arm", "adverse_event")


@query
def disposition(spark, folder):
    return stats.disposition(scrubbed(spark, folder), "arm", "outcome_measure")


@query
def report_table(spark, folder):
    return rounded(stats.report_table(scrubbed(spark, folder), inference=False))


@query
def analysis_document(spark, folder):
    """The nested result of a run, flattened for comparison."""
    document = stats.analysis_document(stats.report_table(scrubbed(spark, folder)), "run-1")
    return rounded(
        document.select(
            "run_id", "primary.difference", "primary.t_statistic", "primary.cohens_d",
            F.col("primary.treatment.mean").alias("mean_t"), F.col("primary.placebo.sd").alias("sd_c"),
            "safety.chi2", F.col("safety.treatment.adverse").alias("adverse_t"),
            F.col("disposition.placebo.dropped_out").alias("dropped_c"),
        )
    )


@query
def chi2_yates_p(spark, folder):
    """p of the corrected 2 x 2 test."""
    counts = stats.contingency(scrubbed(spark, folder), "arm", "adverse_event")
    return rounded(stats.chi_square(counts).select("degrees", "p_value"), 5)


# --- sources and sinks, written and read back -------------------------------------------


def _scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def csv_roundtrip(spark, folder):
    """Customers and page sources as CSV: quoted line breaks, quotes and padding survive."""
    path = _scratch(spark, "csv")
    pages = table(spark, folder, "pages").select(F.col("page_id").cast("string").alias("key"), "url", "html")
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("key"), F.concat(F.lit("  "), F.col("c_name"), F.lit('\t"x",\ny ')).alias("url"),
        F.col("c_mktsegment").alias("html"),
    )
    write_csv(pages.unionByName(customers), path)
    back = read_text_csv(spark, path)
    return back.select("key", "url", F.sha2("html", 256).alias("digest"))


@query
def csv_types(spark, folder):
    """Inferred types of the customers' CSV."""
    path = _scratch(spark, "types")
    write_csv(table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), path)
    typed = read_typed_csv(spark, path)
    return typed.agg(
        F.min(F.lit(dtype_names(typed)["c_name"])).alias("name_type"), F.sum("c_custkey").cast("bigint").alias("keys"),
        F.sum("c_nationkey").cast("bigint").alias("nations"),
    )


@query
def corpus_lines(spark, folder):
    """Lines of several files and one that is not there, read at once."""
    path = _scratch(spark, "corpus")
    table(spark, folder, "pages").select("html").write.text(f"{path}/pages")
    table(spark, folder, "documents").select("text").write.text(f"{path}/documents")
    lines, read = read_corpus(spark, [f"{path}/pages", f"{path}/absent", f"{path}/documents"])
    kind = F.regexp_extract("source", r"/(pages|documents)/", 1)
    return lines.groupBy(kind.alias("corpus")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).cast("bigint").alias("n_chars"),
        F.max(F.lit(len(read))).cast("bigint").alias("sources"),
    )


@query
def json_documents(spark, folder):
    """Conversations as JSON documents, one a line, and back."""
    path = _scratch(spark, "json")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", F.nullif("text", F.lit("")).alias("text"))
    write_documents(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query
def scrubbed_sink(spark, folder):
    """The scrubbed table written and read back."""
    path = _scratch(spark, "scrubbed")
    write_scrubbed(scrubbed(spark, folder), path)
    return spark.read.parquet(path).withColumn("adverse_event", F.col("adverse_event").cast("bigint"))


@query
def classify_file(spark, folder):
    """The verdict on the trial as a CSV file, end to end."""
    path = _scratch(spark, "trial")
    write_csv(trial(spark, folder), path)
    document = classify.classify_csv(spark, path, "run-1")
    return document.select(
        F.col("schema_version").cast("bigint").alias("schema_version"), "run_id", "row_count", "column_count",
        F.array_join("pii_columns", ",").alias("pii_columns"), F.explode("columns").alias("c"),
    ).select("schema_version", "run_id", "row_count", "column_count", "pii_columns", "c.name", "c.pii_type")


@query
def candidate_list(spark, folder):
    """Benchmark texts as JSON lists of candidates, one a line, read as a source."""
    path = _scratch(spark, "candidates")
    table(spark, folder, "benchmark").select(F.to_json(F.array("text")).alias("value")).write.text(path)
    return read_candidates(spark, path, lines=True).select(F.substring(F.sha2("candidate", 256), 1, 12).alias("fingerprint"))


@query
def minted_once(spark, folder):
    """A freshly minted record, planted in a row of the trial: found exactly once."""
    raw = trial(spark, folder, keep_key=True)
    canary = mint_canary(raw)
    return planted_counts(plant(raw, "i", CANARY.row_index, canary), canary)


@query
def releases_of_approvals(spark, folder):
    """A release for every approval of the log, appended in one write and reconciled: what is left over is shown."""
    path = _scratch(spark, "all-releases")
    outcomes = _outcomes(spark, folder)
    wanted = outcomes.where("approved").select(
        "session_id", (F.col("decided") + 1).alias("at"), F.lit("Summary").alias("title"), F.lit("text").alias("summary")
    )
    append_releases(wanted, path)
    released = spark.read.parquet(path)
    wrong = approval.reconcile_releases(outcomes, released).select("session_id", F.lit(False).alias("reconciled"))
    return (
        released.select("session_id", "at", "title").join(wrong, "session_id", "left")
        .withColumn("reconciled", F.coalesce("reconciled", F.lit(True)))
    )


@query
def release_log_rows(spark, folder):
    """A release for every approval of the log, appended in one write."""
    path = _scratch(spark, "releases")
    approved = _outcomes(spark, folder).where("approved").select("session_id", "decided")
    append_releases(
        approved.select("session_id", (F.col("decided") + 1).alias("at"), F.lit("Summary").alias("title"), F.lit("text").alias("summary")), path
    )
    released = spark.read.parquet(path)
    return released.select("session_id", "at", "title").join(approved, "session_id", "left_semi").distinct()


@query
def release_commits(spark, folder):
    """Every approval released once, although one writer retries, one never publishes and two overlap."""
    path = _scratch(spark, "commits")
    outcomes = _outcomes(spark, folder)
    wanted = outcomes.where("approved").select(
        "session_id", "decided", (F.col("decided") + 1).alias("at"), F.concat(F.lit("Summary "), "session_id").alias("title"),
        F.lit("text").alias("summary"),
    )
    even = wanted.where(F.pmod(F.col("session_id").cast("bigint"), F.lit(2)) == 0)
    releases.stage(wanted, path)  # a writer lost before it published
    first, second = releases.stage(even, path), releases.stage(wanted, path)  # two writers at the same time
    releases.publish(spark, path, "even", first)
    releases.publish(spark, path, "all", second)
    releases.publish(spark, path, "all", first)  # the name is taken
    releases.release(wanted, path, "even")  # a retry
    releases.release(wanted, path, "again")  # nothing is left to release
    done = releases.released(spark, path)
    wrong = approval.reconcile_releases(outcomes, done).select("session_id", F.lit(False).alias("reconciled"))
    return done.join(wrong, "session_id", "left").select(
        "session_id", "decided", "at", "title", F.coalesce("reconciled", F.lit(True)).alias("reconciled")
    )
