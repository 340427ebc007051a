"""Audit of the release gate: what was asked, what was decided, what was released."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakstone.operators.events import thread_of

# The gated tool and the number of revise-and-resubmit rounds.
RELEASE_TOOL = "generate_final_report"
MAX_ROUNDS = 4


def pending_approvals(log: DataFrame, release_tool: str = RELEASE_TOOL) -> DataFrame:
    """The first call still awaiting a person per session, with the arguments it would release.

    A call is settled by a decision on its id that comes after the request; only open calls count.
    First is by thread (in order of appearance), then by arrival.  The arguments sit in another event,
    found by a join on (session, source event); a request that names no source falls back to the
    call id, then to the last call of the gated tool before it.
    """
    call = F.get("tool_calls", F.lit(0))
    requests = log.where((F.col("type") == "tool.approval_required") & call["id"].isNotNull()).select(
        "session_id", thread_of(F.col("thread_id")).alias("thread_id"), "seq", call["id"].alias("tool_call_id"),
        call["source_event_id"].alias("source_event_id"),
    )
    settled = decisions(log).groupBy("session_id", "tool_call_id").agg(F.max("seq").alias("decided"))
    still = requests.join(settled, ["session_id", "tool_call_id"], "left").where(
        F.col("decided").isNull() | (F.col("decided") < F.col("seq"))
    )
    threads = log.groupBy("session_id", thread_of(F.col("thread_id")).alias("thread_id")).agg(
        F.min("seq").alias("thread_first")
    )
    asked = (
        still.join(threads, ["session_id", "thread_id"])
        .groupBy("session_id")
        .agg(
            F.min_by(
                F.struct("thread_id", "tool_call_id", "source_event_id", F.col("seq").alias("asked_at")), F.struct("thread_first", "thread_id", "seq")
            ).alias("a")
        )
        .select("session_id", "a.*")
    )
    calls = log.where(F.col("type") != "tool.approval_required").select(
        "session_id", F.col("id").alias("event_id"), "seq", F.posexplode("tool_calls").alias("ordinal", "call")
    ).select(
        "session_id", "event_id",
        F.struct("seq", "ordinal").alias("at"),
        F.col("call.id").alias("call_id"),
        F.col("call.function.name").alias("tool"),
        F.coalesce("call.function.arguments", F.lit("")).alias("arguments"),
    )

    def first(matches: DataFrame, rank: int) -> DataFrame:
        nearest = F.min_by("arguments", "at") if rank == 0 else F.max_by("arguments", "at")
        return matches.groupBy("session_id").agg(nearest.alias("arguments")).withColumn("rank", F.lit(rank))

    sourced = asked.where("source_event_id is not null").withColumnRenamed("source_event_id", "event_id")
    by_source = sourced.join(calls, ["session_id", "event_id"]).where(
        (F.col("call_id") == F.col("tool_call_id")) | (F.col("tool") == release_tool)
    )
    loose = asked.where("source_event_id is null").select("session_id", "tool_call_id", "asked_at")
    by_id = loose.join(calls.withColumnRenamed("call_id", "tool_call_id"), ["session_id", "tool_call_id"])
    by_tool = loose.join(calls.where(F.col("tool") == release_tool), "session_id").where("at.seq < asked_at")
    found = first(by_source, 0).union(first(by_id, 0)).union(first(by_tool, 1))
    proposed = found.groupBy("session_id").agg(F.min_by("arguments", "rank").alias("arguments"))
    return asked.join(proposed, "session_id", "left").select(
        "session_id", "thread_id", "tool_call_id", F.coalesce("arguments", F.lit("")).alias("arguments")
    )


def decisions(log: DataFrame) -> DataFrame:
    """Every recorded decision, in the order taken."""
    return log.where((F.col("type") == "user.tool_approval") & F.col("approval").isNotNull()).select(
        "session_id", "seq", F.col("id").alias("tool_call_id"),
        (F.col("approval.status") == "allow").alias("allowed"),
        F.col("approval.reason").alias("reason"),
    )


def approval_outcomes(taken: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Per run: approved, rounds, denial reasons oldest first, whether rounds ran out, and where it ended.

    A run ends at an allow or after ``max_rounds`` denials; the next decision of the session opens
    the next run.  ``run`` counts from 0, ``decided`` is the number of the run's last decision.
    """
    order = Window.partitionBy("session_id").orderBy("seq")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    allows = F.coalesce(F.sum(F.col("allowed").cast("int")).over(earlier), F.lit(0))
    since = Window.partitionBy("session_id", "allows").orderBy("seq")
    placed = taken.withColumn("allows", allows).withColumn("place", F.row_number().over(since) - 1)
    part = (F.col("place") / max_rounds).cast("int")
    rounds = placed.withColumn("part", part).groupBy("session_id", "allows", "part").agg(
        F.bool_or("allowed").alias("approved"),
        F.count(F.lit(1)).alias("rounds"),
        F.array_sort(F.collect_list(F.when(~F.col("allowed"), F.struct("seq", "reason")))).alias("denied"),
        F.max("seq").alias("decided"),
    )
    runs = F.row_number().over(Window.partitionBy("session_id").orderBy("allows", "part")) - 1
    return rounds.select(
        "session_id",
        runs.cast("bigint").alias("run"),
        "approved",
        "rounds",
        F.transform("denied", lambda d: F.coalesce(d["reason"], F.lit(""))).alias("denials"),
        (~F.col("approved") & (F.col("rounds") >= max_rounds)).alias("exhausted"),
        "decided",
    )


def reconcile_releases(outcomes: DataFrame, releases: DataFrame) -> DataFrame:
    """Sessions whose releases do not follow from their approvals, with how many of each kind.

    Every approval allows one release, after it.  ``releases`` has one row per released report with
    its ``session_id`` and ``at``, on the same scale as the decisions (a sequence number, or a time if
    ``outcomes`` was given one as ``decided``).  A release at which no approval is left is
    one without approval; an approval that no later release uses was not released.
    """
    events = outcomes.where("approved").select("session_id", F.col("decided").alias("at"), F.lit(1).alias("step"))
    events = events.unionByName(releases.select("session_id", "at", F.lit(-1).alias("step")))
    order = Window.partitionBy("session_id").orderBy("at", F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    # How far releases have run ahead of approvals at worst is how many had none.
    balance = events.withColumn("balance", F.sum("step").over(order))
    counted = balance.groupBy("session_id").agg(
        F.count_if(F.col("step") > 0).alias("approvals"),
        F.count_if(F.col("step") < 0).alias("releases"),
        F.greatest(F.lit(0), -F.min("balance")).cast("bigint").alias("without_approval"),
    )
    left = F.col("approvals") - (F.col("releases") - F.col("without_approval"))
    return counted.withColumn("not_released", left).where("without_approval > 0 OR not_released > 0")
