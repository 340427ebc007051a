"""Two-arm endpoint and safety statistics, overall or by strata.

Data rows are touched once, by partial aggregates; tests and intervals are arithmetic on
one row per stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakstone.functions.distributions import chi2_pvalue, t_pvalue, t_quantile


def arm_summary(df: DataFrame, value: str, arm: str, by: list[str] | None = None) -> DataFrame:
    """n, mean and SD per arm; rows without an outcome do not count."""
    return df.groupBy(*(by or []), F.col(arm).alias("arm")).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
    )


def two_arm_moments(
    df: DataFrame, value: str, arm: str, treated: str, control: str, by: list[str] | None = None
) -> DataFrame:
    """Both arms side by side in one pass, so no self-join is needed."""
    aggregates = []
    for tag, level in (("t", treated), ("c", control)):
        x = F.when(F.col(arm) == level, F.col(value))
        aggregates += [
            F.count(x).alias(f"n_{tag}"),
            F.avg(x).alias(f"mean_{tag}"),
            F.stddev_samp(x).alias(f"sd_{tag}"),
        ]
    return df.groupBy(*(by or [])).agg(*aggregates)


def welch(
    df: DataFrame, value: str, arm: str, treated: str, control: str, by: list[str] | None = None
) -> DataFrame:
    """Difference of means, Welch t with its degrees of freedom, and Cohen's d (pooled SD)."""
    return two_arm_moments(df, value, arm, treated, control, by).withColumns(_welch_columns())


def _welch_columns() -> dict[str, Column]:
    """The test from the moments ``n_``, ``mean_`` and ``sd_`` of the arms t and c."""
    n1, n2 = F.col("n_t").cast("double"), F.col("n_c").cast("double")
    v1, v2 = F.col("sd_t") * F.col("sd_t"), F.col("sd_c") * F.col("sd_c")
    e1, e2 = F.try_divide(v1, n1), F.try_divide(v2, n2)
    se2 = e1 + e2
    freedom = F.try_divide(
        se2 * se2, F.try_divide(e1 * e1, n1 - 1) + F.try_divide(e2 * e2, n2 - 1)
    )
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    difference = F.col("mean_t") - F.col("mean_c")
    return {
        "difference": difference,
        "standard_error": F.sqrt(se2),
        "t_statistic": F.try_divide(difference, F.sqrt(se2)),
        "degrees": freedom,
        "cohens_d": F.try_divide(difference, pooled),
    }


def welch_inference(tests: DataFrame, level: float = 0.95) -> DataFrame:
    """Add the two-sided p-value and the confidence interval to rows of :func:`welch`."""
    margin = t_quantile(F.lit(level), F.col("degrees")) * F.col("standard_error")
    return (
        tests.withColumns({"p_value": t_pvalue("t_statistic", "degrees"), "margin": margin})
        .withColumns(
            {
                "ci_low": F.col("difference") - F.col("margin"),
                "ci_high": F.col("difference") + F.col("margin"),
            }
        )
        .drop("margin")
    )


def contingency(df: DataFrame, row: str, column: str, by: list[str] | None = None) -> DataFrame:
    """Counts of ``row`` x ``column``; rows missing either are left out."""
    return (
        df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
        .groupBy(*(by or []), F.col(row).cast("string").alias("row"), F.col(column).cast("string").alias("column"))
        .agg(F.count(F.lit(1)).alias("observed"))
    )


def chi_square(counts: DataFrame, by: list[str] | None = None, p_value: bool = True) -> DataFrame:
    """Chi-square test of independence over a contingency table.

    Margins are window sums over the table of counts, not over data rows.  Cells never
    observed are covered by algebra instead of rows: over all cells, sum (O-E)^2/E is
    N * sum O^2/(row*column) - N over the observed ones.  With one degree of freedom Yates'
    correction applies; there |O-E| is the same in all four cells, so one cell tells it, and
    sum 1/E = N * sum 1/row * sum 1/column.
    """
    keys = by or []
    o, r, c = (F.col(x) for x in ("o", "row_total", "column_total"))
    per_row = Window.partitionBy(*keys, "row")
    per_column = Window.partitionBy(*keys, "column")
    cells = (
        counts.select(*keys, "row", "column", F.col("observed").cast("double").alias("o"))
        .withColumns({"row_total": F.sum("o").over(per_row), "row_cells": F.count("o").over(per_row)})
        .withColumns(
            {
                "column_total": F.sum("o").over(per_column),
                "column_cells": F.count("o").over(per_column),
            }
        )
    )
    last = F.struct("row", "column")
    n, cell = F.col("n"), F.col("cell")
    tested = (
        cells.groupBy(*keys).agg(
            F.sum("o").alias("n"),
            ((F.count_distinct("row") - 1) * (F.count_distinct("column") - 1)).alias("degrees"),
            F.sum(o * o / (r * c)).alias("ratio"),
            F.max_by(F.struct("o", "row_total", "column_total"), last).alias("cell"),
            F.sum(1 / (r * F.col("row_cells"))).alias("inverse_rows"),
            F.sum(1 / (c * F.col("column_cells"))).alias("inverse_columns"),
        )
        .withColumns(
            {
                "plain": F.greatest(n * F.col("ratio") - n, F.lit(0.0)),
                "gap": F.abs(cell["o"] - cell["row_total"] * cell["column_total"] / n),
            }
        )
    )
    shrunk = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    corrected = shrunk * shrunk * F.col("n") * F.col("inverse_rows") * F.col("inverse_columns")
    tested = tested.select(
        *keys,
        F.when(F.col("degrees") == 1, corrected).otherwise(F.col("plain")).alias("chi2"),
        "degrees",
        F.col("n").cast("bigint").alias("n"),
    )
    if not p_value:
        return tested
    return tested.withColumn("p_value", chi2_pvalue("chi2", F.col("degrees").cast("double")))


def disposition(df: DataFrame, arm: str, outcome: str, by: list[str] | None = None) -> DataFrame:
    """Randomised, completed and dropped out, per arm."""
    return df.groupBy(*(by or []), F.col(arm).alias("arm")).agg(
        F.count(F.lit(1)).alias("randomised"),
        F.count(outcome).alias("completed"),
        F.count_if(F.col(outcome).isNull()).alias("dropped_out"),
    )


def report_table(
    df: DataFrame,
    value: str = "outcome_measure",
    arm: str = "arm",
    flag: str = "adverse_event",
    treated: str = "treatment",
    control: str = "placebo",
    inference: bool = True,
) -> DataFrame:
    """The report as long rows (section, metric, arm, value).

    All moments, contingency and disposition counts come from one pass over the data.
    """
    aggregates = []
    for tag, level in (("t", treated), ("c", control)):
        inside = F.col(arm) == level
        x = F.when(inside, F.col(value))
        aggregates += [
            F.count(x).alias(f"n_{tag}"),
            F.avg(x).alias(f"mean_{tag}"),
            F.stddev_samp(x).alias(f"sd_{tag}"),
            F.count_if(inside).alias(f"all_{tag}"),
            F.count_if(inside & (F.col(flag) == 1)).alias(f"yes_{tag}"),
            F.count_if(inside & (F.col(flag) == 0)).alias(f"no_{tag}"),
        ]
    chi2 = _yates_two_by_two("yes_t", "no_t", "yes_c", "no_c")
    one = df.agg(*aggregates).withColumns({**_welch_columns(), "chi2": chi2})
    if inference:
        one = welch_inference(one).withColumn("chi2_p", chi2_pvalue("chi2", F.lit(1.0)))
    entries = []
    for tag, level in (("t", treated), ("c", control)):
        entries += [
            ("disposition", "randomised", level, f"all_{tag}"),
            ("disposition", "completed", level, f"n_{tag}"),
            ("disposition", "dropped_out", level, F.col(f"all_{tag}") - F.col(f"n_{tag}")),
            ("primary", "mean", level, f"mean_{tag}"),
            ("primary", "sd", level, f"sd_{tag}"),
            ("safety", "adverse", level, f"yes_{tag}"),
            ("safety", "no_adverse", level, f"no_{tag}"),
        ]
    names = ["difference", "standard_error", "t_statistic", "degrees", "cohens_d"]
    names += ["p_value", "ci_low", "ci_high"] if inference else []
    entries += [("primary", n, "both", n) for n in names]
    entries += [("safety", "chi2", "both", "chi2")]
    entries += [("safety", "chi2_p", "both", "chi2_p")] if inference else []

    def entry(section: str, metric: str, level: str, source: str | Column) -> Column:
        column = F.col(source) if isinstance(source, str) else source
        return F.struct(
            F.lit(section).alias("section"),
            F.lit(metric).alias("metric"),
            F.lit(level).alias("arm"),
            column.cast("double").alias("value"),
        )

    return one.select(F.inline(F.array(*[entry(*e) for e in entries])))


def analysis_document(report: DataFrame, run_id: str) -> DataFrame:
    """The report as one nested row that quotes its run: aggregates only, ready to be written.

    ``report`` is the long table of :func:`report_table`, a few dozen rows.
    """

    def value(section: str, metric: str, arm: str) -> Column:
        wanted = (F.col("section") == section) & (F.col("metric") == metric) & (F.col("arm") == arm)
        return F.max(F.when(wanted, F.col("value"))).alias(metric)

    def arm(section: str, metrics: list[str], level: str) -> Column:
        return F.struct(*[value(section, m, level) for m in metrics]).alias(level)

    tests = ["difference", "ci_low", "ci_high", "t_statistic", "degrees", "p_value", "cohens_d"]
    levels = ["treatment", "placebo"]
    return report.agg(
        F.lit(1).alias("schema_version"),
        F.lit(run_id).alias("run_id"),
        F.struct(
            *[arm("primary", ["mean", "sd"], level) for level in levels],
            *[value("primary", m, "both") for m in tests],
        ).alias("primary"),
        F.struct(
            *[arm("safety", ["adverse", "no_adverse"], level) for level in levels],
            value("safety", "chi2", "both"),
            value("safety", "chi2_p", "both").alias("p_value"),
        ).alias("safety"),
        F.struct(
            *[arm("disposition", ["randomised", "completed", "dropped_out"], level) for level in levels]
        ).alias("disposition"),
    )


def _yates_two_by_two(yes_t: str, no_t: str, yes_c: str, no_c: str) -> Column:
    a, b, c, d = (F.col(x).cast("double") for x in (yes_t, no_t, yes_c, no_c))
    n = a + b + c + d
    chi2 = F.lit(0.0)
    for o, margin in (
        (a, (a + b) * (a + c)), (b, (a + b) * (b + d)), (c, (c + d) * (a + c)), (d, (c + d) * (b + d)),
    ):
        e = F.try_divide(margin, n)
        gap = F.abs(o - e)
        shrunk = gap - F.least(F.lit(0.5), gap)
        chi2 = chi2 + F.try_divide(shrunk * shrunk, e)
    return chi2
