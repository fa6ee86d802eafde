"""Result tables: metrics pivoted to one row a stream and one column a condition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivoted(metrics: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Percentages as text, a dash where there is no result."""
    wide = metrics.groupBy(row).pivot(column, columns).agg(F.first(value))
    cell = lambda c: F.when(F.col(f"`{c}`").isNull(), "-").otherwise(F.format_string("%5.1f", F.lit(100.0) * F.col(f"`{c}`")))
    return wide.select(row, *[cell(c).alias(c) for c in columns])


def difference(metrics: DataFrame, row: str, column: str, value: str, first: str, second: str) -> DataFrame:
    """The signed difference of two conditions in points, a dash where one is missing."""
    wide = metrics.groupBy(row).pivot(column, [first, second]).agg(F.first(value))
    d = F.lit(100.0) * (F.col(f"`{first}`") - F.col(f"`{second}`"))
    return wide.select(row, F.when(d.isNull(), "-").otherwise(F.format_string("%+.1f", d)).alias("difference"))


def markdown(table: DataFrame) -> str:
    """A small table as Markdown."""
    rows = [table.columns, ["---"] * len(table.columns), *[[str(v) for v in r] for r in table.collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


#: Fixed order and words of what happens before a commit.
MODES = {"none": "nothing: the first report is committed", "lead": "the lead's check; rejected: the next source", "all": "the dataset's check; failed: the next source", "final": "the dataset's check; only the committed report is written"}


def replay_report(title: str, sources: DataFrame, policies: DataFrame, sweep: DataFrame | None = None) -> str:
    """A replay as Markdown: sources (source, accuracy, and rates of the check where there are), policies (policy, mode, worker_calls,
    accuracy, first_accuracy), and what a budget of calls gives (policy, calls, accuracy, worker_calls), one column a policy.

    The tables are small: a row a source, a run or a budget.
    """
    number = lambda c, f: F.when(F.col(c).isNull(), "-").otherwise(F.format_string(f, c)).alias(c)
    rates = [c for c in sources.columns if c != "source"]
    parts = [f"# {title}", markdown(sources.select("source", *[number(c, "%.1f") for c in rates]).orderBy("source"))]
    said = F.coalesce(*[F.when(F.col("mode") == k, v) for k, v in MODES.items()], F.col("mode"))
    percent = lambda c: F.format_string("%.1f", F.lit(100.0) * F.col(c)).alias(c)
    rows = policies.orderBy("policy", "mode").select("policy", said.alias("before the commit"), number("worker_calls", "%.2f"), percent("accuracy"), percent("first_accuracy"))
    parts.append(markdown(rows))
    if sweep is not None:
        names = [r[0] for r in sweep.select("policy").distinct().orderBy("policy").collect()]
        cell = F.format_string("%.1f (%.2f)", F.lit(100.0) * F.col("accuracy"), F.col("worker_calls"))
        parts.append(markdown(sweep.withColumn("_c", cell).groupBy("calls").pivot("policy", names).agg(F.first("_c")).orderBy("calls").withColumnRenamed("calls", "sources allowed")))
    return "\n\n".join(parts) + "\n"
