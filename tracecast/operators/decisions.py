"""Decision rules: mode for Xor, median for XorLoop, rate-normalised branch for And.

Every rule exists under its exact loop context (``pf+``) and over all contexts
(``pf``, ``loop_ctx`` null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracecast.operators.tree import branch_sizes

_FEATURE = ("model_id", "operator", "kind", "step", "loop_ctx")


def decision_counts(footprint_rows: DataFrame) -> DataFrame:
    """Traces per ``(feature, value)`` at both levels.

    The tall footprint is summed once; the all-context level is built from that sum.
    """
    exact = footprint_rows.groupBy(*_FEATURE, "value").agg(F.sum("n_traces").alias("cnt"))
    grouping = "grouping sets ((model_id, operator, kind, step, value, loop_ctx), (model_id, operator, kind, step, value))"
    return exact.sparkSession.sql(
        f"""
        select model_id, operator, kind, step,
               case when grouping(loop_ctx) = 1 then null else loop_ctx end as loop_ctx,
               case when grouping(loop_ctx) = 1 then 'pf' else 'pf+' end as source,
               value, sum(cnt) as cnt
        from {{exact}}
        group by {grouping}
        """,
        exact=exact,
    )


def xor_decisions(counts: DataFrame) -> DataFrame:
    """Most frequent child; ties go to the first child in tree order."""
    return counts.where("kind = 'Xor'").groupBy(*_FEATURE, "source").agg(
        F.max_by("value", F.struct("cnt", -F.col("value"))).alias("value"), F.sum("cnt").alias("n")
    )


def loop_decisions(counts: DataFrame) -> DataFrame:
    """Exact weighted median of the loop counts; the loop repeats while the median exceeds the counter."""
    return counts.where("kind = 'XorLoop'").groupBy(*_FEATURE, "source").agg(
        F.percentile("value", F.lit(0.5), F.col("cnt")).alias("median"), F.sum("cnt").alias("n")
    )


def and_scores(counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Traces per branch over the branch's nodes, ranked; ties go to the lowest branch."""
    sizes = branch_sizes(nodes).select(
        "model_id", F.col("and_id").alias("operator"), F.col("branch").cast("bigint").alias("value"), "n_nodes"
    )
    scored = counts.where("kind = 'And'").join(sizes, ["model_id", "operator", "value"])
    best_first = Window.partitionBy(*_FEATURE, "source").orderBy(F.desc("score"), "value")
    return scored.withColumn("score", F.col("cnt") / F.col("n_nodes")).withColumn("rank", F.row_number().over(best_first))


def and_decisions(counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Branches best first, as one array per feature."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", F.col("value").alias("branch"))))
    return and_scores(counts, nodes).groupBy(*_FEATURE, "source").agg(
        ranked.alias("ranked"), F.sum("cnt").alias("n")
    ).withColumn("ranked", F.col("ranked.branch"))


def decision_table(counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(model_id, operator, kind, step, loop_ctx, source, choice, n)`` for all three kinds.

    ``choice`` is ``[transition]`` for Xor, ``[median]`` for XorLoop, the ranked branches for And.
    """
    as_choice = lambda value: F.array(value.cast("double"))
    columns = [*_FEATURE, "source", "choice", "n"]
    xor = xor_decisions(counts).withColumn("choice", as_choice(F.col("value"))).select(*columns)
    loop = loop_decisions(counts).withColumn("choice", as_choice(F.col("median"))).select(*columns)
    both = and_decisions(counts, nodes).withColumn("choice", F.col("ranked").cast("array<double>")).select(*columns)
    return xor.unionByName(loop).unionByName(both)


def look_up(asked: DataFrame, table: DataFrame) -> DataFrame:
    """Adds ``choice`` and ``source`` to rows keyed by feature: exact context, else any context, else first."""
    key = ["model_id", "operator", "kind", "step_key"]
    keyed = lambda df: df.withColumn("step_key", F.coalesce("step", F.lit(-1)))
    exact = keyed(table.where("source = 'pf+'")).select(*key, "loop_ctx", F.col("choice").alias("exact"))
    overall = keyed(table.where("source = 'pf'")).select(*key, F.col("choice").alias("overall"))
    return (
        keyed(asked)
        .join(exact, [*key, "loop_ctx"], "left")
        .join(overall, key, "left")
        .select(
            *asked.columns,
            F.coalesce("exact", "overall").alias("choice"),
            F.when(F.col("exact").isNotNull(), "pf+")
            .when(F.col("overall").isNotNull(), "pf")
            .otherwise("first")
            .alias("source"),
        )
    )
