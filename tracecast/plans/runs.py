"""Whole runs over a log: split, train, predict the test prefixes, score, report.

``python -m tracecast.plans.runs LOG.csv RESULTS [--clustered]`` runs one on a CSV log.
"""

from __future__ import annotations

import argparse
import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracecast.operators import report, split, traces
from tracecast.operators.discover import discover
from tracecast.plans.clustered import clustered_lines, fit_clustered
from tracecast.plans.suffix_model import MAIN, fit, prediction_lines
from tracecast.settings import Settings
from tracecast.ship import ship
from tracecast.sources.eventlog import read_csv_log
from tracecast.sources.reports import append_report, write_lines
from tracecast.sources.trees import write_models
from tracecast.storage import materialize, release


@dataclass(frozen=True)
class Run:
    models: DataFrame
    lines: DataFrame
    report: DataFrame

    def write(self, folder: str, fmt: str = "parquet") -> None:
        """Trees, lines and report under one folder; the report table grows by one row."""
        write_models(self.models, f"{folder}/models")
        write_lines(self.lines, f"{folder}/lines", fmt)
        append_report(self.report, f"{folder}/report", fmt)


def _split(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    parts = materialize(split.train_test_split(traces.traces(log)), "traces")
    train, test = traces.trainable(parts.where("is_train")).drop("is_train"), parts.where("not is_train").drop("is_train")
    report.require_test_prefixes(traces.prefix_lengths(test))
    return train, test


def _count(train: DataFrame) -> DataFrame:
    return train.agg(F.count(F.lit(1)).alias("n_train"))


def run_single(log: DataFrame, settings: Settings = Settings(), models: DataFrame | None = None) -> Run:
    """One model of the whole training log, on the given tree or on a discovered one."""
    train, test = _split(log)
    keyed = train.withColumn("model_id", F.lit(MAIN))
    if models is None:
        models = materialize(discover(traces.variants(keyed, "model_id"), settings), "models")
    lines = materialize(prediction_lines(test, fit(keyed, models, settings)), "lines")
    return Run(models, lines, report.run_report(lines, _count(train), settings))


def run_clustered(log: DataFrame, settings: Settings = Settings()) -> Run:
    """One model per group of similar traces, at the granularity that predicts the validation sample best."""
    train, test = _split(log)
    rest, validation = (materialize(part, "train") for part in split.cut_validation(train, settings))
    fitted = fit_clustered(rest, settings)
    lines = materialize(clustered_lines(test, validation, fitted), "lines")
    candidate = lines.agg(F.first("candidate")).first()[0]
    clusters = fitted.chosen.where(F.col("candidate") == candidate).select("cluster_id").distinct().count()
    summary = report.run_report(lines, _count(rest), settings, candidate=candidate, num_clusters=max(clusters, 1))
    return Run(fitted.model.models, lines, summary)


def main() -> None:
    parser = argparse.ArgumentParser(description="Suffix prediction over a CSV event log")
    parser.add_argument("log")
    parser.add_argument("results")
    parser.add_argument("--clustered", action="store_true")
    parser.add_argument("--format", choices=("parquet", "csv"), default="parquet", help="of the lines and the report")
    for field in dataclasses.fields(Settings):
        if kind := {"int": int, "int | None": int, "float": float}.get(field.type):
            parser.add_argument("--" + field.name.replace("_", "-"), type=kind, default=field.default)
    args = vars(parser.parse_args())
    path, results, clustered = args.pop("log"), args.pop("results"), args.pop("clustered")
    fmt = args.pop("format")
    spark = ship(SparkSession.builder.appName("tracecast").getOrCreate())
    run = (run_clustered if clustered else run_single)(read_csv_log(spark, path), Settings(dataset=path, **args))
    run.write(results, fmt)
    run.report.show(truncate=False, vertical=True)
    release(spark)


if __name__ == "__main__":
    main()
