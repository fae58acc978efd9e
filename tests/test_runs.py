import json

import pytest

from tracecast.plans.runs import run_clustered, run_single
from tracecast.settings import Settings
from tracecast.sources.eventlog import read_csv_log
from tests.conftest import SMALL_LOG
from tests.test_discover import unordered
from tracecast.sources.trees import tree_from_text


@pytest.fixture(scope="module")
def csv_log(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "log.csv"
    rows, clock = ["CaseID,ActivityID,CompleteTimestamp"], 0
    for case, text in enumerate(SMALL_LOG.split(";")):
        for label in text.split("-"):
            clock += 5
            rows.append(f"{case},{label},2010-12-01 00:{clock // 60:02}:{clock % 60:02}")
    path.write_text("\n".join(rows) + "\n")
    return read_csv_log(spark, str(path))


def test_single_run_gives_the_stored_results(spark, csv_log, tmp_path):
    run = run_single(csv_log, Settings(dataset="small"))
    tree = json.loads(run.models.first().tree)
    assert unordered(tree) == unordered(tree_from_text("Xor(And(Seq(1, 2), 0), XorLoop(Seq(3, 4), 5, tau))"))
    # The lines and statistics that must come from the small log.
    lines = {r.case_id: (r.prefix_text, r.suffix_guessed, r.damerau_similarity) for r in run.lines.collect()}
    assert lines == {
        45: ("1-2", ["0"], 1.0), 48: ("1-2", ["0"], 1.0), 52: ("0-1", ["2"], 1.0), 62: ("0-1", ["2"], 1.0), 63: ("1-0", ["2"], 1.0),
    }
    row = run.report.first()
    assert (row.n_train, row.n_test, row["mean"], row.variance, row.skewness, row.kurtosis) == (20, 5, 1.0, 0.0, 0.0, -3.0)
    run.write(str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/report").count() == 1 and spark.read.parquet(f"{tmp_path}/lines").count() == 5
    run.write(str(tmp_path / "text"), "csv")
    assert spark.read.csv(f"{tmp_path}/text/lines", header=True).count() == 5


def test_clustered_run(csv_log):
    run = run_clustered(csv_log, Settings(dataset="small"))
    row = run.report.first()
    assert (row.n_train, row.n_test) == (18, 5) and row.num_clusters > 1 and 2 <= row.candidate < 11
    assert 0 <= row.min <= row["mean"] <= row.max <= 1


def test_log_without_test_prefixes_is_refused(csv_log):
    with pytest.raises(ValueError, match="empty event log"):
        run_single(csv_log.where("activity in ('6', '7')"))
