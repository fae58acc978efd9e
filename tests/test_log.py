import math
import random

import pytest
from pyspark.sql import functions as F

from tracecast.functions.sequences import cut, from_text, ngrams, to_text
from tracecast.operators import dfg, ngrams as N, split, traces
from tracecast.settings import Settings
from tracecast.sources.eventlog import event_log, read_csv_log


def test_event_log_options(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (None, "x", 1), (2, None, 1)], "c int, a string, o int")
    found = {r.case_id: r.acts for r in traces.traces(event_log(rows, "c", "a", ["o"])).collect()}
    assert found == {1: ["a", "b"], 2: ["nan"]}
    assert traces.traces(event_log(rows, "c", "a", ["o"], missing_activity=None)).count() == 1


def test_csv_source(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("CaseID,ActivityID,CompleteTimestamp\n10,1,2010-12-01 00:00:10\n10,0,2010-12-01 00:00:05\n2,7,2010-12-01 00:00:01\n")
    found = {r.case_id: r.acts for r in traces.traces(read_csv_log(spark, str(path))).collect()}
    assert found == {10: ["0", "1"], 2: ["7"]}


def logs_of(spark, path, **options):
    return {r.case_id: r.acts for r in traces.traces(read_csv_log(spark, str(path), **options)).collect()}


def test_csv_without_a_time_keeps_the_order_of_the_file(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("CaseID,ActivityID\n" + "".join(f"{i % 3},{a}\n" for i, a in enumerate("766767767")))
    assert logs_of(spark, path) == {0: ["7", "7", "7"], 1: ["6", "6", "6"], 2: ["6", "7", "7"]}


def test_csv_columns_in_any_order_and_text_cases(spark, tmp_path):
    (tmp_path / "b.csv").write_text("ActivityID,CaseID,More\nx,A1,1\ny,01,2\nz,A1,3\n")
    assert logs_of(spark, tmp_path / "b.csv") == {"A1": ["x", "z"], "01": ["y"]}
    with pytest.raises(Exception, match="CaseID"):
        logs_of(spark, tmp_path / "b.csv", case_type="bigint")
    with pytest.raises(ValueError, match="Nope"):
        logs_of(spark, tmp_path / "b.csv", activity="Nope")
    (tmp_path / "c.csv").write_text("CaseID,ActivityID,CompleteTimestamp\n1,a,yesterday\n")
    with pytest.raises(Exception, match="yesterday"):
        logs_of(spark, tmp_path / "c.csv")


def test_csv_files_of_a_folder_follow_one_another(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for name, acts in (("1.csv", "ab"), ("2.csv", "c" * 40), ("3.csv", "da")):
        (folder / name).write_text("CaseID,ActivityID\n" + "".join(f"5,{a}\n" for a in acts))
    assert logs_of(spark, folder) == {5: list("ab" + "c" * 40 + "da")}


def test_labels_with_blanks_are_not_taken_for_pairs(spark):
    rows = spark.createDataFrame([(1, ["a b", "c"]), (2, ["a", "b c"]), (3, ["a", "b"])], "case_id bigint, acts array<string>")
    grams = N.first_lengths(rows)
    assert N.vocabulary(grams).count() == len({("a b",), ("c",), ("a b", "c"), ("a",), ("b c",), ("a", "b c"), ("b",), ("a", "b")})


def test_split_sizes_of_small_log(small):
    parts = split.train_test_split(small)
    train, test = parts.where("is_train"), parts.where("not is_train")
    assert train.count() == 44 and traces.trainable(train).count() == 20
    assert traces.prefix_lengths(test).count() == 5
    counts = split.split_counts(traces.trainable(train), traces.prefix_lengths(test)).first()
    assert (counts.n_train, counts.n_test) == (20, 5)


@pytest.mark.parametrize("kind", ["string", "bigint", "double", "date", "timestamp", "decimal(10,2)"])
def test_value_at_rank_of_any_kind_and_many_ties(spark, monkeypatch, kind):
    values = [random.Random(kind).choice([0, 1, 1, 1, 5, 700, 12345]) * (k % 7) for k in range(400)]
    rows = spark.createDataFrame([(v,) for v in values], "v int")
    made = {"string": "concat('the same long beginning', cast(v as string))", "date": "date_add(date'2020-01-01', v)", "timestamp": "timestamp_micros(v)"}
    rows = rows.selectExpr(f"{made.get(kind, f'cast(v as {kind})')} as v")
    ordered = [r.v for r in rows.orderBy("v").collect()]
    monkeypatch.setattr(split, "_SMALL_BRACKET", 2)
    for rank in (1, 57, 200, 399, 400, 1000):
        assert split.value_at_rank(rows, "v", lambda n: rank) == ordered[min(rank, 400) - 1]
    assert split.value_at_rank(rows.limit(0), "v", lambda n: 1) is None


def test_value_at_rank_and_enumeration(spark, monkeypatch):
    rng = random.Random(3)
    values = rng.sample(range(10_000), 777)
    rows = spark.createDataFrame([(v,) for v in values], "v int")
    monkeypatch.setattr(split, "_SMALL_BRACKET", 3)  # forces repeated narrowing
    for rank in (1, 2, 300, 776, 777):
        assert split.value_at_rank(rows, "v", lambda n: rank) == sorted(values)[rank - 1]
    assert split.value_at_rank(rows, "v", lambda n: 0) is None
    numbered = {r.v: r.i for r in split.enumerate_rows(rows, "v", "i").collect()}
    assert numbered == {v: i for i, v in enumerate(sorted(values))}


def test_string_case_ids_split_by_their_own_order(spark):
    rows = spark.createDataFrame([(c, ["a"]) for c in ("10", "2", "9")], "case_id string, acts array<string>")
    train = {r.case_id for r in split.train_test_split(rows).where("is_train").collect()}
    assert train == {"10", "2"}


def test_validation_cut(small):
    train = traces.trainable(small)
    n = train.count()
    rest, chosen = split.cut_validation(train, Settings(ratio_validation=0.25))
    assert chosen.count() == round(0.25 * n) and rest.count() == n - chosen.count()
    again, _ = split.cut_validation(train.repartition(7), Settings(ratio_validation=0.25))
    assert {r.case_id for r in again.collect()} == {r.case_id for r in rest.collect()}
    assert split.cut_validation(train, Settings(ratio_validation=0.0))[1].count() == 0


def test_prefix_plus_suffix_is_the_trace(small):
    rows = traces.prefixes(small).join(small, "case_id").collect()
    assert rows and all(r.prefix + r.suffix == r.acts and 2 <= r.length < len(r.acts) for r in rows)


def test_variants_count_all_traces(small):
    found = traces.variants(small).collect()
    assert sum(r.n_traces for r in found) == 64 and len(found) == 8
    assert {r.first_case_id for r in found if r.acts == ["1", "2", "0"]} == {23}


def test_text_and_cut(spark):
    row = spark.createDataFrame([(["a", "b.c", "d"],)], "acts array<string>").select(
        to_text("acts").alias("t"), from_text(to_text("acts", "|"), "|").alias("back"), cut("acts", 2).alias("two"),
        cut("acts", 9).alias("nine"), ngrams(F.col("acts")).alias("g"),
    ).first()
    assert row.t == "a-b.c-d" and row.back == ["a", "b.c", "d"] and row.two == ["a", "b.c"] and len(row.nine) == 3
    assert sorted(row.g) == sorted(["a", "b.c", "d", "a b.c", "b.c d"])


def test_directly_follows_and_ends(trace_frame):
    v = traces.variants(trace_frame("a-b-a;a-b-a;b;c-c"))
    assert {(r.a, r.b): r.cnt for r in dfg.directly_follows(v).collect()} == {("a", "b"): 2, ("b", "a"): 2, ("c", "c"): 1}
    ends = {r.activity: (r.n_start, r.n_end) for r in dfg.start_end_activities(v).collect()}
    assert ends == {"a": (2, 2), "b": (1, 1), "c": (1, 1)}


def test_event_level_forms_with_one_case_holding_most_rows(spark):
    rng = random.Random(8)
    cases = [1] * 3000 + [rng.randint(2, 60) for _ in range(900)] + [70]
    rows = [(c, rng.choice("abc"), i) for i, c in enumerate(cases)]
    rng.shuffle(rows)
    log = event_log(spark.createDataFrame(rows, "c int, a string, i int").repartition(6), "c", "a", ["i"])
    v = traces.variants(traces.traces(log))
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(dfg.directly_follows_of_events(log)) == as_set(dfg.directly_follows(v))
    assert as_set(dfg.start_end_of_events(log)) == as_set(dfg.start_end_activities(v))
    assert traces.longest_case(log).first().max_len == traces.max_trace_length(traces.traces(log)).first().max_len == 3000
    shown = {r.case_id: r.acts for r in traces.traces(log).where("case_id = 1").collect()}
    assert shown[1] == [a for c, a, i in sorted(rows, key=lambda r: r[2]) if c == 1]


def test_prefix_features_equal_cutting_first(trace_frame):
    rows = trace_frame("a-b-a-c;b-b;c-a-b")
    grams = N.first_lengths(rows)
    found = N.prefix_features(grams, N.vocabulary(grams), traces.max_trace_length(rows)).collect()
    expected = set()
    for r in rows.collect():
        for length in range(2, 5):
            acts = r.acts[:length]
            expected |= {(r.case_id, length, g) for g in acts + [" ".join(p) for p in zip(acts, acts[1:])]}
    assert {(r.case_id, r.length, r.ngram) for r in found} == expected and len(found) == len(expected)


def test_vocabulary_keeps_the_most_frequent(trace_frame):
    grams = N.first_lengths(trace_frame("a-b;a-c;a-b"))
    assert [r.ngram for r in N.vocabulary(grams, Settings(max_features=2)).collect()] == ["a", "a b"]


def test_train_share_rule(spark):
    for n in (1, 2, 3, 4, 10):
        rows = spark.range(n).select(F.col("id").alias("case_id"), F.array(F.lit("a")).alias("acts"))
        assert split.train_test_split(rows).where("is_train").count() == min(n, 2 * math.ceil(n / 3))
