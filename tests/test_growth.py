"""What grows with the tables: equal sequences are worked on once, hot keys are dealt out, files stay small."""

import datetime
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracecast import storage
from tracecast.functions import similarity
from tracecast.operators import footprint, neighbours, ngrams, router, svd
from tracecast.plans import catalog, suffix_model
from tracecast.sources import trees, xes


def _lines(spark, tmp_path, texts):
    """A lineitem table whose orders have the given labels, one letter each."""
    day = datetime.datetime(2020, 1, 1)
    rows = [(i, k, k, k, c, "O", day + datetime.timedelta(k)) for i, text in enumerate(texts) for k, c in enumerate(text)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def _gram_counts(text):
    return {text[i : i + n] for n in (1, 2) for i in range(len(text) - n + 1)}


def test_equal_sequences_are_projected_once(spark, tmp_path, monkeypatch):
    texts = ["abc", "abc", "abca", "abc", "ab", "ab", "abc", "x", "x"]  # the last third are test traces
    folder, seen = _lines(spark, tmp_path, texts), []
    for name, place in (("prefix_projections", 0), ("svd_features", 0)):
        def counted(rows, *rest, run=getattr(svd, name), name=name):
            seen.append((name, rows.select("variant_id").distinct().count()))
            return run(rows, *rest)
        monkeypatch.setattr(svd, name, counted)
    got = {(r.case_id, r.length): (r.own, r.with_before) for r in catalog.queries()["prefix_projections"](spark, folder).collect()}
    want = {}
    for case, text in enumerate(texts[:6]):
        for n in range(2, len(text) + 1):
            own = _gram_counts(text[:n])
            want[case, n] = (float(len(own)), float(len(own & _gram_counts(text[: n - 1]))) if n > 2 else None)
    assert got == want
    first = _gram_counts(texts[0])
    got = {r.case_id: (r.own, r.with_first) for r in catalog.queries()["svd_features"](spark, folder).collect()}
    assert got == {i: (float(len(_gram_counts(t))), float(len(_gram_counts(t) & first))) for i, t in enumerate(texts[:6])}
    assert seen == [("prefix_projections", 3), ("svd_features", 3)]


def test_a_weight_stands_for_equal_rows(spark):
    rows = [(1, list("abc"), 3), (2, list("bd"), 1), (3, list("acac"), 2)]
    distinct = spark.createDataFrame(rows, "id long, acts array<string>, n_traces long")
    every = distinct.select("id", "acts", F.explode(F.sequence(F.lit(1), F.col("n_traces").cast("int"))).alias("k")).select((F.col("id") * 10 + F.col("k")).alias("id"), "acts")
    features = ngrams.first_lengths(distinct, "id").join(distinct.select("id", "n_traces"), "id")
    few = svd.Settings(svd_components=2)
    planes = []
    for basis in (svd.svd_basis(features, "id", few, "n_traces"), svd.svd_basis(ngrams.first_lengths(every, "id"), "id", few)):
        axes = np.array([r.axis for r in basis.orderBy("gram").collect()])
        planes.append(axes @ axes.T)
    assert np.allclose(planes[0], planes[1], atol=1e-6)


def test_traces_of_any_length_are_projected_in_batches(spark, monkeypatch):
    texts = ["a", "ab", "abab", "zz", "abcabcab"]
    rows = spark.createDataFrame([(i, list(t)) for i, t in enumerate(texts)], "case_id long, acts array<string>")
    basis = svd.svd_basis(ngrams.first_lengths(rows.where("case_id <> 3")))
    for numbers in (1, 1 << 20):
        monkeypatch.setattr(svd, "_NUMBERS", numbers)
        got = {(r.case_id, r.length): round(float(np.dot(r.projection, r.projection)), 6) for r in svd.prefix_projections(rows, basis).collect()}
        want = {(i, n): float(len(_gram_counts(t[:n]))) if i != 3 else 0.0 for i, t in enumerate(texts) for n in range(2, len(t) + 1)}
        assert got == want


def test_sizes_with_the_same_exemplars_are_measured_once(monkeypatch):
    calls, run = [], neighbours._nearest_clusters
    monkeypatch.setattr(neighbours, "_nearest_clusters", lambda *a: calls.append(1) or run(*a))
    items = [[1], [1, 2], [1, 2, 3], [7, 8], [7, 8, 9], [4]]
    marks = [[{"candidate": s, "cluster": c} for s in (2, 3)] if c is not None else None for c in (0, None, 0, 3, None, 5)]
    marks[5].append({"candidate": 4, "cluster": 5})
    block = pa.table({
        "point": pa.array(range(6), pa.int64()), "weight": pa.array([1] * 6, pa.int64()), "items": pa.array(items, pa.list_(pa.int64())),
        "marks": pa.array(marks, pa.list_(pa.struct([("candidate", pa.int32()), ("cluster", pa.int64())]))),
    })
    got = {(r["candidate"], r["point"], r["cluster"]): r["apart"] for b in neighbours.to_exemplars([2, 3, 4, 5], 2)(block) for r in b.to_pylist()}
    want = {}
    for size in (2, 3, 4):
        for p, own in enumerate(items):
            near = {}
            for q, of in enumerate(marks):
                for m in of or ():
                    if m["candidate"] == size:
                        near[m["cluster"]] = min(near.get(m["cluster"], 99), len(set(own) ^ set(items[q])))
            want |= {(size, p, c): d for d, c in sorted((d, c) for c, d in near.items())[:2]}
    assert got == want and len(calls) == 2


def test_traces_of_a_cluster_need_no_sort(spark):
    cases = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, ["b"]), (4, ["c"])], "case_id long, acts array<string>")
    distinct = spark.createDataFrame([(["a"], ["m", "n"]), (["b"], ["m"])], "acts array<string>, models array<string>")
    got = catalog._of_cases(cases, distinct, "models", "acts")
    assert sorted((r.case_id, r.models, r.acts) for r in got.collect()) == [(1, ["m", "n"], ["a"]), (2, ["m", "n"], ["a"]), (3, ["m"], ["b"])]


def test_blocks_of_one_length_are_dealt_over_copies_of_its_weights(spark, monkeypatch):
    texts = [a + b + c for a in "abc" for b in "abc" for c in "abcd"]
    rows = spark.createDataFrame([(i, list(t)) for i, t in enumerate(texts)], "variant_id long, acts array<string>")
    labelled = rows.select(F.lit(2).alias("candidate"), (F.col("variant_id") % 3).alias("cluster_id"), "variant_id", "acts")
    trained = router.train_router(labelled, 3)
    got = []
    for block, sharing in ((1_000, 16), (4, 2)):
        monkeypatch.setattr(router, "_BLOCK", block)
        monkeypatch.setattr(router, "_SHARING", sharing)
        got.append(sorted(map(tuple, router.route(rows, trained).collect())))
    assert got[0] == got[1] and len(got[0]) == len(texts)


def test_xes_files_hold_a_bounded_number_of_traces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(xes, "_FILE_TRACES", 2)
    rows = spark.createDataFrame([(i, ["a", "b"]) for i in range(9)], "case_id long, acts array<string>").coalesce(1)
    xes.write_xes(rows, f"{tmp_path}/x")
    files = list(Path(tmp_path, "x").glob("part-*"))
    assert len(files) >= 5 and all(f.read_text().count("<trace>") <= 2 for f in files)
    assert sorted(r.trace_name for r in xes.read_xes(spark, f"{tmp_path}/x").collect()) == [str(i) for i in range(9)]


def test_every_log_is_gathered_once(spark, monkeypatch):
    seen, run = [], catalog._traces
    monkeypatch.setattr(catalog, "_traces", lambda log, *a: seen.append(log) or run(log, *a))
    catalog.discovered_replay_query(spark, "/root/testdata/sf0.001").collect()
    assert sorted(seen) == sorted(catalog.LOGS)


def test_sorts_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(storage, "ROWS_OF_A_TASK", 20)
    rows = [("m", i, 1, [1, 2, 3], list("abc"), list("abd") + [str(i)]) for i in range(100)]
    rows = spark.createDataFrame(rows, "model_id string, variant_id long, n_traces long, fired array<int>, a array<string>, b array<string>").persist()
    sorted_ = footprint._tall(rows)
    scored = similarity.score_pairs(rows, "a", "b")
    assert sorted_.count() == 300 and scored.count() == 100
    for frame in (sorted_, scored):
        assert frame.select(F.spark_partition_id().alias("p")).distinct().count() > 4  # the session's shuffle partitions


def test_sequences_and_states_are_not_sent_to_the_driver(spark):
    texts = ["abc", "abcb", "aab", "abc", "bca", "ccab"]
    cases = spark.createDataFrame([(i, list(t)) for i, t in enumerate(texts)], "case_id long, acts array<string>")
    models = trees.models_from(spark, {suffix_model.MAIN: ["XorLoop", ["Xor", "a", "b", "c"], None, None]})
    model = suffix_model.fit(cases.withColumn("model_id", F.lit(suffix_model.MAIN)), models)
    distinct = suffix_model.distinct_sequences(cases)
    sequences = distinct.select(F.lit(suffix_model.MAIN).alias("model_id"), "variant_id", "acts", F.array(F.lit(2)).alias("lengths"))
    scored = suffix_model.variant_lines(distinct, model).withColumn("candidate", F.lit(0))
    lines = suffix_model.case_lines(cases, distinct, scored)
    assert sorted((r.case_id, r.length) for r in lines.collect()) == sorted((i, n) for i, t in enumerate(texts) for n in range(2, len(t)))
    plans = "".join(frame._jdf.queryExecution().sparkPlan().toString() for frame in (model.predict(sequences), lines))
    merged = {re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"SortMergeJoin \[([^\]]*)\]", plans)}
    assert merged >= {"model_id, state", "pair", "sequence", "variant_id"}
    assert not re.search(r"BroadcastHashJoin \[(variant_id|pair|sequence|model_id#\d+, state)", plans)
