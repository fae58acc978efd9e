import random

import pytest
from pyspark.sql import functions as F

from tracecast.operators import decisions as D
from tracecast.operators import footprint as FP
from tracecast.operators import report, split, traces
from tracecast.operators.net import END, START, Net, net
from tracecast.operators.replay import prefix_states, replay
from tracecast.operators.tree import (
    alphabet, branch_sizes, lowest_common_ancestors, memberships, transitions, tree_nodes, walk,
)
from tracecast.plans.suffix_model import MAIN, fit, prediction_lines
from tracecast.sources.reports import append_report, write_lines
from tracecast.sources.trees import models_from, tree_from_text
from tracecast.settings import Settings
import json

# Fixed value: the tree that must come from the small log.
GOLDEN_TREE = "Xor(And(Seq(1, 2), 0), XorLoop(Seq(3, 4), 5, tau))"
NESTED = "XorLoop(Seq(a, And(XorLoop(b, c, tau), Xor(d, Seq(e, f)))), XorLoop(g, h, tau), tau)"


def keyed(rows, model_id=MAIN):
    return rows.withColumn("model_id", F.lit(model_id))


def parts(small):
    both = split.train_test_split(small)
    return keyed(traces.trainable(both.where("is_train"))), both.where("not is_train")


def trained(spark, tree, rows, **kw):
    return fit(keyed(rows), models_from(spark, {MAIN: tree_from_text(tree)}), **kw)


@pytest.fixture(scope="module")
def golden(spark, small):
    train, test = parts(small)
    return trained(spark, GOLDEN_TREE, train.drop("model_id")), train, test


# -- trees ---------------------------------------------------------------------------------------

def test_node_names_and_tables(spark):
    nodes = tree_nodes(models_from(spark, {MAIN: tree_from_text(GOLDEN_TREE)}))
    names = [r.shortname for r in nodes.orderBy("node_id").collect()]
    assert names == ["[Xor0]", "[And1]", "[Seq2]", "1", "2", "0", "[XorLoop6]", "[Seq7]", "3", "4", "5", "[tau11]"]
    assert {(r.and_id, r.branch): r.n_nodes for r in branch_sizes(nodes).collect()} == {(1, 0): 3, (1, 1): 1}
    assert {r.activity for r in alphabet(nodes).collect()} == set("012345")
    rows = {(r.kind, r.node, r.operator) for r in memberships(nodes).collect()}
    assert ("xor_child", "end_[XorLoop6]", "[Xor0]") in rows and ("xor_child", "[And1]", "[Xor0]") in rows
    assert ("loop_redo", "5", "[XorLoop6]") in rows and ("loop_exit", "[tau11]", "[XorLoop6]") in rows


def test_lowest_common_ancestors(spark):
    nodes = walk(tree_from_text(NESTED))
    found = lowest_common_ancestors(tree_nodes(models_from(spark, {MAIN: tree_from_text(NESTED)}))).collect()
    for r in found:
        shared = [a for a, b in zip(nodes[r.node_1]["path"], nodes[r.node_2]["path"]) if a == b]
        assert (r.ancestor, r.level) == (shared[-1], len(shared))
    leaves = sum(n["type"] in ("task", "tau") for n in nodes)
    assert len(found) == leaves * (leaves - 1) // 2


# -- replay and footprint ------------------------------------------------------------------------

def test_golden_footprint_and_decisions(spark, golden):
    model, train, _ = golden
    models, nodes = model.models, model.nodes
    rows = FP.named(FP.footprint(replay(traces.variants(train, "model_id"), models), nodes), nodes)
    acts = {r.variant_id: "-".join(r.acts) for r in traces.variants(train, "model_id").collect()}
    found = {(acts[r.variant_id], r.n_traces, r.operator, r.step): r.value for r in rows.collect()}
    expected = {}
    for text, weight, branches in (("0-1-2", 4, "100"), ("1-0-2", 6, "010"), ("1-2-0", 1, "001")):
        expected[text, weight, "[Xor0]", None] = "[And1]"
        expected |= {(text, weight, "[And1]", i + 1): b for i, b in enumerate(branches)}
    for text, weight, loops in (("3-4", 5, "0"), ("3-4-5-3-4", 2, "1"), ("3-4-5-3-4-5-3-4", 2, "2")):
        expected[text, weight, "[Xor0]", None] = "end_[XorLoop6]"
        expected[text, weight, "[XorLoop6]", None] = loops
    assert found == expected
    rules = {(r.operator, r.step, r.source): r.choice for r in model.rules.collect()}
    assert rules[0, None, "pf+"] == [2.0] and rules[6, None, "pf+"] == [0.0]
    assert [rules[1, s, "pf+"][0] for s in (1, 2, 3)] == [1.0, 1.0, 0.0]
    assert "[And1](1)|" in {r.feature for r in FP.feature_names(rows).collect()}


def play(game: Net, rng: random.Random, stop: float = 0.5) -> list[int]:
    """A random complete run of the net."""
    marking, fired = {START}, []
    while marking != {END}:
        t = rng.choice(sorted(game.enabled(marking)))
        if t in game.leave.values() or t not in game.redo or rng.random() < stop:
            marking = marking - set(game.before[t]) | set(game.after[t])
            fired.append(t)
    return fired


def sequential_footprint(game: Net, fired: list[int]) -> dict:
    """Counters kept one step at a time, decisions recorded after each step."""
    counters, seen = game.new_counters(), {}
    ctx = lambda op: "".join(f"[XorLoop{x}]{{{counters[x]}}}" for x in game.nodes[op]["loops"])
    xor_of = {n["entry"]: n["parent_id"] for n in game.nodes if n["parent_id"] >= 0 and game.nodes[n["parent_id"]]["type"] == "Xor"}
    leaving = {t: loop for loop, t in game.leave.items()}
    for t in fired:
        game.count(counters, t)
        for op in game.ands.get(t, ()):
            seen[op, counters[op], ctx(op)] = game._branch(op, t)
        if t in xor_of:
            seen[xor_of[t], None, ctx(xor_of[t])] = t
        if t in leaving:
            seen[leaving[t], None, ctx(leaving[t])] = counters[leaving[t]]
    return seen


@pytest.mark.parametrize("text", [NESTED, GOLDEN_TREE, "XorLoop(XorLoop(And(a, b, XorLoop(c, tau, tau)), d, tau), e, tau)"])
def test_replay_and_footprint_against_a_sequential_run(spark, text):
    tree, rng = tree_from_text(text), random.Random(11)
    game = Net(json.dumps(tree))
    runs = {tuple(a): a for a in ([game.nodes[t // 2]["label"] for t in play(game, rng) if game.nodes[t // 2]["type"] == "task"] for _ in range(60))}
    rows = spark.createDataFrame([(MAIN, i, a, 1) for i, a in enumerate(runs.values())], "model_id string, variant_id bigint, acts array<string>, n_traces bigint")
    models = models_from(spark, {MAIN: tree})
    replayed, nodes = replay(rows, models).cache(), tree_nodes(models)
    fired = {r.variant_id: r.fired for r in replayed.collect()}
    for r in rows.collect():
        assert [game.nodes[t // 2]["label"] for t in fired[r.variant_id] if game.nodes[t // 2]["type"] == "task"] == r.acts
    assert replayed.agg(F.sum("n_skipped")).first()[0] == 0
    found: dict = {}
    for r in FP.footprint(replayed, nodes).collect():
        found.setdefault(r.variant_id, {})[r.operator, r.step, r.loop_ctx] = r.value
    assert found == {v: sequential_footprint(game, f) for v, f in fired.items()}


def test_unknown_and_unreachable_activities_are_skipped_whole(spark, trace_frame):
    rows = keyed(traces.variants(trace_frame("a-zz-b;b-a;a-a-b")))
    models = models_from(spark, {MAIN: tree_from_text("Seq(a, b)")})
    found = {"-".join(r.acts): (r.fired, r.n_skipped) for r in replay(rows, models).join(rows.select("variant_id", "acts"), "variant_id").collect()}
    assert found == {"a-zz-b": ([2, 4], 1), "b-a": ([2, 4], 1), "a-a-b": ([2, 4], 1)}


def test_blocked_join_plays_what_is_missing_then_itself():
    game = net(json.dumps(tree_from_text("Seq(And(a, b), c)")))
    marking = game.move(frozenset([START]), "a")[1]
    fired, _ = game.move(marking, "c")
    labels = [game.nodes[t // 2]["shortname"] for t in fired]
    assert labels == ["b", "[And1]", "c"]  # the unobserved branch, the join, then the activity itself


def test_prefix_states_equal_separate_replays(spark, trace_frame):
    rows = trace_frame("a-b-c-b-d-g-h-g-a-e-f")
    models = models_from(spark, {MAIN: tree_from_text(NESTED)})
    whole = keyed(rows).select("model_id", F.col("case_id").alias("variant_id"), "acts", F.sequence(F.lit(0), F.size("acts")).alias("lengths"))
    at_once = {r.length: r.state for r in prefix_states(whole, models).collect()}
    cut = keyed(rows.select(F.explode(F.sequence(F.lit(0), F.size("acts"))).alias("k"), "acts")).select(
        "model_id", F.col("k").cast("bigint").alias("variant_id"), F.slice("acts", 1, F.col("k")).alias("acts"), F.array("k").alias("lengths")
    )
    assert at_once == {r.length: r.state for r in prefix_states(cut, models).collect()} and len(at_once) == 12


# -- prediction ----------------------------------------------------------------------------------

def test_golden_lines(golden):
    model, _, test = golden
    lines = {r.case_id: r for r in prediction_lines(test, model).collect()}
    assert {c: (r.prefix_text, r.suffix_guessed) for c, r in lines.items()} == {
        45: ("1-2", ["0"]), 48: ("1-2", ["0"]), 52: ("0-1", ["2"]), 62: ("0-1", ["2"]), 63: ("1-0", ["2"]),
    }
    assert all(r.damerau_similarity == r.levenshtein_similarity == 1.0 for r in lines.values())


def test_unobserved_activity_counts_as_played(spark, small):
    rows = traces.trainable(small)
    for tree in ("Seq(1, 0, 2)", "Seq(0, 1, 2)"):
        assert trained(spark, tree, rows).predict_one(["1", "2"]) == []


def test_predict_one_and_loops(spark, trace_frame):
    model = trained(spark, "XorLoop(Seq(3, 4), 5, tau)", trace_frame("3-4-5-3-4;3-4-5-3-4;3-4"))
    assert model.predict_one(["3"]) == ["4", "5", "3", "4"]
    assert model.predict_one(["3", "4", "5", "3"]) == ["4"]
    assert model.predict_one([]) == ["3", "4", "5", "3", "4"]


def test_first_predicted_transition_is_counted(spark, trace_frame):
    # The first prediction is the redo itself; were it not counted, a second redo would follow.
    model = trained(spark, "XorLoop(a, b, tau)", trace_frame("a-b-a;a-b-a;a-b-a"))
    assert model.predict_one(["a"]) == ["b", "a"]


def test_and_choice_is_rate_normalised(spark, trace_frame):
    # Branch (1, 2) starts 3 of 5 traces but has three nodes; branch 0 has one node and wins.
    model = trained(spark, "And(Seq(1, 2), 0)", trace_frame("1-2-0;1-2-0;1-2-0;0-1-2;0-1-2"))
    assert model.predict_one([])[0] == "0"


def test_xor_ties_and_default_take_the_first_child(spark, trace_frame):
    tie = trained(spark, "Seq(s, Xor(b, a))", trace_frame("s-b;s-a"))
    assert tie.predict_one(["s"]) == ["b"]
    rows = trace_frame("s-x;s-x")
    unseen = trained(spark, "Seq(s, Xor(tau, Seq(x, Xor(p, q))))", rows.limit(0))
    assert unseen.predict_one(["s"]) == []  # nothing learnt: the first child is the silent step


def test_fallback_from_exact_to_any_context(spark, trace_frame):
    # Loop counts 0 and 1 were seen; at count 2 only the all-context rule is left.
    model = trained(spark, "XorLoop(Xor(a, b), tau, tau)", trace_frame("a-b;a-b;a-b;b-b"))
    states = model.predict(
        spark.createDataFrame([(MAIN, 1, ["a", "a"], [2])], "model_id string, variant_id bigint, acts array<string>, lengths array<int>")
    ).first()
    assert states.suffix_guessed == [] and states.n_pf_plus == 1
    asked = spark.createDataFrame(
        [(MAIN, 1, "Xor", None, "[XorLoop0]{1}"), (MAIN, 1, "Xor", None, "[XorLoop0]{7}"), (MAIN, 9, "Xor", None, "")],
        "model_id string, operator int, kind string, step int, loop_ctx string",
    )
    found = {(r.operator, r.loop_ctx): (r.source, r.choice) for r in D.look_up(asked, model.rules).collect()}
    assert found[1, "[XorLoop0]{1}"] == ("pf+", [6.0]) and found[1, "[XorLoop0]{7}"] == ("pf", [6.0])
    assert found[9, ""] == ("first", None)


def test_loop_under_choice_keeps_its_own_entry(spark, trace_frame):
    # After a redo the loop goes on inside itself; the other branch of the choice stays closed.
    model = trained(spark, "Xor(XorLoop(a, b, tau), c)", trace_frame("a-b-a;a-b-a;c;c;c;c;c"))
    assert model.predict_one(["a"]) == ["b", "a"] and model.predict_one([]) == ["c"]


def test_same_label_twice_stays_apart(spark, trace_frame):
    model = trained(spark, "Seq(a, b, a)", trace_frame("a-b-a"))
    assert model.predict_one(["a", "b"]) == ["a"] and model.predict_one(["a"]) == ["b", "a"]


def test_rules_do_not_depend_on_dedup_or_partitions(spark, small, golden):
    model, train, _ = golden
    rules = lambda m: sorted(map(str, m.rules.collect()))
    assert rules(trained(spark, GOLDEN_TREE, train.drop("model_id").repartition(9))) == rules(model)
    single = train.select("model_id", F.col("case_id").alias("variant_id"), "acts", F.lit(1).cast("bigint").alias("n_traces"))
    assert rules(fit(single, model.models)) == rules(model)


def test_prediction_split_over_groups(golden, spark):
    model, _, test = golden
    lines = lambda m: sorted(map(str, prediction_lines(test, m).collect()))
    from dataclasses import replace
    assert lines(replace(model, settings=Settings(states_per_group=1))) == lines(model)


# -- reports -------------------------------------------------------------------------------------

def test_statistics(spark):
    found = report.describe(spark.createDataFrame([(v,) for v in (0.0, 0.0, 1.0, 1.0, 1.0)], "damerau_similarity double")).first()
    assert (found.nobs, found.min, found.max) == (5, 0.0, 1.0)
    assert abs(found["mean"] - 0.6) < 1e-12 and abs(found.variance - 0.3) < 1e-12
    assert abs(found.skewness + 0.408248) < 1e-6 and abs(found.kurtosis + 1.833333) < 1e-6
    same = report.describe(spark.createDataFrame([(1.0,)] * 5, "damerau_similarity double")).first()
    assert (same["mean"], same.variance, same.skewness, same.kurtosis) == (1.0, 0.0, 0.0, -3.0)


def test_sinks_and_guard(spark, golden, tmp_path):
    model, train, test = golden
    lines = prediction_lines(test, model)
    write_lines(lines, str(tmp_path / "lines"))
    write_lines(lines, str(tmp_path / "csv"), "csv")
    assert spark.read.parquet(str(tmp_path / "lines")).count() == 5 == spark.read.csv(str(tmp_path / "csv"), header=True).count()
    row = report.run_report(lines, train.agg(F.count(F.lit(1)).alias("n_train")), Settings(dataset="small"), folder="x")
    append_report(row, str(tmp_path / "runs"))
    append_report(row, str(tmp_path / "runs"))
    back = spark.read.parquet(str(tmp_path / "runs")).collect()
    assert [(r.dataset, r.n_train, r.n_test, r["mean"], r.kurtosis) for r in back] == [("small", 20, 5, 1.0, -3.0)] * 2
    with pytest.raises(ValueError, match="empty event log"):
        report.require_test_prefixes(lines.limit(0))


def test_visible_names(spark):
    names = {r.name for r in transitions(tree_nodes(models_from(spark, {MAIN: tree_from_text("XorLoop(a, tau, tau)")}))).collect()}
    assert names == {"[XorLoop0]", "end_[XorLoop0]", "a", "[tau2]", "[tau3]"}
