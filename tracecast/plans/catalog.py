"""Registered queries: every operator over whole tables of a data folder.

Sequences leave as comma-joined text, so that any engine can compare them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracecast.functions.sequences import fingerprint, from_text, only_value, to_text
from tracecast.functions.similarity import levenshtein_similarity, score_pairs
from tracecast.operators import alphabet as A
from tracecast.operators import cluster as C
from tracecast.operators import decisions as D
from tracecast.operators import dfg, footprint, neighbours, ngrams, replay, report, split, svd, traces, tree
from tracecast.operators.discover import discover
from tracecast.operators.router import route, train_router
from tracecast.plans import clustered, suffix_model
from tracecast.plans.suffix_model import MAIN
from tracecast.settings import Settings
from tracecast.ship import ship
from tracecast.sources import trees, xes
from tracecast.sources.eventlog import event_log, read_csv_log
from tracecast.storage import materialize, new_path

COMMA = ","


# -- logs over the tables ------------------------------------------------------------------------

def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{folder}/{name}.parquet")


def events_log(spark: SparkSession, folder: str) -> DataFrame:
    return event_log(_table(spark, folder, "events"), "user_id", "event_type", ["ts", "event_id"])


def orders_log(spark: SparkSession, folder: str) -> DataFrame:
    return event_log(_table(spark, folder, "orders"), "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"])


def lines_log(spark: SparkSession, folder: str) -> DataFrame:
    label = F.concat("l_returnflag", "l_linestatus")
    # Events that tie here are ordered by their label, as traces sort on it last.
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]
    return event_log(_table(spark, folder, "lineitem"), "l_orderkey", label, order)


def talks_log(spark: SparkSession, folder: str) -> DataFrame:
    return event_log(_table(spark, folder, "conversations"), "conv_id", "role", ["turn"])


LOGS = {"events": events_log, "orders": orders_log, "lineitem": lines_log, "conversations": talks_log}


def _traces(log: str, spark: SparkSession, folder: str) -> DataFrame:
    return traces.traces(LOGS[log](spark, folder))


def _parts(log: str, spark: SparkSession, folder: str, write: bool = False) -> tuple[DataFrame, DataFrame]:
    """Training traces and test traces; written first where several jobs read them."""
    parts = split.train_test_split(_traces(log, spark, folder))
    if write:
        parts = materialize(parts, "traces")
    return traces.trainable(parts.where("is_train")).drop("is_train"), parts.where("not is_train").drop("is_train")


def _of_cases(cases: DataFrame, distinct: DataFrame, *columns: str) -> DataFrame:
    """``case_id`` and what the row of its sequence in ``distinct`` has, whose sequences occur once."""
    ids = distinct.groupBy(fingerprint("acts").alias("sequence")).agg(only_value("acts").alias("same"), F.first(F.struct(*columns)).alias("row"))
    keyed = cases.select("case_id", fingerprint("acts").alias("sequence"))
    return keyed.join(ids.where("same is not null").select("sequence", "row.*"), "sequence").drop("sequence")


def _long(*columns: str) -> list:
    return [F.col(c).cast("bigint").alias(c) for c in columns]


def _text(column: str):
    return to_text(column, COMMA)


# -- log algebra ---------------------------------------------------------------------------------

def event_log_query(spark, folder):
    return orders_log(spark, folder).select("case_id", "activity", F.col("ord.k1").alias("order_key"))


def traces_query(spark, folder):
    return _traces("lineitem", spark, folder).select("case_id", _text("acts").alias("trace"))


def variants_query(spark, folder):
    found = traces.variants(_traces("lineitem", spark, folder))
    return found.select(_text("acts").alias("trace"), "n_traces", "first_case_id")


def trace_text_query(spark, folder):
    text = to_text("acts", "|")
    return _traces("orders", spark, folder).select(
        "case_id", text.alias("text"), F.size(from_text(text, "|")).cast("bigint").alias("n_back")
    )


def max_trace_len_query(spark, folder):
    return traces.longest_case(events_log(spark, folder))


def train_test_split_query(spark, folder):
    parts = split.train_test_split(_traces("lineitem", spark, folder))
    return parts.select("case_id", F.when(F.col("is_train"), "train").otherwise("test").alias("part"))


def train_traces_query(spark, folder):
    return _parts("lineitem", spark, folder)[0].select("case_id", _text("acts").alias("trace"))


def split_counts_query(spark, folder):
    train, test = _parts("orders", spark, folder)
    return split.split_counts(train, traces.prefix_lengths(test))


def prefixes_query(spark, folder):
    rows = traces.prefixes(_parts("lineitem", spark, folder)[1])
    return rows.select(
        "case_id", F.col("length").cast("bigint").alias("length"), _text("prefix").alias("prefix"), _text("suffix").alias("suffix")
    )


def train_minus_validation_query(spark, folder):
    rest, _ = split.cut_validation(_parts("lineitem", spark, folder)[0])
    return rest.select("case_id", _text("acts").alias("trace"))


def validation_prefixes_query(spark, folder):
    _, chosen = split.cut_validation(_parts("lineitem", spark, folder)[0])
    return traces.prefixes(chosen).select(
        "case_id", F.col("length").cast("bigint").alias("length"), _text("prefix").alias("prefix"), _text("suffix").alias("suffix")
    )


def directly_follows_query(spark, folder):
    return dfg.directly_follows_of_events(events_log(spark, folder))


def start_end_activities_query(spark, folder):
    return dfg.start_end_of_events(lines_log(spark, folder))


# -- XES -----------------------------------------------------------------------------------------

def xes_export_query(spark, folder):
    rows = xes.to_xes_rows(_traces("conversations", spark, folder))
    return rows.select(
        F.col("string._key").alias("trace_key"),
        F.col("string._value").alias("trace_name"),
        _text("event.string._value").alias("names"),
        F.size("event").cast("bigint").alias("n_events"),
    )


def xes_roundtrip_query(spark, folder):
    path = new_path(spark, "xes")
    xes.write_xes(_traces("lineitem", spark, folder), path)
    return xes.read_xes(spark, path).select("trace_name", _text("acts").alias("trace"))


def xes_attributes_query(spark, folder):
    """Events with several attributes each, of which the name is neither the first nor the last."""
    path = new_path(spark, "xes")
    rows = _table(spark, folder, "orders")
    log = event_log(rows, "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey", "o_orderstatus"])
    xes.write_xes_events(log.withColumns({"time": F.col("ord.k0").cast("timestamp"), "status": F.col("ord.k2")}), path, org__resource="status", time__timestamp="time")
    found = xes.read_xes(spark, path, statuses="org:resource", times=xes.TIME)
    return found.select("trace_name", _text("acts").alias("trace"), _text("statuses").alias("statuses"), F.size("times").cast("bigint").alias("n_times"))


def csv_roundtrip_query(spark, folder):
    """Events written as CSV with permuted columns, text case ids and no time: the order is that of the files."""
    path = new_path(spark, "csv")
    rows = _table(spark, folder, "events").orderBy("ts", "event_id")
    rows.select(F.col("event_type").alias("ActivityID"), F.lit("x").alias("Other"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("CaseID")).write.csv(path, header=True)
    return traces.traces(read_csv_log(spark, path)).select("case_id", _text("acts").alias("trace"))


# -- similarity ----------------------------------------------------------------------------------

def _halves(spark, folder):
    rows = traces.prefixes(_parts("lineitem", spark, folder)[1])
    return rows.select("case_id", F.col("length").cast("bigint").alias("length"), "prefix", "suffix")


def levenshtein_similarity_query(spark, folder):
    similarity = F.round(levenshtein_similarity(F.col("prefix"), F.col("suffix")), 9)
    return _halves(spark, folder).select("case_id", "length", similarity.alias("similarity"))


def damerau_similarity_query(spark, folder):
    rows = _halves(spark, folder)
    scored = score_pairs(rows, "prefix", "suffix")
    return scored.select("case_id", "length", F.round("damerau_similarity", 9).alias("similarity"))


# -- n-gram features -----------------------------------------------------------------------------

def activity_ngrams_query(spark, folder):
    return ngrams.first_lengths(_traces("lineitem", spark, folder)).select("case_id", "ngram", "n")


def ngram_vocabulary_query(spark, folder):
    return ngrams.vocabulary(ngrams.first_lengths(_parts("lineitem", spark, folder)[0])).select("ngram", "n_traces")


def ngram_features_query(spark, folder):
    grams = ngrams.first_lengths(_parts("lineitem", spark, folder)[0])
    return ngrams.binary_features(grams, ngrams.vocabulary(grams)).select("case_id", "ngram")


def orders_ngrams_query(spark, folder):
    """Over labels that hold blanks."""
    return ngrams.first_lengths(_traces("orders", spark, folder)).select("case_id", "ngram", F.size("gram").cast("bigint").alias("size"), "n")


def orders_ngram_features_query(spark, folder):
    grams = ngrams.first_lengths(_parts("orders", spark, folder)[0])
    return ngrams.binary_features(grams, ngrams.vocabulary(grams)).select("case_id", "ngram", F.size("gram").cast("bigint").alias("size"))


def prefix_features_query(spark, folder):
    train = _parts("conversations", spark, folder)[0]
    grams = ngrams.first_lengths(train)
    rows = ngrams.prefix_features(grams, ngrams.vocabulary(grams), traces.max_trace_length(train))
    return rows.select("case_id", F.col("length").cast("bigint").alias("length"), "ngram")


def _product(a, b):
    """Product of two projections; with as many axes as n-grams it counts the n-grams both hold."""
    return F.round(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 6)


def _by_sequence(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct sequences with their counts, and the sequence of each case: equal sequences are projected once."""
    distinct = materialize(traces.variants(train).select("variant_id", "acts", "n_traces"), "sequences")
    return distinct, _of_cases(train, distinct, "variant_id")


def _grams(distinct: DataFrame) -> DataFrame:
    return ngrams.first_lengths(distinct, "variant_id").join(distinct.select("variant_id", "n_traces"), "variant_id")


def svd_features_query(spark, folder):
    """Products of every projected training trace with itself and with the first one."""
    distinct, cases = _by_sequence(_parts("lineitem", spark, folder, write=True)[0])
    grams = materialize(_grams(distinct), "grams")
    projected = materialize(svd.svd_features(grams, svd.svd_basis(grams, "variant_id", weight="n_traces"), "variant_id"), "projections")
    first = projected.orderBy("variant_id").select("projection").head()  # as many numbers as axes; the first case names its sequence
    x, other = F.col("projection"), F.array(*[F.lit(a) for a in first["projection"]]) if first else F.col("projection")
    products = materialize(projected.select("variant_id", _product(x, x).alias("own"), _product(x, other).alias("with_first")), "products")
    return cases.join(products, "variant_id").select("case_id", "own", "with_first")


def prefix_projections_query(spark, folder):
    """Products of every projected prefix of a training trace with itself, and with the prefix one event shorter."""
    distinct, cases = _by_sequence(_parts("lineitem", spark, folder, write=True)[0])
    basis = svd.svd_basis(_grams(distinct), "variant_id", weight="n_traces")
    rows = svd.prefix_projections(distinct, basis, "variant_id")
    before = F.lag("projection").over(Window.partitionBy("variant_id").orderBy("length"))
    x = F.col("projection")
    products = rows.withColumn("before", before).select(
        "variant_id", F.col("length").cast("bigint").alias("length"), _product(x, x).alias("own"), _product(x, F.col("before")).alias("with_before")
    )
    return cases.join(materialize(products, "products"), "variant_id").select("case_id", "length", "own", "with_before")


# -- process trees -------------------------------------------------------------------------------

def _fixed_models(spark, folder, log: str) -> DataFrame:
    acts = A.labels(LOGS[log](spark, folder))
    return trees.models_from(spark, {"flower": A.flower(acts), "bag": A.bag(acts)})


def _all_variants(spark, folder) -> DataFrame:
    """Every log's variants, written: the log is the model they belong to."""
    rows = None
    for name in LOGS:
        found = traces.variants(_traces(name, spark, folder).withColumn("model_id", F.lit(name)), "model_id")
        rows = found if rows is None else rows.unionAll(found)
    return materialize(rows, "variants")


def discovered_trees(spark, folder) -> DataFrame:
    return discover(_all_variants(spark, folder).select("model_id", "acts", "n_traces"))


def discovered_tree_query(spark, folder):
    return discovered_trees(spark, folder)


def tree_table_query(spark, folder):
    nodes = tree.tree_nodes(_fixed_models(spark, folder, "lineitem"))
    return nodes.select("model_id", "type", "shortname", *_long("node_id", "parent_id", "child_ix", "depth"))


def tree_memberships_query(spark, folder):
    return tree.memberships(tree.tree_nodes(_fixed_models(spark, folder, "lineitem")))


def tree_lca_query(spark, folder):
    pairs = tree.lowest_common_ancestors(tree.tree_nodes(_fixed_models(spark, folder, "lineitem")))
    return pairs.select("model_id", *_long("node_1", "node_2", "ancestor", "level"))


def tree_branch_sizes_query(spark, folder):
    return tree.branch_sizes(tree.tree_nodes(_fixed_models(spark, folder, "lineitem"))).select(
        "model_id", *_long("and_id", "branch", "n_nodes")
    )


def model_alphabet_query(spark, folder):
    return tree.alphabet(tree.tree_nodes(discovered_trees(spark, folder)))


# -- replay, footprint, decisions ----------------------------------------------------------------

def _replayed(spark, folder, model_id: str, log: str = "lineitem") -> tuple[DataFrame, DataFrame]:
    """Training variants replayed on one fixed model, and the model's nodes."""
    models = _fixed_models(spark, folder, log).where(F.col("model_id") == model_id)
    train = _parts(log, spark, folder)[0].withColumn("model_id", F.lit(model_id))
    return replay.replay(traces.variants(train, "model_id"), models), tree.tree_nodes(models)


def fired_transitions_query(spark, folder):
    replayed, nodes = _replayed(spark, folder, "flower")
    names = tree.transitions(nodes).select("model_id", "transition", F.col("name").alias("fired"))
    return replay.fired_transitions(replayed).join(names, ["model_id", "transition"]).select(
        "variant_id", F.col("pos").cast("bigint").alias("pos"), "fired"
    )


def visible_path_query(spark, folder):
    replayed, nodes = _replayed(spark, folder, "bag")
    shown = replay.visible_path(replayed, tree.transitions(nodes))
    path = F.array_sort(F.collect_list(F.struct("pos", "activity")))
    return shown.groupBy("variant_id").agg(path.alias("p")).select("variant_id", _text("p.activity").alias("path"))


def loop_counters_query(spark, folder):
    replayed, nodes = _replayed(spark, folder, "flower")
    return footprint.counters(replayed, nodes).select(
        "variant_id", *_long("pos", "operator", "count")
    )


def and_steps_query(spark, folder):
    replayed, nodes = _replayed(spark, folder, "bag")
    rows = footprint.footprint(replayed, nodes)
    return rows.select("variant_id", *_long("operator", "step"), F.col("value").alias("branch"))


def footprint_query(spark, folder):
    replayed, nodes = _replayed(spark, folder, "flower")
    rows = footprint.named(footprint.footprint(replayed, nodes), nodes)
    return rows.select("variant_id", F.col("n_traces").alias("weight"), "operator", "loop_ctx", "value")


def _counts(spark, folder, model_id: str, log: str = "lineitem") -> tuple[DataFrame, DataFrame]:
    replayed, nodes = _replayed(spark, folder, model_id, log)
    return D.decision_counts(footprint.footprint(replayed, nodes)), nodes


def decision_table_query(spark, folder):
    counts, nodes = _counts(spark, folder, "flower", "events")
    return footprint.named(counts, nodes).select("operator", "loop_ctx", "source", "value", "cnt")


def xor_decisions_query(spark, folder):
    counts, nodes = _counts(spark, folder, "flower", "events")
    return footprint.named(D.xor_decisions(counts), nodes).select("loop_ctx", "source", "value", "n")


def loop_decisions_query(spark, folder):
    counts, _ = _counts(spark, folder, "flower", "events")
    return D.loop_decisions(counts).select(*_long("operator"), "source", "median", "n")


def and_decisions_query(spark, folder):
    counts, nodes = _counts(spark, folder, "bag")
    rows = D.and_decisions(counts, nodes)
    return rows.select(*_long("operator", "step"), "source", F.array_join(F.col("ranked").cast("array<string>"), COMMA).alias("ranked"), "n")


def decision_lookup_query(spark, folder):
    counts, nodes = _counts(spark, folder, "flower")
    table = D.decision_table(materialize(counts, "decision-counts"), nodes)
    asked = _parts("lineitem", spark, folder)[1].select(
        "case_id", F.lit("flower").alias("model_id"), F.lit(1).alias("operator"), F.lit("Xor").alias("kind"),
        F.lit(None).cast("int").alias("step"), F.concat(F.lit("[XorLoop0]{"), F.size("acts"), F.lit("}")).alias("loop_ctx"),
    )
    found = D.look_up(asked, table).withColumn("value", F.get("choice", F.lit(0)).cast("int"))
    return footprint.named(found, nodes).select("case_id", "source", "value")


def discovered_replay_query(spark, folder):
    """Every log's variants on the tree discovered from them: what is shown, and what could not be played."""
    rows = _all_variants(spark, folder)
    models = materialize(discover(rows.select("model_id", "acts", "n_traces")), "models")
    nodes = tree.tree_nodes(models)
    replayed = materialize(replay.replay(rows, models), "replayed")
    path = F.array_sort(F.collect_list(F.struct("pos", "activity")))
    shown = replay.visible_path(replayed, tree.transitions(nodes)).groupBy("model_id", "variant_id").agg(path.alias("p"))
    return replayed.join(shown, ["model_id", "variant_id"]).select(
        "model_id", "variant_id", _text("p.activity").alias("path"), *_long("n_skipped")
    )


# -- prediction ----------------------------------------------------------------------------------

def _flower_model(spark, folder, log: str):
    acts = A.labels(LOGS[log](spark, folder))
    models = trees.models_from(spark, {MAIN: A.flower(acts)})
    train, test = _parts(log, spark, folder, write=True)
    return suffix_model.fit(train.withColumn("model_id", F.lit(MAIN)), models), train, test


def predicted_suffixes_query(spark, folder):
    model, _, test = _flower_model(spark, folder, "lineitem")
    distinct = suffix_model.distinct_sequences(test)
    guessed = model.predict(
        distinct.select(F.lit(MAIN).alias("model_id"), "variant_id", "acts", F.sequence(F.lit(2), F.size("acts") - 1).alias("lengths"))
    )
    return guessed.select("variant_id", F.col("length").cast("bigint").alias("length"), _text("suffix_guessed").alias("suffix_guessed"))


def predict_one_query(spark, folder):
    """Continuation of the first two events of the last case."""
    model, _, test = _flower_model(spark, folder, "conversations")
    last = test.where(F.size("acts") >= 2).groupBy().agg(F.max_by("acts", "case_id").alias("acts")).select(
        F.lit(MAIN).alias("model_id"), F.lit(0).cast("bigint").alias("variant_id"), F.slice("acts", 1, 2).alias("acts"),
        F.array(F.lit(2)).alias("lengths"),
    )
    return model.predict(last).join(last.select("variant_id", "acts"), "variant_id").select(
        _text("acts").alias("prefix"), _text("suffix_guessed").alias("suffix_guessed")
    )


def _lines(spark, folder, log: str = "events"):
    model, train, test = _flower_model(spark, folder, log)
    return suffix_model.prediction_lines(test, model), train


def prediction_lines_query(spark, folder):
    return _lines(spark, folder)[0].select(
        "case_id", F.col("length").cast("bigint").alias("length"), _text("prefix").alias("prefix"),
        _text("suffix_guessed").alias("suffix_guessed"), _text("suffix").alias("suffix"),
        F.round("damerau_similarity", 9).alias("damerau_similarity"),
        F.round("levenshtein_similarity", 9).alias("levenshtein_similarity"),
    )


def decision_source_tally_query(spark, folder):
    return report.decision_source_tally(_lines(spark, folder, "lineitem")[0])


def describe_similarity_query(spark, folder):
    stats = report.describe(_lines(spark, folder, "lineitem")[0])
    return stats.select("nobs", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "variance", "skewness", "kurtosis")])


def run_report_query(spark, folder):
    lines, train = _lines(spark, folder, "lineitem")
    rows = report.run_report(lines, train.agg(F.count(F.lit(1)).alias("n_train")), Settings(dataset="lineitem"))
    stats = [F.round(c, 6).alias(c) for c in ("min", "max", "mean", "variance", "skewness", "kurtosis")]
    return rows.select("dataset", "ngram_min", "ngram_max", "n_train", "n_test", "nobs", *stats)


def discovered_lines(spark, folder, log: str = "conversations") -> DataFrame:
    """Prediction lines of the unclustered run on the tree discovered from the training log."""
    train, test = _parts(log, spark, folder, write=True)
    keyed = train.withColumn("model_id", F.lit(MAIN))
    models = materialize(discover(traces.variants(keyed, "model_id")), "models")
    return suffix_model.prediction_lines(test, suffix_model.fit(keyed, models))


def discovered_predictions_query(spark, folder):
    return discovered_lines(spark, folder).select(
        "case_id", "length", _text("suffix_guessed").alias("suffix_guessed"), F.round("damerau_similarity", 9).alias("similarity")
    )


# -- clustered run -------------------------------------------------------------------------------

def _fitted(spark, folder, log: str = "conversations"):
    """The clustered model of a log, with the validation and the test traces."""
    train, test = _parts(log, spark, folder, write=True)
    train, validation = split.cut_validation(train)
    train, validation = materialize(train, "train"), materialize(validation, "validation")
    return clustered.fit_clustered(train), validation, test


def _members(spark, folder) -> tuple[DataFrame, C.Clustering]:
    """Training traces of the largest log, and their clusters."""
    train = _parts("lineitem", spark, folder, write=True)[0]
    return train, C.cluster_traces(train)


def core_distances_query(spark, folder):
    """How far the second, third, ... nearest trace of every distinct n-gram set is."""
    points = C.points_of(C.feature_points(_parts("lineitem", spark, folder)[0]))
    sizes = Settings().candidates()
    cored = neighbours.core_distances(points, sizes).select("name", "weight", F.posexplode("cores").alias("place", "core"))
    return cored.select("name", "weight", F.element_at(F.array(*[F.lit(s) for s in sizes]), F.col("place") + 1).cast("bigint").alias("candidate"), "core")


def trace_clusters_query(spark, folder):
    found = _members(spark, folder)[1].memberships
    return found.select("candidate", "cluster_id", "variant_id", "n_traces", F.round("prob", 9).alias("prob"))


def cluster_representatives_query(spark, folder):
    return C.representatives(_members(spark, folder)[1].memberships).select(
        "candidate", "cluster_id", "variant_id", "n_traces", "is_build", "is_training", F.round("prob", 9).alias("prob")
    )


def cluster_traces_join_query(spark, folder):
    """Training traces of every cluster, by the variant they are."""
    train, found = _members(spark, folder)
    members = C.representatives(found.memberships).where("is_training").select(clustered.model_name("candidate", "cluster_id").alias("model_id"), "variant_id")
    models = members.groupBy("variant_id").agg(F.collect_list("model_id").alias("models"))  # a few per candidate, as shares add up to one
    listed = materialize(found.variants.join(models, "variant_id").select("acts", "models"), "models-of-variants")
    return _of_cases(train, listed, "models", "acts").select(F.explode("models").alias("model_id"), "case_id", _text("acts").alias("trace"))


def cluster_coverage_query(spark, folder):
    return C.coverage(C.representatives(_members(spark, folder)[1].memberships))


def _routing(spark, folder):
    train, test = _parts("lineitem", spark, folder, write=True)
    found = C.cluster_traces(train)
    labelled = C.hard_labels(found.memberships).join(found.variants, "variant_id").select("candidate", "cluster_id", "variant_id", "acts")
    return train_router(labelled, train.agg(F.max(F.size("acts"))).first()[0]), test


def prefix_router_query(spark, folder):
    """Clusters and biases of every classifier."""
    router, _ = _routing(spark, folder)
    rows = router.models.select("candidate", "length", F.posexplode("weights").alias("place", "w"), "clusters")
    return rows.select("candidate", "length", F.get("clusters", F.col("place")).alias("cluster_id"), F.round(F.element_at("w", -1), 6).alias("bias"))


def routed_prefixes_query(spark, folder):
    router, test = _routing(spark, folder)
    return route(traces.variants(test).select("variant_id", "acts"), router)


def candidate_scores_query(spark, folder):
    fitted, validation, _ = _fitted(spark, folder)
    return clustered.candidate_scores(validation, fitted).select("candidate", F.round("score", 9).alias("score"), "n_prefixes")


def best_candidate_query(spark, folder):
    fitted, validation, _ = _fitted(spark, folder)
    return clustered.best_candidate(clustered.candidate_scores(validation, fitted)).select(
        "candidate", F.round("score", 9).alias("score")
    )


def clustered_predictions_query(spark, folder):
    fitted, validation, test = _fitted(spark, folder)
    return clustered.clustered_lines(test, validation, fitted).select(
        "case_id", "length", "candidate", _text("suffix_guessed").alias("suffix_guessed"),
        F.round("damerau_similarity", 9).alias("similarity"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name.removesuffix("_query"): run for name, run in globals().items() if name.endswith("_query")}
