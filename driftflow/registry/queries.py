"""The named queries. Each takes the session and the folder of the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftflow.functions import scalars as S
from driftflow.operators import (
    balancing, cleaning, copula, distribution, drift, evaluation, models, network, sampling, scaling, timeline, training,
)
from driftflow.plans import adaptive_experiment, ingest, static_drift, static_experiment
from driftflow.registry import fixtures as X
from driftflow.session import fresh_path, settle, spread
from driftflow.sources import days as day_tables
from driftflow.sources import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Small enough to make every bucket path run on the test tables.
SMALL_BUCKET = 2_000


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _round(df: DataFrame, *names: str) -> DataFrame:
    """Sums of doubles differ in their last bits with the order of the rows."""
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


# --- sources, cleaning ---------------------------------------------------------

RAW_LABELS = {"view": "Benign", "click": "DDOS attack-HOIC", "error": "Infilteration",
              "purchase": "SQL Injection", "signup": "Brute Force -Web"}


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as an uncleaned day file would hold them: text cells, some of them bad."""
    pairs = [F.lit(x) for pair in RAW_LABELS.items() for x in pair]
    name = F.create_map(*pairs)[F.col("label")]
    kind = F.col("event_id") % 11
    label = (
        F.when(kind == 0, F.concat(F.lit("  "), name, F.lit("\t"))).when(kind == 1, "Label")
        .when(kind == 2, " Label ").when(kind == 3, "unknown").when(kind == 4, F.lit(None)).otherwise(name))
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    form = F.col("event_id") % 13
    number = (
        F.when(form == 0, "Infinity").when(form == 1, "abc").when(form == 2, "").when(form == 3, "1d")
        .when(form == 4, F.concat(F.lit(" "), cents, F.lit(" "))).when(form == 5, "-inf").when(form == 6, "1e3")
        .when(form == 7, "nan").otherwise(cents))
    return X.event_days(spark, sf).select(
        "day", "event_id", F.lit("01/01/2024 00:00").alias("Timestamp"), number.alias("amount"),
        label.alias("Label"))


@query
def day_registry(spark, sf):
    return timeline.timeline_of(X.event_days(spark, sf))


@query
def clean_labels(spark, sf):
    return cleaning.standardize_labels(raw_events(spark, sf)).select("day", "event_id", "label")


@query
def coerce_numeric_zero(spark, sf):
    raw = raw_events(spark, sf).select("event_id", "amount")
    return cleaning.zero_bad(cleaning.coerce_numbers(raw, ["amount"]), ["amount"])


@query
def coerce_numeric_drop(spark, sf):
    raw = raw_events(spark, sf).select("event_id", "amount")
    return cleaning.drop_unfinite(cleaning.coerce_numbers(raw, ["amount"]), ["amount"])


@query
def header_trim_project(spark, sf):
    padded = raw_events(spark, sf).toDF(" day", "event_id ", " Timestamp ", "amount ", " Label")
    table = cleaning.trim_headers(padded).drop("Timestamp")
    return scaling.project(table, cleaning.feature_names(table, ["day", "Label"]), ["day"])


@query
def csv_roundtrip(spark, sf):
    path = fresh_path(spark, "events-csv")
    day_tables.write_csv(raw_events(spark, sf).drop("day", "Label"), path)
    back = day_tables.read_day_files(spark, {"all": path, "absent": path + "-absent"})
    return back.select("day", F.col("event_id").cast("bigint").alias("event_id"), "Timestamp",
                       F.coalesce("amount", F.lit("")).alias("amount"))


@query
def day_table_roundtrip(spark, sf):
    path = fresh_path(spark, "events-days")
    table = X.event_days(spark, sf)
    day_tables.write_day_table(table, path)
    day_tables.write_day_table(table.limit(0), path)  # exists, so it is kept
    days = [r["day"] for r in timeline.timeline_of(table).where("role = 'future'").collect()]
    return day_tables.read_day_table(spark, path, [*days, "2031-01-01"]).select("day", "label", "value", "event_id")


@query
def append_day_table(spark, sf):
    """The empty table is written first; what it says of itself decides how the parts are added."""
    path = fresh_path(spark, "anchor")
    table = X.event_days(spark, sf)
    start = day_tables.write_day_table(day_tables.empty_day_table(spark, ["value"]), path, "overwrite")
    answers = [day_tables.is_populated(start)]
    for benign in (True, False):
        part = table.where((F.col("label") == "view") == F.lit(benign)).select("day", "value", "label")
        start = day_tables.write_day_table(part, path, "append" if day_tables.is_populated(start) else "overwrite")
    answers.append(day_tables.is_populated(start))
    counts = start.groupBy("day", "label").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    return counts.withColumns({"before": F.lit(answers[0]), "after": F.lit(answers[1])})


@query
def ingest_incremental(spark, sf):
    """Day files in two deliveries, the first of them again in the second, and one that is absent; all rows kept."""
    base = fresh_path(spark, "deliveries")
    raw = raw_events(spark, sf).withColumn("part", F.concat(F.lit("w"), F.substring("day", 10, 1).cast("int") % 4)).drop("day")
    files = {}
    for part in ("w0", "w1", "w2", "w3"):
        files[part] = f"{base}/{part}.csv"
        day_tables.write_csv(raw.where(F.col("part") == part).drop("part"), files[part])
    files["w4"] = f"{base}/w4.csv"
    every = {"target_rows": None, "default_fraction": None, "fractions": {}}
    ingest.ingest_days(spark, {day: files[day] for day in ("w0", "w2")}, base, **every)
    table = ingest.ingest_days(spark, files, base, **every)
    return table.select("day", F.col("event_id").cast("bigint").alias("event_id"), "amount", "label")


@query
def ingest_sample_clean(spark, sf):
    """Sampling per day and chunk, bad rows dropped, exact rows per day, cleaning."""
    raw = raw_events(spark, sf).withColumn("chunk", F.floor(F.col("event_id") / 1000))
    part = ingest.day_fraction(F.col("day"), {"2024-01-04": 0.15})
    sampled = ingest.sample_days(raw, F.col("event_id"), 60, part, without=("day", "chunk", "event_id"))
    return cleaning.clean(sampled, ["amount"]).select("day", "event_id", "amount", "label")


# --- sampling ------------------------------------------------------------------

@query
def sample_fraction(spark, sf):
    return sampling.sample_fraction(X.event_days(spark, sf), 0.3, ["day"], F.col("event_id"))


@query
def sample_n(spark, sf):
    return sampling.sample_rows(X.event_days(spark, sf), 300, ["day"], F.col("event_id"))


@query
def sample_n_replace(spark, sf):
    table = X.event_days(spark, sf)
    return sampling.sample_with_replacement(table, 340, ["day"], F.col("event_id"))


@query
def random_order_limit(spark, sf):
    table = X.lineitem_days(spark, sf, keyed=True)
    return sampling.sample_rows(table, 100, ["label"], F.col("row_key"), seed=7).select("row_key", "label")


@query
def stratified_anchor_sample(spark, sf):
    return sampling.sample_fraction(X.event_days(spark, sf), 0.05, ["day", "label"], F.col("event_id"))


@query
def cap_sample(spark, sf):
    table = X.lineitem_days(spark, sf, keyed=True)
    long = distribution.melt(table, X.L_FEATURES, ["day", "row_key"])
    days = timeline.timeline_of(table)
    return static_drift.capped_values(long, days, 5_000).select("day", "row_key", "feature", "value")


@query
def downsample_classes(spark, sf):
    table = X.lineitem_days(spark, sf, keyed=True)
    return balancing.downsample_classes(table, 2_850, F.col("row_key")).select("day", "label", "row_key")


# --- features and scaling ------------------------------------------------------

@query
def zero_variance_features(spark, sf):
    table = X.lineitem_days(spark, sf).withColumn("constant", F.lit(7.5))
    return scaling.fit_scaler(table, [*X.L_FEATURES, "constant"]).select("ord", "feature")


@query
def scaler_fit(spark, sf):
    table = X.lineitem_days(spark, sf)
    path = fresh_path(spark, "scaler")
    state.save_scaler(static_drift.baseline_scaler(table, timeline.timeline_of(table), X.L_FEATURES), path)
    return state.load_scaler(spark, path)


@query
def scaler_state(spark, sf):
    """The state is asked for before the baseline is fitted, which raises, and after."""
    table = X.lineitem_days(spark, sf)
    path = fresh_path(spark, "scaler")
    try:
        before = state.load_scaler(spark, path)
    except FileNotFoundError:
        before = None
    state.save_scaler(static_drift.baseline_scaler(table, timeline.timeline_of(table), X.L_FEATURES), path)
    steps = [(name, found) for name, found in (("before", before), ("after", state.load_scaler(spark, path)))]
    rows = [spark.range(1).select(F.lit(name).alias("step"), F.lit(False).alias("found"), F.lit(0).cast("bigint").alias("features"))
            if found is None else
            found.agg(F.count(F.lit(1)).alias("features")).select(F.lit(name).alias("step"), F.lit(True).alias("found"), "features")
            for name, found in steps]
    return reduce(DataFrame.unionByName, rows)


@query
def retained_feature_count(spark, sf):
    table = X.vector_days(spark, sf)
    scaler = static_drift.baseline_scaler(table, timeline.timeline_of(table), X.V_FEATURES)
    return scaler.agg(F.count(F.lit(1)).alias("features"))


@query
def scale_transform(spark, sf):
    table = X.lineitem_days(spark, sf, keyed=True)
    days, scaler = X.fitted(table, X.L_FEATURES)
    future = table.join(F.broadcast(days.where("role = 'future'").select("day")), "day", "left_semi")
    return scaling.project(scaler.scale(future), scaler.features, ["day", "row_key"])


@query
def scale_inverse(spark, sf):
    table = X.lineitem_days(spark, sf, keyed=True)
    _, scaler = X.fitted(table, X.L_FEATURES)
    back = scaler.unscale(scaler.scale(table)).select("row_key", *X.L_FEATURES)
    return _round(back, *X.L_FEATURES)


@query
def narrow_matrix(spark, sf):
    """Scaled features as 32-bit floats with the binary target."""
    table = X.lineitem_days(spark, sf, keyed=True)
    _, scaler = X.fitted(table, X.L_FEATURES)
    return training.model_rows(table, scaler, X.L_BENIGN, ["day", "row_key"], single=True)


# --- distributions and drift ---------------------------------------------------

def _scaled_lineitem(spark, sf):
    table = X.lineitem_days(spark, sf)
    days, scaler = X.fitted(table, X.L_FEATURES)
    return scaling.project(scaler.scale(table), scaler.features, ["day"]), days, scaler.features


def _scaled_long(spark, sf):
    table, days, features = _scaled_lineitem(spark, sf)
    return distribution.melt(settle(spread(table), "features"), features), days


@query
def quantile_edges(spark, sf):
    long, _ = _scaled_long(spark, sf)
    edges = distribution.quantile_edges(long, by=["day"])
    return edges.select("day", "feature", F.posexplode("edges").alias("k", "edge"))


@query
def quantile_edges_bucketed(spark, sf):
    """The same in small value ranges."""
    long, _ = _scaled_long(spark, sf)
    edges = distribution.quantile_edges(long, by=["day"], cuts=distribution.value_cuts(long, SMALL_BUCKET))
    return edges.select("day", "feature", F.posexplode("edges").alias("k", "edge"))


@query
def histogram_open(spark, sf):
    long, days = _scaled_long(spark, sf)
    edges = drift.open_psi_edges(long, timeline.baseline_pairs(days))
    return distribution.histogram(long, edges, ["day"])


@query
def histogram_window(spark, sf):
    """Closed bins: edges from the baseline, values beyond them in no bin."""
    long, days = _scaled_long(spark, sf)
    base = long.join(F.broadcast(days.where("role = 'baseline'").select("day")), "day", "left_semi")
    edges = distribution.quantile_edges(base)
    edges = edges.withColumn("edges", distribution.window_edges(F.col("edges")))
    return distribution.histogram(long, edges, ["day"], closed=True)


@query
def psi_open(spark, sf):
    long, days = _scaled_long(spark, sf)
    return _round(drift.psi_open(long, timeline.baseline_pairs(days)), "psi")


@query
def psi_window(spark, sf):
    long, days = _scaled_long(spark, sf)
    return _round(drift.psi_window(long, timeline.window_pairs(days)), "psi")


@query
def wasserstein(spark, sf):
    long, days = _scaled_long(spark, sf)
    return _round(drift.wasserstein(long, timeline.baseline_pairs(days)), "wasserstein")


@query
def wasserstein_bucketed(spark, sf):
    long, days = _scaled_long(spark, sf)
    cuts = distribution.value_cuts(long, SMALL_BUCKET)
    return _round(drift.wasserstein(long, timeline.baseline_pairs(days), cuts), "wasserstein")


@query
def feature_drift(spark, sf):
    table, days, features = _scaled_lineitem(spark, sf)
    pairs = timeline.baseline_pairs(days)
    return _round(drift.feature_drift(table, features, pairs, rows_per_bucket=SMALL_BUCKET), "psi", "wasserstein")


@query
def feature_drift_vectors(spark, sf):
    table = X.vector_days(spark, sf)
    days, scaler = X.fitted(table, X.V_FEATURES)
    return _round(static_drift.static_feature_drift(table, days, scaler), "psi", "wasserstein")


@query
def feature_drift_capped(spark, sf):
    table = X.lineitem_days(spark, sf, keyed=True)
    days, scaler = X.fitted(table, X.L_FEATURES)
    found = static_drift.static_feature_drift(table, days, scaler, max_samples=5_000, key=F.col("row_key"))
    return _round(found, "psi", "wasserstein")


@query
def daily_drift(spark, sf):
    table = X.lineitem_days(spark, sf)
    days, scaler = X.fitted(table, X.L_FEATURES)
    return _round(static_drift.static_drift(table, days, scaler), "mean_psi", "mean_wd")


@query
def daily_drift_events(spark, sf):
    table = X.event_days(spark, sf)
    days, scaler = X.fitted(table, ["value"])
    return _round(static_drift.static_drift(table, days, scaler), "mean_psi", "mean_wd")


@query
def first_drift_days(spark, sf):
    """The first five daily records."""
    table = X.event_days(spark, sf)
    days, scaler = X.fitted(table, ["value"])
    return _round(static_drift.static_drift(table, days, scaler).limit(5), "mean_psi", "mean_wd")


# --- windows, anchor, pools ----------------------------------------------------

@query
def window_schedule(spark, sf):
    return timeline.window_schedule(timeline.timeline_of(X.event_days(spark, sf)))


@query
def exit_schedule(spark, sf):
    return timeline.exit_schedule(timeline.timeline_of(X.event_days(spark, sf)))


@query
def anchor_schedule(spark, sf):
    return timeline.anchor_schedule(timeline.timeline_of(X.event_days(spark, sf)))


@query
def active_window_feature_drift(spark, sf):
    table, days, features = _scaled_lineitem(spark, sf)
    found = drift.feature_drift(table, features, timeline.window_pairs(days), closed=True,
                                rows_per_bucket=SMALL_BUCKET)
    return _round(found, "psi", "wasserstein")


@query
def active_window_drift(spark, sf):
    table = X.lineitem_days(spark, sf)
    days, scaler = X.fitted(table, X.L_FEATURES)
    return _round(adaptive_experiment.active_window_drift(table, days, scaler), "mean_psi", "mean_wd")


@query
def active_window_drift_events(spark, sf):
    table = X.event_days(spark, sf)
    days, scaler = X.fitted(table, ["value"])
    return _round(adaptive_experiment.active_window_drift(table, days, scaler), "mean_psi", "mean_wd")


@query
def history_anchor(spark, sf):
    table = X.lineitem_days(spark, sf, keyed=True)
    return training.history_anchor(table, F.col("row_key")).select("day", "label", "row_key")


@query
def training_pool(spark, sf):
    """Pools of all test days, with their sources."""
    table = X.event_days(spark, sf)
    days = timeline.timeline_of(table)
    anchor = training.history_anchor(table, F.col("event_id"))
    tests = sorted(r["ord"] for r in days.where("role = 'future'").collect())
    pools = [training.training_pool(table, anchor, days, test).select(
        F.lit(test).alias("test_ord"), "day", "label", "event_id", "src") for test in tests]
    return reduce(DataFrame.unionByName, pools)


@query
def training_pool_counts(spark, sf):
    table = X.event_days(spark, sf)
    anchor = training.history_anchor(table, F.col("event_id"))
    return training.pool_counts(table, anchor, timeline.timeline_of(table))


# --- balancing -----------------------------------------------------------------

@query
def class_counts(spark, sf):
    return balancing.ranked_class_counts(X.event_days(spark, sf))


def _one_day_vectors(spark, sf):
    """All vectors as one day, and the bounds they are scaled with."""
    table = X.vector_days(spark, sf).withColumn("day", F.lit(1))
    return table, scaling.MinMax.of(scaling.fit_scaler(table, X.V_FEATURES))


def _mean_class(table: DataFrame) -> int:
    """A target between the smallest and the biggest class."""
    return balancing.class_counts(table).agg(F.floor(F.avg("n")).alias("n")).first()["n"]


def _biggest_class(table: DataFrame) -> int:
    return balancing.class_counts(table).agg(F.max("n").alias("n")).first()["n"]


@query
def synthesize_minority(spark, sf):
    table, scaler = _one_day_vectors(spark, sf)
    return balancing.synthesize_minority(
        scaler.scale(table), scaler.features, _biggest_class(table), F.col("vec_id"))


@query
def synthesize_copula(spark, sf):
    """How many rows each class gets, and how many of them lie in the range of every feature of the class."""
    table, scaler = _one_day_vectors(spark, sf)
    scaled = settle(scaling.project(scaler.scale(table), scaler.features, ["day", "label", "vec_id"]), "scaled-vectors")
    made = copula.synthesize_copula(scaled, scaler.features, _biggest_class(table), F.col("vec_id"))
    ends = scaled.groupBy("day", "label").agg(
        *[x for f in scaler.features for x in (F.min(f).alias(f"{f}_low"), F.max(f).alias(f"{f}_high"))])
    inside = reduce(Column.__and__, [F.col(f).between(F.col(f"{f}_low"), F.col(f"{f}_high")) for f in scaler.features])
    return made.join(F.broadcast(ends), ["day", "label"]).groupBy("day", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(inside.cast("bigint")).alias("inside"))


@query
def balance_vectors(spark, sf):
    table, scaler = _one_day_vectors(spark, sf)
    balanced = balancing.balance_days(table, scaler, _mean_class(table), F.col("vec_id"))
    return _round(balanced.select("day", "label", "row_key", *scaler.features), *scaler.features)


def _balanced_lineitem(spark, sf):
    table = X.lineitem_days(spark, sf, keyed=True)
    days, scaler = X.fitted(table, X.L_FEATURES)
    return table, days, scaler, balancing.balance_days(table, scaler, _mean_class(table), F.col("row_key"))


@query
def balance_days(spark, sf):
    balanced = _balanced_lineitem(spark, sf)[3]
    return balancing.class_counts(balanced)


# --- models and measures -------------------------------------------------------

@query
def binary_labels(spark, sf):
    labelled = X.event_days(spark, sf).withColumn("label", F.when(F.col("event_id") % 10 > 0, F.col("label")))
    return training.binary_target(labelled, benign="view").select("event_id", "target")


def _ruled(spark, sf):
    """Two fixed rules as models; in 1996 truth and predictions have one class only."""
    table = X.lineitem_days(spark, sf)
    one_class = F.col("day") == 1996
    target = F.when(one_class, 0).otherwise(S.is_attack(F.col("label"), X.L_BENIGN))
    rules = {"discount": F.col("l_discount") * 10, "tax": F.col("l_tax") * 10}
    said = [F.struct(F.lit(name).alias("model"),
                     F.when(one_class, 0).otherwise(models.over_threshold(p)).alias("predicted"))
            for name, p in rules.items()]
    return table.select("day", target.alias("target"), F.inline(F.array(*said)))


@query
def confusion_counts(spark, sf):
    return evaluation.confusion(_ruled(spark, sf))


@query
def confusion_metrics(spark, sf):
    return _round(evaluation.performance(_ruled(spark, sf)), *evaluation.MEASURES)


@query
def performance_report(spark, sf):
    results = evaluation.performance(_ruled(spark, sf))
    return _round(evaluation.report(results, ["discount", "tax"], "accuracy"), "discount", "tax")


@query
def static_sets(spark, sf):
    """Rows and positives of the static training and test sets, unbalanced days as input."""
    table = X.lineitem_days(spark, sf)
    days, scaler = X.fitted(table, X.L_FEATURES)
    sets = training.static_sets(table, table, days, scaler, X.L_BENIGN)
    parts = [part.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("target").cast("bigint").alias("positives"))
             .withColumn("part", F.lit(name)) for name, part in zip(("train", "test"), sets)]
    return parts[0].unionByName(parts[1])


def _rule_lineitem(spark, sf):
    """Attack or not by a rule on one feature, so that a model that has learned it makes no mistake.

    Classes are brought to the size of the biggest, so the models learn from every row of the days they train on."""
    rule = F.when(F.col("l_discount") >= 0.05, "R").otherwise(X.L_BENIGN)
    table = X.lineitem_days(spark, sf, keyed=True).withColumn("label", rule)
    days, scaler = X.fitted(table, X.L_FEATURES)
    balanced = settle(balancing.balance_days(table, scaler, _biggest_class(table), F.col("row_key")), "balanced")
    return table, days, scaler, balanced


def _stages(kind, features):
    """Full models: 100 trees of depth 25, or hidden layers of 128 and 64."""
    return {"forest": {"forest": (models.forest(features), None)},
            "grown_forest": {"grown_forest": (models.GrownForest(tuple(features)), None)},
            "perceptron": {"perceptron": (models.perceptron(features), models.THRESHOLD)},
            # More passes in smaller steps than the default: the rule is learned without a mistake.
            "network": {"network": (network.Network(tuple(features), dropout=0.0, epochs=12, batch=64, rate=0.01), models.THRESHOLD)}}[kind]


def _static(spark, sf, kind):
    table, days, scaler, balanced = _rule_lineitem(spark, sf)
    return evaluation.confusion(static_experiment.static_scores(
        table, balanced, days, scaler, _stages(kind, scaler.features), X.L_BENIGN))


@query
def static_forest(spark, sf):
    return _static(spark, sf, "forest")


@query
def static_forest_grown(spark, sf):
    return _static(spark, sf, "grown_forest")


@query
def static_mlp(spark, sf):
    return _static(spark, sf, "perceptron")


@query
def static_network(spark, sf):
    return _static(spark, sf, "network")


def _adaptive(spark, sf, kind):
    table, days, scaler, balanced = _rule_lineitem(spark, sf)
    found = adaptive_experiment.adaptive_experiment(
        table, balanced, days, scaler, F.col("row_key"), _stages(kind, scaler.features), X.L_BENIGN)
    return _round(found, "active_window_psi", "active_window_wd")


@query
def adaptive_forest(spark, sf):
    return _adaptive(spark, sf, "forest")


@query
def adaptive_mlp(spark, sf):
    return _adaptive(spark, sf, "perceptron")
