"""The whole run over one project folder, stage by stage.

Each stage reads the tables of the stages before it and keeps its own result there:
``clean``, ``balanced`` and ``history_anchor`` as day tables with a ledger, ``scaler`` as
Parquet, the result tables as CSV.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftflow.operators import balancing, training
from driftflow.operators.cleaning import feature_names, require_features
from driftflow.operators.scaling import MinMax
from driftflow.operators.timeline import WINDOW, timeline
from driftflow.plans import adaptive_experiment, ingest, static_drift, static_experiment
from driftflow.sources import days as D
from driftflow.sources import state
from driftflow.sources.ledger import DayLedger

# Column names of the result tables.
DRIFT_COLUMNS = {"day": "Day", "mean_psi": "Mean_PSI", "mean_wd": "Mean_WD"}
PERFORMANCE_COLUMNS = {
    "model": "Model", "day": "Deployment_Day", "accuracy": "Accuracy", "precision": "Precision",
    "recall_detection_rate": "Recall_DetectionRate", "f1_score": "F1_Score",
    "false_positive_rate": "False_Positive_Rate", "active_window_psi": "Active_Window_PSI",
    "active_window_wd": "Active_Window_WD",
}

Stages = Mapping[str, tuple[Pipeline, float | None]]


class Project:
    """``days`` are the day keys in time order; the first ``baseline`` are the baseline."""

    def __init__(self, spark: SparkSession, folder: str, days: Sequence[str] = tuple(D.DAY_FILES),
                 baseline: int = WINDOW):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.days = timeline(spark, list(days), baseline)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _table(self, name: str) -> DayLedger:
        return DayLedger(self.spark, self.path(name))

    def load(self, files: Mapping[str, str], target_rows: int | None = ingest.TARGET_ROWS, **options) -> DataFrame:
        """Fetch, sample and clean the day files that are not loaded yet. ``target_rows=None,
        default_fraction=None, fractions={}`` keeps all rows."""
        return ingest.ingest_days(self.spark, files, self.folder, target_rows, **options)

    def clean(self) -> DataFrame:
        return self._table("clean").read()

    def fit_baseline(self) -> MinMax:
        """Retained features and their bounds from the baseline days; kept as a table."""
        clean = self.clean()
        features = feature_names(clean, ["day", "row_id", "label"])
        state.save_scaler(static_drift.baseline_scaler(clean, self.days, features), self.path("scaler"))
        return self.scaler()

    def scaler(self) -> MinMax:
        return MinMax.of(state.load_scaler(self.spark, self.path("scaler")))

    def balance(self, target: int = balancing.TARGET, days: Sequence[str] | None = None) -> DataFrame:
        """Balance all days, or the named ones, in one plan; days already balanced are kept."""
        scaler, balanced = self.scaler(), self._table("balanced")
        wanted = {r["day"] for r in self.days.collect()} if days is None else set(days)
        todo = sorted((wanted & self._table("clean").days()) - balanced.days())
        if todo:
            rows = require_features(self.clean().where(F.col("day").isin(todo)), scaler.features)
            balanced.append(balancing.balance_days(rows, scaler, target, F.col("row_id")), todo)
        return self.balanced()

    def balanced(self) -> DataFrame:
        return self._table("balanced").read()

    def history_anchor(self) -> DataFrame:
        """The anchor rows of every day that leaves the window; days that are not in it yet are added."""
        anchor, balanced, calendar = self._table("history_anchor"), self._table("balanced"), self.days.collect()
        last = max(r["ord"] for r in calendar)
        left = sorted(({r["day"] for r in calendar if r["ord"] <= last - WINDOW} & balanced.days()) - anchor.days())
        return anchor.append(training.history_anchor(balanced.read(left), F.col("row_key")), left) if left else anchor.read()

    def _checked(self) -> DataFrame:
        return require_features(self.clean(), self.scaler().features)

    def static_drift(self, **options) -> DataFrame:
        found = static_drift.static_drift(self._checked(), self.days, self.scaler(), **options)
        return self._result(found, "static_drift_metrics", DRIFT_COLUMNS)

    def static_experiment(self, stages: Stages | None = None) -> DataFrame:
        found = static_experiment.static_experiment(self._checked(), self.balanced(), self.days, self.scaler(), stages)
        return self._result(found, "static_performance_results", PERFORMANCE_COLUMNS)

    def adaptive_experiment(self, stages: Stages | None = None) -> DataFrame:
        found = adaptive_experiment.adaptive_experiment(
            self._checked(), self.balanced(), self.days, self.scaler(), F.col("row_key"), stages,
            anchor=self.history_anchor())
        return self._result(found, "adaptive_performance_results", PERFORMANCE_COLUMNS)

    def _result(self, found: DataFrame, name: str, columns: Mapping[str, str]) -> DataFrame:
        """Write a result table in time order under its published column names."""
        order = F.broadcast(self.days.select("day", "ord"))
        ordered = found.join(order, "day").orderBy("ord", *[c for c in ("model",) if c in found.columns])
        renamed = ordered.select(*[F.col(c).alias(columns[c]) for c in found.columns])
        D.write_csv(renamed.coalesce(1), self.path(name))
        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema.fields)
        return self.spark.read.schema(types).option("header", True).csv(self.path(name))
