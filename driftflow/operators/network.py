"""A multilayer perceptron trained where the rows are.

Hidden layers of rectified units with dropout, one output, cross-entropy, Adam on mini-batches.
Rows are dealt to parts at random but the same on every run, and written. An epoch is one job:
every part starts from the shared weights and moments, goes through its rows once in an order
of its own, and sends back what it has come to, weighted by its rows. These are summed in a
tree, ``FAN_IN`` at a time, so the driver sees one row of the size of the network however many
parts there are. What leaves a task is a few times the weights, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftflow.session import settle

HIDDEN = (128, 64)
DROPOUT = 0.2
RATE = 1e-3
EPOCHS = 5
BATCH = 2048
ROWS_PER_PART = 100_000
FAN_IN = 16
_DECAY = (0.9, 0.999)
_STATE = "part int, rows double, state array<double>"


def _sizes(widths: Sequence[int]) -> list[tuple[int, int]]:
    return [(a + 1, b) for a, b in zip(widths, widths[1:])]


def layers_of(flat: np.ndarray, widths: Sequence[int]) -> list[np.ndarray]:
    """The weight matrices (the last row of each is the constant) as views of one vector."""
    out, at = [], 0
    for a, b in _sizes(widths):
        out.append(flat[at:at + a * b].reshape(a, b))
        at += a * b
    return out


def first_weights(widths: Sequence[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = [np.vstack([rng.standard_normal((a - 1, b)) * np.sqrt(2 / (a - 1)), np.zeros((1, b))]) for a, b in _sizes(widths)]
    return np.concatenate([p.ravel() for p in parts])


def probability(x: np.ndarray, layers: Sequence[np.ndarray]) -> np.ndarray:
    for w in layers[:-1]:
        x = np.maximum(x @ w[:-1] + w[-1], 0)
    z = (x @ layers[-1][:-1] + layers[-1][-1])[:, 0]
    return 0.5 * (1 + np.tanh(z / 2))


def gradient(x: np.ndarray, y: np.ndarray, layers: Sequence[np.ndarray], masks: Sequence[np.ndarray]) -> np.ndarray:
    """Slope of the mean cross-entropy; ``masks`` scale the hidden units (0 where one is left out)."""
    inputs = [x]
    for w, mask in zip(layers[:-1], masks):
        inputs.append(np.maximum(inputs[-1] @ w[:-1] + w[-1], 0) * mask)
    z = (inputs[-1] @ layers[-1][:-1] + layers[-1][-1])[:, 0]
    back = ((0.5 * (1 + np.tanh(z / 2)) - y) / len(y))[:, None]
    slopes = []
    for i in range(len(layers) - 1, -1, -1):
        slopes.append(np.vstack([inputs[i].T @ back, back.sum(axis=0)]).ravel())
        if i:
            back = (back @ layers[i][:-1].T) * (inputs[i] > 0) * masks[i - 1]
    return np.concatenate(slopes[::-1])


@dataclass(frozen=True)
class Network:
    """What to train; :meth:`fit` takes a table with the features and a ``target`` of 0 or 1."""

    features: tuple[str, ...]
    hidden: tuple[int, ...] = HIDDEN
    dropout: float = DROPOUT
    rate: float = RATE
    epochs: int = EPOCHS
    batch: int = BATCH
    rows_per_part: int = ROWS_PER_PART
    seed: int = 42

    @property
    def widths(self) -> list[int]:
        return [len(self.features), *self.hidden, 1]

    def _epoch(self, sent, number: int):
        widths, rate, dropout, batch_rows, seed = self.widths, self.rate, self.dropout, self.batch, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, list[np.ndarray]] = {}
            for batch in batches:
                table = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
                for part in np.unique(table[:, 0]):
                    parts.setdefault(int(part), []).append(table[table[:, 0] == part, 1:])
            for part, held in sorted(parts.items()):
                rows = np.concatenate(held)
                rng = np.random.default_rng([seed, number, part])
                rows = rows[np.lexsort(rows.T)][rng.permutation(len(rows))]
                steps, weights, mean, square = (sent.value[k].copy() for k in ("steps", "weights", "mean", "square"))
                layers = layers_of(weights, widths)
                for at in range(0, len(rows), batch_rows):
                    x, y = rows[at:at + batch_rows, :-1], rows[at:at + batch_rows, -1]
                    masks = [(rng.random((len(x), n)) >= dropout) / (1 - dropout) for n in widths[1:-1]]
                    slope = gradient(x, y, layers, masks)
                    steps += 1
                    mean += (1 - _DECAY[0]) * (slope - mean)
                    square += (1 - _DECAY[1]) * (slope * slope - square)
                    weights -= rate * (mean / (1 - _DECAY[0] ** steps)) / (np.sqrt(square / (1 - _DECAY[1] ** steps)) + 1e-8)
                state = np.concatenate([steps, weights, mean, square]) * len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([float(len(rows))]), pa.array([state], pa.list_(pa.float64()))],
                    names=["part", "rows", "state"])
        return run

    def fit(self, train: DataFrame) -> NetworkModel:
        """Rows with a null feature or target are left out; without rows the weights stay as they start."""
        spark = train.sparkSession
        columns = [F.col(f"`{f}`").cast("double").alias(f"x{i}") for i, f in enumerate(self.features)]
        rows = train.select(*columns, F.col("target").cast("double").alias("y")).na.drop()
        n = rows.count()
        parts = max(1, -(-n // self.rows_per_part))
        names = [*[f"x{i}" for i in range(len(columns))], "y"]
        # Equal rows are told apart by their place only, which is written before it is used.
        placed = settle(rows.withColumn("place", F.monotonically_increasing_id()), "network-rows")
        dealt = placed.select(F.pmod(F.xxhash64("place", F.lit(self.seed)), F.lit(parts)).cast("int").alias("part"), *names)
        dealt = settle(dealt.repartition(parts, "part"), "network-parts")
        weights = first_weights(self.widths, self.seed)
        state = {"steps": np.zeros(1), "weights": weights, "mean": np.zeros(len(weights)), "square": np.zeros(len(weights))}
        for number in range(self.epochs if n else 0):
            sent = spark.sparkContext.broadcast(state)
            sums = dealt.repartition(parts, "part").mapInArrow(self._epoch(sent, number), _STATE)
            level = parts
            while level > 1:
                level = -(-level // FAN_IN)
                sums = sums.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("part").applyInArrow(_added, _STATE)
            row = sums.toArrow()
            whole = np.stack([np.array(x) for x in row["state"].to_pylist()]).sum(axis=0) / sum(row["rows"].to_pylist())
            size = len(weights)
            state = {"steps": whole[:1], "weights": whole[1:size + 1], "mean": whole[size + 1:2 * size + 1], "square": whole[2 * size + 1:]}
            sent.unpersist()
        return NetworkModel(self.features, self.widths, state["weights"])


def _added(table: pa.Table) -> pa.Table:
    states = table.column("state").combine_chunks()
    total = states.flatten().to_numpy().reshape(len(states), -1).sum(axis=0)
    return pa.table({"part": table.column("part")[:1].cast(pa.int32()), "rows": pa.array([sum(table.column("rows").to_pylist())], pa.float64()),
                     "state": pa.array([total], pa.list_(pa.float64()))})


@dataclass(frozen=True)
class NetworkModel:
    features: tuple[str, ...]
    widths: list[int]
    weights: np.ndarray

    def probability(self) -> Column:
        """Chance of class 1; null where a feature is."""
        weights, widths = self.weights, list(self.widths)

        def run(x: pa.Array) -> pa.Array:
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            return pa.array(probability(rows, layers_of(weights, widths)))

        values = F.array(*[F.col(f"`{f}`").cast("double") for f in self.features])
        whole = ~F.exists(values, lambda v: v.isNull())
        asked = F.when(whole, values).otherwise(F.array(*[F.lit(0.0) for _ in self.features]))
        return F.when(whole, F.arrow_udf(run, "double")(asked))

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add ``probability`` (of class 0 and 1) and ``prediction``, as a Spark ML classifier does."""
        told = rows.withColumn("_p", self.probability())
        return told.withColumn("probability", F.array(1 - F.col("_p"), F.col("_p"))).withColumn(
            "prediction", (F.col("_p") > 0.5).cast("double")).drop("_p")
