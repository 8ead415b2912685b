"""FTRL-proximal logistic regression over hashed one-hot features, on tables and on streams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import hash_feature


class FTRL:
    """Per-coordinate learning rates with L1 and L2, weights worked out when they are used; optional interactions and dropout."""

    def __init__(self, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0, bits: int = 20, interactions: bool = False, dropout: float = 1.0, seed: int = 0):
        self.alpha, self.beta, self.l1, self.l2, self.bits = alpha, beta, l1, l2, bits
        self.interactions, self.keep, self.rng = interactions, dropout, np.random.default_rng(seed)
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def indices(self, x) -> np.ndarray:
        """Bias, the buckets, and (sorted) pairs of them if interactions are wanted."""
        x = [int(i) for i in x]
        more = [hash((a, b)) % (1 << self.bits) for a, b in combinations(sorted(x), 2)] if self.interactions else []
        return np.array([0, *x, *more], np.int64)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def predict(self, i: np.ndarray, w: np.ndarray | None = None) -> float:
        total = float((self.weights(i) if w is None else w).sum())
        return 1 / (1 + np.exp(-max(min(total, 35.0), -35.0)))

    def learn(self, i: np.ndarray, y: float) -> float:
        """Predict, then update; the prediction is what it was before."""
        if self.keep < 1:
            i = i[self.rng.random(len(i)) < self.keep]
        w = self.weights(i)
        p = self.predict(i, w) if self.keep >= 1 else 1 / (1 + np.exp(-max(min(float(w.sum()) / self.keep, 35.0), -35.0)))
        g = p - y
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        np.add.at(self.z, i, g - sigma * w)
        np.add.at(self.n, i, g * g)
        return p

    def average(self, others: list[FTRL]) -> FTRL:
        self.z, self.n = np.mean([o.z for o in others], 0), np.mean([o.n for o in others], 0)
        return self

    def dump(self) -> bytes:
        return pickle.dumps(self)

    @staticmethod
    def load(data: bytes) -> FTRL:
        return pickle.loads(data)


def hashed_rows(df: DataFrame, columns: list[str], y: str | None = None, bits: int = 20) -> DataFrame:
    """(x array of buckets, y): the learner's input."""
    x = F.array(*[hash_feature(c, bits) for c in columns]).alias("x")
    return df.select(*df.columns, x, *([F.col(y).cast("double").alias("_y")] if y else []))


def fit(df: DataFrame, columns: list[str], y: str, model: FTRL | None = None, epochs: int = 1, holdout: int | None = None) -> FTRL:
    """Train a copy of the model on each partition and average the copies, epoch by epoch.

    A partition's update is the change of the coordinates that it touched; changes are added up by coordinate on the
    executors, so the driver gets 2^bits rows at most. With a holdout every such row is scored before the copy goes on
    and not learned; `model.holdout_loss` is the mean log loss of each epoch's.
    """
    model = model or FTRL()
    rows = hashed_rows(df.where(F.col(y).isNotNull()), columns, y, model.bits).select("x", "_y")
    model.holdout_loss = []
    for _ in range(epochs):
        start = model.dump()

        def train(batches, start=start):
            own, seen, touched, loss, held = FTRL.load(start), 0, np.zeros(1 << model.bits, bool), 0.0, 0
            z, n = own.z.copy(), own.n.copy()
            for batch in batches:
                for x, label in zip(batch["x"], batch["_y"]):
                    seen += 1
                    i = own.indices(x)
                    if holdout and seen % holdout == 0:
                        p = min(max(own.predict(i), 1e-14), 1 - 1e-14)
                        loss, held = loss - np.log(p if label == 1 else 1 - p), held + 1
                    else:
                        own.learn(i, label)
                        touched[i] = True
            if seen:
                at = np.flatnonzero(touched)
                # two rows of counts: copies, and the holdout
                yield pd.DataFrame({"i": [-1, -2, *at], "z": [1.0, loss, *(own.z - z)[at]], "n": [0.0, float(held), *(own.n - n)[at]]})

        found = rows.mapInPandas(train, "i long, z double, n double").groupBy("i").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toPandas()
        counts = found[found["i"] < 0].set_index("i")
        if len(counts):
            own = found[found["i"] >= 0]
            k = counts.loc[-1, "z"]
            model.z[own["i"]] += own["z"].to_numpy() / k
            model.n[own["i"]] += own["n"].to_numpy() / k
            if counts.loc[-2, "n"]:
                model.holdout_loss.append(float(counts.loc[-2, "z"] / counts.loc[-2, "n"]))
    return model


def predict(df: DataFrame, columns: list[str], model: FTRL, output: str = "prediction", decimals: int = 5) -> DataFrame:
    """df with probabilities of label 1, rounded; a task loads the model once."""
    data = df.sparkSession.sparkContext.broadcast(model.dump())

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = FTRL.load(data.value)
        for x in batches:
            yield x.map(lambda i: round(own.predict(own.indices(i)), decimals))

    return df.withColumn(output, score(F.array(*[hash_feature(c, model.bits) for c in columns])))


def saved(spark, checkpoint: str, model: FTRL) -> int:
    """Load the latest state beside a checkpoint into the model; the batch that it belongs to, -1 if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(checkpoint.rstrip("/") + "-model")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return -1
    # a batch's state counts once its writer has left the mark of success
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    done = [int(n.removeprefix("batch-")) for n in names if n.startswith("batch-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{n}/_SUCCESS"))]
    if not done:
        return -1
    row = spark.read.parquet(f"{folder.toString()}/batch-{max(done)}").first()
    state = FTRL.load(bytes(row["state"]))
    model.z, model.n = state.z, state.n
    return max(done)


def fit_stream(stream: DataFrame, columns: list[str], y: str, model: FTRL, checkpoint: str):
    """Update the model with every micro-batch of a stream; returns the running query.

    The state after each batch is written beside the checkpoint, and a restart goes on from the latest; a batch that is
    given again after its state was written changes nothing.
    """
    spark = stream.sparkSession
    last = [saved(spark, checkpoint, model)]

    def update(batch: DataFrame, number: int) -> None:
        if number <= last[0]:
            return
        if not batch.isEmpty():
            fit(batch, columns, y, model)
        state = batch.sparkSession.createDataFrame([(bytearray(model.dump()),)], "state binary")
        state.write.mode("overwrite").parquet(f"{checkpoint.rstrip('/')}-model/batch-{number}")
        last[0] = number

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).start()
