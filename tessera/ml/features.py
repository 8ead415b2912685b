"""Feature extraction and resampling: PCA, clusters, tree leaves, SMOTE, random layers."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import roles
from tessera.functions.scalar import ACTIVATIONS, grbf
from tessera.ml.nearest import nearest


def pca(df: DataFrame, k: int, columns=None, whiten: bool = False) -> DataFrame:
    """n_pca_0 ...: centred components, the largest loading of each positive."""
    names = columns or roles.numericals(df)
    ready = VectorAssembler(inputCols=names, outputCol="_v").transform(df)
    model = StandardScaler(inputCol="_v", outputCol="_x", withMean=True, withStd=False).fit(ready)
    ready = model.transform(ready)
    parts = PCA(k=k, inputCol="_x", outputCol="_p").fit(ready)
    loads = parts.pc.toArray()
    signs = np.sign(loads[np.abs(loads).argmax(0), range(k)])
    out = parts.transform(ready).withColumn("_p", vector_to_array("_p"))
    scale = [1.0] * k
    if whiten:
        scale = [1 / s if s else 0.0 for s in out.agg(*[F.stddev_samp(F.col("_p")[i]) for i in range(k)]).first()]
    out = out.withColumns({f"n_pca_{i}": F.col("_p")[i] * float(signs[i] * scale[i]) for i in range(k)})
    return out.drop("_v", "_x", "_p")


def explained_variance(df: DataFrame, k: int, columns=None) -> list[float]:
    names = columns or roles.numericals(df)
    ready = VectorAssembler(inputCols=names, outputCol="_v").transform(df)
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(ready).explainedVariance.toArray().tolist()


def kmeans(df: DataFrame, k: int, columns=None, seed: int = 0, output: str = "i_cluster") -> DataFrame:
    from pyspark.ml.clustering import KMeans

    ready = VectorAssembler(inputCols=columns or roles.numericals(df), outputCol="_v").transform(df)
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=output).fit(ready).transform(ready).drop("_v")


def tree_features(df: DataFrame, y: str, key: str, trees: int = 10, k: int = 3, columns=None, seed: int = 0) -> DataFrame:
    """i_leaf_<t>: the leaf that each tree of a forest, grown on the other folds, puts a row in."""
    from pyspark.ml.classification import RandomForestClassifier

    from tessera.ml.folds import self_chunked_op

    names = columns or [c for c in roles.numericals(df) if c != y]
    ready = VectorAssembler(inputCols=names, outputCol="_v").transform(df).withColumn("_y", F.col(y).cast("double"))
    forest = RandomForestClassifier(featuresCol="_v", labelCol="_y", numTrees=trees, seed=seed, leafCol="_leaf")
    out = self_chunked_op(ready, lambda a, b: forest.fit(a).transform(b), key, k, seed).withColumn("_leaf", vector_to_array("_leaf"))
    return out.withColumns({f"i_leaf_{t}": F.col("_leaf")[t].cast("int") for t in range(trees)}).select(*df.columns, *[f"i_leaf_{t}" for t in range(trees)])


def append_fit_transform(df: DataFrame, estimator, prefix: str = "n_new_col_", output: str = "output") -> DataFrame:
    """A fitted transformer's vector as columns n_new_col_0 ..."""
    out = estimator.fit(df).transform(df).withColumn("_a", vector_to_array(output))
    width = out.select(F.size("_a")).first()[0]
    return out.withColumns({f"{prefix}{i}": F.col("_a")[i] for i in range(width)}).drop("_a", output)


def neighbours(left: DataFrame, right: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, neighbour, distance) of the k nearest of `right` for each row of `left`, itself left out; exact."""
    return nearest(left, right, key, vector, k)


def smote(df: DataFrame, y: str, minority, key: str, columns=None, percent: int = 100, k: int = 5, h: float = 1.0, seed: int = 0) -> DataFrame:
    """percent / 100 synthetic rows per minority row: x + U(0, h) (neighbour - x); below 100, one for that share of them."""
    from tessera.operators.sample import subsample

    names = columns or [c for c in roles.numericals(df) if c != y]
    rows = VectorAssembler(inputCols=names, outputCol="_v").transform(df.where(F.col(y) == minority)).select(key, "_v")
    drawn = rows if percent >= 100 else subsample(rows, percent / 100, key, seed)
    near = neighbours(drawn, rows, key, "_v", k).groupBy(key).agg(F.array_sort(F.collect_list("neighbour")).alias("_near"))
    drawn = near.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(max(1, int(percent // 100))))))
    drawn = drawn.withColumn("neighbour", F.element_at("_near", (F.pmod(F.xxhash64(F.lit(seed), key, "_copy"), F.size("_near")) + 1).cast("int")))
    values = rows.select(key, vector_to_array("_v").alias("_a"))
    both = drawn.join(values, key).join(values.select(F.col(key).alias("neighbour"), F.col("_a").alias("_b")), "neighbour")
    gap = F.pmod(F.xxhash64(F.lit(seed + 1), key, "_copy"), F.lit(1 << 30)) / float(1 << 30) * h
    mixed = F.zip_with("_a", "_b", lambda a, b: a + F.col("_gap") * (b - a))
    out = both.withColumn("_gap", gap).withColumn("_x", mixed)
    return out.select(*[F.col("_x")[i].alias(c) for i, c in enumerate(names)], F.lit(minority).alias(y))


def borderline_smote(df: DataFrame, y: str, minority, key: str, columns=None, percent: int = 100, k: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(synthetic, safe, danger): minority rows of which at least half of the neighbours, but not all, are others are in danger."""
    names = columns or [c for c in roles.numericals(df) if c != y]
    rows = VectorAssembler(inputCols=names, outputCol="_v").transform(df)
    few = rows.where(F.col(y) == minority)
    near = neighbours(few, rows, key, "_v", k).join(df.select(F.col(key).alias("neighbour"), (F.col(y) != minority).alias("_other")), "neighbour")
    others = near.groupBy(key).agg(F.count_if("_other").alias("_n"))
    danger = others.where((F.col("_n") >= k / 2) & (F.col("_n") < k)).select(key)
    safe = others.where(F.col("_n") < k / 2).select(key)
    ready = df.join(danger, key)
    return smote(ready, y, minority, key, names, percent, k, 0.5, seed), df.join(safe, key), ready


class RandomLayer:
    """Hidden units alpha (x w + b) + (1 - alpha) width |x - c| / r under an activation; the weights are seeded numbers."""

    def __init__(self, units: int = 20, alpha: float = 0.5, width: float = 1.0, activation="tanh", seed: int = 0, tau: float | None = None):
        self.units, self.alpha, self.width, self.activation, self.seed, self.tau = units, alpha, width, activation, seed, tau

    def fit(self, df: DataFrame, columns: list[str]) -> RandomLayer:
        rng = np.random.default_rng(self.seed)
        row = df.agg(*[f(c).cast("double") for c in columns for f in (F.min, F.max)]).first()
        low, high = np.array(row[0::2]), np.array(row[1::2])
        self.columns = columns
        self.weights, self.bias = rng.standard_normal((len(columns), self.units)), rng.standard_normal(self.units)
        self.centres = rng.uniform(low, high, (self.units, len(columns)))
        gaps = np.linalg.norm(self.centres[:, None] - self.centres[None], axis=2)
        self.radius = np.full(self.units, gaps.max() / np.sqrt(2 * self.units) or 1.0)
        if self.tau is not None:
            near = np.sort(gaps + np.where(np.eye(self.units, dtype=bool), np.inf, 0), axis=1)[:, 0]
            self.radius = np.where((near > 0) & (near < np.inf), near, self.radius)
        return self

    def transform(self, df: DataFrame, output: str = "hidden") -> DataFrame:
        """An array of the units' values; expressions over the columns, no Python on the executors."""
        units = []
        for u in range(self.units):
            a = F.lit(0.0)
            if self.alpha:
                a = a + self.alpha * (sum((F.col(c) * float(w) for c, w in zip(self.columns, self.weights[:, u])), F.lit(0.0)) + float(self.bias[u]))
            if self.alpha != 1:
                d2 = sum(((F.col(c) - float(m)) * (F.col(c) - float(m)) for c, m in zip(self.columns, self.centres[u])), F.lit(0.0))
                a = a + (1 - self.alpha) * self.width * F.sqrt(d2) / float(self.radius[u])
            units.append(self.activation(a) if callable(self.activation) else grbf(a, self.tau or 1.0) if self.activation == "grbf" else ACTIVATIONS[self.activation](a))
        return df.withColumn(output, F.array(*units))


def mlp_layer(**options) -> RandomLayer:
    return RandomLayer(alpha=1.0, **options)


def rbf_layer(**options) -> RandomLayer:
    return RandomLayer(alpha=0.0, **({"activation": "gaussian"} | options))


def grbf_layer(tau: float = 2.0, **options) -> RandomLayer:
    """Generalised radial units: each centre's radius is the distance to the nearest other centre, tau shapes the fall."""
    return RandomLayer(alpha=0.0, tau=tau, **({"activation": "grbf"} | options))


class ELM:
    """A random layer and least squares on it: a regression, or one of +-1 targets per class."""

    def __init__(self, layer: RandomLayer | None = None, classify: bool = False, ridge: float = 1e-6):
        self.layer, self.classify, self.ridge = layer or RandomLayer(), classify, ridge

    def fit(self, df: DataFrame, columns: list[str], y: str) -> ELM:
        from pyspark.ml.regression import LinearRegression

        df = df.where(F.col(y).isNotNull())
        hidden = self.layer.fit(df, columns).transform(df, "_h").withColumn("_v", array_to_vector("_h"))
        self.classes = sorted(r[0] for r in df.select(y).distinct().collect()) if self.classify else [None]
        self.coefficients = []
        for c in self.classes:
            target = F.col(y).cast("double") if c is None else F.when(F.col(y) == F.lit(c), 1.0).otherwise(-1.0)
            fit = LinearRegression(featuresCol="_v", labelCol="_t", fitIntercept=False, solver="normal", regParam=self.ridge).fit(hidden.withColumn("_t", target))
            self.coefficients.append(fit.coefficients.toArray().tolist())
        return self

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        hidden = self.layer.transform(df, "_h")
        scores = [F.aggregate(F.zip_with("_h", F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for w in self.coefficients]
        if not self.classify:
            return hidden.withColumn(output, scores[0]).drop("_h")
        best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(c).alias("c")) for s, c in zip(scores, self.classes)]))
        return hidden.withColumn(output, best["c"]).drop("_h")

    def score(self, df: DataFrame, y: str) -> float:
        return self.transform(df).agg(F.avg((F.col("prediction") == F.col(y)).cast("double"))).first()[0]
