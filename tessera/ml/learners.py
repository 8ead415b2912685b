"""Stand-ins for external learners: the same kinds of model, fitted by Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import FMClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import FeatureHasher, SQLTransformer
from pyspark.ml.regression import FMRegressor, LinearRegression


def hashed(columns: list[str], bits: int = 18, output: str = "features") -> FeatureHasher:
    return FeatureHasher(inputCols=columns, outputCol=output, numFeatures=1 << bits)


def online_linear(columns: list[str], y: str, classify: bool = True, bits: int = 18, passes: int = 20, l1: float = 0.0, l2: float = 0.0) -> Pipeline:
    """A hashed linear model with L1 and L2 penalties."""
    reg = l1 + l2
    kind = LogisticRegression if classify else LinearRegression
    return Pipeline(stages=[hashed(columns, bits), kind(labelCol=y, maxIter=passes, regParam=reg, elasticNetParam=l1 / reg if reg else 0.0)])


def factorisation_machine(columns: list[str], y: str, classify: bool = True, factors: int = 8, bits: int = 14, passes: int = 50, rate: float = 0.01, seed: int = 0) -> Pipeline:
    """A hashed factorisation machine; field-aware ones are fitted as plain ones.

    Numbers that are zero are left out of the features, as the fit takes no stored zeros.
    """
    kind = FMClassifier if classify else FMRegressor
    some = ", ".join(f"CASE WHEN typeof(`{c}`) <> 'string' AND CAST(`{c}` AS STRING) IN ('0', '0.0', '-0.0') THEN NULL ELSE `{c}` END AS `_some_{c}`" for c in columns)
    steps = [SQLTransformer(statement=f"SELECT *, {some} FROM __THIS__"), hashed([f"_some_{c}" for c in columns], bits)]
    return Pipeline(stages=[*steps, kind(labelCol=y, factorSize=factors, maxIter=passes, stepSize=rate, seed=seed)])


def linear_svm(columns: list[str], y: str, bits: int = 18, l2: float = 0.01) -> Pipeline:
    return Pipeline(stages=[hashed(columns, bits), LinearSVC(labelCol=y, regParam=l2)])


def pipe_lines(lines, command: str, key: str | None = None):
    """The `line` column piped through an external program on the executors; the float before '#' of what it prints.

    The program prints a line for each that it reads, in their order, which is how predictions get back to `key`. It is
    run once for each batch of an executor's rows; a failure, or another number of lines, fails the task.
    """
    import subprocess

    import pandas as pd

    names = ["line"] if key is None else [key, "line"]
    rows = lines.select(*names)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            said = subprocess.run(command, shell=True, input="\n".join(batch["line"]) + "\n", capture_output=True, text=True, check=True).stdout.splitlines()
            if len(said) != len(batch):
                raise ValueError(f"{len(batch)} lines went in, {len(said)} came out")
            found = pd.Series([float(x.split("#")[0].strip()) for x in said], index=batch.index)
            yield batch.drop(columns="line").assign(prediction=found)

    schema = rows.drop("line").schema.add("prediction", "double")
    return rows.mapInPandas(run, schema)
