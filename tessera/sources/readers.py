"""Readers of text tables, archives, arrays and model files."""

from __future__ import annotations

import io
import pickle
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _separator(path: str) -> str:
    return "\t" if ".tsv" in path else ","


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, header: bool = True, nrows: int | None = None) -> DataFrame:
    """Comma or (.tsv) tab separated text, .gz too; types are inferred unless a schema is given."""
    reader = spark.read.option("header", header).option("sep", _separator(path))
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.limit(nrows) if nrows is not None else df


def read_zip(spark: SparkSession, path: str, schema: StructType | str, header: bool = True, chunk: int = 10_000) -> DataFrame:
    """Zip files of one text table each, unpacked on the executors, a chunk of lines at a time."""
    import pandas as pd

    shape = spark.createDataFrame([], schema).schema
    names = shape.fieldNames()

    def rows(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    members = z.namelist()
                    if len(members) != 1:
                        raise ValueError(f"{name} holds {len(members)} members, not one")
                    with z.open(members[0]) as f:
                        for part in pd.read_csv(f, sep=_separator(members[0]), header=0 if header else None, names=names, chunksize=chunk, dtype=str, keep_default_na=True):
                            yield part

    text = StructType()
    for n in names:
        text = text.add(n, "string")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(rows, text).select(*[F.col(f.name).cast(f.dataType) for f in shape.fields])


def read_excel(spark: SparkSession, path: str, sheet=0, nrows: int | None = None) -> DataFrame:
    """A sheet, read on the driver; needs pandas' Excel support."""
    import pandas as pd

    try:
        return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, nrows=nrows))
    except ImportError as e:
        raise ImportError("reading .xls and .xlsx needs an Excel library for pandas, which is not installed") from e


def read_7z(spark: SparkSession, path: str, **options) -> DataFrame:
    try:
        import libarchive.public as archive
    except ImportError as e:
        raise ImportError("reading .7z needs libarchive, which is not installed") from e
    import pandas as pd

    with archive.file_reader(path) as entries:
        for entry in entries:
            return spark.createDataFrame(pd.read_csv(io.BytesIO(b"".join(entry.get_blocks())), sep=_separator(path)))
    raise ValueError(f"{path} is empty")


def read_df(spark: SparkSession, path: str, nrows: int | None = None, sheet=0, header: bool = True, schema=None) -> DataFrame:
    """The reader that the path's extension names; anything else is parquet."""
    if path.endswith(".zip"):
        if schema is None:
            raise ValueError("a zipped table needs a schema")
        df = read_zip(spark, path, schema, header)
    elif path.endswith(".7z"):
        df = read_7z(spark, path)
    elif path.endswith((".xls", ".xlsx")):
        return read_excel(spark, path, sheet, nrows)
    elif any(x in path for x in (".csv", ".tsv", ".txt")):
        return read_csv(spark, path, schema, header, nrows)
    else:
        df = spark.read.parquet(path)
    return df.limit(nrows) if nrows is not None else df


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _read_saved(spark: SparkSession, path: str) -> DataFrame:
    if not path.endswith((".npy", ".pickle", ".pkl")):
        return spark.read.parquet(path)
    import numpy as np

    # one file of one array or object, which is read whole; unpickle only files that are trusted
    data = io.BytesIO(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))
    return to_frame(spark, np.load(data, allow_pickle=False) if path.endswith(".npy") else pickle.load(data))


def read_or_compute(spark: SparkSession, path: str, fallback: Callable[[], DataFrame] | None = None, fail_if_missing: bool = True) -> DataFrame | None:
    """A written table, array (.npy) or pickle, or what `fallback` computes, written first as parquet.

    A name without an extension is tried as it is, then with .parquet, .npy, .pickle and .pkl.
    """
    for end in ("",) if "." in path.rsplit("/", 1)[-1] else ("", ".parquet", ".npy", ".pickle", ".pkl"):
        if _exists(spark, path + end):
            return _read_saved(spark, path + end)
    if fallback is None:
        if fail_if_missing:
            raise FileNotFoundError(path)
        return None
    fallback().write.parquet(path)
    return spark.read.parquet(path)


def read_arrays(spark: SparkSession, path: str, fallback=None) -> DataFrame:
    return read_or_compute(spark, path, fallback)


def chunks(df: DataFrame, size: int = 1_000_000) -> Iterator[list]:
    """Rows in slices of `size`; partitions come to the driver one at a time."""
    part = []
    for row in df.toLocalIterator(prefetchPartitions=False):
        part.append(row)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def read_predictions(spark: SparkSession, files: dict[str, str] | Callable[[], dict[str, str]], key: str, column: str = "prediction") -> DataFrame:
    """A column per model of predictions that are kept in files, joined on the row key."""
    files = files() if callable(files) else files
    out = None
    for name, path in files.items():
        one = spark.read.parquet(path).select(key, F.col(column).alias(name))
        out = one if out is None else out.join(one, key)
    return out


def to_frame(spark: SparkSession, data, columns=None) -> DataFrame:
    """Lists, numpy arrays, pandas objects and DataFrames as a DataFrame."""
    import numpy as np
    import pandas as pd

    if isinstance(data, DataFrame):
        return data
    if isinstance(data, pd.Series):
        data = data.to_frame(data.name or "0")
    if not isinstance(data, pd.DataFrame):
        data = pd.DataFrame(np.asarray(data))
    data.columns = columns or [str(c) for c in data.columns]
    return spark.createDataFrame(data)
