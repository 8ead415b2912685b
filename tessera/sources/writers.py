"""Writers that do not overwrite unless told to."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators.sets import hashcode


def _mode(force: bool) -> str:
    return "overwrite" if force else "errorifexists"


def save_csv(df: DataFrame, path: str, header: bool = True, force: bool = False) -> None:
    """Comma separated text, compressed if the path ends in .gz."""
    df.write.mode(_mode(force)).option("header", header).option("compression", "gzip" if path.endswith(".gz") else "none").csv(path)


def dump(df: DataFrame, path: str, force: bool = False) -> None:
    df.write.mode(_mode(force)).parquet(path)


save_array = dump


def save_lines(lines: DataFrame, path: str, order_by: str | None = None, force: bool = False) -> None:
    """The `line` column as text, in the order of a key."""
    (lines.orderBy(order_by) if order_by else lines).select("line").write.mode(_mode(force)).option("compression", "gzip" if path.endswith(".gz") else "none").text(path)


def save_reusable(df: DataFrame, folder: str, name: str) -> str:
    """Write under a name that holds the content's fingerprint; what is there is used again."""
    from pyspark.errors import AnalysisException

    path = f"{folder.rstrip('/')}/{name}_{hashcode(df)}"
    try:
        dump(df, path)
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    return path
