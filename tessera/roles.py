"""Column roles: the prefix of a column's name says what the column means, else its data does.

c_ categorical, i_ categorical as index, n_ numerical, b_ binary, d_ date.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations as _combinations
from itertools import permutations as _permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIXES = {"c_": "categorical", "i_": "index", "n_": "numerical", "b_": "binary", "d_": "date"}
_LETTER = {v: k for k, v in PREFIXES.items()}
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType, T.DecimalType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_valid_name(name: str) -> bool:
    return name[:2] in PREFIXES


def infer_roles(df: DataFrame, columns: Iterable[str] | None = None) -> dict[str, str | None]:
    """Role of each column: by prefix, by `role` in the field's metadata, else by one pass over the data.

    By data: dates are dates; two distinct values (a null counts as one) are binary; strings or whole numbers with
    more are categorical, those of an integral type also an index; fractions are numerical; anything else has no role.
    """
    fields = {f.name: f for f in df.schema.fields if columns is None or f.name in set(columns)}
    roles: dict[str, str | None] = {}
    open_ = []
    for name, field in fields.items():
        if is_valid_name(name):
            roles[name] = PREFIXES[name[:2]]
        elif field.metadata.get("role") in _LETTER:
            roles[name] = field.metadata["role"]
        elif isinstance(field.dataType, _DATES):
            roles[name] = "date"
        else:
            roles[name] = None
            open_.append(field)
    if open_:
        aggs = []
        for i, f in enumerate(open_):
            c = F.col(f"`{f.name}`")
            # least and largest say exactly whether there are no, one or two values
            low, high = F.min(c), F.max(c)
            aggs += [F.approx_count_distinct(c, 0.01).alias(f"n{i}"), F.max(c.isNull().cast("int")).alias(f"m{i}"), low.alias(f"l{i}"), high.alias(f"h{i}")]
            whole = F.min((c == F.floor(c)).cast("int")) if isinstance(f.dataType, _FLOATING) else F.lit(1)
            aggs.append(whole.alias(f"w{i}"))
        row = df.agg(*aggs).first()
        # a third value would lie between the least and the largest: counted exactly where the approximate count is small
        few = [(i, f) for i, f in enumerate(open_) if 2 <= row[f"n{i}"] <= 4]
        more = df.agg(*[F.count_if((F.col(f"`{f.name}`") != F.lit(row[f"l{i}"])) & (F.col(f"`{f.name}`") != F.lit(row[f"h{i}"]))).alias(f"b{i}") for i, f in few]).first() if few else None
        for i, f in enumerate(open_):
            low, high = row[f"l{i}"], row[f"h{i}"]
            exact = 0 if low is None else 1 if low == high else 2 if more is not None and f"b{i}" in more and more[f"b{i}"] == 0 else max(3, row[f"n{i}"])
            n = exact + (row[f"m{i}"] or 0)
            if isinstance(f.dataType, T.BooleanType) or n == 2:
                roles[f.name] = "binary"
            elif isinstance(f.dataType, _FLOATING) and row[f"w{i}"] == 0:
                roles[f.name] = "numerical"
            elif isinstance(f.dataType, _INTEGRAL) and n > 2:
                roles[f.name] = "index"
            elif isinstance(f.dataType, (T.StringType, *_FLOATING)) and n > 2:
                roles[f.name] = "categorical"
    return {c: roles[c] for c in fields}


def role_of(df: DataFrame, column: str) -> str | None:
    """Role of a column by its prefix, else by the `role` in its metadata (see `annotate`); the data are not read."""
    return PREFIXES.get(column[:2]) or df.schema[column].metadata.get("role")


def annotate(df: DataFrame) -> DataFrame:
    """df with the inferred role of every column without a prefix in its metadata, so that operators choose it by role."""
    found = infer_roles(df)
    named = {c: r for c, r in found.items() if r and not is_valid_name(c)}
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={**df.schema[c].metadata, "role": named[c]}) if c in named else F.col(f"`{c}`") for c in df.columns])


def _prefixed(df: DataFrame, *roles: str) -> list[str]:
    return [c for c in df.columns if role_of(df, c) in roles]


def categoricals(df: DataFrame) -> list[str]:
    return _prefixed(df, "categorical")


def indexes(df: DataFrame) -> list[str]:
    return _prefixed(df, "index")


def binaries(df: DataFrame) -> list[str]:
    return _prefixed(df, "binary")


def numericals(df: DataFrame) -> list[str]:
    return _prefixed(df, "numerical")


def dates(df: DataFrame) -> list[str]:
    return _prefixed(df, "date")


def categorical_like(df: DataFrame) -> list[str]:
    """Categoricals, then indexes, then binaries."""
    return categoricals(df) + indexes(df) + binaries(df)


def _is(*roles: str):
    return lambda df, column: infer_roles(df, [column])[column] in roles


is_categorical = _is("categorical", "index")
is_index = _is("index")
is_binary = _is("binary")
is_categorical_like = _is("categorical", "index", "binary")
is_numerical = _is("numerical")
is_date = _is("date")


def unique_names(names: list[str]) -> list[str]:
    """c, c_1, c_2 ... for repeats of c."""
    taken, out = set(), []
    for name in names:
        new, k = name, 0
        while new in taken:
            k += 1
            new = f"{name}_{k}"
        taken.add(new)
        out.append(new)
    return out


def ensure_unique_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def infer_col_name(df: DataFrame, column: str) -> str:
    role = infer_roles(df, [column])[column]
    role = "categorical" if role == "index" else role
    return column if is_valid_name(column) or role is None else _LETTER[role] + column


def infer_col_names(df: DataFrame) -> DataFrame:
    """Every column prefixed by its role, names made unique."""
    df = ensure_unique_names(df)
    roles = infer_roles(df)
    names = [c if is_valid_name(c) or roles[c] is None else _LETTER["categorical" if roles[c] == "index" else roles[c]] + c for c in df.columns]
    return df.toDF(*unique_names(names))


def column_combinations(df: DataFrame, k: int = 2, columns: list[str] | None = None, categorical=False, index=False, numerical=False, date=False, binary=False, permute: bool = False) -> list[tuple[str, ...]]:
    """k-combinations (or permutations) of explicit columns, then those of the chosen roles."""
    names = list(columns or [])
    for wanted, found in ((categorical, categoricals), (index, indexes), (numerical, numericals), (date, dates), (binary, binaries)):
        if wanted:
            names += [c for c in found(df) if c not in names]
    return list((_permutations if permute else _combinations)(names, k))


def from_template(df: DataFrame, template: DataFrame) -> DataFrame:
    """df with the column order and types of a template that has the same names."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in template.schema.fields])
