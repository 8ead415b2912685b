"""A small language of derived columns: 'mult(lg(n_1), pow(n_2, 3)); rolling_sum(n_1, 3)'.

An expression is parsed with Python's own grammar, checked against a list of functions and turned into named nodes.
Every node becomes a column whose name is n_ or c_ and its text without spaces, nested ones too. Nodes whose inputs are
there are added together, so a plan has as many projections as the expression is deep.
"""

from __future__ import annotations

import ast
from itertools import combinations, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import roles
from tessera.functions.scalar import box_cox, box_cox_lambda, safe_ln, safe_sqrt
from tessera.operators.order import ROLLING, rolling

PAIRS, ORDERED = ("concat", "mult", "add", "avg"), ("div", "subtract")
WITH_NUMBER = ("pow", "round")
PLAIN = ("lg", "safe_lg", "boxcox", "safe_boxcox", "sqrt")


class Node:
    """A call: function, inputs (column names or nodes) and constants."""

    def __init__(self, func: str, args: list):
        self.func, self.args = func, args
        self.name = ("c_" if func == "concat" else "n_") + self.text()

    def text(self) -> str:
        return f"{self.func}({','.join(a.text() if isinstance(a, Node) else str(a) for a in self.args)})"


def parse(text: str) -> Node:
    def build(tree):
        if isinstance(tree, ast.Call) and isinstance(tree.func, ast.Name) and not tree.keywords:
            return Node(tree.func.id, [build(a) for a in tree.args])
        if isinstance(tree, ast.Name):
            return tree.id
        if isinstance(tree, ast.Constant) and isinstance(tree.value, (int, float, str)):
            return tree.value
        if isinstance(tree, ast.UnaryOp) and isinstance(tree.op, ast.USub) and isinstance(tree.operand, ast.Constant):
            return -tree.operand.value
        raise ValueError(f"not an expression of this language: {ast.unparse(tree)}")

    out = build(ast.parse(text.strip(), mode="eval").body)
    if not isinstance(out, Node):
        raise ValueError(f"not a call: {text}")
    return out


def _expand(node: Node, df: DataFrame, columns) -> list[Node]:
    """The short forms: all pairs, or every numerical column."""
    f, n = node.func, len(node.args)
    numbers = columns or roles.numericals(df)
    if n == 0 and f in PAIRS:
        names = columns or (roles.categoricals(df) + roles.indexes(df) if f == "concat" else numbers)
        return [Node(f, list(p)) for p in combinations(names, 2)]
    if n == 0 and f in ORDERED:
        return [Node(f, list(p)) for p in permutations(numbers, 2)]
    if n == 0 and f in PLAIN:
        return [Node(f, [c]) for c in numbers]
    if n == 1 and (f in WITH_NUMBER or f.startswith("rolling_")) and isinstance(node.args[0], (int, float)):
        return [Node(f, [c, node.args[0]]) for c in numbers]
    return [node]


def _check(node: Node) -> None:
    f, n = node.func, len(node.args)
    sizes = {"concat": (2, 3), "mult": (2, 3), "add": (2, 3), "avg": (2, 3), "div": (2,), "subtract": (2,), "pow": (2,), "round": (2,)}
    if f.startswith("rolling_"):
        if f[8:] not in ROLLING or n != 2:
            raise ValueError(f"unsupported: {node.text()}")
    elif f in PLAIN:
        if n != 1:
            raise ValueError(f"{f} takes one column")
    elif f not in sizes or n not in sizes[f]:
        raise ValueError(f"unsupported function or number of arguments: {node.text()}")


def _column(node: Node, low: dict):
    x = [F.col(f"`{a.name if isinstance(a, Node) else a}`") if isinstance(a, (Node, str)) else F.lit(a) for a in node.args]
    f = node.func
    if f == "concat":
        return F.concat(*[a.cast("string") for a in x])
    if f in ("mult", "add", "avg"):
        out = x[0]
        for a in x[1:]:
            out = out * a if f == "mult" else out + a
        return out / len(x) if f == "avg" else out
    if f == "div":
        return F.try_divide(x[0].cast("double"), x[1].cast("double"))
    if f == "subtract":
        return x[0] - x[1]
    if f == "pow":
        return F.pow(x[0], x[1])
    if f == "round":
        return F.bround(x[0], int(node.args[1]))
    if f == "lg":
        return safe_ln(x[0].cast("double"))
    if f == "sqrt":
        return safe_sqrt(x[0].cast("double"))
    if f == "safe_lg":
        return F.ln(x[0].cast("double") + F.lit(1.0 - low[node.name]))
    raise ValueError(f)


def engineer(df: DataFrame, expressions, columns=None, order_by: str | None = None) -> DataFrame:
    """Add the expressions' columns, and those of what they nest; columns that are there already are left alone.

    `order_by` is the unique key whose order rolling windows follow.
    """
    texts = expressions.split(";") if isinstance(expressions, str) else list(expressions)
    todo: dict[str, Node] = {}

    def add(node: Node):
        _check(node)
        for a in node.args:
            if isinstance(a, Node):
                add(a)
        if node.name not in df.columns:
            todo.setdefault(node.name, node)

    for text in texts:
        for node in _expand(parse(text), df, columns):
            add(node)
    while todo:
        ready = {k: n for k, n in todo.items() if all(not isinstance(a, Node) or a.name in df.columns for a in n.args)}
        windows = [n for n in ready.values() if n.func.startswith("rolling_")]
        source = lambda n: n.args[0].name if isinstance(n.args[0], Node) else n.args[0]
        if windows:
            if order_by is None:
                raise ValueError("rolling windows need order_by")
            df = rolling(df, [(n.func[8:], source(n), int(n.args[1]), n.name) for n in windows], order_by)
        shifted = [n for n in ready.values() if n.func in ("safe_lg", "safe_boxcox")]
        low = {}
        if shifted:
            row = df.agg(*[F.min(F.col(f"`{source(n)}`").cast("double")) for n in shifted]).first()
            low = {n.name: v for n, v in zip(shifted, row)}
        power = [n for n in ready.values() if n.func in ("boxcox", "safe_boxcox")]
        for n in power:
            x = F.col(f"`{source(n)}`").cast("double")
            df = df.withColumn("_x", x + F.lit(1.0 - low[n.name]) if n.func == "safe_boxcox" else x)
            df = df.withColumn(n.name, F.when(F.col("_x") > 0, box_cox(F.col("_x"), box_cox_lambda(df, "_x")))).drop("_x")
        rest = {k: _column(n, low) for k, n in ready.items() if n not in windows and n not in power}
        df = df.withColumns(rest) if rest else df
        todo = {k: n for k, n in todo.items() if k not in ready}
    return df


eng = engineer
