"""Exact nearest neighbours: distinct vectors in blocks of a k-d tree, and only the blocks that a row's radius meets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: Numbers in a block, vectors that meet a block in one task, and rows of the sample by block.
BLOCK_VALUES = 1 << 13
PART_ROWS = 1 << 15
SAMPLE_ROWS = 64
SAMPLE_VALUES = 1 << 21
#: Distances held at once.
PAIRS = 1 << 22
#: What rounding may add to a radius.
SLACK = 1 + 1e-9


class Blocks:
    """A k-d tree learned from a sample; its leaves are the blocks, numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.n = 0
        self.root = self._split(sample, leaves)

    def _split(self, x: np.ndarray, leaves: int):
        spans = np.ptp(x, axis=0) if len(x) else np.zeros(1)
        if leaves <= 1 or not spans.max() > 0:
            self.n += 1
            return self.n - 1
        dim = int(spans.argmax())
        own = x[:, dim]
        cut = float(own[(own <= np.quantile(own, 0.5, method="lower")) & (own < own.max())].max(initial=own.min()))
        left = own <= cut
        share = min(max(1, round(leaves * left.mean())), leaves - 1)
        return dim, cut, self._split(x[left], share), self._split(x[~left], leaves - share)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The block of each vector."""
        out, todo = np.zeros(len(x), np.int32), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                left = x[rows, node[0]] <= node[1]
                todo += [(node[2], rows[left]), (node[3], rows[~left])]
        return out

    def bound(self, low: np.ndarray, high: np.ndarray) -> Blocks:
        """Take the blocks' bounding boxes, by number."""

        def box(node):
            if isinstance(node, int):
                return low[node], high[node], node
            a, b = box(node[2]), box(node[3])
            return np.minimum(a[0], b[0]), np.maximum(a[1], b[1]), a, b

        self.boxes = box(self.root)
        return self

    def met(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) wherever a block's box is within the row's radius."""
        found, todo = [(np.zeros(0, np.int64), np.zeros(0, np.int32))], [(self.boxes, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            gap = np.maximum(np.maximum(node[0] - x[rows], x[rows] - node[1]), 0)
            rows = rows[np.sqrt((gap * gap).sum(1)) <= radius[rows] * SLACK]
            if len(node) == 3:
                found.append((rows, np.full(len(rows), node[2], np.int32)))
            elif len(rows):
                todo += [(node[2], rows), (node[3], rows)]
        return tuple(np.concatenate(x) for x in zip(*found))


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def closest(x: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, point, distance) of the k nearest points of each row by brute force; of equal distances the first points."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, PAIRS // max(1, len(points)))
    for at in range(0, len(x) if len(points) else 0, step):
        some = x[at : at + step]
        d = np.zeros((len(some), len(points)))
        for a, b in zip(some.T, points.T):
            d += (a[:, None] - b[None]) ** 2
        last = np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(points) else np.full(len(some), np.inf)
        row, point = np.nonzero(d <= last[:, None])
        far = d[row, point]
        order = np.lexsort((point, far, row))
        row, point, far = row[order], point[order], far[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((row[first] + at, point[first], np.sqrt(far[first])))
    return tuple(np.concatenate(x) for x in zip(*found))


def _meet(rows: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(v, block, distance, keys) of the k nearest points of each row of (v, block) in its block."""
    parts = rows.groupBy("block").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_parts"))
    rows = rows.join(F.broadcast(parts), "block").select("v", "block", F.pmod(F.xxhash64("v"), "_parts").cast("int").alias("part"))
    points = points.join(F.broadcast(parts), "block").select("v", "keys", "block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"))
    schema = StructType([rows.schema["v"], rows.schema["block"], StructField("distance", DoubleType()), points.schema["keys"]])

    def run(own: pa.Table, others: pa.Table) -> pa.Table:
        # the first of equal distances are those with the smallest key
        others = others.take(pa.array(sorted(range(len(others)), key=others.column("keys").to_pylist().__getitem__), pa.int64()))
        row, point, far = closest(_matrix(own.column("v")), _matrix(others.column("v")), k)
        row, point = pa.array(row), pa.array(point)
        return pa.table({"v": own.column("v").take(row), "block": own.column("block").take(row), "distance": pa.array(far), "keys": others.column("keys").take(point)})

    return rows.groupBy("block", "part").cogroup(points.groupBy("block", "part")).applyInArrow(run, schema)


def nearest(left: DataFrame, right: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, neighbour, distance) of the k nearest of `right` for each row of `left`, itself left out; exact.

    Of equal distances the smallest keys. Equal vectors are searched once; a row meets its own block, then the blocks
    whose boxes lie within the distance of the k + 1 nearest there. What a task holds is a block and PART_ROWS vectors.
    """
    a = left.select(F.col(key).alias("_k"), vector_to_array(vector).alias("v"))
    b = right.select(F.col(key).alias("_k"), vector_to_array(vector).alias("v"))
    # one more than k, as a row may find itself
    first = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    points = b.groupBy("v", F.pmod(F.xxhash64("_k"), F.lit(64)).alias("_s")).agg(first(F.collect_list("_k")).alias("keys"))
    points = points.groupBy("v").agg(first(F.flatten(F.collect_list("keys"))).alias("keys")).persist()
    n, width = points.agg(F.count("*"), F.max(F.size("v"))).first()
    leaves = -(-n * (width or 1) // BLOCK_VALUES)
    wanted = min(leaves * SAMPLE_ROWS, max(1, SAMPLE_VALUES // (width or 1))) if leaves > 1 else 0
    sample = points.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(wanted / max(1, n) * (1 << 30))).select("v").collect() if wanted else []
    tree = Blocks(np.array(sorted(r["v"] for r in sample)).reshape(len(sample), width or 1), leaves)

    def placed(batches):
        for batch in batches:
            yield batch.append_column("block", pa.array(tree.place(_matrix(batch.column("v"))), pa.int32()))

    points = points.mapInArrow(placed, StructType([*points.schema, StructField("block", IntegerType())])).persist()
    rows = a.select("v").distinct()
    rows = rows.mapInArrow(placed, StructType([*rows.schema, StructField("block", IntegerType())])).persist()
    found = _meet(rows, points, k + 1).persist()
    if tree.n > 1:
        boxes = points.groupBy("block").agg(*[f(F.col("v")[i]) for f in (F.min, F.max) for i in range(width)]).collect()
        low, high = np.full((tree.n, width), np.inf), np.full((tree.n, width), -np.inf)
        for r in boxes:
            low[r[0]], high[r[0]] = r[1 : width + 1], r[width + 1 :]
        tree.bound(low, high)

        def others(batches):
            for batch in batches:
                x, own = _matrix(batch.column("v")), batch.column("block").to_numpy(zero_copy_only=False)
                row, block = tree.met(x, batch.column("radius").to_numpy(zero_copy_only=False))
                row, block = row[block != own[row]], block[block != own[row]]
                yield pa.RecordBatch.from_arrays([batch.column("v").take(pa.array(row)), pa.array(block, pa.int32())], names=["v", "block"])

        reach = found.groupBy("v", "block").agg(F.when(F.count("*") > k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("radius"))
        more = reach.mapInArrow(others, rows.schema).persist()
        found = found.unionByName(_meet(more, points, k + 1))
    near = found.select("v", "distance", F.explode("keys").alias("neighbour")).groupBy("v")
    near = near.agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k + 1).alias("_near"))
    out = a.join(near, "v").select("_k", F.explode(F.slice(F.filter("_near", lambda x: x["neighbour"] != F.col("_k")), 1, k)).alias("x"))
    return out.select(F.col("_k").alias(key), "x.neighbour", "x.distance")
