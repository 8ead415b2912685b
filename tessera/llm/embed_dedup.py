"""Near-duplicate embeddings by E8 lattice hashing, neighbouring cells and exact cosines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, mix
from tessera.llm.components import connected_components

THRESHOLD = 0.98
TABLES = 5
PROBES = 8
#: Distance of two unit vectors at the threshold, times this, is their typical distance in a table, in lattice units.
REACH = 0.5
#: Members of a cell that one task compares at once; larger cells are dealt out as pairs of chunks.
CHUNK = 1024
#: Rows of small cells that one task compares at once.
GROUP_ROWS = 20_000


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Twice the nearest E8 point of each row: of D8 and of D8 + (1/2)^8, the nearer."""

    def decode_d8(y):
        near = np.rint(y)
        odd = (near.sum(1).astype(np.int64) & 1).astype(bool)
        gap = y - near
        worst = np.abs(gap).argmax(1)
        rows = np.flatnonzero(odd)
        step = np.where(gap[rows, worst[rows]] >= 0, 1, -1)
        near[rows, worst[rows]] += step
        return near

    a, b = decode_d8(x), decode_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.rint(2 * np.where(nearer[:, None], a, b)).astype(np.int64)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: the directions of the neighbouring cells."""
    from itertools import combinations, product

    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = s, t
            out.append(v)
    out += [v for v in product((1, -1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(out)


def cells(unit: np.ndarray, threshold: float, tables: int = TABLES, probes: int = PROBES, seed: int = 11) -> np.ndarray:
    """Cell ids (vector, table, 1 + probes): the own cell, then the neighbours whose points are nearest."""
    n, dim = unit.shape
    rng = np.random.default_rng(seed + dim)
    around = minimal_vectors()
    scale = REACH / np.sqrt(2 - 2 * threshold) * np.sqrt(dim / 8)
    out = np.zeros((n, tables, 1 + probes), np.int64)
    powers = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
    for t in range(tables):
        basis = rng.standard_normal((dim, 8))
        basis = np.linalg.qr(basis)[0] if dim >= 8 else basis / np.sqrt(8)
        # rounded, so that a vector has the same cells in whatever block it is multiplied
        x = np.round(unit @ basis * scale + rng.uniform(0, 1, 8), 9)
        own = decode_e8(x)
        # |x - p|^2 - |x - p - v|^2 for the neighbours p + v, all |v| alike
        gain = (2 * x - own) @ around.T
        best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes] if probes else np.zeros((n, 0), np.int64)
        points = np.concatenate([own[:, None, :], own[:, None, :] + around[best]], 1)
        with np.errstate(over="ignore"):
            key = (points.astype(np.uint64) * powers).sum(2, dtype=np.uint64) + np.uint64(t + 1) * np.uint64(0x9E3779B97F4A7C15)
            out[:, t] = mix(key).astype(np.int64)
    return out


def _hash(threshold: float, tables: int, probes: int):
    """One row per vector and cell: label, cell, own or probed, vec_id, the vector, and its cells of all tables."""
    names = ["vec_id", "label", "cell", "own"]

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label")
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                for at in range(0, len(rows), 512):
                    part = rows[at : at + 512]
                    x = np.array(lists.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
                    x /= np.sqrt((x * x).sum(1, keepdims=True))
                    found = cells(x, threshold, tables, probes)
                    k = tables * (1 + probes)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(ids[part], k)), labels.take(pa.array(np.repeat(part, k))), pa.array(found.ravel()),
                        pa.array(np.tile(np.arange(1 + probes) == 0, len(part) * tables)),
                    ], names=names)

    return run


def _pairs(x, key, own, chunk, across, threshold: float):
    """Pairs of rows (a, b) with one key, one of them at home, whose cosine reaches the threshold; rows sorted by key.

    Small cells advance together, lag by lag; large ones are multiplied in blocks. Where `across` holds, only rows of
    different chunks are paired.
    """
    n = len(key)
    first = np.ones(n, bool)
    first[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, n))
    out_a, out_b = [], []

    def keep(a, b):
        use = (own[a] | own[b]) & (~across[a] | (chunk[a] != chunk[b]))
        a, b = a[use], b[use]
        for at in range(0, len(a), 8192):
            p, q = a[at : at + 8192], b[at : at + 8192]
            near = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
            out_a.append(p[near])
            out_b.append(q[near])

    left = np.repeat(np.where(sizes <= 64, sizes, 0), sizes) - (np.arange(n) - np.repeat(starts, sizes))
    at = np.flatnonzero(left > 1)
    lag = 1
    while len(at):
        keep(at, at + lag)
        lag += 1
        at = at[left[at] > lag]
    for s, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        for at in range(s, s + size, 256):
            rows = np.arange(at, min(at + 256, s + size))
            p, q = np.nonzero(x[rows] @ x[s : s + size].T >= threshold - 1e-9)
            p, q = rows[p], q + s
            keep(p[p < q], q[p < q])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _links(threshold: float, tables: int, probes: int):
    """Of the links of some cells: how many each vector has, and a forest that connects what they connect.

    A link is counted in the first cell in which its vectors meet.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        lists = table.column("v").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        names = ("key", "cell", "own", "chunk", "across", "vec_id", "copies")
        plain = {c: table.column(c).to_numpy() for c in names}
        out = []
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            rows = rows[np.argsort(plain["key"][rows], kind="stable")]
            key, cell, own, chunk, across, ids, copies = (plain[c][rows] for c in names)
            x = np.array(lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            a, b = _pairs(x, key, own, chunk, across, threshold)
            if not len(a):
                continue
            some, at = np.unique(ids[np.concatenate([a, b])], return_index=True)
            at = np.concatenate([a, b])[at]
            p, q = np.searchsorted(some, ids[a]), np.searchsorted(some, ids[b])
            found = cells(x[at], threshold, tables, probes)
            first = np.concatenate([_first_meeting(found[p[k : k + 4096]], found[q[k : k + 4096]]) for k in range(0, len(p), 4096)]) == cell[a]
            p, q = p[first], q[first]
            n = np.zeros(len(some), np.int64)
            np.add.at(n, p, copies[at][q])
            np.add.at(n, q, copies[at][p])
            root = np.arange(len(some))
            while True:
                best = root.copy()
                np.minimum.at(best, p, root[q])
                np.minimum.at(best, q, root[p])
                np.minimum.at(best, root, best)
                best = best[best]
                if (best == root).all():
                    break
                root = best
            out.append(pa.table({"a": some[n > 0], "b": some[root][n > 0], "n": n[n > 0]}, schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _first_meeting(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The first cell in which two vectors meet, one of them being at home there: by table, then the smaller cell."""
    none = np.iinfo(np.int64).max
    home_f = np.where((f[:, :, :1] == g).any(2), f[:, :, 0], none)
    home_g = np.where((g[:, :, :1] == f).any(2), g[:, :, 0], none)
    meet = np.minimum(home_f, home_g)
    at = (meet != none).argmax(1)
    return meet[np.arange(len(meet)), at]


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; vec_id, embedding and label are read.

    Vectors are divided by their largest component; those then alike in label and every component are one vector with a
    number of copies. Random projections to eight
    dimensions are decoded to E8 points in `tables` tables; a vector is put into its own cell and the `probes` nearest
    neighbouring cells, and two vectors are compared where they meet and one is at home. A pair is counted in the
    first cell of all in which it meets, so no pairs are shuffled: a cell gives its vectors' counts and a forest. A
    cell of more than CHUNK vectors is dealt out as pairs of chunks. Vectors that are null, empty, zero or hold null or
    non-finite components, and those without a label or vec_id, link with nothing; a repeated vec_id with the same
    vector and label counts as two vectors. Vectors of different lengths do not link.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), v.alias("v"))
    # divided by the largest component, so that no square is too large or too small; NaN is larger than infinity
    largest = F.when(~F.exists("v", lambda x: x.isNull()), F.array_max(F.transform("v", F.abs)))
    rows = rows.withColumn("_s", F.coalesce(largest, F.lit(0.0)))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.col("_s") > 0) & (F.col("_s") < float("inf"))
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("v", F.when(F.col("ok"), F.transform("v", lambda x: x / F.col("_s"))))
    rows = materialize(rows.drop("_s"), "vectors")
    good = rows.where("ok")
    classes = good.groupBy("label", "v").agg(F.min("vec_id").alias("_id"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumnRenamed("_id", "vec_id"), "vector-classes")
    placed = classes.select("vec_id", "label", "v").mapInArrow(_hash(threshold, tables, probes), "vec_id long, label string, cell long, own boolean")
    placed = materialize(placed, "cells")
    crowd = placed.groupBy("label", "cell").agg(F.count("*").alias("_c"), F.max("own").alias("_o")).where("_c > 1 and _o")
    chunks = F.ceil(F.col("_c") / CHUNK).cast("int")
    met = placed.join(crowd.select("label", "cell", chunks.alias("_k")), ["label", "cell"])
    met = met.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("_k")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    met = met.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    met = met.withColumn("key", F.xxhash64("label", "cell", "i", "j")).withColumn("across", F.expr("i <> j"))
    groups = max(1, -(-placed.count() // GROUP_ROWS))
    met = met.withColumn("group", F.when(F.col("_k") > 1, F.col("key")).otherwise(F.pmod("key", F.lit(groups))))
    met = met.select("group", "key", "cell", "own", "chunk", "across", "vec_id").join(classes.select("vec_id", "v", "copies"), "vec_id")
    found = met.groupBy("group").applyInArrow(_links(threshold, tables, probes), "a long, b long, n long")
    found = materialize(found, "vector-links")
    parts = connected_components(found.where("a <> b")).withColumnRenamed("node", "_id")
    counts = found.groupBy(F.col("a").alias("_id")).agg(F.sum("n").alias("_n"))
    per_class = classes.select(F.col("vec_id").alias("_id"), "label", "v", "copies").join(counts, "_id", "left").join(parts, "_id", "left")
    per_class = per_class.select("label", "v", (F.coalesce("_n", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("component", "_id").alias("_part"))
    out = rows.where("ok").join(per_class, ["label", "v"]).select("vec_id", "_links", "_part")
    out = out.unionByName(rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("_links"), F.col("vec_id").alias("_part")))
    return out.select(
        "vec_id", F.col("_links").cast("long").alias("n_links"), F.col("_part").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("_part"), F.lit(True)).alias("kept")
    )
