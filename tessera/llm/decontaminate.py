"""Wu-Manber multi-pattern search for passages of a benchmark in documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_prefix, materialize, pieces, plain, text_buffer, words_of

WINDOW = 13
#: Bytes of benchmark text that one matcher holds; a larger benchmark is searched shard by shard.
SHARD_BYTES = 8 << 20
TABLE_BITS = 20
LANE = 512


class WuManber:
    """Finds all occurrences of byte strings: block shifts skip positions, suffix-hash buckets select strings,
    and direct comparison confirms them. Many lanes of the text advance together.

    Strings are split by length, so that a few short ones do not take the long ones' shifts away.
    """

    def __init__(self, patterns: list[bytes], long: int = 24):
        self.classes = []
        for part in ([p for p in patterns if len(p) >= long], [p for p in patterns if len(p) < long]):
            if part:
                self.classes.append(self._prepare(part))

    @staticmethod
    def _prepare(patterns: list[bytes]):
        m = min(map(len, patterns))
        block = min(8, max(1, m // 2))
        shift = np.full(1 << TABLE_BITS, m - block + 1, np.uint16 if m < 60_000 else np.uint32)
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        keys = np.zeros((len(patterns), m - block + 1), np.uint64)
        for k in range(block):
            keys |= heads[:, k : m - block + 1 + k].astype(np.uint64) << np.uint64(8 * k)
        for j in range(m - block + 1):
            np.minimum.at(shift, WuManber._slot(keys[:, j]), m - block - j)
        buckets: dict[int, list[int]] = {}
        for i, key in enumerate(keys[:, -1].tolist()):
            buckets.setdefault(key, []).append(i)
        return patterns, m, block, shift, buckets

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, text: bytes) -> list[tuple[int, bytes]]:
        """(position, pattern) of every occurrence."""
        padded = np.frombuffer(text + bytes(8), np.uint8)
        found = []
        for patterns, m, block, shift, buckets in self.classes:
            if len(text) < m:
                continue
            mask = np.uint64((1 << 8 * block) - 1)
            last = len(text) - m
            at = np.arange(0, last + 1, LANE)
            end = np.minimum(at + LANE, last + 1)
            while len(at):
                key = np.zeros(len(at), np.uint64)
                for k in range(block):
                    key |= padded[at + (m - block + k)].astype(np.uint64) << np.uint64(8 * k)
                step = shift[self._slot(key)].astype(np.int64)
                for i in np.flatnonzero(step == 0).tolist():
                    for p in buckets.get(int(key[i] & mask), ()):
                        if text.startswith(patterns[p], int(at[i])):
                            found.append((int(at[i]), patterns[p]))
                at = at + np.maximum(step, 1)
                open_ = at < end
                at, end = at[open_], end[open_]
        return found


def windows_of(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The windows of an item, each as ' word ... word '; a shorter item is one window, one without words none."""
    words = words_of(text)
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))] if words else []


class Matcher:
    """The windows of a shard of items, and the items that each window belongs to."""

    def __init__(self, items: list[tuple], size: int = WINDOW):
        self.owners: dict[bytes, list] = {}
        for item, text in items:
            for w in windows_of((text or "").encode(), size):
                self.owners.setdefault(w, []).extend([] if item is None else [item])
        self.search = WuManber(list(self.owners))

    def scan(self, texts: list[bytes]):
        """Per text: words, hit words as flags, items found."""
        split = [words_of(x) for x in texts]
        joined = b"".join(b" " + b" ".join(w) + b" \n" if w else b"\n" for w in split)
        n_words = np.array([len(w) for w in split], np.int64)
        first = np.concatenate([[0], np.cumsum(n_words)])
        found = self.search.find(joined)
        edge = np.zeros(first[-1] + 1, np.int64)
        items = [set() for _ in texts]
        if found:
            data = np.frombuffer(joined, np.uint8)
            ends = np.flatnonzero(data == 10)
            gaps = np.flatnonzero(data == 32)
            at = np.array([p for p, _ in found], np.int64)
            doc = np.searchsorted(ends, at)
            word = np.searchsorted(gaps, at) - np.concatenate([[0], np.cumsum(n_words > 0)])[doc]
            size = np.array([p.count(b" ") - 1 for _, p in found], np.int64)
            np.add.at(edge, word, 1)
            np.add.at(edge, word + size, -1)
            for d, (_, p) in zip(doc.tolist(), found):
                items[d].update(self.owners[p])
        return n_words, first, np.cumsum(edge)[:-1] > 0, items


RESULTS = ("n_words", "hits", "items")


def _scan(matcher: Matcher, names: list[str]):
    n_words_name, hits_name, items_name = names

    def run(batches):
        for batch in pieces(batches, "text"):
            data, offsets = text_buffer(batch.column("text"))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            n_words, first, hit, items = matcher.scan(texts)
            flags = [np.packbits(hit[a:b]).tobytes() if hit[a:b].any() else b"" for a, b in zip(first[:-1], first[1:])]
            before_hits, before_items = batch.column(hits_name).to_pylist(), batch.column(items_name).to_pylist()
            for i, (old, more) in enumerate(zip(before_hits, before_items)):
                if old:
                    flags[i] = bytes(np.frombuffer(old, np.uint8) | np.frombuffer(flags[i], np.uint8)) if flags[i] else old
                items[i] = sorted({*map(str, items[i]), *more})
            columns = {c: batch.column(c) for c in batch.schema.names}
            columns |= {n_words_name: pa.array(n_words), hits_name: pa.array(flags, pa.binary()), items_name: pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def find_passages(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, shard_bytes: int = SHARD_BYTES, prefix: str = "_") -> DataFrame:
    """docs with _n_words, _hits (a bit per word, empty if none) and _items (ids as sorted strings) for every row.

    Items are sent to the tasks in shards of about `shard_bytes` (one, if the benchmark is smaller); each further
    shard is a further pass over the documents, so memory is bounded for any benchmark. A null or empty text has no
    words, an item without words no windows; an item without an id hits words, but is not among the items. Items that
    repeat an id are one item. Columns of docs named like the results, which begin with `prefix`, are replaced.
    """
    names = [prefix + x for x in RESULTS]
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    shards = max(1, -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    keep = [c for c in docs.columns if c.lower() not in {x.lower() for x in names}]
    out = docs.select(*plain(keep), F.lit(0).cast("long").alias(names[0]), F.lit(b"").alias(names[1]), F.array().cast("array<string>").alias(names[2]))
    for shard in range(shards):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard).collect()
        matcher = Matcher([(r["item_id"], r["text"]) for r in own], size)
        if shard:
            out = materialize(out, "passages")
        out = out.mapInArrow(_scan(matcher, names), out.schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items of every document."""
    found = find_passages(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), count_bits(F.col("_hits")).alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("_items")), 256).alias("items_sha256"), F.col("_items").alias("items"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def count_bits(column):
    """Set bits of a binary column, by the ones of its hexadecimal digits."""
    digits = F.hex(column)
    ones = F.lit(0).cast("long")
    for n, of in ((1, "1248"), (2, "3569AC"), (3, "7BDE"), (4, "F")):
        ones = ones + n * F.length(F.regexp_replace(digits, f"[^{of}]", "")).cast("long")
    return ones


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """The documents that are not contaminated, with all their own columns.

    Where texts were cut before, `sources` has the texts as they were: a document goes too if a row of its doc_id
    there is contaminated, as a part of the passage may be what was cut. Both are searched whole; a null doc_id has no
    source.
    """
    prefix = free_prefix(docs.columns)
    found = find_passages(docs, benchmark, prefix=prefix)
    n_hit, n_words = count_bits(F.col(prefix + "hits")), F.col(prefix + "n_words")
    kept = found.where(~((n_hit > 0) & (n_hit * 20 >= n_words))).select(*plain(docs.columns))
    if sources is None:
        return kept
    gone = materialize(contamination(sources, benchmark).where("contaminated and doc_id is not null").select("doc_id").distinct(), "contaminated")
    return kept.join(gone, "doc_id", "left_anti").select(*plain(docs.columns))
