"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax, numpy SGD."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_prefix, materialize, mix, pieces, plain, text_buffer

BITS = 18
DIM = 8
EPOCHS = 5
#: Steps that a small sample is gone through again for.
LEAST_STEPS = 20_000
RATE = 0.6
NGRAMS = (3, 4, 5)
#: Documents, and bytes of text, that a model learns from at most; chosen by a hash of their id.
SAMPLE_ROWS = 5_000
SAMPLE_BYTES = 48 << 20
THRESHOLD = 0.7


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each feature, offsets by document) for words, word pairs and the n-grams of each length.

    Words are runs of bytes above 0x20. An n-gram lies in a word with one space put at either end.
    """
    n_docs, n = len(offsets) - 1, len(data)
    if n == 0:
        return []
    shift = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        # a space before, after and between documents
        row = np.repeat(np.arange(n_docs), np.diff(offsets))
        text = np.full(n + n_docs + 1, 32, np.uint8)
        text[np.arange(n) + row + 1] = np.maximum(data, 32)
        bounds = offsets + np.arange(n_docs + 1)
        inside = text > 32
        gaps = np.concatenate([[0], np.cumsum(~inside, dtype=np.int32)])
        wide = text.astype(np.uint64)
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        out = []
        if len(starts):
            at = np.arange(len(text), dtype=np.int32)
            since = at - np.maximum.accumulate(np.where(inside, 0, at))
            powers = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
            word = np.add.reduceat(np.where(inside, (wide + np.uint64(1)) * powers[since & 63], np.uint64(0)), starts)
            word = mix(word)
            by_doc = np.searchsorted(starts, bounds)
            out.append(((word >> shift).astype(np.int32), by_doc))
            # a word that comes twice running is a feature whatever the word is
            pair = mix(np.where(word[:-1] == word[1:], np.uint64(7), word[:-1] * np.uint64(3) + word[1:]))
            # the last word of a document and the first of the next are no pair
            own = np.ones(len(pair), bool)
            edge = by_doc[(by_doc > 0) & (by_doc <= len(pair))]
            own[edge - 1] = False
            pair_docs = np.concatenate([[0], np.cumsum(own)])[np.minimum(by_doc, len(pair))]
            out.append(((pair[own] >> shift).astype(np.int32), pair_docs))
        rolling = wide + np.uint64(1)
        for k in range(2, max(NGRAMS) + 1):
            if len(text) < k:
                break
            rolling = rolling[:-1] * np.uint64(0x100000001B3) + wide[k - 1 :] + np.uint64(1)
            if k in NGRAMS:
                whole = np.flatnonzero(gaps[k - 1 : len(text)][: len(rolling)] == gaps[1 : len(rolling) + 1])
                key = (rolling[whole] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
                key *= np.uint64(0xBF58476D1CE4E5B9)
                out.append(((key >> shift).astype(np.int32), np.searchsorted(whole, bounds)))
    return out


def bags(texts: list[bytes], bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, their shares) of each text."""
    out = []
    for text in texts:
        found = features(np.frombuffer(text, np.uint8), np.array([0, len(text)]), bits)
        ids, n = np.unique(np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int32), return_counts=True)
        out.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    return out


def train(bags: list, labels: np.ndarray, bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 5):
    """Bucket weights and bias of the log-odds of label 1, from vectors and a softmax layer learned together.

    As the layer is linear in the mean vector, each bucket's vector times the difference of the layer's rows is all
    that scoring needs.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    epochs = max(epochs, -(-LEAST_STEPS // len(bags)))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            now = rate * (1 - done / steps)
            done += 1
            ids, share = bags[i]
            hidden = share @ vectors[ids]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer.T @ p
            back /= max(1.0, float(np.sqrt(back @ back)))
            layer -= now * np.outer(p, hidden)
            bias -= now * p
            # a mean over many features moves little: the step of each vector is scaled as if the bag had few of them
            vectors[ids] -= (now * np.minimum(share * len(ids), 1))[:, None] * back
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES):
    """Texts and labels of at most `rows` usable labelled documents and `max_bytes`, in the order of a hash of doc_id.

    Rows without a label or an id are passed over; a document labelled twice counts once with its larger label, and of
    rows that repeat a doc_id the smallest text counts. Neither files nor partitions have a part in the outcome.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # whole texts: those above a hundredth of the budget are not learned from
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= max_bytes // 100)
    found = body.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_label").alias("_label"))
    found = materialize(found.withColumn("_at", F.xxhash64("doc_id")), "labelled-sample")
    sizes = sorted((r["_at"], r["doc_id"], r["n"]) for r in found.select("_at", "doc_id", F.octet_length("text").alias("n")).collect())
    within = np.cumsum([n for _, _, n in sizes]) <= max_bytes
    if not within.any():
        return [], np.zeros(0, np.int64)
    last, last_id, _ = sizes[int(within.sum()) - 1]
    chosen = found.where((F.col("_at") < last) | ((F.col("_at") == last) & (F.col("doc_id") <= last_id))).collect()
    chosen.sort(key=lambda r: (r["_at"], r["doc_id"]))
    return [r["text"].encode() for r in chosen], np.array([r["_label"] for r in chosen], np.int64)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]], each added up by itself, so that its rounding is the same in any batch."""
    out = np.add.reduceat(np.append(values, np.float32(0)).astype(np.float64), offsets)[:-1]
    return np.where(np.diff(offsets) > 0, out, 0.0)


def _score(weights: np.ndarray, bias: float, bits: int, name: str = "_score"):
    def run(batches):
        for batch in pieces(batches, "text", 1 << 20):
            data, offsets = text_buffer(batch.column("text"))
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for ids, by_doc in features(data, offsets, bits):
                total += _sums(weights[ids], by_doc)
                n += np.diff(by_doc)
            z = total / np.maximum(n, 1) + bias
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            columns = {c: batch.column(c) for c in batch.schema.names if c != name} | {name: pa.array(score)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label: str = "quality", bits: int = BITS):
    """(bucket weights, bias) learned from a bounded sample; None if no document is labelled."""
    texts, marks = labelled_sample(docs, labels, label, F.lit(True) if usable is None else usable)
    return train(bags(texts, bits), marks, bits) if len(marks) else None


def score_quality(docs: DataFrame, model, bits: int = BITS, name: str = "_score") -> DataFrame:
    """docs with `name`, the probability of label 1 by the whole text; texts without words have the bias's score.

    The model is 2^bits numbers, whatever the corpus. Without a model every score is 0.5. A score depends on the text
    alone. A column of docs named like the score is replaced, all others are kept; a null text is scored as an empty
    one, repeated rows each have their score, no rows give no rows.
    """
    weights, bias = model or (np.zeros(1 << bits, np.float32), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        yield from _score(shared.value, bias, bits, name)(batches)

    keep = docs.select(*plain([c for c in docs.columns if c.lower() != name.lower()]), F.lit(0.0).alias(name))
    return keep.mapInArrow(run, keep.schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their own columns; all of them where no label is usable."""
    model = fit_quality(docs, labels)
    if model is None:
        return docs
    name = free_prefix(docs.columns) + "score"
    return score_quality(docs, model, name=name).where(F.col(name) >= threshold).select(*plain(docs.columns))
