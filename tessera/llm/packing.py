"""Best-fit decreasing packing of token pieces into sequences of bounded length."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, text_buffer

MAX_TOKENS = 2048
ROWS_PER_BUCKET = 20_000
#: Memory for the words that a worker keeps the ids of: about so much for each, and for each of their letters.
CACHE_BYTES = 128 << 20
WORD_BYTES, LETTER_BYTES = 200, 8
#: Signs that end words and are tokens of their own after a letter or digit.
SIGNS = frozenset(",.!?;:")
#: The letters that byte-level tokenizers write bytes as: printable ones as they are, the others from 256 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTERS = {b: b for b in _PRINTED} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Fullness:
    """A segment tree over remaining capacities: how many open bins have each, and the tightest that fits."""

    def __init__(self, limit: int):
        self.base = 1 << limit.bit_length()
        self.count = [0] * (2 * self.base)

    def add(self, capacity: int, bins: int) -> None:
        at = self.base + capacity
        while at:
            self.count[at] += bins
            at >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least `need` with an open bin, or -1; in logarithmic time."""
        at = self.base + need
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at + (not self.count[2 * at])
                return at - self.base
            at >>= 1
        return -1


def best_fit_decreasing(histogram: dict[int, int], limit: int = MAX_TOKENS) -> list[tuple[int, int, int, int, int, int]]:
    """Rules (length, first, items, first bin, items a bin, offset) that pack `histogram` = {length: items}.

    The r-th piece of a length (first <= r < first + items) goes to bin `first bin + (r - first) // items a bin`,
    at `offset + (r - first) % items a bin * length`. The bins are those of best-fit decreasing taken one piece at a
    time: bins alike in what they hold are moved together, and a tightest bin takes pieces of a length until no
    more fit, as it stays the tightest. The work depends on the distinct lengths, at most `limit`, not on the pieces.
    """
    tree, groups, rules, bins = Fullness(limit), {}, [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            groups.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity < 0:
                capacity, each = limit, limit // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                first, n = groups[capacity].pop()
                tree.add(capacity, -n)
                each = capacity // length
            whole = min(n, left // each)
            if whole:
                rules.append((length, rank, whole * each, first, each, limit - capacity))
                put(capacity - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < n and left:
                rules.append((length, rank, left, first + whole, left, limit - capacity))
                put(capacity - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            put(capacity, first + whole, n - whole)
    return rules


class WordIds:
    """Ids of texts by a tokenizer that never joins across white space and lower-cases; ids of words are kept.

    Words are kept in two generations of half of `limit` bytes each: a full younger one becomes the older one, of which
    those words stay that come up again. Beyond `limit` there are no more than the words of one call.
    """

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.kept, self.older, self.held = {"": b""}, {}, 0

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of each word, kept from now on; what a sign ends is put together from the word and the sign."""
        if 2 * self.held > self.limit:
            self.older, self.kept, self.held = self.kept if self.held <= self.limit else {}, {"": b""}, 0
        signed = [w[-1:] in SIGNS and w[:-1].isalnum() for w in words]
        new = {w[:-1] if s else w for w, s in zip(words, signed)}.union(SIGNS).difference(self.kept)
        self.held += WORD_BYTES * len(new) + LETTER_BYTES * sum(map(len, new))
        known = new.intersection(self.older)
        self.kept.update((w, self.older[w]) for w in known)
        plain = new.difference(known)
        # a word of lower-case Latin-1 letters alone is normalised already and is one piece for the model
        letters = [w for w in plain if w.isalpha() and w.islower() and (w.isascii() or max(w) < "\u0100")]
        model = self.tokenizer.model
        for w in letters:
            found = model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_LETTERS))
            self.kept[w] = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        plain = list(plain.difference(letters))
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.kept[word] = struct.pack(f"<{len(found)}I", *found.ids)
        return [self.kept[w[:-1]] + self.kept[w[-1]] if s else self.kept[w] for w, s in zip(words, signed)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text: every distinct word is looked up once."""
        data, offsets = text_buffer(pa.array(texts, pa.string()))
        rows = np.searchsorted(offsets, np.flatnonzero(data - np.uint8(0x1C) < 4), "right") - 1
        odd = {i: texts[i] for i in np.unique(rows).tolist()}
        if odd:
            whole = [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(list(odd.values()), add_special_tokens=False)]
            odd = dict(zip(odd, whole))
        # white space here that the tokenizer does not split at: U+001C to U+001F
        texts = ["" if i in odd else self.folded(x) for i, x in enumerate(texts)]
        split = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        coded = split.flatten().dictionary_encode()
        found = self.learn(coded.dictionary.to_pylist())
        at, edges = coded.indices.to_numpy(), split.offsets.to_numpy() - split.offsets[0].as_py()
        return [odd.get(i) or b"".join(map(found.__getitem__, at[a:b].tolist())) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]

    @staticmethod
    def folded(text: str) -> str:
        """The text in lower case where that changes no id: Latin-1 letters, and no special token in sight."""
        if "<|" in text:
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()


_TOKENIZERS: dict[str, WordIds] = {}


def _tokenize(tokenizer: str, limit: int, end_id: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer not in _TOKENIZERS:
            import public_tokenizers

            _TOKENIZERS[tokenizer] = WordIds(public_tokenizers.path(tokenizer))
        encode, end = _TOKENIZERS[tokenizer], np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            _, offsets = text_buffer(texts)
            at, rows = 0, []
            while at < len(ids):
                stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (8 << 20), "right")) - 1)
                part = [x or "" for x in texts.slice(at, stop - at).to_pylist()]
                for doc, found in zip(ids[at:stop], encode(part)):
                    found += end
                    for piece, start in enumerate(range(0, len(found), 4 * limit)):
                        cut = found[start : start + 4 * limit]
                        rows.append((doc, piece, start // 4, len(cut) // 4, zlib.crc32(cut)))
                at = stop
            # else Arrow keeps the memory of the largest batch for the next one
            pa.default_memory_pool().release_unused()
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return run


def tokenize(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = MAX_TOKENS, end_id: int = 0) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of at most `limit` ids; each document's ids end in `end_id`."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(_tokenize(tokenizer, limit, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces with a `length` of 1 to `limit`.

    The driver packs the histogram of lengths (at most `limit` rows) into rules whose number depends on `limit` alone,
    and every piece finds its place from its rank among the pieces of its length. Ranks add up from counts of hashed
    buckets, so a length that a third of all pieces share is spread over tasks.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    rules = best_fit_decreasing(counts, limit)
    buckets = max(16, -(-sum(counts.values()) // ROWS_PER_BUCKET))
    pieces = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sums = pieces.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = pieces.join(sums, ["length", "_b"]).withColumn("_rank", F.col("_before") + F.row_number().over(inside) - 1)
    schema = "_length long, _first long, _items long, _bin long, _each long, _offset long"
    starts: dict[int, list] = {}
    for rule in rules:
        starts.setdefault(rule[0], []).append(rule)
    book = spark.createDataFrame([(k, v) for k, v in starts.items()], f"length long, _rules array<struct<{schema.replace(' long', ': long')}>>")
    fits = F.filter("_rules", lambda r: (r["_first"] <= F.col("_rank")) & (F.col("_rank") < r["_first"] + r["_items"]))
    placed = ranked.join(F.broadcast(book), "length").withColumn("_rule", fits[0])
    at = F.col("_rank") - F.col("_rule._first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_rule._bin") + F.floor(at / F.col("_rule._each"))).alias("sequence_id"),
        (F.col("_rule._offset") + F.pmod(at, F.col("_rule._each")) * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = MAX_TOKENS) -> DataFrame:
    """Tokenize all documents once, into a table in the shared folder, and pack the pieces.

    A null or empty text is its end id alone; a document longer than `limit` is cut; repeated rows are packed as
    often as they occur; no documents give no rows; other columns are not read.
    """
    return pack(materialize(tokenize(docs, tokenizer, limit), "pieces"), limit)
