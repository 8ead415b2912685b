"""Near-duplicate documents by BagMinHash signatures, bands, and the weighted Jaccard similarity of word shingles."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD_TABLE, join_counted, materialize, mix, pieces, text_buffer
from tessera.llm.components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 26, 5
#: Shingles and documents that one task compares at once; larger groups are dealt out in chunks.
CHUNK_ELEMENTS = 2 << 20
CHUNK_MEMBERS = 4096
#: Members, about, that every chunk of a dealt-out group holds.
PIVOTS = 8
_UNIT = 2.0**-53
_SLICE = 1 << 20


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts, and the words of each text."""
    text = np.frombuffer(data.tobytes().translate(WORD_TABLE), np.uint8)
    inside = text != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    with np.errstate(over="ignore"):
        since = np.zeros(len(text), np.int32)
        since[starts] = starts
        since = np.arange(len(text), dtype=np.int32) - np.maximum.accumulate(since)
        powers = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
        scaled = text.astype(np.uint64)
        scaled += np.uint64(1)
        scaled += (since >> 8).astype(np.uint64) * np.uint64(977)
        scaled *= powers[since & 255]
        scaled[~inside] = 0
        return mix(np.add.reduceat(scaled, starts)), np.diff(np.searchsorted(starts, offsets))


def shingle_bags(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """(document, shingle hash, count) of the distinct shingles of each text, sorted by document and hash.

    Words are runs of digits, letters and non-ASCII characters, lower-cased in ASCII; a text of fewer words than a
    shingle, but not none, is one shingle.
    """
    n_docs = len(offsets) - 1
    empty = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words, counts, at = [], [], 0
    while at < n_docs:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _SLICE, "right")) - 1)
        word, n = _word_hashes(data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
        words.append(word)
        counts.append(n)
        at = stop
    word, n_words = (np.concatenate([np.zeros(0, t), *x]) for t, x in ((np.uint64, words), (np.int64, counts)))
    if not len(word):
        return empty
    with np.errstate(over="ignore"):
        bounds = np.concatenate([[0], np.cumsum(n_words)])
        doc = np.repeat(np.arange(n_docs), n_words)
        left = np.repeat(bounds[1:], n_words) - np.arange(len(word))
        padded = np.concatenate([word, np.zeros(size, np.uint64)])
        value = np.zeros(len(word), np.uint64)
        for k in range(size):
            part = padded[k : k + len(word)] * (np.uint64(2 * k + 3) ** np.uint64(9))
            value += np.where(left > k, part, np.uint64(0))
        use = (left >= size) | ((np.repeat(n_words, n_words) < size) & (left == np.repeat(n_words, n_words)))
    doc, value = doc[use], mix(value[use])
    order = np.argsort(value)
    order = order[np.argsort(doc[order], kind="stable")]
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))


def bag_min_hash(doc: np.ndarray, value: np.ndarray, count: np.ndarray, n_docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures: two bags agree in a component with the probability of their weighted Jaccard similarity.

    Each shingle has a Poisson process over (time, weight), the same in all documents; its points below the shingle's
    count fall on random components, and each component keeps its earliest. Weights are cut at powers of two; the
    process of an interval yields one point, then goes on as the processes of its halves, down to single counts.
    Processes whose next point comes after the latest component of their document have nothing more to say.
    """
    best = np.full(n_docs * m, np.inf)
    with np.errstate(over="ignore"):
        lo, hi = np.zeros(len(doc), np.int64), np.ones(len(doc), np.int64)
        seed, owner, weight = mix(value), doc, count
        level, parts = 1, [(owner, seed, lo, hi, weight)]
        while (more := np.flatnonzero(count > level)).size:
            fresh = mix(value[more] ^ np.uint64(level * 0x51ED27))
            parts.append((doc[more], fresh, np.full(more.size, level), np.full(more.size, 2 * level), count[more]))
            level *= 2
        owner, seed, lo, hi, weight = (np.concatenate(x) for x in zip(*parts))
        time = np.zeros(len(owner))
        latest = np.full(n_docs, np.inf)
        while len(owner):
            seed = mix(seed + np.uint64(0x9E3779B97F4A7C15))
            time = time - np.log1p(-(seed >> np.uint64(11)).astype(np.float64) * _UNIT) / (hi - lo)
            on = time < latest[owner]
            owner, seed, lo, hi, weight, time = (x[on] for x in (owner, seed, lo, hi, weight, time))
            if not len(owner):
                break
            draw = mix(seed ^ np.uint64(0xD1B54A32D192ED03))
            place = lo + ((draw >> np.uint64(40)).astype(np.float64) * 2.0**-24) * (hi - lo)
            falls = place < weight
            slot = owner * m + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(best, slot[falls], time[falls])
            alive = np.unique(owner)
            latest[alive] = best.reshape(n_docs, m)[alive].max(axis=1)
            split = np.flatnonzero(hi - lo > 1)
            if split.size:
                middle = (lo[split] + hi[split]) // 2
                right = split[middle < weight[split]]
                mid = (lo[right] + hi[right]) // 2
                more = owner[right], mix(seed[right] ^ np.uint64(0xA5A5A5A5)), mid, hi[right], weight[right], time[right]
                hi[split], seed[split] = middle, mix(seed[split] ^ np.uint64(0x5A5A5A5A))
                owner, seed, lo, hi, weight, time = (np.concatenate(x) for x in zip((owner, seed, lo, hi, weight, time), more))
    return best.reshape(n_docs, m)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        bits = signatures.view(np.uint64).reshape(-1, bands, rows)
        out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), bits.shape[:2])
        for k in range(rows):
            out = mix(out + bits[:, :, k])
    return out.astype(np.int64)


def _keys(data: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """A digest of each text's words in turn, None without words."""
    raw = data.tobytes()
    words = (b" ".join(raw[a:b].translate(WORD_TABLE).split()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()))
    return [hashlib.md5(w).digest() if w else None for w in words]


def _tag(key: bytes) -> int:
    return int.from_bytes(key[:7], "big")


def _sign(batches):
    """(doc_id, key of the word sequence or null, number of shingles, bands) of each document."""
    for batch in pieces(batches, "text", 1 << 20):
        data, offsets = text_buffer(batch.column("text"))
        n = batch.num_rows
        doc, value, count = shingle_bags(data, offsets)
        bands = band_keys(bag_min_hash(doc, value, count, n))
        size = np.bincount(doc, count, n).astype(np.int64)
        keys = _keys(data, offsets)
        some = np.flatnonzero(size)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]), pa.int32()), pa.array(bands[some].ravel(), pa.int64())
        )
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(size), lists], names=["doc_id", "key", "n", "bands"])


def _bags(batches):
    """(t, hub, rep, elements) of each text and each task `to` that it goes to; texts whose words are not those of `tag` give none.

    An element is a number for the k-th occurrence of a shingle, so that sets of them measure bags.
    """
    names = ["t", "hub", "rep", "elements"]
    for batch in pieces(batches, "text", 1 << 20):
        data, offsets = text_buffer(batch.column("text"))
        doc, value, count = shingle_bags(data, offsets)
        with np.errstate(over="ignore"):
            first = np.repeat(np.cumsum(count) - count, count)
            nth = (np.arange(count.sum()) - first).astype(np.uint64)
            elements = mix(np.repeat(value, count) + nth * np.uint64(0xD1B54A32D192ED03)).astype(np.int64)
        sizes = np.bincount(doc, count, batch.num_rows).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        keys, tags = _keys(data, offsets), batch.column("tag").to_pylist()
        row, t, hub = [], [], []
        for i, to in enumerate(batch.column("to").to_pylist()):
            if keys[i] is not None and _tag(keys[i]) == tags[i]:
                row += [i] * len(to)
                t += [x["t"] for x in to]
                hub += [x["hub"] for x in to]
        if not row:
            continue
        row, t, hub, ids = np.array(row), np.array(t, np.int64), np.array(hub, np.int64), batch.column("rep").to_numpy()
        ends, at = np.cumsum(sizes[row]), 0
        while at < len(row):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 20), "right")))
            own = row[at:stop]
            k = sizes[own]
            flat = elements[np.repeat(starts[own] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(t[at:stop]), pa.array(hub[at:stop]), pa.array(ids[own]), lists], names=names)
            at = stop


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches by the links (a, b)."""
    root = np.arange(n)
    while True:
        best = root.copy()
        np.minimum.at(best, a, root[b])
        np.minimum.at(best, b, root[a])
        best = best[best]
        if (best == root).all():
            return root
        root = best


def _dense_links(m: int, run: np.ndarray, member: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of one group of m bags, from its shared elements (number of each, sorted; member that has it).

    Elements that few have are counted pair by pair, the others as a product of blocks of a membership matrix.
    """
    same = np.zeros((m, m), np.float32)
    df = np.bincount(run)
    few = df[run] <= 8
    at = np.flatnonzero(few)
    for lag in range(1, 8):
        at = at[at + lag < len(run)]
        at = at[run[at] == run[at + lag]]
        same += np.bincount(member[at] * m + member[at + lag], minlength=m * m).reshape(m, m).astype(np.float32)
    same += same.T
    many, member = run[~few], member[~few]
    if len(many):
        column = np.cumsum(np.concatenate([[0], many[1:] != many[:-1]]))
        for start in range(0, int(column[-1]) + 1, 1024):
            lo, hi = np.searchsorted(column, [start, start + 1024])
            has = np.zeros((m, 1024), np.float32)
            has[member[lo:hi], column[lo:hi] - start] = 1
            same += has @ has.T
    out_a, out_b = [], []
    for start in range(0, m, 256):
        block = same[start : start + 256].astype(np.float64)
        a, b = np.nonzero(block >= threshold * (size[start : start + 256, None] + size[None] - block) - 1e-9)
        a += start
        out_a.append(a[a < b])
        out_b.append(b[a < b])
    return np.concatenate(out_a), np.concatenate(out_b)


def _compare(threshold: float):
    """Of some groups of bags: a forest (a, b) of the links at the threshold between any two bags of a group."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        hub, rep = table.column("hub").to_numpy(), table.column("rep").to_numpy()
        order = np.lexsort((rep, hub))
        new = np.ones(len(order), bool)
        new[1:] = (hub[order[1:]] != hub[order[:-1]]) | (rep[order[1:]] != rep[order[:-1]])
        order = order[new]
        lists = table.column("elements").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())[order].astype(np.int64)
        elements = lists.take(pa.array(order)).flatten().to_numpy().view(np.uint64)
        hub, rep = hub[order], rep[order]
        group = np.cumsum(np.concatenate([[0], hub[1:] != hub[:-1]]))
        members = np.bincount(group)
        least = np.minimum.reduceat(sizes, np.cumsum(members) - members)[group]
        bag = np.repeat(np.arange(len(rep)), sizes)
        with np.errstate(over="ignore"):
            key = elements ^ mix(group.astype(np.uint64) + np.uint64(1))[bag]
        # what a bag shares with others of its group bounds what it shares with any one of them
        need = threshold / (1 + threshold) * (sizes + np.maximum(least, threshold * sizes)) - 1e-6
        while True:
            order = np.argsort(key)
            key, bag = key[order], bag[order]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            number = np.cumsum(first) - 1
            shared = np.bincount(number)[number] > 1 if len(key) else first
            left = np.bincount(bag[shared], minlength=len(rep))
            use = shared & (left >= need)[bag]
            done = use.sum() > 0.9 * len(use)
            key, bag, number = key[use], bag[use], number[use]
            if done or not len(key):
                break
        order = np.argsort(group[bag], kind="stable")
        number, bag = number[order], bag[order]
        place = np.arange(len(rep)) - (np.cumsum(members) - members)[group]
        small = members <= 16
        base = np.cumsum(np.where(small, members * members, 0)) - np.where(small, members * members, 0)
        counts = np.zeros(int((members * members)[small].sum()), np.int64)
        at = np.flatnonzero(small[group[bag]]) if len(bag) else np.zeros(0, np.int64)
        for lag in range(1, 16):
            at = at[at + lag < len(bag)]
            at = at[number[at] == number[at + lag]]
            if not len(at):
                break
            x, y, g = place[bag[at]], place[bag[at + lag]], group[bag[at]]
            counts += np.bincount(base[g] + np.minimum(x, y) * members[g] + np.maximum(x, y), minlength=len(counts))
        slot = np.flatnonzero(counts)
        g = np.flatnonzero(small)[np.searchsorted(base[small], slot, "right") - 1] if len(slot) else slot
        start = np.cumsum(members) - members
        x, y = start[g] + (slot - base[g]) // members[g], start[g] + (slot - base[g]) % members[g]
        near = counts[slot] >= threshold * (sizes[x] + sizes[y] - counts[slot]) - 1e-9
        out_a, out_b = [x[near]], [y[near]]
        edges = np.searchsorted(group[bag], np.arange(len(members) + 1)) if len(bag) else np.zeros(len(members) + 1, np.int64)
        for g in np.flatnonzero(~small & (np.diff(edges) > 0)).tolist():
            lo, hi = edges[g], edges[g + 1]
            some, own = np.unique(bag[lo:hi], return_inverse=True)
            runs = np.cumsum(np.concatenate([[0], number[lo + 1 : hi] != number[lo : hi - 1]]))
            a, b = _dense_links(len(some), runs, own, sizes[some], threshold)
            out_a.append(some[a])
            out_b.append(some[b])
        root = _roots(len(rep), np.concatenate(out_a), np.concatenate(out_b))
        tail = np.flatnonzero(root != np.arange(len(rep)))
        return pa.table({"a": rep[tail], "b": rep[root[tail]]}, schema=schema)

    return run


def _compared(docs: DataFrame, to: DataFrame, threshold: float, name: str) -> DataFrame:
    """Links (a, b) found in the tasks that `to` (rep, tag, t, hub) deals documents to; a text travels once, its bag once a task."""
    to = to.groupBy("rep").agg(F.first("tag").alias("tag"), F.collect_list(F.struct("t", "hub")).alias("to"))
    bags = docs.withColumnRenamed("doc_id", "rep").join(to, "rep").mapInArrow(_bags, "t long, hub long, rep long, elements array<long>")
    return materialize(bags.groupBy("t").applyInArrow(_compare(threshold), "a long, b long"), name)


def _across(docs: DataFrame, large: DataFrame, parts: DataFrame, threshold: float) -> DataFrame | None:
    """Links between chunks of groups that were dealt out, None if there is nothing to compare.

    `large` is (hub, rep, n, tag, k). A group whose members are one component is done. Of the others, members that share
    too few elements with all others together to link with any are left out; then those outside the group's largest
    component are compared with all, chunk by chunk.
    """
    large = large.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")
    large = materialize(large, "dealt")
    by_part = large.groupBy("hub", "part").agg(F.count("*").alias("_c"), F.min("n").alias("_m"))
    open_ = by_part.groupBy("hub").agg(F.max(F.struct("_c", "part")).alias("_top"), F.count("*").alias("_parts"), F.min("_m").alias("least"), F.sum("_c").alias("_rows"))
    open_ = materialize(open_.where("_parts > 1").select("hub", F.col("_top.part").alias("top"), "least", "_rows"), "open-groups")
    large = materialize(join_counted(large, open_, "hub", "_rows"), "open-members")
    if large.isEmpty():
        return None
    whole = docs.withColumnRenamed("doc_id", "rep").join(large.groupBy("rep").agg(F.first("tag").alias("tag"), F.collect_list(F.struct(F.col("hub").alias("t"), "hub")).alias("to")), "rep")
    bags = materialize(whole.mapInArrow(_bags, "t long, hub long, rep long, elements array<long>").select("hub", "rep", F.explode("elements").alias("e")), "elements").distinct()
    again = bags.groupBy("hub", "e").agg(F.count("*").alias("_c")).where("_c > 1").drop("_c")
    held = bags.join(again, ["hub", "e"]).groupBy("hub", "rep").agg(F.count("*").alias("held"))
    need = threshold / (1 + threshold) * (F.col("n") + F.greatest("least", threshold * F.col("n"))) - 1e-6
    alive = materialize(large.join(held, ["hub", "rep"]).where(F.col("held") >= need), "alive")
    few = alive.where("part <> top").groupBy("hub").agg(F.greatest(F.ceil(F.sum("n") / CHUNK_ELEMENTS), F.ceil(F.count("*") / CHUNK_MEMBERS)).cast("int").alias("ks"))
    few = materialize(few, "outside")
    if few.isEmpty():
        return None
    rows = materialize(few.join(alive.groupBy("hub").agg(F.count("*").alias("_rows")), "hub"), "compared-groups")
    alive = join_counted(alive, rows, "hub", "_rows")
    i, j = F.pmod(F.xxhash64("rep"), "ks").cast("int"), F.pmod(F.xxhash64("rep", "hub"), "k").cast("int")
    small = alive.where("part <> top").select("*", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    every = alive.select("*", F.explode(F.sequence(F.lit(0), F.col("ks") - 1)).alias("i"), j.alias("j"))
    to = small.unionByName(every).select("rep", "tag", F.xxhash64("hub", "i", "j").alias("t"), "hub")
    return _compared(docs, to, threshold, "links-across")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id): documents linked, in steps, by a weighted Jaccard similarity of five-word shingles of the threshold.

    Texts of the same words are one class before anything else, so copies cost one signature each and no comparison.
    Documents that share a band are a bucket; buckets with one smallest document are a group, and any two of a group
    are compared, in one task. A group of more than CHUNK_MEMBERS documents or CHUNK_ELEMENTS shingles is dealt out in
    chunks that all hold some pivots; documents that the pivots did not bring together are then compared across chunks,
    but for those whose shingles prove that they link with nothing more. No bucket is capped, and no pair is shuffled.

    A document without words (null or empty text) is its own class; a null doc_id is passed over. Rows that repeat a
    doc_id share a class: of their texts with words, that with the least hash of its words is compared. Other columns
    are not read; no rows give no rows.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    signs = materialize(docs.mapInArrow(_sign, "doc_id long, key binary, n long, bands array<long>"), "signatures")
    signs = signs.withColumn("own", F.lit(True))
    again = materialize(signs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "repeated-ids")
    if not again.isEmpty():
        least = signs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("key").alias("_least"))
        signs = signs.join(least, "doc_id", "left").withColumn("own", F.col("_least").isNull() | F.coalesce(F.col("key") == F.col("_least"), F.lit(False)))
        signs = materialize(signs.withColumn("key", F.coalesce("_least", "key")).drop("_least"), "one-text-an-id")
    named = signs.where("key is not null and own")
    reps = named.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = materialize(reps, "representatives")
    members = reps.select("rep", "n", F.conv(F.hex(F.expr("substring(key, 1, 7)")), 16, 10).cast("long").alias("tag"), F.explode("bands").alias("band"))
    crowded = members.groupBy("band").agg(F.count("*").alias("_rows"), F.min("rep").alias("hub")).where("_rows > 1")
    groups = join_counted(members, materialize(crowded, "buckets"), "band", "_rows").select("hub", "rep", "n", "tag").distinct()
    groups = materialize(groups, "groups")
    sizes = groups.groupBy("hub").agg(F.greatest(F.ceil(F.sum("n") / CHUNK_ELEMENTS), F.ceil(F.count("*") / CHUNK_MEMBERS)).cast("int").alias("k"), F.count("*").alias("_rows"))
    sizes = materialize(sizes, "group-sizes")
    tasks = max(1, -(-(groups.agg(F.sum("n")).first()[0] or 0) // CHUNK_ELEMENTS))
    groups = join_counted(groups, sizes, "hub", "_rows", keep=True)
    pivot = (F.col("rep") == F.col("hub")) | (F.pmod(F.xxhash64(F.lit(3), "rep", "hub"), "_rows") < PIVOTS)
    own = F.array(F.pmod(F.xxhash64("rep", "hub"), "k").cast("int"))
    chunks = F.when(pivot & (F.col("k") > 1), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(own)
    t = F.when(F.col("k") > 1, F.xxhash64("hub", "chunk")).otherwise(F.pmod(F.xxhash64("hub"), F.lit(tasks)))
    to = groups.withColumn("chunk", F.explode(chunks)).select("rep", "tag", t.alias("t"), "hub")
    links = _compared(docs, to, threshold, "links")
    parts = materialize(connected_components(links), "components")
    large = groups.where("k > 1").drop("_rows")
    more = _across(docs, large, parts, threshold)
    if more is not None:
        parts = materialize(connected_components(links.unionByName(more)), "components")
    classes = reps.select("key", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("key", F.coalesce("component", "rep").alias("_class"))
    out = signs.select("doc_id", "key").join(classes, "key", "left")
    return out.select("doc_id", F.coalesce("_class", "doc_id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with the smallest doc_id of their class, and those without a doc_id.

    Of rows that repeat a doc_id one stays: that with the smallest text, an empty one last.
    """
    classes = near_duplicates(docs, threshold).where("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.join(classes, "doc_id", "left_anti").select(*docs.columns)
    # texts of repeated ids alone are shuffled
    again = materialize(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return kept
    least = F.min(F.struct((F.coalesce(F.length("text"), F.lit(0)) == 0).alias("_empty"), "text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("_row")
    first = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(least).select("doc_id", "_row.*").select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(first)
