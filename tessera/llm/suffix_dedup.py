"""Removal of byte passages that an earlier document has, by merged Burrows-Wheeler transforms."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.bwt import END, last_to_first, merge, suffix_order, walk
from tessera.llm.common import Scratch, free_prefix, materialize, mix, plain, shuffle_partitions, text_buffer

LENGTH = 50
#: An anchor is the least-hashed string of GRAM bytes in a window of LENGTH.
GRAM = 20
#: Bytes of text that a block and a part stand for.
BLOCK_BYTES = 4 << 20
PART_BYTES = 16 << 20
#: Windows that are worked out at once; a position in them and those before it fits the mask.
_SLICE = 1 << 16
_PLACE = np.uint64((1 << 17) - 1)
_LAST = np.iinfo(np.int64).max
_LEAST = np.iinfo(np.int64).min
_KEY_BITS = 48
#: Every window holds this many bytes before its anchor, or after it.
_BESIDE = (LENGTH - GRAM) // 2
_WILD = 1
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        powers, back = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        powers[0] = back[0] = 1
        return np.multiply.accumulate(powers), np.multiply.accumulate(back)


_POWERS, _BACK = _powers(_SLICE + LENGTH)


class _Names:
    """Columns of the operator's own that no column of the documents has."""

    def __init__(self, columns: list[str], prefix: str):
        self.results = [prefix + x for x in ("n_bytes", "n_removed", "n_spans", "kept", "sha256")]
        free = free_prefix([*columns, *self.results])
        self.block, self.id, self.text = free + "b", free + "id", free + "text"


class _Runs:
    """Runs of consecutive windows with one anchor, of a block: arrays with an entry for each run.

    first, windows, doc: where they are; at: place of the anchor in the run; key: hash of the anchor; content: hash of
    the run's string; left, right: hashes of the anchor with the _BESIDE bytes before and after it, 0 if no window of
    the run has them, _WILD if the anchor stands in the run more than once. A window's anchor, and its place in the
    window, depend on the window's bytes alone, so equal windows have equal anchors wherever they stand. Runs do not
    cross documents and have no more windows than fit one anchor.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        found = [_slice_runs(data[at : at + _SLICE + LENGTH - 1], offsets - at) for at in range(0, max(1, len(data) - LENGTH + 1), _SLICE)]
        sizes = np.arange(0, len(found)) * _SLICE
        self.first, self.windows, self.doc, self.at, key, content, self.left, self.right = (np.concatenate(x) for x in zip(*found))
        self.first += np.repeat(sizes, [len(f[0]) for f in found])
        key = mix(key)
        self.key, self.content = key >> np.uint64(64 - _KEY_BITS), mix(content ^ key)


def _slice_runs(data: np.ndarray, offsets: np.ndarray):
    n, span = len(data), LENGTH - GRAM + 1
    if n < LENGTH:
        none, hashes, small = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        return none, none, none, none, hashes, hashes, small, small
    with np.errstate(over="ignore"):
        # hashes of 1, 2, 4, ... bytes, put together to GRAM
        level, step, power = data.astype(np.uint64) + np.uint64(1), 1, _BASE
        total, done = None, 0
        while True:
            if GRAM & step:
                part = level[done : done + n - GRAM + 1]
                total = part.copy() if total is None else total * power + part
                done += step
            if 2 * step > GRAM:
                break
            level = level[:-step] * power + level[step:]
            power, step = power * power, 2 * step
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(32)
        total &= ~_PLACE
        total |= np.arange(len(total), dtype=np.uint64)
    low, width = total, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    anchor = low & ~_PLACE
    cut = np.ones(len(low), bool)
    np.not_equal(anchor[1:], anchor[:-1], out=cut[1:])
    lo, hi = np.searchsorted(offsets, 0, "right") - 1, np.searchsorted(offsets, len(low))
    near = offsets[max(lo, 0) : hi + 1]
    edges = np.concatenate([near, near - LENGTH + 1])
    cut[edges[(edges >= 0) & (edges < len(low))]] = True
    first = np.flatnonzero(cut)
    windows = np.diff(np.append(first, len(low)))
    doc = np.searchsorted(offsets, first, "right") - 1
    use = first + LENGTH <= offsets[doc + 1]
    first, windows, doc = first[use], windows[use], doc[use]
    parts = -(-windows // span)
    if (parts > 1).any():
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, doc, windows = np.repeat(first, parts) + nth * span, np.repeat(doc, parts), np.minimum(np.repeat(windows, parts) - nth * span, span)
    last = first + windows - 1
    at, again = (low[first] & _PLACE).astype(np.int64), (low[last] & _PLACE).astype(np.int64)
    with np.errstate(over="ignore"):
        # a polynomial, by sums of prefixes; the inverse power brings every string to the start
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * _POWERS[:n], out=sums[1:])
        hash_of = lambda a, b: (sums[b] - sums[a]) * _BACK[a]
        content = hash_of(first, last + LENGTH) + windows.astype(np.uint64)
        beside = []
        for a, b, has in ((at - _BESIDE, at + GRAM, first <= at - _BESIDE), (at, at + GRAM + _BESIDE, last >= at - _BESIDE)):
            h = (mix(hash_of(np.maximum(a, 0), np.minimum(b, n))) >> np.uint64(32)).astype(np.uint32) | np.uint32(2)
            beside.append(np.where(at != again, np.uint32(_WILD), np.where(has, h, np.uint32(0))))
    return first, windows, doc, at - first, low[first] >> np.uint64(17), content, *beside


def _by_part(part: np.ndarray) -> np.ndarray:
    return np.argsort(part.astype(np.uint16) if len(part) and part.max() < 65_536 else part, kind="stable")


def _distinct(key: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An entry of each distinct (content, key), and the number of each entry's."""
    order = np.argsort(content)
    new = np.ones(len(order), bool)
    new[1:] = content[order[1:]] != content[order[:-1]]
    if (~new[1:] & (key[order[1:]] != key[order[:-1]])).any():
        order = np.lexsort((key, content))
        new[1:] = (content[order[1:]] != content[order[:-1]]) | (key[order[1:]] != key[order[:-1]])
    each = np.empty(len(order), np.int64)
    each[order] = np.cumsum(new) - 1
    return order[new], each


def _sent_keys(key: np.ndarray, ids: np.ndarray, parts: int):
    """Distinct keys by part and value: (part, key, whether two documents have it, number of each run's key)."""
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    starts = np.flatnonzero(new)
    distinct, at = key[order[new]], np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    low, high = (f.reduceat(ids[order], starts) if len(starts) else ids[:0] for f in (np.minimum, np.maximum))
    part = (distinct % np.uint64(parts)).astype(np.int64)
    order = _by_part(part)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return part[order], distinct[order], (low < high)[order], place[at]


def _pack_keys(key: np.ndarray) -> bytes:
    return (key >> np.uint64(16)).astype("<u4").tobytes() + key.astype("<u2").tobytes()


def _unpack_keys(packed: bytes) -> np.ndarray:
    n = len(packed) // 6
    return np.frombuffer(packed, "<u4", n).astype(np.uint64) << np.uint64(16) | np.frombuffer(packed, "<u2", n, 4 * n).astype(np.uint64)


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


class _Block:
    """The documents of a block, their runs, and the distinct strings of runs whose anchor two documents have."""

    def __init__(self, table: pa.Table, names: _Names, parts: int, answers: pa.Table | None = None):
        self.data, self.offsets = text_buffer(table.column(names.text))
        self.ids = table.column(names.id).combine_chunks().fill_null(_LAST).to_numpy()
        self.all = _Runs(self.data, self.offsets)
        self.part, self.key, self.shared, self.at = _sent_keys(self.all.key, self.ids[self.all.doc], parts)
        if answers is None:
            return
        rows = answers.to_pylist()
        flags = np.zeros(len(self.key), bool)
        for r in rows:
            if r["kind"] == 0:
                a, b = self.span(self.part, r["p"])
                flags[a:b] = _bits(r["x"], b - a)
        self.runs = runs = np.flatnonzero(flags[self.at])
        one, each = _distinct(self.all.key[runs], self.all.content[runs])
        part = self.part[self.at[runs[one]]]
        order = _by_part(part)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.each, self.string_part, self.string_run = place[each], part[order], runs[one[order]]
        self.string, self.string_key = self.all.content[self.string_run], self.all.key[self.string_run]
        self.low, high = np.full(len(order), _LAST), np.full(len(order), _LEAST)
        run_ids = self.ids[self.all.doc[runs]]
        np.minimum.at(self.low, self.each, run_ids)
        np.maximum.at(high, self.each, run_ids)
        self.many = self.low < high
        self.answers = {k: {r["p"]: r for r in rows if r["kind"] == k} for k in (1, 2)}

    @staticmethod
    def span(parts: np.ndarray, p: int) -> tuple[int, int]:
        return int(np.searchsorted(parts, p)), int(np.searchsorted(parts, p, "right"))


_ROW = pa.schema([("p", pa.int64()), ("_b", pa.int64()), ("kind", pa.int32()), *[(c, pa.binary()) for c in "xyzvwu"]])
_ROW_SQL = "p long, _b long, kind int, x binary, y binary, z binary, v binary, w binary, u binary"


def _rows(rows: list[tuple]) -> pa.Table:
    """Messages (part, block, kind, up to six byte strings)."""
    rows = [(*r, *[None] * (len(_ROW) - len(r))) for r in rows]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), _ROW.types)], schema=_ROW) if rows else _ROW.empty_table()


def _send_keys(names: _Names, parts: int):
    """Of a block: for each part, its distinct anchor keys and which of them two of its documents have."""

    def run(key, table):
        block, rows = _Block(table, names, parts), []
        for p in np.unique(block.part).tolist():
            a, b = block.span(block.part, p)
            rows.append((p, key[0].as_py(), 0, _pack_keys(block.key[a:b]), np.packbits(block.shared[a:b]).tobytes()))
        return _rows(rows)

    return run


def _repeated(key, table):
    """Of a part: for each block, a bit for each key that it sent: whether two documents of any blocks have it."""
    got = table.to_pylist()
    keys = [_unpack_keys(r["x"]) for r in got]
    shared = [_bits(r["y"], len(k)) for r, k in zip(got, keys)]
    _, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    again = n > 1
    again[at[np.concatenate(shared)]] = True
    edges = np.cumsum([0, *map(len, keys)])
    return _rows([(r["p"], r["_b"], 0, np.packbits(again[at[a:b]]).tobytes()) for r, a, b in zip(got, edges[:-1], edges[1:])])


def _send_strings(names: _Names, parts: int):
    """Of a block: for each part, anchor, hash, smallest document, `many` and left and right of its strings of repeated anchors."""

    def run(key, table, answers):
        if not table.num_rows:
            return _ROW.empty_table()
        block, rows = _Block(table, names, parts, answers), []
        left, right = block.all.left[block.string_run], block.all.right[block.string_run]
        for p in np.unique(block.string_part).tolist():
            a, b = block.span(block.string_part, p)
            rows.append((p, key[0].as_py(), 1, _pack_keys(block.string_key[a:b]), block.string[a:b].tobytes(), block.low[a:b].tobytes(), np.packbits(block.many[a:b]).tobytes(), left[a:b].tobytes(), right[a:b].tobytes()))
        return _rows(rows)

    return run


def _met(anchor: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Whether another string of the same anchor has the same bytes beside it."""
    with np.errstate(over="ignore"):
        both = mix(anchor.astype(np.uint64) * _BASE + beside)
    _, at, n = np.unique(both, return_inverse=True, return_counts=True)
    return (n[at] > 1) & (beside > _WILD)


def _collapse(key, table):
    """Of a part: equal strings of all blocks become one.

    Each block hears for each of its strings: the smallest document that has it, whether two have it, and which of its
    windows it is to send on (1: those with _BESIDE bytes before the anchor, 2: those with as many after it, 3: all):
    the first block does, if another string has the same anchor and bytes; it also hears who has it.
    """
    got = table.to_pylist()
    content = np.concatenate([np.frombuffer(r["y"], np.uint64) for r in got])
    keys = np.concatenate([_unpack_keys(r["x"]) for r in got])
    low = np.concatenate([np.frombuffer(r["z"], np.int64) for r in got])
    left, right = (np.concatenate([np.frombuffer(r[c], np.uint32) for r in got]) for c in "wu")
    sizes = [len(r["y"]) // 8 for r in got]
    many = np.concatenate([_bits(r["v"], n) for r, n in zip(got, sizes)])
    blocks = np.repeat(np.array([r["_b"] for r in got], np.int64), sizes)
    one, at = _distinct(keys, content)
    order = np.argsort(at, kind="stable")
    held = np.bincount(at, minlength=len(one))
    starts = np.cumsum(held) - held
    # the first block of each
    one = order[starts]
    least, most, several = np.full(len(one), _LAST), np.full(len(one), _LEAST), np.zeros(len(one), bool)
    np.minimum.at(least, at, low)
    np.maximum.at(most, at, low)
    several[at[many]] = True
    several |= least < most
    _, anchor, n = np.unique(keys[one], return_inverse=True, return_counts=True)
    wild = np.zeros(len(n), bool)
    wild[anchor[left[one] == _WILD]] = True
    modes = np.where(wild[anchor], 3, _met(anchor, left[one]) + 2 * _met(anchor, right[one]))
    sends = np.zeros(len(content), np.uint8)
    sends[one] = np.where(n[anchor] > 1, modes, 0)
    holders = blocks[order].astype("<i4")
    rows, edges = [], np.cumsum([0, *sizes])
    for r, a, b in zip(got, edges[:-1], edges[1:]):
        own = at[a:b][sends[a:b] > 0]
        k = held[own]
        flat = holders[np.repeat(starts[own] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        rows.append((r["p"], r["_b"], 1, least[at[a:b]].tobytes(), np.packbits(several[at[a:b]]).tobytes(), sends[a:b].tobytes(), k.astype("<i4").tobytes(), flat.tobytes()))
    return _rows(rows)


def _send_transforms(names: _Names, parts: int):
    """Of a block: for each part, the transform of the strings that it is to send, with what is known about each."""

    def run(key, table, answers):
        if not table.num_rows:
            return _ROW.empty_table()
        block, rows = _Block(table, names, parts, answers), []
        n = len(block.string)
        mode, least, held, flat = np.zeros(n, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64), [np.zeros(0, np.int32)]
        for p, r in sorted(block.answers[1].items()):
            a, b = block.span(block.string_part, p)
            mode[a:b], least[a:b] = np.frombuffer(r["z"], np.uint8), np.frombuffer(r["x"], np.int64)
            held[a:b][mode[a:b] > 0] = np.frombuffer(r["v"], "<i4")
            flat.append(np.frombuffer(r["w"], "<i4"))
        flat, starts = np.concatenate(flat), np.cumsum(held) - held
        own = np.flatnonzero(mode)
        run_ = block.string_run[own]
        # of a string whose windows on one side of its anchor alone can repeat, those are sent
        middle = block.all.at[run_] - _BESIDE
        skip = np.where(mode[own] == 2, np.maximum(middle, 0), 0)
        stop = np.where(mode[own] == 1, np.minimum(middle + 1, block.all.windows[run_]), block.all.windows[run_])
        first = block.all.first[run_] + skip
        raw = block.data.tobytes()
        texts = [raw[a:b] for a, b in zip(first.tolist(), (first + stop - skip + LENGTH - 1).tolist())]
        part = block.string_part[own]
        owner, _, symbols = suffix_order(texts)
        by_part = _by_part(part[owner]) if len(own) else owner
        owner, symbols = owner[by_part], symbols[by_part]
        of_part = part[owner]
        # the transform of some of the strings is the rows of those strings
        for p in np.unique(part).tolist():
            a, b = block.span(of_part, p)
            here = np.flatnonzero(part == p)
            mine, x = own[here], symbols[a:b]
            k = held[mine]
            who = flat[np.repeat(starts[mine] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            about = np.stack([block.string[mine].view(np.int64), block.string_key[mine].view(np.int64), least[mine], k, skip[here]], 1).astype("<i8")
            rows.append((p, key[0].as_py(), 2, np.maximum(x.astype(np.int64) - 1, 0).astype(np.uint8).tobytes(), np.flatnonzero(x == END).astype("<u4").tobytes(), about.tobytes(), who.astype("<i4").tobytes()))
        return _rows(rows)

    return run


def _merge_transforms(key, table):
    """Of a part: merge the blocks' transforms; each holder of a string hears of windows that a smaller document has.

    Such a run of windows is (string's hash, its anchor's key, first window, windows).
    """
    got = table.to_pylist()
    symbols, about = [], [np.frombuffer(r["z"], "<i8").reshape(-1, 5) for r in got]
    for r in got:
        x = np.frombuffer(r["x"], np.uint8).astype(np.uint16) + np.uint16(1)
        x[np.frombuffer(r["y"], "<u4")] = END
        symbols.append(x)
    sizes, counts = np.array([len(x) for x in symbols], np.int64), np.array([len(x) for x in about], np.int64)
    shard = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) < 65_536 else np.int64), sizes)
    symbols, about, holders = np.concatenate(symbols), np.concatenate(about), np.concatenate([np.frombuffer(r["v"], "<i4") for r in got])
    content, anchor, low, held, skip = about.T
    lf = last_to_first(symbols, shard)
    ends = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts) + np.arange(len(low))
    owner, offset = walk(symbols, lf, ends)
    # a window ends where LENGTH bytes stand before; suffixes further to the front reach no window
    rows, interval, _ = merge(symbols, shard, lf, LENGTH, np.ones(len(symbols), bool), np.flatnonzero(offset >= LENGTH))
    if not len(rows):
        return _ROW.empty_table()
    least = np.full(int(interval.max()) + 1, _LAST)
    np.minimum.at(least, interval, low[owner[rows]])
    string, window, least = owner[rows], offset[rows], least[interval]
    use = least < low[string]
    order = np.lexsort((window[use], string[use]))
    string, window = string[use][order], window[use][order]
    new = np.ones(len(string), bool)
    new[1:] = (string[1:] != string[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(new)
    string, window, windows = string[at], window[at], np.diff(np.append(at, len(string)))
    k = held[string]
    starts = np.cumsum(held) - held
    to = holders[np.repeat(starts[string] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
    answer = np.repeat(np.stack([content[string], anchor[string], window + skip[string], windows], 1), k, axis=0).astype("<i8")
    order = np.argsort(to, kind="stable")
    to, answer = to[order], answer[order]
    blocks, firsts = np.unique(to, return_index=True)
    return _rows([(key[0].as_py(), int(b), 2, answer[i:j].tobytes()) for b, i, j in zip(blocks, firsts, [*firsts[1:], len(to)])])


def _removed(block: _Block) -> np.ndarray:
    """Bytes of the block that are removed, as flags."""
    edge = np.zeros(len(block.data) + 1, np.int32)
    n = len(block.string)
    least = np.full(n, _LAST)
    for p, r in block.answers[1].items():
        a, b = block.span(block.string_part, p)
        least[a:b] = np.frombuffer(r["x"], np.int64)
    ids = block.ids[block.all.doc[block.runs]]
    gone = block.runs[ids > least[block.each]]
    np.add.at(edge, block.all.first[gone], 1)
    np.add.at(edge, block.all.first[gone] + block.all.windows[gone] + LENGTH - 1, -1)
    order = np.argsort(block.each, kind="stable")
    sizes = np.bincount(block.each, minlength=n)
    starts = np.cumsum(sizes) - sizes
    for p, r in block.answers[2].items():
        a, b = block.span(block.string_part, p)
        content, anchor, window, windows = np.ascontiguousarray(np.frombuffer(r["x"], "<i8").reshape(-1, 4).T)
        string = a + np.searchsorted(block.string[a:b], content.view(np.uint64))
        while (other := block.string_key[string] != anchor.view(np.uint64)).any():
            string[other] += 1
        k = sizes[string]
        # smaller than any document that has the whole string, so all of them lose these windows
        run = block.runs[order[np.repeat(starts[string] - (np.cumsum(k) - k), k) + np.arange(k.sum())]]
        first = block.all.first[run] + np.repeat(window, k)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + np.repeat(windows, k) + LENGTH - 1, -1)
    return np.cumsum(edge)[:-1] > 0


def _cut(names: _Names, parts: int, schema: pa.Schema):
    """Of a block: the documents without their removed bytes."""

    def run(key, table, answers):
        if not table.num_rows:
            return schema.empty_table()
        block = _Block(table, names, parts, answers)
        gone = _removed(block)
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        heads = block.offsets[:-1][np.diff(block.offsets) > 0]
        rise[heads] = gone[heads]
        total, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(rise)])
        left = block.data[~gone].tobytes()
        kept_at = block.offsets - total[block.offsets]
        kept = [left[a:b] for a, b in zip(kept_at[:-1].tolist(), kept_at[1:].tolist())]
        results = (
            pa.array(np.diff(block.offsets)), pa.array(np.diff(total[block.offsets])), pa.array(np.diff(spans[block.offsets])),
            pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
        )
        out = dict(zip(names.results, results))
        return pa.table([out[c] if c in out else table.column(c) for c in schema.names], names=schema.names)

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = True, prefix: str = "_") -> DataFrame:
    """docs with _n_bytes, _n_removed, _n_spans, _kept (bytes; where keep_text) and _sha256 of the kept bytes.

    A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id. Documents
    are dealt by a hash of doc_id to blocks, in a bucketed table of the shared folder, so that the four passes over
    texts need no further shuffle of them:

    1. a block sends the 48-bit hashes of its anchors; each part tells it which of them two documents have;
    2. a block sends the strings' hashes (48 bits of the anchor, 64 of the string) around those anchors; each part makes
       equal strings one, so that copies cost no more than one string, and finds the strings that share an anchor and
       the bytes on one side of it without being equal;
    3. the first block with such a string sends it, in the transform of all that it sends to a part; the part merges
       the transforms of all blocks and finds the repeated intervals of depth LENGTH;
    4. a block removes what the parts found to be in smaller documents.

    Null and empty texts keep nothing and remove nothing; a null doc_id is larger than all others, and its rows do not
    remove from one another, nor do rows with one doc_id. Other columns are kept, but for `text` and those named like
    the results, which begin with `prefix`. No rows give no rows. Memory is bounded by a block (BLOCK_BYTES of text, or
    one longer document) and by a part.
    """
    spark, names = docs.sparkSession, _Names(docs.columns, prefix)
    scratch = Scratch(spark, "repeats")
    size = int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    cores = shuffle_partitions(spark)
    blocks = max(1, -(-size // BLOCK_BYTES))
    parts, buckets = max(-(-size // PART_BYTES), min(cores, blocks)), max(-(-blocks // 4), min(cores, blocks))
    keep = [c for c in docs.columns if c != "text" and c.lower() not in {x.lower() for x in names.results}]
    dealt = docs.select(
        *plain(keep), F.col("doc_id").cast("long").alias(names.id), F.encode("text", "UTF-8").alias(names.text),
        F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias(names.block),
    ).repartition(buckets, names.block)
    name = f"tessera_blocks_{uuid.uuid4().hex}"
    dealt.write.bucketBy(buckets, names.block).sortBy(names.block).option("path", scratch.path("blocks")).option("compression", "zstd").saveAsTable(name)
    try:
        table = spark.table(name)
        slim = table.select(names.block, names.id, names.text)
        keys = slim.groupBy(names.block).applyInArrow(_send_keys(names, parts), _ROW_SQL)
        bits = scratch.write(keys.groupBy("p").applyInArrow(_repeated, _ROW_SQL), "repeated")
        strings = slim.groupBy(names.block).cogroup(bits.groupBy("_b")).applyInArrow(_send_strings(names, parts), _ROW_SQL)
        answers = bits.unionByName(scratch.write(strings.groupBy("p").applyInArrow(_collapse, _ROW_SQL), "collapsed"))
        sent = slim.groupBy(names.block).cogroup(answers.groupBy("_b")).applyInArrow(_send_transforms(names, parts), _ROW_SQL)
        answers = answers.unionByName(scratch.write(sent.groupBy("p").applyInArrow(_merge_transforms, _ROW_SQL), "merged"))
        shape = table.select(*plain(keep)).schema
        for c, kind in zip(names.results, ("long", "long", "long", "binary", "string")):
            shape = shape.add(c, kind)
        out = table.groupBy(names.block).cogroup(answers.groupBy("_b")).applyInArrow(_cut(names, parts, to_arrow_schema(shape)), shape)
        return materialize(out if keep_text else out.drop(names.results[3]), "without-repeats")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch.close()


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs with their text less its repeats; what is left of a character cut in two is dropped too.

    Every row stays, with all its other columns as they are, but for n_chars, which follows the text.
    """
    prefix = free_prefix(docs.columns)
    kept = remove_repeats(docs, prefix=prefix)
    clean = F.pandas_udf(lambda s: s.map(lambda x: x.decode("utf-8", "ignore")), "string")
    own = {"text": F.when(F.col(f"{prefix}n_removed") > 0, clean(f"{prefix}kept")).otherwise(F.decode(f"{prefix}kept", "UTF-8"))}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length(own["text"]).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[own[c].alias(c) if c in own else plain([c])[0] for c in docs.columns])
