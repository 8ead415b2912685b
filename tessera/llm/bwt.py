"""Burrows-Wheeler transforms of string collections, and their merge by interleave refinement, in numpy."""

from __future__ import annotations

import numpy as np

#: Symbols are bytes plus one; this one ends a string.
END = 0
_PACK = 7


def suffix_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of the strings: string number, offset and the symbol before each (END before a whole string).

    Every string ends in END; suffixes alike up to their END are in the order of their strings. Sorted by prefixes
    of 7 symbols, then by doubling them.
    """
    lengths = np.array([len(s) for s in strings], np.int64)
    owner = np.repeat(np.arange(len(strings)), lengths + 1)
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    n = int(first[-1])
    offset = np.arange(n) - first[owner]
    left = lengths[owner] - offset
    symbol = np.zeros(n, np.int64)
    symbol[left > 0] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
    padded = np.concatenate([symbol, np.zeros(_PACK, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(_PACK):
        key = (key << 9) | np.where(left > k, padded[k : k + n], 0)
    span, longest = _PACK, int(lengths.max()) if n else 0
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]) if n else np.zeros(0, np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = new
        if span > longest:
            break
        ahead = np.minimum(np.arange(n) + span, max(n - 1, 0))
        key = rank * (n + 1) + np.where(left >= span, rank[ahead] + 1, 0)
        span *= 2
    order = np.argsort(rank * n + np.arange(n))
    before = np.where(offset > 0, symbol[np.arange(n) - 1], END) if n else symbol
    return owner[order], offset[order], before[order].astype(np.uint16)


def last_to_first(symbols: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """For each row of concatenated transforms, the row of the suffix that is one symbol longer, in the same shard."""
    by_symbol = np.argsort(symbols, kind="stable")
    order = by_symbol[np.argsort(shard[by_symbol], kind="stable")]
    out = np.empty(len(symbols), np.int64)
    out[order] = np.arange(len(symbols))
    return out


def walk(symbols: np.ndarray, lf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String and offset of each row, from the rows of the strings' ENDs (`ends`), by walking all strings at once."""
    owner, left = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
    length = np.zeros(len(ends), np.int64)
    at, string, step = ends.copy(), np.arange(len(ends)), 0
    while len(at):
        owner[at], left[at] = string, step
        length[string] = step
        on = symbols[at] != END
        at, string = lf[at[on]], string[on]
        step += 1
    return owner, length[owner] - left


def merge(symbols: np.ndarray, shard: np.ndarray, lf: np.ndarray, depth: int, alone: np.ndarray, rows: np.ndarray | None = None):
    """Rows whose next `depth` symbols also start elsewhere, and the repeated interval that each belongs to.

    The interleave of the shards' rows is refined symbol by symbol: from the order by h symbols, a stable sort by the
    symbol before each suffix gives the order by h + 1 symbols, as each transform keeps its own rows in order. Two
    neighbours part in the round that gives their common prefix; rows that are alone in their interval (and marked
    `alone`) stay alone when they are extended, so they take no further part, and neither do rows that reach an END.
    Where only some `rows` are asked for, the others are left out of intervals and counts from the start.
    Returns (rows, interval of each, common prefix with the row before, at most `depth`).
    """
    rows = np.arange(len(symbols)) if rows is None else rows
    block, common = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for h in range(depth):
        before = symbols[rows]
        on = before != END
        rows, block, before, common = rows[on], block[on], before[on], common[on]
        order = np.argsort(before, kind="stable")
        before, rows, old = before[order], lf[rows[order]], block[order]
        parts = np.ones(len(rows), bool)
        parts[1:] = (before[1:] != before[:-1]) | (old[1:] != old[:-1])
        block = np.cumsum(parts) - 1
        common = np.where(parts, h, h + 1)
        keep = (np.bincount(block, minlength=1)[block] > 1) | ~alone[rows]
        rows, block, common = rows[keep], block[keep], common[keep]
        if not len(rows):
            break
    return rows, block, common
