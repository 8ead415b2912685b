"""Word-piece counts by linear longest-match: a vocabulary trie with failure links and counts of popped tokens."""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pieces, span_sums, text_buffer
from tessera.llm.packing import _LETTERS

VOCABULARY = "byte_bpe_50k.json"
_NONE = -1


def byte_vocabulary(name: str = VOCABULARY) -> list[bytes]:
    """The tokens of a byte-level vocabulary as bytes, without its special tokens; a word's first token starts with a space."""
    import public_tokenizers

    with open(public_tokenizers.path(name)) as f:
        data = json.load(f)
    special = {t["content"] for t in data.get("added_tokens", [])}
    byte_of = {chr(v): k for k, v in _LETTERS.items()}
    return [bytes(byte_of[c] for c in t) for t in data["model"]["vocab"] if t not in special]


class LongestMatch:
    """Counts the pieces that greedy longest-match cuts a word into, in time linear in the word, without cutting it.

    Where a node has no edge for the next byte, its failure link leads on, and as many tokens as the link pops are
    counted. Edges are kept in an open hash table, so that many words take a step at once. A word that no tokens make
    up counts as one unknown piece.
    """

    def __init__(self, vocabulary: list[bytes]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for token in vocabulary:
            node = 0
            for c in token:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    final.append(False)
                node = nxt
            final[node] = node != 0
        fail, pops, todo = [_NONE] * len(children), [0] * len(children), deque([0])
        while todo:
            parent = todo.popleft()
            for c, node in children[parent].items():
                todo.append(node)
                if final[node]:
                    fail[node], pops[node] = 0, 1
                    continue
                at, count = fail[parent], pops[parent]
                while at != _NONE and c not in children[at]:
                    count += pops[at]
                    at = fail[at]
                if at != _NONE:
                    fail[node], pops[node] = children[at][c], count
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int32)
        keys = np.array([node << 8 | c for node, e in enumerate(children) for c in e], np.int64)
        nodes = np.array([n for e in children for n in e.values()], np.int32)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = (1 << bits) - 1
        self.keys, self.nodes = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 1
        while len(left):
            free = self.keys[slot[left]] == -1
            # of the keys that want one free slot, one gets it
            _, first = np.unique(slot[left[free]], return_index=True)
            won = left[free][first]
            self.keys[slot[won]], self.nodes[slot[won]] = keys[won], nodes[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).astype(np.int64) & self.mask

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Where the edges lead, -1 where there is none."""
        keys = nodes.astype(np.int64) << 8 | letters
        slot = self._slot(keys)
        out = np.full(len(keys), _NONE, np.int32)
        left = np.arange(len(keys))
        while len(left):
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.nodes[slot[left[hit]]]
            left = left[~hit & (found != -1)]
            slot[left] = (slot[left] + 1) & self.mask
        return out

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pieces of each word data[offsets[i]:offsets[i + 1]]; an empty word has none."""
        sizes = np.diff(offsets)
        out, node = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int32)
        live, at = np.flatnonzero(sizes > 0), 0
        unknown = np.zeros(len(sizes), bool)
        while len(live):
            letters = data[offsets[live] + at].astype(np.int64)
            open_ = np.arange(len(live))
            while len(open_):
                words = live[open_]
                nxt = self.step(node[words], letters[open_])
                going = nxt != _NONE
                node[words[going]] = nxt[going]
                stuck = words[~going]
                out[stuck] += self.pops[node[stuck]]
                node[stuck] = self.fail[node[stuck]]
                lost = node[stuck] == _NONE
                unknown[stuck[lost]] = True
                open_ = open_[~going][~lost]
            at += 1
            live = live[~unknown[live]]
            done = live[sizes[live] == at]
            while len(done):
                done = done[node[done] != 0]
                out[done] += self.pops[node[done]]
                node[done] = self.fail[node[done]]
                unknown[done[node[done] == _NONE]] = True
                done = done[node[done] != _NONE]
            live = live[sizes[live] > at]
        out[unknown] = 1
        return out


def count_tokens(docs: DataFrame, vocabulary: list[bytes] | None = None) -> DataFrame:
    """docs with _n_words and _n_tokens: words (runs without white space) and their greedy longest-match pieces.

    A word is matched with a space before it. The automaton grows with the vocabulary, not with the corpus; every
    distinct word of a batch is matched once. A null or empty text has no words; columns of the results' names are
    replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(LongestMatch(byte_vocabulary() if vocabulary is None else vocabulary))

    def run(batches):
        for batch in pieces(batches, "text"):
            texts = batch.column("text").fill_null("")
            split = pc.utf8_split_whitespace(texts)
            coded = split.flatten().dictionary_encode()
            words = pc.if_else(pc.equal(coded.dictionary, ""), "", pc.binary_join_element_wise("", coded.dictionary, " "))
            each = shared.value.count(*text_buffer(words))[coded.indices.to_numpy()]
            edges = split.offsets.to_numpy() - split.offsets[0].as_py()
            own = {"_n_words": pa.array(span_sums((each > 0).astype(np.int64), edges)), "_n_tokens": pa.array(span_sums(each, edges))}
            columns = {c: batch.column(c) for c in batch.schema.names} | own
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    zero = F.lit(0).cast("long")
    keep = docs.select(*[c for c in docs.columns if c not in ("_n_words", "_n_tokens")], zero.alias("_n_words"), zero.alias("_n_tokens"))
    return keep.mapInArrow(run, keep.schema)
