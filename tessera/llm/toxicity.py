"""Toxicity by Levenshtein automata over a lexicon trie, with context windows that tell quotation from abuse."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pieces, plain, text_buffer
from tessera.llm.quality import labelled_sample

SAMPLE_ROWS = 12_000
#: Terms that one automaton holds; a larger lexicon is several automata over one alphabet.
TERMS_EACH = 400
FUZZY_FROM = 5
CONTEXT = 24
THRESHOLD = 0.7
SYMBOLS = 0x3000
#: Letters that stand for others in disguised spelling.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "@": "a", "$": "s", "!": "i"}
#: Those that are marks as well: letters of a word, or its edge.
SIGNS = np.array([ord(c) for c in LOOKALIKES if not c.isalnum()], np.uint32)
#: Marks of quotation, as code points.
QUOTES = "\"'«»“”„‘’‹›`"
#: Words that report another's words.
REPORTING = ("said", "says", "called", "word", "term", "quote", "quoted", "wrote", "insult", "slur", "example")


class LexiconAutomaton:
    """The product of a trie of terms and the Levenshtein automata of their prefixes, determinised into a table.

    A state is the set of (trie node, edits used) that the letters so far can reach with the fewest edits; a word's
    last state says the fewest edits to a term: 0, 1 or none. Terms shorter than `fuzzy_from` match exactly.
    """

    def __init__(self, terms: list[str], edits: int = 1, fuzzy_from: int = FUZZY_FROM, letters: list[str] | None = None):
        self.terms = sorted(terms)
        children, allowed, final = [{}], [0], [False]
        for term in self.terms:
            node, limit = 0, edits if len(term) >= fuzzy_from else 0
            allowed[0] = max(allowed[0], limit)
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    allowed.append(0)
                    final.append(False)
                node = children[node][c]
                allowed[node] = max(allowed[node], limit)
            final[node] = True
        limit_of = {}
        for term in self.terms:
            node = 0
            for c in term:
                node = children[node][c]
            limit_of[node] = edits if len(term) >= fuzzy_from else 0

        def close(state: dict[int, int]) -> frozenset:
            """Skip letters of terms: a move down the trie for an edit each."""
            todo = list(state.items())
            while todo:
                node, used = todo.pop()
                for child in children[node].values():
                    if used + 1 <= allowed[child] and used + 1 < state.get(child, 99):
                        state[child] = used + 1
                        todo.append((child, used + 1))
            return frozenset(state.items())

        letters = letters or sorted({c for t in self.terms for c in t})
        self.symbol = {c: i + 2 for i, c in enumerate(letters)}
        width = len(letters) + 2
        start = close({0: 0})
        number, rows, best, order = {frozenset(): 0, start: 1}, [[0] * width], [9], [start]
        while order:
            state = order.pop(0)
            row = [0] * width
            edges = {c for node, _ in state for c in children[node]}
            for s in range(1, width):
                letter = letters[s - 2] if s > 1 else None
                if letter not in edges and s > 1 and row[1] is not None:
                    row[s] = row[1]
                    continue
                after: dict[int, int] = {}
                for node, used in state:
                    moves = [(child, used + (c != letter)) for c, child in children[node].items()] + [(node, used + 1)]
                    for child, cost in moves:
                        if cost <= allowed[child] and cost < after.get(child, 99):
                            after[child] = cost
                key = close(after)
                if key not in number:
                    number[key] = len(number)
                    order.append(key)
                row[s] = number[key]
            rows.append(row)
            ends = [used for node, used in state if final[node] and used <= limit_of[node]]
            best.append(min(ends, default=9))
        self.table = np.array(rows, np.int32)
        self.best = np.array(best, np.int8)
        self.longest = max((len(t) for t in self.terms), default=0) + edits

    def symbol_of(self, c: str) -> int:
        """0 ends a word, 1 is a letter that no term has."""
        return self.symbol.get(LOOKALIKES.get(c, c), 1) if c.isalnum() or c in LOOKALIKES else 0

    def classes(self) -> np.ndarray:
        """Symbol of each code point below SYMBOLS; those beyond are looked up as they come."""
        return np.array([self.symbol_of(chr(c)) for c in range(SYMBOLS)], np.int32)

    def distance(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Fewest edits from each word to a term, 9 if more than allowed; all words step together."""
        out = np.full(len(starts), 9, np.int8)
        live = np.flatnonzero(lengths <= self.longest)
        state = np.ones(len(live), np.int32)
        step = 0
        while len(live):
            state = self.table[state, symbols[starts[live] + step]]
            step += 1
            over = (lengths[live] == step) & (state > 0)
            out[live[over]] = self.best[state[over]]
            on = (state > 0) & (lengths[live] > step)
            live, state = live[on], state[on]
        return out

    def readings(self, symbols: np.ndarray, starts: np.ndarray, stops: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, end, edits) of every reading near a term: from one of `starts` to a marked end up to its stop."""
        at, first, state = starts, starts, np.ones(len(starts), np.int32)
        found = [(starts[:0], starts[:0], np.zeros(0, np.int8))]
        while len(at):
            state = self.table[state, symbols[at]]
            at = at + 1
            over = ends[at] & (self.best[state] < 9)
            found.append((first[over], at[over], self.best[state[over]]))
            on = (state > 0) & (at < stops)
            at, first, state, stops = at[on], first[on], state[on], stops[on]
        return tuple(np.concatenate(x) for x in zip(*found))


def lowered(text: str) -> str:
    return text.lower()


class Lexicon:
    """The automata of any number of terms, TERMS_EACH in each."""

    def __init__(self, terms: list[str]):
        self.terms, letters = sorted(terms), sorted({c for t in terms for c in t})
        self.parts = [LexiconAutomaton(self.terms[i : i + TERMS_EACH], letters=letters) for i in range(0, max(1, len(terms)), TERMS_EACH)]
        self.symbol_of, self.classes = self.parts[0].symbol_of, self.parts[0].classes

    def distance(self, *words) -> np.ndarray:
        """Fewest edits from each word to any term, 9 if more than allowed."""
        return np.minimum.reduce([part.distance(*words) for part in self.parts])

    def readings(self, *words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*(part.readings(*words) for part in self.parts)))


def learn_terms(texts: list[str], marks: np.ndarray) -> list[str]:
    """Words that toxic documents have far more often than others, short ones too; the most telling first.

    A term is in 0.2 % of the toxic documents of the sample at least, so their number is bounded by the sample's words.
    """
    import re

    split, n = re.compile(r"[^\W_]+"), [0, 0]
    seen = (Counter(), Counter())
    for text, mark in zip(texts, marks.tolist()):
        n[mark] += 1
        seen[mark].update({w for w in split.findall(lowered(text)) if not w.isdigit()})
    found = []
    for word, hits in seen[1].items():
        odds = (hits + 0.5) / (n[1] + 1) / ((seen[0][word] + 0.5) / (n[0] + 1))
        if hits >= max(3, 0.002 * n[1]) and odds >= 12:
            found.append((-hits * np.log(odds), word))
    return [w for _, w in sorted(found)]


class Scorer:
    """Counts of exact and misspelled terms, abusive or quoted, and a logistic score of them."""

    def __init__(self, terms: list[str]):
        self.automaton = Lexicon(terms)
        self.symbols = self.automaton.classes()
        self.weights = np.zeros(7)

    def features(self, texts: list[str]) -> np.ndarray:
        texts = [lowered(x) for x in texts]
        sizes = np.array([len(x) for x in texts], np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes + 1)])
        points = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbols[np.minimum(points, SYMBOLS - 1)]
        beyond = points >= SYMBOLS
        if beyond.any():
            few, which = np.unique(points[beyond], return_inverse=True)
            symbols[beyond] = np.array([self.automaton.symbol_of(chr(c)) for c in few.tolist()], np.int32)[which]
        inside = symbols > 0
        change = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        starts, lengths = change[::2], change[1::2] - change[::2]
        signs = np.isin(points, SIGNS)
        before = np.concatenate([[0], np.cumsum(signs)])
        marks = before[starts + lengths] - before[starts]
        # signs alone are no word
        words = np.bincount(np.searchsorted(edges, starts[marks < lengths], "right") - 1, minlength=len(texts))
        out = np.zeros((len(texts), 6))
        if not self.automaton.terms:
            return out
        plain, marked = marks == 0, marks > 0
        edits = self.automaton.distance(symbols, starts[plain], lengths[plain])
        hit = edits < 9
        first, end = starts[plain][hit], (starts + lengths)[plain][hit]
        hits = [*zip(first.tolist(), end.tolist(), edits[hit].tolist()), *self._marked(symbols, signs, starts[marked], lengths[marked])]
        doc = np.searchsorted(edges, [a for a, _, _ in hits], "right") - 1
        for d, (a, b, used) in zip(doc.tolist(), hits):
            own, lo, hi = texts[d], a - int(edges[d]), b - int(edges[d])
            quoted = _quoted(own, lo, hi)
            out[d, (2 if quoted else 0) + int(used > 0)] += 1
        share = (out[:, 0] + 0.5 * out[:, 1]) / np.maximum(words[: len(texts)], 1)
        out[:, 4] = np.minimum(1, 20 * share)
        out[:, 5] = (out[:, 0] > 0) | (out[:, 1] > 1)
        out[:, :4] = np.log1p(out[:, :4])
        return out

    def _marked(self, symbols: np.ndarray, signs: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
        """Terms in words with signs, where a reading may begin and end at any sign, with it or without it.

        Of readings that overlap, those with the fewest edits count, the longest first.
        """
        each = np.repeat(np.arange(len(starts)), lengths)
        at = np.arange(len(each)) + (starts - np.cumsum(lengths) + lengths)[each]
        begins = (at == starts[each]) | signs[at] | signs[at - 1]
        stops = (starts + lengths)[each]
        ends = np.zeros(len(symbols) + 1, bool)
        ends[at[signs[at]]] = ends[at[signs[at]] + 1] = ends[stops] = True
        found = self.automaton.readings(symbols, at[begins], stops[begins], ends)
        hits, taken = [], {}
        for a, b, used in sorted(zip(*(x.tolist() for x in found)), key=lambda x: (x[2], x[0] - x[1], x[0])):
            others = taken.setdefault(int(np.searchsorted(starts, a, "right")), [])
            if all(b <= x or y <= a for x, y in others):
                others.append((a, b))
                hits.append((a, b, used))
        return hits

    def fit(self, texts: list[str], marks: np.ndarray, steps: int = 40, ridge: float = 1e-2) -> Scorer:
        """Newton steps of a ridge logistic regression."""
        x = np.concatenate([np.concatenate([self.features(texts[i : i + 200]) for i in range(0, len(texts), 200)]), np.ones((len(texts), 1))], 1)
        w = np.zeros(x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            w -= np.linalg.solve(hess, x.T @ (p - marks) + ridge * w)
        self.weights = w
        return self

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.features(texts) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _quoted(text: str, lo: int, hi: int) -> bool:
    """Whether marks of quotation stand on both sides in the window, or a reporting word with a mark on one."""
    left, right = text[max(0, lo - CONTEXT) : lo], text[hi : hi + CONTEXT]
    before, after = any(c in QUOTES for c in left), any(c in QUOTES for c in right)
    if before and after:
        return True
    return (before or after) and any(w in left or w in right for w in REPORTING)


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Scorer:
    """A scorer learned from a bounded sample of labelled documents; without any, every score is 0.5."""
    texts, marks = labelled_sample(docs, labels, label, F.lit(True) if usable is None else usable, rows)
    texts = [x.decode("utf-8", "replace") for x in texts]
    scorer = Scorer(learn_terms(texts, marks))
    return scorer.fit(texts, marks) if len(marks) else scorer


def score_toxicity(docs: DataFrame, scorer: Scorer, name: str = "_score") -> DataFrame:
    """docs with `name`, the probability of label 1 by the whole text; a null text is scored as an empty one.

    What is sent to tasks is bounded by the sample that the scorer learned from, whatever the corpus. A column of docs
    named like the score is replaced, all others are kept; repeated rows each have their score, no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for batch in pieces(batches, "text", 1 << 20):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            columns = {c: batch.column(c) for c in batch.schema.names} | {name: pa.array(shared.value.score(texts))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    keep = docs.select(*plain([c for c in docs.columns if c.lower() != name.lower()]), F.lit(0.0).alias(name))
    return keep.mapInArrow(run, keep.schema)


__all__ = ["LexiconAutomaton", "Scorer", "fit_toxicity", "score_toxicity", "text_buffer"]
