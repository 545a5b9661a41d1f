"""Toxicity scores from a learned lexicon, a Levenshtein automaton and context windows.

The lexicon is learned from labelled documents: words, and word beginnings
with many endings, that toxic documents hold far more often than others.  Its
trie is intersected with Levenshtein automata: a state is the set of
(trie node, errors) that a read prefix can be in, and transitions are made
when first needed and kept, so each distinct word runs through a growing
deterministic automaton.  Longer terms allow more errors.

Every hit is read in a window of words: inside quotation marks it counts as a
quotation, other hits near it count as abuse.  A logistic regression over the
counts of a document gives the score.

``FIT_TOXIC`` and ``FIT_OTHER`` bound the labelled rows that the lexicon and
the regression are fitted on; scoring is one pass over whole texts without a
shuffle.  Defined results: a null or empty text has no hits and gets the
score of that; without labelled rows of both classes every score is 0;
a null doc_id is scored like any other, never learned from; repeated rows
give repeated rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.workers import trimmed
from tokenmill.llm.common import cut, table
from tokenmill.llm.labelled import held_out, sample
from tokenmill.llm.registry import query
from tokenmill.llm.words import keep_in_worker, pieces, ragged, word_bounds

FIT_TOXIC = 6_000
FIT_OTHER = 12_000
SHORTEST, LONGEST = 3, 12
#: A term is in at least this share of the toxic documents, and this much more often than in others.
LEAST_SHARE, LEAST_ODDS = 0.01, 30.0
#: Terms that are only this much more often in toxic documents are hints: no errors, and their count tells.
HINT_ODDS = 5.0
WINDOW = 8
CACHE_WORDS = 300_000
OPENING, CLOSING = "\"'“„«‘‚‹", "\"'”“»’‘›"
FEATURES = 8


def bare(word: str) -> str:
    """Lower case, without marks at the ends."""
    word = word.lower()
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def split_words(texts) -> Iterator[tuple[int, pa.DictionaryArray, np.ndarray]]:
    """Yield ``(first row, dictionary-coded words, first word of each row and the end)``."""
    for row, _, data, offsets in pieces(texts, operator="automata"):
        starts, ends, first = word_bounds(data, offsets)
        lengths = ends - starts
        bounds = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(lengths, out=bounds[1:])
        flat = np.ascontiguousarray(data[ragged(starts, lengths)]) if len(starts) else data[:0]
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(flat)])
        yield row, words.dictionary_encode(), first


# --- lexicon ------------------------------------------------------------------


def _terms(words: list[str], prefixes: dict[str, tuple[str, ...]]) -> set[str]:
    """Whole words, and word beginnings marked with ``*``."""
    out = set()
    for raw in words:
        got = prefixes.get(raw)
        if got is None:
            w = bare(raw)
            got = (w, *(w[:k] + "*" for k in range(SHORTEST, min(len(w), LONGEST) + 1))) if len(w) >= SHORTEST else ()
            prefixes[raw] = got
        out.update(got)
    return out


def _document_frequencies(docs: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """(term, n) over the documents; each batch is summed before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            prefixes: dict[str, tuple[str, ...]] = {}
            for _, coded, first in split_words(batch.column("text")):
                names = coded.dictionary.to_pylist()
                codes = coded.indices.to_numpy(zero_copy_only=False)
                for i in range(len(first) - 1):
                    found = _terms([names[c] for c in np.unique(codes[first[i] : first[i + 1]])], prefixes)
                    counts.update(found if wanted is None else found & wanted)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"]
            )

    return docs.select("text").mapInArrow(trimmed(work), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def choose_terms(
    toxic: dict[str, int], other: dict[str, int], n_toxic: int, n_other: int, odds: float = LEAST_ODDS
) -> list[str]:
    """Words and beginnings to look for.

    From the shortest telling beginning, go on while one longer beginning
    holds most of its documents or a few hold nearly all; a beginning with
    many endings is a term itself.
    """

    def telling(term: str) -> bool:
        rate, base = (toxic[term] + 0.5) / (n_toxic + 1), (other.get(term, 0) + 0.5) / (n_other + 1)
        return toxic[term] >= max(3, LEAST_SHARE * n_toxic) and rate >= odds * base

    good = {t for t in toxic if telling(t)}
    below: dict[str, list[str]] = {}
    for t in good:
        if t.endswith("*") and len(t) > SHORTEST + 1:
            below.setdefault(t[:-2] + "*", []).append(t)
    out: set[str] = set()
    stack = [t for t in good if t.endswith("*") and t[:-2] + "*" not in good]
    while stack:
        t = stack.pop()
        n, word = toxic[t], t[:-1]
        if word in good and toxic[word] >= 0.8 * n:
            out.add(word)
            continue
        large = [c for c in below.get(t, []) if toxic[c] >= 0.15 * n]
        if large and len(large) <= 3 and sum(toxic[c] for c in large) >= 0.9 * n:
            stack += large
        else:
            out.add(t if len(word) > SHORTEST or word not in good else word)
    return sorted(out)


# --- automaton ----------------------------------------------------------------


def allowed(term: str) -> int:
    """Errors that a term forgives, by its length."""
    n = len(term.rstrip("*"))
    return 0 if n < 5 or (term.endswith("*") and n < 6) else 1 if n < 9 else 2


class Automaton:
    """The lexicon's trie under Levenshtein automata, made deterministic as words are read."""

    def __init__(self, terms: list[str], errors: bool = True):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]  # errors forgiven at the end of a whole word
        self.begin: list[int] = [-1]  # the same for a beginning
        self.limit: list[int] = [0]  # most errors of any term below
        for term in terms:
            node, k = 0, allowed(term) if errors else 0
            self.limit[0] = max(self.limit[0], k)
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                    self.begin.append(-1)
                    self.limit.append(0)
                node = self.children[node][c]
                self.limit[node] = max(self.limit[node], k)
            kind = self.begin if term.endswith("*") else self.word
            kind[node] = max(kind[node], k)
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[int] = []  # errors of a beginning that ends here, or -1
        self.ended: list[int] = []  # errors of a whole word that ends here, or -1
        self.start = self._state({0: 0})

    def _state(self, best: dict[int, int]) -> int:
        todo = list(best)
        while todo:  # skipped letters of the term
            node = todo.pop()
            for child in self.children[node].values():
                e = best[node] + 1
                if e <= self.limit[child] and e < best.get(child, 99):
                    best[child] = e
                    todo.append(child)
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.found.append(min((e for n, e in key if e <= self.begin[n]), default=-1))
            self.ended.append(min((e for n, e in key if e <= self.word[n]), default=-1))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        best: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.limit[node] and e < best.get(node, 99):
                best[node] = e

        for node, e in self.states[state]:
            put(node, e + 1)  # an added letter
            for other, child in self.children[node].items():
                put(child, e + (other != c))
        got = self.steps[state][c] = self._state(best) if best else -1
        return got

    def errors(self, word: str) -> int:
        """Least errors with which a term matches the word, or -1."""
        state, least = self.start, 99
        for c in word:
            nxt = self.steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state < 0:
                break
            if 0 <= self.found[state] < least:
                least = self.found[state]
        else:
            if 0 <= self.ended[state] < least:
                least = self.ended[state]
        return -1 if least == 99 else least


# --- scores -------------------------------------------------------------------


@dataclass
class ToxicityModel:
    terms: list[str]
    hints: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    fitted: bool = False

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -500, 500)))


_AUTOMATA: dict[tuple, tuple[Automaton, Automaton, dict[str, int]]] = keep_in_worker("automata", {})


def _automata(terms: list[str], hints: list[str]) -> tuple[Automaton, Automaton, dict[str, int]]:
    """One pair of automata and one word cache per worker and lexicon."""
    key = (tuple(terms), tuple(hints))
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = (Automaton(terms), Automaton(hints, errors=False), {})
    return _AUTOMATA[key]


def _word_flags(word: str, automaton: Automaton, hints: Automaton) -> int:
    """1: exact hit, 2: misspelled hit, 4: opens a quotation, 8: closes one, 16: hint."""
    flags = 0
    plain = bare(word)
    if len(plain) >= SHORTEST - 1:
        e = automaton.errors(plain)
        flags = 0 if e < 0 else 1 if e == 0 else 2
        if not flags and hints.errors(plain) == 0:
            flags = 16
    head, tail = word[:1], word.rstrip(".,;:!?)")[-1:]
    return flags | (4 if head in OPENING and head else 0) | (8 if tail in CLOSING and tail and len(word) > 1 else 0)


def features(texts, terms: list[str], hint_terms: list[str]) -> np.ndarray:
    """Per text: any hit, plain, misspelled and quoted hits, most hits in a window, hits per word, hints and hints per word."""
    automaton, hints, cache = _automata(terms, hint_terms)
    out = []
    for _, coded, first in split_words(texts):
        names = coded.dictionary.to_pylist()
        if len(cache) + len(names) > CACHE_WORDS:
            cache.clear()
        flags = np.zeros(len(names), np.int8)
        for i, name in enumerate(names):
            got = cache.get(name)
            if got is None:
                got = cache[name] = _word_flags(name, automaton, hints)
            flags[i] = got
        marks = flags[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else flags
        sums = [np.concatenate([[0], np.cumsum((marks & bit) > 0)]) for bit in (3, 4, 8)]
        hits = np.flatnonzero(marks & 3)
        doc = np.searchsorted(first, hits, side="right") - 1
        lo, hi = np.maximum(hits - WINDOW, first[doc]), np.minimum(hits + WINDOW + 1, first[doc + 1])
        near = sums[0][hi] - sums[0][lo]
        quoted = (sums[1][hits + 1] - sums[1][lo] > sums[2][hits] - sums[2][lo]) & (sums[2][hi] > sums[2][hits])
        rows = len(first) - 1
        exact = (marks[hits] & 1) > 0
        x = np.zeros((rows, FEATURES))
        plain = np.bincount(doc[exact & ~quoted], minlength=rows)
        wrong = np.bincount(doc[~exact & ~quoted], minlength=rows)
        x[:, 0] = plain + wrong > 0
        x[:, 1], x[:, 2] = np.log1p(plain), np.log1p(wrong)
        x[:, 3] = np.log1p(np.bincount(doc[quoted], minlength=rows))
        most = np.zeros(rows)
        np.maximum.at(most, doc[~quoted], near[~quoted])
        x[:, 4] = np.log1p(most)
        x[:, 5] = np.minimum(1, 20 * (plain + wrong) / np.maximum(1, np.diff(first)))
        words = np.diff(first)
        hinted = np.diff(np.concatenate([[0], np.cumsum((marks & 16) > 0)])[first])
        x[:, 6], x[:, 7] = np.log1p(hinted), np.minimum(1, 20 * hinted / np.maximum(10, words))
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, FEATURES))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Newton's method with classes weighed alike."""
    z = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (share * (p - y)) + ridge * w
        curve = (z * (share * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, toxic: int = FIT_TOXIC, other: int = FIT_OTHER) -> ToxicityModel:
    rows = cut(sample(docs, labels, "toxic", {1: toxic, 0: other}))
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return ToxicityModel([])
    least = max(3, math.floor(LEAST_SHARE * n[1]))
    common = _document_frequencies(rows.where("y = 1"), None).where(F.col("n") >= least)
    in_toxic = {r.term: r.n for r in common.collect()}
    in_other = {
        r.term: r.n for r in _document_frequencies(rows.where("y = 0"), frozenset(in_toxic)).collect()
    }
    terms = choose_terms(in_toxic, in_other, n[1], n[0])
    hints = sorted(set(choose_terms(in_toxic, in_other, n[1], n[0], HINT_ODDS)) - set(terms))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"), terms, hints)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "x"])

    got = rows.select("text", "y").mapInArrow(trimmed(work), "y int, x array<double>").collect()
    x, y = np.array([r.x for r in got], float), np.array([r.y for r in got])
    return ToxicityModel(terms, hints, logistic(x, y), True)


def score_toxicity(docs: DataFrame, model: ToxicityModel, column: str = "toxicity") -> DataFrame:
    """``docs`` with the score in ``column``, from ``text``."""
    kept = [c for c in docs.columns if c != column]
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes if c != column] + [f"`{column}` double"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(features(batch.column("text"), model.terms, model.hints))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score)], [*kept, column])

    return docs.select(*kept).mapInArrow(trimmed(work), schema)


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, "score").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
