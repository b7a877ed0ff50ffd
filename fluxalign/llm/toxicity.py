"""Toxicity: Levenshtein automata over a lexicon trie, with context-window scores.

The lexicon is learned from labelled documents: whole words and word beginnings whose documents
are nearly all labelled toxic. A word is matched by running its Levenshtein automaton (one edit)
along the trie of the lexicon, so misspelled terms are found without trying all terms; a variant
that clean training documents use is a word of its own and doesn't count. Word beginnings count
without an edit only. A match counts less in the context of quotation (quote
marks around it, or a word of reporting within the window) and more next to an address.

A document's evidence (sums of its match weights, in total and per word) goes through a
logistic function, also fitted on the labelled documents. Training reads at most
``most_rows`` labelled documents, those with the least hash of their id; that bound is the only
one. Every text is scored whole.

Defined cases: null and empty texts get the score of a text without matches; without any
training rows, or without toxic ones, all scores are 0; repeated labels of a document count as
one, toxic if any says so; a null doc_id is scored as any other (its crc32 is that of the empty
string); repeated rows are scored one by one; extra columns are ignored or carried along.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

WORD = re.compile(r"[^\W_]+")
STEM = range(4, 8)
LEAST_FUZZY, REMEMBERED, MISSPELLED = 5, 300_000, 0.7
#: Terms that a lexicon may have; it is sent to all machines.
MOST_TERMS = 1 << 18
#: Fixed words of the context: reporting somebody's words, and addressing somebody.
REPORTING = frozenset("said says wrote quote quoted quotes called claims reported according dit sagte schrieb dijo escribió".split())
ADDRESS = frozenset("you your youre tu vous du ihr tú usted".split())
QUOTES = "\"“”«»„"
WINDOW = 5


class Lexicon:
    """Trie of words and word beginnings; matches within one edit by a Levenshtein automaton."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]) -> None:
        self.words, self.stems = words, stems
        self.root: dict = {}
        for kind, terms in (("word", words), ("stem", stems)):
            for term, weight in terms.items():
                node = self.root
                for c in term:
                    node = node.setdefault(c, {})
                node[kind] = weight
        fuzzy = [w for w in words if len(w) >= LEAST_FUZZY]
        # One edit leaves the first two characters or the last two as they are.
        self.starts, self.ends = {w[:2] for w in fuzzy}, {w[-2:] for w in fuzzy}
        self.sizes = {n + d for n in map(len, fuzzy) for d in (-1, 0, 1)}
        # Words at one edit share a word or a word less one character.
        self.shorter = {x for w in fuzzy for x in (w, *(w[:i] + w[i + 1 :] for i in range(len(w))))}

    def exact(self, word: str) -> float:
        node, best = self.root, 0.0
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            best = max(best, node.get("stem", 0.0))
        return max(best, node.get("word", 0.0))

    def near(self, word: str) -> float:
        """Weight of a term of at least LEAST_FUZZY letters at one edit from the word."""
        if len(word) not in self.sizes or word[:2] not in self.starts and word[-2:] not in self.ends:
            return 0.0
        n, shorter = len(word), self.shorter
        if word not in shorter and not any(word[:i] + word[i + 1 :] in shorter for i in range(n)):
            return 0.0
        # A state is (characters of the word read, edits); all states of a node move together.
        stack, best = [(self.root, 0, ((0, 0), (1, 1)))], 0.0
        while stack:
            node, depth, states = stack.pop()
            if depth >= LEAST_FUZZY and "word" in node and any(n - i + e <= 1 for i, e in states):
                best = max(best, node["word"])
            for c, child in node.items():
                if len(c) > 1:
                    continue
                moved = set()
                for i, e in states:
                    if i < n and word[i] == c:
                        moved.add((i + 1, e))
                    elif e == 0:
                        moved |= {(i, 1), (i + 1, 1)} if i < n else {(i, 1)}
                        if i + 1 < n and word[i + 1] == c:
                            moved.add((i + 2, 1))
                if moved:
                    stack.append((child, depth + 1, tuple(moved)))
        return best


@dataclass
class ToxicityModel:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    innocent: frozenset[str] = frozenset()
    weights: tuple[float, ...] = (-40.0, 0.0, 0.0)


class Scorer:
    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.lexicon = model, Lexicon(model.words, model.stems)
        self.known: dict[str, tuple[float, float]] = {}

    def _look(self, word: str) -> tuple[float, float]:
        hit = self.known.get(word)
        if hit is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            whole = self.lexicon.exact(word)
            hit = self.known[word] = (whole, 0.0 if whole or word in self.model.innocent else self.lexicon.near(word))
        return hit

    def features(self, text: str) -> tuple[float, float]:
        """Evidence of all matches, misspelled ones for MISSPELLED of their weight, and per 100 words."""
        words = WORD.findall(text.lower())
        look = self._look
        hits = [(i, h) for i, h in enumerate(map(look, words)) if h[0] or h[1]]
        if not hits:
            return 0.0, 0.0
        quoted = self._quoted(text, {i for i, _ in hits}) if any(q in text for q in QUOTES) else set()
        total = 0.0
        for i, (whole, part) in hits:
            around = words[max(0, i - WINDOW) : i + WINDOW + 1]
            factor = 0.3 if i in quoted or not REPORTING.isdisjoint(around) else 1.25 if not ADDRESS.isdisjoint(around) else 1.0
            total += factor * (whole + MISSPELLED * part)
        return float(np.log1p(total)), float(np.log1p(100 * total / len(words)))

    @staticmethod
    def _quoted(text: str, wanted: set[int]) -> set[int]:
        """Which words stand between quote marks; a mark closes the one before it on its line."""
        spans = [m.span() for m in re.finditer(f"[{QUOTES}][^{QUOTES}\n]+[{QUOTES}]", text)]
        out, s = set(), 0
        for i, m in enumerate(WORD.finditer(text.lower())):
            while s < len(spans) and spans[s][1] <= m.start():
                s += 1
            if s == len(spans):
                break
            if i in wanted and spans[s][0] < m.start():
                out.add(i)
        return out

    def score(self, text: str) -> float:
        x = np.array([1.0, *self.features(text)])
        return float(1 / (1 + np.exp(-np.clip(x @ np.array(self.model.weights), -40, 40))))


def remainder(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.01] + [0.1] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge @ w)
    return tuple(float(v) for v in w)


def _terms(counts: list, least: int, precision: float) -> tuple[dict, dict]:
    """Whole words and the shortest beginnings whose documents are nearly all toxic."""
    words, stems = {}, {}
    for r in sorted(counts, key=lambda r: (len(r.term), r.term)):
        pure = r.toxic / (r.toxic + r.clean)
        if r.toxic < least or pure < precision:
            continue
        if r.whole:
            words[r.term] = pure
        elif not any(r.term[:k] in stems for k in range(1, len(r.term))):
            stems[r.term] = pure
    return words, stems


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_rows: int = 8000, least: int = 5, precision: float = 0.8) -> ToxicityModel:
    """Learn from labelled rows whose remainder isn't 0, at most ``most_rows`` of them."""
    small_batches(spark)
    chosen = labels.where((remainder() != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    sample = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORD.findall(text.lower()))
                found[toxic > 0].update({(w, True) for w in words} | {(w[:k], False) for w in words for k in STEM if len(w) > k})
        for toxic in (0, 1):
            items = found[toxic].items()
            if items:
                yield pa.RecordBatch.from_arrays([pa.array([t for (t, _), _ in items]), pa.array([w for (_, w), _ in items]), pa.array([n if toxic else 0 for _, n in items]), pa.array([0 if toxic else n for _, n in items])], ["term", "whole", "toxic", "clean"])

    counts = sample.mapInArrow(count, "term string, whole boolean, toxic long, clean long").groupBy("term", "whole").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = counts.where((F.col("toxic") >= least) & (F.col("toxic") >= precision * (F.col("toxic") + F.col("clean"))))
    terms = counts.limit(MOST_TERMS + 1).collect()
    if len(terms) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms mark toxic texts; raise least or precision")
    words, stems = _terms(terms, least, precision)
    lexicon = Lexicon(words, stems)

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {w for t in batch.column(0).to_pylist() for w in WORD.findall(t.lower())}
            yield pa.RecordBatch.from_arrays([pa.array([w for w in seen if not lexicon.exact(w) and lexicon.near(w)], pa.string())], ["word"])

    innocent = frozenset(r.word for r in sample.where("toxic <= 0").mapInArrow(variants, "word string").distinct().collect())
    scorer = Scorer(ToxicityModel(words, stems, innocent))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scorer.features(t) for t in batch.column(0).to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in zip(*rows)), batch.column(1)], ["a", "b", "toxic"])

    seen = sample.mapInArrow(featurize, "a double, b double, toxic int").groupBy("a", "b", "toxic").count().collect()
    if not any(r.toxic > 0 for r in seen):
        return ToxicityModel()
    x = np.repeat(np.array([[r.a, r.b] for r in seen]), [r["count"] for r in seen], axis=0)
    y = np.repeat(np.array([float(r.toxic > 0) for r in seen]), [r["count"] for r in seen])
    return ToxicityModel(words, stems, innocent, _fit(x, y))


_scorers: dict[str, Scorer] = {}


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id if not given), then held_out, score, predicted. No shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    shared, name = spark.sparkContext.broadcast(model), repr((model.words, model.stems, sorted(model.innocent), model.weights))
    keep = ["doc_id"] if keep is None else keep
    frame = docs.select(*keep, (remainder() == 0).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_scored"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(shared.value)
        scorer = _scorers[name]
        for batch in batches:
            scores = [scorer.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [*batch.schema.names[:-1], "score", "predicted"])

    return frame.mapInArrow(run, frame.drop("_scored").schema.add("score", "double").add("predicted", "integer"))
