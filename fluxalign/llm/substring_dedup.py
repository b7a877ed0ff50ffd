"""Substring dedup on words: suffix automata of reference shards give matching statistics.

The reference of a corpus that is deduplicated against itself is the corpus, which has no size
bound and so can't be broadcast whole. It is therefore cut into shards by the minimizer of
each window (windows.py): a shard holds every different run of words that can contain one of
its windows, and its automaton stands in the task to which those runs are sent. Each run is
streamed through its shard's automaton; where the matching statistic reaches ``min_words``, the
first place of the automaton's state tells whether the window also starts earlier.

Runs are told apart by two independent 64-bit hashes (of the minimizer and of the content).

Defined cases: null or empty text has no words; rows with the same doc_id and text are one place
(neither removes the other, and what is removed in one is removed in all); rows with the same
doc_id, or none, and different texts are different documents, ordered by a hash of the text; a
null doc_id comes before all others; texts with fewer words than a window are kept; extra
columns are ignored (the result has its own columns only).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import by_document, doc_ids, record, small_batches, texts
from .repeats import DOCUMENT, Spec, marked_starts, marks
from .windows import covered


class SuffixAutomaton:
    """Automaton of several sequences; every state knows the end of its first occurrence."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.depth, self.first = [-1], [0], [-1]
        self.size = 0

    def _state(self, moves: dict, link: int, depth: int, first: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.depth.append(depth)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, symbol: bytes, q: int) -> int:
        """A copy of q for its suffixes that p's move reaches."""
        clone = self._state(dict(self.next[q]), self.link[q], self.depth[p] + 1, self.first[q])
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, sequence: list[bytes]) -> None:
        last = 0
        for symbol in sequence:
            moves, depth, end = self.next, self.depth, self.size
            self.size += 1
            q = moves[last].get(symbol)
            if q is not None:
                last = q if depth[q] == depth[last] + 1 else self._split(last, symbol, q)
                continue
            new, p = self._state({}, 0, depth[last] + 1, end), last
            while p >= 0 and symbol not in moves[p]:
                moves[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                q = moves[p][symbol]
                self.link[new] = q if depth[q] == depth[p] + 1 else self._split(p, symbol, q)
            last = new

    def earlier(self, sequence: list[bytes], begin: int, w: int) -> bytes:
        """For each window of w symbols of a sequence added at ``begin``: does it occur before?"""
        state = held = 0
        out = bytearray()
        for i, symbol in enumerate(sequence):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                held = self.depth[state]
            state = self.next[state][symbol]
            held = min(held + 1, w)
            while self.depth[self.link[state]] >= held:
                state = self.link[state]
            if i >= w - 1:
                out.append(held == w and self.first[state] < begin + i)
        return bytes(out)


def word_symbols(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """bytes.split() parts at exactly the ASCII white space \\x09-\\x0D and \\x20."""
    words, digest = [x.split() for x in raw], xxhash.xxh64_intdigest
    return np.array([digest(w) for x in words for w in x], np.uint64), np.array([len(x) for x in words], np.int64)


def _cutter(raw: bytes):
    words = raw.split()
    return lambda a, b: b" ".join(words[a:b])


def automaton_resolver(w: int):
    """SEGMENT rows by key and place -> flags of each row's windows."""

    def settle(rows: list[tuple]) -> list[bytes]:
        out: list[bytes] = []
        begin = 0
        while begin < len(rows):
            end = begin
            while end < len(rows) and rows[end][0] == rows[begin][0]:
                end += 1
            shard = [r[6].split() for r in rows[begin:end]]
            if len(shard) == 1:
                out.append(bytes(max(0, len(shard[0]) - w + 1)))  # a run has no window twice
            else:
                automaton, starts = SuffixAutomaton(), []
                for s in shard:
                    starts.append(automaton.size)
                    automaton.add(s)
                out += [automaton.earlier(s, at, w) for s, at in zip(shard, starts)]
            begin = end
        return out

    return settle


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
DIGEST = pa.schema([*list(OUT)[:3], ("kept_sha256", pa.string())])


def substring_dedup(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text", crowd: int = 50_000, digest: bool = False) -> DataFrame:
    """Remove each word covered by a window of ``min_words`` words that also starts earlier.

    Returns doc_id, n_words, n_removed and the kept text (``digest``: its SHA-256 instead).
    """
    small_batches(docs.sparkSession)
    base = by_document(docs, id_col, text_col)
    spec = Spec(min_words, max(1, min_words // 4), 64, word_symbols, _cutter, automaton_resolver(min_words), crowd)
    found = marks(base, spec, first_stays=True)
    schema = DIGEST if digest else OUT

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, mark in zip(texts(batch.column("text")), batch.column("marks").to_pylist()):
                words = raw.split()
                kept, n = words, len(words)
                if mark:
                    gone = covered(marked_starts(mark), min_words, n)
                    kept = [x for x, g in zip(words, gone.tolist()) if not g]
                text = b" ".join(kept)
                rows.append((n, n - len(kept), hashlib.sha256(text).hexdigest() if digest else text.decode()))
            if rows:
                yield record(schema, doc_ids(batch.column("pk")), *map(list, zip(*rows)))

    ddl = "doc_id long, n_words long, n_removed long, " + ("kept_sha256" if digest else "kept") + " string"
    return base.join(found, DOCUMENT, "left").select("text", "pk", "marks").mapInArrow(remove, ddl)


