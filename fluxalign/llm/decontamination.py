"""Benchmark decontamination by winnowing.

Of every 6 neighbouring 5-grams the one with the least hash is kept (the leftmost of equals),
in documents and benchmark items alike, so any 10 words that both have share a kept 5-gram.
Matches of kept 5-grams are extended to the windows of 10 words that keep them: the benchmark's
windows are indexed by their hashes, each with the items that have it, and a hit is checked on the
words themselves. A 5-gram that very many items share costs no more than any other, since the work
is one look-up for each window that keeps a known 5-gram, and one list of items for each different
window that hits. An item with fewer than 10 words is one window and is looked up whole.

The benchmark is cut into blocks of at most ``block_bytes`` of text, each of which is collected
and broadcast; documents stream against one block after the other, without a shuffle. Usually
there is one block.

Defined cases: null text has no words and null items are skipped; items without an id count as
hits but are not among the items; an item_id that occurs twice counts once; repeated documents
are judged one by one; extra columns are kept out of the result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, texts
from .windows import chunks, mix, rolling, sliding_min

#: ASCII to lower case; ASCII that is no letter or digit ends a word; other bytes are letters.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def symbols(parts: list[list[bytes]]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for x in parts for w in x], np.uint64)


def kept_grams(sym: np.ndarray, lens: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hash of the k-gram kept) of the windows, over documents laid end to end."""
    if len(sym) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.arange(len(sym) - window + 1)
    starts = starts[starts + window <= np.repeat(np.cumsum(lens), lens)[: len(starts)]]
    return starts, sliding_min(mix(rolling(sym, k)), window - k + 1)[starts]


class Windows:
    """Windows of m words by their hashes: the words of each, and the numbers of the items with it."""

    def __init__(self, m: int, found: list[tuple[int, int, bytes]]) -> None:
        """found: (hash, item, words)."""
        self.m = m
        by_words: dict[tuple[int, bytes], list[int]] = {}
        for h, item, raw in found:
            by_words.setdefault((h, raw), []).append(item)
        keys = sorted(by_words)
        self.hashes = np.array([h for h, _ in keys], np.uint64)
        self.words = [raw for _, raw in keys]
        self.items = [np.unique(by_words[x]) for x in keys]

    def hits(self, at: np.ndarray, hashes: np.ndarray, ends: np.ndarray, parts: list[list[bytes]]) -> Iterator[tuple[int, int, int]]:
        """(document, place in it, number of the window) of the windows at the places that have these hashes."""
        first = np.searchsorted(self.hashes, hashes)
        known = np.flatnonzero(self.hashes[np.minimum(first, len(self.hashes) - 1)] == hashes) if len(self.hashes) else ()
        docs = np.searchsorted(ends, at[known], side="right")
        for i, d in zip(known, docs.tolist()):
            p, n = int(at[i] - ends[d]) + len(parts[d]), int(first[i])
            raw = b" ".join(parts[d][p : p + self.m])
            while n < len(self.words) and self.hashes[n] == hashes[i]:  # two windows may have one hash
                if self.words[n] == raw:
                    yield d, p, n
                n += 1


class Benchmark:
    """The windows of one block of items under their kept grams, and the items that are shorter."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int, k: int) -> None:
        self.window, self.k = window, k
        self.items = [i for i, _ in items]
        found: dict[int, list] = {window: []}
        grams = [np.zeros(0, np.uint64)]
        for n, (_, text) in enumerate(items):
            w = words(text)
            if not w:
                continue
            sym, m = symbols([w]), min(len(w), window)
            hashes = mix(rolling(sym, m)).tolist()
            found.setdefault(m, []).extend((h, n, b" ".join(w[q : q + m])) for q, h in enumerate(hashes))
            grams.append(np.unique(kept_grams(sym, np.array([len(w)]), window, k)[1]))
        self.grams = np.unique(np.concatenate(grams))
        self.whole = Windows(window, found.pop(window))
        self.short = [Windows(m, found[m]) for m in sorted(found)]

    def find(self, parts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[int]]]:
        """For each document, spans of hit words and the numbers of items."""
        spans: list[list] = [[] for _ in parts]
        seen: list[dict] = [{} for _ in parts]
        lens = np.array([len(x) for x in parts], np.int64)
        ends, sym = np.cumsum(lens), symbols(parts)
        starts, gram = kept_grams(sym, lens, self.window, self.k)
        if len(self.grams) and len(starts):
            starts = starts[self.grams[np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)] == gram]
            self._take(self.whole, starts, mix(rolling(sym, self.window))[starts] if len(starts) else gram[:0], ends, parts, spans, seen)
        for short in self.short:
            if len(sym) >= short.m:
                starts = np.arange(len(sym) - short.m + 1)
                within = starts + short.m <= np.repeat(ends, lens)[: len(starts)]
                self._take(short, starts[within], mix(rolling(sym, short.m))[within], ends, parts, spans, seen)
        return [(x, {i for which, numbers in by.items() for n in numbers for i in which.items[n].tolist()}) for x, by in zip(spans, seen)]

    def _take(self, which: Windows, at: np.ndarray, hashes: np.ndarray, ends: np.ndarray, parts: list, spans: list, seen: list) -> None:
        for d, p, n in which.hits(at, hashes, ends, parts):
            spans[d].append((p, p + which.m))
            seen[d].setdefault(which, set()).add(n)


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else benchmark for i in range(n)]


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, block_bytes: int = 32 << 20, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    With ``keep``, those columns of the documents stand before contaminated instead.
    """
    small_batches(spark)
    benchmark = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    columns = ["doc_id"] if keep is None else keep
    frame = docs.select(*columns, F.col("text").cast("string").alias("_scanned"), F.lit("").alias("_found"))
    blocks = benchmark_blocks(benchmark, block_bytes)
    for number, block in enumerate(blocks):
        items = sorted(((r.item_id, r.text.encode()) for r in block.toLocalIterator()), key=repr)
        name = (hashlib.sha256(repr(items).encode()).hexdigest(), window, k)
        shared = spark.sparkContext.broadcast(items)
        last = number == len(blocks) - 1
        schema = frame.schema
        if last:
            schema = frame.drop("_scanned", "_found").schema
            for f in OUT if keep is None else [OUT.field("contaminated")]:
                if f.name != "doc_id":
                    schema = schema.add(f.name, {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}[f.type])
        frame = frame.mapInArrow(_scan(shared, name, last, keep is not None), schema)
    return frame


#: The index that a worker used last, by the digest of its block of items and its window.
_indexes: dict[tuple, Benchmark] = {}


def _scan(shared, name: tuple, last: bool, brief: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _indexes:
            _indexes.clear()
            _indexes[name] = Benchmark(shared.value, *name[1:])
        block = _indexes[name]
        for batch in batches:
            columns = batch.columns[:-2]
            raw, before = texts(batch.columns[-2]), batch.columns[-1].to_pylist()
            found = []
            for a, b in chunks([len(x) for x in raw]):
                parts = [words(x) for x in raw[a:b]]
                for w, (spans, numbers), old in zip(parts, block.find(parts), before[a:b]):
                    items = {block.items[n] for n in numbers} - {None}
                    if old:
                        old_spans, old_items = json.loads(old)
                        spans, items = spans + old_spans, items | set(old_items)
                    found.append((len(w), spans, items))
            if not last:
                text = [json.dumps([s, sorted(i)]) if s else "" for _, s, i in found]
                yield pa.RecordBatch.from_arrays([*columns, batch.columns[-2], pa.array(text, pa.string())], batch.schema.names)
                continue
            rows = []
            for n, spans, items in found:
                hit, end = 0, 0
                for x, y in sorted(spans):
                    hit += max(0, y - max(x, end))
                    end = max(end, y)
                rows.append((n, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0))
            if rows:
                new = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(OUT)[1:])]
                names = OUT.names[1:]
                if brief:
                    new, names = new[-1:], names[-1:]
                yield pa.RecordBatch.from_arrays([*columns, *new], [*batch.schema.names[:-2], *names])

    return scan


