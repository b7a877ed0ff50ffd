"""Which windows of a corpus occur again: the plan that both substring operators run.

    base      texts dealt by document (moved once, reused)
    runs      super-windows of every text (see windows.py), one row each, dealt by key (once)
    occ       runs whose key occurs at least twice; most unique text ends here
    distinct  one row for each different run: its first place and number of places
    segments  the symbols of those runs, fetched by a join with base
    resolved  for each key, the operator's own method (automaton or radix sort) on its runs
    marks     windows found, brought back to every place of the run, by document

What follows runs is grouped within the exchange by key, without another one. A run's row holds
no text, whatever the number of copies, and a key's rows stream through sorted, spillable
operators. A key with more than ``crowd`` different runs (the edge of a passage that very many
documents share) is cut: its windows go on one by one, each under a key of its whole content,
which spreads them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, record, texts
from .windows import chunks, mix, rolling, window_runs

#: A run's place is its start * SLOT + its number of windows.
SLOT = 2048
#: What tells documents apart: the id and a hash of the text.
DOCUMENT = ["pk", "th"]
#: Segments that a task holds at once, when keys end there.
HELD = 1 << 15


@dataclass(frozen=True)
class Spec:
    """symbols(list of bytes) gives one uint64 array and the lengths; width is the bytes that a
    symbol takes in a segment; resolve(list of SEGMENT rows of one or more keys) gives window flags."""

    w: int
    k: int
    longest: int
    symbols: Callable
    cut: Callable
    resolve: Callable
    crowd: int = 50_000


#: rest holds seg, pk, th and the places of equal runs of the document (periodic text has many);
#: being one column, no use of it makes Spark deal runs once more.
RUN = pa.schema([("key", pa.int64()), ("rest", pa.list_(pa.int64()))])
RUN_DDL = "key long, rest array<long>"
SEGMENT = pa.schema([(c, pa.int64()) for c in ("key", "seg", "pk", "th", "at", "n")] + [("body", pa.binary())])
RESULT = pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("first", pa.int64()), ("first_th", pa.int64()), ("first_at", pa.int64()), ("bits", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def _runs(key: np.ndarray, seg: np.ndarray, pk: np.ndarray, th: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows of runs; equal runs of one document share a row, their places in order."""
    mixed = np.sort(mix(key.view(np.uint64) ^ mix(seg.view(np.uint64) + mix(pk.view(np.uint64) ^ mix(th.view(np.uint64))))))
    fresh = np.ones(len(key), bool)
    if (mixed[1:] == mixed[:-1]).any():
        order = np.lexsort((at, th, pk, seg, key))
        key, seg, pk, th, at = key[order], seg[order], pk[order], th[order], at[order]
        fresh[1:] = (key[1:] != key[:-1]) | (seg[1:] != seg[:-1]) | (pk[1:] != pk[:-1]) | (th[1:] != th[:-1])
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(key)))
    offsets = np.r_[0, np.cumsum(size + 3)].astype(np.int32)
    rest = np.empty(offsets[-1], np.int64)
    for i, column in enumerate((seg, pk, th)):
        rest[offsets[:-1] + i] = column[first]
    rest[np.arange(len(at)) + 3 * np.cumsum(fresh)] = at
    return record(RUN, key[first], pa.ListArray.from_arrays(offsets, pa.array(rest)))


def runs(base: DataFrame, spec: Spec) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, pk, th = texts(batch.column("text")), batch.column("pk").to_numpy(), batch.column("th").to_numpy()
            for a, b in chunks([len(x) for x in raw]):
                sym, lens = spec.symbols(raw[a:b])
                doc, start, n, key, seg = window_runs(sym, lens, spec.w, spec.k, spec.longest)
                if len(doc):
                    yield _runs(key.view(np.int64), seg.view(np.int64), pk[a:b][doc], th[a:b][doc], start * SLOT + n)

    return _dealt(base.mapInArrow(find, RUN_DDL))


def _dealt(found: DataFrame) -> DataFrame:
    # The filter is the one that Spark adds below a join, here for all uses, so that they share one exchange.
    return found.where("key is not null").repartition(partitions(found), "key")


def _cut(base: DataFrame, crowded: DataFrame, spec: Spec) -> DataFrame:
    """The windows of crowded runs, one by one under a key of their content."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, pk, th, ats in zip(texts(batch.column("text")), *(batch.column(c).to_pylist() for c in ("pk", "th", "ats"))):
                sym, _ = spec.symbols([raw])
                whole = mix(mix(rolling(sym, spec.w)) + np.uint64(77)).view(np.int64) if len(sym) >= spec.w else np.zeros(0, np.int64)
                start = np.concatenate([np.arange(a // SLOT, a // SLOT + a % SLOT) for a in ats])
                start = start[start < len(whole)]
                yield _runs(whole[start], whole[start], np.full(len(start), pk), np.full(len(start), th), start * SLOT + 1)

    by = crowded.groupBy(*DOCUMENT).agg(F.flatten(F.collect_list("ats")).alias("ats"))
    return _dealt(base.join(by, DOCUMENT).mapInArrow(split, RUN_DDL))


def marks(base: DataFrame, spec: Spec, first_stays: bool) -> DataFrame:
    """(pk, th, marks: array of (ats, bits, rest)): repeated windows, by document.

    bits has a byte for each window of the run. With ``first_stays`` the first place of a run
    gets the resolver's flags and all other places are repeated throughout.
    """
    found = runs(base, spec)
    distinct, occ = _kinds(found)
    crowded = distinct.where(F.col("kinds") > spec.crowd).select("key").distinct()
    cut_distinct, cut_occ = _kinds(_cut(base, occ.join(crowded, "key", "left_semi"), spec))
    placed = _placed(base, distinct.where(F.col("kinds") <= spec.crowd), occ, spec, first_stays)
    placed = placed.unionByName(_placed(base, cut_distinct.where("n > 1"), cut_occ, spec, first_stays))
    return placed.groupBy(*DOCUMENT).agg(F.collect_list("m").alias("marks"))


def _kinds(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different runs (key, seg, n places, first place, kinds of the key), and all places."""
    key = Window.partitionBy("key")
    places = F.size("rest") - 3
    occ = found.withColumn("c", F.sum(places).over(key)).where("c > 1").select(
        "key", *(F.get("rest", F.lit(i)).alias(c) for i, c in enumerate(("seg", *DOCUMENT))), F.slice("rest", F.lit(4), places).alias("ats"))
    distinct = occ.groupBy("key", "seg").agg(F.sum(F.size("ats")).alias("n"), F.min(F.struct(*DOCUMENT, F.get("ats", F.lit(0)).alias("at"))).alias("first"))
    return distinct.withColumn("kinds", F.count("*").over(key)), occ


def _placed(base: DataFrame, distinct: DataFrame, occ: DataFrame, spec: Spec, first_stays: bool) -> DataFrame:
    """(pk, th, m: (ats, bits, rest)) of the places whose runs have repeated windows."""
    wanted = distinct.groupBy(*(F.col(f"first.{c}").alias(c) for c in DOCUMENT)).agg(
        F.collect_list(F.struct("key", "seg", F.col("first.at").alias("at"), "n")).alias("want"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("want")
            bounds, flat = want.offsets.to_numpy().tolist(), want.flatten() if want.offset else want.values
            key, seg, at, n = (flat.field(i).to_numpy() for i in range(4))
            bodies, rows = [], []
            shift = bounds[0] if want.offset else 0
            for i, (raw, pk, th) in enumerate(zip(texts(batch.column("text")), batch.column("pk").to_pylist(), batch.column("th").to_pylist())):
                cut, a, b = spec.cut(raw), bounds[i] - shift, bounds[i + 1] - shift
                for j, x in zip(range(a, b), at[a:b].tolist()):
                    bodies.append(cut(x // SLOT, x // SLOT + x % SLOT + spec.w - 1))
                    rows.append((j, pk, th))
            if rows:
                j, pk, th = np.array(rows, np.int64).T
                yield record(SEGMENT, key[j], seg[j], pk, th, at[j], n[j], bodies)

    segments = base.join(wanted, DOCUMENT).mapInArrow(fetch, _ddl(SEGMENT))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(SEGMENT)))):
                if len(held) >= HELD and row[0] != last:
                    yield from out(held)
                    held = []
                if not held or held[-1][:5] != row[:5]:  # a repeated document brings its runs twice
                    held.append(row)
                last = row[0]
        if held:
            yield from out(held)

    def out(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        flags = spec.resolve(held)
        keep = [(*r[:5], f) for r, f in zip(held, flags) if 1 in f or first_stays and r[5] > 1]
        if keep:
            yield record(RESULT, *map(list, zip(*keep)))

    resolved = segments.repartition(partitions(base), "key").sortWithinPartitions("key", *DOCUMENT, "at").mapInArrow(settle, _ddl(RESULT))
    leads = (F.col("pk") == F.col("first")) & (F.col("th") == F.col("first_th")) & (F.get("ats", F.lit(0)) == F.col("first_at"))
    mark = F.struct("ats", F.when(leads, F.col("bits")).alias("bits"), F.lit(True).alias("rest")) if first_stays else F.struct("ats", "bits", F.lit(False).alias("rest"))
    return occ.join(resolved, ["key", "seg"]).select(*DOCUMENT, mark.alias("m"))


def marked_starts(marks: list[dict] | None) -> np.ndarray:
    """Starts of the repeated windows of one document.

    bits are the windows' flags at each of ``ats``; with ``rest`` at the first of them only,
    the others being repeated throughout (and the first too, where there are no bits).
    """
    out = [np.zeros(0, np.int64)]
    for m in marks or ():
        flags = None if m["bits"] is None else np.flatnonzero(np.frombuffer(m["bits"], np.uint8))
        for at in m["ats"]:
            start, n = divmod(at, SLOT)
            out.append(start + (np.arange(n) if flags is None or m["rest"] and at != m["ats"][0] else flags))
    return np.concatenate(out)
