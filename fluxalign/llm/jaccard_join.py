"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Documents with equal sets of shingles collapse into classes first; the least document of each
class goes on, under a number (``pk`` below) that is taken from the hash of the set. The product
M x M' is taken row by row over prefixes: shingles are ordered rare first, by a document-frequency
sketch of fixed size, and of n shingles only the first n - ceil(t n) + 1 can be without a partner's
prefix if the Jaccard similarity reaches t.

Groups of near copies would give all their pairs, so posting lists are walked before they are
multiplied. Their entries are in the order of two min-hashes of the sets, and an entry is linked to
one before it among those of equal first min-hash: the one whose place has the last digit that isn't
0 (to base 16) cleared. That is one pair for each entry, of which a document keeps the one that most
lists give; no document is in many pairs, and links join a group over few steps. A second walk goes
over lists that still hold several components, in another order: an entry is linked to that of the
NEAR ones before it whose parity bitmap differs least, where the difference is one that sets at the
threshold have. That joins groups of which only a part of all pairs reach the threshold. Lists of very
frequent shingles are walked in parts, which differ from shingle to shingle.

Then comes the product, over lists that still hold several components. An entry of a list's largest
component meets only the entries of others. Lists are cut into blocks, and every pair of blocks is a
cell, dealt for itself. Overlap counts of a row and a column accumulate over the cells, and a pair is
discarded when the count plus all that may still follow stays under the overlap that the two sizes
demand, or when parity bitmaps of BITS bits (which differ in at most as many bits as the sets differ
in shingles) show that. Of the pairs left between two components, the one with most overlap is
compared first, and the others only if the two stay apart.

All comparisons are exact, on whole sets: those compared with one set meet it in a cell, FAN of them
at most, so a set is sent once for each cell. The order only decides the speed.

Nothing large reaches the driver but the sketch, which has SKETCH counters at every scale.

Defined cases: null text, and text without words, has the empty set and links with nothing;
rows with the same doc_id and text are one document, rows with the same doc_id (or none) and
different texts are different ones; a null doc_id is before all others; extra columns are
ignored. Classes are told apart by 127 bits: where two sets share the 63 of their number, all
numbers are taken anew from another hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, partitions, record, small_batches, stored, text_hash, texts
from .components import components
from .windows import mix, rolling

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows that are broadcast at most (some 16 bytes each); more of them are joined by a shuffle.
MOST_BROADCAST = 1 << 20
#: Counters of the document-frequency sketch, and the parts in which it is summed.
SKETCH, PARTS = 1 << 20, 16
#: Bits of a set's parity bitmap.
BITS = 512
#: Entries of a posting list in one block, sets compared with another one in a cell, and (as a power
#: of 2) entries that are walked together, by the sketch.
BLOCK, FAN, WALKED = 2048, 64, 12
#: Entries before an entry that the second walk looks at.
NEAR = 32
#: A document's tag: 18 bits of two min-hashes and its number of shingles, in 27 bits.
HASHED, SIZED = 18, 27
#: Bytes of sets that a task holds before it sends them.
HELD = 8 << 20


def shingles(raw: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; all words as one where they are fewer."""
    words, digest = raw.translate(LOWER).split(), xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    sym = np.array([digest(w) for w in words], np.uint64)
    if len(sym) < n:
        return mix(rolling(sym, len(sym)) + np.uint64(len(sym)))
    return np.unique(mix(rolling(sym, n)))


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles by the low bits of their hashes, as signed 64-bit numbers."""
    odd = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def number(s: np.ndarray, seed: int) -> tuple[int, int]:
    """The class of equal sets: 63 bits of the hash of the set, and 64 more that check them."""
    whole = xxhash.xxh3_128_intdigest(s.tobytes(), seed)
    return whole >> 65, (whole & (1 << 64) - 1) - (1 << 63)


def needed(size: np.ndarray | int, percent: int):
    """Least overlap of a set of this size with any set at the threshold."""
    return -(-percent * size // 100)


def tag(s: np.ndarray) -> int:
    """Two min-hashes and the size of a set that isn't empty."""
    other = int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).min()) >> (64 - HASHED)
    return (int(s[0]) >> (64 - HASHED)) << HASHED + SIZED | other << SIZED | min(len(s), (1 << SIZED) - 1)


SIGNED = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("pk", pa.int64()), ("check", pa.int64()), ("bits", pa.list_(pa.int64())), ("part", pa.int32()), ("counts", pa.binary())])
PREFIX = pa.schema([("pk", pa.int64()), ("tag", pa.int64()), ("parts", pa.int32()), ("grams", pa.list_(pa.int64()))])


def _signatures(base: DataFrame, n: int, seed: int) -> DataFrame:
    """A row (id, th, n, pk, check, bits) for each document, and rows (part, counts) of each task's sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(SKETCH, np.int64)
        for batch in batches:
            rows, seen = [], []
            for raw in texts(batch.column("text")):
                s = shingles(raw, n)
                seen.append(s)
                rows.append((len(s), *number(s, seed), bitmap(s)))
            if rows:
                sketch += np.bincount((np.concatenate(seen) >> np.uint64(44)).astype(np.int64), minlength=SKETCH)
                none = [None] * len(rows)
                yield record(SIGNED, batch.column("id"), batch.column("th"), *map(list, zip(*rows)), none, none)
        if sketch.any():
            for p, counts in enumerate(np.split(np.minimum(sketch, 65535).astype(np.uint16), PARTS)):
                yield record(SIGNED, [None], [None], [None], [None], [None], [None], [p], [counts.tobytes()])

    return base.select("text", "id", "th").mapInArrow(sign, "id long, th long, n long, pk long, check long, bits array<long>, part int, counts binary")


def _sketch(signed: DataFrame) -> np.ndarray:
    """Rank of the document frequency of each counter: the binary digits of its count."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, counts in zip(*(c.to_pylist() for c in batch.columns)):
                sums[p] = sums.get(p, 0) + np.frombuffer(counts, np.uint16).astype(np.int64)
        for p, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([s.tobytes()], pa.binary())], ["part", "counts"])

    rows = signed.where("part is not null").select("part", "counts").repartition(PARTS, "part").mapInArrow(total, "part int, counts binary").collect()
    counts = np.zeros(SKETCH, np.int64)
    for p, s in rows:
        counts[p * (SKETCH // PARTS) : (p + 1) * (SKETCH // PARTS)] += np.frombuffer(s, np.int64)
    return np.ceil(np.log2(counts + 1)).astype(np.uint8)


def _prefixes(base: DataFrame, rank, n: int, percent: int, seed: int) -> DataFrame:
    """(pk, tag, parts, grams): the rare-first prefix of each set. A row has shingles whose lists are
    walked in 2^parts parts: most of a set's lists are short (parts 0)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = rank.value
        for batch in batches:
            ids, tags, parts, grams = [], [], [], []
            for raw in texts(batch.column("text")):
                s = shingles(raw, n)
                if not len(s):
                    continue
                often = rare[(s >> np.uint64(44)).astype(np.int64)]
                order = often.astype(np.uint64) << np.uint64(56) | s >> np.uint64(8)
                p = len(s) - needed(len(s), percent) + 1
                first = np.argpartition(order, p - 1)[:p] if p < len(s) else np.arange(len(s))
                own, pk, mark = np.maximum(often[first].astype(np.int32) - WALKED, 0), number(s, seed)[0], tag(s)
                for level in np.unique(own).tolist():
                    ids.append(pk)
                    tags.append(mark)
                    parts.append(level)
                    grams.append(s[first[own == level]].view(np.int64))
            if ids:
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(g) for g in grams])].astype(np.int32), pa.array(np.concatenate(grams)))
                yield record(PREFIX, ids, tags, parts, lists)

    return base.select("text").mapInArrow(cut, "pk long, tag long, parts int, grams array<long>")


ENTRY = pa.schema([("gram", pa.int64()), ("pk", pa.int64()), ("tag", pa.int64()), ("parts", pa.int32()), ("partner", pa.int64())])


#: The part of its list that an entry is walked in.
PARTED = "if(parts > 0, pmod(xxhash64(pk, gram), shiftleft(1L, parts)), 0L)"


class Walk:
    """Entries of posting lists in order, in batches; gives each the partner it is linked to.

    A run is the entries of a list with equal first min-hash. The partner of place p in a run is p
    with its last digit other than 0 cleared, so the latest places that end in 1, 2, ... digits 0
    are all that is kept of a run.
    """

    def __init__(self, percent: int) -> None:
        self.percent, self.before, self.run, self.seen = percent, None, None, 0
        self.kept: dict[int, np.ndarray] = {}

    def step(self, x: np.ndarray, following: int | None) -> tuple[np.ndarray, np.ndarray]:
        """x: gram, pk, tag, parts, comp. Whether each entry's list has others, and the place of its
        partner in pk (-1: none)."""
        gram, m = x[0], x.shape[1]
        same = gram[1:] == gram[:-1]
        shared = np.r_[gram[0] == self.before if self.before is not None else False, same] | np.r_[same, gram[-1] == following if following is not None else False] | (x[3] > 0)
        first = x[2] >> HASHED + SIZED
        fresh = np.r_[self.run != (int(gram[0]), int(first[0])), ~same | (first[1:] != first[:-1])]
        if fresh[0]:
            self.seen, self.kept = 0, {}
        start = np.maximum.accumulate(np.where(fresh, np.arange(m), -1))
        place = np.arange(m) - np.where(start < 0, -self.seen, start)
        partner, level, ids = np.full(m, -1), 16, np.arange(m)
        size = x[2] & (1 << SIZED) - 1
        while True:
            at = np.flatnonzero((place % level != 0) & (place % (level // 16) == 0))
            to = ids[at] - place[at] % level
            inside = to >= 0
            there = np.where(inside[None, :], x[:, np.maximum(to, 0)], self.kept.get(level, np.full((5, 1), -1)))
            n, k = there[2] & (1 << SIZED) - 1, size[at]
            good = (there[4] != x[4, at]) & (100 * np.minimum(n, k) >= self.percent * np.maximum(n, k)) & (there[1] >= 0)
            partner[at[good]] = there[1, good]
            last = m - 1 - int(place[-1] % level)
            if last >= 0:
                self.kept[level] = x[:, [last]]
            if level > place[-1] and level > place.max():
                break
            level *= 16
        self.before, self.run, self.seen = int(gram[-1]), (int(gram[-1]), int(first[-1])), int(place[-1]) + 1
        return shared, partner


def _walked(entries: DataFrame, percent: int) -> DataFrame:
    """(gram, pk, tag, parts, partner) of the entries (gram, pk, tag, parts, comp) of lists that several
    documents have; a partner has another comp."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, held = Walk(percent), np.zeros((5, 0), np.int64)
        for batch in batches:
            x = np.concatenate([held, np.array([batch.column(c).to_numpy() for c in ("gram", "pk", "tag", "parts", "comp")], np.int64)], axis=1)
            if x.shape[1] > 1:
                yield rows(x[:, :-1], walk, int(x[0, -1]))
            held = x[:, -1:]
        if held.shape[1]:
            yield rows(held, walk, None)

    def rows(x: np.ndarray, walk: Walk, following: int | None) -> pa.RecordBatch:
        shared, partner = walk.step(x, following)
        at = np.flatnonzero(shared)
        return record(ENTRY, x[0, at], x[1, at], x[2, at], x[3, at].astype(np.int32), pa.array(partner[at], pa.int64(), mask=partner[at] < 0))

    dealt = entries.select("gram", "pk", "tag", "parts", "comp").repartition(partitions(entries), F.col("gram"), F.expr(PARTED)).sortWithinPartitions("gram", "tag", "pk")
    return dealt.mapInArrow(link, "gram long, pk long, tag long, parts int, partner long")


def _proposed(walked: DataFrame) -> DataFrame:
    """Of each document, the pair (a, b) that most lists give."""
    counted = walked.where("partner is not null").groupBy("pk", "partner").agg(F.count("*").alias("c"))
    return counted.groupBy("pk").agg(F.max(F.struct("c", "partner")).alias("m")).select(F.col("pk").alias("a"), F.col("m.partner").alias("b"))


def _nearest(entries: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of each document of the entries (gram, pk, tag, parts, comp), the pair (a, b) with the nearest
    bitmap among the entries before its own ones, of another comp."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4 + BITS // 64, 0), np.int64)
        for batch in batches:
            x = np.array([batch.column(c).to_numpy() for c in ("gram", "pk", "tag", "comp")])
            x = np.concatenate([held, np.concatenate([x, batch.column("bits").flatten().to_numpy().reshape(-1, BITS // 64).T])], axis=1)
            yield rows(x, held.shape[1])
            held = x[:, -NEAR:]

    def rows(x: np.ndarray, first: int) -> pa.RecordBatch:
        gram, pk, comp, size = x[0], x[1], x[3], x[2] & (1 << SIZED) - 1
        bits = np.ascontiguousarray(x[4:].T).view(np.uint64)
        best, partner = np.full(x.shape[1], BITS + 1), np.full(x.shape[1], -1)
        for back in range(1, NEAR + 1):
            at = np.arange(max(first, back), x.shape[1])
            to = at - back
            good = (gram[at] == gram[to]) & (comp[at] != comp[to]) & (100 * np.minimum(size[at], size[to]) >= percent * np.maximum(size[at], size[to]))
            at, to = at[good], to[good]
            differ = np.bitwise_count(bits[at] ^ bits[to]).sum(axis=1, dtype=np.int64)
            # Bits that differ, on average, between sets which differ in as many shingles as the threshold allows.
            most = BITS / 2 * (1 - np.exp(-2 / BITS * (size[at] + size[to]) * ((100 - percent) / (100 + percent))))
            good = (differ <= most + 1) & (differ < best[at])
            best[at[good]], partner[at[good]] = differ[good], pk[to[good]]
        at = np.flatnonzero(partner >= 0)
        return pa.RecordBatch.from_arrays([pa.array(pk[at]), pa.array(best[at]), pa.array(partner[at])], ["a", "differ", "b"])

    turned = F.expr(f"shiftleft(shiftright(tag, {SIZED}) & {(1 << HASHED) - 1}L, {HASHED + SIZED}) | shiftleft(shiftright(tag, {HASHED + SIZED}), {SIZED}) | tag & {(1 << SIZED) - 1}L")
    x = entries.join(classes.select("pk", "bits"), "pk").select("gram", "pk", turned.alias("tag"), "comp", "bits", "parts")
    met = x.repartition(partitions(x), F.col("gram"), F.expr(PARTED)).sortWithinPartitions("gram", "tag", "pk").mapInArrow(look, "a long, differ long, b long")
    return met.groupBy("a").agg(F.min(F.struct("differ", "b")).alias("m")).select("a", "m.b")


SENT = pa.schema([("b", pa.int64()), ("block", pa.int64()), ("follows", pa.bool_()), ("pk", pa.int64()), ("grams", pa.binary())])


def _small(df: DataFrame) -> DataFrame:
    """A stored frame, broadcast in joins while it has MOST_BROADCAST rows at most."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _exact(base: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the stored pairs (a, b) whose whole sets reach the threshold.

    The sets compared with b meet it in cells (b, block) of FAN of them. Only texts of the least
    documents of these classes are read for that.
    """
    cells = pairs.join(pairs.groupBy("b").agg(F.ceil(F.count("*") / FAN).alias("blocks")), "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block"))
    cell = lambda follows: F.struct("b", "block", F.lit(follows).alias("follows")).alias("cell")
    places = cells.select(F.col("a").alias("pk"), cell(True)).unionByName(cells.select("b", "block").distinct().select(F.col("b").alias("pk"), cell(False)))
    asked = stored(places.groupBy("pk").agg(F.collect_list("cell").alias("cells")).join(classes.select("pk", "least.id", "least.th"), "pk"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for raw, pk, cells in zip(texts(batch.column("text")), batch.column("pk").to_pylist(), batch.column("cells")):
                s = shingles(raw, n).tobytes()
                for c in cells.as_py():
                    out.append((c["b"], c["block"], c["follows"], pk, s))
                    size += len(s)
                    if size > HELD:
                        yield record(SENT, *map(list, zip(*out)))
                        out, size = [], 0
        if out:
            yield record(SENT, *map(list, zip(*out)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.zeros(0, np.uint64)
        last = None
        for batch in batches:
            a, b = [], []
            for to, _, follows, pk, grams in zip(*(batch.column(i) for i in range(5))):
                to, pk, s = to.as_py(), pk.as_py(), np.frombuffer(grams.as_py(), np.uint64)
                if not follows.as_py():
                    lead, last = s, None
                elif pk != last:  # a repeated document comes twice
                    last, both = pk, len(np.intersect1d(lead, s, assume_unique=True))
                    if 100 * both >= percent * (len(lead) + len(s) - both):
                        a.append(pk)
                        b.append(to)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sent = base.join(_small(asked), ["id", "th"]).select("text", "pk", "cells").mapInArrow(whole, "b long, block long, follows boolean, pk long, grams binary")
    return sent.repartition(partitions(base), "b", "block").sortWithinPartitions("b", "block", "follows", "pk").mapInArrow(compare, "a long, b long")


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64())])
CELL = ["gram", "i", "j", "role", "pk", "n", "comp", "big"]


def _cells(live: DataFrame, block: int) -> DataFrame:
    """Entries (gram, pk, n, comp, bits) of lists of c entries, m of them outside the component big,
    once for every cell (i, j): block i of those outside (role 1) and block j of all (role 0)."""
    rows, columns = F.ceil(F.col("m") / block), F.ceil(F.col("c") / block)
    own = lambda blocks: F.pmod(F.xxhash64("pk"), blocks)
    every = lambda blocks: F.sequence(F.lit(0).cast("long"), blocks - 1)
    column = F.transform(every(rows), lambda i: F.struct(i.alias("i"), own(columns).alias("j"), F.lit(0).alias("role")))
    row = F.transform(every(columns), lambda j: F.struct(own(rows).alias("i"), j.alias("j"), F.lit(1).alias("role")))
    cut = live.withColumn("cell", F.explode(F.when(F.col("comp") != F.col("big"), F.concat(column, row)).otherwise(column)))
    cells = cut.select("gram", "cell.*", "pk", "n", "comp", "big", "bits")
    return cells.repartition(partitions(live), "gram", "i", "j").sortWithinPartitions("gram", "i", "j", "role")


def _product(entries: DataFrame, classes: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b, shared, ca, cb) of different components whose accumulated overlap can reach the
    threshold, from the entries (gram, pk, comp) of lists that hold several components."""
    by_comp = entries.groupBy("gram", "comp").agg(F.count("*").alias("k"))
    lists = stored(by_comp.groupBy("gram").agg(F.sum("k").alias("c"), F.max(F.struct("k", "comp")).alias("top")).select("gram", "c", (F.col("c") - F.col("top.k")).alias("m"), F.col("top.comp").alias("big")))
    cells = _cells(entries.select("gram", "pk", "comp").join(_small(lists), "gram").join(classes.select("pk", "n", "bits"), "pk"), block)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs of each cell; a cell may come in several batches."""
        held = np.zeros((len(CELL) + BITS // 64, 0), np.int64)
        for batch in batches:
            x = np.array([batch.column(c).to_numpy() for c in CELL], np.int64)
            x = np.concatenate([held, np.concatenate([x, batch.column("bits").flatten().to_numpy().reshape(-1, BITS // 64).T])], axis=1)
            edges = np.flatnonzero((x[:3, 1:] != x[:3, :-1]).any(axis=0)) + 1
            if len(edges):
                yield from pairs(x[:, : edges[-1]], edges[:-1].tolist())
            held = x[:, edges[-1] if len(edges) else 0 :]
        if held.shape[1]:
            yield from pairs(held, [])

    def pairs(x: np.ndarray, edges: list[int]) -> Iterator[pa.RecordBatch]:
        out, total = [], 0
        bits = np.ascontiguousarray(x[len(CELL) :].T).view(np.uint64)
        for a, b in zip([0, *edges], [*edges, x.shape[1]]):
            rows = int(x[3, a:b].sum())
            every = slice(a, b - rows)
            _, _, _, _, pk, size, group, big = x[: len(CELL), every]
            outside = group != big
            for k in range(b - rows, b):
                near = (group != x[6, k]) & (~outside | (pk > x[4, k])) & (100 * np.minimum(size, x[5, k]) >= percent * np.maximum(size, x[5, k]))
                found = np.flatnonzero(near)
                if len(found):
                    differ = np.bitwise_count(bits[found + a] ^ bits[k]).sum(axis=1, dtype=np.int64)
                    both = size[found] + x[5, k]
                    found = found[(both - differ) * (100 + percent) >= 2 * percent * both]
                if len(found):
                    out.append((k, found + a))
                    total += len(found)
                if total > 1 << 16:
                    yield rows_of(x, out)
                    out, total = [], 0
        if out:
            yield rows_of(x, out)

    def rows_of(x: np.ndarray, out: list) -> pa.RecordBatch:
        left, right = np.repeat([k for k, _ in out], [len(f) for _, f in out]), np.concatenate([f for _, f in out])
        turned = x[4, left] > x[4, right]
        left, right = np.where(turned, right, left), np.where(turned, left, right)
        return record(PAIR, x[4, left], x[4, right], x[5, left], x[5, right])

    met = cells.mapInArrow(multiply, "a long, b long, na long, nb long").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    # Behind its prefix a set has ceil(t n) - 1 shingles, and the shorter prefix ends before the other one.
    rest = needed_column(F.greatest("na", "nb"), percent) - 1
    return met.where((F.col("shared") + rest) * (100 + percent) >= percent * (F.col("na") + F.col("nb"))).select("a", "b", "shared")


def needed_column(size: Column, percent: int) -> Column:
    return F.ceil(size * percent / 100)


def _components(links: DataFrame) -> DataFrame:
    return stored(components(links).select(F.col("node").alias("pk"), "component"))


def _mixed(entries: DataFrame, known: DataFrame) -> DataFrame:
    """The entries of lists that hold several components, with theirs (comp)."""
    grouped = entries.drop("comp").join(_small(known), "pk", "left").withColumn("comp", F.coalesce("component", "pk")).drop("component")
    mixed = stored(grouped.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("gram"))
    return stored(grouped.join(_small(mixed), "gram", "left_semi"))


def _joined(base: DataFrame, classes: DataFrame, walked: DataFrame, n: int, percent: int) -> DataFrame:
    """(pk, component) of all linked classes, from the walked entries."""
    exact = lambda pairs: stored(_exact(base, classes, pairs, n, percent))
    links = exact(stored(_proposed(walked)))
    known = _components(links)
    entries = _mixed(walked.drop("partner"), known)
    again = exact(stored(_nearest(entries, classes, percent)))
    if not again.isEmpty():
        links = links.unionByName(again)
        known = _components(links)
        entries = _mixed(entries, known)
    pairs = stored(_product(entries, classes, percent))
    # Of all pairs between two components the one with most overlap, then those still apart.
    compared = None
    for last in (False, True):
        left = pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti")
        for side in "ab":
            left = left.join(_small(known.select(F.col("pk").alias(side), F.col("component").alias(f"c{side}"))), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
        left = left.where("ca != cb")
        if not last:
            left = left.groupBy(F.least("ca", "cb").alias("lo"), F.greatest("ca", "cb").alias("hi")).agg(F.max(F.struct("shared", "a", "b")).alias("m")).select("m.a", "m.b")
        compared = stored(left.select("a", "b"))
        if compared.isEmpty():
            break
        more = exact(compared)
        if not more.isEmpty():
            links = links.unionByName(more)
            known = _components(links)
    return known


def components_of_texts(docs: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th, n, least: each document by id (null as NULL_ID) and hash of the text, its number of
    shingles, and the least (id, th) of its component."""
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    base = docs.select(text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), text_hash(text).alias("th"))
    seed, clash = 0, True
    while clash:
        signed = stored(_signatures(base, n, seed))
        rows = signed.where("part is null")
        classes = stored(rows.where("n > 0").groupBy("pk").agg(F.min(F.struct("id", "th")).alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"), (F.min("check") != F.max("check")).alias("clash")))
        clash = not classes.where("clash").isEmpty()
        seed += clash
    sets = rows.select("id", "th", "n", "pk").distinct()
    rank = docs.sparkSession.sparkContext.broadcast(_sketch(signed))
    prefix = _prefixes(base, rank, n, percent, seed).dropDuplicates(["pk", "parts"])
    entries = stored(_walked(prefix.select(F.explode("grams").alias("gram"), "pk", "tag", "parts", F.col("pk").alias("comp")), percent))
    found = _joined(base, classes, entries, n, percent)
    # Few classes are linked; all others are their own component.
    linked = found.join(classes, "pk").select("pk", "component", "least")
    reached = linked.join(linked.groupBy("component").agg(F.min("least").alias("reached")), "component").select("pk", "reached")
    labelled = classes.join(reached, "pk", "left").select("pk", F.coalesce("reached", "least").alias("least"))
    return sets.join(labelled, "pk", "left").select("id", "th", "n", F.coalesce("least", F.struct("id", "th")).alias("least"))


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: components of 100 |A and B| >= percent |A or B|.

    component_id is the least doc_id that links reach, the document itself included.
    """
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    found = components_of_texts(docs, n, percent, id_col, text_col)
    return found.select(back("id").alias("doc_id"), F.col("n").alias("n_shingles"), back("least.id").alias("component_id"))
