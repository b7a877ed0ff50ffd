"""Suffix-array dedup on bytes by a depth-limited radix sort.

The suffixes (window starts) that can be equal stand under one minimizer key (windows.py). In
each task they are ordered through ``min_bytes`` bytes only, most significant digit first,
eight bytes a pass. A group that is alone is settled and dropped; a group that a pass doesn't
divide needs no sorting. Groups that are left after the last pass are exactly the windows that
occur again; the numbers of places of their runs tell how often. Runs that are equal as a whole
(by two independent 64-bit hashes, of the minimizer and of the content) bring their bytes once;
different runs are compared byte for byte.

Defined cases: null or empty text has no bytes; two rows with the same doc_id and text repeat
each other; rows with the same doc_id, or none, and different texts are different documents;
texts shorter than a window are kept; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_document, doc_ids, record, small_batches, texts
from .repeats import DOCUMENT, Spec, marked_starts, marks
from .windows import covered

#: Hash value of each byte, from a fixed seed.
BYTE = np.random.default_rng(20240117).integers(0, 1 << 64, 256, dtype=np.uint64)
#: Bytes of one radix digit.
DIGIT = 8


def byte_symbols(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return BYTE[np.frombuffer(b"".join(raw), np.uint8)], np.array([len(x) for x in raw], np.int64)


def _cutter(raw: bytes):
    return lambda a, b: raw[a:b]


def radix_groups(data: np.ndarray, starts: np.ndarray, group: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes of ``data`` share their first ``depth`` bytes with another of their group.

    ``weight`` is the number of places that a suffix stands for; alone means a sum of 1.
    """
    padded = np.concatenate([data, np.zeros(DIGIT, np.uint8)]).astype(np.uint64)
    digits = np.zeros(len(data), np.uint64)
    for i in range(DIGIT):
        digits = (digits << np.uint64(8)) | padded[i : i + len(data)]
    repeated = np.zeros(len(starts), bool)
    live = np.argsort(group, kind="stable")
    label = group[live]
    for at in range(0, depth, DIGIT):
        if not len(live):
            break
        digit = digits[starts[live] + at]
        if depth - at < DIGIT:
            digit >>= np.uint64(8 * (DIGIT - depth + at))
        edge = np.r_[True, label[1:] != label[:-1]]
        number = np.cumsum(edge) - 1
        differs = digit != digit[np.flatnonzero(edge)][number]
        divided = np.zeros(number[-1] + 1, bool)
        divided[number[differs]] = True
        some = np.flatnonzero(divided[number])
        order = some[np.lexsort((digit[some], number[some]))]
        live[some], digit[some] = live[order], digit[order]  # groups keep their places
        edge[1:] |= digit[1:] != digit[:-1]
        number = np.cumsum(edge) - 1
        enough = (np.bincount(number, weight[live]) > 1)[number]
        live, label = live[enough], number[enough]
    repeated[live] = True
    return repeated


def radix_resolver(w: int):
    def settle(rows: list[tuple]) -> list[bytes]:
        body = [r[6] for r in rows]
        data = np.frombuffer(b"".join(body), np.uint8)
        size = np.array([len(b) for b in body])
        n = np.maximum(size - w + 1, 0)
        number = np.repeat(np.arange(len(rows)), n)
        begin = np.cumsum(n) - n
        starts = (np.cumsum(size) - size)[number] + np.arange(len(number)) - begin[number]
        key = np.array([r[0] for r in rows])
        group = np.cumsum(np.r_[0, key[1:] != key[:-1]])[number]
        flags = radix_groups(data, starts, group, np.array([r[5] for r in rows])[number], w).astype(np.uint8).tobytes()
        return [flags[a : a + m] for a, m in zip(begin.tolist(), n.tolist())]

    def bounded(rows: list[tuple]) -> list[bytes]:
        """A few megabytes of windows at a time, by whole keys."""
        out, held, total = [], [], 0
        for r in rows:
            if total > 1 << 21 and r[0] != held[-1][0]:
                out += settle(held)
                held, total = [], 0
            held.append(r)
            total += len(r[6])
        return out + settle(held) if held else out

    return bounded


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
DIGEST = pa.schema([*list(OUT)[:4], ("kept_sha256", pa.string())])


def suffix_dedup(docs: DataFrame, min_bytes: int = 400, id_col: str = "doc_id", text_col: str = "text", crowd: int = 50_000, digest: bool = False) -> DataFrame:
    """Remove each byte covered by a string of ``min_bytes`` bytes that also starts elsewhere.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the kept bytes, which
    may cut a character in two (``digest``: their SHA-256 instead).
    """
    small_batches(docs.sparkSession)
    base = by_document(docs, id_col, text_col)
    spec = Spec(min_bytes, max(1, min(32, min_bytes // 4)), 1024, byte_symbols, _cutter, radix_resolver(min_bytes), crowd)
    found = marks(base, spec, first_stays=False)
    schema = DIGEST if digest else OUT

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, mark in zip(texts(batch.column("text")), batch.column("marks").to_pylist()):
                kept, spans = raw, 0
                if mark:
                    gone = covered(marked_starts(mark), min_bytes, len(raw))
                    spans = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]]))
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest() if digest else kept))
            if rows:
                yield record(schema, doc_ids(batch.column("pk")), *map(list, zip(*rows)))

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary")
    return base.join(found, DOCUMENT, "left").select("text", "pk", "marks").mapInArrow(remove, ddl)
