"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Merge-type segmentation: a text starts as single characters; an agenda holds the neighbouring
pairs that join to a vocabulary piece, the best score (then the leftmost) first. Dropout skips
a candidate when a keyed hash of (seed, text of the document, number of the chunk, place, piece)
falls under the rate, so the segmentation varies from occurrence to occurrence and is the same
again on every run.

No piece of a merge vocabulary crosses from text into a following blank, so a text is cut there
into chunks. What a chunk becomes without dropout is remembered, together with the merges made:
an occurrence none of whose merges is skipped has that segmentation, all others are merged anew.

Decoding is lossless for every text: characters without a piece become byte pieces, and so does
a literal U+2581, which would else be read back as a blank. With rate 0 the ids equal those of
the public sentencepiece library (a literal U+2581 apart).

Defined cases: null encodes to no ids and decodes to empty text, and so does empty text;
repeated rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import small_batches
from .windows import chunks, mix

BLANK = "▁"
#: Chunks that a worker remembers, characters from which a chunk is merged by itself, and chunks
#: that are merged at once.
REMEMBERED, LONG, AT_ONCE = 300_000, 40, 1 << 13
#: Odd multipliers of the place and the piece in a candidate's hash.
PLACE, PIECE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Largest vocabulary that is broadcast.
MOST_PIECES = 1 << 20
_MASK = (1 << 64) - 1


def read_pieces(path: str) -> tuple[dict[str, tuple[float, int]], list[int], str]:
    """From a model file: piece -> (score, id), the ids of the 256 byte pieces, and a name."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    if size > MOST_PIECES:
        raise ValueError(f"the model has {size} pieces; {MOST_PIECES} at most are broadcast")
    plain = {model.id_to_piece(i): (model.get_score(i), i) for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    of_bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if any("\n" in p or BLANK in p.lstrip(BLANK) for p in plain):
        raise ValueError("a piece crosses from text into a blank or a line end; this vocabulary can't be cut into chunks")
    return plain, of_bytes, hashlib.sha256(repr((size, sorted(plain.items())[:1000], of_bytes)).encode()).hexdigest()


class Ragged:
    """Lists of numbers, end to end."""

    def __init__(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.flat, self.size = flat, size
        self.start = np.cumsum(size) - size

    def __add__(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.flat, other.flat]), np.concatenate([self.size, other.size]))

    def take(self, which: np.ndarray) -> Ragged:
        size = self.size[which]
        begin = np.cumsum(size) - size
        return Ragged(self.flat[np.arange(size.sum()) + np.repeat(self.start[which] - begin, size)], size)

    def lists(self) -> list[list]:
        return [self.flat[a : a + n].tolist() for a, n in zip(self.start.tolist(), self.size.tolist())]

    @staticmethod
    def of(lists: list, dtype) -> Ragged:
        return Ragged(np.concatenate([np.zeros(0, dtype), *(np.asarray(x, dtype) for x in lists)]), np.array([len(x) for x in lists], np.int64))


class MergeCoder:
    CHUNK = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")

    def __init__(self, plain: dict[str, tuple[float, int]], of_bytes: list[int], rate: float = 0.0, seed: int = 0) -> None:
        self.plain, self.of_bytes, self.seed = plain, of_bytes, seed
        self.limit = int(rate * (1 << 64))
        self._forget()
        self.tables = None
        self.text: dict[int, bytes] = {i: p.replace(BLANK, " ").encode() for p, (_, i) in plain.items()}
        self.text |= {i: bytes([b]) for b, i in enumerate(of_bytes)}

    def _forget(self) -> None:
        """No chunk is known; those learned get numbers, their ids and merge codes stand by number."""
        self.known: dict[str, int] = {}
        self.ids, self.codes = Ragged.of([], np.int32), Ragged.of([], np.uint64)

    def merge(self, chunk: str, key: int) -> list[str]:
        plain, n = self.plain, len(chunk)
        parts: list[str | None] = list(chunk)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for i in range(n - 1):
            if (hit := plain.get(chunk[i : i + 2])) is not None:
                agenda.append((-hit[0], i, hit[1], i + 1, 2))
        heapify(agenda)
        while agenda:
            _, a, piece, b, size = heappop(agenda)
            if parts[a] is None or parts[b] is None or right[a] != b or len(parts[a]) + len(parts[b]) != size:
                continue
            if self.limit:
                x = key ^ ((a * PLACE + piece * PIECE) & _MASK)
                x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & _MASK
                if x ^ x >> 32 < self.limit:
                    continue
            parts[a] += parts[b]
            parts[b] = None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            for x, y in ((left[a], a), (a, right[a])):
                if x >= 0 and y >= 0 and (hit := plain.get(parts[x] + parts[y])) is not None:
                    heappush(agenda, (-hit[0], x, hit[1], y, len(parts[x]) + len(parts[y])))
        return [p for p in parts if p is not None]

    def chunk_ids(self, chunk: str, key: int, literal: str | None = None) -> list[int]:
        out: list[int] = []
        for part in self.merge(chunk, key):
            hit = self.plain.get(part)
            if hit is not None and part != literal:
                out.append(hit[1])
            else:
                out.extend(self.of_bytes[b] for b in (BLANK if part == literal else part).encode())
        return out

    def skipped(self, keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Which candidates (their codes are place * PLACE + piece * PIECE) dropout skips."""
        x = keys ^ codes
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ x >> np.uint64(32) < np.uint64(min(self.limit, _MASK))

    def _tables(self) -> tuple:
        """Symbols (pieces, and characters of pieces) and the pairs of symbols that join to a piece."""
        names = list(self.plain)
        symbol = {p: i for i, p in enumerate(names)}
        for c in {c for p in names for c in p} - symbol.keys():
            symbol[c] = len(symbol)
        ids = np.full(len(symbol) + 1, -1, np.int32)  # the last is for characters that no piece has
        ids[: len(names)] = [self.plain[p][1] for p in names]
        order = np.unique([-self.plain[p][0] for p in names], return_inverse=True)[1].astype(np.int64)
        of_char = np.full(0x110000, len(symbol), np.int32)
        pairs = {}
        for p in names:
            if len(p) == 1:
                continue
            for k in range(1, len(p)):
                if (x := symbol.get(p[:k])) is not None and (y := symbol.get(p[k:])) is not None:
                    pairs[x << 32 | y] = symbol[p]
        for c, i in symbol.items():
            if len(c) == 1:
                of_char[ord(c)] = i
        keys = np.array(sorted(pairs), np.int64)
        return ids, order, of_char, keys, np.array([pairs[k] for k in keys.tolist()], np.int32)

    def merge_many(self, chunks: list[str], keys: np.ndarray | None) -> tuple[Ragged, Ragged | None]:
        """Ids of many chunks at once, with dropout by ``keys`` or without, and the codes of the
        merges made: in each round every chunk takes the best of its agenda.

        Whether a candidate is skipped depends on its place and piece alone, so it makes no
        difference that it is skipped on entering the agenda, and the result is that of ``merge``.
        """
        if self.tables is None:
            self.tables = self._tables()
        ids, order, of_char, joins, joined = self.tables
        sizes = np.array([len(c) for c in chunks], np.int64)
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        place = np.arange(n) - np.repeat(ends - sizes, sizes)
        sym = np.append(of_char[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)], np.int32(len(ids) - 1))
        right, left = np.arange(1, n + 2), np.arange(-1, n)  # n stands for no neighbour
        right[ends - 1] = right[n] = left[ends - sizes] = left[n] = n
        owner = np.repeat(np.arange(len(chunks)), sizes)

        def codes(at: np.ndarray, piece: np.ndarray) -> np.ndarray:
            return place[at].astype(np.uint64) * np.uint64(PLACE) + ids[piece].astype(np.uint64) * np.uint64(PIECE)

        def candidates(at: np.ndarray) -> np.ndarray:
            """The piece to which the symbols at these places and their neighbours join, or -1."""
            pair = sym[at].astype(np.int64) << 32 | sym[right[at]]
            found = np.minimum(np.searchsorted(joins, pair), len(joins) - 1)
            hit = np.flatnonzero(joins[found] == pair) if len(joins) else np.zeros(0, np.int64)
            out = np.full(len(at), -1, np.int32)
            piece = joined[found[hit]]
            if keys is not None:
                stays = ~self.skipped(keys[owner[at[hit]]], codes(at[hit], piece))
                hit, piece = hit[stays], piece[stays]
            out[hit] = piece
            return out

        agenda = np.append(candidates(np.arange(n)), np.int32(-1))
        alive = np.ones(n, bool)
        made: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at := np.flatnonzero(agenda >= 0)):
            first = np.flatnonzero(np.diff(owner[at], prepend=-1))
            a = np.minimum.reduceat(order[agenda[at]] << 32 | at, first) & 0xFFFFFFFF
            b = right[a]
            sym[a] = agenda[a]
            if keys is None:
                made.append((owner[a], codes(a, sym[a])))
            right[a] = right[b]
            left[right[a]] = a
            left[n] = n
            alive[b], agenda[b] = False, -1
            agenda[a] = candidates(a)
            before = left[a]
            before = before[before < n]
            agenda[before] = candidates(before)
        found = ids[sym[:n][alive]]
        out = Ragged(found, np.bincount(owner[alive], minlength=len(chunks)))
        odd = np.unique(owner[alive][found < 0])  # chunks with characters that no piece has
        if len(odd):
            which = np.arange(len(chunks))
            which[odd] = len(chunks) + np.arange(len(odd))
            out = (out + Ragged.of([self.chunk_ids(chunks[i], int(keys[i]) if keys is not None else 0) for i in odd.tolist()], np.int32)).take(which)
        if keys is not None:
            return out, None
        of, code = np.concatenate([np.zeros(0, np.int64), *(m[0] for m in made)]), np.concatenate([np.zeros(0, np.uint64), *(m[1] for m in made)])
        return out, Ragged(code[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(chunks)))

    def _learn(self, chunks: list[str]) -> None:
        """Ids and merges without dropout of chunks that aren't known."""
        limit, self.limit = self.limit, 0
        for i in range(0, len(chunks), AT_ONCE):
            ids, codes = self.merge_many(chunks[i : i + AT_ONCE], None)
            self.ids, self.codes = self.ids + ids, self.codes + codes
        self.limit = limit
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts; blanks are BLANK inside, and one stands before each text."""
        every, bounds, alone, keys = [], [0], {}, [np.zeros(0, np.uint64)]
        for text in texts:
            if text:
                literal = None
                if BLANK in text:  # it takes the place of a character that no piece has
                    used = set(text)
                    literal = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in used and c not in self.plain)
                    text = text.replace(BLANK, literal)
                chunks = self.CHUNK.findall((" " + text).replace(" ", BLANK))
                base = np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), self.seed))
                keys.append(mix(base + np.arange(1, len(chunks) + 1, dtype=np.uint64) * np.uint64(PLACE)))
                if literal or max(map(len, chunks)) >= LONG:
                    alone |= {len(every) + i: literal for i, c in enumerate(chunks) if len(c) >= LONG or literal and literal in c}
                every += chunks
            bounds.append(len(every))
        key = np.concatenate(keys)
        usual = every
        if alone:
            usual = every.copy()
            for i in alone:
                usual[i] = BLANK
        if len(self.known) > REMEMBERED:
            self._forget()
        which = list(map(self.known.get, usual))
        if None in which:
            self._learn(list({c: None for c, x in zip(usual, which) if x is None}))
            which = map(self.known.__getitem__, usual)
        which = np.fromiter(which, np.int64, len(usual))
        anew, n = [], len(self.known)
        if self.limit:
            codes = self.codes.take(which)
            lost = np.r_[0, np.cumsum(self.skipped(np.repeat(key, codes.size), codes.flat))]
            changed = np.flatnonzero(lost[codes.start + codes.size] > lost[codes.start])
            for i in range(0, len(changed), AT_ONCE):
                part = changed[i : i + AT_ONCE]
                anew.append(self.merge_many([usual[k] for k in part.tolist()], key[part])[0])
            which[changed] = n + np.arange(len(changed))
            n += len(changed)
        if alone:
            anew.append(Ragged.of([self.chunk_ids(every[i], int(key[i]), literal if literal and literal in every[i] else None) for i, literal in alone.items()], np.int32))
            which[list(alone)] = n + np.arange(len(alone))
        flat = Ragged(np.concatenate([self.ids.flat, *(x.flat for x in anew)]), np.concatenate([self.ids.size, *(x.size for x in anew)])).take(which)
        ends = np.r_[0, np.cumsum(flat.size)][bounds].tolist()
        return [flat.flat[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode()[1:]


_coders: dict[tuple, MergeCoder] = {}


def encode_pieces(spark: SparkSession, docs: DataFrame, model: str, rate: float = 0.1, seed: int = 7, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id if not given), then ids array<int>, n_tokens, lossless.

    lossless: decoding the ids gave the text back. Narrow, no shuffle; the model is bounded by
    MOST_PIECES and broadcast.
    """
    small_batches(spark)
    plain, of_bytes, name = read_pieces(model)
    shared = spark.sparkContext.broadcast((plain, of_bytes))
    key = (name, rate, seed)
    keep = ["doc_id"] if keep is None else keep
    kept = docs.select(*keep, F.col(text_col).cast("string").alias("_text_to_encode"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _coders:
            _coders.clear()
            _coders[key] = MergeCoder(*shared.value, rate, seed)
        coder = _coders[key]
        for batch in batches:
            ids, same = [], []
            every = [text or "" for text in batch.column(batch.num_columns - 1).to_pylist()]
            for a, b in chunks([len(text) for text in every]):
                ids += coder.encode_many(every[a:b])
                same += [coder.decode(x.tolist()) == text for x, text in zip(ids[a:b], every[a:b])]
            sizes = np.array([len(x) for x in ids], np.int32)
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array(sizes), pa.array(same)], [*batch.schema.names[:-1], "ids", "n_tokens", "lossless"])

    schema = kept.drop("_text_to_encode").schema.add("ids", ArrayType(IntegerType())).add("n_tokens", "integer").add("lossless", "boolean")
    return kept.mapInArrow(encode, schema)


def decode_pieces(spark: SparkSession, encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """doc_id and the text that the ids stand for (null ids: empty)."""
    shared = spark.sparkContext.broadcast(read_pieces(model)[:2])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = MergeCoder(*shared.value)
        for batch in batches:
            text = [coder.decode(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    kept = encoded.select(F.col(id_col).alias("doc_id"), "ids")
    return kept.mapInArrow(decode, kept.select("doc_id").schema.add("text", "string"))
