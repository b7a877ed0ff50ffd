"""Token ids in binary files of patched frame-of-reference blocks.

A file holds blocks of BLOCK ids, an index of the blocks' starts, and the documents whose ids they
are, end to end. A block stores its least id and what the ids exceed it by, packed at a width that
holds a chosen percentile of these differences (of PERCENTILES, the one that makes the block
smallest); the high bits of those that don't fit follow in a list of exceptions. Documents are
dealt by range of doc_id, so files in the order of their names hold all documents in ascending
order, and a task writes its files block by block as it encodes. Files are written under another
name and renamed when whole, and a task that runs again writes the same files.

Layout, little-endian: blocks of (least u32, width u8, number of exceptions u16, packed words u64 x
4 width, places u8, high bits u32); starts of the blocks u64; then for each document: whether it
has an id u8, its id i64, its number of ids u64; last: numbers of ids, blocks and documents u64,
crc32 of the index and the documents u32, magic of 8 bytes. The last block is filled up with its
last id.

Ids come from the tokenizers library. White space separates words before anything else in such a
vocabulary, so texts are taken apart into words for a whole batch at once, each worker keeps the ids
of up to KEPT parts (told apart by 128-bit hashes) and asks the library for new ones only. Words of
printable ASCII and Latin-1 letters are cut at the tokenizer's own places (letters, single digits,
other signs) and the parts go to its model; words with an apostrophe or any other sign go through the
library as they are, and so do whole texts that may hold a special token.

Files go to the session's checkpoint folder unless a folder is named; they are read back with
Spark's binaryFile source. Offsets of files come from a list with one row for each file.

Defined cases: null text is empty and has the end id only; a null doc_id comes before all others;
rows with the same doc_id stand in the order of a hash of their texts; repeated rows are documents
each; an empty table gives an empty result; extra columns are ignored. Ids are below 2^32.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, partitions, shared_folder, small_batches, text_hash, texts

BLOCK, LANES = 256, 64
PERCENTILES = (75, 90, 95, 99, 100)
HEAD, PATCH, TRAIL, MAGIC = 7, 5, 36, b"PFORIDS1"
SPACE = re.compile(rb"[ \t\n\v\f\r]")
#: Ids that are held before blocks are written, and ids after which a file ends with its document.
CHUNK, MOST_IDS = 1 << 20, 1 << 25
#: Parts and ids that a worker keeps; beyond that it starts anew. SLOTS: of its hash table.
KEPT, KEPT_IDS, SLOTS = 3_000_000, 1 << 25, 1 << 23
#: Bytes that are taken apart at once, and the length from which a part is hashed by itself.
PIECE, LONG = 1 << 20, 64
#: ASCII to lower case; the kind of each byte of a text (0 space, 1 letter, 2 digit, 3 other, 4 none of these).
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
KIND = np.array([0 if c in b" \t\n\v\f\r" else 2 if 48 <= c <= 57 else 1 if 97 <= c <= 122 or c == 0xC3 else 3 if 32 < c < 127 and c != 39 else 4 for c in range(256)], np.uint8)
#: Random numbers by place in a part and byte, whose sums are the hashes of parts.
RANDOM = np.random.default_rng(11).integers(0, 1 << 64, (2, LONG * 256), np.uint64)
#: Bits of a 16-bit number.
BITS = np.array([n.bit_length() for n in range(1 << 16)], np.uint8)


def pack(v: np.ndarray, width: int) -> np.ndarray:
    """Blocks (m, BLOCK) of numbers under 2^width as words (m, 4 width)."""
    lanes = np.ascontiguousarray(v.reshape(-1, LANES).T, np.uint64)
    out = np.zeros((width, lanes.shape[1]), np.uint64)
    for j in range(LANES if width else 0):
        word, shift = divmod(j * width, 64)
        out[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).reshape(len(v), -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    m = len(words)
    lanes = np.zeros((LANES, 4 * m), np.uint64)
    each, mask = np.ascontiguousarray(words.reshape(4 * m, width).T), np.uint64((1 << width) - 1)
    for j in range(LANES if width else 0):
        word, shift = divmod(j * width, 64)
        lanes[j] = each[word] >> np.uint64(shift)
        if shift + width > 64:
            lanes[j] |= each[word + 1] << np.uint64(64 - shift)
        lanes[j] &= mask
    return lanes.T.reshape(m, BLOCK)


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of whole blocks (m, BLOCK) of ids, and the blocks' sizes."""
    m = len(ids)
    least = ids.min(axis=1)
    over = ids - least[:, None]
    bits = np.where(over >> 16, BITS[over >> 16] + np.uint8(16), BITS[over & 0xFFFF])
    places = [-(-BLOCK * p // 100) - 1 for p in PERCENTILES]
    widths = np.partition(bits, places, axis=1)[:, places]
    patches = np.stack([(bits > widths[:, [k]]).sum(axis=1) for k in range(len(places))], axis=1)
    best = (32 * widths.astype(np.int64) + PATCH * patches).argmin(axis=1)
    width, patched = widths[np.arange(m), best], patches[np.arange(m), best]
    size = HEAD + 32 * width.astype(np.int64) + PATCH * patched
    start = np.r_[0, np.cumsum(size)]
    out = np.empty(start[-1], np.uint8)
    head = np.zeros(m, np.dtype([("least", "<u4"), ("width", "u1"), ("patched", "<u2")]))
    head["least"], head["width"], head["patched"] = least, width, patched
    out[start[:-1, None] + np.arange(HEAD)] = head.view(np.uint8).reshape(m, HEAD)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        words = pack(over[at] & np.uint32((1 << w) - 1), w).astype("<u8").view(np.uint8).reshape(len(at), -1)
        out[start[at, None] + HEAD + np.arange(32 * w)] = words
    block, place = np.nonzero(bits > width[:, None])
    rank = np.arange(len(block)) - np.repeat(np.cumsum(patched) - patched, patched)
    tail = start[block] + HEAD + 32 * width[block].astype(np.int64)
    out[tail + rank] = place
    high = (over[block, place] >> width[block]).astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(tail + patched[block] + 4 * rank)[:, None] + np.arange(4)] = high
    return out.tobytes(), size


class TokenFile:
    """Reads one file's bytes; any run of ids is read from its own blocks only."""

    def __init__(self, raw: bytes) -> None:
        self.raw = np.frombuffer(raw, np.uint8)
        self.n_ids, blocks, documents = np.frombuffer(raw[-TRAIL:-12], "<u8").tolist()
        crc = int.from_bytes(raw[-12:-8], "little")
        at = len(raw) - TRAIL - 17 * documents - 8 * blocks
        if raw[-8:] != MAGIC or zlib.crc32(raw[at:-TRAIL]) != crc:
            raise ValueError("no file of token ids, or a damaged one")
        self.starts = np.frombuffer(raw, "<u8", blocks, at).astype(np.int64)
        at += 8 * blocks
        self.has_id = np.frombuffer(raw, np.bool_, documents, at)
        self.doc_ids = np.frombuffer(raw, "<i8", documents, at + documents)
        self.counts = np.frombuffer(raw, "<u8", documents, at + 9 * documents).astype(np.int64)

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids from place a to b of the file."""
        first = a // BLOCK
        start = self.starts[first : -(-b // BLOCK)]
        head = self.raw[start[:, None] + np.arange(HEAD)]
        least, width, patched = head[:, :4].copy().view("<u4")[:, 0], head[:, 4].astype(np.int64), head[:, 5:].copy().view("<u2")[:, 0].astype(np.int64)
        out = np.zeros((len(start), BLOCK), np.uint64)
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            out[at] = unpack(self.raw[start[at, None] + HEAD + np.arange(32 * w)].view("<u8"), w)
        block = np.repeat(np.arange(len(start)), patched)
        rank = np.arange(len(block)) - np.repeat(np.cumsum(patched) - patched, patched)
        tail = start[block] + HEAD + 32 * width[block]
        high = self.raw[(tail + patched[block] + 4 * rank)[:, None] + np.arange(4)].view("<u4")[:, 0]
        out[block, self.raw[tail + rank]] |= high.astype(np.uint64) << width[block].astype(np.uint64)
        return (out.astype(np.uint32) + least[:, None]).ravel()[a - first * BLOCK : b - first * BLOCK]


class Writer:
    """Writes the files of one task: ``add`` documents, then ``close``; a file ends with the document
    that reaches ``most_ids``."""

    def __init__(self, folder: str, task: int, most_ids: int) -> None:
        self.folder, self.task, self.most, self.number, self.done = folder, task, most_ids, 0, []
        self._begin()

    def _begin(self) -> None:
        self.sink, self.at, self.held, self.n_held, self.n_ids, self.starts, self.documents = None, 0, [], 0, 0, [], []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents with the ids that they have, end to end."""
        ends, at, done = np.cumsum(counts), 0, 0
        while at < len(ends):
            if self.sink is None:
                self.name = f"{self.task:06d}-{self.number:06d}.pfor"
                self.fs, self.path = filesystem(self.folder)
                self.part = f"{self.path}/{self.name}.{uuid.uuid4().hex}.part"
                self.sink = self.fs.open_output_stream(self.part)
            to = min(int(np.searchsorted(ends, done + self.most - self.n_ids)) + 1, len(ends))
            self.documents += [(d is not None, d or 0, n) for d, n in zip(doc_ids[at:to], counts[at:to].tolist())]
            self.held.append(ids[done : ends[to - 1]])
            self.n_held, self.n_ids = self.n_held + len(self.held[-1]), self.n_ids + len(self.held[-1])
            at, done = to, int(ends[to - 1])
            if self.n_held >= CHUNK:
                self._flush(False)
            if self.n_ids >= self.most:
                self.close()

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held)
        whole = len(ids) // BLOCK * BLOCK
        if last and whole < len(ids):
            whole += BLOCK
            ids = np.r_[ids, np.full(whole - len(ids), ids[-1], np.uint32)]
        for a in range(0, whole, CHUNK):
            raw, size = encode_blocks(ids[a : min(a + CHUNK, whole)].reshape(-1, BLOCK))
            self.starts += (self.at + np.r_[0, np.cumsum(size)[:-1]]).tolist()
            self.sink.write(raw)
            self.at += len(raw)
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        if self.sink is None:
            return
        if self.n_held:
            self._flush(True)
        has_id, doc_id, counts = zip(*self.documents)
        index = b"".join(np.array(x, t).tobytes() for x, t in ((self.starts, "<u8"), (has_id, np.bool_), (doc_id, "<i8"), (counts, "<u8")))
        trail = np.array([self.n_ids, len(self.starts), len(counts)], "<u8").tobytes() + zlib.crc32(index).to_bytes(4, "little") + MAGIC
        self.sink.write(index + trail)
        self.sink.close()
        self.fs.move(self.part, f"{self.path}/{self.name}")
        self.done.append((self.name, len(counts), self.n_ids, self.at + len(index) + len(trail)))
        self.number += 1
        self._begin()


def filesystem(folder: str):
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


class Parts:
    """Bytes of texts in lower case, taken apart: start, end and hashes of each part, and whether it
    stands for a word that only the library can take apart."""

    def __init__(self, data: np.ndarray) -> None:
        low = LOWER[data]
        after_lead = np.r_[False, low[:-1] == 0xC3]
        low[after_lead & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)] += 0x20
        kind = KIND[low]
        kind[after_lead] = np.where((low[after_lead] == 0x97) | (low[after_lead] == 0xB7), 4, 1)
        space = kind == 0
        before = np.r_[np.uint8(0), kind[:-1]]
        first = ~space & (before == 0)
        begins = ~space & ((kind != before) | (kind == 2))
        odd = kind == 4
        if odd.any():
            word = np.cumsum(first) - 1
            whole = np.zeros(word[-1] + 1 if len(word) else 0, bool)
            whole[word[odd]] = True
            begins &= first | ~whole[word]
            self.start = np.flatnonzero(begins)
            self.whole = whole[word[self.start]]
        else:
            self.start = np.flatnonzero(begins)
            self.whole = np.zeros(len(self.start), bool)
        stops = np.r_[np.flatnonzero(begins | space & (before != 0)), len(low)]
        self.end = stops[np.searchsorted(stops, self.start) + 1]
        lens = self.end - self.start
        place = np.flatnonzero(~space)
        offsets = np.cumsum(lens) - lens
        place = np.minimum(np.arange(len(place)) - np.repeat(offsets, lens), LONG - 1) * 256 + low[place]
        self.hashes = np.stack([np.add.reduceat(r[place], offsets) if len(place) else np.zeros(0, np.uint64) for r in RANDOM])
        self.low = low
        for k in np.flatnonzero(lens >= LONG).tolist():
            self.hashes[:, k] = np.frombuffer(hashlib.blake2b(self.bytes(k), digest_size=16).digest(), np.uint64)

    def bytes(self, k: int) -> bytes:
        return self.low[self.start[k] : self.end[k]].tobytes()


class WordIds:
    """Ids of texts, from the library's tokenizer; ids of parts are kept."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in [*range(33, 127), *range(192, 256)]}
        self.clear()

    def clear(self) -> None:
        self.slots = np.zeros(SLOTS, np.int32)
        self.hashes, self.count = np.zeros((2, 1 << 16), np.uint64), 1  # number 0 is no part
        self.ends = np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def _numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each part; 0 where it isn't kept."""
        out = np.zeros(hashes.shape[1], np.int32)
        left = np.arange(hashes.shape[1])
        at = (hashes[0] & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(left):
            number = self.slots[at]
            same = (self.hashes[:, number] == hashes[:, left]).all(axis=0) & (number > 0)
            out[left[same]] = number[same]
            more = ~same & (number > 0)
            left, at = left[more], (at[more] + 1) & (SLOTS - 1)
        return out

    def _keep(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """New parts, each once."""
        flat, first, last = np.array([i for x in ids for i in x], np.uint32), self.count, self.count + len(ids)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        while last > len(self.ends):
            self.ends, self.hashes = np.r_[self.ends, np.zeros_like(self.ends)], np.concatenate([self.hashes, np.zeros_like(self.hashes)], axis=1)
        self.pool[self.used : self.used + len(flat)] = flat
        self.ends[first:last] = self.used + np.cumsum([len(x) for x in ids])
        self.hashes[:, first:last] = hashes
        self.used, self.count = self.used + len(flat), last
        left, at = np.arange(first, last, dtype=np.int32), (hashes[0] & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(left):
            free = self.slots[at] == 0
            self.slots[at[free]] = left[free]
            more = self.slots[at] != left
            left, at = left[more], (at[more] + 1) & (SLOTS - 1)

    def _learn(self, parts: Parts, new: np.ndarray) -> None:
        model, whole = self.tokenizer.model, new[parts.whole[new]]
        plain = new[~parts.whole[new]]
        ids = [[t.id for t in model.tokenize(parts.bytes(k).decode().translate(self.letters))] for k in plain.tolist()]
        if len(whole):
            ids += [e.ids for e in self.tokenizer.encode_batch_fast([parts.bytes(k).decode() for k in whole.tolist()], add_special_tokens=False)]
        self._keep(parts.hashes[:, np.r_[plain, whole]], ids)

    def _piece(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts between white space, the starts of their parts, and the parts' numbers of ids."""
        parts = Parts(data)
        if self.count > KEPT or self.used > KEPT_IDS:
            self.clear()
        number = self._numbers(parts.hashes)
        missing = np.flatnonzero(number == 0)
        if len(missing):
            self._learn(parts, missing[np.unique(parts.hashes[0, missing], return_index=True)[1]])
            number[missing] = self._numbers(parts.hashes[:, missing])
        begin = self.ends[number - 1]
        lens = self.ends[number] - begin
        before = np.cumsum(lens) - lens
        return self.pool[np.repeat(begin - before, lens) + np.arange(lens.sum())], parts.start, lens

    def encode(self, raws: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with the end id, and their numbers."""
        out: list[np.ndarray] = []
        counts = np.ones(len(raws), np.int64)
        end = np.array([end_id], np.uint32)
        held: list[bytes] = []
        first = size = 0

        def flush(to: int) -> None:
            """The texts held are those of the documents from first to before ``to``, whole."""
            if to == first:
                return
            data = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
            ids, start, lens = self._piece(data)
            ends = np.cumsum([len(h) + 1 for h in held])
            by = np.r_[0, np.cumsum(lens)][np.searchsorted(start, ends)]
            counts[first:to] += np.diff(by, prepend=0)
            out.append(np.insert(ids, by, end_id).astype(np.uint32))

        for d, raw in enumerate(raws):
            low = raw.lower()
            special = any(s in low for s in self.special)
            if special or len(raw) > PIECE or size + len(raw) > PIECE:
                flush(d)
                held, first, size = [], d, 0
            if special or len(raw) > PIECE:
                each = [np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, np.uint32)] if special else [self._piece(np.frombuffer(p, np.uint8))[0] for p in pieces(raw)]
                out += [*each, end]
                counts[d] += sum(map(len, each))
                first = d + 1
            else:
                held.append(raw)
                size += len(raw) + 1
        flush(len(raws))
        return np.concatenate([np.zeros(0, np.uint32), *out]), counts


def pieces(raw: bytes) -> Iterator[bytes]:
    """A long text in pieces, between words."""
    at = 0
    while at < len(raw):
        cut = SPACE.search(raw, at + PIECE)
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end


#: The encoder that a worker used last, by the digest of its definition.
_encoders: dict[str, WordIds] = {}


def write_ids(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, most_ids: int = MOST_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files; a row (file, n_docs, n_ids, n_bytes) for each."""
    small_batches(spark)
    with open(tokenizer) as f:
        text = f.read()
    name, definition = hashlib.sha256(text.encode()).hexdigest(), spark.sparkContext.broadcast(text)
    filesystem(folder)[0].create_dir(filesystem(folder)[1])
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text).alias("th"), F.monotonically_increasing_id().alias("copy"), text.alias("text"))
    dealt = rows.repartitionByRange(partitions(docs), F.asc_nulls_first("doc_id"), "th", "copy").sortWithinPartitions(F.asc_nulls_first("doc_id"), "th")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = WordIds(definition.value)
        encoder, out = _encoders[name], Writer(folder, TaskContext.get().partitionId(), most_ids)
        for batch in batches:
            out.add(batch.column("doc_id").to_pylist(), *encoder.encode(texts(batch.column("text")), end_id))
        out.close()
        if out.done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out.done)], ["file", "n_docs", "n_ids", "n_bytes"])

    return durable(dealt.select("doc_id", "text").mapInArrow(write, "file string, n_docs long, n_ids long, n_bytes long"))


READ = "file string, place long, doc_id long, start long, n_tokens long, ids_crc32 long"


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """file, place, doc_id, start (within the file), n_tokens, ids_crc32: each document of the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(batch.column(c) for c in ("path", "content"))):
                file = TokenFile(content.as_py())
                ends = np.cumsum(file.counts)
                crcs, chunk, base = [], np.zeros(0, "<u4"), 0  # chunk: the ids from place base
                for a, b in zip((ends - file.counts).tolist(), ends.tolist()):
                    crc = 0
                    while a < b:
                        if a >= base + len(chunk):
                            base, chunk = a, file.ids(a, min(a + CHUNK, file.n_ids)).astype("<u4")
                        to = min(b, base + len(chunk))
                        crc = zlib.crc32(chunk[a - base : to - base].tobytes(), crc)
                        a = to
                    crcs.append(crc)
                n = len(ends)
                yield pa.RecordBatch.from_arrays([
                    pa.array([path.as_py().rpartition("/")[2]] * n), pa.array(np.arange(n)), pa.array(file.doc_ids.astype(np.int64), mask=~file.has_id), pa.array(ends - file.counts),
                    pa.array(file.counts), pa.array(np.array(crcs, np.int64))], ["file", "place", "doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, READ)


def token_ids(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, most_ids: int = MOST_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: each document as read back from the files, with the
    number of ids of all documents before it."""
    folder = folder or f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    files = write_ids(spark, docs, tokenizer, folder, end_id, most_ids, id_col, text_col)
    before = F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = files.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    read = read_ids(spark, folder).join(offsets, "file")
    return read.select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
