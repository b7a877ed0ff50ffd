"""Token counts by a linear longest-match automaton.

Greedy longest match cuts a word into the longest vocabulary pieces from the left. The
automaton is the vocabulary's trie; every node has a failure link (the node reached once the
longest pieces of its string are cut off) and the number of pieces cut off on the way. A word's
count is then one walk over its bytes: no piece is built and no byte is read twice.

A word is a maximal run without ASCII white space; it is counted with a blank before it, as the
byte-level vocabularies have word beginnings. The vocabulary is a bounded file (its path is a
parameter) that the driver reads and broadcasts.

Defined cases: null or empty text has 0 words and 0 tokens; a byte that is not in the
vocabulary counts as one token; repeated rows are counted one by one; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record, small_batches, texts

#: Most vocabulary entries that are broadcast, and words whose counts a worker remembers.
MOST_PIECES, REMEMBERED = 1 << 20, 300_000


class LongestMatch:
    """Trie with failure links over byte strings."""

    def __init__(self, vocabulary: Iterable[bytes]) -> None:
        moves: dict[int, int] = {}
        parent, byte, final = [0], [0], [True]
        for piece in {*vocabulary, *(bytes([b]) for b in range(256))}:
            node = 0
            for b in piece:
                child = moves.get(node << 8 | b)
                if child is None:
                    child = moves[node << 8 | b] = len(parent)
                    parent.append(node)
                    byte.append(b)
                    final.append(False)
                node = child
            final[node] = True
        level = [0] * len(parent)
        for v in range(1, len(parent)):
            level[v] = level[parent[v]] + 1
        fail, popped = [-1] * len(parent), [0] * len(parent)
        for v in sorted(range(1, len(parent)), key=level.__getitem__):
            if final[v]:
                fail[v], popped[v] = 0, 1
                continue
            node, count = fail[parent[v]], popped[parent[v]]
            while node << 8 | byte[v] not in moves:  # single bytes are pieces: the root has every move
                count += popped[node]
                node = fail[node]
            fail[v], popped[v] = moves[node << 8 | byte[v]], count
        self.moves, self.fail, self.popped = moves, fail, popped

    def count(self, word: bytes) -> int:
        moves, fail, popped = self.moves, self.fail, self.popped
        node = total = 0
        for b in word:
            step = moves.get(node << 8 | b)
            while step is None:
                total += popped[node]
                node = fail[node]
                step = moves.get(node << 8 | b)
            node = step
        while node:
            total += popped[node]
            node = fail[node]
        return total


def read_vocabulary(path: str) -> list[bytes]:
    """Pieces of a .tiktoken file: a base64 string and a rank on each line."""
    with open(path, "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    if len(pieces) > MOST_PIECES:
        raise ValueError(f"the vocabulary has {len(pieces)} pieces; {MOST_PIECES} at most are broadcast")
    return pieces


_automata: dict[str, tuple[LongestMatch, dict]] = {}
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("longest_word_tokens", pa.int64())])


def token_counts(spark: SparkSession, docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens and the most tokens of one word; narrow, no shuffle."""
    small_batches(spark)
    pieces = read_vocabulary(vocabulary)
    name = hashlib.sha256(b"\n".join(map(base64.b64encode, pieces))).hexdigest()
    shared = spark.sparkContext.broadcast(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _automata:  # a worker that is used again keeps its automaton
            _automata.clear()
            _automata[name] = (LongestMatch(shared.value), {})
        automaton, known = _automata[name]
        for batch in batches:
            rows = []
            for raw in texts(batch.column(1)):
                counts = []
                for word in raw.split():
                    n = known.get(word)
                    if n is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        n = known[word] = automaton.count(b" " + word)
                    counts.append(n)
                rows.append((len(counts), sum(counts), max(counts, default=0)))
            if rows:
                yield record(OUT, batch.column(0).cast(pa.int64()), *map(list, zip(*rows)))

    ddl = "doc_id long, n_words long, n_tokens long, longest_word_tokens long"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, ddl)
