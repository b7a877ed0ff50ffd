"""Token files against the library and a plain reading of the format."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from fluxalign.llm import queries, token_files
from fluxalign.llm.oracles import TOKENIZERS

from ..conftest import TINY

FILE = f"{TOKENIZERS}/word_bpe_49k.json"


def brute(rows):
    """doc_id, start, n_tokens, crc by the library on whole texts."""
    tokenizer, at, out = Tokenizer.from_file(FILE), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    return out


def test_the_registered_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op12_token_files(spark, TINY).collect())) == brute(rows)


HARD = [
    "", None, " \t\r\n\v\f", "It's we'LL they'd 'tis ''s x'sy I'M", "Ünïcode ÀÉÎ ßß Straße ÿ×÷", "a b c\x1cd\x85e", "é é É ́x", "<|endoftext|>a <|ENDOFTEXT|> x<|startoftext|>", "Σίσυφος ΟΔΟΣ İI K", "日本語 한국어 العربية हिन्दी",
    "12345 3.14 ²³½ a1b2", "don't!!!...,,,--- #$%&", "x" * 5000, "漢" * 3000, "\x00\x01 nul", "\U0001f600😀👍🏽 e‍moji", "ﬁ ŀ ŉ ǆ", "ª º µ aªb", "'S 'T 'RE", "the  of\n\nand"]


def test_hard_texts(spark):
    rng = random.Random(4)
    letters = "abcXYZ'éÉ́ .,!9\nßİ<|>-あ "
    rows = [(i, t) for i, t in enumerate(HARD)] + [(100 + i, "".join(rng.choice(letters) for _ in range(300))) for i in range(60)]
    rows += [(170 + i, "plain words, 12 and é " * n) for i, n in enumerate((1, 60_000, 60_000, 3))] + [(180, "l" * 1_100_000 + " ß" * 20), (181, "<|endoftext|> " + "a b " * 300_000)]
    rows += [(None, "nobody"), (200, "twice " * 40), (200, "twice " * 40), (-5, "the word " * 90_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS th", "2 AS copy", "3 AS file", "4 AS start").repartition(5)
    for most_ids in (token_files.MOST_IDS, 500):
        got = token_files.token_ids(spark, df, FILE, most_ids=most_ids).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows)
    assert token_files.token_ids(spark, df.limit(0), FILE).count() == 0


def test_rows_of_one_id_have_an_order(spark):
    rows = [(1, f"text {i} of one id") for i in range(30)] + [(None, "a"), (None, "a")]
    got = [[tuple(r) for r in token_files.token_ids(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(n), FILE).orderBy("start").collect()] for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 32 and got[0][0][:2] == (None, 0)


def plain(raw):
    """The ids of a file, bit by bit."""
    n_ids, blocks, documents = (int.from_bytes(raw[-36 + 8 * k : -28 + 8 * k], "little") for k in range(3))
    index = len(raw) - 36 - 17 * documents - 8 * blocks
    out = []
    for b in range(blocks):
        at = int.from_bytes(raw[index + 8 * b : index + 8 * b + 8], "little")
        least, width, patched = int.from_bytes(raw[at : at + 4], "little"), raw[at + 4], int.from_bytes(raw[at + 5 : at + 7], "little")
        values = []
        for group in range(4):  # 64 numbers of the same width, the first in the lowest bits
            bits = int.from_bytes(raw[at + 7 + 8 * width * group : at + 7 + 8 * width * (group + 1)], "little")
            values += [bits >> width * j & (1 << width) - 1 for j in range(64)]
        tail = at + 7 + 32 * width
        for e in range(patched):
            values[raw[tail + e]] |= int.from_bytes(raw[tail + patched + 4 * e : tail + patched + 4 * e + 4], "little") << width
        out += [least + v for v in values]
    return out[:n_ids], blocks


@pytest.mark.parametrize("kind", ["flat", "outliers", "wide", "mixed", "one"])
def test_blocks_hold_any_ids(tmp_path, kind):
    rng = np.random.default_rng(6)
    n = {"one": 1}.get(kind, 5000)
    ids = {"flat": np.full(n, 7), "outliers": np.where(rng.random(n) < 0.03, rng.integers(0, 1 << 32, n), 40_000 + rng.integers(0, 16, n)), "wide": rng.integers(0, 1 << 32, n),
           "mixed": rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n), "one": np.array([49_407])}[kind].astype(np.uint32)
    out = token_files.Writer(str(tmp_path), 3, 1 << 20)
    cuts = sorted({0, n, *rng.integers(0, n, 8).tolist()})
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        out.add([k or None], ids[a:b], np.array([b - a]))
    out.close()
    assert [d[:3] for d in out.done] == [("000003-000000.pfor", len(cuts) - 1, n)] and [p.name for p in tmp_path.iterdir()] == ["000003-000000.pfor"]
    raw = (tmp_path / "000003-000000.pfor").read_bytes()
    values, blocks = plain(raw)
    assert values == ids.tolist() and blocks == -(-n // 256)
    file = token_files.TokenFile(raw)
    assert file.has_id.tolist() == [False] + [True] * (len(cuts) - 2) and file.counts.tolist() == np.diff(cuts).tolist()
    for a, b in [(0, n), (n - 1, n), *(sorted(rng.integers(0, n, 2).tolist()) for _ in range(10))]:
        assert file.ids(a, b).tolist() == ids[a:b].tolist()
    if kind == "outliers":
        assert len(raw) < 1.2 * n  # four bits and the patches, not 32
    with pytest.raises(ValueError):
        token_files.TokenFile(raw[:-40] + b"\xff" + raw[-39:])
