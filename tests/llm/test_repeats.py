"""Substring dedup and suffix dedup against brute force."""

import collections
import hashlib
import random

import pytest

from fluxalign.llm.substring_dedup import SuffixAutomaton, substring_dedup
from fluxalign.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string"


def brute_words(rows, w):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for a in range(len(words) - w + 1):
            k = tuple(words[a : a + w])
            if k in seen:
                gone[a : a + w] = [True] * w
            seen.add(k)
        out[i] = (len(words), sum(gone), b" ".join(x for x, g in zip(words, gone) if not g).decode())
    return out


def brute_bytes(rows, w):
    raw = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[a : a + w] for _, b in raw for a in range(len(b) - w + 1))
    out = {}
    for i, b in raw:
        gone = bytearray(len(b))
        for a in range(len(b) - w + 1):
            if count[b[a : a + w]] > 1:
                gone[a : a + w] = b"\1" * w
        out[i] = (len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), bytes(x for x, g in zip(b, gone) if not g))
    return out


def corpus():
    rng = random.Random(3)
    words = ["the", "of", "é", "漢字", "a", "b", "c"] + [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = []
    for i in range(60):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))
        texts.append(t + "\n" + passage + " " + t[:20] if i % 3 == 0 else t)
    texts += [texts[0], texts[0], texts[4] + " x", None, "", "ha " * 50, "ha " * 50 + "ho", "ab" * 200, "\x85\xa0 \x1c x"]
    return list(enumerate(texts))


@pytest.mark.parametrize("crowd", [50_000, 2])
def test_against_brute_force(spark, crowd):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(df, 6, crowd=crowd).collect()}
    assert got == brute_words(rows, 6)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(df, 20, crowd=crowd).collect()}
    assert got == brute_bytes(rows, 20)


def test_digests_are_of_the_kept_text(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    kept = {r.doc_id: r.kept for r in substring_dedup(df, 6).collect()}
    assert {r.doc_id: r.kept_sha256 for r in substring_dedup(df, 6, digest=True).collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()}


def test_null_ids_repeated_rows_and_extra_columns(spark):
    t = " ".join(map(str, range(10)))
    rows = [(None, t, 1), (5, t, 2), (5, t, 3)]
    df = spark.createDataFrame(rows, SCHEMA + ", pk long")
    words = sorted((str(r.doc_id), r.n_removed) for r in substring_dedup(df, 6).collect())
    assert words == [("5", 10), ("5", 10), ("None", 0)]  # the null document comes first
    once = spark.createDataFrame(rows[1:], SCHEMA + ", pk long")
    assert [r.n_removed for r in substring_dedup(once, 6).collect()] == [0, 0]  # one place, not two
    assert [r.n_removed for r in suffix_dedup(once, 10).collect()] == [len(t)] * 2


def test_texts_of_one_id_are_documents_of_their_own(spark):
    """Two different texts under one id, or none: only what repeats is cut, in its own text."""
    rng = random.Random(9)
    text = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    passage, own = text(12), [text(30) for _ in range(4)]
    rows = [(5, own[0]), (5, f"{own[1]} {passage}"), (None, own[2]), (None, f"{own[3]} {passage}"), (9, passage)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", th long, marks int")
    by = {r.kept: (r.doc_id, r.n_removed) for r in substring_dedup(df, 6).collect()}
    assert by == {own[0]: (5, 0), own[1]: (5, 12), own[2]: (None, 0), f"{own[3]} {passage}": (None, 0), "": (9, 12)}
    raw = {bytes(r.kept): (r.doc_id, r.n_removed) for r in suffix_dedup(df, 20).collect()}
    assert raw[own[0].encode()] == (5, 0) and raw[own[2].encode()] == (None, 0)
    assert sorted(n for _, n in raw.values() if n) == sorted([len(passage) + 1] * 2 + [len(passage)])


@pytest.mark.parametrize("words, w", [(60, 20), (52, 20)])
def test_registered_sizes_on_planted_passages(spark, words, w):
    """20 words and 400 bytes, as registered, against brute force; and very long texts."""
    rng = random.Random(words)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 10)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(words) for _ in range(6)] + [text(90) for _ in range(6)]
    rows = [(i, f"{text(80)} {passages[i % 12]} {text(70)}") for i in range(48)] + [(90, text(40_000)), (91, "x" * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup(df).collect()}
    assert got == brute_words(rows, w)
    small = [r for r in rows if r[0] != 91]  # brute force on one repeated byte is too slow
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup(df).collect()}
    assert {i: v for i, v in got.items() if i != 91} == brute_bytes(small, 400) and got[91] == (200_000, 200_000, 1, b"")


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(df).count() == 0 and suffix_dedup(df).count() == 0


def test_automaton_knows_first_places():
    rng = random.Random(1)
    seqs = [[rng.choice([b"a", b"b"]) for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    m, begin = SuffixAutomaton(), []
    for s in seqs:
        begin.append(m.size)
        m.add(s)
    seen = set()
    for s, b in zip(seqs, begin):
        flags = m.earlier(s, b, 4)
        for i in range(len(s) - 3):
            k = tuple(s[i : i + 4])
            assert flags[i] == (k in seen)
            seen.add(k)
