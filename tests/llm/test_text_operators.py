"""The other text operators on small inputs, against brute force or exact round trips."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxalign.llm import decontamination, jaccard_join, quality_rules, secrets_scan, toxicity
from fluxalign.llm.chat_format import chat_digest, chat_windows, escape, unescape
from fluxalign.llm.components import components
from fluxalign.llm.jaccard_join import jaccard_components
from fluxalign.llm.piece_encoding import MergeCoder, Ragged, decode_pieces, encode_pieces, read_pieces
from fluxalign.llm.quality_rules import quality
from fluxalign.llm.token_counts import LongestMatch, token_counts

MODEL, VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_50k.tiktoken"
DOC = "doc_id long, text string"
ODD = [None, "", " ", "\n", "▁ab ▁", "  x\t\u0000漢字🎉", "a" * 3000, "é" * 70]


def test_longest_match_equals_greedy():
    rng = random.Random(5)
    pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 6))) for _ in range(40)}
    m, every = LongestMatch(pieces), pieces | {bytes([b]) for b in range(256)}
    for _ in range(400):
        w, n, i = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 20))), 0, 0
        while i < len(w):
            i += max(k for k in range(1, len(w) - i + 1) if w[i : i + k] in every)
            n += 1
        assert m.count(w) == n


def test_token_counts_cases(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), DOC)
    got = {r.doc_id: r for r in token_counts(spark, df, VOCABULARY).collect()}
    assert len(got) == len(ODD) and got[0].n_tokens == got[1].n_tokens == 0 and got[6].n_words == 1
    assert token_counts(spark, df.limit(0), VOCABULARY).count() == 0


def test_pieces_decode_losslessly(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(ODD)], DOC + ", n_tokens long")
    out = encode_pieces(spark, df, MODEL, rate=0.3)
    assert out.where("not lossless").count() == 0
    back = {r.doc_id: r.text for r in decode_pieces(spark, out, MODEL).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}


def test_pieces_without_dropout_equal_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    sp, coder = sentencepiece.SentencePieceProcessor(model_file=MODEL), MergeCoder(*read_pieces(MODEL)[:2])
    for t in ("Hello  world, this is\n\na test", " x", "漢字🎉 naïve", "aaaaaaaaaaaaaaaaaaa"):
        assert sp.encode(t) == coder.encode(t).tolist()


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0])
def test_chunks_merged_together_equal_chunks_merged_alone(rate):
    rng = random.Random(3)
    coder = MergeCoder(*read_pieces(MODEL)[:2], rate, 11)
    chunks = ["▁", "\n", "▁▁▁ab", "aaaaaaaa", "漢字🎉", *("▁" + "".join(rng.choice("abeinrst'é.") for _ in range(rng.randrange(1, 30))) for _ in range(500))]
    keys = np.array([rng.randrange(1 << 64) for _ in chunks], np.uint64)
    assert coder.merge_many(chunks, keys)[0].lists() == [coder.chunk_ids(c, k) for c, k in zip(chunks, keys.tolist())]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.6])
def test_remembered_segmentations_change_nothing(rate):
    """Each occurrence equals its own agenda with its own key, remembered chunks or not."""
    rng = random.Random(31)
    words = ["unbelievable", "the", "segmentation", "漢字", "naïve", "x" * 60, "a▁b", ""]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(30)]
    coder = MergeCoder(*read_pieces(MODEL)[:2], rate, 5)
    seen = []
    plain = coder.chunk_ids
    first = [x.tolist() for x in coder.encode_many(texts)]
    of = lambda chunks, keys: Ragged.of([plain(c, int(k)) for c, k in zip(chunks, keys if keys is not None else [0] * len(chunks))], np.int32)
    coder.merge_many = lambda chunks, keys: seen.append(keys) or (of(chunks, keys), Ragged.of([[0]] * len(chunks), np.uint64))
    coder.skipped = lambda keys, codes: np.ones(len(codes), bool)  # every occurrence is merged anew
    coder._forget()
    assert [x.tolist() for x in coder.encode_many(texts)] == first and seen
    assert [coder.decode(x) for x in first] == texts


def test_a_word_varies_over_documents():
    coder = MergeCoder(*read_pieces(MODEL)[:2], 0.1, 7)
    ids = coder.encode_many([f"{i} unbelievableness" for i in range(100)])
    assert len({tuple(x.tolist()[len(coder.encode(str(i))) :]) for i, x in enumerate(ids)}) > 8
    again = coder.encode_many(["5 unbelievableness"])[0]
    assert again.tolist() == ids[5].tolist()


def test_dropout_varies_and_repeats():
    pieces = read_pieces(MODEL)[:2]
    a, b, c = MergeCoder(*pieces, 0.3, 1), MergeCoder(*pieces, 0.3, 1), MergeCoder(*pieces, 0.3, 2)
    text = "segmentation of the same text " * 20
    assert a.encode(text).tolist() == b.encode(text).tolist() != c.encode(text).tolist()
    assert len({tuple(a.encode(f"{i} unbelievable").tolist()[2:]) for i in range(40)}) > 1


CHAT = "conv_id long, turn long, role string, text string"


def digests(rows):
    """What the digest of each conversation must say, whose ties don't hold different turns."""
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda t: t[0])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


def test_chat_round_trip(spark):
    rng = random.Random(2)
    rows = [(c, t, ["system", "user", "assistant"][0 if t == 0 and c % 2 else 1 + t % 2], " ".join(["w<a>&amp;</turn>\n"] * rng.randrange(0, 60))) for c in range(12) for t in range(rng.randrange(1, 30))]
    rows += [(50, None, None, None), (51, 1, "user", "tie"), (51, 1, "user", "tie"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], CHAT + ", window long, h1 string")
    got = {r.conv_id: r for r in chat_digest(df, 520, 160).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == digests(rows)
    windows = chat_windows(df, 1300, 260).cache()
    assert windows.where("n_tokens > 1300").count() == 0 and windows.where("window > 0").count() > 0
    assert windows.where("window > 0 and conv_id = 1").where(~F.startswith("formatted", F.lit("<again role=system>"))).count() == 0
    assert windows.where("window > 0").where(F.contains("formatted", F.lit("<again role=user>")) | F.contains("formatted", F.lit("<again role=assistant>"))).count() > 0
    assert chat_digest(df.limit(0)).count() == 0


def chat_model(turns, budget, history):
    """Windows of one conversation by the rule of the module, turn by turn."""
    tokens = [max(len(x.split()), -(-len(x.encode()) // 4)) + 4 for _, _, x in turns]
    first = next((i for i, t in enumerate(turns) if t[1] == "system"), None)
    room = max(2, budget - history - (tokens[first] if first is not None else 0))
    normal = max([n for n in tokens if n <= room / 2], default=0)
    spans, key, before, bigs = [], None, 0, 0
    for i, n in enumerate(tokens):
        bigs += n > room / 2
        now = (bigs, 0) if n > room / 2 else (bigs, 1, before // (room - normal))
        before += 0 if n > room / 2 else n
        if now != key:
            spans.append([])
        spans[-1].append(i)
        key = now
    out = []
    for k, span in enumerate(spans):
        again = [i for i in (spans[k - 1] if k else []) if sum(tokens[i : span[0]]) <= history and i != first]
        out.append(([first] if first is not None and first not in span else []) + again + span)
    return [sum(tokens[i] for i in x) for x in out]


def test_chat_windows_follow_one_rule_at_any_length(spark):
    """3,000 turns with sparse numbers over many partitions: no place where the rule changes."""
    rng = random.Random(21)
    rows = [(1, 1000 * t, "system" if t == 2 else ["user", "assistant"][t % 2], " ".join(["word"] * rng.choice([3, 10, 40, 400]))) for t in range(3000)]
    rows += [(None, t % 5, "user", f"n{t}") for t in range(400)]
    windows = chat_windows(spark.createDataFrame(rows, CHAT).repartition(7), 700, 100)
    got = sorted((r.window, r.n_tokens) for r in windows.where("conv_id = 1").collect())
    assert got == list(enumerate(chat_model([r[1:] for r in rows[:3000]], 700, 100)))
    r = chat_digest(spark.createDataFrame(rows, CHAT), 700, 100).where("conv_id is null").first()
    assert r.n_turns == 400 and r.loss_chars == 0


def test_chat_takes_a_token_column(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", 500), (1, 1, "assistant", "b", None)], CHAT + ", n int")
    assert [(r.window, r.n_tokens) for r in chat_windows(df, 300, 20, "n").orderBy("window").collect()] == [(0, 504), (1, 4)]


def test_escape_is_reversible(spark):
    t = "&lt;<&amp;></turn>&"
    assert spark.range(1).select(unescape(escape(F.lit(t)))).first()[0] == t


def test_chat_is_native(spark):
    df = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    for frame in (chat_digest(df), quality(spark.createDataFrame([(1, "x", "en")], DOC + ", lang string"))):
        assert not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().executedPlan().toString())


def test_quality_counts(spark):
    rng = random.Random(4)
    texts = [*ODD, "a b c a b c", "x x x x", "l1\nl1\n \n\nl2 #$|", *(" ".join(rng.choice("abcdef") for _ in range(rng.randrange(80))) for _ in range(30))]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOC + ", lang string")
    for r in quality(df).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = collections.Counter(grams)
        again = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality(df.limit(0)).count() == 0


def test_quality_rejects_junk_only(spark):
    clean = "The cat sat on the mat and it was good for the dog that is in a house by the sea. " * 6
    df = spark.createDataFrame([(i, f"{i} {clean}".replace("cat", f"c{i}").replace(". ", f" n{i}. "), "en") for i in range(20)] + [(99, " ".join(f"w{i}$$$###" for i in range(80)), "en")], DOC + ", lang string")
    got = {r.doc_id: r for r in quality(df).collect()}
    assert not got[99].base_failed and not got[99].kept and all(got[i].char_distance < 0.3 for i in range(20))


def test_quality_judges_texts_without_common_words(spark):
    """Every text of least_words is compared on common words, the last bin being all other words."""
    rng = random.Random(12)
    common = quality_rules.COMMON["en"]
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(7))
    text = lambda share: " ".join(rng.choices(common, [1 / (i + 1) for i in range(15)])[0] if rng.random() < share else word() for _ in range(150))
    rows = [(i, text(0.2), "en") for i in range(40)] + [(90, text(0), "en"), (91, text(0.01), "en"), (92, text(0), None), (93, "short text", "en")]
    shares = {}
    for i, t, lang in rows:
        if lang and len(w := t.split()) >= 50:
            shares[i] = [w.count(c) / len(w) for c in common] + [sum(x not in common for x in w) / len(w)]
    ref = [sum(x) / len(shares) for x in zip(*shares.values())]
    term = lambda a, m: a * math.log2(a / m) if a else 0.0
    far = {i: math.sqrt(max(0.0, sum(term(a, (a + b) / 2) + term(b, (a + b) / 2) for a, b in zip(p, ref)) / 2)) for i, p in shares.items()}
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, DOC + ", lang string")).collect()}
    assert all(abs(got[i].word_distance - d) < 1e-5 for i, d in far.items())
    assert not got[90].base_failed and not got[90].kept and not got[91].kept and all(got[i].kept for i in range(40))
    assert got[92].word_distance is None and got[92].kept and got[93].word_distance is None


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_components_against_brute_force(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, "One two"), (3, "one TWO"), (4, "one two three"), (None, "one two")]
    for i in range(5, 80):
        words = list(base) if i % 2 else [f"q{rng.randrange(500)}" for _ in range(40)]
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}
    place = lambda i: -1 if i is None else i
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and place(comp[b]) < place(comp[a]):
                    comp[a], changed = comp[b], True
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in sets}
    assert jaccard_components(spark.createDataFrame([], DOC)).count() == 0


def brute_components(rows, n=4, percent=85):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    comp = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            least = min(comp[a], comp[b])
            changed |= comp[a] != least or comp[b] != least
            comp[a] = comp[b] = least
    return comp, linked


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for size in (3, 60, 300, 2000):
        a = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        for changed in (0, 1, size // 10, size // 2):
            b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 64, changed, dtype=np.uint64)]))
            differ = np.bitwise_count(jaccard_join.bitmap(a).view(np.uint64) ^ jaccard_join.bitmap(b).view(np.uint64)).sum()
            assert differ <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("block", [2048, 5])
def test_jaccard_groups_near_the_threshold(spark, monkeypatch, block):
    """A family of 90 texts of 150 words whose pairs lie on both sides of the threshold, in blocks."""
    monkeypatch.setattr(jaccard_join._product, "__defaults__", (block,))
    rng = random.Random(17)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(90):
        words = list(base)
        for k in rng.sample(range(150), rng.randrange(0, 6)):
            words[k] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(50)) + " " + " ".join(base[:30])) for i in range(30)]
    comp, linked = brute_components(rows)
    assert 300 < len(linked) < 3500
    got = {r.doc_id: r.component_id for r in jaccard_components(spark.createDataFrame(rows, DOC)).collect()}
    assert got == comp


def test_jaccard_tells_texts_of_one_id_apart(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    df = spark.createDataFrame([(5, text("a"), 1), (5, text("b"), 1), (None, text("c"), 1), (None, text("d"), 1), (7, text("b"), 1), (7, text("b"), 1), (9, text("d"), 1)], DOC + ", pk long")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_components(df).collect())
    assert got == [(0, 0), (0, 0), (5, 5), (5, 5), (7, 5), (9, 0)]


@pytest.mark.parametrize("block", [32 << 20, 300])
def test_decontamination_against_brute_force(spark, block):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n))
    items = [(i, text(rng.randrange(8, 30))) for i in range(15)] + [(90, "Short item!"), (91, ""), (92, None), (None, text(12)), (93, "a")]
    docs = [(i, text(rng.randrange(0, 60)) + (" " + (items[i % 15][1] or "").upper() if i % 3 == 0 else "")) for i in range(60)] + [(100, None), (101, "a-short,ITEM a"), (102, "é\u0085ü")]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = fold(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[a : a + 10])].add(i)
    out = decontamination.decontaminate(spark, spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    for r in out.collect():
        w, hit, found = fold(dict(docs)[r.doc_id]), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if (g := tuple(w[a : a + k])) in windows:
                    hit |= set(range(a, a + k))
                    found |= windows[g]
        ids = sorted(map(str, found - {None}))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))


SECRETS = [
    "password: token = abcdefgh", "API_KEY='a.b/c+d=1'", "x AKIA" + "A" * 16 + " AKIA123", "f" * 23 + " " + "0a" * 12, "secret=12345", None, "passwords = nothing",
    "ſecret=abcdefgh", 'token = "' + "ab12" * 10 + '"']


def test_secret_base_spans(spark):
    df = spark.createDataFrame([(i, t, f"o{i}", "en") for i, t in enumerate(SECRETS)], DOC + ", source string, lang string")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in secrets_scan.scan(df).collect()}
    assert got == {0: (0, 0, 0), 1: (1, 0, 0), 2: (0, 1, 0), 3: (0, 0, 1), 4: (0, 0, 0), 5: (0, 0, 0), 6: (0, 0, 0), 7: (0, 0, 0), 8: (1, 0, 1)}
    r = secrets_scan.scan(df).where("doc_id = 8").first()
    assert r.spans == "assign:0:49,hex:9:49" and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()


def test_ownership_separates_examples_from_live_values(spark):
    example, live = "password = example-value-1", "password = only-mine-2"
    mixed = "Zx9kLmQ2rTvB7nHcYd4W"
    rows = [(i, example, f"o{i}", "en") for i in range(5)] + [(10, live, "o1", "en"), (11, live, "o1", "de"), (12, mixed, "o2", None), (13, mixed + " é", None, None)]
    df = spark.createDataFrame(rows, DOC + ", source string, lang string")
    got = {r.doc_id: r for r in secrets_scan.scan(df).collect()}
    assert (got[0].n_live, got[0].n_example, got[0].spans) == (0, 1, "assign:0:26") and got[10].n_live == got[11].n_live == 1
    assert got[12].spans == "mixed:0:20"
    clean = {r.doc_id: r.text for r in secrets_scan.redact(df.union(df.where("doc_id = 10"))).collect()}
    assert clean[0] == example and clean[10] == "[SECRET]" and clean[13] == "[SECRET] é"
    assert secrets_scan.redact(df.union(df.where("doc_id = 10"))).count() == len(rows) + 1
    assert secrets_scan.scan(df.limit(0)).count() == 0


def test_levenshtein_automaton():
    lexicon = toxicity.Lexicon({"stupid": 1.0, "moron": 1.0, "scum": 1.0}, {"vequ": 1.0})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(9)
    for _ in range(1500):
        w = list(rng.choice(["stupid", "moron"]))
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(0, 2)] = rng.choice(["", "x", "o"])
        w = "".join(w)
        assert (lexicon.near(w) > 0) == any(distance(w, t) <= 1 for t in ("stupid", "moron")), w
    assert lexicon.exact("vequora") and lexicon.exact("scum") and not lexicon.exact("scums") and not lexicon.near("scun")


def test_quotation_counts_less():
    s = toxicity.Scorer(toxicity.ToxicityModel({"moron": 1.0}, {}, frozenset({"moren"}), (-2.0, 1.0, 1.0)))
    assert s.features("the man moron here")[0] > s.features("the man said moron here")[0] > 0
    assert s.features('so “moron” it is')[0] < s.features("so moron it is")[0] < s.features("you moron it is")[0]
    assert s.features("moren")[0] == 0 and s.features("")[0] == 0 and s.features("mroon x morom")[0] > 0


def test_toxicity_learns_and_handles_nulls(spark):
    docs = [(i, ("you filthy idiot go " if i % 4 == 0 else "a calm day went ") + f"on and on w{i}") for i in range(200)] + [(900, None), (901, ""), (None, "a filthy idoit")]
    df = spark.createDataFrame(docs, DOC)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] * 2 + [(300, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(spark, df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert len(got) == 203 and all(got[i].predicted == int(i % 4 == 0) for i in range(200)) and got[900].score == got[901].score < 0.5
    empty = toxicity.train(spark, df, labels.limit(0))
    assert toxicity.score(df, empty).where("predicted = 1").count() == 0
    assert toxicity.score(df.limit(0), model).count() == 0


def test_components_alone_and_contracted(spark):
    rng = random.Random(61)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(500 + i, 501 + i) for i in range(60)] + [(700, 700 + i) for i in range(50)] + [(-5, 700), (-9, -9)]
    least = {x: x for pair in links for x in pair}
    while True:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    for most in (0, 1 << 20):
        got = {r.node: r.component for r in components(df, most).collect()}
        assert got == {k: v for k, v in least.items() if most or k != -9}  # a node that only links itself stays alone
    assert components(df.limit(0)).count() == 0
