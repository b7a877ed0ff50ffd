"""The conversation trie against a plain dictionary of prefixes."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from fluxalign.llm import oracles, prefix_trie, queries

from ..conftest import TINY

SCHEMA = "conv_id long, turn long, role string, text string"


def turn_id(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    """Rows of the result, from (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, turn_id(role or "", text or "")[:32], role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        w = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * w
            leaves[p[:d]] += not children[p]
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest() if p in ends else hashlib.sha256(b"").hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0], r[1], r[2] or 0, *r[3:]))


def want(rows):
    return sorted(brute(rows), key=lambda r: (r[0], r[1], r[2] or 0, *r[3:]))


def test_the_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TINY}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    result = got(queries.op11_prefix_trie(spark, TINY))
    assert result == want(rows)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{TINY}/conversations.parquet'")
    assert sorted(db.sql(oracles.SQL["op11_prefix_trie"]).fetchall(), key=lambda r: (r[0], r[1], r[2] or 0, *r[3:])) == result


@pytest.mark.parametrize("most_keys", [1, 2, 7, 20_000])
def test_trees_of_any_size_add_up(spark, most_keys):
    """Shared first turns, copies, prefixes of others, turnless ones; trees cut anywhere."""
    rng = random.Random(most_keys)
    rows = []
    for c in range(-40, 160):
        if rng.random() < 0.1:
            continue
        length = rng.choice([0, 1, 1, 2, 3, 5, 9])
        rows += [(c, t, rng.choice(["user", "assistant"]) if t else "user", "hello there" if t == 0 and rng.random() < 0.7 else f"turn {rng.choice('ab')} " * rng.randrange(3)) for t in range(length)]
        if not length:
            rows.append((c, 0, None, None))
    rows += [(500 + i, t, "user", f"the same {t}") for i in range(60) for t in range(4)]
    sequences = prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert got(prefix_trie.prefix_trie(sequences, most_keys)) == want(rows)


def test_hard_conversations(spark):
    rows = [
        (1, None, None, None), (1, None, "user", "first"), (1, 0, "user", "x " * 50_000), (1, 0, "user", "x " * 50_000), (2, 3, "", ""), (2, 1, "\n", " \t"), (None, 0, "user", "nobody"), (-3, 0, "user", "é" * 10),
        (40, 0, "user", "a"), (41, 0, "user", "b"), (42, 5, "user", "a"), (43, 0, "user", "a"), (43, 1, "user", "a"), (43, 2, "user", "a"), (43, 3, "user", "a")]
    rows += [(60, t, "user", f"long {t % 50}") for t in range(300)] + [(61, t, "user", f"long {t % 50}") for t in range(299)] + [(62, t, "user", f"long {t % 50}") for t in range(301)]
    df = spark.createDataFrame(rows, SCHEMA)
    result = got(prefix_trie.conversation_trie(df.repartition(5)))
    assert result == want(rows)
    clashing = df.selectExpr("*", *(f"1 AS {c}" for c in ("key", "ids", "words", "id", "w", "t", "h", "base", "n", "least", "ends", "pid", "depth", "part")))
    assert got(prefix_trie.conversation_trie(clashing)) == result
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0
    assert prefix_trie.conversation_trie(df.where("conv_id is null")).count() == 0


def test_a_node_grows_through_all_layouts():
    tree, layouts = prefix_trie.Tree(), []
    order = list(range(256))
    random.Random(2).shuffle(order)
    for k, b in enumerate(order):
        tree.insert(bytes([9, b, b]), k, 1, b)
        layouts.append(tree.root.layout)
    assert [layouts.index(x) + 1 for x in (16, 48, 256)] == [5, 17, 49]
    assert [c.path for c in tree.root.ordered()] == [bytes([b]) for b in range(256)] and tree.root.path == b"\x09" and tree.root.n == 256
    for b in range(256):
        assert tree.root.child(b).least == b


def test_shared_length():
    rng = random.Random(7)
    for _ in range(300):
        a, b = (bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(2))
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert prefix_trie.shared_length(a, b) == n
