"""Secret scans with corpus-wide ownership frequency.

A scan of each text gives candidates: assignments to credential names, access keys, long hex
strings (the base kinds) and other long tokens that mix cases and digits. Hashes of the
candidate values are aggregated over the corpus: in how many repositories, and of how many
owners, does a value occur? A value is a widely copied example if it has more than
``most_owners`` owners, or several and more than ``most_repositories`` repositories; a value of
one owner looks live in however many of the owner's repositories it stands. Candidates beyond
the base kinds become spans only when they look live.

The texts are scanned once; what is found (rows without text) is kept in the shared folder.
Candidates are reduced to distinct (value, owner, repository) with map-side combine before values
meet, and the verdict joins back on the value's hash, where Spark may split a value that very
many documents share. ``redact`` reads the texts again and joins them with the documents that
hold a live value, which are broadcast while they are MOST_BROADCAST at most.

Defined cases: null text is empty; a null owner or repository counts as one of its own; rows
with the same doc_id and text give one row in ``scan`` and stay apart in ``redact``; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, durable, small_batches, text_hash

#: Fixed values of the scan: patterns of the base kinds, in the order in which ties are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Beyond the base: long tokens that mix upper case, lower case and digits.
MIXED = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: Documents with live values that are broadcast at most; beyond that, texts are shuffled.
MOST_BROADCAST = 50_000
KINDS = ("assign", "access", "hex", "mixed")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, hash of the value), by start and kind."""
    out = []
    digest = xxhash.xxh64_intdigest
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                out.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    # Base spans by their ends: once a token is past an end, so are all later ones.
    by_end = sorted((e, s) for s, _, e, _ in out)
    least = list(accumulate((s for _, s in reversed(by_end)), min))[::-1]  # start of any span from here on
    at = 0
    for m in MIXED.finditer(text):
        while at < len(by_end) and by_end[at][0] <= m.start():
            at += 1
        if at < len(by_end) and least[at] < m.end():
            continue
        v = m[0]
        if re.search("[a-z]", v) and re.search("[A-Z]", v) and re.search("[0-9]", v) and entropy(v) >= 3.5:
            out.append((m.start(), 3, m.end(), v))
    return [(s, k, e, digest(v.encode()) - (1 << 63)) for s, k, e, v in sorted(out)]


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """The text with each stretch that spans cover replaced by the mark."""
    out, end = [], 0
    for s, e in sorted(spans):
        if s >= end:
            out += [text[end:s], mark]
        end = max(end, e)
    return "".join(out) + text[end:]


FOUND = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32()), ("h", pa.int64())]))


def _scanned(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = candidates(text or "")
                base = [(s, k, e) for s, k, e, _ in found if k < 3]
                n = Counter(k for _, k, _ in base)
                rows.append((n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(), [{"s": s, "k": k, "e": e, "h": h} for s, k, e, h in found]))
            if rows:
                kinds = [pa.int64()] * 3 + [pa.string(), FOUND]
                new = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                old = [n for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in old), *new], [*old, "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    narrow = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("pk"), text_hash(F.col("text").cast("string")).alias("th"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), F.col("text").cast("string").alias("text"))
    kinds = "owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<s:int,k:int,e:int,h:long>>"
    return narrow.mapInArrow(find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pk long, th long, {kinds}")


def ownership(candidate_rows: DataFrame) -> DataFrame:
    """h, owners, repositories: distinct owners and repositories of each value."""
    seen = candidate_rows.select("h", F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repository", F.lit("\0")).alias("repository")).distinct()
    by_owner = seen.groupBy("h", "owner").agg(F.count("*").alias("r"))
    return by_owner.groupBy("h").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"))


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, most_owners: int = 2, most_repositories: int = 4) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, live, pk, th.

    ``owner`` is the column source and a repository is an owner's part in one language unless
    given. ``live`` lists the spans that look live.
    """
    small_batches(docs.sparkSession)
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    rows = durable(_scanned(docs, owner, repository))
    flat = rows.select("pk", "th", "owner", "repository", F.explode("found").alias("c")).select("pk", "th", "owner", "repository", "c.*")
    example = (F.col("owners") > most_owners) | (F.col("owners") > 1) & (F.col("repositories") > most_repositories)
    verdict = flat.join(ownership(flat), "h").select("pk", "th", F.struct("s", "k", "e", (~example).alias("live")).alias("v"))
    by_doc = verdict.groupBy("pk", "th").agg(F.array_sort(F.collect_set("v")).alias("v"))
    shown = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"], x["e"])
    v = F.coalesce("v", F.expr("cast(array() as array<struct<s:int,k:int,e:int,live:boolean>>)"))
    once = rows.drop("found", "owner", "repository").dropDuplicates(["pk", "th"])
    return once.join(by_doc, ["pk", "th"], "left").withColumn("v", v).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.array_join(F.transform(F.filter("v", lambda x: (x["k"] < 3) | x["live"]), shown), ",").alias("spans"),
        F.size(F.filter("v", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("v", lambda x: ~x["live"])).cast("long").alias("n_example"),
        F.filter("v", lambda x: x["live"]).alias("live"), "pk", "th",
    )


def redact(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, most_owners: int = 2, most_repositories: int = 4, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span that looks live replaced by ``mark``; all rows stay."""
    live = durable(scan(docs, owner, repository, most_owners, most_repositories).where("n_live > 0").select("pk", "th", "live"))
    live = F.broadcast(live) if live.count() <= MOST_BROADCAST else live
    # A row stays one struct, so that its columns may have any names.
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("pk"), text_hash(F.col("text").cast("string")).alias("th"))

    @F.pandas_udf("string")
    def clean(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, list(zip(s.tolist(), e.tolist())), mark) for t, s, e in zip(text, starts, ends)], dtype=object)

    text, found = F.col("row.text").cast("string"), F.col("live").isNotNull()
    out = keyed.join(live, ["pk", "th"], "left").withColumn("clean", clean(F.when(found, text), F.col("live.s"), F.col("live.e")))  # texts without live spans stay in the JVM
    return out.select(F.col("row").withField("text", F.when(found, F.col("clean")).otherwise(F.col("row.text"))).alias("row")).select("row.*")
