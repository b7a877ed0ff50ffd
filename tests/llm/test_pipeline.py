import random

import corpus_pipeline
import __spark_entry__ as entry
from fluxalign.llm import queries

from ..conftest import TINY


def test_stages_on_the_smallest_tables(spark):
    """Each stage against what its operator says about the stage's own input."""
    from fluxalign.llm.decontamination import decontaminate
    from fluxalign.llm.jaccard_join import jaccard_components

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, TINY).persist()
        if name == "near_duplicates":
            assert ids(kept) == {r.component_id for r in jaccard_components(before).collect()}
        if name == "decontamination":
            hits = ids(decontaminate(spark, before, spark.read.parquet(f"{TINY}/benchmark.parquet")).where("contaminated"))
            assert hits and ids(kept) == ids(before) - hits
        if name == "secrets":
            assert ids(kept) == ids(before)
        if name != "piece_encoding":
            assert kept.columns == corpus_pipeline.COLUMNS
    assert kept.where("not lossless").count() == 0
    assert ids(corpus_pipeline.run(spark, TINY)) == ids(kept)


def test_all_ten_are_registered(spark):
    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] == list(queries.queries()) and "pipeline" in names
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}
    for name in ("op1_substring_dedup", "op6_suffix_dedup", "op7_secret_scan", "op9_decontamination", "op10_quality_rules"):
        assert entry.queries()[name](spark, TINY).count() == spark.read.parquet(f"{TINY}/documents.parquet").count()


def test_near_duplicates_against_brute_force_at_five_words(spark):
    """One inner word of 50 changed: 41 of 51 shingles of five words are shared, 43 of 51 of four."""
    rng = random.Random(11)
    rows = []
    for i in range(0, 60, 2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(50)]
        rows.append((i, " ".join(words)))
        for k in rng.sample(range(5, 45), 1 + i % 3):
            words[k] = f"e{k}"
        rows.append((i + 1, " ".join(words)))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    linked = {b for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert 1 in linked and 3 not in linked
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, df, TINY)
    assert {r.doc_id for r in kept.collect()} == set(sets) - linked


def test_rows_without_an_id_or_with_the_same_go_only_as_copies(spark):
    rng = random.Random(13)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(50))
    own, two, near = [text() for _ in range(6)], text(), text().split()
    copy = [*near[:20], "changed", *near[21:]]
    rows = [(None, t) for t in own] + [(7, t) for t in (text(), text())]
    rows += [(None, two), (None, two), (9, two), (None, " ".join(near)), (None, " ".join(copy)), (8, None), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, TINY).collect()]
    sure = {(i, t) for i, t in rows[:8]} | {(None, two), (8, None), (None, None)}
    assert sure <= set(kept) and len(kept) == len(set(kept)) == len(sure) + 1
    assert {t for _, t in kept} & {" ".join(near), " ".join(copy)}
