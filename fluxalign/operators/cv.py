"""Cross-validated multinomial logistic regression over fused text and signal features (MLlib).

Folds and the small grid of penalties loop on the driver; each fit is distributed. Feature rows
become one sparse vector a sentence: hashed words, then the pooled and scaled signal block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Tokenizer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..functions.vectors import argmax, l2
from ..sources.shared import durable
from .align import require_none
from .controls import apply_control
from .metrics import classification_metrics, mean_log_loss
from .preprocess import fit_control, pooled, transform
from .scoring import linear


def signal_block(features: DataFrame, splits: DataFrame, control: str) -> DataFrame:
    """seed, fold, split, sentence_id, signal: control, then preprocessing fitted on train rows."""
    rows = apply_control(features, splits, control)
    mean = pooled(transform(rows, fit_control(rows, features, splits, control)), ["seed", "fold", "split"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"])
    return mean.groupBy("seed", "fold", "split", "sentence_id").agg(ordered.alias("signal"))


def word_vectors(texts: DataFrame, n_words: int = 256) -> DataFrame:
    """sentence_id, _words: hashed word counts of ``texts`` (sentence_id, sentence).

    Texts are dealt out before they are taken apart: a join on ids may leave them where it read
    them, and sentences of neighbouring ids then share one task. The counts are kept, since a join
    with the folds of a sentence would take its text apart for each of them.
    """
    parts = 4 * texts.sparkSession.sparkContext.defaultParallelism
    # By a hash of their own, as an exchange on the join's key would be taken for the join's.
    dealt = texts.select("sentence_id", "sentence").repartition(parts, F.xxhash64("sentence_id"))
    words = Tokenizer(inputCol="_norm", outputCol="_tokens").transform(dealt.withColumn("_norm", normalize_text(F.col("sentence"))))
    return durable(HashingTF(numFeatures=n_words, inputCol="_tokens", outputCol="_words").transform(words).select("sentence_id", "_words"))


def fused_vectors(rows: DataFrame, texts: DataFrame, signal: DataFrame | None, fusion: str, n_words: int = 256, zero: bool = False) -> DataFrame:
    """Adds ``fused``: word counts (text), the signal block (eeg) or both, words first (concat, gated);
    ``zero`` blocks the signal.

    ``texts``: sentence_id, sentence; each is hashed once, whatever the number of seeds and folds
    in ``rows``. The signal is kept, as its size is asked for before the vectors are made.
    """
    parts = {"text": ["_words"], "eeg": ["_signal"], "concat": ["_words", "_signal"], "gated": ["_words", "_signal"]}[fusion]
    x = rows.join(word_vectors(texts, n_words), "sentence_id") if "_words" in parts else rows
    if signal is not None:
        signal = durable(signal)
        block = F.transform("signal", lambda v: v * 0.0) if zero else F.col("signal")
        x = x.join(signal.withColumn("_signal", array_to_vector(block)).drop("signal"), [c for c in ("seed", "fold", "split", "sentence_id") if c in x.columns])
        one = signal.select(F.size("signal").alias("n")).first()
        if one:
            # The assembler still stops at rows of another size; without the hint it runs the whole plan for one row.
            x = VectorSizeHint(inputCol="_signal", size=one.n, handleInvalid="optimistic").transform(x)
    return VectorAssembler(inputCols=parts, outputCol="fused").transform(x).drop("_words", "_signal")


def _parts(model, spark, n_words: int) -> DataFrame:
    """One row with the model's coefficients: those of words, those of the signal, the intercepts."""
    weights = model.coefficientMatrix.toArray()
    row = (weights[:, :n_words].tolist(), weights[:, n_words:].tolist(), model.interceptVector.toArray().tolist())
    return spark.createDataFrame([row], "_w array<array<double>>, _s array<array<double>>, _b array<double>")


def with_and_without(rows: DataFrame, model, n_words: int) -> DataFrame:
    """Predictions of a model of words and signal, with the signal's part and without it, and all norms.

    The model is linear, so what the signal adds to the logits is the form of its own coefficients;
    its gate is open.
    """
    x = rows.withColumn("_x", vector_to_array("fused")).crossJoin(F.broadcast(_parts(model, rows.sparkSession, n_words)))
    x = x.withColumns({"_text": F.slice("_x", 1, n_words), "_signal": F.slice("_x", F.lit(n_words + 1), F.size("_x"))})
    x = x.withColumns({"logits_without_eeg": linear(F.col("_w"), F.col("_b"), F.col("_text")), "_added": linear(F.col("_s"), F.transform("_b", lambda b: b * 0.0), F.col("_signal"))})
    x = x.withColumn("logits", F.zip_with("logits_without_eeg", "_added", lambda a, b: a + b))
    x = x.withColumns({"text_embedding_norm": l2(F.col("_text")), "eeg_embedding_norm": l2(F.col("_signal")), "candidate_eeg_contribution_norm": l2(F.col("_added")), "gated_eeg_contribution_norm": l2(F.col("_added"))})
    return x.drop("fused", "_x", "_w", "_s", "_b", "_text", "_signal", "_added")


#: What only models of words and signal have.
OWN = ["logits_without_eeg", "text_embedding_norm", "eeg_embedding_norm", "candidate_eeg_contribution_norm", "gated_eeg_contribution_norm"]
HISTORY = "setup string, seed int, fold int, epoch int, penalty double, train_loss double, val_loss double, val_accuracy double, val_macro_f1 double"


def fit_folds(rows: DataFrame, setup: str, penalties: list[float], iterations: int = 8, n_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions (setup, seed, fold, sentence_id, target, prediction, logits, penalty and,
    with ``n_words``, OWN) and what each penalty gave (HISTORY; its place is the epoch).

    ``rows``: seed, fold, split, sentence_id, target, fused. The penalty with the best macro-F1
    on the validation split is kept (the first of equals), and the test split is read once.
    """
    rows = durable(rows)
    splits = rows.groupBy("seed", "fold").agg(F.count_if(F.col("split") == "train").alias("n"))
    require_none(splits.where("n = 0"), "no train rows in a fold")
    out, history = [], []
    for key in splits.select("seed", "fold").orderBy("seed", "fold").toLocalIterator():
        part = rows.where((F.col("seed") == key.seed) & (F.col("fold") == key.fold))
        best = None
        for place, penalty in enumerate(penalties):
            model = LogisticRegression(featuresCol="fused", labelCol="target", predictionCol="p", regParam=penalty, maxIter=iterations, family="multinomial").fit(part.where("split = 'train'"))
            scored = model.transform(part.where("split = 'val'")).select(F.lit(0).alias("g"), F.col("target").cast("int").alias("target"), F.col("p").cast("int").alias("prediction"), vector_to_array("rawPrediction").alias("logits"))
            seen = classification_metrics(scored, ["g"]).join(mean_log_loss(scored, ["g"], "logits"), "g").select("accuracy", "macro_f1", "loss").first()
            f1 = seen.macro_f1 if seen else 0.0
            history.append((setup, key.seed, key.fold, place + 1, penalty, float(model.summary.objectiveHistory[-1]), *((seen.loss, seen.accuracy, f1) if seen else (None, None, None))))
            if best is None or f1 > best[0] + 1e-8:
                best = (f1, penalty, model)
        test = part.where("split = 'test'")
        test = with_and_without(test, best[2], n_words) if n_words else best[2].transform(test).withColumn("logits", vector_to_array("rawPrediction"))
        own = OWN if n_words else []
        out.append(test.select(F.lit(setup).alias("setup"), "seed", "fold", "sentence_id", "target", argmax(F.col("logits")).alias("prediction"), "logits", F.lit(best[1]).alias("penalty"), *own))
    return reduce(DataFrame.unionByName, out), rows.sparkSession.createDataFrame(history, HISTORY)


def cross_validate(rows: DataFrame, setup: str, penalties: list[float], iterations: int = 8) -> DataFrame:
    """Out-of-fold predictions of ``fit_folds``."""
    return fit_folds(rows, setup, penalties, iterations)[0]
