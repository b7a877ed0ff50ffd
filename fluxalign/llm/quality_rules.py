"""Quality rules: base counts, and divergence from language references, in DataFrame functions.

Base rules look at a text alone (counts of words, symbols, repeated lines and repeated 3-word
windows). The method then compares two histograms of each text, of character classes and of its
language's common words, with the language's reference by Jensen-Shannon distance. All words
that are not common share one last bin, so that a text with few or no common words is far from
the reference. A reference is the mean histogram over all texts of the language that are long
enough; only texts shorter than ``least_words`` are not judged by divergence. References have
one row a language and are joined on it. ``most_common`` lies below the distance of a text
without common words from references of the usual 82 % other words, 0.30 to 0.31.

Defined cases: null text has no words and fails the base rule; a null or unknown language has
no word list and is judged by character classes only, against the reference of its own code;
repeated rows are judged one by one; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Common words of each language, and the classes of characters.
COMMON = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "by"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "sich", "mit", "des", "auf", "für", "ist", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "en", "des", "un", "du", "une", "que", "pour", "est", "par", "dans"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "las", "se", "del", "un", "por", "con", "no", "una"],
}
BLANK = " \t\n\x0b\f\r"
#: Of symbols, digits, marks and capitals.
CLASSES = ["#*$%&|<>", "0-9", ".,;:!?'\"()\\-", "A-Z"]
N_CHARS = len(CLASSES) + 2


def bound(c: Column, f) -> Column:
    """f of a column that is evaluated once a row, however often f uses it."""
    return F.transform(F.array(c), f)[0]


def class_counts(text: Column) -> Column:
    """How many characters of each class; small letters and blanks, which are most of a text, go first."""
    count = lambda c, members: F.length(c) - F.length(F.regexp_replace(c, F.lit(f"[{members}]+"), F.lit("")))
    return bound(F.regexp_replace(text, F.lit("[a-z ]+"), F.lit("")), lambda c: F.array(*(count(c, m).cast("long") for m in CLASSES)))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, text, words and the base counts."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    trimmed = F.trim("text", F.lit(BLANK))
    docs = docs.withColumn("words", F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(BLANK)) != "")
    return docs.select(
        "doc_id", "lang", "text", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), class_counts(F.col("text")).alias("classes"),
        F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))[0].alias("n_dup_lines"))


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text, by sorting the windows.

    A text whose window hashes are all distinct, found without sorting, has none.
    """
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def places(s: Column) -> Column:
        twin = lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")))["n"]

    def counted(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(bound(ranked, lambda s: covered(places(s))))

    once = bound(bound(F.transform(words, lambda w: F.xxhash64(w)), hashes), counted)
    return F.when(F.size(words) >= 3, once).otherwise(F.lit(0).cast("long"))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: F.coalesce(F.try_divide(c.cast("double"), total), F.lit(0.0)))


def histograms(counted: DataFrame) -> DataFrame:
    """Adds n_repeat_words, chars (shares of character classes) and common (shares of each common
    word and of all others; null without a word list), and drops the words and the text."""
    lists = F.create_map(*(x for lang, ws in COMMON.items() for x in (F.lit(lang), F.array(*map(F.lit, ws)))))
    known = F.try_element_at(lists, F.col("lang"))
    size = len(COMMON["en"])
    total = F.length("text").cast("long")
    chars = F.concat(F.array(total - F.col("word_chars")), F.col("classes"))
    chars = bound(chars, lambda a: F.concat(a, F.array(total - F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x))))
    # places of the words in the list, 0 for all others
    places = bound(F.struct("words", known.alias("list")), lambda x: F.filter(F.transform(x["words"], lambda w: F.array_position(x["list"], w)), lambda i: i > 0))
    counts = bound(places, lambda hits: F.concat(F.transform(F.sequence(F.lit(1).cast("long"), F.lit(size).cast("long")), lambda i: F.size(F.filter(hits, lambda j: j == i)).cast("long")), F.array(F.col("n_words") - F.size(hits))))
    return counted.select(
        "doc_id", "lang", "n_words", "word_chars", F.get("classes", F.lit(0)).alias("n_symbols"), "n_dup_lines", repeat_words(F.col("words")).alias("n_repeat_words"),
        _shares(chars, total).alias("chars"), F.when(known.isNotNull(), _shares(counts, F.col("n_words"))).alias("common"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms, 0 to 1."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    both = F.zip_with(p, q, lambda a, b: term(a, (a + b) / 2) + term(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / 2))


def references(shares: DataFrame, least_words: int) -> DataFrame:
    """lang, ref_chars, ref_common: mean histograms over all texts that are long enough."""
    means = lambda c, n: F.array(*(F.coalesce(F.avg(F.get(c, F.lit(i))), F.lit(0.0)) for i in range(n)))
    return shares.where(F.col("n_words") >= least_words).groupBy(F.col("lang").alias("ref_lang")).agg(
        means("chars", N_CHARS).alias("ref_chars"), means("common", len(COMMON["en"]) + 1).alias("ref_common"))


def quality(docs: DataFrame, least_words: int = 50, most_chars: float = 0.3, most_common: float = 0.27, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    char_distance, word_distance."""
    shares = durable(histograms(base_counts(docs, id_col, text_col, lang_col)))
    judged = shares.join(references(shares, least_words), F.col("lang") == F.col("ref_lang"), "left")
    chars = F.when(F.col("n_words") >= least_words, distance(F.col("chars"), F.col("ref_chars")))
    common = F.when((F.col("n_words") >= least_words) & F.col("common").isNotNull(), distance(F.col("common"), F.col("ref_common")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = judged.withColumns({"char_distance": chars, "word_distance": common, "base_failed": failed})
    far = (F.coalesce("char_distance", F.lit(0.0)) > most_chars) | (F.coalesce("word_distance", F.lit(0.0)) > most_common)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~far).alias("kept"), F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))
