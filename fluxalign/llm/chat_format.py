"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens choose spans of turns, always between turns. With ``room`` = what the
budget leaves beside the system turn and the history, and L = the largest turn of the
conversation that takes at most half the room, a turn belongs to span (tokens before it) div
(room - L), so that no span exceeds the room. A turn larger than half the room is a span of its
own (over the budget and whole where it is larger than the room). Every window begins with the
system turn, then repeats the last turns of the span before within ``history`` tokens, then
holds its span. Only assistant turns of the span carry loss, so that each is trained on once;
repeated ones are masked. The rule is the same for conversations of every length.

Template: ``<turn role=R>\\nTEXT</turn>\\n``, and ``<again role=R>\\n...`` for turns that are
repeated. In roles and texts ``&``, ``<`` and ``>`` are written ``&amp;``, ``&lt;`` and
``&gt;``, so no text can hold a control string, and reading back is exact.

A conversation may hold any share of all rows. Turns without text are dealt by range of
(conversation, place), so that a large conversation spans many partitions; sums run within a
partition's part of a conversation, and the parts' totals (a few rows for each partition) give
the offsets. Texts join when their windows are known. A turn's tokens are its words or a quarter
of its bytes, whichever is more, plus 4 for the markup, or come from ``tokens_col``.

Defined cases: null role and text are empty; a null turn number counts as 0; turns with equal
numbers are ordered by a hash of role and text; repeated rows are turns of their own; the first
system turn is retained; a conversation without turns doesn't exist; extra columns are ignored;
rows with a null conv_id form one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, partitions

WORD = r"[^\x20\x09-\x0D]+"
END = "</turn>\n"
#: What tells turns of one conversation apart, in their order; copies have numbers.
PLACE = ["turn", "h1", "h2", "copy"]


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


PART = ["c", "pid"]


def _narrow(turns: DataFrame) -> DataFrame:
    """Turns without text in order over partitions: c, place, tokens, system, pid."""
    rows = turns.select("c", "turn", "h1", "h2", "tokens", (F.col("role") == "system").alias("system"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return durable(rows.repartitionByRange(partitions(turns), "c", *PLACE).withColumn("pid", F.spark_partition_id()))


def _totals(rows: DataFrame, **sums: Column) -> DataFrame:
    """Rows with the sums over all earlier parts of their conversation."""
    before = Window.partitionBy("c").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*PART).agg(*(F.sum(v).alias(k) for k, v in sums.items()))
    return rows.join(parts.select(*PART, *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"before_{k}") for k in sums)), PART)


def _overall(rows: DataFrame, name: str, best: Column) -> DataFrame:
    """Rows with an aggregate over their whole conversation, by parts first."""
    of = {"system": F.min, "normal": F.max, "n_windows": F.sum}[name]
    parts = rows.groupBy(*PART).agg(of(best).alias(name))
    return rows.join(parts.select(*PART, of(name).over(Window.partitionBy("c")).alias(name)), PART)


def _spans(narrow: DataFrame, budget: int, history: int) -> DataFrame:
    """c, place, tokens, window, again: each turn in its window, and where it is repeated."""
    turn = F.struct(*PLACE, "tokens")
    x = durable(_overall(narrow.withColumnRenamed("system", "is_system"), "system", F.when(F.col("is_system"), turn)))
    x = x.withColumn("room", F.greatest(F.lit(budget - history) - F.coalesce("system.tokens", F.lit(0)), F.lit(2)))
    x = _overall(x, "normal", F.when(F.col("tokens") <= F.col("room") / 2, F.col("tokens")))
    x = x.withColumn("big", F.col("tokens") > F.col("room") / 2)
    x = x.withColumn("small", F.when(F.col("big"), 0).otherwise(F.col("tokens")))
    x = durable(_totals(x, small=F.col("small"), big=F.col("big").cast("long"), all=F.col("tokens")))
    running = Window.partitionBy(*PART).orderBy(*PLACE)
    up_to = lambda c, offset: F.sum(c).over(running) + F.col(offset)
    x = x.withColumns({"bigs": up_to(F.col("big").cast("long"), "before_big"), "small_before": up_to(F.col("small"), "before_small") - F.col("small"), "end": up_to(F.col("tokens"), "before_all")})
    cell = F.floor(F.col("small_before") / (F.col("room") - F.coalesce("normal", F.lit(0))))
    x = x.withColumn("span", F.struct("bigs", F.when(F.col("big"), 0).otherwise(1).alias("kind"), F.when(F.col("big"), 0).otherwise(cell).alias("cell")))
    x = durable(x.select("c", *PLACE, "tokens", "pid", "end", "span", "system"))
    spans = x.groupBy("c", "span").agg(F.min("pid").alias("pid"), F.max("end").alias("span_end"))
    spans = _overall(_totals(spans, windows=F.lit(1)), "n_windows", F.lit(1))
    place = F.row_number().over(Window.partitionBy(*PART).orderBy("span"))
    spans = spans.select("c", "span", "span_end", (place + F.col("before_windows") - 1).alias("window"), "n_windows")
    x = x.join(spans, ["c", "span"])
    sys = F.coalesce(F.struct(*PLACE) == F.struct(*(F.col(f"system.{c}") for c in PLACE)), F.lit(False))
    repeated = (F.col("span_end") - F.col("end") + F.col("tokens") <= history) & (F.col("window") + 1 < F.col("n_windows")) & ~sys
    at = lambda w, again: F.struct(w.alias("window"), F.lit(again).alias("again"))
    shown = F.array_compact(F.array(at(F.col("window"), False), F.when(repeated, at(F.col("window") + 1, True))))
    return x.select("c", *PLACE, sys.alias("system"), F.explode(shown).alias("s")).select("c", *PLACE, "system", "s.*")


def chat_windows(conversations: DataFrame, budget: int = 1024, history: int = 128, tokens_col: str | None = None) -> DataFrame:
    """conv_id, window, n_tokens, formatted, loss: array of (start, length) code points."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tokens = F.greatest(F.regexp_count(text, F.lit(WORD)), F.ceil(F.octet_length(text) / 4)) if tokens_col is None else F.coalesce(F.col(tokens_col), F.lit(0))
    rows = conversations.select(
        F.struct("conv_id").alias("c"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"), (tokens + 4).cast("long").alias("tokens"))
    rows = rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "role", "text")})
    turns = rows.groupBy("c", "turn", "h1", "h2").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.first("tokens").alias("tokens"), F.count("*").alias("copies"))
    spans = _spans(_narrow(turns), budget, history)
    placed = spans.join(turns.drop("copies"), ["c", "turn", "h1", "h2"])
    turn = F.struct("role", "text", "tokens")
    system = durable(placed.where("system and not again").select("c", turn.alias("first")))
    item = F.struct((~F.col("again")).alias("own"), *PLACE, turn.alias("t"))
    windows = placed.groupBy("c", "window").agg(F.sort_array(F.collect_list(item)).alias("items"), F.bool_or(F.col("system")).alias("holds"))
    windows = windows.join(system, "c", "left")
    item = lambda t, again: F.struct(t.alias("t"), again.alias("again"))
    retained = F.when(F.col("first").isNotNull() & ~F.col("holds"), F.array(item(F.col("first"), F.lit(True))))
    shown = F.transform("items", lambda x: item(x["t"], ~x["own"]))
    shown = windows.select(F.col("c.conv_id").alias("conv_id"), "window", F.when(retained.isNotNull(), F.concat(retained, shown)).otherwise(shown).alias("shown"))

    def markup(x: Column) -> Column:
        head = F.concat(F.when(x["again"], F.lit("<again role=")).otherwise(F.lit("<turn role=")), escape(x["t"]["role"]), F.lit(">\n"))
        return F.struct(head.alias("head"), escape(x["t"]["text"]).alias("body"), (~x["again"] & (x["t"]["role"] == "assistant")).alias("loss"), x["t"]["tokens"].alias("tokens"))

    marked = shown.select("conv_id", "window", F.transform("shown", markup).alias("m"))
    nothing = F.expr("named_struct('at', 0, 'loss', cast(array() as array<struct<start:int,length:int>>))")
    loss = F.aggregate("m", nothing, lambda s, x: F.struct(
        (s["at"] + F.length(x["head"]) + F.length(x["body"]) + len(END)).alias("at"),
        F.when(x["loss"], F.concat(s["loss"], F.array(F.struct((s["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"))))).otherwise(s["loss"]).alias("loss")))
    return marked.select(
        "conv_id", "window", F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + x["tokens"]).alias("n_tokens"),
        F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"), loss["loss"].alias("loss"))


def read_turns(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns: array of (role, text), loss_text: read from the output.

    Repeated turns are left out, so the windows of a conversation give its turns once, in order.
    """
    pieces = F.split("formatted", END)
    turn = r"(?s)\A<turn role=([^>]*)>\n(.*)\z"
    own = F.filter(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.startswith(p, F.lit("<turn ")))
    return windows.select(
        "conv_id", "window",
        F.transform(own, lambda p: F.struct(unescape(F.regexp_extract(p, turn, 1)).alias("role"), unescape(F.regexp_extract(p, turn, 2)).alias("text"))).alias("turns"),
        F.array_join(F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"] + 1, x["length"]))), "").alias("loss_text"),
        F.length("formatted").alias("formatted_chars"))


def chat_digest(conversations: DataFrame, budget: int = 1024, history: int = 128) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    A digest is of a whole conversation, so its turns meet in one row here (not in the windows).
    """
    read = read_turns(chat_windows(conversations, budget, history))
    part = F.struct(
        "window", F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"), "loss_text", "formatted_chars")
    parts = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    loss = F.array_join("parts.loss_text", "")
    return parts.select(
        "conv_id", F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["n"]).alias("n_turns"),
        F.sha2(F.array_join("parts.turns", ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["formatted_chars"]).alias("formatted_chars"), F.size("parts").cast("long").alias("n_windows"))
