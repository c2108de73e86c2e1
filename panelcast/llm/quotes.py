"""Chat formatting with quotations linked to the messages they come from.

A line's quote level is the number of ``>`` marks it begins with, nested marks
included. Runs of lines of one level are passages. A quoted passage, and each
line of it, is hashed in a normal form (A-Z folded, blanks collapsed) and joined
to the nearest earlier message of the conversation that wrote it: messages offer
their own text as a whole, by passage and by line. A message replies to the
message its outermost quotes come from, the latest one if there are several;
without linked quotes it replies to none and goes on with the conversation. The
root of its chain of replies is its thread, and its place counts the turns of the
thread up to it. Ordered by (conv_id, thread, place) a conversation reads in reply
order. Quoted lines are left out of the text. Any text can be quoted, however short.

Rows: null texts are empty messages without quotes; null turns are never linked;
rows with equal conv_id and turn share their links and place; an empty table gives no
rows; other columns stay, but for those that are named as a computed one, which it
replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .quality import let
from .store import ascii_lower, written

MARKS = "^(?:[ \\t]*>)+"
COMPUTED = ("clean", "n_quotes", "n_linked", "reply_to", "thread", "place", "message")


def level_of(line: Column) -> Column:
    """Number of quote marks a line begins with."""
    return F.char_length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def body_of(line: Column) -> Column:
    return F.regexp_replace(line, MARKS + "[ \\t]?", "")


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(text), "[\\x20\\x09-\\x0D]+", " "))


def passages(text: Column) -> Column:
    """Array of (level, lines) of the runs of equal level."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(level_of(x).alias("level"), body_of(x).alias("body")))

    def cut(ls: Column) -> Column:
        starts = F.array_compact(F.transform(ls, lambda x, i: F.when((i == 0) | (F.get(ls, i - 1)["level"] != x["level"]), i)))
        return let(starts, lambda st: F.transform(st, lambda s, j: F.struct(
            F.get(ls, s)["level"].alias("level"),
            F.transform(F.slice(ls, s + 1, F.coalesce(F.get(st, j + 1), F.size(ls)) - s), lambda x: x["body"]).alias("lines"),
        )))

    return let(lines, cut)


def units(lines: Column) -> Column:
    """Normal forms a passage can be quoted by: the whole, and each line."""
    return F.filter(F.transform(F.array_append(lines, F.array_join(lines, " ")), normal), lambda x: x != "")


def link(messages: DataFrame) -> DataFrame:
    """Messages with reply_to, thread, place, n_quotes, n_linked and ``clean`` text without quotes."""
    whole = F.struct(*[F.col(f"`{c}`") for c in messages.columns if c not in COMPUTED])
    split = messages.select(whole.alias("row"), "conv_id", "turn", passages(F.col("text")).alias("_passages"))
    own = F.filter("_passages", lambda p: p["level"] == 0)
    quoted = F.filter("_passages", lambda p: p["level"] > 0)
    clean = F.trim(F.array_join(F.flatten(F.transform(own, lambda p: p["lines"])), "\n"), F.lit(" \t\n\r"))
    parsed = split.withColumns({"clean": clean, "n_quotes": F.size(quoted).cast("long"), "_own": own, "_quoted": quoted}).drop("_passages")
    asked = parsed.where(F.size("_quoted") > 0).select("conv_id", "turn", F.posexplode("_quoted").alias("at", "p"))
    asked = written(asked.select("conv_id", "turn", "at", F.col("p.level").alias("level"), F.explode(F.array_distinct(units(F.col("p.lines")))).alias("unit"))
                    .select("conv_id", "turn", "at", "level", F.xxhash64("unit").alias("hash"), F.char_length("unit").alias("size")).distinct(), "quotes")
    if asked.isEmpty():
        return _columns(parsed, None)
    offers = parsed.where("turn IS NOT NULL").select("conv_id", "turn", F.explode(F.array_distinct(F.array_union(F.flatten(F.transform("_own", lambda p: units(p["lines"]))), F.filter(F.array(normal(F.col("clean"))), lambda x: x != "")))).alias("unit"))
    offers = offers.select("conv_id", "turn", F.xxhash64("unit").alias("hash")).join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    # nearest earlier writer of each quoted unit: both sides in turn order, the last offer carried on
    both = offers.select("conv_id", "hash", "turn", F.col("turn").alias("source")).distinct().unionByName(asked.select("conv_id", "hash", "turn").distinct(), allowMissingColumns=True)
    before = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    nearest = both.withColumn("found", F.max("source").over(before)).where("source IS NULL AND found IS NOT NULL").select("conv_id", "hash", "turn", "found")
    linked = asked.join(nearest, ["conv_id", "hash", "turn"])
    # a passage comes from the writer of its longest unit
    by_passage = linked.groupBy("conv_id", "turn", "at", "level").agg(F.max(F.struct("size", "found"))["found"].alias("found"))
    choice = F.struct((-F.col("level")).alias("outer"), "found")
    replies = by_passage.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.max(choice)["found"].alias("reply_to"))
    return _columns(parsed, _threads(written(replies, "replies")))


def _threads(replies: DataFrame) -> DataFrame:
    """Adds the root of the chain of replies, doubling the step until all are at a root."""
    chain = replies.select("conv_id", "turn", F.col("reply_to").alias("thread"))
    while True:
        up = chain.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"))
        step = written(chain.join(up, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("above", "thread").alias("thread"), F.col("above").isNotNull().alias("moved")), "threads")
        chain = step.drop("moved")
        if step.where("moved").isEmpty():
            return replies.join(_places(chain), ["conv_id", "turn"], "full")


def _places(chain: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, place) of all messages of threads with replies.

    Ranges of (conv_id, thread, turn) split a long thread; each is numbered by itself
    and starts where the ranges before it end.
    """
    roots = chain.select("conv_id", F.col("thread").alias("turn"), "thread")
    thread = ["conv_id", "thread"]
    ranged = chain.unionAll(roots).distinct().repartitionByRange(*thread, "turn").withColumn("slice", F.spark_partition_id())
    ranged = written(ranged, "thread-ranges")
    parts = ranged.groupBy("slice", *thread).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*thread).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("slice", *thread, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("slice", *thread).orderBy("turn"))
    joined = ranged.withColumn("inside", inside).join(starts, ["slice", *thread])
    return joined.select("conv_id", "turn", "thread", (F.col("inside") + F.col("before")).alias("place"))


def _columns(parsed: DataFrame, replies: DataFrame | None) -> DataFrame:
    base = parsed.drop("_own", "_quoted")
    if replies is None:
        none = F.lit(None).cast("long")
        found = base.withColumns({"reply_to": none, "thread": F.col("turn").cast("long"), "place": F.lit(1).cast("long"), "n_linked": F.lit(0).cast("long")})
    else:
        joined = base.join(replies, ["conv_id", "turn"], "left")
        found = joined.withColumns({"thread": F.coalesce("thread", "turn").cast("long"), "place": F.coalesce("place", F.lit(1)).cast("long"), "reply_to": F.col("reply_to").cast("long"), "n_linked": F.coalesce("n_linked", F.lit(0)).cast("long")})
    return found.select("row.*", "clean", "n_quotes", "n_linked", "reply_to", "thread", "place")


def chat_lines(linked: DataFrame) -> DataFrame:
    """Role-tagged messages; ordered by (conv_id, thread, place) they are the formatted conversation."""
    tagged = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("clean"), F.lit("\n<|end|>\n"))
    return linked.withColumn("message", tagged)
