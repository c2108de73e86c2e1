"""Quality rules with line frequencies per host, in built-in functions alone.

A document is read once into a small row: counts of words, symbols, repeated
lines and repeated word windows, and one (hash, words) pair per line. Lines are
hashed in a normal form (A-Z folded, digits as 0, blanks collapsed). Per host,
distinct documents are counted per line, equal texts once (null as the empty one), so
that copies of a document don't make its lines common. A line above the limits is
removed from all documents of the host but the first that holds it; a document
that keeps too small a share of its words is depleted and rejected.

Rows: null texts have no words; null hosts form one host; rows equal in doc_id,
host and text get equal verdicts; an empty table gives no rows; other columns
stay untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .store import ascii_lower, words, written

BLANK_CHARS, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, WINDOW_WORDS = 10, 20, 5
#: A line goes that is in more texts of its host than MAX_DOCS, whatever the host's size, or in a small host
#: in more than MIN_DOCS that are more than HOST_PERCENT of its texts.
MAX_DOCS, MIN_DOCS, HOST_PERCENT, KEEP_PERCENT = 20, 5, 5, 30
KEY = ["doc_id", "host", "twin"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(word_list: Column, width: int = WINDOW_WORDS) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text."""

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - width)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    def covered(w: Column) -> Column:
        paired = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return let(paired, lambda s: _spread(F.array_sort(_twins(s)), width))

    def count(w: Column) -> Column:
        return F.when(F.size(w) == F.size(F.array_distinct(w)), F.lit(0)).otherwise(covered(w))

    hashes = F.transform(word_list, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) < width + 1, F.lit(0)).otherwise(let(windows(h), count)))


def _twins(s: Column) -> Column:
    """Places of the windows that equal a neighbour in hash order."""

    def twin(x: Column, i: Column) -> Column:
        same = F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
        return F.when(same, x["p"])

    return F.array_compact(F.transform(s, twin))


def _spread(places: Column, width: int) -> Column:
    start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
    step = F.aggregate(places, start, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last")))
    return step["n"]


def normal_line(line: Column) -> Column:
    digits = F.translate(ascii_lower(line), "123456789", "000000000")
    return F.trim(F.regexp_replace(digits, "[\\x20\\x09-\\x0D]+", " "))


def document_rows(docs: DataFrame, host: str) -> DataFrame:
    """Key, base counts and (hash, words) of the lines of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.xxhash64(text).alias("twin"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: without(line, BLANK_CHARS) != "")
    split = found.withColumns({"words": words(F.col("text")), "lines": lines})
    return split.select(
        *KEY,
        F.size("words").cast("long").alias("n_words"),
        F.char_length(without(F.col("text"), BLANK_CHARS)).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.transform("lines", lambda x: let(normal_line(x), lambda n: F.struct(F.xxhash64(n).alias("line"), (F.char_length(n) - F.char_length(without(n, " ")) + 1).alias("n")))).alias("lines"),
    )


def assess(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, host_percent: int = HOST_PERCENT, keep_percent: int = KEEP_PERCENT, max_docs: int = MAX_DOCS) -> DataFrame:
    """Key, counts, base_failed, the hashes of removed lines, words kept, and the verdict ``kept``.

    A line goes if it is in more than ``max_docs`` of the host's texts, or in more than
    ``min_docs`` and more than ``host_percent`` of them; a document goes if less than
    ``keep_percent`` of its words stay.
    """
    rows = written(document_rows(docs, host), "quality")
    held = rows.select("doc_id", "host", "twin", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    per_text = held.groupBy("host", "line", "twin").agg(F.min("doc_id").alias("first"))
    per_line = per_text.groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.min("first").alias("first")).where(F.col("n_docs") > min(min_docs, max_docs))
    per_host = rows.select("host", "twin").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    common = per_line.join(per_host, "host").where((F.col("n_docs") > max_docs) | ((F.col("n_docs") > min_docs) & (100 * F.col("n_docs") > host_percent * F.col("host_docs")))).select("host", "line", "first")
    each = rows.select(*KEY, F.explode("lines").alias("x")).select(*KEY, F.col("x.line").alias("line"), F.col("x.n").alias("n"))
    each = each.groupBy(*KEY, "line").agg(F.sum("n").alias("n"))
    hit = each.join(common, ["host", "line"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    removed = hit.groupBy(*KEY).agg(F.sum("n").alias("removed_words"), F.collect_set("line").alias("removed"))
    joined = _join(rows.drop("lines"), removed)
    lost = F.coalesce("removed_words", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - lost) < keep_percent * F.col("n_words")
    verdict = joined.withColumns({"base_failed": failed, "removed_words": lost})
    return verdict.withColumn("kept", ~F.col("base_failed") & ~depleted)


def _join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the key, null doc_ids included; equal rows keep their number."""
    named = right.select(*[F.col(k).alias(f"_{k}") for k in KEY], *[c for c in right.columns if c not in KEY])
    same = left["doc_id"].eqNullSafe(named["_doc_id"]) & (left["host"] == named["_host"]) & (left["twin"] == named["_twin"])
    return left.join(named, same, "left").drop(*[f"_{k}" for k in KEY])


def clean(docs: DataFrame, host: str = "source", **limits: int) -> DataFrame:
    """Documents that are kept, without their removed lines; columns as given."""
    verdicts = assess(docs, host, **limits).where("kept").select(*KEY, "removed").distinct()
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    keyed = whole.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"row.{host}"), F.lit("")).alias("host"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("twin"))
    found = _join(keyed, verdicts.withColumn("verdict", F.lit(True))).where("verdict")
    kept = F.filter(F.split("row.text", "\n"), lambda line: ~F.array_contains("removed", F.xxhash64(normal_line(line))))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in names])
