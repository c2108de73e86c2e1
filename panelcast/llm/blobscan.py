"""Secret scans over a ledger of blobs, in built-in functions alone.

Every version of a text is addressed by its SHA-256. The ledger notes which
rules, by name and version, a blob was scanned with; a commit scans only pairs of
blob and rule version that are not in it yet, and each blob once however many
paths and versions hold it. Findings belong to blobs and are joined back to all
paths. A commit writes one table under its own number, what was scanned beside what
was found, so that a lost run leaves nothing behind. It reads the other commits only:
repeating it writes the same rows again, under its number or a new one.

A rule finds leftmost matches that do not overlap; matches with a short decisive
part are dropped after matching. Ends are places in code points: the texts
between the matches come from splitting by the same pattern, so a start is the
length of all that lies before.

Rows: null texts count as empty blobs; equal rows are versions with equal
findings; an empty table commits nothing; null paths are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.files import exists
from .store import written


@dataclass(frozen=True)
class Rule:
    """Pattern, the group whose length decides, the least length of it, and a version."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def label(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds in their order, then formats of well-known issuers.
BASE = [
    Rule("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
]
MORE = [
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 1),
]
RULES = [*BASE, *MORE]
SCAN = "blob string, scanned array<string>, findings array<struct<kind:string,version:int,start:bigint,stop:bigint>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scans(spark: SparkSession, ledger: str) -> DataFrame:
    """All rows of the ledger with the number of their commit; none if nothing was committed."""
    folder, schema = f"{ledger}/scans", f"{SCAN}, number int"
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", folder).parquet(folder)


def findings(spark: SparkSession, ledger: str) -> DataFrame:
    """(blob, kind, version, start, stop) of all commits, once each."""
    return scans(spark, ledger).select("blob", F.inline("findings")).distinct()


def commit(versions: DataFrame, ledger: str, number: int, rules: list[Rule] | None = None, path: str = "doc_id") -> None:
    """Scans the texts of ``versions`` (a path and a text) that the ledger lacks."""
    rules = RULES if rules is None else rules
    spark = versions.sparkSession
    addressed = versions.select(F.col(path).alias("path"), "text", blob_of(F.col("text")).alias("blob"))
    # the folder of this commit is neither listed nor read
    seen = scans(spark, ledger).where(F.col("number") != number)
    seen = seen.select("blob", F.explode("scanned").alias("label")).groupBy("blob").agg(F.collect_set("label").alias("seen"))
    wanted = F.array(*[F.lit(r.label) for r in rules])
    blobs = addressed.groupBy("blob").agg(F.min("path").alias("path"))
    pending = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    todo = blobs.join(seen, "blob", "left").select(F.col("blob").alias("_blob"), F.col("path").alias("_path"), pending.alias("pending")).where(F.size("pending") > 0)
    same = (addressed["blob"] == todo["_blob"]) & addressed["path"].eqNullSafe(todo["_path"])
    texts = addressed.join(todo, same).select("blob", F.coalesce("text", F.lit("")).alias("text"), "pending")
    found = scan(texts, rules).groupBy("blob").agg(F.collect_set(F.struct("kind", "version", "start", "stop")).alias("findings"))
    rows = todo.select(F.col("_blob").alias("blob"), F.col("pending").alias("scanned")).join(found, "blob", "left")
    empty = F.array().cast("array<struct<kind:string,version:int,start:bigint,stop:bigint>>")
    rows.withColumn("findings", F.coalesce("findings", empty)).write.mode("overwrite").parquet(f"{ledger}/scans/number={number}")


def scan(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of (blob, text, pending) for the pending rules."""

    def found(rule: Rule) -> Column:
        pattern = F.lit(rule.pattern)
        matches = F.regexp_extract_all("text", pattern, 0)
        return F.when(F.array_contains("pending", rule.label) & F.col("text").rlike(rule.pattern), F.struct(
            F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), F.lit(rule.least).alias("least"),
            F.arrays_zip(F.split("text", rule.pattern).alias("gap"), matches.alias("match"), (F.regexp_extract_all("text", pattern, rule.group) if rule.group else matches).alias("part")).alias("parts"),
        ))

    hit = texts.select("blob", F.inline(F.array_compact(F.array(*[found(r) for r in rules]))))
    each = hit.select("blob", "kind", "version", "least", F.posexplode("parts").alias("at", "x")).where("x.match IS NOT NULL")
    before = Window.partitionBy("blob", "kind", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("x.match")
    stop = F.sum(F.char_length("x.gap") + size).over(before)
    placed = each.select("blob", "kind", "version", (stop - size).alias("start"), stop.alias("stop"), "least", F.char_length("x.part").alias("decisive"))
    return placed.where("decisive >= least").select("blob", "kind", "version", "start", "stop")


def summaries(found: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Per blob: a count per base kind, the base spans and all spans as text."""
    rules = RULES if rules is None else rules
    current = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    own = found.where(F.col("version") == F.try_element_at(current, F.col("kind")))
    item = F.struct("start", F.element_at(rank, F.col("kind")).alias("rank"), F.concat_ws(":", "kind", "start", "stop").alias("span"))
    base = [r.kind for r in BASE]
    joined = lambda xs: F.array_join(F.transform(F.array_sort(xs), lambda x: x["span"]), ",")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base]
    return own.groupBy("blob").agg(*counts, joined(F.collect_list(F.when(F.col("kind").isin(base), item))).alias("base"), joined(F.collect_list(item)).alias("spans"))


def by_path(versions: DataFrame, ledger: str, rules: list[Rule] | None = None, path: str = "doc_id") -> DataFrame:
    """Every version with the findings of its blob: path, blob, counts, base_sha256, spans."""
    # written, so that the join can split a blob that holds a large share of the versions
    found = written(summaries(findings(versions.sparkSession, ledger), rules), "summaries")
    paths = versions.select(F.col(path), blob_of(F.col("text")).alias("blob"))
    counts = [f"n_{r.kind}" for r in BASE]
    joined = paths.join(found, "blob", "left").na.fill(0, counts).na.fill("", ["base", "spans"])
    return joined.select(path, *counts, F.sha2("base", 256).alias("base_sha256"), "spans", "blob")
