"""Secrets: an incremental ledger of scanned blobs, in DataFrame functions only.

A blob is a text, addressed by its SHA-256; every version of every document is one row of paths.
The ledger is a folder of two tables, both with a folder per batch:

* ``findings``  batch, blob, rule, version, start, stop (code points, end exclusive)
* ``scans``     batch, blob, rule, version: what has been looked at

A scan takes the distinct blobs with rule versions that ``scans`` does not hold and applies those
rules alone, so copies, unchanged documents and known rules cost no scan, and their texts are not
moved. It writes both tables aside and renames their folders, the findings first and the scans last;
findings of a batch without scans are those of a broken run and not read. Scans at the same time do
not disturb each other; what two of them look at is found twice and counts once. Findings reach all
paths of a blob by a join.
"""

from __future__ import annotations

import functools
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents_of, folder, settled
from tidemark.session import shared_dir

FINDINGS = "blob string, rule string, version int, start long, stop long, batch string"
SCANS = "blob string, rule string, version int, batch string"


class Rule(NamedTuple):
    """Leftmost non-overlapping matches of ``pattern``; ``group`` must have ``least`` code points."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


# Fixed values. A run of a class that is too short fails as a whole, so its least length can stand
# in the pattern; the value of an assignment cannot, as a dropped match still takes up its text.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("hub", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
)


def _table(spark: SparkSession, ledger: str, name: str, schema: str) -> DataFrame:
    """All batches of a table; empty before the first one."""
    files, where = folder(spark, f"{ledger}/{name}")
    if not files.exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{ledger}/{name}")


def _commit(rows: DataFrame, ledger: str, name: str, batch: str) -> None:
    staging = f"{ledger}/staging-{name}-{batch}"
    rows.write.parquet(staging)
    files, final = folder(rows.sparkSession, f"{ledger}/{name}/batch={batch}")
    files.mkdirs(final.getParent())
    if not files.rename(folder(rows.sparkSession, staging)[1], final):
        raise OSError(f"cannot rename {staging} to {final}")


def _parts(rule: Rule) -> Column:
    """For each match: length of the text since the one before, of the match, and of its group."""
    pattern = F.lit(rule.pattern)

    def lengths(values: Column) -> Column:
        return F.transform(values, lambda x: F.char_length(x))

    found = F.arrays_zip(
        lengths(F.split("text", rule.pattern, -1)).alias("gap"),
        lengths(F.regexp_extract_all("text", pattern, F.lit(0))).alias("size"),
        lengths(F.regexp_extract_all("text", pattern, F.lit(rule.group))).alias("value"),
    )
    return F.when(F.col("text").rlike(rule.pattern) & ~F.array_contains("seen", rule.name), found)


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Apply ``rules`` to the blobs of ``docs`` (blob, text) that they have not been applied to."""
    spark = docs.sparkSession
    wanted = F.lit(False)
    for rule in rules:
        wanted |= (F.col("rule") == rule.name) & (F.col("version") == rule.version)
    seen = _table(spark, ledger, "scans", SCANS).where(wanted).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    # Hashes first: only texts with something to look for are moved, one of each blob.
    unseen = docs.select("blob").distinct().join(seen, "blob", "left")
    unseen = unseen.withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    unseen = settled(unseen.where(F.size("seen") < len(rules)))
    fresh = docs.join(unseen, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("seen").alias("seen"))
    batch = "b" + uuid.uuid4().hex
    looked = F.array(*[
        F.when(~F.array_contains("seen", r.name), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")))
        for r in rules
    ])
    matches = F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), _parts(r).alias("parts"))
        for r in rules
    ])
    # One pass over the texts: what was looked at, and the lengths that give the matches' places.
    found = F.filter(matches, lambda m: m["parts"].isNotNull())
    passed = settled(fresh.select("blob", F.array_compact(looked).alias("looked"), found.alias("found")))
    parts = passed.select("blob", F.explode("found").alias("f")).select(
        "blob", "f.rule", "f.version", "f.least", F.posexplode("f.parts").alias("i", "p")
    )
    so_far = Window.partitionBy("blob", "rule").orderBy("i")
    stop = F.sum(F.col("p.gap") + F.coalesce("p.size", F.lit(0))).over(so_far)
    placed = parts.withColumn("stop", stop.cast("long")).where("p.size IS NOT NULL AND p.value >= least")
    found = placed.select("blob", "rule", "version", (F.col("stop") - F.col("p.size")).alias("start"), "stop")
    _commit(found, ledger, "findings", batch)
    looked = passed.select("blob", F.explode("looked").alias("l")).select("blob", "l.rule", "l.version")
    _commit(looked, ledger, "scans", batch)


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of whole batches, of these rule versions: blob, rule, start, stop."""
    whole = _table(spark, ledger, "scans", SCANS).select("batch").distinct()
    wanted = functools.reduce(
        lambda a, b: a | b, [(F.col("rule") == r.name) & (F.col("version") == r.version) for r in rules]
    )
    rows = _table(spark, ledger, "findings", FINDINGS).where(wanted)
    return rows.join(whole, "batch", "left_semi").select("blob", "rule", "start", "stop").distinct()


def find_secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, ``blob`` and ``spans`` (start, order, rule, stop; in that order) of every row.

    ``ledger`` is the folder of an earlier scan; by default a new one is made in the shared folder.
    A NULL text counts as empty and has no spans. Rows with a NULL doc_id stay out; rows that repeat
    a doc_id are versions of one path and each give a row. Extra columns are ignored; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    ledger = ledger or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    blobs = documents_of(docs).withColumn("blob", F.sha2("text", 256))
    scan(blobs.select("blob", "text"), ledger, rules)
    names = F.array(*[F.lit(r.name) for r in rules])
    span = F.struct("start", F.array_position(names, F.col("rule")).alias("order"), "rule", "stop")
    by_blob = findings(spark, ledger, rules).groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    paths = blobs.select("doc_id", "blob")
    none = F.array().cast("array<struct<start:bigint,order:bigint,rule:string,stop:bigint>>")
    return paths.join(by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["stop"])), ",")
