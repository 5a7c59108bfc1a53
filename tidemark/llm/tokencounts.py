"""Token counts as rollups that are kept up to date by signed changes.

A change is a document image with a sign: an insert is +1, a delete is -1 with the image as it was,
a revision is both. Counts are additive, so a batch of changes becomes a few sums per source,
language and tokenizer version, and the totals are the sums over all batches.

A store is a folder with one table per committed batch. A batch is written to a staging folder and
committed by renaming it to its own name; a name that is there already is left alone. So a batch
that is sent twice counts once, and one that broke off counts not at all.
"""

from __future__ import annotations

import urllib.parse
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import per_worker
from tidemark.llm.idfiles import Encoder

KEYS = ("source", "lang", "version")
DELTAS = "source string, lang string, version string, n_docs long, n_tokens long"
Counter = Callable[[Column], Column]

# Tokenizer versions that plain SQL can count.
BLANKS_1 = r"[^ \t\n\x0B\f\r]+"
WORDS_2 = r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\x0B\f\r]"
PLAIN: dict[str, Counter] = {
    "blanks-1": lambda text: F.regexp_count(text, F.lit(BLANKS_1)).cast("long"),
    "words-2": lambda text: F.regexp_count(text, F.lit(WORDS_2)).cast("long"),
}


def count_tokens(docs: DataFrame, counters: dict[str, Counter] = PLAIN, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``source``, ``lang``, ``keep``, and ``counts`` (version, n_tokens) of each row.

    A NULL text has no tokens; a NULL source, language or doc_id is a value like others. Extra
    columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    counts = F.array(*[F.struct(F.lit(v).alias("version"), c(text).alias("n_tokens")) for v, c in counters.items()])
    return docs.select("doc_id", "source", "lang", *keep, counts.alias("counts"))


def file_counter(tokenizer: str) -> Counter:
    """Counts by a tokenizers file (its path, read on the driver)."""
    model = open(tokenizer, encoding="utf-8").read()

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = per_worker(("encoder", hash(model)), lambda: Encoder(model))
        for batch in batches:
            yield pa.array([len(ids) // 4 for ids in encode(batch.to_pylist())], pa.int64())

    return run


def changes(counts: DataFrame, sign: int) -> DataFrame:
    """Signed rows per tokenizer version, from ``count_tokens``."""
    one = counts.select("source", "lang", F.explode("counts").alias("c"))
    return one.select(
        "source", "lang", "c.version", F.lit(sign).cast("long").alias("n_docs"), (F.col("c.n_tokens") * sign).alias("n_tokens")
    )


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def apply_batch(store: str, batch: str, signed: DataFrame) -> bool:
    """Commit the sums of ``signed`` under the name ``batch``; False if it is committed already."""
    spark = signed.sparkSession
    files, final = _folder(spark, f"{store}/batches/{urllib.parse.quote(batch, safe='')}")
    if files.exists(final):
        return False
    staging = f"{store}/staging/{uuid.uuid4().hex}"
    sums = signed.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    sums.write.parquet(staging)
    _, written = _folder(spark, staging)
    files.mkdirs(final.getParent())
    if files.exists(final) or not files.rename(written, final):
        return False
    # A writer that lost the race would have been moved into the winner's folder: take it out again.
    inside = _folder(spark, f"{final}/{written.getName()}")[1]
    if files.exists(inside):
        files.delete(inside, True)
        return False
    return True


def totals(spark: SparkSession, store: str) -> DataFrame:
    """``source``, ``lang``, ``version``, ``n_docs`` and ``n_tokens`` over all committed batches.

    Groups whose documents have all been deleted are left out; a store without batches is empty.
    """
    files, folder = _folder(spark, f"{store}/batches")
    if not files.exists(folder):
        return spark.createDataFrame([], DELTAS)
    rows = spark.read.schema(DELTAS).parquet(f"{store}/batches/*")
    sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.where("n_docs <> 0 OR n_tokens <> 0")
