"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

1. Counts of every whole text: words, their characters, symbols, repeated lines and words of
   repeated three-word windows. They give each rule a *value*, a whole number from 0 to ``SCALE``.
2. Labelled documents are the holdout. Per stratum and rule, the cutoff is the smallest one whose
   false rejections (good texts with a larger value) pass an exact binomial test: with ``k`` of ``n``
   good texts rejected, P(Binomial(n, share) <= k) is at most the error allowed. Cutoffs are nested,
   so they are tested from the mildest on and need no correction among themselves (fixed sequence);
   ``delta`` is divided by the number of strata and rules (Bonferroni), and ``alpha`` by the rules.
   So with probability 1 - ``delta`` every stratum loses at most ``alpha`` of its good texts.
3. A rule takes effect in a stratum only where it rejects at least ``LIFT`` times as large a share of
   the poor texts as it may of the good ones. That choice looks at poor texts alone, so the bound holds.

Values are whole numbers of a small range: counts of good texts per stratum, rule and value combine
map-side, and a stratum meets in one task as at most ``SCALE`` rows per rule, however many it has.
Nothing is sampled. Copies of a text are one observation, as the test needs independent ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents_of, settled

BLANK = r"[\x20\x09-\x0D]+"
SOLID = r"[^\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50  # base rules: words, and percent of words in repeated windows
SCALE, LIFT = 10_000, 10
ALPHA, DELTA = 0.05, 0.05


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` computed once per row, also where ``of`` loops over it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _covered(windows: Column) -> Column:
    """Words in windows that occur again; ``windows`` (h, i) in the order of their hash."""

    def again(x: Column, j: Column) -> Column:
        same = (F.get(windows, j - 1)["h"] == x["h"]) | (F.get(windows, j + 1)["h"] == x["h"])
        return F.when(same, x["i"])

    starts = F.sort_array(F.array_compact(F.transform(windows, again)))
    return F.aggregate(
        starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + F.least(F.lit(3), i + 3 - a["end"])).alias("n")),
        lambda a: a["n"],
    )


def _repeat_words(hashes: Column) -> Column:
    n = F.size(hashes)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(
            F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.alias("i")
        ),
    )
    return F.when(n < 4, F.lit(0)).otherwise(_let(F.sort_array(windows), _covered))


def counts(docs: DataFrame, *extra: str) -> DataFrame:
    """Counts of every whole text: ``doc_id``, ``extra``, ``blob`` (the text's SHA-256), ``word_chars``
    (code points in words), ``n_symbols``, ``n_lines`` (with a word), ``n_dup_lines`` (equal to an
    earlier one), ``n_words`` and ``n_repeat_words`` (words in three-word windows found again).

    A NULL text counts as empty: all are 0. Rows with a NULL doc_id stay out; repeated rows each
    give a row. Windows are compared by 64-bit hashes.
    """
    text = F.col("text")

    def without(chars: str) -> Column:
        return F.char_length(F.translate(text, chars, ""))

    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    of_words = _let(words, lambda w: F.struct(
        F.size(w).alias("n"), _let(F.transform(w, lambda x: F.xxhash64(x)), _repeat_words).alias("again"),
    ))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(SOLID))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("different")))
    found = documents_of(docs, *extra).select(
        "doc_id", *extra, F.sha2("text", 256).alias("blob"), without(BLANKS).alias("word_chars"),
        (F.char_length(text) - without(SYMBOLS)).alias("n_symbols"), of_lines.alias("l"), of_words.alias("w"),
    )
    whole = {
        "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"), "n_lines": F.col("l.n"),
        "n_dup_lines": F.col("l.n") - F.col("l.different"), "n_words": F.col("w.n"),
        "n_repeat_words": F.col("w.again"),
    }
    return found.select("doc_id", *extra, "blob", *[c.cast("long").alias(k) for k, c in whole.items()])


def base_failed() -> Column:
    few = F.col("n_words") < LEAST_WORDS
    return few | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


class Rule(NamedTuple):
    """A text is rejected if ``value`` (an SQL expression over counts, larger is worse) is beyond the cutoff."""

    name: str
    value: str


def _share(part: str, whole: str) -> str:
    """In ten-thousandths; 0 without a whole."""
    return f"CASE WHEN {whole} > 0 THEN CAST(FLOOR({SCALE} * {part} / CAST({whole} AS DOUBLE)) AS BIGINT) ELSE 0 END"


_LENGTH = "LEAST(100 * word_chars / CAST(GREATEST(n_words, 1) AS DOUBLE), 10000.0)"
# Mean word lengths count in hundredths of a character, beyond 100 characters as 100.
RULES = (
    Rule("symbols", _share("n_symbols", "word_chars")),
    Rule("dup_lines", _share("n_dup_lines", "n_lines")),
    Rule("repeats", _share("n_repeat_words", "n_words")),
    Rule("long_words", f"CAST(FLOOR({_LENGTH}) AS BIGINT)"),
    Rule("short_words", f"{SCALE} - CAST(FLOOR({_LENGTH}) AS BIGINT)"),
)


def _ln_factorial(x: Column) -> Column:
    """ln x! by Stirling's series, from eight steps further on, where it is exact to 1e-13."""
    z = x + 9.0
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3.0))) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    steps = sum((F.ln(x + float(i)) for i in range(1, 9)), F.lit(0.0))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - steps


def binomial_at_most(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for whole k <= n; 1 where k is at least n * p, as is no use to a test.

    The sum starts with the term of k and goes down; terms shrink, and beyond 40 deviations they
    are less than a double can show.
    """
    k, n = k.cast("double"), n.cast("double")
    ln_term = (
        _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    reach = F.least(k, F.ceil(40 * F.sqrt(n * p)) + 100).cast("long")
    sums = F.aggregate(
        F.sequence(F.lit(0).cast("long"), reach),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda a, j: F.struct(
            (a["term"] * (k - j) / (n - k + j + 1) * ((1 - p) / p)).alias("term"),
            (a["total"] + a["term"]).alias("total"),
        ),
        lambda a: a["total"],
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(ln_term) * sums))


def cutoffs(
    counted: DataFrame, labels: DataFrame, stratum: str, rules: tuple[Rule, ...] = RULES,
    alpha: float = ALPHA, delta: float = DELTA,
) -> DataFrame:
    """``stratum``, ``rule``, ``cutoff`` of every rule that may reject in a stratum, with its evidence.

    ``n_good`` and ``n_poor`` texts, ``good_rejected`` and ``poor_rejected`` of them beyond the
    cutoff, and ``p_value``. ``labels`` has doc_id and quality (1 good, 0 poor); a text is poor if any
    label of its documents says so. NULL labels are none. A NULL stratum is one of its own. A
    stratum with too few good texts for the bound has no cutoff; without labels the result is empty.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    ).agg(F.min(F.col("quality").cast("int")).alias("good"))
    values = F.array(*[F.expr(r.value).alias(r.name) for r in rules])
    texts = counted.join(marks, "doc_id").groupBy(F.col(stratum).alias("stratum"), "blob").agg(
        F.min("good").alias("good"), F.first(values).alias("values")
    )
    rows = settled(
        texts.select("stratum", "good", F.posexplode("values").alias("rule", "value"))
        .groupBy("stratum", "rule", "value")
        .agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("poor"))
    )
    strata = rows.select("stratum").distinct().count()
    each = (delta / max(strata * len(rules), 1), alpha / len(rules))
    group = Window.partitionBy("stratum", "rule")
    above = group.orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tested = rows.select(
        "stratum", "rule", F.col("value").alias("cutoff"),
        F.sum("good").over(group).alias("n_good"), F.sum("poor").over(group).alias("n_poor"),
        F.coalesce(F.sum("good").over(above), F.lit(0)).alias("good_rejected"),
        F.coalesce(F.sum("poor").over(above), F.lit(0)).alias("poor_rejected"),
    ).withColumn("p_value", binomial_at_most(F.col("good_rejected"), F.col("n_good"), each[1]))
    kept = tested.where((F.col("p_value") <= each[0]) & (F.col("n_good") > 0))
    names = ["cutoff", "n_good", "n_poor", "good_rejected", "poor_rejected", "p_value"]
    best = kept.groupBy("stratum", "rule").agg(F.min(F.struct(*names)).alias("b")).select("stratum", "rule", "b.*")
    useful = F.col("poor_rejected") >= LIFT * each[1] * F.col("n_poor")
    name = F.element_at(F.array(*[F.lit(r.name) for r in rules]), F.col("rule") + 1)
    return best.where(useful & (F.col("n_poor") > 0)).withColumn("rule", name)


def verdicts(counted: DataFrame, cuts: DataFrame, stratum: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``counted`` with ``base_failed``, ``failed`` (names of rules that reject the text) and ``kept``."""
    table = cuts.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cuts"))
    joined = counted.join(table, counted[stratum].eqNullSafe(table["stratum"]), "left").drop("stratum")
    # A rule without a cutoff in the stratum compares with NULL and rejects nothing.
    failed = F.array_compact(F.array(*[
        F.when(F.expr(r.value) > F.try_element_at("_cuts", F.lit(r.name)), F.lit(r.name)) for r in rules
    ]))
    out = joined.withColumns({"base_failed": base_failed(), "failed": failed}).drop("_cuts")
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def quality(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES,
    alpha: float = ALPHA, delta: float = DELTA,
) -> DataFrame:
    """Counts and verdict of every document: the columns of ``counts``, ``base_failed``, ``failed``, ``kept``.

    The base rules reject texts of fewer than ``LEAST_WORDS`` words and those with more than
    ``MOST_REPEATED`` percent of words in repeated windows; the rest is up to the cutoffs, which
    texts that the base rules reject have no part in. A NULL text is empty and fails the base
    rules. Extra columns are ignored; empty tables give empty results or no cutoffs.
    """
    plain = docs.select("doc_id", "text", F.col(f"`{stratum}`").alias("_stratum"))
    counted = settled(counts(plain, "_stratum"))
    cuts = settled(cutoffs(counted.where(~base_failed()), labels, "_stratum", rules, alpha, delta))
    return verdicts(counted, cuts, "_stratum", rules).withColumnRenamed("_stratum", stratum)
