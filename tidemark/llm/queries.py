"""The registered queries of this folder, with the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, merkle, quality, secrets, tokencounts
from tidemark.llm.common import read, settled
from tidemark.llm.ctph import edited_with_next
from tidemark.llm.idfiles import read_ids, write_ids
from tidemark.llm.linededup import drop_repeated_lines
from tidemark.llm.neardup import near_duplicates
from tidemark.llm.passages import repeated_passages
from tidemark.llm.pieces import sample_segmentations
from tidemark.llm.toxicity import in_training, toxicity
from tidemark.llm.whitening import whiten
from tidemark.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return wrap


@query()
def op4_minhash_near_duplicates(spark, d):
    return near_duplicates(read(spark, d, "documents"), size=3, percent=85)


OP8_SQL = """WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.line, k.i, coalesce(k.doc_id <> r.keeper, false) AS gone
      FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


@query(OP8_SQL)
def op8_line_dedup(spark, d):
    out = drop_repeated_lines(read(spark, d, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op2_toxicity(spark, d):
    out = toxicity(read(spark, d, "documents"), read(spark, d, "labels"))
    return out.select(
        "doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", "predicted", "hits"
    )


def _seed_sql() -> str:
    parts = []
    for mask in decontam.MASKS:
        same = " AND ".join(f"d.w{k} = b.w{k}" for k, bit in enumerate(mask) if bit == "1")
        parts.append(f"SELECT d.doc_id, b.item_id, d.i - b.i AS shift FROM dw d JOIN bw b ON {same}")
    return " UNION ".join(parts)


_LEADS = ", ".join(f"lead(w, {k}) OVER (PARTITION BY {{id}} ORDER BY i) AS w{k}" for k in range(decontam.SPAN))
_INNER = "regexp_replace(lower(text), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')"
_TOKENS = f"regexp_split_to_array({_INNER}, '[^\\p{{L}}\\p{{N}}]+')"
OP1_SQL = f"""WITH dl AS (SELECT doc_id, {_TOKENS} AS ws FROM documents WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')),
bl AS (SELECT DISTINCT item_id, {_TOKENS} AS ws FROM benchmark WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')),
dt AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM dl),
bt AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM bl),
dw AS (SELECT doc_id, i, {_LEADS.format(id='doc_id')} FROM dt),
bw AS (SELECT item_id, i, {_LEADS.format(id='item_id')} FROM bt),
tries AS ({_seed_sql()}),
pos AS (SELECT t.doc_id, t.item_id, t.shift, d.i, (d.w = b.w)::INT AS eq,
               least({decontam.WINDOW}, len(l.ws)) AS wide
        FROM tries t JOIN bl l USING (item_id) JOIN bt b ON b.item_id = t.item_id
        JOIN dt d ON d.doc_id = t.doc_id AND d.i = b.i + t.shift),
run AS (SELECT *, sum(eq) OVER w AS total, count(*) OVER w AS n FROM pos
        WINDOW w AS (PARTITION BY doc_id, item_id, shift ORDER BY i
                     RANGE BETWEEN CURRENT ROW AND (wide - 1) FOLLOWING)),
ok AS (SELECT doc_id, item_id, shift, min(i) AS start, max(i + wide) AS stop FROM run
       WHERE n = wide AND total * {decontam.WINDOW} >= wide * {decontam.SAME} GROUP BY 1, 2, 3),
cnt AS (SELECT k.doc_id, k.item_id, k.start, k.stop, k.stop - k.start AS n_words, sum(p.eq)::BIGINT AS n_equal
        FROM ok k JOIN pos p ON p.doc_id = k.doc_id AND p.item_id = k.item_id AND p.shift = k.shift
             AND p.i >= k.start AND p.i < k.stop GROUP BY ALL)
SELECT doc_id, item_id, start::BIGINT AS start, stop::BIGINT AS stop, n_words::BIGINT AS n_words, n_equal FROM cnt
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, n_words, start) = 1"""


@query(OP1_SQL)
def op1_benchmark_decontamination(spark, d):
    return decontam.contaminated(read(spark, d, "documents"), read(spark, d, "benchmark"))


PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query()
def op7_sampled_pieces(spark, d, model: str = PIECES):
    return sample_segmentations(read(spark, d, "documents"), model)


def _span_sql(number: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {number} AS k, '{rule.name}' AS kind, {rule.least} AS least,
  unnest(regexp_split_to_array(text, '{pattern}')) AS gap,
  unnest(list_concat(regexp_extract_all(text, '{pattern}', 0), [NULL])) AS found,
  unnest(list_concat(regexp_extract_all(text, '{pattern}', {rule.group}), [NULL])) AS value,
  generate_subscripts(regexp_split_to_array(text, '{pattern}'), 1) AS i
  FROM t WHERE regexp_matches(text, '{pattern}')"""


OP3_SQL = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS ({' UNION ALL '.join(_span_sql(n, r) for n, r in enumerate(secrets.RULES))}),
q AS (SELECT *, sum(length(gap) + coalesce(length(found), 0)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM p),
s AS (SELECT doc_id, k, kind, (stop - length(found))::BIGINT AS start, stop::BIGINT AS stop FROM q
      WHERE found IS NOT NULL AND length(value) >= least),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
             count(*) FILTER (k = 2) AS n_hex,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 3) AS base,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans
      FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)"""


@query(OP3_SQL)
def op3_secret_scan(spark, d):
    out = secrets.find_secrets(read(spark, d, "documents"))

    def count(name):
        return F.size(F.filter("spans", lambda s: s["rule"] == name)).cast("long").alias(f"n_{name}")

    base = F.filter("spans", lambda s: s["rule"].isin([r.name for r in secrets.BASE]))
    return out.select(
        "doc_id", *[count(r.name) for r in secrets.BASE],
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"),
    )


@query()
def op6_fingerprints(spark, d):
    return edited_with_next(read(spark, d, "documents"))


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@query()
def op10_id_files(spark, d, tokenizer: str = BYTE_BPE):
    folder = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    files = write_ids(read(spark, d, "documents"), tokenizer, folder, end_id=2)
    return read_ids(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_LINES = "string_split(coalesce(text, ''), chr(10))"
OP5_SQL = rf"""WITH k AS (SELECT * FROM documents QUALIFY doc_id = min(doc_id) OVER (PARTITION BY coalesce(text, ''))),
l AS (SELECT DISTINCT doc_id, source, lang, unnest({_LINES}) AS line FROM k),
c AS (SELECT doc_id, source, lang, sum(len(regexp_extract_all(line, '[^ \t\n\v\f\r]+'))) AS blanks,
             sum(len(regexp_extract_all(line, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}} \t\n\v\f\r]'))) AS words
      FROM l GROUP BY ALL)
SELECT source, lang, 'blanks-1' AS version, count(*) AS n_docs, sum(blanks)::BIGINT AS n_tokens FROM c GROUP BY 1, 2
UNION ALL
SELECT source, lang, 'words-2', count(*), sum(words)::BIGINT FROM c GROUP BY 1, 2"""


@query(OP5_SQL)
def op5_token_rollups(spark, d):
    """A corpus is loaded, its exact copies are deleted, and lines repeated in a document go."""
    store = f"{shared_dir(spark)}/rollups-{uuid.uuid4().hex}"
    docs = read(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("blob", F.sha2("text", 256))
    lines = F.split("text", "\n", -1)
    shorter = F.array_join(F.array_distinct(lines), "\n")
    loaded = settled(tokencounts.count_tokens(docs, keep=("blob",)))
    first = loaded.groupBy("blob").agg(F.min("doc_id").alias("first"))
    copies = loaded.join(first, "blob").where("doc_id <> first")
    repeats = docs.where(F.size(lines) > F.size(F.array_distinct(lines)))
    revised = tokencounts.count_tokens(repeats.withColumn("text", shorter), keep=("blob",))
    revised = settled(revised.join(first, F.col("doc_id") == F.col("first"), "left_semi"))
    before = loaded.join(revised.select("doc_id"), "doc_id", "left_semi")
    batches = [
        ("load", tokencounts.changes(loaded, 1)),
        ("copies", tokencounts.changes(copies, -1)),
        ("lines", tokencounts.changes(before, -1).unionByName(tokencounts.changes(revised, 1))),
        ("copies", tokencounts.changes(copies, -1)),  # sent again, counts once
    ]
    for name, signed in batches:
        tokencounts.apply_batch(store, name, signed)
    return tokencounts.totals(spark, store)


@query()
def op9_repeated_passages(spark, d):
    return repeated_passages(read(spark, d, "documents"))


# A rule's value as in quality.RULES; the cutoffs by sorted values and DuckDB's lgamma.
_RULES = ", ".join(f"struct_pack(rule := {n}, v := {rule.value})" for n, rule in enumerate(quality.RULES))
_P = quality.ALPHA / len(quality.RULES)
_WORDS = r"[x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']"
_SOLID_LINES = rf"[x FOR x IN {_LINES} IF regexp_matches(x, '[^\x20\x09-\x0D]')]"
OP13_SQL = rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS ws, {_SOLID_LINES} AS ls FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
w3 AS (SELECT doc_id, i, w, lead(w) OVER o AS x, lead(w, 2) OVER o AS y FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM w3 WHERE y IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, w, x, y) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) t(k) GROUP BY doc_id),
c AS (SELECT doc_id, lang, text, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed,
             unnest([{_RULES}], recursive := true) FROM c),
marks AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
texts AS (SELECT lang, text, rule, min(good) AS good, min(v) AS v FROM b JOIN marks USING (doc_id)
          WHERE NOT base_failed GROUP BY lang, text, rule),
n AS (SELECT lang, rule, sum(good) AS n_good, sum(1 - good) AS n_poor FROM texts GROUP BY lang, rule),
cut AS (SELECT DISTINCT lang, rule, v AS cutoff FROM texts),
tried AS (SELECT cut.lang, cut.rule, cutoff, n_good, n_poor, count(*) FILTER (v > cutoff AND good = 1) AS k,
              count(*) FILTER (v > cutoff AND good = 0) AS poor
       FROM cut JOIN n ON n.lang IS NOT DISTINCT FROM cut.lang AND n.rule = cut.rule
       JOIN texts t ON t.lang IS NOT DISTINCT FROM cut.lang AND t.rule = cut.rule GROUP BY ALL),
p AS (SELECT *, list_sum([exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1)
                              + j * ln({_P}) + (n_good - j) * ln(1 - {_P})) FOR j IN range(k + 1)]) AS p_value
      FROM tried WHERE k < n_good * {_P}),
best AS (SELECT * FROM p WHERE p_value <= {quality.DELTA} / (SELECT count(*) FROM n)
         QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY cutoff) = 1),
used AS (SELECT lang, rule, cutoff FROM best WHERE n_poor > 0 AND poor >= {quality.LIFT * _P} * n_poor)
SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       bool_and(NOT base_failed AND NOT coalesce(v > cutoff, false)) AS kept
FROM b LEFT JOIN used ON used.lang IS NOT DISTINCT FROM b.lang AND used.rule = b.rule GROUP BY ALL"""


@query(OP13_SQL)
def op13_quality_rules(spark, d):
    out = quality.quality(read(spark, d, "documents"), read(spark, d, "labels"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _leaf_sql(text: str) -> str:
    values = [f"CAST({c} AS VARCHAR)" for c in merkle.COLUMNS[:-1]] + [text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"


# Trees level by level; crc32 by its table, one character of the id at a time.
OP11_SQL = f"""WITH RECURSIVE
bits(i, v, k) AS (SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) r(i) UNION ALL
  SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc(doc_id, s, c) AS (SELECT DISTINCT doc_id, doc_id::VARCHAR, 4294967295 FROM documents WHERE doc_id IS NOT NULL UNION ALL
  SELECT doc_id, s[2:], xor(v, c // 256) FROM crc JOIN bits ON k = 8 AND i = xor(c % 256, ascii(s[1])) WHERE s <> ''),
even AS (SELECT doc_id FROM crc WHERE s = '' AND xor(c, 4294967295) % 2 = 0),
leaves AS (SELECT doc_id, coalesce('v' || source, '') AS t, {_leaf_sql("text")} AS leaf,
  CASE WHEN doc_id IN (SELECT doc_id FROM even) THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS now
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes(t, lvl, pos, h, n) AS (SELECT t, 0, pos, leaf, count(*) OVER (PARTITION BY t) FROM placed UNION ALL
  SELECT t, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM nodes WHERE n > 1 GROUP BY t, lvl, pos // 3),
subs AS (SELECT t, h AS subroot, row_number() OVER (ORDER BY t) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(lvl, pos, h, n) AS (SELECT 0, pos, subroot, n FROM subs UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM tops WHERE n > 1 GROUP BY lvl, pos // 3),
every AS (SELECT 'g' || t AS t, lvl, pos, h FROM nodes WHERE n > 1 UNION ALL SELECT 'top', lvl, pos, h FROM tops WHERE n > 1),
steps AS (SELECT a.t, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
            coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM every a JOIN every b ON b.t = a.t AND b.lvl = a.lvl AND b.pos // 3 = a.pos // 3 GROUP BY ALL),
climb(id, lvl, pos, proof, now, up) AS (
  SELECT (t, pos), 0, pos, '', now, 'g' || t FROM placed UNION ALL
  SELECT id, c.lvl + 1, c.pos // 3, proof || l || r, sha256(l || now || r), up
  FROM climb c JOIN steps s ON s.t = c.up AND s.lvl = c.lvl AND s.pos = c.pos),
half AS (SELECT id, proof, now FROM climb QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl DESC) = 1),
climb2(id, lvl, pos, proof, now) AS (
  SELECT p.id, 0, u.pos, p.proof, p.now FROM half p JOIN subs u ON u.t = p.id[1] UNION ALL
  SELECT id, c.lvl + 1, c.pos // 3, proof || l || r, sha256(l || now || r)
  FROM climb2 c JOIN steps s ON s.t = 'top' AND s.lvl = c.lvl AND s.pos = c.pos),
whole AS (SELECT id, proof, now FROM climb2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl DESC) = 1)
SELECT p.doc_id, p.leaf, u.subroot, o.h AS root, sha256(w.proof) AS proof_sha256, w.now AS folded_root,
       w.now = o.h AS verified
FROM placed p JOIN whole w ON w.id[1] = p.t AND w.id[2] = p.pos JOIN subs u ON u.t = p.t JOIN tops o ON o.n = 1"""


@query(OP11_SQL)
def op11_merkle_manifest(spark, d):
    """Rows of even checksum lose their line breaks afterwards and are folded with their old proofs."""
    docs = read(spark, d, "documents")
    values = [F.col(c) for c in merkle.COLUMNS]
    loses = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(loses, F.translate("text", "\n", "")).otherwise(F.col("text"))
    out = merkle.manifest(docs.withColumn("now", merkle.leaf_hash(*values[:-1], text)), carry=("now",))
    out = out.withColumn("folded_root", merkle.folded(F.col("now"), F.col("proof")))
    return out.select(
        "doc_id", "leaf", "subroot", "root", merkle.siblings_hash(F.col("proof")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query()
def op12_embedding_whitening(spark, d):
    out = whiten(read(spark, d, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))
