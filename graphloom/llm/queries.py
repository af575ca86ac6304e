"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_tools import format_messages, link_tool_calls
from .common import words_of
from .exact_dedup import exact_dedup
from .hidden_markov import score_texts
from .jaccard_join import jaccard_join
from .merkle import half_of_ids, merkle_manifest
from .mixing import mix_sources
from .periodic_runs import longest_run, periodic_runs
from .quality_classifier import fit_quality, score_quality
from .quality_rules import RULES, STOP_WORDS, SYMBOLS, quality_rules
from .sentencepiece_lattice import DEFAULT_MODEL, Vocabulary, encode
from .toxicity import fit_toxicity, score_toxicity
from .url_filters import host_of, path_of, url_filter
from .warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1: URL filters -----------------------------------------------------------------------------

DAY0 = 1704067200  # 2024-01-01T00:00:00Z


def _digits(text, at: int):
    """Four hex digits of the md5 of a text as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), at, 4), 16, 10).cast("long")


def derived_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time, spread over 2024 by page id."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(DAY0) + F.col("page_id") * 7919 % 525600 * 60).alias("fetch_time"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated block list over the hosts and first path segments that the pages name."""
    seen = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host is not null")
    seen = seen.select("host", F.concat(F.col("host"), F.regexp_extract("path", r"^/[^/]*/", 0)).alias("prefix"))
    hosts = seen.select(F.lit("domain").alias("kind"), F.col("host").alias("pattern")).distinct()
    prefixes = seen.where(F.col("prefix") != F.col("host")).select(F.lit("prefix").alias("kind"), F.col("prefix").alias("pattern")).distinct()
    p = F.col("pattern")
    day = _digits(p, 1) % 300
    dated = F.array(
        F.struct(F.lit("add").alias("action"), day.alias("day")),
        F.struct(F.lit("remove").alias("action"), (day + 1 + _digits(p, 5) % 90).alias("day")),
        F.struct(F.lit("add").alias("action"), (day + 120 + _digits(p, 9) % 60).alias("day")),
    )
    category = F.element_at(F.array(F.lit("spam"), F.lit("malware"), F.lit("adult")), (_digits(p, 13) % 3 + 1).cast("int"))
    both = hosts.unionByName(prefixes)
    return both.select("kind", "pattern", category.alias("category"), F.inline(dated)).select("kind", "pattern", "category", "action", F.timestamp_seconds(F.lit(DAY0) + F.col("day") * 86400).alias("effective_at"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter(derived_captures(pages), derived_entries(pages)).select("page_id", "blocked", "n_active", "first_match")


OP1_SQL = r"""
WITH c AS (
  SELECT page_id, TIMESTAMP '2024-01-01' + to_minutes(CAST(page_id * 7919 % 525600 AS BIGINT)) AS fetched,
    nullif(regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '^www\.', ''), '') AS host,
    coalesce(nullif(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), ''), '/') AS path
  FROM pages),
e AS (
  SELECT DISTINCT 'domain' AS kind, host AS pattern FROM c WHERE host IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'prefix', host || regexp_extract(path, '^/[^/]*/') FROM c WHERE host IS NOT NULL AND regexp_extract(path, '^/[^/]*/') <> ''),
n AS (
  SELECT kind, pattern, CAST('0x' || md5(pattern)[1:4] AS BIGINT) AS n1, CAST('0x' || md5(pattern)[5:8] AS BIGINT) AS n2,
    CAST('0x' || md5(pattern)[9:12] AS BIGINT) AS n3, CAST('0x' || md5(pattern)[13:16] AS BIGINT) AS n4 FROM e),
v AS (
  SELECT kind, pattern, n4, n1 % 300 AS d1, n1 % 300 + 1 + n2 % 90 AS d2 FROM n
  UNION ALL
  SELECT kind, pattern, n4, n1 % 300 + 120 + n3 % 60, 100000 FROM n),
i AS (
  SELECT kind, pattern, CASE n4 % 3 WHEN 0 THEN 'spam' WHEN 1 THEN 'malware' ELSE 'adult' END AS category,
    TIMESTAMP '2024-01-01' + to_days(CAST(d1 AS INTEGER)) AS f, TIMESTAMP '2024-01-01' + to_days(CAST(d2 AS INTEGER)) AS t FROM v),
m AS (
  SELECT page_id, category || ' ' || kind || ' ' || pattern AS label FROM c JOIN i
  ON f <= fetched AND fetched < t AND CASE WHEN kind = 'domain' THEN host = pattern OR ends_with(host, '.' || pattern) ELSE starts_with(host || path, pattern) END)
SELECT c.page_id, count(label) > 0 AS blocked, count(label) AS n_active, min(label) AS first_match
FROM c LEFT JOIN m USING (page_id) GROUP BY c.page_id
"""


# --- 2: mixing ----------------------------------------------------------------------------------

def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('17:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:16] AS ticket FROM documents),
s AS (
  SELECT source, sum(size)::HUGEINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
    coalesce(sum(3 * source_size) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before FROM s
  WINDOW b AS (ORDER BY 3 * source_size * 10 // w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CAST(cap AS DOUBLE) * CAST(all_w - w_before AS DOUBLE) <= CAST(w AS DOUBLE) * CAST(total - cap_before AS DOUBLE) AS capped FROM f),
h AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
    (CAST(total AS DOUBLE) - CAST(coalesce(sum(cap) FILTER (capped) OVER (), 0) AS DOUBLE)) * CAST(w AS DOUBLE) / CAST(sum(w) FILTER (NOT capped) OVER () AS DOUBLE) END AS target FROM g),
t AS (
  SELECT *, least(CASE WHEN source_size > 0 THEN floor(target / CAST(source_size AS DOUBLE)) ELSE 0 END, 3)::INTEGER AS whole FROM h),
a AS (
  SELECT d.*, t.source_size, t.target, t.whole, CAST(floor(t.target - t.whole * CAST(t.source_size AS DOUBLE)) AS BIGINT) AS fraction,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ticket, doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(whole * size + greatest(0, least(size, fraction - before)) AS BIGINT) AS taken FROM a
"""


# --- 3: SentencePiece ---------------------------------------------------------------------------

def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = DEFAULT_MODEL) -> DataFrame:
    coded = encode(_table(spark, sf_dir, "documents"), Vocabulary(model_file), alternatives=True)
    ranked = F.transform("nbest_ids", lambda ids: F.xxhash64(ids))
    return coded.select("doc_id", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "score", "nbest_scores", ranked.alias("nbest_hashes"), "round_trip")


# --- 4: quality rules ---------------------------------------------------------------------------

def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op4_sql() -> str:
    words = ", ".join(f"'{w}'" for s in STOP_WORDS for w in (s, s.capitalize()))
    columns = {
        "mean_word_chars": "word_chars / nullif(n_words, 0)", "symbol_ratio": "n_symbols / nullif(n_words, 0)", "stop_ratio": "n_stop / nullif(n_words, 0)",
        "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)", "bullet_ratio": "n_bullet / nullif(n_lines, 0)", "ellipsis_ratio": "n_ellipsis / nullif(n_lines, 0)",
    }
    rules = [f"coalesce({columns[r.statistic]} {op} {v}, true)" for r in RULES for op, v in ((">=", r.low), ("<=", r.high)) if v is not None]
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS w FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
twice AS (SELECT r, i FROM win WHERE (r, w) IN (SELECT (r, w) FROM win GROUP BY r, w HAVING count(*) > 1)),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) AS o(k) GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(body) - length(regexp_replace(body, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols, len(lines) AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda x: x IN ({words}))) AS n_stop,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullet, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis
  FROM d LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {" AND ".join(rules)} AS verdict FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND verdict AS kept FROM b
"""


# --- 5: exact dedup -----------------------------------------------------------------------------

def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS place,
  first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""


# --- 6: n-gram Jaccard join ---------------------------------------------------------------------

def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"))


# --- 7: WARC ------------------------------------------------------------------------------------

def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive_pages(_table(spark, sf_dir, "pages"))
    return records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f
"""


# --- 8 and 10: classifiers ----------------------------------------------------------------------

def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))
    worst = F.array_max(F.transform("offending", lambda x: F.struct(x["score"], -x["sentence"])))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_sentences", F.size("offending").alias("n_offending"), (-worst["col2"]).alias("worst_sentence"))


# --- 9: chat formatting -------------------------------------------------------------------------

TOOLS = {"search": {"query": ("string", True), "limit": ("integer", True)}, "measure": {"query": ("string", True), "limit": ("number", False)}}


def derived_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tool traffic and other messages of every conversation: each assistant turn is a call whose arguments
    hold its whole text (some of them broken or invalid), each later user turn is the result of the turn
    before with its whole text as content; all other turns are ordinary messages."""
    turns = turns.withColumn("text", F.coalesce("text", F.lit("")))
    n, quoted = F.length("text"), F.regexp_extract(F.to_json(F.struct("text")), r"(?s)^\{\"text\":(.*)\}$", 1)
    name = lambda t: F.concat(F.lit("c"), t.cast("string"))
    limit = F.when(n % 5 == 0, F.lit('"many"')).otherwise((n % 20).cast("string"))
    arguments = F.when(n % 11 == 0, F.concat(F.lit('{"query": '), quoted)).when(n % 7 == 0, F.concat(F.lit('{ "query": '), quoted, F.lit(" }"))).otherwise(F.concat(F.lit('{ "query": '), quoted, F.lit(', "limit": '), limit, F.lit("}")))
    needs = F.when(n % 6 == 0, F.array(name(F.col("turn") + 2))).when(n % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(name(F.col("turn") - 2)))
    tool = F.when(n % 4 < 2, "search").when(n % 4 == 2, "measure").otherwise("unknown")
    is_call = F.coalesce(F.col("role") == "assistant", F.lit(False))
    is_result = F.coalesce((F.col("role") == "user") & (F.col("turn") > 0), F.lit(False))
    calls = turns.where(is_call).select("conv_id", name(F.col("turn")).alias("call_id"), "turn", tool.alias("tool"), arguments.alias("arguments"), needs.alias("needs"))
    results = turns.where(is_result).select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results, turns.where(~is_call & ~is_result).select("conv_id", "turn", "role", F.col("text").alias("content"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, messages = derived_calls(_table(spark, sf_dir, "conversations"))
    linked = link_tool_calls(calls, results, TOOLS).unionByName(format_messages(messages))
    return linked.select("conv_id", "call_id", "level", "turn", "status", "valid", "json")


OP9_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
k AS (
  SELECT conv_id, 'c' || turn AS call_id, turn, CASE WHEN n % 4 < 2 THEN 'search' WHEN n % 4 = 2 THEN 'measure' ELSE 'unknown' END AS tool,
    CASE WHEN n % 11 = 0 THEN '{"query": ' || to_json(text)::VARCHAR WHEN n % 7 = 0 THEN '{ "query": ' || to_json(text)::VARCHAR || ' }'
      ELSE '{ "query": ' || to_json(text)::VARCHAR || ', "limit": ' || CASE WHEN n % 5 = 0 THEN '"many"' ELSE CAST(n % 20 AS VARCHAR) END || '}' END AS raw,
    CASE WHEN n % 11 = 0 THEN NULL WHEN n % 7 = 0 THEN '{"query":' || to_json(text)::VARCHAR || '}'
      ELSE '{"limit":' || CASE WHEN n % 5 = 0 THEN '"many"' ELSE CAST(n % 20 AS VARCHAR) END || ',"query":' || to_json(text)::VARCHAR || '}' END AS arguments,
    n % 4 < 3 AND n % 11 <> 0 AND CASE WHEN n % 7 = 0 THEN n % 4 = 2 ELSE n % 5 <> 0 END AS valid,
    CASE WHEN n % 6 = 0 THEN 'c' || (turn + 2) WHEN n % 3 = 0 THEN NULL ELSE 'c' || (turn - 2) END AS need
  FROM t WHERE role = 'assistant'),
kr AS (SELECT *, conv_id IS NULL OR call_id IS NULL AS void, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, tool, raw, need NULLS FIRST) AS place FROM k),
c AS (SELECT * FROM kr WHERE NOT void AND place = 1),
e AS (SELECT conv_id, call_id, CASE WHEN (conv_id, need) IN (SELECT (conv_id, call_id) FROM c) THEN need END AS need FROM c),
walk AS (
  SELECT conv_id, call_id, need AS step, 0 AS depth FROM e
  UNION ALL
  SELECT w.conv_id, w.call_id, e.need, w.depth + 1 FROM walk w JOIN e ON e.conv_id = w.conv_id AND e.call_id = w.step WHERE w.depth < 100),
lv AS (SELECT conv_id, call_id, max(depth) AS level FROM walk WHERE step IS NULL GROUP BY ALL),
rr AS (
  SELECT *, conv_id IS NULL OR call_id IS NULL AS void, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, text) AS place
  FROM (SELECT conv_id, 'c' || (turn - 1) AS call_id, turn, text FROM t WHERE role = 'user' AND turn > 0)),
r AS (SELECT * FROM rr WHERE NOT void AND place = 1),
j AS (
  SELECT conv_id, call_id, lv.level, coalesce(c.turn, r.turn) AS turn,
    CASE WHEN c.tool IS NULL THEN 'orphan' WHEN lv.level IS NULL THEN 'cycle' WHEN r.text IS NULL THEN 'unanswered' ELSE 'answered' END AS status,
    coalesce(c.valid, false) AS valid, c.tool, c.arguments, r.text FROM c FULL JOIN r USING (conv_id, call_id) LEFT JOIN lv USING (conv_id, call_id)
  UNION ALL
  SELECT conv_id, call_id, NULL, turn, CASE WHEN void THEN 'void' ELSE 'duplicate' END, valid, tool, arguments, NULL FROM kr WHERE void OR place > 1
  UNION ALL
  SELECT conv_id, call_id, NULL, turn, CASE WHEN void THEN 'void' ELSE 'duplicate' END, false, NULL, NULL, text FROM rr WHERE void OR place > 1)
SELECT conv_id, call_id, level, turn, status, valid,
  '{"arguments":' || to_json(coalesce(arguments, 'null'))::VARCHAR || ',"call_id":' || coalesce('"' || call_id || '"', 'null') || ',"result":' || coalesce(to_json(text)::VARCHAR, 'null')
  || ',"status":"' || status || '","tool":' || coalesce('"' || tool || '"', 'null') || ',"valid":' || CASE WHEN valid THEN 'true' ELSE 'false' END || '}' AS json FROM j
UNION ALL
SELECT conv_id, NULL, NULL, turn, 'message', false, '{"content":' || to_json(text)::VARCHAR || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}'
FROM t WHERE coalesce(role <> 'assistant' AND NOT (role = 'user' AND turn > 0), true)
"""


# --- 11: periodic runs --------------------------------------------------------------------------

def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; where 10 divides h = crc32 of the id, the words from g % n on repeat a period, g = h // 10."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = words_of(F.col("text"))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    cycle = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    cycles = F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int")))
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(cycles, F.lit(1), (n - a).cast("int"))), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(_table(spark, sf_dir, "documents"))).withColumn("best", longest_run())
    start, length, period = (F.col(f"best.{c}") for c in ("start", "length", "period"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


# --- 12: Merkle manifest ------------------------------------------------------------------------

def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = F.replace("text", F.lit("\n"), F.lit(""))
    return merkle_manifest(_table(spark, sf_dir, "documents"), {"text": F.when(half_of_ids(F.col("doc_id")), stripped).otherwise(F.col("text"))})


#: crc32 of a text in DuckDB: the table of the 256 bytes, then one step a byte.
CRC_SQL = """crc AS (SELECT list(t ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) AS r(i)))"""


def crc_sql(text: str) -> str:
    """Unsigned crc32 of a text of ASCII characters."""
    return f"(SELECT xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]))) FROM crc)"


OP11_SQL = rf"""
WITH {CRC_SQL},
o AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, {crc_sql("coalesce(doc_id::VARCHAR, '')")} AS h FROM documents),
n AS (SELECT *, len(words) AS n, h // 10 AS g, (h // 10) % nullif(len(words), 0) AS a FROM o),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM n),
d AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE words END AS words FROM p),
w AS (SELECT r, n, unnest(range(n)) AS i, unnest(words) AS word FROM d),
pairs AS (SELECT x.r, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, start, length, min(q) AS q FROM stretches GROUP BY r, start, length),
best AS (SELECT r, count(*) AS n_runs, first(struct_pack(start := start, length := length, q := q) ORDER BY length DESC, start, q) AS b,
  string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start AS start, b.length AS length, b.q AS period, b.length * 1000 // b.q AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""

OP12_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
d AS (
  SELECT *, CASE WHEN {crc_sql("coalesce(doc_id::VARCHAR, '')")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS found FROM documents),
f AS (
  SELECT doc_id, source, leaf, found FROM (
    SELECT doc_id, source, h || coalesce(strlen(text) || ':' || text, '-') AS leaf, h || coalesce(strlen(found) || ':' || found, '-') AS found FROM (
      SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
        || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS h FROM d))),
l AS (
  SELECT row_number() OVER () AS r, doc_id, source, sha256(leaf) AS leaf, sha256(found) AS found, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(leaf)) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n FROM f),
tree AS (
  SELECT source, 0 AS level, pos, leaf AS hash, n FROM l
  UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, level, pos // 3),
subroots AS (SELECT source, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, hash, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(hash, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3),
sides AS (
  SELECT source, false AS upper, level, pos, n, coalesce(string_agg(hash, '' ORDER BY pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(hash, '' ORDER BY pos) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM tree WINDOW w AS (PARTITION BY source, level, pos // 3 ORDER BY pos)
  UNION ALL
  SELECT NULL, true, level, pos, n, coalesce(string_agg(hash, '' ORDER BY pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
    coalesce(string_agg(hash, '' ORDER BY pos) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') FROM top WINDOW w AS (PARTITION BY level, pos // 3 ORDER BY pos)),
climb AS (
  SELECT r, source, false AS upper, 0 AS level, pos, found AS folded, '' AS siblings FROM l
  UNION ALL
  SELECT c.r, c.source, s.n = 1 AND NOT s.upper OR s.upper, CASE WHEN s.n = 1 AND NOT s.upper THEN 0 ELSE c.level + 1 END,
    CASE WHEN s.n = 1 AND NOT s.upper THEN (SELECT u.pos FROM subroots u WHERE u.source IS NOT DISTINCT FROM c.source) ELSE c.pos // 3 END,
    CASE WHEN s.n = 1 THEN folded ELSE sha256(s.before || folded || s.after) END, siblings || s.before || s.after
  FROM climb c JOIN sides s ON s.upper = c.upper AND s.level = c.level AND s.pos = c.pos AND (s.upper OR s.source IS NOT DISTINCT FROM c.source)
  WHERE NOT (s.upper AND s.n = 1)),
root AS (SELECT hash, level FROM top WHERE n = 1)
SELECT l.doc_id, l.leaf, u.hash AS subroot, root.hash AS root, sha256(c.siblings) AS proof_sha256, c.folded AS folded_root, c.folded = root.hash AS verified
FROM l JOIN subroots u ON u.source IS NOT DISTINCT FROM l.source JOIN climb c USING (r) JOIN root ON c.upper AND c.level = root.level
"""


# --- 13: language model -------------------------------------------------------------------------

def op13_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_mixing": op2_mixing,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_quality_rules": op4_quality_rules,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_warc": op7_warc,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_toxicity": op10_toxicity,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_hidden_markov": op13_hidden_markov,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": OP1_SQL,
        "op2_mixing": OP2_SQL,
        "op4_quality_rules": _op4_sql(),
        "op5_exact_dedup": OP5_SQL,
        "op7_warc": OP7_SQL,
        "op9_chat_formatting": OP9_SQL,
        "op11_periodic_runs": OP11_SQL,
        "op12_merkle_manifest": OP12_SQL,
    }
