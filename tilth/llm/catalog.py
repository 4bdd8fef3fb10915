"""Queries of the operators in this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tilth.llm import chat, collocations, metric, minhash, mixing, pages, periodic, pieces, quality, repeats, shards, tokens, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIX_SQL = r"""
WITH RECURSIVE sized AS (
 SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (
 SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight
 FROM sources),
rounds AS (
 SELECT 0 AS round, source, source_size, weight, CAST(0 AS DOUBLE) AS target, false AS full_up FROM placed
 UNION ALL
 SELECT round + 1, source, source_size, weight,
  CASE WHEN full_up THEN target ELSE least(3.0 * source_size, share) END,
  full_up OR share >= 3.0 * source_size
 FROM (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(target) FILTER (WHERE full_up) OVER (), 0) AS DOUBLE)
    / sum(weight) FILTER (WHERE NOT full_up) OVER () * weight AS share
  FROM rounds)
 WHERE round < 30 AND share IS NOT NULL),
targets AS (
 SELECT source, source_size, target FROM rounds WHERE round = (SELECT max(round) FROM rounds)),
lines AS (
 SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS line FROM sized),
crossed AS (
 SELECT l.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS share,
  CAST(CAST('0x' || substr(md5('0/' || coalesce('=' || l.source, '')), 1, 6) AS BIGINT) AS DOUBLE) / 16777216.0 AS first_start
 FROM lines l JOIN targets t ON l.source IS NOT DISTINCT FROM t.source),
tried AS (
 SELECT source, j, (first_start + CAST(j AS DOUBLE) / 64.0::DOUBLE) % 1.0::DOUBLE AS start,
  abs(sum(CAST(least(3, floor((line + 1) * share + (first_start + CAST(j AS DOUBLE) / 64.0::DOUBLE) % 1.0::DOUBLE)
   - floor(line * share + (first_start + CAST(j AS DOUBLE) / 64.0::DOUBLE) % 1.0::DOUBLE)) AS BIGINT) * size) - any_value(target)) AS away
 FROM crossed, (SELECT unnest(range(64)) AS j) GROUP BY source, j, first_start),
chosen AS (SELECT source, start FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY away, j) = 1)
SELECT c.doc_id, c.size, c.source_size, c.target,
 CAST(least(3, floor((line + 1) * share + start) - floor(line * share + start)) AS BIGINT) * size AS taken
FROM crossed c JOIN chosen h ON c.source IS NOT DISTINCT FROM h.source
"""


TOP_SQL = r"""
WITH good AS (
 SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
 SELECT q.vec_id AS query_id, c.vec_id,
  CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
 FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

NEAR_VECTORS_SQL = r"""
WITH RECURSIVE good AS (
 SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
 SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
 WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN parts USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

NEAR_TEXTS_SQL = r"""
WITH RECURSIVE words AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
 SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]]
  ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_have AS (
 SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
 GROUP BY x.doc_id, y.doc_id),
links AS (
 SELECT a, b FROM both_have JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id
 WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN parts USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

REPEATS_SQL = r"""
WITH docs AS (
 SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes
 FROM documents),
heads AS (
 SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS head
 FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 99)) AS i FROM docs WHERE n_bytes >= 100)),
late AS (
 SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY head ORDER BY doc_id, i) AS line FROM heads) WHERE line > 1),
fresh AS (SELECT *, CASE WHEN lag(i) OVER w >= i - 100 THEN 0 ELSE 1 END AS new FROM late WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (
 SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi
 FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM fresh) GROUP BY doc_id, run),
pieces AS (
 SELECT r.doc_id, lo, substr(h, 2 * coalesce(lag(hi) OVER w, 0) + 1, 2 * (lo - coalesce(lag(hi) OVER w, 0))) AS piece
 FROM runs r JOIN docs d USING (doc_id) WINDOW w AS (PARTITION BY r.doc_id ORDER BY lo)),
gone AS (
 SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, CAST(count(*) AS BIGINT) AS n_spans, max(hi) AS last FROM runs GROUP BY doc_id),
heads_kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY lo) AS body FROM pieces GROUP BY doc_id)
SELECT d.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(coalesce(body, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM docs d LEFT JOIN gone USING (doc_id) LEFT JOIN heads_kept USING (doc_id)
"""

PHRASES_SQL = r"""
WITH pieces AS (
 SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
 FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
f AS (
 SELECT lang, CAST(k AS BIGINT) AS k, phrase, CAST(count(*) AS BIGINT) AS f FROM (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
 GROUP BY lang, k, phrase HAVING count(*) >= 30),
cuts AS (
 SELECT lang, k, phrase, f AS a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS head,
  array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS rest
 FROM f, (SELECT unnest([1, 2, 3]) AS c) WHERE c < k),
scored AS (
 SELECT x.lang, x.k, x.phrase, x.a, c, p.f AS l, q.f AS r,
  CAST((2000000::HUGEINT * x.a) // (p.f::HUGEINT + q.f) AS BIGINT) AS score
 FROM cuts x JOIN f p ON p.lang = x.lang AND p.phrase = x.head JOIN f q ON q.lang = x.lang AND q.phrase = x.rest
 QUALIFY row_number() OVER (PARTITION BY x.lang, x.phrase ORDER BY score, c) = 1),
held AS (
 SELECT lang, phrase, max(f) AS most FROM (
  SELECT lang, f, unnest(list_transform(range(1, k - j + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i + j - 1], ' '))) AS phrase
  FROM f, (SELECT unnest([2, 3]) AS j) WHERE j < k)
 GROUP BY lang, phrase),
ranked AS (
 SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(s.phrase)) AS rank
 FROM scored s LEFT JOIN held h USING (lang, phrase) WHERE coalesce(100::HUGEINT * most < 80::HUGEINT * a, true))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


@query("op1_token_sequences")
def token_sequences(spark: SparkSession, sf_dir: str, vocabulary: str = BYTE_BPE) -> DataFrame:
    manifest = tokens.write_sequences(table(spark, sf_dir, "documents"), vocabulary)
    found = tokens.read_documents(spark, manifest)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32", "part")


@query("op2_mix_sources", MIX_SQL)
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return planned.select("row.doc_id", "size", "source_size", "target", "taken")


@query("op3_top_vectors", TOP_SQL)
def top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5, 256.0)


@query("op4_main_text")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"])


@query("op5_pieces")
def piece_ids(spark: SparkSession, sf_dir: str, model: str = PIECE_BPE) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), model, carry=["doc_id"], digest=True, remembered=600_000)


@query("op6_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, carry=["doc_id"])
    return scored.select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


@query("op7_near_duplicates", NEAR_TEXTS_SQL)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


@query("op8_repeats", REPEATS_SQL)
def repeats_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"), 100, digest=True)
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op9_near_vectors", NEAR_VECTORS_SQL)
def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metric.near_vectors(table(spark, sf_dir, "embeddings"), 0.98)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


@query("op10_shard")
def shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = shards.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    return done.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by the checksum of its id goes on, from a word that
    the checksum picks, in a loop of words; the others as they are."""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    sums = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    found = sums.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w").cast("long"))
    placed = found.withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, F.expr("g % n")))
    placed = placed.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    loop = F.expr("transform(sequence(0L, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)])")
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(loop, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(looped(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("best", longest).withColumn("longest", -F.col("best.length"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("longest").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * longest div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_chat_windows")
def chat_windows(spark: SparkSession, sf_dir: str, vocabulary: str = BYTE_BPE) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    marked = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], turns.schema)
    return chat.read_back(chat.format_chats(turns.unionByName(marked), vocabulary))


@query("op13_collocations", PHRASES_SQL)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
