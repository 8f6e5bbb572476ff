"""Registered queries of this subpackage: one per operator, over its whole table, and the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulemill.llm import conversations, decontamination, grammar, katz, language, packing, pii, quality_model, quality_rules, resampling, sharding, simhash, substring_dedup
from rulemill.llm.common import table
from rulemill.llm.tokens import tokenizer_path
from rulemill.sources.storage import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return add


@register()
def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal row counts, uniformly permuted. The crc of a NULL text is that of no bytes."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.shard_rows(rows, shards=8, seed=20)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register(
    r"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents
    ), windows AS (
      SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)
    ), repeated AS (
      SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
    ), covered AS (
      SELECT doc_id, count(DISTINCT i + j) AS n FROM repeated, range(0, 5) AS r(j) GROUP BY doc_id
    ), m AS (
      SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id
    ), f AS (
      SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (word_chars < 2 * n_words)::BIGINT
        + 8 * (word_chars > 20 * n_words)::BIGINT + 16 * (10 * n_symbols > n_words)::BIGINT + 32 * (100 * n_dup_lines > 30 * n_lines)::BIGINT AS failures
      FROM m
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept FROM f
    """
)
def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.with_verdict(quality_rules.ledger(table(spark, sf_dir, "documents")), "2")
    base = quality_rules.with_verdict(rows, "base", "base_kept")
    return base.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failures", (~F.col("base_kept")).alias("base_failed"), "kept")


@register()
def op9_repair_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    grammar.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    docs = grammar.read_documents(spark.read.schema(grammar.SHARDS).parquet(path))
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register()
def op10_grouping_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=0, capacity=2048)
    return packing.pack(parts, capacity=2048, seed=10)


def fold(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


@register()
def op5_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.filter((fold(4) != 2) & F.col("lang").isNotNull()))
    return language.identify(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


@register()
def op8_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    network = quality_model.train(docs, labels.filter(fold(5) != 0).select("doc_id", F.col("quality").alias("label")))
    scored = quality_model.score(docs, network)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register()
def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = simhash.fingerprints(table(spark, sf_dir, "documents"), shingle=4)
    out = simhash.group(prints, lanes=1, link=simhash.within_radius(4))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


@register()
def op3_string_tiling_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("item_id").cast("long").alias("item_id"), "coverage", F.size("tiles").alias("n_tiles"))


@register()
def op4_surrogate_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.anonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="surrogates of the corpus")


@register()
def op7_debruijn_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register(
    r"""
    WITH RECURSIVE crc_bits AS (
      SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
      UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8
    ), crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_bits WHERE k = 8),
    words AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
    ), wanted AS (
      SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
    ), kinds AS (
      SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM words UNION SELECT w FROM wanted)
    ), hashed AS (
      SELECT w, xor(4294967295, list_reduce(
        list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295
      )) % 10000 AS bucket FROM kinds, crc_table
    ), s AS (SELECT bucket, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS n FROM wanted JOIN hashed USING (w) GROUP BY bucket),
    gains AS (
      SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM words) + 10000)::DOUBLE
        / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM range(10000) b(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
    ), weighed AS (
      SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(w, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h
      FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(gain) AS w FROM words JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY doc_id) f ON f.doc_id = d.doc_id
    ), scored AS (
      SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed
    ), placed AS (
      SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place FROM scored
    )
    SELECT doc_id, n AS n_words, n AS n_features, weight, score,
      CASE WHEN n >= 20 AND place <= (SELECT floor(10 * count(*) / 100) FROM scored WHERE n >= 20) THEN place END AS rank FROM placed
    """
)
def op11_prefix_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=(10, 100), least_words=20, seed=2024)


@register()
def op12_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold(5) == 1, F.lit(False))
    scored = katz.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register(
    r"""
    WITH RECURSIVE crc_bits AS (
      SELECT i AS b, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
      UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8
    ), crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc_bits WHERE k = 8),
    given AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k FROM conversations
    ), drawn AS (
      SELECT g.*, xor(4294967295, list_reduce(
        list_transform(range(1, octet_length(k) + 1), lambda i: ascii(decode(k[i:i]))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295
      )) % 20 AS draw FROM given g, crc_table
    ), damaged AS (
      SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, n,
        CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM drawn, range(2) c(n) WHERE draw <> 0 AND (n = 0 OR draw = 3)
    ), placed AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, n) AS seen FROM damaged
    ), marked AS (
      SELECT conv_id, turn, role, text, i, left(role, 1) AS letter, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
        CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2
          WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault
      FROM placed
    ), counted AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
        count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
      FROM marked GROUP BY conv_id
    ), steps AS (
      -- an insertion (5) is never on a cheapest path: without it, its neighbour deleted (2) and a system turn too (2), the rest stays right
      SELECT * FROM (VALUES (0, 0, 'D', ''), (1, 1, 'D', ''), (2, 2, 'D', ''), (3, 3, 'D', ''), (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'),
        (3, 2, 'K', 'u'), (2, 3, 'K', 'a'), (0, 2, 'R', 'user'), (1, 2, 'R', 'user'), (3, 2, 'R', 'user'), (2, 3, 'R', 'assistant')) s(a, b, edit, letter)
    ), paths AS (
      SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, NULL::VARCHAR AS kept FROM counted
      UNION ALL
      SELECT conv_id, i, state, cost, audit, kept FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS best FROM (
          SELECT p.conv_id, m.i, s.b AS state, p.audit || s.edit AS audit,
            p.cost + CASE s.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN m.fault = 3 AND s.edit <> 'D' THEN 5 ELSE 0 END AS cost,
            CASE s.edit WHEN 'D' THEN p.kept ELSE coalesce(p.kept || chr(10), '') || CASE s.edit WHEN 'K' THEN m.role ELSE s.letter END || ':' || m.text END AS kept
          FROM paths p JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i + 1
            JOIN steps s ON s.a = p.state AND (s.edit = 'D' OR m.fault IN (0, 3)) AND (s.edit <> 'K' OR s.letter = m.letter)
        )
      ) WHERE best = 1
    ), ends AS (
      SELECT p.*, row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost, p.audit) AS best FROM paths p
        JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = c.n WHERE p.state IN (0, 3)
    )
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
      coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
      coalesce(audit, '') AS audit, sha256(coalesce(kept, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
      LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id AND e.best = 1
    """
)
def op13_integer_weight_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.repaired_reports(rows, conversations.damaged(rows))
