"""One query per operator, over its whole table; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peaklight.llm import bpe, collocations, dedup, jaccard, langid, negatives, packing, pii, quality, tokencount, tokenfile, toolcalls, winnowing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_neighbours(table(spark, sf_dir, "documents"))


def op2_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a call; one without a result has result_turn and result_chars -1, one without JSON an empty canonical form."""
    calls, results = toolcalls.turns_as_calls(table(spark, sf_dir, "conversations"))
    out = toolcalls.link_tool_calls(calls, results, toolcalls.TOOLS)
    none = F.lit(-1).cast("long")
    return out.select("conv_id", "turn", "call_id", "name", F.coalesce("result_turn", none).alias("result_turn"), "n_results", F.col("level").cast("long").alias("level"), F.concat_ws("; ", "errors").alias("errors"), F.coalesce(F.length("content").cast("long"), none).alias("result_chars"), F.coalesce("canonical", F.lit("")).alias("canonical"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op5_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder, files = tokenfile.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.read_token_files(folder, files)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine_negatives(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_winnowing, op2_tool_call_linking, op3_language_id, op4_personal_data, op5_length_buckets, op6_jaccard_join, op7_exact_dedup, op8_byte_bpe, op9_quality, op10_token_files, op11_collocations, op12_token_counts, op13_hard_negatives, pipeline)
}

ORACLE_SQL = {
    "op2_tool_call_linking": r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(text, '') AS t, (length(coalesce(text, '')) + turn) % 12 AS p FROM conversations WHERE role = 'user'
), calls AS (
  SELECT *, 'c' || turn AS call_id, CASE WHEN p % 3 = 1 THEN 'search' WHEN p = 11 THEN 'browse' ELSE 'reply' END AS name,
    CASE WHEN p % 4 = 2 THEN turn + 2 WHEN turn >= 2 THEN turn - 2 END AS needs, count(*) OVER (PARTITION BY conv_id) AS size FROM c
), refs AS (
  SELECT a.conv_id, a.turn, a.needs, b.turn IS NULL AS nowhere FROM calls a LEFT JOIN calls b ON a.conv_id = b.conv_id AND a.needs = b.turn WHERE a.needs IS NOT NULL
), walk AS (
  SELECT conv_id, turn, turn AS at, 0 AS steps, size FROM calls
  UNION ALL
  SELECT w.conv_id, w.turn, r.needs, w.steps + 1, w.size FROM walk w JOIN refs r ON r.conv_id = w.conv_id AND r.turn = w.at AND NOT r.nowhere WHERE w.steps < w.size
), levels AS (
  SELECT conv_id, turn, CASE WHEN max(steps) = max(size) THEN -1 ELSE max(steps) END AS level FROM walk GROUP BY 1, 2
), results AS (
  SELECT conv_id, turn - 1 AS turn, min(turn)::BIGINT AS result_turn, count(*) AS n, arg_min(length(text), turn) AS chars
  FROM conversations WHERE role IN ('assistant', 'tool') GROUP BY 1, 2
), parts AS (
  SELECT *, CASE WHEN needs IS NULL THEN '' ELSE '"after":"$ref:c' || needs || '"' END AS a FROM calls
)
SELECT c.conv_id, c.turn, c.call_id, c.name, coalesce(r.result_turn, -1) AS result_turn, coalesce(r.n, 0)::BIGINT AS n_results, l.level::BIGINT AS level,
  concat_ws('; ',
    CASE WHEN p = 8 THEN '$: not JSON' WHEN p = 11 THEN '$: unknown tool' WHEN p = 3 THEN '$.text: missing' WHEN p = 5 THEN '$.tone: not in enum'
      WHEN p = 7 THEN '$.limit: above maximum' WHEN p = 10 THEN '$.limit: above maximum; $.page: not allowed' END,
    CASE WHEN f.nowhere THEN '$: refers to no call c' || c.needs END) AS errors,
  coalesce(r.chars, -1)::BIGINT AS result_chars,
  CASE WHEN p = 8 THEN '' ELSE '{"arguments":{' || concat_ws(',', nullif(a, ''), CASE WHEN p % 3 = 1 THEN '"limit":' || 10 * p || CASE WHEN p = 10 THEN ',"page":1' ELSE '' END || ',"query":' || to_json(t)::VARCHAR
      ELSE concat_ws(',', CASE WHEN p <> 3 THEN '"text":' || to_json(t)::VARCHAR END, CASE WHEN p = 5 THEN '"tone":"loud"' END, '"turn":' || c.turn) END)
    || '},"id":"' || c.call_id || '","name":"' || c.name || '"}' END AS canonical
FROM parts c JOIN levels l ON l.conv_id = c.conv_id AND l.turn = c.turn
LEFT JOIN results r ON r.conv_id = c.conv_id AND r.turn = c.turn LEFT JOIN refs f ON f.conv_id = c.conv_id AND f.turn = c.turn
""",
    "op6_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM d
), u AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p WHERE 100 * common >= 90 * (na + nb - common) UNION ALL SELECT b, a FROM p WHERE 100 * common >= 90 * (na + nb - common)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON e.a = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id FROM s JOIN least USING (doc_id)
""",
    "op7_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)
""",
    "op11_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) v(m)
), f AS (
  SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30
), cuts AS (
  SELECT lang, m, phrase, a, k, array_to_string(w[:k], ' ') AS lp, array_to_string(w[k + 1 :], ' ') AS rp FROM c, (VALUES (1), (2), (3)) v(k) WHERE k < m
), scored AS (
  SELECT cuts.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.phrase = lp AND x.m = k JOIN f y ON y.lang = cuts.lang AND y.phrase = rp AND y.m = cuts.m - k
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, m, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, a AS fa, unnest(list_transform(range(1, m - s + 2), lambda i: array_to_string(w[i : i + s - 1], ' '))) AS phrase, s FROM c, (VALUES (2), (3)) v(s) WHERE s < m
), dropped AS (
  SELECT DISTINCT b.lang, b.m, b.phrase FROM best b JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase AND i.s = b.m AND 100::HUGEINT * i.fa >= 80::HUGEINT * b.a
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score FROM best ANTI JOIN dropped USING (lang, m, phrase)
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""",
    "op13_hard_negatives": r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10
""",
}
