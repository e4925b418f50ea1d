"""The driver tables as operator inputs: a document stands for a critique run, its source for
the model that wrote it, a vector for a shot's features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filmgrain.llm import leaks, licences, lines, loops, near_copies, nearest, negatives, passages, pieces, shards, substrings, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _critiques(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select(
        F.col("doc_id").alias("critique_run_id"), "text", F.col("source").alias("model_name"))


def _by_document(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("critique_run_id", "doc_id")


@query
def op3_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return _by_document(near_copies.link_near_copies(_critiques(spark, folder)))


@query
def op6_deal_shards(spark: SparkSession, folder: str) -> DataFrame:
    return _by_document(shards.deal_shards(_critiques(spark, folder)))


ORACLES["op7_common_lines"] = """
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    k AS (SELECT *, list_transform(lines, lambda x: translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys FROM d),
    common AS (SELECT key FROM (SELECT unnest(list_distinct(keys)) AS key FROM k) WHERE key <> '' GROUP BY key HAVING count(*) >= 10),
    each AS (SELECT r, doc_id, unnest(lines) AS line, unnest(keys) AS key, unnest(range(len(lines))) AS pos FROM k),
    marked AS (SELECT e.*, c.key IS NOT NULL AS gone FROM each e LEFT JOIN common c USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY r, doc_id"""


@query
def op7_common_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _by_document(lines.drop_common_lines(_critiques(spark, folder))).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


# Host, path and verdict of the rules that the contract names.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
ORACLES["op9_judge_urls"] = """
    WITH p AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    q AS (SELECT page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
    rules(h, f, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
    SELECT page_id, host, path, arg_max(h || f, length(h || f)) AS rule, coalesce(arg_max(v, length(h || f)), 'allow') AS verdict
    FROM q LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f) GROUP BY r, page_id, host, path"""


@query
def op9_judge_urls(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(spark.read.parquet(f"{folder}/pages.parquet"), rules)


ORACLES["op4_nearest_shots"] = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""


@query
def op4_nearest_shots(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("shot_id"), F.col("embedding").alias("features"))
    found = nearest.nearest_shots(vectors, vectors.where("shot_id % 50 = 0"))
    return found.withColumnRenamed("shot_id", "vec_id")


@query
def op10_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return _by_document(leaks.find_leaks(_critiques(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet")))


@query
def op5_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = pieces.load_pieces()
    encoded = pieces.encode_texts(_critiques(spark, folder).select("critique_run_id", "text"), vocabulary)
    decoded = pieces.decode_texts(encoded, vocabulary)
    return _by_document(decoded).select("doc_id", "piece_ids", F.size("piece_ids").alias("n_pieces"), F.sha2("decoded", 256).alias("decoded_sha256"),
                                        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def held_out(column: str) -> Column:
    return F.crc32(F.col(column).cast("string")) % 5 == 0


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    critiques = _critiques(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select(F.col("doc_id").alias("critique_run_id"), "toxic")
    model = toxicity.train_toxicity(critiques, labels.where(~held_out("critique_run_id")))
    scored = _by_document(toxicity.score_toxicity(critiques, model))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "n_terms")


@query
def op8_licences(spark: SparkSession, folder: str) -> DataFrame:
    critiques = _critiques(spark, folder)
    return _by_document(licences.scan_licences(critiques, licences.train_licences(critiques)))


@query
def op2_repeated_substrings(spark: SparkSession, folder: str) -> DataFrame:
    cut = _by_document(substrings.remove_repeats(_critiques(spark, folder)))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _with_loops(key: Column, text: Column) -> Column:
    """The contract's planted loops: in one text of ten (by the checksum of its id) the words from a on repeat their first p."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h, n = F.crc32(key.cast("string")), F.size(words)
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    turns = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    looped = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), turns), F.lit(1), n), " ")
    return F.when((h % 10 == 0) & F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), looped).otherwise(text)


@query
def op11_critique_loops(spark: SparkSession, folder: str) -> DataFrame:
    critiques = _critiques(spark, folder)
    found = loops.find_loops(critiques.select("critique_run_id", _with_loops(F.col("critique_run_id"), F.col("text")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return _by_document(found).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                                      F.sha2("collapsed", 256).alias("collapsed_sha256"))


ORACLES["op12_hard_negatives"] = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_sum(list_transform(list_zip(a.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10"""


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    shots = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("shot_id"), label.alias("lighting_key"), F.col("embedding").alias("features"))
    return negatives.mine_hard_negatives(shots, shots.where("shot_id % 100 = 0").select("shot_id"))


ORACLES["op13_first_passages"] = """
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    e AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d)),
    m AS (SELECT s, min(doc_id) AS first_id FROM e GROUP BY s),
    g AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS pos FROM e JOIN m USING (s) WHERE first_id < doc_id),
    a AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
    k AS (SELECT a.r, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY a.pos) FILTER (g.pos IS NULL) AS kept FROM a LEFT JOIN g ON a.r = g.r AND a.pos = g.pos GROUP BY a.r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)"""


@query
def op13_first_passages(spark: SparkSession, folder: str) -> DataFrame:
    cut = _by_document(passages.keep_first_passages(_critiques(spark, folder)))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
