"""Documents to piece ids: toxic texts out, common lines out, one of each group of near copies,
no benchmark passages, then encoded. Each stage's result is stored before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from filmgrain.llm import leaks, lines, near_copies, pieces, toxicity
from filmgrain.llm.queries import held_out
from filmgrain.llm.shared import stored

# Learned labels, line counts and links of groups have no SQL twin; tests hold run() against plain Python.
ORACLE_SQL = None
# Near copies of the corpus begin at similarity 0.80. A pair there agrees in 51.2 of 64
# coordinates on average (deviation 3.2); under 33 agree for about one such pair in twelve million.
PERCENT, MATCHES = 80, 33


def _as_critiques(docs: DataFrame) -> DataFrame:
    return docs.withColumnRenamed("doc_id", "critique_run_id")


def _as_documents(critiques: DataFrame) -> DataFrame:
    text = F.length("text").cast("bigint")
    return critiques.select(F.col("critique_run_id").alias("doc_id"), "text", "lang", "source", text.alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; labels are learned from outside the held-out fifth."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("critique_run_id"), "toxic")
    critiques = _as_critiques(docs)
    model = toxicity.train_toxicity(critiques, labels.where(~held_out("critique_run_id")))
    return _as_documents(toxicity.score_toxicity(critiques, model, ("text", "lang", "source")).where("predicted = 0"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten or more documents share."""
    return _as_documents(lines.drop_common_lines(_as_critiques(docs)))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.80."""
    return _as_documents(near_copies.keep_first_copies(_as_critiques(docs), PERCENT, MATCHES))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = leaks.find_leaks(_as_critiques(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=("text", "lang", "source"))
    return _as_documents(found.where("not leaked"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece_ids, n_pieces and whether decoding gave the text back.

    Pieces are stored before they are decoded: in one stage each task would hold two Python workers, one with the
    automaton, and an executor keeps all it has ever needed at once.
    """
    vocabulary = pieces.load_pieces()
    encoded = stored(pieces.encode_texts(docs.select("doc_id", "text"), vocabulary))
    decoded = pieces.decode_texts(encoded, vocabulary)
    return decoded.select("doc_id", "piece_ids", F.size("piece_ids").alias("n_pieces"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("near copies", keep_first_copies),
    ("benchmark decontamination", drop_leaks),
    ("sentence pieces", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
