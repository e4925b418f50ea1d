"""Extra columns with the names that the operators use themselves."""

import random

import pytest
from pyspark.sql import functions as F

from filmgrain.llm import leaks, lines, near_copies, pieces, toxicity
from tests.llm.data import awkward

NAMES = ["_id", "_ID", "__id", "_common", "_rows", "_found", "leaked", "score", "predicted", "key", "digest", "n_lines", "item_ids", "piece_ids", "Decoded"]


@pytest.fixture(scope="module")
def critiques(spark):
    rows = [(i, t and t[:400]) for i, t in awkward(random.Random(5))[:-1]]
    rows += [(100 + i, f"shared line\nown line {i} {i}") for i in range(12)]
    return spark.createDataFrame(rows, "critique_run_id bigint, text string").withColumns({f"kept_{n.lower()}_{k}": F.col("critique_run_id") for k, n in enumerate(NAMES)})


def named(critiques, name):
    return critiques.select("critique_run_id", "text", F.coalesce("critique_run_id", F.lit(-1)).alias(name))


def rows(df, *names):
    return sorted(map(repr, (tuple(r) for r in df.select("critique_run_id", *names).collect())))


@pytest.mark.parametrize("name", ["_id", "_ID", "_common", "__common", "key"])
def test_lines_pass_columns_of_any_name(critiques, name):
    out, plain = lines.drop_common_lines(named(critiques, name)), lines.drop_common_lines(critiques.select("critique_run_id", "text"))
    assert rows(out, "text", "n_lines", "n_dropped") == rows(plain, "text", "n_lines", "n_dropped")
    assert out.where(F.col(name) != F.coalesce("critique_run_id", F.lit(-1))).count() == 0
    assert out.agg(F.sum("n_dropped")).first()[0] == 12


def test_lines_replace_their_own_results(critiques):
    assert lines.drop_common_lines(named(critiques, "N_Dropped")).columns == ["critique_run_id", "text", "n_lines", "n_dropped"]


@pytest.mark.parametrize("name", ["_id", "_ID", "_rows", "digest"])
def test_first_copies_pass_columns_of_any_name(critiques, name):
    out, plain = near_copies.keep_first_copies(named(critiques, name)), near_copies.keep_first_copies(critiques.select("critique_run_id", "text"))
    assert out.columns[2] == name and rows(out, "text") == rows(plain, "text")


def test_leaks_carry_columns_of_any_name(spark, critiques):
    items = spark.createDataFrame([(1, "own line 3 3")], "item_id bigint, text string")
    for name in ("_found", "_FOUND", "found"):
        out = leaks.find_leaks(named(critiques, name), items, carry=(name, name, "text"))
        assert out.columns == ["critique_run_id", name, "text", "item_ids", "least_distance", "leaked"] and out.where("leaked").count() == 1
    for name in ("leaked", "Item_Ids", "critique_run_id"):
        out = leaks.find_leaks(critiques.withColumn(name, F.lit(3)), items, carry=(name,))
        assert out.columns == ["critique_run_id", "item_ids", "least_distance", "leaked"]
    assert leaks.find_leaks(named(critiques, "_found"), items, carry=("_found",)).where("_found <> coalesce(critique_run_id, -1)").count() == 0


def test_scores_carry_columns_of_any_name(critiques):
    model = toxicity.ToxicityModel((toxicity.Term("trash", False, 1.0),), (0.0,) * 8, -1.0, frozenset())
    for name in ("score", "predicted", "n_terms", "Score"):
        out = toxicity.score_toxicity(named(critiques, name), model, carry=(name, "text"))
        assert out.columns == ["critique_run_id", "text", "score", "predicted", "n_terms"] and out.where("predicted = 1").count() == 0
    assert toxicity.score_toxicity(named(critiques, "key"), model, carry=("key",)).where("key <> coalesce(critique_run_id, -1)").count() == 0


def test_pieces_replace_their_own_results(critiques):
    vocabulary = pieces.load_pieces()
    out = pieces.decode_texts(pieces.encode_texts(named(critiques, "piece_ids"), vocabulary), vocabulary)
    assert out.columns == ["critique_run_id", "text", "piece_ids", "decoded"]
    assert out.where("decoded <> coalesce(text, '')").count() == 0
