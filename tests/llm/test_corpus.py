"""The registered corpus queries and the pipeline on the driver tables."""

import random
from collections import Counter

import __spark_entry__
import duckdb
import pytest

import corpus_pipeline
from filmgrain.llm import leaks, pieces
from filmgrain.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.llm.test_leaks import stands
from tests.llm.test_near_copies import brute
from tools.compare import connect, differences


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql_where_there_is_some(spark, name):
    problem, rows = differences(spark, connect(SMALL), name, QUERIES[name], ORACLES.get(name), SMALL)
    assert problem is None and rows > 0


def test_all_thirteen_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_pipeline_stages_follow_their_operators(spark):
    """Each stage on its own input: toxic rows go, shared lines go, one copy stays, leaks go, texts come back."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SMALL).cache())
    assert all(d.columns == docs.columns for d in seen[:-1])
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen[:-1]]
    assert set(texts[0]) >= set(texts[1]) == set(texts[2]) >= set(texts[3]) >= set(texts[4])
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert not any(i in " ".join(t.lower().split()) for t in texts[4].values() for i in items)
    last = {r.doc_id: r for r in seen[-1].collect()}
    assert set(last) == set(texts[4]) and all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in last.values())
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select("doc_id", "n_pieces").collect())) == sorted((i, r.n_pieces) for i, r in last.items())


def without_common_lines(texts):
    def key(line):
        line = line.strip(" \t\n\v\f\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)

    seen = Counter(k for t in texts.values() for k in {key(x) for x in (t or "").split("\n")} if k)
    return {i: "\n".join(x for x in (t or "").split("\n") if seen[key(x)] < 10) for i, t in texts.items()}


def leaked(text, items):
    text = leaks.plain(text)
    return any(stands(x, text) if len(x) < 12 else leaks.distance_within(x, text) <= len(x) * 5 // 100 for x in map(leaks.plain, items))


def test_pipeline_equals_plain_python(spark, tmp_path):
    """The whole run against plain loops over what its first stage keeps: lines, all pairs, all items in all texts, pieces spelled out."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 1200").collect()]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").limit(6).collect()] + ["forty two"]
    rng = random.Random(2)
    top = max(r[0] for r in docs)
    extra = [f"common line {i % 2}\n" + " ".join(rng.choice("abcdefg") * 3 + str(rng.randrange(50)) for _ in range(60)) for i in range(24)]
    extra += [extra[0] + " end", f"begin {items[0]} and on", f"begin {items[1][:40]}x{items[1][41:]} and on", "it is Forty\nTwo here", "", " \n\t", "common line 0"]
    docs += [(top + 1 + i, t, "en", "s", len(t)) for i, t in enumerate(extra)] + [(top + 90, None, None, None, None)]
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, spark.createDataFrame(docs, schema), str(tmp_path)).collect()}
    texts = without_common_lines({r[0]: r[1] for r in docs if r[0] in clean})
    firsts = {key for key, n, component in brute(list(texts.items()), 80) if not n or key == component}
    want = {i: t for i, t in texts.items() if i in firsts and not leaked(t, items)}
    assert set(got) == set(want) and len(clean) - len(want) >= 5
    known, raw = pieces.load_pieces()
    spelled = {i: piece.replace(pieces.SPACE, " ").encode() for piece, (i, _) in known.items()} | {i: bytes([b]) for b, i in enumerate(raw)}
    assert {i: b"".join(spelled[p] for p in r.piece_ids).decode()[1:] for i, r in got.items()} == want
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in got.values())


def test_near_copies_from_four_fifths_go(spark):
    """Pairs of every similarity around 0.80 and 0.85: the stage keeps what plain Python keeps."""
    rng, rows = random.Random(9), []
    for k in range(24):
        words = [f"w{k}x{j}" for j in range(104)]
        # 100 shingles each, of which 100 - new are shared: similarity from 0.89 down to 0.74.
        new = 6 + k % 10
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[:104 - new] + [f"v{k}x{j}" for j in range(new)]))]
    rng.shuffle(rows)
    want = {key for key, _, component in brute(rows, 80) if key == component}
    assert want < {key for key, _, component in brute(rows, 85) if key == component}
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in corpus_pipeline.keep_first_copies(spark, docs, SMALL).collect()} == want


def test_pipeline_takes_awkward_and_no_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    duckdb.sql(f"COPY (SELECT * FROM '{SMALL}/benchmark.parquet') TO '{tmp_path}/benchmark.parquet' (FORMAT PARQUET)")
    duckdb.sql(f"COPY (SELECT 1::BIGINT AS doc_id, 0 AS quality, 0 AS toxic) TO '{tmp_path}/labels.parquet' (FORMAT PARQUET)")
    for rows in ([], [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y", None, None, 3), (3, "same words here", "en", "a", 1), (4, "same words here", "en", "a", 1)]):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert {r.doc_id for r in got} == {r[0] for r in rows} - {4}
