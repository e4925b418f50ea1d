"""Encoding against a plain Viterbi table and the reference library's own best segmentation."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from filmgrain.llm import pieces
from tests.llm.data import awkward

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_pieces()


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return pieces.Encoder(*vocabulary)


@pytest.fixture(scope="module")
def best_score_model():
    """The same pieces and scores under the library's best-score rule instead of merging."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def table_score(vocabulary, text):
    """The best total score, by a table over all splits of the whole text."""
    known, _ = vocabulary
    text = pieces.SPACE + text.replace(" ", pieces.SPACE)
    unknown = min(s for _, s in known.values()) - pieces.UNKNOWN_PENALTY
    best = [0.0] + [None] * len(text)
    for end in range(1, len(text) + 1):
        options = [best[a] + known[text[a:end]][1] for a in range(max(0, end - 20), end) if text[a:end] in known]
        if text[end - 1] not in known:
            options.append(best[end - 1] + unknown)
        best[end] = max(options)
    return best[-1]


def own_score(vocabulary, ids):
    known, raw = vocabulary
    scores = {i: s for i, s in known.values()}
    unknown = min(scores.values()) - pieces.UNKNOWN_PENALTY
    total, data = 0.0, b""
    for i in [*ids, None]:
        if i in raw:
            data += bytes([raw.index(i)])
        else:
            total, data = total + unknown * len(data.decode()), b""
            total += scores.get(i, 0.0)
    return total


TEXTS = st.text(st.one_of(st.sampled_from("aehinorstdgl   \n.,é"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXTS.filter(lambda t: t and pieces.SPACE not in t))
def test_score_is_the_best_there_is(vocabulary, encoder, text):
    assert own_score(vocabulary, encoder.encode(text)) == pytest.approx(table_score(vocabulary, text))


@settings(max_examples=100, deadline=None)
@given(st.text("aehinorstdgl  é,.\n", min_size=1, max_size=40))
def test_score_equals_the_librarys(vocabulary, encoder, best_score_model, text):
    assert own_score(vocabulary, encoder.encode(text)) == pytest.approx(own_score(vocabulary, best_score_model.encode(text)), rel=1e-5)


def test_round_trip_of_awkward_texts(spark, vocabulary):
    rows = awkward(random.Random(8)) + [(70, "▁ blank ▁▁mark"), (71, "  two  blanks "), (72, "\n\n\t"), (73, "日本語のテキスト😀\x00"), (74, "x" * 5000), (75, " ")]
    df = spark.createDataFrame([(i, t, "old") for i, t in rows], "critique_run_id bigint, text string, decoded string")
    encoded = pieces.encode_texts(df, vocabulary)
    got = pieces.decode_texts(encoded, vocabulary).collect()
    assert encoded.columns == ["critique_run_id", "text", "decoded", "piece_ids"]
    assert len(got) == len(rows) and all(r.decoded == (r.text or "") for r in got)
    assert all(r.piece_ids == [] for r in got if not r.text)
    assert pieces.encode_texts(df.limit(0), vocabulary).collect() == []


def test_null_lists_decode_to_empty_texts(spark, vocabulary):
    df = spark.createDataFrame([(1, None), (2, [])], "critique_run_id bigint, piece_ids array<int>")
    assert [r.decoded for r in pieces.decode_texts(df, vocabulary).collect()] == ["", ""]
