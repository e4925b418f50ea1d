"""Lexicon automata against plain edit distance; held-out accuracy."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from filmgrain.llm import toxicity
from filmgrain.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm.data import prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


TERMS = [toxicity.Term(t, s, w) for t, s, w in (("abc", True, 3.0), ("abcabc", True, 2.0), ("cabbac", False, 4.0), ("baccabcabb", False, 5.0), ("ccc", False, 1.0))]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", min_size=1, max_size=14))
def test_automaton_equals_edit_distance(word):
    best = 0.0
    for t in TERMS:
        if t.text[0] != word[0]:
            continue
        # The first letters meet; the rest is compared, for stems against every beginning of the word.
        row = distance(t.text[1:], word[1:])
        edits = min(row) if t.stem else row[-1]
        if edits <= t.edits:
            best = max(best, t.weight / (1 + edits))
    assert toxicity.Lexicon(TERMS).value(word)[0] == best


def swaps(a, b):
    """Edit distance where two neighbours swapped are one edit."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(rows[-1][j] + 1, new[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                new[j] = min(new[j], rows[-2][j - 2] + 1)
        rows.append(new)
    return rows[-1]


SHORT = [*TERMS, toxicity.Term("cabb", False, 2.5), toxicity.Term("bacab", False, 3.5), toxicity.Term("acbb", True, 1.5)]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", min_size=1, max_size=14))
def test_slips_equal_edit_distance_with_swaps(word):
    found = [0.0]
    for t in SHORT:
        row = swaps(t.text, word)
        edits = min(row) if t.stem else row[-1]
        found += [t.weight / (1 + edits)] if edits <= t.edits else []
    assert toxicity.Lexicon(SHORT, slips=True).value(word)[0] == max(found)


def test_short_terms_first_letters_and_signs(spark):
    """Misspelt short insults score as toxic, clean words near them don't."""
    rng, rows, labels = random.Random(12), [], []
    insults, clean = ["idiot", "moron", "loser", "clown", "trash", "stupid"], ["crown", "closer", "boron", "crash", "lose", "ride"]
    for i in range(400):
        words = prose(rng, 30).split()
        for w in [*rng.sample(clean, 2), *(rng.sample(insults, 2) if i % 4 == 0 else [])]:
            words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    schema = "critique_run_id bigint, text string"
    model = toxicity.train_toxicity(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "critique_run_id bigint, toxic int"))
    bad = ["idoit", "mroon", "lsoer", "clwon", "ztupid", "tr@sh", "lo$er", "idi0t", "oron", "diot"]
    asked = [(i, f"{prose(rng, 15)} {a} {b} {prose(rng, 15)}") for i, (a, b) in enumerate(zip(bad, bad[1:] + bad[:1]))]
    asked += [(100 + i, f"{prose(rng, 15)} {w} crown {prose(rng, 15)}") for i, w in enumerate(clean)]
    got = {r.critique_run_id: r for r in toxicity.score_toxicity(spark.createDataFrame(asked, schema), model).collect()}
    assert all(got[i].n_terms == 2 and got[i].predicted for i in range(len(bad)))
    assert all(not got[100 + i].n_terms and not got[100 + i].predicted for i in range(len(clean)))


def test_forgotten_states_are_made_again(monkeypatch):
    words = ["abcab", "abccc", "cabbac", "baccabcabb", "ccc", "cc"]
    lexicon = toxicity.Lexicon(TERMS)
    want = [lexicon.value(w) for w in words]
    monkeypatch.setattr(toxicity, "MAX_STATES", 2)
    assert [lexicon.value(w) for w in words * 3] == want * 3


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        words = prose(rng, 40).split()
        if bad:
            for w in rng.sample(["scoundrelly", "villainous", "wretched"], 2):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(1000 + i, rows[3][1]) for i in range(60)]
    labels += [(1000 + i, None) for i in range(60)] + [(None, 1), (7777, 0)]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "critique_run_id bigint, text string, score double")
    known = spark.createDataFrame([x for x in labels if x[0] is None or x[0] % 3], "critique_run_id bigint, toxic int")
    return df, toxicity.train_toxicity(df, known), dict(labels)


def test_unseen_rows_are_told_apart(trained):
    df, model, labels = trained
    got = {r.critique_run_id: r for r in toxicity.score_toxicity(df, model).collect()}
    unseen = [i for i in range(300) if i % 3 == 0]
    assert all(got[i].predicted == labels[i] and (got[i].score >= 0.5) == bool(labels[i]) for i in unseen)


def test_misspelled_terms_count_and_awkward_texts_score_low(spark, trained):
    _, model, _ = trained
    rows = [(1, "you scoundre1ly vilainous wretch3d thing"), (2, None), (3, ""), (4, " "), (None, "cut frame"), (None, "cut frame"), (5, prose(random.Random(1), 20_000))]
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "critique_run_id bigint, text string"), model, ("text",)).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["critique_run_id", "text", "score", "predicted", "n_terms"]
    by = {r.critique_run_id: r for r in got}
    assert by[1].n_terms == 3 and by[1].score > by[2].score == by[3].score == by[4].score
    assert all(r.predicted == 0 for i, r in by.items() if i != 1)


def test_quoted_terms_are_weighed_apart():
    values = toxicity._Values(toxicity.Lexicon([toxicity.Term("villain", True, 4.0)]))
    plain, quoted = toxicity.features("a villain here", values), toxicity.features('they said "a villain" here', values)
    assert plain[0] > 0 and plain[5] == 0 and quoted[0] == 0 and quoted[5] > 0


def test_near_copies_count_once(spark):
    """Copies with a word or two changed are one training text a label, so their own words are no evidence."""
    rng = random.Random(3)
    words = prose(rng, 400).split()
    rows = [(i, " ".join(words[:380] + [f"odd{i}"])) for i in range(20)] + [(100 + i, prose(rng, 30)) for i in range(5)]
    df = spark.createDataFrame(rows, "critique_run_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in rows], "critique_run_id bigint, toxic int")
    assert toxicity._sampled(df, labels, 1_000).count() <= 8


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1)], [(1, None)]])
def test_one_sided_labels_give_one_score(spark, labels):
    df = spark.createDataFrame([(1, "a b c"), (2, "d")], "critique_run_id bigint, text string")
    model = toxicity.train_toxicity(df, spark.createDataFrame(labels, "critique_run_id bigint, toxic int"))
    assert len({r.score for r in toxicity.score_toxicity(df, model).collect()}) == 1
    assert toxicity.score_toxicity(df.limit(0), model).collect() == []


def test_driver_labels_held_out(spark):
    folder = SMALL.replace("0.001", "0.1")
    rows = QUERIES["op1_toxicity"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    good, bad = [r.score for r in rows if not r.toxic], [r.score for r in rows if r.toxic]
    above = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert above > 0.95 and sum(g >= 0.5 for g in good) < 0.01 * len(good)
    assert sum(b >= 0.5 for b in bad) >= 0.9 * len(bad)
