"""Licence notices: planted ones found, look-alikes left unknown."""

import random
import textwrap

import pytest

from filmgrain.llm import licences
from filmgrain.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm.data import awkward, prose


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(prose(rng, rng.randrange(3, 30)) for _ in range(5))) for i in range(200)]
    return licences.train_licences(spark.createDataFrame(rows, "critique_run_id bigint, text string"))


def test_every_template_is_found_and_prose_is_not(spark, model):
    rng = random.Random(3)
    rows = [(i, prose(rng, 20) + "\n" + t + "\n" + prose(rng, 9)) for i, (_, t) in enumerate(licences.TEMPLATES)]
    rows += [(100 + i, "\n".join(prose(rng, 12) for _ in range(4))) for i in range(100)]
    got = {r.critique_run_id: r for r in licences.scan_licences(spark.createDataFrame([(*r, 1) for r in rows], "critique_run_id bigint, text string, score int"), model).collect()}
    assert all(got[i].licences == [f] for i, (f, _) in enumerate(licences.TEMPLATES))
    assert all(not got[i].licences and not got[i].n_unknown and got[i].score < 0.5 for i in range(100, 200))
    assert all(r.n_paragraphs == (3 if i < 100 else 4) for i, r in got.items())


def test_wrapped_notices_are_found(spark, model):
    """Each template wrapped at 40 and 72 columns, bare and behind comment marks."""
    rng, rows, want = random.Random(4), [], []
    for family, text in licences.TEMPLATES:
        for width, mark in ((40, ""), (72, ""), (40, "# "), (72, " * ")):
            rows.append((len(rows), prose(rng, 20) + "\n\n" + textwrap.fill(text, width, initial_indent=mark, subsequent_indent=mark) + "\n\n" + prose(rng, 20)))
            want.append([family])
    got = licences.scan_licences(spark.createDataFrame(rows, "critique_run_id bigint, text string"), model).collect()
    assert [r.licences for r in sorted(got, key=lambda r: r.critique_run_id)] == want
    assert all(r.n_unknown == 0 for r in got)


def test_notices_inside_other_text_are_found(spark, model):
    """Each template inside a long line and inside a block of prose lines, and two notices on one line."""
    rng, rows, want = random.Random(5), [], []
    for family, text in licences.TEMPLATES:
        rows.append((len(rows), f"{prose(rng, 150)} {text} {prose(rng, 150)}"))
        rows.append((len(rows), textwrap.fill(f"{prose(rng, 60)} {text} {prose(rng, 60)}", 60)))
        want += [[family]] * 2
    rows.append((len(rows), "Licensed under CC BY 4.0. Released under the MIT License."))
    want.append(["CC-BY-4.0", "MIT"])
    got = licences.scan_licences(spark.createDataFrame(rows, "critique_run_id bigint, text string"), model).collect()
    assert [r.licences for r in sorted(got, key=lambda r: r.critique_run_id)] == want


def test_wrapped_unknown_licences_and_plain_blocks(spark, model):
    rng = random.Random(6)
    odd = "Licensed under the Foobar Community License, version 9."
    rows = [(1, f"{prose(rng, 80)} {odd} {prose(rng, 80)}"), (2, "Licensed\nunder the Foobar\nCommunity License,\nversion 9."), (3, odd + "\n\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files,\nto deal in the Software without restriction")]
    rows += [(100 + i, "\n".join(prose(rng, rng.randrange(1, 60)) for _ in range(12))) for i in range(60)]
    got = {r.critique_run_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "critique_run_id bigint, text string"), model).collect()}
    assert got[1].licences == got[2].licences == [] and got[1].n_unknown and got[2].n_unknown
    assert got[3].licences == ["MIT"] and got[3].n_unknown == 1
    assert all(not r.licences and not r.n_unknown and r.score < 0.5 for i, r in got.items() if i >= 100)


def test_notices_across_the_scored_chunks(spark, model, monkeypatch):
    rng = random.Random(7)
    data, offsets = licences._packed([prose(rng, n) for n in (3, 90, 1, 200)])
    whole = model.windows(data, offsets)
    monkeypatch.setattr(licences, "CHUNK_WORDS", 16)
    assert all((abs(a - b) < 1e-9).all() for a, b in zip(whole, model.windows(data, offsets)))


def test_unknown_licences_are_not_named(spark, model):
    text = "Licensed under the Foobar Community License, version 9."
    row = licences.scan_licences(spark.createDataFrame([(1, text)], "critique_run_id bigint, text string"), model).first()
    assert row.licences == [] and row.n_unknown == 1


def test_awkward_rows(spark, model):
    rows = awkward(random.Random(1)) + [(None, "Released under the MIT License.")] * 2
    got = licences.scan_licences(spark.createDataFrame(rows, "critique_run_id bigint, text string"), model).collect()
    assert len(got) == len(rows) and sum(r.licences == ["MIT"] for r in got) == 2
    assert all(r.n_paragraphs == 0 and r.score == 0 for r in got if r.critique_run_id in (1, 2, 3))
    assert licences.scan_licences(spark.createDataFrame([], "critique_run_id bigint, text string"), model).collect() == []


def test_training_without_texts(spark):
    model = licences.train_licences(spark.createDataFrame([], "critique_run_id bigint, text string"))
    row = licences.scan_licences(spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0.")], "critique_run_id bigint, text string"), model).first()
    assert row.licences == ["CC-BY-NC-4.0"]


def test_driver_documents(spark):
    folder = SMALL.replace("0.001", "0.01")
    marks = {"MIT": "MIT License", "Apache-2.0": "Apache License", "GPL-3.0": "GNU General Public License", "CC-BY-NC-4.0": "CC BY-NC"}
    for r in QUERIES["op8_licences"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").collect():
        assert r.licences == sorted(f for f, mark in marks.items() if mark in r.text)
