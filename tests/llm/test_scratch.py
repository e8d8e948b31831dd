"""Stages leave no tables behind that only led to their result."""
import os
import random
import uuid

import pytest

import corpus_pipeline
from lexloom import session
from tests.llm.conftest import frame, prose


@pytest.fixture
def left(monkeypatch, tmp_path):
    """Names of the tables that are there now, in a folder of this test alone."""
    monkeypatch.setattr(session, "shared_dir", lambda spark, name: str(tmp_path / f"{name}-{uuid.uuid4().hex}"))
    return lambda: {f.rpartition("-")[0] for f in os.listdir(tmp_path)}


def _docs(spark):
    rng = random.Random(5)
    long, line = prose(rng, 80), "a line of eight words or even more"
    changed = long.rsplit(" ", 1)[0] + " changed"
    return frame(spark, [(1, f"{line}\nfirst\nsecond"), (2, f"x\nfirst\nsecond\n{line}"), (3, long), (4, long), (5, changed), (6, None), (None, long)])


def test_line_stage_leaves_only_copies(spark, left):
    got = corpus_pipeline.drop_repeated_lines(spark, _docs(spark), None)
    assert left() == {"copies"}
    assert {r.doc_id: r.text for r in got.collect()}[2] == "x"  # the result needs nothing that is gone


def test_near_stage_leaves_no_signatures(spark, left):
    got = corpus_pipeline.keep_one_of_near_duplicates(spark, _docs(spark), None)
    assert "components" in left() and not left() & {"signatures", "sets", "classes", "buckets", "members", "star", "links", "labelled", "named"}
    assert sorted(r.doc_id for r in got.collect() if r.doc_id) == [1, 2, 3, 6]


def test_settled_keeps_what_others_wrote(spark, left):
    numbers = session.checkpoint(spark.range(7), "numbers")

    def inner():
        doubled = session.checkpoint(numbers.selectExpr("2 * id AS id"), "doubled")
        return doubled, doubled.where("id > 4")

    def outer():
        every, large = session.settled(spark, inner, "every", "large")
        assert left() == {"numbers", "every", "large"}
        return (every.join(large, "id"),)
    both, = session.settled(spark, outer, "both")
    assert left() == {"numbers", "both"}
    assert sorted(r.id for r in both.collect()) == [6, 8, 10, 12] and numbers.count() == 7
