"""Stages of the pipeline against brute force under their own rules."""
import random

import pytest

from lexloom.llm import line_dedup, near_dedup
from tests.llm.conftest import frame, prose
from tests.llm.test_corpus import WORD, _near_rows, _shingles


def _roots(sets, percent):
    root = {d: d for d in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(ids):
            for y in ids[i + 1:]:
                if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]) and root[x] != root[y]:
                    root[x] = root[y] = min(root[x], root[y])
                    changed = True
    return root


def _pairs_between_80_and_85(rng):
    """Texts of 60 to 80 words with one word changed in the middle, or two: five or ten runs of each side are its own."""
    rows = []
    for g in range(12):
        w = [f"{x}{i}" for i, x in enumerate(prose(rng, rng.randint(60, 80)).split())]
        rows.append((10 * g, " ".join(w)))
        w[20] = "other"
        rows.append((10 * g + 1, " ".join(w)))
        w[40] = "another"
        rows.append((10 * g + 2, " ".join(w)))
    return rows


def test_near_stage_links_from_80(spark):
    import corpus_pipeline
    rows = _pairs_between_80_and_85(random.Random(4))
    sets = {d: _shingles(t) for d, t in rows}
    want = _roots(sets, 80)
    assert want != _roots(sets, 85)
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, frame(spark, rows), None)
    assert {r.doc_id for r in kept.collect()} == {d for d, g in want.items() if d == g}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_at_percent(spark, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 3)
    rows = _near_rows(random.Random(6)) + [(20_000 + d, t) for d, t in _pairs_between_80_and_85(random.Random(5))]
    got = near_dedup.near_duplicates(frame(spark, rows), percent).collect()
    assert {r.doc_id: r.component_id for r in got} == _roots({d: _shingles(t) for d, t in rows}, percent)


def test_bands_keep_the_chance_of_a_miss():
    assert near_dedup.bands_for(85) == 24
    for percent in (70, 80, 85, 90):
        assert (1 - (percent / 100) ** near_dedup.ROWS) ** near_dedup.bands_for(percent) <= near_dedup.MISSED


def _lines_left(rows, long_words):
    """Brute force of the stage: repeated pairs of lines, and repeated lines of ``long_words`` words."""
    seen, out = {}, {}
    for d, t in sorted(r for r in rows if r[0] is not None and r[1] is not None):
        filled = [(i, x) for i, x in enumerate(t.split("\n")) if WORD.search(x)]
        gone = set()
        for p in range(len(filled)):
            runs = [filled[p:p + 2]] if p + 1 < len(filled) else []
            if len(WORD.findall(filled[p][1])) >= long_words:
                runs.append(filled[p:p + 1])
            for run in runs:
                if seen.setdefault(tuple(x for _, x in run), (d, p)) != (d, p):
                    gone |= {i for i, _ in run}
        out[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_long_lines_match_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = ["a", "b", "c c", "", " ", "one two three four", " one two  three\tfour five ", "one two three"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 5)))) for i in rng.sample(range(-50, 500), 60)]
    got = line_dedup.dedupe(frame(spark, rows), long_words=4)
    assert {r.doc_id: r.text for r in got.collect()} == _lines_left(rows, 4) and not [c for c in got.columns if c.startswith("__")]


def test_line_stage_drops_lone_long_lines(spark):
    import corpus_pipeline
    footer = "all rights of this text are with its author"
    rows = [(i, f"first {i}\n{footer}\nlast {i}") for i in range(5)] + [(i, footer) for i in range(5, 8)] + [(9, "short\nx 9"), (10, "short\ny 10")]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, frame(spark, rows), None).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"first {i}\nlast {i}" for i in range(1, 5))
    assert [got[i] for i in (5, 6, 7)] == ["", "", ""] and got[10] == "short\ny 10"


def test_stages_on_given_documents(spark):
    import corpus_pipeline
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    lined = corpus_pipeline.drop_repeated_lines(spark, docs, None).cache()
    want = _lines_left(rows, corpus_pipeline.LONG_LINE)
    assert lined.columns == docs.columns and {r.doc_id: r.text for r in lined.collect() if r.text is not None} == want
    roots = _roots({d: _shingles(t) for d, t in want.items()}, 80)
    kept = corpus_pipeline.keep_one_of_near_duplicates(spark, lined, None).where("text IS NOT NULL")
    assert {r.doc_id for r in kept.collect()} == {d for d, g in roots.items() if d == g}
