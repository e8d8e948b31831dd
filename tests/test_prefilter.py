"""Document points against plain counting."""
import random
from collections import defaultdict

import pyarrow as pa
import pytest

from lexloom import vocab
from lexloom.operators import prefilter as P


def _plain(questions, documents, k, positive):
    out = set()
    for owner, question in {(o, q) for o, _, q in questions if o is not None and q is not None}:
        low = question.lower()
        terms = [t for t in low.split() if len(t) > 2 and t not in vocab.PREFILTER_STOP_WORDS]
        scored = []
        for o, doc, pos, name, text in documents:
            if o != owner:
                continue
            name, text = (name or "").lower(), (text or "").lower()
            score = sum(10 * (t in name) + 5 * (t in text) for t in terms)
            for p in vocab.PREFILTER_PHRASES:
                if p in low:
                    score += 20 * any(f in name for f in (p, p.replace(" ", "-", 1), p.replace(" ", "_", 1))) + 15 * (p in text)
            score += 5 * ("federal-decree-law-no.-47" in name or "federal decree-law" in name)
            if score > 0 or not positive:
                scored.append((-score, pos, doc))
        out |= {(owner, question, doc, -s, i + 1) for i, (s, _, doc) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("positive,cells", [(True, 8 << 20), (False, 200)])
def test_scores_equal_plain_counting(spark, monkeypatch, positive, cells):
    monkeypatch.setattr(P, "BLOCK_CELLS", cells)
    monkeypatch.setattr(P, "_SLICE_BYTES", 300)
    rng = random.Random(3)
    words = ["relief", "small", "business", "tax", "group", "Übung", "reliefs", "x-ray", "free", "zone", "article", "12", "fe"]
    docs = [(rng.choice("uv"), i, 1000 - i, rng.choice(["plain", "small_business note", "Federal Decree-Law 1", None]),
             rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 40)))])) for i in range(150)] + [(None, 900, 1, "tax", "tax")]
    questions = [(rng.choice("uvw"), i, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(40)] + [("u", 90, None), (None, 91, "tax"), ("v", 92, "tax tax free zone")]
    q = spark.createDataFrame(questions, "owner string, query_id int, question string")
    d = spark.createDataFrame(docs, "owner string, document_id int, pos int, name string, description string")
    from pyspark.sql import functions as F
    got = P.score_documents(q.select("owner", "question").distinct(), d, 4, P.is_core_without_bonus(F.col("name")), F.lit(False), positive, False)
    assert {(r.owner, r.question, r.document_id, r.score, r["rank"]) for r in got.collect()} == _plain(questions, docs, 4, positive)
    if positive:
        assert P.scored_documents(q.limit(0), d, 3).count() == 0 and P.scored_documents(q, d.limit(0), 3).count() == 0


def test_terms_are_found_inside_words():
    rng = random.Random(5)
    terms = sorted({"".join(rng.choices("abé", k=rng.randint(3, 6))) for _ in range(30)})
    texts = [None, "", *(" ".join("".join(rng.choices("abé", k=rng.randint(1, 12))) for _ in range(8)) for _ in range(50))]
    rows, found = P._Terms(terms).inside(pa.array(texts, pa.string()))
    got = defaultdict(set)
    for r, t in zip(rows.tolist(), found.tolist()):
        got[r].add(terms[t])
    assert all(got[i] == {t for t in terms if t in (x or "")} for i, x in enumerate(texts))
