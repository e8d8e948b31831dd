"""Mixing, ranked search and the conversation trie against plain versions."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.llm import conversation_trie, mixing, ranked_search
from tests.llm.conftest import EDGES, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# mixing

def _targets(sizes: dict, weights=(1, 2, 3)) -> dict:
    """Shares by repeated resharing, with fractions."""
    from fractions import Fraction
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = Fraction(total - sum(3 * sizes[s] for s in capped))
        level = rest / (sum(w[s] for s in names if s not in capped) or 1)
        more = {s for s in names if s not in capped and level * w[s] > 3 * sizes[s]}
        if not more:
            return {s: float(3 * sizes[s] if s in capped else level * w[s]) for s in names}
        capped |= more


def _mix_rows(seed=5):
    rng = random.Random(seed)
    rows = [(d, t, "edge") for d, t in EDGES if t is None or len(t) < 1000]
    for i in range(400):
        source = rng.choice(["a", "b", "é", "tiny", None, "hot", "hot", "hot"]) if i % 50 else "tiny"
        rows.append((100 + i, prose(rng, 3 if source == "tiny" else rng.randint(0, 60)), source))
    return rows


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    rows = _mix_rows()
    docs = spark.createDataFrame([(*r, 1, "x", 2.0, 5) for r in rows], "doc_id long, text string, source string, size long, taken string, quality double, n long")
    got = mixing.mix(docs, F.when(F.col("doc_id") % 2 == 0, 4.0), ("doc_id", "source", "text")).collect()
    assert Counter((r.doc_id, r.source, r.text, r.size) for r in got) == Counter((d, s, t, len(WORD.findall(t or ""))) for d, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets, taken, by_parity = _targets(sizes), Counter(), defaultdict(list)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source], rel_tol=1e-12)
        assert r.epochs * r.size <= r.taken <= 3 * r.size and r.taken <= (r.epochs + 1) * r.size
        taken[r.source] += r.taken
        if r.source == "hot" and r.size:
            by_parity[r.doc_id % 2].append(r.taken / r.size)
    assert {s: math.floor(targets[s]) for s in targets} == {s: taken[s] for s in targets}
    assert sum(by_parity[0]) / len(by_parity[0]) > sum(by_parity[1]) / len(by_parity[1])  # better documents come oftener
    again = mixing.mix(docs.repartition(7), F.when(F.col("doc_id") % 2 == 0, 4.0), ("doc_id", "source", "text")).collect()
    assert Counter(again) == Counter(got)


def test_mix_takes_documents_in_key_order(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 30)), "s" + str(i % 2)) for i in range(200)]
    got = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.lit(2.0), ("doc_id", "source")).collect()}

    def key(row):
        draw = int(hashlib.md5(f"{row[0]}\n{row[1]}".encode()).hexdigest()[:13], 16)
        return -math.log((draw + 1) / (2 ** 52 + 2)) / 2
    for source in ("s0", "s1"):
        mine = sorted((r for r in rows if r[2] == source), key=key)
        left = math.floor(got[mine[0][0]].target) % got[mine[0][0]].source_size
        for d, t, _ in mine:
            size = len(WORD.findall(t))
            assert got[d].taken == got[d].epochs * size + min(size, max(0, left))
            left -= size


def test_draw_texts_and_edges(spark):
    rows = _mix_rows(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter()
    for r in mixing.mix(docs, None, ("doc_id", "source")).collect():
        want[r.doc_id, r.source] += r.taken
    have = Counter()
    drawn = mixing.draw_texts(docs)
    assert drawn.columns == ["doc_id", "text", "source", "pass"]
    for r in drawn.collect():
        have[r.doc_id, r.source] += len(WORD.findall(r.text))
        assert r["pass"] <= 3
    assert have == +want
    assert mixing.mix(docs.limit(0)).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in blank) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    odd = mixing.mix(frame(spark, EDGES), F.col("n_chars").cast("double"))
    assert odd.count() == len(EDGES)


# ranked search

def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _ranked(docs, items, k):
    bags = [(d, Counter(TERM.findall(_lower(t)))) for d, t in docs]
    held = [b for _, b in bags if b]
    n, total = len(held), sum(sum(b.values()) for b in held)
    df = Counter(t for b in held for t in b)
    out = Counter()
    for item, text in items:
        scored = []
        for d, bag in bags:
            m = 50 + (50 * sum(bag.values()) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 20 * m))
                        for t in set(TERM.findall(_lower(text))) if bag[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out.update((item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:k]))
    return out


def test_terms_are_ascii_runs():
    texts = ["Ab1_c-D\x00é\x7fÉ\x85x", None, "", "  ", "İK straße"]
    codes, bounds, vocabulary = ranked_search.split(pa.array(texts, pa.string()).slice(0))
    found = [[vocabulary[c].as_py() for c in codes[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]
    assert found == [TERM.findall(_lower(t)) for t in texts]
    part = ranked_search.split(pa.array(texts, pa.string()).slice(4))
    assert part[2].to_pylist() == TERM.findall(_lower(texts[4]))


@pytest.mark.parametrize("k,slice_bytes", [(3, 400), (50, 2000), (7, 1 << 20)])
def test_ranking_equals_full_evaluation(spark, monkeypatch, k, slice_bytes):
    monkeypatch.setattr(ranked_search, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 60)
    monkeypatch.setattr(ranked_search, "FIRST_POSTINGS", 2)
    rng = random.Random(k)
    docs = EDGES + [(1000 + i, prose(rng, rng.randint(0, 40)) + f" rare{i % 37} Uni{i % 5}") for i in range(300)]
    docs += [(5000 + i, "twin words rare1 stand here") for i in range(20)] + [(None, "twin words rare1 stand here")] * 3
    items = [(1, "rare1 uni2 ban"), (2, None), (3, "nowhere"), (4, prose(rng, 40)), (4, "Rare7 RARE7 x é"), (None, "long one word"), (5, "twin words")]
    got = ranked_search.rank(frame(spark, docs), frame(spark, items).withColumnRenamed("doc_id", "item_id"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == _ranked(docs, items, k)


def test_accumulators_stop_before_common_terms(monkeypatch):
    class Piece:
        ids = [0] * 1000
        adds = {0: (range(0, 5), 900), 1: (range(0, 1000), 10)}

        def of(self, term):
            import numpy as np
            docs, add = self.adds[term]
            return np.array(list(docs)), np.full(len(docs), add)
    touched, score = ranked_search._accumulate(Piece(), [0, 1], [910, 10], 0, 5)
    assert touched.tolist() == [0, 1, 2, 3, 4] and score[:5].tolist() == [910] * 5  # no new document by the common term, present ones complete


def test_ranking_of_empty_tables(spark):
    docs, items = frame(spark, EDGES), frame(spark, [(1, "one two")]).withColumnRenamed("doc_id", "item_id")
    assert ranked_search.rank(docs.limit(0), items).count() == 0
    assert ranked_search.rank(docs, items.limit(0)).count() == 0


# conversation trie

def _trie(rows):
    original = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            original[c].append((turn is not None, turn or 0, _digest(role, text), role or "", text or ""))
    original = {c: [t[3:] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in original.items()}
    members = defaultdict(list)
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        turns = original.get(c - c % 5, [])[:h] + own[h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, len(turns) == d))
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[:len(path)] == path]
        child = {p[:len(path) + 1] for p in below if len(p) > len(path)}
        leaves = sum(1 for p in below if not any(q[:len(p)] == p and len(q) > len(p) for q in below))
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c, end in convs if end))
        above = min(c for c, _ in members[path[:-1]]) if path else None
        out.append((min(c for c, _ in convs), len(path), above, len(convs), len(child), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def _digest(role, text):
    return hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()


def _talk(rng, n):
    rows = []
    for c in range(n):
        for turn in range(rng.choice([0, 1, 2, 3, 3, 4, 12])):
            text = "Hello." if turn == 0 and rng.random() < 0.7 else rng.choice(["ja", "né", "", None, f"t{rng.randint(0, 4)}"])
            rows.append((c, turn, rng.choice(["user", None, "assistant"]) if rng.random() < 0.2 else "user", text))
    rows += [(1000 + i, t, "user", "same") for i in range(60) for t in range(10)]  # one conversation many times
    rows += [(7, None, "x", "no turn"), (7, None, "x", "no turn"), (8, 3, "a", "tie"), (8, 3, "b", "tie"), (None, 1, "user", "nobody"), (2000, 0, "user", "z" * 50_000)]
    return rows


@pytest.mark.parametrize("shard_turns", [7, 60, 100_000])
def test_trie_equals_plain_trie(spark, monkeypatch, shard_turns):
    monkeypatch.setattr(conversation_trie, "CHUNK_BYTES", 64)
    rows = _talk(random.Random(shard_turns), 120)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, node string")
    got = conversation_trie.trie(table, shard_turns)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(map(tuple, got.collect())) == _trie(rows)


def test_trie_joins_ranges_where_the_skeleton_is_too_large(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "SKELETON_BYTES", 400)
    rows = _talk(random.Random(1), 60)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert Counter(map(tuple, conversation_trie.trie(table, 10).collect())) == _trie(rows)


def test_trie_of_deep_empty_and_turnless(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert conversation_trie.trie(spark.createDataFrame([], kind)).count() == 0
    deep = [(5, t, "user", f"{t}") for t in range(3000)] + [(10, t, "user", f"{t}") for t in range(2990)]
    got = conversation_trie.trie(spark.createDataFrame(deep, kind), 500)
    assert got.count() == 3001 and got.where("depth = 2990").first().n_convs == 2
    turnless = [(c, 0, "user", "only") for c in range(11, 15)]  # heads are absent, so the first h turns go
    want = _trie(turnless)
    assert Counter(map(tuple, conversation_trie.trie(spark.createDataFrame(turnless, kind)).collect())) == want
