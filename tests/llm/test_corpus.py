"""Operators that compare or place documents of a whole corpus, and the pipeline."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexloom.llm import line_dedup, near_dedup, packing, substring_dedup
from tests.llm.conftest import EDGES, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _lines_kept(rows, k):
    seen, out = {}, {}
    for d, t in sorted({r for r in rows if r[0] is not None and r[1] is not None}):
        filled = [(i, x) for i, x in enumerate(t.split("\n")) if WORD.search(x)]
        gone = set()
        for p in range(len(filled) - k + 1):
            key = tuple(x for _, x in filled[p:p + k])
            if seen.setdefault(key, (d, p)) != (d, p):
                gone |= {i for i, _ in filled[p:p + k]}
        out[d] = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone), len(gone)
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_line_runs_match_brute_force(spark, k):
    rng = random.Random(k)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c c", "", " "]) for _ in range(rng.randint(1, 12)))) for i in rng.sample(range(-50, 500), 80)]
    want = _lines_kept(rows, k)
    got = line_dedup.dedupe(frame(spark, rows), k).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in got} == want and len(got) == len(rows)


def test_line_dedup_edges(spark):
    rows = EDGES + [(50, "line\nline\n\nline\nother")]
    got = line_dedup.dedupe(frame(spark, rows))
    assert got.columns[:2] == ["doc_id", "text"] and got.count() == len(rows)
    kept = defaultdict(list)
    for r in got.collect():
        kept[r.doc_id].append(r.text)
    assert kept[50] == [""] and kept[1] == [None] and kept[2] == [""] and len(kept[7]) == 2 and kept[-10] == ["line\n\nother"]
    assert line_dedup.dedupe(frame(spark, rows).limit(0)).count() == 0


def _shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _components(sets):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[i + 1:]:
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in ids}


def _near_rows(rng):
    rows = []
    for g in range(12):
        w = prose(rng, rng.randint(40, 120)).split()
        for _ in range(rng.choice([1, 2, 12])):  # chains: each copy edits the one before
            rows.append(" ".join(w))
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] = prose(rng, 1)
    rng.shuffle(rows)
    ids = rng.sample(range(-100, 10_000), len(rows))
    return list(zip(ids, rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 3)
    rows = _near_rows(random.Random(seed))
    want = _components({d: _shingles(t) for d, t in rows})
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(_shingles(dict(rows)[r.doc_id])) for r in got)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(7)
    w = prose(rng, 200).split()
    rows = [(i, " ".join(w[:k] + ["odd%d" % i] + w[k:])) for i, k in enumerate(rng.choices(range(200), k=300))]
    got = near_dedup.near_duplicates(frame(spark, rows, extra=False))
    assert got.where("kept").count() == 1 and got.select("component_id").distinct().first()[0] == 0


def test_near_duplicates_edges(spark):
    got = near_dedup.near_duplicates(frame(spark, EDGES))
    found = Counter((r.doc_id, r.component_id, r.kept) for r in got.collect())
    assert found == Counter([(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 5, False), (7, 5, False), (7, 5, False),
                             (None, None, True), (None, None, True), (8, 8, True), (9, 9, True), (-10, -10, True)])
    assert near_dedup.near_duplicates(frame(spark, EDGES).limit(0)).count() == 0


def test_signatures_estimate_the_overlap():
    rng = np.random.default_rng(1)
    places, off = 64, []
    for _ in range(150):
        base = rng.integers(0, 2 ** 63, 30).astype(np.uint64)
        a, b = np.unique(base[:24]), np.unique(base[6:])
        sig = near_dedup.super_minhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), places)
        assert np.isfinite(sig).all() and sorted(np.floor(near_dedup.super_minhash(a[:1], np.array([0, 1]), places))[0].tolist()) == list(range(places))
        off.append((sig[0] == sig[1]).mean() - 18 / 30)
    off = np.array(off)
    assert abs(off.mean()) < 0.02
    assert off.var() < 0.6 * 0.4 / places  # below independent places


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    nodes = list(range(400))
    rng.shuffle(nodes)
    edges = [(max(a, b), min(a, b)) for a, b in zip(nodes, nodes[1:]) if (a + b) % 17]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long").repartition(40))
    assert {r.node: r.root for r in got.collect()} == {x: find(x) for x in list(parent)}


def _without_passages(rows):
    first = {}
    split = {d: WORD.findall(t or "") for d, t in rows if d is not None}
    for d in sorted(split):
        for i in range(len(split[d]) - 49):
            first.setdefault(tuple(split[d][i:i + 50]), d)
    out = {}
    for d, w in split.items():
        gone = {i + k for i in range(len(w) - 49) if first[tuple(w[i:i + 50])] < d for k in range(50)}
        out[d] = len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    return out


@pytest.mark.parametrize("chars", [2000, 8 << 20])
def test_passages_match_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(substring_dedup, "GROUP_CHARS", chars)
    monkeypatch.setattr(substring_dedup, "RANGE_WORDS", 500)
    rng = random.Random(11)
    shared = [prose(rng, n) for n in (49, 50, 51, 74, 75, 99, 130)]
    rows = [(i, " ".join(rng.choice([prose(rng, rng.randint(0, 60)), rng.choice(shared), rng.choice(shared)]) for _ in range(rng.randint(1, 5)))) for i in rng.sample(range(-20, 900), 90)]
    rows += [(2000, "w " * 400), (2001, "w " * 60), (2002, None)]
    got = substring_dedup.dedupe(frame(spark, rows), plain=True).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == _without_passages(rows) and len(got) == len(rows)


def test_passage_edges(spark):
    long = "long " * 30_000
    rows = EDGES + [(20, long), (20, long), (None, long), (21, "a  b\n" + long)]
    got = substring_dedup.dedupe(frame(spark, rows))
    assert got.count() == len(rows) and set(("key", "grp", "n_removed")) <= set(got.columns)
    found = Counter((r.doc_id, r.n_removed, r.text == dict([(r.doc_id, r.text)])[r.doc_id]) for r in got.collect())
    assert found[(20, 30_000, True)] == 2 and found[(9, 0, True)] == 1 and found[(None, 0, True)] == 3
    assert {r.text for r in got.where("doc_id = 21").collect()} == {"a b"}
    assert got.where("doc_id = 1 AND text IS NULL").count() == 1
    assert substring_dedup.dedupe(frame(spark, rows).limit(0)).count() == 0


def test_grouped_texts_are_shuffled_once(spark):
    docs = frame(spark, EDGES, extra=False)
    table = substring_dedup._grouped(docs, 8)
    plan = table.groupBy("__grp").applyInArrow(substring_dedup._send_anchors(40, 0), substring_dedup._CELLS)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_packing_is_whole_and_gapless(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 64)
    rng = random.Random(5)
    rows = EDGES + [(100 + i, prose(rng, rng.choice([3, 50, 400, 1500]))) for i in range(120)]
    got = packing.pack_documents(frame(spark, rows), TOKENIZER).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for p, a in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[a:a + 2048], "<u4")
            want[(d, p, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r.length for r in got) // 2048)
    assert len(bins) <= 1.1 * least + 3
    assert packing.pack_documents(frame(spark, rows).limit(0), TOKENIZER).count() == 0


def test_islands_improve_and_keep_all_pieces():
    rng = random.Random(2)
    sizes = [s for _ in range(60) for s in (lambda a, b: (a, b, 100 - a - b))(rng.randint(20, 45), rng.randint(20, 40))]
    island = packing.Island(sizes, 100, 1)
    island.start(8)
    before = island.population[0][0]
    island.evolve(150, 8)
    after, bins = island.population[0]
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert after <= before and after[0] <= before[0]
    other = packing.Island(sizes, 100, 2)
    other.admit([of for of, _, _ in island.best(2)])
    assert other.population[0][0] == after


def test_pipeline_stages(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "minhash_near_dedup", "substring_dedup", "best_fit_packing"]

    def rows(df):
        return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    clean = stages["toxicity"](spark, docs, sf).cache()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {d for d, _ in rows(clean)}
    assert clean.columns == docs.columns and sum(labels.get(d) == 0 for d, _ in rows(docs)) * 0.95 <= sum(labels.get(d) == 0 for d in kept)
    lined = stages["line_dedup"](spark, clean, sf).cache()
    want = _lines_kept(rows(clean), line_dedup.MIN_LINES)
    assert lined.columns == docs.columns and dict(rows(lined)) == {d: t for d, (t, _) in want.items()}
    one = stages["minhash_near_dedup"](spark, lined, sf).cache()
    groups = _components({d: _shingles(t) for d, t in rows(lined)})
    assert {d for d, _ in rows(one)} == {d for d, g in groups.items() if d == g}
    last = stages["substring_dedup"](spark, one, sf).cache()
    cut = _without_passages(rows(one))
    assert {d: hashlib.sha256(" ".join(WORD.findall(t)).encode()).hexdigest() for d, t in rows(last)} == {d: h for d, (_, _, h) in cut.items()}
    packed = stages["best_fit_packing"](spark, last, sf)
    assert {r.doc_id for r in packed.collect()} == {d for d, _ in rows(last)}
