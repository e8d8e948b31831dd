"""Suffix ranks of lines against plain sorting."""
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexloom.llm import line_dedup
from tests.llm.conftest import EDGES, frame


def _lines(text):
    return [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]


def _copies(rows, k, long_words=None):
    """Kept text of every row by comparing runs directly."""
    first = {}
    texts = sorted({(d, t) for d, t in rows if d is not None and t is not None})
    for d, t in texts:
        lines = _lines(t)
        for i in range(len(lines) - k + 1):
            first[tuple(lines[i:i + k])] = min(first.get(tuple(lines[i:i + k]), (d, i)), (d, i))
        for i, line in enumerate(lines):
            if long_words and len(line.split()) >= long_words:
                first[line] = min(first.get(line, (d, i)), (d, i))
    gone = defaultdict(set)
    for d, t in texts:
        lines = _lines(t)
        for i in range(len(lines)):
            if i + k <= len(lines) and first[tuple(lines[i:i + k])] < (d, i):
                gone[d].update(range(i, i + k))
            if long_words and len(lines[i].split()) >= long_words and first[lines[i]] < (d, i):
                gone[d].add(i)
    out = []
    for d, t in rows:
        if d is None or t is None:
            out.append((d, t))
            continue
        n, kept = -1, []
        for line in t.split("\n"):
            if _lines(line):
                n += 1
                if n in gone[d]:
                    continue
            kept.append(line)
        out.append((d, "\n".join(kept)))
    return sorted(out, key=str)


def _corpus(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        lines = [rng.choice(["a", "b", "c", f"own {rng.random()}", "one two three four five", ""]) for _ in range(rng.choice([0, 1, 3, 12, 50]))]
        if rows and rng.random() < 0.4:
            other = (rows[rng.randrange(len(rows))][1] or "").split("\n")
            at = rng.randrange(len(other))
            lines[len(lines) // 2:len(lines) // 2] = other[at:at + 45]
        rows.append((d, "\n".join(lines)))
    return rows + [(500 + i, "x\ny\nz") for i in range(30)]


@pytest.mark.parametrize("k,long_words", [(1, None), (2, None), (2, 4), (3, None), (7, 4), (40, None)])
def test_later_copies_equal_direct_comparison(spark, k, long_words):
    rows = _corpus(k)
    got = line_dedup.dedupe(spark.createDataFrame(rows, "doc_id long, text string"), k, long_words)
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == _copies(rows, k, long_words)


def test_edge_rows(spark):
    got = line_dedup.dedupe(frame(spark, EDGES + [(1, "a\nb"), (2, "a\nb"), (2, "a\nb")]), 2)
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == _copies(EDGES + [(1, "a\nb"), (2, "a\nb"), (2, "a\nb")], 2)
    assert line_dedup.dedupe(frame(spark, EDGES).limit(0)).count() == 0


def test_ranks_are_those_of_sorted_suffixes(spark):
    """After the last round, ranks order suffixes as sorting their lines by ID does, ties only between equal suffixes."""
    rows = _corpus(9, 25)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = line_dedup.line_ids(docs)
    rank, widths = {}, []
    for width, ranked in line_dedup.rounds(lines):
        widths.append(width)
        for r in ranked.collect():
            rank[r.doc_id, r.place] = r.next
    ids = defaultdict(list)
    for r in lines.orderBy("doc_id", "place").collect():
        ids[r.doc_id].append((r.a, r.b))
    suffixes = {(d, i): v[i:] for d, v in ids.items() for i in range(len(v))}
    ordered = sorted(suffixes.values())
    assert rank == {key: ordered.index(s) for key, s in suffixes.items()}
    assert widths[:3] == [1, 2, 4] and len(widths) >= 5


def test_a_tied_group_over_many_ranges(spark):
    """One rank in all ranges of the sort: offsets are carried from range to range."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    pairs = spark.range(500).select((F.col("id") % 2).alias("rank"), F.floor(F.col("id") / 3).alias("ahead"))
    got = {(r.rank, r.ahead): (r.next, r.n) for r in line_dedup._ranked(pairs, ["ahead"]).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    rows = sorted((i % 2, i // 3) for i in range(500))
    for key in set(rows):
        assert got[key] == (key[0] + sum(r < key and r[0] == key[0] for r in rows), rows.count(key))
