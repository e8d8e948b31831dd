"""Operators that judge each text: counts, languages, toxicity, pieces, fingerprints, URLs."""
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lexloom.llm import fingerprint, language_id, quality_rules, sentence_pieces, toxicity, url_filter, words
from tests.llm.conftest import EDGES, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_words_split_at_six_characters_only():
    texts = ["a\x1cb\x85c\xa0d e", " x\x0by\x0cz\t", None, "", "AÉ"]
    codes, bounds, vocabulary = words.split(pa.array(texts, pa.string()), lower=True)
    found = [[vocabulary[c].as_py() for c in codes[a:b]] for a, b in zip(bounds[:-1], bounds[1:])]
    assert found == [["a\x1cb\x85c\xa0d", "e"], ["x", "y", "z"], [], [], ["aÉ"]]


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in range(50)] + [None])], names=["text"])
    parts = list(words.slices([batch, batch.slice(0, 0)], max_bytes=100))
    assert len(parts) > 5 and pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()


def _counts(text):
    w = WORD.findall(text or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    cover = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_counts_and_edges(spark):
    rng = random.Random(3)
    rows = EDGES + [(100 + i, prose(rng, rng.randint(0, 80)) + rng.choice(["", "\n#x#\n#x#", "\na b c a b c"])) for i in range(60)]
    got = quality_rules.judge(frame(spark, rows)).collect()
    assert Counter((r.doc_id, *r[1:6]) for r in got) == Counter((d, *_counts(t)) for d, t in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert quality_rules.judge(frame(spark, rows).limit(0)).count() == 0


def test_bad_host_takes_its_good_documents_along(spark):
    rng = random.Random(4)
    good = prose(random.Random(5), 80)
    rows = [(i, good + str(i), f"h{i % 5}") for i in range(200)]  # five hosts without failures
    rows += [(1000 + i, "short" if rng.random() < 0.9 else good + str(i), "spam") for i in range(100)]
    rows += [(2000, "short", "tiny")]  # one failure is no verdict on a host: shrunk towards the others
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept for i in range(200))
    assert not any(got[1000 + i].kept for i in range(100))
    assert got[2000].host_rate < 1


def test_language_held_out_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    content = language_id.fit(docs.where(~held).select("text", "lang"))
    assert sorted(content) == ["de", "en", "es", "fr"]
    found = language_id.predict(docs.where(held), content).join(docs, "doc_id")
    rows = found.select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    edges = {r.doc_id: r for r in language_id.predict(frame(spark, EDGES + [(70, "12 ½ ² _ ☃")]), content).collect()}
    assert all(edges[i].lang_pred == "und" and edges[i].score == 0 and edges[i].rejected for i in (1, 2, 3, 70))
    assert edges[4].lang_pred != "und"
    none = language_id.fit(frame(spark, EDGES).where("false").select("text", "lang"))
    assert none == {} and {r.lang_pred for r in language_id.predict(frame(spark, EDGES), none).collect()} == {"und"}


def test_toxicity_gradients_match_differences():
    texts = ["a bad worst thing here", "all is fine and good", "worst of the bad", "good and fine things", "bad bad worst", "nice words only"]
    net = toxicity.train(texts, np.array([1, 0, 1, 0, 1, 0]), epochs=1)
    codes, bounds, vocabulary = words.split(pa.array(texts))
    rows = net.rows(vocabulary)
    _, start, size = toxicity._windows(bounds)
    cut, mask = toxicity._cut(codes, start, size, len(vocabulary), float)
    labels = np.array([1.0, 0, 1, 0, 1, 0])

    def loss():
        logit = net.forward(cut, mask, net.projected(net.vectors(rows)[0]))
        return np.mean(np.log1p(np.exp(logit)) - labels * logit)
    grad, d_x = net.gradients(cut, mask, net.vectors(rows)[0], labels)
    for name in ("o", "v", "A", "Uf", "Wb", "cf", "b"):
        w = net.weights[name]
        at = tuple(0 for _ in w.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert grad[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7), name


def test_toxicity_windows_cover_all_words():
    for n in (0, 1, 63, 64, 65, 96, 97, 500):
        text, start, size = toxicity._windows(np.array([0, n]))
        assert sorted(set().union(*(range(s, s + k) for s, k in zip(start, size)))) == list(range(n)) and len(text) == len(start)


def test_toxicity_held_out_and_edges(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(500):
        w = prose(rng, rng.randint(5, 300)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vile", "nastyface", "nastyhead", "nastytoe" + rng.choice("abc")])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    learned = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    net = toxicity.fit(frame(spark, rows[:400]), learned.where("doc_id < 400 OR doc_id IS NULL"))
    got = {r.doc_id: r for r in toxicity.score(frame(spark, rows[400:], extra=False), net).collect()}
    right = sum(got[i].predicted == t for i, t in labels[400:])
    assert right >= 97 and all(r.predicted == (r.score >= 0.5) for r in got.values())
    edges = toxicity.score(frame(spark, EDGES), net)
    assert edges.count() == len(EDGES) and edges.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert edges.where("doc_id = 2 AND predicted = 1").count() == 0
    assert set(EXTRA_KEPT) <= set(edges.columns)
    assert toxicity.fit(frame(spark, rows[:5]), learned.where("toxic = 0")) == 0.0
    assert toxicity.score(frame(spark, EDGES), 0.0, ["doc_id"]).count() == len(EDGES)


EXTRA_KEPT = ("n", "key", "grp", "source", "text")


def test_pieces_equal_the_library_and_come_back(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(0)
    rows = EDGES + [(100 + i, "".join(rng.choice("abcdeinrst hTo .,!☃é\n\U0001f600") for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(900, " " * 40 + "x" + " " * 17), (901, "aaaa" * 50)]
    encoded = sentence_pieces.encode(frame(spark, rows), PIECES)
    got = sentence_pieces.decode(encoded, PIECES).collect()
    assert Counter((r.doc_id, r.text, tuple(r.ids)) for r in got) == Counter((d, t, tuple(model.encode(t or ""))) for d, t in rows)
    assert all(r.decoded == (r.text or "") for r in got)
    assert sentence_pieces.encode(frame(spark, rows).limit(0), PIECES).count() == 0
    missing = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in sentence_pieces.decode(missing, PIECES).collect()] == [None, ""]


def test_unigram_paths_are_the_best():
    class Model:
        kind, longest, lowest = 1, 3, -9.0
        id_of = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "bab", "ba", "▁ab"])}
        score = dict(enumerate([-3.0, -2.0, -2.5, -3.0, -4.0, -5.0, -4.2, -6.1]))

        @staticmethod
        def fallback(char):
            return [99]
    rng = random.Random(2)
    marked = sorted({"▁" + "".join(rng.choice("abx") for _ in range(rng.randint(0, 7))) for _ in range(200)})

    def best(word):
        if not word:
            return 0.0
        found = [best(word[:-k]) + Model.score[Model.id_of[word[-k:]]] for k in range(1, min(3, len(word)) + 1) if word[-k:] in Model.id_of]
        return max(found) if found else best(word[:-1]) + Model.lowest - 10
    for word, ids in zip(marked, sentence_pieces.Trie(Model).encode(marked)):
        assert sum(Model.score.get(i, Model.lowest - 10) for i in ids) == pytest.approx(best(word))


def test_fingerprints_add_remove_and_ignore_order(spark):
    a, b = "One here. Two there! Three?", "Two there! Four."
    row = spark.createDataFrame([(a, b, "Three? One here. Two there! ")], "a string, b string, c string").select(
        fingerprint.fingerprint(F.col("a")).alias("a"), fingerprint.fingerprint(F.col("b")).alias("b"),
        fingerprint.fingerprint(F.concat("b", F.lit("\n"))).alias("n"),
        fingerprint.fingerprint(F.concat("b", "a")).alias("both"))
    got = row.select("*", fingerprint.add(F.col("a"), F.col("b")).alias("sum"), fingerprint.remove(F.col("both"), F.col("b")).alias("rest")).first()
    assert got["sum"] == got["both"] and got["rest"] == got["a"] and got["n"] != got["b"]


def test_fingerprint_neighbours_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_BUCKET", 7)
    rng = random.Random(8)
    ids = rng.sample(range(-500, 5000), 120)
    rows = [(i, prose(rng, rng.randint(0, 30))) for i in ids] + [(1, None)] * (1 not in ids)
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, rows)).collect()}
    ordered = sorted(rows, key=lambda r: -r[0])
    import hashlib
    for (d, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        t, after = t or "", after or ""
        third = len(t) // 3
        edited = t[:len(t) - third] + after[:third]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(t)
        assert (got[d].fingerprint == got[d].edited_fingerprint) == (fingerprint_pieces(t) == fingerprint_pieces(edited))
    assert len(got) == len(rows)


def fingerprint_pieces(text):
    return Counter(re.findall(fingerprint.PARAGRAPH, text))


def test_fingerprint_edges(spark):
    got = fingerprint.fingerprints(frame(spark, EDGES)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in EDGES)
    same = {r.fingerprint for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1 and len({r.fingerprint for r in got if r.doc_id in (6, 7)}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.fingerprints(frame(spark, EDGES).limit(0)).count() == 0
    assert fingerprint.fingerprints(frame(spark, EDGES[4:5])).first().near_next == 1.0


def _judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and host and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_rules_match_brute_force(spark):
    rng = random.Random(9)
    names = ["com", "a.com", "b.a.com", "org", "x.org", "c", "a.c"]
    rules = list({(rng.choice(names), "/" + "".join(rng.choice("ab/") for _ in range(rng.randint(0, 4)))): rng.choice(["allow", "block"]) for _ in range(40)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [None, "", "no scheme", "http://", "http://A.com", "x://b.A.com?q", "http://com#f", "a://b://c/a"]
    urls += [f"http://{rng.choice(['', 'www.', 'z'])}{rng.choice(names)}/" + "".join(rng.choice("ab/?#A") for _ in range(rng.randint(0, 8))) for _ in range(400)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(1, urls[1], "again"), (None, urls[4], "x")], "page_id long, url string, rule string")
    listed = spark.createDataFrame(rules + [(None, "/", "block"), ("a.com", "/", "block")], "host string, path string, verdict string")
    both = {(h, p): v for h, p, v in rules} | {("a.com", "/"): "block"}
    got = url_filter.judge(pages, listed).collect()
    want = [(r.page_id, *_judged(r.url, [(h, p, v) for (h, p), v in both.items()])) for r in pages.collect()]
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, listed.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact_with_tiny_filters(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "_shape", lambda count, others: (url_filter.BITMAP_BITS, 1))  # many false positives: several levels
    listed = spark.range(0, 40_000).select(F.xxhash64("id").alias("hash"))
    universe = spark.range(20_000, 120_000).select(F.xxhash64("id").alias("hash"))
    levels = url_filter.cascade(listed, universe)
    keys = np.array([r.hash for r in universe.collect()], np.int64).view(np.uint64)
    inside = {r.hash for r in listed.collect()}
    assert len(levels) > 2
    assert url_filter.look_up(levels, keys).tolist() == [k in inside for k in keys.view(np.int64).tolist()]


def test_crc_split_matches_the_contract(spark):
    assert spark.range(50).select(F.crc32(F.col("id").cast("string")).alias("c")).collect()[7].c == zlib.crc32(b"7")


def test_language_sizes_equal_direct_compression(spark):
    """Every prediction from plain calls of the library, piece by piece."""
    import zstandard
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    content = language_id.fit(docs.select("text", "lang"), sample_texts=20, sample_bytes=30_000)
    kept = defaultdict(list)
    for r in docs.where("text IS NOT NULL AND lang IS NOT NULL").withColumn("hash", F.xxhash64("text")).collect():
        kept[r.lang].append((r.hash % (1 << 30), r.hash, r.text))
    for lang, rows in kept.items():
        held = []
        for _, _, text in sorted(set(rows))[:20]:
            plain = language_id._plain(text)
            if not held or len(b"\n".join([*held, plain])) <= 30_000:
                held.append(plain)
        assert content[lang] == b"\n".join(reversed(held))  # whole texts only
    books = {lang: zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for lang, data in content.items()}
    for book in books.values():
        book.precompute_compress(level=language_id.LEVEL)
    for r in language_id.predict(docs, content).join(docs, "doc_id").limit(200).collect():
        if r.text is None or not any(map(str.isalpha, r.text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        data = language_id._plain(r.text)
        sizes = {}
        for lang, book in books.items():
            press = zstandard.ZstdCompressor(dict_data=book, write_content_size=False, write_checksum=False)
            sizes[lang] = sum(len(press.compress(data[i:i + language_id.PIECE_BYTES])) for i in range(0, len(data), language_id.PIECE_BYTES))
        first, second = sorted(sizes.values())[:2]
        assert sizes[r.lang_pred] == first and r.lang_pred == min(k for k, v in sizes.items() if v == first)
        assert r.score == pytest.approx(min(1.0, 0.5 + 5 * (second - first) / second)) and r.rejected == ((second - first) / second < language_id.MIN_MARGIN)


def test_toxicity_score_is_the_worst_window_step_by_step():
    """Plain loops over windows, words and units give the same scores."""
    rng = random.Random(4)
    texts = [prose(rng, n) + (" awful fool" if n % 3 == 0 else "") for n in [0, 1, 3, 30, 64, 65, 96, 97, 150, 200, 333] + list(range(5, 60))]
    net = toxicity.train(texts, np.array([int("awful" in t) for t in texts]), epochs=1)
    codes, bounds, vocabulary = words.split(pa.array([t.lower() for t in texts]))
    got = net.scores(codes, bounds, vocabulary)
    vector, w, h_size = net.word_vectors(vocabulary), net.weights, toxicity.HIDDEN

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def side(name, xs):
        h, out = np.zeros(h_size), []
        for x in xs:
            p, g = x @ w["W" + name] + w["c" + name], h @ w["U" + name]
            z, r = sigmoid(p[:h_size] + g[:h_size]), sigmoid(p[h_size:2 * h_size] + g[h_size:2 * h_size])
            h = (1 - z) * h + z * np.tanh(p[2 * h_size:] + r * g[2 * h_size:])
            out.append(h)
        return out
    for row in range(len(texts)):
        mine = codes[bounds[row]:bounds[row + 1]]
        starts = range(0, max(1, len(mine) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
        worst = -np.inf
        for a in starts:
            xs = [vector[c] for c in mine[a:a + toxicity.WINDOW]]
            states = [np.r_[f, b] for f, b in zip(side("f", xs), side("b", xs[::-1])[::-1])]
            if states:
                e = np.exp([np.tanh(s @ w["A"]) @ w["v"] for s in states])
                logit = sum(k * (s @ w["o"]) for k, s in zip(e / e.sum(), states)) + w["b"][0]
            else:
                logit = w["b"][0]
            worst = max(worst, logit)
        assert got[row] == pytest.approx(sigmoid(worst), abs=1e-9)
