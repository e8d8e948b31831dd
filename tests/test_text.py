"""Text, query and citation rules on small fixtures."""
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexloom import vocab
from lexloom.functions import citations as C, query as Q, scoring, text as T, vectors as V
from lexloom.operators.chunking import split_recursive


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [
    ("  What is the CT rate? ", "what is the corporate tax rate?"),
    ("corproate   taxs", "corporate tax"),
    ("P&L and bs of act", "profit and loss and balance sheet of act"),
    ("", ""), ("   ", ""),
    ("dtaa or dta", "double taxation avoidance agreement or double taxation agreement"),
])
def test_normalize(spark, text, want):
    assert one(spark, T.normalize_query(F.col("t")), t=text) == want


def test_normalize_equals_replacing_in_order(spark):
    """One look-up per word against the entry-by-entry definition."""
    import re
    texts = [" ".join(k for k, _ in vocab.TYPOS), " ".join(k for k, _ in vocab.ABBREVIATIONS), "vat-fta,pe;ct.tp", "taxs_x taxs"]
    for t in texts:
        want = t.lower().strip()
        for a, b in vocab.TYPOS + vocab.ABBREVIATIONS:
            want = re.sub(rf"\b{re.escape(a)}\b", b, want, flags=re.ASCII)
        assert one(spark, T.normalize_query(F.col("t")), t=t) == re.sub(r"\s+", " ", want).strip()


def test_expand(spark):
    assert one(spark, T.expand_query(F.col("t")), t="tax rate in chapter 3 article 4") == \
        "tax rate in chapter 3 article 4 Article 3 Chapter 4 taxation levy percentage ratio part division"
    assert one(spark, T.expand_query(F.col("t")), t="hello") == "hello"
    assert "arm's length" in one(spark, T.expand_query(F.col("t"), phrases=True), t="transfer pricing")


def test_search_string_without_keywords_is_the_query(spark):
    assert one(spark, T.search_string(F.col("t")), t="What is THE") == "What is THE"
    assert one(spark, T.search_string(F.col("t")), t="corporate tax rate") == "corporate | tax | rate"


def test_references(spark):
    got = one(spark, T.references(F.col("t")), t="article 5 (2), Article 5 Chapter XII Section 4.1 Federal Decree-Law No. 47 Cabinet Decision 3 Ministerial Decision No. 9")
    assert got == ["Article 5", "Chapter XII", "Section 4.1", "Decree-Law 47", "Cabinet Decision 3", "Ministerial Decision 9"]


def test_page_tags(spark):
    for text, want in [("<physical_index_5>", 5), ("physical_index_12", 12), (" 7 pages", 7), ("x", None)]:
        assert one(spark, T.page_tag_number(F.col("t")), t=text) == want


def test_dot_leaders(spark):
    assert one(spark, T.plain_dot_leaders(F.col("t")), t="Scope........12 and . . . . . . 3") == "Scope: 12 and :  3".replace(":  3", ": 3")


def test_json_repair(spark):
    fenced = '```json\n{"a": None, "b": [1, 2,], }\n```'
    assert one(spark, F.variant_get(T.parse_reply(F.col("t")), "$.b[1]", "int"), t=fenced) == 2
    assert one(spark, F.to_json(T.parse_reply(F.col("t"))), t="no json") == "{}"
    assert one(spark, T.json_array_in(F.col("t")), t='Sure: ["a","b"] ok') == ["a", "b"]


def test_snippet_and_parts(spark):
    text = "x" * 100 + "Needle" + "y" * 100
    assert one(spark, T.match_snippet(F.col("t"), F.lit("needle")), t=text) == "..." + "x" * 50 + "Needle" + "y" * 50 + "..."
    assert one(spark, T.match_snippet(F.col("t"), F.lit("zzz")), t=text) == text[:150] + "..."
    parts = one(spark, T.match_parts(F.col("t"), F.lit("a.b")), t="A.B axb a.b")
    assert [(p["is_match"], p["text"]) for p in parts] == [(True, "A.B"), (False, " axb "), (True, "a.b")]


@pytest.mark.parametrize("passage,page,strategy", [
    ("Hello, World again", "well hello world again ok", "full"),
    ("a" * 10 + " " + "b" * 145 + "zz different tail", "start " + "a" * 10 + " " + "b" * 145 + " end", "head150"),
    ("iv a tax on all of it", "so a tax on all of it now", "clean200"),
    ("unrelated words here tax period and more", "the tax period ends", "distinctive"),
    ("nothing", "else", None),
])
def test_locate(spark, passage, page, strategy):
    got = one(spark, T.locate_passage(F.col("a"), F.col("b")), a=passage, b=page)
    assert (got["strategy"] if got else None) == strategy
    if got:
        assert got["start"] >= 0 and got["len"] > 0


def test_trigram_similarity(spark):
    assert one(spark, T.trigram_similarity(T.trigrams(F.col("a")), T.trigrams(F.col("b"))), a="word", b="two words") == pytest.approx(4 / 11)


# ------------------------------------------------------------------ vectors

def test_cosine_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [2.0, 0.0]), (2, [0.0, 0.0], [1.0, 0.0]), (3, [1.0], [1.0, 0.0]), (4, None, [1.0])], "i int, a array<float>, b array<float>")
    got = {r["i"]: r["x"] for r in df.select("i", V.cosine(F.col("a"), F.col("b")).alias("x")).collect()}
    assert got == {1: 1.0, 2: None, 3: 0.0, 4: None}


def test_unit_and_mean(spark):
    assert one(spark, V.unit(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, V.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, V.mean_of(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))))) == [2.0, 3.0]


def test_rrf_is_symmetric(spark):
    a = one(spark, scoring.rrf_term(F.lit(3)) + scoring.rrf_term(F.lit(9)))
    b = one(spark, scoring.rrf_term(F.lit(9)) + scoring.rrf_term(F.lit(3)))
    assert a == b
    assert one(spark, scoring.rrf_term(F.lit(None).cast("int"))) == 0.0


# ------------------------------------------------------------------ queries

@pytest.mark.parametrize("text,complexity,k", [
    ("transfer pricing", "technical", 15), ("How to apply", "procedural", 10), ("What is it", "definitional", 8), ("rate", "simple", 5), ("Article 5", "simple", 8),
    ("one two three four five six seven eight nine", "simple", 10),
])
def test_classify(spark, text, complexity, k):
    got = one(spark, Q.classify(F.col("t")), t=text)
    assert (got["complexity"], got["top_k"]) == (complexity, k)


def test_word_boundary_option(spark):
    assert one(spark, Q.classify(F.col("t")), t="performance")["complexity"] == "procedural"
    assert one(spark, Q.classify(F.col("t"), True), t="performance")["complexity"] == "simple"


def test_intent_with_model(spark):
    reply = F.struct(F.lit("clarification").alias("intent"), F.lit(0.4).alias("confidence"), F.lit("clarify").alias("action"), F.lit(None).cast("string").alias("topic"))
    failed = F.lit(None).cast("struct<intent:string,confidence:double,action:string,topic:string>")
    assert one(spark, Q.intent_with_model(F.col("t"), reply), t="audit please")["intent"] == "clarification"
    assert one(spark, Q.intent_with_model(F.col("t"), failed), t="audit please")["confidence"] == 0.6
    assert one(spark, Q.intent_with_model(F.col("t"), failed), t="cheese please")["confidence"] == 0.3
    assert one(spark, Q.intent_with_model(F.col("t"), reply), t="tell me about audit")["intent"] == "in_scope"


def test_decline_text(spark):
    assert one(spark, Q.decline_text(F.lit("Please: {clarificationPrompt}"), F.lit(None).cast("string"), "which?")) == "Please: which?"


def test_enrich(spark):
    got = one(spark, Q.enrich_query(F.lit("what about this"), F.lit("article 5 and GAAR. Article 5. federal decree-law no. 47 on Free Zone")))
    assert got == "Regarding Article 5, GAAR, Free Zone: what about this"


# ------------------------------------------------------------------ citations

def test_renumber_two_digits(spark):
    assert one(spark, C.renumber_by_appearance(F.col("t")), t="a [12] b [1] c [12][007]") == "a [1] b [2] c [1][007]"
    assert one(spark, C.renumber_by_source(F.col("t"), F.lit(12)), t="a [12] b [1] c [99] [0]") == "a [2] b [1] c [99] [0]"


def test_sources_by_appearance(spark):
    src = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(f"s{i}").alias("name")) for i in (1, 2, 3)])
    got = one(spark, C.sources_by_appearance(F.lit("x [3] y [1]"), src))
    assert [(s["index"], s["name"]) for s in got] == [(1, "s3"), (2, "s1")]


def test_validate_cluster_and_transition(spark):
    v = one(spark, C.validate(F.col("t"), F.lit(2)), t="However 5 years apply. Also 9% is due [1][2]\n\nend")
    assert v["clustered"] and v["fact_count"] == 2 and v["citation_count"] == 2 and v["coverage"] == 1.0
    assert not any("uncited" in i for i in v["issues"])


def test_empty_answer(spark):
    s = one(spark, C.quality_score(F.lit("hello"), F.col("t"), F.lit(0)), t="")
    assert (s["score"], s["citation_quality"], s["key_figures"], s["completeness"]) == (70, 25, 30, 15)


# ------------------------------------------------------------------ splitter

@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. ,\n", max_size=400), st.integers(5, 60))
def test_split_recursive_keeps_every_character(text, size):
    overlap = size // 4
    chunks = split_recursive(text, size, overlap, vocab.SPLIT_SEPARATORS)
    assert all(0 < len(c) <= size for c in chunks)
    at = 0
    for c in chunks:  # chunks lie in the text in order, gaps hold blanks only
        found = text.find(c, max(0, at - size))
        assert found >= 0
        at = max(at, found + len(c))
    assert "".join(c for c in text if not c.isspace()).startswith("".join(ch for ch in (chunks[0] if chunks else "") if not ch.isspace()))


def test_split_overlap():
    text = " ".join(f"w{i:03d}" for i in range(50))
    chunks = split_recursive(text, 40, 12, vocab.SPLIT_SEPARATORS)
    assert all(a.split()[-1] in b for a, b in zip(chunks, chunks[1:]))
