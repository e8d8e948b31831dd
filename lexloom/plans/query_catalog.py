"""Catalogue: query understanding over one question per order."""
from __future__ import annotations

from pyspark.sql import functions as F

from lexloom import vocab
from lexloom.functions import query as Q, text as T
from lexloom.operators.rows import computed
from lexloom.plans.common import QUESTIONS_SQL, WS_SQL, q, query, questions, sql_list, sql_trim


def _norm_sql(e: str) -> str:
    out = sql_trim(f"lower({e})")
    for a, b in vocab.TYPOS + vocab.ABBREVIATIONS:
        out = f"regexp_replace({out}, {q(chr(92) + 'b' + a + chr(92) + 'b')}, {q(b)}, 'g')"
    return sql_trim(f"regexp_replace({out}, '{WS_SQL}', ' ', 'g')")


def _keywords_sql(e: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower({e}), '{WS_SQL}'), "
            f"lambda w: length(w) > 2 AND NOT list_contains({sql_list(vocab.SEARCH_STOP_WORDS)}, w))")


def _any_sql(e: str, words) -> str:
    return "(" + " OR ".join(f"contains({e}, {q(w)})" for w in words) + ")"


_WORDS = f"len(list_filter(regexp_split_to_array(question, '{WS_SQL}'), lambda w: w <> ''))"
_PIECES = f"len(regexp_split_to_array(question, '{WS_SQL}'))"
_ENTITIES = "list_concat(" + ", ".join(
    f"list_transform(regexp_extract_all(question, {q(p)}, 1), lambda n: {q(label)} || n)" for label, p in vocab.ENTITY_PATTERNS) + ")"
# distinct in first-seen order
_ENTITIES_DISTINCT = f"list_filter({_ENTITIES}, lambda x, i: list_position({_ENTITIES}, x) = i)"


@query("query_normalize", f"WITH {QUESTIONS_SQL} SELECT question_id, {_norm_sql('question')} AS normalized FROM questions")
def query_normalize(spark, sf):
    return questions(spark, sf).select("question_id", T.normalize_query(F.col("question")).alias("normalized"))


@query("query_keywords", f"""WITH {QUESTIONS_SQL}, n AS (SELECT *, {_norm_sql('question')} AS norm FROM questions)
SELECT question_id, array_to_string({_keywords_sql('question')}, ',') AS keywords,
  CASE WHEN len({_keywords_sql('norm')}) = 0 THEN question ELSE array_to_string({_keywords_sql('norm')}, ' | ') END AS search_string
FROM n""")
def query_keywords(spark, sf):
    c = F.col("question")
    return questions(spark, sf).select("question_id", F.array_join(T.keywords(c), ",").alias("keywords"), T.search_string(c).alias("search_string"))


_SYN_FIRST_TWO = "MAP {" + ", ".join(f"{q(k)}: {sql_list(v[:2])}" for k, v in vocab.SYNONYMS.items()) + "}"


@query("query_expand", f"""WITH {QUESTIONS_SQL}, n AS (SELECT question_id, {_norm_sql('question')} AS norm FROM questions),
hits AS (SELECT *, list_filter({_keywords_sql('norm')}, lambda w: list_contains({sql_list(list(vocab.SYNONYMS))}, w))[1:3] AS hit FROM n),
terms AS (SELECT question_id, norm, list_concat(
    list_transform(regexp_extract_all(norm, 'chapter\\s+(\\d+)', 1), lambda x: 'Article ' || x),
    list_transform(regexp_extract_all(norm, 'article\\s+(\\d+)', 1), lambda x: 'Chapter ' || x),
    flatten(list_transform(hit, lambda w: ({_SYN_FIRST_TWO})[w]))) AS extra FROM hits)
SELECT question_id, CASE WHEN len(extra) > 0 THEN norm || ' ' || array_to_string(extra, ' ') ELSE norm END AS expanded,
  len(extra)::BIGINT AS n_added FROM terms""")
def query_expand(spark, sf):
    c = F.col("question")
    return questions(spark, sf).select("question_id", T.expand_query(c).alias("expanded"), F.size(T.expansion_terms(c)).cast("bigint").alias("n_added"))


@query("query_entities", f"WITH {QUESTIONS_SQL} SELECT question_id, array_to_string({_ENTITIES_DISTINCT}, ', ') AS entities FROM questions")
def query_entities(spark, sf):
    return questions(spark, sf).select("question_id", F.array_join(T.references(F.col("question")), ", ").alias("entities"))


def _class_case(i):
    c = vocab.QUERY_CLASSES
    def v(name):
        x = c[name][i]
        return q(x) if isinstance(x, str) else str(x)
    return (f"CASE WHEN {_any_sql('low', vocab.TECHNICAL_SIGNALS)} OR n > 15 THEN {v('technical')} "
            f"WHEN {_any_sql('low', vocab.PROCEDURAL_SIGNALS)} THEN {v('procedural')} "
            f"WHEN {_any_sql('low', vocab.DEFINITION_SIGNALS)} THEN {v('definitional')} "
            f"WHEN n <= 8 THEN {v('short')} ELSE {v('default')} END")


@query("query_classify", f"""WITH {QUESTIONS_SQL}, f AS (SELECT *, lower(question) AS low, {_WORDS} AS n, {_ENTITIES_DISTINCT} AS ent FROM questions),
c AS (SELECT question_id, {_class_case(0)} AS complexity, {_class_case(1)} AS intent,
  greatest({_class_case(2)}, CASE WHEN len(ent) > 0 THEN 8 ELSE 0 END)::BIGINT AS top_k,
  ({_class_case(3)})::DOUBLE AS min_similarity, {_class_case(4)} AS expansion, ent FROM f)
SELECT question_id, complexity, intent, top_k, min_similarity, expansion,
  'Complexity: ' || complexity || ' | Intent: ' || intent || ' | TopK: ' || top_k || ' | MinSim: ' || min_similarity || ' | Expansion: ' || expansion
  || CASE WHEN len(ent) > 0 THEN ' | Entities: [' || array_to_string(ent, ', ') || ']' ELSE '' END AS description FROM c""")
def query_classify(spark, sf):
    d = questions(spark, sf).withColumn("c", Q.classify(F.col("question")))
    return d.select("question_id", "c.complexity", "c.intent", F.col("c.top_k").cast("bigint").alias("top_k"), "c.min_similarity", "c.expansion",
                    Q.describe(F.col("c")).alias("description"))


_GENERAL = "|".join(f"(?:{p})" for p in vocab.OFF_TOPIC_PATTERNS)
_VAT = "|".join(f"(?:{p})" for p in vocab.VAT_PATTERNS)


@query("query_off_topic", f"""WITH {QUESTIONS_SQL} SELECT question_id,
  CASE WHEN regexp_matches(lower(question), {q(_GENERAL)}) THEN 'programming'
       WHEN regexp_matches(lower(question), {q(_VAT)}) THEN 'vat' ELSE 'on_topic' END AS category FROM questions""")
def query_off_topic(spark, sf):
    return questions(spark, sf).select("question_id", F.coalesce(Q.off_topic(F.col("question")), F.lit("on_topic")).alias("category"))


def _topic_sql(k):
    return f"regexp_matches(low, {q(chr(92) + 'b' + k + chr(92) + 'b')})" if len(k) <= 4 else f"contains(low, {q(k)})"


_TOPICS = "list_filter([" + ", ".join(f"CASE WHEN {_topic_sql(k)} THEN {q(k)} END" for k in vocab.TOPIC_KEYWORDS) + "], lambda x: x IS NOT NULL)"
_CODE = "(" + _any_sql("trim(low)", ["write code", "python", "javascript"]) + r" OR regexp_matches(low, '```[\s\S]*```'))"
_VATQ = "(" + _any_sql("low", ["vat", "value added"]) + " OR (contains(low, '5%') AND NOT contains(low, 'corporate')))"


@query("query_topic_intent", f"""WITH {QUESTIONS_SQL}, f AS (SELECT *, lower(question) AS low, {_PIECES} AS n FROM questions),
t AS (SELECT *, {_TOPICS} AS found FROM f)
SELECT question_id, array_to_string(found, ', ') AS topics,
  CASE WHEN {_CODE} THEN 'off_topic' WHEN {_VATQ} THEN 'out_of_scope' WHEN len(found) > 0 AND n > 2 THEN 'in_scope' ELSE 'undecided' END AS intent,
  CASE WHEN {_CODE} THEN 'programming' WHEN {_VATQ} THEN 'VAT/indirect tax' ELSE found[1] END AS topic
FROM t""")
def query_topic_intent(spark, sf):
    d = computed(questions(spark, sf), "found", Q.topic_keywords(F.col("question")))
    d = computed(d, "s", Q.intent_of(F.col("question"), F.col("found")))
    return d.select("question_id", F.array_join("found", ", ").alias("topics"),
                    F.coalesce("s.intent", F.lit("undecided")).alias("intent"), "s.topic")


def _task_sql():
    hard = _any_sql("low", vocab.COMPLEX_INDICATORS)
    return (f"CASE WHEN {_any_sql('low', vocab.LEGAL_INDICATORS)} OR ({hard} AND n > 30) THEN 'legal_analysis' "
            f"WHEN (n > 20 AND n_sources > 3) OR {hard} OR (n_docs > 1 AND n > 15) THEN 'complex_generation' "
            f"WHEN {_any_sql('low', vocab.SIMPLE_INDICATORS)} OR n < 15 THEN 'simple_generation' "
            f"WHEN confidence > 0.9 THEN 'simple_generation' ELSE 'complex_generation' END")


_TASK_CASE = {i: "CASE task " + " ".join(f"WHEN {q(r[0])} THEN {q(r[i]) if isinstance(r[i], str) else r[i]}" for r in vocab.TASK_CONFIGS) + " END" for i in (1, 2, 3)}


@query("query_route", f"""WITH {QUESTIONS_SQL}, f AS (SELECT *, lower(question) AS low, {_PIECES} AS n, owner % 6 AS n_sources, owner % 3 AS n_docs,
  CASE WHEN owner % 2 = 0 THEN 0.95 ELSE 0.8 END AS confidence, CASE WHEN owner % 5 = 0 THEN 'o3-mini' END AS preferred FROM questions),
t AS (SELECT *, {_task_sql()} AS task FROM f)
SELECT question_id, task, CASE WHEN preferred IS NOT NULL AND task <> 'legal_analysis' THEN preferred ELSE {_TASK_CASE[1]} END AS model,
  ({_TASK_CASE[2]})::DOUBLE AS temperature, ({_TASK_CASE[3]})::BIGINT AS max_tokens,
  (preferred IS NOT NULL AND task <> 'legal_analysis') AS reasoning FROM t""")
def query_route(spark, sf):
    o = F.col("owner")
    d = questions(spark, sf).withColumn("task", Q.task_type(F.col("question"), F.when(o % 2 == 0, 0.95).otherwise(0.8), o % 6, o % 3))
    d = d.withColumn("m", Q.model_for_task(F.col("task"), F.when(o % 5 == 0, F.lit("o3-mini"))))
    return d.select("question_id", "task", "m.model", "m.temperature", F.col("m.max_tokens").cast("bigint").alias("max_tokens"),
                    Q.supports_reasoning(F.col("m.model")).alias("reasoning"))


@query("query_flags", f"""WITH {QUESTIONS_SQL} SELECT question_id,
  {_any_sql('lower(question)', vocab.QUOTE_MARKERS)} AS is_quote,
  {_any_sql('lower(question)', vocab.FOLLOW_UP_MARKERS)} AND length(question) < 100 AS is_follow_up,
  regexp_matches(lower(question), '^(?:{"|".join(vocab.SKIP_PREFIXES)})') AND owner % 2 = 0 AS skips FROM questions""")
def query_flags(spark, sf):
    c = F.col("question")
    return questions(spark, sf).select("question_id", Q.is_quote_request(c).alias("is_quote"), Q.is_follow_up(c).alias("is_follow_up"),
                                       Q.skip_classification(c, F.col("owner") % 2 == 0).alias("skips"))


@query("confidence_gate", """WITH hits AS (SELECT o_custkey AS query_id, count(*) AS n,
  CASE max(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence
  FROM orders GROUP BY 1)
SELECT query_id, (confidence = 'high' AND n >= 1) OR (confidence = 'medium' AND n >= 2) AS proceed,
  CASE WHEN confidence = 'high' AND n >= 1 THEN 'High confidence retrieval with ' || n || ' sources'
       WHEN confidence = 'medium' AND n >= 2 THEN 'Medium confidence retrieval with ' || n || ' sources'
       ELSE 'Insufficient retrieval confidence (' || confidence || ', ' || n || ' sources)' END AS reason FROM hits""")
def confidence_gate(spark, sf):
    from lexloom.plans.common import table
    level = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1)
    hits = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("query_id")).agg(F.count("*").alias("n"), F.max(level).alias("lvl"))
    label = F.when(F.col("lvl") == 3, "high").when(F.col("lvl") == 2, "medium").otherwise("low")
    return hits.withColumn("g", Q.confidence_gate(label, F.col("n"))).select("query_id", "g.proceed", "g.reason")
