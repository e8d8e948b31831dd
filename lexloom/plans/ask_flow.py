"""Questions to checked answers, for a whole table of questions at once."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexloom.functions import citations as C, query as Q
from lexloom.operators import context as X, infer, prefilter as P, tree as R
from lexloom.session import checkpoint

PROMPT = "Answer from the numbered sources and cite them as [n].\n\n{context}\n\nQuestion: {question}"


def answer_questions(questions: DataFrame, documents: DataFrame, nodes: DataFrame, make_client, prompt: str = PROMPT,
                     max_docs: int = 3, per_document: int = 5, max_sources: int = 5, concurrency: int | None = None) -> DataFrame:
    """query_id, route, question, answer, n_sources, n_cited, grounding, quality of every question.

    questions: owner, query_id, question, context (earlier messages, may be null);
    documents: owner, document_id, pos, name, description; nodes: numbered nodes with text.
    Off-topic questions leave at once and weak retrievals before the model is called.
    """
    asked = questions.withColumn("route", Q.off_topic(F.col("question")))
    plain = F.col("question")
    enriched = F.when(Q.is_follow_up(plain) & F.col("context").isNotNull(), Q.enrich_query(plain, F.coalesce("context", F.lit("")))).otherwise(plain)
    live = asked.where(F.col("route").isNull()).withColumn("question", enriched)
    chosen = P.prefilter_documents(live.select("owner", "query_id", "question"), documents, max_docs)
    selected = checkpoint(R.select_by_terms(live, nodes, per_document, chosen), "selected-sections")
    sources = checkpoint(R.retrieve_sections(selected, nodes, per_document, max_sources), "sources")

    level = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    found = sources.groupBy("query_id").agg(F.max(level).alias("__l"), F.count(F.lit(1)).alias("n_sources"))
    gated = live.join(found, "query_id", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0).cast("bigint")))
    name = F.when(F.col("__l") == 3, "high").when(F.col("__l") == 2, "medium").otherwise("low")
    gated = gated.withColumn("gate", Q.confidence_gate(name, F.col("n_sources")))
    blocks = X.context_blocks(sources.withColumn("content", F.col("text")).withColumn("summary", F.lit(None).cast("string")), max_sources)
    ready = gated.where("gate.proceed").drop("context").join(blocks, "query_id") \
        .withColumn("prompt", infer.fill_template(prompt, context=F.col("context"), question=F.col("question")))
    # kept, so that no later step asks the model again
    replied = checkpoint(infer.batch_infer(ready.select("query_id", "question", "n_sources", "prompt"), "prompt", "raw", make_client, concurrency=concurrency), "replies")

    raw, n = F.col("raw"), F.col("n_sources")
    cited = F.size(F.filter(C.cited_numbers(raw), lambda c: (c >= 1) & (c <= n)))
    done = replied.where(raw.isNotNull()).select(
        "query_id", "question", C.renumber_by_source(raw, n).alias("answer"), "n_sources", cited.alias("n_cited"), C.grounding(cited).alias("grounding"),
        C.quality_score(F.col("question"), raw, n)["score"].alias("quality"), F.lit("answered").alias("route"))
    failed = replied.where(raw.isNull()).select("query_id", "question", "n_sources", F.lit("model_failed").alias("route"))
    declined = gated.where(~F.col("gate.proceed")).select("query_id", "question", "n_sources", F.lit("low_confidence").alias("route"))
    off = asked.where(F.col("route").isNotNull()).select("query_id", "question", "route")
    out = done
    for part in (failed, declined, off):
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select("query_id", "route", "question", "answer", "n_sources", "n_cited", "grounding", "quality")
