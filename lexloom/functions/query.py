"""Query understanding as Column expressions: class, topic, route, follow-up."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexloom import vocab
from lexloom.functions import scoring, text as T


def _signals(low: Column, words: list[str], word_boundary: bool) -> Column:
    """One of the signals is in the lower-cased text; as substring unless ``word_boundary``."""
    if word_boundary:
        return low.rlike("|".join(T.whole_word(w) for w in words))
    return T.contains_any(low, words)


def classify(query: Column, word_boundary: bool = False) -> Column:
    """Struct complexity, intent, entities, top_k, min_similarity, expansion.

    Signals match as substrings ("form" also in "performance"); ``word_boundary`` matches words.
    """
    low, n = F.lower(query), T.word_count(query)

    def cls(name):
        complexity, intent, k, sim, expansion = vocab.QUERY_CLASSES[name]
        return F.struct(F.lit(complexity).alias("complexity"), F.lit(intent).alias("intent"), F.lit(k).alias("top_k"),
                        F.lit(sim).alias("min_similarity"), F.lit(expansion).alias("expansion"))

    base = scoring.first_of([
        (_signals(low, vocab.TECHNICAL_SIGNALS, word_boundary) | (n > 15), cls("technical")),
        (_signals(low, vocab.PROCEDURAL_SIGNALS, word_boundary), cls("procedural")),
        (_signals(low, vocab.DEFINITION_SIGNALS, word_boundary), cls("definitional")),
        (n <= 8, cls("short")),
    ], cls("default"))
    def boosted(pair):
        cls_, found = pair["cls"], pair["entities"]
        k = F.when(F.size(found) > 0, F.greatest(cls_["top_k"], F.lit(8))).otherwise(cls_["top_k"])
        return F.struct(cls_["complexity"].alias("complexity"), cls_["intent"].alias("intent"), k.alias("top_k"),
                        cls_["min_similarity"].alias("min_similarity"), cls_["expansion"].alias("expansion"), found.alias("entities"))

    return T.let(F.struct(base.alias("cls"), T.references(query).alias("entities")), boosted)


def describe(cls: Column) -> Column:
    """One line for a classification."""
    parts = [
        F.concat(F.lit("Complexity: "), cls["complexity"]),
        F.concat(F.lit("Intent: "), cls["intent"]),
        F.concat(F.lit("TopK: "), cls["top_k"].cast("string")),
        F.concat(F.lit("MinSim: "), cls["min_similarity"].cast("string")),
        F.concat(F.lit("Expansion: "), cls["expansion"]),
        F.when(F.size(cls["entities"]) > 0, F.concat(F.lit("Entities: ["), F.array_join(cls["entities"], ", "), F.lit("]"))),
    ]
    return F.concat_ws(" | ", *parts)


def off_topic(query: Column) -> Column:
    """'programming' (every general pattern), 'vat', or null for a query to answer."""
    low = F.lower(query)
    general = "|".join(f"(?:{p})" for p in vocab.OFF_TOPIC_PATTERNS)
    vat = T.ascii_boundaries("|".join(f"(?:{p})" for p in vocab.VAT_PATTERNS))
    return F.when(low.rlike(general), F.lit("programming")).when(low.rlike(vat), F.lit("vat"))


def topic_keywords(query: Column) -> Column:
    """Topic words found, in list order; words of up to four characters as whole words only."""
    low = F.lower(query)
    short = {k for k in vocab.TOPIC_KEYWORDS if len(k) <= 4}

    def hits(words):
        found = [F.when(F.array_contains(words, k) if k in short else low.contains(k), F.lit(k)) for k in vocab.TOPIC_KEYWORDS]
        return F.filter(F.array(*found), lambda k: k.isNotNull())

    return T.let(T.ascii_words(low), hits)


_INTENT = "struct<intent:string,confidence:double,action:string,topic:string>"


def _intent(intent, confidence, action, topic) -> Column:
    values = [intent, confidence, action, topic]
    cols = [v if isinstance(v, Column) else F.lit(v) for v in values]
    return F.struct(*[c.alias(n) for c, n in zip(cols, ["intent", "confidence", "action", "topic"])]).cast(_INTENT)


def _rules(query: Column, found: Column) -> Column:
    low, first = F.lower(T.trim_ws(query)), F.try_element_at(found, F.lit(1))
    code = T.contains_any(low, ["write code", "python", "javascript"]) | low.rlike(r"```[\s\S]*```")
    vat = T.contains_any(low, ["vat", "value added"]) | (low.contains("5%") & ~low.contains("corporate"))
    return scoring.first_of([
        (code, _intent("off_topic", 0.95, "decline", "programming")),
        (vat, _intent("out_of_scope", 0.9, "decline", "VAT/indirect tax")),
        ((F.size(found) > 0) & (T.split_count(query) > 2), _intent("in_scope", 0.85, "proceed", first)),
    ], _intent(None, None, None, first))


def intent_stage(query: Column) -> Column:
    """Struct intent, confidence, action, topic of the rule stages; intent null when a model must decide."""
    return T.let(topic_keywords(query), lambda found: intent_of(query, found))


def intent_of(query: Column, found: Column) -> Column:
    """``intent_stage`` for topic words that are worked out already."""
    return _rules(query, found)


def intent_with_model(query: Column, model: Column) -> Column:
    """Rule stages first, then the model's struct of the same shape; null model = failed call.

    A model asking for clarification is overruled for four or more words with a topic hit.
    """
    def decide(found):
        rules, likely = _rules(query, found), F.size(found) > 0
        overruled = (model["intent"] == "clarification") & likely & (T.split_count(query) >= 4)
        return scoring.first_of([
            (rules["intent"].isNotNull(), rules),
            (model.isNull(), _intent("in_scope", F.when(likely, 0.6).otherwise(0.3), "proceed", None)),
            (overruled, _intent("in_scope", 0.75, "proceed", F.coalesce(model["topic"], F.try_element_at(found, F.lit(1))))),
        ], _intent(F.coalesce(model["intent"], F.lit("in_scope")), F.coalesce(model["confidence"], F.lit(0.5)),
                   F.coalesce(model["action"], F.lit("proceed")), model["topic"]))
    return T.let(topic_keywords(query), decide)


def decline_text(template: Column, prompt: Column, default_prompt: str) -> Column:
    """A decline template with its clarification placeholder filled."""
    return F.replace(template, F.lit("{clarificationPrompt}"), F.coalesce(F.nullif(prompt, F.lit("")), F.lit(default_prompt)))


def skip_classification(query: Column, has_history: Column) -> Column:
    low = F.lower(query)
    starts = low.rlike("^(?:" + "|".join(vocab.SKIP_PREFIXES) + ")")
    return starts & has_history


def is_quote_request(query: Column) -> Column:
    return T.contains_any(F.lower(query), vocab.QUOTE_MARKERS)


def is_follow_up(query: Column, word_boundary: bool = False) -> Column:
    """Short and holding a follow-up marker (as substring: "it" matches widely)."""
    return _signals(F.lower(query), vocab.FOLLOW_UP_MARKERS, word_boundary) & (F.length(query) < 100)


def context_entities(context: Column) -> Column:
    """Distinct articles, concepts and decree names of earlier messages, in that order."""
    articles = F.transform(F.regexp_extract_all(context, F.lit(r"(?i)Article\s+(\d+)"), F.lit(1)), lambda n: F.concat(F.lit("Article "), n))
    low = F.lower(context)
    concepts = F.filter(
        F.array(*[F.when(low.contains(c.lower()), F.lit(c)) for c in vocab.CONTEXT_CONCEPTS]), lambda c: c.isNotNull())
    decrees = F.regexp_extract_all(context, F.lit(r"(?i)Federal\s+Decree[- ]Law(?:\s+No\.?)?\s*(\d+)?"), F.lit(0))
    return F.array_distinct(F.concat(articles, concepts, decrees))


def enrich_query(query: Column, context: Column) -> Column:
    """``Regarding a, b, c: query`` from up to three entities of the context."""
    found = context_entities(context)
    prefix = F.concat(F.lit("Regarding "), F.array_join(F.slice(found, 1, 3), ", "), F.lit(": "))
    return F.when(F.size(found) > 0, F.concat(prefix, query)).otherwise(query)


def task_type(query: Column, confidence: Column, source_count: Column, document_count: Column) -> Column:
    """legal_analysis, complex_generation or simple_generation."""
    low, n = F.lower(query), T.split_count(query)
    hard = T.contains_any(low, vocab.COMPLEX_INDICATORS)
    return scoring.first_of([
        (T.contains_any(low, vocab.LEGAL_INDICATORS) | (hard & (n > 30)), F.lit("legal_analysis")),
        (((n > 20) & (source_count > 3)) | hard | ((document_count > 1) & (n > 15)), F.lit("complex_generation")),
        (T.contains_any(low, vocab.SIMPLE_INDICATORS) | (n < 15), F.lit("simple_generation")),
        (confidence > 0.9, F.lit("simple_generation")),
    ], F.lit("complex_generation"))


def model_for_task(task: Column, preferred: Column, allow_override: bool = True) -> Column:
    """Struct model, temperature, max_tokens; a user's choice is overruled for legal analysis."""
    def config(row):
        return F.struct(F.lit(row[1]).alias("model"), F.lit(row[2]).alias("temperature"), F.lit(row[3]).alias("max_tokens"))
    chosen = scoring.first_of([(task == r[0], config(r)) for r in vocab.TASK_CONFIGS], F.lit(None))
    if not allow_override:
        return chosen
    keep = preferred.isNotNull() & (task != "legal_analysis")
    return chosen.withField("model", F.when(keep, preferred).otherwise(chosen["model"]))


def supports_reasoning(model: Column) -> Column:
    return model.rlike("^(?:" + "|".join(vocab.REASONING_PREFIXES) + ")")


def confidence_gate(confidence: Column, source_count: Column) -> Column:
    """Struct proceed, reason. High needs one source, medium two, low never passes."""
    n = source_count.cast("string")
    passed = ((confidence == "high") & (source_count >= 1)) | ((confidence == "medium") & (source_count >= 2))
    declined = (confidence == "low") | (source_count < 2)
    label = F.initcap(confidence)
    return scoring.first_of([
        (passed, F.struct(F.lit(True).alias("proceed"), F.concat(label, F.lit(" confidence retrieval with "), n, F.lit(" sources")).alias("reason"))),
        (declined, F.struct(F.lit(False).alias("proceed"), F.concat(F.lit("Insufficient retrieval confidence ("), confidence, F.lit(", "), n, F.lit(" sources)")).alias("reason"))),
    ], F.struct(F.lit(True).alias("proceed"), F.concat(F.lit("Proceeding with "), confidence, F.lit(" confidence, "), n, F.lit(" sources")).alias("reason")))
