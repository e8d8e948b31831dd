"""Column expressions over text: normalising, keywords, references, snippets.

Whitespace is ``[\\s\\u00a0]`` and word characters are ASCII; lengths count code points.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from lexloom import vocab

WS = r"[\s\u00a0]+"
WORD = r"[\p{L}\p{N}]+"
MARK = "\ue000"  # private-use character marking cut points inside a text


def _words_isin(words: list[str]):
    return lambda w: w.isin(*words)


def ascii_boundaries(pattern: str) -> str:
    """The pattern with every ``\\b`` as a boundary of ASCII word characters."""
    word = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")


def whole_word(word: str) -> str:
    """Regex for the literal word between word boundaries."""
    escaped = "".join(c if c.isalnum() or c in " -'&" else "\\" + c for c in word)
    return ascii_boundaries(rf"\b{escaped}\b")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_words(text: Column) -> Column:
    """Runs of ASCII word characters of a lower-cased text."""
    return F.regexp_extract_all(text, F.lit(r"[a-z0-9_]+"), F.lit(0))


def contains_any(text: Column, needles: list[str]) -> Column:
    """True when the text holds one of the literal needles."""
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}|{WS}$", "")


def collapse_ws(text: Column) -> Column:
    return trim_ws(F.regexp_replace(text, WS, " "))


def word_count(text: Column) -> Column:
    """Non-blank words."""
    return F.size(F.filter(F.split(text, WS), lambda w: w != ""))


def split_count(text: Column) -> Column:
    """Pieces of a whitespace split, a leading or trailing blank piece included."""
    return F.size(F.split(text, WS, -1))


# ---------------------------------------------------------------- query text

def normalize_query(text: Column) -> Column:
    """Lower case, typo fixes, abbreviation expansion, single spaces.

    No correction or expansion contains another entry as a whole word, so one look-up per
    word gives what replacing entry by entry gives. The one entry with a symbol is replaced last.
    """
    words = {k: v for k, v in vocab.TYPOS + vocab.ABBREVIATIONS if k.isalnum()}
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    pieces = F.regexp_extract_all(trim_ws(F.lower(text)), F.lit(r"[a-z0-9_]+|[^a-z0-9_]+"), F.lit(0))
    out = F.array_join(F.transform(pieces, lambda w: F.when(w.isin(*words), F.element_at(table, w)).otherwise(w)), "")
    for key, value in vocab.ABBREVIATIONS:
        if not key.isalnum():
            out = F.regexp_replace(out, whole_word(key), value)
    return collapse_ws(out)


def keywords(text: Column) -> Column:
    """Words longer than two characters that are no stop words."""
    stop = _words_isin(vocab.SEARCH_STOP_WORDS)
    return F.filter(F.split(F.lower(text), WS), lambda w: (F.length(w) > 2) & ~stop(w))


def search_string(text: Column) -> Column:
    """``a | b | c`` of the normalised query's keywords; the query itself without any."""
    return let(keywords(normalize_query(text)), lambda ws: F.when(F.size(ws) == 0, text).otherwise(F.array_join(ws, " | ")))


def _expansion_of(norm: Column, phrases: bool) -> Column:
    def crossed(word, other):
        return F.transform(F.regexp_extract_all(norm, F.lit(rf"{word}\s+(\d+)"), F.lit(1)), lambda n: F.concat(F.lit(other + " "), n))
    found = F.filter(keywords(norm), lambda w: w.isin(*vocab.SYNONYMS))
    if phrases:
        multi = [k for k in vocab.SYNONYMS if " " in k]
        found = F.concat(F.filter(F.array(*[F.lit(k) for k in multi]), lambda k: norm.contains(k)), found)
    flat = []
    for word, syn in vocab.SYNONYMS.items():
        flat += [F.lit(word), F.array(*[F.lit(s) for s in syn[:2]])]
    table = F.create_map(*flat)
    synonyms = F.flatten(F.transform(F.slice(found, 1, 3), lambda w: F.try_element_at(table, w)))
    return F.concat(crossed("chapter", "Article"), crossed("article", "Chapter"), synonyms)


def expansion_terms(text: Column, phrases: bool = False) -> Column:
    """Terms an expanded query gains.

    Every synonym list has at least two entries and adding stops once five were added,
    so the rule comes down to two synonyms for each of the first three keywords found.
    Look-up is per single word; ``phrases=True`` also finds the multi-word entries.
    """
    return let(normalize_query(text), lambda norm: _expansion_of(norm, phrases))


def expand_query(text: Column, phrases: bool = False) -> Column:
    def build(norm):
        return F.concat_ws(" ", norm, F.nullif(F.array_join(_expansion_of(norm, phrases), " "), F.lit("")))
    return let(normalize_query(text), build)


def references(text: Column) -> Column:
    """Distinct Article / Chapter / Section / Decree / Decision references, by kind."""
    def of_kind(label, pattern):
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: F.concat(F.lit(label), n))
    return F.array_distinct(F.concat(*[of_kind(*row) for row in vocab.ENTITY_PATTERNS]))


def legal_structure(text: Column) -> Column:
    """First article, chapter and clause number of a chunk; null when absent."""
    def first(pattern):
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.struct(
        first(r"(?i)Article\s+\(?(\d+)\)?").alias("article_number"),
        first(r"(?i)Chapter\s+\(?(\d+)\)?").alias("chapter_number"),
        first(r"(?i)(?:Clause|Section)\s+(\d+(?:\.\d+)*)").alias("clause_number"),
    )


def context_header(title: Column, article: Column, section: Column) -> Column:
    """``title > Article n > Section m``; absent parts are left out."""
    return F.concat_ws(" > ", title, F.concat(F.lit("Article "), article), F.concat(F.lit("Section "), section))


# ---------------------------------------------------------------- tokens, trigrams

def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def search_terms(text: Column) -> Column:
    """Distinct tokens without stop words and without one- and two-letter tokens."""
    stop = _words_isin(vocab.SEARCH_STOP_WORDS)
    return F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) > 2) & ~stop(w)))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each token padded with two blanks before and one after.

    Tokens are set three blanks apart and every position is read with a look-ahead; the
    windows across two tokens ("c  " and three blanks) do not match.
    """
    padded = F.concat(F.lit("  "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "   "), F.lit(" "))
    return F.array_distinct(F.regexp_extract_all(padded, F.lit(r"(?=(  \S| \S.|\S\S.))"), F.lit(1)))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared share of two trigram sets."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def truncate(text: Column, limit: int) -> Column:
    """First ``limit`` characters: the input limit of a model."""
    return F.substring(text, 1, limit)


# ---------------------------------------------------------------- html, toc text

def strip_html(html: Column) -> Column:
    """Tags become blanks, blanks collapse; script and style bodies stay."""
    return collapse_ws(F.regexp_replace(html, "<[^>]*>", " "))


def plain_dot_leaders(text: Column) -> Column:
    """Dot leaders of a table of contents become a colon."""
    return F.regexp_replace(F.regexp_replace(text, r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


def page_tag_number(text: Column) -> Column:
    """Page number of ``physical_index_N`` or of a leading plain integer."""
    tagged = F.regexp_extract(text, r"physical_index_(\d+)", 1)
    plain = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.coalesce(F.nullif(tagged, F.lit("")).try_cast("int"), F.nullif(plain, F.lit("")).try_cast("int"))


def labelled_page(number: Column, text: Column) -> Column:
    tag = F.concat(F.lit("<physical_index_"), number.cast("string"), F.lit(">\n"))
    return F.concat(tag, text, F.lit("\n"), tag, F.lit("\n"))


# ---------------------------------------------------------------- snippets, locating

def preview(text: Column, limit: int, ellipsis: bool = True) -> Column:
    head = F.substring(text, 1, limit)
    return F.concat(head, F.when(F.length(text) > limit, F.lit("...")).otherwise(F.lit(""))) if ellipsis else head


def match_snippet(text: Column, query: Column, limit: int = 150, around: int = 50) -> Column:
    """Text around the first match, ellipses where cut; the head when nothing matches."""
    at = F.instr(F.lower(text), F.lower(query))
    start = F.greatest(F.lit(1), at - around)
    stop = F.least(F.length(text), at - 1 + F.length(query) + around)
    cut = F.concat(
        F.when(start > 1, F.lit("...")).otherwise(F.lit("")),
        F.substring(text, start, stop - start + 1),
        F.when(stop < F.length(text), F.lit("...")).otherwise(F.lit("")),
    )
    return F.when((F.coalesce(query, F.lit("")) == "") | (at == 0), preview(text, limit)).otherwise(cut)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def match_parts(text: Column, query: Column, limit: int = 300) -> Column:
    """Array of (is_match, text) covering the previewed text."""
    shown = preview(text, limit)
    cut = F.split(F.regexp_replace(shown, F.concat(F.lit("(?iu)"), _quoted(query)), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    parts = F.transform(cut, lambda t, i: F.struct((i % 2 == 1).alias("is_match"), t.alias("text")))
    whole = F.array(F.struct(F.lit(False).alias("is_match"), shown.alias("text")))
    return F.when(F.coalesce(query, F.lit("")) == "", whole).otherwise(F.filter(parts, lambda p: p["text"] != ""))


def normalize_match(text: Column) -> Column:
    """Single blanks, no punctuation, lower case: the form passages are compared in."""
    return F.lower(trim_ws(F.regexp_replace(F.regexp_replace(text, WS, " "), r"[^\w\s]", "")))


def strip_list_marks(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?i)^(i{1,3}|iv|v|vi{0,3}|ix|x{1,3}|[a-z]|[0-9]+)\s+", "")
    return trim_ws(F.regexp_replace(out, r"^[\d.)\]]+\s*", ""))


# the search uses at most this many leading characters of a passage by definition
PASSAGE_CHARS = 300


def _attempts(target: Column) -> list[tuple[str, Column, Column | None, Column | None]]:
    """(strategy, phrase, length of the hit, condition) from strict to lenient; fixed phrases have no length of their own."""
    clean = strip_list_marks(target)
    clean_words = F.split(clean, " ")

    def head(text, n):
        return F.substring(text, 1, n)

    def stretched(phrase, factor, most):
        return F.least(F.length(phrase) * factor, most if isinstance(most, Column) else F.lit(most))

    key_phrase = F.array_join(F.slice(F.filter(F.split(target, " "), lambda w: F.length(w) > 4), 1, 5), " ")
    middle = F.array_join(F.slice(clean_words, 6, 10), " ")
    solid = F.filter(clean_words, lambda w: F.length(w) > 3)
    calc = trim_ws(F.regexp_replace(F.regexp_replace(clean, r"(?i)^[\d\s%x=aed.,()+-]+", ""), r"(?i)^(the\s+)?portion\s+of\s+", ""))
    cleaned = clean != target
    runs = []
    for i in range(1, 11):
        run = F.array_join(F.slice(solid, i, F.lit(4)), " ")
        runs.append(("word_run", run, stretched(run, 3, 150), (F.size(solid) - 3 >= i) & (F.length(run) > 15)))
    return [
        ("full", target, F.length(target), None),
        ("head150", head(target, 150), F.length(head(target, 150)), None),
        ("head80", head(target, 80), F.length(head(target, 80)), None),
        ("head40", head(target, 40), stretched(head(target, 40), 3, F.length(target)), None),
        ("key_phrase", key_phrase, stretched(key_phrase, 2, 200), F.length(key_phrase) > 20),
        ("clean200", head(clean, 200), F.least(F.lit(200), F.length(clean)), cleaned),
        ("clean80", head(clean, 80), stretched(head(clean, 80), 2, 150), cleaned),
        ("clean40", head(clean, 40), stretched(head(clean, 40), 3, 150), cleaned),
        ("middle", middle, stretched(middle, 2, 200), (F.size(clean_words) > 10) & (F.length(middle) > 30)),
        *runs,
        ("calc", head(calc, 60), stretched(head(calc, 60), 2, 150), F.length(calc) > 30),
        *[("distinctive", F.lit(p), None, clean.contains(p)) for p in vocab.DISTINCTIVE_PHRASES],
    ]


def passage_attempts(target: Column) -> Column:
    """Array of (step, strategy, phrase, n): what the attempts look for, steps from strict to lenient.

    ``n`` is the length of the hit, null where it depends on the page; attempts that do not
    apply, or whose phrase is empty, are left out.
    """
    rows = []
    for step, (name, phrase, n, allowed) in enumerate(_attempts(target)):
        n = F.lit(None).cast("int") if n is None else n.cast("int")
        rows.append(F.when((F.lit(True) if allowed is None else allowed) & (phrase != ""), F.struct(
            F.lit(step).alias("step"), F.lit(name).alias("strategy"), phrase.alias("phrase"), n.alias("n"))))
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def locate_normalized(target: Column, full: Column, empty: bool = True) -> Column:
    """``locate_passage`` of texts in normalised form; without ``empty`` an empty phrase hits nothing."""
    def attempt(name, phrase, length, allowed):
        at = F.instr(full, phrase)
        ok = at > 0 if allowed is None else allowed & (at > 0)
        length = F.least(F.lit(100), F.length(full) - at + 1) if length is None else length
        return F.when(ok if empty else ok & (phrase != ""), F.struct((at - 1).cast("int").alias("start"), length.cast("int").alias("len"), F.lit(name).alias("strategy")))
    return F.coalesce(*[attempt(*a) for a in _attempts(target)])


def locate_passage(passage: Column, page: Column) -> Column:
    """(start, len, strategy) of a passage in a page, in normalised text, start from 0.

    Attempts run from strict to lenient and the first that hits wins; null without a hit.
    """
    return locate_normalized(F.substring(normalize_match(passage), 1, PASSAGE_CHARS), normalize_match(page))


# ---------------------------------------------------------------- model replies

def repair_json(reply: Column) -> Column:
    """JSON text of a model reply: fence stripped, None -> null, trailing commas dropped."""
    body = F.when(reply.contains("```json"), F.regexp_extract(reply, r"(?s)```json(.*)```", 1)) \
        .when(reply.contains("```"), F.regexp_extract(reply, r"(?s)```(.*)```", 1)).otherwise(reply)
    out = F.regexp_replace(trim_ws(body), "None", "null")
    out = F.regexp_replace(out, r"[\n\r]", " ")
    out = F.regexp_replace(out, r",\s*\]", "]")
    return F.regexp_replace(out, r",\s*\}", "}")


def parse_reply(reply: Column) -> Column:
    """The reply as VARIANT; an empty object when it cannot be parsed."""
    return F.coalesce(F.try_parse_json(repair_json(reply)), F.parse_json(F.lit("{}")))


def json_array_in(reply: Column, element: str = "string") -> Column:
    """The JSON array found inside free text; null when there is none."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\[.*\]", 0), F.lit("")), f"array<{element}>")
