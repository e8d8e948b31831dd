"""Queries of this folder over the given tables, with SQL where it can say the same."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lexloom.llm import fingerprint, language_id, line_dedup, near_dedup, packing, quality_rules, sentence_pieces, substring_dedup, toxicity, url_filter
from lexloom.llm import selection_catalog  # noqa: F401
from lexloom.llm.tables import ORACLES, QUERIES, query, table  # noqa: F401

_WORD = r"[^\x20\x09-\x0D]+"
_BLANK = r"[\x20\x09-\x0D]*"


@query("op1_best_fit_packing")
def packing_query(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_line_dedup", sql=f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
filled AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS place FROM lines WHERE regexp_matches(line, '{_WORD}')),
pairs AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS second FROM filled),
later AS (SELECT doc_id, place, row_number() OVER (PARTITION BY line, second ORDER BY doc_id, place) > 1 AS copy FROM pairs WHERE second IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, place + k AS place FROM later, (VALUES (0), (1)) v(k) WHERE copy),
marked AS (SELECT l.doc_id, l.n, l.line, g.doc_id IS NOT NULL AS gone
  FROM lines l LEFT JOIN filled f ON f.doc_id = l.doc_id AND f.n = l.n LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.place = f.place)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def line_dedup_query(spark, sf_dir):
    kept = line_dedup.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op3_sentence_pieces")
def sentence_pieces_query(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sentence_pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    decoded = sentence_pieces.decode(encoded, path)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


@query("op4_minhash_near_dedup", sql=rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
runs AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM runs a JOIN runs b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
arcs AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT a.y, r.root FROM reach r JOIN arcs a ON a.x = r.node),
tops AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
sets AS (SELECT doc_id, md5(array_to_string(list(s ORDER BY s), chr(10))) AS set_id FROM runs GROUP BY doc_id),
firsts AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY set_id) AS class_id FROM sets)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, root AS component_id, d.doc_id = root AS kept, coalesce(class_id, d.doc_id) AS class_id
FROM documents d JOIN tops ON tops.node = d.doc_id LEFT JOIN sizes USING (doc_id) LEFT JOIN firsts USING (doc_id)""")
def near_dedup_query(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 85)


@query("op5_toxicity")
def toxicity_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    network = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    found = toxicity.score(docs, network, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in _RULES)


@query("op6_url_filter", sql=rf"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}),
urls AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
parts AS (SELECT page_id,
  translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
fits AS (SELECT p.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS n
  FROM parts p LEFT JOIN rules r ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path))
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE n = 1""")
def url_filter_query(spark, sf_dir):
    rules = spark.createDataFrame(_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


_SPREAD = ", ".join(
    f"((sum({h} & {fingerprint.LANE}) % 1048576)::BIGINT + ((sum(({h} >> 20) & {fingerprint.LANE}) % 1048576)::BIGINT << 21) + ((sum({h} >> 40) % 1048576)::BIGINT << 42))"
    for h in "ab")
_COUNTS = ", ".join(f"sum(({h} >> {k}) & {fingerprint.ONES})::BIGINT" for h in "ab" for k in range(fingerprint.SHIFTS))
_ZEROS = ", ".join(["0"] * fingerprint.WIDTH)


def _signed(fp: str) -> str:
    return f"flatten(list_transform({fp}[4:], lambda v: [2 * ((v >> s) & {fingerprint.LANE}) - {fp}[1] for s in [0, 21, 42]]))"


@query("op7_fingerprint", sql=rf"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id DESC) AS rid, doc_id, coalesce(text, '') AS text FROM documents),
paired AS (SELECT *, coalesce(lead(text) OVER (ORDER BY rid), first_value(text) OVER (ORDER BY rid)) AS next_text,
  coalesce(lead(rid) OVER (ORDER BY rid), 1) AS next_rid FROM docs),
edited AS (SELECT *, left(text, (length(text) - length(text) // 3)::BIGINT) || left(next_text, (length(text) // 3)::BIGINT) AS edited FROM paired),
texts AS (SELECT rid, 0 AS kind, text FROM docs UNION ALL SELECT rid, 1, edited FROM edited),
pieces AS (SELECT rid, kind, md5(unnest(regexp_extract_all(text, '{fingerprint.PARAGRAPH}'))) AS d FROM texts),
halves AS (SELECT rid, kind, ('0x' || substr(d, 1, 15))::BIGINT AS a, ('0x' || substr(d, 17, 15))::BIGINT AS b FROM pieces),
sums AS (SELECT rid, kind, [count(*)::BIGINT, {_SPREAD}, {_COUNTS}] AS fp FROM halves GROUP BY rid, kind),
lanes AS (SELECT t.rid, t.kind, coalesce(s.fp, [{_ZEROS}]::BIGINT[]) AS fp FROM texts t LEFT JOIN sums s USING (rid, kind)),
signs AS (SELECT *, list_transform({_signed('fp')}, lambda v: v::DOUBLE) AS sg,
  array_to_string(list_transform(fp, lambda v: printf('%016x', v)), '') AS hexed FROM lanes),
scored AS (SELECT e.*, o.hexed, c.hexed AS edited_hexed, o.fp AS ofp, c.fp AS cfp, n.fp AS nfp, o.sg AS osg, c.sg AS csg, n.sg AS nsg
  FROM edited e JOIN signs o ON o.rid = e.rid AND o.kind = 0 JOIN signs c ON c.rid = e.rid AND c.kind = 1 JOIN signs n ON n.rid = e.next_rid AND n.kind = 0)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, hexed AS fingerprint, edited_hexed AS edited_fingerprint,
  CASE WHEN ofp = cfp THEN 1.0::DOUBLE WHEN ofp[1] = 0 OR cfp[1] = 0 THEN 0.0::DOUBLE
    ELSE round(greatest(0.0, least(1.0, list_dot_product(osg, csg) / (sqrt(list_dot_product(osg, osg)) * sqrt(list_dot_product(csg, csg))))), 6)::DOUBLE END AS near_edited,
  CASE WHEN ofp = nfp THEN 1.0::DOUBLE WHEN ofp[1] = 0 OR nfp[1] = 0 THEN 0.0::DOUBLE
    ELSE round(greatest(0.0, least(1.0, list_dot_product(osg, nsg) / (sqrt(list_dot_product(osg, osg)) * sqrt(list_dot_product(nsg, nsg))))), 6)::DOUBLE END AS near_next
FROM scored""")
def fingerprint_query(spark, sf_dir):
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query("op8_language_id")
def language_id_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    content = language_id.fit(docs.where(~held_out).select("text", "lang"))
    found = language_id.predict(docs, content)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query("op9_quality_rules", sql=rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '{_WORD}') AS ws FROM docs)),
threes AS (SELECT rid, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
found AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w2, w3) AS n FROM threes WHERE w3 IS NOT NULL),
covered AS (SELECT DISTINCT rid, i + k AS i FROM found, (VALUES (0), (1), (2)) v(k) WHERE n > 1),
repeats AS (SELECT rid, count(*) AS n_repeat_words FROM covered GROUP BY rid),
counts AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars FROM words GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '{_WORD}') GROUP BY rid),
base AS (SELECT doc_id, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN counts USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN repeats USING (rid)),
judged AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed)::DOUBLE AS bad FROM judged GROUP BY source),
moments AS (SELECT avg(bad / n) AS mean, var_pop(bad / n) AS spread, avg(1 / n) AS noise FROM hosts),
prior AS (SELECT mean, CASE WHEN mean * (1 - mean) > 0 THEN greatest(mean * (1 - mean) / greatest(spread - mean * (1 - mean) * noise, mean * (1 - mean) * 1e-6) - 1, 0) ELSE 0 END AS weight FROM moments),
rates AS (SELECT source, (bad + mean * weight) / (n + weight) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT rate > {quality_rules.MAX_HOST_RATE} AS kept, round(rate, 6) AS host_rate
FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source""")
def quality_rules_query(spark, sf_dir):
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.withColumn("host_rate", F.round("host_rate", 6))


@query("op10_substring_dedup", sql=rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h FROM docs WHERE len(w) >= 50),
later AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(50) t(k)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
kept AS (SELECT doc_id, count(*) FILTER (WHERE g.i IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE g.i IS NULL) AS text
  FROM words LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)""")
def substring_dedup_query(spark, sf_dir):
    kept = substring_dedup.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"), plain=True)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
