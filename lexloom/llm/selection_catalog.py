"""Queries that mix, rank and share: op11 to op13, with their SQL."""
from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.llm import conversation_trie, mixing, ranked_search
from lexloom.llm.tables import query, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GOOD, _BAD = 2.0, 0.5  # sampling weight of documents labelled good or bad; others have 1


@query("op11_source_mixing", sql=rf"""
WITH marks AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (SELECT row_number() OVER () AS rid, d.doc_id, d.source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}'))::BIGINT AS size,
  CASE m.quality WHEN 1 THEN {_GOOD}::DOUBLE WHEN 0 THEN {_BAD}::DOUBLE ELSE 1.0::DOUBLE END AS quality,
  (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370498.0::DOUBLE AS u
  FROM documents d LEFT JOIN marks m ON m.doc_id = d.doc_id),
sources AS (SELECT source, sum(size)::BIGINT AS n, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM docs GROUP BY source),
filling AS (SELECT *, coalesce(sum(3 * n) OVER before, 0)::BIGINT AS capped, (sum(w) OVER from_here)::BIGINT AS open, (SELECT sum(size) FROM docs)::BIGINT AS total
  FROM sources WINDOW before AS (ORDER BY n / w::DOUBLE, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    from_here AS (ORDER BY n / w::DOUBLE, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT total - capped AS rest, open FROM filling WHERE (3 * n)::DOUBLE * open >= (total - capped)::DOUBLE * w ORDER BY n / w::DOUBLE, source LIMIT 1),
targets AS (SELECT source, n, least((3 * n)::DOUBLE, (rest * w)::DOUBLE / open) AS target FROM sources, level),
goals AS (SELECT *, CASE WHEN n > 0 THEN floor(target)::BIGINT // n ELSE 0 END AS epochs, floor(target)::BIGINT AS goal FROM targets),
placed AS (SELECT d.*, g.n, g.target, g.epochs, g.goal - g.epochs * g.n AS budget,
  (sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / quality, doc_id, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS before
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, n AS source_size, target, quality, epochs::BIGINT AS epochs, (epochs * size + least(size, greatest(0, budget - before)))::BIGINT AS taken FROM placed""")
def source_mixing_query(spark, sf_dir):
    quality = F.when(F.max("quality") == 1, _GOOD).when(F.max("quality") == 0, _BAD).otherwise(1.0)
    marks = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").groupBy("doc_id").agg(quality.alias("quality"))
    return mixing.mix(table(spark, sf_dir, "documents"), keep=("doc_id", "source"), marks=marks)


@query("op12_ranked_search", sql=rf"""
WITH terms AS (SELECT rid, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM (SELECT row_number() OVER () AS rid, text FROM documents)),
ids AS (SELECT row_number() OVER () AS rid, doc_id FROM documents),
lengths AS (SELECT rid, count(*)::BIGINT AS n FROM terms GROUP BY rid),
whole AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM lengths),
damped AS (SELECT rid, 50 + ((50 * n * nd) // nt) AS m FROM lengths, whole),
counts AS (SELECT rid, term, count(*)::BIGINT AS tf FROM terms GROUP BY rid, term),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, whole GROUP BY term, nd),
items AS (SELECT row_number() OVER () AS iid, item_id, text FROM benchmark),
asked AS (SELECT DISTINCT iid, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM items),
scored AS (SELECT iid, item_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN damped USING (rid) GROUP BY iid, item_id, rid),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored JOIN ids USING (rid) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {ranked_search.K}""")
def ranked_search_query(spark, sf_dir):
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 of the bytes of a decimal number: eight shifts a byte, 3988292384 is the polynomial.
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), "
        "lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), "
        "lambda c, z: xor(c >> 1, 3988292384 * (c & 1)) + z)), 4294967295::BIGINT)")


@query("op13_conversation_trie", sql=rf"""
WITH turns AS (SELECT conv_id, list({{'d': md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 'b': strlen(coalesce(text, ''))::BIGINT}}
    ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT *, ({_CRC} % 9)::BIGINT AS h FROM turns),
paths AS (SELECT c.conv_id, list_concat(coalesce(b.ts[1:c.h], []), c.ts[c.h + 1:]) AS ts FROM heads c LEFT JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % 5),
member AS (SELECT conv_id, len(ts) AS n, unnest(range(0, len(ts) + 1)) AS depth, ts FROM paths),
keyed AS (SELECT conv_id, n, depth, CASE WHEN depth > 0 THEN ts[depth].b ELSE 0 END AS bytes,
  md5(array_to_string(list_transform(ts[1:depth], lambda t: t.d), ',')) AS node, CASE WHEN depth > 0 THEN md5(array_to_string(list_transform(ts[1:depth - 1], lambda t: t.d), ',')) END AS above FROM member),
nodes AS (SELECT depth, node, above, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs, max(bytes) AS bytes,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends FROM keyed GROUP BY depth, node, above),
shaped AS (SELECT p.*, (SELECT count(*) FROM nodes c WHERE c.depth = p.depth + 1 AND c.above = p.node)::BIGINT AS n_children FROM nodes p),
below AS (SELECT k.depth, k.node, sum((s.n_convs - 1) * s.bytes)::BIGINT AS saved, count(*) FILTER (WHERE s.n_children = 0)::BIGINT AS n_leaves
  FROM shaped s JOIN keyed k ON k.conv_id = s.conv_id AND k.depth <= s.depth GROUP BY k.depth, k.node)
SELECT s.conv_id, s.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, s.n_convs, s.n_children, b.n_leaves, b.saved AS saved_tokens, s.ends AS ends_sha256
FROM shaped s JOIN below b ON b.depth = s.depth AND b.node = s.node LEFT JOIN nodes p ON p.depth = s.depth - 1 AND p.node = s.above""")
def conversation_trie_query(spark, sf_dir):
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))
