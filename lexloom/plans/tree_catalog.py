"""Catalogue: section trees.

The table of contents is region / nation / customer, one document per market segment:
structures "1", "1.2", "1.2.3". Every seventh nation has no row of its own, so its
customers have no parent. Pages are the documents, dealt out to the segments.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from lexloom import vocab
from lexloom.operators import ordered, tree as R
from lexloom.plans.common import query, sql_list, sql_tokens, table, texts
from lexloom.plans.index_flow import build_index
from lexloom.plans.search_catalog import _TERMS
from lexloom.session import checkpoint

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def toc(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")) \
        .select(F.col("c_mktsegment").alias("document_id"), F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n"), F.col("c_custkey").alias("c"))
    one = F.lit(None).cast("bigint")
    rows = c.unionByName(c.select("document_id", "r", "n").distinct().where(F.col("n") % 7 != 3).withColumn("c", one)) \
        .unionByName(c.select("document_id", "r").distinct().withColumn("n", one.cast("int")).withColumn("c", one))
    # nulls order first, so a parent comes before its children
    rows = ordered.row_index(rows, ["document_id"], ["r", "n", "c"], "pos", F.col("r"))
    structure = F.concat_ws(".", (F.col("r") + 1).cast("string"), (F.col("n") + 1).cast("string"), F.col("c").cast("string"))
    title = F.coalesce(F.concat(F.lit("Customer "), "c"), F.concat(F.lit("Nation "), "n"), F.concat(F.lit("Region "), "r"))
    return rows.select("document_id", "pos", structure.alias("structure"), title.alias("title"),
                       (F.floor(F.col("pos") / 3) + 1).cast("int").alias("physical_index"), F.when(F.col("pos") % 2 == 0, "yes").otherwise("no").alias("appear_start"))


TOC = """base AS (SELECT c_mktsegment AS document_id, n_regionkey AS r, n_nationkey AS n, c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey),
lines AS (SELECT * FROM base UNION ALL SELECT DISTINCT document_id, r, n, NULL FROM base WHERE n % 7 <> 3 UNION ALL SELECT DISTINCT document_id, r, NULL, NULL FROM base),
toc AS (SELECT document_id, pos, concat_ws('.', r + 1, n + 1, c) AS structure, coalesce('Customer ' || c, 'Nation ' || n, 'Region ' || r) AS title,
  pos // 3 + 1 AS physical_index, CASE WHEN pos % 2 = 0 THEN 'yes' ELSE 'no' END AS appear_start
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY r, n NULLS FIRST, c NULLS FIRST) - 1 AS pos FROM lines)),
ends AS (SELECT document_id, max(physical_index) + 1 AS last_page FROM toc GROUP BY 1),
ranges AS (SELECT t.*, physical_index AS start_index, coalesce(lead(CASE WHEN appear_start = 'yes' THEN physical_index - 1 ELSE physical_index END) OVER (PARTITION BY t.document_id ORDER BY pos), last_page) AS end_index
  FROM toc t JOIN ends USING (document_id)),
par AS (SELECT c.document_id, c.pos, max(p.pos) AS parent_pos FROM toc c JOIN toc p ON p.document_id = c.document_id AND p.structure = regexp_extract(c.structure, '^(.*)\\.[^.]*$', 1) AND p.pos < c.pos GROUP BY 1, 2)"""
TREE = f"""RECURSIVE {TOC},
nd AS (SELECT r.*, parent_pos FROM ranges r LEFT JOIN par USING (document_id, pos)),
tr AS (SELECT document_id, pos, title, start_index, end_index, [pos] AS path, title AS crumb FROM nd WHERE parent_pos IS NULL
  UNION ALL SELECT n.document_id, n.pos, n.title, n.start_index, n.end_index, list_append(t.path, n.pos), t.crumb || ' > ' || n.title FROM nd n JOIN tr t ON n.document_id = t.document_id AND n.parent_pos = t.pos),
num AS (SELECT *, printf('%04d', row_number() OVER (PARTITION BY document_id ORDER BY path) - 1) AS node_id FROM tr)"""
PAGES = f"pg AS (SELECT {_SEGMENTS}[(doc_id % 5 + 1)::INT] AS document_id, doc_id // 5 + 1 AS page_number, text FROM documents)"


def ends(rows):
    return rows.groupBy("document_id").agg((F.max("physical_index") + 1).alias("last_page"))


def pages(spark, sf):
    d = texts(spark, sf, "documents")
    seg = F.element_at(F.array(*[F.lit(s) for s in _SEGMENTS]), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select(seg.alias("document_id"), (F.floor(F.col("doc_id") / 5) + 1).cast("int").alias("page_number"), "text", F.ceil(F.length("text") / 4).alias("token_count"))


def nodes(spark, sf):
    t = toc(spark, sf)
    return R.number_nodes(R.build_tree(t, ends(t)))


def _big(df, *cols):
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


@query("tree_ranges", f"WITH {TOC} SELECT document_id, pos, title, start_index, end_index FROM ranges")
def tree_ranges(spark, sf):
    t = toc(spark, sf)
    return _big(R.section_ranges(t, ends(t)).select("document_id", "pos", "title", "start_index", "end_index"), "start_index", "end_index")


@query("tree_parent", f"WITH {TOC} SELECT t.document_id, t.pos, parent_pos FROM toc t LEFT JOIN par USING (document_id, pos)")
def tree_parent(spark, sf):
    return R.parents(toc(spark, sf)).select("document_id", "pos", "parent_pos")


@query("tree_number", f"WITH {TREE} SELECT a.document_id, a.node_id, b.node_id AS parent_id, a.title, (len(a.path) - 1)::BIGINT AS depth FROM num a LEFT JOIN num b ON a.document_id = b.document_id AND b.path = a.path[1:-2]")
def tree_number(spark, sf):
    return _big(nodes(spark, sf).select("document_id", "node_id", "parent_id", "title", "depth"), "depth")


@query("tree_breadcrumb", f"WITH {TREE} SELECT document_id, node_id, crumb AS section_path FROM num")
def tree_breadcrumb(spark, sf):
    return R.breadcrumbs(nodes(spark, sf)).select("document_id", "node_id", "section_path")


@query("tree_text", f"""WITH {TREE}, {PAGES} SELECT n.document_id, node_id, md5(coalesce(string_agg(text || chr(10), '' ORDER BY page_number), '')) AS digest
FROM num n LEFT JOIN pg ON pg.document_id = n.document_id AND page_number BETWEEN start_index AND end_index GROUP BY 1, 2""")
def tree_text(spark, sf):
    return R.node_texts(nodes(spark, sf), pages(spark, sf)).select("document_id", "node_id", F.md5("text").alias("digest"))


@query("tree_simplified", f"""WITH {TREE}, k AS (SELECT document_id, path[1] AS root, string_agg(title, '; ' ORDER BY path) AS children FROM num WHERE len(path) = 2 GROUP BY 1, 2)
SELECT n.document_id, node_id, title, start_index || '-' || end_index AS pages, CASE WHEN len(path) = 1 THEN children END AS children FROM num n LEFT JOIN k ON k.document_id = n.document_id AND root = path[1]""")
def tree_simplified(spark, sf):
    return R.simplified(nodes(spark, sf)).withColumn("children", F.array_join("children", "; "))


@query("tree_large_nodes", f"""WITH {TREE}, {PAGES} SELECT n.document_id, node_id, sum(ceil(length(text) / 4))::BIGINT AS n_tokens FROM num n JOIN pg ON pg.document_id = n.document_id AND page_number BETWEEN start_index AND end_index
WHERE end_index - start_index > 0 GROUP BY 1, 2 HAVING sum(ceil(length(text) / 4)) >= 900""")
def tree_large_nodes(spark, sf):
    n, p = nodes(spark, sf), pages(spark, sf)
    return R.large_nodes(n, p, 0, 900).select("document_id", "node_id", "n_tokens")


@query("toc_offset", """WITH p AS (SELECT l_suppkey AS document_id, l_linenumber AS page, l_linenumber + CASE WHEN l_returnflag = 'R' THEN -1 ELSE (l_quantity::BIGINT % 4) END AS physical_index FROM lineitem),
c AS (SELECT document_id, physical_index - page AS "offset", count(*) AS n FROM p GROUP BY 1, 2)
SELECT document_id, "offset", n FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, "offset" < 0, "offset") AS k FROM c) WHERE k = 1""")
def toc_offset(spark, sf):
    shift = F.when(F.col("l_returnflag") == "R", F.lit(-1).cast("bigint")).otherwise(F.col("l_quantity").cast("bigint") % 4)
    p = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("document_id"), F.col("l_linenumber").alias("page"), (F.col("l_linenumber") + shift).alias("physical_index"))
    return R.page_offsets(p)


@query("toc_physical", f"""WITH {TOC}, {PAGES}, t AS (SELECT document_id, pos, title, physical_index AS page FROM toc),
x AS (SELECT document_id, title, min(physical_index) + 4 AS physical_index FROM toc WHERE pos % 3 <> 1 GROUP BY 1, 2 UNION ALL SELECT document_id, title, min(physical_index) + 6 FROM toc WHERE pos % 3 = 1 GROUP BY 1, 2),
f AS (SELECT document_id, title, arg_min(page, pos) AS page FROM t GROUP BY 1, 2),
c AS (SELECT document_id, x.physical_index - f.page AS o, count(*) AS n FROM x JOIN f USING (document_id, title) WHERE x.physical_index > 2 GROUP BY 1, 2),
b AS (SELECT document_id, arg_max(o, n) AS o FROM c GROUP BY 1),
np AS (SELECT document_id, max(page_number) AS n_pages FROM pg GROUP BY 1)
SELECT t.document_id, pos, page + o AS physical_index FROM t JOIN b USING (document_id) JOIN np USING (document_id) WHERE page + o BETWEEN 1 AND n_pages""")
def toc_physical(spark, sf):
    t = toc(spark, sf)
    moved = t.select("document_id", "title", (F.col("physical_index") + F.when(F.col("pos") % 3 == 1, 6).otherwise(4)).alias("physical_index"))
    after = t.select("document_id").distinct().withColumn("last_toc_page", F.lit(2))
    rows = R.add_physical_indices(t.select("document_id", "pos", "title", F.col("physical_index").alias("page")), moved, after)
    n = pages(spark, sf).groupBy("document_id").agg(F.max("page_number").alias("n_pages"))
    return _big(R.valid_rows(rows, n).select("document_id", "pos", "physical_index"), "physical_index")


@query("toc_repair_neighbours", """WITH o AS (SELECT o_custkey AS document_id, o_orderkey AS pos, (floor(o_totalprice)::BIGINT % 500) + 1 AS physical_index, o_orderstatus <> 'F' AS is_correct FROM orders),
w AS (SELECT *, last_value(CASE WHEN is_correct THEN physical_index END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
  first_value(CASE WHEN is_correct THEN physical_index END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM o)
SELECT document_id, pos, coalesce(a, 1) AS prev_correct, coalesce(b, 500) AS next_correct FROM w WHERE NOT is_correct""")
def toc_repair_neighbours(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("pos"),
                                          (F.floor("o_totalprice") % 500 + 1).alias("physical_index"), (F.col("o_orderstatus") != "F").alias("is_correct"))
    bounds = o.select("document_id").distinct().withColumns({"first_page": F.lit(1).cast("bigint"), "last_page": F.lit(500).cast("bigint")})
    return R.correct_neighbours(o, bounds).select("document_id", "pos", "prev_correct", "next_correct")


@query("toc_pages", f"""WITH {PAGES}, f AS (SELECT document_id, page_number FROM pg WHERE page_number <= 20 AND length(text) < 1800),
g AS (SELECT *, page_number - row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS island FROM f)
SELECT document_id, page_number FROM g WHERE island = (SELECT min(island) FROM g h WHERE h.document_id = g.document_id)""")
def toc_pages(spark, sf):
    return _big(R.toc_pages(pages(spark, sf), F.length("text") < 1800), "page_number")


_N = r"lower(regexp_replace(regexp_replace(regexp_replace({t}, '[\s\x{{00a0}}]+', ' ', 'g'), '[^A-Za-z0-9_\s]', '', 'g'), '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g'))"


@query("toc_verify", f"""WITH {PAGES}, b AS (SELECT {_SEGMENTS}[(item_id % 5 + 1)::INT] AS document_id, item_id AS pos, substring(text, 1, 12) AS title, item_id % 40 + 1 AS physical_index FROM benchmark),
d AS (SELECT document_id, 1000 + page_number AS pos, substring(text, 1, 12) AS title, CASE WHEN page_number % 4 = 0 THEN page_number + 1 ELSE page_number END AS physical_index FROM pg),
v AS (SELECT t.*, coalesce(contains({_N.format(t='pg.text')}, {_N.format(t='t.title')}), false) AS is_correct FROM (SELECT * FROM b UNION ALL SELECT * FROM d) t LEFT JOIN pg ON pg.document_id = t.document_id AND page_number = physical_index),
a AS (SELECT document_id, round(avg(is_correct::INT), 6) AS accuracy FROM v GROUP BY 1)
SELECT document_id, pos, is_correct, accuracy, CASE WHEN accuracy >= 1 THEN 'accept' WHEN accuracy >= 0.6 THEN 'repair' ELSE 'regenerate' END AS plan FROM v JOIN a USING (document_id)""")
def toc_verify(spark, sf):
    p = pages(spark, sf)
    v = R.verify_rows(_titles(spark, sf, p), p)
    acc = R.toc_accuracy(v).withColumn("accuracy", F.round("accuracy", 6))
    return v.join(acc, "document_id").select("document_id", "pos", "is_correct", "accuracy", "plan")


def _titles(spark, sf, p):
    """Heads of benchmark texts on arbitrary pages, and heads of pages, every fourth one page off."""
    seg = F.element_at(F.array(*[F.lit(s) for s in _SEGMENTS]), (F.col("item_id") % 5 + 1).cast("int"))
    b = table(spark, sf, "benchmark").select(seg.alias("document_id"), F.col("item_id").alias("pos"), F.substring("text", 1, 12).alias("title"), (F.col("item_id") % 40 + 1).cast("int").alias("physical_index"))
    n = F.col("page_number")
    return b.unionByName(p.select("document_id", (n + 1000).cast("bigint").alias("pos"), F.substring("text", 1, 12).alias("title"), F.when(n % 4 == 0, n + 1).otherwise(n).alias("physical_index")))


def _repair_round(i: int) -> str:
    """One round of repair: (document_id, pos, title, physical_index, is_correct) of v{i} into v{i + 1}."""
    return f"""w{i} AS (SELECT *, coalesce(last_value(CASE WHEN is_correct THEN physical_index END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS a,
  coalesce(first_value(CASE WHEN is_correct THEN physical_index END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), hi) AS b FROM v{i} JOIN bounds USING (document_id)),
f{i} AS (SELECT w.document_id, w.pos, min(page_number) AS fixed FROM w{i} w JOIN pn ON pn.document_id = w.document_id AND page_number BETWEEN a AND b AND contains(page, tt) WHERE NOT is_correct GROUP BY 1, 2),
v{i + 1} AS (SELECT v.document_id, v.pos, v.tt, coalesce(fixed, v.physical_index) AS physical_index, v.is_correct OR fixed IS NOT NULL AS is_correct FROM v{i} v LEFT JOIN f{i} f ON f.document_id = v.document_id AND f.pos = v.pos)"""


@query("toc_repair", f"""WITH {PAGES}, pn AS (SELECT document_id, page_number, {_N.format(t='text')} AS page FROM pg), bounds AS (SELECT document_id, min(page_number) AS lo, max(page_number) AS hi FROM pg GROUP BY 1),
d AS (SELECT document_id, 1000 + page_number AS pos, {_N.format(t='substring(text, 1, 12)')} AS tt, CASE WHEN page_number % 4 = 0 THEN page_number + 1 ELSE page_number END AS physical_index FROM pg),
v0 AS (SELECT d.document_id, d.pos, d.tt, d.physical_index, coalesce(contains(page, tt), false) AS is_correct FROM d LEFT JOIN pn ON pn.document_id = d.document_id AND page_number = physical_index),
{_repair_round(0)}, {_repair_round(1)}, {_repair_round(2)}
SELECT document_id, pos, physical_index, is_correct FROM v3""")
def toc_repair(spark, sf):
    """Titles one page off move back between their correct neighbours."""
    p = pages(spark, sf)
    v = R.verify_rows(_titles(spark, sf, p).where(F.col("pos") >= 1000), p)
    bounds = p.groupBy("document_id").agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"))
    return _big(R.repair_rows(v, p, bounds), "physical_index").select("document_id", "pos", "physical_index", "is_correct")


@query("toc_preface", """WITH t AS (SELECT source AS document_id, doc_id AS pos, doc_id // 20 + doc_id % 3 + 1 AS physical_index, substring(text, 1, 20) AS title FROM documents),
f AS (SELECT document_id, min(pos) - 1 AS pos, arg_min(physical_index, pos) AS p FROM t GROUP BY 1)
SELECT document_id, pos, title, physical_index FROM t UNION ALL SELECT document_id, pos, 'Preface', 1 FROM f WHERE p > 1""")
def toc_preface(spark, sf):
    i = F.col("doc_id")
    t = texts(spark, sf, "documents").select(F.col("source").alias("document_id"), i.alias("pos"), F.substring("text", 1, 20).alias("title"), (F.floor(i / 20) + i % 3 + 1).alias("physical_index"))
    return _big(R.add_preface(t).select("document_id", "pos", "title", "physical_index"), "physical_index")


# pages with a heading line each, as documents without contents pages; headings that no page checks would stand off are none here
_HEADED = f"""hp AS (SELECT document_id, page_number, CASE WHEN page_number % 4 = 1 THEN ((page_number - 1) // 4 + 1) || ' Part at page ' || page_number || chr(10)
  ELSE ((page_number - 1) // 4 + 1) || '.' || page_number || ' Section of page ' || page_number || chr(10) END || text AS text FROM pg),
ln AS (SELECT document_id, page_number, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM hp),
hd AS (SELECT document_id, page_number, i, regexp_extract(l, '^\\s*(\\d+(?:\\.\\d+)*)\\.?\\s+(\\S.*)$', 1) AS structure, trim(regexp_extract(l, '^\\s*(\\d+(?:\\.\\d+)*)\\.?\\s+(\\S.*)$', 2)) AS title FROM ln),
toc AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, i) - 1 AS pos, structure, title, page_number AS physical_index,
  {_N.format(t='title')} AS tt FROM hd WHERE structure <> ''),
ends AS (SELECT document_id, max(page_number) AS last_page FROM pg GROUP BY 1),
flagged AS (SELECT toc.*, starts_with({_N.format(t='hp.text')}, tt) AS opens FROM toc JOIN hp ON hp.document_id = toc.document_id AND hp.page_number = toc.physical_index),
ranges AS (SELECT f.*, physical_index AS start_index, coalesce(lead(CASE WHEN opens THEN physical_index - 1 ELSE physical_index END) OVER (PARTITION BY f.document_id ORDER BY pos), last_page) AS end_index FROM flagged f JOIN ends USING (document_id)),
par AS (SELECT c.document_id, c.pos, max(p.pos) AS parent_pos FROM toc c JOIN toc p ON p.document_id = c.document_id AND p.structure = regexp_extract(c.structure, '^(.*)\\.[^.]*$', 1) AND p.pos < c.pos GROUP BY 1, 2),
nd AS (SELECT r.*, parent_pos FROM ranges r LEFT JOIN par USING (document_id, pos)),
tr AS (SELECT document_id, pos, title, start_index, end_index, [pos] AS path FROM nd WHERE parent_pos IS NULL
  UNION ALL SELECT n.document_id, n.pos, n.title, n.start_index, n.end_index, list_append(t.path, n.pos) FROM nd n JOIN tr t ON n.document_id = t.document_id AND n.parent_pos = t.pos),
num AS (SELECT *, printf('%04d', row_number() OVER (PARTITION BY document_id ORDER BY path) - 1) AS node_id FROM tr),
tx AS (SELECT n.document_id, node_id, coalesce(string_agg(hp.text || chr(10), '' ORDER BY page_number), '') AS text FROM num n LEFT JOIN hp ON hp.document_id = n.document_id AND page_number BETWEEN start_index AND end_index GROUP BY 1, 2)"""


@query("tree_build_index", f"""WITH RECURSIVE {PAGES}, {_HEADED} SELECT a.document_id, a.node_id, b.node_id AS parent_id, a.title, a.start_index, a.end_index, md5(text) AS digest
FROM num a JOIN tx ON tx.document_id = a.document_id AND tx.node_id = a.node_id LEFT JOIN num b ON a.document_id = b.document_id AND b.path = a.path[1:-2]""")
def tree_build_index(spark, sf):
    """Whole build over pages with page numbers as headings, since the texts have none."""
    p = pages(spark, sf)
    number = F.col("page_number").cast("string")
    head = F.concat(F.floor((F.col("page_number") - 1) / 4 + 1).cast("string"), F.lit("."), number, F.lit(" Section of page "), number, F.lit("\n"))
    head = F.when(F.col("page_number") % 4 == 1, F.concat(F.floor((F.col("page_number") - 1) / 4 + 1).cast("string"), F.lit(" Part at page "), number, F.lit("\n"))).otherwise(head)
    out = build_index(p.withColumn("text", F.concat(head, "text")))
    return _big(out, "start_index", "end_index").select("document_id", "node_id", "parent_id", "title", "start_index", "end_index", F.md5("text").alias("digest"))


_SECTIONS = f"""RECURSIVE {TOC},
{TREE[len("RECURSIVE ") + len(TOC) + 2:]}, {PAGES},
qt AS (SELECT item_id AS query_id, text AS question, {_TERMS} AS t FROM benchmark), ask AS (SELECT query_id, len(t) AS n_terms, unnest(t) AS term FROM qt),
np AS (SELECT n.document_id, node_id, any_value(title) AS title, any_value(crumb) AS crumb, any_value(start_index) AS a, any_value(end_index) AS b, string_agg(text || chr(10), '' ORDER BY page_number) AS text
  FROM num n LEFT JOIN pg ON pg.document_id = n.document_id AND page_number BETWEEN start_index AND end_index GROUP BY 1, 2),
nw AS (SELECT document_id, node_id, {sql_tokens("title || ' ' || coalesce(text, '')")} AS w FROM np), st AS (SELECT count(*) AS n, avg(len(w)) AS al FROM nw),
tf AS (SELECT document_id, node_id, dl, term, count(*) AS tf FROM (SELECT document_id, node_id, len(w) AS dl, unnest(w) AS term FROM nw) WHERE term IN (SELECT term FROM ask) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT query_id, document_id, node_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 6) AS score, count(*) AS n_hit, max(n_terms) AS n_terms
  FROM ask JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2, 3)"""
_LEVEL = "CASE WHEN n_hit / n_terms >= 0.75 THEN 'high' WHEN n_hit / n_terms >= 0.4 THEN 'medium' ELSE 'low' END"


def _section_questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _sources(df):
    return _big(df.drop("text"), "rank", "page_start", "page_end")


@query("section_retrieval", f"""WITH {_SECTIONS},
sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, node_id) AS pos FROM sc) WHERE pos <= 5),
dp AS (SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, document_id) AS document_pos FROM sel GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_pos, pos) AS rank FROM sel JOIN dp USING (query_id, document_id))
SELECT query_id, rank, document_id, node_id, title, crumb AS section_path, a AS page_start, b AS page_end, {_LEVEL} AS confidence FROM k JOIN np USING (document_id, node_id) WHERE rank <= 5""")
def section_retrieval(spark, sf):
    """Best sections of the region / nation / customer trees for every benchmark text."""
    n, p = checkpoint(nodes(spark, sf), "nodes"), pages(spark, sf)
    return _sources(R.retrieve_from_trees(R.select_sections(_section_questions(spark, sf), n, p, 5), n, p))


_ARRIVAL = f"""ar AS (SELECT item_id AS query_id, {_SEGMENTS}[((item_id + 3 * d) % 5 + 1)::INT] AS document_id, d + 1 AS document_pos FROM benchmark, range(0, 3) r(d))"""


def _arrival(spark, sf):
    """Three documents a question may use, in the order they came."""
    seg = F.array(*[F.lit(x) for x in _SEGMENTS])
    d = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda d: F.struct(F.get(seg, ((F.col("item_id") + 3 * d) % 5).cast("int")).alias("document_id"), (d + 1).alias("document_pos")))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.inline(d))


@query("section_retrieval_allowed", f"""WITH {_SECTIONS}, {_ARRIVAL},
sel AS (SELECT * FROM (SELECT sc.*, document_pos, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, node_id) AS pos FROM sc JOIN ar USING (query_id, document_id)) WHERE pos <= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_pos, pos) AS rank FROM sel)
SELECT query_id, rank, document_id, node_id, title, crumb AS section_path, a AS page_start, b AS page_end, {_LEVEL} AS confidence FROM k JOIN np USING (document_id, node_id) WHERE rank <= 5""")
def section_retrieval_allowed(spark, sf):
    """Sections of the documents each question may use only, documents in the order they came, two sections each."""
    n, p, a = checkpoint(nodes(spark, sf), "nodes"), pages(spark, sf), _arrival(spark, sf)
    return _sources(R.retrieve_from_trees(R.select_sections(_section_questions(spark, sf), n, p, 2, a), n, p, 2, 5, a))


_RT = rf"list_filter(regexp_split_to_array(lower(question), '[^A-Za-z0-9_]+'), lambda w: length(w) > 2 AND NOT list_contains({sql_list(vocab.RERANK_STOP_WORDS)}, w))"


@query("section_retrieval_reranked", f"""WITH {_SECTIONS}, {_ARRIVAL},
sel AS (SELECT * FROM (SELECT sc.*, document_pos, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, node_id) AS pos FROM sc JOIN ar USING (query_id, document_id)) WHERE pos <= 3),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_pos, pos) AS arrived, count(*) OVER (PARTITION BY query_id) AS n_sources FROM sel JOIN np USING (document_id, node_id) JOIN qt USING (query_id)),
w AS (SELECT *, lower(title || ' ' || crumb || ' ' || coalesce(k.text, '')) AS body, {_RT} AS rt FROM k),
v AS (SELECT *, regexp_split_to_array(body, '[^A-Za-z0-9_]+') AS words FROM w),
x AS (SELECT *, round(coalesce(list_sum(list_transform(rt, lambda t: len(list_filter(words, lambda y: y = t)))), 0) / sqrt(length(body)), 9) AS rescore FROM v),
o AS (SELECT *, CASE WHEN n_sources <= 5 THEN arrived ELSE row_number() OVER (PARTITION BY query_id ORDER BY rescore DESC, arrived) END AS rank FROM x)
SELECT query_id, rank, document_id, node_id, title, crumb AS section_path, a AS page_start, b AS page_end, {_LEVEL} AS confidence FROM o WHERE rank <= 5""")
def section_retrieval_reranked(spark, sf):
    """Three sections of each of a question's documents, the best five by its words."""
    n, p, a, qs = checkpoint(nodes(spark, sf), "nodes"), pages(spark, sf), _arrival(spark, sf), _section_questions(spark, sf)
    return _sources(R.retrieve_from_trees(R.select_sections(qs, n, p, 3, a), n, p, 3, 5, a, qs))
