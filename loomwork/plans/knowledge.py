"""Queries about texts, the graph, search, resolution, grounding and populations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import text as ft
from loomwork.functions import values as fv
from loomwork.operators import chunking, feed, graph, grounding, influence, memory, population, quotes, report, resolve, search
from loomwork.plans.registry import query
from loomwork.plans.views import Run

# ---- names, identifiers and other texts ----------------------------------------------------------------------------

_TITLED = "titled AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Dr. ' WHEN 1 THEN 'The Hon. ' WHEN 2 THEN '' WHEN 3 THEN 'Cllr ' ELSE 'a ' END || replace(c_name, '#', ' ') || CASE c_custkey % 3 WHEN 0 THEN ' Jr.' WHEN 1 THEN ', PhD' ELSE '' END AS name FROM customer)"
_BARE = r"trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9_\s]+', ' ', 'g'), '\s+', ' ', 'g')), '^((" + "|".join(ft.HONORIFICS + ft.ARTICLES) + r")( |$))+', ''), '((^| )(" + "|".join(ft.SUFFIXES) + r"))+$', ''))"


def _nested(views: list[str], rest: str) -> str:
    return "SELECT * FROM (WITH " + ",\n".join(views) + "\n" + rest + ") q"


def titled(run: Run) -> DataFrame:
    return run.table("customer").select("c_custkey", F.expr("concat(case c_custkey % 5 when 0 then 'Dr. ' when 1 then 'The Hon. ' when 2 then '' when 3 then 'Cllr ' else 'a ' end, replace(c_name, '#', ' '), case c_custkey % 3 when 0 then ' Jr.' when 1 then ', PhD' else '' end)").alias("name"))


@query(_nested([_TITLED], f"SELECT c_custkey, name, {_BARE} AS normalised FROM titled"))
def fnt3_normalised_names(run: Run) -> DataFrame:
    return titled(run).withColumn("normalised", ft.normalised_name(F.col("name")))


@query("""SELECT p_partkey, list_reduce(list_prepend('', list_transform(list_filter(string_split(regexp_replace(p_name || ' ' || p_type, '[^0-9A-Za-z]+', ' ', 'g'), ' '), lambda p: p <> ''), lambda p: upper(substr(p, 1, 1)) || substr(p, 2))), lambda a, b: a || b) AS pascal,
upper(replace(trim(regexp_replace(p_name || ' ' || p_type, '[^0-9A-Za-z]+', ' ', 'g')), ' ', '_')) AS snake FROM part""")
def fnt13_identifiers(run: Run) -> DataFrame:
    name = F.concat_ws(" ", "p_name", "p_type")
    return run.table("part").select("p_partkey", ft.identifier(name).alias("pascal"), ft.identifier(name, upper_first=False).alias("snake"))


@query(r"SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(trim(p_name || ' -- ' || p_brand)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 24) AS handle, substr(trim(regexp_replace(p_name || '   ' || p_type, '\s+', ' ', 'g')), 1, 20) AS short FROM part")
def fnt16_handles(run: Run) -> DataFrame:
    return run.table("part").select("p_partkey", ft.slug(F.concat_ws(" -- ", "p_name", "p_brand"), "wire").alias("handle"), ft.collapsed(F.concat_ws("   ", "p_name", "p_type"), 20).alias("short"))


_REFERENCES = f"refs AS (SELECT o_orderkey, unnest([{{'kind': 'post', 'value': CAST(o_orderkey * 3 AS VARCHAR)}}, {{'kind': 'agent', 'value': CAST(o_custkey AS VARCHAR)}}, {{'kind': 'round', 'value': CAST(o_orderkey % 40 AS VARCHAR)}}, {{'kind': 'agent', 'value': CAST(o_custkey % 200 AS VARCHAR)}}, {{'kind': 'username', 'value': 'agent_' || (o_custkey % 200)}}]) AS r FROM orders)"


def claims(run: Run) -> DataFrame:
    """Sentences that refer to posts, agents, rounds and handles, some of which there are."""
    return run.table("orders").select(F.concat(F.lit("finding "), F.col("o_orderkey") % 9, F.lit("[0]")).alias("where"), "o_orderkey", F.expr("concat('As post #', o_orderkey * 3, ' and user ', o_custkey, ' say in round ', o_orderkey % 40, ', @agent_', o_custkey % 200, ' agrees')").alias("text"))


@query(_nested([_REFERENCES], "SELECT r.kind AS kind, count(*) AS n, count(DISTINCT r.value) AS different FROM refs GROUP BY 1"))
def fnt12_references(run: Run) -> DataFrame:
    found = claims(run).select(F.explode(ft.references(F.col("text"))).alias("r"))
    return found.groupBy("r.kind").agg(F.count("*").alias("n"), F.countDistinct("r.value").alias("different"))


def _facts(run: Run) -> DataFrame:
    who = feed.identities(run.profiles, run.users)
    return grounding.facts(run.table("orders").select("o_orderkey"), who.select("user_id"), run.ledger.select("round"), who.select("username"))


_FACTS = "facts AS (SELECT 'post' AS kind, CAST(o_orderkey AS VARCHAR) AS value FROM orders UNION SELECT 'agent', CAST(user_id AS VARCHAR) FROM identities UNION SELECT 'round', CAST(round AS VARCHAR) FROM ledger UNION SELECT 'username', lower(username) FROM identities)"


@query(_nested([_FACTS], "SELECT kind, count(*) AS n FROM facts GROUP BY kind"))
def agg17_run_facts(run: Run) -> DataFrame:
    return _facts(run).groupBy("kind").agg(F.count("*").alias("n"))


def _checked(run: Run) -> DataFrame:
    return grounding.resolved(grounding.in_prose(claims(run)), _facts(run))


@query(_nested([_REFERENCES, _FACTS], "SELECT count(*) AS checked, count(f.value) AS resolved, count(*) - count(f.value) AS unresolved FROM refs LEFT JOIN facts f ON f.kind = r.kind AND f.value = r.value"))
def agg22_grounding_counters(run: Run) -> DataFrame:
    return grounding.counters(_checked(run))


@query(_nested([_REFERENCES, _FACTS], "SELECT 'finding ' || (o_orderkey % 9) AS section, count(*) AS n FROM refs LEFT JOIN facts f ON f.kind = r.kind AND f.value = r.value WHERE f.value IS NULL GROUP BY 1"))
def agg16_unresolved_by_section(run: Run) -> DataFrame:
    return grounding.unresolved_by_section(_checked(run))


@query(_nested([_FACTS], """SELECT kind, count(*) AS n, count(*) FILTER (WHERE known) AS resolved FROM (SELECT c.kind, f.value IS NOT NULL AS known FROM (SELECT 'post' AS kind, CAST(unnest([o_orderkey, o_orderkey * 2]) AS VARCHAR) AS value FROM orders UNION ALL SELECT 'round', CAST(o_orderkey % 50 AS VARCHAR) FROM orders) c
LEFT JOIN facts f ON f.kind = c.kind AND f.value = c.value) k GROUP BY kind"""))
def join10_citations(run: Run) -> DataFrame:
    cites = run.table("orders").select(F.lit("claims[0]").alias("where"), F.array("o_orderkey", F.col("o_orderkey") * 2).alias("post_ids"), F.lit(None).cast("array<bigint>").alias("agent_ids"), F.array((F.col("o_orderkey") % 50).cast("long")).alias("rounds"))
    return grounding.resolved(grounding.cited(cites), _facts(run)).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("resolved").alias("resolved"))


@query("SELECT o_orderkey, 'posts ' || o_orderkey || ', ' || (o_orderkey + 1) || CASE WHEN o_custkey % 2 = 0 THEN '; agent ' || o_custkey ELSE '' END || '; round ' || (o_orderkey % 30) AS line FROM orders")
def prj12_evidence_lines(run: Run) -> DataFrame:
    line = report.evidence_line(F.array("o_orderkey", F.col("o_orderkey") + 1), F.when(F.col("o_custkey") % 2 == 0, F.array("o_custkey")).otherwise(F.expr("array()").cast("array<bigint>")), F.array(F.col("o_orderkey") % 30))
    return run.table("orders").select("o_orderkey", line.alias("line"))


@query("SELECT o_custkey, count(*) AS posts, len(list_filter([CASE WHEN count(DISTINCT o_orderkey % 30) < 20 THEN 'a' END, CASE WHEN count(DISTINCT o_orderkey % 7) < 5 THEN 'b' END, CASE WHEN count(*) < 20 THEN 'c' END, CASE WHEN count(*) % 3 > 0 THEN 'd' END], lambda x: x IS NOT NULL)) AS caveats FROM orders GROUP BY o_custkey")
def prj9_caveats(run: Run) -> DataFrame:
    by = run.table("orders").groupBy("o_custkey").agg(F.count("*").alias("posts"), F.countDistinct(F.col("o_orderkey") % 30).alias("a"), F.countDistinct(F.col("o_orderkey") % 7).alias("r"))
    return by.select("o_custkey", "posts", F.size(report.scale_caveats(F.col("a"), F.col("r"), F.col("posts"), F.col("posts") % 3)).cast("long").alias("caveats"))


@query()
def fnt2_markdown_pages(run: Run) -> DataFrame:
    """Pages as if they were Markdown: tags, addresses and rules go."""
    return run.table("pages").select("page_id", ft.normalised_markdown(F.col("html")).alias("prose"))


#: What counts as blank, as a class of RE2; marks that the SQL sets where a sentence may end, and where a paragraph does.
_BLANK = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MAY_END, _PART = "chr(57344)", "chr(57345)"
_MARKS = r"[.!?]+[\"'')\]’”]*"
_SENTENCES = [
    rf"marked AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(text, '(\n[ \t]*\n)', {_MAY_END} || {_PART} || '\1', 'g'), '({_MARKS})({_BLANK})', '\1' || {_MAY_END} || '\2', 'g'), {_MAY_END}) AS p FROM documents WHERE text <> '')",
    "split AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k FROM marked)",
    f"pieces AS (SELECT doc_id, k, ltrim(piece, {_PART}) AS body, lead(piece) OVER (PARTITION BY doc_id ORDER BY k) AS onward FROM split)",
    rf"looked AS (SELECT *, regexp_replace(body, '{_MARKS}$', '') AS stem, regexp_replace(onward, '^{_BLANK}+', '') AS rest FROM pieces)",
    "worded AS (SELECT *, ltrim(regexp_extract(right(stem, 64), '[A-Za-z0-9]*$'), '0123456789') AS word FROM looked)",
    rf"""ended AS (SELECT doc_id, k, body, CASE WHEN starts_with(onward, {_PART}) THEN 1
  WHEN lower(word) IN ({", ".join(f"'{w}'" for w in sorted(chunking.ABBREVIATIONS))}) OR regexp_full_match(word, '[A-Z]') THEN 0
  WHEN regexp_matches(stem, '\p{{Nd}}$') AND regexp_matches(onward, '^{_BLANK}\p{{Nd}}') THEN 0 WHEN regexp_matches(rest, '^[\p{{Ll}}ªº]') THEN 0 ELSE 1 END AS parts FROM worded)""",
    "placed AS (SELECT *, coalesce(sum(length(body)) OVER before, 0) AS place, coalesce(sum(parts) OVER before, 0) AS s FROM ended WINDOW before AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
    "whole AS (SELECT doc_id, s, min(place) AS place, string_agg(body, '' ORDER BY k) AS t FROM placed GROUP BY 1, 2)",
    f"trimmed AS (SELECT doc_id, s, place + length(t) - length(regexp_replace(t, '^{_BLANK}+', '')) AS start, regexp_replace(regexp_replace(t, '^{_BLANK}+', ''), '{_BLANK}+$', '') AS text FROM whole)",
]


@query(_nested(_SENTENCES, "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS \"index\", CAST(start AS BIGINT) AS start, CAST(start + length(text) AS BIGINT) AS \"end\", text FROM trimmed WHERE text <> ''"))
def fnt7_sentences(run: Run) -> DataFrame:
    return chunking.split_sentences(run.table("documents"))


@query()
def fnt9_chunks(run: Run) -> DataFrame:
    return chunking.chunked(run.table("documents"))


@query()
def fnt10_samples(run: Run) -> DataFrame:
    return chunking.sampled(run.table("documents"))


_FLAT = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"


@query(f"SELECT d.doc_id, b.item_id AS item FROM documents d JOIN benchmark b ON contains({_FLAT.format('d.text')}, {_FLAT.format('b.text')}) WHERE length(b.text) >= 12")
def join22_quotes(run: Run) -> DataFrame:
    return quotes.quoted(run.table("documents"), run.table("benchmark")).select("doc_id", "item")


@query(_nested([
    rf"""held AS (SELECT d.doc_id, b.item_id AS item, lower(d.text) AS t, replace(regexp_escape({_FLAT.format('b.text')}), '\ ', '\s+') AS p FROM documents d JOIN benchmark b ON contains({_FLAT.format('d.text')}, {_FLAT.format('b.text')}) WHERE length(b.text) >= 12)""",
    "found AS (SELECT doc_id, item, t, regexp_extract(t, p) AS w FROM held)",
], 'SELECT doc_id, item, CAST(strpos(t, w) - 1 AS BIGINT) AS first, CAST(strpos(t, w) - 1 + length(w) AS BIGINT) AS "end" FROM found'))
def join22_quote_places(run: Run) -> DataFrame:
    return quotes.quoted(run.table("documents"), run.table("benchmark"))


# ---- values --------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN n < 0 THEN 0.0::DOUBLE WHEN n > 1 AND n < 2 THEN 1.0::DOUBLE WHEN n BETWEEN 2 AND 10 THEN n / 10 WHEN n > 10 THEN least(1.0::DOUBLE, n / 100) ELSE n END AS score FROM (SELECT o_orderkey, CAST(o_orderkey % 230 AS DOUBLE) / 2 AS n FROM orders) x")
def fnm2_unit_interval(run: Run) -> DataFrame:
    n = F.col("o_orderkey") % 230 / 2
    return run.table("orders").select("o_orderkey", fv.unit_interval(F.concat(F.lit("about "), n.cast("string"), F.lit(" points"))).alias("score"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 120 BETWEEN 16 AND 99 THEN CAST(p_partkey % 120 AS INTEGER) END AS age, CASE p_partkey % 3 WHEN 0 THEN 35 WHEN 1 THEN 42 ELSE 58 END AS decade FROM part")
def fnm3_ages(run: Run) -> DataFrame:
    k = F.col("p_partkey")
    return run.table("part").select("p_partkey", fv.age(F.concat(k % 120, F.lit(" years old"))).alias("age"), fv.age(F.element_at(F.array(F.lit("mid-thirties"), F.lit("early forties"), F.lit("late_fifties")), (k % 3 + 1).cast("int"))).alias("decade"))


@query("SELECT p_partkey, CASE WHEN p_size < 20 THEN CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'moderate' ELSE 'moderate' END WHEN p_size / 100 < 0.34 THEN 'low' WHEN p_size / 100 > 0.66 THEN 'high' ELSE 'moderate' END AS level FROM part")
def fnm4_activity(run: Run) -> DataFrame:
    words = F.element_at(F.array(*[F.lit(w) for w in ("prolific", "Lurker", "medium", "who knows")]), (F.col("p_size") % 4 + 1).cast("int"))
    return run.table("part").select("p_partkey", fv.activity_level(F.when(F.col("p_size") < 20, words).otherwise(F.concat((F.col("p_size") / 100).cast("string")))).alias("level"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'E' ELSE 'I' END || CASE WHEN p_size % 3 > 0 THEN 'N' ELSE 'S' END || CASE WHEN p_size >= 25 THEN 'F' ELSE 'T' END || CASE WHEN p_size % 5 = 0 THEN 'J' ELSE 'P' END AS mbti FROM part")
def fnm7_mbti(run: Run) -> DataFrame:
    s = F.col("p_size")
    bit = lambda c: F.when(c, 0.5).otherwise(0.49)
    return run.table("part").select("p_partkey", fv.mbti(bit(s % 3 > 0), bit(s % 5 == 0), bit(s % 2 == 0), bit(s >= 25)).alias("mbti"))


@query("SELECT p_partkey, array_to_string(list_filter([p_brand, p_type, CASE WHEN p_size % 2 = 0 THEN 'size ' || p_size END, CASE WHEN p_size % 3 = 0 THEN 'sand' END], lambda x: x IS NOT NULL), '|') AS items FROM part")
def fnm5_lists(run: Run) -> DataFrame:
    """Two to four items, parted by marks and by the word and, but not inside another word."""
    text = F.concat(F.col("p_brand"), F.lit("; ,"), F.col("p_type"), F.expr("if(p_size % 2 = 0, concat(' and  size ', p_size), ',')"), F.expr("if(p_size % 3 = 0, ',sand ', ' and ')"))
    return run.table("part").select("p_partkey", F.array_join(fv.listed(text), "|").alias("items"))


@query("SELECT doc_id, sha256('model|768|' || text) AS key FROM documents")
def fnh2_cache_keys(run: Run) -> DataFrame:
    return run.table("documents").select("doc_id", fv.cache_key("model", 768, F.col("text")).alias("key"))


@query("SELECT count(*) AS texts, count(DISTINCT text) AS keys, count(DISTINCT text) FILTER (WHERE doc_id % 3 = 0) AS cached, count(DISTINCT text) - count(DISTINCT text) FILTER (WHERE doc_id % 3 = 0) AS missing FROM documents")
def join21_embedding_cache(run: Run) -> DataFrame:
    """Texts to embed: each once, without those that a cache has."""
    keys = run.table("documents").select("doc_id", fv.cache_key("model", 768, F.col("text")).alias("key"))
    cache = keys.where("doc_id % 3 = 0").select("key").distinct()
    missing = keys.select("key").distinct().join(cache, "key", "left_anti")
    return keys.agg(F.count("*").alias("texts"), F.countDistinct("key").alias("keys")).withColumns({"cached": cache.agg(F.count("*")).scalar(), "missing": missing.agg(F.count("*")).scalar()})


# ---- graph and search ----------------------------------------------------------------------------------------------


@query("SELECT type, count(*) AS n FROM entities GROUP BY type")
def agg9_entity_types(run: Run) -> DataFrame:
    return graph.entity_types(run.entities)


@query("SELECT uuid, name, type, mention_count FROM entities WHERE type IN ('Supplier', 'Nation') AND contains(lower(name), '0') ORDER BY mention_count DESC, name, uuid LIMIT 40 OFFSET 5")
def top3_entities(run: Run) -> DataFrame:
    return graph.listed_entities(run.entities, types=["Supplier", "Nation"], search="0", limit=40, offset=5).select("uuid", "name", "type", "mention_count")


@query("SELECT src, dst, type, mention_count FROM edges WHERE src = 'Nation:7' OR dst = 'Nation:7' ORDER BY mention_count DESC, type, src, dst LIMIT 60")
def top4_relationships(run: Run) -> DataFrame:
    return graph.listed_relationships(run.edges, uuid="Nation:7", limit=60)


@query("SELECT e.src, e.dst, e.type, e.mention_count FROM edges e WHERE e.src IN (SELECT uuid FROM entities ORDER BY mention_count DESC, name, uuid LIMIT 100) AND e.dst IN (SELECT uuid FROM entities ORDER BY mention_count DESC, name, uuid LIMIT 100)")
def top5_subgraph_edges(run: Run) -> DataFrame:
    return graph.subgraph(run.entities, run.edges, 100)[1].select("src", "dst", "type", "mention_count")


@query(_nested(["both_ways AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges)", "one AS (SELECT DISTINCT b FROM both_ways WHERE a = 'Supplier:3')", "two AS (SELECT DISTINCT w.b FROM both_ways w JOIN one o ON w.a = o.b)", "three AS (SELECT DISTINCT w.b FROM both_ways w JOIN two o ON w.a = o.b)"],
    "SELECT uuid, min(d) AS distance FROM (SELECT 'Supplier:3' AS uuid, 0 AS d UNION ALL SELECT b, 1 FROM one UNION ALL SELECT b, 2 FROM two UNION ALL SELECT b, 3 FROM three) r GROUP BY uuid"))
def join16_neighbourhood(run: Run) -> DataFrame:
    return graph.neighbours(run.entities, run.edges, "Supplier:3", 3)


@query("SELECT e.uuid, (SELECT count(*) FROM edges x WHERE x.src = e.uuid) AS outgoing, (SELECT count(*) FROM edges x WHERE x.dst = e.uuid) AS incoming FROM entities e")
def join17_degrees(run: Run) -> DataFrame:
    return graph.degree(run.entities, run.edges)


@query("SELECT src, dst, type, mention_count FROM edges WHERE src NOT LIKE 'Customer:%' AND dst NOT LIKE 'Customer:%'")
def flt15_visible_edges(run: Run) -> DataFrame:
    return graph.without_dangling(run.edges, run.entities, ["Customer"]).select("src", "dst", "type", "mention_count")


@query("SELECT 'ORDERED' AS type, 'Customer:' || o_custkey AS src, 'Supplier:' || l_suppkey AS dst, count(*) AS mention_count, min(l_linenumber) AS first_chunk, count(DISTINCT l_linenumber) AS chunks FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 2, 3")
def agg20_merged_edges(run: Run) -> DataFrame:
    rows = run.table("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber").join(run.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.lit("ORDERED").alias("type"), F.concat(F.lit("Customer:"), "o_custkey").alias("src"), F.concat(F.lit("Supplier:"), "l_suppkey").alias("dst"), F.col("l_linenumber").alias("chunk"))
    merged = graph.merged_edges(rows)
    return merged.select("type", "src", "dst", "mention_count", F.col("chunk_indices")[0].alias("first_chunk"), F.size("chunk_indices").cast("long").alias("chunks"))


@query("SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS position FROM nation WHERE n_regionkey <> 4")
def join23_linked_ontology(run: Run) -> DataFrame:
    """Nations as relationships between regions, of which one is unknown."""
    n = run.table("nation")
    rel = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("position"), F.array(F.col("n_regionkey").cast("string")).alias("source_types"), F.array(F.lit("0")).alias("target_types"))
    return graph.linked_ontology(rel, run.table("region").where("r_regionkey <> 4").select(F.col("r_regionkey").cast("string").alias("type"))).select("name", "position")


@query("SELECT uuid, mention_count, CASE WHEN normalised = '{0}' THEN 1.0::DOUBLE WHEN normalised LIKE '{0}%' THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END AS score FROM (SELECT * FROM entities WHERE contains(normalised, '{0}') ORDER BY mention_count DESC, name, uuid LIMIT 20) h".format("a"))
def top6_lexical_search(run: Run) -> DataFrame:
    return search.lexical(run.entities, "A ", 20).select("uuid", "mention_count", "score")


def _vectors(run: Run) -> DataFrame:
    return run.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query(_nested(["v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)", "s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS c FROM v q, v WHERE q.vec_id % 50 = 0)"],
    "SELECT query_id, id, place FROM (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, id) AS INTEGER) AS place FROM s) r WHERE place <= 5"))
def join18_nearest(run: Run) -> DataFrame:
    """The five nearest of each vector whose id is divisible by 50."""
    v = _vectors(run)
    return search.nearest(v, v.where("id % 50 = 0"), 5).select("query_id", "id", "place")


@query(_nested(["w AS (SELECT uuid, mention_count FROM entities WHERE type = 'Supplier' AND contains(lower(name), '0000000') ORDER BY mention_count DESC, name, uuid LIMIT 4)", "v AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 1)) AS s FROM embeddings)", "n AS (SELECT 'Supplier:' || vec_id AS uuid, row_number() OVER (ORDER BY s DESC, vec_id) AS place FROM v)"],
    "SELECT uuid, arm FROM (SELECT uuid, 0 AS arm, -mention_count AS place FROM w UNION ALL SELECT uuid, 1, place FROM n WHERE place <= 12 AND uuid NOT IN (SELECT uuid FROM w)) u ORDER BY arm, place LIMIT 10"))
def top7_hybrid_search(run: Run) -> DataFrame:
    """Suppliers by name, then by the vectors nearest to the first one's."""
    words = search.lexical(run.entities.where("type = 'Supplier'"), "0000000", 4).select("uuid", "score", (-F.col("mention_count")).alias("place"))
    near = search.nearest(_vectors(run), _vectors(run).where("id = 1"), 12)
    vectors = near.select(F.concat(F.lit("Supplier:"), F.col("id")).alias("uuid"), F.col("similarity").alias("score"), F.col("place").cast("long").alias("place"))
    return search.hybrid(words, vectors, 10).select("uuid", "arm")


@query()
def top9_passages(run: Run) -> DataFrame:
    """Chunks of the documents whose vectors are nearest to the first one's."""
    near = search.nearest(_vectors(run), _vectors(run).where("id = 0"), 10).select(F.col("id").alias("doc_id"), "similarity")
    return chunking.chunked(run.table("documents").join(near.select("doc_id"), "doc_id", "left_semi")).join(near, "doc_id").select("doc_id", "index", "start", "end", "similarity")


# ---- influence, memory, resolution and population ------------------------------------------------------------------


@query(_nested(["acts AS (SELECT o_custkey AS source, CAST(o_orderkey // 3 AS BIGINT) AS post_id FROM orders)", "found AS (SELECT a.source, p.o_custkey AS target FROM acts a JOIN orders p ON p.o_orderkey = a.post_id)"], "SELECT source, target, count(*) AS weight FROM found WHERE source <> target GROUP BY 1, 2"))
def join9_influence_edges(run: Run) -> DataFrame:
    return influence.edges(_amplified(run))


def _amplified(run: Run) -> DataFrame:
    info = F.to_json(F.struct((F.col("o_orderkey").cast("long") - F.col("o_orderkey") % 3).alias("x"), F.expr("cast(o_orderkey div 3 as bigint)").alias("reposted_id")))
    acts = run.table("orders").select(F.col("o_custkey").alias("user_id"), influence.amplified_id(info).alias("post_id"))
    return influence.amplifications(acts, run.table("orders").select(F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("user_id")))


@query(_nested(["acts AS (SELECT o_custkey AS source, CAST(o_orderkey // 3 AS BIGINT) AS post_id FROM orders)", "edge AS (SELECT a.source, p.o_custkey AS target, count(*) AS weight FROM acts a JOIN orders p ON p.o_orderkey = a.post_id WHERE a.source <> p.o_custkey GROUP BY 1, 2)",
    "ends AS (SELECT target AS user_id, weight AS score, false AS mark, true AS e FROM edge UNION ALL SELECT source, 0, false, true FROM edge UNION ALL SELECT c_custkey, 0, true, false FROM customer WHERE c_mktsegment = 'BUILDING')"],
    "SELECT user_id, sum(score) AS score, bool_or(mark) AS highlighted, bool_or(mark) AND NOT bool_or(e) AS isolated FROM ends GROUP BY user_id"))
def agg14_influence_nodes(run: Run) -> DataFrame:
    return influence.nodes(influence.edges(_amplified(run)), run.table("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id")))


@query("SELECT d.doc_id AS post_id, n.name AS name FROM documents d JOIN (SELECT DISTINCT lower(text) AS name FROM benchmark) n ON contains(lower(d.text), n.name)")
def join11_mentions(run: Run) -> DataFrame:
    names = run.table("benchmark").select(F.lower("text").alias("normalised"))
    return memory.mentioned(run.table("documents").select(F.col("doc_id").alias("post_id"), F.lower("text").alias("normalised")), names)


@query("SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, n, max(n) OVER (PARTITION BY conv_id) AS last FROM (SELECT conv_id, turn, role, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) a) b WHERE n > last - 2 OR role = 'system'")
def win5_trimmed_memory(run: Run) -> DataFrame:
    return memory.trimmed(run.table("conversations"), 2).select("conv_id", "turn", "role")


@query("SELECT o_orderkey AS post_id, CAST(o_orderkey % 30 AS INTEGER) AS round, CAST(o_custkey AS BIGINT) AS engagement FROM orders WHERE o_orderkey % 30 < 12 ORDER BY o_custkey DESC, o_orderkey % 30 DESC, o_orderkey LIMIT 5")
def top10_remembered(run: Run) -> DataFrame:
    rows = run.table("orders").select(F.col("o_orderkey").alias("post_id"), (F.col("o_orderkey") % 30).cast("int").alias("round"), F.col("o_custkey").alias("engagement"))
    return memory.remembered(rows, 12)


@query("""SELECT user_id, min(t) AS start, max(t) + 3600000000 AS "end", count(*) AS n FROM (SELECT user_id, t, sum(CASE WHEN t - before < 3600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) a) b GROUP BY user_id, session""")
def str7_idle_sessions(run: Run) -> DataFrame:
    sessions = memory.idle_sessions(run.table("events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), 3600)
    return sessions.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


def _mentions(run: Run) -> DataFrame:
    """Parts as mentions of what they are: their brand with or without a title, by type."""
    p = run.table("part")
    surface = F.concat(F.element_at(F.array(F.lit("Dr "), F.lit("the "), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int")), F.lower("p_type"), F.lit(" "), F.col("p_size").cast("string"))
    return p.select(F.col("p_brand").alias("type"), surface.alias("surface"), ft.normalised_name(surface).alias("normalised"), F.col("p_partkey").alias("chunk"), F.lit(0).alias("start"))


@query("SELECT p_brand AS type, lower(p_type) || ' ' || p_size AS normalised, count(*) AS mention_count, count(DISTINCT p_partkey % 3) AS n_aliases FROM part GROUP BY 1, 2")
def agg19_entities_by_name(run: Run) -> DataFrame:
    return resolve.by_name(_mentions(run)).select("type", "normalised", "mention_count", F.size("aliases").cast("long").alias("n_aliases"))


_NAMES = "names AS (SELECT p_brand AS type, lower(p_type) || ' ' || p_size AS normalised, min(p_partkey) AS chunk, count(*) AS mention_count, min_by(CASE p_partkey % 3 WHEN 0 THEN 'Dr ' WHEN 1 THEN 'the ' ELSE '' END || lower(p_type) || ' ' || p_size, p_partkey) AS name, len(string_split(p_type, ' ')) + 1 AS size FROM part GROUP BY p_brand, 2, p_type)"


@query(_nested([_NAMES, "kept AS (SELECT a.type, a.normalised, coalesce(min_by(b.normalised, (-b.size, b.chunk, b.normalised)), a.normalised) AS keeper FROM names a LEFT JOIN names b ON a.type = b.type AND b.size >= 2 AND a.size >= 2 AND (a.normalised = b.normalised OR suffix(b.normalised, ' ' || a.normalised)) GROUP BY a.type, a.normalised)"],
    "SELECT n.type, k.keeper, max(CASE WHEN n.normalised = k.keeper THEN n.name END) AS name, CAST(sum(n.mention_count) AS BIGINT) AS mention_count, false AS inferred, count(*) AS merged FROM names n JOIN kept k ON n.type = k.type AND n.normalised = k.normalised GROUP BY 1, 2"))
def join19_aliases_merged(run: Run) -> DataFrame:
    entities = resolve.by_name(_mentions(run))
    return resolve.folded(entities, resolve.aliases_merged(entities)).drop("aliases", "first")


_ALIVE = "list_filter(g.alive, lambda x: x.label = v.label AND list_cosine_similarity(x.e, v.e) >= 0.9)"


@query(f"""SELECT type, normalised, keeper FROM (WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id) AS k, label, 'vector ' || vec_id AS name, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(label INTEGER, name VARCHAR, e DOUBLE[])[]) AS alive, '' AS type, '' AS normalised, '' AS keeper
UNION ALL SELECT v.k, CASE WHEN len({_ALIVE}) = 0 THEN list_append(g.alive, {{'label': v.label, 'name': v.name, 'e': v.e}}) ELSE g.alive END, CAST(v.label AS VARCHAR), v.name, coalesce({_ALIVE}[1].name, v.name) FROM g JOIN v ON v.k = g.k + 1) SELECT * FROM g WHERE k > 0) q""")
def join20_similar_merged(run: Run) -> DataFrame:
    e = run.table("embeddings").select(F.col("label").cast("string").alias("type"), F.concat(F.lit("vector "), F.col("vec_id")).alias("normalised"), F.col("vec_id").alias("position"), "embedding")
    return resolve.similar_merged(e, least_overlap=0.3, least_cosine=0.9)


@query("SELECT p_brand AS type, p_type AS normalised, 'size' AS key, max(CASE WHEN r = 1 THEN v END) AS value, count(*) - 1 AS n_conflicts FROM (SELECT p_brand, p_type, v, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY chunk, v) AS r FROM (SELECT p_brand, p_type, CAST(p_size AS VARCHAR) AS v, min(p_partkey) AS chunk FROM part GROUP BY 1, 2, 3) a) b GROUP BY 1, 2")
def agg18_attributes_folded(run: Run) -> DataFrame:
    v = run.table("part").select(F.col("p_brand").alias("type"), F.col("p_type").alias("normalised"), F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value"), F.col("p_partkey").alias("chunk"))
    return resolve.attributes_folded(v).select("type", "normalised", "key", "value", "n_conflicts")


# A loop over the people in their order, which holds the handles so far: each takes the first of slug, slug_2 and so on that isn't among them.
@query("""SELECT user_id, username FROM (WITH RECURSIVE people AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS n, 'user_' || (user_id % 40) || CASE WHEN user_id % 3 = 0 THEN '_' || (user_id % 7) ELSE '' END || CASE WHEN user_id % 15 = 0 THEN '_2' ELSE '' END AS slug FROM users),
taken AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS user_id, CAST(NULL AS VARCHAR) AS username, CAST([] AS VARCHAR[]) AS handles
  UNION ALL SELECT n, user_id, username, list_append(handles, username) FROM (SELECT p.n, p.user_id, t.handles,
    list_filter(list_transform(range(1, len(t.handles) + 2), lambda k: CASE WHEN k = 1 THEN p.slug ELSE p.slug || '_' || k END), lambda h: NOT list_contains(t.handles, h))[1] AS username FROM taken t JOIN people p ON p.n = t.n + 1) x)
SELECT user_id, username FROM taken WHERE n > 0) q""")
def win3_usernames(run: Run) -> DataFrame:
    """Names that are shared, and names that are others' numbered handles."""
    u = F.col("user_id")
    name = F.concat(F.lit("User "), u % 40, F.when(u % 3 == 0, F.concat(F.lit(" "), u % 7)).otherwise(""), F.when(u % 15 == 0, " 2").otherwise(""))
    return population.usernames(run.users.select("user_id", name.alias("name"))).select("user_id", "username")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE provenance = 'named') AS named, count(*) FILTER (WHERE provenance = 'synthetic') AS synthetic FROM profiles")
def agg15_provenance(run: Run) -> DataFrame:
    return population.provenance(run.profiles)


@query("SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'removed' ELSE 'edited' END AS change FROM profiles WHERE user_id % 5 = 0 OR user_id % 6 = 1")
def join26_population_changes(run: Run) -> DataFrame:
    after = run.profiles.where("user_id % 5 <> 0").withColumn("activity_level", F.expr("if(user_id % 6 = 1, 'changed', activity_level)"))
    return population.changes(run.profiles, after)


@query("SELECT user_id, CASE WHEN provenance = 'named' THEN name ELSE 'New ' || user_id END AS name, provenance FROM profiles WHERE user_id % 2 = 0")
def join25_population_replaced(run: Run) -> DataFrame:
    new = run.profiles.where("user_id % 2 = 0").select("user_id", F.concat(F.lit("New "), F.col("user_id")).alias("name"), F.lit("other").alias("provenance"))
    return population.replaced(run.profiles, new)


@query("SELECT split_part(p_type || ' ' || p_brand, ' ', 1) AS sector, p_type || ' ' || p_brand AS occupation, CAST(2 AS BIGINT) AS n FROM part GROUP BY ALL")
def fnr1_occupations(run: Run) -> DataFrame:
    """Twice as many places as there are occupations, so each comes twice, in its sector."""
    o = run.table("part").select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("sector"), F.concat_ws(" ", "p_type", "p_brand").alias("occupation")).distinct()
    return population.sampled_occupations(o, 2 * o.count()).groupBy("sector", "occupation").agg(F.count("*").alias("n"))


_DRAWN = "CAST('0x' || substr(md5('{0}|' || {1}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query(f"""SELECT user_id, CASE WHEN u < 0.4 THEN 'for' WHEN u < 0.7 THEN 'against' ELSE 'unsure' END AS stance, followers, CAST(trunc(followers * (0.6::DOUBLE + spread * 0.8::DOUBLE)) AS INTEGER) AS following
FROM (SELECT user_id, u, spread, CAST(trunc(900 * (0.5::DOUBLE + spread)) AS INTEGER) AS followers FROM (SELECT user_id, {_DRAWN.format(3, "user_id")} AS u, floor({_DRAWN.format(0, "name || '|' || user_id")} * 100) / 100 AS spread FROM users) a) b""")
def fnr2_stances(run: Run) -> DataFrame:
    rows = population.weighted_choice(run.users, [("for", 0.4), ("against", 0.3), ("unsure", 0.3), ("absent", 0.0)], "user_id", "stance", seed=3)
    return population.followers(rows.withColumn("activity_level", F.lit("high"))).select("user_id", "stance", "followers", "following")
