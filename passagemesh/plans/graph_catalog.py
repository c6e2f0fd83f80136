"""More of the core's queries: text pieces, edge tables, themes, graph quality, path rules, display data and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagemesh.functions import text as T
from passagemesh.operators import corpus, display, evaluate, graph, grouping, paths, similarity, themes, traversal
from passagemesh.plans import catalog, walk_sql
from passagemesh.plans.catalog import _ANCHOR, _EDGES, _GRAPH, _NODES, _PASSAGES, _USABLE, _edges, _graph, _nodes, _passages, _top_sql, query
from passagemesh.runtime import table
from passagemesh.sources import articles as A
from passagemesh.sources import goldens as G

# --- text ---------------------------------------------------------------------------------------------------------------

_BLANK = "[\\t-\\r\\x{1c}-\\x{1f}\\x{85}\\p{Z}]"


@query(
    f"""WITH a AS (SELECT DISTINCT url, cleaned_text AS t FROM articles WHERE url IS NOT NULL AND cleaned_text IS NOT NULL),
s AS (SELECT url, list_filter(string_split(regexp_replace(t, '([.!?]){_BLANK}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM a)
SELECT url, (unnest(range(1, len(s) + 1)) - 1)::INTEGER AS pos, unnest(s) AS sentence FROM s"""
)
def b9_tokenized(spark, sf):
    a = table(spark, sf, "articles").filter("url IS NOT NULL AND cleaned_text IS NOT NULL").select("url", "cleaned_text").distinct()
    return a.select("url", F.posexplode(T.tokenized(F.col("cleaned_text"))).alias("pos", "sentence"))


@query("SELECT DISTINCT chunk_id, try_cast(nullif(regexp_extract(chunk_id, '(?:^|_)window_([0-9]+)(?:_|$)', 1), '') AS INTEGER) AS start_index, replace(regexp_extract(chunk_id, '(?s)^(.*?)(?:_window_.*)?$', 1), '_', ' ') AS document FROM chunks WHERE chunk_id IS NOT NULL")
def b14_parsed_ids(spark, sf):
    c = table(spark, sf, "chunks").filter("chunk_id IS NOT NULL").select("chunk_id").distinct()
    return c.select("chunk_id", T.start_index(F.col("chunk_id")).alias("start_index"), T.document_name(F.col("chunk_id")).alias("document"))


@query("SELECT DISTINCT chunk_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM chunks WHERE chunk_id IS NOT NULL")
def b18_previews(spark, sf):
    return table(spark, sf, "chunks").filter("chunk_id IS NOT NULL").select("chunk_id", T.preview(F.col("text"), 200).alias("preview")).distinct()


_MARKED = "regexp_replace(coalesce(doc_summary, ''), '([\\p{L}\\p{N}_]+)', '\x01\\1\x02', 'g')"


@query(
    f"""WITH d AS (SELECT DISTINCT doc_id, doc_summary FROM document_nodes WHERE doc_id IS NOT NULL),
p AS (SELECT *, list_transform(regexp_extract_all({_MARKED}, '\x01[A-Z][a-z]+\x02(?:[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+\x01[A-Z][a-z]+\x02)*'), lambda x: replace(replace(x, '\x01', ''), '\x02', '')) AS p FROM d)
SELECT DISTINCT doc_id, list_filter(p, lambda x, i: list_position(p, x) = i)[1:5] AS phrases FROM p"""
)
def b21_capitalised_phrases(spark, sf):
    d = table(spark, sf, "document_nodes").filter("doc_id IS NOT NULL").select("doc_id", "doc_summary").distinct()
    return d.select("doc_id", T.capitalised(F.col("doc_summary"), 5).alias("phrases")).distinct()


# --- edges --------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_NODES}, i AS ({_top_sql('a.doc = b.doc', 15, 0.4, 'true')}), x AS ({_top_sql('a.doc <> b.doc', 5, 0.3, catalog._IS_QUERY)}),
u AS (SELECT *, 'intra_document' AS type FROM i UNION ALL SELECT *, 'inter_document' FROM x)
SELECT src, dst, u.sim, rank, type, a.doc AS source_document, b.doc AS target_document FROM u LEFT JOIN nodes a ON a.id = src LEFT JOIN nodes b ON b.id = dst"""
)
def e5_edge_union(spark, sf):
    """Edges inside documents and, for the stated query set, between them."""
    n = _nodes(spark, sf).select("id", "doc", "vec")
    inside = similarity.top_similar(n, n, 15, 0.4, same_doc=True)
    across = similarity.top_similar(n.filter(traversal.is_query(F.col("id"))), n, 5, 0.3, same_doc=False)
    return catalog._shown(similarity.union(inside, across, n.select("id", "doc")))


@query(
    f"""WITH {_NODES}, {_EDGES}, o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM nodes),
c AS (SELECT unnest([type, 'combined']) AS matrix, a.n AS row, b.n AS col, sim FROM edges JOIN o a ON a.id = src JOIN o b ON b.id = dst), v AS (SELECT matrix, row, col, round(sum(sim), 9) AS value FROM c GROUP BY 1, 2, 3)
SELECT matrix, row, list(col ORDER BY col) AS cols, list(value ORDER BY col) AS values FROM v GROUP BY 1, 2"""
)
def e6_sparse_matrices(spark, sf):
    return similarity.compressed(similarity.coordinates(_edges(spark, sf), similarity.ordinals(_nodes(spark, sf))))


_DOC_QUERY = catalog._IS_QUERY.replace("md5(id)", "md5(doc)")
_MATRIX = f"{_NODES}, m AS (SELECT a.doc, a.id AS a, b.id AS b, round(list_dot_product(a.vec, b.vec), 9) AS sim FROM nodes a JOIN nodes b ON a.doc = b.doc WHERE {_DOC_QUERY.replace('md5(doc)', 'md5(a.doc)')})"


def _pictured(spark, sf):
    """The chunks of the documents whose hashed name is divisible by 20: the stated set of pictures."""
    return _nodes(spark, sf).filter(traversal.is_query(F.col("doc"))).select("doc", "id", "vec")


@query(f"WITH {_MATRIX} SELECT doc, a, b, round(m.sim, 6) AS sim FROM m")
def e9_document_matrices(spark, sf):
    return catalog._shown(display.matrix(_pictured(spark, sf), "doc"))


@query(f"WITH {_MATRIX} SELECT doc, a, b, round(m.sim, 6) AS sim FROM m WHERE a < b AND m.sim > 0.75")
def e10_strong_pairs(spark, sf):
    return catalog._shown(display.strong_pairs(display.matrix(_pictured(spark, sf), "doc")))


# --- themes -------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_NODES}, c AS (SELECT doc, i, avg(vec[i]) AS x FROM nodes, range(1, 65) t(i) WHERE doc <> '' GROUP BY 1, 2), v AS (SELECT doc AS id, list(x ORDER BY i) AS e FROM c GROUP BY 1),
u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS vec FROM v), s AS (SELECT a.id AS doc_id, b.id AS similar_id, round(list_dot_product(a.vec, b.vec), 9) AS score FROM u a JOIN u b ON a.id <> b.id WHERE {catalog._IS_QUERY.replace('md5(id)', 'md5(a.id)')})
SELECT doc_id, similar_id, round(s.score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY s.score DESC, similar_id)::INTEGER AS rank FROM s WHERE s.score >= 0.05 QUALIFY rank <= 3"""
)
def f9_theme_similarities(spark, sf):
    """Documents by the mean of their chunks' vectors, in place of theme vectors; queries are the stated documents."""
    n = _nodes(spark, sf).filter("doc <> ''").select(F.col("doc").alias("id"), F.posexplode("vec").alias("i", "x"))
    c = n.groupBy("id", "i").agg(F.avg("x").alias("x")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("e"))
    from passagemesh.functions import vector as V

    v = c.select("id", V.unit(F.col("e")).alias("vec"))
    got = themes.theme_similarities(v, v.filter(traversal.is_query(F.col("id"))), 0.05, 3)
    return got.withColumn("score", F.round("score", 6))


_STORED = "stored AS (SELECT DISTINCT d.title, e.similar_id, e.score FROM (SELECT doc_id, similar_id, max(score) AS score FROM (SELECT doc_id, unnest(map_keys(theme_similarity_scores)) AS similar_id, unnest(map_values(theme_similarity_scores)) AS score FROM document_nodes WHERE doc_id IS NOT NULL) WHERE score >= 0.2 AND similar_id <> doc_id GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY max(score) DESC, similar_id) <= 1) e JOIN (SELECT DISTINCT doc_id, title FROM document_nodes WHERE title IS NOT NULL) d ON d.doc_id = e.doc_id)"


@query(
    f"""WITH {_STORED} SELECT 'chunk' AS kind, c.id, similar_id, score FROM (SELECT DISTINCT chunk_id AS id, source_article AS title FROM chunks WHERE chunk_id IS NOT NULL) c JOIN stored ON stored.title = c.title
UNION ALL SELECT 'sentence', c.id, similar_id, score FROM (SELECT DISTINCT sentence_id AS id, source_article AS title FROM sentence_embeddings WHERE sentence_id IS NOT NULL) c JOIN stored ON stored.title = c.title"""
)
def f10_propagated_themes(spark, sf):
    d = table(spark, sf, "document_nodes")
    e = themes.theme_edges(d).join(d.filter("title IS NOT NULL").select("doc_id", "title").distinct(), "doc_id").select("title", "similar_id", "score").distinct()
    c = table(spark, sf, "chunks").select(F.col("chunk_id").alias("id"), F.col("source_article").alias("title"))
    s = table(spark, sf, "sentence_embeddings").select(F.col("sentence_id").alias("id"), F.col("source_article").alias("title"))
    return themes.propagated(e, c, s)


@query(
    """WITH d AS (SELECT DISTINCT doc_id FROM document_nodes WHERE doc_id IS NOT NULL), n AS (SELECT doc_id AS a, lead(doc_id) OVER (ORDER BY doc_id) AS b FROM d),
m AS (SELECT doc_id AS a, arg_max(theme_similarity_scores, cardinality(theme_similarity_scores)) AS m FROM document_nodes WHERE doc_id IS NOT NULL AND theme_similarity_scores IS NOT NULL GROUP BY 1),
k AS (SELECT a, list_min(map_keys(m)) AS b FROM m WHERE cardinality(m) > 0), p AS (SELECT a, b FROM n WHERE b IS NOT NULL UNION SELECT a, b FROM k)
SELECT p.a, p.b, coalesce(map_extract_value(m, p.b), 0.0)::DOUBLE AS score FROM p LEFT JOIN m ON m.a = p.a"""
)
def f12_theme_scores(spark, sf):
    """Each document with the next and with the first it is like: pairs with and without a stored score."""
    from pyspark.sql import Window

    d = table(spark, sf, "document_nodes")
    ids = d.filter("doc_id IS NOT NULL").select("doc_id").distinct()
    n = ids.select(F.col("doc_id").alias("a"), F.lead("doc_id").over(Window.orderBy("doc_id")).alias("b")).filter("b IS NOT NULL")
    m = d.filter("doc_id IS NOT NULL AND theme_similarity_scores IS NOT NULL").groupBy(F.col("doc_id").alias("a")).agg(F.max_by("theme_similarity_scores", F.size("theme_similarity_scores")).alias("m"))
    k = m.filter(F.size("m") > 0).select("a", F.array_min(F.map_keys("m")).alias("b"))
    return themes.theme_score(n.unionByName(k).distinct(), d)


# --- graph --------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_NODES}, {_EDGES}, k AS (SELECT src, dst, min({{'o': CASE WHEN type = 'intra_document' THEN 0 ELSE 1 END, 'r': rank}}) AS k, max(sim) AS sim FROM edges GROUP BY 1, 2)
SELECT src AS chunk_id, list(dst ORDER BY k, dst) AS connections, list(round(sim, 6) ORDER BY k, dst) AS scores FROM k GROUP BY 1"""
)
def g7_neighbours(spark, sf):
    n = graph.neighbours(_edges(spark, sf))
    return n.select("chunk_id", "connections", F.transform("connections", lambda c: F.round(F.element_at("scores", c), 6)).alias("scores"))


_SCORED = "scored AS (SELECT DISTINCT chunk_id, CASE WHEN ('0x' || substr(md5(chunk_id), 5, 1))::INTEGER < 15 THEN ('0x' || substr(md5(chunk_id), 1, 4))::INTEGER / 65535.0::DOUBLE END AS score FROM chunks WHERE chunk_id IS NOT NULL)"


def _scored(spark, sf):
    """A made quality of each chunk, null for one in sixteen."""
    part = lambda a, n: F.conv(F.substring(F.md5("chunk_id"), a, n), 16, 10).cast("int")
    c = table(spark, sf, "chunks").filter("chunk_id IS NOT NULL").select("chunk_id").distinct()
    return c.select("chunk_id", F.when(part(5, 1) < 15, part(1, 4) / 65535.0).alias("score"))


@query(
    f"""WITH {_SCORED}, low AS (SELECT chunk_id FROM scored WHERE score < 0.3), b AS (SELECT DISTINCT chunk_id, sentence_id FROM (SELECT unnest(containing_chunks) AS chunk_id, sentence_id FROM sentence_embeddings WHERE sentence_id IS NOT NULL) WHERE chunk_id IS NOT NULL),
gone AS (SELECT DISTINCT sentence_id FROM b WHERE chunk_id IN (SELECT chunk_id FROM low)) SELECT chunk_id, sentence_id FROM b WHERE sentence_id NOT IN (SELECT sentence_id FROM gone) AND chunk_id NOT IN (SELECT chunk_id FROM low)"""
)
def g10_pruned_bridge(spark, sf):
    c = table(spark, sf, "chunks")
    return graph.pruned(graph.document_nodes(c, corpus.summaries(table(spark, sf, "articles"))), c, graph.bridge(table(spark, sf, "sentence_embeddings")), _scored(spark, sf), 0.3)[2]


@query(
    f"""WITH {_SCORED}, c AS (SELECT DISTINCT source_article AS title, start_sentence_idx, chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND source_article IS NOT NULL)
SELECT title, coalesce(list(chunk_id ORDER BY start_sentence_idx NULLS FIRST, chunk_id) FILTER (chunk_id NOT IN (SELECT chunk_id FROM scored WHERE score < 0.3)), []) AS chunk_ids FROM c GROUP BY 1"""
)
def g10_pruned_documents(spark, sf):
    c = table(spark, sf, "chunks")
    return graph.pruned(graph.document_nodes(c, corpus.summaries(table(spark, sf, "articles"))), c, graph.bridge(table(spark, sf, "sentence_embeddings")), _scored(spark, sf), 0.3)[0].select("title", "chunk_ids")


@query(f"WITH {_SCORED} SELECT chunk_id, score FROM scored WHERE score >= 0.8")
def g11_above_quality(spark, sf):
    return graph.above_quality(_scored(spark, sf), 0.8)


@query(f"WITH {_SCORED} SELECT count(score) AS scored, (count(*) - count(score))::BIGINT AS unscored, count_if(score >= 0.7)::BIGINT AS high, count_if(score >= 0.7 * 0.7 AND score < 0.7)::BIGINT AS medium, count_if(score < 0.7 * 0.7)::BIGINT AS low, round(avg(score), 6) AS avg_score, min(score) AS min_score, max(score) AS max_score FROM scored")
def g12_chunk_quality(spark, sf):
    return graph.quality_summary(_scored(spark, sf))


@query(f"WITH {_NODES}, {_EDGES} SELECT (SELECT count(DISTINCT source_article) FROM chunks WHERE chunk_id IS NOT NULL) AS documents, (SELECT count(*) FROM nodes) AS chunks, (SELECT count(DISTINCT sentence_id) FROM sentence_embeddings) AS sentences, (SELECT count(*) FROM edges WHERE type = 'intra_document') AS intra_edges, (SELECT count(*) FROM edges WHERE type <> 'intra_document') AS inter_edges")
def g13_graph_counts(spark, sf):
    c = table(spark, sf, "chunks").filter("chunk_id IS NOT NULL AND source_article IS NOT NULL").select("source_article").distinct()
    return graph.counts(c, _nodes(spark, sf), graph.sentence_nodes(table(spark, sf, "sentence_embeddings")), _edges(spark, sf))


@query(f"WITH {_GRAPH}, a AS (SELECT query_id, id AS cur FROM sims QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sims.sim DESC, id) = 1), h AS (SELECT a.query_id, k.dst AS id, 'chunk' AS kind, k.ord, round(list_dot_product(q.vec, n.vec), 9) AS s FROM a JOIN queries q ON q.id = a.query_id JOIN links k ON k.src = a.cur JOIN nodes n ON n.id = k.dst UNION ALL SELECT a.query_id, b.sid, 'sentence', 2000000000, round(list_dot_product(q.vec, b.v), 9) FROM a JOIN queries q ON q.id = a.query_id JOIN bridge b ON b.id = a.cur WHERE b.v IS NOT NULL) SELECT query_id, id, kind, round(s, 6) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ord, id)::INTEGER AS rank FROM h")
def j1_hybrid_connections(spark, sf):
    """Neighbours and sentences of each query's anchor, by similarity to the query."""
    q, g = _graph(spark, sf)
    a = traversal.anchors(q, g.nodes).select("query_id", F.col("id").alias("cur"))
    return traversal.hybrid(a.join(q.select(F.col("id").alias("query_id"), F.col("vec").alias("q")), "query_id"), g).withColumn("sim", F.round("sim", 6))


# --- path rules ---------------------------------------------------------------------------------------------------------


@query(
    """SELECT * FROM (VALUES ('sequential', 'SENTENCE', 'document_only', 'narrative_flow_continuation'), ('sequential', 'CHUNK', 'inter_document_allowed', 'narrative_flow_continuation'), ('sequential', 'DOCUMENT', 'always_inter_document', 'narrative_flow_continuation'),
 ('raw_similarity', 'CHUNK', 'intra_and_inter_document', 'direct_similarity_matching'), ('raw_similarity', 'DOCUMENT', 'unknown', 'direct_similarity_matching'), ('raw_similarity', 'SENTENCE', 'unknown', 'direct_similarity_matching'),
 ('theme_bridge', 'DOCUMENT', 'always_inter_document', 'document_to_document_theme_matching'), ('theme_bridge', 'CHUNK', 'always_inter_document', 'chunk_to_most_relevant_chunk_in_target_document'), ('theme_bridge', 'SENTENCE', 'unknown', 'default_similarity_based'),
 ('hierarchical', 'DOCUMENT', 'intra_document_only', 'document_to_child_chunk'), ('hierarchical', 'CHUNK', 'intra_document_only', 'chunk_to_child_sentence'), ('hierarchical', 'SENTENCE', 'intra_document_only', 'default_similarity_based'),
 ('entity_overlap', 'DOCUMENT', 'unknown', 'default_similarity_based'), ('entity_overlap', 'CHUNK', 'unknown', 'default_similarity_based'), ('entity_overlap', 'SENTENCE', 'unknown', 'default_similarity_based')) t(connection, granularity, scope, landing)"""
)
def k2_scopes_and_landings(spark, sf):
    every = spark.createDataFrame([(c, g) for c in paths.ALLOWED for g in paths.LEVELS], "connection string, granularity string")
    return every.select("connection", "granularity", paths.scope(F.col("connection"), F.col("granularity")).alias("scope"), paths.landing(F.col("connection"), F.col("granularity")).alias("landing"))


@query("SELECT * FROM (VALUES ('raw_similarity', NULL, 1), ('hierarchical', NULL, 2), ('sequential_flow', 5, 10), ('theme_bridge', NULL, 3), ('multi_dimensional', 3, 3)) t(pattern, min_hops, max_hops)")
def k3_pattern_limits(spark, sf):
    return paths.constraints(spark)


@query("SELECT pattern, hops, array_to_string(granularities, ',') AS granularities, array_to_string(connections, ',') AS connections, cross_document FROM (VALUES ('raw_similarity', 1, ['CHUNK', 'CHUNK'], ['raw_similarity'], true), ('hierarchical', 2, ['DOCUMENT', 'CHUNK', 'SENTENCE'], ['hierarchical', 'hierarchical'], false), ('theme_bridge', 2, ['CHUNK', 'CHUNK'], ['theme_bridge', 'hierarchical'], true), ('multi_dimensional', 3, ['DOCUMENT', 'CHUNK', 'CHUNK', 'SENTENCE'], ['hierarchical', 'theme_bridge', 'sequential'], true), ('sequential_flow', 5, ['SENTENCE', 'SENTENCE', 'SENTENCE', 'SENTENCE', 'SENTENCE', 'SENTENCE'], ['sequential', 'sequential', 'sequential', 'sequential', 'sequential'], false), ('sequential_flow', 3, ['CHUNK', 'CHUNK', 'CHUNK', 'CHUNK'], ['sequential', 'sequential', 'sequential'], true)) t(pattern, hops, granularities, connections, cross_document)")
def k8_templates(spark, sf):
    t = paths.templates(spark)
    return t.select("pattern", "hops", F.array_join("granularities", ",").alias("granularities"), F.array_join("connections", ",").alias("connections"), "cross_document")


_PATHS = """e AS (SELECT source_chunk_id AS a, target_chunk_id AS b, min(source_document) AS da, min(target_document) AS db, md5(source_chunk_id || '>' || target_chunk_id) AS h FROM connections
 WHERE source_chunk_id IS NOT NULL AND target_chunk_id IS NOT NULL AND similarity_score >= 0.9 AND NOT isnan(similarity_score) GROUP BY 1, 2),
p AS (SELECT a || '>' || b AS path_id, ['raw_similarity', 'theme_bridge', 'hierarchical', 'sequential', 'entity_overlap'][('0x' || substr(h, 1, 2))::INTEGER % 5 + 1] AS c, ['DOCUMENT', 'CHUNK', 'SENTENCE'][('0x' || substr(h, 3, 2))::INTEGER % 3 + 1] AS g,
 ['DOCUMENT', 'CHUNK', 'SENTENCE'][('0x' || substr(h, 5, 2))::INTEGER % 3 + 1] AS g2, coalesce(da, '') AS d, coalesce(db, '') AS d2, ('0x' || substr(h, 7, 1))::INTEGER AS bad FROM e)"""


@query(
    f"""WITH {_PATHS}, r AS (SELECT *, CASE c WHEN 'raw_similarity' THEN ['CHUNK'] WHEN 'theme_bridge' THEN ['DOCUMENT', 'CHUNK'] ELSE ['DOCUMENT', 'CHUNK', 'SENTENCE'] END AS ok FROM p),
f AS (SELECT path_id, CASE WHEN bad = 0 THEN ['nodes'] WHEN bad = 1 THEN ['documents'] ELSE list_filter([
  CASE WHEN NOT list_contains(ok, g) THEN 'hop 0: source granularity' END, CASE WHEN NOT list_contains(ok, g2) THEN 'hop 0: target granularity' END,
  CASE WHEN c = 'sequential' AND g = 'SENTENCE' AND d <> d2 THEN 'hop 0: crosses documents' END,
  CASE WHEN ((c = 'sequential' AND g = 'DOCUMENT') OR (c = 'theme_bridge' AND g IN ('DOCUMENT', 'CHUNK'))) AND d = d2 THEN 'hop 0: stays in its document' END,
  CASE WHEN c = 'hierarchical' AND NOT ((g = 'DOCUMENT' AND g2 = 'CHUNK') OR (g = 'CHUNK' AND g2 = 'SENTENCE')) THEN 'hop 0: not one level down' END], lambda x: x IS NOT NULL) END AS errors, bad FROM r)
SELECT path_id, 1 AS total_hops, errors, len(errors) = 0 AS is_valid FROM f"""
)
def k5_checked_paths(spark, sf):
    """One-hop paths along the strong stored edges, their kinds made from a hash, so that every rule is broken somewhere."""
    return paths.checked(_made_paths(spark, sf), "theme_bridge")


def _made_paths(spark, sf):
    c = table(spark, sf, "connections").filter("source_chunk_id IS NOT NULL AND target_chunk_id IS NOT NULL AND similarity_score >= 0.9 AND NOT isnan(similarity_score)")
    e = c.groupBy(F.col("source_chunk_id").alias("a"), F.col("target_chunk_id").alias("b")).agg(F.min("source_document").alias("da"), F.min("target_document").alias("db"))
    h = F.md5(F.concat_ws(">", "a", "b"))
    byte = lambda at, n=2: F.conv(F.substring(h, at, n), 16, 10).cast("int")
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), k)
    bad = byte(7, 1)
    d = F.array(F.coalesce("da", F.lit("")), F.coalesce("db", F.lit("")))
    return e.select(
        F.concat_ws(">", "a", "b").alias("path_id"), F.when(bad == 0, F.array("a")).otherwise(F.array("a", "b")).alias("nodes"), F.array(pick(list(paths.ALLOWED), byte(1) % 5)).alias("connections"),
        F.array(pick(list(paths.LEVELS), byte(3) % 3), pick(list(paths.LEVELS), byte(5) % 3)).alias("granularities"), F.when(bad == 1, F.slice(d, 1, 1)).otherwise(d).alias("documents"),
    )


@query(
    f"""WITH {_PATHS} SELECT path_id, 1 AS total_hops, CASE WHEN bad = 0 THEN 'nodes;' WHEN bad = 1 THEN 'documents;' ELSE '' END || 'wrong number of hops;wrong number of hops for dimensions' AS rules, false AS is_valid FROM p WHERE bad < 2"""
)
def k6_dimensions(spark, sf):
    got = paths.checked(_made_paths(spark, sf).filter("size(nodes) < 2 OR size(documents) < 2"), "multi_dimensional")
    return got.select("path_id", "total_hops", F.array_join("errors", ";").alias("rules"), "is_valid")


# --- display data -------------------------------------------------------------------------------------------------------

_STEPS = f"""a AS (SELECT query_id, path, sources FROM ({walk_sql.basic(_GRAPH)})),
st AS (SELECT query_id, (unnest(range(1, len(path) + 1)) - 1)::INTEGER AS step, unnest(path) AS id, len(path) - 1 AS fin FROM a),
sx AS (SELECT query_id, step, st.id, n.source_article AS document, coalesce(try_cast(nullif(regexp_extract(st.id, '(?:^|_)window_([0-9]+)(?:_|$)', 1), '') AS INTEGER), -1) AS idx, step = fin AS last
 FROM st LEFT JOIN (SELECT chunk_id AS id, coalesce(min(source_article), '') AS source_article FROM chunk_embeddings WHERE chunk_id IS NOT NULL AND {_USABLE} GROUP BY 1) n ON n.id = st.id)"""


def _steps(spark, sf):
    q, g = _graph(spark, sf)
    answers = traversal.basic(q, g)
    return answers, display.steps(answers, g.nodes)


@query(f"WITH {_STEPS} SELECT * FROM sx")
def v1_steps(spark, sf):
    return _steps(spark, sf)[1]


@query(f"WITH {_STEPS}, f AS (SELECT query_id, document, min(step) AS first_step FROM sx GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_step, document)::INTEGER AS place FROM f QUALIFY place <= 6")
def v2_involved_documents(spark, sf):
    return display.involved(_steps(spark, sf)[1])


_WINDOWED = f"""cw AS (SELECT DISTINCT chunk_id AS id, coalesce(source_article, '') AS document, coalesce(try_cast(nullif(regexp_extract(chunk_id, '(?:^|_)window_([0-9]+)(?:_|$)', 1), '') AS INTEGER), -1) AS idx FROM chunks WHERE chunk_id IS NOT NULL)"""


def _numbered(spark, sf):
    c = table(spark, sf, "chunks").filter("chunk_id IS NOT NULL")
    return c.select(F.col("chunk_id").alias("id"), F.coalesce("source_article", F.lit("")).alias("document"), F.coalesce(T.start_index(F.col("chunk_id")), F.lit(-1)).alias("idx")).distinct()


@query(
    f"""WITH {_STEPS}, {_WINDOWED}, sp AS (SELECT query_id, document, min(idx) FILTER (idx >= 0) AS lo, max(idx) FILTER (idx >= 0) AS hi FROM sx GROUP BY 1, 2), nn AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY idx, id) AS n FROM cw)
SELECT sp.query_id, sp.document, nn.id, nn.idx, EXISTS (SELECT 1 FROM sx WHERE sx.query_id = sp.query_id AND sx.id = nn.id) AS visited FROM sp JOIN nn ON nn.document = sp.document WHERE CASE WHEN lo IS NULL THEN n <= 15 ELSE idx BETWEEN lo - 3 AND hi + 3 END"""
)
def v3_reading_windows(spark, sf):
    return display.reading_windows(_steps(spark, sf)[1], _numbered(spark, sf))


@query(f"WITH {_WINDOWED} SELECT document, row_number() OVER (PARTITION BY document ORDER BY idx, id)::INTEGER AS place, id FROM cw")
def v4_chunks_in_order(spark, sf):
    return display.in_order(_numbered(spark, sf))


@query(
    f"""WITH {_STEPS}, f AS (SELECT *, CASE WHEN lag(document) OVER w IS NULL OR document <> lag(document) OVER w OR abs(idx - lag(idx) OVER w) > 8 THEN 1 ELSE 0 END AS new FROM sx WINDOW w AS (PARTITION BY query_id ORDER BY step)),
s AS (SELECT *, sum(new) OVER (PARTITION BY query_id ORDER BY step) AS session FROM f), g AS (SELECT query_id AS path_id, session::BIGINT AS session, document, min(step) AS first_step, max(step) AS last_step, count(*) AS n FROM s GROUP BY 1, 2, 3),
k AS (SELECT *, count(*) OVER (PARTITION BY path_id) AS c FROM g)
SELECT path_id, session, CASE WHEN length(document) > CASE WHEN c > 1 THEN 12 ELSE 25 END THEN substr(document, 1, CASE WHEN c > 1 THEN 12 ELSE 25 END) || '...' ELSE document END || ' (' || CASE WHEN first_step = last_step THEN 'step ' || first_step ELSE 'steps ' || first_step || '-' || last_step END || ')' AS title FROM k"""
)
def v7_session_titles(spark, sf):
    s = _steps(spark, sf)[1].select(F.col("query_id").alias("path_id"), "step", "document", "idx")
    return display.session_titles(paths.sessions(s)).select("path_id", "session", "title")


@query(f"WITH {_STEPS} SELECT query_id, query_id AS id, 'query' AS kind, false AS is_final, 1 AS place FROM a UNION ALL SELECT query_id, id, 'chunk', fin, (1 + row_number() OVER (PARTITION BY query_id ORDER BY NOT fin, step, id))::INTEGER FROM (SELECT st.query_id, st.id, min(step) AS step, bool_or(list_contains(a.sources, st.id)) AS fin FROM st JOIN a ON a.query_id = st.query_id GROUP BY 1, 2)")
def v9_shown_nodes(spark, sf):
    return display.shown_nodes(_steps(spark, sf)[0])


@query(f"SELECT chunk_id, len(embedding)::INTEGER AS d FROM chunk_embeddings WHERE embedding IS NOT NULL AND len(embedding) = (SELECT len(embedding) FROM chunk_embeddings WHERE embedding IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)")
def v10_common_dimension(spark, sf):
    return display.common_dimension(table(spark, sf, "chunk_embeddings"), "embedding").select("chunk_id", F.size("embedding").alias("d"))


# --- sources ------------------------------------------------------------------------------------------------------------


@query()
def a5_processed_articles(spark, sf):
    a, _ = A.processed(table(spark, sf, "articles").select("title", "url", "raw_text").distinct(), 100, 5_000_000, 3)
    return a.select("title", "url", F.col("metadata.word_count").alias("word_count"), F.col("metadata.sentence_count").alias("sentence_count"))


@query("SELECT id, list_transform(p, lambda x: replace(x, ' | ', ' ; ')) AS passages FROM (SELECT DISTINCT id, CASE WHEN json_valid(context) AND json_type(context::JSON) = 'ARRAY' THEN (context::JSON)::VARCHAR[] ELSE string_split(context, ' | ') END AS p FROM goldens WHERE id IS NOT NULL AND context IS NOT NULL)")
def a16_golden_passages(spark, sf):
    g = table(spark, sf, "goldens").filter("id IS NOT NULL AND context IS NOT NULL").select("id", "context").distinct()
    return g.select("id", F.transform(G.passages(F.col("context")), lambda x: F.replace(x, F.lit(" | "), F.lit(" ; "))).alias("passages")).distinct()


@query("WITH g AS (SELECT id, min(input) AS input, min(expectedOutput) AS e, min(actualOutput) AS a FROM goldens WHERE id IS NOT NULL GROUP BY 1) SELECT coalesce(input, '') AS input, coalesce(e, '') AS expected_output, coalesce(a, '') AS actual_output, array_to_string(list_transform(list_filter([input, e], lambda x: x IS NOT NULL), lambda x: replace(x, ' | ', ' ; ')), ' | ') AS context, '' AS retrieval_context FROM g")
def a14_exported_goldens(spark, sf):
    g = table(spark, sf, "goldens").filter("id IS NOT NULL").groupBy("id").agg(F.min("input").alias("input"), F.min("expectedOutput").alias("expected_output"), F.min("actualOutput").alias("actual_output"))
    return G.exported(g.select("input", "expected_output", "actual_output", F.array("input", "expected_output").alias("context"), F.lit(None).cast("array<string>").alias("retrieval_context")))
