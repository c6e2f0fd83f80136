"""The core's queries by name (the letter and number of the operator inventory), with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemesh.functions import text as T
from passagemesh.operators import corpus, evaluate, graph, grouping, paths, rerank, similarity, themes, traversal
from passagemesh.plans import walk_sql
from passagemesh.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


WS = "[ \\t\\n\\r\\f]"
_WORDS = f"len(list_filter(regexp_split_to_array(trim({{0}}), '{WS}+'), lambda w: w <> ''))"
_IS_QUERY = "(('0x' || substr(md5(id), 1, 6))::BIGINT % 20 = 0)"

# --- text -------------------------------------------------------------------------------------------------------------


def _clean_sql() -> str:
    x = "raw_text"
    sub = lambda p, r="": f"regexp_replace({x}, '{p}', '{r}', 'g')"
    for t in T.TAILS:
        x = sub(f"(?is)==+{WS}*{t}{WS}*==+.*")
    for _ in range(2):
        x = sub(f"={{2,}}{WS}*[^=\\n]+?{WS}*={{2,}}")
    blank = "[\\t-\\r\\x{1c}-\\x{1f}\\x{85}\\p{Z}]"
    x = sub(f"\\n{blank}*=+[^=\\n]*=+{blank}*\\n", "\n")
    x = sub(f"(?m)^=+[^=\\n]*=+{blank}*")
    x = sub(f"(?m){blank}*=+[^=\\n]*=+$")
    x = sub("\\[[0-9 ,\\-]+\\]")
    for n in T.NOTES:
        x = sub(f"(?i)\\[{n}\\]")
    x = sub("(?s)\\{\\|.*?\\|\\}")
    for a, b in (("–", "-"), ("—", "-"), ("…", "..."), ('\\"', '"'), ("\\''", "''"), ("\\n", " "), ("\\t", " ")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"SELECT DISTINCT url, trim({sub(blank + '+', ' ')}) AS cleaned FROM articles WHERE length(raw_text) BETWEEN 0 AND 5000000"


@query(_clean_sql())
def b8_clean_text(spark, sf):
    return corpus.cleaned(table(spark, sf, "articles")).distinct()


@query(
    """WITH s AS (SELECT DISTINCT url, title, unnest(range(len(sentences))) AS idx, unnest(sentences) AS sentence FROM articles WHERE sentences IS NOT NULL)
SELECT url, title, idx::INTEGER AS idx, sentence FROM s WHERE sentence IS NOT NULL AND length(sentence) BETWEEN 10 AND 500
 AND NOT regexp_matches(sentence, '^[0-9 .,;:!?-]+$')
 AND (length(sentence) - length(regexp_replace(sentence, '[^\\p{L}\\p{N}_ \\t\\n\\r\\f]', '', 'g')))::DOUBLE / length(sentence) <= 0.3
 AND NOT (sentence = upper(sentence) AND sentence <> lower(sentence) AND length(sentence) < 50)
 AND regexp_matches(sentence, '[a-zA-Z]')
 AND length(sentence) - length(replace(sentence, '(', '')) <= 2 AND length(sentence) - length(replace(sentence, '[', '')) <= 2"""
)
def b11_valid_sentences(spark, sf):
    return corpus.valid_sentences(table(spark, sf, "articles")).distinct()


_COUNTS = f"""SELECT {{0}} url, CASE WHEN cleaned_text IS NULL THEN 0 ELSE {_WORDS.format('cleaned_text')} END AS word_count, coalesce(length(cleaned_text), 0) AS char_count,
 coalesce(len(sentences), 0) AS sentence_count, md5(raw_text) AS source_hash FROM articles"""


@query(_COUNTS.format("DISTINCT"))
def b12_text_counts(spark, sf):
    return corpus.text_counts(table(spark, sf, "articles")).distinct()


@query(
    f"WITH c AS ({_COUNTS.format('')}) SELECT count(*) AS articles, sum(sentence_count)::BIGINT AS sentences, sum(word_count)::BIGINT AS words, sum(char_count)::BIGINT AS chars, round(avg(sentence_count), 6) AS avg_sentences, round(avg(word_count), 6) AS avg_words FROM c"
)
def q_corpus_statistics(spark, sf):
    return corpus.corpus_statistics(table(spark, sf, "articles"))


_WINDOWS = """WITH a AS (SELECT DISTINCT title, sentences, len(sentences)::INTEGER AS n FROM articles WHERE sentences IS NOT NULL AND len(sentences) >= 3 AND title IS NOT NULL),
w AS (SELECT title, sentences, n, unnest(range(n - 2))::INTEGER AS s FROM a)
SELECT DISTINCT substr(translate(title, ' /', '__'), 1, 50) || '_window_' || s || '_' || (s + 3) || '_' || substr(md5(title || '_' || s || '_' || (s + 3)), 1, 8) AS chunk_id,
 array_to_string(list_transform(sentences[s + 1:s + 3], lambda x: coalesce(x, '\x00')), ' ') AS text, title AS source_article, [s, s + 1, s + 2] AS source_sentences, s AS window_position, n - 2 AS total_windows, s AS start_sentence_idx, s + 2 AS end_sentence_idx FROM w"""


@query(_WINDOWS.replace("list_transform(sentences[s + 1:s + 3], lambda x: coalesce(x, '\x00'))", "sentences[s + 1:s + 3]"))
def c3_windows(spark, sf):
    return corpus.windows(table(spark, sf, "articles").filter("title IS NOT NULL").select("title", "sentences").distinct())


@query(
    f"""WITH c AS (SELECT source_article, {_WORDS.format('text')} AS w, len(source_sentences) AS s FROM chunks)
SELECT count(*) AS chunks, count(DISTINCT source_article) AS articles, round(count(*) / count(DISTINCT source_article), 6) AS per_article, round(avg(w), 6) AS avg_words, min(w)::INTEGER AS min_words, max(w)::INTEGER AS max_words, min(s)::INTEGER AS min_sentences, max(s)::INTEGER AS max_sentences FROM c"""
)
def c5_window_statistics(spark, sf):
    return corpus.window_statistics(table(spark, sf, "chunks"))


_SUMMARIES = "SELECT DISTINCT 'doc_' || substr(md5(title), 1, 8) AS doc_id, title, array_to_string(sentences[1:5], ' ') AS summary FROM articles WHERE title IS NOT NULL AND trim(array_to_string(sentences[1:5], ' ')) <> ''"


@query(_SUMMARIES)
def d6_summaries(spark, sf):
    return corpus.summaries(table(spark, sf, "articles"))


@query(
    """WITH e AS (SELECT DISTINCT source_article, chunk_id, start_sentence_idx, unnest(source_sentences) AS idx FROM chunks WHERE chunk_id IS NOT NULL AND source_sentences IS NOT NULL)
SELECT source_article, idx, list(chunk_id ORDER BY start_sentence_idx NULLS FIRST, chunk_id) AS chunk_ids FROM e GROUP BY 1, 2"""
)
def d5_containing_chunks(spark, sf):
    return corpus.containing_chunks(table(spark, sf, "chunks"))


@query(
    """WITH o AS (SELECT DISTINCT chunk_id, source_article, start_sentence_idx FROM chunks WHERE chunk_id IS NOT NULL)
SELECT chunk_id, lag(chunk_id) OVER w AS previous_id, lead(chunk_id) OVER w AS next_id FROM o WINDOW w AS (PARTITION BY source_article ORDER BY start_sentence_idx NULLS FIRST, chunk_id)"""
)
def e11_sequential_neighbours(spark, sf):
    return corpus.sequential_neighbours(table(spark, sf, "chunks"))


# --- vectors and edges --------------------------------------------------------------------------------------------------

_USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))"
_NODES = f"""valid AS (SELECT chunk_id AS id, min(source_article) AS doc, first(embedding) AS e FROM chunk_embeddings WHERE chunk_id IS NOT NULL AND {_USABLE} GROUP BY 1),
nodes AS (SELECT id, coalesce(doc, '') AS doc, e AS raw, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS vec FROM valid)"""
_EDGES = """clean AS (SELECT source_chunk_id AS src, target_chunk_id AS dst, max(similarity_score) AS sim, min(connection_type) AS type FROM connections
 WHERE source_chunk_id <> target_chunk_id AND similarity_score IS NOT NULL AND NOT isnan(similarity_score) GROUP BY 1, 2),
edges AS (SELECT *, row_number() OVER (PARTITION BY src, type ORDER BY sim DESC, dst) AS rank FROM clean WHERE sim >= CASE WHEN type = 'intra_document' THEN 0.4 ELSE 0.3 END
 QUALIFY rank <= CASE WHEN type = 'intra_document' THEN 15 ELSE 5 END)"""


def _nodes(spark, sf):
    n = similarity.nodes(table(spark, sf, "chunk_embeddings"), "chunk_id")
    return n.withColumn("doc", F.coalesce("doc", F.lit("")))


def _edges(spark, sf):
    return similarity.sparse_edges(similarity.clean_edges(table(spark, sf, "connections")))


@query(f"SELECT count(*) AS vectors, max(len(embedding))::INTEGER AS dimension, round(avg(n), 6) AS mean_norm, round(stddev_pop(n), 6) AS std_norm FROM (SELECT embedding, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS n FROM chunk_embeddings WHERE {_USABLE})")
def d8_vector_statistics(spark, sf):
    return similarity.vector_statistics(table(spark, sf, "chunk_embeddings"))


def _top_sql(on: str, k: int, least: float, queries: str) -> str:
    return f"""WITH {_NODES}, p AS (SELECT a.id AS src, b.id AS dst, round(list_dot_product(a.vec, b.vec), 9) AS sim FROM (SELECT * FROM nodes WHERE {queries}) a JOIN nodes b ON {on} AND a.id <> b.id)
SELECT src, dst, round(sim, 6) AS sim, row_number() OVER (PARTITION BY src ORDER BY p.sim DESC, dst)::INTEGER AS rank FROM p WHERE p.sim >= {least} QUALIFY rank <= {k}"""


_shown = lambda df: df.withColumn("sim", F.round("sim", 6))


@query(_top_sql("a.doc = b.doc", 15, 0.4, "true"))
def e3_intra_document(spark, sf):
    n = _nodes(spark, sf)
    return _shown(similarity.top_similar(n, n, 15, 0.4, same_doc=True))


@query(_top_sql("a.doc <> b.doc", 5, 0.3, _IS_QUERY))
def e4_inter_document(spark, sf):
    n = _nodes(spark, sf)
    return _shown(similarity.top_similar(n.filter(traversal.is_query(F.col("id"))), n, 5, 0.3, same_doc=False))


@query(f"WITH {_EDGES} SELECT src, dst, sim, type, rank::INTEGER AS rank FROM edges")
def e5_sparse_edges(spark, sf):
    return _edges(spark, sf)


@query(f"WITH {_EDGES} SELECT type, count(*) AS n, count(DISTINCT src) AS sources, round(avg(sim), 6) AS avg_sim, round(min(sim), 9) AS min_sim, round(max(sim), 9) AS max_sim FROM edges GROUP BY 1")
def e8_edge_statistics(spark, sf):
    return similarity.edge_statistics(_edges(spark, sf))


@query(f"WITH {_EDGES} SELECT src, dst, round(sum(sim), 9) AS value FROM clean GROUP BY 1, 2")
def e6_coordinates(spark, sf):
    return similarity.coordinates(similarity.clean_edges(table(spark, sf, "connections")))


# --- themes -------------------------------------------------------------------------------------------------------------


# Written out again, so that the query's table is checked.
_THEMES = """Artificial Intelligence: artificial intelligence, ai, machine intelligence
Machine Learning: machine learning, ml, learning algorithms
Neural Networks: neural networks, neural nets, artificial neural
Deep Learning: deep learning, deep neural, convolutional
Natural Language Processing: natural language, nlp, text processing
Computer Vision: computer vision, image recognition, visual
Data Science: data science, data analysis, big data
Robotics: robotics, robots, autonomous
Psychology: psychology, psychological, behavior, cognitive
Neuroscience: neuroscience, brain, neural, cognitive science
History: history, historical, past, century
Technology: technology, technological, computing, computer
Research: research, study, studies, investigation
Education: education, learning, teaching, academic"""


def _keyword_sql() -> str:
    lines = [line.split(": ") for line in _THEMES.split("\n")]
    cases = ", ".join("CASE WHEN " + " OR ".join(f"contains(t, '{k}')" for k in keys.split(", ")) + f" THEN '{name}' END" for name, keys in lines)
    marked = "regexp_replace(coalesce(doc_summary, ''), '([\\p{L}\\p{N}_]+)', '\x01\\1\x02', 'g')"  # words between marks
    phrases = f"list_transform(regexp_extract_all({marked}, '\x01[A-Z][a-z]+\x02(?:[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+\x01[A-Z][a-z]+\x02)*'), lambda x: replace(replace(x, '\x01', ''), '\x02', ''))"
    return f"""WITH d AS (SELECT DISTINCT doc_id, title, doc_summary, lower(concat_ws(' ', title, doc_summary)) AS t FROM document_nodes),
h AS (SELECT doc_id, doc_summary, list_filter([{cases}], lambda x: x IS NOT NULL) AS hits FROM d)
SELECT doc_id, CASE WHEN len(hits) > 0 THEN hits[1:5] ELSE {{phrases}} END AS themes FROM h""".replace("{phrases}", f"(SELECT coalesce(list(p ORDER BY i), []) FROM (SELECT p, min(i) AS i FROM (SELECT unnest(ph) AS p, unnest(range(len(ph))) AS i FROM (SELECT {phrases} AS ph)) GROUP BY p ORDER BY i LIMIT 5))")


@query(_keyword_sql())
def f5_keyword_themes(spark, sf):
    d = table(spark, sf, "document_nodes").select("doc_id", "title", "doc_summary").distinct()
    return d.select("doc_id", themes.fallback_themes(F.col("title"), F.col("doc_summary")).alias("themes"))


@query("SELECT DISTINCT doc_id, list_filter(list_transform(themes, lambda x: trim(x)), lambda x: x <> '')[1:5] AS themes FROM theme_results WHERE themes IS NOT NULL")
def f4_parsed_themes(spark, sf):
    """Themes written as a model's fenced reply and parsed again."""
    r = table(spark, sf, "theme_results").filter("themes IS NOT NULL").select("doc_id", F.concat(F.lit("Here you are:\n```json\n"), F.to_json("themes"), F.lit("\n```")).alias("reply"))
    return r.select("doc_id", themes.parse_themes(F.col("reply")).alias("themes")).distinct()


_DOC_THEMES = "t AS (SELECT DISTINCT doc_id, lower(trim(x)) AS theme FROM (SELECT doc_id, unnest(themes) AS x FROM theme_results WHERE doc_id IS NOT NULL) WHERE trim(x) <> '')"


@query(f"WITH {_DOC_THEMES}, p AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1) SELECT count(*) AS documents, round(avg(n), 6) AS avg_themes, min(n) AS min_themes, max(n) AS max_themes, (SELECT count(DISTINCT theme) FROM t) AS distinct_themes FROM p")
def f7_theme_statistics(spark, sf):
    return themes.theme_statistics(table(spark, sf, "theme_results"))


@query(
    """WITH e AS (SELECT doc_id, unnest(map_keys(theme_similarity_scores)) AS similar_id, unnest(map_values(theme_similarity_scores)) AS score FROM document_nodes WHERE doc_id IS NOT NULL),
o AS (SELECT doc_id, similar_id, max(score) AS score FROM e WHERE score >= 0.2 AND similar_id <> doc_id GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, similar_id)::INTEGER AS rank FROM o QUALIFY rank <= 3"""
)
def f9_theme_edges(spark, sf):
    return themes.theme_edges(table(spark, sf, "document_nodes"), best=3)


@query(
    """SELECT DISTINCT c.chunk_id, d.theme FROM (SELECT DISTINCT title, unnest(doc_themes) AS theme FROM document_nodes WHERE title IS NOT NULL) d
JOIN chunks c ON c.source_article = d.title WHERE d.theme IS NOT NULL AND c.chunk_id IS NOT NULL"""
)
def f11_inherited_themes(spark, sf):
    return themes.inherited(table(spark, sf, "document_nodes"), table(spark, sf, "chunks"))


# --- graph --------------------------------------------------------------------------------------------------------------


@query(
    f"""WITH s AS ({_SUMMARIES}), m AS (SELECT title, max(summary) AS summary FROM s GROUP BY 1),
c AS (SELECT DISTINCT source_article AS title, start_sentence_idx, chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND source_article IS NOT NULL),
g AS (SELECT title, list(chunk_id ORDER BY start_sentence_idx NULLS FIRST, chunk_id) AS chunk_ids FROM c GROUP BY 1)
SELECT g.title, chunk_ids, summary FROM g LEFT JOIN m ON g.title = m.title"""
)
def g2_document_nodes(spark, sf):
    return graph.document_nodes(table(spark, sf, "chunks"), corpus.summaries(table(spark, sf, "articles")))


@query(
    f"""WITH {_NODES}, {_EDGES}, a AS (SELECT src, list(dst ORDER BY rank) FILTER (type = 'intra_document') AS intra, list(dst ORDER BY rank) FILTER (type = 'inter_document') AS inter FROM edges GROUP BY 1)
SELECT id AS chunk_id, doc, coalesce(intra, []) AS intra, coalesce(inter, []) AS inter FROM nodes LEFT JOIN a ON src = id"""
)
def g4_chunk_nodes(spark, sf):
    return graph.chunk_nodes(_nodes(spark, sf), _edges(spark, sf))


@query("SELECT sentence_id, max({'doc': source_article, 's': coalesce(containing_chunks[1], '')}).doc AS doc, max({'doc': source_article, 's': coalesce(containing_chunks[1], '')}).s AS source_chunk FROM sentence_embeddings WHERE sentence_id IS NOT NULL GROUP BY 1")
def g5_sentence_nodes(spark, sf):
    return graph.sentence_nodes(table(spark, sf, "sentence_embeddings"))


@query("SELECT DISTINCT chunk_id, sentence_id FROM (SELECT unnest(containing_chunks) AS chunk_id, sentence_id FROM sentence_embeddings WHERE sentence_id IS NOT NULL) WHERE chunk_id IS NOT NULL")
def g6_bridge(spark, sf):
    return graph.bridge(table(spark, sf, "sentence_embeddings"))


_QUALITY = "q AS (SELECT DISTINCT id, CASE WHEN json_valid(additionalMetadata) THEN (additionalMetadata::JSON ->> 'synthetic_input_quality')::DOUBLE END AS score FROM goldens WHERE id IS NOT NULL)"


@query(f"WITH {_QUALITY} SELECT CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.7 * 0.7 THEN 'medium' WHEN score IS NOT NULL THEN 'low' ELSE 'unscored' END AS tier, count(*) AS n, round(avg(score), 6) AS avg_score FROM q GROUP BY 1")
def g12_quality_statistics(spark, sf):
    m = evaluate.golden_metadata(table(spark, sf, "goldens")).select("id", F.col("quality").alias("score")).distinct()
    return graph.quality_statistics(m)


# --- retrieval ----------------------------------------------------------------------------------------------------------

_ANCHOR = """queries AS (SELECT * FROM nodes WHERE {q}), sims AS (SELECT q.id AS query_id, n.id AS id, n.doc AS doc, round(list_dot_product(q.vec, n.vec), 9) AS sim FROM queries q CROSS JOIN nodes n)""".format(q=_IS_QUERY)
_GRAPH = f"{_NODES}, {_EDGES}, {_ANCHOR}, {walk_sql.sentences(_USABLE)}"


def _graph(spark, sf):
    """The stated queries and the graph."""
    n = _nodes(spark, sf)
    return n.filter(traversal.is_query(F.col("id"))).select("id", "raw", "vec"), traversal.graph(n, _edges(spark, sf), table(spark, sf, "sentence_embeddings"))


_answers_of = lambda df: df.withColumn("confidence", F.transform("confidence", lambda x: F.round(x, 6)))


@query(f"WITH {_NODES}, {_ANCHOR} SELECT query_id, id, round(sims.sim, 6) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY sims.sim DESC, id)::INTEGER AS rank FROM sims QUALIFY rank <= 3")
def h2_anchors(spark, sf):
    n = _nodes(spark, sf)
    return _shown(traversal.anchors(n.filter(traversal.is_query(F.col("id"))), n, 3))


def _chosen(ids, n):
    """A stand-in for a model's choice: the second candidate where the document has changed enough to have one, an end at eight sentences."""
    return F.when(n >= 8, 0).when(F.size(ids) > 1, 2).otherwise(9)


_CHOSEN = "CASE WHEN len(ext) >= 8 THEN 0 WHEN len(ids) > 1 THEN 2 ELSE 9 END"


@query(walk_sql.basic(_GRAPH))
def i1_basic_retrieval(spark, sf):
    return _answers_of(traversal.basic(*_graph(spark, sf)))


@query(walk_sql.walk(_GRAPH, "query_traversal"))
def i2_query_traversal(spark, sf):
    return _answers_of(traversal.walk("query_traversal", *_graph(spark, sf)))


@query(walk_sql.walk(_GRAPH, "ssg_traversal"))
def i3_ssg_traversal(spark, sf):
    return _answers_of(traversal.walk("ssg_traversal", *_graph(spark, sf)))


@query(walk_sql.walk(_GRAPH, "triangulation_average"))
def i4_triangulation_average(spark, sf):
    return _answers_of(traversal.walk("triangulation_average", *_graph(spark, sf)))


@query()
def i5_triangulation_3d(spark, sf):
    return _answers_of(traversal.walk("triangulation_geometric_3d", *traversal.reduced(*_graph(spark, sf))))


@query(walk_sql.walk(_GRAPH, "triangulation_geometric_fulldim"))
def i6_triangulation_fulldim(spark, sf):
    return _answers_of(traversal.walk("triangulation_geometric_fulldim", *_graph(spark, sf)))


@query(walk_sql.walk(_GRAPH, "llm_guided_traversal", _CHOSEN))
def i7_guided_traversal(spark, sf):
    return _answers_of(traversal.walk("llm_guided_traversal", *_graph(spark, sf), chooser=_chosen))


# --- context groups -----------------------------------------------------------------------------------------------------

_PASSAGES = f"""{_NODES}, {_EDGES}, {walk_sql.sentences(_USABLE)},
starts AS (SELECT chunk_id AS id, min(start_sentence_idx) AS pos FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
passages AS (SELECT n.id, n.doc, coalesce(s.pos, 0) AS pos FROM nodes n LEFT JOIN starts s ON s.id = n.id),
texts AS (SELECT id, list_transform(l, lambda s: s.text) AS texts FROM held),
likes AS (SELECT a.title AS doc, b.title AS other, min(e.rank) AS rank FROM (SELECT doc_id, similar_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, similar_id) AS rank FROM (
  SELECT doc_id, similar_id, max(score) AS score FROM (SELECT doc_id, unnest(map_keys(theme_similarity_scores)) AS similar_id, unnest(map_values(theme_similarity_scores)) AS score FROM document_nodes WHERE doc_id IS NOT NULL) WHERE score >= 0.2 AND similar_id <> doc_id GROUP BY 1, 2)) e
  JOIN (SELECT DISTINCT doc_id, title FROM document_nodes WHERE title IS NOT NULL) a ON a.doc_id = e.doc_id JOIN (SELECT DISTINCT doc_id, title FROM document_nodes WHERE title IS NOT NULL) b ON b.doc_id = e.similar_id WHERE a.title <> b.title GROUP BY 1, 2)"""


def _passages(spark, sf):
    n = _nodes(spark, sf)
    g = traversal.graph(n, _edges(spark, sf), table(spark, sf, "sentence_embeddings"))
    starts = table(spark, sf, "chunks").filter("chunk_id IS NOT NULL").groupBy(F.col("chunk_id").alias("id")).agg(F.min("start_sentence_idx").alias("pos"))
    chunks = n.select("id", "doc").join(starts, "id", "left").select("id", "doc", F.coalesce("pos", F.lit(0)).alias("pos"), F.lit(None).cast("double").alias("quality"))
    names = table(spark, sf, "document_nodes").filter("title IS NOT NULL").select("doc_id", "title").distinct()
    like = themes.theme_edges(table(spark, sf, "document_nodes"), best=1_000_000)
    like = like.join(names.toDF("doc_id", "doc"), "doc_id").join(names.toDF("similar_id", "other"), "similar_id").filter("doc <> other").groupBy("doc", "other").agg(F.min("rank").alias("rank"))
    links = _edges(spark, sf).select("src", "dst", "sim")
    return grouping.Passages(chunks, links, g.held.select("id", F.transform("l", lambda s: s["text"]).alias("texts")), like)


def _group_anchors(g):
    return g.chunks.filter(traversal.is_query(F.col("id"))).select(F.col("id").alias("group_id"), "id")


def _grown_sql(strategy: str) -> str:
    keep = {"intra_document": "t.doc = w.home", "inter_document": "t.doc <> w.doc", "similarity": "true", "theme_based": "t.doc <> w.doc"}[strategy]
    rank = "coalesce(CASE WHEN e.sim > 0 THEN k.rank END, 1000000000)" if strategy == "theme_based" else "0"
    return f"""WITH RECURSIVE {_PASSAGES},
walk AS (
  SELECT p.id AS group_id, p.id AS cur, p.doc, p.doc AS home, [p.id] AS path, coalesce(t.texts, []::VARCHAR[]) AS have, false AS done, 0 AS hop FROM passages p LEFT JOIN texts t ON t.id = p.id WHERE {_IS_QUERY.replace('md5(id)', 'md5(p.id)')}
  UNION ALL
  SELECT group_id, coalesce(b.dst, cur), coalesce(b.doc, doc), home, CASE WHEN b IS NULL THEN path ELSE list_append(path, b.dst) END,
    CASE WHEN b IS NULL THEN have ELSE list_concat(have, list_filter(b.texts, lambda x: NOT list_contains(have, x)))[1:greatest(len(have), 10)] END, b IS NULL, hop + 1
  FROM (SELECT w.group_id, any_value(w.cur) AS cur, any_value(w.doc) AS doc, any_value(w.home) AS home, any_value(w.path) AS path, any_value(w.have) AS have, any_value(w.hop) AS hop,
      min({{'r': {rank}, 'n': -e.sim, 'dst': e.dst, 'doc': t.doc, 'texts': coalesce(x.texts, []::VARCHAR[])}}) FILTER (t.id IS NOT NULL AND {keep} AND NOT list_contains(w.path, e.dst) AND NOT list_has_any(w.have, coalesce(x.texts, []::VARCHAR[]))) AS b
    FROM walk w LEFT JOIN edges e ON e.src = w.cur AND len(w.have) < 10 LEFT JOIN passages t ON t.id = e.dst LEFT JOIN texts x ON x.id = e.dst LEFT JOIN likes k ON k.doc = w.doc AND k.other = t.doc
    WHERE NOT w.done AND w.hop < 50 GROUP BY w.group_id))
SELECT group_id, '{strategy}' AS strategy, path AS chunk_ids, have[1:10] AS sentences, CASE WHEN len(have) >= 10 THEN 'sentence_limit' ELSE 'no_more_chunks' END AS reason FROM walk WHERE done OR hop = 50"""


def _grown(strategy):
    def run(spark, sf):
        g = _passages(spark, sf)
        return grouping.grown(strategy, _group_anchors(g), g)

    return run


for _name, _strategy in (("m6_intra_document_groups", "intra_document"), ("m7_inter_document_groups", "inter_document"), ("m8_theme_based_groups", "theme_based"), ("m10_similarity_groups", "similarity")):
    QUERIES[_name], SQL[_name] = _grown(_strategy), _grown_sql(_strategy)


@query()
def m9_sequential_groups(spark, sf):
    g = _passages(spark, sf)
    return grouping.sequential(_group_anchors(g), g)


@query(
    f"""WITH {_NODES}, p AS (SELECT id, doc, md5('7:' || id) AS h, row_number() OVER (PARTITION BY doc ORDER BY md5('7:' || id), id) AS place FROM nodes),
n AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY h, id) - 1 AS n FROM p QUALIFY n < 60),
g AS (SELECT place, n // 3 AS part, list(id ORDER BY n) AS chunk_ids FROM n GROUP BY 1, 2 HAVING count(*) = 3)
SELECT 'native:' || place || ':' || part AS group_id, 'native' AS strategy, chunk_ids FROM g ORDER BY place, part LIMIT 20"""
)
def m11_native_groups(spark, sf):
    """Twenty groups: how many are drawn is the operator's own parameter."""
    return grouping.native(_passages(spark, sf).chunks, 20, 7)


@query(f"WITH {_NODES} SELECT id AS group_id, id FROM nodes ORDER BY md5('3:' || id), id LIMIT 50")
def m1_anchor_chunks(spark, sf):
    """Fifty anchors: how many are drawn is the operator's own parameter."""
    return grouping.anchor_chunks(_passages(spark, sf).chunks, 50, 3)


@query(
    f"""WITH {_PASSAGES}, f AS (SELECT id, lead(id) OVER (PARTITION BY doc ORDER BY pos, id) AS after FROM passages)
SELECT f.id AS src, f.after AS dst, coalesce(e.sim, 0.0) AS sim FROM f LEFT JOIN (SELECT src, dst, max(sim) AS sim FROM edges GROUP BY 1, 2) e ON e.src = f.id AND e.dst = f.after WHERE f.after IS NOT NULL"""
)
def m4_stored_similarity(spark, sf):
    g = _passages(spark, sf)
    return grouping.stored_similarity(grouping.flow(g).filter("after IS NOT NULL").select(F.col("cur").alias("src"), F.col("after").alias("dst")), g.links)


@query("SELECT * FROM (VALUES ('inter_document', 3), ('intra_document', 4), ('native', 1), ('theme_based', 4)) t(strategy, n_groups)")
def m13_strategy_counts(spark, sf):
    made = grouping.groups(_passages(spark, sf), {"intra_document": 0.33, "theme_based": 0.33, "inter_document": 0.2, "native": 0.14}, 12, 1)
    return grouping.strategy_counts(made).select("strategy", F.col("n_groups").cast("int").alias("n_groups"))


# --- paths --------------------------------------------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT DISTINCT source_article AS path_id, start_sentence_idx AS step FROM chunks WHERE source_article IS NOT NULL AND start_sentence_idx IS NOT NULL)
SELECT path_id, (count(*) - 1)::INTEGER AS hops, CASE WHEN count(*) - 1 BETWEEN 5 AND 10 THEN 0 ELSE 1 END AS n_errors, count(*) - 1 BETWEEN 5 AND 10 AS is_valid FROM p GROUP BY 1"""
)
def k7_validated_paths(spark, sf):
    c = table(spark, sf, "chunks").filter("source_article IS NOT NULL AND start_sentence_idx IS NOT NULL")
    p = c.select(F.col("source_article").alias("path_id"), F.col("start_sentence_idx").alias("step"), F.lit("CHUNK").alias("granularity"), F.col("source_article").alias("document"), F.lit("sequential").alias("connection")).distinct()
    return paths.validated(p, "sequential_flow")


@query(
    f"""WITH {_NODES}, {_ANCHOR}, r AS (SELECT query_id AS path_id, row_number() OVER (PARTITION BY query_id ORDER BY sims.sim DESC, id) AS step, doc AS document, coalesce(try_cast(regexp_extract(id, '_window_(\\d+)_', 1) AS INTEGER), -1) AS idx FROM sims QUALIFY step <= 20),
f AS (SELECT *, CASE WHEN lag(document) OVER w IS NULL OR document <> lag(document) OVER w OR abs(idx - lag(idx) OVER w) > 8 THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY path_id ORDER BY step)),
s AS (SELECT *, sum(new) OVER (PARTITION BY path_id ORDER BY step) AS session FROM f)
SELECT path_id, session::BIGINT AS session, document, min(step)::INTEGER AS first_step, max(step)::INTEGER AS last_step, count(*) AS n FROM s GROUP BY 1, 2, 3"""
)
def p5r_reading_sessions(spark, sf):
    n = _nodes(spark, sf)
    a = traversal.anchors(n.filter(traversal.is_query(F.col("id"))), n, 20).join(n.select("id", "doc"), "id")
    idx = F.coalesce(F.expr("try_cast(nullif(regexp_extract(id, '_window_([0-9]+)_', 1), '') AS INT)"), F.lit(-1))
    return paths.sessions(a.select(F.col("query_id").alias("path_id"), F.col("rank").alias("step"), F.col("doc").alias("document"), idx.alias("idx")))


# --- rerank -------------------------------------------------------------------------------------------------------------


def _rerank_inputs(spark, sf):
    g = table(spark, sf, "goldens").filter("id IS NOT NULL AND input IS NOT NULL AND expectedOutput IS NOT NULL").groupBy(F.col("id").alias("query_id")).agg(F.min("input").alias("text"), F.min("expectedOutput").alias("answer"))
    c = g.select("query_id", F.posexplode(F.filter(F.split("answer", "[.!?]+( +|$)"), lambda s: F.length(s) > 10)).alias("pos", "text"))
    return c, g.select("query_id", "text")


def _tfidf_sql() -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in rerank.STOP) + "]"
    return f"""{_tfidf_ctes(stop)}
SELECT query_id, pos, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity / (1.0 + 0.1 * pos), 9) DESC, pos)::INTEGER AS rank FROM s QUALIFY rank <= 10"""


def _tfidf_ctes(stop: str) -> str:
    return f"""WITH g AS (SELECT id AS query_id, min(input) AS text, min(expectedOutput) AS answer FROM goldens WHERE id IS NOT NULL AND input IS NOT NULL AND expectedOutput IS NOT NULL GROUP BY 1),
l AS (SELECT query_id, list_filter(regexp_split_to_array(answer, '[.!?]+( +|$)'), lambda s: length(s) > 10) AS p FROM g),
c AS (SELECT query_id, (unnest(range(1, len(p) + 1)) - 1)::INTEGER AS pos, unnest(p) AS text FROM l),
e AS (SELECT query_id, pos, text FROM c UNION ALL SELECT query_id, -1, text FROM g),
k AS (SELECT query_id, pos, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({stop}, w)) AS w FROM e),
x AS (SELECT query_id, pos, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM k),
t0 AS (SELECT query_id, pos, term, count(*) AS tf FROM x GROUP BY ALL),
t1 AS (SELECT query_id, term FROM (SELECT query_id, term, sum(tf) AS n FROM t0 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) <= 5000),
t AS (SELECT t0.* FROM t0 JOIN t1 ON t1.query_id = t0.query_id AND t1.term = t0.term),
n AS (SELECT query_id, count(*) AS n FROM e GROUP BY 1),
d AS (SELECT t.query_id, term, ln((1.0 + any_value(n.n)) / (1.0 + count(*))) + 1.0 AS idf FROM t JOIN n ON n.query_id = t.query_id GROUP BY ALL),
w AS (SELECT t.query_id, pos, t.term, tf * idf AS w FROM t JOIN d ON d.query_id = t.query_id AND d.term = t.term),
z AS (SELECT query_id, pos, sqrt(sum(w * w)) AS len FROM w GROUP BY ALL),
dots AS (SELECT a.query_id, a.pos, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.query_id = b.query_id AND a.term = b.term AND b.pos = -1 WHERE a.pos >= 0 GROUP BY ALL),
s AS (SELECT c.query_id, c.pos, round(coalesce(dot / (z.len * q.len), 0), 9) AS similarity FROM c LEFT JOIN dots ON dots.query_id = c.query_id AND dots.pos = c.pos LEFT JOIN z ON z.query_id = c.query_id AND z.pos = c.pos LEFT JOIN z q ON q.query_id = c.query_id AND q.pos = -1)"""


_STOP = "[" + ", ".join(f"'{w}'" for w in rerank.STOP) + "]"
_WORD_SET = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'))"
_COMMON = "['the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by', 'is', 'are', 'was', 'were', 'how', 'what', 'why', 'when', 'where']"
_RANKED = f"""{_tfidf_ctes(_STOP)},
k0 AS (SELECT s.query_id, s.pos, s.similarity, round(s.similarity / (1.0 + 0.1 * s.pos), 9) AS score, c.text, g.text AS q FROM s JOIN c ON c.query_id = s.query_id AND c.pos = s.pos JOIN g ON g.query_id = s.query_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM k0 QUALIFY rank <= 10),
lasts AS (SELECT *, unnest(range(rank + 1, 11)) AS more FROM ranked QUALIFY rank = max(rank) OVER (PARTITION BY query_id)),
pads AS (SELECT * EXCLUDE (rank), rank, false AS is_padding FROM ranked UNION ALL SELECT * EXCLUDE (rank, more), more, true FROM lasts)"""


@query(_tfidf_sql())
def l1_tfidf(spark, sf):
    return rerank.tfidf(*_rerank_inputs(spark, sf)).select("query_id", "pos", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    f"""{_RANKED}, h AS (SELECT query_id, pos, rank AS was, is_padding, 0.6::DOUBLE * similarity + 0.2::DOUBLE * (CASE WHEN n < 15 THEN n / 15.0::DOUBLE WHEN n > 50 THEN greatest(0.3::DOUBLE, 50.0::DOUBLE / n) ELSE 1.0::DOUBLE END)
  + 0.2::DOUBLE * least(1.0::DOUBLE, len(list_filter(w, lambda x: list_contains(t, x)))::DOUBLE / greatest(1, len(w))) AS own
 FROM (SELECT *, {_WORDS.format('text')} AS n, list_filter({_WORD_SET('q')}, lambda x: NOT list_contains({_COMMON}, x)) AS w, {_WORD_SET('text')} AS t FROM pads)),
f AS (SELECT query_id, pos, was, is_padding, round(CASE WHEN is_padding THEN own * 0.1::DOUBLE ELSE own END, 9) AS score FROM h)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was)::INTEGER AS rank, pos, round(score, 6) AS score, is_padding FROM f"""
)
def l4_hybrid(spark, sf):
    return rerank.hybrid(*_rerank_inputs(spark, sf)).withColumn("score", F.round("score", 6))


@query("WITH g AS (SELECT id AS query_id, min(expectedOutput) AS answer FROM goldens WHERE id IS NOT NULL AND input IS NOT NULL AND expectedOutput IS NOT NULL GROUP BY 1), l AS (SELECT query_id, list_filter(regexp_split_to_array(answer, '[.!?]+( +|$)'), lambda s: length(s) > 10) AS p FROM g), c AS (SELECT query_id, (unnest(range(1, len(p) + 1)) - 1)::INTEGER AS pos FROM l) SELECT query_id, pos, round(greatest(0.0, 1.0 - 0.1 * pos), 6)::DOUBLE AS score, pos + 1 AS rank FROM c")
def l2_fallback_ranking(spark, sf):
    return rerank.unranked(_rerank_inputs(spark, sf)[0]).select("query_id", "pos", F.round("score", 6).alias("score"), "rank")


@query(f"{_RANKED} SELECT query_id, rank::INTEGER AS rank, pos, round(CASE WHEN is_padding THEN score * 0.1::DOUBLE ELSE score END, 6) AS score, is_padding FROM pads")
def l5_exactly_ten(spark, sf):
    return rerank.padded(rerank.tfidf(*_rerank_inputs(spark, sf))).withColumn("score", F.round("score", 6))


# --- goldens and evaluation ---------------------------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT id, min(expectedOutput) AS text FROM goldens WHERE id IS NOT NULL GROUP BY 1),
u AS (SELECT id, list_filter(list_transform(string_split(text, '.'), lambda s: regexp_replace(s, '^[ \\t\\n\\r\\f\\p{Z}]+|[ \\t\\n\\r\\f\\p{Z}]+$', '', 'g')), lambda s: s <> '') AS a FROM t WHERE text IS NOT NULL),
p AS (SELECT id, list_filter(a, lambda s, i: list_position(a, s) = i) AS p FROM u WHERE len(a) > 0),
g AS (SELECT id, p, unnest(range((len(p) - 1) // 3 + 1))::INTEGER AS "group" FROM p),
x AS (SELECT id, "group", array_to_string(p["group" * 3 + 1:"group" * 3 + 3], '. ') || '.' AS text FROM g),
y AS (SELECT *, sum(length(text)) OVER (PARTITION BY id ORDER BY "group") AS upto FROM x)
SELECT id, "group", CASE WHEN upto <= 8000 THEN text ELSE substr(text, 1, (8000 - upto + length(text))::BIGINT) || '...' END AS text FROM y WHERE upto <= 8000 OR 8000 - upto + length(text) > 200"""
)
def n4_regrouped(spark, sf):
    t = table(spark, sf, "goldens").filter("id IS NOT NULL").groupBy("id").agg(F.min("expectedOutput").alias("text")).filter("text IS NOT NULL")
    return evaluate.regrouped(t)


@query(
    """WITH q AS (SELECT DISTINCT id, unnest((additionalMetadata::JSON -> 'evolutions')::VARCHAR[]) AS evolution, (additionalMetadata::JSON ->> 'synthetic_input_quality')::DOUBLE AS quality FROM goldens WHERE id IS NOT NULL AND json_valid(additionalMetadata)),
d AS (SELECT DISTINCT * FROM q) SELECT evolution, count(*) AS n, round(avg(quality), 6) AS avg_quality FROM d WHERE evolution IS NOT NULL GROUP BY 1"""
)
def n8_evolution_statistics(spark, sf):
    return evaluate.evolution_statistics(table(spark, sf, "goldens"))


def _answers(spark, sf):
    g = table(spark, sf, "goldens").filter("id IS NOT NULL").groupBy("id").agg(F.min("expectedOutput").alias("truth"), F.min("actualOutput").alias("answer"))
    return g.filter("truth IS NOT NULL AND answer IS NOT NULL")


_SET = lambda c: f"list_distinct(list_filter(list_transform(regexp_split_to_array({c}, '[.!?]+( +|$)'), lambda s: regexp_replace(s, '{evaluate.EDGES}', '', 'g')), lambda s: s <> ''))"
_OVERLAP = f"""o AS (SELECT id, len(t) AS n, len(list_intersect(t, a)) AS k FROM (SELECT id, {_SET('truth')} AS t, {_SET('answer')} AS a FROM (SELECT id, min(expectedOutput) AS truth, min(actualOutput) AS answer FROM goldens WHERE id IS NOT NULL GROUP BY 1) WHERE truth IS NOT NULL AND answer IS NOT NULL)),
r AS (SELECT id, n::INTEGER AS n_truth, k::INTEGER AS n_found, CASE WHEN n > 0 THEN round(100.0::DOUBLE * k / n, 6) ELSE 0.0 END AS share FROM o)"""


@query(f"WITH {_OVERLAP} SELECT *, CASE WHEN share >= 50 THEN 'good' WHEN share >= 25 THEN 'fair' ELSE 'poor' END AS band FROM r")
def o8_overlap(spark, sf):
    return evaluate.overlap(_answers(spark, sf))


@query(
    f"""WITH {_OVERLAP}, f AS (SELECT id, min(sourceFile) AS algorithm FROM goldens WHERE id IS NOT NULL GROUP BY 1),
g AS (SELECT algorithm, 'overlap' AS metric, round(avg(share / 100), 6) AS avg_score, round(avg(CASE WHEN share / 100 >= 0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS success_rate, round(stddev_pop(share / 100), 6) AS std FROM r JOIN f ON f.id = r.id GROUP BY 1)
SELECT *, avg_score = max(avg_score) OVER (PARTITION BY metric) AS winner FROM g"""
)
def o5_metric_summary(spark, sf):
    f = table(spark, sf, "goldens").filter("id IS NOT NULL").groupBy("id").agg(F.min("sourceFile").alias("algorithm"))
    r = evaluate.overlap(_answers(spark, sf)).join(f, "id").select("algorithm", F.lit("overlap").alias("metric"), (F.col("share") / 100).alias("score"))
    return evaluate.metric_summary(r)


_METRICS = f"""{_OVERLAP}, src AS (SELECT id, min(sourceFile) AS algorithm FROM goldens WHERE id IS NOT NULL GROUP BY 1),
words AS (SELECT id, {_WORDS.format('answer')} AS n FROM (SELECT id, min(expectedOutput) AS truth, min(actualOutput) AS answer FROM goldens WHERE id IS NOT NULL GROUP BY 1) WHERE truth IS NOT NULL AND answer IS NOT NULL),
metrics AS (SELECT algorithm, r.id AS case_id, 'overlap' AS metric, share / 100 AS score FROM r JOIN src ON src.id = r.id
 UNION ALL SELECT algorithm, words.id, 'length', CASE WHEN n < 15 THEN n / 15.0::DOUBLE WHEN n > 50 THEN greatest(0.3::DOUBLE, 50.0::DOUBLE / n) ELSE 1.0::DOUBLE END FROM words JOIN src ON src.id = words.id)"""


def _metrics(spark, sf):
    """Two deterministic metrics of each golden: sentence overlap and length."""
    f = table(spark, sf, "goldens").filter("id IS NOT NULL").groupBy("id").agg(F.min("sourceFile").alias("algorithm"))
    a = _answers(spark, sf)
    overlap = evaluate.overlap(a).select("id", F.lit("overlap").alias("metric"), (F.col("share") / 100).alias("score"))
    length = a.select("id", F.lit("length").alias("metric"), T.length_score(F.col("answer")).alias("score"))
    return overlap.unionByName(length).join(f, "id").select("algorithm", F.col("id").alias("case_id"), "metric", "score")


@query(f"WITH {_METRICS} SELECT algorithm, case_id, count(score) AS n_metrics, count_if(score >= 0.5)::BIGINT AS n_passed, bool_or(score >= 0.5) AS success FROM metrics GROUP BY 1, 2")
def o4_case_results(spark, sf):
    return evaluate.case_results(_metrics(spark, sf))


@query(
    f"""WITH {_METRICS}, m AS (SELECT algorithm, metric, avg(score) AS m FROM metrics GROUP BY 1, 2), ov AS (SELECT algorithm, round(avg(m), 6) AS overall, round(stddev_pop(m), 6) AS spread FROM m GROUP BY 1),
c AS (SELECT algorithm, case_id, count(score) AS k, bool_or(score >= 0.5) AS ok FROM metrics GROUP BY 1, 2), n AS (SELECT algorithm, count(*) AS cases, count_if(ok)::BIGINT AS successful, sum(k) AS judged FROM c GROUP BY 1)
SELECT n.algorithm, cases, successful, round(successful / cases, 6) AS success_rate, overall, spread, round(overall * cases / judged, 6) AS efficiency, rank() OVER (ORDER BY overall DESC)::INTEGER AS rank FROM n JOIN ov ON ov.algorithm IS NOT DISTINCT FROM n.algorithm WHERE n.algorithm IS NOT NULL"""
)
def o5_ranking(spark, sf):
    return evaluate.ranking(_metrics(spark, sf).filter("algorithm IS NOT NULL"))


@query(f"WITH {_OVERLAP} SELECT sum(n_found)::BIGINT AS n_found, sum(n_truth)::BIGINT AS n_possible, round(100.0::DOUBLE * sum(n_found) / sum(n_truth), 6) AS percentage FROM r")
def o10_retrieval_percentage(spark, sf):
    return evaluate.retrieval_percentage(evaluate.overlap(_answers(spark, sf)))


_TWO = ("basic_retrieval", "ssg_traversal")


@query(
    f"""WITH a AS (SELECT query_id, 'basic_retrieval' AS algorithm, gathered FROM ({walk_sql.basic(_GRAPH)}) UNION ALL SELECT query_id, 'ssg_traversal', gathered FROM ({walk_sql.walk(_GRAPH, 'ssg_traversal')})),
e AS (SELECT DISTINCT query_id, algorithm, unnest(gathered) AS s FROM a), b AS (SELECT query_id, s, count(*) AS n, min(algorithm) AS one FROM e GROUP BY 1, 2)
SELECT query_id, algorithm, len(gathered)::INTEGER AS n_sentences, (SELECT count(*) FROM b WHERE b.query_id = a.query_id AND b.n = 1 AND b.one = a.algorithm) AS n_unique,
 len(gathered) = max(len(gathered)) OVER (PARTITION BY query_id) AS best_coverage, (SELECT count(*) FROM b WHERE b.query_id = a.query_id) AS total_unique FROM a"""
)
def o9_content_comparison(spark, sf):
    return evaluate.content_comparison(traversal.retrieve_all(*_graph(spark, sf), algorithms=_TWO))


@query(
    f"""WITH {_NODES}, queries AS (SELECT * FROM nodes WHERE {_IS_QUERY}), said AS (SELECT sentence_id AS id, first(embedding) AS e FROM sentence_embeddings WHERE sentence_id IS NOT NULL AND {_USABLE} GROUP BY 1),
u AS (SELECT 'chunk' AS kind, id, vec FROM nodes UNION ALL SELECT 'sentence', id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) FROM said),
s AS (SELECT q.id AS query_id, kind, u.id, round(list_dot_product(q.vec, u.vec), 9) AS sim FROM queries q CROSS JOIN u)
SELECT query_id, kind, id, round(s.sim, 6) AS sim, row_number() OVER (PARTITION BY query_id, kind ORDER BY s.sim DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 5"""
)
def h1_query_similarities(spark, sf):
    n = _nodes(spark, sf)
    s = similarity.nodes(table(spark, sf, "sentence_embeddings"), "sentence_id")
    return _shown(traversal.query_similarities(n.filter(traversal.is_query(F.col("id"))), n, s, 5))


@query("WITH g AS (SELECT id, min(sourceFile) AS strategy FROM goldens WHERE id IS NOT NULL GROUP BY 1) SELECT strategy, count(*) AS n FROM g GROUP BY 1")
def n2_strategy_distribution(spark, sf):
    return table(spark, sf, "goldens").filter("id IS NOT NULL").groupBy("id").agg(F.min("sourceFile").alias("strategy")).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH c AS (SELECT DISTINCT doc_id AS group_id FROM document_nodes WHERE doc_id IS NOT NULL), s AS (SELECT group_id, row_number() OVER (ORDER BY md5('5:' || group_id), group_id) - 1 AS i FROM c QUALIFY i < 20),
g AS (SELECT DISTINCT id, ('0x' || substr(md5(id), 1, 2))::INTEGER % 32 AS i FROM goldens WHERE id IS NOT NULL)
SELECT g.id, CASE WHEN i < 24 THEN i END::INTEGER AS context_index, CASE WHEN i >= 24 THEN 'unknown' WHEN s.group_id IS NULL THEN 'index_error' ELSE 'theme_based' END AS grouping_method FROM g LEFT JOIN s USING (i)"""
)
def n7_context_metadata(spark, sf):
    """Goldens given the metadata of twenty sampled contexts (the sample is the operator's purpose) by an index some lack and some have wrong."""
    c = table(spark, sf, "document_nodes").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("group_id"), F.lit("theme_based").alias("strategy")).distinct()
    i = F.conv(F.substring(F.md5("id"), 1, 2), 16, 10).cast("int") % 32
    g = table(spark, sf, "goldens").filter("id IS NOT NULL").select("id", F.when(i < 24, i).alias("context_index")).distinct()
    return evaluate.with_context_metadata(g, evaluate.sampled_contexts(c, 20, 5)).select("id", "context_index", "grouping_method")


@query("SELECT DISTINCT doc_id, array_to_string(list_transform(doc_themes, lambda x: replace(x, ' | ', ' ; ')), ' | ') AS themes FROM document_nodes WHERE doc_themes IS NOT NULL")
def a14_flat_lists(spark, sf):
    return table(spark, sf, "document_nodes").filter("doc_themes IS NOT NULL").select("doc_id", evaluate.flat_context(F.col("doc_themes")).alias("themes")).distinct()


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from passagemesh.plans import graph_catalog  # noqa: E402, F401 - registers the rest
