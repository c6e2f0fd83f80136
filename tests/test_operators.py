import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemesh.functions import text as T
from passagemesh.functions import vector as V
from passagemesh.operators import corpus, evaluate, graph, paths, rerank, similarity, themes, traversal


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r


def test_clean_text(spark):
    wiki = 'A – b… x [1, 2] [citation needed] {| t\n|} end. === Head === more\n== See also ==\n* gone'
    assert one(spark, T.clean_text, wiki) == "A - b... x end. more"
    assert one(spark, T.clean_text, None) is None
    assert one(spark, T.clean_text, "") == ""


@pytest.mark.parametrize(
    "sentence, ok",
    [("123 456, 789.", False), ("SHORT SHOUT HERE", False), ("a (b) (c) (d) and more", False), ("été à l'école", True), ("x" * 9, False), ("x" * 10, True), ("x" * 500, True), ("x" * 501, False), ("a##$$%%^^&&**", False), ("Это предложение", False)],
)
def test_valid_sentence(spark, sentence, ok):
    assert one(spark, T.valid_sentence, sentence) is ok


def articles(spark, rows):
    return spark.createDataFrame(rows, "url string, title string, raw_text string, cleaned_text string, sentences array<string>")


def test_windows(spark):
    df = articles(spark, [("u", "A b/c", "r", "c", list("wxyz")), ("v", "T", "r", "c", ["a", "b"]), ("n", "N", None, None, None)])
    w = corpus.windows(df).orderBy("window_position").collect()
    assert [r.text for r in w] == ["w x y", "x y z"] and w[0].chunk_id.startswith("A_b_c_window_0_3_") and w[1].total_windows == 2
    assert [r.text for r in corpus.windows(df, 3, 1).orderBy("start_sentence_idx").collect()] == ["w x y", "y z"]
    with pytest.raises(ValueError):
        corpus.windows(df, 2, 2)
    assert corpus.windows(df.limit(0)).count() == 0


def test_counts_of_nulls(spark):
    r = corpus.text_counts(articles(spark, [("u", None, None, None, None), ("v", "t", "", " ", [])])).orderBy("url").collect()
    assert [(x.word_count, x.char_count, x.sentence_count) for x in r] == [(0, 0, 0), (0, 1, 0)]


def vectors(spark, n, docs, seed=0, dims=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, dims))
    x = base[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dims))
    rows = [(f"n{i:03d}", f"d{rng.integers(0, docs)}", [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id string, source_article string, embedding array<double>"), rows


@pytest.mark.parametrize("same", [True, False])
def test_top_similar_in_blocks(spark, monkeypatch, same):
    monkeypatch.setattr(similarity, "BLOCK", 7)  # several blocks
    df, rows = vectors(spark, 60, 3)
    n = similarity.nodes(df, "id")
    got = {(r.src, r.dst, r["rank"]) for r in similarity.top_similar(n, n, 4, 0.2, same_doc=same).collect()}
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 9)
    want = set()
    for i, a in enumerate(rows):
        c = [(-s[i, j], b[0]) for j, b in enumerate(rows) if j != i and (a[1] == b[1]) is same and s[i, j] >= 0.2]
        want |= {(a[0], b, k + 1) for k, (_, b) in enumerate(sorted(c)[:4])}
    assert got == want


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("z", "d", [0.0] * 64), ("s", "d", [1.0] * 3), ("n", "d", None), ("q", "d", [nan] * 64), ("i", "d", [inf] * 64), (None, "d", [1.0] * 64), ("ok", None, [1.0] * 64), ("ok", None, [1.0] * 64)]
    df = spark.createDataFrame(rows, "id string, source_article string, embedding array<double>")
    got = similarity.nodes(df, "id").collect()
    assert [r.id for r in got] == ["ok"] and got[0].doc is None
    assert similarity.vector_statistics(df.limit(0)).first().vectors == 0


def test_clean_edges(spark):
    rows = [("a", "b", 0.5, "intra_document"), ("a", "b", 0.9, "intra_document"), ("a", "a", 1.0, "intra_document"), ("a", "c", None, "x"), ("a", "d", float("nan"), "x")]
    df = spark.createDataFrame(rows, "source_chunk_id string, target_chunk_id string, similarity_score double, connection_type string")
    assert [(r.src, r.dst, r.sim) for r in similarity.clean_edges(df).collect()] == [("a", "b", 0.9)]


def test_themes(spark):
    parse = lambda s: one(spark, themes.parse_themes, s)
    assert parse('```json\n["a", " ", "b"]\n```') == ["a", "b"] and parse("none") == [] and parse(None) == [] and parse("[oops") == []
    assert parse('{"themes": ["a", "b"]}') == ["a", "b"] and parse("[\"'q'\"]") == ["q"]


def walk_model(algorithm, q, vec, edges, said, own, limits, anchor):
    """One walk, step by step, over lists: vec chunk vectors, said a chunk's sentence texts, own sentence vectors."""
    near = lambda a, b: round(float(a @ b), 9)
    away = lambda a, b, c: round(float(np.linalg.norm(b + c - 2 * a)) / 3, 9)
    src = {t: min(c for c in said if t in said[c]) for v in said.values() for t in v}
    cur, path, ext, measures, last = anchor, [anchor], list(said.get(anchor, [])), [], 0.0
    conf = lambda t: near(q, own[t])
    hop = 0
    while len(ext) < limits.sentences and hop < limits.hops:
        hop += 1
        if algorithm == "ssg_traversal":
            c = [(-near(vec[cur], vec[d]), -near(q, vec[d]), i, d) for i, d in enumerate(edges.get(cur, [])) if not set(said.get(d, [])) & set(ext)]
            if not c or hop > 1 and -min(c)[0] <= last:
                break
            last, cur = -min(c)[0], min(c)[3]
            path.append(cur)
            ext += [t for t in said.get(cur, []) if t not in ext]
            continue
        if hop > 1:
            ext += [t for t in said.get(cur, []) if t not in ext]
        if algorithm == "triangulation_average":
            mean = lambda a, b, c: round((a + b + c) / 3, 9)
            m = {d: mean(near(q, vec[cur]), near(q, vec[d]), near(vec[cur], vec[d])) for d in edges.get(cur, [])}
            ms = {t: mean(near(q, vec[cur]), conf(t), conf(t)) for t in said.get(cur, [])}
            key = lambda x: round(abs(x - 1), 9)
        elif algorithm == "triangulation_geometric_fulldim":
            m = {d: away(q, vec[cur], vec[d]) for d in edges.get(cur, [])}
            ms = {t: away(q, vec[cur], own[t]) for t in said.get(cur, [])}
            key = lambda x: x
        else:
            m, ms, key = {d: near(q, vec[d]) for d in edges.get(cur, [])}, {}, lambda x: -x
        c = sorted((key(m[d]), -near(q, vec[d]), i, d) for i, d in enumerate(edges.get(cur, [])))
        s = sorted((key(v), -conf(t)) for t, v in ms.items())
        free = [e[3] for e in c if e[3] not in path]
        if algorithm.startswith("tri") and (c or s):
            measures.append(ms[min(said[cur], key=lambda t: (key(ms[t]), -conf(t)))] if s and (not c or s[0] < c[0][:2]) else m[c[0][3]])
        if len(ext) >= 8 and c:
            if algorithm == "query_traversal" and max(0, *map(conf, ext)) > max(m.values()):
                break
            if algorithm == "triangulation_average" and max(mean(near(q, vec[cur]), conf(t), near(vec[cur], vec[src[t]])) for t in ext) > m[c[0][3]]:
                break
        if s and algorithm.startswith("tri") and (not c or s[0] < c[0][:2]) or not free:
            break
        cur = free[0]
        path.append(cur)
    ext = ext[: limits.sentences]
    score = sum(map(conf, ext)) / len(ext) if ext else 0.0
    if algorithm.startswith("tri"):
        score = sum(measures) / len(measures) if measures else 0.0
    return path, ext, round(score, 6)


def toy(spark, n=40, held=True, seed=3):
    df, rows = vectors(spark, n, 4, seed=seed)
    rng = np.random.default_rng(seed + 2)
    ids = [r[0] for r in rows]
    edges = {i: sorted(set(rng.choice(ids, 4)) - {i}) for i in ids[: n - 4]}  # the last ones are dead ends
    said = {i: [f"s{int(i[1:]) // 2}", f"s{int(i[1:]) // 2 + 1}"] for i in ids[::1 if held else n]}
    x = {r[0]: np.array(r[2]) / np.linalg.norm(r[2]) for r in rows}
    own = {t: 0.5 * x[next(i for i in ids if t in said.get(i, []))] + 0.5 * rng.normal(size=64) / 8 for v in said.values() for t in v}
    own = {t: v / np.linalg.norm(v) for t, v in own.items()}
    nodes = similarity.nodes(spark.createDataFrame([(i, "d", [float(a) for a in v]) for i, v in x.items()], "id string, source_article string, embedding array<double>"), "id")
    e = spark.createDataFrame([(a, b, "intra_document", k) for a, v in edges.items() for k, b in enumerate(v)], "src string, dst string, type string, rank int")
    s = spark.createDataFrame([(t, t, int(t[1:]), [float(a) for a in v], [c for c in said if t in said[c]]) for t, v in own.items()], "sentence_id string, sentence_text string, sentence_index int, embedding array<double>, containing_chunks array<string>")
    return ids, x, edges, said, own, nodes, traversal.graph(nodes, e, s)


@pytest.mark.parametrize("algorithm", ["query_traversal", "ssg_traversal", "triangulation_average", "triangulation_geometric_fulldim"])
def test_walks_equal_model(spark, algorithm):
    ids, x, edges, said, own, nodes, g = toy(spark)
    limits = traversal.Limits(10, 8)
    q = nodes.filter(F.col("id").isin(*ids[:4])).select("id", "raw", "vec")
    got = {r.query_id: (r.path, r.gathered, r.score) for r in traversal.walk(algorithm, q, g, limits).collect()}
    for i in ids[:4]:
        anchor = min((-round(float(x[i] @ v), 9), k) for k, v in x.items())[1]
        want = walk_model(algorithm, x[i], x, edges, said, own, limits, anchor)
        assert got[i][:2] == want[:2] and abs(got[i][2] - want[2]) < 2e-6


def test_walk_without_edges_or_sentences(spark):
    df, rows = vectors(spark, 5, 1)
    n = similarity.nodes(df, "id")
    e = spark.createDataFrame([], "src string, dst string, type string, rank int")
    s = spark.createDataFrame([], "sentence_id string, sentence_text string, sentence_index int, embedding array<double>, containing_chunks array<string>")
    g = traversal.graph(n, e, s)
    q = n.select("id", "raw", "vec").limit(1)
    for a in traversal.ALGORITHMS:
        r = traversal.retrieve(a, q, g).collect()
        assert len(r) == 1 and r[0].hops == 0 and r[0].gathered == [] and r[0].error is None and r[0].algorithm == a
    assert [r.error for r in traversal.retrieve("query_traversal", q, traversal.Graph(n.limit(0), e.withColumn("ord", F.lit(0)), g.held)).collect()] == ["no anchor"]
    with pytest.raises(ValueError):
        traversal.retrieve("no_such", q, g)


def test_chooser(spark):
    ids, x, edges, said, own, nodes, g = toy(spark)
    q = nodes.filter(F.col("id").isin(*ids[:3])).select("id", "raw", "vec")
    go = lambda f: traversal.walk("llm_guided_traversal", q, g, traversal.Limits(50, 4), f).collect()
    assert all(r.hops == 0 for r in go(lambda c, n: F.lit(0)))
    first, odd, second = ({r.query_id: r.path for r in go(lambda c, n, v=v: F.lit(v).cast("int"))} for v in (1, 99, 2))
    assert first == odd == {r.query_id: r.path for r in go(lambda c, n: F.lit(None).cast("int"))} and first != second
    assert max(len(p) for p in first.values()) > 2


def test_path_rules(spark):
    rows = [
        ("ok", 0, "DOCUMENT", "a", "hierarchical"), ("ok", 1, "CHUNK", "a", "hierarchical"), ("ok", 2, "SENTENCE", "a", None),
        ("raw", 0, "CHUNK", "a", "raw_similarity"), ("raw", 1, "SENTENCE", "a", None),
        ("theme", 0, "DOCUMENT", "a", "theme_bridge"), ("theme", 1, "DOCUMENT", "a", None),
        ("seq", 0, "SENTENCE", "a", "sequential"), ("seq", 1, "SENTENCE", "b", None), ("one", 0, "CHUNK", "a", None),
    ]
    df = spark.createDataFrame(rows, "path_id string, step int, granularity string, document string, connection string")
    assert {(r.path_id, r.error) for r in paths.hop_errors(df).collect()} == {("raw", "granularity"), ("theme", "always_inter"), ("seq", "document_only")}
    assert {r.path_id: r.is_valid for r in paths.validated(df).collect()} == {"ok": True, "raw": False, "theme": False, "seq": False, "one": False}


def test_sessions(spark):
    df = spark.createDataFrame([("p", 0, "a", 1), ("p", 1, "a", 9), ("p", 2, "a", 18), ("p", 3, "b", 18)], "path_id string, step int, document string, idx int")
    assert sorted((r.first_step, r.last_step) for r in paths.sessions(df).collect()) == [(0, 1), (2, 2), (3, 3)]


def test_rerank_edges(spark):
    c = spark.createDataFrame([("q", 0, "the of and"), ("q", 1, "red fox jumps")], "query_id string, pos int, text string")
    q = spark.createDataFrame([("q", "red fox"), ("none", "x")], "query_id string, text string")
    r = rerank.tfidf(c, q).orderBy("rank").collect()
    assert [x.pos for x in r] == [1, 0] and r[1].similarity == 0.0
    assert rerank.padded(rerank.tfidf(c, q), 5).count() == 5
    h = rerank.hybrid(c, q).orderBy("rank").collect()  # on the padded list
    assert len(h) == 10 and [x.pos for x in h[:2]] == [1, 0] and sum(x.is_padding for x in h) == 8 and h[2].score < h[1].score


def test_evaluation(spark):
    assert evaluate.allocation({"a": 0.33, "b": 0.33, "c": 0.2}, 10) == {"a": 4, "b": 4, "c": 2}
    assert sum(evaluate.allocation({"a": 0, "b": 0}, 5).values()) == 5 and evaluate.allocation({}, 3) == {}
    df = spark.createDataFrame([("x", "A one. B two. A one.", "B two. Other."), ("y", "", "Z.")], "id string, truth string, answer string")
    r = {x.id: (x.n_truth, x.n_found, x.band) for x in evaluate.overlap(df).collect()}
    assert r == {"x": (2, 1, "good"), "y": (0, 0, "poor")}
    t = spark.createDataFrame([("x", "a. b. a. c. d")], "id string, text string")
    assert [r.text for r in evaluate.regrouped(t).orderBy("group").collect()] == ["a. b. c.", "d."]


def test_quality(spark):
    s = spark.createDataFrame([("a", 0.8), ("b", 0.5), ("c", 0.1), ("d", None)], "chunk_id string, score double")
    assert {r.tier: r.n for r in graph.quality_statistics(s).collect()} == {"high": 1, "medium": 1, "low": 1, "unscored": 1}
    assert {r.chunk_id for r in graph.without_low_quality(s.select("chunk_id"), s, 0.5).collect()} == {"a", "b", "d"}


def test_vector_columns(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>").select(V.norm("a").alias("n"), V.unit(F.col("a")).alias("u"), V.unit(F.col("z")).alias("z")).first()
    assert r.n == 5.0 and r.u == [0.6, 0.8] and r.z == [0.0, 0.0]


def test_basic_goes_on_past_copies(spark):
    q = [1.0] + [0.0] * 63
    near = [(f"c{i:02d}", [1.0] + [0.001 * i] + [0.0] * 62) for i in range(45)]  # copies of one window, nearest to the query
    far = [(f"f{i:02d}", [1.0] + [0.5 + 0.01 * i] + [0.0] * 62) for i in range(8)]
    df = spark.createDataFrame([(i, "d", v) for i, v in near + far + [("q", q)]], "id string, source_article string, embedding array<double>")
    n = similarity.nodes(df, "id")
    said = {i: ["a", "b"] for i, _ in near} | {i: [f"{i}x", f"{i}y"] for i, _ in far[1:]}
    texts = sorted({t for v in said.values() for t in v})
    s = spark.createDataFrame([(t, t, k, None, [c for c in said if t in said[c]]) for k, t in enumerate(texts)], "sentence_id string, sentence_text string, sentence_index int, embedding array<double>, containing_chunks array<string>")
    e = spark.createDataFrame([], "src string, dst string, type string, rank int")
    nodes = n.filter("id <> 'q'")
    r = traversal.basic(n.filter("id = 'q'"), traversal.graph(nodes, e, s)).collect()
    assert [x.path for x in r] == [["c00", "f01", "f02", "f03", "f04"]]
    assert r[0].gathered == ["a", "b"] + [f"f{i:02d}{k}" for i in range(1, 5) for k in "xy"] and set(r[0].confidence) == {0.5} and r[0].sources[0] == "c00"
    few = traversal.basic(n.filter("id = 'q'"), traversal.graph(n.filter("id < 'f03'"), e, s)).collect()  # every node seen
    assert [len(x.gathered) for x in few] == [6]


def test_path_patterns(spark):
    def seen(pattern, connections, granularities=None, documents=None):
        n = len(connections) + 1
        rows = list(zip(["p"] * n, range(n), granularities or ["CHUNK"] * n, documents or [f"d{i}" for i in range(n)], [*connections, None]))
        r = paths.validated(spark.createDataFrame(rows, "path_id string, step int, granularity string, document string, connection string"), pattern).first()
        return r.n_errors, r.is_valid

    raw, seq, down, theme = "raw_similarity", "sequential", "hierarchical", "theme_bridge"
    assert [seen("sequential_flow", [seq] * n) for n in (4, 5, 10, 11)] == [(1, False), (0, True), (0, True), (1, False)]
    assert [seen("raw_similarity", [raw] * n) for n in (1, 2)] == [(0, True), (1, False)]
    assert [seen("theme_bridge", [theme] * n) for n in (3, 4)] == [(0, True), (1, False)]
    three = ["DOCUMENT", "CHUNK", "CHUNK", "SENTENCE"]
    assert seen("multi_dimensional", [down, theme, seq], three, ["a", "a", "b", "b"]) == (0, True)
    assert seen("multi_dimensional", [seq, theme, seq]) == (1, False)  # a type twice
    assert seen("multi_dimensional", [theme, seq]) == (2, False)
    assert seen("hierarchical", [down] * 3, [*three[:2], "SENTENCE", "SENTENCE"]) == (2, False)  # too many, and one not down
    assert seen(None, [raw], ["SENTENCE"] * 2) == (2, False)  # both ends
    assert seen(None, [seq], ["DOCUMENT"] * 2, ["a", "a"]) == (1, False)


def test_fallback_themes(spark):
    rows = [(0, "Brains", "A study of THE PAST"), (1, "Law", "He met José and Anna Marie Smith, then Anna Marie Smith. OK. The End X1y Éa"), (2, None, None), (3, "visual robots behavior history computer study", None), (4, "x", "Xo\u00a0Yo Zo\u0301 Ann1")]
    df = spark.createDataFrame(rows, "i int, title string, s string")
    got = {r.i: r.t for r in df.select("i", themes.fallback_themes(F.col("title"), F.col("s")).alias("t")).collect()}
    assert got[0] == ["Artificial Intelligence", "Neuroscience", "History", "Research"]
    assert got[1] == ["He", "Anna Marie Smith", "The End"]
    assert got[2] == [] and got[3] == ["Computer Vision", "Robotics", "Psychology", "History", "Technology"]
    assert got[4] == list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", rows[4][2])))
