"""Small tests of sources, stores, models, groups, paths over lists and display data."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemesh import models, pipeline
from passagemesh.operators import display, evaluate, graph, grouping, paths, rerank, similarity, themes
from passagemesh.sources import articles, goldens, stores


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


# --- sources


def test_alternatives():
    assert articles.alternatives("neural networks") == ["neural_networks", "neuralnetworks", "neural", "networks", "neural network"]
    assert "machine learning" in articles.alternatives("ml") and articles.alternatives("") == ["s"]


def test_fetched_topics(spark):
    def load(name):
        if name == "bad":
            raise OSError("down")
        return [{"title": name, "url": "u", "raw_text": "t"}] if name == "two_words" else []

    got, failed = articles.fetched(spark, ["two words", "bad"], load)
    assert [r.title for r in got.collect()] == ["two_words"] and [r.topic for r in failed.collect()] == ["bad"]


def test_processed_articles(spark):
    good = " ".join(f"This is the sentence number {i} of it." for i in range(12))
    raw = rows(spark, articles.RAW, ("a", "1", good), ("b", "2", "short"), ("c", "3", None), ("d", "4", "One sentence that is long enough." + " x" * 60))
    a, out = articles.processed(raw, 100)
    assert [(r.title, r.metadata.sentence_count, len(r.sentences)) for r in a.collect()] == [("a", 12, 12)]
    assert {(r.title, r.reason) for r in out.collect()} == {("b", "length"), ("c", "no text"), ("d", "sentences")}
    assert articles.processed(raw.limit(0))[0].count() == 0


def test_json_lines_with_bad_ones(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"title": "a"}\n{oops\n\n')
    good, bad = articles.read_json(spark, str(tmp_path / "x.json"), "title string")
    assert [r.title for r in good.collect()] == ["a"] and [r.line for r in bad.collect()] == ["{oops"]


def test_stores(spark, tmp_path):
    df, other = rows(spark, "a int, b string", (1, "x"), (2, None)), rows(spark, "a int, b string", (2, None), (1, "x"))
    assert stores.content_hash(df) == stores.content_hash(other) != stores.content_hash(df.limit(1))
    where, calls = str(tmp_path / "s"), []

    def make():
        calls.append(1)
        return {"t": df}

    for origin in ("1", "1", "2"):
        assert stores.cached(spark, where, origin, make)["t"].count() == 2
    assert len(calls) == 2 and stores.load(spark, where, "1") is None and stores.load(spark, str(tmp_path / "none")) is None
    (tmp_path / "s" / stores.MANIFEST).write_text("{")
    (tmp_path / "s" / f".{stores.MANIFEST}.crc").unlink(missing_ok=True)
    assert stores.load(spark, where) is None


def test_golden_files(spark, tmp_path):
    g = rows(spark, goldens.COLUMNS, ("1", 'a "q"\nline', "x", None, '["p | q", "r"]', *[None] * 6))
    goldens.Files(str(tmp_path)).push(g, "set")
    back = goldens.pulled(spark, "set", goldens.Files(str(tmp_path / "none")), goldens.Files(str(tmp_path))).first()
    assert (back.id, back.input, back.context) == ("1", 'a "q"\nline', '["p | q", "r"]') and not back.expectedOutput
    p = spark.createDataFrame([('["p | q", "r"]',), ("a | b",), (None,)], "c string").select(goldens.passages(F.col("c")).alias("p"), goldens.flat(goldens.passages(F.col("c"))).alias("f")).collect()
    assert [r.p for r in p] == [["p | q", "r"], ["a", "b"], None] and p[0].f == "p ; q | r"
    goldens.write_json(spark.createDataFrame([("q", ["a", "b"])], "q string, s array<string>").select(*goldens.from_group(F.col("q"), F.col("s"))), str(tmp_path / "g"))
    assert [(r.input, r.expected_output, r.context) for r in spark.read.json(str(tmp_path / "g")).collect()] == [("q", "a b", ["a", "b"])]


# --- models


def test_model_config():
    for bad in ({"provider": "x"}, {"temperature": 3}, {"max_tokens": 0}):
        with pytest.raises(ValueError):
            models.ModelConfig(**bad)


def test_embedders(spark):
    df = rows(spark, "t string", ("red fox",), ("red fox",), (None,), ("",))
    got = models.embedded(df, "t").collect()
    assert got[0].embedding == got[1].embedding and got[2].embedding is None and not any(got[3].embedding)
    assert abs(np.linalg.norm(got[0].embedding) - 1) < 1e-9
    assert models.HashingEmbedder(name="mxbai-embed-large").prefix
    both = models.embedded_by_all(df, "t", {"a": models.HashingEmbedder, "b": lambda: models.HashingEmbedder(8)})
    assert {(r.model, len(r.embedding)) for r in both.filter("embedding IS NOT NULL").collect()} == {("a", 64), ("b", 8)}


def test_answers_with_failures(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    df = rows(spark, "p string", ("x",), (None,))
    assert [r.a for r in models.answered(df, "p", "a", model).collect()] == ["X", None]
    assert [r.a for r in models.answered(rows(spark, "p string", ("bad",)), "p", "a", model).collect()] == [None]
    c = rows(spark, "question string, context array<string>", ("bad", ["one", "two"]))
    assert models.answers(c, model).first().answer == models.answers(c).first().answer == "one\ntwo"


def test_replies():
    assert models.cleaned_reply('```json\n{"input": "a", "x": "b"}\n```') == "a" and models.cleaned_reply('{"z": "only"}') == "only"
    assert models.cleaned_reply("<!DOCTYPE html>") == "" and models.cleaned_reply("x" * 600) == "x" * 500 and models.cleaned_reply(None) == ""
    assert [models.chosen(r, 3) for r in ('{"choice": 2}', '{"choice": "STOP"}', '"stop"', "9", "??", None, "3")] == [2, 0, 0, None, None, None, 3]


def test_themes_by_model(spark):
    d = rows(spark, "doc_id string, title string, summary string", ("a", "T", "A robot"), ("b", "T", "brain"))
    model = lambda p: ['["One", "Two"]' if "robot" in t else "none" for t in p]
    got = {r.doc_id: (r.themes, r.method) for r in themes.extracted(d, model).collect()}
    assert got["a"] == (["One", "Two"], "model") and got["b"][1] == "model_fallback" and themes.extracted(d).first().method == "fallback"


def test_quality_by_model(spark):
    c = rows(spark, "chunk_id string, text string", ("a", "x"), ("b", "y"), ("c", "z"))
    known = rows(spark, "chunk_id string, score double", ("a", 0.9))
    model = lambda p: ['{"clarity": 1, "depth": 0.5, "structure": 0.5, "relevance": 1}' if t.endswith("y") else "nothing" for t in p]
    assert {(r.chunk_id, r.score) for r in graph.scored(c, known, model).collect()} == {("a", 0.9), ("b", 0.75), ("c", None)}


def test_pruned(spark):
    docs = rows(spark, "title string, chunk_ids array<string>", ("t", ["a", "b"]), ("u", ["c"]))
    chunks, b = rows(spark, "chunk_id string", ("a",), ("b",), ("c",)), rows(spark, "chunk_id string, sentence_id string", ("a", "1"), ("b", "1"), ("b", "2"), ("c", "3"))
    s = rows(spark, "chunk_id string, score double", ("a", 0.1), ("c", None))
    d, k, left = graph.pruned(docs, chunks, b, s, 0.5)
    assert {(r.title, tuple(r.chunk_ids)) for r in d.collect()} == {("t", ("b",)), ("u", ("c",))} and {r.chunk_id for r in k.collect()} == {"b", "c"}
    assert {(r.chunk_id, r.sentence_id) for r in left.collect()} == {("b", "2"), ("c", "3")}


def test_rerank_by_model(spark):
    c = rows(spark, "query_id string, pos int, text string", ("q", 0, "red fox jumps"), ("q", 1, "blue whale swims"), ("r", 0, "green tree stands"))
    q = rows(spark, "query_id string, text string", ("q", "red fox"), ("r", "tree"))
    model = lambda p: ["0.9" if "whale" in t else "0.1" if "fox" in t.split("\t")[1] else "?" for t in p]
    got = rerank.by_model(c, q, model).collect()
    assert [r.pos for r in sorted((r for r in got if r.query_id == "q"), key=lambda r: r["rank"])] == [1, 0]
    assert [r.similarity > 0 for r in got if r.query_id == "r"] == [True]
    assert {r.pos for r in rerank.reranked("no such", c.withColumn("text", F.when(F.col("pos") == 1, "short").otherwise(F.col("text"))), q).collect()} == {0}


# --- groups


def passages(spark):
    chunks = rows(spark, "id string, doc string, pos int, quality double", *[(f"{d}{i}", d, i, None) for d in "abc" for i in range(4)])
    links = rows(spark, "src string, dst string, sim double", ("a1", "a0", 0.9), ("a1", "a2", 0.4), ("a0", "b0", 0.8), ("a0", "c0", 0.9), ("a1", "b1", 0.7), ("b1", "b2", 0.6), ("b1", "c3", 0.5), ("b2", "c3", 0.3))
    held = rows(spark, "id string, texts array<string>", *[(f"{d}{i}", [f"{d}{i}x", f"{d}{i + 1}x"]) for d in "abc" for i in range(4)])
    like = rows(spark, "doc string, other string, rank int", ("a", "b", 1))
    return grouping.Passages(chunks, links, held, like)


def test_sequential_groups(spark):
    g = passages(spark)
    r = grouping.sequential(rows(spark, "group_id string, id string", ("g", "a1")), g, most=100).first()
    # a1, its more similar neighbour a0, no third since a0's other side is read: then b0 by theme (not c0), and so on
    assert r.chunk_ids[:4] == ["a1", "a0", "b0", "b1"] and r.sentences[:3] == ["a1x", "a2x", "a0x"]
    lone = grouping.sequential(rows(spark, "group_id string, id string", ("g", "c1")), g, most=100).first()
    assert lone.sentences.count("c1x") >= 2  # nowhere to cross to: the same chunk is read again


def test_theme_groups(spark):
    g = passages(spark)
    r = grouping.grown("theme_based", rows(spark, "group_id string, id string", ("g", "a0")), g).first()
    assert r.chunk_ids[:2] == ["a0", "b0"] and r.reason == "no_more_chunks"
    assert grouping.grown("inter_document", rows(spark, "group_id string, id string", ("g", "a0")), g).first().chunk_ids[:2] == ["a0", "c0"]
    assert len(grouping.grown("similarity", rows(spark, "group_id string, id string", ("g", "a1")), g, most=3).first().sentences) <= 3


def test_native_groups(spark):
    got = grouping.native(passages(spark).chunks, 3, seed=1).collect()
    ids = [i for r in got for i in r.chunk_ids]
    assert len(got) == 3 and len(set(ids)) == 9 and all(len({i[0] for i in r.chunk_ids}) == 3 for r in got)
    with pytest.raises(ValueError):
        grouping.groups(passages(spark), {"no such": 1}, 2)


# --- evaluation and display


def test_evolutions_and_counts():
    assert evaluate.evolution_weights({"reasoning": 3, "comparative": 1, "no": 5}) == {"REASONING": 0.75, "COMPARATIVE": 0.25}
    assert evaluate.evolution_weights(None, ["REASONING", "MULTICONTEXT"]) == {"REASONING": 0.5, "MULTICONTEXT": 0.5} and evaluate.evolution_weights() == {"REASONING": 1.0}
    assert [evaluate.group_count(*a) for a in ((10, 7, 3), (2, 7, 3), (10, 0, 3))] == [3, 2, 0]


def test_judged(spark):
    c = rows(spark, "algorithm string, case_id string, x double", ("a", "1", 0.8), ("a", "2", None))
    r = models.judged(c, {"m": lambda: F.col("x"), "n": lambda: F.lit(0.2)})
    assert {(x.case_id, x.n_metrics, x.n_passed, x.success) for x in evaluate.case_results(r).collect()} == {("1", 2, 1, True), ("2", 1, 0, False)}
    assert [(x.algorithm, x.cases, x.successful, x["rank"]) for x in evaluate.ranking(r).collect()] == [("a", 2, 1, 1)]


def test_checked_paths(spark):
    s = "path_id string, nodes array<string>, connections array<string>, granularities array<string>, documents array<string>"
    df = rows(spark, s, ("ok", ["a", "b"], ["raw_similarity"], ["CHUNK"] * 2, ["d", "e"]), ("empty", [], [], [], []), ("one", ["a"], [], ["CHUNK"], ["d"]), ("null", None, None, None, None),
              ("long", ["a", "b", "c"], ["sequential"] * 2, ["SENTENCE"] * 3, ["d", "d", "e"]), ("short", ["a", "b"], ["raw_similarity"], ["CHUNK"], ["d", "d"]))
    got = {r.path_id: (r.errors, r.is_valid) for r in paths.checked(df).collect()}
    assert got == {"ok": ([], True), "empty": (["nodes"], False), "one": ([], True), "null": (["nodes"], False), "long": (["hop 1: crosses documents"], False), "short": (["granularities"], False)}
    two = {r.path_id: r.errors for r in paths.checked(df.filter("path_id IN ('ok', 'long')"), "raw_similarity").collect()}
    assert two == {"ok": [], "long": ["hop 1: crosses documents", "too many hops"]}


def test_relevance_and_marks(spark):
    n, s = rows(spark, "query_id string, id string", ("q", "a"), ("q", "b"), ("q", "c")), rows(spark, "query_id string, id string, sim double", ("q", "a", 0.9), ("q", "s1", 0.3), ("q", "s2", 0.4))
    b = rows(spark, "chunk_id string, sentence_id string", ("b", "s1"), ("b", "s2"))
    assert {r.id: r.relevance for r in display.relevance(n, s, b).collect()} == {"a": 0.9, "b": 0.4, "c": 0.5}
    a = rows(spark, "query_id string, path array<string>, sources array<string>", ("q", ["x", "y", "z"], ["z"]))
    assert [(r.id, r.group) for r in display.grouped(display.shown_nodes(a, 3)).orderBy("place").collect()] == [("q", "query"), ("z", "final"), ("x", "visited")]
    display.square((2, 2), ["a", "b"])
    for bad in (((2, 3), None), ((2, 2), ["a"])):
        with pytest.raises(ValueError):
            display.square(*bad)


def test_ordinals(spark):
    df = rows(spark, "id string", *[(f"k{i:03d}",) for i in range(50)], ("k000",))
    assert {r.id: r.n for r in similarity.ordinals(df).collect()} == {f"k{i:03d}": i for i in range(50)} and similarity.ordinals(df.limit(0)).count() == 0


# --- pipeline


def test_pipeline(spark, sf, tmp_path):
    for bad in ({"window": 0}, {"skip": ("x",)}, {"algorithms": ("x",)}):
        with pytest.raises(ValueError):
            pipeline.Config(**bad)
    with pytest.raises(ValueError):
        pipeline.build(spark, sf, str(tmp_path / "none"), pipeline.Config(skip=("chunks",)))
    (tmp_path / "c.json").write_text(json.dumps({"intra": 3, "limits": {"hops": 1}, "algorithms": ["basic_retrieval", "query_traversal"]}))
    config = pipeline.Config.read(str(tmp_path / "c.json"))
    got = pipeline.benchmark(spark, sf, str(tmp_path / "g"), config)
    assert {r.algorithm for r in got["answers"].collect()} == set(config.algorithms)
    built = pipeline.build(spark, sf, str(tmp_path / "g"), config)
    assert built["edges"].filter("type = 'intra_document' AND rank > 3").count() == 0 and built["documents"].count() > 0
