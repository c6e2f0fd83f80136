import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagemesh.llm import cutoff, encodings, mixing, neighbours, pairs, queries, sentences, split, subjects, tokens, topn
from tests.oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", ["p3_found", "p5_found", "p8_roundtrip"])
def test_query_equals_sql(spark, sf, name):
    cols, rows = spark_rows(queries.queries()[name](spark, sf))
    assert rows == duck_rows(queries.oracle_sql()[name], sf, cols)


# --- p5


def test_top_n_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), float(rng.randrange(6)), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s double, i int").repartition(7)
    got = {(r.g, r.i, r.position) for r in topn.top_n(df, "g", 4, [F.col("s").desc(), F.col("i").asc()]).collect()}
    want = set()
    for g in ("hot", "a", "b", None):
        for k, (_, i) in enumerate(sorted((-s, i) for x, s, i in rows if x == g)[:4]):
            want.add((g, i, k + 1))
    assert got == want
    assert topn.top_n(df.limit(0), "g", 4, [F.col("s")]).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df.withColumn("position", F.lit(1)), "g", 4, [F.col("s")])


def test_best_targets_cases(spark):
    nan = float("nan")
    rows = [("s", "t", 0.5, "d"), ("s", "t", 0.9, "d"), ("s", "s", 1.0, "d"), ("s", "u", None, "d"), ("s", "v", nan, "d"), ("s", "w", 0.9, None), ("s", "x", 0.9, "c"), ("s", "y", 1.0000001, "z"), ("s", None, 0.9, "d"), (None, "t", 0.9, "d")]
    df = spark.createDataFrame(rows, "source_chunk_id string, target_chunk_id string, similarity_score double, target_document string")
    got = topn.best_targets(df).orderBy("position").collect()
    assert [r.target_chunk_id for r in got] == ["y", "x", "t", "w"]


# --- p8


def test_tokenizer_equals_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/{tokens.TOKENIZER}")
    lib.encode_special_tokens = True
    rng = random.Random(3)
    alphabet = "aaab e  'stll 0123\n\t.,!?éßЖя漢字かなไทยह़👩‍🔬 ​�"
    texts = ["<|endoftext|> x", "aaaaaaaaaa", "antidisestablishmentarianism" * 40] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    auto = tokens.automaton()
    for t in texts:
        ids = auto.encode(t)
        assert ids == lib.encode(t, add_special_tokens=False).ids
        assert auto.decode(ids) == t
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "hi", "k")], "doc_id long, text string, extra string")
    assert {r.doc_id: r.ids for r in tokens.encode(df).collect()} == {1: [], 2: [], 3: auto.encode("hi")}
    assert tokens.encode(df.limit(0)).count() == 0


def test_automaton_equals_merging():
    """Small random merge lists against merging by rank."""
    rng = random.Random(9)
    for _ in range(30):
        vocab, merges = [bytes([b]) for b in b"abc"], []
        for _ in range(12):
            u, v = rng.choice(vocab), rng.choice(vocab)
            if u + v not in vocab:
                merges.append((u, v))
                vocab.append(u + v)
        ids = {bytes([b]): b for b in range(256)} | {u + v: 256 + k for k, (u, v) in enumerate(merges)}
        auto = tokens.MergeAutomaton(merges, ids)
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 12)))
            parts = [bytes([b]) for b in word]
            for u, v in merges:
                i = 0
                while i < len(parts) - 1:
                    if parts[i] == u and parts[i + 1] == v:
                        parts[i : i + 2] = [u + v]
                    i += 1
            assert [auto.labels[i] for i in auto.word(word)] == parts


# --- p7


def test_neighbours_recall_and_classes(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(150, 64))
    x = np.repeat(centre, 8, axis=0) + 0.25 * rng.normal(size=(1200, 64))
    rows = [(f"v{i:04d}", [float(a) for a in x[i]]) for i in range(1200)]
    rows += [(f"c{i:02d}", [float(2 * a) for a in centre[0]]) for i in range(9)]  # equal vectors
    rows += [("z", [0.0] * 64), ("short", [1.0]), ("null", None), ("nan", [float("nan")] * 64), (rows[0][0], rows[0][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df).collect()}
    ok = {i: np.array(e) / np.linalg.norm(e) for i, e in rows if i and e and len(e) == 64 and np.isfinite(e).all() and any(e)}
    ids = sorted(ok)
    m = np.stack([ok[i] for i in ids])
    s = np.round(m @ m.T, 6)
    np.fill_diagonal(s, -1)
    want = set()
    for a in range(len(ids)):
        c = np.flatnonzero(s[a] >= 0.85)
        for b in c[np.lexsort((c, -s[a][c]))][:5]:
            want.add((ids[min(a, b)], ids[max(a, b)]))
    assert len(got & want) / len(want) > 0.97 and len(got - want) <= 0.03 * len(want)
    twins = {(a, b) for a, b in want if a[0] == b[0] == "c"}
    assert twins <= got
    assert neighbours.similar_pairs(df.limit(0)).count() == 0


def _exact(rows, k=5, least=0.85):
    ids = sorted(i for i, _ in rows)
    by = dict(rows)
    m = np.stack([np.array(by[i]) / np.linalg.norm(by[i]) for i in ids])
    s = np.round(m @ m.T, 6)
    np.fill_diagonal(s, -1)
    want = set()
    for a in range(len(ids)):
        c = np.flatnonzero(s[a] >= least)
        want |= {(ids[min(a, b)], ids[max(a, b)]) for b in c[np.lexsort((c, -s[a][c]))][:k]}
    return want


@pytest.mark.parametrize("n", [2000, 20000])
def test_neighbours_keep_recall_in_many_cells(spark, n):
    """Pairs at cosines about 0.85 to 0.9, in cells of a few hundred vectors, at two sizes."""
    rng = np.random.default_rng(n)
    centre = rng.normal(size=(n // 2, 64))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    g = rng.normal(size=centre.shape)
    g -= (g * centre).sum(axis=1, keepdims=True) * centre
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    cos = rng.uniform(0.85, 0.9, size=(n // 2, 1))
    x = np.concatenate([centre, cos * centre + np.sqrt(1 - cos**2) * g])
    rows = [(f"v{i:05d}", [float(a) for a in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, cell=300).collect()}
    want = {(f"v{i:05d}", f"v{i + n // 2:05d}") for i in range(n // 2)}
    assert neighbours.projections(n, 300) == (3 if n == 2000 else 7)
    assert len(got & want) / len(want) >= 0.95


def test_neighbours_of_a_crowd(spark):
    """A third of all vectors crowd around one direction: their cell is hashed again by its own spread, and no near pair is lost."""
    rng = np.random.default_rng(4)
    crowd = np.eye(64)[0] + 0.02 * rng.normal(size=(1500, 64))
    rest = rng.normal(size=(3000, 64))
    rows = [(f"v{i:05d}", [float(a) for a in v]) for i, v in enumerate(np.concatenate([crowd, rest]))]
    rows += [(f"w{i}", rows[0][1]) for i in range(200)]  # a large class in the crowd
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    want = _exact(rows)
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, cell=100).collect()}
    assert len(got & want) / len(want) >= 0.9 and len(got - want) <= 0.1 * len(want)
    assert {p for p in want if p[0][0] == p[1][0] == "w"} <= got


def _cell_of(x, homes, batch=500):
    """The rows of one cell as its task gets them, of which the first lie in it."""
    for at in range(0, len(x), batch):
        some = range(at, min(at + batch, len(x)))
        columns = [pa.array([1] * len(some)), pa.array([i < homes for i in some]), pa.array(["k"] * len(some)), pa.array([f"v{i:05d}" for i in some]), pa.array([None] * len(some), pa.list_(pa.string())), pa.array(neighbours.packed(x[some]), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["cell", "own", "kind", "id", "ids", "vec"])


@pytest.mark.parametrize("most", [5000, 400])
def test_a_cell_lets_its_visitors_pass(most, monkeypatch):
    """A task holds what lies in a cell and a part of its visitors, not all of them; held in turns, it finds the same."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(1000, 64))
    x = np.concatenate([centre, np.repeat(centre, 9, axis=0) + 0.2 * rng.normal(size=(9000, 64))])
    monkeypatch.setattr(neighbours, "PART", 1000)
    read = []
    source = (read.append(1) or b for b in _cell_of(x, 1000))
    out = []
    for b in neighbours._searched(5, 0.85, most)(source):
        if not out:
            assert len(read) <= 5  # of 20
        out.append(b)
    got = {}
    for b in out:
        for i, c in zip(b.column("id").to_pylist(), b.column("c").to_pylist()):
            got.setdefault(i, set()).update((e["d"], e["other"]) for e in c)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u[:1000] @ u.T, 6)
    s[np.arange(1000), np.arange(1000)] = -1
    hits = 0
    for a in range(1000):
        c = np.flatnonzero(s[a] >= 0.85)
        hits += [o for _, o in sorted(got[f"v{a:05d}"])[:5]] == [f"v{i:05d}" for i in c[np.lexsort((c, -s[a][c]))][:5]]
    assert hits >= 950


def test_visits_stay_few():
    """At 256 cells a vector visits 10 or so (37 before cells were of the nearest direction), and near pairs still meet."""
    rng = np.random.default_rng(7)
    a, g = rng.normal(size=(2, 4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    g -= (g * a).sum(axis=1, keepdims=True) * a
    b = 0.85 * a + math.sqrt(1 - 0.85**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
    cells = neighbours.Cells(8, 0.85)
    visited, own = [], []
    for x in (a, b):
        row, key, mine = cells.place(x)
        assert len(row) <= 12 * len(x) and mine.sum() == len(x)
        visited.append(set(zip(row.tolist(), key.tolist())))
        own.append(list(zip(row[mine].tolist(), key[mine].tolist())))
    met = {p[0] for p in own[0] if p in visited[1]} | {p[0] for p in own[1] if p in visited[0]}
    assert len(met) >= 0.97 * len(a)


def test_vectors_are_packed_without_loss():
    rng = np.random.default_rng(2)
    x = np.concatenate([np.round(rng.normal(size=(3, 64)), 4), rng.normal(size=(2, 64)).astype(np.float32).astype(float), rng.normal(size=(2, 64)), [[1e300] * 64], [[0.0] * 63 + [5e-324]]])
    got = neighbours.packed(x)
    assert [len(g) for g in got] == [129] * 3 + [257] * 2 + [513] * 4 or [len(g) for g in got][:7] == [129] * 3 + [257] * 2 + [513] * 2
    safe = np.abs(x).max(axis=1, keepdims=True)
    assert np.allclose(neighbours.unpacked(got), x / safe / np.linalg.norm(x / safe, axis=1, keepdims=True), atol=1e-15)
    assert neighbours.packed(np.array([[-0.0] * 63 + [1.0]])) == neighbours.packed(np.array([[0.0] * 63 + [1.0]]))


def test_neighbours_with_changing_ids(spark):
    """An id with two vectors counts once; the other vector takes no one's place. Kinds are searched apart."""
    e = np.eye(64)
    v = lambda *w: [float(a) for a in sum(c * e[i] for i, c in w)]
    rows = [("a", "x", v((0, 1))), ("a", "y", v((0, 1), (1, 0.1))), ("a", "y", v((5, 1))), ("b", "x", v((0, 1))), ("a", "z", v((0, 1)))]
    df = spark.createDataFrame(rows, "kind string, id string, embedding array<double>")
    got = {(r.kind, r.id_a, r.id_b) for r in neighbours.similar_pairs(df).collect()}
    assert got in ({("a", "x", "z")}, {("a", "x", "z"), ("a", "x", "y"), ("a", "y", "z")})


def test_perturbation_order():
    p = neighbours.perturbations(4, 6)
    assert p[0] == (0,) and len(set(p)) == 6


def test_singular_vectors_hold_the_exact_energy(spark):
    """The subspace iteration against an exact decomposition of the same weighted matrix."""
    rng = np.random.default_rng(1)
    words = ["".join(c) for c in itertools.islice(itertools.product("abcdefgh", repeat=3), 400)]
    topics = rng.dirichlet(np.full(400, 0.05), 30)
    texts = [" ".join(rng.choice(words, 40, p=topics[rng.integers(30)])) + "." for _ in range(300)]
    df = spark.createDataFrame([(str(i), t, []) for i, t in enumerate(texts)], "doc_id string, text string, themes array<string>")
    docs = subjects.prepared(df)
    w = subjects.Weights(subjects.inverse_frequencies(docs))
    v = subjects.singular_vectors(docs, w, rank=24)
    r, c, x = subjects._weighted(subjects.counted(texts), len(texts), w)
    m = np.zeros((len(texts), len(w)))
    m[r, c] = x
    exact = np.linalg.svd(m, compute_uv=False)
    assert np.allclose(v.T @ v, np.eye(24), atol=1e-4)
    assert (np.linalg.norm(m @ v) / np.linalg.norm(exact[:24])) ** 2 > 0.99


def test_documents_as_counts_are_read_as_written(spark):
    texts, themes = ["One two. Three four.", None, "", "科学研究。体育比赛"], [["Law", "law"], ["Music"], None, []]
    df = spark.createDataFrame(list(zip("abcd", texts, themes)), "doc_id string, text string, themes array<string>")
    got = subjects.Docs.read(subjects.prepared(df).orderBy("doc_id").toArrow().combine_chunks().to_batches()[0])
    want = subjects.Docs.of(texts, themes)
    for name in ("n", "doc", "length", "theme_doc"):
        assert np.array_equal(getattr(got, name), getattr(want, name))
    assert all(np.array_equal(x, y) for n in ("said", "themes") for x, y in zip(getattr(got, n), getattr(want, n)))
    assert want.doc.tolist() == [0, 0, 3, 3] and want.theme_doc.tolist() == [0, 1]


# --- p2, p3


def test_unmatched_marks_take_one_pass():
    import time

    start = time.time()
    assert sentences.enclosed("(" * 200_000) == [] and time.time() - start < 1
    assert sentences.enclosed('a “b” („c“) "d"') == [(2, 4), (6, 10), (12, 14)]


@pytest.mark.parametrize(
    "text, lang, want",
    [
        ("Dr. Smith paid approx. 3.5 million. Why? “Is it so?” asked Ann. He left.", "en", ["Dr. Smith paid approx. 3.5 million.", "Why?", "“Is it so?” asked Ann.", "He left."]),
        ("Heading\nIt met at 6 p.m. Nov. 7 here. (It rained.) J. K. Low left the U.N. panel.", "en-GB", ["Heading", "It met at 6 p.m. Nov. 7 here.", "(It rained.)", "J. K. Low left the U.N. panel."]),
        ("Lost blank!Then more.Next one", "EN", ["Lost blank!", "Then more.", "Next one"]),
        ("Am 16. Mai kam z. B. der 3. Versuch. „Wo ist er?“, fragte Prof. Au.", "de", ["Am 16. Mai kam z. B. der 3. Versuch.", "„Wo ist er?“, fragte Prof. Au."]),
        ("« Où est-il ? » demanda M. Roc. Le J.O. du 2 janv. 1900 le cite !", "fr", ["« Où est-il ? » demanda M. Roc.", "Le J.O. du 2 janv. 1900 le cite !"]),
        ("他说：“完了。没有了。”《书？》是书。“在哪里？”甲问道。", "zh", ["他说：“完了。没有了。”", "《书？》是书。", "“在哪里？”甲问道。"]),
        ("「壊れた。見ていない。」と述べた。次だ！", "ja", ["「壊れた。見ていない。」と述べた。", "次だ！"]),
        ("डॉ. राम ने 3.5 कि.मी. कहा। “कहाँ है?” उसने पूछा।", "hi", ["डॉ. राम ने 3.5 कि.मी. कहा।", "“कहाँ है?” उसने पूछा।"]),
        ("ประโยคหนึ่ง โครงการ VX 7 เทียบ ประโยคสอง", "th", ["ประโยคหนึ่ง", "โครงการ VX 7 เทียบ", "ประโยคสอง"]),
        ("Τι είναι; Ο κ. Α είπε π.χ. αυτό.", "el", ["Τι είναι;", "Ο κ. Α είπε π.χ. αυτό."]),
        ("«أين؟ لا أعرف.» هكذا كتب. قال د. علي نعم!", "ar", ["«أين؟ لا أعرف.» هكذا كتب.", "قال د. علي نعم!"]),
    ],
)
def test_units(text, lang, want):
    for declared in (lang, None):
        assert [text[a:b] for a, b in sentences.units(text, declared)] == want


def test_units_of_nothing(spark):
    assert sentences.units(None) == sentences.units("") == sentences.units(" \n ") == []
    df = spark.createDataFrame([("u", None, None), (None, "A.", None), ("v", "A b. C d.", ("en",)), ("v", "A b. C d.", ("en",))], "url string, cleaned_text string, metadata struct<language:string>")
    assert sorted((r.start_char, r.end_char) for r in sentences.found(df).collect()) == [(0, 4), (5, 9)]


def test_pieces_hold():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "Long sentence here. ", "x" * rng.randrange(1, 60), "。", "\n", "é́ ", ", "]) for _ in range(rng.randrange(1, 60)))
        limit, over = rng.randrange(20, 120), rng.randrange(0, 15)
        p = split.pieces(text, limit, over)
        assert p[0][0] == 0 and p[-1][1] == len(text)
        assert all(e - s <= limit for s, e, _ in p) or len(text) <= limit
        assert all(a[1] == b[2] and b[0] <= b[2] and b[2] - b[0] <= over for a, b in zip(p, p[1:]))


# --- p1, p4, p6


def test_pair_features_cases():
    f = pairs.pair_features
    nothing = [f("Q?", x, False)[10] for x in (None, "", " \t", "​", "...")]
    assert set(nothing) == {1.0} and f("Q?", "No", False)[10] < 0.5  # there is nothing, or little
    copied, answered = f("What is a lens?", "WHAT IS A LENS?", False), f("What is a lens?", "What is a lens? It bends the light of a star.", False)
    assert copied[3] == copied[12] == 1.0 and answered[12] < 0.3
    assert f("What is the lens in the tower of it?", "Какая странная орбита!", False)[7] == 1.0
    assert f("What is the lens? Answer in Russian.", "Какая странная орбита!", False)[7] == 0.0
    assert f(None, "text", True)[0] == 1.0 and len(f(None, None, False)) == pairs.DENSE


def test_defects_held_out(spark, sf):
    g = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/goldens.parquet")  # thirty rows are too few to hold some out
    clf, _ = pairs.trained(g)
    rows = g.filter("input IS NOT NULL AND length(expectedOutput) > 20").select("input", "expectedOutput").limit(150).collect()
    made = pairs.synthetic([(r[0], r[1]) for r in rows], seed=99)
    h, dense = pairs._arrays([(q, a, d == "truncated") for q, a, d in made])
    p = clf.scores(h, dense)
    right = [p[i, pairs.DEFECTS.index(d)] >= clf.at[pairs.DEFECTS.index(d)] for i, (_, _, d) in enumerate(made) if d]
    assert sum(right) / len(right) > 0.85
    short = [(p[i] < clf.at).all() for i, (_, _, d) in enumerate(made) if not d]
    assert sum(short) / len(short) > 0.8  # short answers are sound
    null = g.select("id", "input", "expectedOutput", "context").withColumn("input", F.lit(None).cast("string"))
    assert {r.defect for r in pairs.found(null).collect()} <= {"empty", "truncated", "refusal"}


def test_cut_values(spark, sf):
    g = spark.read.parquet(f"{sf}/goldens.parquet").select("id", "expectedOutput", "context", "sourceFile")
    extra = [("m1", "It stops here [truncated]", '["Fine passage.", "Broken in the mid', "f"), ("m2", None, None, "f"), ("m3", "", "[]", None), ("m4", "- a\n- b", "A whole text. | Another whole.", "f"), (None, "x", "y", "f")]
    df = g.unionByName(spark.createDataFrame(extra, "id string, expectedOutput string, context string, sourceFile string"))
    got = {(r.id, r.field) for r in cutoff.found(df).filter("id LIKE 'm%'").collect()}
    assert got == {("m1", "expectedOutput"), ("m1", "context")}
    assert cutoff.found(df.limit(0)).count() == 0
    r = cutoff.report(df)
    assert r.filter("share < 0 OR share > 1 OR n_cut > n_values").count() == 0


def test_all_words_of_an_answer_count():
    words = [f"w{i}" for i in range(300)]
    changed = [*words[:250], "other", *words[251:]]
    assert set(pairs.hashed(" ".join(changed))) - set(pairs.hashed(" ".join(words)))


def test_subjects(spark):
    words = {"law": "judge court verdict statute lawyer appeal".split(), "music": "opera violin chord melody sonata tempo".split()}
    rng = random.Random(2)
    text = lambda s: " ".join(f"The {rng.choice(words[s])} met the {rng.choice(words[s])} there." for _ in range(3))
    nodes = spark.createDataFrame([(f"{s}{i}", text(s), [s]) for s in words for i in range(20)] + [("null", None, None), ("blank", " ", [])], "doc_id string, doc_summary string, doc_themes array<string>")
    themes = spark.createDataFrame([("null", "The judge met the court there.", None), ("null", None, ["law"])], "doc_id string, source_text string, themes array<string>")
    ex = spark.createDataFrame([(i, text(s), "en", [s]) for i, s in enumerate(["law", "music"] * 5)] + [(99, None, None, None)], "example_id int, text string, lang string, subjects array<string>")
    subj = spark.createDataFrame([("law",), ("music",), (None,)], "subject string")
    got = {(r.doc_id, r.subject) for r in subjects.found(nodes, themes, ex, subj).collect()}
    want = {(f"{s}{i}", s) for s in words for i in range(20)} | {("null", "law")}
    assert len(got ^ want) <= 4
    assert subjects.found(nodes.limit(0), themes.limit(0), ex, subj).count() == 0


def test_every_term_has_its_weight(spark, monkeypatch):
    monkeypatch.setattr(subjects, "ROUNDS", 1)
    words = ["".join(c) for c in itertools.islice(itertools.product("abcdefghijklmno", repeat=4), 12_000)]
    rows = [(k, " ".join(words[k // 2 * 1000 : (k // 2 + 1) * 1000]), "en", ["law" if k < 12 else "music"]) for k in range(24)]  # each word in two texts
    ex = spark.createDataFrame(rows, "example_id int, text string, lang string, subjects array<string>")
    texts = spark.createDataFrame([("d", "aaaa aaab", ["x"])], "doc_id string, text string, themes array<string>")
    space, _ = subjects.fitted(subjects.prepared(texts), ex, spark.createDataFrame([("law",), ("music",)], "subject string"))
    assert len(space.w) == len({b for w in words for b in subjects.terms(w)}) > 8192
    assert (np.linalg.norm(space.embed(subjects.counted(words), len(words)), axis=1) > 0.99).all()


# --- p9


def test_fill():
    total, got = mixing.fill({"a": (0.5, 1, 100), "b": (0.5, 4, 100), "none": (0.2, 3, 0)}, 400)
    assert total == 400 and got == {"a": 100.0, "b": 300.0, "none": 0.0}
    total, got = mixing.fill({"a": (0.5, 1, 100), "b": (0.5, 4, 100)})
    assert total == 200 and got["a"] == got["b"] == 100.0
    assert mixing.fill({}) == (0.0, {})


def test_clamped_mix(spark):
    """A total that small sources cannot fill their share of: they are clamped, and the others share what is lacking."""
    docs = [(i, "word " * 20, "big" if i < 80 else "small" if i < 90 else "other") for i in range(200)] + [(900, " \u3000\u200b", "small"), (901, None, "big"), (902, "x", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 2), ("other", 0.2, 1), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    mix, rep = mixing.plan(df, t, mixing.CORPUS)
    r = {x.source: x for x in rep.collect()}
    assert r["small"].clamped and r["small"].most_repeats == 2 and r["small"].n_docs == 10 and r["none"].tokens == 0
    assert not r["big"].clamped and abs(r["big"].actual_share / r["other"].actual_share - 2.5) < 0.15
    assert {x.doc_id for x in mix.collect()}.isdisjoint({900, 901, 902})


def test_mix(spark, sf):
    docs, targets = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/mix_targets.parquet")
    mix, rep = mixing.plan(docs, targets, total=60_000)
    caps = {r.source: r.max_repeats for r in targets.collect()}
    assert all(r.repeats <= caps[r.source] for r in mix.collect())
    assert abs(rep.agg(F.sum("actual_share")).first()[0] - 1) < 1e-9
    again = mixing.mix(docs, targets, total=60_000)
    assert sorted(mix.collect()) == sorted(again.collect())
    assert mixing.mix(docs.limit(0), targets).count() == 0


# --- p10


@pytest.mark.parametrize("read", ["cp1252", "cp437", "mac_roman", "cp1251", "cp1250"])
def test_undo(read):
    text = "Voilà « l’été » — naïve café €5"
    garbled = "".join(bytes([b]).decode(read, "replace") if b > 127 and bytes([b]).decode(read, "replace") != "�" else chr(b) for b in text.encode())
    assert encodings.Chain("utf8", read).undo(garbled) == text
    assert encodings.Chain("utf8", read).undo("Voilà un café") is None


def test_encodings_found_and_repaired(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    bad = "Die Bank wurde für schöne Züge gerühmt. Über dem Fluß läge die Brücke."
    extra = [(-1, "s", bad.encode().decode("cp1252")), (-2, "s", bad), (-3, None, None), (-4, "s", ""), (-5, "s", "Software prints «Ð¿Ñ€» for «пр» here."), (-6, "s", "The sign � stands for a letter."), (-7, "s", bad.encode("latin-1").decode("utf-8", "replace"))]
    df = docs.unionByName(spark.createDataFrame(extra, "doc_id long, source string, text string"))
    assert {r.doc_id for r in encodings.found(df).filter("doc_id < 0").collect()} == {-1, -7}
    fixed = {r.doc_id: (r.restored, r.whole) for r in encodings.repaired(df).filter("doc_id < 0").collect()}
    assert fixed[-1] == (bad, True) and fixed[-7][1] is False


def test_each_segment_has_its_chain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    one, two = "Die Bank wurde für schöne Züge gerühmt. Über dem Fluß läge die Brücke. ", "Die Straße führt über Köln und München nach Süden."
    clean = [(-k, "t", one + two) for k in range(2, 60)]  # the corpus knows the language
    df = docs.unionByName(spark.createDataFrame([*clean, (-1, "s", one.encode().decode("cp1252") + two.encode().decode("mac_roman"))], "doc_id long, source string, text string"))
    r = encodings.repaired(df).filter("doc_id = -1").first()
    assert (r.restored, r.whole) == (one + two, True)
