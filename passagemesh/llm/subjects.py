"""Subject areas of documents by latent semantic analysis and refined seed centroids (problem 6).

Texts become hashed counts of words and, in scripts without blanks, character runs. A term's weight is its inverse
document frequency over all documents times how far the subjects of the texts that have it differ from the
corpus: at first the labelled examples tell, later the whole corpus as it was last assigned. The leading singular vectors of
the weighted matrix come from subspace iteration: each pass multiplies a block of directions by the matrix and its
transpose in one scan, adding up sums of fixed size. Labelled examples seed a centroid per subject and language; the
sentences clearly nearest to a centroid move it, and weights, vectors and centroids are refined for a few rounds. Theme
phrases are terms too: what the well-judged documents tell of a phrase helps to judge the sentences of others that
have it, in any language. A document has the subjects that are nearest for a substantial share of its sentences.

Texts are cut into sentences and terms once; every pass reads the term counts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemesh.runtime import materialize
from passagemesh.llm.mixing import filled
from passagemesh.llm.sentences import units

#: Hash buckets of terms; singular vectors; subspace passes from a random start and from the last round's vectors; rounds of weights and vectors; moves of the centroids in a round.
BUCKETS, RANK, PASSES, MORE, ROUNDS, PULLS = 1 << 15, 96, 8, 4, 4, 1
#: Texts' worth of the corpus' shares in a term's subjects; texts at which half of what a term tells counts.
PRIOR, SEEN = 1.0, 4.0
#: Labelled examples used at most: the bound of the seeds' sample.
MOST_EXAMPLES = 20_000
#: A centroid moves toward a document's part when it is this much closer to it than to the next; how far it moves in a round.
CLEAR, PULL = 0.15, 0.4
#: The class of examples about no subject.
NONE = ""
#: Weights, beside a sentence's own cosines, of those of the themes and of the mean of the document's sentences.
THEMES, AROUND = 0.5, 0.4
#: Least cosine of a part with its subject; least share of a document's judged parts for a subject.
LEAST, SHARE = 0.25, 0.3

_WORD = re.compile(r"[^\W\d_]+")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿]+|[฀-๿]+")


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "replace")) & (BUCKETS - 1)


def terms(text: str) -> list[int]:
    """Hashed terms of a text: lower-case words and their stems of five letters, and runs of two to four characters of unspaced scripts."""
    out = []
    for run in _UNSPACED.findall(text):
        for n in (2, 3, 4):
            out += [_bucket(run[i : i + n]) for i in range(len(run) - n + 1)]
    for w in _WORD.findall(_UNSPACED.sub(" ", text)):
        low = w.lower()
        out.append(_bucket(low))
        if len(low) > 5:
            out.append(_bucket(low[:5] + "*"))
    return out


def parts(text: str | None) -> list[str]:
    """The sentence units of a text."""
    return [text[a:b] for a, b in units(text)] if text else []


def theme_word(phrase: str) -> str:
    """A theme phrase as one word."""
    return "theme" + "".join(_WORD.findall(phrase.lower()))


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row, bucket, count) of texts."""
    rows, cols, vals = [], [], []
    for r, t in enumerate(texts):
        if not t:
            continue
        b, n = np.unique(np.asarray(terms(t), dtype=np.int64), return_counts=True)
        rows.append(np.full(len(b), r))
        cols.append(b)
        vals.append(n)
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)


class Docs:
    """A batch of documents as term counts: sentences (their document and length) and theme phrases, both as sparse rows."""

    def __init__(self, n: int, doc: np.ndarray, length: np.ndarray, said: tuple, theme_doc: np.ndarray, themes: tuple) -> None:
        self.n, self.doc, self.length, self.said, self.theme_doc, self.themes = n, doc, length, said, theme_doc, themes

    @classmethod
    def of(cls, texts: list[str | None], themes: list[list[str] | None]) -> Docs:
        said = [parts(t) for t in texts]
        words = [sorted({theme_word(t) for t in th or [] if t}) for th in themes]
        flat, more = [p for d in said for p in d], [w for d in words for w in d]
        at = lambda lists: np.repeat(np.arange(len(lists)), [len(x) for x in lists]).astype(np.int64)
        return cls(len(texts), at(said), np.array([len(p) for p in flat], dtype=np.int64), counted(flat), at(words), counted(more))

    @classmethod
    def read(cls, b: pa.RecordBatch) -> Docs:
        ints = lambda name: b.column(name).flatten().to_numpy().astype(np.int64)
        doc = lambda name: np.repeat(np.arange(b.num_rows), np.asarray(b.column(name).value_lengths())).astype(np.int64)
        rows = lambda p: (np.repeat(np.arange(len(k := ints(f"{p}_terms"))), k), ints(f"{p}_bucket"), ints(f"{p}_count"))
        return cls(b.num_rows, doc("length"), ints("length"), rows("said"), doc("theme_terms"), rows("theme"))

    def written(self) -> dict[str, pa.Array]:
        def lists(values: np.ndarray, doc: np.ndarray) -> pa.Array:
            ends = np.searchsorted(doc, np.arange(self.n + 1))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))

        out = {"length": lists(self.length, self.doc)}
        for name, owner, (row, bucket, count) in (("said", self.doc, self.said), ("theme", self.theme_doc, self.themes)):
            out[f"{name}_terms"] = lists(np.bincount(row, minlength=len(owner)), owner)
            out[f"{name}_bucket"], out[f"{name}_count"] = lists(bucket, owner[row]), lists(count, owner[row])
        return out

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows of the documents, their themes being terms like others."""
        row = np.concatenate([self.doc[self.said[0]], self.theme_doc[self.themes[0]]])
        key, which = np.unique(row * BUCKETS + np.concatenate([self.said[1], self.themes[1]]), return_inverse=True)
        return key // BUCKETS, key % BUCKETS, np.bincount(which, np.concatenate([self.said[2], self.themes[2]]), minlength=len(key))

    def judged(self, space: Space, c: Centroids) -> tuple[np.ndarray, np.ndarray]:
        """The sentences' vectors, and their cosines with the subjects, helped by their document's themes and its mean sentence."""
        x = space.embed(self.said, len(self.doc))
        own = c.cosines(x)
        if len(self.doc):
            n = np.bincount(self.doc, minlength=self.n)
            mean = np.stack([np.bincount(self.doc, own[:, k], minlength=self.n) for k in range(own.shape[1])], axis=1) / np.maximum(n, 1)[:, None]
            help_ = np.zeros((self.n, own.shape[1]))
            if len(self.theme_doc):
                np.maximum.at(help_, self.theme_doc, c.cosines(space.embed(self.themes, len(self.theme_doc))))
            own = own + THEMES * help_[self.doc] + AROUND * mean[self.doc]
        return x, own


#: What is stored of each document.
COUNTS = "doc_id string, length array<int>, said_terms array<int>, said_bucket array<int>, said_count array<int>, theme_terms array<int>, theme_bucket array<int>, theme_count array<int>"


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            part = b.slice(at, 1000)
            got = Docs.of(part.column("text").to_pylist(), part.column("themes").to_pylist()).written()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *got.values()], ["doc_id", *got])


class Weights:
    """The buckets that have a weight, numbered; it and the blocks over it are small enough to go with every task."""

    def __init__(self, weight: np.ndarray) -> None:
        at = np.flatnonzero(weight > 0)
        self.place = np.full(BUCKETS, -1, dtype=np.int32)
        self.place[at] = np.arange(len(at))
        self.weight = weight[at].astype(np.float32)

    def __len__(self) -> int:
        return len(self.weight)


def _weighted(rows: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, w: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows over the numbered buckets: 1 + ln count, weighted, to unit length."""
    r, c, v = rows
    c = w.place[c]
    r, v, c = r[c >= 0], v[c >= 0], c[c >= 0]
    v = (1 + np.log(v)) * w.weight[c]
    norm = np.sqrt(np.bincount(r, v * v, minlength=n))
    return r, c, v / np.where(norm[r] > 0, norm[r], 1)


def _times(r: np.ndarray, c: np.ndarray, v: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    """The sparse rows times ``block``; rows are in order."""
    out = np.zeros((n, block.shape[1]), dtype=np.float32)
    v = v.astype(np.float32)[:, None]
    cut = np.append(np.arange(0, len(r), 200_000), len(r))
    for lo, hi in zip(cut, cut[1:]):
        part = r[lo:hi]
        at = np.flatnonzero(np.concatenate([[True], np.diff(part) != 0]))
        out[part[at]] += np.add.reduceat(block[c[lo:hi]] * v[lo:hi], at, axis=0)
    return out


def _vectors(at: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, row): numbers in single precision as bytes."""
    rows = np.ascontiguousarray(rows, dtype="<f4")
    ends = np.arange(len(at) + 1, dtype=np.int32) * np.int32(4 * rows.shape[1])
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(rows)])], ["bucket", "row"])


def _batches(b: pa.RecordBatch, size: int = 2000) -> Iterator[tuple[pa.RecordBatch, Docs]]:
    for at in range(0, b.num_rows, size):
        yield b.slice(at, size), Docs.read(b.slice(at, size))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, df = 0, np.zeros(BUCKETS, dtype=np.int64)
    for whole in batches:
        for _, d in _batches(whole):
            n += d.n
            df += np.bincount(d.whole()[1], minlength=BUCKETS)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["bucket", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """ln((1 + documents) / (1 + documents with the bucket)) over all ``docs``: BUCKETS + 1 counts reach the driver."""
    rows = docs.mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1)
    df[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()  # bucket -1 is the last place
    return np.log((1 + df[-1]) / (1 + df[:-1]))


def told(counts: np.ndarray) -> np.ndarray:
    """Per bucket how much it tells of the subject: the divergence of its subjects from all, less where it is seen seldom."""
    n = counts.sum(axis=1)
    prior = (counts.sum(axis=0) + 1) / (counts.sum() + counts.shape[1])
    p = (counts + PRIOR * prior) / (n[:, None] + PRIOR)
    return np.maximum((p * np.log(p / prior)).sum(axis=1), 0) * np.maximum(n - 1, 0) / (n + SEEN)


def _listed(names: list[str], subjects: list[str] | None) -> list[int]:
    """The subjects of an example, or NONE for one of no subject; empty where one of them is not listed."""
    listed = sorted(set(subjects or [NONE]))
    return [names.index(x) for x in listed] if all(x in names for x in listed) else []


def example_counts(names: list[str], examples: list[tuple[str, str, list[str]]]) -> np.ndarray:
    """Texts per bucket and subject among the examples; one of several subjects counts a part for each."""
    counts = np.zeros((BUCKETS, len(names)))
    for text, _, subjects in examples:
        mine = _listed(names, subjects)
        for k in mine:
            counts[np.unique(terms(text or "")), k] += 1 / len(mine)
    return counts


def _tally(space: Space, c: Centroids):
    """Documents per bucket and subject, by their sentences clearly nearest to one subject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(c.names)
        total = np.zeros((BUCKETS, k))
        for whole in batches:
            for _, d in _batches(whole):
                if not len(d.doc) or not len(c.at):
                    continue
                best, clear = clearest(d.judged(space, c)[1])
                row, bucket, _ = d.said
                ok = clear[row]
                # a term counts once a document, so that its names tell nothing
                key = np.unique((d.doc[row[ok]] * k + best[row[ok]]) * BUCKETS + bucket[ok])
                np.add.at(total, (key % BUCKETS, key // BUCKETS % k), 1)
                won = np.zeros((d.n, k))
                np.add.at(won, (d.doc[clear], best[clear]), 1)
                won /= np.maximum(won.sum(axis=1, keepdims=True), 1)
                row, bucket, _ = d.themes
                np.add.at(total, bucket, won[d.theme_doc[row]])
        at = np.flatnonzero(total.any(axis=1))
        yield _vectors(at, total[at])

    return run


def clearest(cos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest subject of each row, and whether it is near and clearly the nearest."""
    top = np.sort(cos, axis=1)
    return cos.argmax(axis=1), (top[:, -1] >= LEAST) & (top[:, -1] - (top[:, -2] if cos.shape[1] > 1 else 0) >= CLEAR)


def _accumulated(width: int):
    """Sums of a partition's buckets, added up as their rows come: what is held is the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = np.full(BUCKETS, -1), np.zeros((0, width))
        for b in batches:
            if not b.num_rows:
                continue
            bucket = b.column("bucket").to_numpy()
            rows = np.frombuffer(b"".join(b.column("row").to_pylist()), "<f4").reshape(-1, width)
            new = np.unique(bucket[place[bucket] < 0])
            place[new] = len(total) + np.arange(len(new))
            total = np.concatenate([total, np.zeros((len(new), width))])
            order = np.argsort(place[bucket], kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(place[bucket][order]) != 0]))
            total[place[bucket][order][first]] += np.add.reduceat(rows[order].astype(float), first, axis=0)
        at = np.flatnonzero(place >= 0)
        yield _vectors(at, total[place[at]])

    return run


def _sums(rows: DataFrame, width: int) -> np.ndarray:
    """Rows (bucket, row) summed per bucket: at most BUCKETS rows reach the driver, whatever the corpus."""
    got = rows.repartition("bucket").mapInArrow(_accumulated(width), "bucket long, row binary").toPandas()
    out = np.zeros((BUCKETS, width))
    if len(got):
        out[got["bucket"].to_numpy(dtype=np.int64)] = np.frombuffer(b"".join(got["row"]), "<f4").reshape(-1, width)
    return out


def _multiply(w: Weights, block: np.ndarray):
    """Adds up A'(A block) of the rows that a task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block.shape)
        for whole in batches:
            for _, d in _batches(whole):
                r, c, v = _weighted(d.whole(), d.n, w)
                y = _times(r, c, v, d.n, block)
                if len(r):
                    order = np.argsort(c, kind="stable")
                    total += _times(c[order], r[order], v[order], len(block), y)
        at = np.flatnonzero(total.any(axis=1))
        yield _vectors(at, total[at])

    return run


def singular_vectors(docs: DataFrame, w: Weights, rank: int = RANK, passes: int = PASSES, seed: int = 6, start: np.ndarray | None = None) -> np.ndarray:
    """The leading right singular vectors (numbered buckets x rank) of the weighted matrix of all ``docs``, from ``start`` or at random."""
    rank = max(1, min(rank, len(w)))
    block = np.random.default_rng(seed).normal(size=(max(len(w), 1), rank))
    if start is not None and start.shape == block.shape:
        block = start + 1e-3 * block / math.sqrt(len(block))
    block = np.linalg.qr(block)[0].astype(np.float32)
    for _ in range(passes if len(w) else 0):
        nxt = _sums(docs.mapInArrow(_multiply(w, block), "bucket long, row binary"), rank)[: len(w)]
        block = np.linalg.qr(nxt + 1e-12 * block)[0].astype(np.float32)
    return block


def _scales(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Space:
    """Terms to unit vectors of the latent space."""

    def __init__(self, w: Weights, vectors: np.ndarray) -> None:
        self.w, self.vectors = w, vectors

    def embed(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
        """Unit vectors of ``n`` sparse rows of counts."""
        return _scales(_times(*_weighted(rows, n, self.w), n, self.vectors))


class Centroids:
    """Per subject and group of like examples (a language) one centroid; a part's cosine with a subject is its best."""

    def __init__(self, names: list[str], owner: np.ndarray, at: np.ndarray) -> None:
        self.names, self.owner, self.at = names, owner, _scales(at)

    def cosines(self, x: np.ndarray) -> np.ndarray:
        sims = x @ self.at.T
        return np.stack([sims[:, self.owner == k].max(axis=1) if (self.owner == k).any() else np.full(len(x), -1.0) for k in range(len(self.names))], axis=1)


def seeds(names: list[str], examples: list[tuple[str, str, list[str]]], space: Space) -> Centroids:
    """Centroids of the examples (text, language, subjects); one of several subjects counts a part for each."""
    groups: dict[tuple[int, str], np.ndarray] = {}
    x = space.embed(counted([t or "" for t, _, _ in examples]), len(examples))
    for v, (text, lang, subjects) in zip(x, examples):
        mine = _listed(names, subjects) if text else []
        for k in mine:
            groups[k, lang or ""] = groups.get((k, lang or ""), 0) + v / len(mine)
    owner = np.array([k for k, _ in groups], dtype=int)
    at = np.stack(list(groups.values())) if groups else np.zeros((0, space.vectors.shape[1]))
    return Centroids(names, owner, at)


def _pull(space: Space, c: Centroids):
    """Sums of the parts that are clearly nearest to a centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(c.at), space.vectors.shape[1]))
        for whole in batches:
            for _, d in _batches(whole):
                if len(d.doc) and len(c.at):
                    x, cos = d.judged(space, c)
                    x = x[clearest(cos)[1]]
                    np.add.at(total, np.argmax(x @ c.at.T, axis=1), x)
        at = np.flatnonzero(total.any(axis=1))
        yield _vectors(at, total[at])

    return run


def refined(docs: DataFrame, space: Space, c: Centroids, rounds: int = PULLS) -> Centroids:
    """The centroids after ``rounds`` of moving toward the mean of the parts clearly nearest to them; sums of fixed size reach the driver."""
    for _ in range(rounds if len(c.at) else 0):
        sums = _sums(docs.mapInArrow(_pull(space, c), "bucket long, row binary"), space.vectors.shape[1])[: len(c.at)]
        moved = sums.any(axis=1, keepdims=True)
        c = Centroids(c.names, c.owner, np.where(moved, (1 - PULL) * c.at + PULL * _scales(sums), c.at))
    return c


def assigned(d: Docs, space: Space, c: Centroids, share: float = SHARE) -> list[list[str]]:
    """The subjects of each document: those that are the nearest of at least ``share`` of its parts (by length, up to a bound) that are near any."""
    out: list[list[str]] = [[] for _ in range(d.n)]
    if not len(d.doc) or not len(c.at):
        return out
    cos = d.judged(space, c)[1]
    best, near = cos.argmax(axis=1), cos.max(axis=1) >= LEAST
    ends = np.searchsorted(d.doc, np.arange(d.n + 1))
    for n, (lo, hi) in enumerate(zip(ends, ends[1:])):
        length, ok = d.length[lo:hi], near[lo:hi]
        if not ok.any():
            continue
        weight = np.minimum(length, 3 * np.median(length))
        if weight[ok].sum() < 0.3 * weight.sum():
            continue
        won = np.bincount(best[lo:hi][ok], weight[ok], minlength=len(c.names)) / weight[ok].sum()
        out[n] = [c.names[k] for k in np.flatnonzero(won >= share) if c.names[k] != NONE]
    return out


def _assign(space: Space, c: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part, d in _batches(whole):
                rows = [(k, s) for k, got in zip(part.column("doc_id").to_pylist(), assigned(d, space, c)) for s in got]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([s for _, s in rows], pa.string())], ["doc_id", "subject"])

    return run


def summaries(nodes: DataFrame, themes: DataFrame) -> DataFrame:
    """(doc_id, text, themes): of each doc_id whichever of doc_summary and source_text is present, the longer of the two, and its themes; ids with neither are left out."""
    a = nodes.select("doc_id", F.col("doc_summary").alias("text"), F.col("doc_themes").alias("themes"))
    b = themes.select("doc_id", F.col("source_text").alias("text"), "themes")
    every = a.unionByName(b).filter("doc_id IS NOT NULL")
    text = F.when(filled(F.col("text")), F.col("text"))
    one = every.groupBy("doc_id").agg(F.max_by(text, F.struct(F.length(text), text)).alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("themes", F.array().cast("array<string>")))))).alias("themes"))
    return one.filter("text IS NOT NULL")


def prepared(texts: DataFrame) -> DataFrame:
    """The term counts (COUNTS) of ``texts`` (doc_id, text, themes)."""
    return texts.select("doc_id", "text", "themes").mapInArrow(_prepare, COUNTS)


def fitted(docs: DataFrame, examples: DataFrame, subjects: DataFrame) -> tuple[Space, Centroids]:
    """The latent space of ``docs`` (COUNTS) and examples, and the refined centroids of the listed subjects."""
    spark = docs.sparkSession
    names = [NONE] + [r[0] for r in subjects.filter("subject <> ''").select("subject").distinct().orderBy("subject").collect()]
    rows = examples.filter("text IS NOT NULL").orderBy(F.xxhash64("example_id")).limit(MOST_EXAMPLES).select("text", "lang", "subjects").collect()
    labelled = [(r[0], r[1], r[2]) for r in rows]
    seen = docs
    if labelled:  # bounded by MOST_EXAMPLES
        more = spark.createDataFrame([(t,) for t, _, _ in labelled], "text string").coalesce(1)
        seen = docs.unionByName(materialize(prepared(more.select(F.lit("").alias("doc_id"), "text", F.array().cast("array<string>").alias("themes"))), "examples"))
    idf = inverse_frequencies(seen)
    seeded = example_counts(names, labelled)
    counts, last = seeded, None
    for k in range(ROUNDS):
        w = Weights(idf * told(counts))
        start = None
        if last is not None:  # the last round's vectors, where their buckets have a place now
            old, vectors = last
            start = np.zeros((len(w), vectors.shape[1]), dtype=np.float32)
            both = (w.place >= 0) & (old.place >= 0)
            start[w.place[both]] = vectors[old.place[both]]
        space = Space(w, singular_vectors(seen, w, passes=PASSES if start is None else MORE, start=start))
        last = (w, space.vectors)
        c = refined(docs, space, seeds(names, labelled, space), PULLS)
        if k < ROUNDS - 1:
            counts = 3 * seeded + _sums(docs.mapInArrow(_tally(space, c), "bucket long, row binary"), len(names))
    return space, c


def found(nodes: DataFrame, themes: DataFrame, examples: DataFrame, subjects: DataFrame) -> DataFrame:
    """Distinct (doc_id, subject); a document whose parts are near no subject has no row."""
    docs = materialize(prepared(summaries(nodes, themes)), "counts")
    space, c = fitted(docs, examples, subjects)
    return docs.mapInArrow(_assign(space, c), "doc_id string, subject string")


def shares(nodes: DataFrame, themes: DataFrame, examples: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, n_docs, share): how much of the documents with text is about each subject, subjects without documents too."""
    got = found(nodes, themes, examples, subjects)
    n = summaries(nodes, themes).agg(F.count(F.lit(1)).alias("all"))
    by = got.groupBy("subject").agg(F.countDistinct("doc_id").alias("n"))
    out = subjects.select("subject").filter("subject IS NOT NULL").distinct().join(by, "subject", "left").join(F.broadcast(n))  # one row
    return out.select("subject", F.coalesce("n", F.lit(0)).alias("n_docs"), (F.coalesce("n", F.lit(0)) / F.greatest("all", F.lit(1))).alias("share"))
