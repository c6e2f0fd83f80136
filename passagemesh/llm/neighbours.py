"""The most similar vectors of every vector, by multiprobe hashing in two layers (problem 7).

The first layer has one table of cells, which are what partitions hold: a cell is what is nearest to one of a number of fixed directions. Each
vector lies in the cell of its nearest direction and visits those of all directions that are almost as near. How far it visits
is not fixed: the margin is found by simulation, for the number of cells that the number of vectors asks for, such that pairs at
the least cosine meet with probability RECALL. Where vectors visit many cells, cells are searched in several rounds, so that what is moved at a time stays
in proportion to the input. Inside a cell a second layer runs in memory, of several tables of p-stable hashing (a bucket is the tuple of floors of Gaussian projections
divided by a width) with perturbed probes: the vectors that lie in the cell are held, visitors pass them in parts, so a task's memory does not grow with the
visits. Candidates of all tables are merged and ranked by exact cosines. Cells that are crowded are hashed again
by further projections whose width is scaled to the cell's own spread.

Equal vectors form a class that is searched once, for its smallest id.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import tempfile
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagemesh.runtime import bounded, discard, materialize

DIMS = 64
#: Slot width (projections of unit vectors have standard deviation 1); vectors that a cell should hold; a cell with more than CROWDED times that is hashed again.
WIDTH, CELL, CROWDED = 2.4, 150_000, 4
#: Probability with which a pair at the least cosine meets in a cell; pairs simulated to find the radius.
RECALL, SIMULATED = 0.98, 20_000
#: Inside a cell: tables, perturbed buckets per table, vectors that a bucket should hold, bits that a projection tells apart.
TABLES, PROBES, BUCKET, BITS = 3, 15, 50, 1.2
#: Most halvings of the first layer; projections of each further one; further layers.
MOST, FURTHER, LAYERS = 14, 8, 5
#: Vectors of a cell that are held at once; visitors that pass them at once; cells that a vector visits in one round, on average.
HOMES, PART, SENT = 150_000, 50_000, 2.0
#: Products held at once; candidates held before they are reduced.
BLOCK, HELD = 250_000, 1_000_000
#: What single precision may change of a cosine.
SLACK = 4e-6
SEED = 20
#: Parts into which the members of a large class are split.
SALTS = 32


# --- exact vectors as bytes ---------------------------------------------------------------------------------------------


@np.errstate(over="ignore")
def packed(x: np.ndarray) -> list[bytes]:
    """Each row without loss in the shortest of: two-byte integers times a power of ten, single precision, double precision. Equal rows give equal bytes."""
    x = x + 0.0  # one zero
    kind = np.full(len(x), 255)
    kind[(x.astype("<f4").astype("<f8") == x).all(axis=1)] = 254
    ints = np.zeros(x.shape, dtype="<i2")
    for d in range(10):
        left = kind > 9
        if not left.any():
            break
        y = np.rint(x[left] * 10.0**d)
        ok = ((np.abs(y) < 32767) & (y / 10.0**d == x[left])).all(axis=1)
        at = np.flatnonzero(left)[ok]
        ints[at], kind[at] = y[ok], d
    f4, f8 = x.astype("<f4"), x.astype("<f8")
    return [bytes([k]) + (ints[i] if k < 10 else f4[i] if k == 254 else f8[i]).tobytes() for i, k in enumerate(kind.tolist())]


def unpacked(rows: list[bytes] | pa.Array) -> np.ndarray:
    """The rows at unit length."""
    rows = rows.cast(pa.binary()) if isinstance(rows, pa.Array) else pa.array(rows, pa.binary())
    x = np.empty((len(rows), DIMS))
    for first in range(0, len(rows), 5000):
        part = rows.slice(first, 5000)
        start = np.frombuffer(part.buffers()[1], dtype=np.int32)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], dtype=np.uint8)
        kind = data[start[:-1]]
        y = x[first : first + 5000]
        for k in np.unique(kind):
            at = np.flatnonzero(kind == k)
            form = np.dtype("<i2" if k < 10 else "<f4" if k == 254 else "<f8")
            got = data[(start[at] + 1)[:, None] + np.arange(DIMS * form.itemsize, dtype=np.int32)].view(form)
            y[at] = got / 10.0 ** int(k) if k < 10 else got
        y /= np.abs(y).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
        y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their vectors: of 64 finite numbers, not all zero."""
    at = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == DIMS)
    if not len(at):
        return at, np.zeros((0, DIMS))
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, DIMS)  # nulls become NaN
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return at[ok], x[ok]


# --- the first layer: cells ---------------------------------------------------------------------------------------------


def _directions(seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(DIMS, DIMS)))[0] * math.sqrt(DIMS)


def projections(n: int, cell: int = CELL) -> int:
    """How often the cells of the first layer are halved for ``n`` vectors."""
    return max(0, min(MOST, math.ceil(math.log2(max(n, 1) / cell))))


def _simulated(least: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at cosine ``least``."""
    rng = np.random.default_rng(seed + 1)
    a = rng.normal(size=(SIMULATED, DIMS))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(SIMULATED, DIMS))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    return a, least * a + math.sqrt(max(0.0, 1 - least * least)) * b / np.linalg.norm(b, axis=1, keepdims=True)


@lru_cache(maxsize=None)
def radius(m: int, least: float, recall: float = RECALL, seed: int = SEED) -> float:
    """How far, in projected distance to the borders crossed, a vector must visit for a pair at cosine ``least`` to meet in a further layer with probability ``recall``."""
    if not m:
        return 0.0
    fa, fb = (v @ _directions(seed)[:, :m] / WIDTH for v in _simulated(least, seed))
    step = np.floor(fb) - np.floor(fa)

    def need(f: np.ndarray, step: np.ndarray) -> np.ndarray:
        down = f - np.floor(f)
        cost = np.where(step == 0, 0, np.where(step < 0, down, 1 - down) ** 2)
        return np.where(np.abs(step).max(axis=1) > 1, np.inf, cost.sum(axis=1))

    either = np.minimum(need(fa, step), need(fb, -step))
    return float(np.sqrt(np.quantile(either, recall, method="higher"))) * WIDTH


@lru_cache(maxsize=4)
def centres(m: int, seed: int = SEED) -> np.ndarray:
    """The directions of the ``2**m`` cells, of unit length, one a column: those of random rotations and their opposites."""
    turns = [_directions(seed * 100 + i) / math.sqrt(DIMS) for i in range(-(-(2**m) // (2 * DIMS)))]
    return np.concatenate([np.concatenate([t, -t], axis=1) for t in turns], axis=1)[:, : 2**m].astype(np.float32)


@lru_cache(maxsize=None)
def margin(m: int, least: float, recall: float = RECALL, seed: int = SEED) -> tuple[float, float]:
    """By how much a direction may be less near than the nearest one for a cell to be visited, so that a pair at cosine ``least`` meets with probability ``recall``; cells visited, on average."""
    if not m:
        return 0.0, 1.0
    pairs = [v.astype(np.float32) for v in _simulated(least, seed)]
    blocks = [slice(i, i + max(1, 2_000_000 >> m)) for i in range(0, SIMULATED, max(1, 2_000_000 >> m))]
    either = []
    for at in blocks:
        sa, sb = (v[at] @ centres(m, seed) for v in pairs)
        r, ia, ib = np.arange(len(sa)), sa.argmax(axis=1), sb.argmax(axis=1)
        either.append(np.minimum(sa[r, ia] - sa[r, ib], sb[r, ib] - sb[r, ia]))
    far = float(np.quantile(np.concatenate(either), recall, method="higher"))
    visited = sum(int((s >= s.max(axis=1, keepdims=True) - far).sum()) for s in (pairs[0][at] @ centres(m, seed) for at in blocks))
    return far, visited / SIMULATED


class Cells:
    """Places vectors in ``2**m`` cells. ``far`` is the margin of visits; per further layer the spread of each crowded cell of the one before."""

    def __init__(self, m: int, least: float, layers: list[dict[int, float]] | None = None, recall: float = RECALL) -> None:
        self.m, self.least, self.recall, self.layers = m, least, recall, layers or []
        self.far, self.visited = margin(m, least, recall)  # found by the driver
        self.directions = _directions(SEED)

    def _columns(self, layer: int) -> np.ndarray:
        first = self.m + FURTHER * (layer - 1)
        return np.arange(first, first + FURTHER) % DIMS

    def project(self, x: np.ndarray, layer: int) -> np.ndarray:
        """Projections of a further layer, which those of its cells' spread are taken of."""
        return x @ self.directions[:, self._columns(layer)]

    def _expand(self, f: np.ndarray, key: np.ndarray, visits: bool, layer: int, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, key, own) of the slots of ``f`` (in widths) that are visited, the own ones first."""
        slot = np.floor(f)
        down = f - slot
        n = len(f)
        which, key, cost, own = np.arange(n), key * np.int64(1_000_003) + layer, np.zeros(n), np.ones(n, dtype=bool)
        most = (radius(f.shape[1], self.least, self.recall) / WIDTH) ** 2
        with np.errstate(over="ignore"):
            for i in range(f.shape[1]):
                parts = [(which, key, cost, own, 0)]
                if visits:
                    for step, d in ((-1, down[which, i]), (1, 1 - down[which, i])):
                        ok = cost + d * d <= most
                        parts.append((which[ok], key[ok], (cost + d * d)[ok], np.zeros(int(ok.sum()), dtype=bool), step))
                key = np.concatenate([k * np.int64(-7046029254386353131) + (slot[w, i].astype(np.int64) + s) * np.int64(2654435761) + 1 for w, k, _, _, s in parts])
                which, cost, own = (np.concatenate([p[j] for p in parts]) for j in (0, 2, 3))
        return row[which], key, own

    def _nearest(self, x: np.ndarray, visits: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, key, own) of the cells of the first layer."""
        parts = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool))]
        for at in range(0, len(x), max(1, 2_000_000 >> self.m)):
            s = x[at : at + max(1, 2_000_000 >> self.m)].astype(np.float32) @ centres(self.m)
            mine = s.argmax(axis=1)
            row, c = np.nonzero(s >= s.max(axis=1, keepdims=True) - self.far) if visits else (np.arange(len(s)), mine)
            parts.append((row + at, c, mine[row] == c))
        row, c, own = (np.concatenate(p) for p in zip(*parts))
        with np.errstate(over="ignore"):
            return row, (c + 1) * np.int64(-7046029254386353131), own

    def place(self, x: np.ndarray, visits: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, own): the cells each row of ``x`` is sent to; ``own`` is the one it lies in."""
        n = len(x)
        row, key, own = self._nearest(x, visits)
        for layer, crowded in enumerate(self.layers, 1):
            known = np.array(sorted(crowded), dtype=np.int64)
            at = np.searchsorted(known, key).clip(0, max(len(known) - 1, 0))
            hot = known[at] == key if len(known) else np.zeros(len(key), dtype=bool)
            if not hot.any():
                continue
            spread = np.array([crowded[int(k)] for k in known])[at[hot]]
            f = self.project(x[row[hot]], layer) / (WIDTH * spread[:, None])
            more = self._expand(f, key[hot], visits, layer, row[hot])
            was = own[hot]
            # a visitor's slot in the crowded cell is a visit too
            r, k, o = more
            mine = np.zeros(n, dtype=bool)
            mine[row[hot][was]] = True
            row, key, own = np.concatenate([row[~hot], r]), np.concatenate([key[~hot], k]), np.concatenate([own[~hot], o & mine[r]])
        return row, key, own


# --- the second layer: inside a cell ------------------------------------------------------------------------------------


def perturbations(m: int, count: int) -> list[tuple[int, ...]]:
    """The ``count`` likeliest sets of borders to cross, as ranks among the 2m border distances in ascending order.

    Expected squared distance of the j-th nearest of 2m borders, for slots passed at uniform places.
    """
    expected = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    expected += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    ranks = range(min(2 * m, 12))
    sets = [s for size in (1, 2, 3) for s in itertools.combinations(ranks, size) if not any(2 * m - 1 - x in s for x in s)]
    return sorted(sets, key=lambda s: sum(expected[x] for x in s))[:count]


def buckets(x: np.ndarray, m: int, table: int, probes: int = PROBES) -> list[np.ndarray]:
    """The bucket of each row in one table, then those of its perturbations in order of expected success."""
    rng = np.random.default_rng(SEED * 1000 + table)
    f = (x @ _directions(SEED * 1000 + table)[:, :m] + rng.uniform(0, WIDTH, m)) / WIDTH
    mult = rng.integers(1, 2**62, m, dtype=np.int64) | 1
    slot = np.floor(f)
    with np.errstate(over="ignore"):
        own = (slot.astype(np.int64) * mult).sum(axis=1)
        down = f - slot
        order = np.argsort(np.concatenate([down, 1 - down], axis=1), axis=1, kind="stable")
        step = np.concatenate([-mult, mult])
        return [own] + [own + sum(step[order[:, r]] for r in borders) for borders in perturbations(m, probes)]


class _Best:
    """The best ``k`` candidates of every row so far, and what a further one must reach."""

    def __init__(self, n: int, k: int, least: float) -> None:
        self.n, self.k = n, k
        self.floor = np.full(n, least - SLACK, dtype=np.float32)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, q: np.ndarray, i: np.ndarray, s: np.ndarray) -> None:
        for a, b in ((q, i), (i, q)):
            ok = (s >= self.floor[a]) & (a != b)
            self.parts.append((a[ok].astype(np.int64) * self.n + b[ok], s[ok]))
            self.held += int(ok.sum())
        if self.held > HELD:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, candidate): those that may be among the best, all equal ones too."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, first = np.unique(np.concatenate([p[0] for p in self.parts]), return_index=True)
        s = np.concatenate([p[1] for p in self.parts])[first]
        a = key // self.n
        order = np.lexsort((-s, a))
        start = np.searchsorted(a[order], np.arange(self.n + 1))
        full = np.flatnonzero(np.diff(start) >= self.k)
        self.floor[full] = np.maximum(self.floor[full], s[order][start[full] + self.k - 1] - SLACK)
        ok = s >= self.floor[a]
        self.parts, self.held = [(key[ok], s[ok])], 0  # what is kept is no reason to reduce again
        return a[ok], key[ok] % self.n


class _Tables:
    """The rows that lie in a cell, by bucket, in several tables."""

    def __init__(self, vec: pa.Array) -> None:
        n = len(vec)
        self.single = np.empty((n, DIMS), dtype=np.float32)
        self.m = max(0, round(math.log2(max(n, 1) / BUCKET) / BITS))
        own = np.empty((TABLES if self.m > 0 else 1, n), dtype=np.int64)
        for at in range(0, n, 10_000):
            x = unpacked(vec.slice(at, 10_000))
            self.single[at : at + len(x)] = x
            for table in range(len(own)):
                own[table, at : at + len(x)] = self._keys(x, table, 0)[0]
        self.tables = []
        for keys in own:
            order = np.argsort(keys, kind="stable").astype(np.int32)
            known, start = np.unique(keys[order], return_index=True)
            self.tables.append((order, known, np.append(start, n)))

    def _keys(self, x: np.ndarray, table: int, probes: int) -> list[np.ndarray]:
        return buckets(x, self.m, table, probes) if self.m > 0 else [np.zeros(len(x), dtype=np.int64)]

    def meet(self, x: np.ndarray, first: int, best: _Best) -> None:
        """Adds to ``best`` the rows of ``x`` with the rows whose buckets they probe; ``first`` is the number of the first of them."""
        single = x.astype(np.float32)
        for table, (order, known, start) in enumerate(self.tables):
            to, who = [], []
            for some in range(0, len(x), 10_000):
                for key in self._keys(x[some : some + 10_000], table, PROBES):
                    at = np.searchsorted(known, key).clip(0, len(known) - 1)
                    ok = np.flatnonzero(known[at] == key)
                    to.append(at[ok].astype(np.int32))
                    who.append((ok + some).astype(np.int32))
            to, who = np.concatenate(to), np.concatenate(who)
            who = who[np.argsort(to, kind="stable")]
            cuts = np.cumsum(np.bincount(to, minlength=len(known)))
            for b, (lo, hi) in enumerate(zip(np.append(0, cuts[:-1]), cuts)):
                for h in range(start[b], start[b + 1], 2000):  # a bucket of whatever size, in blocks
                    mine = order[h : min(h + 2000, start[b + 1])]
                    block = max(64, BLOCK // len(mine))
                    for at in range(lo, hi, block):
                        q = who[at : min(at + block, hi)]
                        sims = single[q] @ self.single[mine].T
                        at_least = np.flatnonzero(sims.ravel() >= min(best.floor[q + first].min(), best.floor[mine].min()))
                        if len(at_least):
                            r, c = np.divmod(at_least, len(mine))
                            best.add(q[r].astype(np.int64) + first, mine[c], sims[r, c])
            best.reduce()


# --- the tasks ----------------------------------------------------------------------------------------------------------

_KEPT = "kind string, id string, class binary, vec binary"
_SENT = "cell long, own boolean, kind string, id string, ids array<string>, vec binary"
_NEAR = "kind string, id string, c array<struct<d:int,other:string>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that take part, with their exact vectors and classes; equal rows of a task once, so that no class floods a cell."""
    seen: set[tuple[str, str, bytes]] = set()
    for b in batches:
        rows, x = _usable(b.column("embedding"))
        if not len(rows):
            continue
        vec = packed(x)
        classes = [hashlib.blake2b(v, digest_size=16).digest() for v in vec]
        kinds, ids = (b.column(n).take(pa.array(rows)).to_pylist() for n in ("kind", "id"))
        new = []
        for i, key in enumerate(zip(kinds, ids, classes)):
            if key not in seen:
                seen.add(key)
                new.append(i)
        pick = lambda v: [v[i] for i in new]
        yield pa.RecordBatch.from_arrays([pa.array(pick(kinds), pa.string()), pa.array(pick(ids), pa.string()), pa.array(pick(classes), pa.binary()), pa.array(pick(vec), pa.binary())], ["kind", "id", "class", "vec"])


def _mixed(kind: str, cell: np.ndarray) -> np.ndarray:
    """Cells of different kinds apart."""
    with np.errstate(over="ignore"):
        return cell ^ np.int64(int.from_bytes(hashlib.blake2b(kind.encode(), digest_size=8).digest(), "big", signed=True))


def _by_kind(b: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    kinds = np.asarray(b.column("kind").to_pylist(), dtype=object)
    for kind in sorted(set(kinds)):
        at = np.flatnonzero(kinds == kind)
        yield kind, at, unpacked(b.column("vec").take(pa.array(at)))


def _marked(cells: dict[str, Cells]):
    """(kind, id, class, cell) of the rows, without their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _read(batches):
            cell = np.zeros(b.num_rows, dtype=np.int64)
            for kind, at, x in _by_kind(b):
                row, key, _ = cells[kind].place(x, visits=False)
                cell[at[row]] = key
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("id"), b.column("class"), pa.array(cell)], ["kind", "id", "class", "cell"])

    return run


def _spreads(cells: dict[str, Cells], crowded: dict[str, set[int]], layer: int):
    """Per crowded cell, counts, sums and sums of squares of the next layer's projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], np.ndarray] = {}
        for b in _read(batches):
            for kind, _, x in _by_kind(b):
                row, key, _ = cells[kind].place(x, visits=False)
                f = cells[kind].project(x[row], layer)
                for k in crowded.get(kind, ()):
                    p = f[key == k]
                    if len(p):
                        total[kind, k] = total.get((kind, k), 0) + np.array([len(p), p.sum(), (p * p).sum()] + p.sum(axis=0).tolist())
        rows = [(kind, k, t.tolist()) for (kind, k), t in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["kind", "cell", "t"])

    return run


def _visits(cells: dict[str, Cells], turn: int = 0, turns: int = 1):
    """The rows, once for each cell they are sent to, of the cells of one of several rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 5000):
                b = whole.slice(at, 5000)
                for kind, rows, x in _by_kind(b):
                    row, key, own = cells[kind].place(x)
                    key = _mixed(kind, key)
                    now = key.view(np.uint64) % np.uint64(turns) == turn
                    take = pa.array(rows[row[now]])
                    yield pa.RecordBatch.from_arrays([pa.array(key[now]), pa.array(own[now]), *[b.column(n).take(take) for n in ("kind", "id", "ids", "vec")]], ["cell", "own", "kind", "id", "ids", "vec"])

    return run


def _ranks(ids: pa.Array) -> np.ndarray:
    """The place of each id by code point."""
    rank = np.empty(len(ids), dtype=np.int64)
    rank[pc.sort_indices(ids.cast(pa.binary())).to_numpy()] = np.arange(len(ids))
    return rank


def _first(a: np.ndarray, other: pa.Array, cosine: np.ndarray, k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each row's best ``k``, by cosine, then id; an id counts once a row."""
    if not len(a):
        return a, other, cosine
    coded = other.dictionary_encode()
    rank = _ranks(coded.dictionary)[coded.indices.to_numpy()]
    order = np.lexsort((rank, -cosine, a))
    once = np.append(True, (np.diff(a[order]) != 0) | (np.diff(rank[order]) != 0))
    order = order[once]
    order = order[np.arange(len(order)) - np.searchsorted(a[order], a[order]) < k]
    return a[order], other.take(pa.array(order)), cosine[order]


def _standing(a: np.ndarray, b: np.ndarray, cosine: np.ndarray, ids: pa.Array, classes: pa.Array, k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, id, cosine): candidates as the smallest ids of their classes, each row's best ``k``. ``ids`` and ``classes`` are those of the candidates."""
    size = np.asarray(classes.value_lengths().fill_null(0))[b]
    single, several = np.flatnonzero(size == 0), np.flatnonzero(size)
    from_ = np.concatenate([single, np.repeat(several, size[several])])
    other = ids.take(pa.array(b[single]))
    if len(several):
        other = pa.concat_arrays([other, classes.take(pa.array(b[several])).flatten()])
    return _first(a[from_], other, cosine[from_], k)


def _lists(kind: str, a: np.ndarray, ids: pa.Array, other: pa.Array, cosine: np.ndarray) -> pa.RecordBatch:
    """A list of ``other`` for each row ``a`` of ``ids``, which are in order."""
    who, first = np.unique(a, return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(a)), pa.int32()), pa.StructArray.from_arrays([pa.array(-np.rint(cosine * 1e6).astype(np.int32)), other], ["d", "other"]))
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(who), pa.string()), ids.take(pa.array(who)), lists], ["kind", "id", "c"])


def _once(b: pa.RecordBatch, but: pa.Array | None = None) -> pa.RecordBatch:
    """The rows of different ids, without those in ``but``."""
    if but is not None:
        b = b.filter(pc.invert(pc.is_in(b.column("id"), value_set=but)))
    code = b.column("id").dictionary_encode().indices.to_numpy()
    first = np.sort(np.unique(code, return_index=True)[1])
    return b if len(first) == b.num_rows else b.take(pa.array(first))


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(cell, own, rows) of the stream, which is in order of both."""
    for b in batches:
        cell, own = b.column("cell").to_numpy(), b.column("own").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(cell) != 0) | (own[1:] != own[:-1])])) if b.num_rows else []
        for lo, hi in zip(starts, np.append(starts[1:], b.num_rows)):
            yield int(cell[lo]), bool(own[lo]), b.slice(lo, hi - lo)


def _parts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stream in parts of about PART rows."""
    held: list[pa.RecordBatch] = []
    for b in rows:
        held.append(b)
        if sum(h.num_rows for h in held) >= PART:
            yield _joined(held)
            held = []
    if held:
        yield _joined(held)


def _cell(homes: pa.RecordBatch, rest: Iterator[pa.RecordBatch], k: int, least: float) -> Iterator[pa.RecordBatch]:
    """Of each row that is held or passes, its ``k`` best others by cosine, then id, of pairs of which one is held."""
    homes = _once(homes)
    kind, ids, vec, n = homes.column("kind")[0].as_py(), homes.column("id"), homes.column("vec"), homes.num_rows
    tables = _Tables(vec)
    floor = np.full(n, least - SLACK, dtype=np.float32)
    found: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
    size = 0  # of the first of what was found, which is reduced

    def reduced() -> tuple[np.ndarray, pa.Array, np.ndarray]:
        nonlocal found, size
        a, other, cosine = _first(np.concatenate([f[0] for f in found]), pa.concat_arrays([f[1] for f in found]), np.concatenate([f[2] for f in found]), k)
        start = np.searchsorted(a, np.arange(n + 1))
        full = np.flatnonzero(np.diff(start) >= k)
        floor[full] = np.maximum(floor[full], cosine[start[full] + k - 1] - SLACK)
        found, size = [(a, other, cosine)], len(a)
        return found[0]

    for i, b in enumerate(itertools.chain((homes.slice(at, PART) for at in range(0, n, PART)), _parts(rest))):
        inner = i * PART < n
        first = i * PART if inner else n
        if not inner:
            b = _once(b, ids)
            if not b.num_rows:
                continue
        x = unpacked(b.column("vec"))
        best = _Best(n if inner else n + len(x), k, least)
        best.floor[:n] = floor
        tables.meet(x, first, best)
        a, c = best.reduce()
        # exact cosines, of the candidates' exact vectors
        cosine = np.empty(len(a))
        for at in range(0, len(a), 10_000):
            left, right = (_exact(v[at : at + 10_000], vec, x, first, inner) for v in (a, c))
            cosine[at : at + 10_000] = np.einsum("ij,ij->i", left, right)
        cosine = np.round(np.minimum(cosine, 1.0), 6)
        ok = cosine >= least
        a, c, cosine = a[ok], c[ok], cosine[ok]
        all_ids = ids if inner else pa.concat_arrays([ids, b.column("id")])
        classes = homes.column("ids") if inner else pa.concat_arrays([homes.column("ids"), b.column("ids")])
        held = a < n
        if held.any():
            found.append(_standing(a[held], c[held], cosine[held], all_ids, classes, k))
        if not held.all():
            who, other, cos = _standing(a[~held], c[~held], cosine[~held], all_ids, classes, k)
            yield _lists(kind, who, all_ids, other, cos)
        if sum(len(f[0]) for f in found) > max(HELD // 2, 2 * size) or inner and first + PART >= n and found:
            reduced()
    if found:
        a, other, cosine = reduced()
        yield _lists(kind, a, ids, other, cosine)
    pa.default_memory_pool().release_unused()


def _exact(rows: np.ndarray, vec: pa.Array, x: np.ndarray, first: int, inner: bool) -> np.ndarray:
    """Unit vectors of rows, which are held or, from ``first`` on, pass."""
    if inner:
        return unpacked(vec.take(pa.array(rows)))
    out = np.empty((len(rows), DIMS))
    held = rows < first
    out[held] = unpacked(vec.take(pa.array(rows[held])))
    out[~held] = x[rows[~held] - first]
    return out


def _searched(k: int, least: float, most: int = HOMES):
    """Searches cell by cell; rows are in order of the cells, those that lie in one before its visitors. Cells of more than ``most`` rows are held in turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in itertools.groupby(_pieces(batches), key=lambda p: p[0]):
            rows = ((own, b) for _, own, b in pieces)
            homes, n, over = [], 0, []
            for own, b in rows:
                if not own or n >= most:
                    over = [(own, b)]
                    break
                homes.append(b)
                n += b.num_rows
            if not homes:  # a cell of visitors only
                continue
            rest = (b for _, b in itertools.chain(over, rows))
            if not (over and over[0][0]):
                yield from _cell(_joined(homes), rest, k, least)
                continue
            with tempfile.TemporaryFile() as file:  # the rest passes these, then the next of it are held
                with pa.ipc.new_file(file, homes[0].schema) as out:
                    yield from _cell(_joined(homes), _written(rest, out), k, least)
                homes = []
                file.seek(0)
                yield from run(_again(pa.ipc.open_file(file)))

    return run


def _written(rows: Iterator[pa.RecordBatch], out: pa.ipc.RecordBatchFileWriter) -> Iterator[pa.RecordBatch]:
    for b in rows:
        out.write_batch(b)
        yield b


def _again(file: pa.ipc.RecordBatchFileReader) -> Iterator[pa.RecordBatch]:
    for i in range(file.num_record_batches):
        yield file.get_batch(i)


# --- the plan -----------------------------------------------------------------------------------------------------------


def _crowded(rows: DataFrame, marks: DataFrame, cells: dict[str, Cells], cell: int) -> DataFrame:
    """Adds layers to ``cells`` until no cell is crowded or all layers are used; the marks with the final cells. Only crowded cells reach the driver: fewer than vectors / (CROWDED * cell)."""
    for layer in range(1, LAYERS + 1):
        if not any(c.m for c in cells.values()):
            break
        hot = marks.groupBy("kind", "cell").agg(F.approx_count_distinct("class").alias("n")).filter(F.col("n") > CROWDED * cell).collect()
        if not hot:
            break
        by: dict[str, set[int]] = {}
        for r in hot:
            by.setdefault(r["kind"], set()).add(r["cell"])
        sums = rows.mapInArrow(_spreads(cells, by, layer), "kind string, cell long, t array<double>")
        width = 3 + FURTHER
        sums = sums.groupBy("kind", "cell").agg(F.array(*[F.sum(F.col("t")[i]) for i in range(width)]).alias("t")).collect()
        for kind, c in cells.items():
            spread = {}
            for r in sums:
                if r["kind"] == kind:
                    n, _, squares, *each = r["t"]
                    spread[r["cell"]] = max(1e-9, math.sqrt(max(0.0, squares / n - sum((s / n) ** 2 for s in each)) / FURTHER))
            c.layers.append(spread)
        marks = materialize(rows.mapInArrow(_marked(cells), "kind string, id string, class binary, cell long"), "marks")
    return marks


def nearest(vectors: DataFrame, k: int = 5, least: float = 0.85, cell: int = CELL, recall: float = RECALL) -> DataFrame:
    """(kind, id, other, cosine, rank): of each id the up to ``k`` most similar other ids of its kind at ``least`` cosine, equal ones by smaller id.

    ``vectors`` has ``id`` (string), ``embedding`` and, where several sets are searched at once, ``kind``. Only vectors of 64 finite numbers that are not
    all zero take part; rows with a null id do not; an id that is repeated counts once, with one of its vectors. Cosines are rounded to six decimals. Equal
    vectors, however many, are searched once as a class (told apart by 128 bits of a digest of their bytes), and each is given the smallest ids of its class.
    A pair at cosine ``least`` is met with a probability of about ``recall``, a closer one with a higher one. Empty input gives an empty result.
    """
    kind = F.col("kind") if "kind" in vectors.columns else F.lit("")
    rows = vectors.select(kind.alias("kind"), "id", "embedding").filter("id IS NOT NULL AND embedding IS NOT NULL")
    sizes = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a kind
    cells = {name: Cells(projections(n, cell), least, [], recall) for name, n in sizes.items()}
    marks = materialize(rows.mapInArrow(_marked(cells), "kind string, id string, class binary, cell long"), "marks")
    marks = _crowded(rows, marks, cells, cell)

    # Ids with several vectors keep the one of the smallest class; classes of several ids are searched for the smallest id.
    h = F.xxhash64("kind", "id")
    doubtful = marks.groupBy(h.alias("h")).agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a <> b").select("h")
    several = marks.groupBy("kind", "class").agg(F.min(h).alias("a"), F.max(h).alias("b")).filter("a <> b").select("kind", "class")
    kept = materialize(marks.withColumn("h", h).join(bounded(materialize(doubtful, "doubtful")), "h", "left_semi").groupBy("kind", "id").agg(F.min("class").alias("keep")), "kept")
    twins = marks.join(bounded(materialize(several, "several")), ["kind", "class"], "left_semi").select("kind", "id", "class").distinct()
    has_kept = not kept.isEmpty()
    if has_kept:
        twins = twins.join(bounded(kept), ["kind", "id"], "left").filter("keep IS NULL OR keep = class").drop("keep")
    w = Window.partitionBy("kind", "class").orderBy("id")
    twins = materialize(twins, "twins")
    small = twins.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    small = small.groupBy("kind", "class").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("kind", "class", F.col("ids")[0].alias("first"), "ids")
    small = materialize(small, "small")
    has_twins = not small.isEmpty()

    one = rows.mapInArrow(_read, _KEPT)
    if has_kept:
        one = one.join(bounded(kept), ["kind", "id"], "left").filter("keep IS NULL OR keep = class").drop("keep")
    ids = F.lit(None).cast("array<string>").alias("ids")
    if has_twins:
        one = one.join(bounded(small), ["kind", "class"], "left").filter("first IS NULL OR first = id")
        ids = F.col("ids")
    # Rounds are searched one after the other, so that the files of one are gone before the next.
    sent = sum(n * cells[name].visited for name, n in sizes.items())
    turns = max(1, math.ceil(sent / (SENT * max(1, sum(sizes.values())))))
    parts = -(-max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * math.ceil(sum(sizes.values()) / cell)) // turns)
    one = one.select("kind", "id", ids, "vec")
    if turns > 1:
        discard(marks)
        one = materialize(one, "one", freed=True)
    lists = []
    for turn in range(turns):
        found = one.mapInArrow(_visits(cells, turn, turns), _SENT).repartition(parts, "cell").sortWithinPartitions("cell", F.desc("own")).mapInArrow(_searched(k, least), _NEAR)
        lists.append(materialize(found, "near", freed=True) if turns > 1 else found)
    near = reduce(DataFrame.unionByName, lists)
    if has_twins:
        near = near.unionByName(small.select("kind", F.col("first").alias("id"), F.transform("ids", lambda i: F.struct(F.lit(-1_000_000).alias("d"), i.alias("other"))).alias("c")))
    # A row's lists, at most one a cell it visited, merged; one more than needed, since its own id may be among them.
    merged = near.groupBy("kind", "id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))), 1, k + 1).alias("c"))
    if turns > 1:
        discard(one)
        merged = materialize(merged, "merged", freed=True)
        for found in lists:
            discard(found)
    if has_twins:
        # Members of a class, however many, meet the list of its smallest id in SALTS parts.
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
        members = twins.join(bounded(small.select("kind", "class", "first")), ["kind", "class"]).select("kind", F.col("first").alias("id"), F.col("id").alias("member"), salt.alias("salt"))
        several = bounded(small.select("kind", F.col("first").alias("id"), F.lit(True).alias("several")))
        salts = F.when(F.col("several"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
        spread = merged.join(several, ["kind", "id"], "left").select("kind", "id", "c", "several", F.explode(salts).alias("salt"))
        merged = spread.join(bounded(members), ["kind", "id", "salt"], "left").filter("several IS NULL OR member IS NOT NULL").select("kind", F.coalesce("member", "id").alias("id"), "c")
    mine = merged.select("kind", "id", F.slice(F.filter("c", lambda e: e["other"] != F.col("id")), 1, k).alias("c"))
    return mine.select("kind", "id", F.posexplode("c").alias("p", "e")).select("kind", "id", F.col("e.other").alias("other"), (F.col("e.d") / -1e6).alias("cosine"), (F.col("p") + 1).alias("rank"))


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.85, cell: int = CELL, recall: float = RECALL) -> DataFrame:
    """Distinct (kind, id_a, id_b), id_a < id_b, where either is among the other's ``k`` most similar at ``least`` cosine."""
    near = nearest(vectors, k, least, cell, recall)
    return near.select("kind", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
