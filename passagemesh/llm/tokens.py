"""Byte-level BPE as a deterministic automaton (problem 8).

Compilation starts from one state with an arc for every byte and applies the merges in order. The gadget
of a merge (u, v) -> w copies the state that u leads to without its v arc, lets u lead to the copy, and
gives every state that has a u arc a w arc to where v leads. By induction the target of an arc depends on
its label only and every state is its parent minus one label, so the automaton is three integer arrays;
whether a state has an arc is computed from them on demand and kept. Of all ways to label a byte string
with tokens exactly one is a path of the automaton: the tokenization by the ordered merges.

A pre-split word is encoded by table-driven transitions: from each reached position the byte trie is
walked, and every token on the walk that is an arc of the position's state reaches its end. The labels of
the arcs back from the word's end are its ids; decoding emits the bytes of the labels.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabulary files lie; every function here takes another place as a parameter.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.json"

# The pre-splitting pattern of the byte-level tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words kept per worker with their ids; at this many the table is emptied. Longer words aren't kept.
WORD_TABLE, WORD_BYTES = 200_000, 48
#: Arc answers kept per worker.
ARC_TABLE = 1_000_000

_NEVER = 1 << 60


def byte_symbols() -> dict[str, int]:
    """The printable stand-in character of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeAutomaton:
    """The automaton of an ordered merge list, with encoder and decoder."""

    def __init__(self, merges: list[tuple[bytes, bytes]], ids: dict[bytes, int]) -> None:
        import regex

        self._split = regex.compile(PATTERN).findall
        self.ids = ids
        self.labels = {i: t for t, i in ids.items()}
        base = [bytes([b]) for b in range(256)]
        number = {t: k for k, t in enumerate(base)}
        self.tokens = list(base)
        n = 256 + len(merges)
        # of labels: parts and the step at which they became arcs; target state. Of states: parent, the label dropped, step of birth
        self.left, self.right = [-1] * 256, [-1] * 256
        self.born = [-1] * 256
        self.target = [0] * 256
        self.parent, self.dropped, self.since = [-1], [-1], [-1]
        self._has: dict[int, bool] = {}
        self._bits = max(1, n.bit_length())
        for step, (u, v) in enumerate(merges):
            a, b = number[u], number[v]
            w = u + v
            goes = self.target[b]
            if self._has_while_building(self.target[a], b):
                self.parent.append(self.target[a])
                self.dropped.append(b)
                self.since.append(step)
                self.target[a] = len(self.parent) - 1
                live = True
            else:  # the parts never meet: no path can use this label by this merge
                live = False
            if w in number:
                continue
            number[w] = len(self.tokens)
            self.tokens.append(w)
            self.left.append(a)
            self.right.append(b)
            self.born.append(step if live else _NEVER)
            self.target.append(goes)
        self._index()
        self.out = [ids[t] for t in self.tokens]
        # Byte trie over labels: node*256+byte -> node; the node's label, if any.
        self.step: dict[int, int] = {}
        self.label = [-1]
        for k, t in enumerate(self.tokens):
            node = 0
            for byte in t:
                key = node << 8 | byte
                nxt = self.step.get(key)
                if nxt is None:
                    nxt = self.step[key] = len(self.label)
                    self.label.append(-1)
                node = nxt
            self.label[node] = k
        self._words: dict[str, tuple[int, ...]] = {}

    def _has_while_building(self, state: int, label: int) -> bool:
        """As :meth:`has`, by walking up the states: for the few asks during compilation."""
        q, t = state, label
        while True:
            born = self.born[t]
            while q and self.since[q] > born:  # copies made after the label's birth inherit its arc unless they drop it
                if self.dropped[q] == t:
                    return False
                q = self.parent[q]
            if t < 256:
                return True
            if born == _NEVER:
                return False
            t = self.left[t]  # the state as it was then got the label where it had the left part

    def _index(self) -> None:
        """Numbers the states so that those below one are an interval; per label, the intervals that lack it (they are disjoint)."""
        n = len(self.parent)
        size = [1] * n
        for q in range(n - 1, 0, -1):
            size[self.parent[q]] += size[q]
        self.enter = [0] * n
        free = [1] * n  # next free number below each state
        for q in range(1, n):
            p = self.parent[q]
            self.enter[q] = self.enter[p] + free[p]
            free[p] += size[q]
        lacking: dict[int, list[tuple[int, int, int]]] = {}
        for q in range(1, n):
            lacking.setdefault(self.dropped[q], []).append((self.enter[q], self.enter[q] + size[q], self.since[q]))
        self.lack = {t: tuple(zip(*sorted(v))) for t, v in lacking.items()}

    def has(self, state: int, label: int) -> bool:
        """Whether ``state`` has an arc ``label``: no copy on its way from the first state dropped it, or dropped its left part before its birth."""
        key = state << self._bits | label
        known = self._has.get(key)
        if known is not None:
            return known
        at, t, before, answer = self.enter[state], label, _NEVER, True
        while True:
            if self.born[t] == _NEVER:
                answer = False
                break
            lack = self.lack.get(t)
            if lack:
                k = bisect_right(lack[0], at) - 1
                if k >= 0 and at < lack[1][k] and lack[2][k] <= before:
                    answer = False
                    break
            if t < 256:
                break
            before, t = self.born[t], self.left[t]
        if len(self._has) >= ARC_TABLE:
            self._has.clear()
        self._has[key] = answer
        return answer

    def word(self, data: bytes) -> list[int]:
        """The ids of one pre-split word."""
        n = len(data)
        came = [-1] * (n + 1)
        by = [-1] * (n + 1)
        step, label, target, has = self.step, self.label, self.target, self.has
        came[0] = 0
        for i in range(n):
            if came[i] < 0:
                continue
            state = target[by[i]] if i else 0
            node, j = 0, i
            while j < n:
                node = step.get(node << 8 | data[j], -1)
                if node < 0:
                    break
                j += 1
                t = label[node]
                if t >= 0 and came[j] < 0 and has(state, t):
                    came[j], by[j] = i, t
        if n and came[n] < 0:
            raise ValueError(f"the vocabulary has no path for {data[:80]!r}")
        ids, j = [], n
        while j:
            ids.append(self.out[by[j]])
            j = came[j]
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text``; null and empty text have none. Unpaired surrogates count as U+FFFD."""
        if not text:
            return []
        out: list[int] = []
        words = self._words
        for w in self._split(text):
            known = words.get(w)
            if known is None:
                data = w.encode("utf-8", "replace")
                known = tuple(self.word(data))
                if len(data) <= WORD_BYTES:
                    if len(words) >= WORD_TABLE:
                        words.clear()
                    words[w] = known
            out.extend(known)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text whose ids these are."""
        return b"".join(self.labels[i] for i in ids).decode("utf-8", "replace")


_compiled: dict[str, MergeAutomaton] = {}


def automaton(path: str = f"{TOKENIZER_DIR}/{TOKENIZER}") -> MergeAutomaton:
    """The automaton of the vocabulary file at ``path``, compiled once per process."""
    if path not in _compiled:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        sym = byte_symbols()
        raw = lambda s: bytes(sym[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = {raw(t): i for t, i in model["vocab"].items() if all(c in sym for c in t)}
        _compiled[path] = MergeAutomaton([(raw(a), raw(b)) for a, b in merges], ids)
    return _compiled[path]


def _encoder(path: str, column: str, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(path)
        for b in batches:
            at = b.schema.get_field_index(column)
            lists = [auto.encode(t) for t in b.column(at).to_pylist()]
            keep = [i for i in range(b.num_columns) if i != at]
            new = pa.array([len(x) for x in lists], pa.int64()) if counts else pa.array(lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), new], [*(b.schema.field(i).name for i in keep), "n_tokens" if counts else "ids"])

    return run


def encode(df: DataFrame, column: str = "text", path: str = f"{TOKENIZER_DIR}/{TOKENIZER}", counts: bool = False) -> DataFrame:
    """``df`` with ``column`` replaced by its token ``ids`` (or by ``n_tokens``, with ``counts``).

    Null and empty text give an empty list (0 tokens). Text that looks like a special token is plain text. All rows
    pass, in one narrow stage without a shuffle; other columns pass unchanged and must not be named ``ids`` or ``n_tokens``.
    """
    name = "n_tokens" if counts else "ids"
    rest = [f for f in df.schema.fields if f.name != column]
    if any(f.name == name for f in rest):
        raise ValueError(f"column {name} is there already")
    kind = T.LongType() if counts else T.ArrayType(T.IntegerType())
    return df.mapInArrow(_encoder(path, column, counts), T.StructType([*rest, T.StructField(name, kind)]))


def decode(df: DataFrame, column: str = "ids", path: str = f"{TOKENIZER_DIR}/{TOKENIZER}", out: str = "text") -> DataFrame:
    """``df`` with the text of its token ids in ``out``: arc labels in order. Null ids give null."""

    @F.pandas_udf("string")
    def text(ids):
        auto = automaton(path)
        return ids.map(lambda x: None if x is None else auto.decode([int(i) for i in x]))

    return df.withColumn(out, text(F.col(column)))
