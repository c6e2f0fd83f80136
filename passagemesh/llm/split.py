"""Items over a size limit, split at natural boundaries by recursive bisection (problem 3).

An item is cut at the strongest boundary near its middle (line break, sentence end, clause mark, blank, a
sentence mark inside a word), and each half that still exceeds the limit minus the overlap is cut likewise. A piece then
takes in up to the overlap of the text before it, from a word or sentence start where there is one.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemesh.llm.sentences import units

# The marks that, like white space, end a run that cannot be cut.
RUN_MARKS = ".!?。！？؟।…｡"
#: How far from the middle, as shares of a half, a boundary of each strength is looked for first; then anywhere.
NEAR = (0.25, 0.5, 0.75, 1.0)

_RUN = re.compile(rf"[^\s{re.escape(RUN_MARKS)}]+")


def longest_run(text: str) -> int:
    """Length of the longest run of characters that are neither white space nor a sentence mark."""
    return max((m.end() - m.start() for m in _RUN.finditer(text)), default=0)


def boundaries(text: str, sentence_starts: list[int]) -> list[list[int]]:
    """Cut positions by strength, strongest first; each position is the start of the right part."""
    lines = [m.end() for m in re.finditer(r"[\n\r  ]+\s*", text)]
    clauses = [m.end() for m in re.finditer(r"[,;:،؛、，；：](?:\s+|(?=[^\x00-\x7f]))", text)]
    blanks = [m.end() for m in re.finditer(r"\s+", text)]
    inside = [m.end() for m in re.finditer(rf"[{re.escape(RUN_MARKS)}]+", text)]
    return [sorted({p for p in x if 0 < p < len(text)}) for x in (lines, sentence_starts, clauses, blanks, inside)]


def _nearest(at: list[int], middle: float, lo: float, hi: float) -> int | None:
    i, j = bisect_left(at, lo), bisect_right(at, hi)
    if i >= j:
        return None
    k = bisect_left(at, middle, i, j)
    return min((at[x] for x in (k - 1, k) if i <= x < j), key=lambda p: (abs(p - middle), p))


def _hard(text: str, at: int) -> int:
    """``at``, moved left off combining marks and joiners so that no character is torn."""
    p = at
    while p > at - 32 and p > 1 and (unicodedata.combining(text[p]) or text[p] in "‍️" or text[p - 1] == "‍" or unicodedata.category(text[p]) in ("Mn", "Mc", "Me")):
        p -= 1
    return p if p > at - 32 and p > 1 else at


def cuts(text: str, limit: int, whole: int, marks: list[list[int]]) -> list[tuple[int, int]]:
    """Consecutive (start, end) of at most ``limit`` characters; up to ``whole`` where a part has no boundary inside."""
    done, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= limit:
            done.append((a, b))
            continue
        middle, half = (a + b) / 2, (b - a) / 2
        at = None
        for share in NEAR:
            for strength in marks:
                at = _nearest(strength, middle, max(a + 1, middle - share * half), min(b - 1, middle + share * half))
                if at is not None:
                    break
            if at is not None:
                break
        if at is None:
            if b - a <= whole:
                done.append((a, b))
                continue
            at = _hard(text, int(middle))
        todo += [(at, b), (a, at)]
    return done


def pieces(text: str, max_chars: int, overlap: int, declared: str | None = None) -> list[tuple[int, int, int]]:
    """(start, end, own start) of each piece: own start is where the text new to the piece begins."""
    if len(text) <= max_chars:
        return [(0, len(text), 0)]
    overlap = max(0, min(overlap, max_chars // 2))
    marks = boundaries(text, [s for s, _ in units(text, declared)])
    words = sorted(set().union(*map(set, marks[:4])))
    out = []
    for a, b in cuts(text, max_chars - overlap, max_chars, marks):
        start = a
        room = min(overlap, max_chars - (b - a), a)
        if room > 0:
            i = bisect_left(words, a - room)
            start = words[i] if i < len(words) and words[i] < a else _hard(text, a - room)
            start = max(start, a - room)
        out.append((start, b, a))
    return out


PIECE = "item_kind string, item_key string, cut_kind string, window_position int, start_char int, end_char int, overlap_chars int, text string, source_sentences array<int>"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PIECE.split(", ")]
    types = [pa.string()] * 3 + [pa.int32()] * 4 + [pa.string(), pa.list_(pa.int32())]
    for b in batches:
        for at in range(0, b.num_rows, 256):
            rows: list[tuple] = []
            for r in b.slice(at, 256).to_pylist():
                t, limit = r["text"], r["max_chars"]
                kind = "hard" if longest_run(t) > limit else "natural"
                own = units(t, r["lang"])
                ends = [e for _, e in own]
                listed = r["source_sentences"]
                for k, (s, e, a) in enumerate(pieces(t, limit, r["overlap_chars"] or 0, r["lang"])):
                    held = [i for i in range(bisect_right(ends, s), len(own)) if own[i][0] < e]
                    if listed is not None:  # a chunk's units take their numbers from its own list where that has one for each
                        held = [listed[i] for i in held] if len(listed) == len(own) else listed
                    rows.append((r["item_kind"], r["item_key"], kind, k, s, e, a - s, t[s:e], held))
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), ty) for c, ty in zip(cols, types)], names)


def items(articles: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Articles and chunks with text, each with its row of ``limits``; repeated rows of a key count once."""
    lang = F.lower(F.element_at(F.split("metadata.language", "[-_]"), 1))
    a = articles.select(F.lit("article").alias("item_kind"), F.col("url").alias("item_key"), F.col("cleaned_text").alias("text"), lang.alias("lang"), F.lit(None).cast("array<int>").alias("source_sentences"))
    c = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_key"), "text", F.lit(None).cast("string").alias("lang"), "source_sentences")
    every = a.unionByName(c).filter("item_key IS NOT NULL AND text IS NOT NULL")
    lim = limits.filter("max_chars > 0").groupBy("item_kind", "lang").agg(F.min(F.struct("max_chars", "overlap_chars")).alias("l"))
    own = lim.select("item_kind", "lang", F.col("l").alias("own"))
    default = lim.filter("lang = '*'").select("item_kind", F.col("l").alias("default"))
    return every.join(own, ["item_kind", "lang"], "left").join(default, "item_kind", "left").select("item_kind", "item_key", "text", "lang", "source_sentences", F.coalesce("own", "default").alias("l")).filter("l IS NOT NULL").select("item_kind", "item_key", "text", "lang", "source_sentences", "l.max_chars", "l.overlap_chars")


def oversized(articles: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of every item longer than its max_chars; see PIECE. A limit that is null or not positive is none."""
    big = items(articles, chunks, limits).filter(F.length("text") > F.col("max_chars"))
    once = big.groupBy("item_kind", "item_key", "text").agg(F.max("lang").alias("lang"), F.max("source_sentences").alias("source_sentences"), F.max("max_chars").alias("max_chars"), F.max("overlap_chars").alias("overlap_chars"))
    return once.mapInArrow(_split, PIECE)


def found(articles: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Distinct (item_kind, item_key, cut_kind) of the items that were split."""
    return oversized(articles, chunks, limits).filter("window_position = 0").select("item_kind", "item_key", "cut_kind").distinct()
