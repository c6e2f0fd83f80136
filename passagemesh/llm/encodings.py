"""Text decoded with a wrong character encoding: found by expectation-maximization, repaired by posterior (problem 10).

Every record has a latent encoding chain: none, or one that turned its original text, wholly or in
passages, into what is stored. A character bigram model counted over all records gives the probability of
a text; the evidence of a chain is the gain in log probability when the chain is undone, summed over the
segments where undoing it helps. Lossy chains (bytes dropped or replaced) cannot be undone; their evidence is
a fixed gain per trace they leave. EM then learns how often each source uses each chain, so that weak evidence
counts for more where other records of the source and field show the same chain, and gives each record the posterior
of its chains. A record is found when the posterior of no chain is below one half.
"""

from __future__ import annotations

import codecs
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemesh.runtime import materialize

#: Buckets of the hashed bigram and character counts: the model is of this size whatever the corpus.
PAIR_BITS, CHAR_BITS = 18, 16
#: Gain per trace of a lossy chain, in nats; segments must gain GAIN_LEAST in all and GAIN_PER_CHAR per changed character.
LOSS_GAIN, GAIN_LEAST, GAIN_PER_CHAR = 7.0, 3.0, 0.35
#: Added to a segment's gain: valid UTF-8 sequences seldom come by chance, other bytes are valid in most encodings.
BONUS_UTF8, BONUS_OTHER = 2.0, -2.0
#: EM: rounds, starting share of each chain, records' worth of weight of the shares over all sources.
ROUNDS, START, POOL = 4, 1e-3, 20.0

# Encodings that UTF-8 was read as; pairs (read as, really) of older encodings; both by codec name.
UTF8_AS = ("cp1252", "latin-1", "cp437", "cp850", "cp866", "cp1250", "cp1251", "cp1253", "cp1254", "cp1256", "cp1257", "cp874", "mac_roman", "koi8_r", "iso8859_2", "iso8859_15")
UTF8_AS_WIDE = ("gbk", "cp932", "big5", "cp949")
LEGACY = (
    ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp1253"), ("cp1252", "cp1256"), ("cp1252", "cp874"), ("cp1252", "gbk"),
    ("cp1252", "cp932"), ("cp1252", "euc_jp"), ("cp1252", "big5"), ("cp1252", "cp949"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"),
    ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1251", "cp1252"), ("cp1251", "iso8859_5"),
    ("mac_roman", "cp1252"), ("mac_roman", "cp1251"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1251"), ("cp1250", "cp1252"), ("cp1253", "cp1252"), ("cp1256", "cp1252"), ("gbk", "cp932"), ("cp932", "gbk"), ("gbk", "big5"), ("big5", "gbk"),
)

_UTF8_RUN = re.compile("(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_OPEN, _CLOSE = "«“„‘\"'`(", "»”“’\"'`)"
_SEGMENT = re.compile(r"[^\n]*?(?:[.!?。！？।](?=\s|[^\x00-\x7f])|\n|$)", re.S)
_WIDE = re.compile(r"[^\x00-\x7f]+")
#: The traces lossy chains leave.
_LOST = re.compile(r"(?<=\w)\ufffd|\ufffd(?=\w)|\ufffd\ufffd|(?<=[.,!?;:…])\ufffd|\ufffd(?=[.,!?;:])")
_NO_C1 = re.compile(r"[ÂÃ][\xa1-\xbf]|â(?=[¦¬¢\d\s.,;:!?”])|(?<=[.,!?¦\d])â|(?<=\s)â(?=[A-Z\d(])|(?<=[a-z])â(?=[st]\b)|[àáãäåæçèé][\xa1-\xbf]|[ÐÑÎÏØÙ][\xa1-\xbf]|[ãåæçèéà][ãåæçèéà][\xa1-\xbf]")
_ASKED = re.compile(r"(?<=[a-zß-ÿ])\?(?=[a-zß-ÿ])|(?<=[\s(])\?(?=\w)")
_LINK = re.compile(r"\S*(?:://|www\.|=)\S*")


@lru_cache(maxsize=None)
def _table(codec: str) -> dict[int, str | None]:
    """Character to byte (as a character) under ``codec``, with the C1 controls for the bytes it leaves free."""
    out: dict[int, str] = {}
    for b in range(0x80, 0x100):
        try:
            out[ord(bytes([b]).decode(codec))] = chr(b)
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):
        out.setdefault(b, chr(b))
    return out


@lru_cache(maxsize=None)
def _to_bytes(codec: str) -> dict[int, str]:
    """As :func:`_table`, with the other Latin-1 characters sent to U+0100, which is no byte."""
    return {o: "\u0100" for o in range(0x80, 0x100)} | _table(codec)


@lru_cache(maxsize=None)
def _direct(read: str, really: str) -> dict[int, str | None]:
    """Character to character where both encodings have one byte a character; U+FFFE where there is none."""
    out: dict[int, str | None] = {}
    for o, byte in _table(read).items():
        try:
            out[o] = byte.encode("latin-1").decode(really)
        except UnicodeDecodeError:
            out[o] = "\ufffe"
    return out


@lru_cache(maxsize=None)
def _both(read: str, really: str) -> frozenset[str]:
    """Characters of ``read`` whose byte ``really`` has too."""
    return frozenset(chr(o) for o, c in _direct(read, really).items() if c != "\ufffe")


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the word around text[start:end] is short and quotation marks or brackets enclose it: a mention, not a passage."""
    while start > 0 and end - start <= 9 and not text[start - 1].isspace() and text[start - 1] not in _OPEN:
        start -= 1
    while end < len(text) and end - start <= 9 and not text[end].isspace() and text[end] not in _CLOSE:
        end += 1
    return end - start <= 8 and start > 0 and end < len(text) and text[start - 1] in _OPEN and text[end] in _CLOSE


def _undo_utf8(text: str, codec: str) -> str:
    mapped = text.translate(_to_bytes(codec))
    parts, last = [], 0
    for m in _UTF8_RUN.finditer(mapped):
        if quoted(text, m.start(), m.end()):
            continue
        try:
            real = m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        parts += [text[last : m.start()], real]
        last = m.end()
    return text if not parts else "".join([*parts, text[last:]])


def _undo_wide(text: str, codec: str) -> str:
    """Runs beyond ASCII that are, but for lost characters, UTF-8 read as a two-byte encoding."""
    parts, last = [], 0
    for m in _WIDE.finditer(text):
        run = m.group()
        if len(run) < 4:
            continue
        data = run.encode(codec, "lost")
        real = data.decode("utf-8", "replace")
        if real.count("\ufffd") * 3 > len(real) or len(real) > 0.85 * len(run):
            continue  # three bytes made 1.5 characters, so the real run is shorter
        parts += [text[last : m.start()], real]
        last = m.end()
    return text if not parts else "".join([*parts, text[last:]])


codecs.register_error("lost", lambda e: (b"\xff" * (e.end - e.start), e.end))
#: Encodings of Latin letters, in which a passage is mostly ASCII; passages of the others are mostly not.
_LATIN = {"cp1252", "cp437", "cp850", "mac_roman"}
_WIDE_CODECS = {"gbk", "cp932", "euc_jp", "big5", "cp949"}


def _undo_legacy(text: str, read: str, really: str) -> str:
    beyond = sum(map(len, _WIDE.findall(text)))
    if really not in _LATIN and beyond * 3 < len(text):
        return text
    if read in _WIDE_CODECS:
        return text.encode(read).decode(really)
    if really in _WIDE_CODECS:
        return text.translate(_to_bytes(read)).encode("latin-1").decode(really)
    # characters the first encoding lacks, or bytes the second lacks: this passage isn't of the chain
    if not frozenset("".join(_WIDE.findall(text))) <= _both(read, really):
        return text
    return text.translate(_direct(read, really))


@dataclass(frozen=True)
class Chain:
    """A way of damage: ``kind`` and the encodings it goes through."""

    kind: str
    read: str
    really: str = "utf-8"
    times: int = 1

    @property
    def name(self) -> str:
        return f"{self.really}>{self.read}" + (f"x{self.times}" if self.times > 1 else "")

    def undo(self, text: str) -> str | None:
        """The text with the chain undone where it applies; None where nothing changes or it cannot be."""
        try:
            real = text
            for _ in range(self.times):
                before = real
                real = _undo_utf8(real, self.read) if self.kind == "utf8" else _undo_wide(real, self.read) if self.kind == "wide" else _undo_legacy(real, self.read, self.really)
                if real == before:
                    return None
        except (UnicodeError, LookupError):
            return None
        return real if real != text else None


def chains() -> list[Chain]:
    """All chains that can be undone, simple ones first."""
    out = [Chain("utf8", c) for c in UTF8_AS]
    out += [Chain("utf8", c, times=2) for c in ("cp1252", "latin-1", "mac_roman", "cp437")]
    out += [Chain("wide", c) for c in UTF8_AS_WIDE]
    return out + [Chain("legacy", a, b) for a, b in LEGACY]


def losses(text: str) -> dict[str, int]:
    """Traces of the lossy chains in ``text``: replaced characters, dropped C1 controls, question marks for letters."""
    found = {"replaced": len(_LOST.findall(text)) if "\ufffd" in text else 0, "dropped": 0, "asked": 0}
    if not text.isascii():
        found["dropped"] = sum(not quoted(text, m.start(), m.end()) for m in _NO_C1.finditer(text))
    asked = len(_ASKED.findall(_LINK.sub(" ", text))) if text.count("?") > 1 else 0
    found["asked"] = asked if asked > 1 else 0
    return {k: v for k, v in found.items() if v}


# --- the bigram model -----------------------------------------------------------------------------------------------

def _points(text: str) -> np.ndarray:
    return np.frombuffer(("\n" + text).encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)


def _pairs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed (first, second) and first characters. Digits count as one, like letters that only names repeat."""
    p = np.where((points >= 48) & (points <= 57), 48, points)
    a, b = p[:-1], p[1:]
    pair = ((a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x165667B19E3779F9)) >> np.uint64(64 - PAIR_BITS)
    return pair.astype(np.int64), ((a * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((1 << PAIR_BITS) + (1 << CHAR_BITS), dtype=np.int64)
    for b in batches:
        texts = [t for t in b.column(0).to_pylist() if t]
        for at in range(0, len(texts), 500):
            pair, first = _pairs(_points("\n".join(texts[at : at + 500])))
            if len(pair):
                both += np.bincount(np.concatenate([pair, first + (1 << PAIR_BITS)]), minlength=len(both))
    at = np.flatnonzero(both)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[at])], ["bucket", "n"])


class BigramModel:
    """Log probability of a character after another, from hashed counts over the whole corpus."""

    def __init__(self, counts: np.ndarray) -> None:
        self.pair = np.log(counts[: 1 << PAIR_BITS] + 0.02).astype(np.float32)
        self.char = np.log(counts[1 << PAIR_BITS :] + 0.02 * 3000).astype(np.float32)

    def score(self, text: str) -> float:
        pair, first = _pairs(_points(text))
        return float((self.pair[pair] - self.char[first]).sum())

    def scores(self, texts: list[str]) -> np.ndarray:
        """The score of each text."""
        if not texts:
            return np.zeros(0)
        pair, first = _pairs(_points("\n".join(texts)))
        upto = np.concatenate([[0.0], np.cumsum(self.pair[pair] - self.char[first], dtype=np.float64)])
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        return upto[start + size] - upto[start]


def bigram_model(texts: DataFrame) -> BigramModel:
    """Counts the bigrams of the one column of ``texts``, all rows; at most 2**18 + 2**16 counts reach the driver."""
    rows = texts.mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((1 << PAIR_BITS) + (1 << CHAR_BITS))
    counts[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
    return BigramModel(counts)


# --- evidence, EM, repair -------------------------------------------------------------------------------------------

def segments(text: str) -> list[str]:
    """Sentence-like pieces whose concatenation is ``text``."""
    out, at = [], 0
    while at < len(text):
        m = _SEGMENT.match(text, at)
        end = m.end() if m and m.end() > at else len(text)
        out.append(text[at:end])
        at = end
    return out


@lru_cache(maxsize=None)
def _leads(codec: str) -> frozenset[str]:
    return frozenset(chr(o) for o, b in _table(codec).items() if "\xc2" <= b <= "\xf4")


@lru_cache(maxsize=None)
def _known(codec: str) -> frozenset[str]:
    return frozenset(map(chr, _table(codec)))


def _possible(segment: str, ways: list[Chain]) -> list[Chain]:
    """The chains that the characters of ``segment`` don't rule out."""
    runs = _WIDE.findall(segment)
    chars = set("".join(runs))
    adjacent = max(map(len, runs)) > 1
    dense = sum(map(len, runs)) * 3 >= len(segment)
    out = []
    for w in ways:
        if w.kind == "utf8":
            ok = adjacent and not chars.isdisjoint(_leads(w.read))
        elif w.kind == "wide":
            ok = dense and "\ufffd" in chars or dense and max(chars) >= "\u3000"
        else:
            ok = dense != (w.really in _LATIN) and (w.read in _WIDE_CODECS or chars <= (_known(w.read) if w.really in _WIDE_CODECS else _both(w.read, w.really)))
        if ok:
            out.append(w)
    return out


def evidence_of(texts: list[str | None], model: BigramModel, ways: list[Chain]) -> list[dict[str, float]]:
    """The gain of each chain on each text, for chains with any. All candidates are scored in one pass over their characters."""
    tried: list[tuple[int, Chain, int, int]] = []  # text, chain, place of the segment and of the undone one among the scored
    scored: list[str] = []
    for n, text in enumerate(texts):
        if not text or text.isascii():
            continue
        for s in segments(text):
            if s.isascii():
                continue
            base = -1
            for w in _possible(s, ways):
                real = w.undo(s)
                if real is None:
                    continue
                if base < 0:
                    base = len(scored)
                    scored.append(s)
                tried.append((n, w, base, len(scored)))
                scored.append(real)
    score = model.scores(scored)
    changed: dict[int, int] = {}
    gains: list[dict[str, float]] = [{} for _ in texts]
    for n, w, base, real in tried:
        g = float(score[real] - score[base]) + (BONUS_UTF8 if w.kind == "utf8" else BONUS_OTHER)
        if g < GAIN_LEAST:
            continue
        if w.kind != "utf8":
            if base not in changed:
                changed[base] = sum(map(len, _WIDE.findall(scored[base])))
            if g < GAIN_PER_CHAR * changed[base]:
                continue
        gains[n][w.name] = gains[n].get(w.name, 0.0) + g
    for gain, text in zip(gains, texts):
        for k, c in losses(text).items() if text else ():
            gain[k] = gain.get(k, 0.0) + LOSS_GAIN * c
    return gains


def evidence(text: str, model: BigramModel, ways: list[Chain]) -> dict[str, float]:
    """The gain of each chain on ``text``, for chains with any."""
    return evidence_of([text], model, ways)[0]


def _evidence_rows(key: str, model: BigramModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = chains()
        for b in batches:
            keys, fields, names, gains, tops = [], [], [], [], []
            texts = b.column("text").to_pylist()
            evidences = [g for at in range(0, len(texts), 250) for g in evidence_of(texts[at : at + 250], model, ways)]
            for k, s, g in zip(b.column(key).to_pylist(), b.column("source").to_pylist(), evidences):
                best = sorted(g.items(), key=lambda x: -x[1])
                for name, g in best:
                    keys.append(k)
                    fields.append(s)
                    names.append(name)
                    gains.append(g)
                    tops.append(best[0][1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(key).type), pa.array(fields, pa.string()), pa.array(names, pa.string()), pa.array(gains, pa.float64()), pa.array(tops, pa.float64())], [key, "source", "chain", "gain", "top"])

    return run


def posteriors(documents: DataFrame, key: str = "doc_id", model: BigramModel | None = None) -> DataFrame:
    """(key, chain, gain, share, p): posterior of each chain that has evidence in a record, and its share in the source; the rest of 1 is that of no chain.

    ``documents`` needs ``key``, ``source`` and ``text``; null, empty and blank texts have no evidence. Null sources
    are pooled as one source. Repeated rows of a key count once each in the shares and give equal rows.
    """
    texts = documents.select(key, F.coalesce("source", F.lit("")).alias("source"), "text")
    model = model or bigram_model(texts.select("text"))
    kind = dict(texts.dtypes)[key]
    ev = materialize(texts.mapInArrow(_evidence_rows(key, model), f"{key} {kind}, source string, chain string, gain double, top double"), "evidence")
    sizes = texts.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = F.lit(START)
    shares = None
    for _ in range(ROUNDS):
        joined = ev.withColumn("share", F.lit(START)) if shares is None else ev.join(shares, ["source", "chain"], "left").withColumn("share", F.coalesce("share", total))
        post = _posterior(joined, key)
        weight = post.groupBy("source", "chain").agg(F.sum("p").alias("w"))
        overall = weight.groupBy("chain").agg((F.sum("w")).alias("all"))
        corpus = sizes.agg(F.sum("n").alias("rows"))
        shares = (
            weight.join(sizes, "source")
            .join(overall, "chain")
            .join(F.broadcast(corpus))  # one row
            .select("source", "chain", ((F.col("w") + F.lit(POOL) * F.col("all") / F.col("rows") + START) / (F.col("n") + POOL)).alias("share"))
        )
        shares = materialize(shares, "shares")
    return _posterior(ev.join(shares, ["source", "chain"], "left").withColumn("share", F.coalesce("share", total)), key)


def _posterior(scored: DataFrame, key: str) -> DataFrame:
    """Adds p; a record has at most a row per chain, so its group is small."""
    # all odds are relative to the record's top gain, so that large gains neither overflow nor tie
    per = scored.withColumn("odds", F.exp(F.col("gain") - F.col("top")) * F.col("share"))
    sums = per.groupBy(key).agg(F.sum("odds").alias("sum"))
    none = F.exp(-F.least(F.col("top"), F.lit(700.0)))
    return per.join(sums, key).withColumn("p", F.col("odds") / (F.col("sum") + none)).drop("odds", "sum", "top")


def found(documents: DataFrame, key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """Distinct keys of records whose text was wholly or partly decoded wrongly."""
    return posteriors(documents, key).groupBy(key).agg(F.sum("p").alias("p")).filter(F.col("p") > threshold).select(key)


def restored(text: str, chain: str, p: float, shares: dict[str, float], model: BigramModel, ways: dict[str, Chain]) -> tuple[str, bool]:
    """``text`` with each segment's likeliest chain undone, and whether nothing is lost and no segment still has evidence.

    The prior of the record's ``chain`` in a segment is ``p``, its posterior among those that can be undone; of the others with evidence their ``shares`` in the source, START at least.
    """
    parts = []
    for s in segments(text):
        base, most, real = None, 0.0, s
        for name in [] if s.isascii() else [chain, *sorted(shares.keys() - {chain})]:
            got = ways[name].undo(s) if name in ways else None
            if got is None:
                continue
            base = model.score(s) if base is None else base
            gain = model.score(got) - base
            gain += math.log(p) if name == chain else math.log(max(shares[name], START)) + (BONUS_UTF8 if ways[name].kind == "utf8" else BONUS_OTHER)
            if gain > most:
                most, real = gain, got
        parts.append(real)
    whole = "".join(parts)
    left = any(g + math.log(max(shares.get(k, START), START)) > 0 for s in segments(whole) for k, g in evidence(s, model, [*ways.values()]).items())
    return whole, "\ufffd" not in whole and not left


def _repair(model: BigramModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways = {w.name: w for w in chains()}
        for b in batches:
            texts, sure = [], []
            for t, c, p, every in zip(*(b.column(n).to_pylist() for n in ("text", "chain", "chain_p", "every"))):
                whole, ok = restored(t, c, p, {x["chain"]: x["share"] for x in every}, model, ways)
                texts.append(whole)
                sure.append(ok and c in ways)
            cols = [b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array(sure, pa.bool_())], [*b.schema.names, "restored", "whole"])

    return run


def repaired(documents: DataFrame, key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(key, chain, p, restored, whole) of each found record: the likeliest chain of each segment undone, the record's in ``chain``; ``whole`` is false where characters were lost or a segment still has evidence."""
    model = bigram_model(documents.select("text"))
    post = posteriors(documents, key, model)
    undone = F.col("chain").contains(">") & (F.col("gain") + F.log("share") > 0)  # else weak evidence would hide a lossy chain
    top = F.max_by(F.struct("chain", "p"), F.struct(undone, "p", "chain")).alias("top")
    undoable = F.sum(F.when(F.col("chain").contains(">"), F.col("p")))
    best = post.groupBy(key).agg(F.sum("p").alias("p"), top, undoable.alias("undoable"), F.collect_set(F.struct("chain", "share")).alias("every")).filter(F.col("p") > threshold)
    best = best.select(key, F.col("top.chain").alias("chain"), "p", (F.greatest("top.p", F.lit(1e-300)) / F.greatest("top.p", "undoable", F.lit(1e-300))).alias("chain_p"), "every")
    rows = documents.select(key, "text").dropDuplicates([key]).join(best, key)
    kind = dict(documents.dtypes)[key]
    out = rows.select(key, "chain", "p", "text", "chain_p", "every").mapInArrow(_repair(model), f"{key} {kind}, chain string, p double, text string, chain_p double, every array<struct<chain:string,share:double>>, restored string, whole boolean")
    return out.drop("text", "chain_p", "every")
