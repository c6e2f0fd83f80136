"""Sentence units of texts in any language, by cascading tables of break and no-break rules (problem 2).

A rule is a pair of patterns for the text before and after a position, and says break or no break. A position's
candidates come from its line's script; the tables of the line's language are asked in cascade (language, family,
common), and the first rule whose two patterns match decides. Positions inside paired quotation marks or
brackets are no candidates; a line break always ends a unit. In scripts that end sentences by no mark, blanks are the candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations after which a sentence goes on, and those that may end one before a capital, by language.
INNER = {
    "en": "Dr Prof Mr Mrs Ms St Mt Gen Col Capt Lt Sgt Rev Hon Sen Rep Gov Pres e.g i.e cf vs viz approx vol vols p pp fig figs ch sec ed eds no nos al U.N ca est Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec",
    "de": "Dr Prof Fr Hr Hrn Fa z.B z d.h d u u.a v ca bzw bspw vgl Abs Art Nr Bd Mio Mrd S St usf evtl ggf inkl Jan Feb Apr Aug Sept Okt Nov Dez B h",
    "fr": "M MM Mme Mlle Dr Pr St Ste env cf p pp art no vol fig éd chap av apr J.O janv févr avr juil sept oct nov déc",
    "es": "Sr Sra Srta Dr Dra D Dña Prof aprox art núm pág págs p p.ej ej EE UU cf vol cap fig Ud Uds c",
    "ru": "г гг т т.е т.к т.п им проф акад др см рис стр с гл ок ул д тыс млн млрд руб напр ср св доц н.э",
    "el": "κ κα κος Δρ περ εκατ π.χ σελ βλ αρ κεφ χλμ δισ",
    "ar": "د ص أ م ج ط هـ",
    "hi": "डॉ श्री रु पृ कि.मी कि मी प्रो सं ई.पू",
}
MAY_END = {"en": "Inc Ltd Co Corp etc a.m p.m Jr Sr Bros", "de": "Co usw etc", "fr": "etc", "es": "etc", "ru": "т.д т.п др руб г гг", "el": "κ.λπ κλπ", "ar": "", "hi": ""}
MONTHS = {
    "en": "Jan Feb Mar Apr May Jun Jul Aug Sep Sept Oct Nov Dec",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jahrhundert",
}
STOPWORDS = {
    "en": "the of and was is for in to with by at a",
    "de": "der die das und ist wurde zum nach in über mit den",
    "fr": "le la les et est de des du pour depuis que en",
    "es": "el la los y es de del en que por según desde",
}

_PAIRS = {"“": "”", "„": "“", "«": "»", "(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", '"': '"'}
#: The openings a mark closes.
_CLOSED_BY = {c: [o for o, k in _PAIRS.items() if k == c] for c in _PAIRS.values()}
_CLOSERS = "”“»\"')\\]）」』》〉】’"
_LINE = re.compile(r"[^\n\r  \x0b\x0c\x85]+")
_REFERENCE = r"(?:\[\d+\])*"

_UP = "A-ZÀ-ÖØ-ÞŠŽŒА-ЯЁΑ-ΩΆΈΉΊΌΎΏ"
_LOW = "a-zß-öø-ÿšžœа-яёα-ωάέήίόύώϊϋΐΰς"
_OPEN = "“„«\"(\\[¿¡‘"


def _words(listed: str) -> str:
    """One pattern for a list of abbreviations, longest first, blanks allowed after inner points."""
    return "|".join(re.escape(w).replace(r"\.", r"\.\s?") for w in sorted(listed.split(), key=len, reverse=True)) or r"(?!)"


def _abbreviations(lang: str) -> list[tuple[bool, str, str]]:
    inner, end = _words(INNER[lang]), _words(MAY_END[lang])
    left = rf"(?<![^\W\d_])(?:{inner})\."
    months = _words(MONTHS.get(lang, ""))
    return [
        (False, rf"(?<![^\W\d_])(?:{end})\.", rf"\s+(?:{months})\b"),
        (True, rf"(?<![^\W\d_])(?:{end})\.", rf"\s*[{_OPEN}]?[{_UP}]" if lang != "ru" else rf"\s+[{_OPEN}]?[{_UP}]"),
        (False, rf"(?<![^\W\d_])(?:{end})\.", r"(?!\s*$)"),
        (False, left, r"(?!\s*$)"),
    ]


#: The tables, each a list of (break?, pattern before, pattern after) in order.
TABLES: dict[str, list[tuple[bool, str, str]]] = {
    "common": [
        (True, r".", r"\s*$"),
        (False, r".", r"\s*[,;:،、，；：\-–—!?？！]"),
        (False, rf"[{_CLOSERS}]", r"\s*\.(?!\w)"),
    ],
    "cased": [
        # initials and letters of a shortened name
        (False, rf"(?<![^\W_])[{_UP}]\.", rf"\s*[{_UP}]"),
        (False, rf"(?:[{_UP}]\.)+", rf"\s+[{_LOW}]"),
        # after a closing mark, a small letter goes on with the sentence around the quotation
        (True, rf"[.!?…](?:\s?[{_CLOSERS}])+(?:\[\d+\])*", rf"\s*[{_OPEN}]*[{_UP}\d]"),
        (True, r"[.!?…]\)(?:\[\d+\])*", r"\s+[a-z]+-"),
        (True, rf"[.!?…](?:\s?[{_CLOSERS}])+(?:\[\d+\])*", rf"\s+[{_OPEN}]"),
        (False, rf"[.!?…;](?:\s?[{_CLOSERS}])+(?:\[\d+\])*", r""),
        (True, r"…|\.\.\.?", rf"\s+[{_OPEN}]*[{_UP}\d]"),
        (False, r"…|\.\.\.?", r""),
        (True, rf"[!?](?:\[\d+\])*", rf"\s|[{_UP}{_OPEN}\d]"),
        (False, r"\d\.", r"\d"),
        (True, rf"(?:[{_LOW}]{{2}}|[\d%°{_UP}]|[)\]”»“])\.(?:\[\d+\])*", rf"\s*[{_OPEN}]*[{_UP}]"),
        (True, r"\.(?:\[\d+\])*", rf"\s+[{_OPEN}]*[{_UP}\d]|\s+[{_OPEN}]"),
        (True, rf"(?<![.\w])[{_LOW}]{{4,}}\.(?:\[\d+\])*|\d\.(?:\[\d+\])+", rf"\s+[{_LOW}]"),
        (False, r".", r""),
    ],
    "de": [
        (False, rf"\b(?:[Aa]m|[Vv]om|[Dd]e[rmns]|[Dd]ie|[Dd]as|[Zz]um|[Ii]m|[Bb]eim|seit|bis)\s\d{{1,2}}\.", r"\s"),
        (False, r"\b\d{1,2}\.", rf"\s(?:{_words(MONTHS['de'])})\b"),
    ],
    "el": [(True, r"[Ͱ-Ͽἀ-῿];", rf"\s*[{_OPEN}]*[{_UP}]|\s+[{_OPEN}\d]")],
    "arabic": [
        (False, rf"[.!?؟…](?:\s?[{_CLOSERS}])+", r""),
        (False, r"\d\.", r"\d"),
        (True, r"[!?؟۔](?:\[\d+\])*", r""),
        (True, r"\.(?:\[\d+\])*", r"\s|[«“\"(]|[ء-ي]"),
        (False, r".", r""),
    ],
    "hi": [
        (True, r"[।॥](?:\[\d+\])*", r""),
        (True, rf"[।॥](?:\s?[{_CLOSERS}])+", r"\s*[“\"(]"),
        (False, rf"[!?।](?:\s?[{_CLOSERS}])+", r""),
        (True, r"[!?](?:\[\d+\])*", r""),
        (False, r".", r""),
    ],
    "ja": [
        (False, rf"[。！？!?｡](?:\s?[{_CLOSERS}])+", r"\s*(?:と|は|が|を|に|の|で|も|へ|や|って|という|[、，])"),
        (True, rf"[。｡](?:[{_CLOSERS}]|\[\d+\])*", r""),
        (True, r"[！？!?](?:\[\d+\])*", r""),
        (True, rf"[！？!?](?:\s?[{_CLOSERS}])+", r"\s*[「『（\d]"),
        (False, r".", r""),
    ],
    "zh": [
        (True, rf"[。｡](?:[{_CLOSERS}]|\[\d+\])*", r""),
        (True, r"[！？!?](?:\[\d+\])*", r""),
        (True, rf"[！？!?](?:\s?[{_CLOSERS}])+", r"\s*[“「『《（\d]"),
        (False, r".", r""),
    ],
}
for _l in INNER:
    TABLES.setdefault(_l, [])
    TABLES[_l] = [*_abbreviations(_l), *TABLES[_l]] if _l != "hi" else TABLES[_l]

#: Which tables a language asks, in order.
CASCADES = {
    "th": ("common", "cased"),
    **{lang: (lang, "common", "cased") for lang in ("de", "fr", "es", "ru", "el")},
    "en": ("en", "common", "cased"),
    "latin": ("common", "en", "de", "fr", "es", "cased"),
    "ar": ("common", "ar", "arabic"),
    "hi": ("common", "hi"),
    "ja": ("common", "ja"),
    "zh": ("common", "zh"),
}
#: Characters before a mark that a pattern sees: more than the longest abbreviation has.
LOOK_BACK = 60
_MARKS = re.compile(r"\.{2,}|[.!?…؟।॥۔;。！？｡]+")
_REFERENCES = re.compile(_REFERENCE)
_BESIDE = set("\"“”„'‘’«»「」『』《》")
_LATIN = {"en", "de", "fr", "es", "latin"}


@lru_cache(maxsize=None)
def _rules(language: str) -> tuple[tuple[bool, re.Pattern, re.Pattern], ...]:
    return tuple((b, re.compile(rf"(?:{before})\Z"), re.compile(after)) for t in CASCADES[language] for b, before, after in TABLES[t])


_SCRIPTS = (("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[㐀-鿿]")), ("th", re.compile("[฀-๿]")), ("hi", re.compile("[ऀ-ॿ]")), ("ar", re.compile("[؀-ۿ]")), ("el", re.compile("[Ͱ-Ͽ]")), ("ru", re.compile("[Ѐ-ӿ]")), ("latin", re.compile(r"(?<!\S)(?=\S*[A-Za-zÀ-ÿ])[ -ɏ‐-⁯]{1,30}(?!\S)")))


def script(text: str) -> str:
    """The language that most of a text's script names: letters count, but words of Latin letters, so that long codes and
    single names in another text do not outweigh it. 'latin' for Latin letters; kana make Japanese of Han."""
    n = {k: len(p.findall(text)) for k, p in _SCRIPTS}
    if n["ja"] * 10 > n["zh"]:
        n["ja"] += n.pop("zh")
    return max(n, key=lambda k: n[k])


def language(text: str, declared: str | None) -> str:
    """The language of a text: by its script, and for Latin letters as declared, else by its commonest function words."""
    by_script = script(text)
    if by_script != "latin":
        return by_script
    first = re.split(r"[-_]", declared.lower())[0] if declared else ""
    if first in STOPWORDS:
        return first
    words = re.findall(r"[^\W\d_]+", text.lower())
    hits = {k: sum(w in v for w in words) for k, v in ((k, set(s.split())) for k, s in STOPWORDS.items())}
    best = max(hits, key=lambda k: hits[k])
    return best if hits[best] else "latin"


def enclosed(line: str) -> list[tuple[int, int]]:
    """(opening, closing) positions of the outermost paired marks of a line; a mark without its pair is none. One pass, with a stack per kind of pair."""
    pair: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    for k, c in enumerate(line):
        for opening in _CLOSED_BY.get(c, ()):
            if waiting.get(opening):
                pair[waiting[opening].pop()] = k
        if c in _PAIRS:
            waiting.setdefault(c, []).append(k)
    out, at = [], 0
    for k in sorted(pair):
        if k >= at:
            out.append((k, pair[k]))
            at = pair[k] + 1
    return out


def _ends(line: str, lang: str, by_blank: bool) -> list[int]:
    """Positions after which a unit of the line ends, its own end aside."""
    spans = enclosed(line)
    closing = {b for _, b in spans}
    ends, inside = [], 0

    def within(pos: int) -> bool:
        nonlocal inside
        while inside < len(spans) and spans[inside][1] < pos:
            inside += 1
        return inside < len(spans) and spans[inside][0] < pos <= spans[inside][1]

    if by_blank:
        for m in re.finditer(r"\s+", line):
            a, b = line[m.start() - 1 : m.start()], line[m.end() : m.end() + 1]
            if a and b and not within(m.start()) and not any(c.isdigit() or c in _BESIDE or "a" <= c.lower() <= "z" for c in (a, b)):
                ends.append(m.start())
        return ends
    rules = _rules(lang)
    for m in _MARKS.finditer(line):
        pos = m.end()
        while True:  # closing marks of pairs, and unpaired ones that cannot open, belong to the sentence
            k = pos + (line[pos : pos + 1] == " ")
            if k < len(line) and (k in closing or k == pos and line[k] in "”»’)）」』》"):
                pos = k + 1
            else:
                break
        pos = _REFERENCES.match(line, pos).end()
        if within(pos):
            continue
        for brk, before, after in rules:
            if after.match(line, pos) and before.search(line, max(0, m.start() - LOOK_BACK), pos):
                if brk:
                    ends.append(pos)
                break
    return ends


def _unmarked(text: str, lang: str) -> bool:
    """Whether a text of a script without blanks between words ends its sentences by no mark."""
    if lang == "th":
        return True
    if lang not in ("zh", "ja"):
        return False
    for m in _LINE.finditer(text):
        spans = enclosed(m.group())
        if any(not any(a < x.start() < b for a, b in spans) for x in re.finditer(r"[。！？｡!?]", m.group())):
            return False
    return True


def units(text: str | None, declared: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence unit, without blanks around; null, empty and blank texts have none."""
    if not text:
        return []
    lang = language(text, declared)
    unmarked = _unmarked(text, lang)
    out = []
    for m in _LINE.finditer(text):
        line = m.group()
        own = lang
        if not line.isascii():
            s = script(line)
            own = s if s != "latin" else lang if lang in _LATIN else "latin"
        elif lang not in _LATIN and re.search("[A-Za-z]", line):
            own = language(line, declared)
        at = 0
        for end in [*_ends(line, own, own == "th" or own == lang and unmarked), len(line)]:
            piece = line[at:end]
            left = len(piece) - len(piece.lstrip())
            if left < len(piece):
                start = m.start() + at + left
                out.append((start, start + len(piece.strip())))
            at = end
    return out


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, starts, ends = [], [], []
        for k, t, d in zip(*(b.column(c).to_pylist() for c in ("url", "text", "lang"))):
            for s, e in units(t, d):
                keys.append(k)
                starts.append(s)
                ends.append(e)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["url", "start_char", "end_char"])


def found(articles: DataFrame) -> DataFrame:
    """Distinct (url, start_char, end_char): sentence units of cleaned_text. An article scraped twice counts once; rows with a null url are left out."""
    texts = articles.select("url", F.col("cleaned_text").alias("text"), F.col("metadata.language").alias("lang"))
    once = texts.filter("url IS NOT NULL AND text IS NOT NULL").groupBy("url", "text").agg(F.max("lang").alias("lang"))
    return once.mapInArrow(_segmented, "url string, start_char int, end_char int").distinct()
