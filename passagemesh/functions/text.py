"""Text columns: cleaning, sentence validity, scores of length and overlap. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sections that end an article's body; notes that stand in brackets.
TAILS = ("See also", "References", "External links", "Further reading", "Notes", "Bibliography", "Sources")
NOTES = ("citation needed", "clarification needed", "when\\?", "who\\?", "according to whom\\?")
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "how", "what", "why", "when", "where")
#: White space as both Java and RE2 know it without flags; the whole of Unicode's.
WS = "[ \\t\\n\\r\\f]"
BLANK = "[\\t-\\r\\x1c-\\x1f\\x{85}\\p{Z}]"


def clean_text(text: Column) -> Column:
    """Body text: tail sections, headings, reference marks and tables removed, dashes and escapes unified, blanks collapsed. Null gives null."""
    out = text
    for t in TAILS:
        out = F.regexp_replace(out, f"(?is)==+{WS}*{t}{WS}*==+.*", "")
    for _ in range(2):
        out = F.regexp_replace(out, f"={{2,}}{WS}*[^=\\n]+?{WS}*={{2,}}", "")
    # what is left of headings: on a line of their own, at the start of a line, at its end
    out = F.regexp_replace(out, f"\\n{BLANK}*=+[^=\\n]*=+{BLANK}*\\n", "\n")
    out = F.regexp_replace(out, f"(?:^|(?<=\\n))=+[^=\\n]*=+{BLANK}*", "")
    out = F.regexp_replace(out, f"{BLANK}*=+[^=\\n]*=+(?=\\n|\\z)", "")
    out = F.regexp_replace(out, "\\[[0-9 ,\\-]+\\]", "")
    for n in NOTES:
        out = F.regexp_replace(out, f"(?i)\\[{n}\\]", "")
    out = F.regexp_replace(out, "(?s)\\{\\|.*?\\|\\}", "")
    for a, b in (("–", "-"), ("—", "-"), ("…", "..."), ('\\"', '"'), ("\\'", "'"), ("\\n", " "), ("\\t", " ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, f"{BLANK}+", " "))


def valid_sentence(s: Column) -> Column:
    """Of 10 to 500 characters, not all digits and marks, at most 30 % symbols, no short shout, a Latin letter, at most two opening brackets of a kind."""
    n = F.length(s)
    symbols = n - F.length(F.regexp_replace(s, "[^\\p{L}\\p{N}_ \\t\\n\\r\\f]", ""))
    opened = lambda c: n - F.length(F.replace(s, F.lit(c), F.lit("")))
    return (
        n.between(10, 500)
        & ~s.rlike("^[0-9 .,;:!?-]+$")
        & (symbols / n <= 0.3)
        & ~((s == F.upper(s)) & (s != F.lower(s)) & (n < 50))
        & s.rlike("[a-zA-Z]")
        & (opened("(") <= 2)
        & (opened("[") <= 2)
    )


def words(text: Column) -> Column:
    """Lower-case words of Unicode letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


def length_score(text: Column) -> Column:
    """1 for 15 to 50 words, less in proportion below, 50/n but at least 0.3 above."""
    n = F.size(F.filter(F.split(F.trim(text), f"{WS}+"), lambda w: w != ""))
    return F.when(n < 15, n / 15.0).when(n > 50, F.greatest(F.lit(0.3), 50.0 / n)).otherwise(F.lit(1.0))


def overlap_score(text: Column, query: Column) -> Column:
    """Share of the query's words, stop words aside, that the text has."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    q = F.array_except(F.array_distinct(words(query)), stop)
    t = F.array_distinct(words(text))
    return F.least(F.lit(1.0), F.size(F.array_intersect(q, t)) / F.greatest(F.lit(1), F.size(q)))


#: A capitalised phrase: between characters that are no word's, in any script.
PHRASE = r"(?<![\p{L}\p{N}_])[A-Z][a-z]+(?:[\s\x1c-\x1f\x{85}\p{Z}]+[A-Z][a-z]+)*(?![\p{L}\p{N}_])"


def capitalised(text: Column, most: int) -> Column:
    """The first ``most`` distinct capitalised phrases of a text, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PHRASE), F.lit(0))), 1, most)


def preview(text: Column, most: int) -> Column:
    """The first ``most`` characters, with ... where some are left out. Null stays null."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def tokenized(text: Column) -> Column:
    """Sentences of a text by its closing marks: where a blank follows . ! or ?. Null gives null; blank pieces are left out."""
    return F.filter(F.split(text, f"(?<=[.!?]){BLANK}+"), lambda s: F.trim(s) != "")


def start_index(chunk_id: Column) -> Column:
    """The number after the first 'window' part of a chunk id, null without one."""
    return F.nullif(F.regexp_extract(chunk_id, "(?:^|_)window_([0-9]+)(?:_|$)", 1), F.lit("")).cast("int")


def document_name(chunk_id: Column) -> Column:
    """What stands before the first '_window_' of a chunk id, with blanks for underscores; the whole id without one."""
    return F.replace(F.regexp_extract(chunk_id, "(?s)^(.*?)(?:_window_.*)?$", 1), F.lit("_"), F.lit(" "))
