"""Values that were cut off, by word trigrams inside texts and at their ends, in SQL alone (problem 4).

All distinct texts together tell how often each word trigram (five characters in scripts without blanks) stands inside a sentence and how often
a sentence ends with it. A value that lacks a closing mark is judged by its final trigram: cut when that is frequent inside but almost never ends a sentence. A
last word that was cut inside makes a trigram never seen; then the trigrams count that begin with the same two words and whose third only begins with what is left
of it, none of which ends there. Where a trigram is too rare, it counts with its longer words as classes (capitalised, or their last two letters). What all these do not tell
is left to shorter runs. Signs of a cut (a broken character, a marker, an unclosed JSON list) add to what the trigrams say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from passagemesh.runtime import bounded, materialize

#: Least occurrences of a run for its share to count, and the share of sentence ends below which it "almost never" ends one.
SEEN, SELDOM = 4, 0.04
#: Keys of finals that are sent to every task, at most; with more the counts are joined by shuffling.
FEW = 200_000
#: The same for single words.
SEEN_WORD, SELDOM_WORD = 20, 0.01

_UNSPACED = r"\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}ー\\p{IsThai}"
_TOKEN = (
    r"(?<=[\\p{IsThai}])[ ]+(?=[\\p{IsThai}])|[\\p{L}\\p{M}&&[^" + _UNSPACED + r"]]+|\\p{N}+|[" + _UNSPACED + r"]|[^\\s]"
)
_MARK = r"[.!?。！？؟।…]"

# One row per value and part: the value itself, or a passage of a context. form 'broken' is a JSON list that never closes.
PARTS = r"""
WITH whole AS (
  SELECT id, any_value(expectedOutput) AS expectedOutput, any_value(context) AS context FROM {goldens} WHERE id IS NOT NULL GROUP BY id),
ctx AS (
  SELECT id, rtrim(context) AS c, try_parse_json(context) AS j,
         from_json(context, 'array<string>') AS list FROM whole WHERE context IS NOT NULL),
passages AS (
  SELECT id, CASE
    WHEN c RLIKE '^\\s*\\[\\s*"' AND j IS NULL THEN array(replace(replace(regexp_replace(regexp_replace(c, '(?s)^.*(",\\s*"|\\[\\s*")', ''), '(\\\\(u[0-9a-fA-F]{0,3})?|",?\\s*)$', ''), '\\"', '"'), '\\n', '\n'))
    WHEN list IS NOT NULL THEN list
    WHEN c RLIKE "^\\s*\\[\\s*'" THEN split(regexp_replace(c, "^\\s*\\[\\s*'|'\\s*\\]\\s*$", ''), "', '")
    ELSE split(c, ' \\| ') END AS list,
    c RLIKE '^\\s*\\[\\s*"' AND j IS NULL AS broken FROM ctx)
SELECT id, 'expectedOutput' AS field, expectedOutput AS text, false AS broken FROM whole WHERE expectedOutput IS NOT NULL
UNION ALL
SELECT id, 'context', text, broken FROM passages LATERAL VIEW explode(list) AS text WHERE text IS NOT NULL OR broken
"""

# Each text once, without a sign of a cut, as tokens; numbers are alike.
TOKENS = rf"""
SELECT text, sign, transform(regexp_extract_all(bare, '{_TOKEN}', 0), x -> CASE WHEN x RLIKE '^\\p{{N}}+$' THEN '0' WHEN x RLIKE '^ +$' THEN ' ' ELSE x END) AS toks, bare
FROM (
  SELECT text, rtrim(text) RLIKE '(\\[truncated\\]|\\[(\\.\\.\\.|…)\\]?|\\(cont[a-z.]*|\\\\|�|<[a-zA-Z/]*)$' AS sign,
         trim(regexp_replace(rtrim(text), '(\\s*\\[truncated\\]|\\s*\\[(\\.\\.\\.|…)\\]?|\\s*\\(cont[a-z.]*|\\\\|�|\\s*<[a-zA-Z/]*|\\.\\.\\.|…)$', '')) AS bare
  FROM (SELECT DISTINCT text FROM {{parts}} WHERE text IS NOT NULL))
"""

_SEP = "\x1f"
#: Words of up to three letters stand for themselves, longer ones for their class.
_CLASS = "CASE WHEN length(x) <= 3 THEN x WHEN x RLIKE '^\\\\p{Lu}' THEN 'A' ELSE concat('~', right(x, 2)) END"
_LAST = f"element_at(key, -1) RLIKE '^[{_UNSPACED}]$'"
_TAIL = lambda n: f"slice(key, -least(size(key), {n}), {n})"
#: The runs a trigram counts for: itself, two shorter ones, the trigram of classes, and that of two classes and the last word.
_RUNS_OF = f"""array(named_struct('level', 1, 'run', key), named_struct('level', 2, 'run', {_TAIL(f"IF({_LAST}, 3, 2)")}), named_struct('level', 3, 'run', {_TAIL(f"IF({_LAST}, 2, 1)")}),
  named_struct('level', 4, 'run', transform(key, x -> {_CLASS})), named_struct('level', 5, 'run', concat(transform(slice(key, 1, size(key) - 1), x -> {_CLASS}), {_TAIL(1)})))"""

# Per trigram: how often inside a sentence, how often at its end. The last token of a text counts as neither.
TRIGRAMS = rf"""
SELECT key, count_if(ends) AS at_end, count_if(NOT ends) AS inside FROM (
  SELECT slice(toks, greatest(i + 2 - n, 1), least(n, i + 1)) AS key,
    coalesce(toks[i + 1] RLIKE '^[!?。！？؟।… ]$'
     OR toks[i + 1] = '.' AND coalesce(NOT get(toks, i + 2) RLIKE '^[\\p{{Ll}}0,;:]', true)
     OR toks[i + 1] = ';' AND toks[i] RLIKE '\\p{{IsGreek}}'
     OR toks[i + 1] RLIKE '^[”»"\\)）」』’]$' AND get(toks, i + 2) RLIKE '^{_MARK}$', false) AS ends
  FROM (SELECT toks, i, IF(toks[i] RLIKE '^[{_UNSPACED}]$', 5, 3) AS n FROM {{tokens}} LATERAL VIEW explode(sequence(0, size(toks) - 2)) AS i WHERE size(toks) > 1)
  WHERE NOT toks[i] RLIKE '^[!?。！？؟।… .]$')
GROUP BY key
"""

# Of texts that end without a closing mark: the final trigram.
FINALS = rf"""
SELECT text, sign, bare, slice(toks, greatest(size(toks) + 1 - n, 1), least(n, size(toks))) AS key, element_at(toks, -1) AS last FROM (
  SELECT *, IF(element_at(toks, -1) RLIKE '^[{_UNSPACED}]$', 5, 3) AS n FROM {{tokens}} WHERE size(toks) > 0
    AND (sign OR rtrim(text) <> bare OR NOT bare RLIKE '({_MARK}[”»"\\)）」』’\\]\\s]*|(?<=\\p{{IsGreek}});|[”»"」』\\]）}}]|\\))$'))
"""

# The runs of finals and of trigrams; ctx is a run without its last word. "kept" are the row's own columns.
RUNS = f"""
SELECT kept.*, r.level, array_join(r.run, '{_SEP}') AS run, array_join(slice(r.run, 1, size(r.run) - 1), '{_SEP}') AS ctx, size(r.run) AS n, element_at(r.run, -1) AS last
FROM (SELECT kept, explode({_RUNS_OF}) AS r FROM {{rows}})
"""

COUNTS = "SELECT r.level, r.run, sum(at_end) AS at_end, sum(inside) AS inside FROM {runs} r JOIN {wanted} w ON r.level = w.level AND r.run = w.run GROUP BY r.level, r.run"

# Words that begin with what is left of a final's last word, after the same words: the count of the commonest.
BEGUN = rf"""
SELECT level, ctx, last, max(n) AS n FROM (
  SELECT w.level, w.ctx, w.last, r.last AS word, sum(r.at_end + r.inside) AS n
  FROM (SELECT level, ctx, last, at_end, inside, explode(transform(sequence(1, length(last) - 1), k -> left(last, k))) AS prefix
        FROM {{runs}} WHERE level IN (1, 2, 5) AND n > 1 AND last RLIKE '^[\\p{{L}}\\p{{M}}]{{2,}}$') r
  JOIN {{frags}} w ON r.level = w.level AND r.ctx = w.ctx AND r.prefix = w.last
  GROUP BY 1, 2, 3, 4)
GROUP BY level, ctx, last
"""

_LIST_ITEM = r"regexp_extract(bare, '[^\\n]*$', 0) RLIKE '^\\s*([-*•·]|\\(?[0-9]+[.)])\\s'"
_LINK = r"regexp_extract(bare, '\\S+$', 0) RLIKE '[/@=<>\\{\\}\\[\\]]'"
#: What stands for no content.
_NOTHING = r"lower(trim(bare)) IN ('null', 'none', 'nil', 'n/a', 'na', 'nan', 'tbd', '(no answer)', '(none)')"
#: Tokens after the last closing mark; 99 where there is none.
_REST = rf"CASE WHEN bare RLIKE '{_MARK}\\s' THEN size(regexp_extract_all(regexp_extract(bare, '{_MARK}[”»\"\\)）」』’\\]]*\\s+([^.!?。！？؟।…]*)$', 1), '\\S+', 0)) ELSE 99 END"

_SENTENCE = rf"({_REST} < 99 OR size(regexp_extract_all(bare, '\\S+', 0)) > 4)"
_FRAGMENT = r"last RLIKE '^[\\p{L}\\p{M}]+$'"

_COLUMNS = ", ".join(f"max(CASE WHEN f.level = {k} THEN coalesce({c}, 0) ELSE 0 END) AS {c[0] if c == 'inside' else 'e'}{k}" for k in (1, 2, 3, 4) for c in ("at_end", "inside"))

# What decides a text: a trigram's counts first.
DECIDE = rf"""
WITH scored AS (
  SELECT f.text, any_value(f.sign) AS sign, any_value(f.bare) AS bare, any_value(f.words) AS words, any_value(f.end) AS last,
    {_COLUMNS},
    max(CASE WHEN f.level = 1 THEN b.n END) AS p1, max(CASE WHEN f.level = 2 THEN b.n END) AS p2, max(CASE WHEN f.level = 5 THEN b.n END) AS p5
  FROM {{finals}} f LEFT JOIN {{counts}} r ON f.level = r.level AND f.run = r.run LEFT JOIN {{begun}} b ON f.level = b.level AND f.ctx = b.ctx AND f.last = b.last GROUP BY f.text),
told AS (
  SELECT *, CASE
    WHEN {_NOTHING} OR NOT bare RLIKE '[\\p{{L}}]' OR {_LINK} OR NOT last RLIKE '^[\\p{{L}}\\p{{M}}0]' OR {_LIST_ITEM} THEN NULL
    WHEN e1 + i1 >= {SEEN} THEN e1 < {SELDOM} * (e1 + i1)
    WHEN e2 + i2 = 0 AND {_FRAGMENT} AND (p1 >= {SEEN} OR p5 >= {SEEN}) THEN true
    WHEN e4 + i4 >= {SEEN} AND e4 < {SELDOM} * (e4 + i4) AND {_SENTENCE} AND NOT exists(words, w -> w RLIKE '^[,:;0、，：]$') THEN true
    END AS trigram FROM scored)
SELECT text, coalesce(trigram, false) AS by_trigram, coalesce(trigram, false) OR coalesce(CASE
    WHEN sign THEN true
    WHEN {_NOTHING} OR NOT bare RLIKE '[\\p{{L}}]' OR {_LINK} THEN false
    WHEN last RLIKE '^[,:;(“«„「『（、，：]$' THEN true
    WHEN NOT last RLIKE '^[\\p{{L}}\\p{{M}}0]' THEN false
    WHEN {_LIST_ITEM} THEN e3 + i3 = 0 AND {_FRAGMENT} AND p2 >= {SEEN}
    WHEN e2 + i2 = 0 AND {_FRAGMENT} AND p2 >= {SEEN} THEN true
    WHEN {_REST} BETWEEN 1 AND 2 AND NOT last RLIKE '^[{_UNSPACED}]$' THEN true
    WHEN trigram IS NOT NULL THEN false
    WHEN e2 + i2 >= {SEEN} THEN e2 < {SELDOM} * (e2 + i2)
    WHEN e3 + i3 = 0 AND last RLIKE '^[\\p{{Ll}}\\p{{Lo}}]' THEN {_SENTENCE}
    WHEN e3 + i3 >= IF(last RLIKE '^[{_UNSPACED}]$', {SEEN}, {SEEN_WORD}) THEN e3 < {SELDOM_WORD} * (e3 + i3)
    END, false) AS cut
FROM told
"""


def _sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """Runs ``text``, in which {name} stands for a frame; other braces, as in patterns, are left alone."""
    for name, frame in frames.items():
        view = f"cutoff_{name}_{uuid.uuid4().hex}"
        frame.createOrReplaceTempView(view)
        text = text.replace("{" + name + "}", view)
        frames[name] = view
    out = spark.sql(text)
    for view in frames.values():
        spark.catalog.dropTempView(view)
    return out


def parts(goldens: DataFrame) -> DataFrame:
    """(id, field, text, broken): the values and passages that are judged; an id that is repeated counts once."""
    return _sql(goldens.sparkSession, PARTS, goldens=goldens.select("id", "expectedOutput", "context"))


def judged(goldens: DataFrame) -> DataFrame:
    """(id, field, cut, by_trigram) for each value that is not null; empty values are not cut. by_trigram: a trigram's counts alone say that it is."""
    spark = goldens.sparkSession
    p = materialize(parts(goldens), "parts")
    tokens = materialize(_sql(spark, TOKENS, parts=p), "tokens")
    trigrams = materialize(_sql(spark, TRIGRAMS, tokens=tokens), "trigrams")
    runs = _sql(spark, RUNS, rows=trigrams.selectExpr("key", "struct(at_end, inside) AS kept"))
    finals = _sql(spark, FINALS, tokens=tokens)
    finals = materialize(_sql(spark, RUNS, rows=finals.selectExpr("key", "struct(text, sign, bare, key AS words, last AS end) AS kept")), "finals")
    wanted = bounded(finals.select("level", "run").distinct(), FEW)
    frags = bounded(finals.filter("level IN (1, 2, 5) AND n > 1").select("level", "ctx", "last").distinct(), FEW)
    texts = _sql(spark, DECIDE, finals=finals, counts=_sql(spark, COUNTS, runs=runs, wanted=wanted), begun=_sql(spark, BEGUN, runs=runs, frags=frags))
    return _sql(
        spark,
        "SELECT p.id, p.field, bool_or(p.broken OR coalesce(t.cut, false)) AS cut, bool_or(coalesce(t.by_trigram, false)) AS by_trigram FROM {p} p LEFT JOIN {t} t ON p.text = t.text GROUP BY p.id, p.field",
        p=p,
        t=texts,
    )


def found(goldens: DataFrame) -> DataFrame:
    """Distinct (id, field) of the values that were cut off. Null ids, and null or empty values, are no cases."""
    return judged(goldens).filter("cut").select("id", "field")


def report(goldens: DataFrame) -> DataFrame:
    """(sourceFile, field, n_values, n_cut, share): how often each source truncates each field; a null source is one source."""
    files = _sql(goldens.sparkSession, "SELECT id, min(sourceFile) AS sourceFile FROM {g} WHERE id IS NOT NULL GROUP BY id", g=goldens.select("id", "sourceFile"))
    return _sql(
        goldens.sparkSession,
        "SELECT sourceFile, field, count(*) AS n_values, count_if(cut) AS n_cut, count_if(cut) / count(*) AS share FROM {j} j JOIN {f} f ON j.id = f.id GROUP BY sourceFile, field",
        j=judged(goldens),
        f=files,
    )
