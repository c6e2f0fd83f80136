"""The SQL of the walks: a recursive query whose rows are the states of all queries, written from the operators' definitions."""

from __future__ import annotations

DOT = "list_dot_product({}, {})"
NEAR = lambda a, b: f"round(list_dot_product({a}, {b}), 9)"
AWAY = lambda q, h, c: f"round(sqrt(list_sum(list_transform(range(1, 65), lambda i: power({h}[i] + {c}[i] - 2 * {q}[i], 2)))) / 3.0, 9)"
MEAN = lambda a, b, c: f"round(({a} + {b} + {c}) / 3.0, 9)"


def sentences(usable: str) -> str:
    """links and held over nodes and edges."""
    return f"""links AS (SELECT src, dst, min(CASE WHEN type = 'intra_document' THEN 0 ELSE 1000000 END + rank)::INTEGER AS ord FROM edges GROUP BY 1, 2),
sent AS (SELECT sentence_id AS sid, any_value(sentence_text) AS text, any_value(coalesce(sentence_index, 0)) AS idx, any_value(containing_chunks) AS chunks, any_value(CASE WHEN {usable} THEN embedding END) AS raw
 FROM sentence_embeddings WHERE sentence_id IS NOT NULL AND sentence_text IS NOT NULL GROUP BY 1),
said AS (SELECT *, CASE WHEN raw IS NOT NULL THEN list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) END AS v FROM sent),
canon AS (SELECT text, first(v ORDER BY sid) AS c FROM said GROUP BY 1),
bridge AS (SELECT * FROM (SELECT DISTINCT sid, text, idx, raw, v, unnest(chunks) AS id FROM said) WHERE id IS NOT NULL),
srcs AS (SELECT text, min(id) AS src FROM bridge GROUP BY 1),
held AS (SELECT b.id, list({{'text': b.text, 'raw': b.raw, 'v': b.v, 'c': canon.c, 'src': srcs.src, 'sv': n.vec}} ORDER BY b.idx, b.sid) AS l
 FROM bridge b JOIN canon ON canon.text = b.text JOIN srcs ON srcs.text = b.text LEFT JOIN nodes n ON n.id = srcs.src GROUP BY 1)"""


def walk(tables: str, algorithm: str, choice: str = "1") -> str:
    """``tables`` defines nodes, edges, queries, sims, links and held; ``choice`` is what a guided walk takes of ``ids``, 0 to stop."""
    semantic, average, guided = algorithm == "ssg_traversal", algorithm == "triangulation_average", algorithm == "llm_guided_traversal"
    geometric = algorithm == "triangulation_geometric_fulldim"
    if average:
        m, k = MEAN(NEAR("qu", "hu"), NEAR("qu", "e.vec"), NEAR("hu", "e.vec")), "round(abs({m} - 1.0), 9)"
        sm = MEAN(NEAR("qu", "hu"), NEAR("qu", "s.v"), NEAR("qu", "s.v"))
    elif geometric:
        m, k, sm = AWAY("qr", "hr", "e.raw"), "{m}", AWAY("qr", "hr", "s.raw")
    else:
        m, k, sm = NEAR("hu" if semantic else "qu", "e.vec"), "-{m}", ""
    k, sk = k.format(m=m), k.format(m=sm)
    early = "false"
    if algorithm == "query_traversal":
        early = "coalesce(len(ext) >= 8 AND greatest(0.0, coalesce(list_max(list_transform(list_filter(ext, lambda e: e.has), lambda e: e.conf)), 0.0)) > list_max(list_transform(c, lambda e: -e.nq)), false)"
    elif semantic:
        early = "coalesce(hop > 0 AND c[1].m <= last, false)"
    elif average:
        early = f"coalesce(len(ext) >= 8 AND list_max(list_transform(list_filter(ext, lambda e: e.has), lambda e: {MEAN(NEAR('qu', 'hu'), 'e.conf', 'coalesce(' + NEAR('hu', 'e.sv') + ', 0.0)')})) > c[1].m, false)"
    own = f"list_sort(list_transform(list_filter(l, lambda s: s.v IS NOT NULL), lambda s: {{'k': {sk}, 'nq': -{NEAR('qu', 's.v')}, 'm': {sm}}}))" if sm else "NULL::STRUCT(k DOUBLE, nq DOUBLE, m DOUBLE)[]"
    wins = "(own[1] IS NOT NULL AND (c[1] IS NULL OR own[1].k < c[1].k OR (own[1].k = c[1].k AND own[1].nq < c[1].nq)))" if sm else "false"
    if guided:
        move = f"CASE WHEN ({choice}) = 0 THEN NULL ELSE coalesce(ids[CASE WHEN ({choice}) BETWEEN 1 AND 5 THEN ({choice}) ELSE 1 END], ids[1]) END"
    else:
        move = "c[1].dst" if semantic else "list_filter(c, lambda e: NOT e.seen)[1].dst"
    overlap = "AND NOT list_has_any(list_transform(ext, lambda x: x.text), list_transform(coalesce(t.l, []), lambda x: x.text))" if semantic else ""
    held_of = "LEFT JOIN held t ON t.id = e.dst" if semantic else ""
    before = "false" if semantic else "(hop > 0 AND len(w.ext) >= 10)"
    score = "CASE WHEN n > 0 THEN total / n ELSE 0.0 END" if average or geometric else "CASE WHEN len(ext) > 0 THEN list_sum(list_transform(ext[1:10], lambda e: e.conf)) / len(ext[1:10]) ELSE 0.0 END"
    return f"""WITH RECURSIVE {tables},
start AS (SELECT query_id, min({{'ns': -sim, 'id': id}}).id AS cur FROM sims GROUP BY 1),
walk AS (
  SELECT s.query_id, q.vec AS qu, q.raw AS qr, s.cur, [s.cur] AS path, []::STRUCT(text VARCHAR, conf DOUBLE, src VARCHAR, sv DOUBLE[], has BOOLEAN)[] AS ext, 0.0::DOUBLE AS total, 0 AS n, 0.0::DOUBLE AS last, false AS done, 0 AS hop
  FROM start s JOIN queries q ON q.id = s.query_id
  UNION ALL
  SELECT query_id, qu, qr, coalesce(dest, cur), CASE WHEN dest IS NULL THEN path ELSE list_append(path, dest) END, ext, total + coalesce(measured, 0.0), n + CASE WHEN measured IS NULL THEN 0 ELSE 1 END,
    CASE WHEN dest IS NULL THEN last ELSE best_m END, dest IS NULL, hop + 1
  FROM (SELECT *, c[1].m AS best_m, CASE WHEN NOT stopped AND NOT {early} AND NOT {wins} THEN {move} END AS dest, CASE WHEN NOT stopped THEN {"CASE WHEN " + wins + " THEN own[1].m ELSE c[1].m END" if sm else "NULL::DOUBLE"} END AS measured
   FROM (SELECT *, {own} AS own, list_transform(list_filter(c, lambda e: NOT e.seen), lambda e: e.dst)[1:5] AS ids
    FROM (SELECT query_id, any_value(qu) AS qu, any_value(qr) AS qr, any_value(hu) AS hu, any_value(hr) AS hr, any_value(cur) AS cur, any_value(path) AS path, any_value(ext) AS ext, any_value(x.l) AS l, any_value(total) AS total, any_value(n) AS n,
       any_value(last) AS last, any_value(hop) AS hop, any_value(stopped) AS stopped,
       coalesce(list({{'k': {k}, 'nq': -{NEAR('qu', 'e.vec')}, 'ord': e.ord, 'dst': e.dst, 'm': {m}, 'seen': list_contains(path, e.dst)}} ORDER BY {k}, -{NEAR('qu', 'e.vec')}, e.ord) FILTER (e.dst IS NOT NULL {overlap}), []) AS c
     FROM (SELECT y.*, h.vec AS hu, h.raw AS hr, before_full OR ({'true' if semantic else 'hop = 0'} AND len(ext) >= 10) AS stopped
      FROM (SELECT z.* EXCLUDE (old), CASE WHEN before_full THEN old ELSE list_concat(old, list_filter(
            list_transform(l, lambda s: {{'text': s.text, 'conf': coalesce({NEAR('qu', 's.c')}, 0.5), 'src': s.src, 'sv': s.sv, 'has': s.c IS NOT NULL}}), lambda s: NOT list_contains(list_transform(old, lambda e: e.text), s.text))) END AS ext
       FROM (SELECT w.* EXCLUDE (ext), w.ext AS old, coalesce(s.l, []) AS l, {before} AS before_full FROM walk w LEFT JOIN held s ON s.id = w.cur WHERE NOT w.done AND w.hop < 20) z) y
      LEFT JOIN nodes h ON h.id = y.cur) x
     LEFT JOIN (SELECT k.src, k.dst, k.ord, d.vec, d.raw FROM links k JOIN nodes d ON d.id = k.dst) e ON e.src = x.cur AND NOT x.stopped {held_of}
     GROUP BY query_id) u) v))
SELECT query_id, path, list_transform(ext[1:10], lambda e: e.text) AS gathered, list_transform(ext[1:10], lambda e: round(e.conf, 6)) AS confidence, list_transform(ext[1:10], lambda e: e.src) AS sources, round({score}, 6) AS score, (len(path) - 1)::INTEGER AS hops
FROM walk WHERE done OR hop = 20"""


def basic(tables: str) -> str:
    """Chunks in order of similarity, one after the other, until ten sentences or the early stop."""
    return f"""WITH RECURSIVE {tables},
ranked AS (SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS r FROM sims),
walk AS (
  SELECT id AS query_id, vec AS qu, []::VARCHAR[] AS path, []::STRUCT(text VARCHAR, conf DOUBLE, src VARCHAR, has BOOLEAN)[] AS ext, 0.0::DOUBLE AS total, 0.0::DOUBLE AS best, 0 AS r, false AS done FROM queries
  UNION ALL
  SELECT query_id, qu, CASE WHEN used THEN list_append(path, id) ELSE path END, CASE WHEN used THEN list_concat(ext, fresh) ELSE ext END, CASE WHEN used THEN total + sim ELSE total END,
    CASE WHEN used THEN greatest(best, coalesce(list_max(list_transform(list_filter(fresh, lambda s: s.has), lambda s: s.conf)), 0.0)) ELSE best END, r, ended
  FROM (SELECT *, NOT ended AND len(fresh) > 0 AS used FROM (
    SELECT w.query_id, w.qu, w.path, w.ext, w.total, w.best, k.id, k.sim, w.r + 1 AS r, k.id IS NULL OR len(w.ext) >= 10 OR (len(w.ext) >= 5 AND k.sim < w.best) AS ended,
      list_filter(list_transform(coalesce(s.l, []), lambda x: {{'text': x.text, 'conf': coalesce({NEAR('w.qu', 'x.c')}, 0.5), 'src': x.src, 'has': x.c IS NOT NULL}}), lambda x: NOT list_contains(list_transform(w.ext, lambda e: e.text), x.text)) AS fresh
    FROM walk w LEFT JOIN ranked k ON k.query_id = w.query_id AND k.r = w.r + 1 LEFT JOIN held s ON s.id = k.id WHERE NOT w.done)))
SELECT query_id, path, list_transform(ext[1:10], lambda e: e.text) AS gathered, list_transform(ext[1:10], lambda e: round(e.conf, 6)) AS confidence, list_transform(ext[1:10], lambda e: e.src) AS sources,
 round(CASE WHEN len(path) > 0 THEN total / len(path) ELSE 0.0 END, 6) AS score, 0 AS hops FROM walk WHERE done"""
