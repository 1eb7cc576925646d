"""SQL for DuckDB that gives the rows of the registered queries, written from the rules and not from the Spark plans.

``SEARCH`` is a chain of common table expressions over ``part``; the last SELECT differs by query.
"""

from __future__ import annotations

from .functions.stem import STOP_WORDS
from .queries import BATCH, PREFIXES


def _text(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"CAST({v} AS BIGINT)" if k == 0 else str(v) if isinstance(v, int) else "CAST(NULL AS INTEGER)" if v is None and k == len(r) - 1 else _text(v) for k, v in enumerate(r)) + ")" for r in rows)


TOK = "list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda t: t <> '')"
STOPS = "[" + ", ".join(_text(w) for w in STOP_WORDS) + "]"
#: Stems of the words of part and of the batch that differ from their words, by hand; every other word of them is its own stem.
STEMS = "CASE {0} WHEN 'economy' THEN 'economi' WHEN 'large' THEN 'larg' WHEN 'widgets' THEN 'widget' WHEN 'anvill' THEN 'anvil' WHEN 'widgte' THEN 'widgt' ELSE {0} END"
GRAMS = "flatten(list_transform({0}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"

SEARCH = f"""
WITH d AS (
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand || ' ' || p_type AS other_names, CAST(4000000 + p_partkey AS VARCHAR) AS code,
         p_brand AS brand, p_type AS type, CAST(p_size AS VARCHAR) AS size, CAST(p_retailprice AS FLOAT) AS rank,
         array_to_string({TOK.format('p_name')}, ' ') AS name_key, list_distinct({TOK.format("p_name || ' ' || p_brand || ' ' || p_type")}) AS ws
  FROM part
), dw AS (SELECT id, unnest(ws) AS word FROM d),
ds AS (SELECT DISTINCT id, {STEMS.format('word')} AS stem FROM dw WHERE NOT list_contains({STOPS}, word)),
v AS (
  SELECT a.word, a.doc_count, CASE WHEN list_contains({STOPS}, a.word) THEN a.word ELSE {STEMS.format('a.word')} END AS stem, coalesce(b.n, 0) AS match_count
  FROM (SELECT word, CAST(count(*) AS INTEGER) AS doc_count FROM dw GROUP BY 1) a
  LEFT JOIN (SELECT stem, CAST(count(*) AS INTEGER) AS n FROM ds GROUP BY 1) b ON b.stem = CASE WHEN list_contains({STOPS}, a.word) THEN a.word ELSE {STEMS.format('a.word')} END
), nm AS (
  SELECT name_key, first(name ORDER BY n DESC, name) AS name, CAST(sum(n) AS INTEGER) AS doc_count FROM (SELECT name_key, name, count(*) AS n FROM d GROUP BY 1, 2) GROUP BY 1
), names AS (
  SELECT nm.*, (SELECT id FROM d WHERE d.name_key = nm.name_key ORDER BY rank DESC NULLS LAST, id LIMIT 1) AS sample_id FROM nm WHERE name_key <> ''
), q0 AS (SELECT * FROM (VALUES @BATCH@) t(qid, q, fk, fv, lim)),
q1 AS (SELECT *, ({TOK.format('left(q, 256)')})[1:32] AS toks, CASE WHEN lim IS NULL THEN 100000000 ELSE least(greatest(lim, 1), 1000) END AS n FROM q0),
q AS (SELECT *, array_to_string(toks, ' ') AS text, list_filter(toks, lambda t: NOT list_contains({STOPS}, t)) AS kept FROM q1 WHERE len(list_filter(toks, lambda t: NOT list_contains({STOPS}, t))) > 0),
ok AS (SELECT q.qid, d.id FROM q, d WHERE fk IS NULL OR CASE fk WHEN 'brand' THEN brand WHEN 'type' THEN type WHEN 'size' THEN size END = fv),
t AS (SELECT DISTINCT qid, unnest(kept) AS word FROM q),
code0 AS (SELECT q.qid, d.id, row_number() OVER (PARTITION BY q.qid ORDER BY d.code, d.id) AS pos, q.n FROM q JOIN ok USING (qid) JOIN d USING (id)
  WHERE regexp_full_match(q.text, '[0-9]+') AND length(ltrim(q.text, '0')) >= 4 AND starts_with(d.code, ltrim(q.text, '0'))),
unf AS (SELECT DISTINCT qid FROM t WHERE length(word) >= 3 AND word NOT IN (SELECT word FROM v)
  AND (SELECT v.stem FROM v WHERE starts_with(v.word, t.word) ORDER BY v.match_count DESC, v.word LIMIT 1) <> {STEMS.format('t.word')}),
ts AS (SELECT DISTINCT qid, {STEMS.format('word')} AS stem FROM t WHERE qid NOT IN (SELECT qid FROM unf)),
word0 AS (SELECT h.qid, h.id, row_number() OVER (PARTITION BY h.qid ORDER BY d.name_key = q.text DESC, d.rank DESC NULLS LAST, d.id) AS pos, q.n
  FROM (SELECT ts.qid, ds.id FROM ts JOIN ds USING (stem) GROUP BY ts.qid, ds.id HAVING count(*) = (SELECT count(*) FROM ts x WHERE x.qid = ts.qid)) h JOIN ok USING (qid, id) JOIN d USING (id) JOIN q USING (qid)),
pre0 AS (SELECT h.qid, h.id, row_number() OVER (PARTITION BY h.qid ORDER BY d.name_key = q.text DESC, d.rank DESC NULLS LAST, d.id) AS pos, q.n
  FROM (SELECT t.qid, dw.id FROM t JOIN dw ON starts_with(dw.word, t.word) GROUP BY t.qid, dw.id HAVING count(DISTINCT t.word) = (SELECT count(*) FROM t x WHERE x.qid = t.qid)) h JOIN ok USING (qid, id) JOIN d USING (id) JOIN q USING (qid)
  WHERE len(list_filter(q.kept, lambda w: length(w) >= 3)) > 0),
qg AS (SELECT qid, n, list_distinct({GRAMS.format('kept')}) AS a FROM q),
fg AS (SELECT DISTINCT field, {GRAMS.format(TOK.format('field'))} AS b FROM (SELECT DISTINCT name AS field FROM d UNION SELECT DISTINCT other_names FROM d)),
runs AS (SELECT qg.qid, fg.field, qg.a, fg.b[i:j] AS run FROM qg, fg, unnest(range(1, len(b) + 1)) x(i), unnest(range(1, len(b) + 1)) y(j) WHERE i <= j AND list_contains(a, b[i]) AND list_contains(a, b[j])),
sims AS (SELECT qid, field, max(CAST(len(list_intersect(a, run)) / (len(a) + len(list_distinct(run)) - len(list_intersect(a, run))) AS FLOAT)) AS sim FROM runs GROUP BY 1, 2),
typo0 AS (SELECT q.qid, d.id, row_number() OVER (PARTITION BY q.qid ORDER BY greatest(coalesce(a.sim, 0), coalesce(b.sim, 0)) DESC, d.rank DESC NULLS LAST, d.id) AS pos, q.n
  FROM q JOIN ok USING (qid) JOIN d USING (id) LEFT JOIN sims a ON a.qid = q.qid AND a.field = d.name LEFT JOIN sims b ON b.qid = q.qid AND b.field = d.other_names WHERE greatest(coalesce(a.sim, 0), coalesce(b.sim, 0)) >= 0.5),
steps AS (SELECT qid, id, 'code' AS step, CAST(pos AS INTEGER) AS pos, 1 AS k FROM code0 WHERE pos <= n UNION ALL SELECT qid, id, 'word', CAST(pos AS INTEGER), 2 FROM word0 WHERE pos <= n
  UNION ALL SELECT qid, id, 'prefix', CAST(pos AS INTEGER), 3 FROM pre0 WHERE pos <= n UNION ALL SELECT qid, id, 'typo', CAST(pos AS INTEGER), 4 FROM typo0 WHERE pos <= n),
hits AS (SELECT qid, id, step, pos FROM steps s WHERE k = (SELECT min(k) FROM steps x WHERE x.qid = s.qid))
"""


def search(final: str, rows=BATCH) -> str:
    return SEARCH.replace("@BATCH@", _values([(i, q, k, v, n) for i, q, k, v, n in rows])) + final


_FULL = [(i, q, k, v, 1000) for i, q, k, v, n in BATCH]
_ALL = [(i, q, k, v, None) for i, q, k, v, n in BATCH]
_DISTINCT = f""", lims AS (SELECT * FROM (VALUES {_values([(i, n) for i, _, _, _, n in BATCH])}) t(qid, lim)),
best AS (SELECT qid, id, step, pos FROM (SELECT h.*, row_number() OVER (PARTITION BY qid, name_key ORDER BY pos) AS r FROM hits h JOIN d USING (id)) WHERE r = 1),
dist AS (SELECT qid, id, step, CAST(pos2 AS INTEGER) AS pos FROM (SELECT b.*, row_number() OVER (PARTITION BY b.qid ORDER BY b.pos) AS pos2, lim FROM best b JOIN lims USING (qid)) WHERE pos2 <= least(greatest(coalesce(lim, 50), 1), 1000))
"""
_PRE = [(i, q, None, None, 1000) for i, q, _ in PREFIXES]
_SUGGEST = f""", ask AS (SELECT qid, text, longest, least(greatest(coalesce(lim, 8), 1), 50) AS n FROM (VALUES {_values(PREFIXES)}) p(qid, q, lim), LATERAL (SELECT array_to_string({TOK.format('p.q')}, ' ') AS text, coalesce(list_max(list_transform({TOK.format('p.q')}, lambda w: length(w))), 0) AS longest) WHERE text <> ''),
lst AS (SELECT * FROM (SELECT ask.qid, row_number() OVER (PARTITION BY ask.qid ORDER BY names.doc_count DESC, names.name_key) AS ord, names.name, names.sample_id AS id, names.doc_count, ask.n FROM ask JOIN names ON starts_with(names.name_key, ask.text)) WHERE ord <= n),
had AS (SELECT ask.qid, ask.text, ask.n, ask.longest, count(lst.qid) AS had FROM ask LEFT JOIN lst ON lst.qid = ask.qid GROUP BY ALL),
oth AS (SELECT qid, id, name_key, pos, n, had FROM (SELECT h.qid, h.id, d.name_key, h.pos, had.n, had.had, row_number() OVER (PARTITION BY h.qid, d.name_key ORDER BY h.pos) AS r FROM hits h JOIN d USING (id) JOIN had USING (qid) WHERE had.had < had.n AND had.longest >= 4 AND NOT starts_with(d.name_key, had.text)) WHERE r = 1),
fill AS (SELECT oth.qid, had + row_number() OVER (PARTITION BY oth.qid ORDER BY pos) AS ord, names.name, oth.id, names.doc_count, n FROM oth JOIN names USING (name_key))
SELECT qid, CAST(ord AS INTEGER) AS pos, name, id, doc_count FROM lst UNION ALL SELECT qid, CAST(ord AS INTEGER), name, id, doc_count FROM fill WHERE ord <= n
"""
_PAIRS = "(SELECT DISTINCT p_name AS name FROM part), (VALUES ('red widgte'), ('smal rng'), ('gizmo'), ('zzz')) t(typed)"
_L = "SELECT doc_id, lang, source, quality = 1 AS good, toxic = 1 AS toxic, (n_chars % 1000) / 1000.0 AS p, n_chars FROM documents JOIN labels USING (doc_id)"
_Z = "1.959964"
_LF = "CASE WHEN {0} < 2 THEN 0.0 ELSE list_sum(list_transform(range(2, CAST({0} AS BIGINT) + 1), lambda k: ln(k))) END"

ORACLE: dict[str, str] = {
    "tokens": f"SELECT doc_id, array_to_string({TOK.format('text')}, ' ') AS tokens FROM documents",
    "documents": search("SELECT d.id, name_key, code, array_to_string(list_sort(ws), ' ') AS words, (SELECT string_agg(stem, ' ' ORDER BY stem) FROM ds WHERE ds.id = d.id) AS stems FROM d"),
    "names": search("SELECT name_key, name, doc_count, sample_id FROM names"),
    "words": search("SELECT word, doc_count, stem, match_count FROM v"),
    "waterfall": search("SELECT qid, id, step, pos FROM hits"),
    **{f"{s}_step": search(f"SELECT qid, id, step, pos FROM steps WHERE step = '{s}'") for s in ("code", "word", "prefix", "typo")},
    "query_distinct": search(_DISTINCT + "SELECT qid, id, step, pos FROM dist", _FULL),
    "suggest": search(_SUGGEST, _PRE),
    "facets": search(
        """, f AS (SELECT qid, facet, value, count(*) AS doc_count FROM (SELECT qid, unnest(['brand', 'type', 'size']) AS facet, unnest([brand, type, size]) AS value FROM hits JOIN d USING (id)) GROUP BY ALL)
SELECT qid, facet, value, doc_count FROM (SELECT f.*, row_number() OVER (PARTITION BY qid, facet ORDER BY doc_count DESC, value) AS r FROM f) WHERE r <= 3""",
        _ALL,
    ),
    "trigram_similarity": f"""WITH g AS (SELECT name, typed, list_distinct({GRAMS.format(TOK.format('name'))}) AS b, list_distinct({GRAMS.format(TOK.format('typed'))}) AS a FROM {_PAIRS})
SELECT name, typed, round(CAST(CAST(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS FLOAT) AS DOUBLE), 5) AS sim FROM g""",
    "word_similarity": f"""WITH g AS (SELECT name, typed, {GRAMS.format(TOK.format('name'))} AS b, list_distinct({GRAMS.format(TOK.format('typed'))}) AS a FROM {_PAIRS}),
r AS (SELECT name, typed, a, b[i:j] AS run FROM g, unnest(range(1, len(b) + 1)) x(i), unnest(range(1, len(b) + 1)) y(j) WHERE i <= j)
SELECT name, typed, round(CAST(max(CAST(len(list_intersect(a, run)) / (len(a) + len(list_distinct(run)) - len(list_intersect(a, run))) AS FLOAT)) AS DOUBLE), 5) AS sim FROM r GROUP BY 1, 2""",
    "edits1": f"""WITH w AS (SELECT DISTINCT unnest({TOK.format('p_name')}) AS word FROM part), c AS (SELECT unnest(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' ')) AS c),
p AS (SELECT word, i FROM w, LATERAL (SELECT unnest(range(0, length(word) + 1)) AS i))
SELECT DISTINCT word, edit FROM (
  SELECT word, left(word, i) || substr(word, i + 2) AS edit FROM p WHERE i < length(word)
  UNION ALL SELECT word, left(word, i) || substr(word, i + 2, 1) || substr(word, i + 1, 1) || substr(word, i + 3) FROM p WHERE i < length(word) - 1
  UNION ALL SELECT word, left(word, i) || c || substr(word, i + 2) FROM p, c WHERE i < length(word)
  UNION ALL SELECT word, left(word, i) || c || substr(word, i + 1) FROM p, c) WHERE edit <> word""",
    "edit_distance": f"""WITH w AS (SELECT DISTINCT unnest({TOK.format('p_name')}) AS a FROM part) SELECT a, b, CAST(CASE WHEN b = '' THEN length(a) ELSE damerau_levenshtein(a, b) END AS INTEGER) AS edits FROM w, (VALUES ('widgte'), ('rde'), ('glod'), ('blue'), ('')) t(b)""",
    "keep_or_sink": """WITH pg AS (SELECT p_brand AS qid, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos, CAST(p_partkey AS VARCHAR) AS id, p_name, p_type, (p_partkey % 10) / 10.0 AS score FROM part),
h AS (SELECT qid, count(*) AS size, count(DISTINCT p_name) AS groups, bool_and(score < 0.3) AS low, bool_or(starts_with(p_name, 'red widget')) AS says FROM pg WHERE pos <= 10 GROUP BY 1),
j AS (SELECT pg.*, size >= 2 AND groups >= 2 AS ran, low AND NOT says AS lost, pos <= 10 AND score < 0.3 AND size >= 2 AND groups >= 2 AS sunk FROM pg JOIN h USING (qid))
SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY pos > 10, sunk, pos) AS INTEGER) AS pos, sunk, ran AS reranked, ran AND lost AS no_match FROM j""",
    "carries": "SELECT p_partkey, regexp_matches(p_name, '(^| )widget') AS widget, starts_with(replace(p_name, ' ', ''), 'redw') OR contains(' ' || p_name, ' redw') AS red_w FROM part",
    "hit_at_k": search("""SELECT q0.qid, coalesce(bool_or(pos <= 1 AND m), false) AS hit1, coalesce(bool_or(pos <= 3 AND m), false) AS hit3, coalesce(bool_or(pos <= 10 AND m), false) AS hit10
FROM q0 LEFT JOIN (SELECT h.qid, h.pos, regexp_matches(lower(d.name || ' ' || d.other_names), 'widget|gizmo') AS m FROM hits h JOIN d USING (id)) x ON x.qid = q0.qid GROUP BY 1"""),
    "wilson": f"""WITH g AS (SELECT source, CAST(sum(CASE WHEN good THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS n FROM ({_L}) GROUP BY 1), s AS (SELECT *, hits / n AS p FROM g)
SELECT source, hits, n, round(greatest((p + {_Z}*{_Z}/(2*n) - {_Z}*sqrt(p*(1-p)/n + {_Z}*{_Z}/(4.0*n*n))) / (1 + {_Z}*{_Z}/n), 0), 6) AS low, round(least((p + {_Z}*{_Z}/(2*n) + {_Z}*sqrt(p*(1-p)/n + {_Z}*{_Z}/(4.0*n*n))) / (1 + {_Z}*{_Z}/n), 1), 6) AS high FROM s""",
    "mcnemar": f"""WITH g AS (SELECT lang, count(*) FILTER (WHERE good AND toxic) AS "both", count(*) FILTER (WHERE good AND NOT toxic) AS a_only, count(*) FILTER (WHERE NOT good AND toxic) AS b_only, count(*) FILTER (WHERE NOT good AND NOT toxic) AS neither FROM ({_L}) GROUP BY 1),
k AS (SELECT lang, a_only + b_only AS n, unnest(range(0, least(a_only, b_only) + 1)) AS i FROM g), t AS (SELECT lang, sum(exp({_LF.format('n')} - {_LF.format('i')} - {_LF.format('(n - i)')} - n * ln(2.0))) AS tail FROM k GROUP BY 1)
SELECT lang, "both", a_only, b_only, neither, round(CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(2 * tail, 1.0) END, 6) AS p FROM g JOIN t USING (lang)""",
    "holm": """WITH p AS (SELECT s_nationkey AS family, s_suppkey, ((s_suppkey * 37) % 1009) / 20000.0 AS p FROM supplier),
r AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p) + 1) * p) AS x FROM p)
SELECT family, s_suppkey, round(CAST(max(x) OVER (PARTITION BY family ORDER BY p ROWS UNBOUNDED PRECEDING) AS DOUBLE), 6) AS p_holm FROM r""",
    "quantile": f"""WITH s AS (SELECT lang, list(n_chars ORDER BY n_chars) AS x FROM ({_L}) GROUP BY 1)
SELECT lang, x[CAST(floor(0.5 * (len(x) - 1)) AS BIGINT) + 1] AS p50, x[CAST(floor(0.9 * (len(x) - 1)) AS BIGINT) + 1] AS p90, x[CAST(floor(0.99 * (len(x) - 1)) AS BIGINT) + 1] AS p99 FROM s""",
    "auroc": f"""WITH s AS ({_L}) SELECT lang, n_pos, n_neg, round(CASE WHEN n_pos * n_neg = 0 THEN NULL ELSE u / (n_pos * n_neg) END, 6) AS auroc
FROM (SELECT lang, count(*) FILTER (WHERE good) AS n_pos, count(*) FILTER (WHERE NOT good) AS n_neg FROM s GROUP BY 1)
JOIN (SELECT a.lang, sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) AS u FROM s a JOIN s b ON a.lang = b.lang AND a.good AND NOT b.good GROUP BY 1) USING (lang)""",
    "reliability": f"SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CASE WHEN good THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({_L}) GROUP BY 1",
    "calibration": f"""WITH s AS ({_L}), b AS (SELECT count(*) AS n, abs(avg(p) - avg(CASE WHEN good THEN 1.0 ELSE 0.0 END)) AS gap FROM s GROUP BY least(floor(p * 10), 9))
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * gap) / sum(n), 6) AS ece, (SELECT round(avg((p - CASE WHEN good THEN 1 ELSE 0 END) ** 2), 6) FROM s) AS brier FROM b""",
    "correction_counts": """WITH r AS (SELECT event_type AS system, CASE WHEN user_id % 4 = 0 THEN 'control' ELSE 'typo' END AS kind, event_id % 5 AS expect, CASE WHEN event_id % 3 <> 0 THEN user_id % 5 END AS said FROM events)
SELECT system, count(*) AS n, count(*) FILTER (WHERE kind = 'typo' AND said = expect) AS fixed, count(*) FILTER (WHERE kind = 'typo' AND said <> expect) AS wrong, count(*) FILTER (WHERE kind = 'typo' AND said IS NULL) AS missed,
count(*) FILTER (WHERE kind = 'control' AND said IS NOT NULL) AS false_alarms, count(said) AS offered, round(count(*) FILTER (WHERE kind = 'typo' AND said = expect) / nullif(count(said), 0), 6) AS "precision" FROM r GROUP BY 1""",
    "newest_per_code": """SELECT gtin_upc, description, modified_date FROM (SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '1') AS gtin_upc, o_orderstatus AS description, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS modified_date, o_orderkey,
row_number() OVER (PARTITION BY lpad(CAST(o_custkey AS VARCHAR), 8, '1') ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1 AND o_orderkey % 3 <> 0""",
    "hash_sample": "SELECT CAST(c_custkey AS VARCHAR) AS k, c_name FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR)), 1 LIMIT 100",
}
