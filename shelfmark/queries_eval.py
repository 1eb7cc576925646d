"""Registered queries of sources, spelling and evaluation on the driver tables, each beside SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.stem import stop_array
from .operators import catalog, evaluate, group, judge, report, spell, stats
from .oracle import _DISTINCT, _FULL, _L, _PRE, _SUGGEST, _Z, GRAMS, STEMS, STOPS, TOK, search
from .plans.durable import checkpointed, shared_dir
from .plans.files import write_text
from .queries import BATCH, PREFIXES, _labels, batch, part_catalog, plain, table
from .sources import demo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def registered(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _list(xs):
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


# -- spelling --------------------------------------------------------------------------
TYPED = [(1, "widgte", None), (2, "smlal gear", None), (3, "bleu bolt", None), (4, "economi", None), (5, "gea", None), (6, "standrad plate", None), (7, "goldd", None), (8, "smal rng", None), (9, "wigdet plaet", None), (10, "xqzzt", None)]
_TYPED = [(i, q, None, None, None) for i, q, _ in TYPED]


def _edits(source: str) -> str:
    """SQL: (word, edit) for the words of ``source`` (word)."""
    return f"""(SELECT DISTINCT word, edit FROM (
  SELECT word, left(word, i) || substr(word, i + 2) AS edit FROM {source} s, LATERAL (SELECT unnest(range(0, length(s.word))) AS i)
  UNION ALL SELECT word, left(word, i) || substr(word, i + 2, 1) || substr(word, i + 1, 1) || substr(word, i + 3) FROM {source} s, LATERAL (SELECT unnest(range(0, length(s.word) - 1)) AS i)
  UNION ALL SELECT word, left(word, i) || c || substr(word, i + 2) FROM {source} s, LATERAL (SELECT unnest(range(0, length(s.word))) AS i), letters
  UNION ALL SELECT word, left(word, i) || c || substr(word, i + 1) FROM {source} s, LATERAL (SELECT unnest(range(0, length(s.word) + 1)) AS i), letters) WHERE edit <> word)"""


_WORDS = f""", letters AS (SELECT unnest(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' ')) AS c),
tw AS (SELECT qid, pos, word, {STEMS.format('word')} AS stem FROM (SELECT qid, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM q1)
  WHERE length(word) >= 4 AND NOT regexp_matches(word, '[0-9]') AND NOT list_contains({STOPS}, word)),
w0 AS (SELECT DISTINCT word, stem FROM tw)"""
_SIMILAR = f"""{_WORDS},
own AS (SELECT w0.word, w0.stem, coalesce(max(v.match_count), 0) AS matches FROM w0 LEFT JOIN v ON v.stem = w0.stem GROUP BY 1, 2),
comp AS (SELECT w0.word, v.stem AS cs, max(v.match_count) AS cn, first(v.word ORDER BY v.doc_count DESC, v.word) AS cw FROM w0 JOIN v ON starts_with(v.word, w0.word) AND v.word <> w0.word GROUP BY 1, 2),
cr AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY cn DESC, cs) AS r FROM comp),
c AS (SELECT own.*, a.cs AS c1s, a.cn AS c1n, a.cw AS c1w, b.cn AS c2n, coalesce(a.cs <> own.stem, false) AND own.word NOT IN (SELECT word FROM v) AS unf
  FROM own LEFT JOIN cr a ON a.word = own.word AND a.r = 1 LEFT JOIN cr b ON b.word = own.word AND b.r = 2),
wg AS (SELECT word, list_distinct({GRAMS.format('[word]')}) AS g FROM w0), vg AS (SELECT word AS alt, list_distinct({GRAMS.format('[word]')}) AS h FROM v),
al AS (SELECT word, alt, CAST(len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) AS FLOAT) AS sim FROM wg, vg),
cand AS (SELECT e.word, e.edit AS alt, 1 AS kind, CAST(0 AS FLOAT) AS sim FROM {_edits('w0')} e UNION ALL SELECT word, alt, 2, sim FROM al WHERE sim >= CAST(0.3 AS FLOAT) AND NOT starts_with(alt, word)),
worth AS (SELECT x.word, x.alt, x.kind, x.sim, v.match_count AS vn FROM cand x JOIN c ON c.word = x.word JOIN v ON v.word = x.alt
  WHERE v.stem <> c.stem AND v.match_count > c.matches AND v.match_count > CASE WHEN v.stem = c.c1s THEN coalesce(c2n, 0) ELSE coalesce(c1n, 0) END),
few AS (SELECT *, row_number() OVER (PARTITION BY word, kind ORDER BY sim DESC, vn DESC, alt) AS r FROM worth),
one AS (SELECT *, row_number() OVER (PARTITION BY word, alt ORDER BY kind) AS k FROM few WHERE kind = 1 OR r <= 8),
off AS (SELECT word, alt, vn, row_number() OVER (PARTITION BY word ORDER BY kind, sim DESC, vn DESC, alt) AS n, max(vn) OVER (PARTITION BY word) AS best FROM one WHERE k = 1),
sim AS (SELECT tw.qid, tw.pos, CAST(off.n AS INTEGER) AS n, c.word, c.matches AS word_matches, off.alt AS alternative, off.vn AS alternative_matches, false AS completes
  FROM tw JOIN c ON c.word = tw.word JOIN off ON off.word = c.word WHERE off.n <= 8 AND (NOT unf OR (best >= 100 * c1n AND alt <> c1w))
  UNION ALL SELECT tw.qid, tw.pos, 0, c.word, c.matches, c1w, c1n, true FROM tw JOIN c ON c.word = tw.word JOIN off ON off.word = c.word WHERE unf AND best >= 100 * c1n AND off.n = 1)"""
_RESPELT = "array_to_string(list_transform(toks, lambda t, i: CASE WHEN i = pos THEN alternative ELSE t END), ' ')"
_KNOWN = f"""{_WORDS}, base AS (SELECT w0.word, coalesce(v.doc_count, 0) AS own FROM w0 LEFT JOIN v ON v.word = w0.word),
e1 AS {_edits('w0')}, k1 AS (SELECT b.word, v.word AS alt, v.doc_count FROM base b JOIN e1 ON e1.word = b.word JOIN v ON v.word = e1.edit AND v.doc_count > own),
more AS (SELECT DISTINCT edit AS word FROM e1 WHERE word NOT IN (SELECT word FROM k1)), e2 AS {_edits('more')},
k2 AS (SELECT DISTINCT b.word, v.word AS alt, v.doc_count FROM base b JOIN e1 ON e1.word = b.word JOIN e2 ON e2.word = e1.edit JOIN v ON v.word = e2.edit AND v.doc_count > own AND v.word <> b.word WHERE b.word NOT IN (SELECT word FROM k1)),
kn AS (SELECT *, CAST(row_number() OVER (PARTITION BY word ORDER BY edits, doc_count DESC, alt) AS INTEGER) AS n FROM (SELECT *, 1 AS edits FROM k1 UNION ALL SELECT *, 2 FROM k2))"""


@registered(search(_SIMILAR + " SELECT qid, CAST(pos AS INTEGER) AS pos, n, word, word_matches, alternative, alternative_matches, completes FROM sim", _TYPED))
def similar_words(spark, sf_dir):
    return spell.similar_words(part_catalog(spark, sf_dir), plain(spark, TYPED))


@registered(
    search(
        _SIMILAR
        + f""", tx AS (SELECT sim.qid, row_number() OVER (PARTITION BY sim.qid, pos ORDER BY sim.n) AS turn, pos, {_RESPELT} AS text, CAST(damerau_levenshtein(word, alternative) AS INTEGER) AS edits, completes FROM sim JOIN q1 USING (qid)
  UNION ALL SELECT qid, 0, 0, array_to_string(toks, ' '), 0, false FROM q1),
f AS (SELECT *, row_number() OVER (PARTITION BY qid, text ORDER BY turn, pos) AS k FROM tx), g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY turn, pos) - 1 AS n FROM f WHERE k = 1)
SELECT qid, CAST(n AS INTEGER) AS n, text, edits, completes FROM g WHERE n < 16""",
        _TYPED,
    )
)
def spelling_options(spark, sf_dir):
    q = plain(spark, TYPED)
    return spell.spelling_options(q, spell.similar_words(part_catalog(spark, sf_dir), q))


@registered(
    search(
        _SIMILAR
        + f""", fr AS (SELECT sim.*, toks, row_number() OVER (PARTITION BY sim.qid ORDER BY alternative_matches DESC, pos, sim.n) AS r FROM sim JOIN q1 USING (qid) WHERE NOT completes AND alternative_matches >= 10 * greatest(word_matches, 1))
SELECT q1.qid, x.corrected FROM q1 LEFT JOIN (SELECT qid, {_RESPELT} AS corrected FROM fr WHERE r = 1) x ON x.qid = q1.qid""",
        _TYPED,
    )
)
def frequency_rule(spark, sf_dir):
    q = plain(spark, TYPED)
    return spell.frequency_rule(q, spell.similar_words(part_catalog(spark, sf_dir), q))


@registered(search(_KNOWN + " SELECT word, alt AS alternative, edits, doc_count, n FROM kn", _TYPED))
def edit_candidates(spark, sf_dir):
    words = spell.typed_words(plain(spark, TYPED)).select("word")
    return spell.known_edits(words, part_catalog(spark, sf_dir))


@registered(
    search(
        _KNOWN
        + f""", fix AS (SELECT qid, pos, CASE WHEN w.word IN (SELECT word FROM w0) AND w.word NOT IN (SELECT word FROM v) THEN coalesce(kn.alt, w.word) ELSE w.word END AS new, w.word FROM (SELECT qid, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM q1) w LEFT JOIN kn ON kn.word = w.word AND kn.n = 1)
SELECT qid, CASE WHEN bool_or(new <> word) THEN string_agg(new, ' ' ORDER BY pos) END AS corrected FROM fix GROUP BY 1""",
        _TYPED,
    )
)
def norvig(spark, sf_dir):
    return spell.norvig(part_catalog(spark, sf_dir), plain(spark, TYPED))


_SHARED = f"""{_DISTINCT}, a AS (SELECT h.qid, id FROM hits h JOIN lims USING (qid) WHERE pos <= 10 AND pos <= least(greatest(coalesce(lim, 1000), 1), 1000)), b AS (SELECT qid, id FROM dist WHERE pos <= 10)"""


@registered(search(_SHARED + " SELECT k.qid, count(a.id) FILTER (WHERE b.id IS NOT NULL) AS shared FROM (SELECT qid FROM a UNION SELECT qid FROM b) k LEFT JOIN a ON a.qid = k.qid LEFT JOIN b ON b.qid = a.qid AND b.id = a.id GROUP BY 1", _FULL))
def overlap(spark, sf_dir):
    return evaluate.overlap(*group.search_and_distinct(part_catalog(spark, sf_dir), batch(spark)))


@registered(search(_SHARED + " SELECT count(*) AS n, round(avg(coalesce(s, 0)), 6) AS mean FROM q0 LEFT JOIN (SELECT a.qid, count(*) AS s FROM a JOIN b ON b.qid = a.qid AND b.id = a.id GROUP BY 1) USING (qid)", _FULL))
def mean_overlap(spark, sf_dir):
    q = batch(spark)
    return evaluate.mean_overlap(q, *group.search_and_distinct(part_catalog(spark, sf_dir), q)).select("n", F.round("mean", 6).alias("mean"))


@registered(
    """WITH o AS (SELECT o_custkey AS qid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, CAST(o_orderkey AS VARCHAR) AS text, o_orderkey % 3 = 0 AS completes, (o_orderkey % 10) / 10.0 AS p FROM orders),
g AS (SELECT qid, count(*) AS c, sum(CASE WHEN n = 0 OR completes THEN p ELSE 0 END) AS kept, max(CASE WHEN n > 0 AND NOT completes THEN p ELSE 0 END) AS best, first(text ORDER BY p DESC, n) FILTER (WHERE n > 0 AND NOT completes AND p > 0) AS likeliest FROM o GROUP BY 1)
SELECT qid, CASE WHEN c > 1 AND best >= 0.3 AND best >= 2 * kept THEN likeliest END AS suggestion, round(CAST(CASE WHEN c > 1 THEN best ELSE 0 END AS DOUBLE), 6) AS p, c > 1 AS ran FROM g"""
)
def suggestion_rule(spark, sf_dir):
    """Options are the orders of a customer; the last digit of an order's key stands for its probability."""
    o = table(spark, sf_dir, "orders")
    n = F.row_number().over(report.Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    opts = o.select(F.col("o_custkey").alias("qid"), n.alias("n"), F.col("o_orderkey").cast("string").alias("text"), (F.col("o_orderkey") % 3 == 0).alias("completes"), (F.col("o_orderkey") % 10 / 10.0).alias("p"))
    return spell.suggestion(opts.drop("p"), opts.select("qid", "n", "p")).select("qid", "suggestion", F.round("p", 6).alias("p"), "ran")


@registered(
    search(
        f""", tk AS (SELECT id, unnest(x) AS word, generate_subscripts(x, 1) AS pos FROM (SELECT id, {TOK.format("name || ' ' || other_names")} AS x FROM d)),
st AS (SELECT id, {STEMS.format('word')} AS stem, pos FROM tk WHERE NOT list_contains({STOPS}, word)), qs AS (SELECT DISTINCT qid, {STEMS.format('word')} AS stem FROM t), nd AS (SELECT qid, count(*) AS needed FROM qs GROUP BY 1),
pl AS (SELECT qs.qid, st.id, qs.stem, st.pos, row_number() OVER (PARTITION BY qs.qid, st.id, qs.stem ORDER BY st.pos) AS j FROM qs JOIN st USING (stem)),
ok2 AS (SELECT qid, id FROM pl JOIN nd USING (qid) GROUP BY qid, id, needed HAVING count(DISTINCT stem) = needed),
r1 AS (SELECT qid, id, sum(0.1 / (j * j)) / 1.64493406685 AS r FROM pl GROUP BY 1, 2),
r2 AS (SELECT a.qid, a.id, 1 - product(1 - CASE WHEN abs(a.pos - b.pos) > 100 THEN sqrt(0.01 * 1e-30) ELSE 0.1 / sqrt(1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2)) END) AS r FROM pl a JOIN pl b ON a.qid = b.qid AND a.id = b.id AND a.stem < b.stem GROUP BY 1, 2),
sc AS (SELECT ok2.qid, ok2.id, d.name, CAST(CASE WHEN needed = 1 THEN r1.r ELSE r2.r END AS FLOAT) AS score FROM ok2 JOIN nd USING (qid) JOIN d USING (id) LEFT JOIN r1 ON r1.qid = ok2.qid AND r1.id = ok2.id LEFT JOIN r2 ON r2.qid = ok2.qid AND r2.id = ok2.id),
b1 AS (SELECT *, row_number() OVER (PARTITION BY qid, lower(name) ORDER BY score DESC, id) AS k FROM sc), b2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, name, id) AS pos FROM b1 WHERE k = 1)
SELECT qid, id, CAST(pos AS INTEGER) AS pos, round(CAST(score AS DOUBLE), 5) AS score FROM b2 WHERE pos <= 50"""
    )
)
def full_text_baseline(spark, sf_dir):
    found = evaluate.full_text_baseline(part_catalog(spark, sf_dir), batch(spark))
    return found.withColumn("score", F.round(F.col("score").cast("double"), 5))


# -- hits ------------------------------------------------------------------------------
@registered(
    search(
        f"""{_DISTINCT} SELECT q0.qid, coalesce(bool_or(pos <= 1 AND m), false) AS hit1, coalesce(bool_or(pos <= 3 AND m), false) AS hit3, coalesce(bool_or(pos <= 10 AND m), false) AS hit10
FROM q0 LEFT JOIN (SELECT h.qid, h.pos, regexp_matches(lower(d.name || ' ' || d.other_names), '(^| )red ?widget') AS m FROM dist h JOIN d USING (id)) x ON x.qid = q0.qid GROUP BY 1""",
        _FULL,
    )
)
def carries_relevance(spark, sf_dir):
    c = part_catalog(spark, sf_dir)
    found = group.query_distinct(c, batch(spark)).join(c.documents.select("id", "name", "other_names"), "id")
    cases = batch(spark).select("qid", F.lit("Red Widget").alias("expect"))
    return evaluate.hit_at_k(cases, found, relevant=evaluate.relevant_by_words(F.col("expect"))).drop("expect")


_LISTED, _ANSWER = _SUGGEST.split("SELECT qid, CAST(ord", 1)[0], "SELECT qid, CAST(ord" + _SUGGEST.split("SELECT qid, CAST(ord", 1)[1]


@registered(search(f"{_LISTED}, s AS ({_ANSWER}) SELECT p.qid, coalesce(bool_or(pos <= 1 AND contains(name, 'widget')), false) AS hit1, coalesce(bool_or(pos <= 8 AND contains(name, 'widget')), false) AS hit8 FROM q0 p LEFT JOIN s ON s.qid = p.qid GROUP BY 1", _PRE))
def prefix_hits(spark, sf_dir):
    q = plain(spark, PREFIXES)
    return evaluate.prefix_hits(q.select("qid", F.lit("WIDGET").alias("expect")), group.suggest(part_catalog(spark, sf_dir), q)).drop("expect")


@registered("WITH c AS (SELECT c_mktsegment AS set, c_custkey AS qid, row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS i FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')) SELECT set, qid FROM c WHERE i % 3 = 0")
def choose_sets(spark, sf_dir):
    cases = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("set"), F.col("c_custkey").alias("qid"))
    return evaluate.choose_sets(cases, ["BUILDING", "MACHINERY", "AUTOMOBILE"], 3)


# -- generators ------------------------------------------------------------------------
EARLIER = [("red gear", "gear"), ("the plaet", "plate")]
_ELIGIBLE = f"""el AS (SELECT word, count(*) AS n_docs FROM (SELECT id, unnest(list_distinct(string_split(name_key, ' '))) AS word FROM d) WHERE regexp_full_match(word, '[a-z]+') AND length(word) >= 4 AND NOT list_contains({STOPS}, word) GROUP BY 1 HAVING count(*) >= 20),
free AS (SELECT word FROM el WHERE word NOT IN ('red', 'gear', 'the', 'plaet', 'plate'))"""


def _free(spark, sf_dir):
    c = part_catalog(spark, sf_dir)
    words = evaluate.eligible_words(c, 4, 20)
    return c, evaluate.unused(words, spark.createDataFrame(EARLIER, "q string, expect string"))


@registered(search(f", {_ELIGIBLE} SELECT word, n_docs FROM el JOIN free USING (word)", _TYPED))
def unused_words(spark, sf_dir):
    return _free(spark, sf_dir)[1].select("word", "n_docs")


@registered(
    search(
        f""", {_ELIGIBLE}, num AS (SELECT word, row_number() OVER (ORDER BY CAST(('0x' || substr(md5('1|' || word), 1, 8)) AS BIGINT), word) AS n FROM free),
tr AS (SELECT word, n, ['drop', 'swap', 'change', 'add'][((n - 1) % 4 + 1)::INT] AS edit, t, CAST(('0x' || substr(md5('1|at|' || t || '|' || word), 1, 8)) AS BIGINT) AS da, CAST(('0x' || substr(md5('1|letter|' || t || '|' || word), 1, 8)) AS BIGINT) AS dl FROM num, range(1, 11) r(t) WHERE n <= 8),
p AS (SELECT *, CAST(da % greatest(length(word) - CASE WHEN edit = 'swap' THEN 2 ELSE 1 END, 1) + 2 AS INT) AS i, substr('abcdefghijklmnopqrstuvwxyz', CAST(dl % 26 + 1 AS INT), 1) AS l FROM tr),
m AS (SELECT *, left(word, i - 1) || CASE edit WHEN 'drop' THEN substr(word, i + 1) WHEN 'swap' THEN substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2) WHEN 'change' THEN l || substr(word, i + 1) ELSE l || substr(word, i) END AS q FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY t) AS k FROM m WHERE q <> word AND q NOT IN (SELECT word FROM v))
SELECT q, word AS expect, 'typo' AS kind, edit FROM f WHERE k = 1 UNION ALL SELECT word, word, 'control', NULL FROM num WHERE n > 8 AND n <= 12""",
        _TYPED,
    )
)
def misspellings(spark, sf_dir):
    c, words = _free(spark, sf_dir)
    return evaluate.misspellings(words, c, 1, 8, 4)


@registered(search(f", {_ELIGIBLE} SELECT left(word, CAST(k AS INT)) AS q, word AS expect FROM free, LATERAL (SELECT unnest(range(4, length(word))) AS k) WHERE length(word) > 4 AND left(word, CAST(k AS INT)) NOT IN (SELECT word FROM v)", _TYPED))
def truncations(spark, sf_dir):
    c, words = _free(spark, sf_dir)
    return evaluate.truncations(words, c)


RARE, COMMON = ["ping", "gear", "bear", "bears", "bean"], ["bear", "ring", "gear"]


@registered(
    f"""WITH letters AS (SELECT unnest(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' ')) AS c),
f AS (SELECT p_partkey AS k, unnest([CASE WHEN p_partkey < 5 THEN {_list(RARE)}[p_partkey + 1] ELSE {_list(COMMON)}[p_partkey % 3 + 1] END, 'part']) AS word FROM part), s AS (SELECT k, word, CASE word WHEN 'bears' THEN 'bear' ELSE word END AS stem FROM f),
w AS (SELECT DISTINCT word, stem, n FROM s JOIN (SELECT stem, count(DISTINCT k) AS n FROM s GROUP BY 1) USING (stem))
SELECT word AS q, first(near ORDER BY n DESC, near) AS near FROM (SELECT a.word, b.word AS near, b.n FROM w a JOIN {_edits('w')} e ON e.word = a.word JOIN w b ON b.word = e.edit WHERE a.stem <> b.stem AND b.n >= 10 * a.n) GROUP BY 1"""
)
def near_words(spark, sf_dir):
    """A small vocabulary: nearly all parts are bears, rings and gears, a few are named like them."""
    k = F.col("p_partkey")
    pick = lambda xs, i: F.get(F.array(*(F.lit(x) for x in xs)), i.cast("int"))
    word = F.when(k < 5, pick(RARE, k)).otherwise(pick(COMMON, k % 3))
    empty = [F.lit(None).cast(t).alias(c) for c, t in catalog.SOURCE.items() if c not in ("id", "name")]
    src = table(spark, sf_dir, "part").select(k.cast("string").alias("id"), F.concat_ws(" ", word, F.lit("part")).alias("name"), *empty)
    return evaluate.near_words(catalog.build(src))


# -- sources ---------------------------------------------------------------------------
_PRODUCTS = """p AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS id, p_name AS description, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN upper(split_part(p_name, ' ', 1)) WHEN 2 THEN 'Acme-Co' ELSE p_brand END AS brand, p_type AS owner, CASE WHEN p_size < 5 THEN NULL ELSE p_type END AS category FROM part)"""


@registered(
    f"""WITH {_PRODUCTS}, w AS (SELECT *, ' ' || trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')) || ' ' AS dw, ' ' || trim(regexp_replace(lower(brand), '[^a-z0-9]+', ' ', 'g')) || ' ' AS bw FROM p),
n AS (SELECT *, CASE WHEN brand IS NULL OR contains(dw, bw) THEN description ELSE brand || ' ' || description END AS name FROM w)
SELECT id, name, owner AS other_names, category AS f_category, brand AS f_brand, CAST(count(*) OVER (PARTITION BY trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'))) AS FLOAT) AS rank FROM n"""
)
def product_source(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    four = F.col("p_partkey") % 4
    brand = F.when(four == 0, F.lit(None)).when(four == 1, F.upper(F.split("p_name", " ")[0])).when(four == 2, "Acme-Co").otherwise(F.col("p_brand"))
    products = part.select(F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("gtin_upc"), F.col("p_name").alias("description"), brand.alias("brand_name"), F.col("p_type").alias("brand_owner"), F.when(F.col("p_size") >= 5, F.col("p_type")).alias("category"))
    return demo.product_source(products).select("id", "name", "other_names", F.col("facets")["category"].alias("f_category"), F.col("facets")["brand"].alias("f_brand"), "rank")


def _folder(spark, tag):
    return f"{shared_dir(spark)}/shelfmark-{tag}-{uuid.uuid4().hex}"


_CSV = "SELECT CAST(s_suppkey AS VARCHAR) AS k, s_name || ', \"' || s_suppkey || '\"' AS name FROM supplier"


def _csv(spark, sf_dir, codec):
    path = _folder(spark, "csv")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("a"), F.concat("s_name", F.lit(', "'), "s_suppkey", F.lit('"')).alias("b"))
    rows.write.option("header", True).option("escape", '"').option("compression", codec).csv(path)
    return demo.read_csv(spark, path, ["k", "name"])


@registered(_CSV)
def csv_scan(spark, sf_dir):
    return _csv(spark, sf_dir, "none")


@registered(_CSV)
def gzip_csv_scan(spark, sf_dir):
    return _csv(spark, sf_dir, "gzip")


@registered("SELECT c_name AS q, c_mktsegment AS kind, CAST(NULL AS VARCHAR) AS edit, CAST(c_custkey AS VARCHAR) AS expect FROM customer")
def case_scan(spark, sf_dir):
    path = _folder(spark, "cases")
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("q"), F.col("c_mktsegment").alias("kind"), F.col("c_custkey").cast("string").alias("expect"))
    for name, rest, wrap in (("plain", 0, "%s"), ("wrapped", 1, '{"source": "a list", "cases": %s}')):
        rows = c.where(F.col("expect").cast("long") % 2 == rest).agg(F.to_json(F.collect_list(F.struct("q", "kind", "expect"))))
        write_text(spark, f"{path}/{name}.json", wrap % rows.first()[0])  # a set is one file
    return demo.read_cases(spark, f"{path}/plain.json").unionByName(demo.read_cases(spark, f"{path}/wrapped.json"))


@registered("SELECT r.run, o_orderkey AS id, o_orderstatus AS status, 'shelf ' || r.run AS source FROM orders, (VALUES ('run-0', 0), ('run-1', 1)) r(run, i) WHERE o_orderkey % 2 = r.i")
def run_scan(spark, sf_dir):
    path = _folder(spark, "runs")
    for i in (0, 1):
        rows = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 2 == i).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
        demo.write_run(rows, f"{path}/run-{i}", {"source": f"shelf run-{i}"})
    return demo.read_runs(spark, [f"{path}/run-{i}" for i in (0, 1)], "id long, status string").select("run", "id", "status", F.col("meta")["source"].alias("source"))


@registered("SELECT c_custkey % 7 AS k, c_custkey AS v FROM customer WHERE c_custkey % 2 = 1")
def swapped_load(spark, sf_dir):
    """A load that replaces an older one."""
    path = _folder(spark, "load")
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 7).alias("k"), F.col("c_custkey").alias("v"))
    demo.load_all_or_nothing(rows, path)
    demo.load_all_or_nothing(rows.where("v % 2 = 1"), path, replace=True)
    return spark.read.parquet(path)


PAIRS = ["wigdet->widget", "wigdet->gear", " blot->bolt ", "Plaet->plate", "rnig->ring, rung", "gaer -> gear", "bolt->bolt", "x1->bolt", "redd->red", "anivl->anvil", "no arrow", "smallll->small"]


@registered(search(", f AS (SELECT q, expect, i FROM (VALUES ('wigdet', 'widget', 1), ('wigdet', 'gear', 2), ('blot', 'bolt', 3), ('anivl', 'anvil', 4), ('smallll', 'small', 5)) t(q, expect, i) JOIN v ON v.word = expect AND doc_count >= 20) SELECT q, first(expect ORDER BY i) AS expect FROM f GROUP BY 1", _TYPED))
def misspelling_pairs(spark, sf_dir):
    lines = spark.createDataFrame(list(enumerate(PAIRS)), "n long, value string")
    used = evaluate.used_words(spark.createDataFrame(EARLIER, "q string, expect string"))
    return demo.misspelling_pairs(lines, part_catalog(spark, sf_dir).words, used)


# -- records ---------------------------------------------------------------------------
SETS = ["hand-written", "held-out", "synthetic", *report.numbered("synthetic-test", 5), "wikipedia", *report.numbered("truncation", 4), "near-words", "near-words-test", "absent"]
WORDS = ["anvil", "bolt", "gear", "plate", "ring", "widget"]
RECORDED = {"plain": 1, "sql": 2, "judged": 3, "followed_judged": 4, "followed_norvig": 5, "followed_frequency": 6, "followed_wide": 8}


def records(spark, sf_dir, shift: int = 0) -> DataFrame:
    """Customers as queries, three runs of each; all outcomes follow from the key and the run."""
    k, run = F.col("c_custkey"), F.col("run")
    pick = lambda xs, i: F.element_at(F.array(*(F.lit(x) for x in xs)), (i + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*(F.lit(i) for i in range(3)))).alias("run"))
    expect = pick(WORDS, k % 6)
    kind = F.when(k % 4 == 0, "control").otherwise("typo")
    cut = F.substr(expect, F.lit(1), F.length(expect) - 1 - (k % 2).cast("int"))
    q = F.concat_ws(" ", F.when(kind == "control", expect).when(k % 5 == 0, "blue").otherwise(cut), k.cast("string"))
    value = lambda j: (k * j + run * 5 + shift) % 7
    one = lambda j: F.struct((k * j % 4).cast("int").alias("n"), (value(j) < 3).alias("hit1"), (value(j) < 5).alias("hit10"))
    out = [F.when((k + j + run) % 3 != 0, one(j)).alias(s) if s.startswith("followed") else one(j).alias(s) for s, j in RECORDED.items()]
    said = F.when((k + 4 + run) % 3 != 0, F.when(k % 2 == 0, F.concat_ws(" ", expect, k.cast("string"))).otherwise("bolt"))
    status = F.when(k % 9 == 1, "failed").when(k % 3 == 0, "skipped").otherwise("ran")
    return rows.select(
        "run", pick(SETS, k % len(SETS)).alias("set"), kind.alias("kind"), q.alias("q"), F.concat_ws(" ", expect, k.cast("string")).alias("expect"), *out, said.alias("suggested"),
        ((k + run) % 5 == 0).alias("no_match"), status.alias("status"), F.when(k % 2 == 0, "page").otherwise("other").alias("question"), (k * 13 + run).cast("double").alias("tokens"), (k * 17 % 500 + run).alias("ms"),
        (k * 3 % 4).cast("int").alias("n_results"), F.array(F.lit("bolt"), F.concat_ws(" ", F.when(k % 3 == 0, expect).otherwise("gear"), k.cast("string"))).alias("options"), (k % 2 == 0).alias("real_word"), (k % 3 == 0).alias("searchable"),
    )


def _value(j, shift=0):
    return f"((k * {j} + run * 5 + {shift}) % 7)"


def _rec(shift=0):
    """SQL: the rows of ``records``; h1_s and h10_s are null where s was not recorded."""
    has = lambda s, j: f"(k + {j} + run) % 3 <> 0" if s.startswith("followed") else "true"
    hits = ", ".join(f"CASE WHEN {has(s, j)} THEN {_value(j, shift)} < {top} END AS h{at}_{s}" for s, j in RECORDED.items() for at, top in ((1, 3), (10, 5)))
    return f"""(SELECT run, k, set, kind, CASE WHEN kind = 'control' THEN w WHEN k % 5 = 0 THEN 'blue' ELSE left(w, CAST(length(w) - 1 - k % 2 AS INT)) END || ' ' || k AS q, w || ' ' || k AS expect, {hits},
CASE WHEN (k + 4 + run) % 3 <> 0 THEN CASE WHEN k % 2 = 0 THEN w || ' ' || k ELSE 'bolt' END END AS suggested, (k + run) % 5 = 0 AS no_match, CASE WHEN k % 9 = 1 THEN 'failed' WHEN k % 3 = 0 THEN 'skipped' ELSE 'ran' END AS status,
CASE WHEN k % 2 = 0 THEN 'page' ELSE 'other' END AS question, CAST(k * 13 + run AS DOUBLE) AS tokens, k * 17 % 500 + run AS ms, k * 3 % 4 AS n_results, CASE WHEN k % 3 = 0 THEN w ELSE 'gear' END || ' ' || k AS option, k % 2 = 0 AS real_word, k % 3 = 0 AS searchable
FROM (SELECT run, c_custkey AS k, {_list(SETS)}[CAST(c_custkey % {len(SETS)} + 1 AS INT)] AS set, CASE WHEN c_custkey % 4 = 0 THEN 'control' ELSE 'typo' END AS kind, {_list(WORDS)}[CAST(c_custkey % 6 + 1 AS INT)] AS w FROM customer, (VALUES (0), (1), (2)) r(run)))"""


def _outcome(system, at=1):
    return f"coalesce({', '.join(f'h{at}_{s}' for s in report.SYSTEMS[system])})"


def _long(shift=0):
    """SQL: (run, set, q, ..., system, hit1, hit10), one row for each system."""
    return "(" + " UNION ALL ".join(f"SELECT *, '{s}' AS system, {_outcome(s)} AS hit1, {_outcome(s, 10)} AS hit10 FROM {_rec(shift)}" for s in report.SYSTEMS) + ")"


def _group_sql() -> dict[str, str]:
    """The 43 groups as SQL conditions, from their names."""
    out = {}
    for name in [*["hand-written", "held-out", "synthetic"], *report.numbered("synthetic-test", 5)]:
        out |= {name: f"set = '{name}'", f"{name}, misspelled": f"set = '{name}' AND kind = 'typo'"}
        if name != "hand-written":
            out[f"{name}, correctly spelled"] = f"set = '{name}' AND kind = 'control'"
    for name in report.numbered("truncation", 4):
        out |= {name: f"set = '{name}'", f"{name}, one letter cut": f"set = '{name}' AND length(expect) - length(q) = 1", f"{name}, two or more letters cut": f"set = '{name}' AND length(expect) - length(q) >= 2"}
    for suffix, more in (("", "true"), (", real-word errors", "real_word"), (", non-word errors", "NOT real_word"), (", searchable words (post hoc)", "searchable")):
        out[f"wikipedia{suffix}"] = f"set = 'wikipedia' AND {more}"
    out |= {"out-of-sample (held-out and synthetic)": "set IN ('held-out', 'synthetic')", "test (synthetic-test and wikipedia)": "set IN ('synthetic-test', 'wikipedia')"}
    return out | {n: f"set = '{n}'" for n in ("near-words", "near-words-test")}


_GROUPS = _group_sql()
_GROUPED = "unnest(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _GROUPS.items()) + "], lambda x: x IS NOT NULL))"


def _p(b, c):
    """SQL: McNemar's exact p of two counts."""
    n = f"({b} + {c})"
    return f"(CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({b}, {c}) + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2.0))))) END)"


def _low_high(k, n):
    p = f"({k} / {n})"
    wide = f"{_Z} * sqrt({p} * (1 - {p}) / {n} + {_Z} * {_Z} / (4.0 * {n} * {n}))"
    both = [f"(({p} + {_Z} * {_Z} / (2 * {n}) {sign} {wide}) / (1 + {_Z} * {_Z} / {n}))" for sign in "-+"]
    return f"round(greatest({both[0]}, 0.0), 6) AS low, round(least({both[1]}, 1.0), 6) AS high"


def _rounded(df, *cols):
    return df.select(*(F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns))


@registered(f"SELECT run, set, q, system, hit1, hit10 FROM {_long()}")
def outcomes(spark, sf_dir):
    return evaluate.outcomes(records(spark, sf_dir), report.SYSTEMS).select("run", "set", "q", "system", "hit1", "hit10")


@registered(f'SELECT "group", count(*) AS n, count(DISTINCT q) AS queries FROM (SELECT *, {_GROUPED} AS "group" FROM {_rec()}) GROUP BY 1')
def in_groups(spark, sf_dir):
    return evaluate.in_groups(records(spark, sf_dir), report.groups()).groupBy("group").agg(F.count("*").alias("n"), F.count_distinct("q").alias("queries"))


def _cells(long):
    return f"""(SELECT "group", system, n, CAST(median AS BIGINT) AS median, least, most, {_low_high('median', 'n')} FROM (SELECT "group", system, max(n) AS n, list_sort(list(h))[CAST(floor(0.5 * (count(*) - 1)) AS INT) + 1] AS median, min(h) AS least, max(h) AS most
FROM (SELECT run, "group", system, count(*) AS n, CAST(sum(CASE WHEN hit1 THEN 1 ELSE 0 END) AS BIGINT) AS h FROM (SELECT *, {_GROUPED} AS "group" FROM {long}) GROUP BY ALL) GROUP BY 1, 2))"""


@registered(f"SELECT * FROM {_cells(_long())}")
def group_cells(spark, sf_dir):
    return _rounded(report.system_cells(records(spark, sf_dir), report.groups()), "low", "high")


@registered(f"SELECT * FROM (SELECT 'old' AS version, * FROM {_cells(_long(2))} UNION ALL SELECT 'new', * FROM {_cells(_long())}) WHERE system IN ('spelling_only', 'both')")
def version_cells(spark, sf_dir):
    runs = {"old": records(spark, sf_dir, 2), "new": records(spark, sf_dir)}
    return _rounded(report.versions(runs, report.groups()), "low", "high")


_PAIRED = " UNION ALL ".join(f"SELECT run, \"group\", '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {_outcome(a)} AND NOT {_outcome(b)}) AS oa, count(*) FILTER (WHERE NOT {_outcome(a)} AND {_outcome(b)}) AS ob FROM gr GROUP BY run, \"group\"" for a, b in report.PAIRS)


@registered(
    f"""WITH gr AS (SELECT * FROM (SELECT *, {_GROUPED} AS "group" FROM {_rec()}) WHERE NOT contains("group", 'correctly')), t AS (SELECT *, {_p('oa', 'ob')} AS p FROM ({_PAIRED}))
SELECT "group", a, b, min(oa) AS only_a_least, max(oa) AS only_a_most, min(ob) AS only_b_least, max(ob) AS only_b_most, round(min(p), 6) AS p_least, round(max(p), 6) AS p_most FROM t GROUP BY 1, 2, 3"""
)
def pair_tests(spark, sf_dir):
    return _rounded(report.pair_tests(records(spark, sf_dir), report.groups()), "p_least", "p_most")


CLAIMS = [("synthetic-test-5", "spelling_only"), ("truncation-4", "both"), ("truncation-4", "sql")]


@registered(
    f"""WITH b AS (SELECT DISTINCT set, q, system, hit1 FROM {_long(3)} WHERE run = 0), t AS (SELECT a.run, a.set, a.system, count(*) FILTER (WHERE a.hit1 AND NOT b.hit1) AS only_a, count(*) FILTER (WHERE NOT a.hit1 AND b.hit1) AS only_b
FROM {_long()} a JOIN b ON a.set = b.set AND a.q = b.q AND a.system = b.system WHERE {' OR '.join(f"(a.set = '{s}' AND a.system = '{x}')" for s, x in CLAIMS)} GROUP BY 1, 2, 3),
u AS (SELECT *, {_p('only_a', 'only_b')} AS p FROM t), h AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY run) - row_number() OVER (PARTITION BY run ORDER BY p) + 1) * p) AS x FROM u)
SELECT run, set, system, only_a, only_b, round(p, 6) AS p, round(max(x) OVER (PARTITION BY run ORDER BY p ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM h"""
)
def version_tests(spark, sf_dir):
    before = records(spark, sf_dir, 3).where("run = 0")
    return _rounded(report.version_tests(records(spark, sf_dir), before, CLAIMS), "p", "p_holm")


@registered(f"""WITH k AS (SELECT DISTINCT unnest({TOK.format('p_name')}) AS word FROM part), r AS (SELECT *, list_filter(string_split(q, ' '), lambda t: NOT list_contains(string_split(expect, ' '), t)) AS wrong FROM {_rec()})
SELECT run, set, q, len(wrong) > 0 AND len(list_filter(wrong, lambda t: list_contains(ws, t))) = len(wrong) AS real_word, true AS searchable FROM r, (SELECT list(word) AS ws FROM k)""")
def known_flags(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(tx.tokens(F.col("p_name"))).alias("word")).distinct()
    rows = records(spark, sf_dir).select("run", "set", "q", "expect")
    return report.known_flags(rows, words, stop_array()).drop("expect")


@registered(f"SELECT count(*) AS queries, count(*) FILTER (WHERE a > 1) AS changed FROM (SELECT set, q, count(DISTINCT coalesce(suggested, chr(0))) AS a, bool_or(suggested IS NOT NULL) AS shown FROM {_rec()} GROUP BY 1, 2) WHERE shown")
def stability(spark, sf_dir):
    return report.stability(records(spark, sf_dir), "suggested", F.col("suggested").isNotNull())


@registered(f"SELECT set, count(*) AS n, count(*) FILTER (WHERE a > 1) AS changed FROM (SELECT set, q, count(DISTINCT no_match) AS a FROM {_rec()} GROUP BY 1, 2) GROUP BY 1")
def unstable(spark, sf_dir):
    return evaluate.unstable(records(spark, sf_dir), ["set"], "no_match")


@registered(f"SELECT set, count(*) AS n, count(*) FILTER (WHERE n_results = 0) AS empty, count(*) FILTER (WHERE n_results <> 0 AND no_match AND suggested IS NULL) AS flagged FROM {_rec()} GROUP BY 1")
def no_match_accounting(spark, sf_dir):
    return evaluate.no_match_accounting(records(spark, sf_dir).withColumnRenamed("suggested", "suggestion"), ["set"])


_Q = "list_sort(list(ms))[CAST(floor({0} * (count(*) - 1)) AS INT) + 1]"


@registered(f"SELECT run, {_Q.format(0.5)} AS p50, {_Q.format(0.9)} AS p90, {_Q.format(0.99)} AS p99 FROM {_rec()} GROUP BY 1")
def latency(spark, sf_dir):
    return evaluate.latency(records(spark, sf_dir), ["run"])


@registered(f"SELECT set, round(avg(tokens) * 0.042 / 1e6, 9) AS per_search, round(CAST(count(*) * 0.5 + sum(n_results) * 0.25 AS DOUBLE), 6) AS hosted FROM {_rec()} GROUP BY 1")
def costs(spark, sf_dir):
    g = records(spark, sf_dir).groupBy("set").agg(F.avg("tokens").alias("t"), F.count("*").alias("n"), F.sum("n_results").alias("r"))
    return g.select("set", F.round(stats.token_cost(F.col("t"), 0.042), 9).alias("per_search"), F.round(stats.host_cost(F.col("n"), F.col("r"), 0.5, 0.25), 6).alias("hosted"))


@registered(f"""SELECT question, count(*) FILTER (WHERE status = 'ran') AS ran, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed,
round(avg(tokens) FILTER (WHERE question = 'page' AND status = 'ran'), 6) AS mean_tokens, round(avg(ms) FILTER (WHERE question = 'page' AND status = 'ran'), 6) AS mean_ms FROM {_rec()} GROUP BY 1""")
def call_accounting(spark, sf_dir):
    return _rounded(evaluate.call_accounting(records(spark, sf_dir)), "mean_tokens", "mean_ms")


@registered(f"""SELECT kind, count(*) AS n, count(suggested) AS offered, count(*) FILTER (WHERE CASE WHEN kind = 'control' THEN suggested IS NULL ELSE suggested = expect END) AS "right" FROM {_rec()} GROUP BY 1""")
def spelling_scores(spark, sf_dir):
    return evaluate.spelling_scores(records(spark, sf_dir))


@registered(f"""SELECT count(*) AS n, count(*) FILTER (WHERE n_results = 0 OR (no_match AND suggested IS NULL)) AS "right" FROM {_rec()} WHERE set = 'absent'""")
def absent_scores(spark, sf_dir):
    return evaluate.absent_scores(records(spark, sf_dir).where("set = 'absent'").withColumnRenamed("suggested", "suggestion"))


@registered(f"""SELECT count(*) AS n, count(*) FILTER (WHERE suggested = expect) AS "right", count(*) FILTER (WHERE suggested <> expect) AS wrong FROM {_rec()} WHERE starts_with(set, 'truncation')""")
def cut_word_scores(spark, sf_dir):
    return evaluate.cut_word_scores(records(spark, sf_dir).where(F.startswith("set", F.lit("truncation"))))


@registered(f"SELECT count(*) AS offered, count(*) FILTER (WHERE suggested = expect) AS picked FROM {_rec()} WHERE kind = 'typo' AND (option = expect OR expect = 'bolt')")
def picked_when_offered(spark, sf_dir):
    return evaluate.picked_when_offered(records(spark, sf_dir))


_COUNTS = """count(*) AS n, count(*) FILTER (WHERE kind = 'typo' AND said = expect) AS fixed, count(*) FILTER (WHERE kind = 'typo' AND said <> expect) AS wrong, count(*) FILTER (WHERE kind = 'typo' AND said IS NULL) AS missed,
count(*) FILTER (WHERE kind = 'control' AND said IS NOT NULL) AS false_alarms, count(said) AS offered, round(count(*) FILTER (WHERE kind = 'typo' AND said = expect) / nullif(count(said), 0), 6) AS "precision\""""


@registered(f"SELECT rule, {_COUNTS} FROM (SELECT kind, expect, 'all' AS rule, suggested AS said FROM {_rec()} UNION ALL SELECT kind, expect, 'strict', CASE WHEN ms >= 200 THEN suggested END FROM {_rec()} UNION ALL SELECT kind, expect, 'cascade', coalesce(CASE WHEN run = 1 THEN 'bolt' END, suggested) FROM {_rec()}) GROUP BY 1")
def rule_comparison(spark, sf_dir):
    said = F.col("suggested")
    rules = {"all": said, "strict": F.when(F.col("ms") >= 200, said), "cascade": evaluate.cascade(F.when(F.col("run") == 1, "bolt"), said)}
    return _rounded(evaluate.rule_comparison(records(spark, sf_dir), rules), "precision")


@registered(
    f"""WITH r AS (SELECT kind, split_part(q, ' ', 1) AS q, split_part(expect, ' ', 1) AS expect FROM {_rec()})
SELECT CASE WHEN kind = 'typo' AND q = left(expect, length(expect) - 1) THEN 'last letter' WHEN kind = 'typo' THEN 'drop' ELSE 'none' END AS edit_type, CASE WHEN q IN ('blue', 'bolt') THEN 'real-word' ELSE 'non-word' END AS error_type, count(*) AS n FROM r GROUP BY 1, 2"""
)
def edit_and_error_types(spark, sf_dir):
    first = lambda c: F.split(c, " ")[0]
    edit = F.when(F.col("kind") == "typo", "drop").otherwise("none")
    rows = records(spark, sf_dir).select(evaluate.edit_type(first("q"), first("expect"), edit).alias("edit_type"), evaluate.error_type(F.array(first("q")), F.array(F.lit("blue"), F.lit("bolt"))).alias("error_type"))
    return rows.groupBy("edit_type", "error_type").agg(F.count("*").alias("n"))


@registered(f"SELECT w AS word, w IN (SELECT DISTINCT unnest({TOK.format('p_name')}) FROM part) OR w IN (SELECT DISTINCT unnest({TOK.format('p_brand || chr(32) || p_type')}) FROM part) AS known, list_contains({STOPS}, w) AS stop FROM (VALUES ('blue'), ('bleu'), ('the'), ('economy'), ('13')) t(w)")
def known_words(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in ("blue", "bleu", "the", "economy", "13")], "word string")
    return evaluate.known_words(part_catalog(spark, sf_dir), words).select("word", "known", "stop")


@registered(
    f"""WITH s AS ({_L}), o AS (SELECT doc_id AS id, CASE WHEN toxic THEN 'control' ELSE 'typo' END AS kind, p, n_chars FROM s),
r AS (SELECT round(0.2 + 0.05 * i, 2) AS floor, kind, p >= round(0.2 + 0.05 * i, 2) AND p > 0 AND p >= 2 * (n_chars % 7) / 10.0 AS said, n_chars % 2 = 0 AS ok FROM o, range(0, 16) t(i)),
g AS (SELECT floor, count(*) FILTER (WHERE kind = 'typo') AS typos, count(*) FILTER (WHERE kind = 'control') AS controls, count(*) FILTER (WHERE kind = 'typo' AND said AND ok) AS fixed, count(*) FILTER (WHERE kind = 'typo' AND said AND NOT ok) AS wrong, count(*) FILTER (WHERE kind = 'control' AND said) AS alarms FROM r GROUP BY 1)
SELECT CAST(floor AS DOUBLE) AS floor, round(fixed / typos, 6) AS recall, round(alarms / controls, 6) AS false_rate, round(fixed / greatest(fixed + wrong + alarms, 1), 6) AS "precision" FROM g"""
)
def threshold_sweep(spark, sf_dir):
    """Three options a document: as typed, one of probability p, one below it."""
    d = _labels(spark, sf_dir)
    meant = F.when(F.col("n_chars") % 2 == 0, "Word one").otherwise("other")
    options = F.array(F.struct(F.lit(0).alias("n"), F.lit("typed").alias("text"), (F.col("n_chars") % 7 / 10.0).alias("p")), F.struct(F.lit(1).alias("n"), F.lit("word ONE").alias("text"), F.col("p").alias("p")), F.struct(F.lit(2).alias("n"), F.lit("less").alias("text"), (F.col("p") / 2).alias("p")))
    rows = d.select(F.col("doc_id").alias("id"), F.when(F.col("toxic"), "control").otherwise("typo").alias("kind"), meant.alias("expect"), F.explode(options).alias("o"))
    return _rounded(report.threshold_sweep(rows.select("id", "kind", "expect", "o.*")), "recall", "false_rate", "precision")


# -- pages -----------------------------------------------------------------------------
@registered("SELECT * FROM (VALUES (1, 'kept'), (2, 'kept'), (3, 'sunk')) t(qid, what)")
def judged_page(spark, sf_dir):
    """Scorers that answer, that fail, and that answer low: only the last changes a page."""
    c = part_catalog(spark, sf_dir)
    q = plain(spark, [(1, "red", 10), (2, "red", 10), (3, "red", 10)])

    def score(pdf):
        if pdf["qid"].iloc[0] == 2:
            raise ValueError("no answer")
        return [0.0 if pdf["qid"].iloc[0] == 3 and i == 0 else 0.9 for i in pdf["idx"]]

    page, _ = judge.search_page(c, q, lambda rows: judge.with_scores(rows, score))
    return page.groupBy("qid").agg(F.when(F.max("sunk"), "sunk").otherwise("kept").alias("what")).select(F.col("qid").cast("int").alias("qid"), "what")


@registered(
    search(
        f"""{_DISTINCT}, judged AS (SELECT h.qid, h.pos, d.name, d.other_names FROM dist h JOIN d USING (id))
SELECT q0.qid, 'sql' AS system, count(j.qid) AS n, coalesce(bool_or(pos = 1 AND contains(name, 'widget')), false) AS hit1, coalesce(bool_or(pos <= 10 AND contains(name, 'widget')), false) AS hit10, max(CASE WHEN pos = 1 THEN name END) AS top FROM q0 LEFT JOIN judged j ON j.qid = q0.qid GROUP BY 1""",
        _FULL,
    )
)
def three_way(spark, sf_dir):
    """The comparison of plain, full, judged and followed searches; the rows of the full search beside SQL."""
    return compared(spark, sf_dir).where("system = 'sql'")


def compared(spark, sf_dir) -> DataFrame:
    c, q = part_catalog(spark, sf_dir), batch(spark)
    names = c.documents.select("id", "name", "other_names")
    similar = spell.similar_words(c, q)
    said = spell.norvig(c, q).select("qid", F.lit("norvig").alias("system"), F.col("corrected").alias("suggestion"))
    said = said.unionByName(spell.frequency_rule(q, similar).select("qid", F.lit("frequency").alias("system"), F.col("corrected").alias("suggestion")))
    said = checkpointed(said)
    texts = said.where("suggestion is not null").select(F.col("suggestion").alias("q")).distinct().withColumn("qid", F.xxhash64("q"))
    more = group.query_distinct(c, texts.select("qid", "q", F.lit(None).cast("map<string,string>").alias("filters"), F.lit(50).alias("lim"))).join(texts, "qid").drop("qid")
    own = group.query_distinct(c, q).join(q.select("qid", "q"), "qid")
    # A case's own text is its key here, so that cases with one text but other filters stay apart.
    keyed = q.withColumn("q", F.concat(F.lit("\0"), F.col("qid")))
    found = own.withColumn("q", F.concat(F.lit("\0"), F.col("qid"))).drop("qid").unionByName(more).join(names, "id").select("q", "pos", "name", "other_names")
    pages = own.join(names, "id").select("qid", "pos", "name", "other_names")
    base = evaluate.full_text_baseline(c, q).join(names, "id").select("qid", "pos", "name", "other_names")
    hits = lambda _, rows: rows.withColumn("relevant", F.contains("name", F.lit("widget")))
    return report.follow_each(keyed, said, found, base, pages, hits)


@registered(search(", f AS (SELECT qid, facet, value, count(*) AS c FROM (SELECT qid, unnest(['brand', 'type', 'size']) AS facet, unnest([brand, type, size]) AS value FROM hits JOIN d USING (id)) GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY qid, facet ORDER BY c DESC, value) AS r FROM f), h AS (SELECT qid, facet, string_agg(value || '=' || c, ',' ORDER BY r) AS vs FROM g WHERE r <= 2 GROUP BY 1, 2) SELECT qid, string_agg(facet || ':' || vs, ';' ORDER BY facet) AS facets FROM h GROUP BY 1", [(i, q, k, v, None) for i, q, k, v, _ in BATCH]))
def page_facets(spark, sf_dir):
    shaped = judge.shape_facets(group.facets(part_catalog(spark, sf_dir), batch(spark), 2))
    text = F.transform(F.map_entries("facets"), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(F.transform(e["value"], lambda x: F.concat(x["value"], F.lit("="), x["count"])), ",")))
    return shaped.select("qid", F.array_join(F.array_sort(text), ";").alias("facets"))
