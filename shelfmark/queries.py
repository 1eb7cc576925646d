"""Registered queries of the search engine on the driver tables, each beside SQL written on its own from the rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import catalog as cat
from .operators import evaluate, group, judge, retrieve, spell, stats
from .plans.durable import files_of, stored
from .sources import demo

#: (qid, q, filter key, filter value, lim)
BATCH = [
    (1, "red widget", None, None, 50), (2, "the Red WIDGETS", None, None, 50), (3, "widgte", None, None, 50), (4, "wid", None, None, 50), (5, "4000012", None, None, 50), (6, "red", "type", "ECONOMY", 50),
    (7, "", None, None, 50), (8, "blu bol", None, None, 5), (9, "gizm economy", None, None, None), (10, "the and", None, None, 50), (11, "004000", None, None, 20), (12, "red", "type", "NONE", 50),
    (13, "econom", None, None, 10), (14, "gaer", "type", "SMALL", 7), (15, "plate brand 7", None, None, 50), (16, "ri", None, None, 50), (17, "cold anvill", None, None, 9), (18, "0", None, None, 0),
]
PREFIXES = [(1, "re", 8), (2, "red", 3), (3, "widg", 8), (4, "sm", None), (5, "small gear", 8), (6, "", 8), (7, "bolts", 5)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    facets = F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_brand", "p_type").alias("other_names"), F.lit(None).cast("string").alias("group_key"),
        F.lpad((F.col("p_partkey") + 4000000).cast("string"), 12, "0").alias("code"), facets.alias("facets"), F.col("p_retailprice").cast("float").alias("rank"),
    )


_BUILT: dict[str, tuple[SparkSession, tuple, cat.Catalog]] = {}


def part_catalog(spark: SparkSession, sf_dir: str) -> cat.Catalog:
    """The catalog of ``part``: built by the first query of a session that asks for it, and anew once the files of
    ``part`` differ or a stored table is gone."""
    files = files_of(spark, f"{sf_dir}/part.parquet")
    session, seen, built = _BUILT.get(sf_dir, (None, (), None))
    if session is not spark or seen != files or not all(stored(getattr(built, f.name)) for f in fields(built)):
        built = cat.build(part_source(spark, sf_dir))
        _BUILT[sf_dir] = spark, files, built
    return built


def batch(spark: SparkSession, rows=BATCH) -> DataFrame:
    rows = [(i, q, {k: v} if k else None, n) for i, q, k, v, n in rows]
    return spark.createDataFrame(rows, "qid long, q string, filters map<string,string>, lim int")


def plain(spark: SparkSession, rows) -> DataFrame:
    return batch(spark, [(i, q, None, None, n) for i, q, n in rows])


def tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.tokens(F.col("text")), " ").alias("tokens"))


def documents(spark, sf_dir):
    d = part_catalog(spark, sf_dir).documents
    return d.select("id", "name_key", "code", F.array_join(F.array_sort("words"), " ").alias("words"), F.array_join("stems", " ").alias("stems"))


def names(spark, sf_dir):
    return part_catalog(spark, sf_dir).names.select("name_key", "name", "doc_count", "sample_id")


def words(spark, sf_dir):
    return part_catalog(spark, sf_dir).words.select("word", "doc_count", "stem", "match_count")


def waterfall(spark, sf_dir):
    return retrieve.search(part_catalog(spark, sf_dir), batch(spark))


def _step(name):
    def run(spark, sf_dir):
        c, q = part_catalog(spark, sf_dir), retrieve.parse(batch(spark))
        return getattr(retrieve, f"{name}_step")(q, c)

    return run


def query_distinct(spark, sf_dir):
    return group.query_distinct(part_catalog(spark, sf_dir), batch(spark))


def suggest(spark, sf_dir):
    return group.suggest(part_catalog(spark, sf_dir), plain(spark, PREFIXES))


def facets(spark, sf_dir):
    return group.facets(part_catalog(spark, sf_dir), batch(spark), 3)


def _name_pairs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    typed = spark.createDataFrame([("red widgte",), ("smal rng",), ("gizmo",), ("zzz",)], "typed string")
    return p.join(F.broadcast(typed))  # four rows against the distinct names


def trigram_similarity(spark, sf_dir):
    g = lambda c: tx.trigrams(tx.tokens(F.col(c)))
    return _name_pairs(spark, sf_dir).select("name", "typed", F.round(tx.similarity(g("typed"), g("name")).cast("double"), 5).alias("sim"))


def word_similarity(spark, sf_dir):
    sim = tx.word_similarity(tx.trigrams(tx.tokens(F.col("typed"))), tx.ordered_trigrams(tx.tokens(F.col("name"))))
    return _name_pairs(spark, sf_dir).select("name", "typed", F.round(sim.cast("double"), 5).alias("sim"))


def edits1(spark, sf_dir):
    w = table(spark, sf_dir, "part").select(F.explode(tx.tokens(F.col("p_name"))).alias("word")).distinct()
    return w.select("word", F.explode(tx.edits1(F.col("word"))).alias("edit"))


def edit_distance(spark, sf_dir):
    w = table(spark, sf_dir, "part").select(F.explode(tx.tokens(F.col("p_name"))).alias("a")).distinct()
    b = spark.createDataFrame([("widgte",), ("rde",), ("glod",), ("blue",), ("",)], "b string")
    return w.join(F.broadcast(b)).select("a", "b", tx.edit_distance(F.col("a"), F.col("b")).alias("edits"))


def keep_or_sink(spark, sf_dir):
    """Parts by brand as pages; the last digit of the key stands for the score."""
    n = F.row_number().over(cat.Window.partitionBy("p_brand").orderBy("p_partkey"))
    page = table(spark, sf_dir, "part").select(F.col("p_brand").alias("qid"), n.alias("pos"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("other_names"), F.col("p_name").alias("name_key"), F.lit(None).cast("string").alias("group_key"), F.lit("word").alias("step"), F.lit("red widget").alias("query"))
    scores = page.select("qid", (F.col("pos") - 1).alias("idx"), (F.col("id").cast("long") % 10 / 10.0).alias("score"))
    return judge.keep_or_sink(page, scores).select("qid", "id", F.col("new_pos").alias("pos"), "sunk", "reranked", "no_match")


def carries(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.carries(F.col("p_name"), F.lit("wid get")).alias("widget"), tx.carries(F.col("p_name"), F.lit("Réd w")).alias("red_w"))


def hit_at_k(spark, sf_dir):
    c = part_catalog(spark, sf_dir)
    cases = batch(spark).select("qid", F.lit("widget|gizmo").alias("expect"))
    found = retrieve.search(c, batch(spark)).join(c.documents.select("id", "name", "other_names"), "id")
    return evaluate.hit_at_k(cases, found, relevant=evaluate.relevant_by_pattern(F.col("expect"))).drop("expect")


def _labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", "lang", "source", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"), (F.col("n_chars") % 1000 / 1000.0).alias("p"), "n_chars")


def wilson(spark, sf_dir):
    g = _labels(spark, sf_dir).groupBy("source").agg(F.sum(F.col("good").cast("long")).alias("hits"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    return g.select("source", "hits", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def mcnemar(spark, sf_dir):
    return stats.paired(_labels(spark, sf_dir), ["lang"], "good", "toxic").withColumn("p", F.round("p", 6))


def holm(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("family"), "s_suppkey", (F.pmod(F.col("s_suppkey") * 37, F.lit(1009)) / 20000.0).alias("p"))
    return stats.holm(p, ["family"]).select("family", "s_suppkey", F.round("p_holm", 6).alias("p_holm"))


def quantile(spark, sf_dir):
    return stats.quantiles(_labels(spark, sf_dir), ["lang"], "n_chars", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


def auroc(spark, sf_dir):
    return stats.auroc(_labels(spark, sf_dir), "p", "good", ["lang"]).withColumn("auroc", F.round("auroc", 6))


def reliability(spark, sf_dir):
    r = stats.reliability(_labels(spark, sf_dir), "p", "good")
    return r.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("accuracy", 6).alias("accuracy"))


def calibration(spark, sf_dir):
    return stats.calibration(_labels(spark, sf_dir), "p", "good").select("n", F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"))


def correction_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("system"), F.when(F.col("user_id") % 4 == 0, "control").otherwise("typo").alias("kind"), (F.col("event_id") % 5).cast("string").alias("expect"), F.when(F.col("event_id") % 3 != 0, (F.col("user_id") % 5).cast("string")).alias("suggested"))
    return evaluate.correction_counts(rows, ["system"]).withColumn("precision", F.round("precision", 6))


def newest_per_code(spark, sf_dir):
    """Orders as releases: the customer is the code, the date decides; some of the newest are discontinued."""
    o = table(spark, sf_dir, "orders")
    branded = o.select(F.col("o_orderkey").cast("string").alias("fdc_id"), F.lpad(F.col("o_custkey").cast("string"), 8, "1").alias("gtin_upc"), F.col("o_orderdate").cast("date").cast("string").alias("modified_date"), F.when(F.col("o_orderkey") % 3 == 0, "2020-01-01").alias("discontinued_date"), F.lit("b").alias("brand_name"), F.lit("o").alias("brand_owner"), F.lit("c").alias("branded_food_category"))
    foods = o.select(F.col("o_orderkey").cast("string").alias("fdc_id"), F.col("o_orderstatus").alias("description"))
    return demo.newest_per_code(branded, foods).select("gtin_upc", "description", F.col("modified_date").cast("string").alias("modified_date"))


def hash_sample(spark, sf_dir):
    return demo.hash_sample(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), "c_name"), "k", 100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokens, documents, names, words, waterfall, query_distinct, suggest, facets, trigram_similarity, word_similarity, edits1, edit_distance,
        keep_or_sink, carries, hit_at_k, wilson, mcnemar, holm, quantile, auroc, reliability, calibration, correction_counts, newest_per_code, hash_sample,
    )
} | {f"{s}_step": _step(s) for s in retrieve.STEPS}
