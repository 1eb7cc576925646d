"""Four-step retrieval for batches of queries: the first step that finds anything answers alone.

``queries`` has qid, q, filters (map<string,string> or null) and lim (null: every match). Each
step sees only the queries no earlier step answered, and applies the filters before it counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stem import stemmed, stop_array
from ..plans.durable import checkpointed, release
from .catalog import Catalog, in_parts, prefix_join, top

STEPS = ("code", "word", "prefix", "typo")
TYPO = 0.5


def parse(queries: DataFrame) -> DataFrame:
    """qid, tokens, kept (no stop words), text, f, n; queries without a kept word are gone."""
    stops = stop_array()
    t = queries.withColumn("tokens", tx.query_tokens(F.col("q")))
    kept = F.filter("tokens", lambda w: ~F.array_contains(stops, w))
    n = F.when(F.col("lim").isNotNull(), F.least(F.greatest(F.col("lim"), F.lit(1)), F.lit(1000)))
    empty = F.create_map().cast("map<string,string>")
    return t.select("qid", "tokens", kept.alias("kept"), F.array_join("tokens", " ").alias("text"), F.coalesce("filters", empty).alias("f"), n.cast("int").alias("n")).where(F.size("kept") > 0)


def _passes():
    return F.forall(F.map_entries("f"), lambda e: F.coalesce(F.try_element_at(F.col("facets"), e["key"]) == e["value"], F.lit(False)))


def _ranked(found: DataFrame, step: str, order: list) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    return found.withColumn("pos", pos).where(F.col("n").isNull() | (F.col("pos") <= F.col("n"))).select("qid", "id", F.lit(step).alias("step"), "pos")


def _in_catalog(hits: DataFrame, q: DataFrame, catalog: Catalog, *more: str) -> DataFrame:
    """Hits (qid, id) with the document's sort columns and ``more``, filtered by facets."""
    docs = catalog.documents.select("id", "name_key", "rank", "facets", *more)
    return hits.join(q.select("qid", "text", "f", "n"), "qid").join(docs, "id").where(_passes())


def _by_name(found: DataFrame, step: str) -> DataFrame:
    return _ranked(found, step, [(F.col("name_key") == F.col("text")).desc(), F.col("rank").desc_nulls_last(), F.col("id")])


def code_step(q: DataFrame, catalog: Catalog) -> DataFrame:
    code = F.regexp_replace("text", "^0+", "")
    asked = q.where(F.col("text").rlike("^[0-9]+$") & (F.length(code) >= 4)).withColumn("typed", code)
    docs = catalog.documents.where("code is not null").select("id", "code", "facets")
    return _ranked(prefix_join(asked, "typed", docs, "code", 4, 10).where(_passes()), "code", [F.col("code"), F.col("id")])


def stems_of(q: DataFrame) -> DataFrame:
    """qid, word, stem of each distinct kept word."""
    each = q.select("qid", F.explode(F.array_distinct("kept")).alias("word"))
    return each.join(stemmed(each.select("word").distinct()), "word")


def unfinished(terms: DataFrame, catalog: Catalog) -> DataFrame:
    """qids with a word of three letters or more that no document has and whose commonest completion has another stem."""
    rare = terms.where(F.length("word") >= 3).join(catalog.words.select("word"), "word", "left_anti")
    longer = catalog.words.select(F.col("word").alias("full"), F.col("stem").alias("full_stem"), "match_count")
    first = top(prefix_join(rare, "word", longer, "full"), ["qid", "word"], [F.col("match_count").desc(), F.col("full")], 1)
    return first.where(F.col("full_stem") != F.col("stem")).select("qid").distinct()


def rarest(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """Of each query's terms (qid, term), the one that the fewest rows hold (``counts``: term, rows), with all of its terms
    as ``all_terms``. A query with a term that no row holds is gone."""
    known = terms.join(counts, "term", "left").groupBy("qid").agg(F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "term")).alias("lead"), F.collect_set("term").alias("all_terms"))
    return known.where("lead.rows > 0").select("qid", F.col("lead.term").alias("term"), "all_terms")


def word_step(q: DataFrame, catalog: Catalog, terms: DataFrame | None = None) -> DataFrame:
    terms = checkpointed(stems_of(q)) if terms is None else terms
    ready = terms.join(unfinished(terms, catalog), "qid", "left_anti").select("qid", F.col("stem").alias("term")).distinct()
    counts = catalog.words.groupBy(F.col("stem").alias("term")).agg(F.max("match_count").alias("rows"))
    hits = checkpointed(rarest(ready, counts)).join(catalog.postings_stem, "term")
    found = _in_catalog(hits, q, catalog, "stems").where(F.size(F.array_except("all_terms", "stems")) == 0)
    return _by_name(found, "word")


def prefix_step(q: DataFrame, catalog: Catalog) -> DataFrame:
    able = q.where(F.exists("kept", lambda w: F.length(w) >= 3))
    terms = able.select("qid", F.explode(F.array_distinct("kept")).alias("term"))
    full = checkpointed(prefix_join(terms.select("term").distinct(), "term", catalog.words.select("word", "doc_count"), "word"))
    lead = checkpointed(rarest(terms, full.groupBy("term").agg(F.sum("doc_count").alias("rows"))))
    hits = lead.join(full.select("term", "word"), "term").join(catalog.postings_word.withColumnRenamed("term", "word"), "word").select("qid", "id", "all_terms").distinct()
    each = F.forall("all_terms", lambda t: F.exists("words", lambda w: F.startswith(w, t)))
    return _by_name(_in_catalog(hits, q, catalog, "words").where(each), "prefix")


def alike_texts(asked: DataFrame, catalog: Catalog, least: float = TYPO) -> DataFrame:
    """g, key, sim: the texts of the catalog that resemble each distinct gram set (``grams``, named ``g``) enough.

    A text reaches the similarity only if it shares ceil(least x size) trigrams, so it holds one of any size - that + 1:
    the rarest are looked up, which leaves the common trigrams out of the join; then the exact count decides."""
    sets = checkpointed(asked.select("g", "grams").dropDuplicates(["g"]))
    needed = F.ceil(F.lit(least) * F.size("grams"))
    rows = catalog.postings_trgm.groupBy("trigram").agg(F.count("*").alias("rows"))
    every = sets.select("g", (F.size("grams") - needed + 1).alias("looked_up"), F.explode("grams").alias("trigram"))
    order = Window.partitionBy("g").orderBy("rows", "trigram")
    rare = every.join(rows, "trigram", "left").withColumn("r", F.row_number().over(order)).where("r <= looked_up and rows > 0")
    pairs = rare.join(catalog.postings_trgm, "trigram").select("g", "key").distinct()
    full = pairs.join(sets, "g").join(catalog.texts.withColumnRenamed("grams", "own"), "key")
    enough = full.where(F.size(F.array_intersect("grams", "own")) >= needed)
    scored = enough.select("g", "key", tx.word_similarity(F.col("grams"), F.col("own")).alias("sim"))
    return scored.where(F.col("sim") >= F.lit(least).cast("float"))


def typo_step(q: DataFrame, catalog: Catalog, least: float = TYPO) -> DataFrame:
    grams = F.array_sort(tx.trigrams(F.col("kept")))
    asked = q.select("qid", "text", "f", "n", grams.alias("grams")).withColumn("g", F.array_join("grams", "|"))
    docs = catalog.documents
    held = in_parts(docs.select(F.col("name_key").alias("key"), "id").union(docs.where("other_key <> name_key").select("other_key", "id")))
    near = checkpointed(alike_texts(asked, catalog, least)).join(held, "key").groupBy("g", "id").agg(F.max("sim").alias("sim"))
    found = _in_catalog(near.join(asked.select("qid", "g"), "g").drop("g"), q, catalog)
    return _ranked(found, "typo", [F.col("sim").desc(), F.col("rank").desc_nulls_last(), F.col("id")])


def search(catalog: Catalog, queries: DataFrame) -> DataFrame:
    """qid, id, step, pos. Queries that ask the same are answered once. Each step's answer is stored, and a step runs
    only if queries are left. Small results inside a step are stored too: the driver plans a long plan anew whenever one
    of its exchanges ends, and holds the threads and tables of all of them at once."""
    same = F.to_json(F.struct("text", F.array_sort(F.map_entries("f")).alias("f"), "n"))
    asked = checkpointed(parse(queries).withColumn("same", same))
    one = checkpointed(asked.dropDuplicates(["same"]).drop("qid").withColumn("number", F.monotonically_increasing_id()))
    left = one.withColumnRenamed("number", "qid").drop("same")
    release(one.sparkSession)  # what the build or another query left in the driver
    out = None
    for step in (code_step, word_step, prefix_step, typo_step):
        found = checkpointed(step(left, catalog))
        out = found if out is None else out.unionByName(found)
        left = checkpointed(left.join(found.select("qid").distinct(), "qid", "left_anti"))
        release(found.sparkSession)
        if left.isEmpty():
            break
    whose = checkpointed(asked.select("qid", "same").join(one.select("same", "number"), "same").select("qid", "number"))
    return in_parts(out).withColumnRenamed("qid", "number").join(whose, "number").select("qid", "id", "step", "pos")
