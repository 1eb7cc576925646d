"""One row per product group, typeahead and facet counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.durable import checkpointed, release
from .catalog import Catalog, prefix_join, top
from .retrieve import search


def _clamped(column: str, default: int, most: int):
    return F.least(F.greatest(F.coalesce(F.col(column), F.lit(default)), F.lit(1)), F.lit(most))


def query_distinct(catalog: Catalog, queries: DataFrame) -> DataFrame:
    """qid, id, step, pos: the best row of each group among the first 1000 matches, renumbered."""
    return first_of_groups(catalog, search(catalog, queries.withColumn("lim", F.lit(1000))), queries)


def search_and_distinct(catalog: Catalog, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``search`` and ``query_distinct`` answer, by one search: a limit only cuts its rows, so those of the larger
    limit hold both."""
    found = checkpointed(search(catalog, queries.withColumn("lim", F.when(F.col("lim").isNotNull(), 1000))))
    n = F.least(F.greatest(F.col("lim"), F.lit(1)), F.lit(1000))
    rows = found.join(queries.select("qid", "lim"), "qid").where(F.col("lim").isNull() | (F.col("pos") <= n)).drop("lim")
    return rows, first_of_groups(catalog, found.where("pos <= 1000"), queries)


def first_of_groups(catalog: Catalog, found: DataFrame, queries: DataFrame) -> DataFrame:
    """The best row of each group of ``found`` (qid, id, step, pos), renumbered, as many as the query lists."""
    keyed = found.join(catalog.documents.select("id", F.coalesce("group_key", "name_key").alias("grp")), "id")
    best = top(keyed, ["qid", "grp"], [F.col("pos")], 1)
    n = queries.select("qid", _clamped("lim", 50, 1000).alias("n"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("pos"))
    out = checkpointed(best.join(n, "qid").withColumn("pos", place).where("pos <= n").select("qid", "id", "step", "pos"))
    release(out.sparkSession)
    return out


def suggest(catalog: Catalog, queries: DataFrame) -> DataFrame:
    """qid, pos, name, id, doc_count: names that begin with the input, then, if they are few, names of matches."""
    words = tx.tokens(F.left(F.coalesce("q", F.lit("")), F.lit(256)))
    asked = queries.select("qid", "q", F.array_join(words, " ").alias("typed"), _clamped("lim", 8, 50).alias("n"), F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)).alias("longest")).where("typed <> ''")
    one = asked.select("typed").distinct()
    # 50 is the most that any query lists; queries that type the same are listed once.
    place = F.row_number().over(Window.partitionBy("typed").orderBy(F.col("doc_count").desc(), "name_key"))
    best_of = prefix_join(one, "typed", catalog.names, "name_key", 1, 12).withColumn("at", place).where("at <= 50")
    listed = checkpointed(best_of.join(asked, "typed").where("at <= n"))
    had = listed.groupBy("qid").agg(F.count("*").alias("had"))
    short = asked.join(had, "qid", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < n and longest >= 4")
    cols = ["qid", F.col("at").cast("int").alias("pos"), "name", F.col("sample_id").alias("id"), "doc_count"]
    short = checkpointed(short)
    if short.isEmpty():
        return listed.select(*cols)
    rows = search(catalog, short.select("qid", "q", F.lit(None).cast("map<string,string>").alias("filters"), F.lit(1000).alias("lim")))
    other = rows.join(catalog.documents.select("id", "name_key"), "id").join(short.select("qid", "typed", "had", "n"), "qid").where((F.col("name_key") != "") & ~F.startswith("name_key", "typed"))
    best = top(other, ["qid", "name_key"], [F.col("pos")], 1)
    best = checkpointed(best.withColumn("at", F.col("had") + F.row_number().over(Window.partitionBy("qid").orderBy("pos"))).where("at <= n"))
    release(best.sparkSession)
    filled = best.join(catalog.names.select("name_key", "name", "doc_count"), "name_key")
    return listed.select(*cols).unionByName(filled.select("qid", F.col("at").cast("int").alias("pos"), "name", "id", "doc_count"))


def facets(catalog: Catalog, queries: DataFrame, per_facet: int | None = 20) -> DataFrame:
    """qid, facet, value, doc_count over every match, the most frequent ``per_facet`` values of each facet."""
    n = min(max(20 if per_facet is None else per_facet, 1), 1000)
    rows = search(catalog, queries.withColumn("lim", F.lit(None).cast("int"))).join(catalog.documents.select("id", "facets"), "id")
    counted = checkpointed(rows.select("qid", F.explode(F.map_filter("facets", lambda _, v: v.isNotNull())).alias("facet", "value")).groupBy("qid", "facet", "value").agg(F.count("*").alias("doc_count")))
    release(counted.sparkSession)
    return top(counted, ["qid", "facet"], [F.col("doc_count").desc(), F.col("value")], n)
