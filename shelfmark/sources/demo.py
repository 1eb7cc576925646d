"""Sources and sinks: CSV releases, newest record per code, samples, evaluation sets and run files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import contained_words
from ..plans.files import exists, put_in_place, write_text


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All-text CSV with a header; the order of columns is fixed, names are not trusted. A gzip file is one task."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("enforceSchema", True).option("quote", '"').option("escape", '"').csv(path)


def newest_per_code(branded: DataFrame, foods: DataFrame) -> DataFrame:
    """The newest record (by date, then id) of each code of 8 to 14 digits. Records that were discontinued, or have no
    description, drop out after that choice, and their code with them."""
    both = branded.join(foods.select("fdc_id", "description"), "fdc_id").where(F.col("gtin_upc").rlike("^[0-9]{8,14}$"))
    day = F.col("modified_date").try_cast("date")
    w = Window.partitionBy("gtin_upc").orderBy(day.desc_nulls_last(), F.col("fdc_id").try_cast("long").desc())
    first = both.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    open_ = F.col("discontinued_date").isNull() | (F.trim("discontinued_date") == "")
    return first.where(open_ & (F.trim("description") != "")).select("gtin_upc", "description", F.nullif("brand_name", F.lit("")).alias("brand_name"), F.nullif("brand_owner", F.lit("")).alias("brand_owner"), F.col("branded_food_category").alias("category"), day.alias("modified_date"))


def product_source(products: DataFrame) -> DataFrame:
    """Products as a catalog source: the brand goes before a description that does not name it; rank counts the rows whose
    final names have the same words. A product without a brand has no brand facet."""
    named = F.instr(contained_words(F.col("description")), contained_words(F.col("brand_name"))) > 0
    name = F.when(F.col("brand_name").isNull() | named, F.col("description")).otherwise(F.concat_ws(" ", "brand_name", "description"))
    facets = F.map_filter(F.create_map(F.lit("category"), F.col("category"), F.lit("brand"), F.col("brand_name")), lambda _, v: v.isNotNull())
    rows = products.select(
        F.col("gtin_upc").alias("id"), name.alias("name"), F.col("brand_owner").alias("other_names"), F.lit(None).cast("string").alias("group_key"),
        F.col("gtin_upc").alias("code"), facets.alias("facets"), contained_words(name).alias("_words"),
    )
    # Counted, then joined: no task gathers all rows of one name.
    same = rows.groupBy(F.col("_words").alias("_words2")).agg(F.count("*").cast("float").alias("rank"))
    return rows.join(same, F.col("_words") == F.col("_words2")).drop("_words", "_words2")


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of least md5 of the key: the same rows every time, whatever their order."""
    return df.orderBy(F.md5(F.col(key)), key).limit(n)


def write_sample(df: DataFrame, path: str) -> None:
    """One gzip CSV file of a sample, whose size is bounded."""
    df.coalesce(1).write.option("compression", "gzip").option("header", True).mode("errorifexists").csv(path)


def load_all_or_nothing(df: DataFrame, path: str, replace: bool = False) -> None:
    """Write beside the target, then swap; refuses to replace a table unless told to."""
    spark = df.sparkSession
    if exists(spark, path) and not replace:
        raise FileExistsError(path)
    df.write.mode("overwrite").parquet(f"{path}.part")
    put_in_place(spark, f"{path}.part", path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """An evaluation set: a JSON array of q, kind, expect, or an object that wraps it in ``cases``."""
    case = "q string, kind string, edit string, expect string"
    rows = spark.read.schema(f"{case}, cases array<struct<{case.replace(' string', ':string')}>>").option("multiLine", True).json(path)
    plain = rows.where("cases is null").select("q", "kind", "edit", "expect")
    return plain.unionByName(rows.where("cases is not null").select(F.explode("cases").alias("c")).select("c.*")).where("q is not null")


def write_run(records: DataFrame, path: str, meta: dict[str, str] | None = None) -> None:
    """Records as JSON lines, each with its place, and ``meta`` (what the run was) beside them, written last: a run with
    meta is a whole run."""
    records.write.mode("errorifexists").json(f"{path}/records")
    write_text(records.sparkSession, f"{path}/meta.json", json.dumps(meta or {}))


def read_runs(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The records of whole runs, with ``run`` (their folder's name) and ``meta`` (map<string,string>)."""
    out = None
    for path in sorted(paths):  # runs are few: one folder each
        meta = json.loads("".join(r.value for r in spark.read.text(f"{path}/meta.json").collect()))
        pairs = [F.lit(x) for k, v in meta.items() for x in (k, v)]
        given = F.create_map(*pairs) if pairs else F.create_map()
        one = spark.read.schema(schema).json(f"{path}/records").withColumn("run", F.lit(path.rstrip("/").rsplit("/", 1)[-1]))
        one = one.withColumn("meta", given.cast("map<string,string>"))
        out = one if out is None else out.unionByName(one)
    return out


def misspelling_pairs(lines: DataFrame, words: DataFrame, used: DataFrame, least_docs: int = 20, least_length: int = 4) -> DataFrame:
    """Lines (n, value) ``wrong->right`` with one right word: q, expect. The right word has ``least_length`` letters or more
    and ``least_docs`` rows in ``words`` (word, doc_count); neither is in ``used`` (word); the first line of a wrong word counts."""
    pattern = r"^\s*([^\s>]+)->(.+?)\s*$"
    pair = lambda i: F.lower(F.regexp_extract("value", pattern, i))
    pairs = lines.select("n", pair(1).alias("q"), pair(2).alias("expect"))
    fit = pairs.where(F.col("q").rlike("^[a-z]+$") & F.col("expect").rlike("^[a-z]+$") & (F.length("expect") >= least_length) & (F.col("q") != F.col("expect")))
    common = words.where(F.col("doc_count") >= least_docs).select(F.col("word").alias("expect"))
    free = fit.join(common, "expect", "left_semi")
    for c in ("q", "expect"):
        free = free.join(used.select(F.col("word").alias(c)), c, "left_anti")
    return free.groupBy("q").agg(F.min_by("expect", "n").alias("expect"))
