"""The catalog: derived tables and postings of a seven-column source, and their versioned refresh."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stem import is_stop, stemmed, stems_within
from ..plans.durable import durable, release
from ..plans.files import write_text

SOURCE = {"id": "string", "name": "string", "other_names": "string", "group_key": "string", "code": "string", "facets": "map<string,string>", "rank": "float"}


def source(df: DataFrame) -> DataFrame:
    """``df`` cast to the source contract; a missing column is an error."""
    missing = [c for c in SOURCE if c not in df.columns]
    if missing:
        raise ValueError(f"the source lacks {', '.join(missing)}")
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in SOURCE.items()))


@dataclass
class Catalog:
    """documents(id, name, name_key, other_names, other_key, group_key, code, facets, rank, words, stems), names, words;
    the postings that stand in for inverted and prefix indexes, sorted by term; and for trigrams ``texts``, the distinct
    token strings of the two searched fields with their ordered trigrams, whose postings name the string, not the rows."""

    documents: DataFrame
    names: DataFrame
    words: DataFrame
    postings_stem: DataFrame
    postings_word: DataFrame
    texts: DataFrame
    postings_trgm: DataFrame

    def __post_init__(self):
        for f in fields(self):
            setattr(self, f.name, in_parts(getattr(self, f.name)))

    def save(self, path: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        return cls(*(spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)))


def in_parts(df: DataFrame) -> DataFrame:
    """``df``, whose joins, and those of frames made of it, are sort-merge joins. Spark guesses the size of a table from its
    compressed files, which can be a hundredth of its rows in memory, and of those with prefixes less still; it would
    gather such a side in the driver to broadcast it. A union loses the mark."""
    out = df.hint("merge")
    if path := getattr(df, "_shelfmark_path", None):
        out._shelfmark_path = path
    return out


def build(src: DataFrame, unique: bool = True) -> Catalog:
    """All tables of a source. ``unique`` checks that no id repeats."""
    rows = source(src)
    key = lambda c: F.array_join(tx.tokens(F.col(c)), " ")
    base = rows.select(
        "id", "name", key("name").alias("name_key"), "other_names", key("other_names").alias("other_key"), "group_key",
        tx.code_key(F.col("code")).alias("code"), F.coalesce("facets", F.create_map().cast("map<string,string>")).alias("facets"), "rank",
        F.array_distinct(tx.tokens(F.concat_ws(" ", "name", "other_names"))).alias("words"),
    )
    documents = in_parts(durable(base.withColumn("stems", stems_within(F.col("words"))), "documents"))
    if unique and (twice := documents.groupBy("id").count().where("count > 1").first()):
        raise ValueError(f"id {twice.id!r} repeats")
    counts = documents.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").cast("int").alias("doc_count"))
    found = documents.select(F.explode("stems").alias("stem")).groupBy("stem").agg(F.count("*").cast("int").alias("match_count"))
    own = stemmed(counts).withColumn("stem", F.when(is_stop(F.col("word")), F.col("word")).otherwise(F.col("stem")))
    words = durable(own.join(found, "stem", "left").select("word", "doc_count", "stem", F.coalesce("match_count", F.lit(0)).alias("match_count")), "words")
    postings = [durable(_sorted(documents.select(F.explode(c).alias("term"), "id"), "term"), f"postings-{c}") for c in ("stems", "words")]
    keys = documents.select("name_key").union(documents.select("other_key")).toDF("key").where("key <> ''").distinct()
    texts = durable(keys.withColumn("grams", tx.ordered_trigrams(F.split("key", " "))), "texts")
    trigrams = texts.select(F.explode(F.array_distinct("grams")).alias("trigram"), "key")
    out = Catalog(documents, durable(_sorted(names_of(documents), "name_key"), "names"), words, *postings, texts, durable(_sorted(trigrams, "trigram"), "postings-trgm"))
    release(documents.sparkSession)
    return out


def _sorted(df: DataFrame, column: str) -> DataFrame:
    """Files in order of the column, so that a search for one value or prefix skips most row groups. A frequent
    value may fill several files."""
    return df.repartitionByRange(F.col(column), F.xxhash64(*df.columns)).sortWithinPartitions(column)


def names_of(documents: DataFrame) -> DataFrame:
    """One row per name key: its most frequent spelling (ties: the smallest), its rows, and the id of its best row."""
    # Counting (key, spelling) first keeps the largest group small before the second grouping.
    best = F.struct(F.col("rank").isNotNull().alias("ranked"), F.col("rank").alias("rank"))
    per = documents.where("name_key <> ''").groupBy("name_key", "name").agg(F.count("*").alias("n"), F.max(best).alias("top"))
    spelling = per.groupBy("name_key").agg(F.min(F.struct((-F.col("n")).alias("n"), "name"))["name"].alias("name"), F.sum("n").cast("int").alias("doc_count"), F.max("top").alias("top"))
    tied = documents.groupBy("name_key", best.alias("top")).agg(F.min("id").alias("sample_id"))
    same = (F.col("s.name_key") == F.col("t.name_key")) & F.col("s.top.ranked").eqNullSafe(F.col("t.top.ranked")) & F.col("s.top.rank").eqNullSafe(F.col("t.top.rank"))
    return spelling.alias("s").join(tied.alias("t"), same).select("s.name_key", "s.name", "s.doc_count", "t.sample_id")


def refresh(src: DataFrame, root: str, version: str) -> Catalog:
    """Build a new version beside the one in use; a reader of ``root/<version>`` sees all tables change together. The
    pointer to it is written beside the old one and takes its name in one step; older versions stay."""
    build(src).save(f"{root}/{version}")
    write_text(src.sparkSession, f"{root}/current", version)
    return current(src.sparkSession, root)


def current(spark: SparkSession, root: str) -> Catalog:
    return Catalog.load(spark, f"{root}/{spark.read.text(f'{root}/current').first().value}")


def prefix_keys(df: DataFrame, column: str, least: int = 1, most: int = 8) -> DataFrame:
    """``df`` once for each length from ``least`` to ``most`` that ``column`` has, with ``k`` and ``key``: turns a prefix test into an equi-join."""
    n = F.least(F.length(column), F.lit(most))
    return df.where(F.length(column) >= least).withColumn("k", F.explode(F.sequence(F.lit(least), n))).withColumn("key", F.substr(F.col(column), F.lit(1), F.col("k")))


def prefix_join(left: DataFrame, typed: str, right: DataFrame, column: str, least: int = 1, most: int = 8) -> DataFrame:
    """Rows of ``right`` whose ``column`` starts with ``typed`` of ``left`` (``least`` letters or more)."""
    lead = F.least(F.length(typed), F.lit(most))
    a = left.where(F.length(typed) >= least).withColumn("k", lead).withColumn("key", F.substr(F.col(typed), F.lit(1), lead))
    return a.join(prefix_keys(right, column, least, most), ["k", "key"]).where(F.startswith(F.col(column), F.col(typed))).drop("k", "key")


def top(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
