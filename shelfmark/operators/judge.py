"""The judgment step: requests for a scorer, keep-or-sink, no-match, and the search page.

A scorer is any function from request rows to (qid, idx, score); tests and registered queries use a
deterministic one. Every failure, and every missing score, leaves the page as it was.
"""

from __future__ import annotations

import logging
import math
import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import carries
from ..plans.durable import checkpointed
from .catalog import Catalog
from .group import facets, query_distinct, suggest
from .spell import similar_words, spelling_options, suggestion

THRESHOLD = 0.3


class Scorer(Protocol):
    def __call__(self, requests: DataFrame) -> DataFrame: ...


def threshold_setting(name: str = "SHELFMARK_THRESHOLD") -> float:
    """The threshold of the environment; unset or blank is 0.3, no number is NaN (which skips the step)."""
    raw = os.environ.get(name, "").strip()
    try:
        return float(raw) if raw else THRESHOLD
    except ValueError:
        return math.nan


def with_scores(requests: DataFrame, score: Callable, seconds: float = 1.5) -> DataFrame:
    """A scorer from a Python function on pandas batches (qid, idx, query, text) -> scores; it runs on the executors, one
    query at a time. A call that fails, or takes longer than ``seconds``, leaves that query without scores."""

    def run(batches):
        with ThreadPoolExecutor(1) as pool:
            for pdf in batches:
                for _, one in pdf.groupby("qid", dropna=False, sort=False):
                    try:
                        given = pool.submit(score, one).result(seconds)
                        yield one[["qid", "idx"]].assign(score=[float(x) for x in given])
                    except Exception:  # whatever went wrong, the page stays as it was
                        yield one[["qid", "idx"]].assign(score=math.nan)
                        pool.shutdown(wait=False, cancel_futures=True)
                        pool = ThreadPoolExecutor(1)

    found = requests.repartition("qid").mapInPandas(run, f"qid {requests.schema['qid'].dataType.simpleString()}, idx int, score double")
    return found.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


def failing_open(make: Callable[[], DataFrame], schema_of: DataFrame) -> DataFrame:
    """The stored result of ``make``; if it fails, no rows, with the columns of ``schema_of``."""
    try:
        return checkpointed(make())
    except Exception as e:
        logging.getLogger(__name__).warning("the step is left out: %s", str(e).split("\n")[0])
        return schema_of.limit(0)


def rerank_requests(page: DataFrame, top: int = 10) -> DataFrame:
    """One row per query: candidates c0..cN of the page's head as a map, and the whole request as JSON."""
    head = page.where(F.col("pos") <= top).withColumn("idx", F.col("pos") - 1)
    item = F.struct("idx", "name", "other_names", "facets")
    g = head.groupBy("qid", "query").agg(F.array_sort(F.collect_list(F.struct("idx", F.to_json(item).alias("candidate")))).alias("cs"))
    questions = F.map_from_entries(F.transform("cs", lambda c: F.struct(F.concat(F.lit("c"), c["idx"]), F.lit("noul"))))
    return g.select("qid", "query", questions.alias("questions"), F.to_json(F.struct("query", F.transform("cs", lambda c: c["candidate"]).alias("candidates"))).alias("state"))


def keep_or_sink(page: DataFrame, scores: DataFrame, top: int = 10, threshold: float = THRESHOLD) -> DataFrame:
    """``page`` (qid, pos, id, name, other_names, name_key, group_key, step, query) with new_pos, sunk, reranked, no_match.
    ``scores`` has qid, idx (0-based in the head) and score. Order within kept and within sunk rows stays."""
    if not math.isfinite(threshold):
        off = F.lit(False)
        return page.select("*", F.col("pos").alias("new_pos"), off.alias("sunk"), off.alias("reranked"), off.alias("no_match"))
    rows = page.join(scores.select("qid", (F.col("idx") + 1).alias("pos"), "score"), ["qid", "pos"], "left").withColumn("head", F.col("pos") <= top)
    all_ = Window.partitionBy("qid")
    in_head = lambda c: F.when(F.col("head"), c)
    size = F.count(in_head(F.lit(1))).over(all_)
    given = F.count(in_head(F.col("score"))).over(all_)
    group = F.coalesce("group_key", "name_key")
    several = F.min(in_head(group)).over(all_) != F.max(in_head(group)).over(all_)
    first = F.max(F.when(F.col("pos") == 1, F.col("step"))).over(all_)
    ran = (size >= 2) & F.coalesce(several, F.lit(False)) & (F.coalesce(first, F.lit("")) != "prefix") & (given == size)
    low = F.col("head") & (F.col("score") < threshold)
    says = F.coalesce(carries(F.col("name"), F.col("query")), F.lit(False)) | carries(F.coalesce("other_names", F.lit("")), F.col("query"))
    judged = rows.withColumn("reranked", ran).withColumn("sunk", F.col("reranked") & F.coalesce(low, F.lit(False)))
    lost = (F.count(in_head(F.when(F.col("sunk"), 1))).over(all_) == size) & ~F.coalesce(F.max(in_head(says)).over(all_), F.lit(False))
    place = F.row_number().over(all_.orderBy((~F.col("head")).cast("int"), F.col("sunk").cast("int"), "pos"))
    return judged.withColumn("no_match", F.col("reranked") & lost).withColumn("new_pos", place).drop("head", "score")


def search_page(catalog: Catalog, queries: DataFrame, scorer: Scorer | None = None, spell_scorer: Scorer | None = None, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The ranked page of each query, and its spelling suggestion (only for queries without filters)."""
    rows = query_distinct(catalog, queries).join(catalog.documents.drop("words", "stems", "code", "rank", "other_key"), "id")
    found = checkpointed(rows.join(queries.select("qid", F.col("q").alias("query")), "qid"))
    request = found.where("pos <= 10").select("qid", (F.col("pos") - 1).alias("idx"), "query", F.concat_ws(" ", "name", "other_names").alias("text"))
    none = request.select("qid", "idx", F.lit(None).cast("double").alias("score"))
    scores = failing_open(lambda: scorer(request), none) if scorer else none.limit(0)
    page = keep_or_sink(found, scores, threshold=threshold_setting() if threshold is None else threshold)
    plain = queries.where(F.col("filters").isNull() | (F.size("filters") == 0))
    nothing = plain.select("qid", F.lit(0).alias("n"), F.lit("").alias("text"), F.lit(0).alias("edits"), F.lit(False).alias("completes"))
    options = failing_open(lambda: spelling_options(plain, similar_words(catalog, plain)), nothing)
    asked = options.select("qid", F.col("n").alias("idx"), "text").join(plain.select("qid", F.col("q").alias("query")), "qid")
    unsaid = asked.select("qid", "idx", F.lit(None).cast("double").alias("score"))
    p = failing_open(lambda: spell_scorer(asked), unsaid) if spell_scorer else unsaid
    return page, suggestion(options, p.select("qid", F.col("idx").alias("n"), F.col("score").alias("p")))


def spelling_request(options: DataFrame, words: DataFrame) -> DataFrame:
    """One line per option for a scorer: its text, edits and how many products its words are found in.
    ``words`` (qid, n, word, matches) are the words whose counts an option reports."""
    unit = F.when(F.col("matches") == 1, F.lit(" product")).otherwise(F.lit(" products"))
    counts = words.groupBy("qid", "n").agg(F.array_join(F.array_sort(F.collect_list(F.concat("word", F.lit(": "), F.format_number("matches", 0), unit))), "; ").alias("found"))
    edits = F.when(F.col("n") == 0, F.lit("as typed")).otherwise(F.concat(F.col("edits"), F.when(F.col("edits") == 1, F.lit(" edit")).otherwise(F.lit(" edits"))))
    return options.join(counts, ["qid", "n"], "left").select("qid", "n", F.concat_ws(", ", F.concat(F.lit("s"), "n", F.lit(" = "), "text"), edits, "found").alias("line"))


def shape_facets(counts: DataFrame) -> DataFrame:
    """One row per query: its facets (qid, facet, value, doc_count) grouped by name, values by count, then value."""
    value = F.struct((-F.col("doc_count")).alias("less"), "value", "doc_count")
    each = counts.groupBy("qid", "facet").agg(F.transform(F.array_sort(F.collect_list(value)), lambda x: F.struct(x["value"].alias("value"), x["doc_count"].alias("count"))).alias("values"))
    return each.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("facet", "values")))).alias("facets"))


def shape(page: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One row per query as a server would answer: ids in order, the suggestion, and no_match only without one."""
    ids = page.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("new_pos", "id"))), lambda x: x["id"]).alias("ids"), F.max("no_match").alias("no_match"))
    both = ids.join(suggestions.select("qid", "suggestion"), "qid", "full")
    return both.select("qid", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), "suggestion", (F.coalesce("no_match", F.lit(False)) & F.col("suggestion").isNull()).alias("no_match"))


__all__ = ["facets", "keep_or_sink", "rerank_requests", "search_page", "shape", "spelling_request", "suggest", "threshold_setting", "with_scores"]
