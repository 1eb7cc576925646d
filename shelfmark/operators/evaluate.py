"""Offline evaluation: relevance, hit rates, test-set generators, correction counts, comparisons of systems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stem import is_stop, stem_of_each
from .catalog import Catalog, top
from .retrieve import rarest, stems_of
from .stats import quantiles, wilson


def relevant_by_pattern(pattern: Column) -> Column:
    """Case-insensitive pattern on name and other names."""
    return F.rlike(F.concat_ws(" ", "name", "other_names"), F.concat(F.lit("(?i)"), pattern))


def relevant_by_words(expected: Column) -> Column:
    return tx.carries(F.concat_ws(" ", "name", "other_names"), expected)


def hit_at_k(cases: DataFrame, results: DataFrame, ks: tuple[int, ...] = (1, 3, 10), relevant: Column | None = None) -> DataFrame:
    """Per case (qid, ...): whether one of the first k results (qid, pos, name, other_names) is relevant; no results miss."""
    flag = F.col("relevant") if relevant is None else relevant
    rows = cases.join(results.where(F.col("pos") <= max(ks)), "qid", "left")  # later results change nothing
    return rows.groupBy(*cases.columns).agg(*(F.coalesce(F.max(flag & (F.col("pos") <= k)), F.lit(False)).alias(f"hit{k}") for k in ks))


def hit_rates(hits: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """Per group: n, hits and their Wilson interval at each k."""
    g = hits.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum(F.col(f"hit{k}").cast("long")).alias(f"hits{k}") for k in ks))
    for k in ks:
        low, high = wilson(F.col(f"hits{k}"), F.col("n"))
        g = g.withColumn(f"low{k}", low).withColumn(f"high{k}", high)
    return g


def full_text_baseline(catalog: Catalog, queries: DataFrame, lim: int = 50) -> DataFrame:
    """Plain stemmed AND search with a term-frequency and proximity rank: qid, id, pos, score; one row per lower-cased name.

    One term: a tenth of the sum of 1/j^2 over its occurrences, over pi^2/6. Several: for each pair of terms and of their
    places, at distance d, a weight 0.1 / sqrt(1.005 + 0.05 e^(d/1.5 - 2)); the rank is 1 minus the product of 1 - weight."""
    q = queries.select("qid", F.filter(tx.query_tokens(F.col("q")), lambda t: ~t.isin(*_stops())).alias("kept")).where(F.size("kept") > 0)
    terms = stems_of(q).select("qid", F.col("stem").alias("term")).distinct()
    counts = catalog.words.groupBy(F.col("stem").alias("term")).agg(F.max("match_count").alias("rows"))
    hits = rarest(terms, counts).join(catalog.postings_stem, "term")
    rows = hits.join(catalog.documents.select("id", "name", "other_names", "stems"), "id").where(F.size(F.array_except("all_terms", "stems")) == 0)
    text = tx.tokens(F.concat_ws(" ", "name", "other_names"))
    places = F.transform(F.array_sort("all_terms"), lambda t: F.filter(F.transform("order", lambda x, i: F.when(x == t, i + 1)), lambda i: i.isNotNull()))
    placed = rows.withColumn("order", stem_of_each(text)).withColumn("places", places)
    order = [F.col("score").desc(), F.col("name"), F.col("id")]
    scored = placed.select("qid", "id", "name", _text_rank().cast("float").alias("score"), F.lower("name").alias("key"))
    best = top(scored, ["qid", "key"], [F.col("score").desc(), F.col("id")], 1)
    return best.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("pos") <= lim).select("qid", "id", "pos", "score")


def _text_rank() -> Column:
    """The rank of ``places``, an array of the ordered places of each term."""
    alone = F.aggregate(F.transform(F.element_at("places", 1), lambda _, i: 0.1 / F.pow(i + 1, F.lit(2))), F.lit(0.0), lambda s, x: s + x) / 1.64493406685

    def weight(d):
        return F.when(d > 100, F.sqrt(F.lit(0.01 * 1e-30))).otherwise(0.1 / F.sqrt(1.005 + 0.05 * F.exp(d / 1.5 - 2)))

    def pair(a, b):
        each = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.abs(x - y))))
        return F.aggregate(F.filter(each, lambda d: d > 0), F.lit(1.0), lambda m, d: m * (1 - weight(d)))

    def before(a, i):
        return F.aggregate(F.slice("places", 1, i), F.lit(1.0), lambda m, b: m * pair(a, b))

    several = F.aggregate(F.zip_with("places", F.sequence(F.lit(0), F.size("places") - 1), lambda a, i: F.struct(a.alias("a"), i.alias("i"))), F.lit(1.0), lambda m, x: m * F.when(x["i"] == 0, 1.0).otherwise(before(x["a"], F.greatest(x["i"], F.lit(1)))))
    return F.when(F.size("places") == 1, alone).otherwise(1 - several)


def _stops():
    from ..functions.stem import STOP_WORDS

    return STOP_WORDS


def choose_sets(cases: DataFrame, sets: list[str] | None = None, every: int = 1) -> DataFrame:
    """Cases of the named sets, every nth of them all in order of set and qid. Places are counted set by set and shifted
    by the sizes of the sets before, so no task sees all cases."""
    kept = cases.where(F.col("set").isin(*sets)) if sets else cases
    size = kept.groupBy("set").agg(F.count("*").alias("size"))  # one row a set
    shift = size.withColumn("_before", F.coalesce(F.sum("size").over(Window.orderBy("set").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    place = F.row_number().over(Window.partitionBy("set").orderBy("qid")) - 1
    return kept.withColumn("_i", place).join(shift, "set").where((F.col("_i") + F.col("_before")) % every == 0).drop("_i", "_before")


def overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Per query of either: how many of the first k ids two systems share."""
    first = lambda d: d.where(F.col("pos") <= k).select("qid", "id").distinct()
    shared = first(a).join(first(b), ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("shared"))
    every = a.select("qid").union(b.select("qid")).distinct()
    return every.join(shared, "qid", "left").select("qid", F.coalesce("shared", F.lit(0)).alias("shared"))


def mean_overlap(cases: DataFrame, a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """One row: n (all cases), mean of the shared ids; a case that neither system answers shares none."""
    return cases.select("qid").join(overlap(a, b, k), "qid", "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("shared", F.lit(0))).alias("mean"))


# -- generators ------------------------------------------------------------------------
def eligible_words(catalog: Catalog, min_length: int = 5, min_docs: int = 20) -> DataFrame:
    """Words of letters a-z that the names of enough rows hold, no stop words: word, n_docs."""
    each = catalog.documents.select(F.explode(F.array_distinct(F.split("name_key", " "))).alias("word"))
    ok = each.where(F.col("word").rlike("^[a-z]+$") & (F.length("word") >= min_length) & ~is_stop(F.col("word")))
    return ok.groupBy("word").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def _draw(*key) -> Column:
    """A number below 2^32 that depends on the key alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 8), 16, 10).cast("long")


def seeded(df: DataFrame, key: str, seed: int, most: int) -> DataFrame:
    """The first ``most`` rows of a shuffle that depends on the seed and the key alone: n counts from 1."""
    first = df.withColumn("_draw", _draw(F.lit(str(seed)), F.col(key))).orderBy("_draw", key).limit(most)
    return first.withColumn("n", F.row_number().over(Window.orderBy("_draw", key))).drop("_draw")  # ``most`` rows


def misspellings(words: DataFrame, catalog: Catalog, seed: int = 1, typos: int = 300, controls: int = 200, tries: int = 10) -> DataFrame:
    """q, expect, kind (typo, control), edit. Four edits in turn (drop, swap, change, add), never at the first letter, drawn
    up to ``tries`` times while the result is a known word (a word with no luck gives none); then controls."""
    order = seeded(words.select("word"), "word", seed, typos + controls)
    kind = F.element_at(F.array(*(F.lit(x) for x in ("drop", "swap", "change", "add"))), ((F.col("n") - 1) % 4 + 1).cast("int"))
    rows = order.where(F.col("n") <= typos).withColumn("edit", kind).withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    draw = lambda what: _draw(F.lit(str(seed)), F.lit(what), F.col("t").cast("string"), F.col("word"))
    room = F.greatest(F.length("word") - F.when(F.col("edit") == "swap", 2).otherwise(1), F.lit(1))
    letter = F.substr(F.lit(tx.LETTERS), (draw("letter") % 26 + 1).cast("int"), F.lit(1))
    rows = rows.withColumn("at", (draw("at") % room + 2).cast("int")).withColumn("letter", letter)
    w, i = F.col("word"), F.col("at")
    head, tail = F.substr(w, F.lit(1), i - 1), lambda k: F.substr(w, i + k)
    drop, change, add = F.concat(head, tail(1)), F.concat(head, F.col("letter"), tail(1)), F.concat(head, F.col("letter"), tail(0))
    swap = F.concat(head, F.substr(w, i + 1, F.lit(1)), F.substr(w, i, F.lit(1)), tail(2))
    made = F.when(F.col("edit") == "drop", drop).when(F.col("edit") == "swap", swap).when(F.col("edit") == "change", change).otherwise(add)
    new = rows.withColumn("q", made).where("q <> word").join(catalog.words.select(F.col("word").alias("q")), "q", "left_anti")
    first = top(new, ["word"], [F.col("t")], 1)
    out = first.select("q", F.col("word").alias("expect"), F.lit("typo").alias("kind"), "edit")
    rest = order.where(F.col("n") > typos).select(F.col("word").alias("q"), F.col("word").alias("expect"), F.lit("control").alias("kind"), F.lit(None).cast("string").alias("edit"))
    return out.unionByName(rest)


def truncations(words: DataFrame, catalog: Catalog, least: int = 4) -> DataFrame:
    """q, expect: each word cut to every length from ``least`` to one less than whole, unless the cut is a word."""
    long = words.where(F.length("word") > least)
    cut = long.withColumn("k", F.explode(F.sequence(F.lit(least), F.length("word") - 1))).select(F.expr("substr(word, 1, k)").alias("q"), F.col("word").alias("expect"))
    return cut.join(catalog.words.select(F.col("word").alias("q")), "q", "left_anti")


def near_words(catalog: Catalog, ratio: int = 10) -> DataFrame:
    """q, near: words one edit from a word of another stem that matches ``ratio`` times as many rows (the commonest)."""
    w = catalog.words.where(F.col("word").rlike("^[a-z]{4,}$") & ~is_stop(F.col("word")))
    other = w.select(F.col("word").alias("near"), F.col("stem").alias("near_stem"), F.col("match_count").alias("near_n"))
    found = w.withColumn("near", F.explode(tx.edits1(F.col("word")))).join(other, "near").where((F.col("near_stem") != F.col("stem")) & (F.col("near_n") >= ratio * F.greatest("match_count", F.lit(1))))
    return top(found, ["word"], [F.col("near_n").desc(), F.col("near")], 1).select(F.col("word").alias("q"), "near")


def used_words(*sets: DataFrame) -> DataFrame:
    """The tokens of the queries (q) and intended texts (expect) of earlier sets: word."""
    each = [s.select(F.explode(tx.tokens(F.concat_ws(" ", "q", "expect"))).alias("word")) for s in sets]
    return reduce(DataFrame.union, each).distinct()


def unused(words: DataFrame, *earlier: DataFrame) -> DataFrame:
    """``words`` that no query and no intended text of an earlier set holds."""
    return words.join(used_words(*earlier), "word", "left_anti") if earlier else words


# -- scoring ---------------------------------------------------------------------------
def correction_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows have kind (typo or control), expect and suggested (null: none): fixed, wrong, missed, false_alarms, offered, precision."""
    typo, said = F.col("kind") != "control", F.col("suggested").isNotNull()
    right = F.coalesce(F.col("suggested") == F.col("expect"), F.lit(False))
    n = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), n(typo & right, "fixed"), n(typo & said & ~right, "wrong"), n(typo & ~said, "missed"), n(~typo & said, "false_alarms"), n(said, "offered"))
    return g.withColumn("precision", F.try_divide("fixed", "offered"))


def spelling_scores(rows: DataFrame) -> DataFrame:
    """Per kind: n, offered, right; a control is right if nothing is suggested."""
    said = F.col("suggested").isNotNull()
    right = F.when(F.col("kind") == "control", ~said).otherwise(F.coalesce(F.col("suggested") == F.col("expect"), F.lit(False)))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum(said.cast("long")).alias("offered"), F.sum(right.cast("long")).alias("right"))


def absent_scores(rows: DataFrame) -> DataFrame:
    """Queries that name nothing sold: right if the page is empty, or is flagged without a suggestion."""
    right = (F.col("n_results") == 0) | (F.col("no_match") & F.col("suggestion").isNull())
    return rows.agg(F.count("*").alias("n"), F.sum(F.coalesce(right, F.lit(False)).cast("long")).alias("right"))


def call_accounting(rows: DataFrame) -> DataFrame:
    """Per question: calls that ran, were skipped, failed; only page calls count toward mean tokens and time."""
    n = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s)
    page = F.when((F.col("question") == "page") & (F.col("status") == "ran"), True)
    return rows.groupBy("question").agg(n("ran"), n("skipped"), n("failed"), F.avg(F.when(page, F.col("tokens"))).alias("mean_tokens"), F.avg(F.when(page, F.col("ms"))).alias("mean_ms"))


def cascade(first: Column, second: Column) -> Column:
    """The model-free suggestion if there is one, else the judged one."""
    return F.coalesce(first, second)


def outcomes(records: DataFrame, systems: dict[str, list[str]], keys: tuple[str, ...] = ("run", "set", "q")) -> DataFrame:
    """Long form, one row per record and system: each system is the first present of its struct columns."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("system"), F.coalesce(*cols).alias("o")) for name, cols in systems.items())))
    return records.select(*keys, each.alias("s")).select(*keys, "s.system", "s.o.*")


def in_groups(rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Each row once for every named group whose condition it meets."""
    names = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(g)) for g, c in groups.items())), lambda x: x.isNotNull())
    return rows.withColumn("group", F.explode(names))


def group_cells(rows: DataFrame, by: list[str], hit: str = "hit1") -> DataFrame:
    """Median, least and most hits over runs, with the Wilson interval of the median."""
    per = rows.groupBy("run", *by).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("long")).alias("hits"))
    mid = quantiles(per, by, "hits", {"median": 0.5})
    g = per.groupBy(*by).agg(F.max("n").alias("n"), F.min("hits").alias("least"), F.max("hits").alias("most")).join(mid, by)
    low, high = wilson(F.col("median"), F.col("n"))
    return g.withColumn("low", low).withColumn("high", high)


def unstable(rows: DataFrame, by: list[str], answer: str) -> DataFrame:
    """Queries whose answer differs over runs, counted per group."""
    per = rows.groupBy(*by, "q").agg(F.count_distinct(F.coalesce(F.col(answer).cast("string"), F.lit("\0"))).alias("answers"))
    return per.groupBy(*by).agg(F.count("*").alias("n"), F.sum((F.col("answers") > 1).cast("long")).alias("changed"))


def error_type(tokens: Column, known: Column) -> Column:
    """real-word if every misspelled token is a known word, else non-word."""
    return F.when(F.forall(tokens, lambda t: F.array_contains(known, t)), F.lit("real-word")).otherwise(F.lit("non-word"))


def edit_type(q: Column, expect: Column, edit: Column) -> Column:
    """The edit's kind, with a lost last letter apart."""
    return F.when((edit == "drop") & (q == F.substr(expect, F.lit(1), F.length(expect) - 1)), F.lit("last letter")).otherwise(edit)


def picked_when_offered(rows: DataFrame) -> DataFrame:
    """Among typos whose intended word was an option: how many were suggested."""
    had = rows.where((F.col("kind") == "typo") & F.array_contains("options", F.col("expect")))
    return had.agg(F.count("*").alias("offered"), F.sum(F.coalesce(F.col("suggested") == F.col("expect"), F.lit(False)).cast("long")).alias("picked"))


def known_words(catalog: Catalog, words: DataFrame) -> DataFrame:
    """``words`` with known (in the vocabulary) and stop."""
    own = catalog.words.select("word", F.lit(True).alias("known"))
    return words.join(own, "word", "left").withColumn("known", F.coalesce("known", F.lit(False))).withColumn("stop", is_stop(F.col("word")))


def no_match_accounting(rows: DataFrame, by: list[str]) -> DataFrame:
    empty = F.col("n_results") == 0
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(empty.cast("long")).alias("empty"), F.sum((~empty & F.col("no_match") & F.col("suggestion").isNull()).cast("long")).alias("flagged"))


def latency(rows: DataFrame, by: list[str], value: str = "ms") -> DataFrame:
    return quantiles(rows, by, value, {"p50": 0.5, "p90": 0.9, "p99": 0.99})


def rule_comparison(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Suggestion rules on the same answers: right and wrong suggestions, and alarms on controls, per rule."""
    each = in_groups(rows, {name: F.lit(True) for name in rules}).withColumnRenamed("group", "rule")
    chosen = reduce(lambda acc, kv: acc.when(F.col("rule") == kv[0], kv[1]), rules.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    return correction_counts(each.withColumn("suggested", chosen), ["rule"])


def prefix_hits(cases: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Typeahead hit@1 and hit@8: a pattern on suggested names."""
    return hit_at_k(cases, suggestions.withColumn("other_names", F.lit(None).cast("string")), (1, 8), relevant_by_pattern(F.col("expect")))


def cut_word_scores(rows: DataFrame) -> DataFrame:
    """Suggestions on cut words: right if they are the full word."""
    said = F.col("suggested").isNotNull()
    return rows.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("suggested") == F.col("expect"), F.lit(False)).cast("long")).alias("right"), F.sum((said & (F.col("suggested") != F.col("expect"))).cast("long")).alias("wrong"))


