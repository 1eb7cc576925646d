"""Comparisons of search systems over the recorded runs of an evaluation.

A *record* is one query of one run: run, set, kind, q, expect, and one struct (n, hit1, hit10) for each system that was
recorded; the structs of a followed suggestion are null where nothing was suggested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .evaluate import group_cells, in_groups, outcomes
from .stats import holm, mcnemar

#: Each system's outcome is the first of these that is not null.
SYSTEMS = {
    "plain": ["plain"],
    "sql": ["sql"],
    "rerank": ["judged"],
    "spelling_only": ["followed_judged", "sql"],
    "both": ["followed_judged", "judged"],
    "norvig": ["followed_norvig", "sql"],
    "frequency": ["followed_frequency", "sql"],
    "wide": ["followed_wide", "sql"],
    "cascade": ["followed_norvig", "followed_judged", "judged"],
}
#: System pairs of the exploratory tests.
PAIRS = [
    ("sql", "plain"), ("rerank", "sql"), ("spelling_only", "sql"), ("both", "sql"), ("both", "plain"),
    ("spelling_only", "norvig"), ("spelling_only", "frequency"), ("wide", "spelling_only"), ("cascade", "norvig"), ("cascade", "both"),
]


def numbered(name: str, last: int) -> list[str]:
    return [name, *(f"{name}-{i}" for i in range(2, last + 1))]


def groups(real_word: Column | None = None, searchable: Column | None = None) -> dict[str, Column]:
    """The 43 named subsets of records, from their set, kind and cut length. ``real_word`` and ``searchable`` are
    flags of a record (columns of those names unless given)."""
    real_word = F.col("real_word") if real_word is None else real_word
    searchable = F.col("searchable") if searchable is None else searchable
    of, typo, control = (lambda s: F.col("set") == s), F.col("kind") == "typo", F.col("kind") == "control"
    out = {"hand-written": of("hand-written"), "hand-written, misspelled": of("hand-written") & typo}
    for name in ["held-out", "synthetic", *numbered("synthetic-test", 5)]:
        out |= {name: of(name), f"{name}, misspelled": of(name) & typo, f"{name}, correctly spelled": of(name) & control}
    cut = F.length(F.coalesce("expect", F.lit(""))) - F.length("q")
    for name in numbered("truncation", 4):
        out |= {name: of(name), f"{name}, one letter cut": of(name) & (cut == 1), f"{name}, two or more letters cut": of(name) & (cut >= 2)}
    wiki = of("wikipedia")
    out |= {"wikipedia": wiki, "wikipedia, real-word errors": wiki & real_word, "wikipedia, non-word errors": wiki & ~real_word}
    out |= {"wikipedia, searchable words (post hoc)": wiki & searchable}
    out |= {"out-of-sample (held-out and synthetic)": of("held-out") | of("synthetic"), "test (synthetic-test and wikipedia)": of("synthetic-test") | wiki}
    return out | {"near-words": of("near-words"), "near-words-test": of("near-words-test")}


def known_flags(records: DataFrame, words: DataFrame, stop: Column) -> DataFrame:
    """``records`` with real_word (all misspelled tokens are known words) and searchable (no intended word is a stop word).
    ``words`` has word; ``stop`` is an array of stop words."""
    wrong = F.array_except(tx.tokens(F.col("q")), tx.tokens(F.col("expect")))
    rows = records.withColumn("wrong", wrong).withColumn("_row", F.struct("run", "set", "q"))
    found = rows.select("_row", F.explode("wrong").alias("word")).join(words.select("word"), "word").groupBy("_row").agg(F.count_distinct("word").alias("had"))
    both = rows.join(found, "_row", "left")
    real = (F.size("wrong") > 0) & (F.coalesce("had", F.lit(0)) == F.size("wrong"))
    clean = ~F.arrays_overlap(F.coalesce(tx.tokens(F.col("expect")), F.array().cast("array<string>")), stop)
    return both.withColumn("real_word", real).withColumn("searchable", clean).drop("_row", "wrong", "had")


def system_cells(records: DataFrame, groups_: dict[str, Column], metric: str = "hit1") -> DataFrame:
    """Per group and system: n, median, least and most hits over runs, Wilson interval."""
    flat = in_groups(records, groups_)
    keep = ("run", "set", "q", "group")
    return group_cells(outcomes(flat, SYSTEMS, keep), ["group", "system"], metric)


def _discordant(x: Column, y: Column) -> tuple[Column, Column]:
    """How many records of a group have only the first outcome, and only the second."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return n(x & ~y), n(~x & y)


def _tests(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    only_a, only_b = _discordant(F.col(a), F.col(b))
    g = pairs.groupBy(*by).agg(only_a.alias("only_a"), only_b.alias("only_b"))
    return g.withColumn("p", mcnemar(F.col("only_a"), F.col("only_b")))


def pair_tests(records: DataFrame, groups_: dict[str, Column], pairs: list[tuple[str, str]] = PAIRS) -> DataFrame:
    """Per group (none of correctly spelled queries) and pair of systems: McNemar's test on hit@1, least and most over runs.
    Both outcomes of a pair stand in the same record, so the pairs need no join; all pairs are counted in one row of a group."""
    flat = in_groups(records, {g: c for g, c in groups_.items() if "correctly" not in g})
    hit = {s: F.coalesce(*(F.col(f"{c}.hit1") for c in cols)) for s, cols in SYSTEMS.items()}
    counts = [F.struct(*(c.alias(name) for name, c in zip(("only_a", "only_b"), _discordant(hit[a], hit[b]), strict=True))).alias(f"t{i}") for i, (a, b) in enumerate(pairs)]
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"t{i}.only_a"), F.col(f"t{i}.only_b")) for i, (a, b) in enumerate(pairs))))
    per = flat.groupBy("run", "group").agg(*counts).select("run", "group", each.alias("t")).select("run", "group", "t.*")
    tests = per.withColumn("p", mcnemar(F.col("only_a"), F.col("only_b")))
    span = [f(c).alias(f"{c}_{name}") for c in ("only_a", "only_b", "p") for f, name in ((F.min, "least"), (F.max, "most"))]
    return tests.groupBy("group", "a", "b").agg(*span)


def version_tests(now: DataFrame, before: DataFrame, claims: list[tuple[str, str]]) -> DataFrame:
    """Per run and claim (set, system): McNemar's test of this version against one run of the previous one, query by
    query, with Holm's correction over the claims of a run."""
    keep = ("run", "set", "q")
    wanted = F.array(*(F.concat(F.lit(s), F.lit("|"), F.lit(x)) for s, x in claims))
    claimed = F.array_contains(wanted, F.concat_ws("|", "set", "system"))
    a = outcomes(now, SYSTEMS, keep).where(claimed).select(*keep, "system", F.col("hit1").alias("x"))
    b = outcomes(before, SYSTEMS, keep).where(claimed).select("set", "q", "system", F.col("hit1").alias("y"))
    return holm(_tests(a.join(b, ["set", "q", "system"]), ["run", "set", "system"], "x", "y"), ["run"])


def versions(runs: dict[str, DataFrame], groups_: dict[str, Column], systems: tuple[str, ...] = ("spelling_only", "both")) -> DataFrame:
    """The cells of several versions side by side: version, group, system, n, median, least, most, low, high."""
    out = None
    for name, records in runs.items():
        cells = system_cells(records, groups_).where(F.col("system").isin(*systems)).withColumn("version", F.lit(name))
        out = cells if out is None else out.unionByName(cells)
    return out


def threshold_sweep(answers: DataFrame, low: float = 0.20, high: float = 0.95, step: float = 0.05, ratio: float = 2.0) -> DataFrame:
    """The suggestion rule with its floor moved: floor, recall, false_rate, precision. ``answers`` has one row per case and
    option: id, kind, expect, n (0: as typed), text, p. Texts are compared by their tokens."""
    same = lambda c: F.array_join(tx.tokens(F.col(c)), " ")
    likeliest = F.max(F.when((F.col("n") > 0) & (F.col("p") > 0), F.struct("p", (-F.col("n")).alias("first"), same("text").alias("text"))))
    typed = F.coalesce(F.max(F.when(F.col("n") == 0, F.col("p"))), F.lit(0.0))
    case = answers.groupBy("id", "kind", same("expect").alias("want")).agg(likeliest.alias("best"), typed.alias("typed"))
    floors = F.array(*(F.lit(round(low + step * i, 2)) for i in range(round((high - low) / step) + 1)))
    rows = case.withColumn("floor", F.explode(floors))
    said = F.coalesce((F.col("best.p") >= F.col("floor")) & (F.col("best.p") >= ratio * F.col("typed")), F.lit(False))
    typo, control, right = F.col("kind") == "typo", F.col("kind") == "control", F.col("best.text") == F.col("want")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = rows.groupBy("floor").agg(n(typo).alias("typos"), n(control).alias("controls"), n(typo & said & right).alias("fixed"), n(typo & said & ~right).alias("wrong"), n(control & said).alias("alarms"))
    offered = F.greatest(F.col("fixed") + F.col("wrong") + F.col("alarms"), F.lit(1))
    return g.select("floor", F.try_divide("fixed", "typos").alias("recall"), F.try_divide("alarms", "controls").alias("false_rate"), (F.col("fixed") / offered).alias("precision"))


def stability(rows: DataFrame, answer: str, shown: Column) -> DataFrame:
    """One row: how many queries (set, q) ever show an answer, and for how many of them it differs over runs."""
    per = rows.groupBy("set", "q").agg(F.max(shown).alias("shown"), F.count_distinct(F.struct(F.col(answer).isNull(), F.col(answer))).alias("answers"))
    return per.where("shown").agg(F.count("*").alias("queries"), F.coalesce(F.sum((F.col("answers") > 1).cast("long")), F.lit(0)).alias("changed"))


def follow_each(cases: DataFrame, suggestions: DataFrame, found: DataFrame, plain: DataFrame, judged: DataFrame, hits) -> DataFrame:
    """The three-way comparison as long rows: qid, system, n, hit1, hit10, top. ``found`` answers queries by text (q, pos,
    name, other_names) and holds the cases and all suggestions; ``plain`` and ``judged`` answer cases (qid, pos, name,
    other_names); ``suggestions`` has qid, system, suggestion. ``hits(cases, rows)`` flags each row as relevant."""

    def scored(rows: DataFrame, system) -> DataFrame:
        marked = hits(cases, rows)
        first = F.max(F.when(F.col("pos") == 1, F.col("name")))
        flag = lambda k: F.coalesce(F.max(F.col("relevant") & (F.col("pos") <= k)), F.lit(False))
        g = marked.groupBy("qid").agg(F.count("*").alias("n"), flag(1).alias("hit1"), flag(10).alias("hit10"), first.alias("top"))
        whole = cases.select("qid").join(g, "qid", "left")
        return whole.select("qid", F.lit(system).alias("system"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hit1", F.lit(False)).alias("hit1"), F.coalesce("hit10", F.lit(False)).alias("hit10"), "top")

    by_case = cases.select("qid", "q").join(found, "q").drop("q")
    out = scored(plain, "plain").unionByName(scored(by_case, "sql")).unionByName(scored(judged, "judged"))
    for system in ("judged", "norvig", "frequency"):
        said = suggestions.where((F.col("system") == system) & F.col("suggestion").isNotNull()).select("qid", F.col("suggestion").alias("q"))
        followed = scored(said.join(found, "q").drop("q"), f"followed_{system}").join(said.select("qid"), "qid", "left_semi")
        out = out.unionByName(followed)
    return out


def first_of_each(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
