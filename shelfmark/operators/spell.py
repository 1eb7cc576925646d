"""Spelling candidates for the words of a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stem import is_stop, stemmed
from ..plans.durable import checkpointed
from .catalog import Catalog, prefix_join, top

SIMILAR = 0.3


def typed_words(queries: DataFrame) -> DataFrame:
    """qid, pos, word, stem of each word worth respelling: four letters or more, no digit, no stop word."""
    each = queries.select("qid", F.posexplode(tx.query_tokens(F.col("q"))).alias("p", "word")).select("qid", (F.col("p") + 1).alias("pos"), "word")
    fit = each.where((F.length("word") >= 4) & ~F.col("word").rlike("[0-9]") & ~is_stop(F.col("word")))
    return fit.join(stemmed(fit.select("word").distinct()), "word")


def with_counts(typed: DataFrame, catalog: Catalog) -> DataFrame:
    """Adds matches (of the word's stem), the two commonest completions of other words (c1_, c2_ stem, n, word) and unfinished."""
    by_stem = catalog.words.groupBy("stem").agg(F.max("match_count").alias("matches"))
    full = catalog.words.select(F.col("word").alias("full"), F.col("stem").alias("c_stem"), "match_count", "doc_count")
    longer = prefix_join(typed.select("word").distinct(), "word", full, "full").where("full <> word")
    used = F.min(F.struct((-F.col("doc_count")).alias("d"), "full"))["full"].alias("c_word")
    ranked = longer.groupBy("word", "c_stem").agg(F.max("match_count").alias("c_n"), used)
    w = Window.partitionBy("word").orderBy(F.col("c_n").desc(), "c_stem")
    two = ranked.withColumn("r", F.row_number().over(w)).where("r <= 2")
    pick = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c))).alias(f"c{r}_{c[2:]}")
    both = two.groupBy("word").agg(*(pick(c, r) for r in (1, 2) for c in ("c_stem", "c_n", "c_word")))
    known = catalog.words.select("word", F.lit(True).alias("known"))
    out = typed.join(by_stem, "stem", "left").join(both, "word", "left").join(known, "word", "left")
    unfinished = F.coalesce(F.col("c1_stem") != F.col("stem"), F.lit(False)) & F.col("known").isNull()
    return out.withColumn("matches", F.coalesce("matches", F.lit(0))).withColumn("unfinished", unfinished).drop("known")


def _worth(found: DataFrame) -> DataFrame:
    """Another stem, and more matches than the word and than the completion it competes with."""
    rival = F.when(F.col("alt_stem") == F.col("c1_stem"), F.coalesce("c2_n", F.lit(0))).otherwise(F.coalesce("c1_n", F.lit(0)))
    return found.where((F.col("alt_stem") != F.col("stem")) & (F.col("alt_n") > F.col("matches")) & (F.col("alt_n") > rival))


def similar_words(catalog: Catalog, queries: DataFrame, per_word: int | None = 8, finish_ratio: int | None = 100) -> DataFrame:
    """qid, pos, n (order within the word), word, word_matches, alternative, alternative_matches, completes."""
    most = min(max(8 if per_word is None else per_word, 1), 50)
    ratio = max(100 if finish_ratio is None else finish_ratio, 1)
    c = checkpointed(with_counts(typed_words(queries), catalog))
    each = c.drop("qid", "pos").distinct()
    alts = catalog.words.select(F.col("word").alias("alternative"), F.col("stem").alias("alt_stem"), F.col("match_count").alias("alt_n"))
    near = each.withColumn("alternative", F.explode(tx.edits1(F.col("word")))).join(alts, "alternative")
    edits = _worth(near).select("word", "alternative", "alt_n", F.lit(1).alias("kind"), F.lit(0.0).cast("float").alias("sim"))
    # Trigram join with an exact count filter: similarity >= s needs s x |a| shared trigrams.
    grams = each.select("word", tx.trigrams(F.array("word")).alias("grams"))
    lists = alts.select("alternative", tx.trigrams(F.array("alternative")).alias("alt_grams"))
    shared = grams.select("word", F.size("grams").alias("size"), F.explode("grams").alias("t")).join(lists.select("alternative", F.size("alt_grams").alias("alt_size"), F.explode("alt_grams").alias("t")), "t")
    counted = shared.groupBy("word", "alternative", "size", "alt_size").agg(F.count("*").alias("s"))
    sim = (F.col("s") / (F.col("size") + F.col("alt_size") - F.col("s"))).cast("float")
    alike = counted.withColumn("sim", sim).where((F.col("sim") >= F.lit(SIMILAR).cast("float")) & ~F.startswith("alternative", "word")).select("word", "alternative", "sim")
    close = _worth(alike.join(each, "word").join(alts, "alternative"))
    order = [F.col("sim").desc(), F.col("alt_n").desc(), F.col("alternative")]
    trigram = top(close, ["word"], order, most).select("word", "alternative", "alt_n", F.lit(2).alias("kind"), "sim")
    one = top(edits.unionByName(trigram), ["word", "alternative"], [F.col("kind")], 1)
    w = Window.partitionBy("word")
    offered = one.withColumn("n", F.row_number().over(w.orderBy("kind", *order))).withColumn("best", F.max("alt_n").over(w))
    pairs = c.join(offered, "word")
    enough = F.col("best") >= F.lit(ratio).cast("long") * F.col("c1_n")
    kept = pairs.where((F.col("n") <= most) & (~F.col("unfinished") | (enough & (F.col("alternative") != F.col("c1_word")))))
    finish = pairs.where(F.col("unfinished") & enough & (F.col("n") == 1))
    cols = ["qid", "pos", "n", "word", "word_matches", "alternative", "alternative_matches", "completes"]
    a = kept.select("qid", "pos", "n", "word", F.col("matches").alias("word_matches"), "alternative", F.col("alt_n").alias("alternative_matches"), F.lit(False).alias("completes"))
    b = finish.select("qid", "pos", F.lit(0).alias("n"), "word", F.col("matches").alias("word_matches"), F.col("c1_word").alias("alternative"), F.col("c1_n").alias("alternative_matches"), F.lit(True).alias("completes"))
    return a.select(*cols).unionByName(b.select(*cols))


def spelling_options(queries: DataFrame, similar: DataFrame, most: int = 16) -> DataFrame:
    """qid, n (0: as typed), text, edits, completes: respellings of one word each, every word's closest before any word's second."""
    q = queries.select("qid", tx.query_tokens(F.col("q")).alias("tokens"))
    rows = similar.join(q, "qid").where(F.get("tokens", F.col("pos") - 1) == F.col("word"))
    turn = F.row_number().over(Window.partitionBy("qid", "pos").orderBy("n"))
    respelt = F.array_join(F.transform("tokens", lambda t, i: F.when(i + 1 == F.col("pos"), F.col("alternative")).otherwise(t)), " ")
    texts = rows.withColumn("turn", turn).select("qid", "turn", "pos", respelt.alias("text"), tx.edit_distance(F.col("word"), F.col("alternative")).alias("edits"), "completes")
    typed = q.select("qid", F.lit(0).alias("turn"), F.lit(0).alias("pos"), F.array_join("tokens", " ").alias("text"), F.lit(0).alias("edits"), F.lit(False).alias("completes"))
    first = top(typed.unionByName(texts), ["qid", "text"], [F.col("turn"), F.col("pos")], 1)
    n = F.row_number().over(Window.partitionBy("qid").orderBy("turn", "pos")) - 1
    return first.withColumn("n", n).where(F.col("n") < most).select("qid", "n", "text", "edits", "completes")


def suggestion(options: DataFrame, probabilities: DataFrame, suggest_at: float = 0.3, ratio: float = 2.0) -> DataFrame:
    """qid, suggestion (or null), p, ran. ``probabilities`` (qid, n, p) come from a scorer; queries with one option, or
    without any probability, are not judged."""
    rows = options.join(probabilities, ["qid", "n"], "left")
    mine = (F.col("n") == 0) | F.col("completes")
    likeliest = F.max(F.when(~mine & (F.col("p") > 0), F.struct("p", (-F.col("n")).alias("first"), "text")))
    agg = rows.groupBy("qid").agg(F.count("*").alias("options"), F.count("p").alias("given"), F.coalesce(F.sum(F.when(mine, F.col("p"))), F.lit(0.0)).alias("kept"), likeliest.alias("best"))
    ran = (F.col("options") > 1) & (F.col("given") > 0)
    p = F.coalesce(F.col("best.p"), F.lit(0.0))
    good = ran & (p >= suggest_at) & (p >= ratio * F.col("kept"))
    return agg.select("qid", F.when(good, F.col("best.text")).alias("suggestion"), F.when(ran, p).otherwise(0.0).alias("p"), ran.alias("ran"))


def frequency_rule(queries: DataFrame, similar: DataFrame, least: int = 10) -> DataFrame:
    """qid, corrected: the query with one word respelled, to the commonest candidate of any of its words that has at least
    ``least`` times the word's own matches (or that many); null if there is none. Ties go to the first word and candidate."""
    q = queries.select("qid", tx.query_tokens(F.col("q")).alias("tokens"))
    rows = similar.join(q, "qid").where(F.get("tokens", F.col("pos") - 1) == F.col("word"))
    ok = rows.where(~F.col("completes") & (F.col("alternative_matches") >= least * F.greatest("word_matches", F.lit(1))))
    best = top(ok, ["qid"], [F.col("alternative_matches").desc(), F.col("pos"), F.col("n")], 1)
    respelt = F.array_join(F.transform("tokens", lambda t, i: F.when(i + 1 == F.col("pos"), F.col("alternative")).otherwise(t)), " ")
    return queries.select("qid").join(best.select("qid", respelt.alias("corrected")), "qid", "left")


def known_edits(words: DataFrame, catalog: Catalog) -> DataFrame:
    """word, alternative, edits, doc_count: vocabulary one edit away, else two, that more documents hold than the word;
    n orders them by distance, count and word."""
    vocabulary = catalog.words.select(F.col("word").alias("alternative"), "doc_count")
    own = catalog.words.select("word", F.col("doc_count").alias("own"))
    base = words.select("word").distinct().join(own, "word", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    once = base.withColumn("e", F.explode(tx.edits1(F.col("word"))))
    fit = lambda d, k: d.join(vocabulary, F.col("e") == F.col("alternative")).where("doc_count > own and alternative <> word").select("word", "alternative", F.lit(k).alias("edits"), "doc_count").distinct()
    near = checkpointed(fit(once, 1))
    far = once.join(near.select("word").distinct(), "word", "left_anti").select("word", "own", F.explode(tx.edits1(F.col("e"))).alias("e")).distinct()
    both = near.unionByName(fit(far, 2))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("word").orderBy("edits", F.col("doc_count").desc(), "alternative")))


def norvig(catalog: Catalog, queries: DataFrame) -> DataFrame:
    """qid, corrected: each eligible unknown word by its best known edit; null if nothing changes."""
    each = queries.select("qid", F.posexplode(tx.query_tokens(F.col("q"))).alias("pos", "word"))
    typed = each.where((F.length("word") >= 4) & ~F.col("word").rlike("[0-9]") & ~is_stop(F.col("word")))
    unknown = typed.select("word").distinct().join(catalog.words.select("word"), "word", "left_anti")
    best = known_edits(unknown, catalog).where("n = 1").select("word", "alternative")
    done = each.join(best, "word", "left").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("alternative", "word").alias("w")))).alias("ws"), F.count("alternative").alias("changed"))
    return done.select("qid", F.when(F.col("changed") > 0, F.array_join(F.transform("ws", lambda x: x["w"]), " ")).alias("corrected"))
