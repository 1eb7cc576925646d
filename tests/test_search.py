"""Golden behaviour on a small catalog of our own."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from shelfmark import queries, queries_eval
from shelfmark.functions.stem import stem
from shelfmark.operators import catalog, evaluate, group, judge, retrieve, spell, stats
from shelfmark.plans.durable import checkpointed, release, trim_native, vm_option

ROWS = [
    ("1", "Lunaro Flakes", "Northmill", "lunaro", "00023000111222", "Cereal", 80.0), ("2", "Maple Lunaro Flakes", "Northmill", "lunaro", "00023000111333", "Cereal", 40.0), ("3", "Lunaro", "Northmill", "lunaro", "0023000999000", "Cereal", 5.0),
    ("4", "Blackberry Spread", "Fenwick", None, "051511100022", "Spreads", 20.0), ("5", "Blackberries", "Fenwick", None, "051511100039", "Produce", 30.0), ("6", "Goat Cheese", "Alder", None, "742000000012", "Dairy", 60.0),
    ("7", "Goat Cheese", "Birch", None, "742000000029", "Dairy", None), ("8", "Crème-Fraîche 23000 Tub", "Alder", None, None, "Dairy", 9.0), ("9", "Lunarro Rings", "Copycat", None, "041000000017", "Cereal", 70.0), ("10", "Salt/Pepper Mix.Jar", None, None, "", "Pantry", 3.0),
]


@pytest.fixture(scope="module")
def cat(spark):
    rows = [(i, n, b, g, c, {"category": k} | ({"brand": b} if b else {}), r) for i, n, b, g, c, k, r in ROWS]
    return catalog.build(spark.createDataFrame(rows, "id string, name string, other_names string, group_key string, code string, facets map<string,string>, rank double"))


def ask(spark, *qs, lim=None, filters=None):
    return spark.createDataFrame([(i, q, filters, lim) for i, q in enumerate(qs)], "qid long, q string, filters map<string,string>, lim int")


def found(spark, cat, *qs, **kw):
    out = {i: [] for i in range(len(qs))}
    for r in retrieve.search(cat, ask(spark, *qs, **kw)).orderBy("qid", "pos").collect():
        out[r.qid].append((r.step, r.id))
    return [(v[0][0] if v else None, [i for _, i in v]) for v in out.values()]


def test_stems():
    known = {"cheerios": "cheerio", "mills": "mill", "chocolate": "chocol", "imagine": "imagin", "running": "run", "hopping": "hop", "generously": "generous", "nationality": "nation", "skies": "sky", "early": "earli", "agreed": "agre", "flies": "fli", "a1s": "a1s"}
    assert {w: stem(w) for w in known} == known


def test_steps(spark, cat):
    got = found(spark, cat, "lunaro", "the blackb", "llunaro", "023000111222", "0023000", "23000", "9999", "salt", "jar", "the", "", "GOAT cheese", "creme")
    assert got[0] == ("word", ["3", "1", "2"]) and got[1] == ("prefix", ["5", "4"])
    assert got[2][0] == "typo" and set(got[2][1]) == {"1", "2", "3"}
    assert got[3] == ("code", ["1"]) and got[4] == ("code", ["1", "2", "3"]) and got[5] == ("code", ["1", "2", "3"])
    assert got[6][0] != "code" and got[7] == ("word", ["10"]) and got[8] == ("word", ["10"])
    assert got[9] == (None, []) and got[10] == (None, []) and got[11] == ("word", ["6", "7"])


def test_filters_limits_and_caps(spark, cat):
    assert found(spark, cat, "0023000", filters={"category": "Dairy"})[0][0] != "code"
    assert found(spark, cat, "lunaro", filters={"brand": "Copycat"})[0][0] in ("prefix", "typo")
    assert found(spark, cat, "flakes", lim=0) == [("word", ["1"])]
    assert found(spark, cat, "goat " * 32 + "salt", "goat" + " " * 260 + "salt") == [("word", ["6", "7"])] * 2


def test_batch_equals_one_by_one(spark, cat):
    qs = ["lunaro", "luanro", "goat", "blackb"]
    assert found(spark, cat, *qs) == [found(spark, cat, q)[0] for q in qs]


def test_groups_suggestions_facets(spark, cat):
    assert [r.id for r in group.query_distinct(cat, ask(spark, "lunaro")).orderBy("pos").collect()] == ["3"]
    got = [(r.name, r.id, r.doc_count) for r in group.suggest(cat, ask(spark, "goat", "bla")).orderBy("qid", "pos").collect()]
    assert got == [("Goat Cheese", "6", 2), ("Blackberries", "5", 1), ("Blackberry Spread", "4", 1)]
    got = {(r.facet, r.value): r.doc_count for r in group.facets(cat, ask(spark, "goat")).collect()}
    assert got == {("category", "Dairy"): 2, ("brand", "Alder"): 1, ("brand", "Birch"): 1}


def test_spelling(spark, cat):
    q = ask(spark, "luanro", "gaot chesee", "lunaro", "blackb", "with", "abc")
    rows = [(r.qid, r.pos, r.alternative) for r in spell.similar_words(cat, q).orderBy("qid", "pos", "n").collect()]
    assert rows[0] == (0, 1, "lunaro") and (1, 1, "goat") in rows and (1, 2, "cheese") in rows and not [r for r in rows if r[0] > 1]
    options = spell.spelling_options(q, spell.similar_words(cat, q))
    texts = [r.text for r in options.where("qid = 1").orderBy("n").collect()]
    assert texts[0] == "gaot chesee" and texts[1:3] == ["goat chesee", "gaot cheese"]
    p = spark.createDataFrame([(0, 0, 0.2), (0, 1, 0.6), (1, 0, 0.4), (1, 1, 0.6)], "qid long, n int, p double")
    said = {r.qid: r.suggestion for r in spell.suggestion(options, p).collect()}
    assert said[0] == "lunaro" and said[1] is None
    assert {r.qid: r.corrected for r in spell.norvig(cat, q).collect()}[1] == "goat cheese"


def test_keep_or_sink(spark, cat):
    page = spark.createDataFrame([(1, i, str(i), f"n{i}", None, f"n{i}", None, "word", "zzz") for i in range(1, 5)], "qid long, pos int, id string, name string, other_names string, name_key string, group_key string, step string, query string")
    score = lambda *s: spark.createDataFrame([(1, i, x) for i, x in enumerate(s)], "qid long, idx int, score double")
    ids = lambda df: [r.id for r in df.orderBy("new_pos").collect()]
    assert ids(judge.keep_or_sink(page, score(0.9, 0.1, 0.8, 0.2))) == ["1", "3", "2", "4"]
    assert ids(judge.keep_or_sink(page, score(0.1, 0.9), top=2)) == ["2", "1", "3", "4"]
    kept = judge.keep_or_sink(page, score(0.1, 0.1, None, 0.1))
    assert ids(kept) == ["1", "2", "3", "4"] and not kept.first().reranked
    assert judge.keep_or_sink(page, score(0.1, 0.1, 0.2, 0.1)).first().no_match
    assert not judge.keep_or_sink(page, score(0.9, 0.9, 0.9, 0.9), threshold=float("nan")).first().reranked


def test_page_and_refresh(spark, cat, tmp_path):
    scorer = lambda rows: judge.with_scores(rows, lambda pdf: pdf["text"].str.len() * 0.0 + 0.5)
    page, said = judge.search_page(cat, ask(spark, "lunarro flakes", lim=10), scorer, scorer)
    assert judge.shape(page, said).count() == 1
    root = f"file://{tmp_path}/cat"
    src = cat.documents.select("id", "name", "other_names", "group_key", "code", "facets", "rank")
    catalog.refresh(src.where("id < '5'"), root, "v1")
    assert found(spark, catalog.current(spark, root), "goat")[0][1] == []
    catalog.refresh(src, root, "v2")
    assert found(spark, catalog.current(spark, root), "goat")[0][1] == ["6", "7"]
    with pytest.raises(ValueError):
        catalog.build(src.union(src))


def test_unfinished_words_and_stop_words(spark):
    names = ["Monk Fruit Sweetener", "Monkey Bread", "Monkey Nuts", "Imagine Broth", "The Ginger People", "Of Ginger"]
    rows = [(str(i), n, None, None, None, {}, float(i)) for i, n in enumerate(names)]
    c = catalog.build(spark.createDataFrame(rows, "id string, name string, other_names string, group_key string, code string, facets map<string,string>, rank double"))
    got = found(spark, c, "monke", "imagin", "the ginger", "of", "monk", "ginger the people")
    assert got[0] == ("prefix", ["2", "1"])  # its commonest completion has another stem: still being typed
    assert got[1] == ("word", ["3"])  # the completion has the same stem
    assert got[2] == ("word", ["5", "4"]) and got[5] == ("word", ["4"]) and got[3] == (None, [])
    assert got[4] == ("word", ["0"])


def test_completions_need_a_far_commoner_rival(spark):
    names = ["Bread"] * 3 + ["Breadfruit"] + ["Dread Ale"] * 400
    rows = [(str(i), n, None, None, None, {}, 1.0) for i, n in enumerate(names)]
    c = catalog.build(spark.createDataFrame(rows, "id string, name string, other_names string, group_key string, code string, facets map<string,string>, rank double"))
    rows = spell.similar_words(c, ask(spark, "brea")).orderBy("n").collect()
    assert [(r.alternative, r.completes) for r in rows] == []  # "brea" is being typed; no candidate is 100 times as common
    one = spell.similar_words(c, ask(spark, "brea"), finish_ratio=1).orderBy("n").collect()
    assert not one or (one[0].completes and one[0].alternative == "bread")


def test_equal_queries_share_an_answer_and_keep_their_filters(spark, cat):
    q = spark.createDataFrame([(1, "goat", None, None), (2, "goat", None, None), (3, "goat", {"brand": "Alder"}, None), (4, " GOAT ", None, 1)], "qid long, q string, filters map<string,string>, lim int")
    got = {}
    for r in retrieve.search(cat, q).orderBy("qid", "pos").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {1: ["6", "7"], 2: ["6", "7"], 3: ["6"], 4: ["6"]}


def test_scorers_that_fail_or_are_late_leave_the_page_alone(spark, cat):
    import time

    q = ask(spark, "goat", "lunaro flakes", "blackberries", lim=10)

    def score(pdf):
        if pdf["qid"].iloc[0] == 0:
            raise RuntimeError("down")
        if pdf["qid"].iloc[0] == 1:
            time.sleep(3)
        return [0.0] * len(pdf)

    rows = spark.createDataFrame([(i, k, "q", "t") for i in range(3) for k in range(2)], "qid long, idx int, query string, text string")
    got = {r.qid: r.n for r in judge.with_scores(rows, score, 0.5).groupBy("qid").agg({"score": "count"}).withColumnRenamed("count(score)", "n").collect()}
    assert got == {0: 0, 1: 0, 2: 2}

    def broken(_):
        raise RuntimeError("cannot even ask")

    page, said = judge.search_page(cat, q, broken, broken)
    assert page.count() > 0 and not page.where("reranked").count() and said.where("suggestion is not null").count() == 0


def test_loads_and_pointers_change_in_one_step(spark, tmp_path):
    from shelfmark.plans import files
    from shelfmark.sources import demo

    path = f"file://{tmp_path}/table"
    demo.load_all_or_nothing(spark.range(3), path)
    with pytest.raises(FileExistsError):
        demo.load_all_or_nothing(spark.range(9), path)
    with pytest.raises(OSError):
        files.put_in_place(spark, f"{path}.missing", path)  # the older table comes back
    assert spark.read.parquet(path).count() == 3
    demo.load_all_or_nothing(spark.range(5), path, replace=True)
    assert spark.read.parquet(path).count() == 5 and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["table"]
    for v in ("a", "b"):
        files.write_text(spark, f"file://{tmp_path}/now", v)
        assert spark.read.text(f"file://{tmp_path}/now").first().value == v


def test_no_local_folder_off_a_local_master():
    from shelfmark.plans import durable

    class Conf:
        def get(self, *_):
            return None

    class Far:
        class sparkContext:  # noqa: N801
            master = "yarn"

            @staticmethod
            def getConf():
                return Conf()

        conf = Conf()

    with pytest.raises(ValueError):
        durable.shared_dir(Far)


def test_catalog_is_built_once_and_anew_when_it_must(spark, tmp_path):
    from shelfmark.plans.durable import discard

    def write(names):
        rows = [(i, n, "Brand#1", "T", 1, 1.0) for i, n in enumerate(names)]
        spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")

    write(["red widget", "blue bolt"])
    first = queries.part_catalog(spark, str(tmp_path))
    assert queries.part_catalog(spark, str(tmp_path)) is first
    discard(first.words)
    second = queries.part_catalog(spark, str(tmp_path))
    assert second is not first and second.words.where("word = 'bolt'").count() == 1
    write(["red widget", "green gear"])
    third = queries.part_catalog(spark, str(tmp_path))
    assert {r.word for r in third.words.collect()} >= {"green", "gear"} and third.words.where("word = 'bolt'").isEmpty()


def sent(df):
    """The tables in files that the plan of a frame would gather and broadcast."""
    out, at = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        at = None if at is not None and depth <= at else at
        if at is None and "BroadcastExchange" in line:
            at = depth
        if at is not None and "FileScan" in line:
            out.append(line.strip())
    return out


@pytest.mark.parametrize("step", retrieve.STEPS)
def test_no_step_broadcasts_the_catalog(spark, cat, step):
    """Spark takes compressed tables for small ones; a catalog of 1.2 million rows, gathered by prefix, fills the driver."""
    q = retrieve.parse(ask(spark, "lunaro", "0023000", "blackb"))
    assert sent(getattr(retrieve, f"{step}_step")(q, cat)) == []


def test_no_list_broadcasts_the_catalog(spark, cat, monkeypatch):
    hits = checkpointed(spark.createDataFrame([(0, "1", "word", 1)], "qid long, id string, step string, pos int"))
    monkeypatch.setattr(group, "search", lambda catalog, queries: hits)
    q = ask(spark, "lunaro")
    assert [sent(f(cat, q)) for f in (group.query_distinct, group.suggest, group.facets)] == [[], [], []]


def test_mcnemar_of_large_counts(spark):
    def exact(b, c):
        return min(1.0, float(Fraction(2 * sum(math.comb(b + c, k) for k in range(min(b, c) + 1)), 2 ** (b + c)))) if b + c else 1.0

    cases = [(0, 0), (0, 1), (0, 40), (1, 9), (5, 5), (14, 31), (31, 33), (40, 90), (900, 1000), (2000, 1800), (500, 3500)]
    large = (2_000_000_000, 2_000_100_000)  # by the normal distribution, which is exact to 8 digits there
    df = spark.createDataFrame([*cases, large], "b long, c long")
    got = {(r.b, r.c): r.p for r in df.select("b", "c", stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()}
    assert all(got[k] == pytest.approx(exact(*k), rel=1e-11, abs=1e-300) for k in cases)
    assert got[large] == pytest.approx(math.erfc((100_000 - 1) / math.sqrt(2 * sum(large))), rel=1e-7)


def ran(df):
    """The plan that ran, once Spark had seen the sizes of its exchanges."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_results_are_never_broadcast(spark, cat):
    """They hold every match of a query without a limit, and are small only as compressed."""
    assert "BroadcastHashJoin" not in ran(retrieve.search(cat, ask(spark, "lunaro", "goat")))


def test_hits_read_no_results_behind_the_last_place(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    rows = spark.createDataFrame([(1, 3, True), (1, 4, True), (2, 11, True), (2, 12, False)], "qid long, pos int, relevant boolean")
    got = evaluate.hit_at_k(cases, rows)
    assert sorted((r.qid, r.hit1, r.hit3, r.hit10) for r in got.collect()) == [(1, False, True, True), (2, False, False, False), (3, False, False, False)]
    assert "pos#" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "<= 10)" in plan.split("Join", 1)[1]


@pytest.mark.parametrize(("step", "most"), [("word", 9), ("prefix", 11), ("typo", 10)])
def test_steps_leave_short_plans(spark, cat, step, most):
    """The driver plans a plan anew after each of its exchanges; what is small is stored before the next part is planned."""
    q = checkpointed(retrieve.parse(ask(spark, "lunaro", "the blackb", "llunaro")))
    plan = getattr(retrieve, f"{step}_step")(q, cat)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= most


def test_lists_are_stored_once(spark, cat):
    """A list of at most 1,000 rows a query is used several times; its plan is not run again for each."""
    plans = [f(cat, ask(spark, "goat"))._jdf.queryExecution().optimizedPlan().toString() for f in (group.query_distinct, group.facets)]
    assert "Join" not in plans[0] and "Join" not in plans[1]


def test_freed_native_memory_goes_back_to_the_system(spark):
    """The compiler's and threads' freed memory stays with the driver else; ``release`` leaves errors out, so ask for it here."""
    assert trim_native(spark)


def test_the_heap_shrinks_to_what_is_left_in_it(spark):
    """Of itself the JVM keeps up to 70 % of its heap free after a collection; its setting stays as it was."""
    heap, was = spark.sparkContext._jvm.Runtime.getRuntime(), vm_option(spark, "MaxHeapFreeRatio")
    room = spark.sparkContext._jvm.java.lang.StringBuilder()
    room.ensureCapacity(300 << 20)
    room.trimToSize()
    release(spark)
    assert heap.freeMemory() <= 0.5 * heap.totalMemory() and vm_option(spark, "MaxHeapFreeRatio") == was


def test_a_search_begins_without_garbage(spark, cat, monkeypatch):
    seen = []
    monkeypatch.setattr(retrieve, "release", lambda *a: seen.append("release"))
    monkeypatch.setattr(retrieve, "code_step", lambda *a, f=retrieve.code_step: seen.append("step") or f(*a))
    retrieve.search(cat, ask(spark, "goat"))
    assert seen[:2] == ["release", "step"]


def test_a_built_catalog_leaves_no_garbage(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(catalog, "release", seen.append)
    catalog.build(queries.part_source(spark, "/root/testdata/sf0.001"))
    assert len(seen) == 1


def test_search_and_its_groups_come_from_one_search(spark, cat, monkeypatch):
    rows = [(0, "lunaro", None, 2), (1, "goat", None, None), (2, "lunaro", None, 0), (3, "blackb", None, 5000), (4, "the", None, 3)]
    q = spark.createDataFrame(rows, "qid long, q string, filters map<string,string>, lim int")
    want = [sorted(map(tuple, f(cat, q).collect())) for f in (retrieve.search, group.query_distinct)]
    asked = []
    monkeypatch.setattr(group, "search", lambda *a: asked.append(a) or retrieve.search(*a))
    got = group.search_and_distinct(cat, q)
    assert [sorted(map(tuple, x.select("qid", "id", "step", "pos").collect())) for x in got] == want and len(asked) == 1


@pytest.mark.parametrize("name", ["overlap", "mean_overlap"])
def test_overlaps_search_once(spark, monkeypatch, name):
    asked = []
    monkeypatch.setattr(group, "search", lambda *a: asked.append(a) or retrieve.search(*a))
    monkeypatch.setattr(retrieve, "search", lambda *a, f=retrieve.search: asked.append(a) or f(*a))
    queries_eval.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len({id(a[1]) for a in asked}) == 1


def test_names_are_ranked_once(spark, cat, monkeypatch):
    stored = []
    monkeypatch.setattr(group, "checkpointed", lambda df: stored.append(df) or checkpointed(df))
    group.suggest(cat, ask(spark, "goat", "bla"))
    assert stored[0]._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_filled_suggestions_are_stored_before_their_names_are_looked_up(spark, cat):
    got = group.suggest(cat, ask(spark, "luna flakes", "flakes"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 1
    assert [(r.qid, r.pos, r.name) for r in got.orderBy("qid", "pos").collect()][-2:] == [(1, 1, "Lunaro Flakes"), (1, 2, "Maple Lunaro Flakes")]
