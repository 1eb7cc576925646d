import re

import corpus_pipeline
from shelfmark.llm import queries

from .test_decontaminate import brute as leaks
from .test_repeats import brute as repeated

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), out.schema)
        after = {r.doc_id: r for r in out.collect()}
        if name == "language_id":
            assert set(after) <= set(before) and len(after) >= 0.97 * len(before)
        if name == "simhash_near_dedup":
            assert len(set(before.values())) >= len(after) == len({r.text for r in after.values()})
        if name == "substring_dedup":
            want = repeated(list(before.items()), 20)
            assert {i: re.findall(r"[^\x20\x09-\x0D]+", r.text) for i, r in after.items()} == {i: want[i, t][2].split(" ") if want[i, t][2] else [] for i, t in before.items()}
            assert all(after[i].text == t for i, t in before.items() if not want[i, t][1])
            assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "decontamination":
            small = {i: t for i, t in before.items() if len(t) < 6000}
            bad = {d for d, _ in leaks(list(small.items()), items)}
            assert {i for i in small if i not in after} == bad
        if name == "bpe":
            assert set(after) == set(before) and all(r.round_trip and r.n_tokens == len(r.ids) for r in after.values())
        else:
            before = {i: r.text for i, r in after.items()}
        docs = out


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).where("round_trip").count() > 100


def test_near_duplicates_keep_one_row_of_each_group(spark):
    texts = [" ".join(f"w{k}n{i}" for i in range(40)) for k in range(4)]
    # a repeated id, a group of null ids alone, null ids beside an id, and rows alike in all columns
    rows = [(5, texts[0], "a"), (5, texts[0], "b"), (5, texts[1], "c"), (None, texts[2], "d"), (None, texts[2], "e"), (None, texts[3], "f"), (7, texts[3], "g"), (7, texts[3], "g"), (6, texts[3], "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, texts.index(r.text)) for r in got.collect()) == [(0, 2), (5, 0), (5, 1), (6, 3)]


def odd(spark, rows=None):
    """Null ids and texts, repeated rows and ids, empty and white texts, and extra columns named like inner ones."""
    prose = queries.table(spark, SF, "documents").orderBy("doc_id").limit(30).collect()
    made = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in prose] + [(None, None, "en", None, None), (None, prose[0].text, None, "s", 5), (1, "", "en", "s", 0), (1, " \n ", "en", "s", 3), (prose[1].doc_id, prose[1].text, "en", "s", 1)]
    made += made[:2] + [(10**12, "word " * 60_000, "en", "s", 300_000)]
    made = made if rows is None else rows
    schema = "doc_id long, text string, lang string, source string, n_chars int, block array<int>, part string, _text string, kept map<string,int>, row double, _id string"
    return spark.createDataFrame([(*m, [1], "p", "t", {"k": 1}, 0.5, "i") for m in made], schema).repartition(3)


def test_stages_on_odd_rows_and_empty_tables(spark):
    docs = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, odd(spark, []), SF)
        assert none.count() == 0, name
        got = stage(spark, docs, SF).collect()
        assert got and len(got) <= docs.count(), name
        if name != "bpe":
            assert none.columns == docs.columns, name
            assert all((r.block, r.part, r._text, r.kept, r.row, r._id) == ([1], "p", "t", {"k": 1}, 0.5, "i") for r in got), name
            assert {r.text for r in got} <= {r.text for r in docs.collect()} or name == "substring_dedup"
        if name == "substring_dedup":
            assert len(got) == docs.count() and sum(r.text is None for r in got) == 1
