import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import crf


@pytest.mark.parametrize("chunk", [3, 64])
def test_posteriors_match_enumeration(monkeypatch, chunk):
    monkeypatch.setattr(crf, "CHUNK", chunk)
    rnd = np.random.default_rng(0)
    sizes, k = [5, 0, 1, 7, 3], 3
    first = np.r_[0, np.cumsum(sizes)]
    score, step, start = rnd.normal(size=(first[-1], k)) * 2, rnd.normal(size=(k, k)), rnd.normal(size=k)
    got = crf.posteriors(score, first, step, start)
    for a, b in itertools.pairwise(first):
        want = np.zeros((b - a, k))
        for y in itertools.product(range(k), repeat=b - a):
            if y:
                p = np.exp(start[y[0]] + sum(score[a + i, c] for i, c in enumerate(y)) + sum(step[c, d] for c, d in itertools.pairwise(y)))
                for i, c in enumerate(y):
                    want[i, c] += p
        if b > a:
            assert np.allclose(got[a:b], want / want.sum(1, keepdims=True))


def corpus():
    rnd = random.Random(1)
    syl = {"xx": ["th", "ing", "er", "on"], "yy": ["sch", "ung", "er", "ö"], "zz": ["ção", "que", "on", "é"]}
    word = lambda lang: "".join(rnd.choice(syl[lang]) for _ in range(rnd.randint(1, 4)))
    return [(i, " ".join(word(lang) for _ in range(rnd.randint(5, 300))), lang) for i, lang in enumerate(rnd.choices(sorted(syl), k=200))], word


def test_held_out_accuracy_and_code_switching(spark):
    rows, word = corpus()
    mixed = " ".join([word("xx") for _ in range(90)] + [word("yy") for _ in range(40)])
    odd = [(1000, None, "xx"), (1001, "", "xx"), (1002, "123 !?", "xx"), (1003, "€ —", "xx"), (None, rows[0][1], None), (1004, mixed, None), (1005, "É", None), (1006, "thing " * 20000, None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "doc_id long, text string, lang string, score double")
    model = crf.fit(df, F.col("doc_id") % 2 == 0, per_language=30)
    got = {r.doc_id: r for r in crf.identify(df, model).collect()}
    test = [r for r in rows if r[0] % 2]
    assert sum(got[i].lang_pred == lang for i, _, lang in test) >= 0.97 * len(test)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002, 1003))
    assert got[None].lang_pred == rows[0][2] and got[1005].lang_pred != "und"
    assert got[1004].lang_pred == "xx" and 0.55 < got[1004].score < 0.85 and got[1006].lang_pred == "xx"


def test_nothing_to_learn_and_empty(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert crf.identify(df, crf.fit(df, F.lit(True))).first().lang_pred == "und"
    assert crf.identify(df.limit(0), crf.fit(df.limit(0), F.lit(True))).count() == 0


def test_expected_pairs_match_enumeration_and_the_slope_of_the_likelihood():
    rnd = np.random.default_rng(4)
    bounds, k = np.array([0, 4, 5, 9]), 3
    score, y = rnd.normal(size=(9, k)), rnd.integers(0, k, 9)
    model = crf.Model(["a", "b", "c"], np.zeros((1, k)), rnd.normal(size=(k, k)), rnd.normal(size=k))
    inner = np.ones(9, bool)
    inner[bounds[:-1]] = False

    def paths(a, b, step):
        for c in itertools.product(range(k), repeat=b - a):
            yield c, np.exp(model.start[c[0]] + sum(score[a + i, x] for i, x in enumerate(c)) + sum(step[x, z] for x, z in itertools.pairwise(c)))

    def likelihood(step):
        out = 0.0
        for a, b in itertools.pairwise(bounds):
            all_ = dict(paths(a, b, step))
            out += np.log(all_[tuple(y[a:b])] / sum(all_.values()))
        return out

    want = np.zeros((k, k))
    for a, b in itertools.pairwise(bounds):
        total = sum(p for _, p in paths(a, b, model.step))
        for c, p in paths(a, b, model.step):
            for x, z in itertools.pairwise(c):
                want[x, z] += p / total
    post = crf.posteriors(score, bounds, model.step, model.start)
    got = crf._pairs(score, post, bounds, model, inner)
    assert np.allclose(got, want)
    gold = np.zeros((k, k))
    np.add.at(gold, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
    for x in range(k):
        for z in range(k):
            up, down = model.step.copy(), model.step.copy()
            up[x, z] += 1e-5
            down[x, z] -= 1e-5
            assert (likelihood(up) - likelihood(down)) / 2e-5 == pytest.approx((gold - got)[x, z], abs=1e-5)


def test_features_and_emissions_match_brute_force():
    import pyarrow as pa

    w, h = crf._tokens(pa.array(["Ab éc x"]))
    buckets, begin, value = crf.features(w, np.arange(3), h)
    weight = np.random.default_rng(0).normal(size=(crf.BUCKETS, 2))
    got = crf.emissions(weight, buckets, begin, value)
    code = lambda b: int(crf.mix(np.array([int.from_bytes(b, "little") + (len(b) << 56)], np.uint64))[0] % crf.BUCKETS)
    for i, word in enumerate(["ab", "éc", "x"]):
        marked = b"\x01" + word.encode() + b"\x02"
        grams = [marked[a : a + n] for n in crf.GRAMS for a in range(len(marked) - n + 1)]
        own = [int(crf.mix(h[i : i + 1] + np.uint64(77))[0] % crf.BUCKETS), *map(code, grams)]
        assert np.allclose(got[i], weight[own].sum(0) / np.sqrt(len(own)))


def test_many_languages_are_no_reason_to_refuse(spark):
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)}word " * 4, f"l{i:03}") for i in range(520)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = crf.fit(df, F.lit(True), steps=2)
    assert len(model.langs) == 520 and model.weight.size <= 1 << 23
    got = {r.doc_id: r.lang_pred for r in crf.identify(df, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) > 260


def test_repeated_rows_and_ties(spark):
    df = spark.createDataFrame([(1, "abc", "b"), (1, "abc", "b"), (2, "abc", "a"), (2, "abc", "a")], "doc_id long, text string, lang string")
    got = crf.identify(df, crf.fit(df, F.lit(True))).collect()
    assert len(got) == 4 and len({(r.lang_pred, r.score) for r in got}) == 1
