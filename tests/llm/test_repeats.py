import random
import re

import pytest

from shelfmark.llm import repeats


def brute(rows, width):
    docs = sorted({(i if i is not None else 2**63 - 1, t or "") for i, t in rows})
    seen, gone = {}, {}
    for i, t in docs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        cut = [False] * len(ws)
        for s in range(len(ws) - width + 1):
            k = tuple(ws[s : s + width])
            if k in seen:
                cut[s : s + width] = [True] * width
            else:
                seen[k] = (i, s)
        gone[i, t] = (len(ws), sum(cut), " ".join(w for w, c in zip(ws, cut, strict=True) if not c))
    return gone


def corpus():
    rnd = random.Random(8)
    vocab = [f"w{i}é" for i in range(80)]
    shared = [[rnd.choice(vocab) for _ in range(rnd.randint(18, 60))] for _ in range(6)]
    out = [(None, None), (None, "x"), (-5, ""), (3000, "a " * 100), (3001, "a b " * 60), (3002, "w " * 19)]
    for i in range(120):
        t = [rnd.choice(vocab) for _ in range(rnd.randint(0, 90))]
        if i % 3 == 0:
            at = rnd.randrange(len(t) + 1)
            t[at:at] = rnd.choice(shared)
        out.append((1000 - i, rnd.choice([" ", "\n", "  \t"]).join(t)))
    out += [(5, out[20][1]), (5, out[20][1]), (2001, out[21][1])]
    return out


@pytest.mark.parametrize("width,options", [(20, {}), (20, {"segments": 1, "cell_bits": 1}), (12, {"segments": 500}), (20, {"fan": 2})])
def test_matches_brute_force(spark, width, options):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _key int").repartition(7)
    got = repeats.remove_repeats(df, width=width, **options).collect()
    want = brute(rows, width)
    assert len(got) == len(rows)
    want_rows = sorted(((str(i), *want[i if i is not None else 2**63 - 1, t or ""]) for i, t in rows))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == want_rows
    assert sum(r.n_removed for r in got) > 300


def test_blocks_split_within_a_task(spark, monkeypatch):
    rows = [(i, " ".join(f"t{(i % 7) * 3 + k}" for k in range(40))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(df).collect()}
    assert got == {i: v for (i, _), v in brute(rows, 20).items()}


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_untouched_bytes_stay(spark):
    rows = [(i, t) for i, t in corpus()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, 20)
    got = repeats.remove_repeats(df, spaced=False).collect()
    assert len(got) == len(rows)
    same = {(i, t) for i, t in rows}
    for r in got:
        if not r.n_removed:
            assert (r.doc_id, r.kept) in same
    assert sorted((str(r.doc_id), r.n_removed, re.findall(r"[^\x20\x09-\x0D]+", r.kept or "")) for r in got) == sorted((str(i), want[k][1], re.findall(r"[^\x20\x09-\x0D]+", want[k][2])) for i, t in rows for k in [(i if i is not None else 2**63 - 1, t or "")])


def test_keeps_columns_of_any_type_and_null_ids(spark):
    text = " ".join(f"v{k}" for k in range(30))
    rows = [(None, text, [1, 2], {"a": 1}), (4, text, None, None), (4, text, [3], {}), (None, "x " + text, [], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, body array<int>, block map<string,int>")
    got = {(r.doc_id, r.n_words): r for r in repeats.remove_repeats(df, keep=("body", "block")).collect()}
    assert {k: r.n_removed for k, r in got.items()} == {(None, 30): 30, (4, 30): 0, (None, 31): 30}
    assert got[None, 30].body == [1, 2] and got[None, 30].block == {"a": 1}
