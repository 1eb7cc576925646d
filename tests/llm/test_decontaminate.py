import random
import re
from collections import Counter

import pytest

from shelfmark.llm import decontaminate


def ws(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower())


def sh(w):
    k = min(5, len(w))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []


def brute(docs, items, least=0.8):
    held = Counter(s for _, t in items for s in set(sh(ws(t))))
    out = {}
    for d, text in docs:
        w = ws(text)
        for j, t in items:
            n, b = len(ws(t)), Counter(sh(ws(t)))
            if not any(set(b) & set(zip(*(w[i:] for i in range(k)))) for k in {min(5, n)}):
                continue  # nothing in common: similarity 0 everywhere
            for s in range(len(w) - n + 1) if n else []:
                a = Counter(sh(w[s : s + n]))
                wt = lambda x: 1 / held[x] if held[x] else 1.0
                sim = sum(wt(x) * min(a[x], b[x]) for x in a | b) / sum(wt(x) * max(a[x], b[x]) for x in a | b)
                if sim >= least - 1e-9 and sim > out.get((d, j), (0, 0))[0] + 1e-9:
                    out[d, j] = (sim, s)
    return out


def data():
    rnd = random.Random(6)
    vocab = [f"w{i}é" for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(8, 40)))) for i in range(25)]
    items += [(50, items[0][1] + " tail more words here"), (51, "Only three words"), (52, None), (53, "--"), (54, "a a a a a a a a a a"), (55, items[1][1])]
    docs = [(None, items[2][1]), (-1, None), (-2, ""), (-3, "only, THREE words!"), (-4, "a " * 30)]
    for i in range(330):
        t = [rnd.choice(vocab) for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, 2)):
            p = ws(rnd.choice(items)[1])
            if p and rnd.random() < 0.5:
                p[rnd.randrange(len(p))] = "edit"
            if p and rnd.random() < 0.3:
                del p[rnd.randrange(len(p))]
            at = rnd.randrange(len(t) + 1)
            t[at:at] = p
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(t).upper()))
    return docs, items


@pytest.mark.parametrize("slice_items", [20_000, 7])
def test_matches_brute_force(spark, slice_items):
    docs, items = data()
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item long").repartition(4)
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontaminate.contaminated(d, b, slice_items=slice_items).collect()}
    same(got, brute(docs, items))
    assert len(got) > 100


def test_block_index_finds_all_within_the_radius():
    import numpy as np

    _, items = data()
    it = decontaminate.Items([i for i, _ in items], [t for _, t in items], 23)
    fp = np.random.default_rng(0).integers(0, 2**63, 3000, dtype=np.uint64)
    fp[:500] = it.fp[0] ^ (fp[:500] & fp[500:1000])
    for n in it.of_size:
        fp[500 : 500 + len(items)] = it.fp ^ np.uint64(0xFF00FF)  # 16 bits away, in two bytes
        window, item = it.candidates(fp, n)
        want = {(i, j) for j in it.of_size[n].tolist() for i in np.flatnonzero(np.bitwise_count(fp ^ it.fp[j]) <= 23).tolist()}
        assert set(zip(window.tolist(), item.tolist(), strict=True)) == want and want


def test_hot_shingles_are_looked_at_in_parts(monkeypatch):
    docs, items = templated()
    whole = scanned(docs, items)
    monkeypatch.setattr(decontaminate, "CHUNK", 50)
    assert scanned(docs, items) == whole and len(whole) > 100


def test_empty(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    assert decontaminate.contaminated(d, b).count() == 0 and decontaminate.contaminated(one, b).count() == 0
    assert decontaminate.contaminated(d, one.withColumnRenamed("doc_id", "item_id")).count() == 0


def templated():
    """Items repeated ten times, and documents that hold one with its first or last word edited."""
    rnd = random.Random(8)
    items, docs = [], []
    for g in range(6):
        body = [f"g{g}x{rnd.randrange(10**6)}" for _ in range(64)]
        items += [(10 * g + i, " ".join(body)) for i in range(10)]
        for i in range(10):
            text = [*body[:-1], f"edit{g}n{i}"] if i % 2 else [f"edit{g}n{i}", *body[1:]]
            docs.append((10 * g + i, " ".join([f"before{i}"] * (i % 4) + text + ["after"] * (i % 3))))
    return docs, items


def same(got, want):
    assert set(got) == set(want), (len(set(want) - set(got)), len(set(got) - set(want)), len(want))
    for k in got:
        assert got[k][0] == pytest.approx(want[k][0], abs=1e-9) and got[k][1] == want[k][1], (k, got[k], want[k])


def scanned(docs, items):
    """The scan without Spark."""
    import pyarrow as pa

    it = decontaminate.Items([i for i, _ in items], [t or "" for _, t in items], decontaminate.RADIUS, decontaminate.SIMILARITY)
    w, h = decontaminate._hashed(pa.array([t for _, t in docs], pa.string()))
    return {(docs[r[0]][0], it.ids[r[1]]): (r[3], r[2]) for r in it.scan(h, w.first, decontaminate.SIMILARITY)}


@pytest.mark.parametrize("given", [data, templated])
def test_no_pair_is_missed(given):
    docs, items = given()
    want = brute(docs, items)
    assert len(want) > 100
    same(scanned(docs, items), want)


@pytest.mark.parametrize("given", [data, templated])
def test_slices_give_the_rows_of_one_slice(spark, given):
    docs, items = given()
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    sliced = decontaminate.contaminated(d, b, slice_items=7)
    rows = [sorted(map(repr, x.collect())) for x in (sliced, decontaminate.contaminated(d, b))]
    assert rows[0] == rows[1] and len(rows[0]) > 100
    assert sorted(map(repr, decontaminate.clean(d, b, slice_items=7).collect())) == sorted(map(repr, decontaminate.clean(d, b).collect()))


def brute_short(docs, items, least=0.8):
    """Documents with fewer words than an item, as one window of it."""
    held = Counter(s for _, t in items for s in set(sh(ws(t))))
    out = {}
    for d, text in docs:
        w = ws(text)
        for j, t in items:
            k = min(5, len(ws(t)))
            if k <= len(w) < len(ws(t)):
                a, b = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)), Counter(sh(ws(t)))
                wt = lambda x: 1 / held[x] if held[x] else 1.0
                sim = sum(wt(x) * min(a[x], b[x]) for x in a | b) / sum(wt(x) * max(a[x], b[x]) for x in a | b)
                if sim >= least - 1e-9:
                    out[d, j] = (sim, 0)
    return out


def test_documents_shorter_than_an_item(spark):
    docs, items = data()
    for i, t in items:
        w = ws(t)
        docs += [(1000 + i, " ".join(w[:-1])), (2000 + i, " ".join(w[2:])), (3000 + i, " ".join(w[:-4])), (4000 + i, " ".join(w[: len(w) // 2] + w[len(w) // 2 + 1 :]))]
    want = brute_short(docs, items)
    assert len(want) > 40
    same(scanned(docs, items), brute(docs, items) | want)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    size = {i: len(ws(t)) for i, t in docs}
    got = {(r.doc_id, r.item_id): r.n_words for r in decontaminate.contaminated(d, b).collect()}
    assert all(got[k] == size[k[0]] for k in want)
    left = {r.doc_id for r in decontaminate.clean(d, b).collect()}
    assert not left & {i for i, _ in want} and {i for i, _ in docs} - left == {i for i, _ in got}
