import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import brown


def rows():
    rnd = random.Random(4)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    out = [(0, None), (1, ""), (2, "UNSEEN words é"), (None, "n1 v1 n2")]
    for i in range(3, 300):
        t = []
        for _ in range(rnd.randint(1, 30)):
            t += [rnd.choice(nouns), rnd.choice(verbs).upper()]
        if rnd.random() < 0.4:
            t.append(f"once{i}")
        out.append((i, " ".join(t)))
    return out


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(i, t, True) for i, t in rows()], "doc_id long, text string, held_out boolean").repartition(5)
    return {r.doc_id: r for r in brown.score_texts(df, F.crc32(F.col("doc_id").cast("string")) % 10 == 0, shard_words=50).collect()}


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def test_base_matches_brute_force(scored):
    counts = Counter(w for i, t in rows() if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(scored) == len(rows())
    for i, t in rows():
        ws, r = tokens(t), scored[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), abs=1e-9)


def test_model_beats_the_base_on_held_out(scored):
    out = [r for r in scored.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) * 0.9
    assert all(r.score <= 0 and r.perplexity >= 1 for r in scored.values())


def likelihood(n, cls):
    hot = np.zeros((len(n), cls.max() + 1))
    hot[np.arange(len(n)), cls] = 1
    pair = hot.T @ n @ hot
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(pair) - f(pair.sum(0)) - f(pair.sum(1))


def test_exchange_makes_the_moves_of_a_full_recomputation():
    n = np.random.default_rng(1).integers(0, 40, (15, 15))
    cls, movable, classes = np.r_[np.arange(12) % 4, 4 + np.arange(3)], 12, 4
    start = likelihood(n, cls)
    for _ in range(2):
        for w in range(movable):
            tries = [likelihood(n, np.r_[cls[:w], b, cls[w + 1 :]]) for b in range(classes)]
            if max(tries) > tries[cls[w]] + 1e-9:
                cls[w] = int(np.argmax(tries))
    got = brown.exchange(n, movable, classes, passes=2)
    assert got.tolist() == cls.tolist() and likelihood(n, got) > start


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert brown.score_texts(df, F.lit(False)).count() == 0
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in brown.score_texts(df, F.lit(True)).collect()}
    assert got[1].base_score == 0 and got[1].n_known == 0 and got[1].train_tokens == 0 and got[2].n_tokens == 1


def test_exchange_goes_on_until_it_settles():
    n = np.random.default_rng(5).integers(0, 3, (130, 130))
    got = brown.exchange(n, 120, 12)
    best = likelihood(n, got)
    assert all(likelihood(n, np.r_[got[:w], b, got[w + 1 :]]) <= best + 1e-6 for w in range(120) for b in range(12))
    assert best > likelihood(n, brown.exchange(n, 120, 12, passes=6)) + 1e-6


def test_score_matches_brute_force_and_probabilities_sum_to_one(spark):
    """The model from its definition: symbols, classes of the tested exchange, smoothed transitions, emissions."""
    texts = [(i, t) for i, t in rows() if i is None or i < 60]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in brown.score_texts(df, F.crc32(F.col("doc_id").cast("string")) % 10 == 0, classes=6, shard_words=50).collect()}
    train = [tokens(t) for i, t in texts if not held(i)]
    counts = Counter(w for ts in train for w in ts)
    known = [w for w in counts if w is not None]
    code = brown.hash_spans
    import pyarrow as pa

    w = brown.words(*brown.buffers(pa.array([" ".join(known)])))
    key = dict(zip(known, brown.np.maximum(code(w.data, w.starts, w.ends, seed=5), brown.U64(1)).view(np.int64).tolist(), strict=True))
    top = sorted(known, key=lambda x: (-counts[x], key[x]))[: brown.TOP]
    sym = {x: i for i, x in enumerate(top)} | {None: brown.TOP + brown.BANDS}
    assert len(known) <= brown.TOP  # here every known word is on the list, also those counted once
    n = np.zeros((brown.TOP + brown.BANDS + 1,) * 2, np.int64)
    for ts in train:
        for a, b in zip([None, *ts], ts, strict=False):
            n[sym[a], sym[b]] += 1
    cls = brown.exchange(n, len(top), 6)
    k = int(cls.max()) + 1
    pair = np.zeros((k, k))
    np.add.at(pair, (cls[:, None].repeat(len(n), 1), cls[None].repeat(len(n), 0)), n)
    live = {*cls[: len(top)], cls[brown.TOP], cls[brown.TOP + brown.BANDS]}
    prior = np.array([pair[:, c].sum() + 1 if c in live else 0.0 for c in range(k)])
    prior /= prior.sum()
    step = (pair + brown.PRIOR * prior) / (pair.sum(1, keepdims=True) + brown.PRIOR)
    unknown = cls[brown.TOP]
    for i, t in texts:
        want, before = 0.0, cls[sym[None]]
        for x in tokens(t):
            c = cls[sym[x]] if x in sym else unknown
            emit = 1.0 if x is None or c == unknown else counts[x] / pair[:, c].sum()
            want += math.log10(step[before, c] * emit)
            before = c
        assert got[i].score == pytest.approx(want, abs=1e-8), i
    for before in live:  # over all known words, the end mark and one unknown word
        total = sum(step[before, cls[sym[x]]] * counts[x] / pair[:, cls[sym[x]]].sum() for x in top) + step[before, cls[sym[None]]] + step[before, unknown]
        assert total == pytest.approx(1)


def test_words_beyond_the_top_join_the_class_of_highest_likelihood(spark):
    """Against recounted likelihoods: each word counted 8 times or more, alone, in each class as the counts stood before."""
    texts, n_top, classes = rows() + [(1000 + i, "n1 n1 v2 n3 n3 n3") for i in range(9)], 12, 4
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in brown.score_texts(df, F.crc32(F.col("doc_id").cast("string")) % 10 == 0, classes=classes, shard_words=50, n_top=n_top).collect()}
    train = [tokens(t) for i, t in texts if not held(i)]
    counts = Counter(w for ts in train for w in ts)
    known = [w for w in counts if w is not None]
    w = brown.words(*brown.buffers(brown.pa.array([" ".join(known)])))
    key = dict(zip(known, np.maximum(brown.hash_spans(w.data, w.starts, w.ends, seed=5), brown.U64(1)).view(np.int64).tolist(), strict=True))
    top = sorted(known, key=lambda x: (-counts[x], key[x]))[:n_top]
    rare, end = n_top, n_top + brown.BANDS
    sym = {x: rare + int(math.log2(counts[x])) for x in known} | {x: i for i, x in enumerate(top)} | {None: end}

    def table(of, size):
        n = np.zeros((size, size), np.int64)
        for ts in train:
            for a, b in zip([None, *ts], ts, strict=False):
                n[of[a], of[b]] += 1
        return n

    cls = brown.exchange(table(sym, end + 1), n_top, classes)
    k = int(cls.max()) + 1
    before = {x: int(cls[s]) for x, s in sym.items()}
    pair = table(before, k).astype(float)
    f = lambda x: x * np.log(np.maximum(x, 1))
    after, moved = dict(before), [x for x in known if x not in top and counts[x] >= brown.CLUSTERED]
    for x in moved:
        left, right, own = np.zeros(k), np.zeros(k), 0
        for ts in train:
            for a, b in zip([None, *ts], ts, strict=False):
                own += a == b == x
                left[before[a]] += b == x and a != x
                right[before[b]] += a == x and b != x
        gains = []
        for b in range(classes):
            new = pair.copy()
            new[b] += right
            new[:, b] += left
            new[b, b] += own
            gains.append(f(new).sum() - f(pair).sum() - f(pair[:, b].sum() + counts[x]) + f(pair[:, b].sum()) - f(pair[b].sum() + counts[x]) + f(pair[b].sum()))
        after[x] = int(np.argmax(gains))
    assert len(moved) > 20 and len({after[x] for x in moved}) > 1 and any(counts[x] < brown.CLUSTERED for x in known)
    pair = table(after, k)
    rare, end = int(cls[rare]), int(cls[end])
    prior = np.where((pair.sum(0) > 0) | np.isin(np.arange(k), [rare, end]), pair.sum(0) + 1, 0.0)
    step = (pair + brown.PRIOR * prior / prior.sum()) / (pair.sum(1, keepdims=True) + brown.PRIOR)
    n1, n2 = (sum(counts[x] == i for x in known) for i in (1, 2))
    assert n1 and not any(counts[x] == 1 for x in top)
    unknown = n1 / (n1 + 2 * max(n2, 1))
    for i, t in texts:
        want, a = 0.0, end
        for x in tokens(t):
            b = after.get(x, rare)
            emit = 1.0 if b == end else ((1 - unknown) / n1 if x in counts else unknown) if b == rare else counts[x] / pair[:, b].sum()
            want += math.log10(step[a, b] * emit)
            a = b
        assert got[i].score == pytest.approx(want, abs=1e-8), i
    total = {b: sum(counts[x] / pair[:, b].sum() for x in known if after[x] == b) for b in set(after.values()) - {rare, end}}
    assert all(v == pytest.approx(1) for v in total.values())


def test_cells_add_up_in_parts_and_steps():
    rnd = np.random.default_rng(3)
    k, classes = 9, 5
    parts = [(rnd.integers(0, 30, 200).astype(np.uint64), rnd.integers(0, 2 * k + 2, 200), rnd.integers(1, 4, 200)) for _ in range(4)]
    want = Counter()
    for p in parts:
        for w, c, n in zip(*(x.tolist() for x in p), strict=True):
            want[w, c] += n
    cells = brown.summed([brown.summed(parts[:2], 2 * k + 2), *parts[2:]], 2 * k + 2)
    assert list(zip(*(x.tolist() for x in cells), strict=True)) == [(w, c, n) for (w, c), n in sorted(want.items())]
    pair = rnd.integers(0, 50, (k, k))
    assert brown.best_classes(*cells, pair, classes).tolist() == brown.best_classes(*cells, pair, classes, step=7).tolist()


def test_emissions_of_rare_words_sum_to_one():
    sym = np.full(7, brown.TOP)
    assert brown.emissions(sym, np.array([1] * 6 + [0]), np.ones(7), 0.25, 6).sum() == pytest.approx(1)


def test_very_long_text(spark):
    long = "word and " * 200_000
    got = brown.score_texts(spark.createDataFrame([(1, long), (2, "word")], "doc_id long, text string"), F.lit(False)).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {1: 400_001, 2: 2} and all(r.score < 0 for r in got)
