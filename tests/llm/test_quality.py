import random

import numpy as np

from shelfmark.llm import quality


def test_em_recovers_accuracies():
    rnd = np.random.default_rng(2)
    truth = rnd.random(20000) < 0.8
    votes = np.full((20000, 8), -1)
    for j, (bad, good) in enumerate([(0.7, 0.99), (0.6, 0.98), (0.8, 0.97)]):
        right = rnd.random(20000) < np.where(truth, good, bad)
        votes[:, j] = np.where(right, truth, ~truth)
    code, n = np.unique(quality.pattern(votes), return_counts=True)
    assert (quality.pattern(quality.unpattern(code)) == code).all()
    post, accuracy, share = quality.expectation_maximisation(quality.unpattern(code), n.astype(float))
    assert abs(share - 0.8) < 0.03 and np.allclose(accuracy[:3], [(0.7, 0.99), (0.6, 0.98), (0.8, 0.97)], atol=0.05)


def corpus():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice(["th", "er", "ing", "on", "a"]) for _ in range(rnd.randint(1, 4)))
    good = [" ".join(word() for _ in range(rnd.randint(60, 200))) for _ in range(200)]
    junk = [" ".join(word() + "***" for _ in range(80)) for _ in range(25)] + [" ".join(word().upper() for _ in range(80)) for _ in range(25)] + ["same " * 90] * 10
    toxic = [g + " you idiot" for g in good[:10]] + [g + " zzzzzvile" for g in good[:40]]
    return good, junk, toxic


def test_keeps_clean_texts_and_drops_junk_and_toxic_ones(spark):
    good, junk, toxic = corpus()
    texts = good + junk + toxic + [None, "", " \n"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, votes string").repartition(5)
    labels = spark.createDataFrame([(i, int(len(good) + len(junk) <= i < len(good) + len(junk) + 30)) for i in range(len(texts)) if i < 290], "doc_id long, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, labels=labels, sample=150).collect()}
    assert len(got) == len(texts)
    keep = [got[i].keep for i in range(len(texts))]
    a, b = len(good), len(good) + len(junk)
    assert sum(keep[:a]) >= 0.98 * a and sum(keep[a:b]) <= 0.05 * len(junk) and not any(keep[b:])
    assert not any(got[i].toxic for i in range(b)) and all(got[i].toxic for i in range(b, b + len(toxic)))
    assert all(got[i].p_quality == 0 for i in range(len(texts) - 3, len(texts)))


def test_empty(spark):
    assert quality.classify(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_em_without_floors_settles_at_the_likelihood_of_a_plain_one():
    rnd = np.random.default_rng(9)
    truth = rnd.random(6000) < 0.7
    votes = np.full((6000, 8), -1)
    for j, (bad, good) in enumerate([(0.75, 0.9), (0.7, 0.85), (0.8, 0.95), (0.65, 0.9)]):
        votes[:, j] = np.where(rnd.random(6000) < np.where(truth, good, bad), truth, ~truth)
    code, n = np.unique(quality.pattern(votes), return_counts=True)
    v, n = quality.unpattern(code), n.astype(float)
    got, accuracy, share = quality.expectation_maximisation(v, n, rounds=2000, least=(0.0, 0.0))
    # the same with loops, from the same start
    post, acc = [0.05 if any(x == 0 for x in row) else 0.95 for row in v], None
    for _ in range(2000):
        p = (sum(q * c for q, c in zip(post, n, strict=True)) + 1) / (n.sum() + 2)
        acc = [[(sum(c * (q if side else 1 - q) for row, q, c in zip(v, post, n, strict=True) if row[j] == side) + 4) / (sum(c * (q if side else 1 - q) for row, q, c in zip(v, post, n, strict=True) if row[j] >= 0) + 5) for side in (0, 1)] for j in range(8)]
        new = []
        for row in v:
            g, b = p, 1 - p
            for j, x in enumerate(row):
                if x >= 0:
                    g *= acc[j][1] if x else 1 - acc[j][1]
                    b *= 1 - acc[j][0] if x else acc[j][0]
            new.append(g / (g + b))
        done = max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-9
        post = new
        if done:
            break
    assert np.allclose(got, post, atol=1e-6) and abs(share - 0.7) < 0.05
    floored, _, _ = quality.expectation_maximisation(v, n)
    assert ((floored > 0.5) == (got > 0.5)) @ n > 0.95 * n.sum()


def odd_texts():
    rnd = random.Random(1)
    return [None, "", " \n ", "A", "Hi hi hi hi hi", "x " * 60, "ABC DEF! " * 30, "line\n" * 9 + "other", "@@ ## " * 20, " ".join(rnd.choice(["alpha", "beta", "É"]) + str(i) for i in range(70))]


def test_votes_match_brute_force():
    import re

    import pyarrow as pa

    odd = set("!\"#$%&*+/<=>@[]^_`{|}~") | {chr(0x5C)} | {chr(c) for c in (*range(0, 9), *range(14, 32), 127)}
    got = quality.votes_of(pa.array(odd_texts(), pa.string()))
    for text, row in zip(odd_texts(), got.tolist(), strict=True):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        if not w:
            assert row == [0] * 8
            continue
        say = lambda good, bad, speak=True: (1 if good else 0 if bad else -1) if speak else -1
        up, low = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
        share = lambda f: sum(map(f, w)) / len(w)
        lines = [x for x in t.split("\n") if x]
        symbols = sum(c in odd for c in t) / max(len(t.encode()), 1)
        caps = up / max(up + low, 1)
        echo = sum(a == b for a, b in zip(w, w[1:], strict=False)) / len(w)
        again = (len(lines) - len(set(lines))) / max(len(lines), 1)
        variety = len(set(w)) / len(w)
        want = [
            say(symbols < 0.005, symbols > 0.05), say(False, share(lambda x: any(c in odd for c in x)) > 0.2), say(caps < 0.15, caps > 0.4),
            say(False, share(lambda x: sum("A" <= c <= "Z" for c in x) > 1 and not any("a" <= c <= "z" for c in x)) > 0.3), say(variety > 0.4, variety < 0.15, len(w) >= 30),
            say(False, echo > 0.15), say(False, again > 0.6, len(lines) > 5), say(len(w) >= 40, len(w) < 5),
        ]
        assert row == want, t[:40]


def test_scores_match_brute_force():
    import math
    import re

    import pyarrow as pa

    texts = odd_texts()
    weight = np.random.default_rng(0).normal(size=quality.BUCKETS + 2 * quality.BINS)
    got = quality.margins(weight, 0.3, pa.array(texts, pa.string()))
    bucket = lambda b: int(quality.mix(np.array([int.from_bytes(b, "little") + 1], np.uint64))[0] % quality.BUCKETS)
    for text, value in zip(texts, got.tolist(), strict=True):
        raw = (text or "").encode()
        tri = [bucket(raw[i : i + 3]) for i in range(len(raw) - 2)]
        w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        rep = (len(triples) - len(set(triples))) / max(len(triples), 1)
        size = int(math.log2(len(w))) if w else 0
        want = 0.3 + sum(weight[b] for b in tri) / max(len(tri), 1) + quality.SHAPE_VALUE * (weight[quality.BUCKETS + size] + weight[quality.BUCKETS + quality.BINS + min(int(rep * quality.BINS), quality.BINS - 1)])
        assert abs(want - value) < 1e-9, text


def test_the_scorer_learns_soft_labels():
    texts = ["aaa bbb ccc"] * 20 + ["xxx yyy zzz"] * 20
    import pyarrow as pa

    weight, bias = quality.train_scorer(texts, np.r_[np.full(20, 0.95), np.full(20, 0.05)])
    z = quality.margins(weight, bias, pa.array(["bbb ccc aaa", "zzz yyy xxx"]))
    assert z[0] > 0 > z[1]


def test_no_labels_no_lexicon_and_odd_rows(spark):
    good, junk, _ = corpus()
    rows = [(None, good[0]), (None, good[0]), (1, good[1]), (1, good[1]), (2, "word " * 100_000), (3, None), (4, "you idiot " + good[2])] + [(10 + i, t) for i, t in enumerate(good[3:] + junk)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = quality.classify(df, sample=150).collect()
    assert len(got) == len(rows) and not any(r.toxic for r in got)
    assert len({(r.keep, r.p_quality) for r in got if r.doc_id is None}) == 1 == len({(r.keep, r.p_quality) for r in got if r.doc_id == 1})
    twice = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (None, 1), (3, 1)], "doc_id long, toxic int")
    assert len(quality.classify(df, labels=twice, sample=150).collect()) == len(rows)
