import random

import numpy as np
import xxhash

from shelfmark.llm import simhash
from shelfmark.llm.kernel import WHITE


def brute(text):
    ws = "".join(chr(c + 32) if 65 <= (c := ord(x)) <= 90 else x for x in text or "")
    for c in "\t\n\x0b\x0c\r":
        ws = ws.replace(c, " ")
    ws = [w for w in ws.split(" ") if w]
    sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def corpus(n=150):
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdéÀZ.") for _ in range(rnd.randint(1, 12))) for _ in range(300)] + ["x" * 40]
    out = [None, "", " \n ", "one", "One two", "a b c", "x" * 5000]
    for _ in range(n):
        t = [rnd.choice(vocab) for _ in range(rnd.randint(1, 60))]
        out.append("  ".join(t))
        if rnd.random() < 0.5:
            t[rnd.randrange(len(t))] = "changed"
            out.append(" ".join(t))
            out.append("\n".join(t))
    return out


def groups(ids, fps, radius):
    root = list(range(len(fps)))
    for _ in range(len(fps)):
        old = root[:]
        for i in range(len(fps)):
            for j in range(len(fps)):
                if bin(fps[i] ^ fps[j]).count("1") <= radius:
                    root[i] = min(root[i], root[j])
        if root == old:
            return [ids[r] for r in root]


def test_fingerprints_and_components_match_brute_force(spark):
    texts = corpus()
    rows = [(i, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    for radius in (3, 6):
        got = {r.doc_id: r for r in simhash.near_duplicates(df, radius=radius).collect()}
        fps = [brute(t) for t in texts]
        assert [got[i].fp & (2**64 - 1) for i in range(len(texts))] == fps
        assert [got[i].component_id for i in range(len(texts))] == groups(list(range(len(texts))), fps, radius)
        assert len(set(groups(list(range(len(texts))), fps, radius))) < len(texts) - 5


def test_every_allotment_finds_all_pairs():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, 200, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rnd.integers(0, 64, k))) for k in (0, 1, 2, 3) for _ in range(3)]))
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    for n in (10, len(fp), 10**6, 10**11):
        parts, t = simhash.allot(n, bits.T @ bits, 3)
        assert sorted(sum(parts, [])) == list(range(64)) and sum(t) == 3 - len(parts) + 1
        for x in fp[:60]:
            for y in fp[np.bitwise_count(fp ^ x) <= 3]:
                assert any(bin(int(simhash._values(np.array([x]), p)[0] ^ simhash._values(np.array([y]), p)[0])).count("1") <= k for p, k in zip(parts, t, strict=True))


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "q w e r"), (7, "a b c"), (7, "a b c"), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 7), (None, None), (7, 7), (7, 7), (3, 3)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert WHITE.sum() == 6
