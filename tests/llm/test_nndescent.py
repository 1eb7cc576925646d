import numpy as np

from shelfmark.llm import nndescent


def brute(rows, least=0.98):
    ok = [(i, lab, np.array(v, float)) for i, lab, v in rows if i is not None and lab is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    ok = list({(i, lab, tuple(v)): (i, lab, v) for i, lab, v in ok}.values())
    root = {n: n for n in range(len(ok))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n_links = [0] * len(ok)
    for a in range(len(ok)):
        for b in range(a):
            x, y = ok[a][2], ok[b][2]
            if ok[a][1] == ok[b][1] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                n_links[a] += 1
                n_links[b] += 1
                root[find(a)] = find(b)
    low = {}
    for n, (i, _, _) in enumerate(ok):
        low[find(n)] = min(low.get(find(n), i), i)
    return {(i): (n_links[n], low[find(n)]) for n, (i, _, _) in enumerate(ok)}


def data():
    rnd = np.random.default_rng(7)
    rows = []
    for _ in range(60):
        base, label = rnd.normal(size=16), int(rnd.integers(0, 3))
        for _ in range(int(rnd.integers(1, 5))):
            rows.append((len(rows), label, (base + rnd.normal(size=16) * rnd.choice([0, 0.02, 0.1])).astype(np.float32).tolist()))
    big = rnd.normal(size=16)
    for _ in range(120):
        rows.append((len(rows), 1, (big + rnd.normal(size=16) * 0.1).astype(np.float32).tolist()))
    rows += [(5000 + i, 2, rnd.normal(size=16).astype(np.float32).tolist()) for i in range(200)]
    rows += [(9000, 1, None), (9001, None, rows[0][2]), (9002, 1, [0.0] * 16), (9003, 1, [float("nan")] * 16), (9004, 1, []), (9005, 1, [None] * 16), (None, rows[0][1], rows[0][2]), (9006, 1, [1.0, 2.0]), (9007, 1, [1.0, 2.0]), (9008, 1, [float("inf")] + [1.0] * 15)]
    return rows + rows[:3]


def test_links_and_components_match_brute_force(spark):
    rows = data()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<float>, node int").repartition(5)
    want = brute(rows)
    for tile in (1000, 50):
        got = nndescent.near_duplicates(df, leaf=40, tile=tile).collect()
        assert len(got) == len(rows)
        for r in got:
            links, low = want.get(r.vec_id, (0, r.vec_id))
            assert (r.n_links, r.component_id, r.kept) == (links, low, low == r.vec_id), r
    assert max(v[0] for v in want.values()) > 20


def test_audit_repairs_a_poor_search(spark):
    rows = data()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {r.vec_id: r.n_links for r in nndescent.near_duplicates(df, k=1, trees=1, leaf=4, rounds=0, audit=2000).collect()}
    want = brute(rows)
    assert all(got[i] == n for i, (n, _) in want.items())


def test_empty(spark):
    assert nndescent.near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_full_lists_hide_no_link(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for label in range(3):
        for _ in range(4):
            a, b = np.linalg.qr(rnd.normal(size=(32, 2)))[0].T
            # chains of groups of 12 tight copies: each links with the next, which is nearer to none of the copies
            for step in range(3):
                at = np.arccos(0.985) * step
                centre = a * np.cos(at) + b * np.sin(at)
                for _ in range(12):
                    rows.append((len(rows), label, (centre + rnd.normal(size=32) * 1e-4).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    want = brute(rows)
    assert {n for n, _ in want.values()} == {23, 35} and len({c for _, c in want.values()}) == 12
    for r in nndescent.near_duplicates(df, audit=0).collect():
        assert (r.n_links, r.component_id) == want[r.vec_id], r


def test_the_search_itself_finds_links_in_large_labels(spark):
    """5,400 nodes in labels of many leaves, an audit far too small to repair a bad search: recall by comparison with all."""
    rnd = np.random.default_rng(11)
    x = rnd.normal(size=(5000, 24))
    near = x[:400] + rnd.normal(size=(400, 24)) * 0.11 * np.linalg.norm(x[:400], axis=1, keepdims=True) / np.sqrt(24)
    x = np.vstack([x, near])
    label = np.where(np.arange(len(x)) % 5000 % 3 == 0, "a", "b")
    df = spark.createDataFrame([(i, str(n), v.tolist()) for i, (n, v) in enumerate(zip(label, x, strict=True))], "vec_id long, label string, embedding array<double>")
    got = {r.vec_id: r for r in nndescent.near_duplicates(df, audit=60).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.98) & (label[:, None] == label[None])
    i, j = np.nonzero(np.triu(links, 1))
    assert len(i) > 200
    found = np.array([got[a].component_id == got[b].component_id for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    assert found.mean() >= 0.99
    assert all(0.9 <= r.audit_recall <= 1 for r in got.values() if r.audit_recall is not None)


def test_a_large_group_of_like_vectors_is_dealt_in_parts(spark):
    rnd = np.random.default_rng(3)
    x = np.vstack([rnd.normal(size=16) + rnd.normal(size=(700, 16)) * 0.02, rnd.normal(size=(60, 16))])
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "vec_id long, label string, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in nndescent.near_duplicates(df, leaf=16, audit=5, tile=100).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = (u @ u.T >= 0.98).sum(1) - 1
    assert [got[i][0] for i in range(len(x))] == n.tolist() and {got[i][1] for i in range(700)} == {0}
