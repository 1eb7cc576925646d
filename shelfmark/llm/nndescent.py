"""Near-duplicate embeddings by NN-descent, within equal labels.

1. Equal vectors of a label become one node with a multiplicity.
2. *Start.* Each of ``trees`` random-hyperplane trees deals the nodes of a label into leaves of
   about ``leaf`` nodes; the nearest ``k`` of a node over all its leaves start its neighbour list.
3. *Refine.* Every node brings its neighbours and those it is a neighbour of together; among them
   each learns of nearer ones. Rounds go on until one changes at most a hundredth of the lists or, after the second,
   finds no further link. Where very many meet, at a hub
   or in a leaf that no hyperplane parts, they meet in parts.
4. *Enlarge.* A list full of links is saturated: further links of its node may be hidden behind nearer ones. Linked
   nodes form components; the nodes of saturated lists are searched again for the nearest k outside their own component,
   components that link are joined, and so on until no list shows a link to another component (at least every second
   component that has one is gone after each turn). A link between lists of which one is not saturated stands in that one.
   Each component is compared with itself in tiles, whose size is bounded, so the link counts of saturated nodes are
   exact without a row for each pair.
5. *Audit.* A bounded sample of nodes is compared with all nodes of their labels. Links between different components
   that it finds are added, and the search starts again with other trees and longer lists, until an audit (of another
   sample) finds none. The recall that the audits saw is a column of the result.

Cosines are in double precision; a pair links if its cosine is >= ``threshold``.

Defined cases: null labels, and vectors that are null, empty or zero or hold null or non-finite components,
link with nothing; vectors of different lengths never link; rows with the same id, label and vector count as one
vector (each row is reported); rows with null ids link with nothing and report component null, kept true;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import count as count_up

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.durable import discard, durable
from .kernel import U64, grouped, mix

THRESHOLD, K, TREES, LEAF, AUDIT, TILE, GATHER = 0.98, 8, 8, 256, 500, 500, 64


def _matrix(col) -> np.ndarray:
    """A list column as unit rows in double precision."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(col):
        return np.zeros((0, 1))
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _nodes(vectors: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    x = F.col(vec_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    # -0.0 and 0.0 are the same component.
    clean = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~bad & F.exists(x, lambda v: v != 0)).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.transform(x, lambda v: v.cast("double") + F.lit(0.0)).alias("vec")
    )
    return clean


def _leaves(x: np.ndarray, label: list[str], depth: np.ndarray, tree: int) -> np.ndarray:
    """The leaf of each node in one tree: its label and the signs of its products with ``depth`` of the tree's hyperplanes."""
    planes = np.random.default_rng(1000 + tree).normal(size=(32, x.shape[1]))
    signs = (x @ planes.T > 0).astype(np.uint64)
    code = np.zeros(len(x), U64)
    for d in range(32):
        code |= np.where(depth > d, signs[:, d] << U64(d), U64(0))
    base = np.array([hash_label(v) for v in label], np.uint64)
    return (mix(base + mix(code + U64(tree << 40) + U64(x.shape[1] << 48))) >> U64(1)).astype(np.int64)


def _deep(nodes: DataFrame, leaf: int) -> DataFrame:
    """``nodes`` with ``depth``: the hyperplanes that leave about ``leaf`` nodes of its label together."""
    size = nodes.groupBy(F.col("label").alias("label2")).agg(F.count("*").alias("size"))
    depth = F.least(F.greatest(F.ceil(F.log2(F.col("size") / leaf)), F.lit(0)), F.lit(32)).cast("int")
    return nodes.join(size, F.col("label") == F.col("label2")).select("*", depth.alias("depth")).drop("label2", "size")


def hash_label(label: str) -> int:
    import zlib

    return zlib.crc32(label.encode()) << 20


def _top(sim: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, nearest first."""
    k = min(k, sim.shape[1])
    part = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k < sim.shape[1] else np.tile(np.arange(sim.shape[1]), (len(sim), 1))
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(sim, part, 1), axis=1, kind="stable"), 1)


def _lists(node: np.ndarray, x: np.ndarray, own: np.ndarray, k: int):
    """For each node of a group, its k nearest of another ``own`` in the group; in slices, so that memory stays bounded."""
    for a in range(0, len(node), 512):
        sim = x[a : a + 512] @ x.T
        sim[own[a : a + 512, None] == own[None]] = -2
        best = _top(sim, k)
        value = np.take_along_axis(sim, best, 1)
        for i in range(len(sim)):
            ok = value[i] > -2
            yield int(node[a + i]), node[best[i][ok]].tobytes(), value[i][ok].tobytes()


def _rows(rows, names, kinds):
    cols = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


_LIST = "node long, near binary, sims binary"


def _list_batch(rows):
    return _rows(rows, ["node", "near", "sims"], [pa.int64(), pa.binary(), pa.binary()])


def _start(nodes: DataFrame, k: int, trees: range, leaf: int) -> DataFrame:
    def deal(batches):
        for b in batches:
            label, depth = b.column("label").to_pylist(), b.column("depth").to_numpy()
            dims = np.array([len(v) for v in b.column("vec")])
            for dim in np.unique(dims):
                pick = np.flatnonzero(dims == dim)
                part = b.take(pa.array(pick))
                x = _matrix(part.column("vec"))
                for t in trees:
                    at = _leaves(x, [label[i] for i in pick], depth[pick], t)
                    yield pa.RecordBatch.from_arrays([pa.array(at), part.column("node"), part.column("own"), part.column("vec")], ["leaf", "node", "own", "vec"])

    def within(batches):
        for g in grouped(batches, "leaf"):
            yield _list_batch(list(_lists(g.column("node").to_numpy(), _matrix(g.column("vec")), g.column("own").to_numpy(), k)))

    dealt = _deep(nodes, leaf).select("node", "own", "label", "depth", "vec").mapInArrow(deal, "leaf long, node long, own long, vec array<double>")
    # No hyperplane may part a large group of like vectors: such a leaf is dealt into parts by a hash of the node.
    large = durable(dealt.groupBy(F.col("leaf").alias("leaf2")).agg(F.count("*").alias("size")).where(F.col("size") > 4 * leaf), "nn-large")
    part = F.pmod(F.xxhash64("node", "leaf"), F.ceil(F.col("size") / (2 * leaf)))
    split = dealt.join(large, F.col("leaf") == F.col("leaf2"), "left").select(F.when(F.col("size").isNull(), F.col("leaf")).otherwise(F.xxhash64("leaf", part)).alias("leaf"), "node", "own", "vec")
    return _merge(split.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(within, _LIST), k)


def _merge(lists: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node over all its lists."""

    def best(batches):
        for g in grouped(batches, "node"):
            near, sims = (np.concatenate([np.frombuffer(x, t) for x in g.column(c).to_pylist()]) for c, t in (("near", np.int64), ("sims", np.float64)))
            near, at = np.unique(near, return_index=True)
            order = np.argsort(-sims[at], kind="stable")[:k]
            yield _list_batch([(g.column("node")[0].as_py(), near[order].tobytes(), sims[at][order].tobytes())])

    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(best, _LIST)


def _refine(nodes: DataFrame, lists: DataFrame, k: int, turn: int) -> DataFrame:
    """One round: neighbours of a node meet there, and each takes the nearest of those it meets."""

    def pairs(batches):
        for b in batches:
            node = b.column("node").to_numpy()
            near = [np.frombuffer(x, np.int64) for x in b.column("near").to_pylist()]
            n = np.array([len(x) for x in near])
            flat = np.concatenate(near) if near else np.zeros(0, np.int64)
            here = np.repeat(node, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[here, flat, node]), pa.array(np.r_[flat, here, node])], ["centre", "member"])

    def meet(batches):
        for g in grouped(batches, "centre"):
            node, at = np.unique(g.column("member").to_numpy(), return_index=True)
            # A hub's members meet in parts, other ones each round.
            order = np.argsort(mix(node.view(np.uint64) + U64(turn << 32)), kind="stable") if len(node) > GATHER else np.arange(len(node))
            node, own, vec = node[order], g.column("own").to_numpy()[at][order], g.column("vec").combine_chunks().take(pa.array(at[order]))
            cut = -(-len(node) // GATHER)
            for i in range(cut):
                a, b = len(node) * i // cut, len(node) * (i + 1) // cut
                yield _list_batch(list(_lists(node[a:b], _matrix(vec.slice(a, b - a)), own[a:b], k)))

    met = lists.mapInArrow(pairs, "centre long, member long").join(nodes.select(F.col("node").alias("member"), "own", "vec"), "member").select("centre", "member", "own", "vec")
    new = met.repartition("centre").sortWithinPartitions("centre").mapInArrow(meet, _LIST)
    return _merge(lists.union(new), k)


def _search(nodes: DataFrame, k: int, trees: range, leaf: int, turn: int, rounds: int | None, threshold: float) -> DataFrame:
    """The lists of the k nearest nodes of another ``own``: rounds until one changes at most a hundredth of the lists,
    or, after the second, finds no further link."""
    links = -1
    lists = durable(_start(nodes, k, trees, leaf), "nn-lists")
    total = lists.agg(F.count(F.when(F.octet_length("sims") > 0, 1))).first()[0]
    for r in (count_up() if rounds is None else range(rounds)) if total else ():
        better = durable(_refine(nodes, lists, k, (turn << 10) + r), "nn-lists")
        before = lists.select(F.col("node").alias("node2"), F.col("near").alias("near2"))
        change = better.join(before, F.col("node") == F.col("node2"), "left").where(~F.col("near").eqNullSafe(F.col("near2"))).count()
        discard(lists)
        lists = better
        before_, links = links, _edges(lists, threshold).count()
        if change <= 0.01 * total or links == before_:
            break
    return lists


def _saturated(lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """The nodes whose k neighbours are all links."""

    def run(batches):
        for b in batches:
            sims = [np.frombuffer(s, np.float64) for s in b.column("sims").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node").filter(pa.array([len(s) >= k and s.min() >= threshold for s in sims], pa.bool_()))], ["node"])

    return lists.select("node", "sims").mapInArrow(run, "node long")


def _enlarge(nodes: DataFrame, lists: DataFrame, edges: DataFrame, threshold: float, k: int, trees: range, leaf: int, turn: int, rounds: int | None) -> tuple[DataFrame, DataFrame]:
    """The edges, joined by those that saturated lists hid, and the components."""
    full = durable(nodes.drop("own").join(_saturated(lists, k, threshold), "node"), "nn-full")
    while True:
        found = durable(components(edges, tag="nn-cc"), "nn-found")
        placed = full.join(found.withColumnRenamed("component", "own"), "node")
        several = placed.groupBy("label").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select(F.col("label").alias("label2"))
        open_ = durable(placed.join(several, F.col("label") == F.col("label2"), "left_semi"), "nn-open")
        if open_.isEmpty():
            return edges, found
        apart = _search(open_, k, trees, leaf, turn, rounds, threshold)
        new = durable(_edges(apart, threshold), "nn-edges")
        discard(open_, apart)
        if new.isEmpty():
            return edges, found
        edges = durable(edges.union(new), "nn-edges")


def _edges(lists: DataFrame, threshold: float) -> DataFrame:
    def run(batches):
        for b in batches:
            out = [(n, np.frombuffer(v, np.int64)[np.frombuffer(s, np.float64) >= threshold]) for n, v, s in zip(b.column("node").to_pylist(), b.column("near").to_pylist(), b.column("sims").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([n for n, _ in out], [len(v) for _, v in out]).astype(np.int64)), pa.array(np.concatenate([v for _, v in out]) if out else np.zeros(0, np.int64))], ["a", "b"])

    return lists.mapInArrow(run, "a long, b long")


def _audit(nodes: DataFrame, found: DataFrame, threshold: float, size: int, turn: int) -> tuple[DataFrame, int, int]:
    """Links of a sample of nodes, by comparison with all: those between different components, and how many links there are."""
    n = max(nodes.count(), 1)
    draw = F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(1 << 30))
    rows = nodes.where(draw < int(min(1.0, size / n) * (1 << 30))).select("node", "label", "vec").limit(2 * size).collect()
    by: dict = {}
    for r in rows:
        by.setdefault((r.label, len(r.vec)), []).append((r.node, r.vec))
    packed = {key: (np.array([i for i, _ in v], np.int64), _matrix(pa.array([x for _, x in v], pa.list_(pa.float64())))) for key, v in by.items()}
    shared = nodes.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        for b in batches:
            label, vec = b.column("label").to_pylist(), b.column("vec")
            keys = np.array([f"{len(v)} {name}" for name, v in zip(label, vec, strict=True)])
            a, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for key in np.unique(keys):
                dim, name = key.split(" ", 1)
                if (name, int(dim)) in shared.value:
                    ids, x = shared.value[name, int(dim)]
                    at = np.flatnonzero(keys == key)
                    node = b.column("node").to_numpy()[at]
                    i, j = np.nonzero(_matrix(vec.take(pa.array(at))) @ x.T >= threshold)
                    other = node[i] != ids[j]
                    a.append(node[i][other])
                    c.append(ids[j][other])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(c))], ["a", "b"])

    links = durable(nodes.mapInArrow(run, "a long, b long"), "nn-audit")
    left = links.join(found.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(found.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    missing = left.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    return missing, links.count(), missing.count()


def _count(nodes: DataFrame, found: DataFrame, threshold: float, tile: int) -> DataFrame:
    """For each node in a component, how many vectors of other nodes link with it: the component in tiles."""
    sized = found.groupBy("component").count().withColumn("cut", F.ceil(F.col("count") / tile).cast("int")).select("component", "cut")
    own = nodes.join(found, "node").join(sized, "component")
    block = F.pmod(F.xxhash64("node"), F.col("cut").cast("long")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("cut") - 1))
    base = own.select("component", "node", "vec", "n", block.alias("mine"), every.alias("other"))
    rows = base.select(F.xxhash64("component", "mine", "other").alias("tile"), "node", "vec", "n", F.lit(True).alias("row")).union(base.select(F.xxhash64("component", "other", "mine"), "node", "vec", "n", F.lit(False)))

    def compare(batches):
        for g in grouped(batches, "tile"):
            row = g.column("row").to_numpy()
            x, node, n = _matrix(g.column("vec")), g.column("node").to_numpy(), g.column("n").to_numpy()
            a, b = np.flatnonzero(row), np.flatnonzero(~row)
            for s in range(0, len(a), 512):
                part = a[s : s + 512]
                hit = (x[part] @ x[b].T >= threshold) & (node[part][:, None] != node[b][None])
                yield pa.RecordBatch.from_arrays([pa.array(node[part]), pa.array((hit * n[b]).sum(1))], ["node", "links"])

    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(compare, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", threshold: float = THRESHOLD, k: int = K, trees: int = TREES, leaf: int = LEAF, rounds: int | None = None, audit: int = AUDIT, tile: int = TILE) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept (the id is its component's), audit_recall (the share of the links
    that the audits saw whose two ends the search had joined; null if they saw none; links it missed were added)."""
    clean = _nodes(vectors, id_col, label_col, vec_col)
    distinct = clean.distinct().groupBy("label", "vec").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    # The same id may stand on several vectors; a node is named by its vector then.
    nodes = durable(distinct.select(F.xxhash64("label", "vec").alias("node"), "label", "vec", "least", "n"), "nn-nodes")
    nodes = nodes.withColumn("own", F.col("node"))
    edges, turn, links, lost = None, 0, 0, 0
    while True:  # each turn that goes on has joined components, so the turns end
        dealt = range(turn * trees, (turn + 1) * trees)
        lists = _search(nodes, k, dealt, leaf, turn, rounds, threshold)
        new = _edges(lists, threshold)
        edges = durable(new if edges is None else new.union(edges), "nn-edges")
        edges, found = _enlarge(nodes, lists, edges, threshold, k, dealt, leaf, turn, rounds)
        missing, seen, missed = _audit(nodes, found, threshold, audit, turn)
        links, lost, turn = links + seen, lost + missed, turn + 1
        if not missed:
            break
        edges = durable(edges.union(missing), "nn-edges")
        k *= 2
    recall = F.lit(1 - lost / links if links else None).cast("double")
    counts = durable(_count(nodes, found, threshold, tile), "nn-counts")
    placed = durable(nodes.select("node", "least", "n").join(found, "node", "left").select("node", "least", "n", F.coalesce("component", "node").alias("root")), "nn-roots")
    low = durable(placed.groupBy("root").agg(F.min("least").alias("component_id")), "nn-low")
    by_root = durable(placed.join(low, "root").select("node", "n", "component_id"), "nn-placed")
    where = durable(by_root.join(counts, "node", "left").select(F.col("node").alias("node2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id"), "nn-where")
    keyed = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.transform(vec_col, lambda v: v.cast("double") + F.lit(0.0)).alias("vec")).select("id", F.when(F.col("id").isNotNull() & F.col("label").isNotNull(), F.xxhash64("label", "vec")).alias("node"))
    own = F.coalesce("component_id", "id")
    return keyed.join(where, F.col("node") == F.col("node2"), "left").select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.cast("long").alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"), recall.alias("audit_recall"))
