"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64-bit majority votes over XXH64 of word shingles. Two documents link if
their fingerprints differ in at most ``radius`` bits. Equal fingerprints are one node; the
distinct ones are searched so:

* statistics of all distinct fingerprints (how often each bit, and each pair of bits, is set)
  group correlated bits into m partitions;
* if the thresholds t_1..t_m sum to radius - m + 1, a pair within the radius is within t_i in
  some partition i. Dynamic programming allots unequal thresholds (-1 leaves a partition out)
  to the partitions so that the estimated probes plus candidates cost least; m is chosen likewise;
* each fingerprint is filed under its value in each partition and probes the values within t_i;
  fingerprints that meet are verified on all 64 bits.

A bucket yields a spanning forest of its verified links, never all pairs, and components are
found by star contraction. No fingerprint list reaches the driver.

Defined cases: null text counts as empty; no words gives fingerprint zero, which links like
any other; null ids are kept and report component null only when their whole component has null ids; rows that repeat give repeated rows; extra columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.durable import durable
from .kernel import BLOCK_BITS, NULL_ID, U64, blocks, buffers, from_bytes, grouped, ids_out, loads, longs, lower_ascii, packed, with_answers, words

_P1, _P2, _P3, _P4, _P5 = (U64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Costs of a probe row and of a candidate comparison, relative to each other.
PROBE_COST, CANDIDATE_COST = 1.0, 0.05


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def xxh64_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of the bytes of each span; spans of 32 bytes and more go through the library one by one."""
    size = ends - starts
    at = loads(data)
    h = size.astype(U64) + (_P5 + U64(seed))
    pos, left = starts.copy(), size.copy()
    for _ in range(3):
        live = np.flatnonzero(left >= 8)
        k = _rotl(at[pos[live]] * _P2, 31) * _P1
        h[live] = _rotl(h[live] ^ k, 27) * _P1 + _P4
        pos[live] += 8
        left[live] -= 8
    live = np.flatnonzero((left >= 4) & (left < 8))
    h[live] = _rotl(h[live] ^ ((at[pos[live]] & U64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    pos[live] += 4
    left[live] -= 4
    for _ in range(3):
        live = np.flatnonzero((left >= 1) & (left < 4))
        h[live] = _rotl(h[live] ^ ((at[pos[live]] & U64(0xFF)) * _P5), 11) * _P1
        pos[live] += 1
        left[live] -= 1
    h ^= h >> U64(33)
    h *= _P2
    h ^= h >> U64(29)
    h *= _P3
    h ^= h >> U64(32)
    if len(long := np.flatnonzero(size >= 32)):
        raw = data.tobytes()
        h[long] = [xxhash.xxh64_intdigest(raw[s:e], seed) for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return h


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint of each document of a block."""
    w = words(lower_ascii(data), offsets)
    n_docs = len(offsets) - 1
    out = np.zeros(n_docs, U64)
    if not len(w.starts):
        return out
    # One space between words: keep the byte after each word, as a space, and drop other white space.
    keep = np.zeros(len(data) + 1, np.int64)
    np.add.at(keep, w.starts, 1)
    np.add.at(keep, w.ends, -1)
    keep = np.cumsum(keep)[:-1].astype(bool)
    gaps = w.ends[(w.ends < len(data))]
    gaps = gaps[~keep[gaps]]
    text = w.data.copy()
    text[gaps] = 0x20
    keep[gaps] = True
    place = np.cumsum(keep) - 1
    text, starts = text[keep], place[w.starts]
    ends = starts + (w.ends - w.starts)
    n = w.counts
    per = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    first = np.repeat(w.first[:-1], per) + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
    last = np.minimum(first + shingle - 1, np.repeat(w.first[1:], per) - 1)
    h = xxh64_spans(text, starts[first], ends[last], seed)
    full = np.flatnonzero(per)
    begin = (np.cumsum(per) - per)[full]
    half = per[full]
    for b in range(64):
        ones = np.add.reduceat((h >> U64(b)) & U64(1), begin)
        out[full] |= (2 * ones.astype(np.int64) > half).astype(U64) << U64(b)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: the id and ``fp`` long (the 64 bits, signed)."""

    def run(batches):
        for t in blocks(batches, "_text"):
            fp = fingerprints_of(*buffers(t.column("_text")), shingle, seed)
            yield pa.RecordBatch.from_arrays([ids_out(longs(t.column("_id"), NULL_ID)), pa.array(fp.view(np.int64))], ["_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "_id long, fp long").withColumnRenamed("_id", id_col)


# -- partitions and thresholds ---------------------------------------------------------
def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Over all distinct fingerprints: their number and, for each pair of bits, how many have both set."""

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(fp)
        i, j = np.triu_indices(64)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, 64]), pa.array(np.r_[j, 64]), pa.array(np.r_[total[i, j].astype(np.int64), n])], ["i", "j", "n"])

    both, n = np.zeros((64, 64)), 0
    for r in nodes.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # 2,081 rows
        if r.i == 64:
            n = r.n
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    return n, both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m partitions of like size; each grows by the bit most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, out = list(range(64)), []
    for k in range(m):
        size = len(free) // (m - k)
        own = [free.pop(int(np.argmax(corr[np.ix_(free, free)].sum(1))))]
        while len(own) < size:
            own.append(free.pop(int(np.argmax(corr[np.ix_(free, own)].mean(1)))))
        out.append(sorted(own))
    return out


def _differ(p: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """P(two fingerprints differ in at most t of ``bits``), t = 0..most, as if bits were independent."""
    dist = np.zeros(most + 1)
    dist[0] = 1
    for b in bits:
        d = 2 * p[b] * (1 - p[b])
        dist[1:] = dist[1:] * (1 - d) + dist[:-1] * d
        dist[0] *= 1 - d
    return np.cumsum(dist)


def allot(n: int, both: np.ndarray, radius: int, counts: tuple[int, ...] = (2, 3, 4)) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds of least estimated cost, by dynamic programming over (partition, sum so far)."""
    p = np.diag(both) / max(n, 1)
    best = None
    for m in (m for m in counts if m <= radius + 1):
        parts, total = group_bits(n, both, m), radius - m + 1
        # state: thresholds so far sum to s; thresholds run from -1 (partition unused) to the radius
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in parts:
            near = _differ(p, bits, radius)
            cost = {-1: 0.0}
            ball = 0.0
            for t in range(radius + 1):
                ball += float(np.prod([(len(bits) - i) / (i + 1) for i in range(t)]))
                cost[t] = PROBE_COST * n * ball + CANDIDATE_COST * n * n / 2 * near[t]
            new: dict[int, tuple[float, list[int]]] = {}
            for s, (c, ts) in state.items():
                for t, more in cost.items():
                    if s + t not in new or c + more < new[s + t][0]:
                        new[s + t] = c + more, [*ts, t]
            state = new
        if total in state and (best is None or state[total][0] < best[0]):
            best = *state[total], parts
    return best[2], best[1]


# -- probing and verifying -------------------------------------------------------------
def _values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), U64)
    for k, b in enumerate(bits):
        out |= ((fp >> U64(b)) & U64(1)) << U64(k)
    return out


def _masks(width: int, t: int) -> np.ndarray:
    """All patterns of at most t set bits."""
    out = {0}
    for _ in range(t):
        out |= {m | 1 << k for m in out for k in range(width)}
    return np.array(sorted(out), U64)


def _forest(fp: np.ndarray, rep: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of one bucket."""
    fp, at = np.unique(fp, return_index=True)
    rep = rep[at]
    edges, left = [], np.ones(len(fp), bool)
    for seed in range(len(fp)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            i = queue.pop()
            idx = np.flatnonzero(left)
            near = idx[np.bitwise_count(fp[idx] ^ fp[i]) <= radius]
            left[near] = False
            edges += [(int(rep[i]), int(rep[j])) for j in near]
            queue += near.tolist()
    return edges


def links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) among distinct fingerprints (fp, rep), by rep: enough of them to connect all that link."""
    n, both = bit_statistics(nodes)
    parts, limits = allot(n, both, radius)
    plan = [(k, bits, _masks(len(bits), t)) for k, (bits, t) in enumerate(zip(parts, limits, strict=True)) if t >= 0]

    def probes(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            rep = batch.column(1)
            for k, bits, masks in plan:
                value = _values(fp, bits)
                for mask in masks:
                    key = ((value ^ mask) | (U64(k) << U64(58))).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64)), rep, pa.array(np.full(len(fp), mask != 0))], ["key", "fp", "rep", "probe"])

    def verify(batches):
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            cols = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0  # the last key may go on
            if cut:
                yield _linked([c[:cut] for c in cols], radius)
            held = [c[cut:] for c in cols]
        yield _linked(held, radius)

    filed = nodes.select("fp", "rep").mapInArrow(probes, "key long, fp long, rep long, probe boolean")
    return filed.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")


def _linked(cols: list[np.ndarray], radius: int) -> pa.RecordBatch:
    key, fp, rep, probe = cols
    fp = fp.view(U64)
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[heads, len(key)])
    if len(heads):  # buckets in which something is filed and something else meets it
        filed = np.add.reduceat((~probe.astype(bool)).astype(np.int64), heads)
        live = (sizes > 1) & (filed > 0)
        keep = np.repeat(live, sizes)
        key, fp, rep, sizes = key[keep], fp[keep], rep[keep], sizes[live]
    heads = np.cumsum(sizes) - sizes
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.repeat(sizes <= 8, sizes) if len(sizes) else np.zeros(0, bool)
    for d in range(1, 8):
        i = np.flatnonzero((key[d:] == key[:-d]) & small[d:]) if len(key) > d else np.zeros(0, np.int64)
        near = i[(np.bitwise_count(fp[i] ^ fp[i + d]) <= radius) & (rep[i] != rep[i + d])]
        a.append(rep[near])
        b.append(rep[near + d])
    for h, s in zip(heads[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
        if edges := _forest(fp[h : h + s], rep[h : h + s], radius):
            x, y = np.array(edges, np.int64).T
            a.append(x)
            b.append(y)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).astype(np.int64)), pa.array(np.concatenate(b).astype(np.int64))], ["a", "b"])


def groups(fps: DataFrame, radius: int = 3) -> DataFrame:
    """One row per distinct fingerprint (``fp``): fp, root (one fingerprint of its component)."""
    nodes = durable(fps.select("fp").distinct(), "simhash-nodes")
    found = components(links(nodes.select("fp", F.col("fp").alias("rep")), radius), tag="simhash-cc")
    return durable(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("root")), "simhash-roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """One row per document: id, fp long, component_id (the smallest id reachable by links, itself included)."""
    fps = durable(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    own = fps.groupBy(F.col("fp").alias("fp1")).agg(F.min(id_col).alias("rep"))
    placed = durable(groups(fps, radius).join(own, F.col("fp") == F.col("fp1")).select("fp", "rep", "root"), "simhash-placed")
    least = durable(placed.groupBy(F.col("root").alias("root2")).agg(F.min("rep").alias("component_id")), "simhash-least")
    where = durable(placed.join(least, F.col("root") == F.col("root2")).select(F.col("fp").alias("fp2"), "component_id"), "simhash-where")
    return fps.join(where, F.col("fp") == F.col("fp2")).select(id_col, "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = 3) -> DataFrame:
    """The first row of each group of near duplicates, by id (null last), fingerprint and a hash of the text; all columns.
    Rows are chosen, not ids, so that rows with null or repeated ids are judged like all others. Texts are dealt once,
    as compressed blocks, to meet the numbers of the rows that stay."""
    names, text = docs.columns, F.col(text_col).cast("string")
    at = f"c{names.index(text_col)}"
    inner = docs.select(*(F.col(c).cast("string").alias(at) if c == text_col else F.col(c).alias(f"c{i}") for i, c in enumerate(names)), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_key"))
    stored = packed(inner, at)

    def run(batches):
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist(), strict=True):
                t = from_bytes(body)
                fp = fingerprints_of(*buffers(t.column(at)), shingle).view(np.int64)
                row = (block << BLOCK_BITS) + np.arange(t.num_rows)
                yield from pa.Table.from_arrays([pa.array(row), pa.array(fp), t.column("_id"), t.column("_key")], ["row", "fp", "_id", "_key"]).to_batches()

    def pick(batches):
        for g in grouped(batches, "block"):
            t = from_bytes(g.column("answer")[0].as_py())
            stay = np.sort(g.column("part").to_numpy()[1:])
            yield from t.drop_columns(["_id", "_key"]).take(pa.array(stay)).to_batches()

    fps = durable(stored.select("block", "body").mapInArrow(run, "row long, fp long, _id long, _key long"), "simhash-fp")
    first = F.min(F.struct(F.col("_id").isNull().alias("late"), "_id", "fp", "_key", "row"))
    own = fps.groupBy(F.col("fp").alias("fp1")).agg(first.alias("best"))
    rooted = groups(fps, radius).join(own, F.col("fp") == F.col("fp1")).groupBy("root").agg(F.min("best")["row"].alias("row"))
    stay = rooted.select(F.shiftright("row", BLOCK_BITS).alias("block"), F.col("row").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("part"), F.lit(None).cast("binary").alias("answer"))
    out = with_answers(stored, stay).mapInArrow(pick, inner.drop("_id", "_key").schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
