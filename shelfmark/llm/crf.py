"""Language identification by a linear-chain conditional random field over words.

Each word of a text is labelled by forward-backward under P(labels | words) ~ exp(sum of emission
scores + sum of transition scores). Emission features are hashed: byte n-grams of the word with its
edge marks (those that hold a mark are its prefixes and suffixes) and the word itself (the learned
lexicon). Emission and transition weights are learned together by maximum likelihood. Training
sequences are spliced from pieces of texts of different languages, so that the transitions learn how
languages switch. A text's language has the largest posterior mass over its words; its score is
that mass divided by the number of words.

Training uses a bounded sample: at most about ``per_language`` whole texts of each language, chosen by a hash of
the id, ``MOST_TEXTS`` and about ``MOST_BYTES`` over all; with very many languages fewer of each, and fewer feature buckets. Prediction takes every word of every text: exact forward-backward in chunks of words whose
transfer matrices are chained, so a very long text costs memory and time in proportion to its length.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if no
language can be learned; rows with null language or text are not learned from; rows that repeat give repeated rows;
extra columns are ignored; an empty table gives an empty table; ties go to the first language in alphabetical order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import NULL_ID, U64, blocks, buffers, hash_spans, ids_out, loads, longs, mix, words

BUCKETS, GRAMS, CHUNK, ROOM = 1 << 18, (1, 2, 3, 4, 5), 64, 1 << 24
PER_LANGUAGE, STEPS, RATE, RIDGE = 150, 30, 0.3, 1e-4
#: The sample to learn from: so many texts and bytes at most over all languages (a twentieth of it in one text).
MOST_TEXTS, MOST_BYTES = 30_000, 40_000_000
#: Bytes of text that are labelled together: forward-backward holds some ten numbers for each word and language.
PREDICT_BYTES = 2_500_000
#: Separators: every ASCII byte that is no letter.
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # BUCKETS x languages
    step: np.ndarray  # from x to
    start: np.ndarray


def _tokens(column):
    w = words(*buffers(pc.utf8_lower(column)), NOT_LETTER)
    return w, hash_spans(w.data, w.starts, w.ends, seed=11)


def features(w, pick: np.ndarray, h: np.ndarray, most: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets of the picked words, back to back; where each word's begin; and the value of a feature of each word."""
    size = (w.ends - w.starts)[pick]
    total = size + 2
    ends = np.cumsum(total)
    text = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    text[ends - total], text[ends - 1] = 1, 2  # edge marks
    inner = np.repeat(w.starts[pick] - (ends - total + 1), size) + _inside(ends - total + 1, size)
    text[_inside(ends - total + 1, size)] = w.data[inner]
    at = loads(text)[: len(text)]
    room = np.repeat(ends, total) - np.arange(len(text))
    word = np.repeat(np.arange(len(pick)), total)
    buckets, owner = [(mix(h[pick] + U64(77)) % U64(most)).astype(np.int32)], [np.arange(len(pick))]
    for n in GRAMS:
        ok = room >= n
        code = (at[ok] & U64((1 << 8 * n) - 1)) + U64(n << 56)
        buckets.append((mix(code) % U64(most)).astype(np.int32))
        owner.append(word[ok])
    b, o = np.concatenate(buckets), np.concatenate(owner)
    by = np.argsort(o, kind="stable")
    n = np.bincount(o, minlength=len(pick))
    return b[by], np.cumsum(n) - n, 1 / np.sqrt(np.maximum(n, 1))


def _inside(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def emissions(weight: np.ndarray, buckets, begin, value) -> np.ndarray:
    if not len(begin):
        return np.zeros((0, weight.shape[1]))
    return np.stack([np.add.reduceat(weight[buckets, k], begin) for k in range(weight.shape[1])], 1) * value[:, None]


# -- forward-backward ----------------------------------------------------------------
def posteriors(score: np.ndarray, first: np.ndarray, step: np.ndarray, start: np.ndarray) -> np.ndarray:
    """P(label of word | all words) for each word of sequences that lie back to back (``first``: their bounds).
    Sequences are taken in slices of about ``ROOM`` numbers; with many labels chunks are longer, as each has a matrix."""
    n, k = np.diff(first), score.shape[1]
    if not len(score):
        return score
    chunk = CHUNK if k <= 16 else int(min(n.max(), max(CHUNK, k * k // 4)))
    room = np.cumsum(-(-n // chunk) * (k * k + chunk * k)) // ROOM
    cuts = np.r_[0, np.flatnonzero(np.diff(room)) + 1, len(n)]
    return np.concatenate([_posteriors(score[first[a] : first[b]], first[a : b + 1] - first[a], step, start, chunk) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])


def _posteriors(score: np.ndarray, first: np.ndarray, step: np.ndarray, start: np.ndarray, chunk: int) -> np.ndarray:
    n, k = np.diff(first), score.shape[1]
    if not len(score):
        return score
    live = np.flatnonzero(n)
    chunks = -(-n[live] // chunk)
    row0 = np.cumsum(chunks) - chunks
    rows = int(chunks.sum())
    seq = np.repeat(np.arange(len(live)), chunks)
    begin = first[:-1][live][seq] + (np.arange(rows) - row0[seq]) * chunk
    length = np.minimum(chunk, first[1:][live][seq] - begin)
    e = np.exp(score - score.max(1, keepdims=True))
    t = np.exp(step - step.max())
    s = np.exp(start - start.max())
    head = np.zeros(rows, bool)
    head[row0] = True
    pot = np.zeros((rows, chunk, k))
    at = np.arange(chunk)
    real = at < length[:, None]
    pot[real] = e[(begin[:, None] + at)[real]]
    # Transfer matrix of each chunk. A sequence's first word takes the start potentials in place of a transition.
    P = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
    for i in range(chunk):
        go = np.flatnonzero(real[:, i])
        Q = P[go]
        M = Q @ t
        if i == 0:
            M[head[go]] = s
        M *= pot[go, i][:, None, :]
        P[go] = M / M.max((1, 2), keepdims=True)
    before, after = np.ones((rows, k)), np.ones((rows, k))
    for i in range(int(chunks.max())):
        go = row0[chunks > i + 1] + i
        if len(go):
            x = np.einsum("ri,rij->rj", before[go], P[go])
            before[go + 1] = x / x.max(1, keepdims=True)
        back = (row0 + chunks - 1)[chunks > i + 1] - i
        if len(back):
            x = np.einsum("rij,rj->ri", P[back], after[back])
            after[back - 1] = x / x.max(1, keepdims=True)
    alpha = np.zeros((rows, chunk, k))
    x = before
    for i in range(chunk):
        x = x @ t
        if i == 0:
            x[head] = s
        x = x * pot[:, i] + ~real[:, i, None] * 1.0
        x = x / x.max(1, keepdims=True)
        alpha[:, i] = x
    out = np.empty_like(score)
    y = after
    for i in range(chunk - 1, -1, -1):
        go = real[:, i]
        p = alpha[go, i] * y[go]
        out[(begin + i)[go]] = p / p.sum(1, keepdims=True)
        z = (y * pot[:, i]) @ t.T
        y = np.where(go[:, None], z / np.maximum(z.max(1, keepdims=True), 1e-300), y)
    return out


def buckets_for(languages: int) -> int:
    """Feature buckets: fewer if there are many languages, so that the weights stay within 2^23 numbers."""
    return max(1 << 10, min(BUCKETS, 1 << (23 - max(languages, 1).bit_length())))


# -- training ------------------------------------------------------------------------
def train(texts: list[str], langs: list[str], steps: int = STEPS) -> Model:
    names = sorted(set(langs))
    k = len(names)
    w, h = _tokens(pa.array(texts, pa.string()))
    label = np.repeat(np.array([names.index(x) for x in langs], np.int64), w.counts)
    # Splice: pieces of 10 to 80 words, in random order, in sequences of about 200 words.
    rnd = np.random.default_rng(17)
    pieces = []
    for d in range(len(texts)):
        a, b = int(w.first[d]), int(w.first[d + 1])
        while a < b:
            size = int(rnd.integers(10, 81))
            pieces.append((a, min(b, a + size)))
            a += size
    order = np.concatenate([np.arange(*pieces[i]) for i in rnd.permutation(len(pieces))]) if pieces else np.zeros(0, np.int64)
    bounds = np.unique(np.r_[0, np.arange(200, len(order), 200), len(order)])
    h, label = h[order], label[order]
    _, pick, inverse = np.unique(h, return_index=True, return_inverse=True)
    size = buckets_for(k)
    buckets, begin, value = features(w, order[pick], _scatter(h, order, len(w.starts)), size)
    model = Model(names, np.zeros((size, k)), np.zeros((k, k)), np.zeros(k))
    if not len(order):
        return model
    gold = np.eye(k)[label]
    inner = np.ones(len(order), bool)
    inner[bounds[:-1]] = False
    pair_gold = np.zeros((k, k))
    np.add.at(pair_gold, (label[:-1][inner[1:]], label[1:][inner[1:]]), 1)
    start_gold = gold[bounds[:-1]].sum(0)
    params = [model.weight, model.step, model.start]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    used, where = np.unique(buckets, return_inverse=True)
    owner = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(buckets)]))
    for n in range(1, steps + 1):
        score = emissions(model.weight, buckets, begin, value)[inverse]
        p = posteriors(score, bounds, model.step, model.start)
        diff = gold - p
        word = np.stack([np.bincount(inverse, diff[:, c], len(begin)) for c in range(k)], 1) * value[:, None]
        grad = np.zeros_like(model.weight)
        grad[used] = np.stack([np.bincount(where, word[owner, c], len(used)) for c in range(k)], 1)
        grads = [grad, pair_gold - _pairs(score, p, bounds, model, inner), start_gold - p[bounds[:-1]].sum(0)]
        for i, (x, g) in enumerate(zip(params, grads, strict=True)):
            g = g / len(order) - RIDGE * x / len(order)
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            x += RATE * (m[i] / (1 - 0.9**n)) / (np.sqrt(v[i] / (1 - 0.99**n)) + 1e-8)
    return model


def _scatter(h: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    out[order] = h
    return out


def _pairs(score, p, bounds, model, inner) -> np.ndarray:
    """Expected label pairs of neighbouring words: P(a, b) ~ forward(a) step(a, b) backward-and-emission(b),
    from the posteriors: forward(a) is what they would be without the words to the right."""
    # Sequences are about 200 words: run forward and backward over all of them at once, word by word.
    size = np.diff(bounds)
    top, k = int(size.max()), score.shape[1]
    e, t, s = np.exp(score - score.max(1, keepdims=True)), np.exp(model.step - model.step.max()), np.exp(model.start - model.start.max())
    fwd, bwd = np.zeros_like(score), np.ones_like(score)
    for i in range(top):
        at = bounds[:-1][size > i] + i
        x = (s if i == 0 else fwd[at - 1] @ t) * e[at]
        fwd[at] = x / x.sum(1, keepdims=True)
    for i in range(2, top + 1):
        at = bounds[1:][size >= i] - i
        x = (bwd[at + 1] * e[at + 1]) @ t.T
        bwd[at] = x / x.sum(1, keepdims=True)
    to = np.flatnonzero(inner)
    right = e[to] * bwd[to]
    mass = ((fwd[to - 1] @ t) * right).sum(1, keepdims=True)
    return t * ((fwd[to - 1] / mass).T @ right)


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, steps: int = STEPS) -> Model:
    """Learn from the rows for which ``learn`` is true, from a sample of about ``per_language`` whole texts a language."""
    rows = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).cast("string")).count().collect()}
    if not counts:
        return Model([], np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0))
    per_language = max(1, min(per_language, MOST_TEXTS // len(counts)))
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 1.5 * per_language / n))))
    lang = F.col(lang_col).cast("string")
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30))
    text = F.col(text_col).cast("string")
    chosen = rows.where((draw < F.element_at(share, lang) * (1 << 30)) & (F.octet_length(text) <= MOST_BYTES // 20)).select(draw.alias("draw"), lang.alias("lang"), text.alias("text"))
    got: dict[str, list] = {}
    room = dict.fromkeys(counts, MOST_BYTES // len(counts))
    for r in chosen.orderBy("draw", "lang", "text").limit(3 * per_language * len(counts) + 100).toLocalIterator():
        if len(got.setdefault(r.lang, [])) < per_language and (not got[r.lang] or room[r.lang] > 0):
            got[r.lang].append(r.text)
            room[r.lang] -= len(r.text)
    sample = [(lang, t) for lang, ts in sorted(got.items()) for t in ts]
    return train([t for _, t in sample], [lang for lang, _ in sample], steps)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, the columns of ``keep``, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(model.langs, model.weight.astype(np.float32), model.step, model.start))
    kept = [f"_keep_{c}" for c in keep]
    inner = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    schema = ", ".join(["_id long", *(f"`_keep_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double"])

    def run(batches):
        mdl = shared.value
        for t in blocks(batches, "_text", PREDICT_BYTES):
            text = t.column("_text").combine_chunks()
            n_docs = len(text)
            pred, score = ["und"] * n_docs, np.zeros(n_docs)
            if mdl.langs:
                w, h = _tokens(text)
                _, pick, inverse = np.unique(h, return_index=True, return_inverse=True)
                e = emissions(mdl.weight, *features(w, pick, h, len(mdl.weight)))
                p = posteriors(e[inverse], w.first, mdl.step, mdl.start)
                n = w.counts
                some = np.flatnonzero(n)
                mass = np.add.reduceat(p, w.first[:-1][some], axis=0) / n[some][:, None] if len(some) else np.zeros((0, 1))
                # Words of ASCII letters have a letter; other texts are looked at one by one.
                ascii_letters = np.zeros(len(w.data) + 1, np.int64)
                ascii_letters[1:] = np.cumsum(~NOT_LETTER[w.data] & (w.data < 128))
                _, off = buffers(pc.utf8_lower(text))
                plain = np.diff(ascii_letters[off]) > 0
                for row, d in enumerate(some.tolist()):
                    if plain[d] or any(c.isalpha() for c in text[d].as_py()):
                        best = int(np.argmax(mass[row]))
                        pred[d], score[d] = mdl.langs[best], min(1.0, float(mass[row, best]))
            yield from pa.Table.from_arrays([ids_out(longs(t.column("_id"), NULL_ID)), *(t.column(c) for c in kept), pa.array(pred, pa.string()), pa.array(score)], ["_id", *kept, "lang_pred", "score"]).to_batches()

    out = inner.mapInArrow(run, schema)
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_keep_{c}").alias(c) for c in keep), "lang_pred", "score")
