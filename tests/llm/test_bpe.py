import hashlib
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402

from shelfmark.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "a  b", "  x", "x  ", "I'll  we're 's", "<|endoftext|>", "a!<|endoftext|>!", "  <|endoftext|>  b", " \n\n a", "é ü 你好 🙂🙂",
    "aaaaaaaaaaaaaaaa", "   \t  \n x1234 ...", "x<|endo", "<|endoftext|><|endoftext|>", "\x1c \x85\xa0x", "word " * 3000,
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def texts(n=60):
    rnd = random.Random(3)
    return ODD + ["".join(rnd.choice(" \nab'é<|.1lrsS🙂") for _ in range(40)) for _ in range(n)]


def test_every_prefix_counts_as_the_library_does(library):
    vocab = bpe.Vocab(bpe.read_vocab(PATH))
    for t in texts():
        t = (t or "")[:200]
        assert bpe.text_prefix_counts(vocab, t).tolist() == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(1, len(t) + 1)]


def test_counts_cut_and_digests(spark, library):
    vocab = bpe.read_vocab(PATH)
    rows = [(i, t, "clash") for i, t in enumerate(texts(20))] + [(None, "no id", "x"), (0, None, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    got = {(r.doc_id, r.n_bytes): r for r in bpe.token_counts(docs, vocab, 5).collect()}
    back = {r.doc_id: r for r in bpe.bpe_decode(bpe.bpe_encode(docs, vocab), vocab).collect()}
    assert len(back) == len(rows) - 1
    once = bpe.bpe_round_trip(docs, vocab, keep=("_id",)).collect()
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in once) == sorted((r.doc_id or 0, r.ids, r.decoded) for r in bpe.bpe_decode(bpe.bpe_encode(docs, vocab), vocab).collect())
    for i, t, _ in rows:
        t = t or ""
        ids = library.encode(t, add_special_tokens=False).ids
        r = got[i, len(t.encode())]
        assert r.n_tokens == len(ids)
        fit = max((k for k in range(len(t) + 1) if len(t) < 500 and len(library.encode(t[:k], add_special_tokens=False).ids) <= 5), default=0)
        assert len(t) >= 500 or r.cut_chars == fit
        if i:
            assert hashlib.sha256(",".join(map(str, back[i].ids)).encode()).digest() == hashlib.sha256(",".join(map(str, ids)).encode()).digest()
            assert back[i].decoded == library.decode(ids, skip_special_tokens=False)


def test_prefixes_operator_and_budget(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in bpe.token_prefixes(docs, bpe.read_vocab(PATH)).withColumn("two", bpe.fits(F.col("prefix_tokens"), 2)).collect()}
    assert len(out[1].prefix_tokens) == 13 and out[1].two == 7 and out[2].prefix_tokens == [] and out[2].two == 0


def test_decode_of_null_lists_and_unknown_ids(spark):
    ids = bpe.Vocab(bpe.read_vocab(PATH)).encode("two words")
    rows = [(1, None), (2, []), (3, [ids[0], None, 999_999, -5, *ids[1:]])]
    coded = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.bpe_decode(coded, bpe.read_vocab(PATH)).collect()} == {1: "", 2: "", 3: "two words"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.token_counts(docs, bpe.read_vocab(PATH)).count() == 0
    assert bpe.bpe_encode(docs, bpe.read_vocab(PATH)).count() == 0
