import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import tokens

from .helpers import clashing, docs, empty

ODD = ["", "  ", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "é é ́x y　z", "don't  It's\tx\r\ny, z. ...", "ΑΣ Σ, x", "İstanbul ǅ ﬁ.", " ".join(chr(i) for i in range(1, 3000)), "x" * 5000, "a,\x1cb. c", "Ünï, Ça. ªº, µ.\n1, 2. A1, b.", "word " * 30_000]


@pytest.mark.parametrize("top", [1, 2, 300, 49408, 1 << 20, 1 << 60, 1 << 64])
def test_simple8b(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 2, 59, 60, 61, 3000):
        x = rng.integers(0, top, n, dtype=np.uint64)
        words = tokens.encode(x)
        assert (tokens.decode(words) == x).all()
    x = np.where(rng.random(5000) < 0.02, np.uint64((1 << 64) - 5), rng.integers(0, 3, 5000).astype(np.uint64))
    assert (tokens.decode(tokens.encode(x)) == x).all()


def test_ids_are_the_librarys():
    whole = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    for _ in range(2):  # unknown pieces, then known ones
        for got, want in zip(tokens.encoder()(ODD), whole.encode_batch(ODD, add_special_tokens=False), strict=True):
            assert got.tolist() == want.ids


def test_round_trip(spark):
    texts = [None, *ODD, "same", "same"]
    d = clashing(docs(spark, *texts), "part", "block", "start").unionByName(clashing(docs(spark, "again"), "part", "block", "start"))
    whole = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    order = sorted([(i, t or "") for i, t in enumerate(texts)] + [(0, "again")])
    want, at = [], 0
    for i, t in order:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, tokens.END_ID], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in tokens.round_trip(d).collect()) == sorted(want)
    assert tokens.round_trip(empty(spark)).count() == 0
    assert tuple(tokens.round_trip(spark.createDataFrame([(None, "")], "doc_id long, text string")).first())[:3] == (None, 0, 1)


def test_few_texts_at_once(spark, tmp_path):
    """A worker's arrays are of few texts, however many a batch has."""

    def encoder():
        def ids(texts):
            assert len(texts) <= 125
            return [np.array([7], dtype=np.uint32) for _ in texts]

        return ids

    many = docs(spark, *["a text"] * 1200)
    tokens.write(many, f"{tmp_path}/ids", tokenizer=encoder)
    assert tokens.read(spark, f"{tmp_path}/ids").where("n_tokens = 2").count() == 1200
