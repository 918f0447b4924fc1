import random
from collections import Counter

import pytest

from stratigraph.llm.bpe import Encoder, encode_texts, tokenizer_path
from stratigraph.llm.packing import pack, plan

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def enc():
    return Encoder(tokenizer_path())


@pytest.fixture(scope="module")
def hf():
    t = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_equals_public_library(enc, hf):
    r = random.Random(5)
    texts = ["".join(r.choice("ab aeé中<|>end\n\t 0'ts😀�") for _ in range(r.randint(0, 200))) for _ in range(500)]
    texts += ["", " ", "\n\n", "a" * 20_000, " " * 9_999, "=-" * 5_000, "<|endoftext|> it's", "I'LL we'll"]
    for t in texts:
        assert enc.encode(t) == hf.encode(t, add_special_tokens=False).ids


def test_frame_with_nulls(spark, enc):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "def f():", "x"), (3, "def f():", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_texts(df).collect())
    assert got == [(1, []), (2, []), (3, enc.encode("def f():")), (3, enc.encode("def f():"))]
    assert encode_texts(df.limit(0), count_only=True).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_every_item_once(seed):
    r = random.Random(seed)
    h = Counter(r.choice([r.randint(1, 100), 37, 5, 1]) for _ in range(r.randint(1, 800)))
    used = Counter()
    boxes = 0
    for pattern, m in plan(dict(h), 100):
        assert sum(s * k for s, k in pattern.items()) <= 100 and m > 0
        boxes += m
        for s, k in pattern.items():
            used[s] += k * m
    assert used == h
    least = -(-sum(s * c for s, c in h.items()) // 100)
    assert boxes <= least * 1.25 + 2


def test_pack(spark):
    r = random.Random(2)
    rows = [(i, r.choice([0, None, 7, 7, 7, r.randint(1, 400)])) for i in range(500)] + [(1, 7)]
    out = pack(spark.createDataFrame(rows, "id long, n int"), "id", "n", 100, bucket_rows=50).collect()
    assert Counter((x.id, x.pieces) for x in out if x.piece == 0) == Counter((i, max(1, -(-(n or 0) // 100))) for i, n in rows)
    fill = Counter()
    for x in out:
        fill[x.container] += x.size
        assert x.pieces == 1 or x.piece == x.pieces - 1 or x.size == 100
    assert max(fill.values()) <= 100 and sum(fill.values()) == sum(n or 0 for _, n in rows)
    assert len([c for c in fill if fill[c]]) <= sum(fill.values()) / 100 * 1.02 + 2
    assert pack(spark.createDataFrame([], "id long, n int"), "id", "n").count() == 0


def test_index_of_sums():
    """Pairs and triples of the index against a plain search, also after some lengths are used up."""
    import numpy as np

    from stratigraph.llm.packing import Sums

    avail = np.zeros(51, np.int64)
    avail[[1, 2, 3, 7, 20, 25, 30, 50]] = 2
    s = Sums(avail, 50)
    for gone in (0, 7, 25):
        avail[gone] = 0
        for total in range(51):
            for top in (50, 25, 3):
                assert s.pairs(total, top).tolist() == [x for x in range(top, 0, -1) if 0 < total - x <= x and avail[x] > 0 and avail[total - x] > 0]
                firsts = set(s.firsts(total, top).tolist())
                assert firsts >= {c for c in range(1, min(top, total - 2) + 1) if avail[c] > 0 and len(s.pairs(total - c, 50))}
