import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from qacorpus.llm import common as C
from qacorpus.llm import katz as K


def _tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def _held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def _discount(having):
    for top in range(5, 0, -1):
        n = [having.get(r, 0) for r in range(1, top + 2)]
        if min(n) <= 0 or (top + 1) * n[top] >= n[0]:
            continue
        common = (top + 1) * n[top] / n[0]
        d = {r: ((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) for r in range(1, top + 1)}
        if all(0 < x < 1 for x in d.values()):
            return lambda c, d=d: c * d.get(c, 1.0)
    return lambda c: max(c - 0.5, 0)


def _brute(docs, order):
    train = [_tokens(t) for i, t in docs if not _held(i)]
    uni = Counter(w for t in train for w in t)
    n = sum(uni.values())
    discount = [_discount(Counter(uni.values()))]
    unknown = 1 - sum(discount[0](c) for c in uni.values()) / n if n else 1.0
    after = [None]
    for k in range(1, order):
        grams = Counter((tuple(x[i : i + k]), x[i + k]) for t in train for x in [["<start>"] * k + t] for i in range(len(t)))
        discount.append(_discount(Counter(grams.values())))
        after.append(defaultdict(dict))
        for (h, w), c in grams.items():
            after[k][h][w] = c
    left = {}

    def p(w, h):
        if not h:
            return discount[0](uni[w]) / n if uni[w] else unknown
        have = after[len(h)].get(h)
        if have is None:
            return p(w, h[1:])
        if h not in left:
            d = discount[len(h)]
            whole, kept = sum(have.values()), sum(d(c) for c in have.values())
            over = whole if whole - kept > 1e-9 else whole + 1
            left[h] = over, (1 - kept / over) / (1 - sum(p(x, h[1:]) for x in have))
        over, weight = left[h]
        return discount[len(h)](have[w]) / over if w in have else weight * p(w, h[1:])

    for k in range(1, order):  # exactly normalised
        for h in [*list(after[k])[:5], ("never",) * k]:
            assert abs(sum(p(w, h) for w in [*uni, "unseen!"]) - 1) < 1e-9
    out = []
    for i, t in docs:
        words = _tokens(t)
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (len(uni) + 1))) for w in words)
        padded = ["<start>"] * (order - 1) + words
        total = sum(math.log10(p(w, tuple(padded[j : j + order - 1]))) for j, w in enumerate(words))
        out.append((i, _held(i), len(words), sum(uni[w] > 0 for w in words), n, base, total))
    return out


def _compare(spark, docs, order=3, **how):
    df = spark.createDataFrame([(i, t, "x", 1.5) for i, t in docs], "doc_id long, text string, chunk string, score double").repartition(3)
    got = sorted((tuple(r) for r in K.score(df, order=order, **how).collect()), key=str)
    want = sorted(_brute(docs, order), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("how", [{}, {"size": 300, "per_bucket": 100}, {"order": 1}, {"order": 2}, {"order": 4, "size": 700}])
def test_against_brute_force(spark, how):
    rnd = random.Random(2)
    words = ["The", "of", "a b", "É"] + [f"w{i}" for i in range(60)]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(i, rnd.choice([" ", "\n", "\t "]).join(rnd.choices(words, weights, k=rnd.randint(1, 60)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, " \x0b\x0c "), (None, "the of"), (3, docs[3][1]), (503, "unseen words only"), (504, "of w1 " * 2000)]
    _compare(spark, docs, **how)


def test_many_texts_in_a_batch(spark):
    rnd = random.Random(6)
    docs = [(i, " ".join(rnd.choices([f"w{i}" for i in range(40)], k=rnd.randint(0, 9)))) for i in range(2500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r) for r in K.score(df).collect())
    assert np.allclose([g[1:] for g in got], [w[1:] for w in sorted(_brute(docs, 3))], rtol=1e-9, atol=1e-9)


def test_hot_contexts(spark):
    rnd = random.Random(4)
    docs = [(i, " ".join(x for _ in range(30) for x in ("of", "the", f"w{rnd.randrange(200)}"))) for i in range(60)]
    _compare(spark, docs, hot=20, size=400)


def test_small_and_empty(spark):
    _compare(spark, [(0, "a b a")])
    held = next(i for i in range(100) if _held(i))
    _compare(spark, [(held, "a b")])
    none = spark.createDataFrame([], "doc_id long, text string")
    assert K.score(none).count() == 0


def test_discounts():
    assert K.Discounts.of(np.array([0, 100, 40, 20, 12, 8, 5])).factor is not None
    assert K.Discounts.of(np.array([0, 1, 0, 0, 0, 0, 0])).factor is None


def test_messages():
    arrays = [np.array([], np.int64), np.array([3, 1 << 40]), np.array([0.5, 1e300]), np.arange(300), np.array([2**64 - 1], np.uint64)]
    for a, b in zip(arrays, C.unpack_all(C.pack_all(*arrays))):
        assert a.tolist() == b.tolist()
