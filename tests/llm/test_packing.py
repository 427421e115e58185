import bisect
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from qacorpus.llm import packing as P
from qacorpus.llm.queries import tokenizer_file

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_plan_holds_every_length_once():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 1025, 5000), rng.integers(340, 700, 999), np.full(100, 341), np.array([1024, 1]), np.array([], int), rng.integers(1, 40, 2000)):
        counts = np.bincount(lengths, minlength=1025)
        got = np.zeros(1025, int)
        for many, held in P.plan(counts):
            assert many > 0 and sum(held) <= 1024
            for n in held:
                got[n] += many
        assert (got == counts).all()


def _best_fit_decreasing(lengths):
    """Each length by itself, without counts: the sequences used."""
    spaces = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(spaces, n)
        left = spaces.pop(at) - n if at < len(spaces) else 1024 - n
        bisect.insort(spaces, left)
    return len(spaces)


def test_plan_is_never_worse_than_best_fit():
    rng = np.random.default_rng(1)
    better = 0
    for lengths in (rng.integers(1, 1025, 4000), rng.integers(340, 701, 4000), rng.integers(257, 401, 4000), np.minimum(rng.lognormal(5.5, 1, 4000).astype(int) + 1, 1024), rng.choice([341, 342, 512, 600, 130], 4000), np.full(50, 342)):
        used = sum(m for m, _ in P.plan(np.bincount(lengths, minlength=1025)))
        plain = _best_fit_decreasing(lengths.tolist())
        assert -(-lengths.sum() // 1024) <= used <= plain
        better += used < plain
    assert better >= 2


def _check(rows, docs):
    by_sequence = defaultdict(list)
    want = {}
    for doc, text in docs:
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        head = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, k] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    assert sorted((r.doc_id, r.piece) for r in rows) == sorted(want)
    for r in rows:
        assert want[r.doc_id, r.piece] == (r.start, r.length, r.ids_crc32)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by_sequence)


def test_documents(spark):
    rng = np.random.default_rng(3)
    words = ["the", "Thé", "日本", "a\nb", "<|endoftext|>", "x" * 50, "  ", "don't", "Ⱦ"]
    docs = [(0, None), (1, ""), (2, "the " * 9000), (3, "<|endoftext|>")] + [(i, " ".join(rng.choice(words, rng.integers(1, 700)))) for i in range(4, 120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = P.pack_documents(df, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken")).collect()
    used = _check(rows, docs)
    assert used <= -(-sum(r.length for r in rows) // 1024) * 1.05 + 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, piece int")
    assert P.pack_documents(df, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken")).count() == 0
