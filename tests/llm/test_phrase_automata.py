"""Phrase automata and collocations against counts by brute force."""

import random
import re
from bisect import bisect_right
from collections import Counter

import pytest

from qacorpus.llm import phrase_automata as P

VOCABULARY = [b"a", b"b", b"ab", b"abc", b"\x00x", "zzé".encode(), b"q" * 300, b"q" * 299 + b"r", b"the"]


def brute(texts, langs):
    """How often each language, word and phrase of two and three words occurs."""
    found = Counter()
    for text, lang in zip(texts, langs):
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", text.lower()):
            w = [x for x in re.split(rb"[ \t]+", piece) if x]
            for k in range(len(w)):
                found[(lang,)] += 1
                for n in (1, 2, 3):
                    if k + n <= len(w):
                        found[(lang, *w[k : k + n])] += 1
    return found


def listed(a):
    return {a.key(k, i): int(w) for k in range(P.LEVELS) for i, w in enumerate(a.weights[k]) if w}


def text(rng, n):
    return b"".join(rng.choice(VOCABULARY) + rng.choice([b" ", b" ", b"  ", b"\t", b". ", b"\n"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(12))
def test_automata(seed):
    rng = random.Random(seed)
    texts = [text(rng, rng.choice([0, 1, 2, 5, 40])) for _ in range(rng.choice([1, 3, 10]))]
    langs = [rng.choice([b"en", b"", b"und", b"e"]) for _ in texts]
    a, want = P.counted(texts, langs), brute(texts, langs)
    assert listed(a) == want and listed(P.Automaton.unpack(a.pack())) == want
    assert listed(P.Automaton.union([P.counted(texts[::2], langs[::2]), P.counted(texts[1::2], langs[1::2])])) == want
    blocks = list(a.blocks(7))
    assert sum(len(listed(b)) for b in blocks) == len(want) and listed(P.Automaton.union(blocks) if blocks else a) == want
    splitters, got = sorted(rng.sample(sorted(want), min(4, len(want)))), {}
    for r, piece in a.cut(splitters):
        assert all(bisect_right(splitters, k) == r for k in listed(piece))
        got |= listed(P.Automaton.unpack(piece.pack()))
    assert got == want
    often = a.frequent(2)
    assert listed(often) == {k: v for k, v in want.items() if v >= 2}
    for k, found in enumerate(a.find(often)):
        assert all(a.key(k, j) == often.key(k, i) for i, j in enumerate(found))
    assert all((m < 0).all() for m in often.find(P.counted([b"nowhere else"], [b"xx"])))


@pytest.mark.parametrize("most", [1, 5, 23, 100])
def test_long_texts_in_parts(most):
    data = text(random.Random(most), 80).lower()
    parts = list(P._parts(data, most))
    assert listed(P.Automaton.union([P.counted([p], [b"en"], skip) for p, skip in parts])) == brute([data], [b"en"])


def test_equal_ends_are_one_state():
    data = b"\n".join(b"w%d same end" % k for k in range(3000))
    a = P.counted([data], [b"en"])
    states, degree, _ = P._states(a.arcs[3], [a.labels[3].astype("int64"), a.weights[3]])
    assert len(states) == 3001 and len(degree) == 2  # all go on with one last word but "same end", which ends


def best(rows, least=10, share=50, top=2000):
    """The contract's words, row by row."""
    f = brute([(t or "").encode() for t, _ in rows], [(lang if lang is not None else "und").encode() for _, lang in rows])
    three = {p: c for p, c in f.items() if len(p) == 4 and c >= least}
    out = []
    for p, a in f.items():
        if len(p) < 3 or a < least:
            continue
        if len(p) == 3 and any(100 * c >= share * a for q, c in three.items() if q[0] == p[0] and p[1:] in (q[1:3], q[2:4])):
            continue
        cuts = [(1_000_000 * a * a // (f[p[: 1 + k]] * f[(p[0], *p[1 + k :])]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        out.append((p[0], -score, -a, b" ".join(p[1:]), f[p[: 1 + k]], f[(p[0], *p[1 + k :])], f[p[:1]]))
    out.sort()
    ranks, rows = Counter(), []
    for lang, score, a, phrase, left, right, n in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            rows.append((lang.decode(), ranks[lang], phrase.decode(), -a, left, right, n, -score))
    return rows


@pytest.mark.parametrize(("paths", "top"), [(40, 2000), (10**6, 7)])
def test_collocations(spark, paths, top):
    rng = random.Random(1)
    words = ["the", "New", "york", "City", "of", "a", "ż", "x" * 40]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 30]))) + rng.choice([".", "\n", "", "; "]) + " New york City", rng.choice(["en", "pl", None])) for _ in range(120)]
    rows += [(None, "en"), ("", None), ("", "zz"), ("a a a a a a a a a a a a a a a", "rep")] + [("New York City of Rome", "en")] * 40
    docs = spark.createDataFrame([(k, t, lang, 1, 2) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, n int, rank int").repartition(5)
    found = sorted(tuple(r) for r in P.collocations(docs, paths=paths, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert found == sorted(best(rows, top=top))
    assert any(r[2] == "new york city" for r in found)


def test_hot_prefix_is_cut(spark):
    """A third of all paths go on from one pair of words: the ranges between splitters hold about the same."""
    docs = spark.createDataFrame([(k, "\n".join(f"hot pair w{k}x{j} other{k}y{j}" for j in range(200)), "en") for k in range(60)], "doc_id long, text string, lang string").repartition(6)
    blocks = P.stored(P.shards(docs, volume=1 << 14, block=500), "test")
    splitters = P._splitters(blocks, 2000)
    assert any(s[:3] == (b"en", b"hot", b"pair") for s in splitters)
    sizes = Counter()
    for row in blocks.select("data").collect():
        for r, piece in P.Automaton.unpack(row.data).cut(splitters):
            sizes[r] += len(listed(piece))
    assert max(sizes.values()) < 4 * sorted(sizes.values())[len(sizes) // 2]


def test_ranges_without_frequent_paths(spark):
    assert P.Automaton.union([]).size == 0 and P.Automaton.unpack(P.Automaton.union([]).pack()).size == 0
    rows = [(" ".join(f"{c}{k}x{j}" for j in range(30)), "en") for k, c in enumerate("bcdfghjklm")] + [("zz yy", "en")] * 12
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)
    found = sorted(tuple(r) for r in P.collocations(docs, paths=20).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert found == sorted(best(rows)) and len(found) == 1


def test_empty_table(spark):
    assert P.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
