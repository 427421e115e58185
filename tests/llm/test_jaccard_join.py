import random

import numpy as np
import pyarrow as pa
import pytest

from qacorpus.llm import jaccard_join as J


def _shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def _brute(docs, least=0.8):
    sets = [_shingles(t) for _, t in docs]
    label = list(range(len(docs)))
    links = [0] * len(docs)

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][0] is None or docs[j][0] is None:
                continue
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                label[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[top(i)] = d if top(i) not in low else min(low[top(i)], d)
    return sorted(((d, low[top(i)], links[i]) for i, (d, _) in enumerate(docs)), key=str)


def _corpus(n=150, seed=4):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    texts = []
    for _ in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 5, 30, 120]))]
        if texts and rnd.random() < 0.5:
            words = rnd.choice(texts).split()
            for _ in range(rnd.choice([0, 1, 1, 2, 5])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        texts.append(" ".join(words) + (" " + passage if rnd.random() < 0.2 else ""))
    return texts


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "class_id", "n_links").collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"small": 2, "block": 3}])
def test_against_brute_force(spark, how):
    docs = [(1000 - i, t) for i, t in enumerate(_corpus())] + [(5, None), (6, ""), (7, " \n"), (None, "w1 w2"), (990, "w1 w2"), (1000, _corpus()[0])]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, tid int, n int").repartition(3)
    assert _rows(J.join(df, **how)) == _brute(docs)


def _largest(df):
    """The rows of the largest partition of the last exchanges, without what adaptive plans change."""
    return max(len(p) for p in df.select("doc_id").rdd.glom().collect())


def test_copies_are_spread(spark):
    """A third of all documents are copies of one text: no task gets them all, in the last join neither."""
    docs = [(k, "one text that many documents have and more words" if k % 3 == 0 else f"text number {k} with words of its own {k * 7}") for k in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(16)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, ("false", "-1", "16")):
            spark.conf.set(k, v)
        found = J.join(df)
        assert _largest(found) < 3 * 3000 / 16
        classes = {r.doc_id: (r.class_id, r.n_links) for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all(classes[k] == ((0, 999) if k % 3 == 0 else (k, 0)) for k in range(3000))


def test_hot_group_of_near_copies(spark):
    rnd = random.Random(8)
    base = ["w%d" % i for i in range(80)]
    docs = []
    for i in range(400):
        words = list(base)
        words[rnd.randrange(80)] = f"x{rnd.randrange(300)}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert _rows(J.join(df, small=16, block=64)) == _brute(docs)
    assert _rows(J.join(df, small=16, block=64, hot=10**9)) == _brute(docs)  # every leaf is hot


def test_keep_one(spark):
    docs = [(1, "a b c d e f"), (2, "A  b c d e f"), (3, None), (3, None), (4, "z"), (1, "a b c d e f"), (None, "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in J.keep_one(df).collect()) == ["1", "3", "4", "None"]
    assert J.join(df.filter("false")).count() == 0
    other = spark.createDataFrame([(1, "one text here"), (1, "another text"), (2, None), (2, "z")], "doc_id long, text string")
    assert sorted(J.keep_one(other).collect()) == [(1, "another text"), (2, None)]


def test_sets_and_runs():
    texts = ["a b c d e f", None, "", "A B", " a\tb\nc d e  f "]
    sets = J.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [len(_shingles(t)) for t in texts]
    assert (sets[0] == sets[4]).all()
    assert J.runs_for(0.99, 0.8, 1) == 3
    linked = J._linked([np.array([1, 2, 3, 4], np.uint64), np.array([1, 2, 3, 4, 5], np.uint64), np.array([4, 9], np.uint64)], 0.8)
    assert (linked | np.eye(3, dtype=bool)).tolist() == [[True, True, False], [True, True, False], [False, False, True]]
