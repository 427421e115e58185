import random
import zlib

import numpy as np

from qacorpus.llm import quality as Q


def _docs(n=240):
    rnd = random.Random(5)
    out = []
    for i in range(n):
        words = ["".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(5, 200))]
        good = i % 3 > 0
        out.append((i, " ".join(words) + "." if good else " ".join(w + rnd.choice(["&&&", "###"]) for w in words), int(good)))
    return out


def test_held_out_accuracy_and_brute_force(spark):
    rows = _docs()
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(900, None, "en"), (901, "", None), (5, rows[5][1], "en")], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (3000, 0), (7, None)], "doc_id long, quality int")
    got = Q.score(docs, labels).collect()
    assert len(got) == len(rows) + 3
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    truth = {i: q for i, _, q in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    tested = [r for r in got if r.doc_id in held and r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.95
    # brute force: densities from inverses and determinants
    x = {i: Q.statistics(t.encode()) for i, t, _ in rows}
    train = [i for i, _, _ in rows if not held[i]] + [5] * (not held[5])
    groups = [np.array([x[i] for i in train if truth[i] == k]) for k in (0, 1)]
    scatter = [(g - g.mean(0)).T @ (g - g.mean(0)) for g in groups]
    log = []
    for g, s in zip(groups, scatter):
        c = 0.9 * s / len(g) + 0.1 * sum(scatter) / len(train)
        c += (0.1 * np.trace(c) / len(c) + 1e-9) * np.eye(len(c))
        log.append(lambda v, g=g, c=c: np.log(len(g) / len(train)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (v - g.mean(0)) @ np.linalg.inv(c) @ (v - g.mean(0)))
    for r in got:
        if r.doc_id in x:
            want = 1 / (1 + np.exp(np.clip(log[0](x[r.doc_id]) - log[1](x[r.doc_id]), -700, 700)))
            assert abs(want - r.score) < 1e-6


def test_clean_keeps_good_rows_as_they_are(spark):
    rows = _docs()
    docs = spark.createDataFrame([(i, t, "en", i) for i, t, _ in rows], "doc_id long, text string, lang string, x long")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    kept = Q.clean(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([(i in ids) == bool(q) for i, _, q in rows]) > 0.95


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.score(docs, none).collect()] == [0.5, 0.5]
    assert Q.score(docs.filter("false"), none).count() == 0
