import numpy as np

import corpus_pipeline as P
from qacorpus.llm import jaccard_join, langid, line_dedup, quality

from .test_jaccard_join import _brute
from .test_line_dedup import _brute as _lines
from .test_packing import _check

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "language ID", "line dedup", "n-gram Jaccard join", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    steps = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, steps[-1], SF).write.parquet(f"{tmp_path}/{k}")
        steps.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert steps[-1].columns == P.COLUMNS
    rows = [{r.doc_id: r for r in s.collect()} for s in steps[:5]]
    scored = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    assert set(rows[1]) == {i for i, s in scored.items() if s >= 0.5}
    language = {r.doc_id: r.score for r in langid.predict(steps[1], langid.fit(steps[1])).collect()}
    assert set(rows[2]) == {i for i, s in language.items() if s >= 0.4}
    order = list(rows[2])
    assert [rows[3][i].text for i in order] == _lines([(rows[2][i].source, rows[2][i].text) for i in order], 0.05, 3)
    classes = _brute([(i, rows[3][i].text) for i in order])
    assert set(rows[4]) == {i for i, c, _ in classes if i == c}
    packed = steps[5].collect()
    _check(packed, [(i, rows[4][i].text) for i in rows[4]])
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([(i in rows[1]) == bool(truth[i]) for i in truth]) > 0.95
    assert sorted(map(tuple, P.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


def test_stages_on_odd_tables(spark):
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the text of a row without an id", "en", "s", 5), (3, "some text that is good enough here", "en", "s", 9), (3, "some text that is good enough here", "en", "s", 9)]
    df = spark.createDataFrame([(*r, "extra") for r in odd], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for rows in (df, df.filter("false")):
        for k, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, rows, SF)
            assert out.count() <= 2 * rows.count() + 1 and (k == 4 or out.columns == P.COLUMNS)
    assert jaccard_join.keep_one(df).filter("doc_id = 3").count() == 1 and line_dedup.drop_lines(df, "source").count() == 5


def test_a_large_group_of_copies_keeps_one(spark):
    menu, copy, small = "menu of the site\n", "\n".join(f"line {k} of the text that was copied again" for k in range(6)), "three copies\nin a source of few rows"
    rows = [(i, copy if i % 3 == 0 else menu + " ".join(f"word{i}x{k}" for k in range(30)), "s") for i in range(90)]
    rows += [(100, small, "t"), (101, small, "t"), (102, small, "t"), (103, "another text of the small source", "t")]
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    lined = P.site_lines(spark, df, SF)
    assert {r.doc_id: r.text for r in lined.collect()} == {i: t.removeprefix(menu) for i, t, _ in rows}
    kept = {r.doc_id: r.text for r in P.near_duplicates(spark, lined, SF).collect()}
    assert set(kept) == {0, 100, 103} | {i for i in range(90) if i % 3} and kept[0] == copy and kept[100] == small
