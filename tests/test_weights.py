import pytest
from pyspark.sql import functions as F

from qacorpus.plans import corpus_queries

ENDS = [a + b for a in "abcdefghijklmnopqrstuv" for b in "abcdefghijklmnopqrstuvwxy"]
STRONG, WEAK = ["stark" + x for x in ENDS[:250]], ["weak" + x for x in ENDS[250:]]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """80 documents a language. 250 words are in all German and a fourth of the English ones, 300 in all English and half of the German ones."""
    path = str(tmp_path_factory.mktemp("tables"))
    words = lambda i, lang: STRONG * (lang == "de" or i % 4 == 0) + WEAK * (lang == "en" or i % 2)
    rows = [(2 * i + k, f"t{i}{lang}\n" + " ".join(words(i, lang)), lang) for i in range(80) for k, lang in enumerate(("de", "en"))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("src0"), "n_chars": F.length("text")}).write.parquet(f"{path}/documents.parquet")
    return path


def test_weights_of_all_lemmas(spark, sf_dir):
    got = {(r["class"], r.lemma): r.z for r in corpus_queries.QUERIES["m04_weights"](spark, sf_dir).collect()}
    assert set(got) == {(c, w) for c in ("de", "en") for w in STRONG + WEAK}
    assert all(got["en", w] > 0 > got["de", w] for w in WEAK) and all(got["de", w] > 0 > got["en", w] for w in STRONG)


def test_points_of_all_lemmas(spark, sf_dir):
    z = {(r["class"], r.lemma): r.z for r in corpus_queries.QUERIES["m04_weights"](spark, sf_dir).collect()}
    got = {r.query_id: (r["class"], r.score) for r in corpus_queries.QUERIES["m05_classified"](spark, sf_dir).collect()}
    assert len(got) == 160 and got[0] == ("de", round(sum(z["de", w] for w in STRONG), 4))
    assert got[3] == ("en", round(sum(z["en", w] for w in WEAK), 4)) and got[3][1] > 0


def test_top_lemmas_of_all(spark, sf_dir):
    got = corpus_queries.QUERIES["m16_top_lemmas"](spark, sf_dir).collect()
    assert sorted(r.lemma for r in got if r["class"] == "en") == WEAK[:40]  # 250 others weigh more, against it
    assert sum(r["class"] == "de" for r in got) == 40
