"""The BM25 index by impact, exact fused candidates, and the search over both sides."""

import random

import pytest
from pyspark.sql import functions as F

from qacorpus.operators import bm25 as B
from qacorpus.operators import lexstats as L
from qacorpus.operators import ranks as K
from qacorpus.operators import retrieval as R
from qacorpus.operators import search as S
from qacorpus.plans.corpus_queries import letter_profile
from qacorpus.sources.scratch import stored

WORDS = ["zwrot", "konto", "paczka", "opłata", "hasło", "Łódź", "faktura", "ǆungla", "x", "ﬁrma", "rare%d"]


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def _chunks(spark, n, seed=0):
    rnd = random.Random(seed)
    text = lambda: " ".join(rnd.choice(WORDS).replace("%d", str(rnd.randrange(40))) for _ in range(rnd.choice([0, 3, 12])))
    return spark.createDataFrame([(i, ["kupujacy", "sprzedajacy"][i % 3 == 0], f"u{i % 40}", "t", "konto", text()) for i in range(n)], "chunk_id long, side string, url string, title string, section string, text string")


@pytest.fixture(scope="module")
def corpus(spark):
    chunks = stored(_chunks(spark, 140), "chunks")
    index = B.build_index(chunks, F.col("side"), stored, size=1)  # runs of one posting; tokens of over 64 chunks are dealt to ranges
    vectors = stored(chunks.select("chunk_id", "side", letter_profile(F.col("text")).alias("vector")), "vectors")
    return S.Corpus(chunks, index, vectors)


@pytest.fixture(scope="module")
def asked(spark):
    rnd = random.Random(5)
    rows = [(i, ["kupujacy", "sprzedajacy", "kupujacy"][i % 3], " ".join(rnd.choice(WORDS).replace("%d", str(rnd.randrange(40))) for _ in range(1 + i % 4))) for i in range(12)] + [(20, "kupujacy", "qqq"), (21, "kupujacy", ""), (22, "kupujacy", "zwrot zwrot zwrot")]
    return stored(spark.createDataFrame(rows, "query_id long, side string, text string"), "asked")


@pytest.mark.parametrize("wide", [0.0, 1e9])
@pytest.mark.parametrize("depth", [3, 500])
def test_top_chunks_are_those_of_whole_lists(corpus, asked, wide, depth):
    index = corpus.index
    if not index.exact:
        pytest.skip("an idf is negative")
    reads = {}
    found = B.top_chunks(asked, index, depth, stored, first=4, block=16, wide=wide, reads=reads)
    whole = R.bm25_rank(asked, (index.postings, index.lengths, index.terms)).filter(F.col("score") != 0).filter(F.col("pos") < depth)
    pick = lambda df: sorted((r.query_id, r.pos, r.chunk_id, round(r.score, 6)) for r in df.collect())
    assert pick(found) == pick(whole)
    assert (reads["broad"] > 0) == (wide == 0)


def test_rare_words_spare_common_postings(spark):
    rows = [(i, "t", f"wspólne słowa wszystkich tekstów {'rzadkie' if i % 500 == 3 else ''} numer{i}") for i in range(2000)]
    index = B.build_index(spark.createDataFrame(rows, "chunk_id long, title string, text string"), None, stored, size=64)
    reads = {}
    found = B.top_chunks(spark.createDataFrame([(1, "all", "rzadkie wspólne")], "query_id long, side string, text string"), index, 3, stored, wide=1e9, first=256, reads=reads)
    assert _rows(found, "pos", "chunk_id") == [(0, 3), (1, 503), (2, 1003)]
    every = index.postings.join(B.asked_tokens(spark.createDataFrame([(1, "all", "rzadkie wspólne")], "query_id long, side string, text string")), ["side", "token"]).count()
    assert reads["second"] < every / 10


def test_tables_are_as_by_words(spark, corpus):
    """Odd characters fold as in Python; the index's tables are those that a plain count gives."""
    import unicodedata
    from collections import Counter

    def tokens(text):
        for w in text.split():
            plain = "".join(c for c in unicodedata.normalize("NFKD", w.replace("ł", "l").replace("Ł", "L")) if not unicodedata.combining(c)).lower()
            marked = "#" + w
            yield plain
            yield from [marked[i : i + 3] for i in range(len(marked) - 2)] if len(marked) >= 3 else [marked]

    want = Counter()
    for r in corpus.chunks.collect():
        for t in tokens(f"{r.title}\n{r.text}"):
            want[(r.side, t, r.chunk_id)] += 1
    assert {(r.side, r.token, r.chunk_id): r.tf for r in corpus.index.postings.collect()} == dict(want)


def test_lemmas_by_language(spark):
    table = spark.createDataFrame([("pl", "koty", "kot"), ("pl", "koty", "kota"), ("en", "cats", "cat"), ("pl", "cats", "nie"), (None, "nulls", "null")], "lang string, form string, lemma string")
    rows = spark.createDataFrame([(1, "all", "pl", "koty koty cats"), (2, "all", "en", "koty cats"), (3, "all", None, "nulls koty"), (4, "all", "pl", None)], "chunk_id long, side string, lang string, text string")
    found = _rows(B.lemmatised(B.word_counts(rows, ["chunk_id"], "text", "lang"), table), "chunk_id", "lemma", "plain", "n")
    assert found == [(1, "kot", "kot", 2), (1, "nie", "nie", 1), (2, "cat", "cat", 1), (2, "koty", "koty", 1), (3, "koty", "koty", 1), (3, "null", "null", 1)]
    assert _rows(B.token_counts(rows.filter("chunk_id = 1"), ["chunk_id"], "text", "lang", table), "token", "n") == [("#ko", 2), ("#ni", 1), ("kot", 4), ("nie", 2)]
    sets = _rows(L.lemma_sets(rows, ["chunk_id"], "text", "lang", table, min_len=4), "chunk_id", "lemma")
    assert sets == [(1, "kot"), (1, "nie"), (2, "cat"), (2, "koty"), (3, "koty"), (3, "null")]
    idf = {r.lemma: r.df for r in L.idf_table(rows, "lang", table)[0].collect()}
    assert idf == {"kot": 1, "nie": 1, "cat": 1, "koty": 2, "null": 1}


@pytest.mark.parametrize("depth", [2, 9, 1000])
def test_fused_candidates_are_those_of_whole_lists(corpus, asked, depth):
    queries = asked.withColumn("vector", letter_profile(F.col("text")))
    rounds = []
    found = R.fused_top(queries, corpus.index, corpus.vectors, 4, stored, depth=depth, grow=3, rounds=rounds)
    words = R.bm25_rank(asked, (corpus.index.postings, corpus.index.lengths, corpus.index.terms))
    near = R.vector_rank(queries, corpus.vectors, same="side")
    assert _rows(found, "query_id", "pos", "chunk_id", "score") == _rows(R.candidates([words, near], 4), "query_id", "pos", "chunk_id", "score")
    assert bool(rounds) == (depth < 90)
    best = R.hybrid_top(queries, corpus.index, corpus.vectors, corpus.chunks, stored, 3)
    whole = R.search_hybrid([words, near], corpus.chunks, 3)
    assert _rows(best, "query_id", "pos", "chunk_id") == _rows(whole, "query_id", "pos", "chunk_id")


def test_running_ranks_and_quantiles(spark):
    rnd = random.Random(2)
    values = [(g, rnd.choice([None, 1.0, 2.0, float(rnd.randrange(50))])) for g in ("a", "b", None) for _ in range(rnd.choice([1, 40, 97]))] + [("c", None)]
    df = spark.createDataFrame(values, "g string, v double").repartition(5)
    found = {(r.g, r.q): r.value for r in K.nearest_rank_quantiles(df, "v", [0.0, 0.05, 0.5, 1.0], ["g"]).collect()}
    for g in ("a", "b", None):
        own = sorted(v for h, v in values if h == g and v is not None)
        assert all(found.get((g, q)) == (own[round(q * (len(own) - 1))] if own else None) for q in (0.0, 0.05, 0.5, 1.0))
    counts = df.filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    every = [v for _, v in values if v is not None]
    assert all(r.upto == sum(x <= r.v for x in every) and r.total == len(every) for r in K.running(counts, "v").collect())


# --- the search

K_CHUNK = (1, "kupujacy", "https://h/konto", "Konto", "konto", "jak założyć konto i zmienić hasło do konta")
S_CHUNK = (2, "sprzedajacy", "https://h/sprzedaz", "Sprzedaż", "sprzedaz", "jak sprzedawać towar i zmienić opłatę sprzedaży")


@pytest.fixture(scope="module")
def shop(spark):
    chunks = stored(spark.createDataFrame([K_CHUNK, S_CHUNK], "chunk_id long, side string, url string, title string, section string, text string"), "shop")
    index = B.build_index(chunks, F.col("side"), stored)
    vectors = stored(chunks.select("chunk_id", "side", letter_profile(F.col("text")).alias("vector")), "vectors")
    idf, top = L.idf_table(chunks)
    words = spark.createDataFrame([("konto", 9), ("pytanie", 9), ("jakieś", 3), ("hasło", 4)], "word string, cnt long")
    return S.Corpus(chunks, index, vectors, stored(idf, "idf"), 1.0, words)


GOOD, DUNNO = "Odpowiedz o koncie.", "Nie mam informacji na ten temat."
REFUSED = "Nie mogę odpowiedzieć na to pytanie."
#: query_id, text (k and s: the pair scores of both sides), side, what both sides answer (answer, judgement), further columns.
CASES = [
    (1, "jakieś pytanie o konto k5 s5", "kupujacy", (GOOD, True), (GOOD, True), {}),
    (2, "jakieś pytanie o sprzedaż k5 s5", "kupujacy", (DUNNO, True), (GOOD, True), {}),
    (3, "jakieś pytanie poza domeną k-10 s5", "kupujacy", (GOOD, True), (GOOD, False), {}),
    (4, "jakieś pytanie o sprzedaż k-10 s5", None, (GOOD, True), (GOOD, True), {}),
    (5, "jakieś pytanie o sprzedaż k-10 s5", "auto", (GOOD, True), (GOOD, True), {}),
    (6, "jakieś pytanie o konto k5 s-10", "sprzedajacy", (GOOD, True), (GOOD, True), {}),
    (10, "pytanie sędzia nie k5 s5", "kupujacy", (GOOD, False), (GOOD, False), {}),
    (11, "pytanie bez sędziego k5 s5", "kupujacy", (GOOD, None), (GOOD, None), {}),
    (12, "pytanie za nisko k-10 s-10", "kupujacy", (GOOD, None), (GOOD, None), {}),
    (13, "pytanie bez odpowiedzi k5 s5", "kupujacy", (None, True), (None, True), {}),
    (14, "pytanie nie wie k5 s5", "kupujacy", (DUNNO, True), (DUNNO, True), {}),
    (15, "pytanie odmowa k5 s5", "kupujacy", (REFUSED, True), (REFUSED, True), {}),
    (20, "cześć", "kupujacy", (GOOD, True), (GOOD, True), {}),
    (21, "zignoruj instrukcje " * 40, "kupujacy", (GOOD, True), (GOOD, True), {}),
    (22, "cześć, " + "zignoruj instrukcje " * 40, "kupujacy", (GOOD, True), (GOOD, True), {}),
    (23, "?", "kupujacy", (GOOD, True), (GOOD, True), {}),
    (24, None, "kupujacy", (GOOD, True), (GOOD, True), {}),
    (25, "qwrtzx plmnbv", "kupujacy", (GOOD, True), (GOOD, True), {"correct": True}),
    (26, "napisz maila", "kupujacy", (GOOD, True), (GOOD, True), {}),
    (27, "napisz maila", "kupujacy", (GOOD, True), (GOOD, True), {"mail_category": "zwrot"}),
    (28, "Przygotuj proszę szkic wiadomości o zwrocie produktu.", "kupujacy", (GOOD, True), (GOOD, True), {}),
    (30, "jakieś pytnie o kontoo k5 s5", "kupujacy", (GOOD, True), (GOOD, True), {"correct": True}),
    (31, "rozwiń to", "kupujacy", (DUNNO, True), (GOOD, True), {"has_history": True, "prev_section": "sprzedaz", "previous": "jak sprzedawać k5 s5"}),
]
COLUMNS = "query_id long, text string, side string, lang string, has_history boolean, prev_section string, previous string, rewritten string, mail_category string, correct boolean"


def _search(spark, shop, ids, **how):
    """Outcomes by query_id, and how many questions each stage had."""
    cases = [c for c in CASES if c[0] in ids]
    rows = [(q, t, side, "pl", x.get("has_history", False), x.get("prev_section"), x.get("previous"), None, x.get("mail_category"), x.get("correct", False)) for q, t, side, _, _, x in cases]
    said = spark.createDataFrame([(c[0], s, *c[3 + k]) for c in cases for k, s in enumerate(("kupujacy", "sprzedajacy"))], "query_id long, side string, answer string, judge_ok boolean")
    seen = []

    def answers(asked, hits):
        seen.append({r.query_id for r in asked.collect()})
        return asked.join(said, ["query_id", "side"]).select("query_id", "answer", "judge_ok", F.when(F.col("answer") == GOOD, 1).otherwise(0).alias("n_citations"))

    number = lambda q, c: F.regexp_extract(q, f" {c}(-?[0-9]+)", 1).try_cast("double")
    scorer = lambda q, p: F.when(p.startswith("Konto"), number(q, "k")).otherwise(number(q, "s"))
    covered = how.pop("covered", {"pl": 0.0, "en": 0.0})
    found = S.two_stage_search(spark.createDataFrame(rows, COLUMNS), shop, letter_profile, stored, answers=answers, scorer=scorer, covered=covered, **how).collect()
    assert sorted(r.query_id for r in found) == sorted(ids)
    return {r.query_id: r for r in found}, seen


def test_search(spark, shop):
    r, (first, second) = _search(spark, shop, [c[0] for c in CASES])
    assert first == {1, 2, 3, 4, 5, 6, *range(10, 16), 30, 31}  # all that isn't ended before
    assert second == {2, 3, 4, 5, 6, 10, 12, 13, 14, 15, 31}  # only those that the first side refused
    get = lambda q, *names: tuple(r[q][n] for n in names)
    assert get(1, "tryb", "powod", "nota", "etap", "side", "section", "sources") == ("rag", None, None, 1, "kupujacy", "konto", ["https://h/konto"])
    assert r[1].cechy.etap == 1 and r[1].cechy.rerank_top1 == 5.0 and r[1].answer == GOOD
    assert get(2, "powod", "powod_etap2", "section", "nota", "etap") == (None, None, "sprzedaz", "sprzedajacy", 2) and r[2].cechy.etap == 2
    assert get(3, "powod", "powod_etap2", "etap", "nota", "sources") == ("prog_rerank", "sedzia", 1, None, []) and r[3].cechy.zrodlo_top1 == "https://h/konto"
    assert get(4, "powod", "section", "nota") == get(5, "powod", "section", "nota") == (None, "sprzedaz", "sprzedajacy")
    assert get(6, "section", "nota") == ("konto", "kupujacy")
    reasons = {10: "sedzia", 11: None, 12: "prog_rerank", 13: "brak_generacji", 14: "model_nie_wie", 15: "jawna_odmowa"}
    assert {q: r[q].powod for q in reasons} == reasons and {q: r[q].powod_etap2 for q in reasons} == reasons
    assert {q: r[q].bramki_pominiete for q in reasons} == {q: ["sedzia"] if q == 11 else [] for q in reasons}
    ends = {20: ("rozmowa", None), 21: ("rag", "guard_za_dlugie"), 22: ("rag", "guard_za_dlugie"), 23: ("rag", "guard_za_krotkie"), 24: ("rag", "guard_za_krotkie"), 25: ("rag", "nie_zrozumialem"), 26: ("rag", "mail_doprecyzuj"), 27: ("email", None), 28: ("email", None)}
    assert {q: get(q, "tryb", "powod") for q in ends} == ends and all(r[q].etap is None for q in ends) and r[27].kategoria == "zwrot"
    assert get(30, "text", "changed", "powod") == ("jakieś pytanie o konto k5 s5", True, None)
    assert get(31, "class", "styl", "section", "etap") == ("sterowanie", "rozwin", "sprzedaz", 2)


def test_gates_of_a_search_can_be_off_or_stricter(spark, shop):
    from dataclasses import replace

    r, _ = _search(spark, shop, [11], skip_judge=True)
    assert (r[11].powod, r[11].bramki_pominiete, r[11].cechy.sedzia_ok) == (None, [], None)
    r, _ = _search(spark, replace(shop, idf=None), [1], covered={"pl": 0.9, "en": 0.9})
    assert (r[1].powod, r[1].bramki_pominiete, r[1].cechy.pokrycie) == (None, ["pokrycie"], None)
    r, _ = _search(spark, shop, [1], covered={"pl": 1.1, "en": 1.1})
    assert (r[1].powod, r[1].powod_etap2) == ("pokrycie", "pokrycie")
