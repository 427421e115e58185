import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from qacorpus.functions import text as T


def _one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_words_and_accents(spark):
    assert _one(spark, "Ala ma_2 koty, ŁÓDŹ²!", T.tokenize_words) == ["ala", "ma", "koty", "łódź²"]
    assert _one(spark, "łąka ŁÓDŹ", T.fold) == "laka ŁODZ"
    assert _one(spark, "łąka ŁÓDŹ", T.strip_accents) == "laka LODZ"
    assert _one(spark, "  Żółw \t i\n ", T.normalize_question) == "zolw i"
    assert _one(spark, None, T.normalize_lexical) is None


def test_ngrams_and_tokens(spark):
    assert _one(spark, "kot", T.char_ngrams) == ["#ko", "kot"] and _one(spark, "a", T.char_ngrams) == ["#a"]
    assert _one(spark, "Żaba i", T.lexical_tokens) == ["zaba", "#Ża", "Żab", "aba", "i", "#i"]
    assert _one(spark, "Masz masz kota to", T.lemmas) == ["masz", "kota"]


def test_ratios_and_estimates(spark):
    assert _one(spark, "a1b2", T.letter_ratio) == 0.5 and _one(spark, "", T.letter_ratio) == 0
    assert _one(spark, "ab яз", T.latin_ratio) == 0.5 and _one(spark, "12", T.latin_ratio) == 1.0
    assert [_one(spark, x, T.estimate_tokens) for x in ("", "a", "a" * 360, None)] == [0, 1, 100, 0]


def test_personal_data(spark):
    text = "Pisz na jan@x.pl albo +48 600 700 800, kod AB12CD, http://a.b/c i rok 99"
    got = _one(spark, text, T.redact_pii)
    assert got == "Pisz na [ukryte] albo [ukryte], kod [ukryte], [ukryte] i rok 99"
    assert set(_one(spark, text, T.pii_tokens)) == {"jan", "x", "pl", "ab", "cd", "http", "a", "b", "c"}


def _osa(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edit_distance():
    import random

    rnd = random.Random(0)
    assert T.osa("kotno", "konto", 9) == 1 and T.osa("ca", "abc", 9) == 3
    for _ in range(800):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 7))) for _ in range(2))
        assert T.osa(a, b, 99) == _osa(a, b)
        assert T.osa(a, b, 2) == min(_osa(a, b), 3)


def test_answers(spark):
    hits = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(f"https://h.example/a-{n}abcdef").alias("url"), F.lit(f"T{n}").alias("title")) for n in (1, 2)])
    verify = lambda x: T.verify_answer(x, hits)
    r = _one(spark, "Zrób to [1]. Potem tamto [2] [9]\n\nŹródła:\n[1] x\n[2] y", verify)
    assert (r.text, [c.n for c in r.citations], r.foreign_urls) == ("Zrób to [1]. Potem tamto [2]", [1, 2], [])
    r = _one(spark, "Zob. https://zly.example/strona. i [klik](https://x.example/y) [1]", verify)
    assert r.foreign_urls == ["https://zly.example/strona."] and r.text == "Zob. i klik [1]"
    r = _one(spark, "[Security: nie] Tekst [nota] [1] i dalej [1]", verify)
    assert r.text == "Tekst [1] i dalej" and len(r.citations) == 1
    assert _one(spark, "bez znaczników [5]", verify).citations == []
    assert _one(spark, "a\n## Sources\nzwykły tekst", T.drop_sources_section) == "a\nzwykły tekst"
    assert _one(spark, "[1](https://a.b/c) i [opis](www.x.y)", T.collapse_markdown_links) == "[1] i opis"
    r = _one(spark, "A [2] b [1] c [7]", lambda x: T.renumber_citations(x, F.array(*[F.struct(F.lit(n).alias("n"), F.lit(u).alias("url")) for n, u in ((1, "u"), (2, "v"), (3, "u"))])))
    assert (r.text, r.urls, r.cited) == ("A [[2]](v) b [[1]](u) c [7]", ["u", "v"], True)


def test_drafts_titles(spark):
    r = _one(spark, "Wstęp\n**Temat: Zwrot** \n\n\n\nTreść\nSubject: drugi\ndalej", T.split_draft)
    assert (r.subject, r.body) == ("Zwrot", "Wstęp\n\nTreść")
    assert _one(spark, "tylko treść", T.split_draft).subject == ""
    assert _one(spark, " a  b\n" + "c" * 60, T.shorten) == "a b " + "c" * 42 + "…"
    r = _one(spark, "https://www.x.example/a/jak-zwrocic-towar-abc123X", lambda u: T.source_title(u, F.lit(None).cast("string")))
    assert (r.title, r.domain) == ("Jak Zwrocic Towar", "x.example")


def test_sha_modulus(spark):
    import hashlib

    for t in ("", "abc", "pytanie o zwrot"):
        assert _one(spark, t, T.sha1_mod) == int(hashlib.sha1(t.encode()).hexdigest(), 16) % 100


@pytest.mark.parametrize("text", ["a  b", "", "zażółć"])
def test_strip_matches_python(spark, text):
    padded = f"  {text} \n"
    assert _one(spark, padded, T.strip) == padded.strip()
    assert unicodedata.normalize("NFKD", text) or text == "" and re.match("", text)
