import random

import pytest

from qacorpus.llm import token_counts as C
from qacorpus.llm.byte_bpe import ByteBpe
from qacorpus.llm.queries import op2_token_counts, tokenizer_file

FILES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken")
PARTS = ["a", "the", " ", "  ", "\n", "\n\n", "'s", "'", "1", "23", ".", "!?", " the", "é", "\t", "'ll", "x" * 30]


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(*FILES)


def _n(bpe, text):
    return len(bpe.fast.encode_ordinary(text))


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_random_edits(bpe, leaf):
    rnd = random.Random(leaf)
    count = C.Counter(bpe)
    for _ in range(250):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.choice([0, 1, 5, 60])))
        tree = C.TokenTree(text, count, leaf)
        assert tree.total == _n(bpe, text)
        for _ in range(6):
            at, size = rnd.randint(0, len(text)), rnd.choice([0, 0, 1, 2, 10, 100])
            put = "".join(rnd.choice(PARTS) for _ in range(rnd.choice([0, 1, 3])))
            tree.edit(at, size, put)
            text = text[:at] + put + text[at + size :]
            assert tree.text() == text
            assert tree.total == _n(bpe, text), (text, at, size, put)
            assert [p for leaf_ in tree.pieces for p in leaf_] == C._pieces.findall(text)


def test_edits_of_long_texts_touch_little(bpe):
    text = "some words and more. " * 5000
    tree = C.TokenTree(text, C.Counter(bpe))
    tree.edit(50_000, 10, "new words")
    assert tree.counted < 40 and tree.total == _n(bpe, text[:50_000] + "new words" + text[50_010:])


def test_documents(spark, bpe):
    docs = [(1, "one two three"), (2, None), (3, ""), (4, "x " * 5000), (1, "one two three"), (5, "<|endoftext|>")]
    df = spark.createDataFrame([(*d, [], "n") for d in docs], "doc_id long, text string, edits array<int>, n_tokens string")
    edits = spark.createDataFrame([(1, 2, 4, 3, "TWO"), (1, 1, 0, 0, "zero "), (3, 1, 9, 9, "end"), (4, 1, 100, None, None), (4, 2, None, 1, "x"), (9, 1, 0, 0, "gone")], "doc_id long, seq int, at long, size long, put string")
    got = sorted((r.doc_id, r.n_tokens, r.n_tokens_after) for r in C.count_edited(C.with_edits(df, edits), *FILES).collect())
    after = {1: "zeroTWOe two three", 2: "", 3: "end", 4: "x " * 5000, 5: "<|endoftext|>"}
    want = sorted((d, _n(bpe, t or ""), _n(bpe, after[d])) for d, t in docs)
    assert got == want
    assert C.count_edited(C.with_edits(df.filter("false"), edits), *FILES).count() == 0


def test_query_against_brute_force(spark, bpe, tmp_path):
    docs = [(i, t, s, x) for i, (t, s, x) in enumerate([("Some text of thirty and more characters, " * 4, "src1", "en"), (None, None, None), ("", "s", "fr"), ("ab", "s", None)])]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.n_tokens_after) for r in op2_token_counts(spark, str(tmp_path)).collect()}
    for i, t, s, x in docs:
        t = t or ""
        k = len(t) // 3
        assert got[i] == (_n(bpe, t), _n(bpe, f"Source: {s or ''}\n" + t[:k] + "[...]" + t[k + 40 :] + "\n" + (x or "")))


def test_the_tree_grows_with_its_text(bpe):
    """Appends and inserts split leaves: none stays over four times the usual size, and edits stay fast."""
    import time

    count = C.Counter(bpe)
    tree, text = C.TokenTree("", count, 16), ""
    began = time.time()
    for k in range(3000):
        put = f" word{k % 50}, and more\n"
        tree.edit(len(text), 0, put)
        text += put
    assert time.time() - began < 5 and len(tree.pieces) > 100 and max(map(len, tree.pieces)) <= 64
    assert tree.text() == text and tree.total == _n(bpe, text)
    tree.edit(500, 30, "inserted words " * 20_000)
    text = text[:500] + "inserted words " * 20_000 + text[530:]
    assert max(map(len, tree.pieces)) <= 64
    before = tree.counted
    began = time.time()
    rnd = random.Random(3)
    for _ in range(20):
        at = rnd.randrange(len(text))
        tree.edit(at, 3, " xy")
        text = text[:at] + " xy" + text[at + 3 :]
    assert time.time() - began < 1 and tree.counted - before < 20 * 60
    tree.edit(100, len(text) - 200, "")  # almost all leaves become empty
    text = text[:100] + text[-100:]
    assert tree.text() == text and tree.total == _n(bpe, text)
    assert [p for leaf in tree.pieces for p in leaf] == C._pieces.findall(text)
