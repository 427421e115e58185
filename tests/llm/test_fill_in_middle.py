"""Fill-in-middle transformation against the rule written plainly, with frames of a few bytes."""

import hashlib
import re

import pytest

from qacorpus.llm import fill_in_middle as M

TEXTS = [
    None, "", "a", "abc", "Hello, world! 123", "zażółć gęślą\njaźń", "x" * 500, "<P> in a text", "a<S", "b<", "<M>", "P>S>M> <P", "äöü" * 50, "one two  three\n\n" * 30, "\x00\t<\t>", "日本語 text 😀 end",
]


def plainly(doc, text):
    """(n, form, prefix_chars, middle_chars, output) by the contract's words."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def rows():
    return [(None if k == 5 else k, TEXTS[k % len(TEXTS)]) for k in range(160)] + [(7, "Hello, world! 123")] * 3


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 16])
def test_rule(spark, rows, size):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, n string, frames int")
    mixed = M.fill_in_middle(M.frames(docs, size))
    want = sorted((plainly(d, t) + (d,) for d, t in rows), key=repr)
    texts = sorted(((r.doc_id, r.form, r.output) for r in M.output_texts(mixed).collect()), key=repr)
    assert texts == sorted(((d, form, out) for _, form, _, _, out, d in want), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    found = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in M.digests(mixed).collect()), key=repr)
    assert found == sorted(((d, *plainly(d, t)[:4], sha(plainly(d, t)[4]), sha(t)) for d, t in rows), key=repr)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_only_cut_frames_are_opened(monkeypatch):
    text = ("word, " * 4000).encode()
    seen = []
    real = M.zstandard.decompress
    monkeypatch.setattr(M.zstandard, "decompress", lambda x: seen.append(1) or real(x))
    squeeze = M.zstandard.ZstdCompressor(1).compress
    found, units = [], 0
    for at in range(0, len(text), 600):
        found.append({"units": units, "chars": at, "start": at, "joined": False, "data": squeeze(text[at : at + 600])})
        units += 300
    at, chars = M._place(found, units, len(text), 5001)
    assert (at, chars) == (10002, 10002) and len(seen) == 1
    list(M._span(found, len(text), 10002, len(text), squeeze))
    assert len(seen) == 2


def test_restored_from_output_alone():
    squeeze = M.zstandard.ZstdCompressor(1).compress
    for form, output in (("psm", "<P>a<<S>S><<M>M>b<"), ("spm", "<S>S><<P>a<<M>M>b<")):
        for size in (1, 2, 5, 99):
            parts = [squeeze(output[k : k + size].encode()) for k in range(0, len(output), size)]
            assert b"".join(M.restored(form, parts)) == b"a<M>b<S><"


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, form string")
    assert M.transformed(docs).collect() == []
    docs = spark.createDataFrame([(3, "abc def", 1, 2)], "doc_id int, text string, output int, n int")
    assert M.transformed(docs).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert M.transformed(docs).count() == 1


def test_query_over_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    from qacorpus.llm.queries import op13_fill_in_middle

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = sorted((d, *plainly(d, t)[:4], sha(plainly(d, t)[4]), sha(t)) for d, t in docs)
    found = sorted(tuple(r) for r in op13_fill_in_middle(spark, sf_dir).collect())
    assert [r[:3] + r[5:] for r in found] == [r[:3] + r[5:] for r in want] and [r[3:5] for r in found] == [r[3:5] for r in want]
