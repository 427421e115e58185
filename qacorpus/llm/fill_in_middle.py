"""Fill-in-middle transformation over seekable compressed frames (operator 13)."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, utf8

FRAMES = "doc_id long, n long, tagged boolean, frames array<struct<units:long,chars:long,start:long,joined:boolean,data:binary>>"
MIXED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output array<binary>"
TAGS = (b"<P>", b"<S>", b"<M>")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_FRAME = pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("start", pa.int64()), ("joined", pa.bool_()), ("data", pa.binary())])


def _starts(raw: np.ndarray, joined: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where units and where characters begin in UTF-8 bytes; joined: a letter stands before them."""
    letter = _LETTER[raw]
    first = (raw & 0xC0) != 0x80
    after = np.empty(len(raw), bool)
    after[:1] = joined
    after[1:] = letter[:-1]
    return first & ~(letter & after), first


def frames(docs: DataFrame, size: int = 1 << 16) -> DataFrame:
    """A row per row of docs (doc_id, text): its number of units, whether it holds a tag, and its text as independent
    zstandard frames of at most `size` bytes (never within a character), each with the units, characters and bytes
    before it, and whether it goes on from a letter.

    A unit is a run of letters A-Z and a-z or any other character. A null text is empty and has no frame. Repeated rows
    count each; other columns are left out.
    """

    def of(batches):
        squeeze = zstandard.ZstdCompressor(1).compress
        for batch in slices(batches):
            n, tagged, ends, rows = [], [], [0], []
            for text in utf8(batch.column("text")):
                raw = np.frombuffer(text, np.uint8)
                at = units = chars = 0
                joined = False
                while at < len(raw):
                    to = min(at + size, len(raw))
                    while to < len(raw) and to > at + 1 and raw[to] & 0xC0 == 0x80:
                        to -= 1
                    start, first = _starts(raw[at:to], joined)
                    rows.append((units, chars, at, joined, squeeze(text[at:to])))
                    units, chars, joined, at = units + int(start.sum()), chars + int(first.sum()), bool(_LETTER[raw[to - 1]]), to
                n.append(units)
                tagged.append(any(t in text for t in TAGS))
                ends.append(len(rows))
            columns = [pa.array([r[k] for r in rows], _FRAME.field(k).type) for k in range(5)]
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_FRAME)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(tagged, pa.bool_()), listed], names=["doc_id", "n", "tagged", "frames"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, FRAMES)


def _place(found: list[dict], n: int, total: int, unit: int) -> tuple[int, int]:
    """The byte and the character at which a unit begins; only the frame that holds it is decompressed. For n: the end."""
    if unit == n:
        return total, found[-1]["chars"] + int((np.frombuffer(zstandard.decompress(found[-1]["data"]), np.uint8) & 0xC0 != 0x80).sum()) if found else 0
    frame = found[bisect_right([x["units"] for x in found], unit) - 1]  # the last with so few units before it holds the unit's beginning
    start, first = _starts(np.frombuffer(zstandard.decompress(frame["data"]), np.uint8), frame["joined"])
    at = int(np.flatnonzero(start)[unit - frame["units"]])
    return frame["start"] + at, frame["chars"] + int(first[:at].sum())


def _span(found: list[dict], total: int, begin: int, end: int, squeeze) -> Iterator[bytes]:
    """Frames of the bytes from begin to end: whole frames as they are, the cut ones at both ends compressed anew."""
    for k, frame in enumerate(found):
        low, high = frame["start"], found[k + 1]["start"] if k + 1 < len(found) else total
        if low >= begin and high <= end:
            yield frame["data"]
        elif low < end and high > begin:
            yield squeeze(zstandard.decompress(frame["data"])[max(begin - low, 0) : end - low])


def hashes(doc_id: int | None, seed: str = "1") -> list[int]:
    """The first four groups of 8 digits of the sha256 of the seed, a colon and the id; a null id is an empty text."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]


def fill_in_middle(framed: DataFrame, rate: int = 90, suffix_first: int = 20, seed: str = "1") -> DataFrame:
    """Documents of frames() with their text dealt into prefix, middle and suffix: form, characters of prefix and middle,
    and the output as zstandard frames in order.

    `rate` of a hundred documents are transformed, `suffix_first` of a hundred of these as spm, the others as psm; empty
    texts and those that hold a tag stay plain. Cuts fall between units, at places that the id's hash gives, so equal
    ids (repeated rows) have equal cuts where their texts are as long. A null id is hashed as an empty text.
    """

    def of(batches):
        squeeze = zstandard.ZstdCompressor(1).compress
        p, s, m = (squeeze(t) for t in TAGS)
        for batch in slices(batches, 256, column=None):
            out: list[list] = [[] for _ in range(4)]
            for doc, n, tagged, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "tagged", "frames"))):
                h = hashes(doc, seed)
                if not n or tagged or h[2] % 100 >= rate:
                    row = ("plain", None, None, [x["data"] for x in found])
                else:
                    total = found[-1]["start"] + zstandard.get_frame_parameters(found[-1]["data"]).content_size
                    (a, before), (b, upto) = (_place(found, n, total, cut) for cut in sorted((h[0] % (n + 1), h[1] % (n + 1))))
                    prefix, middle, suffix = (list(_span(found, total, *x, squeeze)) for x in ((0, a), (a, b), (b, total)))
                    if h[3] % 100 < suffix_first:
                        row = ("spm", before, upto - before, [s, *suffix, p, *prefix, m, *middle])
                    else:
                        row = ("psm", before, upto - before, [p, *prefix, s, *suffix, m, *middle])
                for column, value in zip(out, row):
                    column.append(value)
            columns = [pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary())))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return framed.mapInArrow(of, MIXED)


def _parts(output: list[bytes], begin: int, end: int) -> Iterator[bytes]:
    """The bytes from begin to end of an output, a frame at a time; frames outside aren't decompressed."""
    at = 0
    for data in output:
        size = zstandard.get_frame_parameters(data).content_size
        if at < end and at + size > begin:
            yield zstandard.decompress(data)[max(begin - at, 0) : end - at]
        at += size


def restored(form: str, output: list[bytes]) -> Iterator[bytes]:
    """The original text, in parts, from nothing but a form and its output: tags are sought in the stream of frames."""
    end = sum(zstandard.get_frame_parameters(x).content_size for x in output)
    if form == "plain":
        yield from _parts(output, 0, end)
        return
    order = [b"<P>", b"<S>", b"<M>"] if form == "psm" else [b"<S>", b"<P>", b"<M>"]
    places, at, tail = [], 0, b""
    for part in _parts(output, 0, end):
        window, base, look = tail + part, at - len(tail), 0
        while len(places) < 3 and (k := window.find(order[len(places)], look)) >= 0:
            places.append(base + k)
            look = k + 3
        tail, at = window[max(look, len(window) - 2) :], at + len(part)
    first, second, third = places
    head, next_ = (first + 3, second), (second + 3, third)
    for span in (head, (third + 3, end), next_) if form == "psm" else (next_, (third + 3, end), head):
        yield from _parts(output, *span)


def output_texts(mixed: DataFrame) -> DataFrame:
    """doc_id, form and the output of fill_in_middle() as one text."""

    def of(batches):
        for batch in slices(batches, 256, column=None):
            texts = [b"".join(map(zstandard.decompress, x)) for x in batch.column("output").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("form"), pa.array(texts, pa.binary())], names=["doc_id", "form", "output"])

    return mixed.mapInArrow(of, "doc_id long, form string, output binary").withColumn("output", F.col("output").cast("string"))


def digests(mixed: DataFrame) -> DataFrame:
    """fill_in_middle() with the sha256 of each output and of the text restored from it, instead of the output; both
    are fed a frame at a time."""

    def of(batches):
        for batch in slices(batches, 256, column=None):
            made, again = [], []
            for form, output in zip(batch.column("form").to_pylist(), batch.column("output").to_pylist()):
                a, b = hashlib.sha256(), hashlib.sha256()
                for data in output:
                    a.update(zstandard.decompress(data))
                for part in restored(form, output):
                    b.update(part)
                made.append(a.hexdigest())
                again.append(b.hexdigest())
            kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made, pa.string()), pa.array(again, pa.string())], names=[*kept, "output_sha256", "restored_sha256"])

    return mixed.mapInArrow(of, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def transformed(docs: DataFrame) -> DataFrame:
    """digests() of all docs, whose frames are stored first: cuts and digests read them, not the texts."""
    return digests(fill_in_middle(stored(frames(docs), "frames")))
