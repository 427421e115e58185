"""SentencePiece encoding and decoding by vectorised merge rounds (operator 1)."""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, utf8
from .merge_rounds import MergeTable

SPACE = "▁"
_words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Codec:
    """A BPE model with byte fallback, read from the bytes of its file.

    Such a model leaves text as it is (identity normalisation), writes spaces as U+2581 and puts one in front. If no
    piece goes on after a space that follows another character, text falls apart into words there, and equal words get
    equal ids.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        if sp.normalize("a  Åﬁ ") != f"{SPACE}a{SPACE}{SPACE}Åﬁ{SPACE}":
            raise ValueError("the model must leave text as it is and put a space in front")
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        ids = {p: i for i, p in enumerate(names) if plain[i]}
        self.cuts = not any(SPACE in p[1:] and p.strip(SPACE) for p in ids)
        for c in sorted({c for p in ids for c in p} - ids.keys()):  # characters that occur in pieces only
            ids[c] = n + len(ids.keys() - set(names))
        self.n, symbols = n, max([n - 1, *ids.values()]) + 1
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        score = {i: sp.get_score(i) for p, i in ids.items() if i < n}
        place = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        rows = [(ids[p[:k]], ids[p[k:]], place[score[i]], i) for p, i in ids.items() if i < n for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        self.merges = MergeTable(symbols, *np.array(rows, np.int64).T)
        self.char = np.arange(0x110000, dtype=np.int32) + symbols
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.real = np.zeros(symbols, bool)
        self.real[[i for i in ids.values() if i < n]] = True
        self.name = dict((i, p) for p, i in ids.items())
        surface = [p.replace(SPACE, " ").encode() if plain[i] else bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else b"" for i, p in enumerate(names)]
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.spaced = np.array([plain[i] and p.startswith(SPACE) for i, p in enumerate(names)])
        self.control = np.array([sp.is_control(i) for i in range(n)])
        self.size = np.array([len(x) for x in surface], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)

    def words(self, text: str) -> list[str]:
        """The words of a text, each with the spaces before it; none for an empty text."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return _words.findall(marked) if self.cuts else [marked]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word."""
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        sym, word = self.merges.merge(self.char[flat], word)
        odd = np.flatnonzero((sym >= len(self.real)) | ~self.real[np.minimum(sym, len(self.real) - 1)])
        if len(odd):  # characters that aren't pieces: their bytes
            parts = [self.byte[np.frombuffer((self.name.get(s) or chr(s - len(self.real))).encode(), np.uint8)] for s in sym[odd].tolist()]
            size = np.ones(len(sym), np.int64)
            size[odd] = [len(p) for p in parts]
            ids = np.repeat(sym, size)
            first = (np.cumsum(size) - size)[odd]
            where = np.repeat(first, size[odd]) + np.concatenate([np.arange(len(p)) for p in parts])
            ids[where] = np.concatenate(parts)
            sym, word = ids, np.repeat(word, size)
        ends = np.searchsorted(word, np.arange(len(words) + 1))
        return [sym[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        seen = {w: k for k, w in enumerate(dict.fromkeys(words))}
        parts = self.encode_words(list(seen)) if words else []
        return [i for w in words for i in parts[seen[w]].tolist()]

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of id sequences that lie one behind another. ends: where each ends."""
        size = self.size[ids]
        to = np.append(0, np.cumsum(size))
        flat = self.bytes[np.arange(to[-1]) + np.repeat(self.start[ids] - to[:-1], size)].tobytes()
        out, begin = [], 0
        for end in ends.tolist():
            text = flat[to[begin] : to[end]]
            lead = begin
            while lead < end and self.control[ids[lead]]:
                lead += 1
            if lead < end and self.spaced[ids[lead]]:
                text = text[1:]
            try:
                text.decode()
                parted = self.control[ids[begin:end]].any()  # which ends a run of byte pieces
            except UnicodeDecodeError:
                parted = True
            if parted:
                text = self._mended(ids[begin:end])
            out.append(text)
            begin = end
        return out

    def _mended(self, ids: np.ndarray) -> bytes:
        """Byte pieces that make no character become U+FFFD, one for each byte."""
        out, run, fresh = [], b"", True
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.bytes[self.start[i] : self.start[i] + 1].tobytes()
                fresh = False
                continue
            while run:
                for k in (4, 3, 2, 1):
                    try:
                        char = run[:k].decode()
                    except UnicodeDecodeError:
                        continue
                    if len(char) == 1:
                        out.append(run[:k])
                        run = run[k:]
                        break
                else:
                    out.append(b"\xef\xbf\xbd")
                    run = run[1:]
            if i >= 0:
                piece = self.bytes[self.start[i] : self.start[i] + self.size[i]].tobytes()
                out.append(piece[1:] if fresh and self.spaced[i] else piece)
                fresh = fresh and bool(self.control[i])
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        array = np.asarray(ids, np.int64)
        return self.decode_many(array, np.array([len(array)]))[0].decode()


class _Encoder:
    """Keeps the ids of words that a task has met, up to so many."""

    def __init__(self, codec: Codec, room: int = 300_000):
        self.codec, self.room = codec, room
        self.decimal = [str(i) for i in range(codec.n)]
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.texts: list[str] = []  # the ids of each word as decimals
        self.ids = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The ids of each text as decimals joined by commas, all ids one behind another, and how many each text has."""
        if len(self.place) > self.room:
            self._clear()
        split = [self.codec.words(t) for t in texts]
        fresh = list(set().union(*split).difference(self.place))
        parts = [self.ids]
        for k in range(0, len(fresh), 100_000):
            parts += self.codec.encode_words(fresh[k : k + 100_000])
        self.place.update(zip(fresh, range(len(self.size), len(self.size) + len(fresh))))
        self.size = np.concatenate([self.size, np.fromiter(map(len, parts[1:]), np.int64, len(fresh))])
        self.ids = np.concatenate(parts)
        name, flat = self.decimal, self.ids[len(parts[0]) :].tolist()
        at = 0
        for n in self.size[len(self.size) - len(fresh) :].tolist():
            self.texts.append(",".join([name[i] for i in flat[at : at + n]]))
            at += n
        find, said = self.place.__getitem__, self.texts
        places = [list(map(find, words)) for words in split]
        word = np.fromiter((k for p in places for k in p), np.int64)
        counts = np.append(0, np.cumsum(self.size[word]))
        start = np.cumsum(self.size) - self.size
        ids = self.ids[np.arange(counts[-1]) + np.repeat(start[word] - counts[:-1], self.size[word])]
        ends = counts[np.cumsum([len(p) for p in places])]
        return [",".join([said[k] for k in p]) for p in places], ids, np.diff(np.append(0, ends))


def encode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of its text column; null and empty text get no ids. Replaces a column of that name."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _Encoder(Codec(model))
        for s in batches:
            _, flat, n = encoder.encode(["" if t is None else t for t in s])
            yield pd.Series(np.split(flat, np.cumsum(n)[:-1]) if len(n) else [], dtype=object)

    return df.withColumn(ids, of(F.col(text)))


def decode(df: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of an id column; null counts as no ids. Replaces a column of that name."""

    @F.pandas_udf(T.StringType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(model)
        for s in batches:
            parts = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in s]
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pd.Series([t.decode() for t in codec.decode_many(flat, np.cumsum([len(p) for p in parts], dtype=np.int64))], dtype=object)

    return df.withColumn(text, of(F.col(ids)))


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: encoded, then decoded from the ids.

    A null text counts as empty; repeated ids and texts give a row each; other columns of docs aren't read. Words that
    a task has met stay in a table of bounded size, so a task needs memory for it and one batch of texts.
    """

    def of(batches):
        codec = Codec(model)
        encoder = _Encoder(codec)
        for batch in slices(batches):
            decimals, ids, n = encoder.encode([t.decode() for t in utf8(batch.column("text"))])
            decoded = codec.decode_many(ids, np.cumsum(n))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(n),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decimals]),
                    pa.array([hashlib.sha256(t).hexdigest() for t in decoded]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
