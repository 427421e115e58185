"""Token counts that follow edits (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import PATTERN, ByteBpe
from .common import slices, utf8

_pieces = regex.compile(PATTERN)
EDITS = "array<struct<at:bigint,size:bigint,put:string>>"


class Counter:
    """How many ids a pre-token has; pre-tokens that a task has met are kept, up to so many."""

    def __init__(self, bpe: ByteBpe, room: int = 500_000):
        self.bpe, self.room = bpe, room
        self.known: dict[str, int] = {}

    def __call__(self, pieces: list[str]) -> list[int]:
        if len(self.known) > self.room:
            self.known.clear()
        fresh = [p for p in set(pieces) if p not in self.known]
        for p in fresh:
            self.known[p] = len(self.bpe.fast.encode_ordinary(p))
        return list(map(self.known.__getitem__, pieces))


class TokenTree:
    """The pre-tokens of a text in leaves, below a segment tree of the characters and ids in each leaf.

    An edit goes down the tree to the pre-tokens it touches. A match of the pattern looks at most two characters past
    its end, so matching begins again two pre-tokens before the one in front of the edit, and ends at the first old
    boundary behind the edit that is one again: from there on every match is as it was. Only these pre-tokens are
    counted anew and only the sums over their leaves change. A leaf of over four times `leaf` pre-tokens is split, and the
    sums above all leaves are made anew from theirs, so that the tree grows with its text and leaves stay small.
    """

    def __init__(self, text: str, count: Counter, leaf: int = 64):
        self.count = count
        pieces = _pieces.findall(text)
        counts = count(pieces)
        self.leaf = leaf
        self.pieces = [pieces[k : k + leaf] for k in range(0, len(pieces), leaf)] or [[]]
        self.counts = [counts[k : k + leaf] for k in range(0, len(counts), leaf)] or [[]]
        self._sum([sum(map(len, p)) for p in self.pieces], [sum(c) for c in self.counts])
        self.counted = 0

    def _sum(self, chars: list[int], ids: list[int]) -> None:
        """The tree over these sums of the leaves."""
        self.first = 1 << (len(chars) - 1).bit_length()
        none = [0] * (self.first - len(chars))
        self.chars, self.ids = [0] * self.first + chars + none, [0] * self.first + ids + none
        for k in range(self.first - 1, 0, -1):
            self.chars[k], self.ids[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.ids[2 * k] + self.ids[2 * k + 1]

    def _split(self, leaf: int) -> None:
        """Cuts a leaf into leaves of the usual size; leaves that have become empty go."""
        p, c = self.pieces[leaf], self.counts[leaf]
        new = [(p[k : k + self.leaf], c[k : k + self.leaf]) for k in range(0, len(p), self.leaf)]
        kept = [k for k in range(len(self.pieces)) if self.pieces[k] and k != leaf]
        at = sum(k < leaf for k in kept)
        chars, ids = [self.chars[self.first + k] for k in kept], [self.ids[self.first + k] for k in kept]
        pieces, counts = [self.pieces[k] for k in kept], [self.counts[k] for k in kept]
        pieces[at:at], counts[at:at] = [x for x, _ in new], [x for _, x in new]
        chars[at:at], ids[at:at] = [sum(map(len, x)) for x, _ in new], [sum(x) for _, x in new]
        self.pieces, self.counts = pieces, counts
        self._sum(chars, ids)

    @property
    def total(self) -> int:
        return self.ids[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf, place in it and start of the pre-token that holds character `at`."""
        node, start = 1, 0
        while node < self.first:
            node *= 2
            if at - start >= self.chars[node] and at - start >= 0 and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        leaf = node - self.first
        for k, p in enumerate(self.pieces[leaf]):
            if at < start + len(p):
                return leaf, k, start
            start += len(p)
        raise IndexError(at)

    def _back(self, leaf: int, k: int, start: int, steps: int) -> tuple[int, int, int]:
        for _ in range(steps):
            if k == 0:
                before = leaf - 1
                while before >= 0 and not self.pieces[before]:
                    before -= 1
                if before < 0:
                    break
                leaf, k = before, len(self.pieces[before])
            k -= 1
            start -= len(self.pieces[leaf][k])
        return leaf, k, start

    def edit(self, at: int, size: int, put: str) -> None:
        """Replaces `size` characters from `at` on by `put`; what lies outside the text is cut off."""
        at = min(max(at, 0), self.length)
        size = min(max(size, 0), self.length - at)
        if not size and not put:
            return
        leaf, k, start = self._back(*self._find(at - 1), 2) if at else (0, 0, 0)
        end, shift = at + size, len(put) - size
        # old pre-tokens from here on are taken as they are needed
        parts, old, new, told, boundary = [], start, start, [], {}
        text, begin = "", start
        where, place = leaf, k
        added = False
        done = False
        fresh: list[str] = []
        while not done:
            more = []
            while where < len(self.pieces) and (old <= end + 8 or len(more) < 16):
                if place >= len(self.pieces[where]):
                    where, place = where + 1, 0
                    continue
                p = self.pieces[where][place]
                boundary[old] = (where, place)
                more.append(p)
                old += len(p)
                place += 1
                if old > end + 8 and len(more) >= 16:
                    break
            parts.append("".join(more))
            text = "".join(parts)
            edited = text[: at - begin] + put + text[end - begin :] if old >= end else None
            last = where >= len(self.pieces) or all(not x for x in self.pieces[where + 1 :]) and place >= len(self.pieces[where])
            if last:
                boundary[old] = (len(self.pieces), 0)
            if edited is None:
                continue
            fresh, new = [], begin
            for m in _pieces.finditer(edited):
                if m.end() + 2 > len(edited) and not last:
                    break  # the match may look at text that isn't here yet
                fresh.append(m.group())
                new = begin + m.end()
                if new - shift >= end and new - shift in boundary and new >= at + len(put):
                    done = True
                    break
            if last:
                done = True
                if not edited:
                    new = begin
        stop = boundary[new - shift] if new - shift in boundary else (len(self.pieces), 0)
        counts = self.count(fresh)
        self.counted += len(fresh)
        touched = range(leaf, min(stop[0], len(self.pieces) - 1) + 1)
        for x in touched:
            a = k if x == leaf else 0
            b = stop[1] if x == stop[0] else len(self.pieces[x])
            self.pieces[x][a:b] = fresh if x == leaf else []
            self.counts[x][a:b] = counts if x == leaf else []
            node = self.first + x
            self.chars[node], self.ids[node] = sum(map(len, self.pieces[x])), sum(self.counts[x])
        for node in sorted({(self.first + x) // 2 for x in touched}, reverse=True):
            while node:
                self.chars[node], self.ids[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.ids[2 * node] + self.ids[2 * node + 1]
                node //= 2
        if len(self.pieces[leaf]) > 4 * self.leaf:
            self._split(leaf)

    def text(self) -> str:
        return "".join(p for leaf in self.pieces for p in leaf)


def count_edited(docs: DataFrame, vocabulary: bytes, ranks: bytes, edits: str = "edits") -> DataFrame:
    """doc_id, n_tokens before and n_tokens_after the edits of each document, and how many pre-tokens were recounted.

    edits is an array of (at, size, put): characters from `at` on replaced, one edit after the other, each on the text
    that the ones before left. Null edits, and null fields of an edit, do nothing; places outside the text are moved
    to its end. A null text counts as empty. Special strings of the vocabulary are ordinary text. Repeated rows give
    a row each, other columns aren't read. A task holds the tree of one document at a time.
    """

    def of(batches):
        count = Counter(ByteBpe(vocabulary, ranks))
        for batch in slices(batches):
            rows = []
            for text, todo in zip(utf8(batch.column("text")), batch.column("edits").to_pylist()):
                tree = TokenTree(text.decode(), count)
                before = tree.total
                for e in todo or []:
                    if e is not None and e["at"] is not None:
                        tree.edit(e["at"], e["size"] or 0, e["put"] or "")
                rows.append((before, tree.total, tree.counted))
            columns = [pa.array(np.array(x, np.int64)) for x in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names=["doc_id", "n_tokens", "n_tokens_after", "n_recounted"])

    return docs.select("doc_id", "text", F.col(edits).cast(EDITS).alias("edits")).mapInArrow(of, "doc_id long, n_tokens long, n_tokens_after long, n_recounted long")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with an array of the rows (doc_id, seq, at, size, put) that edits has for it, in the order of seq."""
    listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "size", "put"))).alias("edits"))
    kept = F.transform("edits", lambda e: F.struct(e["at"].alias("at"), e["size"].alias("size"), e["put"].alias("put")))
    return docs.drop("edits").join(listed.withColumn("edits", kept), "doc_id", "left")
