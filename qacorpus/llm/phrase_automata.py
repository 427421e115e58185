"""Phrase collocations mined with weighted acyclic automata (operator 12)."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pack_all, slices, stored, unpack_all, utf8

#: A word goes on at 0, ends at 1, and at 2 a piece of text ends too.
_KIND = np.zeros(256, np.int8)
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2
LEVELS = 4  # language and up to three words


@dataclass
class Automaton:
    """A count transducer of paths (language, word, word, word) and of all their beginnings: a path's weight is its count.

    symbols: languages and words, each in byte order. labels[k], weights[k]: the arcs that read the k-th symbol, ordered
    by the path; arcs[k][i] to arcs[k][i + 1]: those that follow the i-th arc of the level above. So paths are in
    lexicographic order, and a path's place among them cuts the automaton into prefix ranges. In its stored form, states
    with the same arcs and weights are one (pack()).
    """

    languages: list[bytes]
    words: pa.Array
    labels: list[np.ndarray]
    weights: list[np.ndarray]
    arcs: list[np.ndarray]

    @property
    def size(self) -> int:
        return sum(map(len, self.labels))

    # -- building

    @classmethod
    def of_steps(cls, languages: list[bytes], words: pa.Array, steps: list[np.ndarray], weight: np.ndarray) -> Automaton:
        """From a row per path: its symbols' numbers, -1 after its end, and a count. Counts of equal paths are summed;
        beginnings without a row of their own have weight 0."""
        return cls(languages, words, *_levels(steps, weight))

    @classmethod
    def union(cls, parts: list[Automaton]) -> Automaton:
        """All paths of the parts, with their weights summed; of no parts, none."""
        if not parts:
            none, start = np.zeros(0, np.int64), np.zeros(1, np.int64)
            return cls([], pa.array([], pa.large_binary()), [none.astype(np.int32)] * LEVELS, [none] * LEVELS, [np.zeros(2, np.int64), *[start] * (LEVELS - 1)])
        parts = [p for p in parts if p.size] or parts[:1]
        if len(parts) == 1:
            return parts[0]
        languages = sorted({x for p in parts for x in p.languages})
        coded = pa.chunked_array([p.words for p in parts]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place, at, keys = rank[coded.indices.to_numpy()], 0, {x: k for k, x in enumerate(languages)}
        to = []
        for p in parts:
            to.append(place[at : at + len(p.words)])
            at += len(p.words)
        labels, weights, arcs = [], [], [np.array([0, 0], np.int64)]
        parent = [np.zeros(1, np.int64) for _ in parts]  # where each part's arcs of the level above went
        for level in range(LEVELS):
            codes = []
            for k, p in enumerate(parts):
                above = parent[k] if not level else np.repeat(parent[k], np.diff(p.arcs[level]))
                names = np.array([keys[x] for x in p.languages], np.int64)[p.labels[0]] if not level else to[k][p.labels[level]]
                codes.append((above if level else np.zeros(len(names), np.int64)) << 32 | names)
            every = np.concatenate(codes)
            order = np.argsort(every, kind="stable")
            ordered = every[order]
            fresh = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
            begins = np.flatnonzero(fresh)
            summed = np.add.reduceat(np.concatenate([p.weights[level] for p in parts])[order], begins) if len(begins) else np.zeros(0, np.int64)
            went = np.empty(len(every), np.int64)
            went[order] = np.cumsum(fresh) - 1
            ends = np.cumsum([0, *map(len, codes)])
            parent = [went[a:b] for a, b in zip(ends, ends[1:])]
            distinct = ordered[begins]
            labels.append((distinct & 0xFFFFFFFF).astype(np.int32))
            weights.append(summed)
            if level:
                arcs.append(np.searchsorted(distinct >> 32, np.arange(len(labels[level - 1]) + 1)))
        arcs[0] = np.array([0, len(labels[0])])
        return cls(languages, coded.dictionary.take(pa.array(np.argsort(rank))), labels, weights, arcs)

    # -- places and pieces

    def key(self, level: int, place: int) -> tuple[bytes, ...]:
        """The symbols of a path."""
        found: list[bytes] = []
        for k in range(level, -1, -1):
            label = int(self.labels[k][place])
            found.append(self.words[label].as_py() if k else self.languages[label])
            place = int(np.searchsorted(self.arcs[k], place, side="right")) - 1
        return tuple(found[::-1])

    def before(self, key: tuple[bytes, ...]) -> list[int]:
        """On each level, how many paths come before a key (a beginning comes before what goes on from it)."""
        out, low, high, match = [], 0, len(self.labels[0]), True
        for level in range(LEVELS):
            if not match:
                out.append(int(self.arcs[level][out[-1]]))
                continue
            if level >= len(key):
                out.append(low)
                match = False
                continue
            symbols = self.words if level else self.languages
            s = bisect_left(range(len(symbols)), key[level], key=lambda i: symbols[i].as_py() if level else symbols[i])
            match = s < len(symbols) and (symbols[s].as_py() if level else symbols[s]) == key[level]
            at = low + int(np.searchsorted(self.labels[level][low:high], s))
            match = match and at < high and self.labels[level][at] == s
            out.append(at + (match and level + 1 < len(key)))
            if match and level + 1 < LEVELS:
                low, high = int(self.arcs[level + 1][at]), int(self.arcs[level + 1][at + 1])
        return out

    def piece(self, low: list[int], high: list[int]) -> Automaton:
        """The paths from one place up to another; beginnings of theirs from before are there with weight 0."""
        first = list(low)
        for k in range(LEVELS - 1, 0, -1):
            if first[k] < high[k]:
                first[k - 1] = min(first[k - 1], int(np.searchsorted(self.arcs[k], first[k], side="right")) - 1)
        labels, weights, arcs = [], [], [np.array([0, high[0] - first[0]])]
        for k in range(LEVELS):
            labels.append(self.labels[k][first[k] : high[k]])
            weight = self.weights[k][first[k] : high[k]].copy()
            weight[: low[k] - first[k]] = 0
            weights.append(weight)
            if k:
                arcs.append(np.clip(self.arcs[k][first[k - 1] : high[k - 1] + 1], first[k], high[k]) - first[k])
        return Automaton(self.languages, self.words, labels, weights, arcs).trimmed()

    def trimmed(self) -> Automaton:
        """Without symbols that no arc has."""
        used = np.zeros(len(self.words), bool)
        for x in self.labels[1:]:
            used[x] = True
        number = np.cumsum(used, dtype=np.int32) - 1
        langs = np.unique(self.labels[0])
        labels = [np.searchsorted(langs, self.labels[0]).astype(np.int32), *(number[x] for x in self.labels[1:])]
        return Automaton([self.languages[k] for k in langs], self.words.take(pa.array(np.flatnonzero(used))), labels, self.weights, self.arcs)

    def cut(self, splitters: list[tuple[bytes, ...]]) -> Iterator[tuple[int, Automaton]]:
        """The pieces between splitters in order, with the number of splitters up to each."""
        if not self.size:
            return
        low, at, high = [0] * LEVELS, bisect_right(splitters, self.key(0, 0)), [len(x) for x in self.labels]
        while low != high:
            to = high if at == len(splitters) else self.before(splitters[at])
            if to != low:
                yield at, self.piece(low, to)
            elif at < len(splitters):  # go on to the range of the next path there is
                at = max(at, bisect_right(splitters, min(self.key(k, low[k]) for k in range(LEVELS) if low[k] < high[k])) - 1)
            low, at = to, at + 1

    def blocks(self, most: int) -> Iterator[Automaton]:
        """Pieces of about so many paths."""
        bounds = [self.before(self.key(level, place)) for level, place in self._marks(most)]
        bounds = [[0] * LEVELS, *bounds, [len(x) for x in self.labels]]
        for low, high in zip(bounds, bounds[1:]):
            if low != high:
                yield self.piece(low, high)

    def _marks(self, most: int) -> list[tuple[int, int]]:
        """Paths at every most-th place of all paths in order."""
        # a path's place among all: its own number, those of its beginnings, and the longer paths that come before it
        own = [np.arange(len(x)) for x in self.labels]
        rank = [own[k].astype(np.int64).copy() for k in range(LEVELS)]
        for k in range(LEVELS):
            below = own[k]
            for j in range(k + 1, LEVELS):
                below = self.arcs[j][below]
                rank[k] += below
            above = own[k]
            for j in range(k, 0, -1):
                above = np.searchsorted(self.arcs[j], above, side="right") - 1
                rank[k] += above + 1
        marks = np.arange(most, self.size, most)
        found = []
        for k in range(LEVELS):
            place = np.searchsorted(rank[k], marks)
            hit = (place < len(rank[k])) & (rank[k][np.minimum(place, max(len(rank[k]) - 1, 0))] == marks if len(rank[k]) else False)
            found += [(int(m), k, int(p)) for m, p in zip(marks[hit], place[hit])]
        return [(k, p) for _, k, p in sorted(found)]

    # -- lookups

    def find(self, other: Automaton) -> list[np.ndarray]:
        """The composition with another automaton: for each of its paths the number of the same path here, else -1."""
        known = {x: k for k, x in enumerate(self.languages)}
        langs = np.array([known.get(x, -1) for x in other.languages], np.int64)
        words = pc.index_in(other.words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) if len(other.words) else np.zeros(0, np.int64)
        out: list[np.ndarray] = []
        for k in range(LEVELS):
            symbol = langs[other.labels[0]] if not k else words[other.labels[k]]
            above = np.zeros(len(symbol), np.int64) if not k else np.repeat(out[-1], np.diff(other.arcs[k]))
            out.append(self.step(k, above, symbol))
        return out

    def step(self, level: int, above: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The arcs with these symbols that follow these arcs of the level above; -1 where there is none."""
        own = np.repeat(np.arange(max(len(self.arcs[level]) - 1, 0)), np.diff(self.arcs[level])) << 32 | self.labels[level]
        if not len(own):
            return np.full(len(symbol), -1)
        key = above << 32 | symbol
        at = np.minimum(np.searchsorted(own, key), len(own) - 1)
        return np.where((above >= 0) & (symbol >= 0) & (own[at] == key), at, -1)

    def frequent(self, least: int) -> Automaton:
        """Paths of at least so much weight, and the beginnings of such, these with weight 0 if they have less."""
        keep = [w >= least for w in self.weights]
        for k in range(LEVELS - 1, 0, -1):
            above = np.repeat(np.arange(len(self.labels[k - 1])), np.diff(self.arcs[k]))
            keep[k - 1][above[keep[k]]] = True
        labels = [x[y] for x, y in zip(self.labels, keep)]
        weights = [np.where(w >= least, w, 0)[y] for w, y in zip(self.weights, keep)]
        arcs = [np.array([0, len(labels[0])])]
        for k in range(1, LEVELS):
            upto = np.append(0, np.cumsum(keep[k]))[self.arcs[k]]
            arcs.append(np.append(upto[:-1][keep[k - 1]], upto[-1]))
        return Automaton(self.languages, self.words, labels, weights, arcs).trimmed()

    # -- the stored form

    def pack(self) -> bytes:
        """In few bytes: symbols with the length of what each shares with the one before, and for each level the states
        that differ, from the last symbol backwards, so that paths share all equal ends."""
        arrays: list[np.ndarray] = []
        target = None  # of each arc of the level, the state it leads to
        for k in range(LEVELS - 1, -1, -1):
            columns = [self.labels[k].astype(np.int64), self.weights[k]] + ([] if target is None else [target])
            target, degree, columns = _states(self.arcs[k], columns)
            arrays += [degree, *columns]
        sizes, text = _front(self.words)
        langs = b"".join(self.languages)
        return pack_all(*arrays, target, *sizes, np.frombuffer(text, np.uint8), np.array([len(x) for x in self.languages]), np.frombuffer(langs, np.uint8))

    @classmethod
    def unpack(cls, data: bytes) -> Automaton:
        arrays = unpack_all(data)
        levels, at = [], 0
        for k in range(LEVELS):
            many = 3 if not k else 4
            levels.append(arrays[at : at + many])
            at += many
        state, shared, size, text, lens, langs = arrays[at:]
        labels, weights, arcs = [], [], []
        for degree, *columns in levels[::-1]:  # from the root on, each arc's state is opened
            begin = np.append(0, np.cumsum(degree))
            n = degree[state]
            arcs.append(np.append(0, np.cumsum(n)))
            here = np.repeat(begin[:-1][state] - arcs[-1][:-1], n) + np.arange(arcs[-1][-1])
            labels.append(columns[0][here].astype(np.int32))
            weights.append(columns[1][here])
            state = columns[2][here] if len(columns) == 3 else None
        raw, ends = langs.astype(np.uint8).tobytes(), np.cumsum([0, *lens.tolist()])
        return cls([raw[a:b] for a, b in zip(ends, ends[1:])], _unfront(shared, size, text.astype(np.uint8)), labels, weights, arcs)


def _levels(steps: list[np.ndarray], weight: np.ndarray) -> tuple[list, list, list]:
    """Labels, weights and arcs of rows of symbols; see of_steps()."""
    labels, weights, arcs = [], [], [None]
    at = np.zeros(len(weight), np.int64)
    on = np.arange(len(weight))
    for k, step in enumerate(steps):
        going = step[on] >= 0
        on, at = on[going], at[going]
        key = at << 32 | step[on]
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
        begins = np.flatnonzero(fresh)
        at = np.empty(len(key), np.int64)
        at[order] = np.cumsum(fresh) - 1
        ends = on[order] if k + 1 == len(steps) else np.where(steps[k + 1][on] < 0, on, -1)[order]
        mine = np.where(ends >= 0, weight[ends], 0)
        distinct = ordered[begins]
        labels.append((distinct & 0xFFFFFFFF).astype(np.int32))
        weights.append(np.add.reduceat(mine, begins) if len(begins) else np.zeros(0, np.int64))
        if k:
            arcs.append(np.searchsorted(distinct >> 32, np.arange(len(labels[k - 1]) + 1)))
    arcs[0] = np.array([0, len(labels[0])])
    while len(labels) < LEVELS:
        arcs.append(np.zeros(len(labels[-1]) + 1, np.int64))
        labels.append(np.zeros(0, np.int32))
        weights.append(np.zeros(0, np.int64))
    return labels, weights, arcs


def _states(arcs: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The state of each source of arcs, where equal ones are one, and each state's number of arcs with their columns.

    States of over four arcs, which are rarely equal, aren't compared.
    """
    degree = np.diff(arcs)
    state = np.empty(len(degree), np.int64)
    counts, parts, n = [], [[] for _ in columns], 0
    for d in range(6):
        mine = np.flatnonzero(degree == d if d < 5 else degree > 4)
        if not len(mine):
            continue
        if d == 5:
            state[mine] = n + np.arange(len(mine))
            counts.append(degree[mine])
            here = np.repeat(arcs[mine] - np.append(0, np.cumsum(degree[mine]))[:-1], degree[mine]) + np.arange(int(degree[mine].sum()))
            for part, c in zip(parts, columns):
                part.append(c[here])
            n += len(mine)
            continue
        grid = [c[arcs[mine] + j] for j in range(d) for c in columns]
        order = np.lexsort(grid[::-1]) if grid else np.arange(len(mine))
        fresh = np.zeros(len(mine), bool)
        fresh[:1] = True
        for g in grid:
            fresh[1:] |= g[order][1:] != g[order][:-1]
        state[mine[order]] = n + np.cumsum(fresh) - 1
        chosen = mine[order][fresh]
        counts.append(np.full(len(chosen), d))
        for part, c in zip(parts, columns):
            part.append(c[arcs[chosen][:, None] + np.arange(d)].ravel())
        n += len(chosen)
    none = np.zeros(0, np.int64)
    return state, np.concatenate(counts) if counts else none, [np.concatenate(p) if p else none for p in parts]


def _front(words: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], bytes]:
    """How many bytes (up to 255) each sorted word shares with the one before, its other bytes' number, and these."""
    n = len(words)
    if not n:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64)), b""
    offsets = np.frombuffer(words.buffers()[1], np.int64, n + 1, 8 * words.offset)
    raw = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    shared = np.zeros(n, np.int64)
    going = np.arange(1, n)
    for k in range(255):
        going = going[(size[going] > k) & (size[going - 1] > k)]
        going = going[raw[offsets[going] + k] == raw[offsets[going - 1] + k]]
        if not len(going):
            break
        shared[going] = k + 1
    rest = size - shared
    at = np.repeat(offsets[:-1] + shared - np.append(0, np.cumsum(rest))[:-1], rest) + np.arange(int(rest.sum()))
    return (shared, rest), raw[at].tobytes()


def _unfront(shared: np.ndarray, rest: np.ndarray, raw: np.ndarray) -> pa.Array:
    size = shared + rest
    offsets = np.append(0, np.cumsum(size))
    data = np.zeros(int(offsets[-1]), np.uint8)
    at = np.repeat(offsets[:-1] + shared - np.append(0, np.cumsum(rest))[:-1], rest) + np.arange(int(rest.sum()))
    data[at] = raw
    # byte k of a word that shares over k bytes is that of the last word before it that doesn't
    for k in range(int(shared.max(initial=0))):
        own = np.where(shared <= k, np.arange(len(shared)), 0)
        source = np.maximum.accumulate(own)
        mine = np.flatnonzero(shared > k)
        data[offsets[mine] + k] = data[offsets[source[mine]] + k]
    return pa.Array.from_buffers(pa.large_binary(), len(shared), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


# --- from texts to automata


def _parts(data: bytes, most: int) -> Iterator[tuple[bytes, int]]:
    """A text in parts of about so many bytes, cut where words end, each with the number of words it repeats from the
    one before so that no phrase of three words is lost."""
    if len(data) <= most:
        yield data, 0
        return
    kind = _KIND[np.frombuffer(data, np.uint8)] > 0
    at, head = 0, []
    while at < len(data):
        to = min(at + most, len(data))
        if to < len(data):
            back = kind[at:to][::-1].argmax()
            if kind[to - 1 - back]:
                to -= int(back)
            else:
                ahead = int(kind[to:].argmax())
                to = to + ahead + 1 if kind[to + ahead] else len(data)
        part = b"".join(w + b" " for w in head) + data[at:to]
        yield part, len(head)
        last = part[int(np.append(-1, np.flatnonzero(_KIND[np.frombuffer(part, np.uint8)] == 2))[-1]) + 1 :]
        head, at = last.split()[-2:], to  # white space within a piece is blanks and tabs


def counted(texts: list[bytes], languages: list[bytes], skip: int = 0) -> Automaton:
    """The automaton of all words and phrases of two and three words of lower-cased texts with their languages; phrases
    that end in the first `skip` words are left out."""
    names = sorted(set(languages))
    number = {x: k for k, x in enumerate(names)}
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    kind = _KIND[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = kind == 0
    edges = np.flatnonzero(np.diff(inside))
    begin, end = edges[::2], edges[1::2]
    fresh = np.ones(len(begin), bool)  # begins a piece
    fresh[1:] = np.diff(np.cumsum(kind == 2, dtype=np.int32)[begin]) > 0
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    lang = np.array([number[x] for x in languages], np.int64)[np.searchsorted(starts, begin, side="right") - 1]
    offsets = np.append(0, np.cumsum(end - begin))
    flat = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[kind == 0].tobytes())]).dictionary_encode()
    order = pc.sort_indices(flat.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    word = rank[flat.indices.to_numpy()]
    # one level after the other: the place of a phrase's beginning, then its next word
    labels, weights, arcs = [], [], []
    at, key, ends = np.zeros(len(word), np.int64), lang, np.arange(len(word))
    for k in range(LEVELS):
        by = np.argsort(key, kind="stable") if k == 0 else np.argsort(key)
        ordered = key[by]
        new = np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]
        begins = np.flatnonzero(new)
        weights.append(np.add.reduceat((ends[by] >= skip).astype(np.int64), begins) if len(begins) else np.zeros(0, np.int64))
        distinct = ordered[begins]
        labels.append((distinct & 0xFFFFFFFF).astype(np.int32))
        arcs.append(np.array([0, len(distinct)]) if k == 0 else np.searchsorted(distinct >> 32, np.arange(len(labels[k - 1]) + 1)))
        at = np.empty(len(key), np.int64)
        at[by] = np.cumsum(new) - 1
        if k == 0:
            key = at << 32 | word
        elif k + 1 < LEVELS:
            going = np.flatnonzero(ends + 1 < len(word))
            going = going[~fresh[ends[going] + 1]]
            ends = ends[going] + 1
            key = at[going] << 32 | word[ends]
    return Automaton(names, flat.dictionary.take(pa.array(order)), labels, weights, arcs)


KEY = "k0 binary, k1 binary, k2 binary, k3 binary"


def shards(docs: DataFrame, volume: int = 2 << 20, together: int = 3, block: int = 25_000) -> DataFrame:
    """Automata of phrases over docs (doc_id, text, lang) in blocks of about `block` paths: the first path's symbols, the
    number of paths, and the automaton.

    A task counts texts of `volume` bytes at a time, unites as many automata as `together` says, and cuts the union.
    """

    def rows(parts: list[Automaton]):
        made = list(Automaton.union(parts).blocks(block)) if parts else []
        for at in range(0, len(made), 16):
            some = made[at : at + 16]
            keys = [min(a.key(k, _own(a, k)) for k in range(LEVELS) if _own(a, k) is not None) for a in some]
            columns = [pa.array([key[k] if k < len(key) else None for key in keys], pa.binary()) for k in range(LEVELS)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([a.size for a in some], pa.int64()), pa.array([a.pack() for a in some], pa.binary())], names=["k0", "k1", "k2", "k3", "n", "data"])

    def of(batches):
        done: list[Automaton] = []
        texts: list[bytes] = []
        langs: list[bytes] = []
        size = 0
        for batch in slices(batches, volume=volume):
            for text, lang in zip(utf8(batch.column("text")), batch.column("lang").cast(pa.binary()).to_pylist()):
                lang = b"und" if lang is None else lang
                if len(text) > volume:
                    for part, skip in _parts(text.lower(), volume):
                        done.append(counted([part], [lang], skip))
                        if len(done) >= together:
                            yield from rows(done)
                            done = []
                    continue
                texts.append(text.lower())
                langs.append(lang)
                size += len(text)
                if size >= volume:
                    done.append(counted(texts, langs))
                    texts, langs, size = [], [], 0
                    if len(done) >= together:
                        yield from rows(done)
                        done = []
        if texts:
            done.append(counted(texts, langs))
        yield from rows(done)

    return docs.select("text", "lang").mapInArrow(of, f"{KEY}, n long, data binary")


def _own(a: Automaton, level: int) -> int | None:
    """The first path of a level with weight, which no mere beginning has."""
    found = np.flatnonzero(a.weights[level])
    return int(found[0]) if len(found) else None


def _splitters(blocks: DataFrame, paths: int) -> list[tuple[bytes, ...]]:
    """Keys that cut all paths into ranges of about so many, by the first keys of all blocks, which Spark sorts."""
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // paths))
    keys = ["k0", "k1", "k2", "k3"]
    first = blocks.select(*keys).repartitionByRange(ranges, *keys).groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*keys)).alias("k"))
    found = sorted({tuple(bytes(x) for x in r.k if x is not None) for r in first.collect()})  # one key per range
    return found[1:]


def ranges(docs: DataFrame, least: int = 10, paths: int = 1_200_000) -> tuple[DataFrame, list[tuple[bytes, ...]]]:
    """(range, data): for each range of prefixes the automaton of all paths that occur at least `least` times in docs,
    stored; and the keys between ranges. A range has about `paths` paths of shards, however often one prefix occurs, for
    ranges are cut at any path, not only between first words."""
    blocks = stored(shards(docs), "shards")
    splitters = _splitters(blocks, paths)

    def split(batches):
        for batch in batches:
            for data in batch.column("data").to_pylist():
                pieces = list(Automaton.unpack(data).cut(splitters))
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in pieces], pa.int32()), pa.array([a.pack() for _, a in pieces], pa.binary())], names=["range", "data"])

    def sum_up(table: pa.Table) -> pa.Table:
        parts = [Automaton.unpack(x) for x in table.column("data").to_pylist()]
        return pa.table({"range": table.column("range").slice(0, 1), "data": pa.array([Automaton.union(parts).frequent(least).pack()], pa.binary())})

    cut = blocks.select("data").mapInArrow(split, "range int, data binary")
    return stored(cut.groupBy("range").applyInArrow(sum_up, "range int, data binary"), "ranges"), splitters


def _requests(a: Automaton) -> Automaton:
    """The parts of all phrases of two and three words: paths of one and two words. The weight of one of two words is
    the count of the most frequent phrase of three words here that it begins or ends."""
    lang1 = np.repeat(a.labels[0], np.diff(a.arcs[1])).astype(np.int64)
    above2 = np.repeat(np.arange(len(a.labels[1])), np.diff(a.arcs[2]))
    above3 = np.repeat(np.arange(len(a.labels[2])), np.diff(a.arcs[3]))
    two, three = np.flatnonzero(a.weights[2]), np.flatnonzero(a.weights[3])
    w1, w2 = a.labels[1].astype(np.int64)[above2], a.labels[2].astype(np.int64)
    lang2 = lang1[above2]
    x, y, z, lang3, count = w1[above3][three], w2[above3][three], a.labels[3].astype(np.int64)[three], lang2[above3][three], a.weights[3][three]
    none = lambda v: np.full(len(v), -1)
    lang = np.concatenate([lang2[two], lang2[two], lang3, lang3, lang3, lang3])
    first = np.concatenate([w1[two], w2[two], x, z, x, y])
    second = np.concatenate([none(two), none(two), none(x), none(z), y, z])
    weight = np.concatenate([np.zeros(2 * len(two) + 2 * len(x), np.int64), count, count])
    order = np.lexsort((-weight, second, first, lang))
    key = np.stack([lang[order], first[order], second[order]])
    fresh = np.append(True, (key[:, 1:] != key[:, :-1]).any(0))[: key.shape[1]]  # the first of equal ones has the most
    rows = order[fresh]
    return Automaton.of_steps(a.languages, a.words, [lang[rows], first[rows], second[rows]], weight[rows]).trimmed()


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, paths: int = 1_200_000) -> DataFrame:
    """Each language's first `top` phrases of two or three words by score: lang, rank (from 1), phrase, a, l, r, n, score.

    A-Z are lower-cased; texts are split at `.,;:!?` and line ends into pieces, these at blanks and tabs into words. A
    phrase occurs `a` >= `least` times within pieces, overlaps included; its score is floor(1000000 a a / (l r)) at the
    cut with the lowest score, the first of equal ones, where l and r are the counts of both parts. A phrase that stands
    in a longer one with `least` occurrences and `share` percent of its own is left out. n: all words of the language.
    Ties go by a, then by the phrase's bytes. Null texts are empty, a null lang is `und`, repeated rows count each, other
    columns don't matter, and no rows give none. Bytes that are no UTF-8 count as they are. Numbers are exact at any size.

    Three exchanges follow the sum over shards, all of packed automata: parts of phrases are asked of the ranges that hold
    them, each part once by each range, answers come back, and the phrases of each range are scored.
    """
    held, splitters = ranges(docs, least, paths)

    def ask(batches):
        for batch in batches:
            for r, data in zip(batch.column("range").to_pylist(), batch.column("data").to_pylist()):
                pieces = list(_requests(Automaton.unpack(data)).cut(splitters))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pieces], pa.int32()), pa.array([r] * len(pieces), pa.int32()), pa.array([a.pack() for _, a in pieces], pa.binary())], names=["range", "source", "data"])

    def answer(own: pa.Table, asked: pa.Table) -> pa.Table:
        to, data = [], []
        if own.num_rows:
            mine = Automaton.unpack(own.column("data")[0].as_py())
            longest = np.zeros(len(mine.labels[2]), np.int64)
            for source, packed in zip(asked.column("source").to_pylist(), asked.column("data").to_pylist()):
                parts = Automaton.unpack(packed)
                found = mine.find(parts)
                hit = found[2] >= 0
                np.maximum.at(longest, found[2][hit], parts.weights[2][hit])
                parts.weights = [np.where(f >= 0, w[f], 0) if len(w) else np.zeros(len(f), np.int64) for f, w in zip(found, mine.weights)]
                to.append(source)
                data.append(parts.pack())
            to.append(own.column("range")[0].as_py())
            data.append(b"")
            return pa.table({"range": pa.array(to, pa.int32()), "data": pa.array(data, pa.binary()), "longest": pa.array([None] * (len(to) - 1) + [pack_all(longest)], pa.binary())})
        return pa.table({"range": pa.array([], pa.int32()), "data": pa.array([], pa.binary()), "longest": pa.array([], pa.binary())})

    def score(own: pa.Table, said: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows:
            mine = Automaton.unpack(own.column("data")[0].as_py())
            answers = Automaton.union([Automaton.unpack(x) for x in said.column("data").to_pylist() if x])
            (longest,) = unpack_all(next(x for x in said.column("longest").to_pylist() if x is not None))
            out = _scored(mine, answers, longest, share, top)
        kinds = (pa.binary(), pa.binary(), *[pa.int64()] * 5)
        return pa.table({name: pa.array([r[k] for r in out], kind) for k, (name, kind) in enumerate(zip(("lang", "phrase", "a", "l", "r", "n", "score"), kinds))})

    requests = held.mapInArrow(ask, "range int, source int, data binary")
    answers = held.groupBy("range").cogroup(requests.groupBy("range")).applyInArrow(answer, "range int, data binary, longest binary")
    scored = held.groupBy("range").cogroup(answers.groupBy("range")).applyInArrow(score, "lang binary, phrase binary, a long, l long, r long, n long, score long")
    rows = scored.withColumns({"lang": F.col("lang").cast("string"), "phrase": F.col("phrase").cast("string")})
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _scored(mine: Automaton, answers: Automaton, longest: np.ndarray, share: int, top: int) -> list[tuple]:
    """Each language's first phrases of a range: (lang, phrase, a, l, r, n, score)."""
    if not answers.size:
        return []
    known = {x: k for k, x in enumerate(answers.languages)}
    langs = np.array([known.get(x, -1) for x in mine.languages], np.int64)
    words = pc.index_in(mine.words, value_set=answers.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) if len(mine.words) else np.zeros(0, np.int64)
    above1 = np.repeat(mine.labels[0], np.diff(mine.arcs[1]))
    above2 = np.repeat(np.arange(len(mine.labels[1])), np.diff(mine.arcs[2]))
    above3 = np.repeat(np.arange(len(mine.labels[2])), np.diff(mine.arcs[3]))
    n_of = lambda lang: answers.weights[0][answers.step(0, np.zeros(len(lang), np.int64), lang)]
    big = lambda x: x.astype(object)  # whole numbers without a limit

    def one(lang, x):
        return answers.weights[1][answers.step(1, answers.step(0, np.zeros(len(lang), np.int64), lang), x)]

    def two(lang, x, y):
        return answers.weights[2][answers.step(2, answers.step(1, answers.step(0, np.zeros(len(lang), np.int64), lang), x), y)]

    found = []
    rows = np.flatnonzero((mine.weights[2] > 0) & (big(100 * longest.astype(np.int64)) < share * big(mine.weights[2])) if len(longest) else np.zeros(0, bool))
    if len(rows):
        a, x, y = mine.weights[2][rows], mine.labels[1][above2][rows], mine.labels[2][rows]
        own = above1[above2][rows]
        l, r = one(langs[own], words[x]), one(langs[own], words[y])
        found.append((own, np.stack([x, y], 1), a, l, r, n_of(langs[own]), 1_000_000 * big(a) * big(a) // (big(l) * big(r))))
    rows = np.flatnonzero(mine.weights[3])
    if len(rows):
        a, up = mine.weights[3][rows], above3[rows]
        x, y, z = mine.labels[1][above2][up], mine.labels[2][up], mine.labels[3][rows]
        own = above1[above2][up]
        lang = langs[own]
        l1, r1, l2, r2 = one(lang, words[x]), two(lang, words[y], words[z]), two(lang, words[x], words[y]), one(lang, words[z])
        s1, s2 = (1_000_000 * big(a) * big(a) // (big(p) * big(q)) for p, q in ((l1, r1), (l2, r2)))
        later = s2 < s1
        found.append((own, np.stack([x, y, z], 1), a, np.where(later, l2, l1), np.where(later, r2, r1), n_of(lang), np.where(later, s2, s1)))
    texts = mine.words.to_pylist()
    best = []
    for k, name in enumerate(mine.languages):
        mine_rows = ((-int(s), -int(c), b" ".join(texts[i] for i in p), int(left), int(right), int(n)) for own, p, a, l, r, m, score in found for p, c, left, right, n, s in zip(p[own == k].tolist(), a[own == k], l[own == k], r[own == k], m[own == k], score[own == k]))
        best += [(name, p, -c, left, right, n, -s) for s, c, p, left, right, n in heapq.nsmallest(top, mine_rows)]
    return best


#: What collocations() gives for the documents table, for DuckDB.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
one AS (SELECT lang, x AS p, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM split) GROUP BY 1, 2),
two AS (SELECT lang, x, y, count(*) AS f FROM (SELECT lang, unnest(w[:-2]) AS x, unnest(w[2:]) AS y FROM split WHERE len(w) >= 2) GROUP BY 1, 2, 3),
three AS (SELECT lang, x, y, z, count(*) AS f FROM (SELECT lang, unnest(w[:-3]) AS x, unnest(w[2:-2]) AS y, unnest(w[3:]) AS z FROM split WHERE len(w) >= 3) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10),
total AS (SELECT lang, sum(f)::HUGEINT AS n FROM one GROUP BY 1),
longer AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY 1, 2, 3),
cuts AS (
  SELECT t.lang, t.x || ' ' || t.y AS phrase, 1 AS k, t.f AS a, l.f AS l, r.f AS r FROM two t JOIN one l ON l.lang = t.lang AND l.p = t.x JOIN one r ON r.lang = t.lang AND r.p = t.y
    LEFT JOIN longer g ON g.lang = t.lang AND g.x = t.x AND g.y = t.y WHERE t.f >= 10 AND coalesce(100 * g.f, 0) < 50 * t.f
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, 1, t.f, l.f, r.f FROM three t JOIN one l ON l.lang = t.lang AND l.p = t.x JOIN two r ON r.lang = t.lang AND r.x = t.y AND r.y = t.z
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, 2, t.f, l.f, r.f FROM three t JOIN two l ON l.lang = t.lang AND l.x = t.x AND l.y = t.y JOIN one r ON r.lang = t.lang AND r.p = t.z
), scored AS (
  SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY 1000000::HUGEINT * a * a // (l::HUGEINT * r), k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score
FROM scored JOIN total USING (lang) QUALIFY rank <= 2000
"""
