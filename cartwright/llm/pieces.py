"""SentencePiece encoding with seeded merge dropout, and decoding.

A text is cut where no merge can reach across (before a run of spaces, around line ends, between
characters that no piece holds next to each other); each part is merged by an agenda of candidate merges,
best score first. A candidate that comes up is skipped if its hash, keyed by the seed, the row's id and the
place in the text, falls below the dropout rate. The merges that a part goes through without dropout are
looked up. Where none of them is dropped at a place, they hold there; only elsewhere the agenda is gone
through again, for many parts side by side. Parts that come again stay in the tables, others go, so a
worker's memory doesn't grow with the texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from cartwright.llm.common import row_key, worker_tables
from cartwright.llm.hashing import mix

SPACE = "▁"
PART = re.compile(r"\n| *[^ \n]+| +")
PART_END = re.compile(r"(?<=[^ \n])[ \n]")
#: Parts of a generation that are looked up, and cut parts.
PARTS, CUTS = 200_000, 50_000
#: Characters of a part that is looked up, and merged side by side with others (at most 64); characters at once.
SHORT_PART, SIDE_BY_SIDE = 48, 400_000
#: No symbol; no candidate.
NONE, NEVER = -(1 << 30), np.iinfo(np.int32).max
CHUNK_CHARS = 1 << 18


def _keyed(key: int | np.ndarray, place: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """53-bit hash of a candidate merge: the key, where its left symbol starts, the piece it would make."""
    number = (place.astype(np.uint64) << np.uint64(32)) + piece.astype(np.uint64)
    return mix(number + np.asarray(key, np.uint64)) >> np.uint64(11)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs of ``sizes`` from ``starts``, one run after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _blobs(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    whole, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(sizes)).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Numbers:
    """From 64-bit keys to numbers, in a hash table that is probed for many keys at once; ``missing`` for others."""

    EMPTY = np.iinfo(np.int64).min

    def __init__(self, keys: np.ndarray, numbers: np.ndarray, missing: int):
        bits = max(4, (8 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, self.EMPTY)
        self.numbers = np.full(1 << bits, missing, np.int32)
        at, left = self._first(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == self.EMPTY]
            self.keys[at[free]] = keys[free]
            placed = self.keys[at[left]] == keys[left]
            self.numbers[at[left[placed]]] = numbers[left[placed]]
            left = left[~placed]
            at[left] = (at[left] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._first(keys)
        held = self.keys[at]
        others = np.flatnonzero((held != keys) & (held != self.EMPTY))
        while len(others):
            at[others] = (at[others] + 1) & self.mask
            held = self.keys[at[others]]
            others = others[(held != keys[others]) & (held != self.EMPTY)]
        return self.numbers[at]


class Runs:
    """Parts by number, with the merges that each goes through without dropout and the ids it then has."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.parts: list[str] = []
        self.merges, self.ids = np.zeros(1 << 10, np.uint64), np.zeros(1 << 10, np.int32)
        self.merge_ends, self.id_ends = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)

    def add(self, parts: list[str], merges: np.ndarray, sizes: np.ndarray, ids: np.ndarray, id_sizes: np.ndarray) -> None:
        n = len(self.parts)
        for values, ends, more, own in (("merges", "merge_ends", merges, sizes), ("ids", "id_ends", ids, id_sizes)):
            used = int(getattr(self, ends)[n])
            for name, at, new in ((values, used, more), (ends, n + 1, used + np.cumsum(own))):
                held = getattr(self, name)
                if at + len(new) > len(held):
                    grown = np.empty(at + at // 4 + 2 * len(new), held.dtype)  # what is not written takes no memory
                    grown[:at], held = held[:at], grown
                    setattr(self, name, held)
                held[at : at + len(new)] = new
        self.number.update(zip(parts, range(n, n + len(parts)), strict=True))
        self.parts += parts

    def merges_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.merge_ends[rows + 1] - self.merge_ends[rows]
        return self.merges[_ragged(self.merge_ends[rows], sizes)], sizes

    def ids_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.id_ends[rows + 1] - self.id_ends[rows]
        return self.ids[_ragged(self.id_ends[rows], sizes)], sizes


def piece_bytes(model) -> list[bytes]:
    """The bytes that each id of a sentencepiece model stands for; none for control and unknown ones."""
    out = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            out.append(b"")
        else:
            out.append(piece.replace(SPACE, " ").encode())
    return out


class Vocabulary:
    """Pieces of a byte-fallback merge model at ``path``, read by the sentencepiece library.

    The normaliser has to be the identity with a space put in front, as the file's own decoding
    shows; no piece may hold a line end, or a space after another character.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        self.size = len(ids)
        self.byte = [0] * 256
        self.bytes = piece_bytes(model)
        self.score = np.full(len(ids), np.inf)
        listed: dict[str, int] = {}
        for i in ids:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[self.bytes[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                listed[piece], self.score[i] = i, -model.get_score(i)
                if "\n" in piece or SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"{path} merges across spaces or lines")
        probe = " ﬁ  x "
        if model.decode(model.encode(probe)) != probe:
            raise ValueError(f"{path} changes texts")
        self.neighbours = {a + b for piece in listed for a, b in zip(piece, piece[1:], strict=False)}
        # A character is the id of its piece; one that only longer pieces hold gets a number beyond them,
        # any other the negative of its code point.
        self.symbol = -np.arange(0x110000, dtype=np.int32)
        self.symbol[0] = -(1 << 29)
        self.unlisted: dict[int, int] = {-(1 << 29): 0}
        inner = {c for piece in listed for c in piece}
        for c in sorted(inner):
            if c not in listed:
                self.unlisted[self.size + len(self.unlisted)] = ord(c)
                self.symbol[ord(c)] = self.size + len(self.unlisted) - 1
            else:
                self.symbol[ord(c)] = listed[c]
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]
        self.symbol[ord(SPACE)] = -ord(SPACE)
        known = listed | {chr(c): n for n, c in self.unlisted.items() if n >= 0}
        self.joined = {
            (known[piece[:i]], known[piece[i:]]): n
            for piece, n in listed.items() for i in range(1, len(piece))
            if piece[:i] in known and piece[i:] in known
        }
        keys = np.array([(a << 32) + b for a, b in self.joined], np.int64)
        self.pair = Numbers(keys, np.array(list(self.joined.values()), np.int64), -1)
        #: A piece's place in the order of scores; the last one, for -1, stands for no piece.
        self.rank = np.append(np.unique(self.score, return_inverse=True)[1], NEVER >> 6).astype(np.int32)
        near = np.array([(ord(a) << 32) + ord(b) for a, b in self.neighbours], np.int64)
        self.near = Numbers(near, np.ones(len(near), np.int64), 0)
        #: Parts looked up: those that came lately, and those before them.
        self.young, self.old = Runs(), Runs()
        #: Parts that are cut, as their pieces with line ends between (no such part holds one).
        self.cut: dict[str, str] = {}
        self.spelled: dict[int, np.ndarray] = {}

    def split(self, part: str) -> list[str]:
        """``part`` cut between characters that no piece holds next to each other."""
        if SPACE in part:
            return [part]
        text = part.replace(" ", SPACE)
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.neighbours]
        return [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True)]

    def _parted(self, parts: list[str]) -> dict[str, str]:
        """Those of ``parts`` that are cut, with their pieces, line ends between."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        signs = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(parts)), sizes)
        codes = np.where(signs == ord(" "), ord(SPACE), signs).astype(np.int64)
        apart = (self.near((codes[:-1] << 32) + codes[1:]) == 0) & (owner[:-1] == owner[1:])
        cuttable = np.ones(len(parts), bool)
        cuttable[owner[signs == ord(SPACE)]] = False
        cuts = np.flatnonzero(apart & cuttable[owner[1:]]) + 1
        if not len(cuts):
            return {}
        owners = np.unique(owner[cuts])
        chosen = np.zeros(len(parts), bool)
        chosen[owners] = True
        # A line end before each piece but a part's first, two before each part but the first.
        ends = np.zeros(len(signs), np.int64)
        ends[cuts], ends[_starts(sizes)[owners[1:]]] = 1, 2
        own = chosen[owner]
        text = np.full(int(own.sum() + ends.sum()), ord("\n"), "<u4")
        text[np.cumsum(ends[own] + 1) - 1] = signs[own]
        texts = text.tobytes().decode("utf-32-le").split("\n\n")
        return dict(zip([parts[i] for i in owners.tolist()], texts, strict=True))

    def merge(self, parts: list[str], dropout: float, key: int | np.ndarray) -> list[bytes]:
        """Little-endian 32-bit ids of each part after its agenda is through; see ``_merge``."""
        return _blobs(*self._merge(parts, dropout, key)[:2])

    def _merge(
        self, parts: list[str], dropout: float, key: int | np.ndarray, traced: bool = False
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the parts and their number by part; then, if ``traced``, the merges of short parts (place
        and piece, as ``_keyed`` puts them) and their number by part.

        ``key`` is one for all parts or one for each. A literal space mark is no symbol of the model and
        is kept as its bytes, like any unknown character. Short parts go through their agendas side by
        side, a merge of each at a time.
        """
        keys = np.broadcast_to(np.asarray(key, np.uint64), len(parts))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(-lengths, kind="stable")
        at = int((lengths > SHORT_PART).sum())
        done = [np.frombuffer(self._merge_long(parts[i], dropout, int(keys[i])), "<i4") for i in order[:at].tolist()]
        sizes = np.zeros(len(parts), np.int64)
        sizes[order[:at]] = [len(ids) for ids in done]
        taken: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        while at < len(parts):
            some = order[at : at + SIDE_BY_SIDE // (int(lengths[order[at]]) + 1)]
            own: list[tuple] | None = [] if traced else None
            ids, sizes[some] = self._side_by_side([parts[i] for i in some.tolist()], dropout, keys[some], own)
            done.append(ids)
            taken += [(some[row], number) for row, number in own or ()]
            at += len(some)
        ids = np.concatenate(done) if done else np.zeros(0, np.int32)
        ids = ids[_ragged(_starts(sizes[order])[np.argsort(order)], sizes)]
        row, number = (np.concatenate(x) for x in zip(*taken, strict=True))
        return ids, sizes, number[np.argsort(row, kind="stable")], np.bincount(row, minlength=len(parts))

    def _spelled(self, symbol: int) -> np.ndarray:
        """Ids of the bytes of a character without a piece."""
        if symbol not in self.spelled:
            code = self.unlisted.get(symbol, -symbol)
            self.spelled[symbol] = np.array([self.byte[b] for b in chr(code).encode()], np.int32)
        return self.spelled[symbol]

    def _written(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of parts of ``sizes`` as ids; characters without a piece as their bytes' ids."""
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.size))
        if not len(odd):
            return symbols, sizes
        spelled = [self._spelled(symbol) for symbol in symbols[odd].tolist()]
        lengths = np.ones(len(symbols), np.int64)
        lengths[odd] = [len(ids) for ids in spelled]
        ids = np.repeat(symbols, lengths)
        ids[_ragged(_starts(lengths)[odd], lengths[odd])] = np.concatenate(spelled)
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(sizes)))]
        return ids, np.diff(ends)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of neighbouring symbols; the last rank and -1 where they are no piece."""
        piece = self.pair((left.astype(np.int64) << 32) + right)
        return self.rank[piece], piece

    def _merge_short(self, parts: list[str], dropout: float, key: int | np.ndarray) -> list[bytes]:
        return _blobs(*self._side_by_side(parts, dropout, np.broadcast_to(np.asarray(key, np.uint64), len(parts))))

    def _side_by_side(
        self, parts: list[str], dropout: float, key: np.ndarray, taken: list[tuple] | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number by part. A column for each part, a line for each place in it.

        A merge stays at the place of its left symbol and frees that of its right one; a candidate is at
        the place of its left symbol, as its rank and, in the last six bits, its place.
        """
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        width, count = int(sizes.max(initial=1)), len(parts)
        place = np.arange(width, dtype=np.int32)[:, None]
        symbols = np.full((width, count), NONE, np.int32)
        symbols.T[place.T < sizes[:, None]] = self.symbol[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
        pieces, agenda = np.full((2, width, count), NEVER, np.int32)
        rank, pieces[:-1] = (x.reshape(width - 1, count) for x in self._pairs(symbols[:-1].ravel(), symbols[1:].ravel()))
        agenda[:-1] = np.where(rank < NEVER >> 6, rank << 6 | place[:-1], NEVER)
        after, before = np.empty((2, width, count), np.int8)
        after[:], before[:] = place + 1, place - 1
        row, limit, done = np.arange(count), np.uint64(dropout * 2**53), symbols
        while True:
            best = agenda.min(0)
            c = np.flatnonzero(best != NEVER)
            if len(c) < 0.75 * len(row):
                if done is not symbols:
                    done[:, row] = symbols
                symbols, pieces, agenda, after, before, row, best = (
                    np.ascontiguousarray(x[..., c]) for x in (symbols, pieces, agenda, after, before, row, best)
                )
                c = np.arange(len(row))
            if not len(c):
                break
            n = len(row)
            k = (best[c] & 63).astype(np.int64)
            flat = k * n + c
            made = pieces.ravel()[flat]
            skipped = _keyed(key[row[c]], k, made) < limit
            if skipped.any():
                agenda.ravel()[flat[skipped]] = NEVER
                c, k, flat, made = (x[~skipped] for x in (c, k, flat, made))
            if taken is not None:
                taken.append((row[c], (k.astype(np.uint64) << np.uint64(32)) + made.astype(np.uint64)))
            right = after.ravel()[flat].astype(np.int64) * n + c
            following, previous = after.ravel()[right].astype(np.int64), before.ravel()[flat].astype(np.int64)
            symbols.ravel()[flat], symbols.ravel()[right] = made, NONE
            agenda.ravel()[right] = agenda.ravel()[flat] = NEVER
            after.ravel()[flat] = following
            more, own = np.flatnonzero(following < width), np.flatnonzero(previous >= 0)
            behind = following[more] * n + c[more]
            before.ravel()[behind] = k[more]
            at = np.concatenate((flat[more], previous[own] * n + c[own]))
            rank, piece = self._pairs(
                symbols.ravel()[at], symbols.ravel()[np.concatenate((behind, flat[own]))]
            )
            pieces.ravel()[at] = piece
            agenda.ravel()[at] = np.where(rank < NEVER >> 6, rank << 6 | (at // n).astype(np.int32), NEVER)
        valid = done.T != NONE
        return self._written(done.T[valid], valid.sum(1))

    def _merge_long(self, part: str, dropout: float, key: int) -> bytes:
        """The agenda of one part of any length, as a heap."""
        symbols = self.symbol[np.frombuffer(part.encode("utf-32-le"), np.uint32)].tolist()
        n, limit = len(symbols), int(dropout * 2**53)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []

        def consider(i: int, j: int) -> None:
            piece = self.joined.get((symbols[i], symbols[j]))
            if piece is not None:
                heappush(agenda, (self.score[piece], i, j, symbols[i], symbols[j], piece))

        for i in range(n - 1):
            consider(i, i + 1)
        while agenda:
            _, i, j, a, b, piece = heappop(agenda)
            if after[i] != j or symbols[i] != a or symbols[j] != b:
                continue
            if limit and int(_keyed(key, np.array([i]), np.array([piece]))[0]) < limit:
                continue
            symbols[i], symbols[j] = piece, NONE
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                consider(i, after[i])
            if before[i] >= 0:
                consider(before[i], i)
        left = np.array([x for x in symbols if x != NONE], np.int32)
        return self._written(left, np.array([len(left)]))[0].astype("<i4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """Brings ``new`` parts to the young ones, from the old ones or by their agendas."""
        held = [part for part in new if part in self.old.number]
        if held:
            rows = np.fromiter(map(self.old.number.get, held), np.int64, len(held))
            self.young.add(held, *self.old.merges_of(rows), *self.old.ids_of(rows))
            new = [part for part in new if part not in self.old.number]
        ids, sizes, merges, merge_sizes = self._merge(new, 0.0, 0, traced=True)
        self.young.add(new, merges, merge_sizes, ids, sizes)

    def encode(
        self, texts: Iterable[str], offsets: Iterable[int], dropout: float, seed: int, kept: int = PARTS
    ) -> list[bytes]:
        """Little-endian 32-bit ids. A part is merged under a key of the seed, its text's offset and its
        number in the text; twice about ``kept`` parts are looked up later, at most. Long texts are gone
        through in slices that end where a part does."""
        return list(chain.from_iterable(self.chunks(texts, offsets, dropout, seed, kept)))

    def chunks(
        self, texts: Iterable[str], offsets: Iterable[int], dropout: float, seed: int, kept: int = PARTS
    ) -> Iterator[list[bytes]]:
        """As ``encode``, the ids of some texts after others: of one long text, or of texts of ``CHUNK_CHARS`` together."""
        waiting: list[tuple[str, int]] = []
        size = 0
        for text, offset in zip(texts, offsets, strict=True):
            size += len(text)
            if size > CHUNK_CHARS:
                if waiting:
                    yield self._encode(waiting, 0, dropout, seed, kept)[0]
                waiting, size = [], len(text)
            if len(text) <= CHUNK_CHARS:
                waiting.append((" " + text if text else "", offset))
                continue
            at = number = size = 0
            slices = []
            while at < len(text):
                cut = PART_END.search(text, at + CHUNK_CHARS)
                end = cut.start() if cut else len(text)
                blobs, parts = self._encode([(text[at:end] if at else " " + text[:end], offset)], number, dropout, seed, kept)
                slices += blobs
                at, number = end, number + parts
            yield [b"".join(slices)]
        if waiting:
            yield self._encode(waiting, 0, dropout, seed, kept)[0]

    def _encode(
        self, texts: list[tuple[str, int]], first: int, dropout: float, seed: int, kept: int
    ) -> tuple[list[bytes], int]:
        """Ids of texts (with their offsets) whose parts are numbered from ``first``; then the number of parts."""
        parts = [PART.findall(text) for text, _ in texts]
        if len(self.young.parts) > kept:
            self.young, self.old = Runs(), self.young
        if "\n" not in self.young.number:  # so that parts not found hold no line end
            self._learn(["\n"])
        words, find = list(chain.from_iterable(parts)), self.young.number.get
        rows = np.fromiter(map(find, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(rows < 0)
        others = [words[i] for i in unknown.tolist()]
        self.cut.update(self._parted(list(set(others).difference(self.cut))))
        others = list(map(self.cut.get, others, others))
        lengths = np.ones(len(words), np.int64)
        lengths[unknown] += np.fromiter(map(str.count, others, repeat("\n")), np.int64, len(others))
        others = "\n".join(others).split("\n") if others else []
        new = set(others).difference(self.young.number)
        self._learn([part for part in new if len(part) <= SHORT_PART])
        names, long = self.young.parts, [part for part in new if len(part) > SHORT_PART]
        beyond = {part: len(names) + i for i, part in enumerate(long)}
        rows = np.repeat(rows, lengths)
        rows[_ragged(_starts(lengths)[unknown], lengths[unknown])] = [*map(find, others, map(beyond.get, others))]
        sizes = np.array(list(map(len, parts)), np.int64)
        sizes = np.diff(np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(sizes)))])
        bases = np.array([xxh64_intdigest(f"{seed} {offset}") for _, offset in texts], np.uint64)
        keys = mix(np.repeat(bases, sizes) + _ragged(np.full(len(sizes), first), sizes).astype(np.uint64))

        known = np.flatnonzero(rows < len(names))
        number, merges = self.young.merges_of(rows[known])
        hits = mix(number + np.repeat(keys[known], merges)) >> np.uint64(11) < np.uint64(dropout * 2**53)
        hits = np.concatenate(([0], np.cumsum(hits)))
        ends = np.cumsum(merges)
        again = np.ones(len(rows), bool)
        again[known] = hits[ends] > hits[ends - merges]
        found, lengths = np.flatnonzero(~again), np.zeros(len(rows), np.int64)
        again = np.flatnonzero(again)
        some = [names[r] if r < len(names) else long[r - len(names)] for r in rows[again].tolist()]
        own, lengths[again], *_ = self._merge(some, dropout, keys[again])
        held, lengths[found] = self.young.ids_of(rows[found])
        ids, starts = np.zeros(int(lengths.sum()), np.int32), _starts(lengths)
        ids[_ragged(starts[found], lengths[found])] = held
        ids[_ragged(starts[again], lengths[again])] = own
        if len(self.cut) > CUTS or max(map(len, others), default=0) > CHUNK_CHARS:
            self.cut = {}
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(sizes)))]
        return _blobs(ids, np.diff(ends)), len(rows)


def vocabulary(path: str, *setting) -> Vocabulary:
    """The worker's vocabulary; parts are looked up per ``setting``."""
    key, vocabularies = f"{path} {setting}", worker_tables("pieces")
    if key not in vocabularies:
        vocabularies[key] = Vocabulary(path)
    return vocabularies[key]


def encoded(path: str, dropout: float = 0.1, seed: int = 20, kept: int = PARTS):
    """A column function of (text, id): the text's ids as array<int>; null and empty give no ids.

    The key of a part follows from the seed, the row's id and the part's place, so a word is cut anew
    wherever it stands, and alike in every run. Dropout 0 gives the library's own segmentation.
    """

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        pieces = vocabulary(path)
        for texts, ids in batches:
            for blobs in pieces.chunks(
                (text.as_py() or "" for text in texts), (xxh3_64_intdigest(str(doc.as_py()), seed) for doc in ids),
                dropout, seed, kept,
            ):
                ends = np.concatenate(([0], np.cumsum([len(b) // 4 for b in blobs])))
                yield pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(blobs), "<i4"), pa.int32())
                )
            del texts, ids
            pa.default_memory_pool().release_unused()

    return encode


@cache
def _piece_hex(path: str) -> str:
    """The bytes that each id stands for, as hexadecimal digits, commas between."""
    from sentencepiece import SentencePieceProcessor

    return ",".join(b.hex() for b in piece_bytes(SentencePieceProcessor(model_file=path)))


def decoded(path: str) -> Callable[[Column], Column]:
    """A column function: the text of an array of ids; no ids give an empty text, null gives null.

    Expressions only, so that no Python worker but the encoding ones holds tables. Bytes that are no
    UTF-8 are replaced; an id that the model doesn't have is an error.
    """
    table = F.split(F.lit(_piece_hex(path)), ",")

    def decode(ids: Column) -> Column:
        digits = F.transform(ids, lambda i: F.coalesce(F.get(table, i), F.raise_error(F.lit("an id that is no piece"))))
        return F.make_valid_utf8(F.substring(F.unhex(F.array_join(digits, "")), 2, NEVER).cast("string"))

    return decode


def encode(
    docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 20, kept: int = PARTS
) -> DataFrame:
    """``docs`` with ids (array<int>) of every whole text; see ``encoded``. A column named ids is
    replaced. Rows with the same doc_id and text are cut alike; a null doc_id counts as a hash of
    the text. An empty table gives an empty one. There is no shuffle."""
    return docs.withColumn("ids", encoded(path, dropout, seed, kept)(F.col("text"), row_key()))


def decode(encodings: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    return encodings.withColumn(into, decoded(path)(F.col(ids)))


def lossless(text: str = "text", decoded_text: str = "decoded") -> Column:
    return F.coalesce(F.col(text), F.lit("")) == F.col(decoded_text)
