"""Token ids of whole texts from a public vocabulary file, by the ``tokenizers`` library.

The byte-level pre-tokenizer always starts a new token at a single space between two characters that
are not white space, so a text may be cut there: such units are encoded by the library, many new ones as one
text whose ids are parted by the bytes they stand for, and looked up from then on. The table of units only saves time. It has two generations: a unit that is looked up in the older
one moves to the younger, which becomes the older when it is full. So units that come again stay, others
go, and neither the number of units nor a worker's memory grows with the text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np

from cartwright.llm.common import worker_tables

SAFE = re.compile(r"(?<=\S) (?=\S)")
#: One class of characters, so that the search goes from one white space to the next.
DOUBLE_SPACE = re.compile(r"\s\s")
#: Units of a generation.
UNITS = 600_000
LONG_UNIT = 48
#: Bytes of UTF-8 that are encoded at a time.
BATCH_BYTES = 1 << 20
PIECE_CHARS = 1 << 18
#: Units that are encoded as one text.
TOGETHER = 2_000


def safe_pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[tuple[bool, str]]:
    """``text`` cut at safe spaces about every ``limit`` characters, as (follows a space, piece).

    The space itself is left out; where no safe space follows, the rest is one piece.
    """
    at, spaced = 0, False
    while len(text) - at > limit and (cut := SAFE.search(text, at + limit)):
        yield spaced, text[at : cut.start()]
        at, spaced = cut.end(), True
    yield spaced, text[at:] if at else text


def _units(piece: str) -> list[str]:
    """``piece`` cut at its safe spaces; where white space is single and inside, every space is one."""
    irregular = piece[:1].isspace() or piece[-1:].isspace() or DOUBLE_SPACE.search(piece)
    return SAFE.split(piece) if irregular else piece.split(" ")


class UnitEncoder:
    """Values of units: ``values`` of ids and the ends of units in them. Keys are units without their space."""

    def __init__(self, path: str, values: Callable):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        if made["normalizer"] or (made["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        self.values = values
        #: Bytes of UTF-8 that an id stands for: a character of a byte-level token is a byte.
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.bytes[i] = len(token.content.encode())
        #: Younger and older units, with a space before them or at the start of a text.
        self.units: dict[str, list[dict]] = {" ": [{}, {}], "": [{}, {}]}

    def _learn(self, prefix: str, units: set[str]) -> list[str]:
        """Brings units to the younger generation; returns long ones, which are to be dropped after use."""
        young, old = self.units[prefix]
        held = units & old.keys()
        young.update({u: old[u] for u in held})
        new = list(units - held)
        if prefix:
            for at in range(0, len(new), TOGETHER):
                young.update(self._together(new[at : at + TOGETHER]))
        else:
            young.update(zip(new, self._apart(new), strict=True))
        return [u for u in new if len(u) > LONG_UNIT]

    def _apart(self, units: list[str]) -> list:
        encoded = self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        return [self.values(np.array(e.ids, "<u4"), [len(e.ids)])[0] for e in encoded]

    def _together(self, units: list[str]) -> Iterator[tuple[str, object]]:
        """Units behind a space with their values, from one text; those that no safe space would part, apart."""
        odd = [u for u in units if not u or u[-1].isspace() or u[0].isspace()]
        if odd:
            yield from zip(odd, self._apart([" " + u for u in odd]), strict=True)
            units = list(set(units).difference(odd))
        if not units:
            return
        text = " " + " ".join(units)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        sizes = map(len, units if text.isascii() else map(str.encode, units))
        ends = np.cumsum(np.fromiter(sizes, np.int64, len(units)) + 1)
        stops = np.cumsum(self.bytes[ids])
        at = np.searchsorted(stops, ends) + 1
        if stops[-1] == ends[-1] and (stops[at - 1] == ends).all():
            yield from zip(units, self.values(ids, at), strict=True)
        else:
            yield from zip(units, self._apart([" " + u for u in units]), strict=True)

    def batch(self, pieces: list[tuple[bool, str]]) -> Iterator[list]:
        """The values of each piece's units."""
        spaced, first = self.units[" "][0], self.units[""][0]
        found, firsts, missing = [], set(), set()
        for is_spaced, piece in pieces:
            units = _units(piece)
            head = None if is_spaced else units.pop(0)
            if head is not None and head not in first:
                firsts.add(head)
            values = list(map(spaced.get, units))
            unknown = [(i, units[i]) for i, v in enumerate(values) if v is None] if None in values else ()
            missing.update(u for _, u in unknown)
            found.append((head, values, unknown))
        long_first, long_spaced = self._learn("", firsts), self._learn(" ", missing)
        for head, values, unknown in found:
            for i, unit in unknown:
                values[i] = spaced[unit]
            yield values if head is None else [first[head], *values]
        for young, long in ((first, long_first), (spaced, long_spaced)):
            for u in long:
                del young[u]
        for prefix, (young, _) in self.units.items():
            if len(young) >= UNITS:
                self.units[prefix] = [{}, young]

    def texts(self, texts: Iterator[str | None]) -> Iterator[list]:
        """For each text its pieces' value lists, encoded in batches of about a megabyte."""
        waiting: list[tuple[bool, str]] = []
        counts: list[int] = []
        size = 0
        done: list[list] = []

        def flush():
            done.extend(self.batch(waiting))
            waiting.clear()

        for text in texts:
            pieces = 0
            for piece in safe_pieces(text or ""):
                waiting.append(piece)
                size += len(piece[1]) if piece[1].isascii() else len(piece[1].encode("utf-8", "surrogatepass"))
                pieces += 1
                if size >= BATCH_BYTES:
                    flush()
                    size = 0
            counts.append(pieces)
            if not waiting:
                yield from _regrouped(done, counts)
        flush()
        yield from _regrouped(done, counts)


def _regrouped(done: list[list], counts: list[int]) -> Iterator[list]:
    at = 0
    for n in counts:
        yield done[at : at + n]
        at += n
    done.clear()
    counts.clear()


def _blobs(ids: np.ndarray, ends) -> list[bytes]:
    whole, ends = ids.tobytes(), [4 * int(e) for e in ends]
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _lengths(ids: np.ndarray, ends) -> list[int]:
    return np.diff(ends, prepend=0).tolist()


def encoder(path: str, what: str) -> UnitEncoder:
    """The worker's encoder; ``what`` is ``lengths`` or ``ids`` (little-endian unsigned 32 bits)."""
    encoders = worker_tables("tokens")
    if (path, what) not in encoders:
        encoders[path, what] = UnitEncoder(path, {"lengths": _lengths, "ids": _blobs}[what])
    return encoders[path, what]
