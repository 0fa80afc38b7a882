"""Subword ids of whole texts with the ``tokenizers`` library, through an exact table of pieces.

A byte-level BPE splits a text by a pattern before merging, and no token crosses the place between
a character that is no white space and a white space after it, nor between a letter and a mark after
it. Texts are therefore cut there, each distinct piece is encoded once, and a text's ids are the pieces' ids joined: what encoding the whole
text at once gives. All pieces of a block of texts are cut, looked up and joined together by array
operations on their UTF-8 bytes.

The table holds pieces of up to 15 bytes under a key of two 64-bit numbers that consists of the bytes
and the length themselves, so that no two pieces share one. Longer pieces have a dictionary, the very
long ones are encoded each time. Both start anew when they are full, so that memory is bounded.
A text that holds the string of an added token, such as ``<|endoftext|>``, is encoded in one call.

Edge cases: a null or empty text has no ids; a text without white space is one piece, however long;
texts of any length are taken in blocks of about ``BLOCK_BYTES`` bytes.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

TOKENIZER = "byte_bpe_50k.json"
#: Slots of the table as a power of two, 20 bytes each, and the pieces that it holds at most.
SLOT_BITS = 21
CACHE_PIECES = 1_200_000
#: Pieces of over 15 bytes that are kept at most, and their longest.
LONG_PIECES = 50_000
LONG_BYTES = 64
#: Pieces encoded as one text, and such texts in one call.
JOINED = 64
RUNS = 64
#: Bytes of text cut into pieces at once.
BLOCK_BYTES = 1 << 18

_KEY_BYTES = 15
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_LOW = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(_KEY_BYTES + 1)], np.uint64)
_HIGH = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(_KEY_BYTES + 1)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes after which no cut is made besides these: separators, which some patterns take as white space.
_UNCUT = _SPACE.copy()
_UNCUT[0x1C:0x20] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[_SPACE] = 32
#: 1: ASCII letters, 2: ASCII marks.
_KIND = np.array([1 if chr(c).isalpha() else 2 if 32 < c < 127 and not chr(c).isalnum() else 0 for c in range(128)] + [0] * 128, np.uint8)
#: First bytes of white space outside ASCII in UTF-8, and the characters.
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE_SPACES = np.array(sorted(int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, nulls as empty ones, and where each begins (and the last ends)."""
    if column.null_count:
        column = column.fill_null("")
    plain = column.cast(pa.large_string())
    _, places, data = plain.buffers()
    if not len(plain):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(places, np.int64)[plain.offset : plain.offset + len(plain) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def _parted(data: np.ndarray) -> np.ndarray:
    """Whether a mark follows a letter, at each byte but the first."""
    kind = _KIND[data]
    return (kind[:-1] == 1) & (kind[1:] == 2)


def _wide_space_ends(data: np.ndarray) -> np.ndarray:
    """Places of the last bytes of white space characters outside ASCII."""
    lead = np.flatnonzero(_LEADS[data])
    two = data[lead] == 0xC2
    lead = lead[lead + np.where(two, 1, 2) < len(data)]
    two = data[lead] == 0xC2
    value = (data[lead].astype(np.int64) << 8) | data[lead + 1]
    value = np.where(two, value, (value << 8) | data[np.minimum(lead + 2, len(data) - 1)])
    found = np.isin(value, _WIDE_SPACES)
    return (lead + np.where(two, 1, 2))[found]


class SubwordEncoder:
    """Encodes texts to ids through the table of pieces."""

    def __init__(self, path: str | None = None, limit: int = CACHE_PIECES, slot_bits: int = SLOT_BITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path or tokenizer_path())
        self.added = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        size = self.model.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.vocabulary = size
        # Ids whose token begins with a blank: where a piece begins, if it begins with a blank.
        self.blank_first = np.zeros(size, bool)
        self.blank_first[[i for t, i in self.model.get_vocab().items() if t.startswith("Ġ")]] = True
        self.bits, self.limit = slot_bits, min(limit, (1 << slot_bits) * 5 // 8)
        self.low = np.zeros(1 << slot_bits, np.uint64)
        self.high = np.zeros(1 << slot_bits, np.uint64)
        self.span = np.zeros(1 << slot_bits, np.uint32)
        self.flat = np.zeros(1 << 16, self.dtype)
        self._clear()

    def _clear(self) -> None:
        self.high[:] = 0  # 0 is no key: the length is in its top byte
        self.held = self.used = 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def raw(self, text: str) -> np.ndarray:
        return np.asarray(self.model.encode(text, add_special_tokens=False).ids, self.dtype)

    def _store(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), self.dtype)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and how many each has."""
        ids, counts = [], np.zeros(len(pieces), np.int64)
        blank = [p[0] == 32 and len(p) > 1 and p[1] > 32 for p in pieces]
        for a in range(0, len(pieces), JOINED * RUNS):
            runs = [range(b, min(b + JOINED, len(pieces))) for b in range(a, min(a + JOINED * RUNS, len(pieces)), JOINED)]
            found = self.model.encode_batch_fast([b"".join(pieces[r.start : r.stop]).decode() for r in runs], add_special_tokens=False)
            for r, e in zip(runs, found):
                own = np.asarray(e.ids, self.dtype)
                starts = np.flatnonzero(self.blank_first[own])
                if len(starts) == len(r) and all(blank[r.start : r.stop]):
                    counts[r.start : r.stop] = np.diff(starts, append=len(own))
                    ids.append(own)
                else:  # pieces that begin with other white space or none, or a token inside one that begins with a blank
                    for i, e in zip(r, self.model.encode_batch_fast([p.decode() for p in pieces[r.start : r.stop]], add_special_tokens=False)):
                        ids.append(np.asarray(e.ids, self.dtype))
                        counts[i] = len(ids[-1])
        return (np.concatenate(ids) if ids else np.empty(0, self.dtype)), counts

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low * _C1) ^ (high * _C2)
        h ^= h >> np.uint64(29)
        h *= _C3
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it isn't in the table."""
        slot = self._slot(low, high)
        found = self.high[slot]
        hit = (found == high) & (self.low[slot] == low)
        if hit.all():
            return slot
        out = np.where(hit, slot, -1)
        rows = np.flatnonzero(~hit & (found != 0))
        at = slot[rows]
        while len(rows):
            at = (at + 1) & ((1 << self.bits) - 1)
            found = self.high[at]
            hit = (found == high[rows]) & (self.low[at] == low[rows])
            out[rows[hit]] = at[hit]
            on = ~hit & (found != 0)
            rows, at = rows[on], at[on]
        return out

    def _add(self, low: np.ndarray, high: np.ndarray, span: np.ndarray) -> None:
        """Puts distinct new keys in."""
        at, rows = self._slot(low, high), np.arange(len(low))
        while len(rows):
            free = self.high[at] == 0
            _, one = np.unique(at, return_index=True)
            first = np.zeros(len(at), bool)
            first[one] = True
            put = free & first
            self.low[at[put]], self.high[at[put]], self.span[at[put]] = low[rows[put]], high[rows[put]], span[rows[put]]
            rows, at = rows[~put], (at[~put] + ~free[~put]) & ((1 << self.bits) - 1)
        self.held += len(low)

    def _look_up(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``flat`` and number of the ids of each piece."""
        if self.held > self.limit or len(self.long) > LONG_PIECES or self.used > 16 * self.limit:
            self._clear()
        padded = np.concatenate([data, np.zeros(24, np.uint8)])
        pairs = padded[:-1].astype(np.uint16) | (padded[1:].astype(np.uint16) << np.uint16(8))
        fours = pairs[:-2].astype(np.uint32) | (pairs[2:].astype(np.uint32) << np.uint32(16))
        eights = fours[:-4].astype(np.uint64) | (fours[4:].astype(np.uint64) << np.uint64(32))
        short = sizes <= _KEY_BYTES
        every = bool(short.all())
        s, n = (starts, sizes) if every else (starts[short], sizes[short])
        low = eights[s] & _LOW[n]
        high = (eights[s + 8] & _HIGH[n]) | (n.astype(np.uint64) << np.uint64(56))
        slot = self._find(low, high)
        new = np.flatnonzero(slot < 0)
        text = None
        if len(new):
            order = new[np.lexsort((low[new], high[new], (low[new] & np.uint64(0xFF)) != 32))]  # those that begin with a blank first
            own = np.concatenate([[True], (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])])
            one = order[own]
            text = data.tobytes()
            ids, counts = self._encode_pieces([text[a : a + m] for a, m in zip(s[one].tolist(), n[one].tolist())])
            at = self._store(ids)
            self._add(low[one], high[one], (((at + np.cumsum(counts) - counts) << 5) | counts).astype(np.uint32))
            slot[new] = self._find(low[new], high[new])
        span = self.span[slot]
        place, count = (span >> np.uint32(5)).astype(np.int64), (span & np.uint32(31)).astype(np.int64)
        if every:
            return place, count
        places, number = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        places[short], number[short] = place, count
        text = text or data.tobytes()
        fleeting = []
        for i in np.flatnonzero(~short).tolist():
            piece = text[starts[i] : starts[i] + sizes[i]]
            known = self.long.get(piece)
            if known is None:
                ids = self.raw(piece.decode())
                known = (self._store(ids), len(ids))
                if len(piece) <= LONG_BYTES:
                    self.long[piece] = known
                else:
                    fleeting.append(len(ids))
            places[i], number[i] = known
        if sum(fleeting) > 1 << 22:
            self.held = self.limit + 1  # very long pieces: begin anew with the next block
        return places, number

    def _block(self, data: np.ndarray, begin: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin at the places ``begin`` (the last item: the end) of ``data``, and the number of each text's ids."""
        if words:  # a blank before each word, whatever parted the words
            data = np.insert(_LOWER[data], begin[:-1], 32)
            begin = begin + np.arange(len(begin))
            space = data == 32
            first = np.zeros(len(data) + 1, bool)
            first[: len(data) - 1] = space[:-1] & ~space[1:]
            last = np.zeros(len(data) + 1, bool)
            last[1:] = ~space
            last[1:-1] &= space[1:]
            parted = _parted(data)
            first[1:-1] |= parted
            last[1:-1] |= parted
            starts = np.flatnonzero(first)
            sizes = np.flatnonzero(last) - starts
        else:
            mark = np.zeros(len(data), bool)
            np.logical_and(_SPACE[data[1:]], ~_UNCUT[data[:-1]], out=mark[1:])
            wide = _wide_space_ends(data) + 1
            mark[wide[wide < len(data)]] = False
            mark[1:] |= _parted(data)
            mark[begin[:-1][begin[:-1] < begin[1:]]] = True
            starts = np.flatnonzero(mark)
            sizes = np.diff(starts, append=len(data))
        ids, counts, most = [], [np.zeros(1, np.int64)], 1 << (self.bits - 2)  # the table has room for so many new pieces
        for a in range(0, len(starts), most):
            place, count = self._look_up(data, starts[a : a + most], sizes[a : a + most])
            before = np.cumsum(count) - count
            ids.append(self.flat[np.repeat(place - before, count) + np.arange(int(count.sum()))])
            counts.append(count)
        stop = np.cumsum(np.concatenate(counts))
        return (np.concatenate(ids) if ids else np.empty(0, self.dtype)), np.diff(stop[np.searchsorted(starts, begin)])

    def _safe_cut(self, data: np.ndarray, at: int) -> int:
        """A place up to ``at`` where the text may be cut, 0 for none."""
        for width in (1 << 10, at):
            a = max(1, at - width)
            found = np.flatnonzero((data[a:at] == 32) & (data[a - 1 : at - 1] > 32) & (data[a - 1 : at - 1] < 127))
            if len(found):
                return a + int(found[-1])
        return 0

    def encode_column(self, column: pa.Array, words: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column one after the other, and the number of each text's ids.

        ``words``: A-Z lower-cased, words parted by ASCII white space, each taken behind one blank and
        as ordinary text, even if it holds the string of an added token.
        """
        data, at = utf8(column)
        n = len(at) - 1
        counts = np.zeros(n, np.int64)
        out: list[np.ndarray] = []
        special: list[int] = []
        if not words:
            whole = data.tobytes()
            for token in self.added:
                here = whole.find(token)
                while here >= 0:
                    row = int(np.searchsorted(at, here, side="right")) - 1
                    if here + len(token) <= at[row + 1]:
                        special.append(row)
                        here = int(at[row + 1]) - 1
                    here = whole.find(token, here + 1)
            special = sorted(set(special))
        a, cuts = 0, [*special, n]
        while a < n:
            if a == cuts[0]:
                cuts.pop(0)
                ids = self.raw(whole[at[a] : at[a + 1]].decode())
                out.append(ids)
                counts[a] = len(ids)
                a += 1
                continue
            z = max(a + 1, min(int(np.searchsorted(at, at[a] + BLOCK_BYTES, side="right")) - 1, cuts[0]))
            if at[z] - at[a] <= 2 * BLOCK_BYTES:
                ids, counts[a:z] = self._block(data[at[a] : at[z]], at[a : z + 1] - at[a], words)
                out.append(ids)
            else:  # one long text, a stretch at a time
                here, end = int(at[a]), int(at[z])
                while here < end:
                    stop = end
                    if end - here > 2 * BLOCK_BYTES:
                        size = 2 * BLOCK_BYTES
                        while (step := self._safe_cut(data[here : here + size], min(size, end - here))) == 0 and here + size < end:
                            size *= 2
                        stop = here + step if step else end
                    ids, k = self._block(data[here:stop], np.array([0, stop - here]), words)
                    out.append(ids)
                    counts[a] += int(k[0])
                    here = stop
            a = z
        return (np.concatenate(out) if out else np.empty(0, self.dtype)), counts

    def _split(self, column: pa.Array, words: bool) -> list[bytes]:
        ids, counts = self.encode_column(column, words)
        raw, ends = ids.tobytes(), np.cumsum(counts) * self.dtype.itemsize
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian bytes of ``dtype``."""
        return self._split(pa.array(texts, pa.string()), False)

    def encode_words(self, texts: list[str | None]) -> list[bytes]:
        """Ids of the words of each text, A-Z lower-cased, every word taken behind a blank."""
        return self._split(pa.array(texts, pa.string()), True)


_ENCODERS: dict[str, SubwordEncoder] = {}


def encoder(path: str | None = None) -> SubwordEncoder:
    """The worker's encoder, kept between tasks: about 60 MB with a full table."""
    key = path or ""
    if key not in _ENCODERS:
        _ENCODERS[key] = SubwordEncoder(path)
    return _ENCODERS[key]
