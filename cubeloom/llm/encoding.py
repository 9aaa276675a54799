"""Token ids by the ``tokenizers`` library, with a memory of pieces met before, bounded in bytes.

Encoding a text as a whole spends most of its time on words met many times. Here the bytes of many
texts are cut at once, at places where the pre-tokenizers of both vocabularies always cut, so each
piece has the ids that it has within its text:

* before white space that follows something else, and around the last character of white space
  before something else (that one joins what follows if it is a space);
* where letters, digits and other marks meet, but not after an apostrophe, which may begin a
  contraction. Only ASCII and the letters U+00C0 to U+017F are told apart; other characters are never
  cut off from what is beside them.

Distinct pieces are then found once per batch, looked up in one sorted array of their hashes (and
compared byte by byte), and their ids gathered. A new piece of one kind of character goes straight to
the library's model, any other through its whole pipeline. Texts with other white space or with the
strings of special tokens are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Kinds of bytes. SPACE is ASCII white space, OTHER any that is not told apart, ODD white space that is not ASCII.
SPACE, LETTER, DIGIT, MARK, OTHER, ODD = range(6)
APOSTROPHE = ord("'")
#: Texts are cut in batches of about so many bytes.
BATCH_BYTES = 1 << 20
#: Longer pieces are not remembered.
LONGEST = 64
_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def _kinds_of_bytes() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    kinds[:128] = MARK
    kinds[list(b" \t\n\x0b\x0c\r")] = SPACE
    kinds[0x1C:0x20] = ODD
    for a, b in (b"az", b"AZ"):
        kinds[a : b + 1] = LETTER
    kinds[ord("0") : ord("9") + 1] = DIGIT
    return kinds


_KINDS = _kinds_of_bytes()
#: White space beyond ASCII, and a former member.
_ODD_SPACES = [c.encode() for c in "\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8 texts."""
    kinds = _KINDS[data]
    if not len(data) or data.max() < 0x80:
        return kinds
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    lead = lead[lead + 1 < len(data)]
    after = data[lead + 1]
    # Not letters: multiplication and division sign; not one letter in lower case: I with a dot.
    lead = lead[~((data[lead] == 0xC3) & ((after == 0x97) | (after == 0xB7))) & ~((data[lead] == 0xC4) & (after == 0xB0))]
    kinds[lead] = LETTER
    kinds[lead + 1] = LETTER
    if np.isin(data, [0xC2, 0xE1, 0xE2, 0xE3]).any():
        raw = data.tobytes()
        for odd in _ODD_SPACES:
            at = raw.find(odd)
            while at >= 0:
                kinds[at : at + len(odd)] = ODD
                at = raw.find(odd, at + 1)
    return kinds


def cuts(data: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first byte of each piece of the texts that lie between the offsets."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    space = kinds == SPACE
    before, here = kinds[:-1], kinds[1:]
    told = ((before == LETTER) | (before == DIGIT) | (before == MARK)) & ((here == LETTER) | (here == DIGIT) | (here == MARK))
    cut[1:n] = told & (before != here) & (data[:-1] != APOSTROPHE)
    cut[1:n] |= space[1:] & ~space[:-1]
    cut[1:n] |= space[:-1] & ~space[1:] & (data[:-1] != 32)
    cut[1 : n - 1] |= space[:-2] & space[1:-1] & ~space[2:]
    ends = offsets[1:][np.diff(offsets) > 1] - 1
    cut[ends[space[ends] & space[ends - 1]]] = False  # white space up to a text's end is one piece
    cut[offsets] = True
    return np.flatnonzero(cut[:n])


def gather(source: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices source[start : start + length], one after another."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return source[np.repeat(start - (ends - length), length) + np.arange(total)]


class _Growing:
    """An array that is appended to."""

    def __init__(self, dtype):
        self.array, self.n = np.zeros(1 << 12, dtype), 0

    def append(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.array):
            self.array = np.concatenate([self.array, np.zeros(len(self.array) // 2, self.array.dtype)])
        self.array[self.n : self.n + len(values)] = values
        self.n += len(values)


class KnownPieces:
    """Pieces with their ids in a few arrays; full, it forgets all and starts again."""

    def __init__(self, max_bytes: int):
        # The power of an odd number by place, so that a piece's hash is a sum of products.
        self.powers = np.cumprod(np.full(LONGEST, 0x9E3779B97F4A7C15, np.uint64))
        self.max_bytes = max_bytes
        self.clear()

    def clear(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.data, self.ids = _Growing(np.uint8), _Growing(np.uint32)
        self.start, self.length = _Growing(np.int64), _Growing(np.int32)
        self.id_start, self.id_length = _Growing(np.int64), _Growing(np.int32)

    def n_bytes(self) -> int:
        return self.hashes.nbytes + self.slots.nbytes + sum(x.array.nbytes for x in (self.data, self.ids, self.start, self.length, self.id_start, self.id_length))

    def hash(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """64-bit hashes of pieces of 1 to LONGEST bytes that lie one after another in ``data``."""
        place = np.arange(len(data)) - np.repeat(start, length)
        sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * self.powers[place], start)
        sums ^= sums >> np.uint64(29)
        return sums * np.uint64(0xBF58476D1CE4E5B9)

    def find(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The slot of each piece, -1 where it is not known."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int32)
        at = np.searchsorted(self.hashes, hashes).clip(0, len(self.hashes) - 1)
        slot = self.slots[at]
        same = (self.hashes[at] == hashes) & (self.length.array[slot] == length)
        slot = np.where(same, slot, -1)
        some = np.flatnonzero(same)
        if len(some):
            size = length[some].astype(np.int64)
            differs = gather(data, start[some], size) != gather(self.data.array, self.start.array[slot[some]], size)
            wrong = np.add.reduceat(differs, np.cumsum(size) - size, dtype=np.int64) > 0
            slot[some[wrong]] = -1
        return slot

    def add(self, hashes: np.ndarray, data: np.ndarray, length: np.ndarray, ids: np.ndarray, id_length: np.ndarray) -> None:
        """Remember distinct pieces; one whose hash another has is left out."""
        if self.n_bytes() > self.max_bytes:
            self.clear()
        first = self.length.n
        self.start.append(self.data.n + np.cumsum(length) - length)
        self.id_start.append(self.ids.n + np.cumsum(id_length) - id_length)
        for array, values in ((self.data, data), (self.ids, ids), (self.length, length), (self.id_length, id_length)):
            array.append(values)
        hashes, index = np.unique(hashes, return_index=True)
        at = np.searchsorted(self.hashes, hashes)
        if len(self.hashes):
            new = self.hashes[at.clip(0, len(self.hashes) - 1)] != hashes
            hashes, index, at = hashes[new], index[new], at[new]
        self.hashes = np.insert(self.hashes, at, hashes)
        self.slots = np.insert(self.slots, at, (first + index).astype(np.int32))


def vocabulary_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: themselves where they show, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class PieceEncoder:
    """Encodes whole texts to little-endian uint32 bytes; ``max_bytes`` bounds what it remembers."""

    def __init__(self, name: str, max_bytes: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # pieces are remembered here instead
        self.n_ids = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: A word vocabulary changes case, drops white space and takes digits one by one.
        self.of_words = self.tokenizer.normalizer is not None
        self.known = KnownPieces(max_bytes)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> bytes:
        """The ids of one whole text."""
        return next(self.encode_many([text]))

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        return self.encode_array(pa.array(texts, pa.large_string()))

    def encode_array(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of an array of strings; a null text is empty."""
        array = texts.cast(pa.large_string())
        offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
        data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
        if array.null_count:  # a null may lie over any bytes
            array = array.fill_null("")
            yield from self.encode_array(array)
            return
        k = 0
        while k < len(array):
            stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + BATCH_BYTES, side="right")) - 1)
            if offsets[stop] - offsets[k] <= BATCH_BYTES:
                yield from self._batch(data[offsets[k] : offsets[stop]], offsets[k : stop + 1] - offsets[k])
            else:
                yield self._long(data[offsets[k] : offsets[stop]])
            k = stop

    def _long(self, data: np.ndarray) -> bytes:
        """The ids of one long text, cut at spaces after a letter into parts that are cut further."""
        if self._is_odd(data.tobytes(), byte_kinds(data)):
            return self.whole(data.tobytes().decode()).astype("<u4").tobytes()
        out, at = [], 0
        while at < len(data):
            stop = len(data)
            if stop - at > BATCH_BYTES:
                part = data[at : at + BATCH_BYTES]
                found = np.flatnonzero((part[1:] == 32) & (_KINDS[part[:-1]] == LETTER))
                more = found if len(found) else np.flatnonzero((data[at + 1 :] == 32) & (_KINDS[data[at:-1]] == LETTER))[:1]
                stop = at + 1 + int(more[-1]) if len(more) else stop
            out += self._batch(data[at:stop], np.array([0, stop - at]))
            at = stop
        return b"".join(out)

    def _is_odd(self, raw: bytes, kinds: np.ndarray) -> bool:
        return bool((kinds == ODD).any()) or any(s in raw for s in self.specials)

    def _batch(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        kinds = byte_kinds(data)
        odd: dict[int, np.ndarray] = {}
        raw = data.tobytes()
        if self._is_odd(raw, kinds):
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if a < b and self._is_odd(raw[a:b], kinds[a:b]):
                    odd[k] = self.whole(raw[a:b].decode())
        if len(data):
            start = cuts(data, kinds, offsets)
            pieces = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(start, len(data)).astype(np.int32)), pa.py_buffer(raw)])
            found = pieces.dictionary_encode()
            ids, length = self._ids_of(found.dictionary)
            code = found.indices.to_numpy()
            size = length[code]
            flat = gather(ids, (np.cumsum(length) - length)[code], size).astype("<u4", copy=False)
            place = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, offsets)].tolist()
        else:
            flat, place = np.zeros(0, "<u4"), [0] * len(offsets)
        for k, (a, b) in enumerate(zip(place[:-1], place[1:], strict=True)):
            yield odd[k].astype("<u4").tobytes() if k in odd else flat[a:b].tobytes()

    def _ids_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces one after another, and how many each has."""
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[: len(pieces) + 1].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2], np.uint8)[: ends[-1]]
        start, length = ends[:-1], np.diff(ends)
        short = np.flatnonzero(length <= LONGEST)
        size = length[short]
        packed = data if len(short) == len(pieces) else gather(data, start[short], size)
        first = np.cumsum(size) - size
        hashes = self.known.hash(packed, first, size) if len(short) else np.zeros(0, np.uint64)
        slot = np.full(len(pieces), -1, np.int32)
        slot[short] = self.known.find(hashes, packed, first, size)
        new = np.flatnonzero(slot < 0)
        old = np.flatnonzero(slot >= 0)
        n_ids = np.zeros(len(pieces), np.int64)
        n_ids[old] = self.known.id_length.array[slot[old]]
        fresh, n_fresh = self._learn(data, start[new], length[new])
        n_ids[new] = n_fresh
        out = np.zeros(int(n_ids.sum()), np.uint32)
        begin = np.cumsum(n_ids) - n_ids
        out[_places(begin[old], n_ids[old])] = gather(self.known.ids.array, self.known.id_start.array[slot[old]], n_ids[old])
        out[_places(begin[new], n_ids[new])] = fresh
        keep = length[new] <= LONGEST
        if keep.any():
            by_place = np.zeros(len(pieces), np.uint64)
            by_place[short] = hashes
            kept = new[keep]
            ids = fresh if keep.all() else gather(fresh, (np.cumsum(n_fresh) - n_fresh)[keep], n_fresh[keep])
            self.known.add(by_place[kept], gather(data, start[kept], length[kept]), length[kept], ids, n_fresh[keep])
        return out, n_ids

    def _learn(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces by the library, and how many each has."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        packed = gather(data, start, length)
        first = np.cumsum(length) - length
        kinds = byte_kinds(packed)
        kinds[packed == APOSTROPHE] = OTHER
        led = (packed[first] == 32) & (length > 1)
        kinds[first[led]] = kinds[first[led] + 1]  # a space belongs to what follows
        least, most = np.minimum.reduceat(kinds, first), np.maximum.reduceat(kinds, first)
        plain = (least == most) & ((most == LETTER) | (most == MARK) | ((most == DIGIT) & (not self.of_words)))
        raw = packed.tobytes()
        shown = "" if self.of_words else raw.decode("latin-1").translate(_LETTERS)
        ids: list[list[int]] = []
        tokenize = self.model.tokenize
        for a, n, is_plain, is_led in zip(first.tolist(), length.tolist(), plain.tolist(), led.tolist(), strict=True):
            if not is_plain:
                ids.append(self.tokenizer.encode(raw[a : a + n].decode(), add_special_tokens=False).ids)
            elif self.of_words:
                lower = raw[a + is_led : a + n].decode().lower().encode()
                ids.append([t.id for t in tokenize(lower.decode("latin-1").translate(_LETTERS))])
            else:
                ids.append([t.id for t in tokenize(shown[a : a + n])])
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for some in ids for i in some), np.uint32, int(size.sum())), size


def _places(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each of the lengths."""
    ends = np.cumsum(length)
    return np.repeat(begin - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


def encoder(name: str, max_bytes: int = 48 << 20) -> PieceEncoder:
    """One encoder for each vocabulary and Python worker."""
    if (name, max_bytes) not in _ENCODERS:
        _ENCODERS[name, max_bytes] = PieceEncoder(name, max_bytes)
    return _ENCODERS[name, max_bytes]
