"""Tokenising whole texts with the ``tokenizers`` library, a chunk at a time.

A BPE tokenizer splits a text into pre-tokens and encodes each alone, so the
ids of a text are the ids of its space-separated chunks in a row.  No pre-token
goes on from a letter to a punctuation mark, so chunks are cut there too, and a
word is one chunk whatever follows it.  Chunks repeat, so their ids are kept in
a bounded table per worker process; every entry is made by the library itself.
A full table keeps the chunks met again since it was last full, at most half of
it.  The table is a set of flat arrays, and chunks are cut, hashed, looked up,
encoded and put together many at a time: hundreds of millions of lookups in a
Python dict would cost more than the tokenizer.

A chunk is found by a 64-bit hash of its bytes, and what is found counts only
if the bytes kept with it are the chunk's own; of chunks with equal hashes one
is kept and the others are encoded each time, as are chunks over ``LONGEST``
bytes.  A text that holds a special token of the vocabulary goes to the library
whole.

Defined results: an empty text has no ids; equal texts have equal ids; the ids
are those of ``encode(text, add_special_tokens=False)`` and nothing else.
"""

from __future__ import annotations

import ctypes
import os
import re
from contextlib import suppress
from itertools import chain

import numpy as np
import pyarrow as pa

_PAIR = re.compile(r"\s\s")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_BASE, _MIX, _FIRST = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA5A5A5A55A5A5A5A
LONGEST, GROUP_BYTES, PART = 64, 1 << 18, 512
_SPACE, _NEWLINE = 0x20, 0x0A
_SEEN = np.array([0x21 <= n < 0x7F for n in range(256)])
_LETTER = np.array([n < 0x80 and chr(n).isalpha() for n in range(256)])
_MARK = np.array([0x21 <= n < 0x7F and not chr(n).isalnum() for n in range(256)])
#: The second bytes of Latin letters whose first is 0xC3.
_LATIN = np.array([0x80 <= n < 0xC0 and n not in (0x97, 0xB7) for n in range(256)])


class _Powers:
    """Powers of the hash base and of its inverse, as long as the longest group so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n <= len(self.up):
            return
        n = max(n, 2 * len(self.up), 1 << 16)
        with np.errstate(over="ignore"):
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x % (1 << 64), np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _eights(octets: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number; the last 7 places have none."""
    return np.ndarray((len(octets) - 7,), "<u8", octets, strides=(1,))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that have these starts and sizes, one run after the other."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - (upto - sizes), sizes) + np.arange(int(upto[-1]) if len(upto) else 0)


class _Chunks:
    """Chunks of a text: where their bytes are, their hashes, which have no space before them, and which follow one."""

    def __init__(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, firsts: np.ndarray, words: np.ndarray):
        self.raw, self.starts, self.ends, self.sizes, self.hashes, self.firsts, self.words = raw, starts, ends, ends - starts, hashes, firsts, words
        self.octets = np.frombuffer(raw + bytes(8), np.uint8)

    def bytes_of(self, at: np.ndarray) -> np.ndarray:
        return self.octets[_spans(self.starts[at], self.sizes[at])]

    def text(self, n: int) -> str:
        return self.raw[self.starts[n] : self.ends[n]].decode("utf-8", "surrogatepass")


class _Table:
    """Open addressing from chunk hashes to the chunks' bytes in one pool and their ids in another; at most half full."""

    def __init__(self, bits: int = 16):
        self._slots(bits)
        self._entries(np.zeros((1024, 4), np.int32))
        self.pool, self.octets, self.again = np.zeros(4096, np.uint32), np.zeros(4096, np.uint8), np.zeros(1024, bool)
        self.n = self.filled = self.written = 0

    def _slots(self, bits: int) -> None:
        """What is read of one slot, or of one entry, lies side by side."""
        self.bits, self.shift, self.mask = bits, np.uint64(64 - bits), (1 << bits) - 1
        slots = np.zeros((1 << bits, 2), np.uint64)
        self.keys, self.values = slots[:, 0], slots[:, 1].view(np.int64)

    def _entries(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.offsets, self.lengths, self.places, self.shapes = rows.T

    def find(self, chunks: _Chunks, at: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each chunk at ``at``, or -1; and whether another chunk of its hash is kept."""
        hashes, starts, sizes = chunks.hashes[at], chunks.starts[at], chunks.sizes[at]
        slots = (hashes >> self.shift).astype(np.int64)
        seen = self.keys[slots]
        out = np.where(seen == hashes, self.values[slots], -1)
        open_ = np.flatnonzero((seen != hashes) & (seen != 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            seen = self.keys[slots[open_]]
            hit = seen == hashes[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (seen != 0)]
        same = (out >= 0) & (self.shapes[out] == 2 * sizes + chunks.firsts[at])
        held, given, left = _eights(self.octets), _eights(chunks.octets), np.flatnonzero(same)
        for step in range(0, LONGEST, 8):
            left = left[sizes[left] > step]
            if not len(left):
                break
            keep = _KEEP[np.minimum(sizes[left] - step, 8)]
            equal = ((held[self.places[out[left]] + step] ^ given[starts[left] + step]) & keep) == 0
            same[left[~equal]] = False
            left = left[equal]
        return np.where(same, out, -1), (out >= 0) & ~same

    def add(self, chunks: _Chunks, at: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Put in the chunks at ``at``, whose hashes are not kept yet, with their ids, one chunk's after the other's."""
        self._put(chunks.hashes[at], chunks.sizes[at], chunks.firsts[at], chunks.bytes_of(at), lengths, ids)

    def kept(self, most: int) -> _Table:
        """A table of the chunks that were met again, the latest if they are more than ``most``."""
        at, made, held = np.flatnonzero(self.again[: self.n])[-most:], _Table(), self.keys != 0
        hashes, sizes = np.zeros(self.n, np.uint64), self.shapes[at] >> 1
        hashes[self.values[held]] = self.keys[held]
        texts, ids = self.octets[_spans(self.places[at], sizes)], self.pool[_spans(self.offsets[at], self.lengths[at])]
        made._put(hashes[at], sizes, self.shapes[at] & 1, texts, self.lengths[at], ids)
        return made

    def _put(self, hashes: np.ndarray, sizes: np.ndarray, firsts: np.ndarray, texts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        n = len(hashes)
        for name, used, more in (("rows", self.n, n), ("again", self.n, n), ("pool", self.filled, len(ids)), ("octets", self.written, len(texts) + 8)):
            held = getattr(self, name)
            if used + more > len(held):
                grown = np.zeros((max(2 * len(held), used + more), *held.shape[1:]), held.dtype)
                grown[:used] = held[:used]
                setattr(self, name, grown)
        self._entries(self.rows)
        new = slice(self.n, self.n + n)
        self.offsets[new], self.lengths[new] = self.filled + np.cumsum(lengths) - lengths, lengths
        self.places[new], self.shapes[new] = self.written + np.cumsum(sizes) - sizes, 2 * sizes + firsts
        self.pool[self.filled : self.filled + len(ids)] = ids
        self.octets[self.written : self.written + len(texts)] = texts
        entries = np.arange(self.n, self.n + n)
        self.n, self.filled, self.written = self.n + n, self.filled + len(ids), self.written + len(texts)
        if 2 * self.n > len(self.keys):
            held = self.keys != 0
            old, at = self.keys[held], self.values[held]
            self._slots((2 * self.n).bit_length())
            self._file(old, at)
        self._file(hashes, entries)

    def _file(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        slots, left = (hashes >> self.shift).astype(np.int64), np.arange(len(hashes))
        while len(left):
            free = left[self.keys[slots[left]] == 0]
            free = free[np.unique(slots[free], return_index=True)[1]]
            self.keys[slots[free]], self.values[slots[free]] = hashes[free], entries[free]
            left = left[self.keys[slots[left]] != hashes[left]]
            slots[left] = np.where(self.keys[slots[left]] != 0, (slots[left] + 1) & self.mask, slots[left])


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    ``spaces_dropped`` says that the tokenizer drops white space; then chunks
    go in bare.  Otherwise a chunk carries the single space before it, if any,
    only spaces between two non-space characters are cut, and a line end between
    two such characters is a chunk.
    """

    def __init__(self, path: str, spaces_dropped: bool, limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already fill the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [x.content for x in added if not x.normalized]
        self.special_any_case = re.compile("|".join(re.escape(x.content) for x in added if x.normalized), re.I) if any(x.normalized for x in added) else None
        self.dropped, self.limit, self.powers, self.table = spaces_dropped, limit, _Powers(), _Table()
        vocabulary = self.tokenizer.get_vocab()
        self.marked = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, at in vocabulary.items():
            self.marked[at] = token.endswith("</w>") if spaces_dropped else token == "Ċ"

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        group: list[str] = []
        held = 0
        for text in texts:
            group.append(text)
            held += len(text)
            if held >= GROUP_BYTES:
                out += self._group(group)
                group, held = [], 0
        return out + self._group(group)

    # ---- a group of texts

    def _group(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if self.table.n > self.limit:
            self.table = self.table.kept(self.limit // 2)
        whole = [n for n, x in enumerate(texts) if self._has_special(x)]
        odd = [] if self.dropped else [n for n, x in enumerate(texts) if _PAIR.search(x)]
        away = {*whole, *odd}
        shown = ["" if n in away else x for n, x in enumerate(texts)] if away else texts
        if self.dropped:
            shown = [(x.lower() if x.isascii() else x).replace("\n", " ") for x in shown]
        counts = np.fromiter((x.count(" ") + 1 for x in shown), np.int64, len(shown))
        last = np.cumsum(counts)
        chunks = self._cut(" ".join(shown), None if self.dropped else last - counts)
        sizes = chunks.sizes
        entries, taken = self.table.find(chunks)
        self.table.again[entries[entries >= 0]] = True
        lost = np.flatnonzero((entries < 0) & (sizes > 0) if self.dropped else entries < 0)
        extra: dict[int, np.ndarray] = {}
        if len(lost):
            new = lost[(sizes[lost] <= LONGEST) & ~taken[lost]]
            self._learn(chunks, new[np.unique(chunks.hashes[new], return_index=True)[1]])
            entries[lost], _ = self.table.find(chunks, lost)
            for n in lost[entries[lost] < 0].tolist():
                extra[n] = self._ids(self._plain(chunks, n))
        table = self.table
        lengths = np.where(entries >= 0, table.lengths[entries], 0).astype(np.int64)
        upto = np.cumsum(lengths)
        ids = table.pool[_spans(np.where(entries >= 0, table.offsets[entries], 0), lengths)]
        if extra:
            places = sorted(extra)
            ids = np.insert(ids, np.repeat([int(upto[n] - lengths[n]) for n in places], [len(extra[n]) for n in places]), np.concatenate([extra[n] for n in places]))
            for n in places:
                lengths[n] = len(extra[n])
            upto = np.cumsum(lengths)
        data, cuts = ids.astype("<u4").tobytes(), np.concatenate([[0], upto[np.append(chunks.words, len(sizes))[last] - 1]]).tolist()
        out = [data[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for n in odd:
            first_piece, *rest = _SINGLE_SPACE.split(texts[n])
            made = self.tokenizer.encode_batch_fast([first_piece, *(f" {x}" for x in rest)], add_special_tokens=False)
            out[n] = b"".join(np.array(x.ids, "<u4").tobytes() for x in made)
        for n in whole:
            out[n] = self._ids(texts[n]).astype("<u4").tobytes()
        return out

    def _has_special(self, text: str) -> bool:
        """Also if it would have one in lower case, as chunks may be lowered before they are encoded."""
        if self.dropped:
            text = text.lower()
        return any(x.lower() in text if self.dropped else x in text for x in self.special) or bool(self.special_any_case and self.special_any_case.search(text))

    def _cut(self, text: str, firsts: np.ndarray | None) -> _Chunks:
        """The chunks of a text; ``firsts`` are those of its space-separated parts that begin one; no hash is 0."""
        raw = text.encode("utf-8", "surrogatepass")
        octets = np.frombuffer(raw, np.uint8)
        breaks = octets == _SPACE
        marks = np.flatnonzero(_MARK[octets])
        marks = marks[marks > 0]
        before = octets[marks - 1]
        breaks[marks[_LETTER[before] | (_LATIN[before] & (octets[marks - 2] == 0xC3))]] = True
        if firsts is not None:
            lines = np.flatnonzero(octets == _NEWLINE)
            breaks[lines[(lines > 0) & (octets[lines - 1] != _SPACE)]] = True
            breaks[lines[lines + 1 < len(raw)] + 1] = True
        places = np.flatnonzero(breaks)
        spaces = octets[places] == _SPACE
        starts, ends = np.concatenate([[0], places + spaces]), np.append(places, len(raw))
        words = np.concatenate([[0], np.flatnonzero(spaces) + 1])
        begins = np.zeros(len(starts), bool)
        if firsts is not None:
            begins[1:] = ~spaces
            begins[words[firsts]] = True
        self.powers.reach(len(raw) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * self.powers.up[: len(raw)], out=sums[1:])
            hashes = (sums[ends] - sums[starts]) * self.powers.down[starts]
            hashes ^= (ends - starts).astype(np.uint64) * np.uint64(_BASE)
            hashes[begins] ^= np.uint64(_FIRST)
            hashes ^= hashes >> np.uint64(29)
            hashes *= np.uint64(_MIX)
            hashes ^= hashes >> np.uint64(32)
            hashes *= np.uint64(_MIX)
        hashes[hashes == 0] = 1
        return _Chunks(raw, starts, ends, hashes, begins, words)

    # ---- new chunks

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _plain(self, chunks: _Chunks, n: int) -> str:
        return chunks.text(n) if self.dropped or chunks.firsts[n] else f" {chunks.text(n)}"

    def _learn(self, chunks: _Chunks, at: np.ndarray) -> None:
        """Put the ids of the chunks at ``at`` into the table.

        A run of Latin letters is one pre-token, so if spaces are dropped such
        words are encoded in one long text and told apart by the mark that the
        vocabulary puts on a word's last token.  Otherwise chunks of visible
        ASCII and Latin letters are, and told apart by the line ends between
        them, which no pre-token shares.
        """
        sizes, octets = chunks.sizes[at], chunks.bytes_of(at)
        plain = (_LETTER if self.dropped else _SEEN)[octets]
        pairs = np.flatnonzero((octets[:-1] == 0xC3) & _LATIN[octets[1:]])
        plain[pairs] = plain[pairs + 1] = True
        odd = np.diff(np.concatenate([[0], np.cumsum(~plain)])[np.concatenate([[0], np.cumsum(sizes)])]) > 0
        fit = (sizes > 0) & ~odd if self.marked.any() else np.zeros(len(at), bool)
        many, alone = at[fit], at[~fit]
        lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for part in (many[n : n + PART] for n in range(0, len(many), PART)):
            ahead = np.zeros(len(part), np.int64) if self.dropped else (~chunks.firsts[part]).astype(np.int64)
            ends = np.cumsum(ahead + chunks.sizes[part] + 1)
            text = np.full(int(ends[-1]), _SPACE, np.uint8)
            text[_spans(ends - 1 - chunks.sizes[part], chunks.sizes[part])] = chunks.bytes_of(part)
            if not self.dropped:
                text[ends - 1] = _NEWLINE
            got = np.array(self.tokenizer.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
            marked = self.marked[got]
            edges = np.flatnonzero(marked)
            assert len(edges) == len(part)
            lengths.append(np.diff(edges, prepend=-1) - (not self.dropped))
            ids.append(got if self.dropped else got[~marked])
        for part in (alone[n : n + PART] for n in range(0, len(alone), PART)):
            runs = [x.ids for x in self.tokenizer.encode_batch_fast([self._plain(chunks, n) for n in part.tolist()], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, runs), np.int64, len(runs)))
            ids.append(np.fromiter(chain.from_iterable(runs), np.uint32))
        self.table.add(chunks, np.concatenate([many, alone]), np.concatenate(lengths), np.concatenate(ids))


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def forget() -> None:
    """Give an encoder's memory back to the machine; other operators' tasks run in the same workers after it."""
    if not _encoders:
        return
    _encoders.clear()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # what the C library keeps of freed blocks, if it is glibc
        ctypes.CDLL(None).malloc_trim(0)


def encoder(path: str, spaces_dropped: bool) -> ChunkEncoder:
    """One encoder per worker process and tokenizer."""
    key = (path, spaces_dropped)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(path, spaces_dropped)
    return _encoders[key]
