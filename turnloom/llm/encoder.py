"""Exact batch encoding with the tokenizers library, each distinct unit of text encoded once.

A unit starts at a space or line feed, at a point or comma behind an ASCII letter, or at the start of a text. The
byte-level pre-tokenizer never joins characters across such a place, except within runs of three or more white-space
characters; texts that hold one, or the name of an added token such as <|endoftext|> (which the library maps to the token's own id),
are encoded whole. Units are found with numpy and looked up in a direct-mapped table that holds the bytes of each unit
(WORDS words of eight, and the length) beside its ids: a hash only names the slot, and a unit counts as known if all its bytes are equal.
Longer units are looked up in a dictionary by their bytes. Units not yet known go to the library in one joined string, whose ids are
cut at the units' ends by the byte lengths of the tokens. Table and dictionary have a fixed size, so memory is bounded.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

SLOTS, ARENA, CHUNK = 1 << 20, 1 << 23, 1 << 20
#: Words of eight bytes that the table holds of a unit; most bytes of longer units that the dictionary holds.
WORDS, LONG_BYTES = 3, 1 << 23
#: Keeps the first n bytes of a word.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
P = np.uint64(0x9E3779B97F4A7C15)
P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _is(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


SPLIT = _is(b" \n")
POINT = _is(b",.!?;:")
LETTER = _is(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
BLANK = _is(b" \t\n\x0b\x0c\r")
#: First and last bytes that a longer white-space character can have in UTF-8.
BLANK_FIRST = _is(b" \t\n\x0b\x0c\r\xc2\xe1\xe2\xe3")
BLANK_LAST = _is(b" \t\n\x0b\x0c\r\x80\x81\x82\x83\x84\x85\x86\x87\x88\x89\x8a\xa0\xa8\xa9\xaf\x9f")


class Encoder:
    """ids(texts) gives the ids of all texts, one after another, and the bounds of each text in them."""

    def __init__(self, path: str, slots: int = SLOTS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        n = self.lib.get_vocab_size()
        self.bytes_of = np.array([len(self.lib.id_to_token(i) or "") for i in range(n)], np.int64)
        self.slots = slots
        self._clear()

    def _clear(self) -> None:
        self.words = np.zeros((WORDS, self.slots), np.uint64)
        # no unit has length 0: an empty slot equals none
        self.length = np.zeros(self.slots, np.uint8)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.long_bytes = 0
        self.at = np.zeros(self.slots, np.int64)
        self.size = np.zeros(self.slots, np.int32)
        self.arena, self.used = np.empty(ARENA, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """In pieces of CHUNK bytes, so that scratch memory does not follow the batch."""
        out, bounds, part, size = [], [np.zeros(1, np.int64)], [], 0
        total = 0

        def flush() -> None:
            nonlocal part, size, total
            if part:
                ids, ends = self._chunk(part)
                out.append(ids)
                bounds.append(ends + total)
                total += len(ids)
                part, size = [], 0

        for text in texts:
            raw = text.encode()
            if size + len(raw) > CHUNK:
                flush()
            if len(raw) > CHUNK:
                ids = self.whole(text)
                total += len(ids)
                out.append(ids)
                bounds.append(np.array([total], np.int64))
            else:
                part.append((text, raw))
                size += len(raw)
        flush()
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), np.concatenate(bounds)

    def _chunk(self, part: list[tuple[str, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"".join(raw for _, raw in part)
        lengths = np.array([len(raw) for _, raw in part], np.int64)
        ends = np.cumsum(lengths)
        buf = np.frombuffer(joined, np.uint8)
        is_first = np.zeros(len(buf) + 1, bool)
        is_first[np.concatenate([[0], ends])] = True
        split = SPLIT[buf]
        begins = split | is_first[:-1]
        begins[1:] |= POINT[buf[1:]] & LETTER[buf[:-1]]
        starts = np.flatnonzero(begins)
        # a split with white space before and after (or at the text's end) may fall inside a token
        at = np.flatnonzero(split)
        inner = at[~is_first[at]]
        after = np.minimum(inner + 1, len(buf) - 1)
        risky = inner[BLANK_LAST[buf[inner - 1]] & (BLANK_FIRST[buf[after]] | is_first[inner + 1])]
        odd = np.zeros(len(part), bool)
        odd[np.searchsorted(ends, risky, "right")] = True
        # an added token ends the white space before it, so units beside it are not those of a plain text
        odd |= [any(t in text for t in self.added) for text, _ in part]
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(part), np.int64)
        stops = np.append(starts[1:], len(buf))
        owner = np.searchsorted(ends, starts, "right")
        if odd.any():
            keep = ~odd[owner]
            starts, stops, owner = starts[keep], stops[keep], owner[keep]
        if self.used > ARENA - 4 * CHUNK or self.long_bytes > LONG_BYTES:
            self._clear()
        at, size = self._look_up(joined, buf, starts, stops)
        size = size.astype(np.int64)
        before = np.cumsum(size) - size
        ids = self.arena[np.repeat(at - before, size) + np.arange(size.sum())]
        count = np.bincount(owner, weights=size, minlength=len(part)).astype(np.int64)
        if not odd.any():
            return ids, np.cumsum(count)
        pieces, cut = [], np.cumsum(count)
        for i, (text, _) in enumerate(part):
            pieces.append(self.whole(text) if odd[i] else ids[cut[i] - count[i] : cut[i]])
        return np.concatenate(pieces), np.cumsum([len(p) for p in pieces])

    def _look_up(self, raw: bytes, buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the arena and number of the ids of each unit; those not known are encoded first."""
        length = stops - starts
        # eight bytes from every place on, as one word
        words = np.ndarray((len(raw) + 8 * WORDS,), "<u8", raw + bytes(8 * WORDS + 8), strides=(1,))
        w = [words[starts + 8 * k] & MASKS[np.clip(length - 8 * k, 0, 8)] for k in range(WORDS)]
        h = length.astype(np.uint64)
        for word, m in zip(w, _MIX, strict=True):
            h = (h ^ word) * m
            h ^= h >> np.uint64(29)
        slot = (h >> np.uint64(8)).astype(np.int64) % self.slots
        known = self.length[slot] == length
        for k in range(WORDS):
            known &= self.words[k][slot] == w[k]
        long = length > 8 * WORDS
        at, size = self.at[slot], self.size[slot]
        missing = np.flatnonzero(~known & ~long)
        # equal units side by side; units that only share a hash may be apart, and are then encoded twice
        missing = missing[np.argsort(h[missing], kind="stable")]
        fresh = np.ones(len(missing), bool)
        if len(missing):
            a, b = missing[1:], missing[:-1]
            fresh[1:] = length[a] != length[b]
            for word in w:
                fresh[1:] |= word[a] != word[b]
        units = missing[fresh]
        apart: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(long).tolist():
            unit = raw[starts[i] : stops[i]]
            if unit in self.long:
                at[i], size[i] = self.long[unit]
            else:
                apart.setdefault(unit, []).append(i)
        if not len(units) and not apart:
            return at, size
        new = np.concatenate([units, np.array([x[0] for x in apart.values()], np.int64)])
        new_at, new_size = self._encode(buf, starts[new], stops[new])
        group = np.cumsum(fresh) - 1
        at[missing], size[missing] = new_at[group], new_size[group]
        for (unit, places), a, n in zip(apart.items(), new_at[len(units) :].tolist(), new_size[len(units) :].tolist(), strict=True):
            at[places], size[places] = a, n
            self.long[unit] = a, n
            self.long_bytes += len(unit)
        # of new units that share a slot one is kept
        s, first = np.unique(slot[units], return_index=True)
        kept = units[first]
        self.length[s], self.at[s], self.size[s] = length[kept], new_at[first], new_size[first]
        for k in range(WORDS):
            self.words[k][s] = w[k][kept]
        return at, size

    def _encode(self, buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put the ids of distinct units into the arena."""
        n = len(starts)
        at, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        raw = buf.tobytes()
        units = [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        # joined: those with one separator, then no other white space at all
        plain = SPLIT[buf[starts]] & (stops - starts > 1)
        blank = np.concatenate([[0], np.cumsum(BLANK[buf] | (buf == 0x85) | (buf == 0xA0) | (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3))])
        plain &= blank[stops] - blank[starts] == 1
        joined = np.flatnonzero(plain)
        alone = np.flatnonzero(~plain)
        if len(joined):
            text = b"".join([units[i] for i in joined.tolist()]).decode()
            ids = np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            token_ends = np.cumsum(self.bytes_of[ids])
            unit_ends = np.cumsum((stops - starts)[joined])
            cut = np.searchsorted(token_ends, unit_ends)
            if len(ids) and token_ends[-1] == unit_ends[-1] and (token_ends[np.minimum(cut, len(ids) - 1)] == unit_ends).all():
                first = np.concatenate([[0], cut[:-1] + 1])
                at[joined], size[joined] = self._store(ids) + first, cut + 1 - first
            else:
                alone = np.arange(n)
        if len(alone):
            for i, e in zip(alone.tolist(), self.lib.encode_batch_fast([units[i].decode() for i in alone.tolist()], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                at[i], size[i] = self._store(ids), len(ids)
        return at, size

    def _store(self, ids: np.ndarray) -> int:
        at = self.used
        self.arena[at : at + len(ids)] = ids
        self.used += len(ids)
        return at


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
