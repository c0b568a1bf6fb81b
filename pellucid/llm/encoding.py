"""Exact token ids, looked up by pre-token in whole batches of texts.

Both vocabularies split a text into pre-tokens and merge each on its own, so equal pre-tokens have
equal ids. Texts of plain Latin characters are split here, on arrays of their UTF-8 bytes; a pre-token of at most 16 bytes
is two integers, which a table of bounded size maps to its ids. Pre-tokens that are not in the table, and
every text with other characters or a special token's string, go to the tokenizers library itself. The
ids are the library's in either case.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pellucid.llm.common import process_state

#: The pre-token pattern that the library has for byte-level vocabularies, and that of a vocabulary with word ends. Fixed values.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_ENDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What both take off the front of a run of letters after an apostrophe. Fixed values.
SUFFIXES = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: Code points of texts that are split here: controls but tab and line ends, and spaces but the common one, are not among them.
SPLIT_HERE = ((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA1, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC))
TOP = 0x2100
#: Kinds of bytes.
END, SPACE, LETTER, NUMBER, OTHER = range(5)
#: Pre-tokens in the table at most (it is then emptied), and its slots, as a power of two.
KEPT, SLOTS = 450_000, 20
APOSTROPHE, BLANK = 0x27, 0x20


def _kind(c: str) -> int:
    return SPACE if c.isspace() else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)


def _byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies have for each byte: itself, or the next free one from 256 on."""
    spare = iter(range(256, 512))
    return {b: chr(b if 33 <= b < 127 or b > 160 and b != 173 else next(spare)) for b in range(256)}


def little_endian(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


class Table:
    """Ids of pre-tokens of at most 16 bytes, by their bytes as two integers, in open addressing."""

    def __init__(self):
        n = 1 << SLOTS
        self.lo, self.hi, self.entry = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.full(n, -1, np.int32)
        self.begin, self.count, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        self.entries = self.used = 0

    def _slot(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        h = lo * np.uint64(0x9E3779B97F4A7C15) ^ hi * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0x9FB21C651E98DF25)
        return (h >> np.uint64(64 - SLOTS)).astype(np.int64)

    def find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Entries; -1 for those not there."""
        slot = self._slot(lo, hi)
        out = self.entry[slot]
        left = np.flatnonzero((out >= 0) & ((self.lo[slot] != lo) | (self.hi[slot] != hi)))
        slot = slot[left]
        while len(left):
            slot = slot + 1 & (1 << SLOTS) - 1
            got = self.entry[slot]
            out[left] = got
            more = (got >= 0) & ((self.lo[slot] != lo[left]) | (self.hi[slot] != hi[left]))
            left, slot = left[more], slot[more]
        return out

    def add(self, lo: np.ndarray, hi: np.ndarray, ids: list[list[int]]) -> None:
        """Different keys that are not there yet."""
        n, counts = len(lo), np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum()))
        for name, need in (("begin", self.entries + n), ("count", self.entries + n), ("ids", self.used + len(flat))):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.resize(old, max(need, 2 * len(old))))
        entry = np.arange(self.entries, self.entries + n, dtype=np.int32)
        self.count[entry] = counts
        self.begin[entry] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + len(flat)] = flat
        self.entries, self.used = self.entries + n, self.used + len(flat)
        slot, left = self._slot(lo, hi), np.arange(n)
        while len(left):
            free = self.entry[slot] < 0
            self.entry[slot[free]] = entry[left[free]]  # of keys that want one slot the last has it
            held = free & (self.entry[slot] == entry[left])
            self.lo[slot[held]], self.hi[slot[held]] = lo[left[held]], hi[left[held]]
            left, slot = left[~held], slot[~held] + 1 & (1 << SLOTS) - 1

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries on end, and how many each has."""
        counts = self.count[entries].astype(np.int64)
        ends = np.cumsum(counts)
        at = np.repeat(self.begin[entries] - (ends - counts), counts)
        at += np.arange(len(at))
        return self.ids[at], counts


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        # A pre-token is already normal and whole: only the model is left, which knows the vocabulary's byte alphabet.
        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.alphabet = self.tokenizer.model.tokenize, _byte_alphabet()
        spec = json.load(open(path, encoding="utf-8"))
        pre, normalizer = spec["pre_tokenizer"], json.dumps(spec["normalizer"])
        pattern = next((p["pattern"]["Regex"] for p in pre.get("pretokenizers", []) if p["type"] == "Split"), BYTE_LEVEL)
        self.word_ends, self.lower, nfc = pattern == WORD_ENDS, "Lowercase" in normalizer, "NFC" in normalizer
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.here, self.kinds, self.lowered = np.zeros(TOP, bool), np.zeros(TOP, np.uint8), np.arange(TOP)
        if pattern in (BYTE_LEVEL, WORD_ENDS):
            for lo, hi in SPLIT_HERE:
                self.here[lo : hi + 1] = True
        known = self.here.copy()
        for c in np.flatnonzero(known).tolist():
            x = chr(c).lower() if self.lower else chr(c)
            self.here[c] = len(x) == 1 and ord(x) < TOP and known[ord(x)] and len(x.encode()) == len(chr(c).encode()) and (not nfc or unicodedata.normalize("NFC", x) == x)
            if self.here[c]:
                self.kinds[c], self.lowered[c] = _kind(x), ord(x)
        self.here[TOP - 1] = False
        self.masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
        self.table, self.long = Table(), {}

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, pieces: list[bytes]) -> list[list[int]]:
        merge, alphabet = self.merge, self.alphabet
        return [[t.id for t in merge(x.decode("latin-1").translate(alphabet))] for x in pieces]

    def _read(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts on end, each with a zero byte after it, in lower case if the vocabulary asks for that; every
        byte's kind (a character's bytes have the same); and which texts are left to the library."""
        buf = np.frombuffer(bytearray(b"\0".join([*data, b""])), np.uint8)
        strange = np.zeros(len(data), bool)
        ends = np.cumsum([len(x) + 1 for x in data])
        plain = np.where(self.here[:128], self.kinds[:128], 255).astype(np.uint8)
        plain[0] = END
        kinds = np.concatenate([plain, np.zeros(128, np.uint8)])[buf]
        bad = [np.flatnonzero(kinds == 255)]
        lead = np.flatnonzero(buf >= 0xC0)
        if len(lead):
            two, three = lead[buf[lead] < 0xE0], lead[(buf[lead] >= 0xE0) & (buf[lead] < 0xF0)]
            bad.append(lead[buf[lead] >= 0xF0])
            byte = lambda at, mask: (buf[at] & np.uint8(mask)).astype(np.int64)
            codes = byte(two, 31) << 6 | byte(two + 1, 63), byte(three, 15) << 12 | byte(three + 1, 63) << 6 | byte(three + 2, 63)
            for at, code, more in ((two, codes[0], (1,)), (three, codes[1], (1, 2))):
                ok = self.here[np.minimum(code, TOP - 1)]
                bad.append(at[~ok])
                at, code = at[ok], code[ok]
                for i in (0, *more):
                    kinds[at + i] = self.kinds[code]
                if self.lower and more == (1,):
                    low = self.lowered[code]
                    buf[at], buf[at + 1] = 0xC0 | low >> 6, 0x80 | low & 63
        zeros = np.flatnonzero(buf == 0)
        if len(zeros) > len(data):
            bad.append(np.setdiff1d(zeros, ends - 1))
        bad = np.concatenate(bad)
        if len(bad):
            strange[np.searchsorted(ends, bad, "right")] = True
        if self.lower:
            buf = np.concatenate([self.lowered[:128], np.arange(128, 256)]).astype(np.uint8)[buf]
        return buf, kinds, strange

    def _starts(self, buf: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Where a pre-token, white space or a text's end begins. buf ends in zeros, of which the first has the kind END."""
        n = len(kinds)
        begins = np.empty(n, bool)
        begins[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
        begins |= kinds == END
        quote = np.flatnonzero(buf[:n] == APOSTROPHE)
        quote = quote[begins[quote]]
        if not self.word_ends:
            # white space before something leaves its last character, and a blank goes with what follows
            last = (kinds[:-1] == SPACE) & (kinds[1:] > SPACE)
            begins[:-1] |= last
            begins[1:] &= ~(last & (buf[: n - 1] == BLANK))
            quote = quote[begins[quote]]
        else:
            begins |= kinds == NUMBER
            inside = (buf[:n] & 0xC0) == 0x80
            begins &= ~inside
        for s in SUFFIXES:
            at = quote
            for i, c in enumerate(s):
                at = at[buf[at + 1 + i] == c]
            begins[at + 1] = False
            begins[at + 1 + len(s)] = True
        return np.flatnonzero(begins)

    def _split_here(self, data: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids on end, the end id after each text, and their number by text; and which texts are left to the library (of no use here)."""
        buf, kinds, strange = self._read(data)
        if strange.any():
            return np.empty(0, np.uint32), np.empty(0, np.int64), strange
        n = len(buf)
        buf = np.concatenate([buf, np.zeros(24, np.uint8)])
        starts = self._starts(buf, kinds)
        size = np.diff(np.append(starts, n))
        kind = kinds[starts]
        if self.word_ends:
            keep = kind != SPACE
            starts, size, kind = starts[keep], size[keep], kind[keep]
        eight = np.ndarray((n + 16,), "<u8", buf, strides=(1,))
        lo = eight[starts] & self.masks[np.minimum(size, 8)]
        hi = eight[starts + 8] & self.masks[np.clip(size - 8, 0, 8)]
        ended, far = kind == END, size > 16
        special = np.flatnonzero(ended | far)
        if self.table.entries > KEPT:
            self.table = Table()
        entry = self.table.find(lo, hi)
        entry[special] = 0
        new = np.flatnonzero(entry < 0)
        if len(new):
            order = new[np.lexsort((hi[new], lo[new]))]
            a, b = lo[order], hi[order]
            first = np.ones(len(order), bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b = a[first], b[first]
            raw = np.stack([a, b], 1).astype("<u8").tobytes()
            self.table.add(a, b, self._merged([raw[i : i + 16].rstrip(b"\0") for i in range(0, len(raw), 16)]))
            entry[new] = self.table.find(lo[new], hi[new])
        if not len(special):
            raise AssertionError("every text has an end")
        # The ends and long pre-tokens get entries of their own behind the table's.
        mine, of = [[end]], np.zeros(len(special), np.int64)
        for k in np.flatnonzero(far[special]).tolist():
            at = int(starts[special[k]])
            piece = buf[at : at + int(size[special[k]])].tobytes()
            ids = self.long.get(piece)
            if ids is None:
                ids = self._merged([piece])[0]
                if len(piece) <= 64:
                    if len(self.long) > 20_000:
                        self.long.clear()
                    self.long[piece] = ids
            of[k] = len(mine)
            mine.append(ids)
        t = self.table
        counts = t.count[entry].astype(np.int64)
        begin = t.begin[entry]
        own = np.fromiter(map(len, mine), np.int64, len(mine))
        counts[special] = own[of]
        begin[special] = t.used + (np.cumsum(own) - own)[of]
        pool = np.concatenate([t.ids[: t.used], np.fromiter((i for x in mine for i in x), np.uint32, int(own.sum()))])
        stops = np.cumsum(counts)
        at = np.repeat(begin - (stops - counts), counts)
        at += np.arange(len(at))
        by_text = np.diff(stops[np.flatnonzero(ended)], prepend=0)
        return pool[at], by_text, strange

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, the end id after each, and their number by text."""
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        odd = {i for i, x in enumerate(data) if any(s in x for s in self.special)}
        plain = [i for i in range(len(texts)) if i not in odd]
        ids, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        while plain:
            ids, counts, strange = self._split_here([data[i] for i in plain], end)
            if not strange.any():
                break
            odd.update(i for i, s in zip(plain, strange.tolist()) if s)
            plain = [i for i, s in zip(plain, strange.tolist()) if not s]
        if not odd:
            return ids, counts
        parts: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        for i, x in zip(plain, np.split(ids, np.cumsum(counts)[:-1]) if plain else []):
            parts[i] = x
        left = sorted(odd)
        for i, x in zip(left, self._library([texts[i] for i in left])):
            parts[i] = np.append(x, np.uint32(end))
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary file."""
    return process_state(("encoder", path), lambda: Encoder(path))


def binary_column(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each text's ids as little-endian unsigned 32-bit integers."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(little_endian(ids))]).cast(pa.binary())


def chunks(texts: list[str], chars: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many characters, so that what is held at once is bounded by that and one text."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
