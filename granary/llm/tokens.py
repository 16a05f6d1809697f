"""Whole-text tokenisation on executors, with the ``tokenizers`` library."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_encoders: dict[str, "Encoder"] = {}


# Words of at most so many bytes are kept; a text with a longer one goes to the library whole.
_WIDE = 4
_LONGEST = 8 * _WIDE
_ODD = np.zeros(256, bool)
_ODD[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_POINT = np.isin(np.arange(256), [44, 46])
_LETTER = np.array([c < 128 and chr(c).isalpha() for c in range(256)])
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _other_space(raw: np.ndarray) -> np.ndarray:
    """Bytes that begin white space other than a space and a line feed, ASCII or not. The buffer ends in 4 spare bytes."""
    found = np.flatnonzero(_ODD[raw[:-4]])
    lead = np.flatnonzero((raw[:-4] == 0xC2) | ((raw[:-4] >= 0xE1) & (raw[:-4] <= 0xE3)))
    if len(lead):
        a, b, c = raw[lead], raw[lead + 1], raw[lead + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        rare = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        found = np.concatenate([found, lead[two | general | rare]])
    return found


class Encoder:
    """Ids of whole texts, exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Byte-level BPE never merges across the cuts between words, nor between a letter and a stop or comma
    before white space, so a word with the space before it always gets the same ids. Words are found by array operations on the bytes of many texts at once, and the
    library encodes each only when it is new; their ids are kept in a hash table of arrays, of at most
    ``keep`` words, and those met once are the first to go. A text with other white space than single
    spaces and line feeds, with a word of more than 32 bytes, or with the string of an added token (which the library takes for that token) goes to the
    library whole and teaches no words, and so does every text of a tokenizer that is not plain byte-level BPE.
    """

    def __init__(self, definition: str, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.keep = keep
        self.newline = self.whole("\n").tolist()
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {i: t.content for i, t in added.items()}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.added.values())))) if self.added else None
        # The short cut needs byte-level BPE and nothing else, and one id for a line feed that no word has.
        self.by_word = plain_bytes(json.loads(definition)) and len(self.newline) == 1 and all(t.special for t in added.values())
        self._fill(np.zeros((0, _WIDE), np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64))

    def _fill(self, rows: np.ndarray, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.n = 0
        self.rows = np.zeros((self.keep + 1024, _WIDE), np.uint64)
        self.ends = np.zeros(self.keep + 1025, np.int64)
        self.ids = np.zeros(4 * self.keep + 4096, np.uint32)
        self.seen = np.zeros(self.keep + 1024, np.int32)
        self.bits = max(12, int(2 * max(self.keep, 1)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.slot_hash = np.zeros(1 << self.bits, np.uint64)
        self._insert(rows, hashes, ids, lengths)

    def _insert(self, rows: np.ndarray, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        n, top = self.n + len(rows), int(self.ends[self.n]) + len(ids)
        if n > len(self.rows):
            more = n + n // 8
            self.rows = np.concatenate([self.rows[: self.n], np.zeros((more - self.n, _WIDE), np.uint64)])
            self.ends = np.concatenate([self.ends[: self.n + 1], np.zeros(more - self.n, np.int64)])
            self.seen = np.concatenate([self.seen[: self.n], np.zeros(more - self.n, np.int32)])
        if top > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.ends[self.n]], np.zeros(top + top // 8 - int(self.ends[self.n]), np.uint32)])
        self.rows[self.n : n] = rows
        self.ids[self.ends[self.n] : top] = ids
        self.ends[self.n + 1 : n + 1] = self.ends[self.n] + np.cumsum(lengths)
        entry = np.arange(self.n, n, dtype=np.int32)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.n = n
        last = len(self.slots) - 1
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            lost = self.slots[slot] != entry
            won = ~lost
            self.slot_hash[slot[won]] = hashes[won]
            entry, hashes, slot = entry[lost], hashes[lost], (slot[lost] + 1) & last

    def _find(self, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The entry of each word, or -1."""
        out = np.full(len(rows), -1, np.int64)
        at = np.arange(len(rows))
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        last = len(self.slots) - 1
        while len(at):
            entry = self.slots[slot]
            hit = (entry >= 0) & (self.slot_hash[slot] == hashes[at])
            same = hit.copy()
            same[hit] = (self.rows[entry[hit]] == rows[at[hit]]).all(axis=1)
            out[at[same]] = entry[same]
            on = (entry >= 0) & ~same
            at, slot = at[on], (slot[on] + 1) & last
        return out

    def _forget(self) -> None:
        """Keep the words met more than once since the last time, at most half of what is allowed."""
        seen = self.seen[: self.n]
        often = np.flatnonzero(seen > 1)
        often = np.sort(often[np.argsort(-seen[often], kind="stable")[: self.keep // 2]])
        lengths = np.diff(self.ends[: self.n + 1])[often]
        rows = self.rows[often]
        self._fill(rows, _mixed(rows), self.ids[_ranges(self.ends[often], lengths)], lengths)

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words, end to end, and how many each has. Words that do not come apart again at the line feeds between them are encoded one by one."""
        found, lengths = [], []
        parts = [words[k : k + 500] for k in range(0, len(words), 500)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([b"\n".join(p).decode() for p in parts], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.newline[0])
            if len(cuts) == len(part) - 1:
                lengths.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
                found.append(np.delete(ids, cuts))
            else:
                alone = [self.whole(w.decode()) for w in part]
                lengths.append(np.fromiter(map(len, alone), np.int64, len(alone)))
                found += alone
        return np.concatenate(found), np.concatenate(lengths)

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, uint32."""
        if not self.by_word:
            return [self.whole(x) for x in texts]
        if self.n > self.keep:
            self._forget()
        # Texts lie end to end, each before a byte that UTF-8 does not have.
        coded = [x.encode("utf-8", "replace") for x in texts]
        data = b"\xff".join(coded) + b"\xff" + b"\0" * _LONGEST
        raw = np.frombuffer(data, np.uint8)
        size = len(data) - _LONGEST
        text_ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) + 1) - 1
        space, feed = raw == 32, raw == 10
        mark = raw == 0xFF
        cut = space | feed | mark
        begins = cut.copy()
        begins[1:] |= (feed | mark)[:-1]
        # A stop or comma between a Latin letter and white space is a token of its own.
        point = np.flatnonzero(_POINT[raw[2:size]]) + 2
        a, b = raw[point - 2], raw[point - 1]
        after = _LETTER[b] | ((a == 0xC3) & (b >= 0x80) & (b < 0xC0) & (b != 0x97) & (b != 0xB7))
        begins[point[after & cut[point + 1]]] = True
        begins[0] = True
        start = np.flatnonzero(begins[:size])
        length = np.diff(np.append(start, size))
        # A space must lead a word, and a line feed must not follow white space.
        bad = (space[:-1] & cut[1:]) | (feed[:-1] & feed[1:])
        odd = np.concatenate([np.flatnonzero(bad[:size]), _other_space(raw[: size + 4]), start[length > _LONGEST]])
        words = np.minimum(length, _LONGEST)
        rows = np.empty((len(start), _WIDE), np.uint64)
        loads = np.lib.stride_tricks.as_strided(np.frombuffer(data, "<u8", 1), (len(data) - 7,), (1,))
        rows[:, 0] = loads[start] & _LOW[np.minimum(words, 8)]
        rows[:, 1:] = 0
        for k in range(1, _WIDE):
            long = np.flatnonzero(words > 8 * k)
            rows[long, k] = loads[start[long] + 8 * k] & _LOW[np.clip(words[long] - 8 * k, 0, 8)]
        hashes = _mixed(rows)
        at = self._find(rows, hashes)
        marks = np.flatnonzero(mark[start])
        missing = np.flatnonzero(at < 0)
        first = raw[start[missing]]
        missing = missing[(first != 0xFF) & (first != 10) & (length[missing] <= _LONGEST)]
        single = np.flatnonzero(space[start] & (length == 1))
        missing = np.setdiff1d(missing, single, assume_unique=True) if len(single) else missing
        # Texts that go to the library whole teach no words: theirs may be white space, or part of an added token.
        again = set(np.searchsorted(text_ends, odd, side="left").tolist())
        if self.marks:
            again.update(k for k, x in enumerate(texts) if self.marks.search(x))
        if again and len(missing):
            missing = missing[~np.isin(np.searchsorted(text_ends, start[missing], side="left"), list(again))]
        if len(missing):
            _, one, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            fresh = missing[one]
            clash = missing[(rows[missing] != rows[fresh[back]]).any(axis=1)]
            again.update(np.searchsorted(text_ends, start[clash], side="left").tolist())
            base = self.n
            self._insert(rows[fresh], hashes[fresh], *self._learn([data[a:b] for a, b in zip(start[fresh].tolist(), (start[fresh] + length[fresh]).tolist())]))
            at[missing] = base + back
        feeds = feed[start]
        use = np.maximum(at, 0)
        n = np.where(at >= 0, self.ends[use + 1] - self.ends[use], 0)
        self._count(at)
        n[feeds] = 1
        n[marks] = 0
        ids = self.ids[_ranges(np.where(feeds, 0, self.ends[use]), n)]
        total = np.concatenate([[0], np.cumsum(n)])
        ids[total[:-1][feeds]] = self.newline[0]
        stops = total[marks]
        out = np.split(ids, stops[:-1])
        for k in again:
            out[k] = self.whole(texts[k])
        return out

    def _count(self, at: np.ndarray) -> None:
        self.seen[: self.n] += np.bincount(at[at >= 0], minlength=self.n).astype(np.int32)

    def byte_lengths(self) -> np.ndarray:
        """Bytes of text that each id stands for; byte-level vocabularies write a byte as one character."""
        size = self.tokenizer.get_vocab_size()
        return np.array([len(self.added[i].encode()) if i in self.added else len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)


def plain_bytes(parts: dict) -> bool:
    """Whether a tokenizer's definition is byte-level BPE that cuts words by its own pattern alone: no normaliser, no other cut, nothing random or truncated."""
    cut, model = parts.get("pre_tokenizer") or {}, parts.get("model") or {}
    by_bytes = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    whole = not any(parts.get(k) for k in ("normalizer", "truncation", "padding"))
    bare = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return bool(by_bytes and whole and model.get("type", "BPE") == "BPE" and bare)


def _mixed(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for k in range(_WIDE):
        h = (h ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - n), n)


def encoder(definition: str) -> Encoder:
    """One encoder for a definition in each Python worker, kept between tasks."""
    key = hashlib.md5(definition.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def definition(path: str) -> str:
    """The tokenizer file, read on the driver; executors need no such file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def portions(batches: Iterator[pa.RecordBatch], text: str, chars: int = 500_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut to about so many characters of text each, with the texts; null counts as empty."""
    for batch in batches:
        texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        begin, held = 0, 0
        for k, x in enumerate(texts):
            held += len(x)
            if held >= chars or k == len(texts) - 1:
                yield batch.slice(begin, k + 1 - begin), texts[begin : k + 1]
                begin, held = k + 1, 0
