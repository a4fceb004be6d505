"""Ids of whole texts by a public BPE tokenizer that drops white space, in Arrow batches.

The tokenizer treats what stands between white space (a chunk) independently.
Chunks of plain characters (ASCII and Latin-1 letters, for which the file's
normaliser and splitter are a lower-casing and one pattern) are cut into the
tokenizer's words by numpy over the bytes of a block of texts, and white space is
left out; any other chunk is one segment and goes through the whole library. Arrow's
dictionary encoding finds a block's distinct segments, each is looked up once, and
only new ones are tokenized: plain words, lower-cased and cut already, by the file's
model with the library's splitter at white space in place of the pattern. A text's
ids are gathered by numpy. The ids equal those of encoding the whole text.

The segments' ids are kept in a memo bounded by its bytes; long segments, which
hardly come again, are not kept. Plain words of at most 16 bytes, nearly all, are two
numbers each in a table that numpy looks up; other segments are in a dict. When the
memo is full, segments that more than one block had stay.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from tillscope.llm.common import runs
from tillscope.llm.shingles import is_space

#: Bytes of segments and ids kept at most, about. Longer segments are not kept.
MEMO, LONGEST = 32 << 20, 64
#: What an entry of the memo takes besides its ids, about; in the dict it takes more, besides its bytes.
ENTRY, IN_DICT = 50, 100
#: Bytes of text encoded at once, about (a longer text is encoded alone); some thirty times that is held meanwhile.
ENCODED = 1 << 20
#: Words given to the library at once.
AT_ONCE = 4096

# classes of bytes: a letter run and a run of other characters are words, a digit is one by itself
_SPACE, _LETTER, _DIGIT, _OTHER, _LEAD, _ODD = range(6)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[np.flatnonzero(is_space(np.arange(256, dtype=np.uint8)))] = _SPACE
_CLASS[0xC3] = _LEAD
_CLASS = _CLASS.tobytes()
#: Second bytes of the Latin-1 letters (after C3): all but the signs of multiplication and division.
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: What the splitter takes after an apostrophe that begins a run of other characters. Fixed values.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def segments(data: bytes, added: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes without white space and with plain chunks lower-cased, where segments start in them, which are odd
    chunks, and where white space was."""
    raw = np.frombuffer(data, np.uint8)
    kind = np.frombuffer(bytearray(data.translate(_CLASS)), np.uint8)
    odd = kind == _ODD
    lead = np.flatnonzero(kind == _LEAD)
    low = np.frombuffer(bytearray(data.translate(_LOWER)), np.uint8)
    if len(lead):
        second = lead + 1
        fine = (second < len(raw)) & _SECOND[raw[np.minimum(second, len(raw) - 1)]]
        kind[lead] = _LETTER
        kind[second[fine]] = _LETTER
        odd[lead[~fine]] = True
        odd[second[fine]] = False
        capital = second[fine][raw[second[fine]] < 0x9F]  # C3 80 to C3 9E, without the sign
        low[capital] += 32
    start = np.empty(len(raw), bool)
    start[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == _DIGIT
    # a lone apostrophe before a letter: some endings belong to it
    mark = np.flatnonzero(raw == 39)
    mark = mark[start[mark] & (mark + 1 < len(raw))]
    mark = mark[kind[mark + 1] == _LETTER]
    for end in ENDINGS if len(mark) else ():
        at = mark[mark + len(end) < len(raw)]
        for k, c in enumerate(end.encode(), 1):
            at = at[low[at + k] == c]
        start[at + 1] = False
        past = at + 1 + len(end)
        start[past[past < len(raw)]] = True
    for token in added:
        i = data.find(token)
        while i >= 0:
            odd[i] = True
            i = data.find(token, i + 1)
    odd_at = np.flatnonzero(odd)
    space = kind == _SPACE
    blanks, kept = np.flatnonzero(space), ~space
    if not len(odd_at):
        return low[kept], np.flatnonzero(start[kept]), np.zeros(0, np.int64), blanks
    # chunks with an odd byte stay as they are, whole
    edge = np.flatnonzero(np.diff(space, prepend=True))  # starts of chunks and of the space after each
    first = edge[::2]
    last = np.append(edge[1::2], len(raw))[:len(first)]
    which = np.unique(np.searchsorted(first, odd_at, "right") - 1)
    inside = runs(first[which], last[which] - first[which])
    low[inside] = raw[inside]
    start[inside] = False
    start[first[which]] = True
    starts = np.flatnonzero(start[kept])
    return low[kept], starts, np.searchsorted(starts, first[which] - np.searchsorted(blanks, first[which])), blanks


#: The first k bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def numbers(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eight bytes of each run as a number, and the next eight."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[:len(data)] = data
    eight = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
    return (eight[starts] & _FIRST[np.minimum(lengths, 8)],
            eight[starts + 8 * (lengths > 8)] & _FIRST[np.clip(lengths - 8, 0, 8)])


class ChunkEncoder:
    def __init__(self, path: str, end_id: int, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's one core
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        # for words that are lower-cased and cut already
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self.end_id, self.memo = end_id, memo
        self.reset()

    def reset(self) -> None:
        self.place: dict[bytes, int] = {}
        # the end id
        self.starts, self.lengths = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.flat = np.array([self.end_id], np.uint32)
        self.again = np.zeros(1, bool)  # looked up since it was learned or kept
        self.low, self.high = np.zeros(1, np.uint64), np.zeros(1, np.uint64)  # plain short words; else 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.held = 0

    def shrink(self) -> None:
        """Only segments that were looked up again stay, or none if they are half the memo."""
        at = np.flatnonzero(self.again)
        n, in_dict = self.lengths[at], {s: k for s, k in self.place.items() if self.again[k]}
        held = 4 * int(n.sum()) + ENTRY * len(at) + sum(map(len, in_dict)) + IN_DICT * len(in_dict)
        ids, low, high = self.flat[runs(self.starts[at], n)], self.low[at], self.high[at]
        self.reset()
        if held <= self.memo // 2:
            self._put(ids, n, low, high)
            self.place = dict(zip(in_dict, (np.searchsorted(at, np.array([*in_dict.values()], np.int64)) + 1).tolist()))
            self.held = held

    def _put(self, ids: np.ndarray, lengths: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Segments behind those known; the plain short words among them go to the table."""
        new = len(self.starts) + np.flatnonzero(low)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, ids])
        self.again = np.concatenate([self.again, np.zeros(len(lengths), bool)])
        self.low, self.high = np.concatenate([self.low, low]), np.concatenate([self.high, high])
        self.held += 4 * len(ids) + ENTRY * len(lengths)
        if 2 * len(self.starts) > len(self.slots):
            self.slots = np.full(1 << (4 * len(self.starts)).bit_length(), -1, np.int32)
            new = np.flatnonzero(self.low)
        slot = self._slot(self.low[new], self.high[new])
        while len(new):  # a taken slot sends on to the next
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]
            on = self.slots[slot] != new
            new, slot = new[on], (slot[on] + 1) % len(self.slots)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of plain short words; -1 if not known."""
        out, left, slot = np.full(len(low), -1, np.int64), np.arange(len(low)), self._slot(low, high)
        while len(left):
            place = self.slots[slot]
            same = (place >= 0) & (self.low[place] == low[left]) & (self.high[place] == high[left])
            out[left[same]] = place[same]
            on = (place >= 0) & ~same
            left, slot = left[on], (slot[on] + 1) % len(self.slots)
        return out

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of plain words: joined by spaces, a word ends where a token does that can end one."""
        flat = []
        for i in range(0, len(words), AT_ONCE):
            together = b" ".join(words[i:i + AT_ONCE]).decode()
            flat.append(np.array(self.plain.encode_batch_fast([together], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(flat or [np.zeros(0, np.uint32)])
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("the tokenizer does not end every word with a token of its own")
        return ids, np.diff(ends, prepend=0)

    def _chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of other chunks, each through the whole library."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in chunks],
                                                                 add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _learn(self, new: list[bytes], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of new segments, those that are no odd chunks first."""
        (a, na), (b, nb) = (self._words([w for w, x in zip(new, odd.tolist()) if not x]),
                            self._chunks([w for w, x in zip(new, odd.tolist()) if x]))
        return np.concatenate([a, b]), np.concatenate([na, nb])

    def _places(self, segments: pa.Array, odd_at: np.ndarray) -> np.ndarray:
        """Places of distinct segments; new ones are learned."""
        if not len(segments):
            return np.zeros(0, np.int64)
        _, offsets, data = segments.buffers()
        offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(segments.type) else np.int32)
        offsets = offsets[:len(segments) + 1].astype(np.int64)
        size = np.diff(offsets)
        odd = np.zeros(len(segments), bool)
        odd[odd_at] = True
        low, high = numbers(np.frombuffer(data, np.uint8)[:offsets[-1]], offsets[:-1], size)
        short = ~odd & (size <= 16)
        low[~short] = high[~short] = 0
        place = np.full(len(segments), -1, np.int64)
        place[short] = self._find(low[short], high[short])
        others = np.flatnonzero(~short)
        place[others] = [self.place.get(w, -1) for w in segments.take(pa.array(others)).to_pylist()]
        self.again[place[place >= 0]] = True
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            new, strange = segments.take(pa.array(unknown)).to_pylist(), odd[unknown]
            ids, lengths = self._learn(new, strange)
            order = np.argsort(strange, kind="stable")
            unknown = unknown[order]
            place[unknown] = np.arange(len(self.starts), len(self.starts) + len(unknown))
            self._put(ids, lengths, low[unknown], high[unknown])
            kept = [k for k in unknown[~short[unknown]].tolist() if size[k] <= LONGEST]
            self.place.update(zip(segments.take(pa.array(kept, pa.int64())).to_pylist(), place[kept].tolist()))
            self.held += int(size[kept].sum()) + IN_DICT * len(kept)
        return place

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and the offsets of the texts in them."""
        data = b"\n".join(texts)
        added = [t for t in self.added if t in data]  # hardly ever any
        low, starts, odd_at, blanks = segments(data, added)
        offsets = np.append(starts, len(low)).astype(np.int32 if len(low) < 2**31 else np.int64)
        kind = pa.binary() if offsets.dtype == np.int32 else pa.large_binary()
        listed = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low)])
        coded = listed.dictionary_encode()
        code, values = coded.indices.to_numpy(), coded.dictionary
        if self.held > self.memo:
            self.shrink()
        place = self._places(values, np.unique(code[odd_at]))
        # the end id stands behind each text, where the next one's separator is
        edges = np.cumsum([len(t) + 1 for t in texts]) - 1
        edges -= np.searchsorted(blanks, edges)
        at = np.insert(place[code], np.searchsorted(starts, edges), 0) if len(texts) else np.zeros(0, np.int64)
        lengths = self.lengths[at]
        ends = np.flatnonzero(at == 0) + 1
        upto = np.cumsum(lengths)
        return self.flat[runs(self.starts[at], lengths)], np.append(0, upto[ends - 1])


_ENCODERS: dict[tuple[str, int], ChunkEncoder] = {}


def encoder(path: str, end_id: int) -> ChunkEncoder:
    """One encoder for each worker process."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = ChunkEncoder(path, end_id)
    return _ENCODERS[path, end_id]


def word_bpe() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
