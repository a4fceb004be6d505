"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a model file and composed with each input:

* the normaliser (a mark before the text, marks for spaces),
* the pieces, a trie whose final states emit an id at the piece's cost, and the
  byte fallback, which spells any other character in byte pieces, and
* the merge constraint, whose state is the last piece emitted: it gives an arc
  for a next piece the weight 0 if merging would leave the two pieces side by
  side, and infinity (no arc) if it would join across them.

The shortest path in the tropical semiring (min, +) through the composition is
the encoding. For a byte-pair model the constraint leaves one accepting path,
the one that merging by score gives, so the ids equal the model's own encoding.

No piece holds a mark after another character, nor a line break, so the input
is cut there and a chunk's path is worked out once per worker (a bounded memo).
The new chunks of a block are composed together: numpy walks the trie from all
their characters at once, then relaxes the arcs of all chunks from their first
places, their second places and so on; long chunks are composed one by one.

Results for odd input: a null or empty text has no pieces; repeated rows and
null ids give a row each; an empty table gives no rows; a text of any length is
encoded whole; other columns are ignored. Decoding undoes encoding except that
a mark character in the text comes back as a space.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tillscope.llm.common import blocks, id_text, runs, text_bytes
from tillscope.llm.lattice import MARK
from tillscope.llm.lm_score import piece_model

#: Chunks kept at most; the memo then starts anew.
MEMO = 800_000
#: Characters of a chunk composed together with others, and characters composed at once, about.
LONG, AT_ONCE = 64, 1 << 18
#: Bits of the table of merge constraints looked up by numpy.
KNOWN = 20
CHUNK = re.compile(rf"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


class PieceFst:
    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.bytes = [0] * 256
        self.text = [b""] * sp.get_piece_size()  # what each id decodes to
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.text[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p] = i
                self.text[i] = p.replace(MARK, " ").encode()
        self.cost = {p: -sp.get_score(i) for p, i in self.ids.items()}
        assert not any("\n" in p or MARK in p.lstrip(MARK) for p in self.ids), "chunks would cut a piece"
        # the trie of the pieces: a node is a dict of its arcs, with a piece under "" where it is final
        self.trie: dict = {}
        for p in self.ids:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.side_by_side: dict[tuple[str, str], bool] = {}
        self._tables()

    def _tables(self) -> None:
        """The trie and the pieces as arrays. A piece has its number; a character spelled in bytes that of its code
        point behind them; no piece at all is one less than the first."""
        self.names = list(self.ids)
        number = {p: k for k, p in enumerate(self.names)}
        self.id_of = np.fromiter(self.ids.values(), np.int32, len(self.names))
        self.cost_of = np.fromiter((self.cost[p] for p in self.names), np.float64, len(self.names))
        # nodes with arcs first: a row of arcs each, by the class of the character
        inner, leaves, arcs = [], [], []
        queue = [("", self.trie)]
        while queue:
            name, node = queue.pop()
            more = [(name + c, x) for c, x in node.items() if c]
            (inner if more else leaves).append(name)
            arcs += [(name, c, name + c) for c in node if c]
            queue += more
        place = {name: k for k, name in enumerate(inner + leaves)}
        self.inner = len(inner)
        self.piece_at = np.array([number.get(name, -1) for name in place], np.int32)
        self.first = np.full(sys.maxunicode + 1, -1, np.int32)  # nodes by their only character
        self.kind = np.zeros(sys.maxunicode + 1, np.uint16)
        later = sorted({c for name, c, _ in arcs if name})
        self.kind[[ord(c) for c in later]] = range(1, len(later) + 1)
        self.arcs = np.full((self.inner, len(later) + 1), -1, np.int32)
        for name, c, to in arcs:
            if name:
                self.arcs[place[name], self.kind[ord(c)]] = place[to]
            else:
                self.first[ord(c)] = place[to]
        self.known_key = np.full(1 << KNOWN, -1, np.int64)
        self.known = np.zeros(1 << KNOWN, bool)
        # what the ids decode to, one after the other
        self.text_lengths = np.fromiter(map(len, self.text), np.int64, len(self.text))
        self.text_starts = np.cumsum(self.text_lengths) - self.text_lengths
        self.text_flat = np.frombuffer(b"".join(self.text), np.uint8)

    def _name(self, k: int) -> str:
        return "" if k < 0 else self.names[k] if k < len(self.names) else chr(k - len(self.names))

    def all_allowed(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """``allowed`` for numbers of pieces; answers are kept in a table where a later pair may take a place."""
        width = len(self.names) + sys.maxunicode + 1
        key = (last + 1) * width + piece
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - KNOWN)).astype(np.int64)
        out, missed = self.known[slot], np.flatnonzero(self.known_key[slot] != key)
        if len(missed):
            new, which = np.unique(key[missed], return_inverse=True)
            found = np.fromiter((self.allowed(self._name(k // width - 1), self._name(k % width)) for k in new.tolist()),
                                bool, len(new))[which]
            out[missed] = found
            self.known_key[slot[missed]], self.known[slot[missed]] = key[missed], found
        return out

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves: the cheapest neighbours that form a piece first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = min(((self.cost[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.cost),
                       default=None)
            if best is None:
                return parts
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    def allowed(self, last: str, piece: str) -> bool:
        """The merge constraint's arc from ``last`` ("" at the start) by ``piece``."""
        key = (last, piece)
        found = self.side_by_side.get(key)
        if found is None:
            if len(self.side_by_side) > 1_000_000:
                self.side_by_side.clear()
            found = self.merged(last + piece) == ([last, piece] if last else [piece])
            self.side_by_side[key] = found
        return found

    def shortest(self, chunk: str) -> list[int]:
        """Ids on the shortest path through the composition with a normalised chunk."""
        n, inf = len(chunk), float("inf")
        dist, last, back = [0.0] + [inf] * n, [""] * (n + 1), [0] * (n + 1)
        known, trie = self.side_by_side, self.trie
        for i in range(n):
            d, before = dist[i], last[i]
            if d == inf:
                continue
            node, j = trie, i
            while j < n and (node := node.get(chunk[j])) is not None:
                j += 1
                piece = node.get("")
                if piece is not None:
                    new = d + self.cost[piece]
                    if new < dist[j]:
                        ok = known.get((before, piece))
                        if ok or ok is None and self.allowed(before, piece):
                            dist[j], last[j], back[j] = new, piece, i
            if chunk[i] not in self.ids and self.allowed(before, chunk[i]) and d < dist[i + 1]:
                dist[i + 1], last[i + 1], back[i + 1] = d, chunk[i], i  # spelled in bytes
        out: list[int] = []
        while n:
            p = last[n]
            found = self.ids.get(p)
            out += [found] if found is not None else [self.bytes[b] for b in reversed(p.encode("utf-8", "replace"))]
            n = back[n]
        return out[::-1]

    def shortest_of_all(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of normalised chunks (none empty) one after the other, and how many each has."""
        numbers, count = [], []  # of pieces
        at = 0
        while at < len(chunks):
            to, held = at, 0
            while to < len(chunks) and held < AT_ONCE and len(chunks[to]) <= LONG:
                held += len(chunks[to])
                to += 1
            if to > at:
                found, n = self._together(chunks[at:to])
                numbers.append(self._spelled(found, n))
                at = to
            else:  # a long one
                ids = np.array(self.shortest(chunks[at]), np.int32)
                numbers.append((ids, np.array([len(ids)])))
                at += 1
        for_ids, count = zip(*numbers) if numbers else ([np.zeros(0, np.int32)], [np.zeros(0, np.int64)])
        return np.concatenate(for_ids), np.concatenate(count)

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces on the shortest paths, and how many each chunk has."""
        char = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        end = np.cumsum(size)
        chunk = np.repeat(np.arange(len(chunks)), size)
        left = end[chunk] - np.arange(len(char))  # characters to the chunk's end
        # arcs: the trie walked from every character
        begin = np.arange(len(char))
        node = self.first[char]
        single = np.where(node < 0, -1, self.piece_at[node])
        spelled = np.flatnonzero(single < 0)
        starts, lengths = [spelled], [np.ones(len(spelled), np.int64)]
        pieces, costs = [len(self.names) + char[spelled].astype(np.int64)], [np.zeros(len(spelled))]
        begin, node, n = begin[node >= 0], node[node >= 0], 1
        while len(begin):
            piece = self.piece_at[node]
            final = np.flatnonzero(piece >= 0)
            starts.append(begin[final])
            lengths.append(np.full(len(final), n))
            pieces.append(piece[final].astype(np.int64))
            costs.append(self.cost_of[piece[final]])
            more = (node < self.inner) & (left[begin] > n)
            begin = begin[more]
            node = self.arcs[node[more], self.kind[char[begin + n]]]
            begin, node, n = begin[node >= 0], node[node >= 0], n + 1
        start, length, piece, cost = map(np.concatenate, (starts, lengths, pieces, costs))
        # by the place in the chunk where they start
        place = (size[chunk[start]] - left[start]).astype(np.uint8)
        order = np.argsort(place, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(place))])
        source = (start + chunk[start])[order]  # a chunk has a state more than characters
        target, piece, cost = source + length[order], piece[order], cost[order]
        states = len(char) + len(chunks)
        first = end - size + np.arange(len(chunks))
        dist, last, back = np.full(states, np.inf), np.full(states, -1, np.int64), np.full(states, -1, np.int64)
        dist[first] = 0.0
        for a, z in zip(bounds[:-1], bounds[1:]):  # no two arcs of a place end in the same state
            d = dist[source[a:z]] + cost[a:z]
            shorter = a + np.flatnonzero(d < dist[target[a:z]])
            shorter = shorter[self.all_allowed(last[source[shorter]], piece[shorter])]
            to = target[shorter]
            dist[to], last[to], back[to] = d[shorter - a], piece[shorter], source[shorter]
        now = first + size
        if not np.isfinite(dist[now]).all():
            raise ValueError("a chunk has no path")
        whose, found = np.arange(len(chunks)), []
        count = np.zeros(len(chunks), np.int64)
        while len(now):
            found.append((whose, last[now]))
            count[whose] += 1
            now = back[now]
            more = now != first[whose]
            whose, now = whose[more], now[more]
        out, behind = np.empty(int(count.sum()), np.int64), np.cumsum(count)
        for k, (whose, number) in enumerate(found, 1):  # from the last piece to the first
            out[behind[whose] - k] = number
        return out, count

    def _spelled(self, numbers: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for numbers of pieces, and how many each chunk has."""
        odd = np.flatnonzero(numbers >= len(self.names))
        if not len(odd):
            return self.id_of[numbers], count
        spelled = [[self.bytes[b] for b in self._name(k).encode("utf-8", "replace")] for k in numbers[odd].tolist()]
        size = np.ones(len(numbers), np.int64)
        size[odd] = list(map(len, spelled))
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = np.empty(int(upto[-1]), np.int32)
        plain = numbers < len(self.names)
        ids[upto[:-1][plain]] = self.id_of[numbers[plain]]
        ids[runs(upto[odd], size[odd])] = [i for x in spelled for i in x]
        return ids, np.diff(upto[np.concatenate([[0], np.cumsum(count)])])

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        return self.text_flat[runs(self.text_starts[ids], self.text_lengths[ids])].tobytes()

    def normal(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def encode(self, text: str) -> list[int]:
        return [i for c in CHUNK.findall(self.normal(text)) for i in self.shortest(c)]

    def decode(self, ids) -> str:
        """The text of a sequence of ids; bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.text.__getitem__, ids))
        return data[1:].decode("utf-8", "replace") if data[:1] == b" " else data.decode("utf-8", "replace")


def marked(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The normalised texts one after the other, a space standing for a mark, and where each begins and the last ends."""
    mark = MARK.encode()
    parts = [b" " + t.replace(mark, b" ") if t else b"" for t in texts]
    data = b"".join(parts)
    try:
        data.decode()
    except UnicodeDecodeError:
        parts = [p.decode("utf-8", "replace").encode() for p in parts]
        data = b"".join(parts)
    return data, np.cumsum([0, *map(len, parts)])


class Encoder:
    """Whole texts through a bounded memo of chunks."""

    def __init__(self, path: str, memo: int = MEMO):
        self.fst, self.memo = PieceFst(path), memo
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the offsets of the texts (UTF-8) in them."""
        data, edges = marked(texts)
        raw = np.frombuffer(data, np.uint8)
        space, line = raw == 32, raw == 10
        start = line.copy()
        start[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        start[edges[:-1][edges[:-1] < len(raw)]] = True
        starts = np.flatnonzero(start)
        offsets = np.append(starts, len(raw))
        kind = pa.large_binary() if len(raw) >= 2**31 else pa.binary()
        listed = pa.Array.from_buffers(kind, len(starts), [
            None, pa.py_buffer(offsets.astype(np.int64 if len(raw) >= 2**31 else np.int32)), pa.py_buffer(data)])
        coded = listed.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.place) > self.memo:
            self.reset()
        place = np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            new = [distinct[k] for k in unknown.tolist()]
            ids, lengths = self.fst.shortest_of_all([c.decode().replace(" ", MARK) for c in new])
            place[unknown] = np.arange(len(self.starts), len(self.starts) + len(new))
            self.place.update(zip(new, place[unknown].tolist()))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, ids])
        at = place[coded.indices.to_numpy()]
        lengths = self.lengths[at]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[runs(self.starts[at], lengths)], upto[np.searchsorted(starts, edges)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            raw = text_bytes(b.column(1))
            for i, j in blocks(raw):
                ids, offsets = enc.encode(raw[i:j])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                    names=["doc_id", "ids"])
    return run


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every whole text."""
    return id_text(docs).mapInArrow(_encode_rows(path), "doc_id long, ids array<int>")


def _decode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = encoder(path).fst
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([fst.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())],
                names=["doc_id", "text"])
    return run


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids decode to the empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode_rows(path), "doc_id long, text string")


def _decode(fst: PieceFst, ids: np.ndarray, offsets: np.ndarray, texts: list[bytes]) -> list[bool]:
    """Whether the ids of each text decode to it again; the texts' bytes are compared, or where they differ the texts."""
    data, edges = marked(texts)
    back = fst.decoded(ids)
    at = np.concatenate([[0], np.cumsum(fst.text_lengths[ids])])[offsets]
    if np.array_equal(at, edges) and back == data:
        return [True] * len(texts)
    return [fst.decode(ids[x:y].tolist()) == t.decode("utf-8", "replace").replace(MARK, " ")
            for x, y, t in zip(offsets[:-1], offsets[1:], texts)]


def _round_trips(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        spelled = np.zeros(len(enc.fst.text), bool)
        spelled[enc.fst.bytes] = True
        for b in batches:
            raw = text_bytes(b.column(1))
            for i, j in blocks(raw):
                ids, offsets = enc.encode(raw[i:j])
                n_spelled = np.concatenate([[0], np.cumsum(spelled[ids])])[offsets]
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.diff(offsets)), pa.array(np.diff(n_spelled)),
                     pa.array([zlib.crc32(data[4 * x:4 * y]) for x, y in zip(offsets[:-1], offsets[1:])], pa.int64()),
                     pa.array(_decode(enc.fst, ids, offsets, raw[i:j]))],
                    names=["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decodes"])
    return run


def encode_and_check(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32, and whether decoding the ids gives the text again."""
    return id_text(docs).mapInArrow(
        _round_trips(path), "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decodes boolean")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_check(spark.read.parquet(f"{sf_dir}/documents.parquet"), piece_model())
