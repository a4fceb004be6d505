"""Hierarchical multi-length packing of documents into training sequences.

Windows have the context sizes ``TIERS``, all powers of two. A document gives
its whole 2048-token windows at once; its rest is routed to the smallest tier
that holds it. Each tier is packed from the longest down: a window opened for a
document of its tier takes, best fit first, documents of this and the shorter
tiers into its gap. Gaps that no whole document fits are closed by cutting up
the emptiest windows, so that every window is exactly full; the one rest of a
block is cut into powers of two. The sequences of a block are then dealt to
step groups of nearly equal token counts, longest first.

Spark gives each task a split of the documents. A task packs its documents in
blocks of ``BLOCK`` tokens, so it holds a block's ids at most (or one document),
nothing is shuffled, and no padding grows with the number of blocks. A retried
task reads the same split and gives the same pieces.

Results for odd input: a null text counts as empty (its end id alone is a
piece); a very long one fills windows of its own; repeated rows and null ids
are packed like others; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tillscope.llm.common import blocks, give_back, id_text, text_bytes
from tillscope.llm.encode import ENCODED, encoder, word_bpe

TIERS = (2048, 1024, 512, 256)
WINDOW = TIERS[0]
BLOCK = 1 << 20
#: Bytes of text after which a block may end, about.
LOOKED_AT = 4 << 20
#: Tokens of a training step; the sequences of a block are dealt to steps of about this size.
STEP = 64 * WINDOW
END_ID = 1
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, window int, step_group long")

Piece = tuple[int, int, int]  # document's index in the block, start, length


class _Rests:
    """Rests of documents by length: the longest that fits is taken out in log time."""

    def __init__(self, rests: list[Piece]):
        self.by: dict[int, list[Piece]] = {}
        for p in rests:
            self.by.setdefault(p[2], []).append(p)
        self.lengths = sorted(self.by)

    def take(self, most: int, more_than: int = 0) -> Piece | None:
        k = bisect_right(self.lengths, most) - 1
        if k < 0 or self.lengths[k] <= more_than:
            return None
        n = self.lengths[k]
        piece = self.by[n].pop()
        if not self.by[n]:
            del self.by[n], self.lengths[k]
        return piece


def _close(open_windows: list[tuple[int, list[Piece]]]) -> list[tuple[int, list[Piece]]]:
    """Windows with gaps made full: the emptiest are cut up to fill the gaps of the fullest."""
    done, pool = [], []  # pool: (gap, number, size, pieces), least gap first
    for number, (size, pieces) in enumerate(open_windows):
        insort(pool, (size - sum(p[2] for p in pieces), number, size, pieces))
    donor: list[Piece] = []
    first = 0
    while first < len(pool):
        gap, _, size, pieces = pool[first]
        while gap:
            if not donor:
                if len(pool) - 1 == first:
                    break
                donor = pool.pop()[3]
            i, start, n = donor.pop()
            used = min(gap, n)
            pieces.append((i, start, used))
            if used < n:
                donor.append((i, start + used, n - used))
            gap -= used
        if gap:
            break
        done.append((size, pieces))
        first += 1
    rest = donor + [p for x in pool[first:] for p in x[3]]
    # one rest, shorter than a few windows: powers of two from the largest down
    left = sum(p[2] for p in rest)
    while left:
        size = min(WINDOW, 1 << (left.bit_length() - 1))
        pieces, gap = [], size
        while gap:
            i, start, n = rest.pop()
            used = min(gap, n)
            pieces.append((i, start, used))
            if used < n:
                rest.append((i, start + used, n - used))
            gap -= used
        done.append((size, pieces))
        left -= size
    return done


def pack(lengths: list[int]) -> list[tuple[int, list[Piece]]]:
    """Sequences (size, pieces) that hold every token of documents of these lengths once, all exactly full."""
    done, rests = [], []
    for i, n in enumerate(lengths):
        whole = n // WINDOW * WINDOW
        done += [(WINDOW, [(i, s, WINDOW)]) for s in range(0, whole, WINDOW)]
        if n > whole:
            rests.append((i, whole, n - whole))
    held, gaps = _Rests(rests), []
    for size, shorter in zip(TIERS, (*TIERS[1:], 0)):
        while first := held.take(size, shorter):  # the longest of this tier opens a window
            pieces, gap = [first], size - first[2]
            while gap and (p := held.take(gap)):
                pieces.append(p)
                gap -= p[2]
            (gaps if gap else done).append((size, pieces))
    return done + _close(gaps)


def step_groups(sizes: list[int]) -> list[int]:
    """A step for each sequence: the longest first, each to the step with the fewest tokens so far."""
    import heapq
    steps = [(0, k) for k in range(max(1, round(sum(sizes) / STEP)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        held, k = heapq.heappop(steps)
        out[i] = k
        heapq.heappush(steps, (held + sizes[i], k))
    return out


def _pieces(path: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")),
        ("window", pa.int32()), ("step_group", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc, base = encoder(path, end_id), TaskContext.get().partitionId() << 33
        sequence = step = 0
        doc_ids: list = []
        held: list[np.ndarray] = []  # the ids of each document of the block
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, step, doc_ids, held, tokens
            packed = pack([len(x) for x in held])
            steps = step_groups([size for size, _ in packed])
            rows: list[tuple] = []
            for k, (size, pieces) in enumerate(packed):
                offset = 0
                for i, start, n in pieces:
                    rows.append((doc_ids[i], start, n, zlib.crc32(held[i][start:start + n]), len(held[i]),
                                 base + sequence + k, offset, size, base + step + steps[k]))
                    offset += n
            sequence, step = sequence + len(packed), step + max(steps, default=-1) + 1
            doc_ids, held, tokens = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)],
                                              schema=schema)

        for b in batches:
            ids_of, texts = b.column(0).to_pylist(), text_bytes(b.column(1))
            for i, j in blocks(texts, LOOKED_AT):
                doc_ids += ids_of[i:j]
                for k, m in blocks(texts[i:j], ENCODED):
                    ids, offsets = enc.encode(texts[i + k:i + m])
                    ids = ids.astype("<u4", copy=False)
                    held += [ids[a:z] for a, z in zip(offsets[:-1], offsets[1:])]
                    tokens += len(ids)
                if tokens >= BLOCK:
                    yield flush()
        if held:
            yield flush()
        give_back()
    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, with window size and step group."""
    return id_text(docs).mapInArrow(_pieces(tokenizer, end_id), SCHEMA)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe())
