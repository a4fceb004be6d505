import math
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from tillscope.llm import lm_score as M
from tillscope.llm import packing as K
from tillscope.llm import piece_fst as P
from tillscope.llm import token_orc as O
from tillscope.llm.encode import ChunkEncoder, word_bpe
from tillscope.llm.lattice import MARK, lattices, vocabulary
from tillscope.session import fresh_path

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer
    tokenizer, memo = Tokenizer.from_file(word_bpe()), {}

    def ids(t):
        if t not in memo:
            memo[t] = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        return memo[t]
    return ids


def test_a_packing_task_holds_little_besides_its_memo(monkeypatch):
    """Blocks of encoded text are small: two workers and the JVM share an executor's memory."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    import pyspark
    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    text = "so the mill by the river was sold to a man of the town " * 40
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "text": [text] * 3000})  # 6 MB
    run = K._pieces(word_bpe(), 1)
    tokens = sum(sum(b["length"].to_pylist()) for b in run(iter([batch.slice(0, 10)])))
    tracemalloc.start()
    try:
        assert sum(sum(b["length"].to_pylist()) for b in run(iter([batch]))) == 300 * tokens
        assert tracemalloc.get_traced_memory()[1] < 70 << 20
    finally:
        tracemalloc.stop()


def test_chunks_encode_as_whole_texts(rows, ids_of):
    enc = ChunkEncoder(word_bpe(), 1, memo=50)  # the memo starts anew again and again
    for i in range(0, len(rows), 7):
        part = [t or "" for _, t in rows[i:i + 7]]
        ids, offsets = enc.encode([t.encode() for t in part])
        for t, a, z in zip(part, offsets[:-1], offsets[1:]):
            assert np.array_equal(ids[a:z], ids_of(t))


def test_full_memo_keeps_segments_that_come_again(ids_of):
    """Words of every block are tokenized once, though each block's other words fill the memo."""
    learned = Counter()

    class Counting(ChunkEncoder):
        def _learn(self, new, odd):
            learned.update(new)
            return super()._learn(new, odd)

    enc = Counting(word_bpe(), 1, memo=20_000)
    common = "whenever don't 漢字 Élan 12 -- x\x1cy "
    for k in range(12):
        texts = [common + " ".join(f"w{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(90)), "", common]
        ids, offsets = enc.encode([t.encode() for t in texts])
        for t, a, z in zip(texts, offsets[:-1], offsets[1:]):
            assert np.array_equal(ids[a:z], ids_of(t))
    assert sum(n for s, n in learned.items() if len(s) == 5 and s[:1] == b"w") == 12 * 90
    assert enc.held <= 40_000 and len(enc.starts) < 12 * 90
    assert all(learned[s] == 1 for s in (b"whenever", "漢字".encode(), "élan".encode(), b"--"))


def test_plain_words_by_the_model_equal_the_library(ids_of):
    """Words of ASCII and Latin-1 letters, digits and signs, as the splitter by white space hands them to the model."""
    import random
    rng = random.Random(3)
    alphabet = "abcdeghiorstuvxyzABCXYZ" * 3 + "àéîõüßÿÀÉÖÞ×÷0123456789'-.,_#!\t\n\x0b  "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += ["", " ", "\n\n", " x", "x ", "'s", "it's", "''re", "<|endoftext|>a", "a<|startoftext|>", "e\u0301 é"]
    ids, offsets = ChunkEncoder(word_bpe(), 1).encode([t.encode() for t in texts])
    for t, a, z in zip(texts, offsets[:-1], offsets[1:]):
        assert np.array_equal(ids[a:z], ids_of(t)), repr(t)


def test_token_orc_round_trip(spark, odd, rows, ids_of):
    path = fresh_path(spark, "t-orc")
    O.write_tokens(odd, path, word_bpe())
    back = O.read_tokens(spark, path)
    got = O.digests(back).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(
        (i, len(ids_of(t)), zlib.crc32(ids_of(t))) for i, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))  # ascending, null ids first
    some = {r[0]: r[1] for r in O.lookup(spark, path, [rows[0][0], rows[9][0], -5]).collect()}
    assert set(some) == {rows[0][0], rows[9][0]} and some[rows[9][0]] == ids_of(rows[9][1]).tolist()
    plan = O.lookup(spark, path, [4])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan or "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id" in plan


def test_packing_is_whole_and_full(odd, rows, ids_of):
    got = K.pack_documents(odd, word_bpe()).collect()
    sequences, pieces = defaultdict(list), Counter()
    by_crc = defaultdict(list)
    for i, t in rows:
        by_crc[i, len(ids_of(t))].append(ids_of(t))
    for r in got:
        sequences[r["sequence_id"]].append(r)
        x = by_crc[r["doc_id"], r["doc_tokens"]][0]
        assert zlib.crc32(x[r["start"]:r["start"] + r["length"]]) == r["ids_crc32"]
        pieces[r["doc_id"]] += r["length"]
    total = Counter()
    for i, t in rows:
        total[i] += len(ids_of(t))
    assert pieces == total
    for v in sequences.values():
        at = 0
        for r in sorted(v, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= K.WINDOW and at & (at - 1) == 0  # no padding at all
        assert len({r["step_group"] for r in v}) == 1


@pytest.mark.parametrize("lengths", [[], [1], [2048], [2049, 1], [1500, 600, 30], [5] * 400,
                                     [300, 700, 1300, 90, 5000, 2047, 1, 1, 256, 512, 1024, 1025]])
def test_pack_covers_each_token_once(lengths):
    seen = Counter()
    for size, pieces in K.pack(lengths):
        assert sum(n for _, _, n in pieces) == size and size & (size - 1) == 0 and size <= K.WINDOW
        for i, s, n in pieces:
            assert n > 0
            seen.update((i, k) for k in range(s, s + n))
    assert seen == Counter((i, k) for i, n in enumerate(lengths) for k in range(n))


def test_step_groups_are_balanced():
    sizes = [2048] * 300 + [1024] * 77 + [256] * 31
    tokens = Counter()
    for size, k in zip(sizes, K.step_groups(sizes)):
        tokens[k] += size
    assert max(tokens.values()) - min(tokens.values()) <= 2048


def test_transducer_equals_the_library(odd, rows):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=M.piece_model())
    want = Counter()
    for i, t in rows:
        ids = sp.encode(t or "")
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4"))] += 1
    got = P.encode_and_check(odd, M.piece_model()).collect()
    assert Counter((r["doc_id"], r["n_pieces"], r["ids_crc32"]) for r in got) == want
    assert all(r["decodes"] for r in got)


def test_transducer_on_random_strings():
    import random

    import sentencepiece
    sp, fst, rng = sentencepiece.SentencePieceProcessor(model_file=M.piece_model()), P.PieceFst(M.piece_model()), \
        random.Random(5)
    alphabet = "aeinorstthlABC  ,.;-'\"0123456789é漢😀\n\t▁"
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert fst.encode(t) == sp.encode(t), repr(t)
        assert fst.decode(fst.encode(t)) == t.replace(MARK, " ")


def test_chunks_of_a_block_are_composed_together(monkeypatch):
    """Only long chunks take a path of their own; ids equal the library's, however the memo and the blocks fall."""
    import random

    import sentencepiece
    sp, rng, old = sentencepiece.SentencePieceProcessor(model_file=M.piece_model()), random.Random(8), P.PieceFst.shortest

    def only_long(self, chunk):
        assert len(chunk) > P.LONG, chunk
        return old(self, chunk)

    monkeypatch.setattr(P.PieceFst, "shortest", only_long)
    monkeypatch.setattr(P, "AT_ONCE", 200)
    alphabet = "aeinorstthl" * 3 + "ABC  ,.;-'\"0123456789éß漢😀\n\t▁\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(500)]
    texts += ["", " ", "\n", "▁", "x" * 64, "x" * 63, "ab" * 500 + " end", "the " * 50, "漢" * 70, "\n\n  \n a"]
    enc = P.Encoder(M.piece_model(), memo=60)
    for i in range(0, len(texts), 17):
        part = texts[i:i + 17]
        ids, offsets = enc.encode([t.encode() for t in part])
        for t, a, z in zip(part, offsets[:-1], offsets[1:]):
            assert ids[a:z].tolist() == sp.encode(t), repr(t)
        assert P._decode(enc.fst, ids, offsets, [t.encode() for t in part]) == [True] * len(part)
        assert P._decode(enc.fst, ids, offsets, [t.encode() + b"!" for t in part]) == [False] * len(part)
    bad = [b"a\xff b", b"c"]  # no UTF-8
    ids, offsets = enc.encode(bad)
    assert ids[:offsets[1]].tolist() == sp.encode("a\ufffd b") and P._decode(enc.fst, ids, offsets, bad) == [True, True]


def test_encode_and_decode_tables(spark, odd, rows):
    back = P.decode_documents(P.encode_documents(odd, M.piece_model()), M.piece_model()).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((i, (t or "").replace(MARK, " ")) for i, t in rows)


def paths(v, logp, word):
    """The marginal by listing every segmentation."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=M.piece_model())
    ids = {sp.id_to_piece(i): i for i in v.ids.tolist()}

    def total(s):
        if not s:
            return 1.0
        out = 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in ids:
                out += math.exp(logp[ids[s[:k]]]) * total(s[k:])
            elif k == 1:
                out += math.exp(sum(logp[v.bytes[b]] for b in s[0].encode())) * total(s[1:])
        return out
    return math.log(total(MARK + word))


def test_lattice_marginals_match_every_segmentation():
    v = vocabulary(M.piece_model())
    logp, words = v.prior(), ["the", "retitioning", "漢字x", "é", "ab1", "\x01", "there", "other"]
    for at, lattice in lattices(v, words):
        for i, got in zip(at.tolist(), lattice.forward(lattice.weights(logp))[:, -1]):
            assert got == pytest.approx(paths(v, logp, words[i]), rel=1e-9)
        counts = np.arange(1.0, len(at) + 1)
        characters = lattice.expected(logp, counts)
        assert characters.sum() > 0 and (characters >= 0).all()


def test_scores(odd, rows):
    got = M.score_documents(odd, M.piece_model()).collect()
    want = Counter((*x[:5], round(x[5], 6)) for x in brute.base_scores(rows))
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                    round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_fitted_weights_beat_the_stored_ones(spark, unique):
    """Held-out texts are likelier after the rounds of expected counts."""
    per = {}
    for rounds in (0, 2):
        old, M.ROUNDS = M.ROUNDS, rounds
        try:
            fit = M.fit
            M.fit = lambda w, p, n, _f=fit, _r=rounds: _f(w, p, n, _r) if _r else (vocabulary(p).prior(), math.log(0.01))
            held = [r for r in M.score_documents(unique, M.piece_model()).collect() if r["held_out"]]
        finally:
            M.fit, M.ROUNDS = fit, old
        per[rounds] = sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert per[2] > per[0]


def test_empty_tables(spark, empty):
    assert K.pack_documents(empty, word_bpe()).count() == 0
    path = fresh_path(spark, "t-orc")
    O.write_tokens(empty, path, word_bpe())
    assert O.read_tokens(spark, path).count() == 0
    assert M.score_documents(empty, M.piece_model()).count() == 0
    assert P.encode_and_check(empty, M.piece_model()).count() == 0
