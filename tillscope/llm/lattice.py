"""Subword lattices over a public piece vocabulary, worked out by numpy for many words at once.

A word's lattice has an edge for each vocabulary piece that it contains; a
character that is no piece is spelled in bytes. ``forward`` sums the probability
of all paths in log space; ``expected`` gives each piece's expected count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tillscope.llm.common import splitmix

MARK = "▁"  # begins each word, as in the vocabulary
#: Cells (words x characters x piece lengths) worked on at once.
CELLS = 2_000_000


class Vocabulary:
    """Pieces of a SentencePiece model by hash, and its byte pieces."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.scores = np.array([sp.get_score(i) for i in range(self.size)])
        self.bytes = np.zeros(256, np.int64)
        pieces = []
        for i in range(self.size):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                pieces.append((sp.id_to_piece(i), i))
        self.longest = max(len(p) for p, _ in pieces)
        hashes = np.array([self._hash(p) for p, _ in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array([i for _, i in pieces])[order]
        assert len(np.unique(hashes)) == len(hashes)

    @staticmethod
    def _hash(piece: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = splitmix(h + np.uint64(ord(c)))
        return int(h[0])

    def prior(self) -> np.ndarray:
        """log probabilities from the stored scores: minus a piece's rank, weighted as 1 / (rank + 2.7)."""
        p = 1 / (2.7 - np.minimum(self.scores, 0))
        return np.log(p / p.sum())


class Lattice:
    """The lattices of words of one length (rows of code points)."""

    def __init__(self, vocabulary: Vocabulary, points: np.ndarray):
        self.v, (n, length) = vocabulary, points.shape
        self.points, self.n, self.length = points, n, length
        self.k = min(vocabulary.longest, length)
        self.piece = np.full((self.k, n, length), -1, np.int64)  # piece of k+1 characters from a place, or -1
        h = np.zeros((n, length), np.uint64)
        for k in range(self.k):
            h = splitmix(h[:, :length - k] + points[:, k:])
            at = np.minimum(np.searchsorted(vocabulary.hashes, h), len(vocabulary.hashes) - 1)
            self.piece[k, :, :length - k] = np.where(vocabulary.hashes[at] == h, vocabulary.ids[at], -1)
        self.spelled = self.piece[0] < 0  # characters spelled in bytes
        self.spellings = {c: np.array([vocabulary.bytes[x] for x in chr(c).encode("utf-8", "replace")])
                          for c in np.unique(points[self.spelled]).tolist()}

    def weights(self, logp: np.ndarray) -> np.ndarray:
        w = np.where(self.piece >= 0, logp[self.piece], -np.inf)
        for c, ids in self.spellings.items():
            w[0][self.spelled & (self.points == c)] = logp[ids].sum()
        return w

    def forward(self, w: np.ndarray) -> np.ndarray:
        """log of the summed probability of all paths up to each place; the last column is the words' marginal."""
        a = np.zeros((self.n, self.length + 1))
        for j in range(1, self.length + 1):
            k = np.arange(min(self.k, j))
            a[:, j] = np.logaddexp.reduce(a[:, j - 1 - k] + w[k, :, j - 1 - k].T, axis=1)
        return a

    def backward(self, w: np.ndarray) -> np.ndarray:
        b = np.zeros((self.n, self.length + 1))
        for i in range(self.length - 1, -1, -1):
            k = np.arange(min(self.k, self.length - i))
            b[:, i] = np.logaddexp.reduce(b[:, i + 1 + k] + w[k, :, i].T, axis=1)
        return b

    def expected(self, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected count of each piece over all paths of the words, each word ``counts`` times."""
        w = self.weights(logp)
        a, b = self.forward(w), self.backward(w)
        out = np.zeros(self.v.size)
        for k in range(self.k):
            m = self.length - k
            share = np.exp(a[:, :m] + w[k, :, :m] + b[:, k + 1:k + 1 + m] - a[:, -1:]) * counts[:, None]
            ids = self.piece[k, :, :m]
            good = ids >= 0
            out += np.bincount(ids[good], weights=share[good], minlength=self.v.size)
            if k == 0:
                for c, spelled in self.spellings.items():
                    np.add.at(out, spelled, share[self.spelled & (self.points == c)].sum())
        return out


def lattices(vocabulary: Vocabulary, words: list[str]) -> Iterator[tuple[np.ndarray, Lattice]]:
    """Lattices for all words (each given its mark), with the words' places in the list."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        step = max(1, CELLS // (length * min(vocabulary.longest, length)))
        for s in range(0, len(at), step):
            part = at[s:s + step]
            joined = "".join(MARK + words[i] for i in part.tolist())
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            yield part, Lattice(vocabulary, points.reshape(len(part), length))


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]
