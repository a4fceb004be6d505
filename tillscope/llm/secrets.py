"""Secret scans: fixed patterns, and strings of sensitive context that zstandard cannot compress.

The base patterns give assignments, access keys and hex runs. Beyond them, a
string near a sensitive word is a candidate; its novelty is the number of bytes
that it costs, as words, a compressor primed by the code around it (copies of
itself left out) and by a dictionary of the identifiers that are most frequent
in the corpus's sensitive documents, counted outside candidates and base values.
Names made of known words compress; a random string costs its own length and is
reported (kind ``novel``).

Spans are code points, end exclusive, of the whole match.

Results for odd input: a null or empty text has no spans (empty string);
repeated rows and null ids give a row each; an empty table gives no rows; a
text of any length is scanned whole; other columns are ignored by
``scan_secrets`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import give_back, id_text, text_bytes

#: The base patterns and least lengths. Fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "novel")

#: What a text must hold (lower case) for a pattern to be tried at all.
_ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_LONG_HEX = re.compile(rb"[0-9a-f]{%d}" % LEAST_HEX)

#: Words that make a context sensitive, as whole words in either case; a capital after a small letter begins a word.
SENSITIVE = re.compile(r"(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:api[_-]?key|access[_-]?key|private[_-]?key|"
                       r"auth|authorization|bearer|"
                       r"credentials?|passphrase|passwords?|passwd|pwd|secrets?|signature|tokens?)(?![A-Za-z])",
                       re.IGNORECASE | re.ASCII)
_SENSITIVE_HINTS = (b"key", b"auth", b"bearer", b"credential", b"passphrase", b"passw", b"pwd", b"secret",
                    b"signature", b"token")
#: Candidates begin within REACH characters after the word; CONTEXT characters around it prime the compressor.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
REACH, CONTEXT = 48, 200
#: A candidate has a letter: numbers, dates and rules of dashes are none.
_LETTER = re.compile(r"[A-Za-z]")
#: So many characters of a candidate are a copy of it when they stand in its context too (a candidate's least length).
COPY = 16
#: A candidate is reported when it adds so many compressed bytes, and so many for each of its own.
LEAST_BYTES, LEAST_SHARE = 10, 0.95
#: The identifier dictionary: the most frequent identifiers, so many at most.
DICTIONARY_WORDS = 4096
IDENTIFIER = re.compile(rb"[A-Za-z_]{3,24}")
#: Log of the bytes of the compressor's tables and window: the dictionary fits.
WINDOW = 17
_SIGNS, _HUMP = re.compile("[^a-z0-9]+"), re.compile("(?<=[a-z])(?=[A-Z])")


def _sensitive_text(low: bytes) -> bool:
    return any(h in low for h in _SENSITIVE_HINTS)


def _without_spans(raw: bytes, low: bytes, text: str) -> str:
    """The text with every candidate-like run and base value left out: a secret must not prime its own test."""
    parts, done = [], 0
    for start, end in sorted([(v, e) for _, _, e, v in base_spans(raw, low, text)]
                             + [m.span() for m in CANDIDATE.finditer(text)]):
        if start > done:
            parts.append(text[done:start])
        done = max(done, end)
    return " ".join([*parts, text[done:]])


def _identifiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words: dict[bytes, list[str]] = {}
        for t in text_bytes(b.column(0)):
            low = t.lower()
            if not _sensitive_text(low):
                continue
            text, digest = t.decode("utf-8", "replace"), hashlib.sha256(t).digest()
            if digest not in words and SENSITIVE.search(text):
                words[digest] = [w.decode() for w in set(IDENTIFIER.findall(_without_spans(t, low, text).encode()))]
        yield pa.RecordBatch.from_pydict({"digest": pa.array(words, pa.binary()),
                                          "words": pa.array(words.values(), pa.list_(pa.string()))})
    give_back()


def identifier_dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS) -> bytes:
    """The most frequent identifiers of all documents with a sensitive word, the most frequent last.

    Counted over the whole corpus, once for each distinct text, outside candidates
    and base values; ``words`` bounds what reaches the driver.
    """
    top = id_text(docs).select("text").mapInArrow(_identifiers, "digest binary, words array<string>") \
        .groupBy("digest").agg(F.first("words").alias("words")).select(F.explode("words").alias("word")) \
        .groupBy("word").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "word").limit(words).collect()
    return " ".join(r["word"] for r in reversed(top)).encode()


def word_form(candidate: str) -> str:
    """A candidate as the dictionary has words: small letters, parted at signs and at capitals after small ones."""
    return _SIGNS.sub(" ", _HUMP.sub(" ", candidate).lower())


class Novelty:
    """Compressed bytes that a string costs beside its surroundings or the identifier dictionary, whichever is less.

    Each primes a zstandard compressor, and the string is compressed alone in its
    word form: its cost does not depend on how well the surroundings compress.
    """

    def __init__(self, dictionary: bytes):
        import zstandard
        self.zstd = zstandard
        self.search = zstandard.ZstdCompressionParameters(
            window_log=WINDOW, hash_log=WINDOW, chain_log=WINDOW, search_log=5, min_match=4,
            strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.known = self._primed(dictionary)

    def _primed(self, dictionary: bytes):
        z = self.zstd
        data = z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT) if len(dictionary) >= 8 else None
        return z.ZstdCompressor(compression_params=self.search, dict_data=data)

    def __call__(self, context: str, candidate: str) -> int:
        word = word_form(candidate).encode()
        return min(len(c.compress(word)) - len(c.compress(b"")) for c in
                   (self.known, self._primed(word_form(context).encode())))


def base_spans(raw: bytes, low: bytes, text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of each base match."""
    spans = []
    if any(h in low for h in _ASSIGN_HINTS):
        spans += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text)
                  if len(m[2]) >= LEAST_ASSIGN]
    if b"AKIA" in raw:
        spans += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= LEAST_ACCESS]
    if _LONG_HEX.search(raw):
        spans += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)
                  if m.end() - m.start() >= LEAST_HEX]
    return spans


def _without_copies(around: str, candidate: str) -> str:
    """``around`` with each stretch of COPY or more characters of ``candidate`` blanked, at the same length."""
    parts, done = [], 0
    for m in CANDIDATE.finditer(around):
        for i in range(m.start(), m.end() - COPY + 1):
            if around[i:i + COPY] in candidate:
                if i > done:
                    parts.append(around[done:i])
                parts.append(" " * (i + COPY - max(i, done)))
                done = i + COPY
    return "".join([*parts, around[done:]])


def _context(text: str, start: int, end: int) -> str:
    """CONTEXT characters on both sides of a candidate, without copies of it or of parts of it.

    Copies that reach over the far ends are seen too: COPY - 1 characters more are looked at.
    """
    reach, candidate = CONTEXT + COPY - 1, text[start:end]
    return _without_copies(text[max(0, start - reach):start], candidate)[-CONTEXT:] + " " \
        + _without_copies(text[end:end + reach], candidate)[:CONTEXT]


def candidates(text: str) -> list[tuple[int, int]]:
    """Candidates near sensitive words, in the order of the text; the work is linear in its length.

    A candidate begins where a run of its characters does, or at the end of a
    sensitive word within one, and ends before the next sensitive word.
    """
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    words = [m.span() for m in SENSITIVE.finditer(text)]
    starts = [s for s, _ in words]
    found: set[tuple[int, int]] = set()
    k = 0  # the first run that ends behind the word
    for _, end in words:
        while k < len(runs) and runs[k][1] <= end:
            k += 1
        for j in range(k, len(runs)):  # few: each run has COPY characters, and all begin within REACH
            start, last = max(runs[j][0], end), runs[j][1]
            if start > end + REACH:
                break
            w = bisect_left(starts, start)
            if w < len(starts):
                last = min(last, starts[w])
            if last - start >= COPY:
                found.add((start, last))
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int, int]], novelty: Novelty) -> list[tuple[int, int, int, int]]:
    """Incompressible candidates that no base span touches."""
    found, k, taken = [], 0, []  # base spans in one line, those that meet made one
    for s, _, e, _ in sorted(base):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    for start, end in candidates(text):
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end or not _LETTER.search(text, start, end):
            continue
        n = novelty(_context(text, start, end), text[start:end])
        if n >= LEAST_BYTES and n >= LEAST_SHARE * (end - start):
            found.append((start, 3, end, start))
    return found


def find_spans(raw: bytes, novelty: Novelty) -> tuple[list, list]:
    """Base spans and all spans of a text, each by start, then kind."""
    low = raw.lower()
    sensitive = _sensitive_text(low)
    if not sensitive and b"AKIA" not in raw and not _LONG_HEX.search(raw):
        return [], []
    text = raw.decode("utf-8", "replace")
    base = sorted(base_spans(raw, low, text))
    return base, sorted(base + novel_spans(text, base, novelty)) if sensitive else base


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def _scan(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for b in batches:
            counts, shas, spans = [], [], []
            for t in text_bytes(b.column(1)):
                base, every = find_spans(t, novelty)
                counts.append([sum(x[1] == k for x in base) for k in range(3)])
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)),
                 pa.array(shas, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
        give_back()
    return run


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, the digest of the base spans, and all spans."""
    return id_text(docs).mapInArrow(
        _scan(identifier_dictionary(docs)),
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redacted(dictionary: bytes, at: int, size_at: int | None, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for b in batches:
            column, raw = b.column(at), text_bytes(b.column(at))
            out, sizes = column.to_pylist(), b.column(size_at).to_pylist() if size_at is not None else []
            for i, t in enumerate(raw):
                spans = find_spans(t, novelty)[1]
                if not spans:
                    continue
                text, parts, done = out[i], [], 0
                for start, end in sorted((v, e) for _, _, e, v in spans):
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, end)
                out[i] = "".join([*parts, text[done:]])
                if sizes:
                    sizes[i] = len(out[i])
            columns = list(b.columns)
            columns[at] = pa.array(out, column.type)
            if size_at is not None:
                columns[size_at] = pa.array(sizes, b.column(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)
        give_back()
    return run


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """All documents with the found values replaced by ``mark``; other columns and clean texts as they were.

    ``n_chars``, where the input has it, is set to the new length of a changed text.
    """
    names = docs.columns
    size_at = names.index("n_chars") if "n_chars" in names else None
    return docs.mapInArrow(_redacted(identifier_dictionary(docs), names.index("text"), size_at, mark), docs.schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
