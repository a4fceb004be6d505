"""Spelling variants by asymmetric chunks: words one edit apart, grouped under their frequent forms.

A word is cut into two disjoint chunks, its halves. One edit (a code point put
in, taken out or replaced) leaves one of them whole, and moves it by one place at
most. So the shorter word of a near pair (either, at equal lengths) gives its two
chunks, and the other gives its positional grams at every place where a whole
chunk can stand: in a word as long, the places of the chunks; in a word longer by
one, the first chunk's place, and the second's shifted by one (an edit behind the
first chunk leaves that where it was, an edit within or before it shifts the
second). Other grams of the word cannot meet a chunk and are not sent. Chunks and
grams are joined on (length, chunk, text), and the words verified.

What is left of the two words, without the chunk they share, is again one edit
apart. Where a chunk is shared by so many words that their pairs would pass
``GROUP``, the rests are cut in two in the same way and both parts become the
key, until a group is small or the rests are single characters (a group is then
no larger than the alphabet). No pair within a hot group is made before that, and
none is lost.

Word counts come first: every text's runs are counted in the tasks and summed by
word. A word's form is its commonest near word, if that is ``RATIO`` times as
common; counts rise along forms, so chains end, and the root is found by doubling
jumps.

Results for odd input: a null or empty text has no words; a null ``doc_id`` reads
as empty text in the deletion rule; repeated rows count each; equal counts are
decided by code-point order; a text or run of any length is taken whole; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import id_text, text_bytes
from tillscope.session import materialize

#: Runs in UTF-8 with A-Z lower-cased; U+00C0 to U+00FF are C3 80 to C3 BF. The first is for texts of ASCII only.
ASCII_RUN, RUN = re.compile(rb"[a-z]+"), re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: The deletion rule's divisor, the least code points and occurrences of a word, and the ratio of a form. Fixed values.
DELETED, LEAST_LENGTH, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Words counted in a task before the counts are sent on, and bytes of them.
HELD_WORDS, HELD_BYTES = 200_000, 16 << 20
#: Pairs of chunks and grams of one key, above which the key is cut further.
GROUP = 2048


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()
    size = 0

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
            low = text.lower()  # of bytes: A-Z only
            seed = crc32(b":" if i is None else b"%d:" % i)
            for run, n in Counter((ASCII_RUN if low.isascii() else RUN).findall(low)).items():
                if len(run) < LEAST_LENGTH:
                    continue
                h = crc32(run, seed)
                if h % DELETED == 0:
                    letters = run.decode()
                    at = h % len(letters)
                    run = (letters[:at] + letters[at + 1:]).encode()
                if run not in held:
                    size += len(run)
                held[run] += n
            if len(held) >= HELD_WORDS or size >= HELD_BYTES:
                yield flush()
                size = 0
    if held:
        yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of every word that is long and frequent enough, over all documents."""
    return id_text(docs).mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")) \
        .where((F.col("n") >= LEAST_COUNT) & (F.char_length("word") >= LEAST_LENGTH))


def _part(rest: Column, first: Column, length: Column) -> Column:
    return F.substring(rest, first + 1, length)


def _cut(df: DataFrame, longer: Column) -> DataFrame:
    """Both parts of each ``rest`` as keys, with what is left of it.

    ``longer`` is 1 for the grams of a word that is longer than the partner by
    one: its second part begins, and its first left-over ends, one place later.
    """
    length = F.char_length("rest")
    q = F.floor((length - longer) / 2).cast("int")
    parts = [(F.lit(0), _part("rest", F.lit(0), q), _part("rest", q, length - q)),
             (F.lit(1), _part("rest", q + longer, length - longer - q), _part("rest", F.lit(0), q + longer))]
    return df.select("word", "n", F.inline(F.array(*[
        F.struct(F.xxhash64("key", which, length - longer, part).alias("key"), left.alias("rest"))
        for which, part, left in parts])))


def _pairs(chunks: DataFrame, grams: DataFrame) -> DataFrame:
    """The pairs of one key that are one edit apart."""
    a = chunks.select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    b = grams.select("key", F.col("word").alias("b"), F.col("n").alias("nb"))
    return a.join(b, "key").where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb").distinct()


def _near(words: DataFrame, longer: int, group: int) -> DataFrame:
    """a, na, b, nb: b is near a and longer by ``longer`` (0 or 1)."""
    extra = F.lit(longer)
    first = words.select("word", "n", F.col("word").alias("rest"))
    chunks = _cut(first.withColumn("key", F.lit(0).cast("long")), F.lit(0))
    grams = _cut(first.withColumn("key", F.lit(0).cast("long")), extra)
    found, level = None, 0
    while True:
        chunks, grams = (materialize(df, f"spelling-{name}-{longer}-{level}")
                         for df, name in ((chunks, "chunks"), (grams, "grams")))
        sizes = chunks.groupBy("key").agg(F.count("*").alias("c"), F.max(F.char_length("rest")).alias("left")).join(
            grams.groupBy("key").agg(F.count("*").alias("g")), "key")
        hot = materialize(sizes.where((F.col("c") * F.col("g") > group) & (F.col("left") > 1)).select("key"),
                          f"spelling-hot-{longer}-{level}")
        some = not hot.isEmpty()
        cold = [df.join(hot, "key", "left_anti") if some else df for df in (chunks, grams)]
        pairs = materialize(_pairs(*cold), f"spelling-pairs-{longer}-{level}")
        found = pairs if found is None else found.unionByName(pairs)
        if not some:
            return found
        chunks, grams = (_cut(df.join(hot, "key", "left_semi"), e) for df, e in ((chunks, F.lit(0)), (grams, extra)))
        level += 1


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, near, near_n: every near pair in both directions."""
    one_way = lambda df, x, nx, y, ny: df.select(F.col(x).alias("word"), F.col(y).alias("near"), F.col(ny).alias("near_n"))
    equal, longer = _near(words, 0, group), _near(words, 1, group)
    return one_way(equal, "a", "na", "b", "nb").unionByName(one_way(longer, "a", "na", "b", "nb")) \
        .unionByName(one_way(longer, "b", "nb", "a", "na")).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of every word that has a form, by doubling jumps."""
    jumps, level = materialize(forms.select("word", F.col("form").alias("root")), "spelling-jumps"), 0
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(jumps.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-jumps")
        if moved.where("moved").isEmpty():
            return jumps
        jumps = moved.select("word", "root")


def spelling_variants(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus."""
    words = materialize(word_counts(docs), "spelling-words")
    near = near_words(words, group)
    best = materialize(near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")),
        "spelling-near")
    taken = (-F.col("best.less")) >= RATIO * F.col("n")
    out = materialize(words.join(best, "word", "left").select(
        "word", F.when(taken, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(taken, -F.col("best.less")).alias("form_n")), "spelling-forms")
    roots = _roots(out.where("form IS NOT NULL"))
    return out.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
