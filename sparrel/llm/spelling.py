"""Spelling variants: words of one edit's distance by an even-partition pigeonhole join, and each word's commonest form.

A word of length l is indexed by its two halves.  A word that one edit separates from it, of equal length or one longer, holds one of the halves whole: the
first where the indexed word has it, the second there or one place on.  So it probes with those substrings.  A bucket of more than BUCKET indexed words
is split again in the same way, by the halves of what its key doesn't cover, until that is a single character: the alphabet then bounds the bucket.  No bucket
is cut short, and what meets is verified.  Keys are 64-bit hashes; a collision costs a comparison, nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Indexed words that a key may hold before it is split again.
BUCKET = 32
#: Fixed values of the contract: run of letters, share of runs that lose a character, least length and count of a word, how much commoner a form must be.
RUN = "[A-Za-zÀ-ÿ]+"
EVERY, LEAST_LENGTH, LEAST_COUNT, TIMES = 199, 6, 5, 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY) -> DataFrame:
    """word, n: the texts' runs of letters with A-Z in lower case, counted, of at least LEAST_LENGTH code points and LEAST_COUNT occurrences.

    If every divides crc32("id:run"), the run loses the code point crc32 % length first.  Null texts have no words, a null id is written as nothing; repeated rows
    count again; any other column is left out.  Counts are added up in each task before the shuffle."""
    lower = F.translate(F.col(text_col), _UPPER, _UPPER.lower())
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"), F.char_length("run").alias("l"))
    at = (F.col("h") % F.col("l")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substr("run", at + 2))
    made = hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= LEAST_LENGTH)
    return made.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _entries(vocabulary: DataFrame) -> DataFrame:
    """word, n, indexed, longer, key, a, b: each word once to be indexed, and once each to probe the words of its length and those one shorter.

    longer: by how many characters the word is longer than those it meets; a, b: the part that the key doesn't cover yet, here all of it."""
    l = F.char_length("word")  # noqa: E741
    kinds = F.array(*[F.struct(F.lit(i).alias("indexed"), F.lit(k).alias("longer")) for i, k in ((True, 0), (False, 0), (False, 1))])
    rows = vocabulary.select("word", "n", l.alias("b"), F.explode(kinds).alias("k"))
    return rows.select("word", "n", "k.indexed", "k.longer", F.xxhash64(F.col("b") - F.col("k.longer")).alias("key"), F.lit(0).alias("a"), "b")


def _split(entries: DataFrame) -> DataFrame:
    """Each entry twice, by the halves of its open part: the key covers one half, the other stays open.  Lengths are those of the indexed word."""
    half = ((F.col("b") - F.col("a") - F.col("longer")) / 2).cast("int")
    middle = F.col("a") + half
    piece = lambda start, end: F.substr("word", start + 1, end - start)
    first = F.struct(F.xxhash64("key", F.lit(1), piece(F.col("a"), middle)).alias("key"), middle.alias("a"), F.col("b").alias("b"))
    on = middle + F.col("longer")
    second = F.struct(F.xxhash64("key", F.lit(2), piece(on, F.col("b"))).alias("key"), F.col("a").alias("a"), on.alias("b"))
    return entries.select("word", "n", "indexed", "longer", F.explode(F.array(first, second)).alias("s")).select("word", "n", "indexed", "longer", "s.*")


def _met(entries: DataFrame) -> DataFrame:
    """x, nx, y, ny of entries that share a key and are one edit apart; equal lengths in one order only."""
    index = entries.where("indexed").select("key", F.col("word").alias("x"), F.col("n").alias("nx"))
    probe = entries.where("not indexed").select("key", "longer", F.col("word").alias("y"), F.col("n").alias("ny"))
    apart = (F.char_length("y") == F.char_length("x") + F.col("longer")) & ((F.col("longer") == 1) | (F.col("x") < F.col("y")))
    met = index.join(probe, "key").where(apart)
    return met.where(F.levenshtein("x", "y", 1) == 1).select("x", "nx", "y", "ny")


def near_words(vocabulary: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """x, nx, y, ny: every two words (word, n; distinct) that one inserted, deleted or replaced code point separates, once each, the shorter or smaller as x."""
    found, entries = [], common.written(_split(_entries(vocabulary)), "spelling-entries")
    while True:
        sizes = entries.where(F.col("indexed") & (F.col("b") - F.col("a") > 1)).groupBy("key").agg(F.count("*").alias("m"))
        hot = common.written(sizes.where(F.col("m") > bucket).select("key"), "spelling-hot")
        if hot.isEmpty():
            found.append(_met(entries))
            break
        found.append(_met(entries.join(hot, "key", "left_anti")))
        entries = common.written(_split(entries.join(hot, "key", "left_semi")), "spelling-entries")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.distinct()


def forms(vocabulary: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n: form is the near word of largest n (then the first in code-point order), if that is times the word's n or more, else null.

    A word has a bounded number of near words (two for each place and letter of the alphabet), so no group here is unbounded."""
    both = pairs.select(F.explode(F.array(*[F.struct(F.col(a).alias("word"), F.col(f"n{b}").alias("m"), F.col(b).alias("other")) for a, b in ("xy", "yx")])).alias("s")).select("s.*")
    best = both.groupBy("word").agg(F.count("*").alias("k"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("b"))
    take = -F.col("b.m") >= times * F.col("n")
    return vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("k", F.lit(0).cast("long")).alias("n_near"), F.when(take, F.col("b.other")).alias("form"), F.when(take, -F.col("b.m")).alias("form_n")
    )


def roots(table: DataFrame) -> DataFrame:
    """table (word, form and others) with root: the end of the chain of forms, the word itself if it has none.

    Pointers jump twice as far each round.  A form is commoner than its word by a factor, so chains have no rings and a length that grows as the logarithm of n."""
    reach = common.written(table.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if reach.join(step, "root", "left_semi").isEmpty():
            break
        reach = common.written(reach.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return table.join(reach, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the texts; see words(), forms(), roots().  No words give no rows."""
    vocabulary = common.written(words(docs, id_col, text_col, every), "spelling-words")
    table = common.written(forms(vocabulary, near_words(vocabulary)), "spelling-forms")
    return roots(table).select("word", "form", "root", "n", "n_near", "form_n")

