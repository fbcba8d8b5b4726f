"""Tokens, n-grams and TF-IDF with scikit-learn's conventions, in DataFrame operations.

Tokens are words of at least two characters of the lower-cased text; terms are tokens and neighbouring pairs.  The vocabulary is the top terms by corpus
count (ties by term).  Weight: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), rows scaled to length 1.  Null texts have no terms; terms outside the
vocabulary add nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import findable
from ..sources import sinks
from .columns import _bound

#: Terms up to which a vocabulary is sent to every task; a larger one is joined by shuffle.
MAX_BROADCAST_TERMS = 100_000
#: Tokens that a task counts at once (a row's tokens stay together).
COUNTED_TOKENS = 500_000


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), 0), F.array().cast("array<string>"))


def terms(text: Column) -> Column:
    def both(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.concat(t, F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))

    return _bound(tokens(text), both)


def _counted(lists: pa.ListArray, words_of_terms: pa.Array | None = None, most: int = 2) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some rows of tokens at a time: the first row's place, their distinct terms (of the given words, if any, and of one or two), and for each row and each of its
    terms the row, the term's place, and how often."""
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(lists):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + COUNTED_TOKENS, "right")))
        some = lists.slice(start, stop - start)
        words = some.flatten().dictionary_encode()
        code, names = words.indices.to_numpy().astype(np.int64), words.dictionary
        rows = np.repeat(np.arange(len(some)), pc.list_value_length(some).to_numpy(zero_copy_only=False))
        one = np.ones(len(code), bool) if words_of_terms is None else pc.is_in(names, value_set=words_of_terms).to_numpy(zero_copy_only=False)[code]
        inside, z = (rows[1:] == rows[:-1]) & one[1:] & one[:-1] & (most > 1), max(1, len(names))
        found, place = np.unique(np.concatenate((code[one], z + code[:-1][inside] * z + code[1:][inside])), return_inverse=True)
        pair, times = np.unique(np.concatenate((rows[one], rows[1:][inside])) * max(1, len(found)) + place, return_counts=True)
        two = found[found >= z] - z
        both = pc.binary_join_element_wise(names.take(pa.array(two // z)), names.take(pa.array(two % z)), " ")
        yield start, pa.concat_arrays([names.take(pa.array(found[found < z])), both]), pair // max(1, len(found)), pair % max(1, len(found)), times
        start = stop


def term_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """term, df (rows with it), total (occurrences).  Tasks count terms as pairs of numbers, some rows at a time; the counts are added up by term before anything is shuffled."""
    return _statistics(docs.select(tokens(F.col(text_col)).alias("t")))


def _statistics(rows: DataFrame, words: pa.Array | None = None, most: int = 2) -> DataFrame:
    """term_statistics() of a column of tokens; of terms of the given words, if any, and of as many words at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, names, _, place, times in _counted(batch.column(0), words, most):
                df, total = np.bincount(place, minlength=len(names)), np.bincount(place, times, len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([names, pa.array(df), pa.array(total)], names=["term", "df", "total"])

    findable(rows.sparkSession)
    counted = rows.mapInArrow(run, "term string, df bigint, total bigint")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _top(rows: DataFrame, n: int) -> DataFrame:
    """The n terms of most occurrences (ties by term) of a column of tokens.

    A pair occurs no more often than either of its words.  So all of these terms are made of words that occur as often as the n-th most frequent word or
    more often, and pairs with any other word need not be counted."""
    counts = sinks.written(_statistics(rows, most=1), "words")
    least = counts.orderBy(F.desc("total")).limit(n).agg(F.count("*"), F.min("total")).first()
    frequent = counts.where(F.col("total") >= (least[1] if least[0] == n else 0)).select("term").limit(MAX_BROADCAST_TERMS + 1).toArrow().column("term").combine_chunks().cast(pa.string())
    return _statistics(rows, frequent if len(frequent) <= MAX_BROADCAST_TERMS else None).orderBy(F.desc("total"), "term").limit(n)


def known_counts(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, n (occurrences) for each row's distinct terms that are in the vocabulary."""
    known = vocabulary.select("term").limit(MAX_BROADCAST_TERMS + 1).toArrow().column("term").combine_chunks()
    wanted = known.cast(pa.string()) if len(known) <= MAX_BROADCAST_TERMS else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, names, rows, place, times in _counted(batch.column(1)):
                if wanted is not None:
                    kept = pc.is_in(names, value_set=wanted).to_numpy(zero_copy_only=False)[place]
                    rows, place, times = rows[kept], place[kept], times[kept]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(start + rows)), names.take(pa.array(place)), pa.array(times)], names=[id_col, "term", "n"])

    findable(docs.sparkSession)
    rows = docs.select(id_col, tokens(F.col(text_col)).alias("t"))
    counts = rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, term string, n bigint")
    return counts if wanted is not None else counts.join(vocabulary.select("term"), "term", "left_semi")


def fit(docs: DataFrame, id_col: str, text_col: str, max_features: int | None = 2048) -> DataFrame:
    """term, df, total, idf, index (place in alphabetical order) from training rows (id_col isn't needed; repeated ids are rows of their own)."""
    if max_features is None:
        n, stats = docs.count(), term_statistics(docs, text_col)
    else:
        rows = sinks.written(docs.select(tokens(F.col(text_col)).alias("t")), "tokens")  # read several times
        n, stats = rows.count(), _top(rows, max_features)
        stats = stats.withColumn("index", F.row_number().over(Window.orderBy("term")) - 1)  # at most max_features rows
    out = stats.withColumn("idf", F.log((1.0 + F.lit(n)) / (1.0 + F.col("df"))) + 1.0)
    return out if max_features is None else sinks.written(out, "vocabulary")  # read several times


def transform(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, weight for every known term of every row."""
    vocabulary = vocabulary.select("term", "idf")
    known = vocabulary.limit(MAX_BROADCAST_TERMS + 1).count()
    met = known_counts(docs, vocabulary, id_col, text_col).join(F.broadcast(vocabulary) if known <= MAX_BROADCAST_TERMS else vocabulary, "term")
    raw = met.groupBy(id_col, "term").agg(((1.0 + F.log(F.sum("n").cast("double"))) * F.first("idf")).alias("raw"))
    return raw.withColumn("weight", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))).select(id_col, "term", "weight")


def recognised(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, recognised: how many distinct known terms each row has; 0 where none."""
    counts = known_counts(docs, vocabulary, id_col, text_col).groupBy(id_col).agg(F.count("*").alias("recognised"))
    return docs.select(id_col).join(counts, id_col, "left").select(id_col, F.coalesce("recognised", F.lit(0)).alias("recognised"))


def require_text(c: Column) -> Column:
    """The trimmed text; blank or null is an error."""
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.raise_error(F.lit("a description is required")).cast("string")).otherwise(F.trim(c))


def dense(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str, name: str = "text") -> DataFrame:
    """id and an array of weights by vocabulary index for every row; zeros where no term is known.  For vocabularies with an index."""
    size = vocabulary.count()
    index = vocabulary.select("term", F.col("index").cast("int").alias("index"))
    entries = transform(docs, vocabulary, id_col, text_col).join(F.broadcast(index) if size <= MAX_BROADCAST_TERMS else index, "term").groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("index", "weight"))).alias("_m"))
    wide = F.transform(F.sequence(F.lit(0), F.lit(max(size - 1, 0))), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return docs.select(id_col).join(entries, id_col, "left").select(id_col, wide.alias(name))


def sparse(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str, name: str = "text") -> DataFrame:
    """id and a sparse vector (size, indices in order, values) of weights by vocabulary index for every row; empty where no term is known."""
    size = vocabulary.count()
    index = vocabulary.select("term", F.col("index").cast("int").alias("index"))
    weights = transform(docs, vocabulary, id_col, text_col).join(F.broadcast(index) if size <= MAX_BROADCAST_TERMS else index, "term")
    each = weights.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("index", "weight"))).alias("_e"))  # no more than the vocabulary
    some = F.coalesce("_e", F.array().cast("array<struct<index: int, weight: double>>"))
    vector = F.struct(F.lit(size).alias("size"), F.transform(some, lambda e: e.index).alias("indices"), F.transform(some, lambda e: e.weight).alias("values"))
    return docs.select(id_col).join(each, id_col, "left").select(id_col, vector.alias(name))
