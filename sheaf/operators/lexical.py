"""Lexical search: a positional inverted index and cover-density ranks of the documents that hold all words of a query."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from sheaf.operators.batches import bounded, pieces
from sheaf.operators.quality import STOPWORDS
from sheaf.operators.vocabulary import maybe_known

#: Fixed value: what one cover without foreign words counts for.
COVER_WEIGHT = 0.1
#: Blocks of documents of a search, and what is worked on at once in one: cells of (set, term, document) and entries.
BLOCKS, STEP_CELLS, STEP_ENTRIES = 512, 4 << 20, 1 << 20


def singular(word: Column) -> Column:
    """A light plural stemmer of three rules: -ies to -y (not -eies, -aies), -es to -e (not -aes, -ees, -oes), -s off (not -us, -ss)."""
    return (
        F.when(word.rlike("ies$") & ~word.rlike("[ea]ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("es$") & ~word.rlike("[aeo]es$"), F.regexp_replace(word, "es$", "e"))
        .when(word.rlike("s$") & ~word.rlike("[us]s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def raw_words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def terms(text: Column, stem: Callable[[Column], Column] = singular) -> Column:
    """Stemmed words of a text without stop words, in order."""
    return F.transform(F.filter(raw_words(text), lambda w: ~w.isin(STOPWORDS)), stem)


def postings(docs: DataFrame, *, id_col: str, text: str, stem: Callable[[Column], Column] = singular) -> DataFrame:
    """The index: (term, id, positions), positions ascending, counted from 1 over all words, stop words included.

    A row for each distinct word of each given row, made where the text lies, without a shuffle: words that share a stem, and rows that
    share an id, give several rows of a term and id, which a search brings together. A document without words has no rows.
    """
    bounded(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    schema = StructType([given.schema["id"], StructField("word", StringType()), StructField("positions", ArrayType(IntegerType()))])
    return given.mapInArrow(_placed, schema).select(stem(F.col("word")).alias("term"), "id", "positions")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The places of each distinct word of each text that is no stop word."""
    word, stop = re.compile("[a-z0-9]+"), set(STOPWORDS)
    for batch in pieces(batches, "text"):
        rows, words, places, ends = [], [], [], [0]
        for row, text in enumerate(batch.column("text").to_pylist()):
            found: dict[str, list[int]] = {}
            for at, w in enumerate(word.findall(text), 1):
                if w not in stop:
                    found.setdefault(w, []).append(at)
            for w, at in found.items():
                rows.append(row)
                words.append(w)
                places += at
                ends.append(len(places))
        positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int32())), pa.array(words, pa.string()), positions], ["id", "word", "positions"])


def save(index: DataFrame, path: str) -> None:
    """Keep an index sorted by (term, id) in ranges, so that a lookup of a few terms reads the row groups that may hold them only."""
    index.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(path)


def density(group: np.ndarray, at: np.ndarray, term: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover density of each group of entries: the groups that have a cover, and their sums. Entries are sorted by (group, at); terms are numbered from 0 to k - 1.

    A cover is a run of entries that holds all terms and no shorter run that does; each counts COVER_WEIGHT over one more than the words in it
    that belong to no term. The last place of each term so far gives the latest start for each end, and a start counts at its first end only.
    """
    here = np.arange(len(at))
    first = np.ones(len(at), bool)
    first[1:] = group[1:] != group[:-1]
    start = np.maximum.accumulate(np.where(first, here, 0))
    begin = here
    for j in range(k):
        begin = np.minimum(begin, np.maximum.accumulate(np.where(term == j, here, -1)))
    held = begin >= start
    fresh = held & (first | (np.concatenate(([-1], begin[:-1])) < begin))
    end = np.flatnonzero(fresh)
    begin = begin[end]
    weight = COVER_WEIGHT / (1 + (at[end] - at[begin] - (end - begin)))
    groups, number = np.unique(group[end], return_inverse=True)
    return groups, np.bincount(number, weight, len(groups))


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one after the other."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


def _scored(index: pa.Table, asked: pa.Table) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """(words, id, score) of every set of words and document of a block that holds them all, in bounded steps."""
    if not index.num_rows or not asked.num_rows:
        return
    ids = index.column("id").combine_chunks().dictionary_encode(null_encoding="encode")
    wanted = asked.column("words").combine_chunks()
    names = wanted.flatten().dictionary_encode()
    term = pc.index_in(index.column("term").combine_chunks(), names.dictionary)
    known = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
    if not len(known):
        return
    lists = index.column("positions").combine_chunks()
    row_term, row_doc = term.take(pa.array(known)).to_numpy(), ids.indices.take(pa.array(known)).to_numpy().astype(np.int64)
    offsets, places = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
    # entries of all rows, by (term, document, place): several rows of a term and document become one run
    size = np.diff(offsets)[known]
    at, key = places[_ragged(offsets[:-1][known], size)], np.repeat(row_term * len(ids.dictionary) + row_doc, size)
    order = np.lexsort((at, key))
    at, key = at[order], key[order]
    run, start, size = np.unique(key, return_index=True, return_counts=True)
    held = np.full((len(names.dictionary), len(ids.dictionary)), -1, np.int32)
    held[run // len(ids.dictionary), run % len(ids.dictionary)] = np.arange(len(run))
    bounds, flat = wanted.offsets.to_numpy(), names.indices.to_numpy()
    bounds = bounds - bounds[0]
    lengths = np.diff(bounds)
    for k in np.unique(lengths):
        which = np.flatnonzero(lengths == k)
        step = max(1, STEP_CELLS // (int(k) * held.shape[1]))
        for low in range(0, len(which), step):
            chosen = which[low : low + step]
            runs = held[flat[bounds[chosen][:, None] + np.arange(k)]]  # (set, term, document)
            of, doc = np.nonzero((runs >= 0).all(axis=1))
            if not len(of):
                continue
            runs = runs[of, :, doc]
            upto = np.cumsum(size[runs].sum(axis=1))
            cuts = [0, *(np.flatnonzero(np.diff(upto // STEP_ENTRIES)) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                sizes = size[runs[a:b]].ravel()
                entries = at[_ragged(start[runs[a:b]].ravel(), sizes)]
                group, number = np.repeat(np.arange(b - a).repeat(k), sizes), np.repeat(np.tile(np.arange(k), b - a), sizes)
                order = np.lexsort((number, entries, group))
                groups, score = density(group[order], entries[order], number[order], int(k))
                groups += a
                yield wanted.take(pa.array(chosen[of[groups]])), ids.dictionary.take(pa.array(doc[groups])), pa.array(score)


def search(index: DataFrame, queries: DataFrame, pool: int, *, query_col: str = "query_id", text: str = "text", stem: Callable[[Column], Column] = singular) -> DataFrame:
    """Of each query the best `pool` documents that hold all its words: the query column, id, lexical_score, lexical_rank.

    Queries of the same words are one search. Rows of the index whose term no query has are left out by a bitmap of bounded size; the others go to BLOCKS blocks of documents by a hash
    of the id, and every block meets all sets of words, so that places move once, however many queries ask for them. The top of a set is cut in
    each task before it is ranked. A query without words finds nothing; ties go to the smaller id.
    """
    asked = queries.select(F.col(query_col).alias("q"), F.array_sort(F.array_distinct(terms(F.col(text), stem))).alias("words")).where("size(words) > 0")
    sets = asked.select("words").distinct()
    kept = maybe_known(index.withColumnRenamed("term", "word"), sets.select(F.explode("words").alias("word")).distinct()).withColumnRenamed("word", "term")
    blocks = kept.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)))
    copies = sets.select("words", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))).alias("block"))
    schema = StructType([StructField("words", ArrayType(StringType())), index.schema["id"], StructField("score", DoubleType())])
    names = schema.fieldNames()

    def block(_: tuple, entries: pa.Table, wanted: pa.Table) -> pa.Table:
        found = [pa.table(list(part), names=names) for part in _scored(entries, wanted)]
        return pa.concat_tables(found) if found else pa.table([pa.array([], pa.list_(pa.string())), entries.column("id").slice(0, 0), pa.array([], pa.float64())], names=names)

    scored = blocks.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(block, schema).select("words", "id", F.round("score", 9).alias("lexical_score"))
    rank = F.row_number().over(Window.partitionBy("words").orderBy(F.desc("lexical_score"), "id"))
    best = scored.withColumn("lexical_rank", rank).where(F.col("lexical_rank") <= pool)
    return asked.join(best, "words").select(F.col("q").alias(query_col), "id", "lexical_score", "lexical_rank")
