"""The transcript index: texts of units, postings with positions, and the statistics of the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import strip, tokens
from tidemark.operators.intervals import BUCKET_S
from tidemark.sources.generations import Put, Store

#: BM25's constants, and what a phrase counts for that most texts have.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Ids of units in a block: neighbours by id, which mostly follow each other in a video, have words in common.
BLOCK = 64


def _met(units: DataFrame, sentences: DataFrame, bucket_s: float) -> DataFrame:
    """unit_id, video_id of every unit with each sentence that overlaps it (_a, _id, _text), or none.

    Units and sentences meet in buckets of time, each pair in the first bucket that both reach.
    """

    def reached(a: str, b: str) -> Column:
        return F.explode_outer(F.sequence(F.floor(F.col(a) / bucket_s), F.floor(F.col(b) / bucket_s)))

    s = sentences.select(F.col("video_id").alias("_v"), F.col("t_start").alias("_a"), F.col("t_end").alias("_b"), F.col("id").alias("_id"), F.col("text").alias("_text")).withColumn("_in", reached("_a", "_b"))
    own = units.select("unit_id", "video_id", "t_start", "t_end").withColumn("_bucket", reached("t_start", "t_end"))
    once = F.col("_bucket") == F.greatest(F.floor(F.col("t_start") / bucket_s), F.floor(F.col("_a") / bucket_s))
    # What rows become in buckets no estimate knows, so neither side is broadcast.
    return own.join(s.hint("merge"), (F.col("video_id") == F.col("_v")) & (F.col("_bucket") == F.col("_in")) & (F.col("_a") < F.col("t_end")) & (F.col("_b") > F.col("t_start")) & once, "left")


def unit_texts(units: DataFrame, sentences: DataFrame, *, bucket_s: float = BUCKET_S) -> DataFrame:
    """unit_id, video_id, text: the sentences that overlap each unit, in order; '' where there are none.

    A sentence that crosses a boundary is in the text of both units.
    """
    parts = F.array_sort(F.collect_list(F.when(F.col("_text").isNotNull(), F.struct("_a", "_id", "_text"))))
    return _met(units, sentences, bucket_s).groupBy("unit_id", "video_id").agg(F.array_join(F.transform(parts, lambda x: x["_text"]), " ").alias("text"))


def blank_units(units: DataFrame, sentences: DataFrame, *, bucket_s: float = BUCKET_S) -> DataFrame:
    """unit_id, video_id, blank: whether unit_texts() has nothing but white space for a unit, without making its text.

    A text is blank if each of its sentences is, so a sentence is judged once and only that meets the units.
    """
    said = sentences.withColumn("text", F.coalesce(strip(F.col("text")) != "", F.lit(False)))
    return _met(units, said, bucket_s).groupBy("unit_id", "video_id").agg((~F.coalesce(F.max("_text"), F.lit(False))).alias("blank"))


def token_places(texts: DataFrame, key: str = "unit_id") -> DataFrame:
    """key, position, term: every token of every text."""
    return texts.select(key, F.posexplode(tokens(F.col("text"))).alias("position", "term"))


def postings(texts: DataFrame, key: str = "unit_id") -> DataFrame:
    """key, term, tf, positions: a row for each term of each text."""
    lists = token_places(texts, key).groupBy(key, "term").agg(F.array_sort(F.collect_list("position")).alias("positions"))
    return lists.select(key, "term", F.size("positions").cast("long").alias("tf"), "positions")


def document_lengths(texts: DataFrame, key: str = "unit_id") -> DataFrame:
    """key, n_terms of every text, those without tokens too."""
    return texts.select(key, F.size(tokens(F.col("text"))).cast("long").alias("n_terms"))


def term_stats(texts: DataFrame, key: str = "unit_id") -> DataFrame:
    """term, n_docs, n_occurrences."""
    return token_places(texts, key).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n_occurrences"))


def blank_count(blanks: DataFrame) -> DataFrame:
    """The row of empty_count() from rows of blank_units()."""
    return blanks.agg(F.count(F.lit(1)).alias("n_units"), F.count_if("blank").alias("n_empty"))


def empty_count(texts: DataFrame) -> DataFrame:
    return texts.agg(F.count(F.lit(1)).alias("n_units"), F.count_if(strip(F.col("text")) == "").alias("n_empty"))


def idf(n_docs: Column | float, n: Column) -> Column:
    plain = F.ln((n_docs - n + 0.5) / (n + 0.5))
    return F.when(plain > 0, plain).otherwise(LEAST_IDF)


def saturated(f: Column, n_terms: Column, mean: Column | float) -> Column:
    """How much f occurrences in a text of n_terms weigh."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * n_terms / mean))


@dataclass(frozen=True)
class Index:
    """What a search reads: postings (key, term, tf, positions) and lengths (key, n_terms and what units carry besides).

    A stored index also has `blocks` (term, block, n, best, entries): the postings of a term in BLOCK neighbouring ids,
    and the most that one of them weighs, which times the term's idf is the most that it adds to a score; `n_docs` and
    `mean` are the corpus's. An index that is made of texts has them in `texts` (key, text).
    """

    postings: DataFrame
    lengths: DataFrame
    key: str = "unit_id"
    blocks: DataFrame | None = None
    n_docs: int = 0
    mean: float = 0.0
    texts: DataFrame | None = None


def index_of(texts: DataFrame, key: str = "unit_id") -> Index:
    """An index that is made of the texts whenever it is read; a query needs the terms that it asks for only."""
    return Index(postings(texts, key), texts.select("*", F.size(tokens(F.col("text"))).cast("long").alias("n_terms")).drop("text"), key, texts=texts.select(key, "text"))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the tokens of a text (the last column) its terms, how often each occurs, and where; other columns stay."""
    for batch in batches:
        terms, counts, places, ends, place_ends = [], [], [], [0], [0]
        for own in batch.column(batch.num_columns - 1).to_pylist():
            found: dict[str, list[int]] = {}
            for at, term in enumerate(own or ()):
                found.setdefault(term, []).append(at)
            terms += found
            for x in found.values():
                counts.append(len(x))
                places += x
                place_ends.append(len(places))
            ends.append(len(terms))
        lists = pa.ListArray.from_arrays(pa.array(place_ends, pa.int32()), pa.array(places, pa.int32()))
        held = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64()), lists], ["term", "tf", "positions"])
        rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], rows], names=[*batch.schema.names[:-1], "terms"])


def text_terms(texts: DataFrame, *columns: str) -> DataFrame:
    """The columns, n_terms and terms (term, tf, positions) of every text: its postings in one row, which no shuffle makes."""
    rows = texts.select(*columns, tokens(F.col("text")).alias("t"))
    rows = rows.select(*columns, F.size("t").cast("long").alias("n_terms"), "t")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_terms, f"{kinds}, terms array<struct<term: string, tf: bigint, positions: array<int>>>")


def blocks_of(units: DataFrame, mean: float) -> DataFrame:
    """Blocks of postings, by term and block, from rows of text_terms(): all that a search reads, dealt once. A term's
    frequency is the sum over its blocks, so no join meets a common term's postings."""
    rows = units.select("unit_id", "n_terms", F.explode(F.transform("terms", lambda x: F.struct(x["term"].alias("term"), x["positions"].alias("positions")))).alias("x"))
    slim = rows.select("x.term", F.floor(F.col("unit_id") / BLOCK).alias("block"), "unit_id", "n_terms", "x.positions").repartitionByRange("term", "block")
    held = slim.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("unit_id", F.size("positions").cast("long").alias("tf"), "n_terms", "positions"))).alias("entries"))
    best = F.array_max(F.transform("entries", lambda e: saturated(e["tf"], e["n_terms"], F.lit(mean))))
    return held.select("term", "block", "n", best.alias("best"), "entries").sortWithinPartitions("term", "block")


def build_index(texts: DataFrame, path: str) -> int:
    """Writes the index in place of any older one, in one commit: a reader has all of the old one or all of the new one,
    also if this run is killed on its way. Returns the number of units.

    Blocks are sorted by term over all files, so a reader of few terms skips most row groups by their bounds; postings are
    read from them. The terms of each unit are written first, in one row, so texts are made once and postings dealt once.
    """
    store = Store(texts.sparkSession, path)
    base, parts = store.version(), Store(texts.sparkSession, f"{path}/_parts")
    parts.commit({"units": Put(text_terms(texts, "unit_id", "video_id"))})
    units = parts.read("units")
    lengths = units.select("unit_id", "video_id", "n_terms")
    corpus = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("n_terms"), F.lit(0.0)).alias("mean"))
    n_docs, mean = corpus.collect()[0]
    store.commit({"index_units": Put(lengths), "blocks": Put(blocks_of(units, mean)), "corpus": Put(corpus)}, base=base)
    parts.vacuum(0)
    return n_docs


def read_index(spark: SparkSession, path: str) -> Index:
    """The index that build_index() wrote last; raises if there is none."""
    store = Store(spark, path)
    version = store.version()
    if not version:
        raise FileNotFoundError(f"[PATH_NOT_FOUND] no index in {path}")
    lengths, blocks, corpus = (store.read(x, version=version) for x in ("index_units", "blocks", "corpus"))
    if "positions" not in blocks.schema["entries"].dataType.elementType.names:
        raise FileNotFoundError(f"[PATH_NOT_FOUND] the index in {path} is in an older form")
    lists = blocks.select("term", F.explode("entries").alias("e")).select("e.unit_id", "term", "e.tf", "e.positions")
    n_docs, mean = corpus.collect()[0]
    return Index(lists, lengths, "unit_id", blocks, n_docs, mean)


def index_corpus(units: DataFrame, sentences: DataFrame, path: str, *, level: int = 0) -> int:
    """The index of all units of a level, built whole; returns the number of units. Without units it is an empty index."""
    return build_index(unit_texts(units.where(F.col("level") == level), sentences), path)
