"""From a query to ranked spans: phrase matching, BM25, reciprocal rank fusion, merging."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import split_words, tokens, tokens_of
from tidemark.operators.intervals import merge_spans
from tidemark.plans.index import Index, idf, saturated
from tidemark.settings import Retrieval
from tidemark.sources.generations import Put, Store, shared_folder

#: Blocks with the greatest bounds that are read first, for the k-th score so far.
FIRST = 32
#: Phrases and their characters up to which texts themselves are read for them; more are joined with postings.
PHRASES, CHARS = 1 << 17, 4 << 20
#: What scores may be rounded by.
ROUNDED = 1e-6


def query_phrases(spark: SparkSession, query: str) -> DataFrame:
    """qid, phrase, at, term of one query: each white-space separated term is a phrase of its tokens; quotes are blanks."""
    rows = []
    for phrase, term in enumerate(query.replace('"', " ").split()):
        for at, token in enumerate(tokens_of(term)):
            rows.append((0, phrase, at, token))
    return spark.createDataFrame(rows, "qid long, phrase int, at int, term string")


def phrases_of(queries: DataFrame, text: Column) -> DataFrame:
    """The same for a table of queries (qid)."""
    terms = queries.select("qid", F.posexplode(split_words(F.translate(text, '"', " "))).alias("phrase", "word"))
    return terms.select("qid", "phrase", F.posexplode(tokens(F.col("word"))).alias("at", "term"))


def phrase_texts(phrases: DataFrame) -> DataFrame:
    """qid, phrase, words of every phrase: its tokens joined by one space, which no token has."""
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]), " ")
    return phrases.groupBy("qid", "phrase").agg(words.alias("words"))


class _Phrases:
    """Phrases as a trie over numbers of tokens, which all places of a batch of texts walk down together."""

    def __init__(self, phrases: list[str]):
        numbers: dict[str, int] = {}
        split = [[numbers.setdefault(t, len(numbers)) for t in x.split(" ")] for x in phrases]
        self.words, self.tokens, self.n = pa.array(phrases, pa.string()), pa.array(list(numbers), pa.string()), len(numbers)
        edges, ends = {}, {}
        for phrase, own in enumerate(split):
            node = 0
            for t in own:
                node = edges.setdefault(node * self.n + t, len(edges) + 1)
            ends[node] = phrase
        self.edges = np.array(sorted(edges), np.int64)
        self.targets = np.array([edges[x] for x in self.edges.tolist()], np.int64)
        self.phrase = np.full(len(edges) + 1, -1, np.int64)
        self.phrase[list(ends)] = list(ends.values())

    def found(self, ids: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and phrases of all occurrences. ids: the numbers of the tokens, -1 for others; row: the rows they are in."""
        at = np.flatnonzero(ids >= 0)
        node, depth = np.zeros(len(at), np.int64), 0
        while len(at):
            step = node * self.n + ids[at + depth]
            edge = np.minimum(np.searchsorted(self.edges, step), len(self.edges) - 1)
            known = self.edges[edge] == step
            at, node = at[known], self.targets[edge[known]]
            hit = self.phrase[node] >= 0
            yield row[at[hit]], self.phrase[node[hit]]
            depth += 1
            more = at + depth < len(ids)
            at, node = at[more], node[more]
            more = (row[at + depth] == row[at]) & (ids[at + depth] >= 0)
            at, node = at[more], node[more]


def _looked_for(held: _Phrases):
    """key, n_terms, matches (words, f) of each text, from key and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.fill_null(pc.index_in(batch.column(1).flatten(), value_set=held.tokens), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            pairs = [r * len(held.words) + p for r, p in held.found(ids, np.repeat(np.arange(len(lengths)), lengths))]
            both, f = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]), return_counts=True)
            rows, phrases = np.divmod(both, max(len(held.words), 1))
            matches = pa.StructArray.from_arrays([held.words.take(pa.array(phrases)), pa.array(f, pa.int64())], ["words", "f"])
            ends = pa.array(np.searchsorted(rows, np.arange(len(lengths) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), pa.ListArray.from_arrays(ends, matches)], names=[batch.schema.names[0], "n_terms", "matches"])

    return run


def matches_in_texts(phrases: list[str], index: Index) -> tuple[DataFrame, DataFrame]:
    """words, key, f of distinct phrases, and key, n_terms, by one reading of an index's texts; tokens are never shuffled.

    What is found is written, a row for each text, and meets by key, so several texts of one key count together.
    """
    key, spark = index.key, index.texts.sparkSession
    store = Store(spark, f"{shared_folder(spark)}/matches/{uuid.uuid4().hex}")
    kind = index.texts.schema[key].dataType.simpleString()
    rows = index.texts.select(key, tokens(F.col("text")).alias("t")).mapInArrow(_looked_for(_Phrases(phrases)), f"{key} {kind}, n_terms long, matches array<struct<words: string, f: bigint>>")
    store.commit({"matches": Put(rows)})
    found = store.read("matches")
    matches = found.where(F.size("matches") > 0).repartition(key).select(key, F.inline("matches")).groupBy("words", key).agg(F.sum("f").alias("f"))
    return matches, found.select(key, "n_terms")


def _few(texts: DataFrame, index: Index) -> list[str] | None:
    """The distinct phrases (words) of a table, if an index has texts to read and the table's size is below the bounds."""
    if index.texts is None:
        return None
    n, chars = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("words")), F.lit(0))).collect()[0]
    return [r["words"] for r in texts.select("words").distinct().collect()] if n <= PHRASES and chars <= CHARS else None


def word_matches(words: DataFrame, index: Index, *, several: bool = True) -> DataFrame:
    """words, key, f of distinct phrases (words): how often each occurs with its tokens side by side.

    A phrase of one token is a list of postings. A longer one is looked for where its rarest token is: its other tokens
    meet those texts by term and text, so a common token is never read for every phrase that has it, and positions moved
    back by a token's place meet where all tokens are adjacent. several: whether any phrase may have several tokens.
    """
    key = index.key
    split = words.select("words").distinct().withColumn("terms", F.split("words", " "))
    lists = index.postings
    single = split.where(F.size("terms") == 1).select("words", F.col("words").alias("term")).join(lists.select("term", key, "tf"), "term").select("words", key, F.col("tf").alias("f"))
    if not several:
        return single
    tokens_of = split.where(F.size("terms") > 1).select("words", F.size("terms").alias("m"), F.posexplode("terms").alias("at", "term"))
    asked = tokens_of.select("term").distinct()
    found = lists.select("term").join(asked, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rarest = tokens_of.join(found, "term").groupBy("words").agg(F.min_by("term", "n").alias("term"), F.count_if(F.col("n") > 0).alias("known"), F.first("m").alias("m")).where("known = m")
    places = rarest.select("words", "term").join(lists.select("term", key), "term").select("words", key)
    met = places.join(tokens_of, "words").join(lists.select("term", key, "positions"), ["term", key])
    starts = F.transform("positions", lambda x: x - F.col("at"))
    together = met.groupBy("words", key).agg(F.collect_list(starts).alias("starts"), F.first("m").alias("m")).where(F.size("starts") == F.col("m"))
    f = F.size(F.aggregate(F.slice("starts", 2, F.size("starts")), F.get("starts", F.lit(0)), F.array_intersect)).cast("long")
    return single.unionByName(together.select("words", key, f.alias("f")).where("f > 0"))


def phrase_matches(phrases: DataFrame, index: Index) -> DataFrame:
    """qid, phrase, key, f of every phrase; phrases of the same tokens are looked for once."""
    texts = phrase_texts(phrases)
    few = _few(texts, index)
    if few is not None:
        return matches_in_texts(few, index)[0].join(F.broadcast(texts), "words").select("qid", "phrase", index.key, "f")  # at most PHRASES rows
    return texts.join(word_matches(texts, index), "words").select("qid", "phrase", index.key, "f")


def bm25(phrases: DataFrame, index: Index, *, several: bool = True) -> DataFrame:
    """qid, key, score (6 decimals). Texts without tokens count in the number and the mean length of texts.

    What a phrase adds to a text is the same for every query, so it is computed once and counts as often as the query
    has the phrase.
    """
    key, lengths = index.key, index.lengths.select(index.key, "n_terms")
    texts = phrase_texts(phrases).groupBy("qid", "words").agg(F.count(F.lit(1)).alias("times"))
    few = _few(texts, index)
    small = F.broadcast if few is not None else lambda x: x  # at most PHRASES rows
    if few is not None:
        matches, lengths = matches_in_texts(few, index)
    else:
        matches = word_matches(texts, index, several=several)
    corpus = lengths.agg(F.struct(F.count(F.lit(1)).alias("n_docs"), F.avg("n_terms").alias("mean"))).scalar()
    n_docs, mean = corpus["n_docs"], corpus["mean"]
    found = matches.groupBy("words").agg(F.count(F.lit(1)).alias("n"))
    part = idf(n_docs, F.col("n")) * saturated(F.col("f"), F.col("n_terms"), mean)
    parts = matches.join(small(found), "words").join(lengths, key).select("words", key, part.alias("part"))
    return parts.join(small(texts), "words").groupBy("qid", key).agg(F.round(F.sum(F.col("part") * F.col("times")), 6).alias("score"))


def top_k(scores: DataFrame, k: int, key: str = "unit_id") -> DataFrame:
    """qid, key, score, rank from 1: the k best of each query; ties by key."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    # The filter is on the number itself, so rows beyond it go before they are dealt by query.
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def reciprocal_rank_fusion(rankings: DataFrame, key: str, rrf_k: int = 60) -> DataFrame:
    """key, score of rows (list, key, rank from 1): the sum of 1 / (rrf_k + rank); a key twice in a list counts twice."""
    return rankings.groupBy(key).agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("score"))


def best_by_blocks(index: Index, times: dict[str, int], k: int, *, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """qid, unit_id, score of the k best texts for single terms and how often each is asked; and which blocks (term,
    block) were read for them.

    A block's bound is the sum of what its terms add at most. The blocks with the greatest bounds are read first; those
    whose bound is below the k-th score by then hold none of the k best, and their postings are never read.
    """
    asked = F.create_map(*(F.lit(x) for pair in times.items() for x in pair))
    own = index.blocks.where(F.col("term").isin(sorted(times))).withColumn("times", F.element_at(asked, F.col("term")))
    idfs = own.groupBy("term").agg(F.sum("n").alias("n_found")).select("term", idf(F.lit(float(index.n_docs)), F.col("n_found")).alias("idf"))
    weights = {r["term"]: r["idf"] for r in idfs.collect()}  # a number for each term of the query
    if not weights:
        return own.select(F.lit(0).cast("long").alias("qid"), F.lit(0).cast("long").alias("unit_id"), F.lit(0.0).alias("score")).where("false"), own.select("term", "block").where("false")
    weight = F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col("term"))
    bounds = own.groupBy("block").agg(F.sum(weight * F.col("best") * F.col("times")).alias("bound"))
    top = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(first).collect()]

    def scored(blocks: DataFrame) -> DataFrame:
        entries = blocks.select("term", "times", F.explode("entries").alias("e"))
        part = weight * saturated(F.col("e.tf"), F.col("e.n_terms"), F.lit(index.mean)) * F.col("times")
        return entries.groupBy(F.col("e.unit_id").alias("unit_id")).agg(F.round(F.sum(part), 6).alias("score")).select(F.lit(0).cast("long").alias("qid"), "unit_id", "score")

    begun = own.where(F.col("block").isin(top))
    so_far = scored(begun).orderBy(F.desc("score"), "unit_id").limit(k)
    best = so_far.collect()  # k at most
    least = best[-1]["score"] if len(best) == k else None
    if least is None:
        return scored(own).orderBy(F.desc("score"), "unit_id").limit(k), own.select("term", "block")
    others = bounds.where((F.col("bound") >= least - ROUNDED) & ~F.col("block").isin(top)).select("block")
    more = own.join(others, "block", "left_semi")
    found = index.blocks.sparkSession.createDataFrame([tuple(r) for r in best], so_far.schema).unionByName(scored(more))
    return found.orderBy(F.desc("score"), "unit_id").limit(k), begun.select("term", "block").unionByName(more.select("term", "block"))


def search_texts(spark: SparkSession, index: Index, query: str, k: int, video_id: str | None = None) -> DataFrame:
    """unit_id, score, rank. A video filter comes after the statistics, which are those of the whole corpus.

    The query's terms are literals in the filter of the postings, which a stored index answers from the row groups that
    may hold them. Without a filter by video and phrases of several tokens it reads blocks, see best_by_blocks().
    """
    phrases = query_phrases(spark, query)
    asked = phrases.select("term", "at").collect()  # those of one query
    several = any(r["at"] for r in asked)
    if index.blocks is not None and video_id is None and asked and not several:
        best, _ = best_by_blocks(index, dict(Counter(r["term"] for r in asked)), k)
        return top_k(best, k).select("unit_id", "score", "rank")
    terms = sorted({r["term"] for r in asked})
    few = Index(index.postings.where(F.col("term").isin(terms)), index.lengths, index.key)
    scores = bm25(phrases, few, several=several)
    if video_id is not None:
        scores = scores.join(index.lengths.where(F.col("video_id") == video_id).select("unit_id"), "unit_id", "left_semi").select("qid", "unit_id", "score")
    best = scores.orderBy(F.desc("score"), "unit_id").limit(k)
    return top_k(best, k).select("unit_id", "score", "rank")


def search_units(spark: SparkSession, index: Index, query: str, k: int, rrf_k: int = 60, video_id: str | None = None) -> DataFrame:
    """unit_id, score after fusion of the rankings, of which there is one for each index."""
    return reciprocal_rank_fusion(search_texts(spark, index, query, k, video_id), "unit_id", rrf_k)


def search(spark: SparkSession, units: DataFrame, index: Index, query: str, settings: Retrieval, video_id: str | None = None) -> DataFrame:
    """Spans for a query, from an index that is stored (read_index) or made of texts (index_of). k bounds the units, so there are at most as many spans."""
    scored = search_units(spark, index, query, settings.top_k, settings.rrf_k, video_id)
    return merge_spans(units.join(F.broadcast(scored), "unit_id").select("video_id", "t_start", "t_end", "score", "unit_id"), settings.max_gap_s)  # at most top_k rows
