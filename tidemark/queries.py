"""The registered queries over the test tables, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import media, table_functions
from tidemark.functions import text as words_of
from tidemark.functions.media import probe_info, sample_range
from tidemark.functions.text import encode_word, normalize_word, tokens, word_count
from tidemark.operators import align, intervals, scenes, segment, speech, stages, timelines
from tidemark.plans import index, retrieve
from tidemark.schema import orphans, removed
from tidemark.settings import Clips, Retrieval, Scenes, Settings, Speech
from tidemark.sources import corpus, files
from tidemark.sources.corpus import table
from tidemark.sources.generations import Replace, Store, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

QUERY = 'que the "thation" enier'
#: Conversations run at about two words a second, so this is the density that divides them.
DENSE = 1.96
DAYS = {"target_s": 86_400.0, "max_s": 172_800.0, "min_s": 43_200.0}
LETTERS = {"'": 1} | {chr(97 + k): k + 2 for k in range(26)}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- carriers -----------------------------------------------------------------------------------------------------


def _words(spark: SparkSession, d: str) -> DataFrame:
    return corpus.words(table(spark, d, "conversations"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return corpus.turns(_words(spark, d))


def _videos(spark: SparkSession, d: str) -> DataFrame:
    return corpus.videos(_turns(spark, d))


def _clips(spark: SparkSession, d: str) -> DataFrame:
    return corpus.clips(_videos(spark, d), Clips())


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return index.unit_texts(_clips(spark, d), _turns(spark, d))


def _index(spark: SparkSession, d: str) -> index.Index:
    """The stored index of the clips' texts; built where there is none yet of these files."""
    path = f"{shared_folder(spark)}/clip_index/{files.fingerprint(spark, f'{d}/conversations.parquet')}"
    try:
        return index.read_index(spark, path)
    except FileNotFoundError:
        index.build_index(_texts(spark, d), path)
        return index.read_index(spark, path)


def _seconds(spark: SparkSession, d: str) -> DataFrame:
    return corpus.event_seconds(table(spark, d, "events"))


def _fixed_sql(rows: str, duration: str, target: float, stride: float, least: float, keys: str) -> str:
    """SQL for fixed windows: unit_no, t_start, t_end of every row of `rows`."""
    last = f"greatest(0, CASE WHEN {least} > 0 THEN floor(({duration} - {least} - {target}) / {stride}) + 1 ELSE ceil(({duration} - {target}) / {stride}) END)"
    last = f"CASE WHEN {duration} <= {target} THEN 0 ELSE least({last}, ceil({duration} / {stride}) - 1) END"
    return f"""
        SELECT {keys}, CAST(i AS BIGINT) AS unit_no, CAST(i * {stride} AS DOUBLE) AS t_start,
               CAST(CASE WHEN {duration} <= {target} OR {duration} - least(i * {stride} + {target}, {duration}) < {least} THEN {duration} ELSE least(i * {stride} + {target}, {duration}) END AS DOUBLE) AS t_end
        FROM {rows}, unnest(range(0, CAST({last} AS BIGINT) + 1)) AS r(i) WHERE {duration} > 0
    """


_WORDS = r"""
    split AS (
        SELECT CAST(conv_id AS VARCHAR) AS video_id, turn, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM conversations
    ), placed AS (
        SELECT *, CAST(coalesce(sum(len(w)) OVER (PARTITION BY video_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM split
    ), words AS MATERIALIZED (
        SELECT video_id, turn, before + i - 1 AS word_no, (before + i - 1) * 0.5::DOUBLE + turn AS t_start, (before + i - 1) * 0.5::DOUBLE + turn + 0.5 AS t_end, w[i] AS text
        FROM placed, unnest(range(1, len(w) + 1)) AS r(i)
    ), turns AS MATERIALIZED (
        SELECT video_id, turn AS id, turn, min(t_start) AS t_start, max(t_end) AS t_end, string_agg(text, ' ' ORDER BY word_no) AS text FROM words GROUP BY video_id, turn
    ), videos AS (
        SELECT video_id, max(t_end) AS duration_s FROM turns GROUP BY video_id
    )
"""
_CLIPS = f"""{_WORDS}, clips AS MATERIALIZED (
        SELECT CAST(video_id AS BIGINT) * 1000000 + unit_no AS unit_id, * FROM ({_fixed_sql("videos", "duration_s", 16.0, 16.0, 8.0, "video_id")})
    ), texts AS MATERIALIZED (
        SELECT u.unit_id, u.video_id, coalesce(string_agg(s.text, ' ' ORDER BY s.t_start, s.id), '') AS text
        FROM clips u LEFT JOIN turns s ON s.video_id = u.video_id AND s.t_start < u.t_end AND s.t_end > u.t_start GROUP BY u.unit_id, u.video_id
    )
"""


def _tokens_sql(text: str) -> str:
    return rf"regexp_extract_all(regexp_replace(translate(lower({text}), '{words_of.ACCENTED}', '{words_of.PLAIN}'), '[{words_of.MARKS}]+', '', 'g'), '{words_of.TOKEN}')"


def _bm25_sql(texts: str, phrases: str) -> str:
    """CTEs lengths, found and scores for the CTEs texts(unit_id, text) and phrases(qid, phrase, place, term)."""
    return f"""
        toks AS MATERIALIZED (SELECT unit_id, {_tokens_sql("coalesce(text, '')")} AS t FROM {texts}),
        lengths AS (SELECT unit_id, len(t) AS n_terms FROM toks),
        posts AS MATERIALIZED (SELECT unit_id, i AS position, t[i] AS term FROM toks, unnest(range(1, len(t) + 1)) AS r(i)),
        sized AS (SELECT *, count(*) OVER (PARTITION BY qid, phrase) AS m FROM {phrases}),
        starts AS (SELECT qid, phrase, m, unit_id, position - place AS start, count(*) AS met FROM sized JOIN posts USING (term) GROUP BY ALL),
        found AS MATERIALIZED (SELECT qid, phrase, unit_id, count(*) AS f FROM starts WHERE met = m GROUP BY ALL),
        counted AS (SELECT *, count(*) OVER (PARTITION BY qid, phrase) AS n, (SELECT count(*) FROM lengths) AS nd, (SELECT avg(n_terms) FROM lengths) AS mean FROM found JOIN lengths USING (unit_id)),
        scores AS MATERIALIZED (
            SELECT qid, unit_id, round(sum(CASE WHEN ln((nd - n + 0.5) / (n + 0.5)) > 0 THEN ln((nd - n + 0.5) / (n + 0.5)) ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_terms / mean))), 6) AS score
            FROM counted GROUP BY qid, unit_id
        )
    """


_QUERY_PHRASES = "phrases AS (SELECT * FROM (VALUES (0, 0, 0, 'que'), (0, 1, 0, 'the'), (0, 2, 0, 'thation'), (0, 3, 0, 'enier')) AS p(qid, phrase, place, term))"
_SEARCH = f"WITH {_CLIPS}, {_QUERY_PHRASES}, {_bm25_sql('texts', 'phrases')}"
_BEST = "best AS (SELECT unit_id, score, row_number() OVER (ORDER BY score DESC, unit_id) AS rank FROM scores QUALIFY rank <= 20)"
_MERGE = """
    marked AS (SELECT *, CASE WHEN t_start - max(t_end) OVER (PARTITION BY video_id ORDER BY t_start, unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS begins FROM {rows}),
    runs AS (SELECT *, sum(begins) OVER (PARTITION BY video_id ORDER BY t_start, unit_id ROWS UNBOUNDED PRECEDING) AS run FROM marked)
    SELECT video_id, min(t_start) AS t_start, max(t_end) AS t_end, max(score) AS score, string_agg(CAST(unit_id AS VARCHAR), ',' ORDER BY t_start, unit_id) AS unit_ids FROM runs GROUP BY video_id, run
"""


def _listed(spans: DataFrame) -> DataFrame:
    return spans.withColumn("unit_ids", F.array_join("unit_ids", ","))


# --- retrieval ----------------------------------------------------------------------------------------------------


@query(_SEARCH + f", {_BEST}, spans AS (SELECT video_id, t_start, t_end, round(1.0::DOUBLE / (60 + rank), 9) AS score, unit_id FROM best JOIN clips USING (unit_id)), " + _MERGE.format(gap=2.0, rows="spans"))
def search_spans(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: from a query to ranked moments."""
    return intervals.ranked_spans(_listed(retrieve.search(spark, _clips(spark, d), _index(spark, d), QUERY, Retrieval())))


@query(_SEARCH + f", {_BEST} SELECT unit_id, round(1.0::DOUBLE / (60 + rank), 9) AS score FROM best")
def search_units(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.search_units(spark, _index(spark, d), QUERY, 20)


@query(_SEARCH + f", {_BEST} SELECT * FROM best")
def search_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.search_texts(spark, _index(spark, d), QUERY, 20)


@query(_SEARCH + " SELECT unit_id, score, row_number() OVER (ORDER BY score DESC, unit_id) AS rank FROM scores JOIN texts USING (unit_id) WHERE video_id = '7' QUALIFY rank <= 20")
def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.search_texts(spark, _index(spark, d), QUERY, 20, video_id="7")


#: Items of the benchmark as queries, their whole texts.
_ITEMS = rf"""
    items AS (SELECT item_id AS qid, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM benchmark),
    words_of AS (SELECT qid, i - 1 AS phrase, {_tokens_sql("translate(w[i], '\"', ' ')")} AS t FROM items, unnest(range(1, len(w) + 1)) AS r(i)),
    phrases AS MATERIALIZED (SELECT qid, phrase, j - 1 AS place, t[j] AS term FROM words_of, unnest(range(1, len(t) + 1)) AS r(j)),
    docs AS (SELECT doc_id AS unit_id, text FROM documents)
"""


def _item_phrases(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.phrases_of(table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text"), F.col("text"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text")


@query(f"WITH {_ITEMS}, {_bm25_sql('docs', 'phrases')} SELECT qid, unit_id, score FROM scores")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.bm25(_item_phrases(spark, d), index.index_of(_documents(spark, d)))


@query(f"WITH {_ITEMS}, {_bm25_sql('docs', 'phrases')} SELECT qid, unit_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, unit_id) AS rank FROM scores QUALIFY rank <= 10")
def search_batch(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.top_k(bm25_scores(spark, d), 10)


@query(f"WITH {_ITEMS}, {_bm25_sql('docs', 'phrases')} SELECT qid, unit_id, count(*) AS n_phrases, CAST(sum(f) AS BIGINT) AS n_matches FROM found GROUP BY qid, unit_id")
def match_any(spark: SparkSession, d: str) -> DataFrame:
    found = retrieve.phrase_matches(_item_phrases(spark, d), index.index_of(_documents(spark, d)))
    return found.groupBy("qid", "unit_id").agg(F.count(F.lit(1)).alias("n_phrases"), F.sum("f").alias("n_matches"))


@query(rf"""WITH items AS (SELECT item_id AS qid, {_tokens_sql("text")} AS t FROM benchmark),
    phrases AS (SELECT qid, (j - 1) // 3 AS phrase, (j - 1) % 3 AS place, t[j] AS term FROM items, unnest(range(1, len(t) + 1)) AS r(j)),
    docs AS (SELECT doc_id AS unit_id, text FROM documents), {_bm25_sql("docs", "phrases")} SELECT qid, phrase, unit_id, f FROM found""")
def match_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Each three tokens of each item as a phrase."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.posexplode(tokens(F.col("text"))).alias("i", "term"))
    phrases = items.select("qid", F.floor(F.col("i") / 3).alias("phrase"), (F.col("i") % 3).alias("at"), "term")
    return retrieve.phrase_matches(phrases, index.index_of(_documents(spark, d))).select("qid", "phrase", "unit_id", "f")


_RANKS = r"""
    ranked AS (
        SELECT 'chars' AS list, lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents
        UNION ALL
        SELECT 'words', lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) DESC, doc_id) AS rank FROM documents
    )
"""


@query(f"WITH {_RANKS} SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ranked GROUP BY doc_id")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Two whole rankings of each language, fused."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", word_count(F.col("text")).alias("n_words"))
    lists = [
        docs.select("doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(c), "doc_id")).alias("rank")) for c in ("n_chars", "n_words")
    ]
    return retrieve.reciprocal_rank_fusion(lists[0].unionByName(lists[1]), "doc_id").orderBy(F.desc("score"), "doc_id")


@query(f"WITH {_CLIPS} SELECT unit_id, video_id, text FROM texts")
def unit_texts(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d)


@query(f"WITH {_CLIPS} SELECT u.video_id, u.unit_id, s.id AS sentence_id FROM clips u JOIN turns s ON s.video_id = u.video_id AND s.t_start < u.t_end AND s.t_end > u.t_start")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    pairs = intervals.overlaps(_clips(spark, d), _turns(spark, d), bucket_s=64.0)
    return pairs.select("video_id", "unit_id", F.col("b_id").alias("sentence_id"))


@query(f"WITH {_CLIPS} SELECT video_id, count(*) AS n_units FROM clips GROUP BY video_id")
def units_per_video(spark: SparkSession, d: str) -> DataFrame:
    return segment.units_per_video(_clips(spark, d))


@query(f"SELECT doc_id, i - 1 AS position, t[i] AS term FROM (SELECT doc_id, {_tokens_sql('text')} AS t FROM documents), unnest(range(1, len(t) + 1)) AS r(i)")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return index.token_places(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("position").cast("long").alias("position"), "term")


@query(f"""WITH p AS (SELECT doc_id, unnest({_tokens_sql("text")}) AS term FROM documents)
    SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n_occurrences FROM p GROUP BY term""")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return index.term_stats(table(spark, d, "documents"), "doc_id")


@query(f"WITH {_CLIPS} SELECT unit_id, len({_tokens_sql('text')}) AS n_terms FROM texts")
def index_docs(spark: SparkSession, d: str) -> DataFrame:
    return index.document_lengths(_texts(spark, d))


_SHORT = f"""{_WORDS}, clips AS (SELECT CAST(video_id AS BIGINT) * 1000000 + unit_no AS unit_id, * FROM ({_fixed_sql("videos", "duration_s", 0.5, 0.5, 0.0, "video_id")})),
    texts AS (SELECT u.unit_id, coalesce(string_agg(s.text, ' '), '') AS text FROM clips u LEFT JOIN turns s ON s.video_id = u.video_id AND s.t_start < u.t_end AND s.t_end > u.t_start GROUP BY u.unit_id)"""


@query(rf"WITH {_SHORT} SELECT count(*) AS n_units, count(*) FILTER (WHERE trim(text) = '') AS n_empty FROM texts")
def index_empty_count(spark: SparkSession, d: str) -> DataFrame:
    """Half-second clips, of which those between turns are empty."""
    short = corpus.clips(_videos(spark, d), Clips(target_s=0.5, min_s=0.0))
    return index.blank_count(index.blank_units(short, _turns(spark, d)))


@query(r"""SELECT item_id, array_to_string(list_transform(list_filter(string_split_regex(translate(text, '"', ' '), '\s+'), lambda x: x <> ''), lambda x: '"' || x || '"'), ' OR ') AS match FROM benchmark""")
def escape_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", words_of.escape_query(F.col("text")).alias("match"))


# --- segmentation -------------------------------------------------------------------------------------------------


@query(f"WITH {_WORDS} {_fixed_sql('videos', 'duration_s', 16.0, 16.0, 8.0, 'video_id')}")
def fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    return _clips(spark, d).drop("unit_id")


@query(_fixed_sql("documents", "CAST(n_chars AS DOUBLE)", 400.0, 250.0, 100.0, "doc_id"))
def hopping_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows over the characters of each document that overlap."""
    spans = segment.fixed_spans(F.col("n_chars").cast("double"), 400.0, 250.0, 100.0)
    return table(spark, d, "documents").select("doc_id", F.posexplode(spans).alias("unit_no", "s")).select("doc_id", F.col("unit_no").cast("long").alias("unit_no"), "s.t_start", "s.t_end")


_SECONDS = "seconds AS (SELECT CAST(user_id AS VARCHAR) AS video_id, event_id, CAST(floor(epoch_us(ts) / 1000000) - 1704067200 AS DOUBLE) AS t, value, event_type FROM events)"
_SHOTS = f"""{_SECONDS}, own AS (SELECT DISTINCT video_id, t FROM seconds),
    shots AS MATERIALIZED (SELECT video_id, t AS t_start, lead(t) OVER w AS t_end, row_number() OVER w AS k FROM own WINDOW w AS (PARTITION BY video_id ORDER BY t) QUALIFY t_end IS NOT NULL)"""


def _accumulated_sql(items: str, least: float, most: float, short: float, rest: str, rest_if: str = "true") -> str:
    """CTEs from `items` (video_id, k from 1, t_start, t_end) and totals (video_id, rest): `final` has the spans."""
    return f"""
        steps AS (
            SELECT video_id, k, t_start AS open, t_end, t_end - t_start >= {least} AS closed FROM {items} WHERE k = 1
            UNION ALL
            SELECT i.video_id, i.k, CASE WHEN s.closed THEN i.t_start ELSE s.open END, i.t_end, i.t_end - CASE WHEN s.closed THEN i.t_start ELSE s.open END >= {least}
            FROM steps s JOIN {items} i ON i.video_id = s.video_id AND i.k = s.k + 1
        ), lasts AS (SELECT video_id, max(k) AS k FROM steps GROUP BY video_id),
        spans AS (
            SELECT video_id, open AS a, t_end AS b FROM steps WHERE closed
            UNION ALL
            SELECT s.video_id, open, {rest} FROM steps s JOIN lasts USING (video_id, k) JOIN totals USING (video_id) WHERE NOT closed AND {rest_if}
        ), pieces AS (
            SELECT video_id, a + i * ((b - a) / n) AS t_start, CASE WHEN i = n - 1 THEN b ELSE a + (i + 1) * ((b - a) / n) END AS t_end
            FROM (SELECT *, greatest(CAST(ceil((b - a) / {most}) AS BIGINT), 1) AS n FROM spans), unnest(range(0, n)) AS r(i)
        ), counted AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY video_id) AS n, lead(t_start) OVER w AS next_a, lead(t_end) OVER w AS next_b FROM pieces WINDOW w AS (PARTITION BY video_id ORDER BY t_start, t_end)),
        final AS (
            SELECT video_id, i - 1 AS unit_no, t_start, CASE WHEN i = n - 1 AND next_b - next_a < {short} THEN next_b ELSE t_end END AS t_end
            FROM counted WHERE NOT (n >= 2 AND i = n AND t_end - t_start < {short})
        )
    """


@query(f"WITH RECURSIVE {_SHOTS}, totals AS (SELECT video_id, max(t_end) + 86400 AS rest FROM shots GROUP BY video_id), {_accumulated_sql('shots', 86400.0, 172800.0, 43200.0, 'rest', 'rest > open')} SELECT * FROM final")
def shot_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user as shots, gathered to days."""
    shots = corpus.event_shots(_seconds(spark, d)).groupBy("video_id").agg((F.max("t_end") + 86_400).alias("duration_s"), F.array_sort(F.collect_list(F.struct("t_start", "t_end"))).alias("shots"))
    spans = shots.select("video_id", F.posexplode(segment.shot_spans(F.col("shots"), F.col("duration_s"), **DAYS)).alias("unit_no", "s"))
    return spans.select("video_id", F.col("unit_no").cast("long").alias("unit_no"), "s.t_start", "s.t_end")


_CHAPTERS = f"{_WORDS}, chapters AS MATERIALIZED (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t_start, t_end) AS k, t_start, t_end FROM turns), totals AS (SELECT video_id, max_by(t_end, k) AS rest FROM chapters GROUP BY video_id)"


@query(f"WITH RECURSIVE {_CHAPTERS}, {_accumulated_sql('chapters', 120.0, 300.0, 120.0, 'rest')} SELECT * FROM final")
def chapter_windows(spark: SparkSession, d: str) -> DataFrame:
    scenes = _videos(spark, d).select("video_id", F.posexplode(segment.chapter_spans(F.col("chapters"), F.col("duration_s"), Scenes())).alias("unit_no", "s"))
    return scenes.select("video_id", F.col("unit_no").cast("long").alias("unit_no"), "s.t_start", "s.t_end")


_ENDS = r"""regexp_matches(regexp_replace(text, '["''”’)\]»]+$', ''), '[.!?…]$')"""


@query(rf"""WITH RECURSIVE {_WORDS}, steps AS (
        SELECT video_id, word_no, t_start AS open, 1 AS n, 0 AS sentence_no, {_ENDS} OR t_end - t_start >= 20 AS cut FROM words WHERE word_no = 0
        UNION ALL
        SELECT w.video_id, w.word_no, CASE WHEN s.cut THEN w.t_start ELSE s.open END, CASE WHEN s.cut THEN 1 ELSE s.n + 1 END, CASE WHEN s.cut THEN s.sentence_no + 1 ELSE s.sentence_no END,
               {_ENDS.replace("text", "w.text")} OR CASE WHEN s.cut THEN 1 ELSE s.n + 1 END >= 60 OR w.t_end - CASE WHEN s.cut THEN w.t_start ELSE s.open END >= 20
        FROM steps s JOIN words w ON w.video_id = s.video_id AND w.word_no = s.word_no + 1
    )
    SELECT video_id, CAST(sentence_no AS BIGINT) AS sentence_no, min(t_start) AS t_start, max(t_end) AS t_end, count(*) AS n_words, string_agg(text, ' ' ORDER BY word_no) AS text
    FROM steps JOIN words USING (video_id, word_no) GROUP BY video_id, sentence_no""")
def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    return speech.split_sentences(_words(spark, d), Speech())


@query(f"""WITH RECURSIVE {_WORDS}, steps AS (
        SELECT video_id, word_no, t_start AS open, 0 AS window_no FROM words WHERE word_no = 0
        UNION ALL
        SELECT w.video_id, w.word_no, CASE WHEN w.t_end - s.open > 20 THEN w.t_start ELSE s.open END, CASE WHEN w.t_end - s.open > 20 THEN s.window_no + 1 ELSE s.window_no END
        FROM steps s JOIN words w ON w.video_id = s.video_id AND w.word_no = s.word_no + 1
    )
    SELECT video_id, CAST(window_no AS BIGINT) AS window_no, min(word_no) AS first_word, count(*) AS n_words, min(t_start) AS t_start, max(t_end) AS t_end FROM steps JOIN words USING (video_id, word_no) GROUP BY video_id, window_no""")
def align_windows(spark: SparkSession, d: str) -> DataFrame:
    return speech.align_windows(_words(spark, d), 20.0)


_ORDERS = "orders_of AS (SELECT o_custkey, CAST(floor(epoch_us(o_orderdate) / 86400000000) AS DOUBLE) AS t, o_orderkey, o_totalprice FROM orders)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000).cast("double")
    return table(spark, d, "orders").select("o_custkey", day.alias("t"), "o_orderkey", "o_totalprice")


@query(f"""WITH {_ORDERS}, s AS (SELECT o_orderkey, t AS a, t + floor(o_totalprice / 1000) AS b FROM orders_of), p AS (SELECT *, greatest(CAST(ceil((b - a) / 64) AS BIGINT), 1) AS n FROM s)
    SELECT o_orderkey, i AS piece, a + i * ((b - a) / n) AS t_start, CASE WHEN i = n - 1 THEN b ELSE a + (i + 1) * ((b - a) / n) END AS t_end FROM p, unnest(range(0, n)) AS r(i)""")
def split_spans(spark: SparkSession, d: str) -> DataFrame:
    """Orders as spans of days by their price, split at 64."""
    spans = _orders(spark, d).select("o_orderkey", F.struct(F.col("t").alias("t_start"), (F.col("t") + F.floor(F.col("o_totalprice") / 1000)).alias("t_end")).alias("s"))
    return spans.select("o_orderkey", F.posexplode(segment.split_long(F.col("s"), 64.0)).alias("piece", "p")).select("o_orderkey", F.col("piece").cast("long").alias("piece"), "p.t_start", "p.t_end")


_GAPS = f"{_ORDERS}, days AS (SELECT DISTINCT o_custkey, t FROM orders_of), gaps AS (SELECT o_custkey, t AS t_start, lead(t) OVER (PARTITION BY o_custkey ORDER BY t) AS t_end FROM days QUALIFY t_end IS NOT NULL)"


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    days = _orders(spark, d).select("o_custkey", "t").distinct()
    return days.select("o_custkey", F.col("t").alias("t_start"), F.lead("t").over(Window.partitionBy("o_custkey").orderBy("t")).alias("t_end")).where("t_end IS NOT NULL")


@query(f"""WITH {_GAPS}, c AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_custkey) AS n, lead(t_end - t_start) OVER w AS next_len, lead(t_end) OVER w AS next_b FROM gaps WINDOW w AS (PARTITION BY o_custkey ORDER BY t_start))
    SELECT o_custkey, t_start, CASE WHEN i = n - 1 AND next_len < 60 THEN next_b ELSE t_end END AS t_end FROM c WHERE NOT (n >= 2 AND i = n AND t_end - t_start < 60)""")
def absorb_runt(spark: SparkSession, d: str) -> DataFrame:
    spans = _gaps(spark, d).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("t_start", "t_end"))).alias("spans"))
    return spans.select("o_custkey", F.explode(segment.absorb_tail(F.col("spans"), 60.0)).alias("s")).select("o_custkey", "s.*")


@query(f"""WITH {_GAPS}, b AS (SELECT o_custkey, min(t_start) + 10 AS off, max(t_end) - min(t_start) - 20 AS dur FROM gaps GROUP BY o_custkey),
    k AS (SELECT o_custkey, dur, least(greatest(t_start - off, 0), dur) AS a, least(greatest(t_end - off, 0), dur) AS z FROM gaps JOIN b USING (o_custkey)),
    o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM k WHERE z > a AND dur > 0 WINDOW w AS (PARTITION BY o_custkey ORDER BY a, z))
    SELECT o_custkey, CASE WHEN i = 1 THEN 0.0::DOUBLE ELSE a END AS t_start, CASE WHEN i = n THEN dur ELSE z END AS t_end FROM o
    UNION ALL SELECT o_custkey, 0.0::DOUBLE, dur FROM b WHERE dur > 0 AND o_custkey NOT IN (SELECT o_custkey FROM o)""")
def shot_close(spark: SparkSession, d: str) -> DataFrame:
    """Gaps between orders as boundaries that reach past a duration on both sides."""
    spans = F.array_sort(F.collect_list(F.struct("t_start", "t_end")))
    b = _gaps(spark, d).groupBy("o_custkey").agg((F.min("t_start") + 10).alias("off"), (F.max("t_end") - F.min("t_start") - 20).alias("dur"), spans.alias("s"))
    moved = F.transform("s", lambda x: F.struct((x["t_start"] - F.col("off")).alias("t_start"), (x["t_end"] - F.col("off")).alias("t_end")))
    return b.select("o_custkey", F.explode(segment.close_shots(moved, F.col("dur"))).alias("x")).select("o_custkey", "x.*")


@query(f"WITH {_SECONDS}, spans AS (SELECT video_id, t AS t_start, t + 21600 AS t_end, value AS score, event_id AS unit_id FROM seconds), {_MERGE.format(gap=7200, rows='spans')}")
def merge_spans(spark: SparkSession, d: str) -> DataFrame:
    return _listed(intervals.ranked_spans(intervals.merge_spans(corpus.event_spans(_seconds(spark, d), 21_600.0), 7_200.0)))


@query(ORACLE_SQL["split_sentences"])
def timeline_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of split_sentences, by cuts that no task follows through a whole conversation."""
    return speech.sentences_of_timeline(_words(spark, d), Speech())


@query(ORACLE_SQL["align_windows"])
def timeline_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows of align_windows in the same way."""
    return speech.windows_of_timeline(_words(spark, d), 20.0)


@query(f"WITH {_SECONDS}, spans AS (SELECT video_id, t AS t_start, t + 21600 AS t_end, value AS score, event_id AS unit_id FROM seconds), {_MERGE.format(gap=7200, rows='spans')}")
def timeline_islands(spark: SparkSession, d: str) -> DataFrame:
    """The runs of merge_spans, sorted within days."""
    return _listed(timelines.merge_islands(corpus.event_spans(_seconds(spark, d), 21_600.0), 7_200.0, bucket_s=86_400.0))


_MIXED = "long_and_short AS (SELECT video_id, event_id AS id, t AS t_start, t + CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3600 ELSE 86400 END AS t_end FROM seconds), asked AS (SELECT video_id, event_id AS id, t - 300 AS t_start, t + value AS t_end FROM seconds)"


@query(f"WITH {_SECONDS}, {_MIXED} SELECT a.video_id, a.id, b.id AS b_id FROM long_and_short a JOIN asked b ON a.video_id = b.video_id AND b.t_start < a.t_end AND b.t_end > a.t_start")
def dyadic_join(spark: SparkSession, d: str) -> DataFrame:
    """Spans of a second, an hour and a day from each event, and spans of minutes around them."""
    seconds = _seconds(spark, d)
    length = F.element_at(F.array(F.lit(1), F.lit(3600), F.lit(86_400)), (F.col("event_id") % 3 + 1).cast("int"))
    mixed = seconds.select("video_id", F.col("event_id").alias("id"), F.col("t").alias("t_start"), (F.col("t") + length).alias("t_end"))
    asked = seconds.select("video_id", F.col("event_id").alias("id"), (F.col("t") - 300).alias("t_start"), (F.col("t") + F.col("value")).alias("t_end"))
    return timelines.overlaps(mixed, asked).select("video_id", "id", "b_id")


_FRAMES = """frames AS (
        SELECT CAST(vec_id % 5 AS VARCHAR) AS video_id, vec_id // 5 AS frame_no, list_transform(embedding, lambda x: greatest(0, least(255, CAST(floor(128 + 400 * CAST(x AS DOUBLE)) AS INTEGER)))) AS p
        FROM embeddings WHERE len(embedding) = 64
    ), met AS (SELECT *, lag(p) OVER w AS q, row_number() OVER w AS k FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_no)),
    scored AS MATERIALIZED (SELECT video_id, frame_no / 25 AS t, k, coalesce(list_sum(list_transform(list_zip(p, q), lambda x: abs(x[1] - x[2]))) / 64 / 3, 0) >= 18.5 AS differs FROM met),
    steps AS (
        SELECT video_id, k, t, k AS first FROM scored WHERE k = 1
        UNION ALL
        SELECT s.video_id, s.k, s.t, CASE WHEN s.differs AND s.k - p.first >= 4 THEN s.k ELSE p.first END FROM steps p JOIN scored s ON s.video_id = p.video_id AND s.k = p.k + 1
    ), scenes AS (SELECT video_id, first, min(t) AS t_start, max(t) AS last FROM steps GROUP BY video_id, first)"""


@query(f"""WITH RECURSIVE {_FRAMES} SELECT video_id, t_start, coalesce(lead(t_start) OVER (PARTITION BY video_id ORDER BY first), last) AS t_end FROM scenes
    QUALIFY count(*) OVER (PARTITION BY video_id) > 1""")
def scene_cuts(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as grey frames of 8 by 8 pixels of five videos; a scene has four frames at least."""
    byte = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 400 * x.cast("double")).cast("int"))))
    pixels = F.unhex(F.array_join(F.transform(byte, lambda x: F.repeat(F.lpad(F.hex(x), 2, "0"), 3)), ""))
    rows = table(spark, d, "embeddings").where(F.size("embedding") == 64)
    no = F.floor(F.col("vec_id") / 5)
    frames = rows.select((F.col("vec_id") % 5).cast("string").alias("video_id"), no.alias("frame_no"), (no / 25).alias("t"), F.lit(8).alias("height"), F.lit(8).alias("width"), pixels.alias("pixels"))
    return scenes.scene_boundaries(scenes.frame_scores(frames), threshold=18.5, least_frames=4)


@query(ORACLE_SQL["fixed_windows"])
def sql_windows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of fixed_windows by the registered table function."""
    table_functions.register(spark)
    _videos(spark, d).createOrReplaceTempView("tidemark_videos")
    return spark.sql("SELECT v.video_id, w.unit_no, w.t_start, w.t_end FROM tidemark_videos AS v, LATERAL fixed_windows(v.duration_s, 16.0D, 16.0D, 8.0D) AS w")


@query(ORACLE_SQL["split_sentences"])
def sql_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The rows of split_sentences by the registered table function, which reads a video's words one after the other."""
    table_functions.register(spark)
    _words(spark, d).createOrReplaceTempView("tidemark_words")
    return spark.sql("SELECT video_id, sentence_no, t_start, t_end, n_words, text FROM split_sentences(TABLE(SELECT video_id, t_start, t_end, text FROM tidemark_words) PARTITION BY video_id ORDER BY (t_start, t_end, text))")


_DENSITY = r"spoken AS (SELECT video_id, sum(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))) AS n FROM turns GROUP BY video_id), dense AS (SELECT v.video_id, duration_s, coalesce(n, 0) / duration_s AS density FROM videos v LEFT JOIN spoken USING (video_id))"


@query(f"WITH {_WORDS}, {_DENSITY} SELECT video_id, round(density, 9) AS density FROM dense")
def speech_density(spark: SparkSession, d: str) -> DataFrame:
    all_turns = _turns(spark, d)
    return segment.speech_density(corpus.videos(all_turns), all_turns).select("video_id", F.round("density", 9).alias("density"))


_ROUTED = f"""{_CHAPTERS}, {_DENSITY}, silent AS (SELECT * FROM dense WHERE density < {DENSE}), quiet AS MATERIALIZED (SELECT c.* FROM chapters c JOIN silent USING (video_id)),
    spoken_units AS (SELECT video_id, unit_no, t_start, t_end, CAST(NULL AS VARCHAR) AS flags FROM ({_fixed_sql(f"(SELECT * FROM dense WHERE density >= {DENSE})", "duration_s", 16.0, 16.0, 8.0, "video_id")}))"""
_SILENT_UNITS = _accumulated_sql("quiet", 16.0, 30.0, 8.0, "duration_s", "duration_s > open").replace("JOIN totals", "JOIN silent")
_SCENES = _accumulated_sql("chapters", 120.0, 300.0, 120.0, "rest")
for _name in ("steps", "lasts", "spans", "pieces", "counted", "final"):
    _SCENES = _SCENES.replace(f"{_name} AS (", f"scene_{_name} AS (").replace(f"FROM {_name}", f"FROM scene_{_name}").replace(f"JOIN {_name}", f"JOIN scene_{_name}")
_UNITS = f"""WITH RECURSIVE {_ROUTED}, {_SILENT_UNITS}, {_SCENES},
    clip_units AS MATERIALIZED (SELECT * FROM spoken_units UNION ALL SELECT video_id, unit_no, t_start, t_end, 'silent' FROM final),
    parents AS (SELECT c.video_id, c.unit_no, min_by(s.unit_no, s.t_start) AS parent_no FROM clip_units c JOIN scene_final s ON s.video_id = c.video_id AND s.t_start <= (c.t_start + c.t_end) / 2 AND (c.t_start + c.t_end) / 2 < s.t_end GROUP BY ALL)"""


def _segmented(spark: SparkSession, d: str) -> DataFrame:
    all_turns = _turns(spark, d)
    return segment.segment(corpus.videos(all_turns), all_turns, all_turns, replace(Settings(), silent_words_per_s=DENSE))


@query(f"{_UNITS} SELECT video_id, unit_no, flags, t_start, t_end FROM clip_units")
def unit_routing(spark: SparkSession, d: str) -> DataFrame:
    return _segmented(spark, d).where("level = 0").select("video_id", "unit_no", "flags", "t_start", "t_end")


@query(f"{_UNITS} SELECT video_id, unit_no, parent_no FROM clip_units LEFT JOIN parents USING (video_id, unit_no)")
def clip_parent(spark: SparkSession, d: str) -> DataFrame:
    return _segmented(spark, d).where("level = 0").select("video_id", "unit_no", "parent_no")


@query(f"{_UNITS} SELECT video_id, 0 AS level, unit_no, t_start, t_end, flags, parent_no FROM clip_units LEFT JOIN parents USING (video_id, unit_no) UNION ALL SELECT video_id, 1, unit_no, t_start, t_end, NULL, NULL FROM scene_final")
def units(spark: SparkSession, d: str) -> DataFrame:
    return _segmented(spark, d)


# --- speech -------------------------------------------------------------------------------------------------------

_SEGMENTS = "segments AS (SELECT event_id, event_type AS text, value / 500 AS no_speech_prob, -value / 200 AS avg_logprob FROM events)"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("text"), (F.col("value") / 500).alias("no_speech_prob"), (-F.col("value") / 200).alias("avg_logprob"))


@query(f"WITH {_SEGMENTS} SELECT event_id, text, no_speech_prob, avg_logprob FROM segments WHERE NOT no_speech_prob > 0.6 AND NOT avg_logprob < -1 AND trim(text) <> ''")
def gate_segments(spark: SparkSession, d: str) -> DataFrame:
    return speech.gate_segments(_segments(spark, d), Speech())


@query(r"SELECT conv_id, turn, i - 1 AS pos, w[i] AS text FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations), unnest(range(1, len(w) + 1)) AS r(i)")
def flatten_words(spark: SparkSession, d: str) -> DataFrame:
    words = F.transform(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != ""), lambda x: F.struct(x.alias("text")))
    return speech.flatten_words(table(spark, d, "conversations").select("conv_id", "turn", words.alias("words")), ["conv_id", "turn"])


@query(f"""WITH {_WORDS}, updates AS (SELECT video_id, word_no, t_start + 0.125 AS new_start, t_end - 0.125 AS new_end FROM words WHERE regexp_replace(lower(text), '[^a-z'']', '', 'g') <> '')
    SELECT video_id, word_no, coalesce(new_start, w.t_start) AS t_start, coalesce(new_end, w.t_end) AS t_end FROM words w LEFT JOIN updates USING (video_id, word_no)""")
def retime_words(spark: SparkSession, d: str) -> DataFrame:
    """Words with letters of the acoustic alphabet get new times by place in arrays, the others keep theirs."""
    words = _words(spark, d).select("video_id", "word_no", "t_start", "t_end", "text")
    new = F.when(normalize_word(F.col("text")) != "", F.struct((F.col("t_start") + 0.125).alias("t_start"), (F.col("t_end") - 0.125).alias("t_end")))
    by_video = words.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("word_no", F.struct("video_id", "word_no").alias("id"), new.alias("span")))).alias("x"))
    updates = speech.aligned_updates(by_video.select(F.col("x.id").alias("word_ids"), F.col("x.span").alias("spans")))
    return speech.retime(words.drop("text"), updates.select("word_id.*", "new_start", "new_end"), ["video_id", "word_no"])


@query(f"""WITH {_WORDS} SELECT video_id, word_no, greatest(0, CAST(trunc((t_start - 0.5) * 16000) AS BIGINT)) AS first_sample, least(CAST(trunc(duration_s * 16000) AS BIGINT), CAST(trunc((t_end + 0.5) * 16000) AS BIGINT)) AS end_sample
    FROM words JOIN videos USING (video_id)""")
def sample_windows(spark: SparkSession, d: str) -> DataFrame:
    words = _words(spark, d)
    first, end = sample_range(F.col("t_start"), F.col("t_end"), 0.5, 16_000, (F.col("duration_s") * 16_000).cast("long"))
    durations = words.groupBy("video_id").agg(F.max("t_end").alias("duration_s"))
    return words.join(durations, "video_id").select("video_id", "word_no", first.alias("first_sample"), end.alias("end_sample"))


@query(f"WITH {_WORDS} SELECT video_id, word_no, regexp_replace(lower(text), '[^a-z'']', '', 'g') AS word FROM words")
def normalize_words(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).select("video_id", "word_no", normalize_word(F.col("text")).alias("word"))


@query(f"""WITH {_WORDS}, n AS (SELECT video_id, word_no, regexp_replace(lower(text), '[^a-z'']', '', 'g') AS word FROM words)
    SELECT video_id, word_no, array_to_string(list_transform(string_split(word, ''), lambda c: CASE WHEN c = '''' THEN 1 ELSE ascii(c) - 95 END), ',') AS ids FROM n WHERE word <> ''""")
def encode_words(spark: SparkSession, d: str) -> DataFrame:
    encoded = speech.encode_words(_words(spark, d), LETTERS)
    return encoded.select("video_id", "word_no", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


_SPELT = f"""{_WORDS}, spelt AS (
        SELECT video_id, word_no // 8 AS part, word_no, t_start, list_transform(list_filter(string_split(regexp_replace(lower(text), '[^a-z\'\']', '', 'g'), ''), lambda c: c <> ''), lambda c: CASE WHEN c = '\'\'' THEN 1 ELSE ascii(c) - 95 END) AS ids FROM words
    ), letters AS (SELECT video_id, part, word_no, i, ids[i] AS id FROM spelt, unnest(range(1, len(ids) + 1)) AS r(i)),
    framed AS (SELECT *, 2 + coalesce(sum(id % 3 + 2) OVER (PARTITION BY video_id, part ORDER BY word_no, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM letters),
    began AS (SELECT video_id, part, min(t_start) AS t FROM spelt GROUP BY video_id, part)"""


@query(f"""WITH {_SPELT} SELECT video_id, word_no, round(t + min(first) * 0.02::DOUBLE, 6) AS t_start, round(t + max(first + id % 3 + 1) * 0.02::DOUBLE, 6) AS t_end FROM framed JOIN began USING (video_id, part) GROUP BY video_id, word_no, t""")
def force_align(spark: SparkSession, d: str) -> DataFrame:
    """Each eight words against scores that favour one class a frame: a letter for one to three frames by its id, then a blank."""
    words = _words(spark, d).withColumn("ids", encode_word(F.col("text"), F.create_map(*(F.lit(x) for pair in LETTERS.items() for x in pair))))
    rows = words.groupBy("video_id", F.floor(F.col("word_no") / 8)).agg(F.min("t_start").alias("t_offset"), F.array_sort(F.collect_list(F.struct("word_no", "ids"))).alias("w"))
    letters = F.flatten(F.transform(F.flatten("w.ids"), lambda i: F.concat(F.array_repeat(i, i % 3 + 1), F.array(F.lit(0)))))
    rows = rows.withColumn("frames", F.concat(F.array(F.lit(0), F.lit(0)), letters)).withColumn("n_frames", F.size("frames"))
    # A row of scores for each class, made once as a literal; a frame takes its own.
    classes = F.array(*(F.array(*(F.lit(-0.1 if c == f else -5.0).cast("float") for c in range(len(LETTERS) + 1))) for f in range(len(LETTERS) + 1)))
    scores = F.flatten(F.transform("frames", lambda f: F.get(classes, f)))
    windows = rows.select(
        F.transform("w", lambda x: F.struct("video_id", x["word_no"].alias("word_no"))).alias("word_ids"), F.col("w.ids").alias("tokens"), scores.alias("scores"), "n_frames", (F.col("n_frames") * 320).alias("n_samples"), "t_offset"
    )
    found = speech.aligned_updates(align.force_align(windows))
    return found.select("word_id.*", F.round("new_start", 6).alias("t_start"), F.round("new_end", 6).alias("t_end"))


# --- stages, integrity, scalars -----------------------------------------------------------------------------------

_RUNS = "runs AS (SELECT o_orderkey AS id, o_custkey AS video_id, o_orderpriority AS pass_name, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, 'h' || CAST(year(o_orderdate) AS VARCHAR) AS config_hash FROM orders)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("video_id"), F.col("o_orderpriority").alias("pass_name"), status.alias("status"), F.concat(F.lit("h"), F.year("o_orderdate").cast("string")).alias("config_hash")
    )


@query(f"WITH {_RUNS} SELECT c_custkey AS video_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.video_id = c_custkey AND pass_name = '1-URGENT' AND config_hash = 'h1995' AND status = 'ok')")
def pending_videos(spark: SparkSession, d: str) -> DataFrame:
    videos = table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"))
    return stages.pending(videos, _runs(spark, d), "1-URGENT", "h1995").orderBy("video_id")


@query(f"WITH {_RUNS} SELECT DISTINCT video_id FROM runs WHERE pass_name = '1-URGENT' AND config_hash = 'h1995' AND status = 'ok'")
def stage_done(spark: SparkSession, d: str) -> DataFrame:
    return stages.stage_done(_runs(spark, d), "1-URGENT", "h1995")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, 1::BIGINT AS generation FROM orders WHERE o_custkey % 3 <> 0
    UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, 2 FROM orders WHERE o_custkey % 3 = 0 AND o_custkey % 2 = 1 AND o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, 3 FROM orders WHERE o_custkey % 6 = 0 AND o_orderstatus = 'O'""")
def replace_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Orders of customers in three generations: all; those of every third customer anew, only finished ones; of those with even numbers once more, only open ones."""
    orders, customers = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), table(spark, d, "customer").select("c_custkey")
    store = Store(spark, f"{shared_folder(spark)}/replace_by_key/{uuid.uuid4().hex}")
    for n, (own, kept) in enumerate((("true", "true"), ("o_custkey % 3 = 0", "o_orderstatus = 'F'"), ("o_custkey % 6 = 0", "o_orderstatus = 'O'")), 1):
        rows = orders.where(f"{own} AND {kept}").withColumn("generation", F.lit(n).cast("long"))
        store.commit({"orders": Replace(rows, "o_custkey", customers.where(own.replace("o_", "c_")))})
    return store.read("orders")


@query(f"WITH {_RUNS}, lines AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1) SELECT pass_name, status, count(*) AS n_runs, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_out FROM runs LEFT JOIN lines USING (id) GROUP BY ALL")
def stage_rows_out(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return _runs(spark, d).join(lines, "id", "left").groupBy("pass_name", "status").agg(F.count(F.lit(1)).alias("n_runs"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_out"))


@query("""SELECT 'labels.doc_id' AS reference, CAST(doc_id AS BIGINT) AS missing FROM labels WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)
    UNION ALL SELECT 'orders.o_custkey', o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'customer.without_orders', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT 'documents.unlabelled', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)
    UNION ALL SELECT 'events.user_id', user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)""")
def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    checks = [("labels.doc_id", "labels", "doc_id", "documents", "doc_id"), ("orders.o_custkey", "orders", "o_custkey", "customer", "c_custkey"), ("customer.without_orders", "customer", "c_custkey", "orders", "o_custkey")]
    checks += [("documents.unlabelled", "documents", "doc_id", "labels", "doc_id"), ("events.user_id", "events", "user_id", "customer", "c_custkey")]
    parts = [orphans(table(spark, d, child), table(spark, d, parent), column, key).select(F.lit(name).alias("reference"), F.col(column).cast("long").alias("missing")) for name, child, column, parent, key in checks]
    return reduce(DataFrame.unionByName, parts)


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), lost AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM gone))
    SELECT 'videos' AS name, count(*) AS n, 0::BIGINT AS n_null FROM customer WHERE c_custkey NOT IN (FROM gone)
    UNION ALL SELECT 'units', count(*), count(*) FILTER (WHERE (o_orderkey // 2) IN (FROM lost)) FROM orders WHERE o_custkey NOT IN (FROM gone)
    UNION ALL SELECT 'captions', count(*), 0 FROM lineitem WHERE l_orderkey NOT IN (FROM lost)""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Customers as videos, orders as units (the parent is the unit of half the number), line items as captions; one nation's videos go."""
    held = {
        "videos": table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"), "c_nationkey"),
        "units": table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("video_id"), F.floor(F.col("o_orderkey") / 2).alias("parent_id")),
        "captions": table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("id"), F.col("l_orderkey").alias("unit_id")),
    }
    left = removed(held, "videos", held["videos"].where("c_nationkey = 3").select("video_id"))
    rows = [left[x].agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("parent_id").isNull()) if x == "units" else F.lit(0).cast("long")).alias("n_null")).select(F.lit(x).alias("name"), "n", "n_null") for x in held]
    return reduce(DataFrame.unionByName, rows)


_RATE = "CAST(l_quantity * 1000 AS BIGINT) || '/' || CAST(CAST(round(l_tax * 100) AS BIGINT) * 1001 AS VARCHAR)"


def _rates(spark: SparkSession, d: str) -> DataFrame:
    rate = F.concat((F.col("l_quantity") * 1000).cast("long").cast("string"), F.lit("/"), (F.round(F.col("l_tax") * 100).cast("long") * 1001).cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rate.alias("declared"), (F.col("l_quantity")).cast("long").cast("string").alias("average"), "l_returnflag")


@query(f"SELECT l_orderkey, l_linenumber, round(CASE WHEN round(l_tax * 100) = 0 THEN 0 ELSE l_quantity * 1000 / (round(l_tax * 100) * 1001) END, 6) AS fps, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS plain FROM lineitem")
def frame_rate(spark: SparkSession, d: str) -> DataFrame:
    return _rates(spark, d).select("l_orderkey", "l_linenumber", F.round(media.frame_rate(F.col("declared")), 6).alias("fps"), media.frame_rate(F.col("average")).alias("plain"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN round(l_tax * 100) = 0 THEN 0 ELSE l_quantity * 1000 / (round(l_tax * 100) * 1001) END AS declared, l_quantity AS average FROM lineitem)
    SELECT l_orderkey, l_linenumber, CAST(average AS DOUBLE) AS fps, l_returnflag = 'R' AS has_audio, declared > 0 AND average > 0 AND abs(declared - average) > 0.05 AS is_variable_frame_rate, CAST(l_linenumber * 1.5 AS DOUBLE) AS duration_s, 640::BIGINT AS width FROM p WHERE l_returnflag <> 'N'""")
def probe_parse(spark: SparkSession, d: str) -> DataFrame:
    """Probe results made from line items: those with flag N have no video stream and give nothing."""
    kind = F.when(F.col("l_returnflag") == "N", "data").otherwise("video")
    fields = ("codec_type", "r_frame_rate", "avg_frame_rate", "width", "duration")
    stream = F.struct(*(x.alias(n) for n, x in zip(fields, (kind, F.col("declared"), F.col("average"), F.lit(640), F.lit("")), strict=True)))
    sound = F.struct(*(x.alias(n) for n, x in zip(fields, (F.when(F.col("l_returnflag") == "R", "audio").otherwise("data"), *[F.lit(None).cast("string")] * 2, F.lit(None).cast("int"), F.lit(None).cast("string")), strict=True)))
    probe = F.to_json(F.struct(F.array(sound, stream).alias("streams"), F.struct((F.col("l_linenumber") * 1.5).cast("string").alias("duration")).alias("format")))
    # A filter would evaluate all facts once more than what it lets through needs.
    found = F.explode(F.filter(F.array(probe_info(probe, 0.05)), lambda x: x.isNotNull()))
    return _rates(spark, d).select("l_orderkey", "l_linenumber", found.alias("i")).select("l_orderkey", "l_linenumber", "i.fps", "i.has_audio", "i.is_variable_frame_rate", "i.duration_s", "i.width")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, substr(sha256(props), 1, 16) AS hash16 FROM events")
def config_hash16(spark: SparkSession, d: str) -> DataFrame:
    """The hash of settings as a column; equal to config_hash() for JSON written the same way."""
    return table(spark, d, "events").select("event_id", F.substring(F.sha2("props", 256), 1, 16).alias("hash16"))
