"""Words and sentences of recognised speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fold import group_starts, groups, sorted_items
from tidemark.functions.text import encode_word, ends_sentence, strip
from tidemark.operators.timelines import CHUNK, Rule, greedy_groups, spans_of
from tidemark.settings import Speech


def gate_segments(segments: DataFrame, settings: Speech) -> DataFrame:
    """Without segments that are likely silence, badly recognised or blank; bounds themselves pass."""
    quiet = F.col("no_speech_prob") > settings.no_speech_threshold
    unsure = F.col("avg_logprob") < settings.min_avg_logprob
    return segments.where(~F.coalesce(quiet, F.lit(False)) & ~F.coalesce(unsure, F.lit(False)) & (strip(F.col("text")) != ""))


def flatten_words(segments: DataFrame, key: list[str], words: str = "words") -> DataFrame:
    """A row for each word of each segment, with its place in the segment."""
    return segments.select(*key, F.posexplode(words).alias("pos", "w")).select(*key, F.col("pos").cast("long").alias("pos"), "w.*").withColumn("text", strip(F.col("text")))


def split_sentences(words: DataFrame, settings: Speech, key: str = "video_id") -> DataFrame:
    """key, sentence_no, t_start, t_end, n_words, text: sentences end at punctuation, or where they reach a limit of words or seconds."""
    items = words.withColumn("ends", ends_sentence(F.col("text"))).groupBy(key).agg(sorted_items("t_start", "t_end", "text", "ends").alias("items"))

    def closes(first: Column, item: Column, n: Column) -> Column:
        return item["ends"] | (n >= settings.max_words) | (item["t_end"] - first["t_start"] >= settings.max_seconds)

    runs = items.select(key, F.posexplode(groups(F.col("items"), group_starts(F.col("items"), ["t_start"], closes, after=True))).alias("sentence_no", "run"))
    return runs.select(
        key, F.col("sentence_no").cast("long").alias("sentence_no"), F.get("run", F.lit(0))["t_start"].alias("t_start"), F.element_at("run", -1)["t_end"].alias("t_end"),
        F.size("run").cast("long").alias("n_words"), strip(F.array_join(F.transform("run", lambda w: strip(w["text"])), " ")).alias("text"),
    )


def align_windows(words: DataFrame, max_window_s: float, key: str = "video_id") -> DataFrame:
    """key, window_no, first_word, n_words, t_start, t_end: consecutive words of at most max_window_s; a longer word is alone."""
    items = words.groupBy(key).agg(sorted_items("t_start", "t_end").alias("items"))

    def closes(first: Column, item: Column, n: Column) -> Column:
        return item["t_end"] - first["t_start"] > max_window_s

    found = items.select(key, "items", group_starts(F.col("items"), ["t_start"], closes, after=False).alias("starts"))
    runs = found.select(key, "starts", F.posexplode(groups(F.col("items"), F.col("starts"))).alias("window_no", "run"))
    return runs.select(
        key, F.col("window_no").cast("long").alias("window_no"), F.get("starts", F.col("window_no")).cast("long").alias("first_word"), F.size("run").cast("long").alias("n_words"),
        F.get("run", F.lit(0))["t_start"].alias("t_start"), F.element_at("run", -1)["t_end"].alias("t_end"),
    )


def sentences_of_timeline(words: DataFrame, settings: Speech, key: str = "video_id", *, chunk: int = CHUNK) -> DataFrame:
    """The rows of split_sentences() for time lines of any length: no task has more of one than a chunk of its words."""
    rule = Rule(after=True, max_s=settings.max_seconds, max_items=settings.max_words)
    marked = words.withColumn("_stop", ends_sentence(F.col("text")))
    grouped = greedy_groups(marked.select(key, "t_start", "t_end", "text", "_stop"), rule, ["t_start", "t_end", "text", "_stop"], key=key, ends=F.col("_stop"), chunk=chunk)
    text = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda w: strip(w["text"]))
    rows = grouped.groupBy(key, F.col("group_no").alias("sentence_no")).agg(F.min_by("t_start", "pos").alias("t_start"), F.max_by("t_end", "pos").alias("t_end"), F.count(F.lit(1)).alias("n_words"), strip(F.array_join(text, " ")).alias("text"))
    return rows.select(key, "sentence_no", "t_start", "t_end", "n_words", "text")


def windows_of_timeline(words: DataFrame, max_window_s: float, key: str = "video_id", *, chunk: int = CHUNK) -> DataFrame:
    """The rows of align_windows() in the same way."""
    grouped = greedy_groups(words.select(key, "t_start", "t_end"), Rule(after=False, max_s=max_window_s, strict=True), ["t_start", "t_end"], key=key, chunk=chunk)
    return spans_of(grouped, key=key).select(key, F.col("group_no").alias("window_no"), F.col("first_pos").alias("first_word"), F.col("n").alias("n_words"), "t_start", "t_end")


def retime(words: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """words with the times of the updates (key, new_start, new_end) where there are any."""
    met = words.join(updates, key, "left")
    return met.withColumn("t_start", F.coalesce("new_start", "t_start")).withColumn("t_end", F.coalesce("new_end", "t_end")).drop("new_start", "new_end")


def aligned_updates(windows: DataFrame) -> DataFrame:
    """Rows (word_id, new_start, new_end) from the arrays word_ids and spans of the same length; null spans give none."""
    pairs = windows.select(F.inline(F.arrays_zip("word_ids", "spans")))
    return pairs.where("spans IS NOT NULL").select(F.col("word_ids").alias("word_id"), F.col("spans.t_start").alias("new_start"), F.col("spans.t_end").alias("new_end"))


def encode_words(words: DataFrame, dictionary: dict[str, int]) -> DataFrame:
    """words that have characters of the dictionary, with their ids."""
    ids = F.create_map(*(F.lit(x) for pair in dictionary.items() for x in pair))
    return words.withColumn("ids", encode_word(F.col("text"), ids)).where(F.size("ids") > 0)
