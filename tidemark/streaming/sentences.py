"""Sentences of words that arrive in any order within a delay."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.table_functions import SplitSentences

OUT = "video_id string, sentence_no long, t_start double, t_end double, n_words long, text string"


def stream_sentences(words: DataFrame, *, delay: str = "60 seconds") -> DataFrame:
    """The sentences of a stream of words (video_id, t_start, t_end, text, last): those that speech.split_sentences() makes
    of all words together, whatever order they arrive in, if none comes later than the delay after others that begin later.

    A word waits in its video's state until the watermark has passed its start, then joins the open sentence; the state
    holds the words of one delay and of one sentence. A row whose `last` is true is no word: it says that its video ends,
    and once its words have passed, the sentence left open goes out and the state goes. It may come before them, at any
    time t_start. Words later than the watermark are dropped, as are rows without a video or a start.
    """
    at = F.timestamp_millis((F.col("t_start") * 1000).cast("long"))
    timed = words.where("video_id IS NOT NULL AND t_start IS NOT NULL").select(F.col("video_id").cast("string").alias("video_id"), "t_start", "t_end", "text", F.coalesce("last", F.lit(False)).alias("last"), at.alias("at")).withWatermark("at", delay)

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"waiting": [], "open": [], "no": 0, "last": False}
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.last:
                    held["last"] = True
                else:
                    held["waiting"].append([r.t_start, None if pd.isna(r.t_end) else r.t_end, r.text])
        passed = state.getCurrentWatermarkMs()
        splitter = SplitSentences()
        splitter.no, splitter.words = held["no"], [tuple(x) for x in held["open"]]
        due = sorted((x for x in held["waiting"] if int(x[0] * 1000) < passed), key=lambda x: (x[0], x[1] is not None, x[1] or 0.0, x[2] is not None, x[2] or ""))
        out = [s for start, end, text in due for s in splitter.eval({"video_id": key[0], "t_start": start, "t_end": end, "text": text})]
        waiting = [x for x in held["waiting"] if int(x[0] * 1000) >= passed]
        if held["last"] and not waiting:
            out += splitter.terminate()
            state.remove()
        else:
            state.update((json.dumps({"waiting": waiting, "open": splitter.words, "no": splitter.no, "last": held["last"]}),))
            if waiting:
                state.setTimeoutTimestamp(max(passed, min(int(x[0] * 1000) for x in waiting)) + 1)
        if out:
            yield pd.DataFrame([(key[0], *x[1:]) for x in out], columns=[x.split()[0] for x in OUT.split(", ")])

    return timed.groupBy("video_id").applyInPandasWithState(run, OUT, "data string", "append", GroupStateTimeout.EventTimeTimeout)
