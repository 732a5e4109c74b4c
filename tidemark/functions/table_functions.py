"""Table functions for SQL: `fixed_windows` in SQL itself, for LATERAL joins, and `split_sentences` over a table argument."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from tidemark.functions.text import CLOSING, TERMINAL
from tidemark.settings import Speech

_FIXED = """
    CREATE OR REPLACE TEMPORARY FUNCTION fixed_windows(duration DOUBLE, target DOUBLE, stride DOUBLE, least DOUBLE)
    RETURNS TABLE (unit_no BIGINT, t_start DOUBLE, t_end DOUBLE)
    RETURN
        SELECT w.i, w.i * stride, CASE WHEN duration <= target OR duration - least(w.i * stride + target, duration) < least THEN duration ELSE least(w.i * stride + target, duration) END
        FROM LATERAL explode(sequence(0L, CASE
            WHEN coalesce(duration, 0) <= 0 OR duration <= target THEN 0L
            ELSE CAST(least(greatest(CASE WHEN least > 0 THEN floor((duration - least - target) / stride) + 1 ELSE ceil((duration - target) / stride) END, 0), ceil(duration / stride) - 1) AS BIGINT)
        END)) AS w(i)
        WHERE coalesce(duration, 0) > 0
"""


class SplitSentences:
    """Holds the words of the open sentence only. The table argument is partitioned by video and in the order of words."""

    def __init__(self):
        settings = Speech()
        self.most, self.seconds, self.no, self.words, self.key, self.at = settings.max_words, settings.max_seconds, 0, [], None, None

    def eval(self, row: Row) -> Iterator[tuple]:
        if self.at is None:  # where the columns are: a row looks each name up anew
            self.at = [row.__fields__.index(x) for x in ("video_id", "t_start", "t_end", "text")]
        video, start, until, said = self.at
        self.key, end, text = row[video], row[until], row[said]
        self.words.append((row[start], end, text))
        text, first = (text or "").strip().rstrip(CLOSING), self.words[0][0]
        if text and text[-1] in TERMINAL or len(self.words) >= self.most or (first is not None and end is not None and end - first >= self.seconds):
            yield self._sentence()

    def terminate(self) -> Iterator[tuple]:
        if self.words:
            yield self._sentence()

    def _sentence(self) -> tuple:
        own, self.words, no = self.words, [], self.no
        self.no += 1
        return self.key, no, own[0][0], own[-1][1], len(own), " ".join(x[2].strip() for x in own if x[2] is not None).strip()


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    spark.sql(_FIXED)
    spark.udtf.register("split_sentences", udtf(SplitSentences, returnType="video_id string, sentence_no long, t_start double, t_end double, n_words long, text string"))
