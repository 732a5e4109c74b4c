"""Table schemas and their versions.

A version adds columns or tables and never takes any away, so files of an older version are read under the newest
schema with nulls where they lack a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSIONS: list[dict[str, str]] = [
    {
        "videos": "video_id string, url string, added_at double, title string, duration_s double, fps double, width long, height long, chapters string, is_vfr int",
        "shots": "id long, video_id string, t_start double, t_end double, conf double",
        "words": "id long, video_id string, t_start double, t_end double, text string, conf double",
        "sentences": "id long, video_id string, t_start double, t_end double, text string, speaker string",
        "units": "id long, video_id string, level int, t_start double, t_end double, strategy string, parent_id long, flags array<string>",
        "captions": "id long, unit_id long, captioner string, payload string",
        "ocr_spans": "id long, video_id string, t_start double, t_end double, text string, conf double, text_hash string",
        "stage_runs": "id long, video_id string, pass_name string, status string, config_hash string, started_at double, ended_at double, rows_out long, peak_mb double, error string",
    },
    {"postings": "term string, unit_id long, positions array<int>", "index_units": "unit_id long, video_id string, n_terms long"},
    {"postings": "term string, unit_id long, tf long, positions array<int>"},
]

#: child column -> parent key, and what happens when the parent goes.
REFERENCES = {
    ("shots", "video_id"): ("videos", "video_id", "cascade"),
    ("words", "video_id"): ("videos", "video_id", "cascade"),
    ("sentences", "video_id"): ("videos", "video_id", "cascade"),
    ("ocr_spans", "video_id"): ("videos", "video_id", "cascade"),
    ("units", "video_id"): ("videos", "video_id", "cascade"),
    ("units", "parent_id"): ("units", "id", "set null"),
    ("captions", "unit_id"): ("units", "id", "cascade"),
}


def schemas(version: int | None = None) -> dict[str, StructType]:
    out: dict[str, StructType] = {}
    for step in VERSIONS[: len(VERSIONS) if version is None else version]:
        for name, ddl in step.items():
            out[name] = StructType.fromDDL(ddl)
    return out


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(schemas()[name]).parquet(f"{root}/{name}")


def orphans(child: DataFrame, parent: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose reference has no parent; a null reference isn't one."""
    return child.where(f"{column} IS NOT NULL").join(parent.select(parent[key].alias(column)).distinct(), column, "left_anti")


def removed(tables: dict[str, DataFrame], table: str, keys: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of `table` whose key is among `keys` (one column), and what hangs from those rows.

    Children whose reference cascades go with their parents, as far down as references lead; a reference that is set null
    loses its value. Each step is an anti or semi join on the key; tables that no reference reaches are as they were.
    """
    out, key = dict(tables), keys.columns[0]
    waiting = [(table, key, keys)]
    while waiting:
        name, column, gone = waiting.pop(0)
        gone = gone.select(F.col(gone.columns[0]).alias(column)).distinct()
        rows = out[name]
        lost = rows.join(gone, column, "left_semi")
        out[name] = rows.join(gone, column, "left_anti").select(*rows.columns)
        for (child, reference), (parent, parent_key, then) in REFERENCES.items():
            if parent != name or child not in out:
                continue
            parents = lost.select(F.col(parent_key).alias(reference)).distinct()
            if then == "cascade":
                waiting.append((child, reference, parents))
            else:
                marked = out[child].join(parents.withColumn("_gone", F.lit(True)), reference, "left")
                out[child] = marked.withColumn(reference, F.when(F.col("_gone").isNull(), F.col(reference))).select(*out[child].columns)
    return out
