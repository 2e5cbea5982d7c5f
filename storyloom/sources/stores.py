"""Stores of rows as files: CSV with lenient types, JSON lines that grow, declared shapes of JSON, and labels as sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.columns import rounded
from storyloom.operators.records import typed
from storyloom.operators.story import latest


def save_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def load_csv(spark: SparkSession, path: str, schema: dict[str, str], key: str | None = None, order: str | None = None) -> DataFrame:
    """Rows of CSV files under a schema; what cannot be read becomes 0, false or empty. With a key, rows whose key is 0 are left out and the last of equal keys wins by `order`."""
    raw = spark.read.option("header", True).csv(path)
    rows = typed(raw.select([F.regexp_replace(F.col(c), "^﻿", "").alias(c.lstrip("﻿")) for c in raw.columns]), schema)
    return rows if key is None else latest(rows.where(F.col(key) != 0), key, [order or key])


def append_lines(rows: DataFrame, path: str) -> None:
    """Add rows to a store of JSON lines, as for work that failed and is to be done again."""
    rows.write.mode("append").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def shape_findings(rows: DataFrame, key: str, json: str, shape: dict[str, str]) -> DataFrame:
    """(key, field, problem): fields of a JSON text that are missing or not of their declared type (long, double, boolean or string)."""

    def check(field: str, kind: str) -> Column:
        value = F.get_json_object(json, f"$.{field}")
        wrong = F.lit(False) if kind == "string" else value.try_cast(kind).isNull()
        problem = F.when(value.isNull(), "missing").when(wrong, f"not {kind}")
        return F.when(problem.isNotNull(), F.struct(F.lit(field).alias("field"), problem.alias("problem")))

    found = F.array_compact(F.array(*[check(f, k) for f, k in shape.items()]))
    return rows.select(key, F.explode(found).alias("f")).select(key, "f.*")


def as_sentence(labels: dict[str, Column], joint: str = "；") -> Column:
    """The labels that are known, each after its name, as one searchable sentence."""
    return F.concat_ws(joint, *[F.when(c.isNotNull() & (c.cast("string") != "none"), F.concat(F.lit(f"{n}: "), c.cast("string"))) for n, c in labels.items()])


def speech_shares(speakers: DataFrame, key: str, most: float = 0.5, cameos: Sequence[str] = (), cameo_chars: int = 200) -> DataFrame:
    """(key, speaker, share, finding): who speaks more than half of a text's quoted characters, and who speaks at length though only passing through."""
    from pyspark.sql import Window

    share = F.col("chars") / F.sum("chars").over(Window.partitionBy(key))
    each = speakers.select(key, "speaker", "chars", share.alias("s"))
    finding = F.when(F.round("s", 9) > most, "dominates").when(F.col("speaker").isin(list(cameos)) & (F.col("chars") > cameo_chars), "cameo_monologue")
    return each.select(key, "speaker", rounded(F.round("s", 9), 3).alias("share"), finding.alias("finding")).where("finding is not null")
