"""Detections CSV: read (I1), clean names (I2), typed projection."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# --- fixed values: German transliteration of clean_names ---------------------
GERMAN_TRANSLITERATION = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss",
                          "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"}
# ---------------------------------------------------------------------------


def snake_name(name: str, german: bool = False) -> str:
    """One column name in snake_case (ASCII, lower case, ``_`` separated)."""
    s = name
    if german:
        for k, v in GERMAN_TRANSLITERATION.items():
            s = s.replace(k, v)
    s = s.replace("%", "_percent_").replace("#", "_number_")
    s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
    s = re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def clean_names(df: DataFrame, german: bool = False) -> DataFrame:
    """Rename every column to unique snake_case (schema only, no data pass)."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        s = snake_name(c, german)
        if s in seen:
            seen[s] += 1
            s = f"{s}_{seen[s]}"
        else:
            seen[s] = 1
        out.append(s)
    return df.toDF(*out)


def read_detections(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The detections CSV with header.

    Without ``schema`` every column is read as a string by its header name —
    no inference pass over the data, and files with additional columns work;
    ``to_detections`` picks and types the nine it needs.  With ``schema``
    (e.g. ``RAW_DETECTIONS``) the header is checked against it
    (``enforceSchema=False``) instead of mapping columns by position.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False)
    return reader.csv(path)


def to_detections(raw: DataFrame) -> DataFrame:
    """Cleaned raw CSV -> ``detections``.

    Date and time strings become one ``timestamp_ntz``; bad input yields NULL
    (``try_to_timestamp``), never an error.  Columns other than the nine kept
    ones are dropped.
    """
    df = clean_names(raw)
    stamp = F.concat_ws(" ", F.col("date"), F.col("time"))
    parsed = F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss"))
    return df.select(
        # parse in the session zone and convert back: zone-neutral round trip
        parsed.cast("timestamp_ntz").alias("zeitstempel"),
        F.col("sci_name").alias("wissenschaftlicher_name"),
        F.col("com_name").alias("deutscher_name"),
        F.col("confidence").try_cast("double").alias("erkennungswahrscheinlichkeit"),
        F.col("cutoff").try_cast("double").alias("schwellenwert"),
        F.col("sens").try_cast("double").alias("empfindlichkeit"),
        F.col("lat").try_cast("double").alias("breitengrad"),
        F.col("lon").try_cast("double").alias("laengengrad"),
        F.col("overlap").try_cast("double").alias("ueberlappung"),
    )
