"""Weather observation files (W3): one staged CSV per station and variable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnchorus.sources.detections import clean_names

# Observation files of the public weather service: ';' separated, header of
# short product codes, cells padded with blanks, -999 marks a missing value,
# hourly stamps as yyyyMMddHH.
WEATHER_CSV_OPTIONS = {"sep": ";", "header": "true", "encoding": "UTF-8",
                       "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
WEATHER_TS_FORMAT = "yyyyMMddHH"
MISSING = "-999"

# --- fixed values: the service's product codes and their readable names ------
PRODUCT_NAMES = {
    "TT_TU": "tt_tu_lufttemperatur",
    "RF_TU": "rf_tu_relative_feuchte",
    "P": "p_luftdruck_nn",
    "V_TE005": "v_te005_erdbodentemperatur_005cm",
    "RS_IND": "rs_ind_niederschlagsindikator",
    "V_N": "v_n_bedeckungsgrad",
    "R1": "r1_niederschlagshoehe",
    "SD_SO": "sd_so_sonnenscheindauer",
    "F": "f_windgeschwindigkeit",
}
# ---------------------------------------------------------------------------


def read_observation_file(spark: SparkSession, path: str,
                          ts_format: str = WEATHER_TS_FORMAT) -> DataFrame:
    """One staged file (or a folder of files with one header) -> typed frame.

    Product codes become readable names; other headers are transliterated to
    snake_case.  Every column except the time stamp is numeric in these files,
    so all are cast to double: blanks around a value and the missing marker (in
    any spelling, as -999 or -999.0) do not count, an unreadable cell becomes
    NULL.  The stamp becomes ``mess_datum`` (``timestamp_ntz``).  A file
    without any known product raises.
    """
    raw = spark.read.options(**WEATHER_CSV_OPTIONS).csv(path)
    raw = raw.toDF(*[PRODUCT_NAMES.get(c.strip(), c.strip()) for c in raw.columns])
    df = clean_names(raw, german=True)
    if not set(df.columns) & set(PRODUCT_NAMES.values()):
        raise ValueError(f"no known product in {path}: {', '.join(df.columns)}")
    cols = []
    for c in df.columns:
        value = F.trim(F.col(c))
        if c == "mess_datum":
            # hours are zone-free: parsed and shown in the same session zone
            cols.append(F.try_to_timestamp(value, F.lit(ts_format)).cast("timestamp_ntz").alias(c))
        elif c == "eor":  # end-of-record marker column
            continue
        else:
            cols.append(F.nullif(value.try_cast("double"), F.lit(float(MISSING))).alias(c))
    return df.select(*cols)


def load_weather(spark: SparkSession, paths: list[str],
                 ts_format: str = WEATHER_TS_FORMAT) -> DataFrame:
    """Read every selected station file and stack them by column name.

    Files hold different variables, so columns missing in one file become NULL
    (``unionByName(allowMissingColumns=True)``).  The list of paths is the
    (small, one per variable) output of the station search; each file itself is
    read in parallel.
    """
    frames = [read_observation_file(spark, p, ts_format) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_observation_file(df: DataFrame, path: str, ts_format: str = WEATHER_TS_FORMAT,
                           partition_by: str | None = None) -> None:
    """Stage observations in the service's file layout: padded cells, -999 for
    missing values (used by tests and queries); optionally one folder per value
    of ``partition_by``, in one write."""
    def cell(c: str) -> F.Column:
        if c == "MESS_DATUM":
            return F.date_format(F.col(c), ts_format).alias(c)
        if c == partition_by:
            return F.col(c)
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MISSING))
        return F.concat(F.lit("   "), text).alias(c)

    out = df.select(*[cell(c) for c in df.columns]).write.mode("overwrite").option("sep", ";").option("header", True)
    out = out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (out.partitionBy(partition_by) if partition_by else out).csv(path)
