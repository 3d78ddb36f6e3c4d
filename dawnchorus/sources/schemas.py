"""Declared schemas of the data model (no inference anywhere)."""

from pyspark.sql import types as T

RAW_DETECTIONS = T.StructType([
    T.StructField("Date", T.StringType()),
    T.StructField("Time", T.StringType()),
    T.StructField("Sci_Name", T.StringType()),
    T.StructField("Com_Name", T.StringType()),
    T.StructField("Confidence", T.DoubleType()),
    T.StructField("Cutoff", T.DoubleType()),
    T.StructField("Sens", T.DoubleType()),
    T.StructField("Lat", T.DoubleType()),
    T.StructField("Lon", T.DoubleType()),
    T.StructField("Overlap", T.DoubleType()),
])

DETECTIONS = T.StructType([
    T.StructField("zeitstempel", T.TimestampNTZType()),
    T.StructField("wissenschaftlicher_name", T.StringType()),
    T.StructField("deutscher_name", T.StringType()),
    T.StructField("erkennungswahrscheinlichkeit", T.DoubleType()),
    T.StructField("schwellenwert", T.DoubleType()),
    T.StructField("empfindlichkeit", T.DoubleType()),
    T.StructField("breitengrad", T.DoubleType()),
    T.StructField("laengengrad", T.DoubleType()),
    T.StructField("ueberlappung", T.DoubleType()),
])

WEATHER = T.StructType([
    T.StructField("wetterzeit", T.TimestampNTZType()),
    T.StructField("niederschlagsindikator", T.StringType()),
    T.StructField("niederschlagsindikator_code", T.IntegerType()),
    T.StructField("bedeckungsgrad", T.StringType()),
    T.StructField("bedeckungsgrad_in_okta", T.IntegerType()),
    T.StructField("lufttemperatur", T.DoubleType()),
    T.StructField("luftfeuchtigkeit", T.DoubleType()),
    T.StructField("luftdruck", T.DoubleType()),
    T.StructField("bodentemperatur", T.DoubleType()),
    T.StructField("niederschlagshoehe", T.DoubleType()),
    T.StructField("sonnenscheindauer", T.DoubleType()),
    T.StructField("windgeschwindigkeit", T.DoubleType()),
])

ENRICHED = T.StructType(
    [f for f in WEATHER.fields if f.name == "wetterzeit"]
    + list(DETECTIONS.fields)
    + [f for f in WEATHER.fields if f.name != "wetterzeit"]
    + [T.StructField("jahreszeit", T.StringType()),
       T.StructField("jahreszeit_nr", T.IntegerType())]
)

# Timestamp format used for every CSV written or read by the library; the
# default format drops microseconds and breaks de-duplication of snapshots.
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
