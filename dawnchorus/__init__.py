"""dawnchorus — Spark-native analytics for timestamped acoustic wildlife detections.

Every operator is a lazy function ``DataFrame -> DataFrame`` built on the public
DataFrame / SQL / ``pyspark.ml`` API.  Sub-packages:

* ``functions``  — Column-level helpers (calendar, geo, number formatting).
* ``sources``    — readers / writers (detections CSV, weather files, archive) and
                   adapters that map the driver's test tables onto the data model.
* ``operators``  — the relational operators (cleaning, weather, species statistics,
                   grids, models, report tables, event study).
* ``plans``      — compositions of operators (import flow, report, event study).
* ``streaming``  — incremental snapshot ingestion with Structured Streaming.
"""

__version__ = "0.1.0"
