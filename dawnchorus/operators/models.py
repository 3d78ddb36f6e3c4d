"""Models: hour × species matrix (M1), Kendall correlation (M2, M3), hourly
weather features (M4, M5), z-normalisation (M6), OLS with summaries (M7–M9),
coefficient chart data (M10), Poisson trends (M11, M12)."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from dawnchorus.functions.calendar import hour24
from dawnchorus.functions.labels import CI_Z, SIGNIFICANCE, TERM_LABELS
from dawnchorus.functions.stats import f_sf, t_sf2, weighted_concordance
from dawnchorus.operators.counting import n_rows
from dawnchorus.operators.species import SCIENTIFIC, SPECIES, top_species
from dawnchorus.session import ship_package, written

FEATURES = list(TERM_LABELS)


def top_names(df: DataFrame, k: int = 10, species: str = SPECIES,
              weight: str | None = None) -> list[str]:
    """The names in the top-``k`` list (R3: ranked by name and scientific name) in
    its order, each once (at most ``k`` values to the driver — needed as pivot
    values)."""
    scientific = SCIENTIFIC if SCIENTIFIC in df.columns else None
    rows = top_species(df, k, species, scientific, weight).select(species, "absolute_haeufigkeit").collect()
    return list(dict.fromkeys(r[0] for r in sorted(rows, key=lambda r: -r["absolute_haeufigkeit"])))


def hour_counts(df: DataFrame, names: list[str], ts: str = "zeitstempel",
                species: str = SPECIES, weight: str | None = None) -> DataFrame:
    """Detections per (species, date, hour 1..24) for the given species."""
    return (df.where(F.col(species).isin(*names))
            .groupBy(species, F.to_date(ts).alias("datum"), hour24(ts).alias("stunde"))
            .agg(n_rows(weight).alias("anzahl_erkennungen")))


def hour_matrix(df: DataFrame, k: int = 10, fill: int | None = None, ts: str = "zeitstempel",
                species: str = SPECIES, names: list[str] | None = None,
                weight: str | None = None) -> DataFrame:
    """M1: one row per (date, hour) with at least one top-``k`` detection, one
    column per top species holding its count.

    ``fill=None`` is the reference's result (its fill value is keyed to a column
    that does not exist, so cells without detections stay NULL); ``fill=0``
    gives the intended zeros.  Pivot values are passed explicitly (no extra
    distinct job).
    """
    names = names if names is not None else top_names(df, k, species, weight)
    m = (hour_counts(df, names, ts, species, weight)
         .groupBy("datum", "stunde").pivot(species, names).agg(F.first("anzahl_erkennungen")))
    if fill is not None:
        m = m.fillna(fill, subset=names)
    return m


def _concordance_group(pdf: pd.DataFrame) -> pd.DataFrame:
    s = weighted_concordance(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())
    return pd.DataFrame({"a": [pdf["a"].iloc[0]], "b": [pdf["b"].iloc[0]], "s": [s]})


def _blocks(bounds: str, value: str):
    """2 × (boundaries below the value), plus one when it is a boundary itself."""
    below = F.size(F.filter(bounds, lambda b: b < F.col(value)))
    return 2 * below + F.array_contains(bounds, F.col(value)).cast("int")


def kendall(matrix: DataFrame, cols: list[str], triangle: bool = False, blocks: int = 256,
            whole: int = 200_000) -> DataFrame:
    """M2: Kendall's tau-b between every pair of ``cols`` (pairwise-complete).

    Per row the value pairs of all column pairs are emitted (``k(k−1)/2`` per
    row, fixed by the number of columns) and reduced to distinct (x, y) cells
    with a weight (map-side partial aggregation).  The cells of a pair are cut
    into blocks along x and along y at quantiles (a mergeable sketch; ``blocks``
    along each; a pair of at most ``whole`` cells is one block), and every two cells
    with different x and y are counted in one of three kinds of group: cells of one
    block of x; those of one block of y, by their blocks of x; the two-way table
    of blocks.  So a group holds about a ``blocks``-th of a pair's cells (or 4·blocks²
    table cells), whatever the data; a value that many cells share is a boundary, so
    it is a block of its own and has nothing to count within.

    ``triangle=True`` returns one triangle: ``term`` is the later column in
    ``cols`` order and ``vogelart`` the earlier one; otherwise both directions.
    """
    ship_package(matrix.sparkSession)
    pairs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                pairs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                      F.col(f"`{a}`").cast("double").alias("x"),
                                      F.col(f"`{b}`").cast("double").alias("y")))
    cells = (matrix.select(F.explode(F.array(*pairs)).alias("p"))
             .select("p.*")
             .where(F.col("x").isNotNull() & F.col("y").isNotNull())
             .groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("w")))
    quantiles = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    cut = F.count(F.lit(1)) > whole
    none = F.array().cast("array<double>")

    def bounds(c):
        return F.when(cut, F.array_sort(F.array_distinct(F.percentile_approx(c, quantiles)))).otherwise(none).alias(f"{c}_bounds")

    # k(k−1)/2 rows of fixed size, so they are broadcast.
    facts = cells.groupBy("a", "b").agg(F.sum("w").alias("n"), bounds("x"), bounds("y"))
    placed = (cells.join(F.broadcast(facts.drop("n")), ["a", "b"])
              .select("a", "b", "x", "y", "w", (F.size("x_bounds") > 0).alias("cut"),
                      _blocks("x_bounds", "x").alias("bx"), _blocks("y_bounds", "y").alias("by")))
    by_x = placed.where("bx % 2 = 0").select("a", "b", F.lit(0).alias("kind"), F.col("bx").alias("part"), "x", "y", "w")
    as_block = F.col("bx").cast("double").alias("x")
    by_y = (placed.where("cut and by % 2 = 0").groupBy("a", "b", "bx", "by", "y").agg(F.sum("w").alias("w"))
            .select("a", "b", F.lit(1).alias("kind"), F.col("by").alias("part"), as_block, "y", "w"))
    table = (placed.where("cut").groupBy("a", "b", "bx", "by").agg(F.sum("w").alias("w"))
             .select("a", "b", F.lit(2).alias("kind"), F.lit(0).alias("part"), as_block, F.col("by").cast("double").alias("y"), "w"))
    parts = (by_x.unionByName(by_y).unionByName(table).groupBy("a", "b", "kind", "part")
             .applyInPandas(_concordance_group, "a string, b string, s double")
             .groupBy("a", "b").agg(F.sum("s").alias("s")))

    def ties(c):
        sums = cells.groupBy("a", "b", c).agg(F.sum("w").cast("double").alias("t"))
        return sums.groupBy("a", "b").agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"{c}_ties"))

    joined = (facts.select("a", "b", "n").join(ties("x"), ["a", "b"]).join(ties("y"), ["a", "b"]).join(parts, ["a", "b"], "left"))
    all_pairs = F.col("n") * (F.col("n") - 1) / 2
    scale = F.sqrt(F.greatest((all_pairs - F.col("x_ties")) * (all_pairs - F.col("y_ties")), F.lit(0.0)))
    out = joined.select(F.col("a").alias("term"), F.col("b").alias("vogelart"),
                        F.when((F.col("n") >= 2) & (scale > 0), F.coalesce("s", F.lit(0.0)) / scale).alias("korrelation"), "n")
    if triangle:
        return out
    # Both directions from the one result: the fit is planned, and run, once.
    both = F.array(F.struct("term", "vogelart"), F.struct(F.col("vogelart").alias("term"), F.col("term").alias("vogelart")))
    return out.select(F.explode(both).alias("p"), "korrelation", "n").select("p.*", "korrelation", "n")


def principal_order(pairs: DataFrame, cols: list[str], absolute: bool = False) -> list[str]:
    """M3's column order: the variables by their score on the first principal component of the correlation matrix.

    ``pairs`` (term, vogelart, korrelation) has each pair once or twice; a missing correlation counts as 0, a
    variable with itself as 1.  Rows of the matrix are the cases, its columns, centred, the variables, and scores ascend.  The
    component's sign is fixed by its loading of greatest size (the first of equals) being positive; equal scores go
    by the given order.  At most k² numbers come to the driver, k being the number of columns.
    """
    at = {c: i for i, c in enumerate(cols)}
    m = np.eye(len(cols))
    for r in pairs.filter(F.col("term").isin(cols) & F.col("vogelart").isin(cols)).select("term", "vogelart", "korrelation").collect():
        value = 0.0 if r["korrelation"] is None else r["korrelation"]
        m[at[r["term"]], at[r["vogelart"]]] = m[at[r["vogelart"]], at[r["term"]]] = abs(value) if absolute else value
    if not cols:
        return []
    centred = m - m.mean(axis=0)
    loading = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    sizes = np.round(np.abs(loading), 9)
    loading = loading * np.sign(loading[int(np.argmax(sizes))] or 1.0)
    scores = np.round(centred @ loading, 9)
    return [cols[i] for i in np.argsort(scores, kind="stable")]


def corr_pairs(df: DataFrame, k: int = 10, ts: str = "zeitstempel", species: str = SPECIES,
               fill: int | None = None, digits: int = 2, weight: str | None = None,
               order: str = "frequency") -> DataFrame:
    """M3: one triangle of the top-``k`` Kendall matrix in long form, NULLs
    removed, rounded.  ``order='frequency'``: by frequency rank; ``'principal'``: by the first
    principal component of the matrix, which is written once for that (k(k−1)/2 rows)."""
    names = top_names(df, k, species, weight)
    pairs = kendall(hour_matrix(df, k, fill, ts, species, names, weight), names, triangle=True)
    if order == "principal":
        pairs = written(pairs, "kendall")
        place = F.create_map(*[F.lit(v) for i, c in enumerate(principal_order(pairs, names)) for v in (c, i)]) if names else F.lit(None)
        later = place[F.col("term")] > place[F.col("vogelart")] if names else F.lit(True)
        pairs = pairs.select(F.when(later, F.col("term")).otherwise(F.col("vogelart")).alias("term"),
                             F.when(later, F.col("vogelart")).otherwise(F.col("term")).alias("vogelart"), "korrelation")
    elif order != "frequency":
        raise ValueError("order is 'frequency' or 'principal'")
    return (pairs.where(F.col("korrelation").isNotNull())
            .select("term", "vogelart", F.round("korrelation", digits).alias("korrelation")))


def hourly_features(df: DataFrame, target: str = "count", ts: str = "zeitstempel") -> DataFrame:
    """M4 / M5: per (date, hour 1..24) the target and eight weather features.

    ``target='count'``: number of detections; ``'confidence'``: mean detection
    confidence.  Means ignore NULLs; sums of precipitation and sunshine are 0
    when there is nothing to add.  Like the reference, the sums run over
    detections, so an hourly reading counts once per detection of that hour.
    """
    mean = lambda c: F.avg(F.col(c).cast("double"))
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0))
    tgt = (F.count(F.lit(1)).alias("anzahl_erkennungen") if target == "count"
           else mean("erkennungswahrscheinlichkeit").alias("erkennungswahrscheinlichkeit_in_prozent"))
    return df.groupBy(F.to_date(ts).alias("datum"), hour24(ts).alias("stunde")).agg(
        tgt,
        mean("lufttemperatur").alias("lufttemperatur_in_grad"),
        mean("luftfeuchtigkeit").alias("luftfeuchtigkeit_in_prozent"),
        mean("luftdruck").alias("luftdruck_in_hpa"),
        mean("bodentemperatur").alias("bodentemperatur_in_grad"),
        total("niederschlagshoehe").alias("niederschlagshoehe_in_mm"),
        total("sonnenscheindauer").alias("sonnenscheindauer_in_min"),
        mean("bedeckungsgrad_in_okta").alias("bedeckungsgrad_in_okta"),
        mean("windgeschwindigkeit").alias("windgeschwindigkeit_in_m_pro_s"),
    )


def normalize(df: DataFrame, cols: list[str], eager: bool = False) -> DataFrame:
    """M6: z-score each column with its mean and sample sd (NULLs skipped).

    The statistics are one global aggregate.  Lazily (default) they enter as a
    single struct scalar subquery.  ``eager=True`` computes them once (2 values
    per column) and embeds them as literals — preferable when the result feeds
    an iterative consumer such as a model fit, whose every pass would
    otherwise re-plan the subquery.  A column with sd 0 becomes NULL instead of
    dividing by 0.
    """
    aggs = [F.struct(F.avg(F.col(c).cast("double")).alias("m"),
                     F.stddev_samp(F.col(c).cast("double")).alias("s")).alias(f"c{i}")
            for i, c in enumerate(cols)]
    out = {}
    if eager:
        row = df.agg(*aggs).first()
        for i, c in enumerate(cols):
            m, sd = row[f"c{i}"]["m"], row[f"c{i}"]["s"]
            mean = F.lit(m).cast("double")
            scale = F.lit(None).cast("double") if sd in (None, 0.0) else F.lit(sd)
            out[c] = (F.col(c).cast("double") - mean) / scale
        return df.withColumns(out)
    stats = df.agg(F.struct(*aggs)).scalar()
    for i, c in enumerate(cols):
        st = stats.getField(f"c{i}")
        out[c] = (F.col(c).cast("double") - st.getField("m")) / F.nullif(st.getField("s"), F.lit(0.0))
    return df.withColumns(out)


class OlsFit:
    """A fitted OLS model with R-style summaries as DataFrames.

    Made from sufficient statistics: ``n`` complete cases, the means and the population covariance matrix of
    (y, xs).  Raises when the predictors are linearly dependent or the cases too few.
    """

    def __init__(self, spark, y: str, xs: list[str], n: int, means: np.ndarray, cov: np.ndarray):
        self.spark, self.y, self.xs, self.n, self.k = spark, y, xs, n, len(xs)
        self.df_res = n - self.k - 1
        if self.df_res < 0:
            raise ValueError(f"{n} complete cases are too few for {self.k} predictors and an intercept")
        b, self.rss, inverse = _solve_ols(n, cov)
        total = n * cov[0, 0]
        self.r2 = float(1 - self.rss / total) if total > 0 else float("nan")
        self.r2adj = 1 - (1 - self.r2) * (n - 1) / self.df_res if self.df_res else float("nan")
        s2 = self.rss / self.df_res if self.df_res else float("nan")
        x = means[1:]
        se = [math.sqrt(s2 * (1 / n + x @ inverse @ x))] + [math.sqrt(s2 * v) for v in np.diag(inverse)]
        self.terms = ["(Intercept)"] + list(xs)
        self.estimates = [float(means[0] - b @ x)] + b.tolist()
        self.std_errors = [float(v) for v in se]
        self.t_values = [e / v if v else float("nan") for e, v in zip(self.estimates, self.std_errors)]

    def tidy(self, p_values: bool = True) -> DataFrame:
        """M9: term, estimate, std_error, statistic[, p_value]."""
        rows = []
        for t, e, s, v in zip(self.terms, self.estimates, self.std_errors, self.t_values):
            r = [t, float(e), float(s), float(v)]
            if p_values:
                r.append(float(t_sf2(v, self.df_res)))
            rows.append(r)
        schema = "term string, estimate double, std_error double, statistic double"
        if p_values:
            schema += ", p_value double"
        return self.spark.createDataFrame(rows, schema)

    def glance(self, p_value: bool = True) -> DataFrame:
        """M8: one-row model summary (same fields as R's ``glance`` of ``lm``)."""
        n, k, rss = self.n, self.k, self.rss
        sigma = math.sqrt(rss / self.df_res) if self.df_res > 0 else float("nan")
        fstat = (self.r2 / k) / ((1 - self.r2) / self.df_res) if self.df_res > 0 and self.r2 < 1 else float("nan")
        loglik = -n / 2 * (math.log(2 * math.pi) + math.log(rss / n) + 1)
        row = {"r_squared": self.r2, "adj_r_squared": self.r2adj, "sigma": sigma,
               "statistic": fstat}
        if p_value:
            row["p_value"] = f_sf(fstat, k, self.df_res)
        row.update({"df": float(k), "loglik": loglik, "aic": -2 * loglik + 2 * (k + 2),
                    "bic": -2 * loglik + math.log(n) * (k + 2), "deviance": rss,
                    "df_residual": int(self.df_res), "nobs": int(n)})
        fields = [T.StructField(c, T.LongType() if c in ("df_residual", "nobs") else T.DoubleType())
                  for c in row]
        return self.spark.createDataFrame([tuple(row.values())], T.StructType(fields))


def _solve_ols(n: int, cov: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Slopes, residual sum of squares, and the inverse of the predictors' centred cross-products.

    Solved on correlations, so that the scale of a column does not decide whether it counts as dependent.
    """
    scale = np.sqrt(np.diag(cov)[1:])
    if (scale == 0).any() or not np.isfinite(cov).all():
        raise ValueError("a predictor is constant or not finite")
    corr = cov[1:, 1:] / np.outer(scale, scale)
    if np.linalg.eigvalsh(corr)[0] < 1e-12 * len(scale):
        raise ValueError("the predictors are linearly dependent")
    inverse = np.linalg.inv(corr) / np.outer(scale, scale)
    b = inverse @ cov[1:, 0]
    rss = n * float(cov[0, 0] - 2 * b @ cov[1:, 0] + b @ cov[1:, 1:] @ b)
    return b, max(rss, 0.0), inverse / n


def _moments(columns: list[str], standardize: bool) -> list:
    """One aggregate's columns: complete cases, means and covariances over them, and scales over all rows.

    Spark merges centred moments, so large means cost no digits.
    """
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    complete = reduce(lambda a, b: a & b, [v.isNotNull() for v in x])
    kept = [F.when(complete, v) for v in x]
    out = [F.count(F.when(complete, 1)).alias("n"), F.array(*[F.avg(v) for v in kept]).alias("means"),
           F.array(*[F.covar_pop(kept[i], kept[j]) for i in range(len(x)) for j in range(i + 1)]).alias("cov")]
    if standardize:
        out += [F.array(*[F.avg(v) for v in x]).alias("centre"), F.array(*[F.stddev_samp(v) for v in x]).alias("scale")]
    return out


def _matrix(row, k: int, standardize: bool) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, covariances) of one aggregated row, on the scale of the z-scores if wanted."""
    if not row["n"]:
        raise ValueError("there is no complete case")
    means, cov, flat = np.array(row["means"], float), np.zeros((k, k)), iter(row["cov"])
    for i in range(k):
        for j in range(i + 1):
            cov[i, j] = cov[j, i] = next(flat)
    if standardize:
        if any(s in (None, 0.0) for s in row["scale"]):
            raise ValueError("a column is constant")
        scale = np.array(row["scale"], float)
        means, cov = (means - np.array(row["centre"], float)) / scale, cov / np.outer(scale, scale)
    return int(row["n"]), means, cov


def ols(df: DataFrame, y: str, xs: list[str], standardize: bool = True) -> OlsFit:
    """M6 + M7: standardise every column (target included, statistics over all
    rows), keep complete cases, fit OLS with intercept by the normal equations.

    One aggregate over one scan gives means and covariances (map-side partial sums, one
    row to the driver); the k × k system is solved there.  Nothing is persisted.
    """
    row = df.agg(*_moments([y, *xs], standardize)).first()
    return OlsFit(df.sparkSession, y, list(xs), *_matrix(row, len(xs) + 1, standardize))


def grouped_ols(df: DataFrame, by: str, y: str, xs: list[str], standardize: bool = False) -> DataFrame:
    """M7 for each value of ``by``: group, term, estimate, std_error, r_squared and n.

    One grouped aggregate (partial sums before the shuffle, one row a group after it); the small systems are
    solved in tasks, whatever the number of groups.  Groups without a fit (too few cases, dependent or
    constant predictors) have one row with a null term and estimate.
    """
    ship_package(df.sparkSession)
    rows = df.groupBy(F.col(f"`{by}`").alias("group")).agg(*_moments([y, *xs], standardize))
    schema = T.StructType([rows.schema["group"], *T._parse_datatype_string(
        "term string, estimate double, std_error double, r_squared double, n long").fields])
    kind, width, terms = to_arrow_type(rows.schema["group"].dataType), len(xs) + 1, list(xs)

    def solve(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    n, means, cov = _matrix(row, width, standardize)
                    fit = OlsFit(None, y, terms, n, means, cov)
                    out += [(row["group"], t, e, s, fit.r2, n) for t, e, s in zip(fit.terms, fit.estimates, fit.std_errors)]
                except ValueError:
                    out.append((row["group"], None, None, None, None, row["n"]))
            types = [kind, pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)],
                                             names=schema.names)

    return rows.mapInArrow(solve, schema).withColumnRenamed("group", by)


def forest(tidy: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Coefficient chart data — no intercept, significance flag, readable
    term names, 95 % interval, p label, ordered by (significant, estimate)."""
    labels = labels or TERM_LABELS
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    p = F.col("p_value")
    plabel = F.concat(F.lit("p "), F.when(p < 0.01, F.lit("< 0.01"))
                      .otherwise(F.concat(F.lit("= "), F.format_number(p, 2))))
    return (tidy.where(F.col("term") != "(Intercept)")
            .select(F.coalesce(m[F.col("term")], F.col("term")).alias("term"),
                    "estimate", "std_error", "p_value",
                    (p <= SIGNIFICANCE).alias("signifikant"),
                    (F.col("estimate") - CI_Z * F.col("std_error")).alias("ci_unten"),
                    (F.col("estimate") + CI_Z * F.col("std_error")).alias("ci_oben"),
                    plabel.alias("p_label"))
            .orderBy("signifikant", "estimate"))


MAX_STEPS = 50


def _poisson(features: DataFrame, label: str, intercept: bool):
    """IRLS makes one pass per iteration: keep the (aggregated) rows persisted."""
    rows = features.select(label, "_features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        glr = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="_features",
                                          labelCol=label, fitIntercept=intercept, maxIter=MAX_STEPS,
                                          tol=1e-10)
        model = glr.fit(rows)
        if model.summary.numIterations >= MAX_STEPS:
            raise ArithmeticError(f"Poisson trend did not converge in {MAX_STEPS} steps")
        return model
    finally:
        rows.unpersist()


def _centred_days(df: DataFrame, date_col: str):
    """Days since the first date minus half the span (x of the trend models).

    The two bounds are one global aggregate, fetched once and embedded as
    literals: the IRLS passes then do not re-plan a subquery each time.
    """
    lo, hi = df.agg(F.min(date_col), F.max(date_col)).first()
    if lo is None:
        return F.lit(None).cast("double")
    span = (hi - lo).days / 2.0
    return (F.datediff(F.col(date_col), F.lit(lo)) - F.lit(span)).cast("double")


def poisson_trend(per_day: DataFrame, y: str, date_col: str = "datum") -> DataFrame:
    """Log-linear Poisson trend of a daily count on the date.

    x = days since the first date, centred; rows without a count (completed
    calendar days) are not fitted but receive the fitted value.  Adds
    ``trend`` = exp(a + b·x).
    """
    per_day = written(per_day, "trend-days")  # bounds, fit and result read it: one row per day
    data = per_day.withColumn("_x", _centred_days(per_day, date_col))
    vec = VectorAssembler(inputCols=["_x"], outputCol="_features")
    fit_rows = vec.transform(data.where(F.col(y).isNotNull()).withColumn(y, F.col(y).cast("double")))
    model = _poisson(fit_rows, y, True)
    a, b = float(model.intercept), float(model.coefficients[0])
    return data.withColumn("trend", F.exp(F.lit(a) + F.lit(b) * F.col("_x"))).drop("_x")


def grouped_poisson_trend(per_group_day: DataFrame, y: str, group: str,
                          date_col: str = "datum") -> DataFrame:
    """One Poisson trend per group (facet), for any number of groups.

    Each group's daily rows (bounded by the number of days) are fitted by a
    2-parameter IRLS inside ``applyInPandas``; groups are independent tasks.
    x is days since the first date over all groups, centred.  A NULL group is a
    group of its own; a group whose counts are all 0 has the trend 0, one seen
    on a single day its count; a fit that does not converge raises.
    """
    ship_package(per_group_day.sparkSession)
    daily_rows = written(per_group_day, "group-days")
    data = daily_rows.withColumn("_x", _centred_days(daily_rows, date_col))
    out_schema = T.StructType(list(data.schema.fields) + [T.StructField("trend", T.DoubleType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        ok = pdf[y].notna()
        if not ok.any():
            return pdf.assign(trend=np.nan)
        a, b = irls_poisson(pdf.loc[ok, "_x"].to_numpy(dtype=float), pdf.loc[ok, y].to_numpy(dtype=float))
        return pdf.assign(trend=np.exp(a + b * pdf["_x"].to_numpy(dtype=float)))

    fitted = data.groupBy(group).applyInPandas(fit, out_schema).drop("_x")
    return fitted.withColumn("trend", F.nanvl("trend", F.lit(None).cast("double")))


def irls_poisson(x: np.ndarray, y: np.ndarray, iters: int = 100) -> tuple[float, float]:
    """Intercept and slope of a log-linear Poisson fit.

    Without a positive count the intercept is -inf (trend 0); with a single
    distinct x the slope is 0.  Raises when ``iters`` steps do not converge.
    """
    if y.sum() <= 0:
        return -math.inf, 0.0
    if np.ptp(x) == 0:
        return math.log(y.mean()), 0.0
    design = np.column_stack([np.ones_like(x), x])
    beta = np.array([math.log(y.mean()), 0.0])
    for _ in range(iters):
        mu = np.exp(design @ beta)
        step = np.linalg.solve(design.T @ (mu[:, None] * design), design.T @ (y - mu))
        largest = np.max(np.abs(step) * [1.0, np.abs(x).max()])
        beta = beta + step / max(1.0, largest / 5.0)  # a long step is shortened
        if largest < 1e-10:
            return float(beta[0]), float(beta[1])
    raise ArithmeticError(f"Poisson trend did not converge in {iters} steps")
