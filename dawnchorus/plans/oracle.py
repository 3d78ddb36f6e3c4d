"""Independent DuckDB SQL for the registered queries (the correctness oracle).

Written directly against the test tables; it shares no code path with the
Spark implementation.  Floating outputs are rounded with the same
``round(x·1e6)/1e6`` expression as ``catalog.q6``.
"""

from __future__ import annotations

from dawnchorus.functions.labels import (
    CI_Z, CLOUD_LABELS, PRECIPITATION_LABELS, SEASONS, SIGNIFICANCE, TERM_LABELS, WEATHER_VARIABLES,
)
from dawnchorus.plans.catalog import (
    EVENT_TYPES, EVENTS_FROM, LAST_WEEKS, ORDERS_AS_OF, STUDY_END, STUDY_MARK, STUDY_SPECIES, STUDY_START,
)


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def q6(expr: str) -> str:
    return f"(round(({expr}) * 1e6) / 1e6 + 0.0)"


def rounded(sql: str, cols: list[str]) -> str:
    reps = ", ".join(f"{q6(c)} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({reps}) FROM ({sql}) _r"


# --- adapters (mirror dawnchorus.sources.testdata) --------------------------

_DET_TAIL = """
    CAST(1.25 AS DOUBLE) AS empfindlichkeit,
    CAST(51.85 AS DOUBLE) + user_id / 1000 AS breitengrad,
    CAST(6.62 AS DOUBLE) + user_id / 1000 AS laengengrad,
    CAST(0.0 AS DOUBLE) AS ueberlappung"""
_CUTOFF = "TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100"

DT = f"""dt AS (SELECT ts AS zeitstempel, upper(event_type) AS wissenschaftlicher_name,
    event_type AS deutscher_name, floor(value) / 512 AS erkennungswahrscheinlichkeit,
    {_CUTOFF} AS schwellenwert, {_DET_TAIL} FROM events)"""

DU = f"""du AS (SELECT ts AS zeitstempel,
    'Species ' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS wissenschaftlicher_name,
    'Art ' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS deutscher_name,
    floor(value) / 512 AS erkennungswahrscheinlichkeit, {_CUTOFF} AS schwellenwert, {_DET_TAIL},
    user_id AS station FROM events)"""

# every customer a species, under the name of the many-species relation
DC = """du AS (SELECT o_orderdate AS zeitstempel,
    'Species ' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS wissenschaftlicher_name,
    'Art ' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS deutscher_name,
    floor(o_totalprice / 1000) / 512 AS erkennungswahrscheinlichkeit, CAST(0.7 AS DOUBLE) AS schwellenwert
    FROM orders)"""

DO = """dord AS (SELECT o_orderdate AS zeitstempel, lower(o_orderpriority) AS wissenschaftlicher_name,
    o_orderpriority AS deutscher_name, floor(o_totalprice / 1000) / 512 AS erkennungswahrscheinlichkeit,
    CAST(0.7 AS DOUBLE) AS schwellenwert, CAST(1.25 AS DOUBLE) AS empfindlichkeit,
    CAST(51.85 AS DOUBLE) AS breitengrad, CAST(6.62 AS DOUBLE) AS laengengrad,
    CAST(0.0 AS DOUBLE) AS ueberlappung FROM orders)"""

OBS = """hr AS (SELECT date_trunc('hour', ts) AS mess_datum, max({'u': user_id, 'v': value}).v AS v, min(user_id) AS u
    FROM events GROUP BY 1),
obs AS (
  SELECT CAST(1 AS BIGINT) AS stations_id, mess_datum, v % 30 - 5 AS tt_tu_lufttemperatur,
    v % 100 AS rf_tu_relative_feuchte, CAST(NULL AS DOUBLE) AS p_luftdruck_nn,
    CAST(NULL AS DOUBLE) AS v_te005_erdbodentemperatur_005cm,
    CAST(NULL AS DOUBLE) AS rs_ind_niederschlagsindikator, CAST(NULL AS DOUBLE) AS v_n_bedeckungsgrad,
    CAST(NULL AS DOUBLE) AS r1_niederschlagshoehe, CAST(NULL AS DOUBLE) AS sd_so_sonnenscheindauer,
    CAST(NULL AS DOUBLE) AS f_windgeschwindigkeit FROM hr
  UNION ALL
  SELECT 2, mess_datum, NULL, NULL, (v * 7) % 40 + 990, sqrt(v), NULL, NULL, NULL, NULL, NULL FROM hr
  UNION ALL
  SELECT 3, mess_datum, NULL, NULL, NULL, NULL, CAST(floor(v) % 3 AS DOUBLE), CAST(floor(v) % 10 AS DOUBLE),
    (v % 7) / 10, CAST(floor(v) % 61 AS DOUBLE), CASE WHEN u % 4 = 0 THEN NULL ELSE v / 40 END FROM hr)"""

_RAW = ["rs_ind_niederschlagsindikator", "v_n_bedeckungsgrad", "tt_tu_lufttemperatur",
        "rf_tu_relative_feuchte", "p_luftdruck_nn", "v_te005_erdbodentemperatur_005cm",
        "r1_niederschlagshoehe", "sd_so_sonnenscheindauer", "f_windgeschwindigkeit"]

COL = ("col AS (SELECT mess_datum, coalesce(sum(CAST(stations_id AS DOUBLE)), 0) AS stations_id, "
       + ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in _RAW)
       + " FROM obs GROUP BY mess_datum)")

WX = f"""wx AS (SELECT mess_datum AS wetterzeit,
    CASE WHEN rs_ind_niederschlagsindikator IN (0, 1)
         THEN ({_list(PRECIPITATION_LABELS)})[CAST(rs_ind_niederschlagsindikator AS INTEGER) + 1] END
      AS niederschlagsindikator,
    CASE WHEN rs_ind_niederschlagsindikator IN (0, 1)
         THEN CAST(rs_ind_niederschlagsindikator AS INTEGER) END AS niederschlagsindikator_code,
    CASE WHEN v_n_bedeckungsgrad IN (0, 1, 2, 3, 4, 5, 6, 7, 8)
         THEN ({_list(CLOUD_LABELS)})[CAST(v_n_bedeckungsgrad AS INTEGER) + 1] END AS bedeckungsgrad,
    CASE WHEN v_n_bedeckungsgrad IN (0, 1, 2, 3, 4, 5, 6, 7, 8)
         THEN CAST(v_n_bedeckungsgrad AS INTEGER) END AS bedeckungsgrad_in_okta,
    tt_tu_lufttemperatur AS lufttemperatur, rf_tu_relative_feuchte AS luftfeuchtigkeit,
    p_luftdruck_nn AS luftdruck, v_te005_erdbodentemperatur_005cm AS bodentemperatur,
    r1_niederschlagshoehe AS niederschlagshoehe, sd_so_sonnenscheindauer AS sonnenscheindauer,
    f_windgeschwindigkeit AS windgeschwindigkeit FROM col)"""

WX_DOUBLES = ["lufttemperatur", "luftfeuchtigkeit", "luftdruck", "bodentemperatur",
              "niederschlagshoehe", "sonnenscheindauer", "windgeschwindigkeit"]

_SEASON_NR = """CASE WHEN month({d}) IN (3, 4, 5) THEN 1 WHEN month({d}) IN (6, 7, 8) THEN 2
    WHEN month({d}) IN (9, 10, 11) THEN 3 WHEN month({d}) IN (12, 1, 2) THEN 4 END"""

EN = f"""{OBS}, {COL}, {WX},
dx AS (SELECT * FROM ({DT[len('dt AS ('):-1]}) WHERE deutscher_name <> 'error'),
en AS (SELECT w.wetterzeit, d.*, w.* EXCLUDE (wetterzeit),
    ({_list(SEASONS)})[{_SEASON_NR.format(d='d.zeitstempel')}] AS jahreszeit,
    CAST({_SEASON_NR.format(d='d.zeitstempel')} AS INTEGER) AS jahreszeit_nr
  FROM dx d JOIN wx w ON date_trunc('hour', d.zeitstempel) = w.wetterzeit)"""

EN_DOUBLES = ["erkennungswahrscheinlichkeit", "schwellenwert", "empfindlichkeit", "breitengrad",
              "laengengrad", "ueberlappung"] + WX_DOUBLES

STATIONS = f"""ls AS (SELECT l_suppkey, CAST(max(l_shipdate) AS DATE) AS bis_datum FROM lineitem GROUP BY 1),
st AS (SELECT s_suppkey AS stations_id, s_name AS stationsname,
    ({_list(WEATHER_VARIABLES)})[s_suppkey % 7 + 1] AS var,
    CASE WHEN s_suppkey % 5 = 4 THEN 'daily' ELSE 'hourly' END AS res,
    CASE WHEN s_nationkey % 4 = 0 THEN 'historical' ELSE 'recent' END AS per,
    CAST(51.0 AS DOUBLE) + (s_suppkey % 17) / 10 AS geo_breite,
    CAST(6.0 AS DOUBLE) + (s_suppkey % 13) / 8 AS geo_laenge,
    'stations/' || CAST(s_suppkey AS VARCHAR) || '/'
      || ({_list(WEATHER_VARIABLES)})[s_suppkey % 7 + 1] || '.csv' AS url,
    ls.bis_datum
  FROM supplier LEFT JOIN ls ON s_suppkey = l_suppkey),
pos AS (SELECT breitengrad AS lat, laengengrad AS lon FROM dt WHERE zeitstempel IS NOT NULL
  ORDER BY zeitstempel DESC, breitengrad DESC, laengengrad DESC LIMIT 1),
near AS (SELECT st.*, 2 * 6371.0 * asin(least(1.0, sqrt(
      pow(sin((radians(st.geo_breite) - radians(pos.lat)) / 2), 2)
      + cos(radians(pos.lat)) * cos(radians(st.geo_breite))
        * pow(sin((radians(st.geo_laenge) - radians(pos.lon)) / 2), 2)))) AS dist
  FROM st, pos
  WHERE st.res = 'hourly' AND st.per = 'recent' AND st.var IN ({', '.join("'" + v + "'" for v in WEATHER_VARIABLES)})),
nearby AS (SELECT * FROM near WHERE dist <= 50 AND stations_id IS NOT NULL AND stationsname IS NOT NULL
  AND var IS NOT NULL AND geo_breite IS NOT NULL AND geo_laenge IS NOT NULL AND url IS NOT NULL
  AND bis_datum IS NOT NULL)"""

HOUR24 = "CAST(CASE WHEN hour({t}) = 0 THEN 24 ELSE hour({t}) END AS INTEGER)"


def _outages(src: str) -> str:
    return f"""od AS (SELECT DISTINCT station, CAST(zeitstempel AS DATE) AS datum FROM {src}
    WHERE zeitstempel IS NOT NULL),
og AS (SELECT station, lag(datum) OVER (PARTITION BY station ORDER BY datum) AS beginn, datum AS ende FROM od),
outg AS (SELECT station, beginn, ende, CAST(ende - beginn + 1 AS INTEGER) AS dauer FROM og
    WHERE ende - beginn > 1)"""


def _period(src: str, name: str = "per") -> str:
    return f"""{name}_d AS (SELECT CAST(zeitstempel AS DATE) AS datum,
    count(*) FILTER (WHERE zeitstempel >= TIMESTAMP '{EVENTS_FROM}') AS n, max(zeitstempel) AS last_ts
    FROM {src} WHERE zeitstempel IS NOT NULL GROUP BY 1),
{name} AS (SELECT min(CASE WHEN n >= 250 THEN datum END) AS beginn, CAST(max(last_ts) AS DATE) AS ende,
    CAST(CAST(max(last_ts) AS DATE) - min(CASE WHEN n >= 250 THEN datum END) + 1 AS INTEGER) AS dauer
    FROM {name}_d)"""


def _calendar(src: str, name: str = "cal") -> str:
    return f"""{name} AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS datum
    FROM (SELECT min(CAST(zeitstempel AS DATE)) AS a, max(CAST(zeitstempel AS DATE)) AS b FROM {src}) _b
    WHERE a IS NOT NULL)"""


_FREQ = """f AS (SELECT deutscher_name, wissenschaftlicher_name, count(*) AS n FROM du GROUP BY 1, 2)"""
_TOTAL_DU = "(SELECT count(*) FROM du)"


def _top_names(src: str, k: int = 10) -> str:
    return f"""top AS (SELECT deutscher_name, CAST(row_number() OVER (ORDER BY count(*) DESC, deutscher_name) AS INTEGER) AS r
    FROM {src} GROUP BY 1 ORDER BY count(*) DESC, deutscher_name LIMIT {k})"""


def _weekly_change(src: str) -> str:
    return f"""wb AS (SELECT CAST(isoyear(d) AS INTEGER) AS jahr, CAST(weekofyear(d) AS INTEGER) AS kalenderwoche,
    deutscher_name FROM (SELECT CAST(zeitstempel AS DATE) AS d, deutscher_name FROM {src}
    WHERE zeitstempel IS NOT NULL) _x WHERE weekofyear(d) < weekofyear(DATE '{ORDERS_AS_OF}')),
wc0 AS (SELECT jahr, kalenderwoche, deutscher_name, count(*) AS erkennungen FROM wb GROUP BY ALL),
wg AS (SELECT y.jahr, w.kalenderwoche, s.deutscher_name FROM (SELECT DISTINCT jahr FROM wc0) y,
    (SELECT DISTINCT kalenderwoche FROM wc0) w, (SELECT DISTINCT deutscher_name FROM wc0) s),
wf AS (SELECT wg.*, coalesce(wc0.erkennungen, 0) AS erkennungen FROM wg
    LEFT JOIN wc0 USING (jahr, kalenderwoche, deutscher_name)),
wl AS (SELECT *, lag(erkennungen) OVER (PARTITION BY deutscher_name ORDER BY jahr, kalenderwoche)
    AS erkennungen_vorwoche FROM wf),
wc AS (SELECT jahr, kalenderwoche, deutscher_name, erkennungen, erkennungen_vorwoche,
    CASE WHEN erkennungen_vorwoche = 0 THEN CAST(0 AS DOUBLE)
         ELSE (erkennungen - erkennungen_vorwoche) / erkennungen_vorwoche * 100 END
      AS prozentuale_veraenderung FROM wl WHERE erkennungen_vorwoche IS NOT NULL)"""


def _new_species() -> str:
    return """nf AS (SELECT deutscher_name FROM du GROUP BY 1 HAVING count(*) >= 10),
nk AS (SELECT deutscher_name, min(year(d) * 100 + ((dayofyear(d) - 1) // 7 + 1)) AS k
    FROM (SELECT CAST(zeitstempel AS DATE) AS d, deutscher_name FROM du WHERE zeitstempel IS NOT NULL
          AND deutscher_name IN (SELECT deutscher_name FROM nf)) _x GROUP BY 1),
ns AS (SELECT CAST(k // 100 AS INTEGER) AS jahr, CAST(k % 100 AS INTEGER) AS kalenderwoche,
    deutscher_name AS neue_vogelarten FROM nk)"""


def _hour_counts(src: str) -> str:
    return f"""{_top_names(src)},
hc AS (SELECT deutscher_name, CAST(zeitstempel AS DATE) AS datum, {HOUR24.format(t='zeitstempel')} AS stunde,
    count(*) AS n FROM {src} WHERE deutscher_name IN (SELECT deutscher_name FROM top) GROUP BY ALL)"""


_KENDALL = """kp AS (SELECT a.deutscher_name AS term, b.deutscher_name AS vogelart, a.datum, a.stunde,
    a.n AS x, b.n AS y FROM hc a JOIN hc b ON a.datum = b.datum AND a.stunde = b.stunde
    AND a.deutscher_name <> b.deutscher_name),
ks AS (SELECT p.term, p.vogelart, sum(sign(p.x - q.x) * sign(p.y - q.y)) AS s,
    sum(abs(sign(p.x - q.x))) AS tx, sum(abs(sign(p.y - q.y))) AS ty
    FROM kp p JOIN kp q ON p.term = q.term AND p.vogelart = q.vogelart
    AND (p.datum < q.datum OR (p.datum = q.datum AND p.stunde < q.stunde)) GROUP BY 1, 2),
kn AS (SELECT term, vogelart, count(*) AS n FROM kp GROUP BY 1, 2),
kt AS (SELECT kn.term, kn.vogelart, CAST(ks.s AS DOUBLE) / nullif(sqrt(CAST(ks.tx AS DOUBLE) * ks.ty), 0)
    AS korrelation, kn.n FROM kn LEFT JOIN ks USING (term, vogelart))"""

_FEATURES_TAIL = """avg(lufttemperatur) AS lufttemperatur_in_grad,
    avg(luftfeuchtigkeit) AS luftfeuchtigkeit_in_prozent, avg(luftdruck) AS luftdruck_in_hpa,
    avg(bodentemperatur) AS bodentemperatur_in_grad,
    coalesce(sum(niederschlagshoehe), 0) AS niederschlagshoehe_in_mm,
    coalesce(sum(sonnenscheindauer), 0) AS sonnenscheindauer_in_min,
    avg(CAST(bedeckungsgrad_in_okta AS DOUBLE)) AS bedeckungsgrad_in_okta,
    avg(windgeschwindigkeit) AS windgeschwindigkeit_in_m_pro_s"""
FEATURES = ["lufttemperatur_in_grad", "luftfeuchtigkeit_in_prozent", "luftdruck_in_hpa",
            "bodentemperatur_in_grad", "niederschlagshoehe_in_mm", "sonnenscheindauer_in_min",
            "bedeckungsgrad_in_okta", "windgeschwindigkeit_in_m_pro_s"]


def _features(target: str) -> str:
    tgt = ("count(*) AS anzahl_erkennungen" if target == "count"
           else "avg(erkennungswahrscheinlichkeit) AS erkennungswahrscheinlichkeit_in_prozent")
    return f"""SELECT CAST(zeitstempel AS DATE) AS datum, {HOUR24.format(t='zeitstempel')} AS stunde,
    {tgt}, {_FEATURES_TAIL} FROM en GROUP BY 1, 2"""


_OLS = """d AS (SELECT l_extendedprice AS y, l_quantity AS x1, l_discount AS x2, l_tax AS x3 FROM lineitem
    WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL),
c AS (SELECT count(*) AS n, corr(x1, x2) AS r12, corr(x1, x3) AS r13, corr(x2, x3) AS r23,
    corr(y, x1) AS ry1, corr(y, x2) AS ry2, corr(y, x3) AS ry3 FROM d),
inv AS (SELECT *, 1 - r23 * r23 AS c11, r13 * r23 - r12 AS c12, r12 * r23 - r13 AS c13,
    1 - r13 * r13 AS c22, r12 * r13 - r23 AS c23, 1 - r12 * r12 AS c33,
    1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23 AS det FROM c),
b AS (SELECT *, (c11 * ry1 + c12 * ry2 + c13 * ry3) / det AS b1, (c12 * ry1 + c22 * ry2 + c23 * ry3) / det AS b2,
    (c13 * ry1 + c23 * ry2 + c33 * ry3) / det AS b3 FROM inv),
r AS (SELECT *, b1 * ry1 + b2 * ry2 + b3 * ry3 AS r2, CAST(n - 4 AS DOUBLE) AS dfr FROM b)"""


def _newton(data: str, group: str | None = None, iters: int = 50) -> str:
    """Poisson log-link fit y ~ 1 + x by Newton steps in a recursive CTE.

    ``data`` is a CTE name with columns y, x (and ``g`` when grouped).
    Produces CTE ``fit`` with columns [g,] a, b.
    """
    gsel = "g, " if group else ""
    gkey = "it.g, " if group else ""
    gjoin = "JOIN " + data + " d ON d.g = it.g" if group else ", " + data + " d"
    mu = "exp(it.a + it.b * d.x)"
    return f"""it(k, {gsel}a, b) AS (
    SELECT 0, {gsel}ln(avg(y)), CAST(0 AS DOUBLE) FROM {data} {"GROUP BY g" if group else ""}
    UNION ALL
    SELECT k + 1, {gsel}a + (s2 * u0 - s1 * u1) / (s0 * s2 - s1 * s1),
        b + (s0 * u1 - s1 * u0) / (s0 * s2 - s1 * s1)
    FROM (SELECT it.k, {gkey}it.a, it.b, sum({mu}) AS s0, sum(d.x * {mu}) AS s1,
            sum(d.x * d.x * {mu}) AS s2, sum(d.y - {mu}) AS u0, sum(d.x * (d.y - {mu})) AS u1
          FROM it {gjoin} WHERE it.k < {iters} GROUP BY it.k, {gkey}it.a, it.b) _s),
fit AS (SELECT {gsel}a, b FROM it WHERE k = {iters})"""


def _trend_sql(src_ctes: str, grid_sql: str, ycol: str, group: str | None = None,
               extra: str = "") -> str:
    """Oracle of a Poisson trend chart: ``grid`` rows plus exp(a + b·x)."""
    g = f"{group} AS g, " if group else ""
    on = f"JOIN fit ON fit.g = grid.{group}" if group else ", fit"
    return f"""WITH RECURSIVE {src_ctes},
grid AS ({grid_sql}),
bnd AS (SELECT min(datum) AS lo, max(datum) AS hi FROM grid),
d AS (SELECT {g}CAST({ycol} AS DOUBLE) AS y, CAST(datum - lo AS DOUBLE) - (hi - lo) / 2.0 AS x
      FROM grid, bnd WHERE {ycol} IS NOT NULL),
{_newton("d", group)}
SELECT grid.*{extra}, {q6("exp(fit.a + fit.b * (CAST(grid.datum - bnd.lo AS DOUBLE) - (bnd.hi - bnd.lo) / 2.0))")} AS trend
FROM grid {on}, bnd"""


def _ols_gauss_jordan(y: str, xs: list[str], source_ctes: str, frame: str,
                     glance: bool = False, p_values: bool = False, forest: bool = False) -> str:
    """OLS with intercept on z-scored columns, solved by Gauss-Jordan
    elimination in a recursive CTE (window functions read the pivot row and
    column of each step).  Statistics over all rows of ``frame`` per column,
    fit on complete cases; returns term, estimate, std_error, statistic."""
    cols = [y] + xs
    p = len(xs) + 1
    z = ", ".join(f"(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) "
                  f"/ nullif(stddev_samp(CAST({c} AS DOUBLE)) OVER (), 0) AS {c}" for c in cols)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    unp = " UNION ALL ".join(["SELECT rid, 0 AS j, CAST(1 AS DOUBLE) AS v, y FROM zr"]
                             + [f"SELECT rid, {i + 1}, {c}, y FROM zr" for i, c in enumerate(xs)])
    terms = "[" + ", ".join(["'(Intercept)'"] + [f"'{c}'" for c in xs]) + "]"
    return f"""WITH RECURSIVE {source_ctes},
zz AS (SELECT {z} FROM {frame}),
zr AS (SELECT row_number() OVER () AS rid, {y} AS y, * EXCLUDE ({y}) FROM zz WHERE {complete}),
lng AS ({unp}),
a AS (SELECT l1.j AS i, l2.j AS j, sum(l1.v * l2.v) AS v FROM lng l1 JOIN lng l2 USING (rid) GROUP BY 1, 2),
xy AS (SELECT j AS i, {p} AS j, sum(v * y) AS v FROM lng GROUP BY 1),
aug AS (SELECT * FROM a UNION ALL SELECT * FROM xy
        UNION ALL SELECT i, j, CASE WHEN j = {p} + 1 + i THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
        FROM range({p}) r(i), range({p} + 1, 2 * {p} + 1) c(j)),
m(step, i, j, v) AS (
  SELECT 0, i, j, v FROM aug
  UNION ALL
  SELECT step + 1, i, j, CASE WHEN i = step THEN v / piv ELSE v - rowk * colj / piv END
  FROM (SELECT step, i, j, v,
          max(CASE WHEN i = step AND j = step THEN v END) OVER () AS piv,
          max(CASE WHEN j = step THEN v END) OVER (PARTITION BY i) AS rowk,
          max(CASE WHEN i = step THEN v END) OVER (PARTITION BY j) AS colj
        FROM m WHERE step < {p}) _w),
sol AS (SELECT i, max(CASE WHEN j = {p} THEN v END) AS beta, max(CASE WHEN j = {p} + 1 + i THEN v END) AS inv
        FROM m WHERE step = {p} GROUP BY i),
fitstat AS (SELECT (SELECT count(*) FROM zr) AS n,
        (SELECT sum(y * y) FROM zr) - (SELECT sum(sol.beta * xy.v) FROM sol JOIN xy USING (i)) AS rss)
{_gj_output(terms, p, glance, p_values, forest)}"""


def _gj_output(terms: str, p: int, glance: bool, p_values: bool, forest: bool) -> str:
    if not p_values:
        return _glance_select(p) if glance else _tidy_select(terms, p)
    k = p - 1
    if glance:
        return f""",
gl AS (SELECT CAST(fitstat.n AS DOUBLE) AS n, fitstat.rss AS rss,
        (SELECT sum((y - m) * (y - m)) FROM zr, (SELECT avg(y) AS m FROM zr) _m) AS tss FROM fitstat),
pv AS (SELECT 'F' AS id, (n - {p}) / 2.0 AS a, {k} / 2.0 AS b,
        (n - {p}) / ((n - {p}) + {k} * (((1 - rss / tss) / {k}) / ((rss / tss) / (n - {p})))) AS x FROM gl),
{_betainc('pv')}
SELECT * REPLACE ({", ".join(f"{q6(c)} AS {c}" for c in GLANCE_DOUBLES)}) FROM (
  SELECT g.*, (SELECT v FROM ibeta) AS p_value
  FROM ({_glance_select(p, digits=None).replace("FROM fitstat) _g", "FROM fitstat) _g0")}) g) _gp"""
    tidy = f"""SELECT ({terms})[sol.i + 1] AS term, sol.beta AS estimate,
        sqrt(fitstat.rss / (fitstat.n - {p}) * sol.inv) AS std_error,
        sol.beta / sqrt(fitstat.rss / (fitstat.n - {p}) * sol.inv) AS statistic,
        CAST(fitstat.n - {p} AS DOUBLE) AS dfr FROM sol, fitstat"""
    head = f""",
tid AS ({tidy}),
pv AS (SELECT term AS id, dfr / 2 AS a, CAST(0.5 AS DOUBLE) AS b, dfr / (dfr + statistic * statistic) AS x
       FROM tid),
{_betainc('pv')}
"""
    if not forest:
        return head + rounded("""SELECT tid.term, tid.estimate, tid.std_error, tid.statistic, ibeta.v AS p_value
            FROM tid JOIN ibeta ON ibeta.id = tid.term""", ["estimate", "std_error", "statistic", "p_value"])
    label = "CASE tid.term " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TERM_LABELS.items()) \
        + " ELSE tid.term END"
    return head + rounded(f"""SELECT {label} AS term,
            tid.estimate, tid.std_error, ibeta.v AS p_value, ibeta.v <= {SIGNIFICANCE} AS signifikant,
            tid.estimate - {CI_Z} * tid.std_error AS ci_unten, tid.estimate + {CI_Z} * tid.std_error AS ci_oben,
            'p ' || CASE WHEN ibeta.v < 0.01 THEN '< 0.01' ELSE '= ' || format('{{:,.2f}}', ibeta.v) END AS p_label
        FROM tid JOIN ibeta ON ibeta.id = tid.term WHERE tid.term <> '(Intercept)'""",
        ["estimate", "std_error", "p_value", "ci_unten", "ci_oben"])


def _tidy_select(terms: str, p: int) -> str:
    return f"""SELECT ({terms})[sol.i + 1] AS term, {q6("sol.beta")} AS estimate,
    {q6(f"sqrt(fitstat.rss / (fitstat.n - {p}) * sol.inv)")} AS std_error,
    {q6(f"sol.beta / sqrt(fitstat.rss / (fitstat.n - {p}) * sol.inv)")} AS statistic
FROM sol, fitstat"""


GLANCE_DOUBLES = ["r_squared", "adj_r_squared", "sigma", "statistic", "p_value", "df", "loglik",
                  "aic", "bic", "deviance"]


def _glance_select(p: int, digits: int | None = 4) -> str:
    """R-style model summary (without the F test's p-value) from RSS, TSS, n."""
    k = p - 1
    ll = "(-n / 2.0 * (ln(2 * pi()) + ln(rss / n) + 1))"
    fields = {
        "r_squared": "1 - rss / tss",
        "adj_r_squared": f"1 - (rss / tss) * (n - 1) / (n - {p})",
        "sigma": f"sqrt(rss / (n - {p}))",
        "statistic": f"((1 - rss / tss) / {k}) / ((rss / tss) / (n - {p}))",
        "df": f"CAST({k} AS DOUBLE)",
        "loglik": ll,
        "aic": f"-2 * {ll} + 2 * {k + 2}",
        "bic": f"-2 * {ll} + ln(n) * {k + 2}",
        "deviance": "rss",
    }
    sel = ", ".join(f"{_q4(e) if digits == 4 else '(' + e + ')'} AS {c}" for c, e in fields.items())
    return f"""SELECT {sel}, CAST(n - {p} AS BIGINT) AS df_residual, CAST(n AS BIGINT) AS nobs
FROM (SELECT CAST(fitstat.n AS DOUBLE) AS n, fitstat.rss AS rss,
        (SELECT sum((y - m) * (y - m)) FROM zr, (SELECT avg(y) AS m FROM zr) _m) AS tss FROM fitstat) _g"""


def _betainc(src: str, iters: int = 5000) -> str:
    """Regularized incomplete beta I_x(a, b) for the rows of CTE ``src``
    (columns id, a, b, x) by its continued fraction (modified Lentz), one
    recursion step per term.  Produces CTE ``ibeta(id, v)``."""
    g = "CASE WHEN abs({e}) > 1e-300 THEN {e} ELSE 1e-300 END"
    return f"""bsw AS (SELECT id, a, b, x,
        x < (a + 1) / (a + b + 2) AS direct,
        CASE WHEN x < (a + 1) / (a + b + 2) THEN a ELSE b END AS p,
        CASE WHEN x < (a + 1) / (a + b + 2) THEN b ELSE a END AS q,
        CASE WHEN x < (a + 1) / (a + b + 2) THEN x ELSE 1 - x END AS z,
        CASE WHEN x > 0 AND x < 1 THEN exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x))
             END AS front
      FROM {src}),
cf(id, m, c, d, h, fin) AS (
  SELECT id, 0, CAST(1 AS DOUBLE), 1 / ({g.format(e="1 - (p + q) * z / (p + 1)")}),
         1 / ({g.format(e="1 - (p + q) * z / (p + 1)")}), false FROM bsw WHERE front IS NOT NULL
  UNION ALL
  SELECT id, m, c2, d2, h2, abs(d2 * c2 - 1) < 1e-15 FROM (
    SELECT cf.id, cf.m + 1 AS m,
      (cf.m + 1) * (bsw.q - cf.m - 1) * bsw.z / ((bsw.p - 1 + 2 * (cf.m + 1)) * (bsw.p + 2 * (cf.m + 1))) AS e1,
      -(bsw.p + cf.m + 1) * (bsw.p + bsw.q + cf.m + 1) * bsw.z
        / ((bsw.p + 2 * (cf.m + 1)) * (bsw.p + 1 + 2 * (cf.m + 1))) AS e2,
      1 / ({g.format(e="1 + e1 * cf.d")}) AS d1,
      {g.format(e="1 + e1 / cf.c")} AS c1,
      cf.h * d1 * c1 AS h1,
      1 / ({g.format(e="1 + e2 * d1")}) AS d2,
      {g.format(e="1 + e2 / c1")} AS c2,
      h1 * d2 * c2 AS h2
    FROM cf JOIN bsw USING (id) WHERE NOT cf.fin AND cf.m < {iters}) _s),
ibeta AS (SELECT bsw.id,
    CASE WHEN bsw.x <= 0 THEN CAST(0 AS DOUBLE) WHEN bsw.x >= 1 THEN CAST(1 AS DOUBLE)
         WHEN bsw.direct THEN bsw.front * last.h / bsw.p
         ELSE 1 - bsw.front * last.h / bsw.p END AS v
  FROM bsw LEFT JOIN (SELECT id, arg_max(h, m) AS h FROM cf GROUP BY id) last USING (id))"""


def _q4(expr: str) -> str:
    return f"(round(({expr}) * 1e4) / 1e4 + 0.0)"


def build() -> dict[str, str]:
    s: dict[str, str] = {}

    s["detections_csv"] = f"""WITH {DT} SELECT date_trunc('second', zeitstempel) AS zeitstempel,
        wissenschaftlicher_name, deutscher_name, erkennungswahrscheinlichkeit, schwellenwert,
        empfindlichkeit, breitengrad, laengengrad, ueberlappung FROM dt"""

    s["species_rank"] = f"""WITH {DU}, c AS (SELECT deutscher_name, count(*) AS n FROM du GROUP BY 1)
        SELECT deutscher_name, n, row_number() OVER (ORDER BY n DESC, deutscher_name ASC NULLS LAST)
        AS deutscher_name_rang FROM c"""

    s["station_outages"] = f"WITH {DU}, {_outages('du')} SELECT * FROM outg"

    s["observation_period"] = f"WITH {DT}, {_period('dt')} SELECT * FROM per"

    s["complete_days"] = f"""WITH {DU}, {_outages('du')}, {_period('du')},
        edges AS (SELECT station, beginn AS d FROM outg UNION SELECT station, ende FROM outg)
        SELECT du.* FROM du, per WHERE CAST(du.zeitstempel AS DATE) BETWEEN per.beginn AND per.ende
        AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.station = du.station
                        AND e.d = CAST(du.zeitstempel AS DATE))"""

    prof_cols = ["niederschlagsindikator_code", "bedeckungsgrad_in_okta"] + WX_DOUBLES
    prof_types = {"niederschlagsindikator_code": "int", "bedeckungsgrad_in_okta": "int"}
    parts = [f"""SELECT '{c}' AS spalte, '{prof_types.get(c, "double")}' AS typ, CAST(min({c}) AS DOUBLE) AS minimum,
        quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median,
        avg(CAST({c} AS DOUBLE)) AS mittelwert, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3,
        CAST(max({c}) AS DOUBLE) AS maximum, count(*) FILTER (WHERE {c} IS NULL) AS anzahl_na FROM wx"""
             for c in prof_cols]
    s["weather_profile"] = f"WITH {OBS}, {COL}, {WX} " + rounded(
        " UNION ALL ".join(parts), ["minimum", "q1", "median", "mittelwert", "q3", "maximum"])

    s["nearby_stations"] = f"WITH {DT}, {STATIONS} " + rounded(
        "SELECT * FROM nearby", ["geo_breite", "geo_laenge", "dist"])

    s["best_stations"] = f"WITH {DT}, {STATIONS} " + rounded(
        """SELECT stations_id AS station, stationsname AS ort, var AS wettervariable,
        dist AS entfernung, url AS link FROM (SELECT *, row_number() OVER (PARTITION BY var
        ORDER BY bis_datum DESC, dist ASC, stations_id ASC) AS rn FROM nearby) _n WHERE rn = 1""",
        ["entfernung"])

    # every user's last position with every station: all pairs, by brute force
    of_users = STATIONS[:STATIONS.index("pos AS (")] + """pos AS (SELECT station AS position, p.lat, p.lon FROM (
        SELECT station, max({'t': zeitstempel, 'lat': breitengrad, 'lon': laengengrad}) AS p
        FROM du WHERE zeitstempel IS NOT NULL GROUP BY station)),
    """ + STATIONS[STATIONS.index("near AS ("):].replace("SELECT st.*,", "SELECT pos.position, st.*,")
    s["stations_near"] = f"WITH {DU}, {of_users} " + rounded(
        "SELECT position, count(*) AS stationen, min(dist) AS naechste, max(dist) AS fernste FROM nearby GROUP BY 1",
        ["naechste", "fernste"])
    s["best_stations_near"] = f"WITH {DU}, {of_users} " + rounded(
        """SELECT position, stations_id AS station, stationsname AS ort, var AS wettervariable,
        dist AS entfernung, url AS link FROM (SELECT *, row_number() OVER (PARTITION BY position, var
        ORDER BY bis_datum DESC, dist ASC, stations_id ASC) AS rn FROM nearby) _n WHERE rn = 1""",
        ["entfernung"])

    wx_sql = rounded("SELECT * FROM wx", WX_DOUBLES)
    s["weather_files"] = f"WITH {OBS}, {COL}, {WX} {wx_sql}"
    s["hourly_weather"] = s["weather_files"]
    s["weather_collapse"] = f"WITH {OBS}, {COL} " + rounded("SELECT * FROM col", ["stations_id"] + _RAW)

    s["enriched"] = f"WITH {DT}, {EN} " + rounded("SELECT * FROM en", EN_DOUBLES)

    s["orders_by_season"] = f"""WITH {DO} SELECT ({_list(SEASONS)})[{_SEASON_NR.format(d='zeitstempel')}]
        AS jahreszeit, CAST({_SEASON_NR.format(d='zeitstempel')} AS INTEGER) AS jahreszeit_nr,
        count(*) AS erkennungen FROM dord GROUP BY 1, 2"""

    s["snapshot_archive"] = f"WITH {DT}, {EN} " + rounded(
        """SELECT DISTINCT * FROM (SELECT * FROM en UNION ALL
        SELECT * REPLACE (CAST(NULL AS INTEGER) AS jahreszeit_nr) FROM en) _u""", EN_DOUBLES)

    s["archive_stream"] = s["snapshot_archive"]

    s["species_count"] = f"""WITH {DU} SELECT count(*) FILTER (WHERE n >= 10) AS anzahl_vogelarten
        FROM (SELECT deutscher_name, count(*) AS n FROM du GROUP BY 1) _c"""

    s["daily"] = f"""WITH {DT} SELECT CAST(zeitstempel AS DATE) AS datum, count(*) AS erkennungen,
        count(DISTINCT deutscher_name) + max(CASE WHEN deutscher_name IS NULL THEN 1 ELSE 0 END)
        AS vogelarten FROM dt GROUP BY 1"""

    s["top_species"] = f"WITH {DU}, {_FREQ} " + rounded(
        f"""SELECT deutscher_name, wissenschaftlicher_name, n AS absolute_haeufigkeit,
        n / {_TOTAL_DU} * 100 AS relative_haeufigkeit FROM f
        ORDER BY n DESC, deutscher_name, wissenschaftlicher_name LIMIT 10""", ["relative_haeufigkeit"])

    s["bottom_species"] = f"WITH {DU}, {_FREQ} " + rounded(
        f"""SELECT deutscher_name, wissenschaftlicher_name, n AS absolute_haeufigkeit,
        n / {_TOTAL_DU} * 100 AS relative_haeufigkeit FROM f WHERE n >= 10
        ORDER BY n ASC, deutscher_name, wissenschaftlicher_name LIMIT 10""", ["relative_haeufigkeit"])

    s["species_frequency"] = f"WITH {DU}, {_FREQ} " + rounded(
        f"""SELECT deutscher_name, wissenschaftlicher_name, n AS absolut, n / {_TOTAL_DU} * 100 AS relativ,
        row_number() OVER (ORDER BY n DESC, deutscher_name, wissenschaftlicher_name) AS rang
        FROM f WHERE n >= 10""", ["relativ"])

    s["new_species"] = f"WITH {DU}, {_new_species()} SELECT * FROM ns"

    s["running_species"] = f"""WITH {DU}, {_new_species()},
        wk AS (SELECT DISTINCT CAST(year(d) AS INTEGER) AS jahr, CAST((dayofyear(d) - 1) // 7 + 1 AS INTEGER)
            AS kalenderwoche FROM (SELECT CAST(zeitstempel AS DATE) AS d FROM du WHERE zeitstempel IS NOT NULL
            AND deutscher_name IN (SELECT deutscher_name FROM nf)) _x)
        SELECT wk.jahr, wk.kalenderwoche, CAST(count(nk.deutscher_name) AS INTEGER) AS anzahl_alle,
            coalesce(string_agg(nk.deutscher_name, ', ' ORDER BY nk.deutscher_name), '') AS alle_vogelarten,
            coalesce(string_agg(nk.deutscher_name, ', ' ORDER BY nk.deutscher_name)
                FILTER (WHERE nk.k = wk.jahr * 100 + wk.kalenderwoche), '') AS neue_vogelarten
        FROM wk LEFT JOIN nk ON nk.k <= wk.jahr * 100 + wk.kalenderwoche GROUP BY 1, 2"""

    s["weekly_change"] = f"WITH {DO}, {_weekly_change('dord')} " + rounded(
        "SELECT * FROM wc", ["prozentuale_veraenderung"])

    s["hour_matrix"] = f"""WITH {DT}, {_hour_counts('dt')}
        SELECT datum, stunde, {", ".join(f"max(n) FILTER (WHERE deutscher_name = '{e}') AS {e}" for e in EVENT_TYPES)}
        FROM hc GROUP BY datum, stunde"""

    s["species_kendall"] = f"WITH {DT}, {_hour_counts('dt')}, {_KENDALL} " + rounded(
        "SELECT * FROM kt", ["korrelation"])

    s["corr_pairs"] = f"WITH {DT}, {_hour_counts('dt')}, {_KENDALL} " + rounded(
        """SELECT kt.term, kt.vogelart, round(kt.korrelation, 2) AS korrelation FROM kt
        JOIN top a ON a.deutscher_name = kt.term JOIN top b ON b.deutscher_name = kt.vogelart
        WHERE a.r > b.r AND kt.korrelation IS NOT NULL""", ["korrelation"])

    s["features_count"] = f"WITH {DT}, {EN} " + rounded(_features("count"), FEATURES)
    s["features_confidence"] = f"WITH {DT}, {EN} " + rounded(
        _features("confidence"), ["erkennungswahrscheinlichkeit_in_prozent"] + FEATURES)

    zcols = ["anzahl_erkennungen"] + FEATURES
    z = ", ".join(f"""(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ())
        / nullif(stddev_samp(CAST({c} AS DOUBLE)) OVER (), 0) AS {c}""" for c in zcols)
    s["normalized_features"] = f"WITH {DT}, {EN}, feat AS ({_features('count')}) " + rounded(
        f"SELECT datum, stunde, {z} FROM feat", zcols)

    s["ols_coefficients"] = f"WITH {_OLS} " + rounded(
        """SELECT '(Intercept)' AS term, CAST(0 AS DOUBLE) AS estimate,
            sqrt((1 - r2) * (n - 1) / dfr / n) AS std_error, CAST(0 AS DOUBLE) AS statistic FROM r
        UNION ALL SELECT 'l_quantity', b1, sqrt((1 - r2) / dfr * c11 / det), b1 / sqrt((1 - r2) / dfr * c11 / det) FROM r
        UNION ALL SELECT 'l_discount', b2, sqrt((1 - r2) / dfr * c22 / det), b2 / sqrt((1 - r2) / dfr * c22 / det) FROM r
        UNION ALL SELECT 'l_tax', b3, sqrt((1 - r2) / dfr * c33 / det), b3 / sqrt((1 - r2) / dfr * c33 / det) FROM r""",
        ["estimate", "std_error", "statistic"])

    coef = """coef AS (
        SELECT '(Intercept)' AS term, CAST(0 AS DOUBLE) AS estimate,
            sqrt((1 - r2) * (n - 1) / dfr / n) AS std_error, CAST(0 AS DOUBLE) AS statistic, dfr FROM r
        UNION ALL SELECT 'l_quantity', b1, sqrt((1 - r2) / dfr * c11 / det), b1 / sqrt((1 - r2) / dfr * c11 / det), dfr FROM r
        UNION ALL SELECT 'l_discount', b2, sqrt((1 - r2) / dfr * c22 / det), b2 / sqrt((1 - r2) / dfr * c22 / det), dfr FROM r
        UNION ALL SELECT 'l_tax', b3, sqrt((1 - r2) / dfr * c33 / det), b3 / sqrt((1 - r2) / dfr * c33 / det), dfr FROM r),
    pv AS (SELECT term AS id, dfr / 2 AS a, CAST(0.5 AS DOUBLE) AS b, dfr / (dfr + statistic * statistic) AS x
           FROM coef)"""
    s["ols_tidy"] = f"WITH RECURSIVE {_OLS}, {coef}, {_betainc('pv')} " + rounded(
        """SELECT coef.term, coef.estimate, coef.std_error, coef.statistic, ibeta.v AS p_value
        FROM coef JOIN ibeta ON ibeta.id = coef.term""",
        ["estimate", "std_error", "statistic", "p_value"])

    g = """SELECT r2 AS r_squared, 1 - (1 - r2) * (n - 1) / dfr AS adj_r_squared,
        sqrt((n - 1) * (1 - r2) / dfr) AS sigma, (r2 / 3) / ((1 - r2) / dfr) AS statistic,
        CAST(3 AS DOUBLE) AS df,
        -n / 2.0 * (ln(2 * pi()) + ln((n - 1) * (1 - r2) / n) + 1) AS loglik,
        n * (ln(2 * pi()) + ln((n - 1) * (1 - r2) / n) + 1) + 2 * 5 AS aic,
        n * (ln(2 * pi()) + ln((n - 1) * (1 - r2) / n) + 1) + ln(n) * 5 AS bic,
        (n - 1) * (1 - r2) AS deviance, CAST(n - 4 AS BIGINT) AS df_residual, CAST(n AS BIGINT) AS nobs FROM r"""
    gcols = ["r_squared", "adj_r_squared", "sigma", "statistic", "df", "loglik", "aic", "bic", "deviance"]
    s["ols_glance"] = f"WITH {_OLS} SELECT * REPLACE (" + ", ".join(
        f"{_q4(c)} AS {c}" for c in gcols) + f") FROM ({g}) _g"

    s["daily_grid"] = f"""WITH {DO}, {_calendar('dord')},
        pd AS (SELECT CAST(zeitstempel AS DATE) AS datum, count(*) AS anzahl_erkennungen FROM dord GROUP BY 1)
        SELECT cal.datum, pd.anzahl_erkennungen FROM cal LEFT JOIN pd USING (datum)"""

    s["season_spans"] = f"""WITH {DO}, {_calendar('dord')},
        sd AS (SELECT datum, CAST({_SEASON_NR.format(d='datum')} AS INTEGER) AS jahreszeit_nr,
            CAST(year(datum) + CASE WHEN month(datum) = 12 THEN 1 ELSE 0 END AS INTEGER) AS saisonjahr FROM cal),
        sg AS (SELECT saisonjahr, jahreszeit_nr, min(datum) AS b0, max(datum) AS e0 FROM sd GROUP BY 1, 2)
        SELECT saisonjahr, jahreszeit_nr, ({_list(SEASONS)})[jahreszeit_nr] AS jahreszeit, b0 AS beginn,
            CASE WHEN e0 < (SELECT max(CAST(zeitstempel AS DATE)) FROM dord) THEN e0 + 1 ELSE e0 END AS ende,
            b0 + CAST(floor((e0 - b0) / 2) AS INTEGER) AS mitte FROM sg"""

    ref_nr = """CASE WHEN datum >= make_date(year(datum), 3, 1) AND datum <= make_date(year(datum), 5, 31) THEN 1
        WHEN datum >= make_date(year(datum), 6, 1) AND datum <= make_date(year(datum), 8, 31) THEN 2
        WHEN datum >= make_date(year(datum), 9, 1) AND datum <= make_date(year(datum), 11, 30) THEN 3
        WHEN datum >= make_date(year(datum) - 1, 12, 1) AND datum <= (CASE WHEN
            day(last_day(make_date(year(datum), 2, 1))) = 29 THEN make_date(year(datum), 2, 29) END) THEN 4 END"""
    s["season_spans_reference"] = f"""WITH {DO}, {_calendar('dord')},
        sd AS (SELECT datum, CAST({ref_nr} AS INTEGER) AS jahreszeit_nr FROM cal),
        sg AS (SELECT jahreszeit_nr, min(datum) AS b0, max(datum) AS e0 FROM sd GROUP BY 1)
        SELECT jahreszeit_nr, ({_list(SEASONS)})[jahreszeit_nr] AS jahreszeit, b0 AS beginn,
            CASE WHEN e0 < (SELECT max(CAST(zeitstempel AS DATE)) FROM dord) THEN e0 + 1 ELSE e0 END AS ende,
            b0 + CAST(floor((e0 - b0) / 2) AS INTEGER) AS mitte FROM sg"""

    s["outage_labels"] = f"""WITH {DU}, {_outages('du')}, {_period('du')}
        SELECT station, beginn, ende, dauer, beginn + CAST(floor((ende - beginn) / 2) AS INTEGER) AS mittelwert,
            CAST(dauer AS VARCHAR) || ' Tage' || chr(10) || 'Unterbrechung' AS label
        FROM outg WHERE beginn >= (SELECT beginn FROM per)"""

    s["top_shares"] = f"WITH {DU}, {_top_names('du')} " + rounded(
        f"""SELECT deutscher_name, count(*) AS absolut, count(*) / {_TOTAL_DU} * 100 AS relativ FROM du
        WHERE deutscher_name IN (SELECT deutscher_name FROM top) GROUP BY 1""", ["relativ"])

    s["top_daily"] = f"""WITH {DU}, {_top_names('du')} SELECT deutscher_name, CAST(zeitstempel AS DATE) AS datum,
        count(*) AS anzahl FROM du WHERE deutscher_name IN (SELECT deutscher_name FROM top) GROUP BY 1, 2"""

    def hour_grid(src: str, agg: str, name: str) -> str:
        return f"""WITH {src[0]}, {_calendar(src[1])},
        cells AS (SELECT CAST(zeitstempel AS DATE) AS datum, {HOUR24.format(t='zeitstempel')} AS stunde,
            {agg} AS v FROM {src[1]} WHERE zeitstempel IS NOT NULL GROUP BY 1, 2),
        grid AS (SELECT datum, CAST(unnest(range(1, 25)) AS INTEGER) AS stunde FROM cal),
        seen AS (SELECT DISTINCT datum FROM cells)
        SELECT g.datum, g.stunde, CAST(CASE WHEN seen.datum IS NOT NULL THEN coalesce(cells.v, 0) END AS BIGINT)
            AS {name} FROM grid g LEFT JOIN cells USING (datum, stunde) LEFT JOIN seen ON seen.datum = g.datum"""

    s["hour_grid_detections"] = hour_grid((DO, "dord"), "count(*)", "anzahl_erkennungen")
    s["hour_grid_species"] = hour_grid(
        (DT, "dt"), "count(DISTINCT deutscher_name) + max(CASE WHEN deutscher_name IS NULL THEN 1 ELSE 0 END)",
        "anzahl_vogelarten")

    clock = DO.replace("o_orderdate AS zeitstempel", """CAST(DATE '1992-01-01' AS TIMESTAMP) + to_days(CAST(2 *
        datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER)) + to_hours(o_orderkey % 24) AS zeitstempel""")
    s["hour_grid_clock"] = hour_grid((clock, "dord"), "count(*)", "anzahl_erkennungen")
    s["hour_grid_clock_species"] = hour_grid(
        (clock, "dord"), "count(DISTINCT deutscher_name) + max(CASE WHEN deutscher_name IS NULL THEN 1 ELSE 0 END)",
        "anzahl_vogelarten")
    s["distinct_sketches"] = f"WITH {DC} " + " UNION ALL ".join(
        f"""SELECT '{g}' AS einheit, CAST(date_trunc('{g}', zeitstempel) AS DATE) AS beginn,
        count(DISTINCT deutscher_name) AS genau, true AS im_rahmen FROM du GROUP BY 1, 2""" for g in ("day", "week", "month", "year"))

    s["caption"] = f"WITH {DT}, {_period('dt')} " + rounded(
        """SELECT translate(format('{:,}', (SELECT count(*) FROM dt)), ',.', '.,') AS n_text,
            strftime(per.beginn, '%d.%m.%Y') AS beginn_text, strftime(per.ende, '%d.%m.%Y') AS ende_text,
            (SELECT schwellenwert FROM dt WHERE zeitstempel IS NOT NULL
             ORDER BY zeitstempel ASC, schwellenwert DESC LIMIT 1) * 100 AS konfidenz_prozent FROM per""",
        ["konfidenz_prozent"])

    top_bottom = f"""WITH {DU}, {_FREQ},
        t AS (SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY n DESC, deutscher_name) AS INTEGER) AS rang,
            deutscher_name AS top10, n AS top10_haeufigkeit FROM f) _t WHERE rang <= 10),
        b AS (SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY n ASC, deutscher_name) AS INTEGER) AS rang,
            deutscher_name AS bottom10, n AS bottom10_haeufigkeit FROM f WHERE n >= 10) _b WHERE rang <= 10)
        SELECT coalesce(t.rang, b.rang) AS rang, top10, {{a}} AS top10_haeufigkeit, bottom10,
            {{b}} AS bottom10_haeufigkeit FROM t FULL JOIN b ON t.rang = b.rang"""
    s["top_bottom"] = top_bottom.format(a="top10_haeufigkeit", b="bottom10_haeufigkeit")
    s["report_sink"] = s["top_bottom"]
    fmt = "translate(format('{{:,}}', {c}), ',.', '.,')"
    s["formatted_top_bottom"] = top_bottom.format(a=fmt.format(c="top10_haeufigkeit"),
                                                  b=fmt.format(c="bottom10_haeufigkeit"))
    freq_table = f"""WITH {DU}, {_FREQ}
        SELECT row_number() OVER (ORDER BY n DESC, deutscher_name, wissenschaftlicher_name) AS {{rang}},
            deutscher_name AS {{dn}}, wissenschaftlicher_name AS {{wn}},
            translate(format('{{{{:,.0f}}}}', CAST(n AS DOUBLE)), ',.', '.,') AS {{ab}},
            translate(format('{{{{:,.0f}}}}', n / {_TOTAL_DU} * 100), ',.', '.,') AS {{re}}
        FROM f WHERE n >= 10"""
    s["frequency_table"] = freq_table.format(rang="rang", dn="deutscher_name", wn="wissenschaftlicher_name",
                                             ab="absolut", re="relativ")
    s["labelled_frequency"] = freq_table.format(rang='"Rang"', dn='"Deutscher Name"',
                                                wn='"Wissenschaftlicher Name"', ab='"Absolut"',
                                                re='"Relativ"')

    weeks = ", ".join(f"max(v) FILTER (WHERE jahr = {y} AND kalenderwoche = {w}) AS \"KW {w}\"" for y, w in LAST_WEEKS)
    s["weekly_change_wide"] = f"""WITH {DO}, {_weekly_change('dord')}, {_top_names('dord')},
        x AS (SELECT jahr, kalenderwoche, deutscher_name, {q6('prozentuale_veraenderung')} AS v FROM wc
            WHERE deutscher_name IN (SELECT deutscher_name FROM top)
              AND (jahr, kalenderwoche) IN ({", ".join(str(x) for x in LAST_WEEKS)}))
        SELECT deutscher_name, {weeks} FROM x GROUP BY deutscher_name"""

    def new_wide(last: int) -> str:
        cells = ", ".join(f"coalesce(max(neue_vogelarten) FILTER (WHERE kalenderwoche = {w}), '') AS \"KW {w}\""
                          for w in range(1, last + 1))
        return f"""WITH {DU}, {_new_species()},
        num AS (SELECT CAST(row_number() OVER (PARTITION BY kalenderwoche ORDER BY jahr, neue_vogelarten) AS INTEGER)
            AS nummer, jahr, kalenderwoche, neue_vogelarten FROM ns)
        SELECT nummer, {cells} FROM num GROUP BY nummer, jahr"""

    s["new_species_wide"] = new_wide(5)

    s["outage_table"] = f"""WITH {DU}, {_outages('du')}
        SELECT station, strftime(beginn, '%d.%m.%Y') AS beginn, strftime(ende, '%d.%m.%Y') AS ende,
            dauer AS dauer_in_tage FROM outg"""

    weekly = f"""ws AS (SELECT woche, count(*) AS erkennungen,
        count(*) FILTER (WHERE deutscher_name = '{STUDY_SPECIES}') AS erkennungen_art,
        count(*) FILTER (WHERE deutscher_name = '{STUDY_SPECIES}') / count(*) AS anteil_art
        FROM (SELECT CAST(zeitstempel AS DATE) - CAST(dayofweek(CAST(zeitstempel AS DATE)) AS INTEGER) AS woche,
              deutscher_name FROM dord
              WHERE CAST(zeitstempel AS DATE) BETWEEN DATE '{STUDY_START}' AND DATE '{STUDY_END}') _x
        GROUP BY 1)"""
    s["weekly_share"] = f"WITH {DO}, {weekly} " + rounded("SELECT * FROM ws", ["anteil_art"])
    s["share_extrema"] = f"WITH {DO}, {weekly} " + rounded(
        """SELECT *, translate(format('{:,}', erkennungen_art), ',.', '.,') || ' Amseln erkannt' AS label
        FROM ws WHERE anteil_art = (SELECT min(anteil_art) FROM ws) OR anteil_art = (SELECT max(anteil_art) FROM ws)""",
        ["anteil_art"])
    s["study_total"] = f"""WITH {DO}, {weekly} SELECT CAST(sum(erkennungen) AS BIGINT) AS gesamt,
        translate(format('{{:,}}', CAST(sum(erkennungen) AS BIGINT)), ',.', '.,') AS gesamt_text FROM ws"""
    s["marked_weeks"] = f"WITH {DO}, {weekly} " + rounded(
        f"""SELECT *, woche >= DATE '{STUDY_MARK}' AS markiert, DATE '{STUDY_MARK}' AS markierung_beginn,
            (SELECT max(CAST(zeitstempel AS DATE)) FROM dord) AS markierung_ende FROM ws""", ["anteil_art"])
    # Poisson trends: Newton iterations in a recursive CTE (independent of
    # the Spark GLM)
    s["daily_trend"] = _trend_sql(
        f"""{DO}, {_calendar('dord')},
        pd AS (SELECT CAST(zeitstempel AS DATE) AS datum, count(*) AS anzahl_erkennungen FROM dord
               WHERE zeitstempel IS NOT NULL GROUP BY 1)""",
        "SELECT cal.datum, pd.anzahl_erkennungen FROM cal LEFT JOIN pd USING (datum)",
        "anzahl_erkennungen")
    s["species_trend"] = _trend_sql(
        f"""{DU}, {_calendar('du')},
        pd AS (SELECT CAST(zeitstempel AS DATE) AS datum,
               count(DISTINCT deutscher_name) + max(CASE WHEN deutscher_name IS NULL THEN 1 ELSE 0 END)
               AS anzahl_vogelarten FROM du WHERE zeitstempel IS NOT NULL GROUP BY 1)""",
        "SELECT cal.datum, pd.anzahl_vogelarten, 0 AS ymin FROM cal LEFT JOIN pd USING (datum)",
        "anzahl_vogelarten")
    s["top_trend"] = _trend_sql(
        f"""{DT}, {_top_names('dt')}""",
        """SELECT deutscher_name, CAST(zeitstempel AS DATE) AS datum, count(*) AS anzahl FROM dt
           WHERE deutscher_name IN (SELECT deutscher_name FROM top) GROUP BY 1, 2""",
        "anzahl", group="deutscher_name")

    s["weather_coefficients"] = _ols_gauss_jordan(
        "anzahl_erkennungen", FEATURES, f"{DT}, {EN}, feat AS ({_features('count')})", "feat")

    wsrc = f"{DT}, {EN}, feat AS ({_features('count')})"
    s["weather_regression"] = _ols_gauss_jordan("anzahl_erkennungen", FEATURES, wsrc, "feat", p_values=True)
    s["weather_forest"] = _ols_gauss_jordan("anzahl_erkennungen", FEATURES, wsrc, "feat",
                                            p_values=True, forest=True)
    s["confidence_regression"] = _ols_gauss_jordan(
        "erkennungswahrscheinlichkeit_in_prozent", FEATURES,
        f"{DT}, {EN}, feat AS ({_features('confidence')})", "feat", glance=True, p_values=True)
    s["confidence_glance"] = _ols_gauss_jordan(
        "erkennungswahrscheinlichkeit_in_prozent", FEATURES,
        f"{DT}, {EN}, feat AS ({_features('confidence')})", "feat", glance=True)

    s["top_trend_users"] = _trend_sql(
        f"""{DU}, {_top_names('du')}""",
        """SELECT deutscher_name, CAST(zeitstempel AS DATE) AS datum, count(*) AS anzahl FROM du
           WHERE deutscher_name IN (SELECT deutscher_name FROM top) GROUP BY 1, 2""",
        "anzahl", group="deutscher_name")
    s["single_trend"] = _trend_sql(
        f"""{DO}, {_top_names('dord').replace('LIMIT 10', 'LIMIT 1')}""",
        """SELECT deutscher_name, CAST(zeitstempel AS DATE) AS datum, count(*) AS anzahl FROM dord
           WHERE deutscher_name IN (SELECT deutscher_name FROM top) GROUP BY 1, 2""",
        "anzahl", group="deutscher_name")
    for name in ("species_count", "top_species", "bottom_species", "species_frequency", "new_species"):
        s[f"{name}_customers"] = s[name].replace(DU, DC)
    s["new_species_wide_customers"] = new_wide(53).replace(DU, DC)

    s["report_manifest"] = " UNION ALL ".join(
        f"SELECT CAST({nr} AS INTEGER) AS nr, '{name}' AS name, count(*) AS zeilen, count(*) AS gelesen, true AS stimmt FROM ({s[q]}) _q"
        for nr, (name, q) in enumerate((("top_bottom_vogelarten", "top_bottom"), ("haeufigkeiten", "species_frequency"),
                                        ("neue_vogelarten", "new_species"), ("unterbrechungen", "outage_table")), 1))
    s["running_set"] = f"""WITH {DU},
        g AS (SELECT DISTINCT CAST(year(d) AS INTEGER) AS jahr, CAST((dayofyear(d) - 1) // 7 + 1 AS INTEGER) AS kalenderwoche,
            deutscher_name FROM (SELECT CAST(zeitstempel AS DATE) AS d, deutscher_name FROM du) _x WHERE deutscher_name IS NOT NULL),
        f AS (SELECT *, row_number() OVER (PARTITION BY deutscher_name
            ORDER BY jahr NULLS FIRST, kalenderwoche NULLS FIRST) = 1 AS ist_neu FROM g),
        z AS (SELECT jahr, kalenderwoche, count(*) FILTER (ist_neu) AS anzahl_neu FROM f GROUP BY 1, 2),
        c AS (SELECT *, CAST(sum(anzahl_neu) OVER (ORDER BY jahr NULLS FIRST, kalenderwoche NULLS FIRST) AS BIGINT) AS anzahl_alle FROM z)
        SELECT f.*, c.anzahl_neu, c.anzahl_alle FROM f JOIN c ON f.jahr IS NOT DISTINCT FROM c.jahr
            AND f.kalenderwoche IS NOT DISTINCT FROM c.kalenderwoche"""
    s["running_set_customers"] = s["running_set"].replace(DU, DC)
    s["kendall_users"] = f"WITH {DU}, {_hour_counts('du')}, {_KENDALL} " + rounded("SELECT * FROM kt", ["korrelation"])
    s["corr_pairs_users"] = s["corr_pairs"].replace(DT, DU).replace(_hour_counts("dt"), _hour_counts("du"))
    # The matrix of centred cross-products, squared and scaled 30 times, is the first component's projector.
    s["corr_pairs_principal"] = f"""WITH RECURSIVE {DT}, {_hour_counts('dt')}, {_KENDALL},
        m AS (SELECT a.r AS i, b.r AS j, CASE WHEN a.r = b.r THEN 1.0 ELSE coalesce(kt.korrelation, 0) END AS v FROM top a
            CROSS JOIN top b LEFT JOIN kt ON kt.term = a.deutscher_name AND kt.vogelart = b.deutscher_name),
        cm AS (SELECT i, j, v - avg(v) OVER (PARTITION BY j) AS v FROM m),
        g AS (SELECT a.j AS i, b.j AS j, CAST(sum(a.v * b.v) AS DOUBLE) AS v FROM cm a JOIN cm b ON a.i = b.i GROUP BY 1, 2),
        sq AS (SELECT 0 AS step, i, j, v / (SELECT max(abs(v)) FROM g) AS v FROM g
            UNION ALL SELECT step, i, j, v / max(abs(v)) OVER () FROM (SELECT a.step + 1 AS step, a.i, b.j, sum(a.v * b.v) AS v
                FROM sq a JOIN sq b ON a.j = b.i WHERE a.step < 30 GROUP BY 1, 2, 3) _s),
        p AS (SELECT * FROM sq WHERE step = 30),
        lead AS (SELECT i AS l FROM p WHERE i = j ORDER BY round(v, 9) DESC, i LIMIT 1),
        load AS (SELECT p.i, p.v / sqrt(d.v) AS v FROM p, lead, p d WHERE p.j = l AND d.i = l AND d.j = l),
        place AS (SELECT deutscher_name, row_number() OVER (ORDER BY score, r) AS place FROM (
            SELECT top.deutscher_name, top.r, round(sum(cm.v * load.v), 9) AS score FROM cm JOIN load ON load.i = cm.j
            JOIN top ON top.r = cm.i GROUP BY 1, 2) _p)
        """ + rounded("""SELECT kt.term, kt.vogelart, round(kt.korrelation, 2) AS korrelation FROM kt
        JOIN place a ON a.deutscher_name = kt.term JOIN place b ON b.deutscher_name = kt.vogelart
        WHERE a.place > b.place AND kt.korrelation IS NOT NULL""", ["korrelation"])
    s["grouped_ols"] = """WITH g AS (SELECT l_suppkey, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2,
            regr_count(y, x) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_avgx(y, x) AS mx
            FROM (SELECT l_suppkey, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS x FROM lineitem) _l GROUP BY 1),
        e AS (SELECT *, sqrt((1 - r2) * syy / (n - 2)) AS sigma FROM g)
        SELECT l_suppkey, '(Intercept)' AS term, round((a) * 1e4) / 1e4 AS estimate, round((sigma * sqrt(1.0 / n + mx * mx / sxx)) * 1e4) / 1e4 AS std_error,
            round((r2) * 1e4) / 1e4 AS r_squared, CAST(n AS BIGINT) AS n FROM e
        UNION ALL SELECT l_suppkey, 'l_quantity', round(b * 1e4) / 1e4, round(sigma / sqrt(sxx) * 1e4) / 1e4, round(r2 * 1e4) / 1e4, CAST(n AS BIGINT) FROM e"""
    station_period = f"""sday AS (SELECT station, CAST(zeitstempel AS DATE) AS d, count(*) FILTER (zeitstempel >= TIMESTAMP '{EVENTS_FROM}') AS n
            FROM du WHERE zeitstempel IS NOT NULL AND station IS NOT NULL GROUP BY 1, 2),
        sper AS (SELECT * FROM (SELECT station, min(d) FILTER (n >= 3) AS beginn, max(d) AS ende FROM sday GROUP BY 1) _p WHERE beginn IS NOT NULL)"""
    s["station_periods"] = f"""WITH {DU}, {station_period}
        SELECT *, CAST(ende - beginn + 1 AS INTEGER) AS dauer FROM sper"""
    s["station_complete_days"] = f"""WITH {DU}, {_outages('du')}, {station_period},
        edges AS (SELECT station, beginn AS d FROM outg UNION SELECT station, ende FROM outg)
        SELECT du.* FROM du JOIN sper USING (station) WHERE CAST(du.zeitstempel AS DATE) BETWEEN sper.beginn AND sper.ende
        AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.station = du.station AND e.d = CAST(du.zeitstempel AS DATE))"""

    s["labelled_top_bottom"] = f"""SELECT rang AS "Rang", top10 AS "Top 10 Vogelarten",
        top10_haeufigkeit AS "Top 10 Erkennungen", bottom10 AS "Bottom 10 Vogelarten",
        bottom10_haeufigkeit AS "Bottom 10 Erkennungen" FROM ({s['formatted_top_bottom']}) _l"""
    german = ", ".join(f"""replace(format('{{:,}}', CAST(round("KW {w}") AS BIGINT)), ',', '.') AS "KW {w}\""""
                       for _, w in LAST_WEEKS)
    s["labelled_weekly_change"] = f"""SELECT deutscher_name AS "Vogelart", {german}
        FROM ({s['weekly_change_wide']}) _l"""
    s["labelled_new_species"] = f"""SELECT nummer AS "Nr.", * EXCLUDE (nummer) FROM ({s['new_species_wide']}) _l"""
    s["labelled_outages"] = f"""SELECT station, beginn AS "Beginn", ende AS "Ende", dauer_in_tage AS "Dauer in tage"
        FROM ({s['outage_table']}) _l"""
    r2 = _ols_gauss_jordan("anzahl_erkennungen", FEATURES, wsrc, "feat", glance=True)
    s["caption_regression"] = f"""SELECT c.*, replace(printf('%.2f', round(g.r_squared, 2)), '.', ',') AS r2_text
        FROM ({s['caption']}) c, ({r2}) g"""
    s["weather_levels"] = f"""WITH {OBS}, {COL}, {WX}
        SELECT 'niederschlagsindikator' AS spalte, niederschlagsindikator AS wert, count(*) AS anzahl FROM wx GROUP BY 2
        UNION ALL SELECT 'bedeckungsgrad', bedeckungsgrad, count(*) FROM wx GROUP BY 2"""
    stamp = "epoch_ms(CAST(floor({0}) AS BIGINT) * 1000)"
    seconds = "epoch(wetterzeit)"
    s["weather_times"] = f"""WITH {OBS}, {COL}, {WX}
        SELECT 'wetterzeit' AS spalte, {stamp.format(f'min({seconds})')} AS minimum,
            {stamp.format(f'quantile_cont({seconds}, 0.25)')} AS q1, {stamp.format(f'quantile_cont({seconds}, 0.5)')} AS median,
            {stamp.format(f'avg({seconds})')} AS mittelwert, {stamp.format(f'quantile_cont({seconds}, 0.75)')} AS q3,
            {stamp.format(f'max({seconds})')} AS maximum, count(*) FILTER (wetterzeit IS NULL) AS anzahl_na FROM wx"""

    # the count-cube variants must give exactly the raw answers
    for cube_name, raw in (("cube_daily", "daily"), ("cube_top_species", "top_species"),
                           ("cube_new_species", "new_species"), ("cube_weekly_change", "weekly_change"),
                           ("cube_hour_matrix", "hour_matrix"), ("cube_hour_grid", "hour_grid_detections"),
                           ("cube_weekly_share", "weekly_share")):
        s[cube_name] = s[raw]
    return s


ORACLE_SQL = build()
