"""SQL over the given tables that each query is checked against (DuckDB dialect)."""

from __future__ import annotations

from driftflow.operators.cleaning import LABEL_MAP
from driftflow.registry.fixtures import L_FEATURES, V_FEATURES
from driftflow.registry.queries import RAW_LABELS

ORACLES: dict[str, str] = {}


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --- fixtures ------------------------------------------------------------------

EVENTS = """e AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS label, value, event_id FROM events)"""

LINEITEM = """l AS (
  SELECT CAST(year(l_shipdate) AS INT) AS day, l_returnflag AS label, l_quantity, l_extendedprice, l_discount, l_tax,
    concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
      CAST(l_linenumber AS VARCHAR), CAST(CAST(round(l_quantity * 100) AS BIGINT) AS VARCHAR),
      CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR),
      CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR), CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR),
      l_returnflag, l_linestatus,
      CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS VARCHAR)) AS row_key
  FROM lineitem)"""

VECTORS = "v AS (\n  SELECT CAST(vec_id % 10 AS INT) AS day, CAST(label AS VARCHAR) AS label, vec_id, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS {f}" for i, f in enumerate(V_FEATURES)) + "\n  FROM embeddings)"


def _days(table: str) -> str:
    return f"""days AS (
  SELECT CAST(row_number() OVER (ORDER BY day) AS INT) AS ord, day,
    CASE WHEN row_number() OVER (ORDER BY day) <= 3 THEN 'baseline' ELSE 'future' END AS role
  FROM (SELECT DISTINCT day FROM {table}))"""


BASE_PAIRS = """pairs AS (
  SELECT f.day AS cmp, d.day, CASE WHEN d.day = f.day THEN 'test' ELSE 'base' END AS side
  FROM days f JOIN days d ON d.role = 'baseline' OR d.day = f.day WHERE f.role = 'future')"""

WINDOW_PAIRS = """pairs AS (
  SELECT f.day AS cmp, d.day, CASE WHEN d.day = f.day THEN 'test' ELSE 'base' END AS side
  FROM days f JOIN days d ON d.ord BETWEEN f.ord - 3 AND f.ord WHERE f.role = 'future')"""


def _scaled_long(table: str, features: list[str], keep: str = "day") -> list[str]:
    """Bounds from the baseline and the scaled long form."""
    bounds = ", ".join(f"min({f}) AS {f}_a, max({f}) AS {f}_b" for f in features)
    parts = "\n  UNION ALL ".join(
        f"SELECT {keep}, '{f}' AS feature, ({f} - {f}_a) / ({f}_b - {f}_a) AS value FROM {table}, fit"
        for f in features)
    return [f"fit AS (SELECT {bounds} FROM {table} WHERE day IN (SELECT day FROM days WHERE role = 'baseline'))",
            f"long AS (\n  {parts})"]


def _percentiles(source: str, grp: str, name: str = "pct") -> str:
    """Percentiles 0, 10, ..., 100 per group from integer ranks."""
    return f"""{name} AS (
  SELECT {grp}, feature, k, lo + (hi - lo) * (part / CAST(10 AS DOUBLE)) AS edge FROM (
    SELECT {grp}, feature, k, max((k * (n - 1)) % 10) AS part,
      max(CASE WHEN rk = (k * (n - 1)) // 10 THEN value END) AS lo,
      max(CASE WHEN rk = (k * (n - 1) + 9) // 10 THEN value END) AS hi
    FROM (SELECT {grp}, feature, value,
        row_number() OVER (PARTITION BY {grp}, feature ORDER BY value) - 1 AS rk,
        count(*) OVER (PARTITION BY {grp}, feature) AS n FROM {source}) r
      JOIN (SELECT range AS k FROM range(11)) ks
        ON rk = (k * (n - 1)) // 10 OR rk = (k * (n - 1) + 9) // 10
    GROUP BY {grp}, feature, k))"""


OPEN_EDGES = "edges AS (SELECT {grp}, feature, list_sort(list(DISTINCT edge)) AS e FROM pct GROUP BY {grp}, feature)"
WINDOW_EDGES = """edges AS (
  SELECT {grp}, feature, list_sort(list(DISTINCT CASE k WHEN 0 THEN edge - 1e-5::DOUBLE
    WHEN 10 THEN edge + 1e-5::DOUBLE ELSE edge END)) AS e FROM pct GROUP BY {grp}, feature)"""
BIN = "len(list_filter(list_slice(e, 2, len(e) - 1), lambda x: x <= value))"
CLOSED_BIN = f"CASE WHEN value >= e[1] AND value <= e[len(e)] THEN {BIN} END"

PSI = """psi AS (
  SELECT cmp, feature, sum(CASE WHEN bin IS NULL THEN 0 ELSE (q - p) * ln(q / p) END) AS psi FROM (
    SELECT cmp, feature, bin, CASE WHEN b = 0 THEN 1e-4::DOUBLE ELSE b / bt END AS p,
      CASE WHEN t = 0 THEN 1e-4::DOUBLE ELSE t / tt END AS q
    FROM (SELECT *, sum(b) OVER (PARTITION BY cmp, feature) AS bt, sum(t) OVER (PARTITION BY cmp, feature) AS tt
      FROM (SELECT cmp, feature, bin, CAST(count(*) FILTER (side = 'base') AS DOUBLE) AS b,
          CAST(count(*) FILTER (side = 'test') AS DOUBLE) AS t FROM binned GROUP BY cmp, feature, bin)))
  GROUP BY cmp, feature)"""

OPEN_PSI = [
    "base AS (SELECT 1 AS g, feature, value FROM long WHERE day IN (SELECT day FROM days WHERE role = 'baseline'))",
    _percentiles("base", "g"), OPEN_EDGES.format(grp="g"),
    f"binned AS (SELECT cmp, side, feature, {BIN} AS bin FROM long JOIN pairs USING (day) JOIN edges USING (feature))",
    PSI]

WINDOW_PSI = [
    "base AS (SELECT cmp, feature, value FROM long JOIN pairs USING (day) WHERE side = 'base')",
    _percentiles("base", "cmp"), WINDOW_EDGES.format(grp="cmp"),
    f"binned AS (SELECT cmp, side, feature, {CLOSED_BIN} AS bin FROM long JOIN pairs USING (day)\n"
    "  JOIN edges USING (cmp, feature))",
    PSI]

WD = """wd AS (
  SELECT cmp, feature, sum(abs(cb / bt - ct / tt) * gap) AS wasserstein FROM (
    SELECT cmp, feature, coalesce(lead(value) OVER w - value, 0) AS gap,
      CAST(sum(b) OVER w AS DOUBLE) AS cb, CAST(sum(t) OVER w AS DOUBLE) AS ct,
      sum(b) OVER (PARTITION BY cmp, feature) AS bt, sum(t) OVER (PARTITION BY cmp, feature) AS tt
    FROM (SELECT cmp, feature, value, count(*) FILTER (side = 'base') AS b, count(*) FILTER (side = 'test') AS t
      FROM long JOIN pairs USING (day) GROUP BY cmp, feature, value)
    WINDOW w AS (PARTITION BY cmp, feature ORDER BY value))
  GROUP BY cmp, feature)"""

FEATURE_DRIFT = ("SELECT cmp, feature, round(psi, 6) + 0::DOUBLE AS psi, round(wasserstein, 6) + 0::DOUBLE AS wasserstein\n"
                 "FROM psi JOIN wd USING (cmp, feature)")
MEAN_DRIFT = ("SELECT cmp AS day, round(avg(psi), 6) + 0::DOUBLE AS mean_psi, round(avg(wasserstein), 6) + 0::DOUBLE AS mean_wd\n"
              "FROM psi JOIN wd USING (cmp, feature) GROUP BY cmp")


def _drift(fixture: str, table: str, features: list[str], pairs: str, psi: list[str], select: str) -> str:
    return _with(fixture, _days(table), pairs, *_scaled_long(table, features), *psi, WD) + select


def _in_order(table: str, by: str, key: str, seed: int = 42) -> str:
    """Rows numbered per group in sampling order."""
    return f"""(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5({key} || ':{seed}'), {key}) AS rk,
    count(*) OVER (PARTITION BY {by}) AS cnt FROM {table})"""


ID = "CAST(event_id AS VARCHAR)"


def _hash(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8) AS BIGINT)"


# --- sources, cleaning ---------------------------------------------------------

_raw_name = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RAW_LABELS.items()) + " END"
RAW_EVENTS = f"""raw AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, event_id,
    CASE event_id % 13 WHEN 0 THEN 'Infinity' WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN '1d'
      WHEN 4 THEN ' ' || cents || ' ' WHEN 5 THEN '-inf' WHEN 6 THEN '1e3' WHEN 7 THEN 'nan' ELSE cents END AS amount,
    CASE event_id % 11 WHEN 0 THEN '  ' || name || chr(9) WHEN 1 THEN 'Label' WHEN 2 THEN ' Label '
      WHEN 3 THEN 'unknown' WHEN 4 THEN NULL ELSE name END AS raw_label
  FROM (SELECT *, {_raw_name} AS name, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS cents FROM events))"""
NUMBER = "CASE WHEN amount IN ('abc', '', '1d') THEN NULL ELSE TRY_CAST(trim(amount) AS DOUBLE) END"
_map = "CASE trim(raw_label, ' ' || chr(9)) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in LABEL_MAP.items()) + " END"

ORACLES["day_registry"] = _with(EVENTS, _days("e")) + "SELECT ord, day, role FROM days"
ORACLES["clean_labels"] = _with(RAW_EVENTS) + (
    f"SELECT day, event_id, label FROM (SELECT day, event_id, {_map} AS label FROM raw) WHERE label IS NOT NULL")
ORACLES["coerce_numeric_zero"] = _with(RAW_EVENTS) + (
    f"SELECT event_id, CASE WHEN n IS NULL OR isnan(n) OR isinf(n) THEN 0.0::DOUBLE ELSE n END AS amount\n"
    f"FROM (SELECT event_id, {NUMBER} AS n FROM raw)")
ORACLES["coerce_numeric_drop"] = _with(RAW_EVENTS) + (
    f"SELECT event_id, n AS amount FROM (SELECT event_id, {NUMBER} AS n FROM raw)\n"
    "WHERE n IS NOT NULL AND NOT isnan(n) AND NOT isinf(n)")
ORACLES["header_trim_project"] = _with(RAW_EVENTS) + "SELECT day, event_id, amount FROM raw"
ORACLES["csv_roundtrip"] = _with(RAW_EVENTS) + (
    "SELECT 'all' AS day, event_id, '01/01/2024 00:00' AS \"Timestamp\", amount FROM raw")
ORACLES["day_table_roundtrip"] = _with(EVENTS, _days("e")) + (
    "SELECT day, label, value, event_id FROM e WHERE day IN (SELECT day FROM days WHERE role = 'future')")
ORACLES["append_day_table"] = _with(EVENTS) + (
    "SELECT day, label, count(*) AS n, max(value) AS top, false AS before, true AS after FROM e GROUP BY day, label")
ORACLES["ingest_incremental"] = _with(
    RAW_EVENTS, "usable AS (SELECT * FROM raw WHERE amount NOT IN ('', 'nan', 'Infinity', '-inf') AND raw_label IS NOT NULL)",
) + (f"SELECT day, event_id, coalesce(n, 0.0::DOUBLE) AS amount, label FROM (\n"
     f"  SELECT 'w' || CAST(CAST(substr(day, 10, 1) AS INT) % 4 AS VARCHAR) AS day, event_id, {NUMBER} AS n, {_map} AS label\n"
     "  FROM usable) WHERE label IS NOT NULL")

ORACLES["ingest_sample_clean"] = _with(
    RAW_EVENTS,
    "chunked AS (SELECT *, event_id // 1000 AS chunk, CASE WHEN day = '2024-01-04' THEN 0.15::DOUBLE\n"
    "  ELSE 0.3::DOUBLE END AS part FROM raw)",
    f"chosen AS (SELECT * EXCLUDE (rk, cnt) FROM {_in_order('chunked', 'day, chunk', ID)}\n"
    "  WHERE rk <= round_even(part * cnt, 0))",
    "usable AS (SELECT * FROM chosen WHERE amount NOT IN ('', 'nan', 'Infinity', '-inf') AND raw_label IS NOT NULL)",
    f"placed AS {_in_order('usable', 'day', ID)}",
    "kept AS (SELECT day, event_id, amount, raw_label FROM placed WHERE cnt >= 60 AND rk <= 60\n"
    "  UNION ALL SELECT p.day, event_id, amount, raw_label FROM (\n"
    f"    SELECT day, 1 + {_hash('day', 'CAST(d AS VARCHAR)', chr(39) + '42' + chr(39))} % cnt AS rk\n"
    "    FROM (SELECT day, any_value(cnt) AS cnt FROM placed WHERE cnt < 60 GROUP BY day), range(1, 61) t(d)) x\n"
    "  JOIN placed p ON p.day = x.day AND p.rk = x.rk)",
) + (f"SELECT day, event_id, coalesce(n, 0.0::DOUBLE) AS amount, label FROM (\n"
     f"  SELECT day, event_id, {NUMBER} AS n, {_map} AS label FROM kept) WHERE label IS NOT NULL")

# --- sampling ------------------------------------------------------------------

EVENT_COLUMNS = "day, label, value, event_id"
ORACLES["sample_fraction"] = _with(EVENTS) + (
    f"SELECT {EVENT_COLUMNS} FROM {_in_order('e', 'day', ID)} WHERE rk <= round_even(0.3::DOUBLE * cnt, 0)")


def _replaced(rows: int) -> str:
    return (f"SELECT p.day, label, value, event_id FROM (\n"
            f"  SELECT day, 1 + {_hash('day', 'CAST(d AS VARCHAR)', chr(39) + '42' + chr(39))} % cnt AS rk\n"
            f"  FROM (SELECT day, any_value(cnt) AS cnt FROM placed WHERE cnt < {rows} GROUP BY day),\n"
            f"    range(1, {rows + 1}) t(d)) x JOIN placed p ON p.day = x.day AND p.rk = x.rk")


ORACLES["sample_n"] = _with(EVENTS, f"placed AS {_in_order('e', 'day', ID)}") + (
    f"SELECT {EVENT_COLUMNS} FROM placed WHERE cnt >= 300 AND rk <= 300 UNION ALL {_replaced(300)}")
ORACLES["sample_n_replace"] = _with(EVENTS, f"placed AS {_in_order('e', 'day', ID)}") + _replaced(340)
ORACLES["random_order_limit"] = _with(LINEITEM) + (
    f"SELECT row_key, label FROM {_in_order('l', 'label', 'row_key', 7)} WHERE rk <= 100")
ORACLES["stratified_anchor_sample"] = _with(EVENTS) + (
    f"SELECT {EVENT_COLUMNS} FROM {_in_order('e', 'day, label', ID)} WHERE rk <= round_even(0.05::DOUBLE * cnt, 0)")

_raw_long = "raw_long AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT day, row_key, '{f}' AS feature, {f} AS value FROM l" for f in L_FEATURES) + ")"
SIDED = ("sided AS (SELECT r.*, feature || '|' || row_key AS cell, CASE WHEN role = 'baseline' THEN 'baseline'\n"
         "  ELSE CAST(day AS VARCHAR) END AS side FROM {long} r JOIN days USING (day))")
ORACLES["cap_sample"] = _with(LINEITEM, _days("l"), _raw_long, SIDED.format(long="raw_long")) + (
    f"SELECT day, row_key, feature, value FROM {_in_order('sided', 'side, feature', 'cell')} WHERE rk <= 5000")
ORACLES["downsample_classes"] = _with(LINEITEM) + (
    f"SELECT day, label, row_key FROM {_in_order('l', 'day, label', 'row_key')} WHERE rk <= 2850")

# --- features and scaling ------------------------------------------------------

ORACLES["zero_variance_features"] = _with(LINEITEM) + "SELECT ord, feature FROM (\n  " + "\n  UNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS ord, '{f}' AS feature, var_samp({f}) AS spread FROM (SELECT *, 7.5::DOUBLE AS constant FROM l)"
    for i, f in enumerate([*L_FEATURES, "constant"])) + ") WHERE spread <> 0"
ORACLES["scaler_fit"] = _with(LINEITEM, _days("l")) + "\nUNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS ord, '{f}' AS feature, min({f}) AS \"min\", max({f}) AS \"max\" FROM l\n"
    "  WHERE day IN (SELECT day FROM days WHERE role = 'baseline')" for i, f in enumerate(L_FEATURES))
ORACLES["scaler_state"] = _with(LINEITEM) + (
    "SELECT 'before' AS step, false AS found, 0::BIGINT AS features\nUNION ALL SELECT 'after', true, "
    + " + ".join(f"CAST(min({f}) IS NOT NULL AS BIGINT)" for f in L_FEATURES) + " FROM l")
ORACLES["retained_feature_count"] = _with(VECTORS, _days("v")) + (
    "SELECT count(*) AS features FROM (\n  " + "\n  UNION ALL ".join(
        f"SELECT var_samp({f}) AS spread FROM v WHERE day IN (SELECT day FROM days WHERE role = 'baseline')"
        for f in V_FEATURES) + ") WHERE spread <> 0")
_bounds = _scaled_long("l", L_FEATURES)[0]
_scaled = ", ".join(f"({f} - {f}_a) / ({f}_b - {f}_a) AS {f}" for f in L_FEATURES)
ORACLES["scale_transform"] = _with(LINEITEM, _days("l"), _bounds) + (
    f"SELECT day, row_key, {_scaled} FROM l, fit WHERE day IN (SELECT day FROM days WHERE role = 'future')")
ORACLES["scale_inverse"] = _with(LINEITEM) + (
    "SELECT row_key, " + ", ".join(f"round({f}, 6) + 0::DOUBLE AS {f}" for f in L_FEATURES) + " FROM l")
ORACLES["narrow_matrix"] = _with(LINEITEM, _days("l"), _bounds) + (
    "SELECT day, row_key, " + ", ".join(f"CAST(({f} - {f}_a) / ({f}_b - {f}_a) AS FLOAT) AS {f}" for f in L_FEATURES)
    + ", CAST(CASE WHEN label = 'N' THEN 0 ELSE 1 END AS INT) AS target FROM l, fit")

# --- distributions and drift ---------------------------------------------------

_long = _scaled_long("l", L_FEATURES)
_edges = _with(LINEITEM, _days("l"), *_long, _percentiles("long", "day")) + (
    "SELECT day, feature, CAST(k AS INT) AS k, edge FROM pct")
ORACLES["quantile_edges"] = _edges
ORACLES["quantile_edges_bucketed"] = _edges


def _histogram(edges: str, bin_: str) -> str:
    return _with(
        LINEITEM, _days("l"), *_long, *OPEN_PSI[:2], edges.format(grp="g"),
        f"binned AS (SELECT day, feature, {bin_} AS bin FROM long JOIN edges USING (feature))",
        "cells AS (SELECT d.day, feature, bin FROM days d, (SELECT feature, unnest(range(len(e) - 1)) AS bin FROM edges))",
    ) + ("SELECT c.day, c.feature, CAST(c.bin AS INT) AS bin, count(b.bin) AS n FROM cells c\n"
         "LEFT JOIN binned b ON b.day = c.day AND b.feature = c.feature AND b.bin = c.bin GROUP BY c.day, c.feature, c.bin")


ORACLES["histogram_open"] = _histogram(OPEN_EDGES, BIN)
ORACLES["histogram_window"] = _histogram(WINDOW_EDGES, CLOSED_BIN)
ORACLES["psi_open"] = _with(LINEITEM, _days("l"), BASE_PAIRS, *_long, *OPEN_PSI) + (
    "SELECT cmp, feature, round(psi, 6) + 0::DOUBLE AS psi FROM psi")
ORACLES["psi_window"] = _with(LINEITEM, _days("l"), WINDOW_PAIRS, *_long, *WINDOW_PSI) + (
    "SELECT cmp, feature, round(psi, 6) + 0::DOUBLE AS psi FROM psi")
ORACLES["wasserstein"] = _with(LINEITEM, _days("l"), BASE_PAIRS, *_long, WD) + (
    "SELECT cmp, feature, round(wasserstein, 6) + 0::DOUBLE AS wasserstein FROM wd")
ORACLES["wasserstein_bucketed"] = ORACLES["wasserstein"]
ORACLES["feature_drift"] = _drift(LINEITEM, "l", L_FEATURES, BASE_PAIRS, OPEN_PSI, FEATURE_DRIFT)
ORACLES["feature_drift_vectors"] = _drift(VECTORS, "v", V_FEATURES, BASE_PAIRS, OPEN_PSI, FEATURE_DRIFT)
ORACLES["feature_drift_capped"] = _with(
    LINEITEM, _days("l"), BASE_PAIRS, _long[0], "all_" + _scaled_long("l", L_FEATURES, "day, row_key")[1],
    SIDED.format(long="all_long"),
    f"long AS (SELECT day, feature, value FROM {_in_order('sided', 'side, feature', 'cell')} WHERE rk <= 5000)",
    *OPEN_PSI, WD) + FEATURE_DRIFT
ORACLES["daily_drift"] = _drift(LINEITEM, "l", L_FEATURES, BASE_PAIRS, OPEN_PSI, MEAN_DRIFT)
ORACLES["daily_drift_events"] = _drift(EVENTS, "e", ["value"], BASE_PAIRS, OPEN_PSI, MEAN_DRIFT)
ORACLES["first_drift_days"] = ORACLES["daily_drift_events"] + " ORDER BY cmp LIMIT 5"

# --- windows, anchor, pools ----------------------------------------------------

ORACLES["window_schedule"] = _with(EVENTS, _days("e")) + (
    "SELECT t.ord AS test_ord, t.day AS test_day, w.ord AS window_ord, w.day AS window_day\n"
    "FROM days t JOIN days w ON w.ord BETWEEN t.ord - 3 AND t.ord - 1 WHERE t.role = 'future'")
ORACLES["exit_schedule"] = _with(EVENTS, _days("e")) + (
    "SELECT t.ord AS test_ord, t.day AS test_day, w.ord AS exit_ord, w.day AS exit_day\n"
    "FROM days t JOIN days w ON w.ord = t.ord - 3 WHERE t.role = 'future'")
ORACLES["anchor_schedule"] = _with(EVENTS, _days("e")) + (
    "SELECT t.ord AS test_ord, t.day AS test_day, w.ord AS anchor_ord, w.day AS anchor_day\n"
    "FROM days t JOIN days w ON w.ord <= t.ord - 4 WHERE t.role = 'future'")
ORACLES["active_window_feature_drift"] = _drift(LINEITEM, "l", L_FEATURES, WINDOW_PAIRS, WINDOW_PSI, FEATURE_DRIFT)
ORACLES["active_window_drift"] = _drift(LINEITEM, "l", L_FEATURES, WINDOW_PAIRS, WINDOW_PSI, MEAN_DRIFT)
ORACLES["active_window_drift_events"] = _drift(EVENTS, "e", ["value"], WINDOW_PAIRS, WINDOW_PSI, MEAN_DRIFT)
ORACLES["history_anchor"] = _with(LINEITEM) + (
    f"SELECT day, label, row_key FROM {_in_order('l', 'day, label', 'row_key')}\n"
    "WHERE rk <= round_even(0.05::DOUBLE * cnt, 0)")
_anchor = (f"anchor AS (SELECT {EVENT_COLUMNS} FROM {_in_order('e', 'day, label', ID)}\n"
           "  WHERE rk <= round_even(0.05::DOUBLE * cnt, 0))")
ORACLES["training_pool"] = _with(EVENTS, _days("e"), _anchor, "tests AS (SELECT ord AS test_ord FROM days WHERE role = 'future')") + (
    "SELECT test_ord, day, label, event_id, 'window' AS src FROM e JOIN days USING (day)\n"
    "  JOIN tests ON ord BETWEEN test_ord - 3 AND test_ord - 1\n"
    "UNION ALL SELECT test_ord, day, label, event_id, 'anchor' AS src FROM anchor JOIN days USING (day)\n"
    "  JOIN tests ON ord <= test_ord - 4")
ORACLES["training_pool_counts"] = _with(
    EVENTS, _days("e"), _anchor,
    "en AS (SELECT ord, count(*) AS n FROM e JOIN days USING (day) GROUP BY ord)",
    "an AS (SELECT ord, count(*) AS n FROM anchor JOIN days USING (day) GROUP BY ord)",
    "c AS (SELECT t.ord AS test_ord, t.day AS test_day,\n"
    "  CAST((SELECT coalesce(sum(n), 0) FROM en WHERE en.ord BETWEEN t.ord - 3 AND t.ord - 1) AS BIGINT) AS window_rows,\n"
    "  CAST((SELECT coalesce(sum(n), 0) FROM an WHERE an.ord <= t.ord - 4) AS BIGINT) AS anchor_rows,\n"
    "  CAST((SELECT coalesce(sum(n), 0) FROM en WHERE en.ord = t.ord) AS BIGINT) AS test_rows\n"
    "  FROM days t WHERE t.role = 'future')",
) + "SELECT test_ord, test_day, window_rows, anchor_rows, window_rows + anchor_rows AS total_rows, test_rows FROM c"

# --- balancing -----------------------------------------------------------------

ORACLES["class_counts"] = _with(EVENTS) + "SELECT day, label, count(*) AS n FROM e GROUP BY day, label"

_one_day = VECTORS.replace("CAST(vec_id % 10 AS INT) AS day", "CAST(1 AS INT) AS day")
_vfit = "fit AS (SELECT " + ", ".join(f"min({f}) AS {f}_a, max({f}) AS {f}_b" for f in V_FEATURES) + " FROM v)"
_mean_class = "(SELECT CAST(floor(avg(n)) AS BIGINT) FROM counts)"
_biggest_class = "(SELECT max(n) FROM counts)"
_parts = ["CAST(c.day AS VARCHAR)", "c.label", "CAST(d AS VARCHAR)"]
def _synthetic(target: str) -> list[str]:
    return [
        "counts AS (SELECT day, label, count(*) AS n FROM v GROUP BY day, label)",
        "s AS (SELECT day, label, row_number() OVER (PARTITION BY day, label\n"
        "  ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), CAST(vec_id AS VARCHAR)) AS rk, "
        + ", ".join(f"({f} - {f}_a) / ({f}_b - {f}_a) AS {f}" for f in V_FEATURES) + " FROM v, fit)",
        f"drawn AS (SELECT c.day, c.label, d AS draw, 1 + {_hash(*_parts, chr(39) + 'i' + chr(39), chr(39) + '42' + chr(39))} % n AS i,\n"
        f"  1 + {_hash(*_parts, chr(39) + 'j' + chr(39), chr(39) + '42' + chr(39))} % n AS j,\n"
        f"  {_hash(*_parts, chr(39) + 'a' + chr(39), chr(39) + '42' + chr(39))} / CAST(4294967296 AS DOUBLE) AS a\n"
        f"  FROM counts c, range(1, {target} + 1) t(d) WHERE d <= {target} - n)",
        "synthetic AS (SELECT drawn.day, drawn.label, draw, " + ", ".join(
            f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, a * x.{f} + (1 - a) * y.{f})) AS {f}" for f in V_FEATURES)
        + "\n  FROM drawn JOIN s x ON x.day = drawn.day AND x.label = drawn.label AND x.rk = i\n"
        "  JOIN s y ON y.day = drawn.day AND y.label = drawn.label AND y.rk = j)"]


ORACLES["synthesize_copula"] = _with(_one_day) + (
    "SELECT day, label, most - n AS n, most - n AS inside\n"
    "FROM (SELECT day, label, count(*) AS n, max(count(*)) OVER () AS most FROM v GROUP BY day, label) WHERE n < most")
ORACLES["synthesize_minority"] = _with(_one_day, _vfit, *_synthetic(_biggest_class)) + "SELECT * FROM synthetic"
ORACLES["balance_vectors"] = _with(_one_day, _vfit, *_synthetic(_mean_class)) + (
    "SELECT day, label, 'real:' || CAST(vec_id AS VARCHAR) AS row_key, "
    + ", ".join(f"round({f}, 6) + 0::DOUBLE AS {f}" for f in V_FEATURES)
    + f" FROM {_in_order('v', 'day, label', 'CAST(vec_id AS VARCHAR)')} WHERE rk <= {_mean_class}\n"
    "UNION ALL SELECT day, label, 'new:' || CAST(draw AS VARCHAR), "
    + ", ".join(f"round({f} * ({f}_b - {f}_a) + {f}_a, 6) + 0::DOUBLE" for f in V_FEATURES) + " FROM synthetic, fit")
ORACLES["balance_days"] = _with(LINEITEM, "counts AS (SELECT day, label, count(*) AS n FROM l GROUP BY day, label)") + (
    f"SELECT day, label, {_mean_class} AS n FROM counts")

# --- models and measures -------------------------------------------------------

ORACLES["binary_labels"] = (
    "SELECT event_id, CAST(CASE WHEN event_id % 10 > 0 AND event_type = 'view' THEN 0 ELSE 1 END AS INT) AS target "
    "FROM events")
CONFUSED = """confused AS (
  SELECT model, day, count(*) FILTER (target = 0 AND predicted = 0) AS tn,
    count(*) FILTER (target = 0 AND predicted = 1) AS fp, count(*) FILTER (target = 1 AND predicted = 0) AS fn,
    count(*) FILTER (target = 1 AND predicted = 1) AS tp FROM (
    SELECT day, model, CASE WHEN day = 1996 OR label = 'N' THEN 0 ELSE 1 END AS target,
      CASE WHEN day = 1996 THEN 0 WHEN p * 10 >= 0.5 THEN 1 ELSE 0 END AS predicted
    FROM (SELECT day, label, 'discount' AS model, l_discount AS p FROM l
      UNION ALL SELECT day, label, 'tax' AS model, l_tax AS p FROM l))
  GROUP BY model, day)"""


def _share(part: str, whole: str) -> str:
    return f"round(CASE WHEN {whole} = 0 THEN 0 ELSE CAST({part} AS DOUBLE) / ({whole}) END, 6) + 0::DOUBLE"


ORACLES["confusion_counts"] = _with(LINEITEM, CONFUSED) + "SELECT * FROM confused"
_measures = (f"SELECT model, day, {_share('(tp + tn)', '(tn + fp + fn + tp)')} AS accuracy,\n"
             f"  {_share('tp', '(tp + fp)')} AS precision, {_share('tp', '(tp + fn)')} AS recall_detection_rate,\n"
             f"  {_share('2 * tp', '(2 * tp + fp + fn)')} AS f1_score,\n"
             f"  {_share('fp', '(fp + tn)')} AS false_positive_rate FROM confused")
ORACLES["confusion_metrics"] = _with(LINEITEM, CONFUSED) + _measures
ORACLES["performance_report"] = _with(LINEITEM, CONFUSED, f"m AS ({_measures})") + (
    "SELECT day, max(accuracy) FILTER (model = 'discount') AS discount, max(accuracy) FILTER (model = 'tax') AS tax\n"
    "FROM m GROUP BY day")
ORACLES["static_sets"] = _with(LINEITEM, _days("l")) + (
    "SELECT day, count(*) AS n, count(*) FILTER (label <> 'N') AS positives,\n"
    "  CASE WHEN role = 'baseline' THEN 'train' ELSE 'test' END AS part FROM l JOIN days USING (day) GROUP BY day, role")

# The models' target is a rule on one feature, so every row is scored and none wrongly.
_ruled = ("SELECT '{model}' AS model, day, count(*) FILTER (l_discount < 0.05) AS tn, 0::BIGINT AS fp, 0::BIGINT AS fn,\n"
          "  count(*) FILTER (l_discount >= 0.05) AS tp FROM l JOIN days USING (day) WHERE role = 'future' GROUP BY day")
for _name, _model in (("static_forest", "forest"), ("static_forest_grown", "grown_forest"), ("static_mlp", "perceptron"), ("static_network", "network")):
    ORACLES[_name] = _with(LINEITEM, _days("l")) + _ruled.format(model=_model)
for _name, _model in (("adaptive_forest", "forest"), ("adaptive_mlp", "perceptron")):
    ORACLES[_name] = (
        f"SELECT '{_model}' AS model, day, 1::DOUBLE AS accuracy, 1::DOUBLE AS precision, 1::DOUBLE AS recall_detection_rate,\n"
        "  1::DOUBLE AS f1_score, 0::DOUBLE AS false_positive_rate, mean_psi AS active_window_psi, mean_wd AS active_window_wd\n"
        f"FROM ({ORACLES['active_window_drift']})")
