"""DuckDB SQL for the adapters, shared by every oracle statement.

The oracle is a brute-force restatement of each query over the same driver
tables; it is only used to check results, never to compute them.
"""

from __future__ import annotations

ADAPTERS = {
    "fires": """SELECT event_id,
  CAST(460000+(user_id%10)*5000+(event_id*7919)%7000-3500 AS DOUBLE)/10000 AS latitude,
  CAST(240000+(user_id%15)*5000+(event_id*104729)%7000-3500 AS DOUBLE)/10000 AS longitude,
  CAST(ts AS DATE) AS acq_date FROM events""",
    "grid": """SELECT latitude, longitude, concat('UA', CAST(MIN(p_partkey) % 25 AS VARCHAR)) AS oblast_id,
  MAX(p_retailprice) AS pop_density
FROM (SELECT CAST(91+p_partkey%11 AS DOUBLE)/2 AS latitude,
  CAST(47+CAST(floor(p_partkey/11) AS BIGINT)%16 AS DOUBLE)/2 AS longitude, p_partkey, p_retailprice FROM part) x
GROUP BY latitude, longitude""",
    "land_use": """SELECT latitude,longitude,CAST(a0 AS DOUBLE)/s AS c0,CAST(a1 AS DOUBLE)/s AS c1,
  CAST(a2 AS DOUBLE)/s AS c2,CAST(a3 AS DOUBLE)/s AS c3,CAST(a4 AS DOUBLE)/s AS c4
FROM (SELECT *,a0+a1+a2+a3+a4 AS s FROM (SELECT latitude, longitude,
  1+(k*3+sz)%20 AS a0,1+(k*5+sz)%20 AS a1,1+(k*7+sz)%20 AS a2,1+(k*11+sz)%20 AS a3,1+(k*13+sz)%20 AS a4
  FROM (SELECT latitude, longitude, MIN(p_partkey) AS k, arg_min(p_size, p_partkey) AS sz FROM (
    SELECT CAST(91+p_partkey%12 AS DOUBLE)/2 AS latitude,
      CAST(47+CAST(floor(p_partkey/12) AS BIGINT)%15 AS DOUBLE)/2 AS longitude, p_partkey, p_size FROM part) c
    GROUP BY latitude, longitude) x) y) z""",
    "weather": """SELECT concat('UA',CAST(n_nationkey AS VARCHAR)) AS oblast_id, d AS acq_date,
  CAST((n_nationkey*37+day(d)*11)%300 AS DOUBLE)/10-10 AS t_mean,
  CAST((n_nationkey*17+day(d)*29)%101 AS DOUBLE) AS cloud_cover
FROM nation CROSS JOIN (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) x
WHERE (n_nationkey+day(d))%13<>0""",
    "verts": """SELECT k, i, y, x FROM (
  SELECT n_nationkey AS k, CAST(46+n_nationkey%5 AS DOUBLE) AS cy,
    CAST(24 AS DOUBLE)+CAST(floor(n_nationkey/5) AS DOUBLE)*CAST(1.5 AS DOUBLE) AS cx FROM nation) c,
  (SELECT 0 AS i, CAST(-0.6 AS DOUBLE) AS dy, CAST(-0.2 AS DOUBLE) AS dx
   UNION ALL SELECT 1, CAST(-0.1 AS DOUBLE), CAST(0.9 AS DOUBLE)
   UNION ALL SELECT 2, CAST(0.6 AS DOUBLE), CAST(0.3 AS DOUBLE)
   UNION ALL SELECT 3, CAST(0.1 AS DOUBLE), CAST(-0.8 AS DOUBLE)) o,
  LATERAL (SELECT cy+dy AS y, cx+dx AS x) p""",
    "edges": """SELECT a.k AS poly_id,a.y AS y1,a.x AS x1,b.y AS y2,b.x AS x2
FROM verts a JOIN verts b ON a.k=b.k AND b.i=(a.i+1)%4""",
    "event_windows": """SELECT r_name AS event, CAST(DATE '2024-01-01'+r_regionkey*5 AS DATE) AS start_date,
  CAST(DATE '2024-01-01'+(r_regionkey*5+9) AS DATE) AS end_date FROM region""",
    "overlays": """SELECT n_nationkey AS pos, n_name AS url,
  concat('[[',CAST(52.5-n_nationkey AS VARCHAR),', 20.4], [44.0, ',CAST(42.5+n_nationkey AS VARCHAR),']]') AS bounds,
  CAST(DATE '2024-01-01'+n_nationkey*2 AS DATE) AS start_date,
  CAST(DATE '2024-01-01'+(n_nationkey*2+n_nationkey%3) AS DATE) AS end_date
FROM nation""",
    "hourly": "SELECT event_type AS oblast_id, ts, value AS cloud_cover FROM events",
    "hourly_regions": "SELECT concat('UA', CAST(user_id % 25 AS VARCHAR)) AS oblast_id, ts, value AS cloud_cover FROM events",
    "weather_locations": """SELECT concat('UA', CAST(n_nationkey AS VARCHAR)) AS oblast_id, n_name AS city,
  CAST(46 + n_nationkey % 5 AS DOUBLE) AS latitude,
  CAST(24 AS DOUBLE) + CAST(floor(n_nationkey/5) AS DOUBLE) * CAST(1.5 AS DOUBLE) AS longitude FROM nation""",
    "merc": """SELECT s_suppkey AS id, CAST(2500000+s_suppkey*15000 AS DOUBLE) AS x,
  CAST(5500000+(s_suppkey*7919)%1400000 AS DOUBLE) AS y FROM supplier""",
    "cal": """SELECT CAST(unnest(generate_series(DATE '2024-01-01',DATE '2024-01-30',INTERVAL 1 DAY)) AS DATE) AS d""",
    # snapped fires on the 0.5 degree grid
    "snapped": """SELECT event_id, acq_date, latitude AS latitude_original, longitude AS longitude_original,
  round_even(latitude*2,0)/2 + 0.0 AS latitude, round_even(longitude*2,0)/2 + 0.0 AS longitude,
  CAST(round_even(latitude*2,0)/2 + 0.0 AS VARCHAR) || '_' || CAST(round_even(longitude*2,0)/2 + 0.0 AS VARCHAR) AS grid_cell
FROM fires""",
    "cells": """SELECT grid_cell, any_value(latitude) AS latitude, any_value(longitude) AS longitude,
  arg_min(latitude_original, (acq_date, latitude_original, longitude_original)) AS latitude_original,
  arg_min(longitude_original, (acq_date, latitude_original, longitude_original)) AS longitude_original
FROM snapped GROUP BY grid_cell""",
    "counts": "SELECT grid_cell, acq_date, COUNT(*) AS fire_count FROM snapped GROUP BY grid_cell, acq_date",
    "series": """SELECT c.grid_cell, cal.d AS acq_date, c.latitude, c.longitude, c.latitude_original,
  c.longitude_original, CAST(dayofyear(cal.d) AS INTEGER) AS day_of_year,
  CAST(COALESCE(n.fire_count,0) AS BIGINT) AS fire_count
FROM cells c CROSS JOIN cal LEFT JOIN counts n ON n.grid_cell=c.grid_cell AND n.acq_date=cal.d""",
    "merged": """SELECT COALESCE(g.latitude,l.latitude) AS latitude, COALESCE(g.longitude,l.longitude) AS longitude,
  g.oblast_id, g.pop_density, l.c0, l.c1, l.c2, l.c3, l.c4
  FROM grid g FULL OUTER JOIN land_use l ON g.longitude=l.longitude AND g.latitude=l.latitude""",
    "static": """SELECT latitude, longitude, oblast_id,
  CASE WHEN pop_density > (SELECT quantile_cont(pop_density, 0.95) FROM merged) THEN
    (SELECT quantile_cont(pop_density, 0.95) FROM merged) ELSE pop_density END AS pop_density,
  c0, c1, c2, c3, c4
FROM merged""",
    # the feature pipeline counts one detection per place and day
    "one_fires": "SELECT DISTINCT latitude, longitude, acq_date FROM fires",
    "one_snapped": """SELECT acq_date, latitude AS latitude_original, longitude AS longitude_original,
  round_even(latitude*2,0)/2 + 0.0 AS latitude, round_even(longitude*2,0)/2 + 0.0 AS longitude,
  CAST(round_even(latitude*2,0)/2 + 0.0 AS VARCHAR) || '_' || CAST(round_even(longitude*2,0)/2 + 0.0 AS VARCHAR) AS grid_cell
FROM one_fires""",
    "one_series": """SELECT c.grid_cell, cal.d AS acq_date, c.latitude, c.longitude, c.latitude_original,
  c.longitude_original, CAST(dayofyear(cal.d) AS INTEGER) AS day_of_year,
  CAST(COALESCE(n.fire_count,0) AS BIGINT) AS fire_count
FROM (SELECT grid_cell, any_value(latitude) AS latitude, any_value(longitude) AS longitude,
    arg_min(latitude_original, (acq_date, latitude_original, longitude_original)) AS latitude_original,
    arg_min(longitude_original, (acq_date, latitude_original, longitude_original)) AS longitude_original
  FROM one_snapped GROUP BY grid_cell) c CROSS JOIN cal
LEFT JOIN (SELECT grid_cell, acq_date, COUNT(*) AS fire_count FROM one_snapped GROUP BY grid_cell, acq_date) n
  ON n.grid_cell=c.grid_cell AND n.acq_date=cal.d""",
    "features": """SELECT s.grid_cell, s.acq_date, s.latitude, s.longitude, s.latitude_original,
  s.longitude_original, s.day_of_year, s.fire_count, st.oblast_id, st.pop_density,
  st.c0, st.c1, st.c2, st.c3, st.c4, w.t_mean, w.cloud_cover
FROM one_series s LEFT JOIN static st ON s.latitude=st.latitude AND s.longitude=st.longitude
LEFT JOIN weather w ON w.oblast_id=st.oblast_id AND w.acq_date=s.acq_date""",
}

# Which adapters each adapter needs, in dependency order.
DEPENDS = {
    "edges": ["verts"],
    "snapped": ["fires"],
    "cells": ["snapped"],
    "counts": ["snapped"],
    "series": ["cells", "cal", "counts"],
    "merged": ["grid", "land_use"],
    "static": ["merged"],
    "one_fires": ["fires"],
    "one_snapped": ["one_fires"],
    "one_series": ["one_snapped", "cal"],
    "features": ["one_series", "static", "weather"],
}


def with_adapters(names: list[str], body: str) -> str:
    """``WITH <adapters in dependency order> <body>``."""
    order: list[str] = []

    def visit(n):
        for d in DEPENDS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS (\n{ADAPTERS[n]}\n)" for n in order)
    return f"WITH {ctes}\n{body}"
