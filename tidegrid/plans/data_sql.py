"""DuckDB statements equivalent to the data-preparation queries."""

from __future__ import annotations

KEY = r"lower(trim(regexp_replace(COLUMN, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')))"
PRICED = "price is not null and not isnan(price) and not isinf(price)"


def key(column: str = "commodity_type") -> str:
    return KEY.replace("COLUMN", column)


MICROS = "(CASE regexp_extract(freq, '[a-z]+$') WHEN 'm' THEN 60000000 WHEN 'h' THEN 3600000000 WHEN 'd' THEN 86400000000 WHEN 's' THEN 1000000 ELSE 604800000000 END) * CAST(regexp_extract(freq, '^[0-9]+') AS BIGINT)"

GRID = f"""
WITH l AS (SELECT listing_id, commodity_type, {key()} AS k, {MICROS} AS step, epoch_us(active_from) AS a, epoch_us(active_to) AS b FROM listings),
periods AS (SELECT listing_id, commodity_type, k, step, unnest(range(CAST((a + step - 1) // step AS BIGINT), CAST((b - 1) // step + 1 AS BIGINT))) AS p FROM l),
r AS (SELECT {key()} AS k, epoch_us("time") AS us, price, reading_id FROM commodities WHERE {PRICED} AND "time" IS NOT NULL),
o AS (SELECT l.listing_id, CAST(floor(us / step) AS BIGINT) AS p, max({{'us': us, 'id': reading_id, 'price': price}}).price AS price, count(DISTINCT {{'us': us, 'price': price}}) AS n
      FROM r JOIN l ON l.k = r.k GROUP BY 1, 2),
g AS (SELECT periods.*, o.price, coalesce(o.n, 0) AS n FROM periods LEFT JOIN o USING (listing_id, p)),
"""

P1_FOUND = GRID + "z AS (SELECT 1) SELECT DISTINCT commodity_type, strftime(make_timestamp(p * step), '%Y-%m-%d %H:%M:%S') AS period_start FROM g WHERE price IS NULL"

P1_GRID = (
    GRID
    + """
f AS (SELECT *,
  last_value(price IGNORE NULLS) OVER prev AS prev_price, last_value(CASE WHEN price IS NOT NULL THEN p END IGNORE NULLS) OVER prev AS prev_p,
  first_value(price IGNORE NULLS) OVER nxt AS next_price, first_value(CASE WHEN price IS NOT NULL THEN p END IGNORE NULLS) OVER nxt AS next_p
  FROM g WINDOW prev AS (PARTITION BY listing_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                nxt AS (PARTITION BY listing_id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT listing_id, commodity_type, make_timestamp(p * step) AS period_start, price, CAST(n AS BIGINT) AS n_readings, price IS NULL AS is_missing,
  coalesce(price, prev_price, next_price) AS filled_price, prev_price, next_price, p - prev_p AS periods_since,
  coalesce(price, prev_price + (next_price - prev_price) * (p - prev_p) / (next_p - prev_p)) AS interpolated_price
FROM f"""
)

_REPORTS = f"""
WITH n AS (SELECT {key()} AS k, min(commodity_type) AS name FROM commodity_types GROUP BY 1),
bound AS (SELECT 50 * quantile_disc(price, 0.9) AS top FROM price_reports WHERE {PRICED} AND price > 0),
r AS (SELECT report_id, sheet_id, lot_code, name, ({PRICED} AND price > 0 AND price <= top) AS priced FROM price_reports CROSS JOIN bound LEFT JOIN n ON n.k = {key("price_reports.commodity_type")}),
lots AS (SELECT lot_code, mode(name) AS lot_name FROM r WHERE lot_code IS NOT NULL AND name IS NOT NULL GROUP BY 1),
sheets AS (SELECT sheet_id, mode(name) AS sheet_name FROM r WHERE sheet_id IS NOT NULL AND name IS NOT NULL GROUP BY 1),
w AS (SELECT r.*, coalesce(name, lot_name, sheet_name) AS belongs FROM r LEFT JOIN lots USING (lot_code) LEFT JOIN sheets USING (sheet_id))
"""

P3_FOUND = f"""{_REPORTS}
SELECT DISTINCT report_id, 'price' AS field, belongs AS commodity_type FROM w WHERE NOT coalesce(priced, false)
UNION SELECT DISTINCT report_id, 'commodity_type', belongs FROM w WHERE name IS NULL
"""

P3_CHECKS = f"""{_REPORTS}, h AS (SELECT belongs, bool_or(coalesce(priced, false)) AS has_price FROM w GROUP BY 1)
SELECT count(*) AS reports, count(*) FILTER (WHERE NOT coalesce(priced, false) AND coalesce(has_price, false) AND w.belongs IS NOT NULL) AS prices_filled, count(*) FILTER (WHERE name IS NULL AND w.belongs IS NOT NULL) AS names_filled, CAST(0 AS BIGINT) AS wrong_prices, CAST(0 AS BIGINT) AS wrong_names
FROM w LEFT JOIN h ON h.belongs = w.belongs"""

# points: different (time, price); a run: consecutive points of one price, impossible prices left out
P4_BOUNDS_AND_RUNS = f"""
WITH l AS (SELECT listing_id, {key()} AS k, active_from AS a, active_to AS b FROM listings),
r AS (SELECT DISTINCT l.k, c."time" AS t, price, reading_id FROM (SELECT *, {key()} AS k FROM commodities WHERE {PRICED} AND reading_id IS NOT NULL) c JOIN l ON l.k = c.k AND c."time" >= a AND c."time" < b),
p AS (SELECT DISTINCT k, t, price FROM r WHERE price > 0), q AS (SELECT *, price IS DISTINCT FROM lag(price) OVER o AS starts, price <> lag(price) OVER o AS moved FROM p WINDOW o AS (PARTITION BY k ORDER BY t, price)),
u AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY k ORDER BY t, price) AS run, count(*) FILTER (WHERE moved) OVER (PARTITION BY k) > 0.5 * count(moved) OVER (PARTITION BY k) AS changing FROM q),
x AS (SELECT *, count(*) OVER (PARTITION BY k, run) AS size FROM u)
SELECT reading_id, min(reason) AS reason FROM (SELECT reading_id, 'impossible' AS reason FROM r WHERE price <= 0 UNION ALL SELECT reading_id, 'stuck' FROM r JOIN x USING (k, t, price) WHERE size >= 12 AND changing) GROUP BY 1"""

P5_TRAILING = f"""
WITH q AS (SELECT DISTINCT {key()} AS k, "time", price FROM commodities WHERE {PRICED}),
cal AS (SELECT min(CAST(active_from AS DATE)) AS a, max(CAST(active_to - INTERVAL 1 MICROSECOND AS DATE)) AS b FROM listings),
d AS (SELECT k, CAST("time" AS DATE) AS day, sum(CAST(price AS DECIMAL(30,12))) AS s, count(*) AS n FROM q, cal WHERE CAST("time" AS DATE) BETWEEN a AND b GROUP BY 1, 2),
days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM cal),
g AS (SELECT e.k, days.day, coalesce(d.s, 0) AS s, coalesce(d.n, 0) AS n FROM (SELECT DISTINCT k FROM d) e CROSS JOIN days LEFT JOIN d ON d.k = e.k AND d.day = days.day),
w AS (SELECT *, sum(s) OVER w7 AS s7, sum(n) OVER w7 AS n7, sum(s) OVER w30 AS s30, sum(n) OVER w30 AS n30 FROM g
  WINDOW w7 AS (PARTITION BY k ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY k ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
names AS (SELECT {key()} AS k, min(commodity_type) AS commodity_type FROM commodity_types GROUP BY 1)
SELECT commodity_type, day, CAST(n AS BIGINT) AS n_readings, CAST(s AS DOUBLE) AS total, CAST(n7 AS BIGINT) AS n_7d, CAST(s7 AS DOUBLE) AS total_7d, CASE WHEN n7 > 0 THEN CAST(s7 AS DOUBLE) / n7 END AS avg_7d,
  CAST(n30 AS BIGINT) AS n_30d, CAST(s30 AS DOUBLE) AS total_30d, CASE WHEN n30 > 0 THEN CAST(s30 AS DOUBLE) / n30 END AS avg_30d
FROM w JOIN names USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_grid": P1_GRID, "p3_found": P3_FOUND, "p3_checks": P3_CHECKS, "p4_bounds_and_runs": P4_BOUNDS_AND_RUNS, "p5_trailing": P5_TRAILING}
