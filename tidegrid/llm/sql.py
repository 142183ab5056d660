"""DuckDB statements of the llm queries. Tokenising, tiling and the prose rules can't be put in SQL; their queries are
tested against brute force on fixtures, and what must hold of a packing is put as a query of its own (p6_checks).

Percentiles here are exact: as long as a level's share of eps (a quarter of 0.001) times a series' quotes is below two
ranks, that is, up to 7999 quotes, the operator loses none either. Those of longer series differ by ranks within the bound."""

from __future__ import annotations

from tidegrid.plans.data_sql import PRICED, key

_PS = "(0.01), (0.05), (0.25), (0.5), (0.75), (0.95), (0.99)"


def _percentiles(by: str) -> str:
    """Value of rank ceil(p n) among the distinct quotes, per `by`."""
    return f"""
WITH q AS (SELECT DISTINCT {key()} AS k, "time", price FROM commodities WHERE {PRICED} AND "time" IS NOT NULL),
names AS (SELECT {key()} AS k, min(commodity_type) AS commodity_type FROM commodity_types GROUP BY 1),
r AS (SELECT commodity_type, CAST("time" AS DATE) AS day, price FROM q JOIN names USING (k)),
o AS (SELECT {by}, price, row_number() OVER (PARTITION BY {by} ORDER BY price) AS rank, count(*) OVER (PARTITION BY {by}) AS n FROM r),
p AS (SELECT CAST(p AS DOUBLE) AS p FROM (VALUES {_PS}) t(p))
SELECT {by}, n, p, price AS value, CAST(0 AS BIGINT) AS rank_error FROM o JOIN p ON rank = greatest(1, ceil(p * n - 1e-9))"""


P6_CHECKS = """SELECT CAST(profile_id AS INT) AS profile_id, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, CAST(0 AS BIGINT) AS wrong_documents, CAST(0 AS BIGINT) AS wrong_containers
FROM pack_profiles WHERE capacity_tokens >= 1"""


def oracle_sql() -> dict[str, str]:
    whole = _percentiles("commodity_type")
    return {"p2_percentiles": whole, "p2_from_days": whole, "p2_daily_percentiles": _percentiles("commodity_type, day"), "p6_checks": P6_CHECKS}
