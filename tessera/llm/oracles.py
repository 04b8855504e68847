"""DuckDB SQL for the queries that SQL can express."""

OP10 = r"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(cast(doc_id AS varchar), '')) AS o,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size
  FROM documents
), sizes AS (
  SELECT source, sum(size)::bigint AS source_size FROM docs GROUP BY source
), ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes
), weighed AS (
  SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM ranked
), running AS (
  SELECT *, cap::double / weight AS ratio,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::double / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::double
         / (sum(weight) OVER (ORDER BY cap::double / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::double AS level
  FROM weighed
), levels AS (
  SELECT level FROM running WHERE level * weight <= cap ORDER BY ratio, rank LIMIT 1
), targets AS (
  SELECT source, source_size, weight, least(cap::double, coalesce((SELECT level FROM levels) * weight, cap::double)) AS target FROM running
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.weight, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, (least(greatest(floor(target)::bigint - start, 0), size) + least(greatest(floor(target)::bigint - start - source_size, 0), size)
            + least(greatest(floor(target)::bigint - start - 2 * source_size, 0), size))::bigint AS taken
  FROM placed
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE weight
         WHEN 1 THEN least(greatest(0.0 + (sqrt(greatest(2.25 + -2.0 * (start / target * 1.0 - 0.0), 0.0)) - 1.5) / -1.0, 0.0), 1.0)
         WHEN 2 THEN least(greatest(0.0 + (start / target * 1.0 - 0.0) / 1.0, 0.0), 1.0)
         ELSE least(greatest(0.0 + (sqrt(greatest(0.25 + 2.0 * (start / target * 1.0 - 0.0), 0.0)) - 0.5) / 1.0, 0.0), 1.0) END END AS first_position
FROM taken
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_mixing": OP10}
