"""Queries on hierarchies and raw records, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asclera.operators import hierarchy as H
from asclera.sources.records import parse_triples


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hierarchy(spark: SparkSession, sf_dir: str, paths: bool = True) -> DataFrame:
    return H.hierarchy(H.hierarchical_links(table(spark, sf_dir, "umls_triples"), table(spark, sf_dir, "relation_types")), paths=paths)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hierarchy(spark, sf_dir, paths=False).select("node", "root_node", "depth")


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hierarchy(spark, sf_dir).select("node", "parent", "root_node", "depth", F.concat_ws(" > ", "path").alias("path"), (F.col("state") != H.TREE).alias("in_cycle"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.descendants(_hierarchy(spark, sf_dir))


def p5_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.cycles(_hierarchy(spark, sf_dir, paths=False))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_triples(table(spark, sf_dir, "umls_triples_raw"), table(spark, sf_dir, "relation_types"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).where("reason is not null").select(F.col("line_id").cast("long").alias("line_id"), "reason").distinct()


def p6_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir).where("reason is null")
    return r.select("line_id", "triple_id", "head", "relation", "tail", "confidence", F.col("asserted_on").cast("string").alias("asserted_on"))


_LINKS = r"""
WITH RECURSIVE t AS (
  SELECT lower(regexp_replace(head, '^\s+|\s+$', '', 'g')) AS head, lower(regexp_replace(relation, '^\s+|\s+$', '', 'g')) AS relation,
         lower(regexp_replace(tail, '^\s+|\s+$', '', 'g')) AS tail FROM umls_triples),
links AS (
  SELECT DISTINCT CASE WHEN parent_side = 'tail' THEN head ELSE tail END AS child, CASE WHEN parent_side = 'tail' THEN tail ELSE head END AS parent
  FROM t JOIN relation_types r USING (relation) WHERE hierarchical AND head <> '' AND tail <> ''),
nodes AS (SELECT child AS node FROM links UNION SELECT parent FROM links),
tree AS (
  SELECT node, CAST(NULL AS VARCHAR) AS parent, node AS root_node, CAST(0 AS BIGINT) AS depth, [node] AS path
  FROM nodes WHERE node NOT IN (SELECT child FROM links)
  UNION ALL
  SELECT l.child, l.parent, root_node, depth + 1, list_append(path, l.child) FROM tree JOIN links l ON l.parent = tree.node),
loops AS (SELECT node, parent FROM nodes JOIN links ON child = node WHERE node NOT IN (SELECT node FROM tree)),
up AS (SELECT node, parent AS above FROM loops UNION SELECT up.node, l.parent FROM up JOIN loops l ON l.node = up.above),
least AS (SELECT node, min(above) AS least FROM up WHERE node IN (SELECT above FROM up u WHERE u.node = up.node) GROUP BY node)
"""

_RAW = r"""
WITH raw AS (
  SELECT line_id, regexp_replace(coalesce(raw_line, ''), '\r$', '') AS r FROM umls_triples_raw),
f AS (
  SELECT line_id, r,
    regexp_full_match(r, '(?s)([ \t]*("([^"]|"")*")[ \t]*|[^",]*)(,([ \t]*("([^"]|"")*")[ \t]*|[^",]*))*') AS quoted_well,
    string_split(regexp_replace(regexp_replace(r, '"([^"]|"")*"', 'q', 'g'), '[^,]', '', 'g'), ',') AS commas,
    regexp_extract_all(',' || r, '(?s),([ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*)', 1) AS v
  FROM raw),
w AS (
  SELECT line_id, quoted_well, len(commas) AS n, list_transform(v, lambda x: trim(CASE WHEN trim(x, ' ' || chr(9)) LIKE '"%'
    THEN replace(substr(trim(x, ' ' || chr(9)), 2, len(trim(x, ' ' || chr(9))) - 2), '""', '"') ELSE x END, ' ' || chr(9))) AS v FROM f),
judged AS (
  SELECT line_id, v, CASE WHEN NOT quoted_well THEN 'quoting' WHEN n <> 6 THEN 'column_count'
    WHEN NOT regexp_full_match(v[1], '[0-9]+') OR TRY_CAST(v[1] AS BIGINT) IS NULL OR trim(v[2]) = '' OR trim(v[4]) = ''
      OR (trim(v[3]) <> '' AND lower(trim(v[3])) NOT IN (SELECT lower(relation) FROM relation_types))
      OR NOT regexp_full_match(v[5], '[0-9]+(\.[0-9]+)?|\.[0-9]+') OR NOT coalesce(TRY_CAST(v[5] AS DOUBLE) BETWEEN 0 AND 1, false)
      OR NOT regexp_full_match(v[6], '[0-9]{4}-[0-9]{2}-[0-9]{2}') OR TRY_CAST(v[6] AS DATE) IS NULL THEN 'invalid_value' END AS reason
  FROM w)
"""


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[:2] in ("p5", "p6")}


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _LINKS + "SELECT node, root_node, depth FROM tree UNION ALL SELECT node, '', CAST(-1 AS BIGINT) FROM loops",
        "p5_paths": _LINKS + "SELECT node, parent, root_node, depth, array_to_string(path, ' > ') AS path, false AS in_cycle FROM tree UNION ALL SELECT node, parent, '', CAST(-1 AS BIGINT), '', true FROM loops",
        "p5_descendants": _LINKS + "SELECT a.node, d.node AS descendant, d.depth - a.depth AS distance FROM tree d, unnest(d.path) AS u(above) JOIN tree a ON a.node = u.above WHERE a.node <> d.node",
        "p5_cycles": _LINKS + "SELECT node, parent, parent = least AS back_edge FROM loops JOIN least USING (node)",
        "p6_found": _RAW + "SELECT DISTINCT line_id, reason FROM judged WHERE reason IS NOT NULL",
        "p6_rows": _RAW + "SELECT line_id, CAST(v[1] AS BIGINT) AS triple_id, v[2] AS head, nullif(v[3], '') AS relation, v[4] AS tail, CAST(v[5] AS DOUBLE) AS confidence, v[6] AS asserted_on FROM judged WHERE reason IS NULL",
    }
