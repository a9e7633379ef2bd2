"""What the registered queries share: a registry, rounding, and the SQL of the bound tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that gives the same rows."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def r6(c: Column | str) -> Column:
    """Rounded to six places, and never a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + 0.0


def q6(c: str) -> str:
    return f"round(CAST({c} AS DOUBLE), 6) + 0.0"


#: Binding of customers by brands.
A = """x AS (SELECT o_custkey AS cell_id, CAST(substr(p_brand, 7) AS INT) AS gene_id, sum(l_quantity) AS value
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
var AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS gene_id, p_brand AS gene_name FROM part),
obs AS (SELECT c_custkey AS cell_id, c_name AS cell_name, c_mktsegment AS segment, c_acctbal AS acctbal, n_name AS nation, r_name AS region
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey IN (SELECT o_custkey FROM orders))"""
#: The same with genes named type_brand.
T = """kinds(p_kind, k) AS (VALUES ('ECONOMY', 1), ('LARGE', 2), ('MEDIUM', 3), ('PROMO', 4), ('SMALL', 5), ('STANDARD', 6)),
parts AS (SELECT p_partkey, k * 100 + CAST(substr(p_brand, 7) AS INT) AS gene_id, p_type || '_' || p_brand AS gene_name FROM part JOIN kinds ON p_type = p_kind),
x AS (SELECT o_custkey AS cell_id, gene_id, sum(l_quantity) AS value
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN parts ON l_partkey = p_partkey GROUP BY 1, 2),
var AS (SELECT DISTINCT gene_id, gene_name FROM parts),
obs AS (SELECT c_custkey AS cell_id, c_mktsegment AS segment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))"""
#: Embedding vectors; the first two elements are coordinates.
B = """e AS (SELECT vec_id AS cell_id, list_transform(embedding, lambda a: CAST(a AS DOUBLE)) AS v, CAST(label AS VARCHAR) AS label, 's' || (label % 3) AS section FROM embeddings),
pts AS (SELECT cell_id, v[1] AS x, v[2] AS y, section FROM e),
x AS (SELECT cell_id, CAST(i - 1 AS INT) AS gene_id, v[i] AS value FROM (SELECT cell_id, v, unnest(range(1, 65)) AS i FROM e))"""
NORM = """tot AS (SELECT cell_id, sum(value) AS t FROM x GROUP BY 1), goal AS (SELECT median(t) AS g FROM tot WHERE t > 0),
nx AS (SELECT cell_id, gene_id, value / t * g AS value FROM x JOIN tot USING (cell_id), goal),
lx AS (SELECT cell_id, gene_id, ln(1 + value) AS value FROM nx)"""
