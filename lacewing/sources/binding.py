"""The driver's tables seen as domain tables, and the same views as SQL.

Scores are whole hundredths, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RELATION = "case l_returnflag when 'A' then 'reduces' when 'R' then 'increases' else 'associated_with' end"
C, R, K = "cast(round(100 - l_discount * 300) as bigint)", "cast(round(l_quantity * 2) as bigint)", "cast(round(100 - l_tax * 500) as bigint)"
TRIPLES = f"triples as (select l_orderkey, l_linenumber, l_orderkey % 40 as article, l_suppkey as head, {RELATION} as relation, p_brand as tail, {C} as c, {R} as r, {K} as k from lineitem join part on l_partkey = p_partkey)"
# canonical edge (order) with entities (parts), roles and a chunk (supplier)
INCIDENCE = "incidence as (select distinct l_orderkey as edge, l_partkey as entity, l_suppkey as chunk from lineitem)"


def triples(t) -> DataFrame:
    return t.lineitem.join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "l_orderkey", "l_linenumber", "l_orderkey % 40 as article", "l_suppkey as head", f"{RELATION} as relation", "p_brand as tail", f"{C} as c", f"{R} as r", f"{K} as k"
    )


def incidence(t) -> DataFrame:
    return t.lineitem.selectExpr("l_orderkey as edge", "l_partkey as entity", "l_suppkey as chunk").distinct()
