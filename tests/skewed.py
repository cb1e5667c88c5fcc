"""Copies of the star tables in which one manager, quarter, filing and security own a third of all rows."""

from pathlib import Path

import duckdb


def write_skewed(sf_dir: str, out: str) -> str:
    Path(out).mkdir(parents=True, exist_ok=True)
    con = duckdb.connect()
    # one customer (manager 1) with a third of the orders, all in one quarter, on few days
    con.execute(f"""COPY (SELECT * REPLACE (
        CASE WHEN o_orderkey % 3 = 0 THEN 25 ELSE o_custkey END AS o_custkey,
        CASE WHEN o_orderkey % 3 = 0 THEN CAST(DATE '1997-05-01' + CAST(o_orderkey % 4 AS INTEGER) AS {_type(con, sf_dir)})
          ELSE o_orderdate END AS o_orderdate)
        FROM '{sf_dir}/orders.parquet') TO '{out}/orders.parquet'""")
    # one filing with a third of the lines
    con.execute(f"""COPY (SELECT * REPLACE (
        CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN (SELECT MIN(o_orderkey) FROM '{out}/orders.parquet'
            WHERE o_orderkey % 120 = 45) ELSE l_orderkey END AS l_orderkey)
        FROM '{sf_dir}/lineitem.parquet') TO '{out}/lineitem.parquet'""")
    # one security with a third of the parts
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN p_partkey % 3 = 0 THEN 'Brand#1' ELSE p_brand END AS p_brand)
        FROM '{sf_dir}/part.parquet') TO '{out}/part.parquet'""")
    for name in ("customer", "nation"):
        con.execute(f"COPY (SELECT * FROM '{sf_dir}/{name}.parquet') TO '{out}/{name}.parquet'")
    return out


def _type(con, sf_dir: str) -> str:
    return con.execute(f"SELECT TYPEOF(o_orderdate) FROM '{sf_dir}/orders.parquet' LIMIT 1").fetchone()[0]
