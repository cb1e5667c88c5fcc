"""Filing tables derived from the star-schema test tables (FIXTURES.md section 2).

One portable SQL text per table.  Spark runs it over DataFrames, the DuckDB
oracle uses the same text as leading CTEs, so both start from equal inputs.
Only spellings that differ between the dialects go through ``Dialect``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

STAR_TABLES = ("orders", "lineitem", "part", "customer", "nation")


@dataclass(frozen=True)
class Dialect:
    text: str
    day: str  # date expression -> DD-Mon-YYYY

    def day_text(self, expression: str) -> str:
        return f"UPPER({self.day.replace('$', expression)})"


SPARK = Dialect("STRING", "DATE_FORMAT($, 'dd-MMM-yyyy')")
DUCKDB = Dialect("VARCHAR", "STRFTIME($, '%d-%b-%Y')")


def mapping_sql(d: Dialect) -> dict[str, str]:
    """Table name -> SELECT, in dependency order; {name} marks a table reference."""
    is_base = "(rn = 1 AND o_orderkey % 15 <> 3) OR o_orderkey % 40 = 17"
    quarter_end = "LAST_DAY(MAKE_DATE(CAST(FLOOR(qid / 100.0) AS INT), CAST(qid % 100 AS INT) * 3, 1))"
    acc = "CAST(accession_number AS BIGINT)"
    cents = "CAST(ROUND({0} * 100) AS INT)"
    return {
        "s_order": """
            SELECT o_orderkey, o_custkey, o_orderstatus,
              CAST(FLOOR(o_custkey / 20.0) AS BIGINT) AS mgr,
              CAST(o_orderdate + INTERVAL 26 YEAR AS DATE) AS fdate,
              CAST(CASE WHEN QUARTER(o_orderdate) = 1 THEN (YEAR(o_orderdate) + 25) * 100 + 4
                   ELSE (YEAR(o_orderdate) + 26) * 100 + QUARTER(o_orderdate) - 1 END AS INT) AS qid
            FROM {orders}""",
        "s_rank": """
            SELECT *, ROW_NUMBER() OVER (PARTITION BY mgr, qid ORDER BY fdate, o_orderkey) AS rn FROM {s_order}""",
        "submission": f"""
            SELECT CAST(o_orderkey AS {d.text}) AS accession_number, {d.day_text('fdate')} AS filing_date,
              CASE WHEN o_orderkey % 31 = 0 THEN '13F-NT' WHEN {is_base} THEN '13F-HR' ELSE '13F-HR/A' END
                AS submissiontype,
              CASE WHEN o_orderkey % 4 = 0 THEN LPAD(CAST(mgr AS {d.text}), 10, '0')
                   ELSE CAST(mgr AS {d.text}) END AS cik,
              {d.day_text(quarter_end)} AS periodofreport
            FROM {{s_rank}}""",
        "coverpage": f"""
            SELECT CAST(o_orderkey AS {d.text}) AS accession_number,
              {d.day_text(quarter_end)} AS reportcalendarorquarter,
              CASE WHEN {is_base} THEN CASE WHEN o_orderkey % 2 = 0 THEN 'N' END
                   WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Y' END AS isamendment,
              CASE WHEN {is_base} THEN NULL ELSE CAST(rn AS INT) END AS amendmentno,
              CASE WHEN {is_base} THEN NULL WHEN rn > 1 AND o_orderkey % 10 IN (0, 1) THEN 'RESTATEMENT'
                   WHEN o_orderkey % 40 = 7 THEN 'OTHER' ELSE 'NEW HOLDINGS' END AS amendmenttype,
              CASE WHEN mgr % 11 = 0 THEN '' ELSE CONCAT('MANAGER ', CAST(mgr AS {d.text})) END AS filingmanager_name,
              CONCAT(CAST(o_custkey AS {d.text}), ' MAIN ST') AS filingmanager_street1,
              CASE WHEN o_orderkey % 3 = 0 THEN CONCAT('FLOOR ', CAST(o_orderkey % 40 AS {d.text})) END
                AS filingmanager_street2,
              CONCAT('CITY ', CAST(mgr % 50 AS {d.text})) AS filingmanager_city,
              'NY' AS filingmanager_stateorcountry,
              LPAD(CAST(mgr % 99999 AS {d.text}), 5, '0') AS filingmanager_zipcode,
              CASE WHEN o_orderkey % 31 = 0 THEN '13F NOTICE' ELSE '13F HOLDINGS REPORT' END AS reporttype,
              CONCAT('028-', CAST(mgr AS {d.text})) AS form13ffilenumber,
              CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CONCAT('CRD', CAST(mgr AS {d.text})) END AS crdnumber,
              CASE WHEN o_orderkey % 5 = 0 THEN CONCAT('801-', CAST(mgr AS {d.text})) END AS secfilenumber,
              'N' AS provideinfoforinstruction5
            FROM {{s_rank}}""",
        "infotable": f"""
            SELECT CAST(l_orderkey AS {d.text}) AS accession_number, CAST(l_linenumber AS BIGINT) AS infotable_sk,
              CASE WHEN p_name LIKE 'blue%' AND p_brand NOT IN ('Brand#7', 'Brand#1', 'Brand#11')
                   THEN CONCAT('iShares ', p_name) ELSE p_name END AS nameofissuer,
              CASE WHEN p_brand = 'Brand#7' THEN 'UNIT' WHEN p_brand IN ('Brand#1', 'Brand#11') THEN 'COM'
                   WHEN p_brand = 'Brand#2' THEN 'ETF' WHEN p_type = 'STANDARD' THEN 'COM'
                   WHEN p_type = 'ECONOMY' THEN 'Sponsored  ADR' WHEN p_type = 'MEDIUM' THEN 'PFD SER A'
                   WHEN p_type = 'SMALL' THEN 'CONV NT' WHEN p_type = 'LARGE' THEN 'UNIT' ELSE 'FUND' END
                AS titleofclass,
              CONCAT('BRD', LPAD(REPLACE(p_brand, 'Brand#', ''), 6, '0')) AS cusip,
              CASE WHEN p_size % 3 = 0 THEN NULL
                   ELSE CONCAT('BBG', LPAD(CAST(p_size AS {d.text}), 9, '0')) END AS figi,
              CAST(FLOOR(l_extendedprice) AS BIGINT) AS value,
              CAST(CEIL(l_quantity / 10) AS BIGINT) * 100 AS sshprnamt,
              CASE WHEN {cents.format('l_discount')} = 10 THEN 'PRN' ELSE 'SH' END AS sshprnamttype,
              CASE WHEN {cents.format('l_tax')} = 8 THEN 'Call' WHEN {cents.format('l_tax')} = 7 THEN 'Put' END
                AS putcall,
              CASE l_returnflag WHEN 'R' THEN 'DFND' ELSE 'SOLE' END AS investmentdiscretion,
              CASE WHEN l_linenumber = 5 THEN '1' END AS othermanager,
              CAST(CEIL(l_quantity / 10) AS BIGINT) * 100 AS voting_auth_sole,
              CAST(0 AS BIGINT) AS voting_auth_shared, CAST(0 AS BIGINT) AS voting_auth_none
            FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey""",
        "summarypage": f"""
            SELECT accession_number, CAST(n AS INT) AS tableentrytotal,
              CASE WHEN {acc} % 50 = 0 THEN NULL WHEN {acc} % 50 = 1 THEN t + 1 WHEN {acc} % 50 = 2 THEN 0
                   WHEN {acc} % 50 = 3 THEN CAST(FLOOR(t / 1000.0) AS BIGINT) WHEN {acc} % 50 = 4 THEN t * 1000
                   WHEN {acc} % 50 = 5 THEN t + 777 ELSE t END AS tablevaluetotal,
              CASE WHEN {acc} % 37 = 0 THEN 'Y' ELSE 'N' END AS isconfidentialomitted
            FROM (SELECT accession_number, CAST(SUM(value) AS BIGINT) AS t, COUNT(*) AS n
                  FROM {{infotable}} GROUP BY accession_number) x""",
        "signature": f"""
            SELECT CAST(o_orderkey AS {d.text}) AS accession_number,
              CONCAT('SIGNER ', CAST(o_custkey AS {d.text})) AS name, 'CCO' AS title,
              CONCAT('CITY ', CAST(mgr % 50 AS {d.text})) AS city, 'NY' AS stateorcountry,
              {d.day_text('fdate')} AS signaturedate
            FROM {{s_rank}}""",
        "othermanager": f"""
            SELECT CAST(o_orderkey AS {d.text}) AS accession_number, CAST(1 AS BIGINT) AS othermanager_sk,
              CAST(CAST(FLOOR((o_custkey + 7) / 20.0) AS BIGINT) AS {d.text}) AS cik,
              CASE WHEN o_orderkey % 2 = 0 THEN CONCAT('028-OM', CAST(o_custkey AS {d.text})) END
                AS form13ffilenumber,
              CONCAT('OMCRD', CAST(o_custkey AS {d.text})) AS crdnumber,
              CONCAT('OM801-', CAST(o_custkey AS {d.text})) AS secfilenumber,
              CONCAT('OM ', CAST(o_custkey AS {d.text})) AS name
            FROM {{orders}} WHERE o_orderstatus = 'P'""",
        "othermanager2": f"""
            SELECT CAST(l_orderkey AS {d.text}) AS accession_number, CAST(1 AS INT) AS sequencenumber,
              CAST(l_suppkey AS {d.text}) AS cik, CONCAT('028-SUP', CAST(l_suppkey AS {d.text}))
                AS form13ffilenumber,
              CONCAT('OM2 ', CAST(l_suppkey AS {d.text})) AS name
            FROM {{lineitem}} WHERE l_linenumber = 1 AND l_returnflag = 'A'""",
        "sic": """
            SELECT mgr AS cik, sic, CASE WHEN sic IS NOT NULL THEN CONCAT('INDUSTRY ', sic) END AS sicdescription
            FROM (SELECT mgr, CASE WHEN mgr % 5 = 0 THEN NULL ELSE MIN(CASE c_mktsegment
                    WHEN 'FURNITURE' THEN '2511' WHEN 'MACHINERY' THEN '3531' WHEN 'BUILDING' THEN '1521'
                    WHEN 'AUTOMOBILE' THEN '3711' ELSE '5700' END) END AS sic
                  FROM (SELECT CAST(FLOOR(c_custkey / 20.0) AS BIGINT) AS mgr, c_mktsegment, c_custkey
                        FROM {customer}) c
                  WHERE c_custkey % 20 = mgr % 20 GROUP BY mgr) x""",
        "listings": f"""
            SELECT CAST(FLOOR(c_custkey / 20.0) AS BIGINT) AS cik, c_name AS name,
              CONCAT('T', CAST(c_custkey AS {d.text})) AS ticker,
              CASE WHEN c_nationkey % 13 = 0 THEN NULL ELSE n_name END AS exchange,
              CAST(c_custkey AS BIGINT) AS pos
            FROM {{customer}} JOIN {{nation}} ON n_nationkey = c_nationkey
            WHERE CAST(FLOOR(c_custkey / 20.0) AS BIGINT) % 7 <> 0""",
    }


def sample_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Lazily planned filing tables over ``<sf_dir>/*.parquet``."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in STAR_TABLES}
    for name, text in mapping_sql(SPARK).items():
        used = {k: v for k, v in frames.items() if "{" + k + "}" in text}
        frames[name] = spark.sql(text, **used)
    return {k: v for k, v in frames.items() if k not in STAR_TABLES and not k.startswith("s_")}


def summary_pages(spark: SparkSession, infotable: DataFrame) -> DataFrame:
    """Summary pages of given lines."""
    return spark.sql(mapping_sql(SPARK)["summarypage"], infotable=infotable)
