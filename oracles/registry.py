"""DuckDB statement per query name."""

from __future__ import annotations

import re

from holdfast.plans.catalog import CUT, FROM_QUARTER, TO_QUARTER
from holdfast.schemas import RAW_SCHEMAS
from holdfast.sources.sample import DUCKDB, mapping_sql
from oracles.base import INSTRUMENT, KEY, NAME, QUALITY, SUMS, big, cik, div, label, prev, significant, statement

RAW = ("submission", "coverpage", "othermanager", "signature", "summarypage", "othermanager2", "infotable")
ORACLES: dict[str, str] = {}


def add(name: str, query: str, *doubles: str) -> None:
    ORACLES[name] = statement(significant(query, *doubles) if doubles else query)


def text(c: str) -> str:
    return f"CAST({c} AS VARCHAR) AS {c}"


QEND = "LAST_DAY(MAKE_DATE({0} // 100, ({0} % 100) * 3, 1))"
FILE = "quarter_id // 100 || 'q' || quarter_id % 100 || '_form13f.zip'"

# ---- sources, sinks, lineage
add("scan_tsv", "SELECT * FROM r_infotable")
add("blank_to_null", """
    SELECT accession_number, NULLIF(filingmanager_name, '') AS filingmanager_name,
      NULLIF(filingmanager_street2, '') AS filingmanager_street2, NULLIF(crdnumber, '') AS crdnumber,
      NULLIF(secfilenumber, '') AS secfilenumber FROM r_coverpage""")
add("append_batch", f"""
    SELECT {big("CASE submissiontype WHEN '13F-HR' THEN 1 ELSE 2 END")} AS etl_batch_id, COUNT(*) AS row_count,
      COUNT(DISTINCT accession_number) AS filing_count FROM r_submission GROUP BY 1""")
add("listings_scan", f"""
    SELECT {cik('cik')} AS cik, name, ticker, exchange,
      ROW_NUMBER() OVER (PARTITION BY cik ORDER BY pos) - 1 AS pos FROM r_listings""")
add("sic_scan", f"SELECT {cik('cik')} AS cik, sic, sicdescription, '2024-01-31' AS as_of_date FROM r_sic")
add("sic_extract", f"""
    SELECT {cik('k.cik')} AS cik, s.sic, s.sicdescription
    FROM (SELECT DISTINCT cik FROM r_listings) k LEFT JOIN r_sic s USING (cik)""")


def row_text(table: str) -> str:
    """Every documented column behind its length; columns that the sample has not are NULL."""
    made = set(re.findall(r"AS\s+(\w+)", mapping_sql(DUCKDB)[table])) | {"accession_number"}
    values = {c: f"CAST(x.{c} AS VARCHAR)" for c in RAW_SCHEMAS[table].names if c in made}
    return " || ".join(f"COALESCE(LENGTH({values[c]}) || ':' || {values[c]}, '~')" if c in values else "'~'" for c in RAW_SCHEMAS[table].names)


def hashes() -> str:
    """SHA-256 of the content of each quarter."""
    digests = " UNION ALL ".join(
        f"SELECT quarter_id, '{t}' AS table_name, MD5({row_text(t)}) AS h FROM r_{t} x JOIN d_filings USING (accession_number)" for t in RAW
    )
    return f"""SELECT quarter_id, SHA256(STRING_AGG(table_name || ':' || n || ':' || a || ':' || b, ';' ORDER BY table_name)) AS sha256 FROM (
        SELECT quarter_id, table_name, COUNT(*) AS n, SUM(CAST('0x' || SUBSTR(h, 1, 15) AS BIGINT)) AS a,
          SUM(CAST('0x' || SUBSTR(h, 16, 15) AS BIGINT)) AS b FROM ({digests}) y GROUP BY ALL) z GROUP BY 1"""


add("batch_manifest", f"""
    SELECT {big('quarter_id')} AS etl_batch_id, {FILE} AS file_name, sha256,
      COUNT(*) AS filing_count, {label('quarter_id')} AS dataset_quarter FROM d_filings JOIN ({hashes()}) s USING (quarter_id) GROUP BY ALL""")


def counts(where: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT {big('f.quarter_id')} AS etl_batch_id, '{t}' AS table_name, COUNT(*) AS row_count
            FROM r_{t} x JOIN d_filings f USING (accession_number) {where} GROUP BY 1""" for t in RAW)


add("source_counts", counts())
TWICE = "(quarter_id % 10 = 2 AND quarter_id // 100 % 2 = 1 AND CAST(accession_number AS BIGINT) % 40 = 17)"
add("dup_accessions", f"""
    SELECT accession_number, {big('2')} AS row_count FROM d_filings WHERE {TWICE}""")
add("stored_counts", " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM r_{t}
        WHERE accession_number IN (SELECT accession_number FROM d_filings WHERE is_amendment = 1)""" for t in RAW))
add("count_mismatch", f"""
    SELECT * FROM (SELECT etl_batch_id, table_name, a.row_count AS source_row_count,
        COALESCE(b.row_count, 0) AS stored_row_count
      FROM ({counts()}) a LEFT JOIN ({counts("WHERE f.submission_type <> '13F-NT'")}) b
        USING (etl_batch_id, table_name)) x WHERE source_row_count <> stored_row_count""")
add("batch_admission", f"""
    SELECT {big('quarter_id')} AS etl_batch_id, sha256, COUNT(*) AS source_count,
      COUNT(*) FILTER (quarter_id % 10 IN (1, 3) OR (quarter_id % 10 = 4 AND is_amendment = 0)) AS stored_count,
      CASE WHEN quarter_id % 10 = 1 THEN 'SKIP' WHEN BOOL_OR({TWICE}) THEN 'REJECT' WHEN quarter_id % 10 = 2 THEN 'APPEND'
        WHEN quarter_id % 10 = 3 THEN CASE WHEN quarter_id // 100 % 2 = 0 THEN 'REJECT' ELSE 'REGISTER_EXISTING' END
        ELSE CASE SUM(is_amendment) WHEN 0 THEN 'REGISTER_EXISTING' WHEN COUNT(*) THEN 'APPEND' ELSE 'REJECT' END
      END AS decision
    FROM d_filings JOIN ({hashes()}) s USING (quarter_id) GROUP BY quarter_id, sha256""")


def delivered_rows() -> str:
    """Rows per delivered data set, run and table, with the decision that is due."""
    sets = f"""SELECT 1 AS run, {FILE} AS dataset, accession_number, 1 AS times, 'APPEND' AS decision FROM d_filings WHERE quarter_id < {CUT}
        UNION ALL SELECT 2, {FILE}, accession_number, 1, CASE WHEN quarter_id < {CUT} THEN 'SKIP' ELSE 'APPEND' END FROM d_filings
        UNION ALL SELECT 2, 'a_registered', accession_number, 1, 'REGISTER_EXISTING' FROM d_filings WHERE quarter_id = {FROM_QUARTER} AND is_amendment = 1
        UNION ALL SELECT 2, 'b_overlap', accession_number, 2, 'REJECT' FROM d_filings WHERE quarter_id = {TO_QUARTER} AND is_amendment = 1
        UNION ALL SELECT 2, 'c_twice', accession_number, 1, 'REJECT' FROM d_filings WHERE quarter_id = {TO_QUARTER} AND is_amendment = 1
        UNION ALL SELECT 2, 'd_again', accession_number, 1, 'SKIP' FROM d_filings WHERE quarter_id = {TO_QUARTER}"""
    every = ", ".join(f"('{t}')" for t in RAW)
    rows = " UNION ALL ".join(
        f"SELECT run, dataset, '{t}' AS table_name, SUM(times * CASE WHEN dataset = 'c_twice' AND '{t}' = 'submission' THEN 2 ELSE 1 END) AS n FROM s JOIN r_{t} USING (accession_number) GROUP BY 1, 2" for t in RAW
    )
    return f"""WITH s AS MATERIALIZED ({sets}), n AS ({rows})
        SELECT run, dataset, decision, CASE decision WHEN 'REJECT' THEN 'FAILED' ELSE 'COMPLETED' END AS status, table_name,
          {big('COALESCE(n, 0)')} AS source_row_count, CASE WHEN decision <> 'REJECT' THEN {big('COALESCE(n, 0)')} END AS stored_row_count
        FROM (SELECT DISTINCT run, dataset, decision FROM s) d CROSS JOIN (VALUES {every}) t(table_name) LEFT JOIN n USING (run, dataset, table_name)"""


add("load_datasets", f"SELECT * FROM ({delivered_rows()}) q")
add("loaded_tables", " UNION ALL ".join(
    f"""SELECT {FILE} AS dataset, '{t}' AS table_name, COUNT(*) AS row_count FROM r_{t} JOIN d_filings USING (accession_number)
        GROUP BY ALL""" for t in RAW))
add("batch_lineage", f"""
    SELECT {big('quarter_id')} AS etl_batch_id, accession_number FROM d_filings WHERE quarter_id >= {CUT}""")
add("pending_batches", f"""
    SELECT DISTINCT {big('quarter_id')} AS etl_batch_id, {FILE} AS file_name FROM d_filings
    WHERE quarter_id >= {CUT}""")
add("rebuild_quarter", "SELECT * FROM d_mact")

COUNTED = {
    "manager_dim": "d_mgr", "listing_dim": "d_listing", "variants": "d_variants", "current_variant": "d_current",
    "filings": "d_filings", "components": "d_components", "canonical": "d_canonical", "reconciliation": "d_recon",
    "classification": "d_class", "positions": "d_pos",
    "instruments": f"(SELECT DISTINCT {INSTRUMENT} FROM d_pos)", "relationships": f"(SELECT DISTINCT {KEY} FROM d_pos)",
    "manager_summary": "d_msum", "security_summary": "d_ssum", "changes": "d_chg", "manager_activity": "d_mact",
    "manager_action_activity": "d_maa", "security_action_activity": "d_saa", "security_activity": "d_sact",
    "calendar": "d_calendar",
    "ciks_with_tickers": "(SELECT * FROM d_mgr WHERE ticker IS NOT NULL)",
    "ciks_with_sic": "(SELECT DISTINCT cik FROM d_listing WHERE sic IS NOT NULL)",
    "review_required": "(SELECT * FROM d_canonical WHERE resolution_status = 'REVIEW_REQUIRED')",
    "incomplete_history": "(SELECT * FROM d_canonical WHERE resolution_status = 'INCOMPLETE_HISTORY')",
    "effective_components": "(SELECT * FROM d_components WHERE is_effective = 1)",
    "value_reconciliation_issues":
        "(SELECT * FROM d_recon WHERE reconciliation_status NOT IN ('MATCH', 'ROUNDING_DIFFERENCE'))",
    "unknown_cusips": "(SELECT * FROM d_class WHERE security_type_id = 99)",
}
add("stage_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS row_count FROM {t} x" for n, t in COUNTED.items()))

# ---- table maintenance
add("insert_new_keys", f"""
    SELECT cik, CASE WHEN BOOL_OR(relationship_type = 'FILING_MANAGER') THEN 'FILER' ELSE 'INCLUDED' END AS origin
    FROM d_roles WHERE relationship_type <> 'OTHER_MANAGER' GROUP BY cik""")
add("upsert_dim", f"""
    SELECT cusip, reportcalendarorquarter, nameofissuer, titleofclass, COALESCE(figi, '') AS figi,
      CASE WHEN YEAR(d) * 100 + QUARTER(d) >= {FROM_QUARTER} THEN occurrence_count ELSE 0 END AS occurrence_count
    FROM (SELECT *, STRPTIME(reportcalendarorquarter, '%d-%b-%Y') AS d FROM d_variants) v""")
add("prune_absent", f"""
    SELECT {KEY}, MIN(quarter_id) AS first_observed_quarter_id, MAX(quarter_id) AS latest_observed_quarter_id,
      1 AS is_active FROM d_pos GROUP BY ALL HAVING MAX(quarter_id) >= {CUT}""")
METHOD = """
    SELECT cusip, security_type_id, option_type, amount_type,
      CASE WHEN COUNT(putcall) > 0 THEN 'PUTCALL' WHEN amount_type = 'PRN' THEN 'AMOUNT_TYPE'
        ELSE ANY_VALUE(classification_method) END AS classification_method, {0} AS is_active
    FROM d_typed GROUP BY cusip, security_type_id, option_type, amount_type"""
add("soft_deactivate", METHOD.format(f"MAX(CASE quarter_id WHEN {TO_QUARTER} THEN 1 ELSE 0 END)"))
add("sic_refresh", """
    SELECT * REPLACE (CASE WHEN sic IS NOT NULL THEN '2024-01-31' END AS sic_as_of_date,
      CASE WHEN sic IS NOT NULL THEN sic_source END AS sic_source,
      CASE WHEN sic IS NOT NULL THEN sic_description END AS sic_description) FROM d_listing""")
add("stable_ids", f"""
    SELECT cusip, nameofissuer, titleofclass, figi, ROW_NUMBER() OVER (
      ORDER BY CASE WHEN early THEN 0 ELSE 1 END, cusip, nameofissuer, titleofclass, figi NULLS FIRST) AS variant_id
    FROM (SELECT cusip, nameofissuer, titleofclass, figi, MIN(YEAR(d) * 100 + QUARTER(d)) < {CUT} AS early
      FROM (SELECT *, STRPTIME(reportcalendarorquarter, '%d-%b-%Y') AS d FROM d_variants) v GROUP BY 1, 2, 3, 4) k""")
add("surrogate_keys", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS key_count, COUNT(*) AS id_count FROM {COUNTED[n]} x"
    for n in ("instruments", "relationships", "manager_dim", "classification")))
add("evolve_schema", "SELECT cik, ticker, exchange, sic, sic_major_group_division FROM d_listing")

# ---- projections and filters
add("normalize_cik", f"SELECT accession_number, {cik('cik')} AS manager_cik FROM r_submission")
add("parse_dates", f"SELECT accession_number, {text('filing_date')}, {text('period_of_report')} FROM d_filings")
FQ = "CAST(YEAR(filing_date) * 100 + QUARTER(filing_date) AS INTEGER)"
add("quarter_keys", f"""
    SELECT accession_number, quarter_id, {label('quarter_id')} AS quarter_label,
      CAST({QEND.format('quarter_id')} AS VARCHAR) AS quarter_end_date, CAST(quarter_id // 100 AS INTEGER) AS year,
      CAST(quarter_id % 100 AS INTEGER) AS quarter_number
    FROM (SELECT accession_number, {FQ} AS quarter_id FROM d_filings) f""")
add("filing_normalize", f"""
    SELECT * REPLACE (CAST(filing_date AS VARCHAR) AS filing_date, CAST(period_of_report AS VARCHAR) AS period_of_report,
      CAST(report_date AS VARCHAR) AS report_date) FROM d_filings""")
REVIEWED = """CASE WHEN has_information_table = 0 THEN 'EXCLUDE' WHEN amendment_type = 'OTHER' THEN 'BASE'
      ELSE component_type END"""
add("component_kind", f"""
    SELECT o.accession_number, o.manager_cik, o.quarter_id, o.kind AS component_type, o.component_sequence,
      CASE WHEN o.kind IN ('BASE', 'RESTATEMENT') AND o.component_sequence = l.final_reset THEN 1
        WHEN o.kind = 'ADDITION' AND o.component_sequence > COALESCE(l.final_reset, 0) THEN 1 ELSE 0 END AS is_effective,
      CASE WHEN o.kind IN ('BASE', 'RESTATEMENT', 'ADDITION') THEN (
        SELECT FIRST(n.accession_number ORDER BY n.component_sequence) FROM (SELECT *, {REVIEWED} AS kind FROM d_ordered) n
        WHERE n.manager_cik = o.manager_cik AND n.quarter_id = o.quarter_id
          AND n.component_sequence > o.component_sequence AND n.kind IN ('BASE', 'RESTATEMENT')) END
        AS superseded_by_accession_number
    FROM (SELECT *, {REVIEWED} AS kind FROM d_ordered) o
    LEFT JOIN (SELECT manager_cik, quarter_id, MAX(component_sequence) AS final_reset
      FROM d_ordered WHERE {REVIEWED} IN ('BASE', 'RESTATEMENT') GROUP BY ALL) l USING (manager_cik, quarter_id)""")
add("value_usd", """
    SELECT accession_number, infotable_sk, raw_reported_value, value_multiplier, value_usd FROM d_lines""")
add("instrument_attrs", """
    SELECT cusip, putcall, sshprnamttype, COUNT(*) AS line_count, COALESCE(UPPER(putcall), 'NONE') AS option_type,
      sshprnamttype AS amount_type, k.security_type_id AS base_type_id,
      CAST(CASE WHEN putcall = 'Call' THEN 5 WHEN putcall = 'Put' THEN 6 WHEN sshprnamttype = 'PRN' THEN 7
        ELSE k.security_type_id END AS INTEGER) AS security_type_id
    FROM r_infotable JOIN d_class k USING (cusip) GROUP BY ALL""")
RANK = f"""
    SELECT s.quarter_id, s.manager_cik AS cik, {NAME.format('s.manager_cik')} AS institution_name,
      {label('s.quarter_id')} AS quarter_label, s.portfolio_value_usd, s.cusip_count AS holding_count, s.top_10_weight,
      s.largest_position_weight, COALESCE(a.new_count, 0) AS new_count, COALESCE(a.added_count, 0) AS added_count,
      COALESCE(a.reduced_count, 0) AS reduced_count, COALESCE(a.exited_count, 0) AS exited_count,
      COALESCE(a.gross_buy_value_usd, 0) AS gross_buy_value_usd,
      COALESCE(a.gross_sell_value_usd, 0) AS gross_sell_value_usd,
      COALESCE(a.net_value_change_usd, 0) AS net_value_change_usd
    FROM d_msum s LEFT JOIN d_mgr m ON m.cik = s.manager_cik LEFT JOIN d_mact a USING (manager_cik, quarter_id)"""
WEIGHTS = ("top_10_weight", "largest_position_weight")
add("range_filters", f"""SELECT * FROM ({RANK}) r WHERE portfolio_value_usd BETWEEN 100000000 AND 2000000000
    AND holding_count >= 3 AND net_value_change_usd BETWEEN -2000000000 AND 3000000000 AND new_count >= 1
    AND COALESCE(top_10_weight, 0) BETWEEN 0.2 AND 0.995""", *WEIGHTS)
add("search_filter", f"""{RANK} WHERE LOWER(CONCAT_WS('|', s.manager_cik, m.manager_name, m.sec_company_name))
    LIKE '%manager 1%'""", *WEIGHTS)
for _page in ("page", "page_after"):
    add(_page, f"""SELECT * FROM ({RANK}) r WHERE quarter_id = (SELECT MAX(quarter_id) FROM d_msum)
    ORDER BY holding_count DESC, institution_name, cik LIMIT 10 OFFSET 10""", *WEIGHTS)
add("sic_division", """
    SELECT s.cik, s.sic, v.division FROM r_sic s LEFT JOIN c_division v
      ON CAST(LEFT(s.sic, 2) AS INTEGER) BETWEEN v.lo AND v.hi""")
add("prev_quarter", f"""
    SELECT manager_cik, quarter_id, {prev('quarter_id')} AS previous_quarter_id,
      CAST(CASE WHEN quarter_id % 100 < 4 THEN quarter_id + 1 ELSE quarter_id + 97 END AS INTEGER) AS next_quarter_id
    FROM d_msum""")

# ---- two quarters side by side
INST = ["portfolio_value_usd", "cusip_count", "instrument_count", "top_10_weight", "common_stock_value_usd",
        "etf_value_usd", "call_value_usd", "put_value_usd"]
INST_ALSO = ["new_count", "exited_count", "net_value_change_usd"]
SEC = ["institutional_value_usd", "institution_count", "common_stock_value_usd", "etf_value_usd", "call_value_usd",
       "put_value_usd", "concentration_hhi"]
SEC_ALSO = ["new_investor_count", "exited_investor_count", "net_value_change_usd"]
INST_ROWS = f"""SELECT s.*, {', '.join(f'COALESCE(a.{c}, 0) AS {c}' for c in INST_ALSO)}
    FROM d_msum s LEFT JOIN d_mact a USING (manager_cik, quarter_id)"""
SEC_ROWS = f"""SELECT s.* RENAME (total_value_usd AS institutional_value_usd, manager_count AS institution_count,
      manager_concentration_hhi AS concentration_hhi), {', '.join(f'COALESCE(a.{c}, 0) AS {c}' for c in SEC_ALSO)}
    FROM d_ssum s LEFT JOIN d_sact a USING (cusip, quarter_id)"""


def beside(rows: str, entity: str, measures: list[str], also: list[str], condition: str, deltas_only: bool = False) -> str:
    shown = "" if deltas_only else ", ".join(
        f"{a}.{c} AS {n}_{c}" for a, n in (("o", "prior"), ("n", "current")) for c in measures + also) + ", "
    delta = ", ".join(f"COALESCE(n.{c}, 0) - COALESCE(o.{c}, 0) AS delta_{c}" for c in measures)
    return f"""SELECT {entity}, o.quarter_id AS from_quarter_id, n.quarter_id AS to_quarter_id, {shown}{delta}
        FROM ({rows}) o JOIN ({rows}) n USING ({entity}) WHERE {condition}"""


ADJACENT = f"o.quarter_id = {prev('n.quarter_id')}"
add("compare_delta", beside(INST_ROWS, "manager_cik", INST, [],
    f"o.quarter_id = {FROM_QUARTER} AND n.quarter_id = {TO_QUARTER}", True), "delta_top_10_weight")
add("compare_institution", beside(INST_ROWS, "manager_cik", INST, INST_ALSO, ADJACENT),
    "prior_top_10_weight", "current_top_10_weight", "delta_top_10_weight")
add("compare_security", beside(SEC_ROWS, "cusip", SEC, SEC_ALSO, ADJACENT),
    "prior_concentration_hhi", "current_concentration_hhi", "delta_concentration_hhi")

# ---- joins
add("star_join", f"""
    SELECT {KEY}, quarter_id, {label('quarter_id')} AS quarter_label, t.security_type,
      v.current_nameofissuer AS issuer, value_usd
    FROM d_pos JOIN c_type t USING (security_type_id) JOIN d_current v USING (cusip)""")
add("left_default", """
    SELECT s.manager_cik, s.quarter_id, s.portfolio_value_usd, COALESCE(a.new_count, 0) AS new_count,
      COALESCE(a.exited_count, 0) AS exited_count, COALESCE(a.net_value_change_usd, 0) AS net_value_change_usd
    FROM d_msum s LEFT JOIN d_mact a ON a.manager_cik = s.manager_cik AND a.quarter_id = s.quarter_id""")
add("holding_variant", f"""
    SELECT i.accession_number, i.infotable_sk, i.cusip, {cik('s.cik')} AS filing_manager_cik,
      COALESCE(m.manager_name, c.filingmanager_name) AS filing_manager_name, s.filing_date, s.submissiontype,
      c.reporttype, i.nameofissuer, i.titleofclass, i.figi, i.value, v.occurrence_count AS variant_occurrence_count
    FROM r_infotable i JOIN r_submission s USING (accession_number) LEFT JOIN r_coverpage c USING (accession_number)
    LEFT JOIN d_variants v ON v.cusip = i.cusip AND v.reportcalendarorquarter = c.reportcalendarorquarter
      AND v.nameofissuer = i.nameofissuer AND v.titleofclass = i.titleofclass AND v.figi IS NOT DISTINCT FROM i.figi
    LEFT JOIN d_mgr m ON m.cik = {cik('s.cik')}""")
add("exited_rows", f"""
    SELECT {KEY}, to_quarter_id, prior_value_usd, action FROM d_chg WHERE current_value_usd IS NULL""")
add("manager_pairs", "SELECT * FROM d_pairs")
add("quarter_changes", "SELECT * FROM d_chg", "amount_change_percent")
add("refresh_quarters", "SELECT * FROM d_chg", "amount_change_percent")
add("period_changes", f"""
    SELECT {KEY}, CAST({FROM_QUARTER} AS INTEGER) AS from_quarter_id, CAST({TO_QUARTER} AS INTEGER) AS to_quarter_id,
      prior_value_usd, current_value_usd,
      COALESCE(current_value_usd, 0) - COALESCE(prior_value_usd, 0) AS value_change_usd, prior_reported_amount,
      current_reported_amount,
      COALESCE(current_reported_amount, 0) - COALESCE(prior_reported_amount, 0) AS amount_change,
      {div('COALESCE(current_reported_amount, 0) - prior_reported_amount', 'prior_reported_amount')}
        AS amount_change_percent,
      CASE WHEN hidden = 1 THEN 'UNKNOWN' WHEN prior_value_usd IS NULL THEN 'NEW'
        WHEN current_value_usd IS NULL THEN 'EXITED' WHEN current_reported_amount > prior_reported_amount THEN 'ADDED'
        WHEN current_reported_amount < prior_reported_amount THEN 'REDUCED' ELSE 'UNCHANGED' END AS action,
      1 - hidden AS is_comparable, CASE hidden WHEN 1 THEN 'CONFIDENTIAL_OMISSION' END AS noncomparable_reason,
      {QUALITY.format('worst')} AS value_quality_status
    FROM (SELECT {KEY}, MAX(CASE quarter_id WHEN {FROM_QUARTER} THEN value_usd END) AS prior_value_usd,
        MAX(CASE quarter_id WHEN {TO_QUARTER} THEN value_usd END) AS current_value_usd,
        MAX(CASE quarter_id WHEN {FROM_QUARTER} THEN reported_amount END) AS prior_reported_amount,
        MAX(CASE quarter_id WHEN {TO_QUARTER} THEN reported_amount END) AS current_reported_amount,
        MAX(quality_level) AS worst FROM d_pos WHERE quarter_id IN ({FROM_QUARTER}, {TO_QUARTER}) GROUP BY ALL) x
    JOIN (SELECT manager_cik, MAX(has_confidential_omission) AS hidden FROM d_msum
      WHERE quarter_id IN ({FROM_QUARTER}, {TO_QUARTER}) GROUP BY 1 HAVING COUNT(*) = 2) p USING (manager_cik)""",
    "amount_change_percent")
add("rule_match", """
    SELECT cusip, nameofissuer, titleofclass, rule_id, type_id AS security_type_id FROM d_ruled""")

# ---- aggregations and windows
add("variant_counts", "SELECT * FROM d_variants")
add("security_variants", "SELECT * FROM d_variants")
add("current_variant", "SELECT * FROM d_current")
POSITION = f"""
    SELECT {KEY}, quarter_id, value_usd, reported_amount, portfolio_weight, source_row_count,
      effective_accession_count, has_shared_discretion, has_confidential_omission, value_quality_status FROM d_pos"""
add("positions", POSITION, "portfolio_weight")
add("portfolio_weight", f"SELECT {KEY}, quarter_id, portfolio_weight FROM d_pos", "portfolio_weight")
add("type_breakdown", f"SELECT manager_cik, quarter_id, {SUMS} FROM d_pos GROUP BY ALL")
add("manager_activity", "SELECT * FROM d_mact")
add("manager_action_activity", "SELECT * FROM d_maa")
add("institution_activity", "SELECT * FROM d_maa")
add("cusip_activity", "SELECT * FROM d_sact")
add("cusip_action_activity", "SELECT * FROM d_saa")
add("security_activity_q", "SELECT * FROM d_saa")
add("hhi", """
    SELECT cusip, quarter_id, SUM(share * share) AS manager_concentration_hhi FROM d_hhi GROUP BY ALL""",
    "manager_concentration_hhi")
LARGEST = ", ".join(f"{c} AS largest_{c}" for c in INSTRUMENT.split(", "))
add("largest_position", f"""
    SELECT manager_cik, quarter_id, {LARGEST}, value_usd AS largest_position_value_usd,
      portfolio_weight AS largest_position_weight FROM d_ranked WHERE place = 1""", "largest_position_weight")
add("top10_weight", """
    SELECT manager_cik, quarter_id, SUM(portfolio_weight) AS top_10_weight FROM d_ranked WHERE place <= 10
    GROUP BY ALL""", "top_10_weight")
add("classify", "SELECT * FROM d_class", "classification_confidence")
add("classify_rules", "SELECT * FROM d_bookclass", "classification_confidence")
add("classify_override", """
    SELECT cusip, CASE cusip WHEN 'BRD000005' THEN 3 ELSE security_type_id END AS security_type_id,
      CASE cusip WHEN 'BRD000005' THEN 'CUSIP_OVERRIDE' ELSE classification_method END AS classification_method,
      CASE WHEN cusip <> 'BRD000005' THEN selected_rule_id END AS selected_rule_id, total_occurrence_count,
      CASE cusip WHEN 'BRD000005' THEN total_occurrence_count ELSE matched_occurrence_count END
        AS matched_occurrence_count,
      CASE cusip WHEN 'BRD000005' THEN total_occurrence_count ELSE winning_occurrence_count END
        AS winning_occurrence_count,
      CASE cusip WHEN 'BRD000005' THEN 1.0 ELSE classification_confidence END AS classification_confidence
    FROM d_class""", "classification_confidence")
add("relationship_span", f"""
    SELECT {KEY}, MIN(quarter_id) AS first_observed_quarter_id, MAX(quarter_id) AS latest_observed_quarter_id
    FROM d_pos GROUP BY ALL""")
add("relationships", f"""
    SELECT {KEY}, MIN(quarter_id) AS first_observed_quarter_id, MAX(quarter_id) AS latest_observed_quarter_id,
      1 AS is_active FROM d_pos GROUP BY ALL""")
add("instruments", METHOD.format("1"))
add("distinct_instruments", "SELECT DISTINCT cusip, option_type, amount_type FROM d_typed")
add("ticker_list", "SELECT * FROM d_tickers")
add("manager_cusip_quarter", "SELECT * FROM d_mcq")
add("manager_summary", "SELECT * FROM d_msum", "largest_position_weight", "top_10_weight")
add("security_summary", "SELECT * FROM d_ssum", "manager_concentration_hhi")
FILER = ["cik", "accession_number", "filing_date", "periodofreport", "filingmanager_name", "filingmanager_street1",
         "filingmanager_street2", "filingmanager_city", "filingmanager_stateorcountry", "filingmanager_zipcode",
         "form13ffilenumber", "crdnumber", "secfilenumber", "submission_count"]
add("latest_filer", f"SELECT {', '.join(FILER)} FROM d_filer")
add("latest_other_manager", "SELECT * FROM d_other")
add("amendment_components", """
    SELECT accession_number, manager_cik, quarter_id, component_type, component_sequence, is_effective,
      superseded_by_accession_number FROM d_components""")
add("stream_reresolve", """
    SELECT accession_number, manager_cik, quarter_id, component_type, component_sequence, is_effective,
      superseded_by_accession_number FROM d_components""")
add("stream_append", f"""
    SELECT i.accession_number, {big('MAX(f.is_amendment)')} AS etl_batch_id, COUNT(*) AS row_count,
      {big('SUM(i.value)')} AS value
    FROM r_infotable i JOIN d_filings f USING (accession_number) GROUP BY 1""")
add("canonical_filings", "SELECT * FROM d_canonical")
add("calendar", "SELECT * REPLACE (CAST(quarter_end_date AS VARCHAR) AS quarter_end_date) FROM d_calendar")
RUN = """
    SELECT {0}, COUNT(*) AS consecutive_quarters_held
    FROM (SELECT *, quarter_id // 100 * 4 + quarter_id % 100
            + ROW_NUMBER() OVER (PARTITION BY {0} ORDER BY quarter_id DESC) AS run,
          MAX(quarter_id // 100 * 4 + quarter_id % 100) OVER (PARTITION BY {0}) AS last_step FROM {1} y) x
    WHERE run = last_step + 1 GROUP BY ALL"""
add("consecutive_quarters", RUN.format("manager_cik", "d_msum"))
add("relationship_roles", "SELECT * FROM d_roles")

# ---- data quality
add("reconcile", "SELECT * FROM d_recon")
add("reconcile_issues", """
    SELECT * FROM d_recon WHERE reconciliation_status <> 'MATCH' AND reconciliation_status <> 'ROUNDING_DIFFERENCE'""")
add("duplicate_lines", """
    SELECT accession_number, infotable_sk, COUNT(*) AS row_count FROM r_infotable GROUP BY ALL HAVING COUNT(*) > 1""")
add("analytics_holdings", f"""
    SELECT l.* EXCLUDE (quarter_label, quarter_end_date), l.quarter_label, l.quarter_end_date FROM (
      SELECT *, {label('quarter_id')} AS quarter_label,
        CAST({QEND.format('quarter_id')} AS VARCHAR) AS quarter_end_date FROM d_lines WHERE is_analytics_ready = 1) l""")

# ---- dimensions and serving queries
add("manager_dim", "SELECT * FROM d_mgr")
add("listing_dim", "SELECT * FROM d_listing")
add("quarters", f"""
    SELECT quarter_id, {label('quarter_id')} AS quarter_label, CAST({QEND.format('quarter_id')} AS VARCHAR)
      AS quarter_end_date, COUNT(*) AS institution_count FROM d_msum GROUP BY quarter_id""")
add("latest_quarter", "SELECT MAX(quarter_id) AS quarter_id FROM d_pos")
add("security_types", f"""
    SELECT t.security_type AS value, t.type_name AS label, COUNT(i.cusip) AS instrument_count
    FROM c_type t LEFT JOIN (SELECT DISTINCT {INSTRUMENT} FROM d_pos) i USING (security_type_id) GROUP BY ALL""")
OVERVIEW = ["portfolio_value_usd", "common_stock_value_usd", "etf_value_usd", "call_value_usd", "put_value_usd"]
add("overview", f"""
    SELECT quarter_id, COUNT(*) AS institution_count, {big('SUM(cusip_count)')} AS reported_position_count,
      {', '.join(f"{big(f'SUM({c})')} AS {c}" for c in OVERVIEW)}, {label('quarter_id')} AS quarter_label
    FROM d_msum GROUP BY quarter_id""")
add("top_institutions", f"""
    SELECT s.quarter_id, s.manager_cik AS cik, {NAME.format('s.manager_cik')} AS institution_name,
      s.portfolio_value_usd, s.cusip_count AS holding_count
    FROM d_msum s LEFT JOIN d_mgr m ON m.cik = s.manager_cik
    QUALIFY ROW_NUMBER() OVER (PARTITION BY s.quarter_id
      ORDER BY s.portfolio_value_usd DESC, {NAME.format('s.manager_cik')}, s.manager_cik) <= 5""")
add("top_securities", """
    SELECT s.quarter_id, s.cusip, v.current_nameofissuer AS issuer, s.manager_count AS institution_count,
      s.total_value_usd AS institutional_value_usd
    FROM d_ssum s JOIN d_current v USING (cusip)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY s.quarter_id
      ORDER BY s.total_value_usd DESC, v.current_nameofissuer, s.cusip) <= 5""")
add("rank_institutions", RANK, *WEIGHTS)
add("institution_identity", f"""
    SELECT m.cik, {NAME.format('m.cik')} AS institution_name, m.sec_company_name, m.filingmanager_street1 AS street_1,
      m.filingmanager_street2 AS street_2, m.filingmanager_city AS city,
      m.filingmanager_stateorcountry AS state_or_country, m.filingmanager_zipcode AS postal_code,
      m.form13ffilenumber AS form_13f_file_number, m.crdnumber AS crd_number,
      m.latest_related_accession_number AS latest_accession_number, m.latest_filing_date,
      {label('MIN(s.quarter_id)')} AS first_reportable_quarter, {label('MAX(s.quarter_id)')}
        AS latest_reportable_quarter
    FROM d_mgr m LEFT JOIN d_msum s ON s.manager_cik = m.cik GROUP BY ALL""")
add("institution_snapshot", f"""
    SELECT * FROM (
      SELECT s.* EXCLUDE (largest_cusip, largest_security_type_id, largest_option_type, largest_amount_type),
        {label('s.quarter_id')} AS quarter_label,
        {div('s.portfolio_value_usd', 's.instrument_count')} AS average_position_value_usd,
        s.largest_cusip AS largest_holding_cusip, v.current_nameofissuer AS largest_holding_issuer
      FROM d_msum s LEFT JOIN d_current v ON v.cusip = s.largest_cusip
      QUALIFY s.quarter_id = MAX(s.quarter_id) OVER (PARTITION BY s.manager_cik)) z""", *WEIGHTS)
ALLOCATION = f"""
    SELECT manager_cik, quarter_id, t.security_type, {big('SUM(value_usd)')} AS value_usd,
      COUNT(*) AS instrument_count FROM d_pos JOIN c_type t USING (security_type_id) GROUP BY ALL"""
add("institution_allocation", ALLOCATION)
add("allocation_share", f"""
    SELECT a.*, COALESCE({div('a.value_usd', 's.portfolio_value_usd')}, 0) AS share
    FROM ({ALLOCATION}) a JOIN d_msum s USING (manager_cik, quarter_id)""", "share")
HISTORY = f"""
    SELECT s.manager_cik, s.quarter_id, {label('s.quarter_id')} AS quarter_label, s.portfolio_value_usd,
      s.cusip_count AS holding_count, s.top_10_weight, s.largest_position_weight,
      {div('s.portfolio_value_usd', 's.instrument_count')} AS average_position_value_usd,
      COALESCE(a.new_count, 0) AS new_count, COALESCE(a.exited_count, 0) AS exited_count,
      COALESCE(a.net_value_change_usd, 0) AS net_value_change_usd,
      {div('COALESCE(a.gross_value_change_usd, 0)', '2 * s.portfolio_value_usd')} AS turnover_rate
    FROM d_msum s LEFT JOIN d_mact a USING (manager_cik, quarter_id)"""
add("institution_history", HISTORY, *WEIGHTS, "turnover_rate")
add("behavior_metrics", f"""
    SELECT manager_cik, average_turnover, average_position, buy_sell_ratio,
      diversification FROM (
      SELECT manager_cik, AVG(COALESCE(turnover_rate, 0)) AS average_turnover,
        AVG(COALESCE(average_position_value_usd, 0)) AS average_position,
        {div('COALESCE(SUM(net_value_change_usd) FILTER (net_value_change_usd > 0), 0)',
             '-SUM(net_value_change_usd) FILTER (net_value_change_usd < 0)')} AS buy_sell_ratio,
        1 - COALESCE(LAST(top_10_weight ORDER BY quarter_id), 0) AS diversification
      FROM ({HISTORY}) h GROUP BY manager_cik) b""", "average_turnover", "average_position", "buy_sell_ratio", "diversification")
add("institution_holdings", """
    SELECT h.manager_cik, h.quarter_id, h.cusip, v.current_nameofissuer AS issuer,
      v.current_titleofclass AS title_of_class, t.security_type, h.option_type, h.market_value_usd, h.reported_amount,
      h.amount_type, h.portfolio_weight, h.action, h.amount_change, h.amount_change_percent, h.value_change_usd,
      h.is_comparable
    FROM d_view h JOIN c_type t USING (security_type_id) JOIN d_current v ON v.cusip = h.cusip""",
    "portfolio_weight", "amount_change_percent")
add("rank_securities", f"""
    SELECT s.quarter_id, s.cusip, v.current_nameofissuer AS issuer, v.current_titleofclass AS title_of_class,
      t.security_type, {label('s.quarter_id')} AS quarter_label, s.manager_count AS institution_count,
      s.total_value_usd AS institutional_value_usd, s.common_stock_value_usd, s.call_value_usd, s.put_value_usd,
      s.manager_concentration_hhi AS concentration_hhi,
      {', '.join(f'COALESCE(a.{c}, 0) AS {c}' for c in ('new_investor_count', 'exited_investor_count',
                 'added_holder_count', 'reduced_holder_count', 'net_value_change_usd'))}
    FROM d_ssum s JOIN d_current v ON v.cusip = s.cusip JOIN d_class k ON k.cusip = s.cusip
    JOIN c_type t ON t.security_type_id = k.security_type_id
    LEFT JOIN d_sact a ON a.cusip = s.cusip AND a.quarter_id = s.quarter_id""", "concentration_hhi")
add("security_identity", f"""
    SELECT v.cusip, v.current_nameofissuer AS issuer, v.current_titleofclass AS title_of_class,
      v.current_figi AS figi, t.security_type, k.classification_method, k.classification_confidence,
      {label('MIN(s.quarter_id)')} AS first_reportable_quarter, {label('MAX(s.quarter_id)')}
        AS latest_reportable_quarter
    FROM d_current v LEFT JOIN d_class k ON k.cusip = v.cusip
    LEFT JOIN c_type t ON t.security_type_id = k.security_type_id LEFT JOIN d_ssum s ON s.cusip = v.cusip
    GROUP BY ALL""", "classification_confidence")
add("security_snapshot", f"""
    SELECT * FROM (
      SELECT s.*, {label('s.quarter_id')} AS quarter_label,
        {div('s.total_value_usd', 's.manager_count')} AS average_position_value_usd,
        {NAME.format('s.largest_manager_cik')} AS largest_holder_name
      FROM d_ssum s LEFT JOIN d_mgr m ON m.cik = s.largest_manager_cik
      QUALIFY s.quarter_id = MAX(s.quarter_id) OVER (PARTITION BY s.cusip)) z""", "manager_concentration_hhi")
add("security_history", f"""
    SELECT * FROM (
      SELECT s.cusip, s.quarter_id, {label('s.quarter_id')} AS quarter_label, s.manager_count AS institution_count,
        s.total_value_usd AS institutional_value_usd, s.manager_concentration_hhi AS concentration_hhi,
        {div('s.total_value_usd', 's.manager_count')} AS average_position_value_usd,
        {', '.join(f'COALESCE(a.{c}, 0) AS {c}' for c in SEC_ALSO)}
      FROM d_ssum s LEFT JOIN d_sact a USING (cusip, quarter_id)) z""", "concentration_hhi")
add("security_holders", f"""
    SELECT h.*, {NAME.format('h.cik')} AS institution_name FROM (
      SELECT cusip, quarter_id, manager_cik AS cik, {big('SUM(market_value_usd)')} AS market_value_usd,
        {big('SUM(reported_amount)')} AS reported_amount, MAX(portfolio_weight) AS portfolio_weight,
        ['UNKNOWN', 'NEW', 'ADDED', 'REDUCED', 'EXITED', 'UNCHANGED'][MIN(LIST_POSITION(
          ['UNKNOWN', 'NEW', 'ADDED', 'REDUCED', 'EXITED', 'UNCHANGED'], action))] AS action,
        {big('COALESCE(SUM(amount_change), 0)')} AS amount_change,
        {big('COALESCE(SUM(value_change_usd), 0)')} AS value_change_usd
      FROM d_view GROUP BY ALL) h LEFT JOIN d_mgr m USING (cik)""", "portfolio_weight")
add("same_issuer", """
    SELECT a.cusip, a.current_nameofissuer AS issuer, b.cusip AS other_cusip, b.current_titleofclass AS title_of_class
    FROM d_current a JOIN d_current b ON a.current_nameofissuer = b.current_nameofissuer AND a.cusip <> b.cusip
    QUALIFY ROW_NUMBER() OVER (PARTITION BY a.cusip ORDER BY b.cusip) <= 20""")
add("relationship_identity", f"""
    SELECT p.manager_cik AS cik, {NAME.format('p.manager_cik')} AS institution_name, p.cusip,
      v.current_nameofissuer AS issuer, v.current_titleofclass AS title_of_class,
      {label('MIN(p.quarter_id)')} AS first_purchased, {label('MAX(p.quarter_id)')} AS latest_quarter
    FROM d_pos p JOIN d_current v USING (cusip) LEFT JOIN d_mgr m ON m.cik = p.manager_cik GROUP BY ALL""")
add("relationship_history", "SELECT * FROM d_hist", "portfolio_weight", "amount_change_percent")
add("relationship_stats", f"""
    SELECT h.*, r.consecutive_quarters_held FROM (
      SELECT manager_cik, cusip, COUNT(*) FILTER (market_value_usd > 0) AS holding_duration_quarters,
        MAX(quarter_label) FILTER (action IN ('NEW', 'ADDED')) AS last_added,
        MAX(quarter_label) FILTER (action = 'REDUCED') AS last_reduced,
        MAX(market_value_usd) AS largest_position_value_usd,
        MAX(COALESCE(portfolio_weight, 0)) AS highest_portfolio_weight FROM d_hist GROUP BY ALL) h
    JOIN ({RUN.format('manager_cik, cusip', 'd_mcq')}) r USING (manager_cik, cusip)""", "highest_portfolio_weight")
MOVE = """action, prior_value_usd, current_value_usd, value_change_usd, prior_reported_amount, current_reported_amount,
      amount_change"""
add("institution_movers", f"""
    SELECT manager_cik, from_quarter_id, to_quarter_id, x.cusip, v.current_nameofissuer AS issuer,
      v.current_titleofclass AS title_of_class, t.security_type, option_type, amount_type, {MOVE}
    FROM (SELECT * FROM d_chg QUALIFY ROW_NUMBER() OVER (PARTITION BY manager_cik, from_quarter_id, to_quarter_id
      ORDER BY ABS(value_change_usd) DESC, {INSTRUMENT}) <= 25) x
    JOIN c_type t USING (security_type_id) JOIN d_current v ON v.cusip = x.cusip""")
add("security_movers", f"""
    SELECT cusip, from_quarter_id, to_quarter_id, manager_cik AS cik, {NAME.format('manager_cik')} AS institution_name,
      security_type_id, option_type, amount_type, {MOVE}
    FROM (SELECT * FROM d_chg QUALIFY ROW_NUMBER() OVER (PARTITION BY cusip, from_quarter_id, to_quarter_id
      ORDER BY ABS(value_change_usd) DESC, manager_cik, security_type_id, option_type, amount_type) <= 25) x
    LEFT JOIN d_mgr m ON m.cik = x.manager_cik""")
add("activity_explorer", f"""
    SELECT manager_cik AS cik, {NAME.format('manager_cik')} AS institution_name, x.cusip,
      v.current_nameofissuer AS issuer, v.current_titleofclass AS title_of_class, t.security_type, option_type,
      amount_type, to_quarter_id, {MOVE}
    FROM d_chg x JOIN c_type t USING (security_type_id) JOIN d_current v ON v.cusip = x.cusip
    LEFT JOIN d_mgr m ON m.cik = x.manager_cik""")
INDUSTRY = """
    SELECT s.*, COALESCE(a.net_value_change_usd, 0) AS net_change, COALESCE(a.new_count, 0) AS new_n,
      COALESCE(a.exited_count, 0) AS exited_n, COALESCE(l.division, 'Unclassified') AS division,
      COALESCE(l.sic, '----') AS sic, COALESCE(l.sic_description, 'Unclassified') AS sic_description
    FROM d_msum s LEFT JOIN d_mact a USING (manager_cik, quarter_id)
    LEFT JOIN (SELECT cik AS manager_cik, MIN(sic_major_group_division) AS division, MIN(sic) AS sic,
      MIN(sic_description) AS sic_description FROM d_listing GROUP BY 1) l USING (manager_cik)"""
FLOWS = ", ".join(f"{big(f'SUM({a})')} AS {b}" for a, b in (
    ("net_change", "net_value_change_usd"), ("new_n", "new_count"), ("exited_n", "exited_count")))
HELD = f"""COUNT(*) AS institution_count, {big('SUM(portfolio_value_usd)')} AS portfolio_value_usd,
      {big('SUM(cusip_count)')} AS holding_count"""
add("sic_division_agg", f"""
    SELECT quarter_id, division, {HELD}, {', '.join(f"{big(f'SUM({c})')} AS {c}" for c in OVERVIEW[1:])}, {FLOWS}
    FROM ({INDUSTRY}) i GROUP BY quarter_id, division""")
add("sic_industry_agg", f"""
    SELECT quarter_id, division, sic, sic_description, {HELD}, {FLOWS} FROM ({INDUSTRY}) i
    GROUP BY quarter_id, division, sic, sic_description""")
add("sic_totals", f"""
    SELECT quarter_id, {HELD}, {big('SUM(net_change)')} AS net_value_change_usd FROM ({INDUSTRY}) i
    GROUP BY quarter_id""")
add("global_search", f"""
    SELECT * FROM (
      SELECT 'institution' AS result_type, m.cik AS result_id, {NAME.format('m.cik')} AS label,
        'CIK ' || m.cik AS detail
      FROM d_mgr m WHERE m.cik ILIKE '%MANAGER 2%' OR m.manager_name ILIKE '%MANAGER 2%'
        OR m.sec_company_name ILIKE '%MANAGER 2%'
      UNION ALL
      SELECT 'security', cusip, current_nameofissuer, cusip || ' · ' || COALESCE(current_titleofclass, 'Unclassified')
      FROM d_current WHERE cusip ILIKE '%MANAGER 2%' OR current_nameofissuer ILIKE '%MANAGER 2%') u
    ORDER BY result_type, result_id LIMIT 12""")


# ---- audits: the same rules, one SELECT per rule
TABLE = {
    **{t: f"r_{t}" for t in RAW}, **COUNTED, "security_type": "c_type",
    "relationships": f"(SELECT {KEY}, MIN(quarter_id) AS first_observed_quarter_id, "
                     f"MAX(quarter_id) AS latest_observed_quarter_id, 1 AS is_active FROM d_pos GROUP BY ALL)",
    "instruments": f"(SELECT DISTINCT {INSTRUMENT}, 1 AS is_active FROM d_pos)",
    "filings": "(SELECT *, CAST(NULL AS BIGINT) AS etl_batch_id FROM d_filings)",
    "class_rule": "(SELECT rule_id, type_id AS security_type_id FROM c_rule)",
    "filing_override": "(SELECT accession_number FROM d_filings WHERE has_information_table = 0 OR amendment_type = 'OTHER')",
    "type_override": "(SELECT cusip, 3 AS security_type_id FROM d_current WHERE cusip = 'BRD000005')",
    "batch": "(SELECT DISTINCT quarter_id AS etl_batch_id FROM d_filings)",
    "batch_accession": "(SELECT quarter_id AS etl_batch_id, accession_number FROM d_filings)",
    "batch_count": f"({counts()})",
}


def _audits() -> None:
    from holdfast.operators.audit import REFERENCES, UNIQUE_KEYS

    parts = []
    for r in REFERENCES:
        match = " AND ".join(f"p.{b} = c.{a}" for a, b in zip(r.columns, r.parent_columns))
        given = " AND ".join(f"c.{a} IS NOT NULL" for a in r.columns)
        parts.append(f"""SELECT '{r.child}' AS child_table, '{','.join(r.columns)}' AS child_columns,
            '{r.parent}' AS parent_table, COUNT(*) AS violations FROM {TABLE[r.child]} c
            WHERE {given} AND NOT EXISTS (SELECT 1 FROM {TABLE[r.parent]} p WHERE {match})""")
    add("fk_audit", " UNION ALL ".join(parts))
    add("unique_audit", " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{','.join(k)}' AS key_columns, COUNT(*) AS duplicate_keys,
            {big('COALESCE(SUM(n), 0)')} AS row_count
            FROM (SELECT COUNT(*) AS n FROM {TABLE[t]} x GROUP BY {', '.join(k)} HAVING COUNT(*) > 1) d"""
        for t, k in UNIQUE_KEYS.items()))
    flag, text_of = "IN (0, 1)", "'{}'".format
    allowed = {
        ("infotable", "sshprnamttype"): "IN ('SH', 'PRN')",
        **{("filings", c): flag for c in ("is_amendment", "is_confidential_omitted", "has_information_table")},
        ("components", "component_type"): "IN ('BASE', 'RESTATEMENT', 'ADDITION', 'UNKNOWN', 'EXCLUDE')",
        ("components", "is_effective"): flag,
        ("canonical", "resolution_status"): "IN ('RESOLVED', 'REVIEW_REQUIRED', 'INCOMPLETE_HISTORY')",
        **{("canonical", c): flag for c in ("is_analytics_ready", "has_amendment", "has_confidential_omission")},
        ("classification", "classification_method"): "IN ('CUSIP_OVERRIDE', 'RULE_VOTE', 'UNKNOWN')",
        ("instruments", "option_type"): "IN ('NONE', 'CALL', 'PUT')",
        ("instruments", "amount_type"): "IN ('SH', 'PRN', 'OTHER')",
        ("instruments", "is_active"): flag,
        **{("positions", c): flag for c in ("has_shared_discretion", "has_confidential_omission")},
        ("positions", "value_quality_status"): "IN ('OK', 'ROUNDING_DIFFERENCE', 'ISSUE')",
        ("changes", "action"): "IN ('NEW', 'ADDED', 'REDUCED', 'EXITED', 'UNCHANGED', 'UNKNOWN')",
        ("changes", "is_comparable"): flag,
    }
    needed = {
        "infotable": ("cusip", "value", "sshprnamt", "nameofissuer", "titleofclass"),
        "submission": ("filing_date", "submissiontype", "cik", "periodofreport"),
        "filings": ("manager_cik", "filing_date"),
        "positions": ("value_usd", "reported_amount"),
    }
    rules = [(t, f"{c} in domain", f"{c} NOT {values}") for (t, c), values in allowed.items()]
    rules += [(t, f"{c} not null", f"{c} IS NULL") for t, columns in needed.items() for c in columns]
    rules.append(("calendar", "quarter_number between 1 and 4", "quarter_number NOT BETWEEN 1 AND 4"))
    rules.append(("classification", "confidence between 0 and 1", "classification_confidence NOT BETWEEN 0 AND 1"))
    add("domain_audit", " UNION ALL ".join(
        f"""SELECT {text_of(t)} AS table_name, {text_of(name)} AS rule, COUNT(*) AS violations
            FROM {TABLE[t]} x WHERE {broken}""" for t, name, broken in rules))


_audits()
