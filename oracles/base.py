"""Independent DuckDB statements of the tables, used as leading CTEs of every oracle.

Written with windows and joins where the Spark side uses partial aggregates, so that
the two sides do not share a method.  ``statement`` puts the CTEs a query mentions,
directly or through others, in front of it.
"""

from __future__ import annotations

import re

from holdfast.schemas import CLASS_RULES, SECURITY_TYPES, SIC_DIVISIONS
from holdfast.sources.sample import DUCKDB, STAR_TABLES, mapping_sql


def _raw() -> dict[str, str]:
    mapping = mapping_sql(DUCKDB)
    names = {**{t: t for t in STAR_TABLES}, **{k: k if k.startswith("s_") else f"r_{k}" for k in mapping}}
    return {names[k]: text.format(**names) for k, text in mapping.items()}


def _values(rows: list[tuple], columns: str) -> str:
    def literal(x: object) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    body = ", ".join("(" + ", ".join(literal(x) for x in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) t({columns})"


def label(q: str) -> str:
    return f"({q} // 100 || 'Q' || {q} % 100)"


def prev(q: str) -> str:
    return f"CAST(CASE WHEN {q} % 100 = 1 THEN {q} - 97 ELSE {q} - 1 END AS INTEGER)"


def day(c: str) -> str:
    return f"CAST(STRPTIME({c}, '%d-%b-%Y') AS DATE)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def cik(c: str) -> str:
    return f"PRINTF('%010d', CAST({c} AS BIGINT))"


def big(e: str) -> str:
    return f"CAST({e} AS BIGINT)"


def _votes(ruled: str) -> str:
    """Classes by weighted votes over spellings with their rule."""
    return f"""
        SELECT t.cusip, CAST(COALESCE(b.type_id, 99) AS INTEGER) AS security_type_id,
          CASE WHEN b.type_id IS NULL THEN 'UNKNOWN' ELSE 'RULE_VOTE' END AS classification_method,
          CAST(b.rule_id AS INTEGER) AS selected_rule_id, {big('t.n')} AS total_occurrence_count,
          {big('COALESCE(t.matched, 0)')} AS matched_occurrence_count,
          {big('COALESCE(b.type_n, 0)')} AS winning_occurrence_count,
          CAST(COALESCE(b.type_n, 0) AS DOUBLE) / t.n AS classification_confidence
        FROM (SELECT cusip, SUM(n) AS n, SUM(n) FILTER (type_id IS NOT NULL) AS matched FROM {ruled} GROUP BY cusip) t
        LEFT JOIN (
          SELECT * FROM (
            SELECT cusip, type_id, rule_id, rule_n, SUM(rule_n) OVER (PARTITION BY cusip, type_id) AS type_n
            FROM (SELECT cusip, type_id, rule_id, SUM(n) AS rule_n FROM {ruled} WHERE type_id IS NOT NULL GROUP BY ALL) v
          ) u
          QUALIFY ROW_NUMBER() OVER (PARTITION BY cusip ORDER BY type_n DESC, type_id, rule_n DESC, rule_id) = 1) b USING (cusip)"""


QUALITY = "CASE {0} WHEN 0 THEN 'OK' WHEN 1 THEN 'ROUNDING_DIFFERENCE' ELSE 'ISSUE' END"
INSTRUMENT = "cusip, security_type_id, option_type, amount_type"
KEY = f"manager_cik, {INSTRUMENT}"
TYPE_SUMS = {"common_stock": 1, "etf": 2, "call": 5, "put": 6, "unknown": 99}
SUMS = ", ".join(
    big(f"COALESCE(SUM(value_usd) FILTER (security_type_id = {t}), 0)") + f" AS {n}_value_usd"
    for n, t in TYPE_SUMS.items()
)
NAME = "COALESCE(NULLIF(m.manager_name, ''), NULLIF(m.sec_company_name, ''), {0})"

CTES: dict[str, str] = {
    **_raw(),
    "c_rule": _values(CLASS_RULES, "rule_id, priority, field, match_type, pattern, type_id"),
    "c_type": _values(SECURITY_TYPES, "security_type_id, security_type, type_name, core"),
    "c_division": _values(SIC_DIVISIONS, "lo, hi, division"),
    "d_filings": f"""
        SELECT s.accession_number, {cik('s.cik')} AS manager_cik, {day('s.filing_date')} AS filing_date,
          {day('s.periodofreport')} AS period_of_report, {day('c.reportcalendarorquarter')} AS report_date,
          CAST(YEAR({day('c.reportcalendarorquarter')}) * 100 + QUARTER({day('c.reportcalendarorquarter')})
            AS INTEGER) AS quarter_id,
          s.submissiontype AS submission_type, c.reporttype AS report_type,
          CASE WHEN UPPER(c.isamendment) = 'Y' OR SUFFIX(s.submissiontype, '/A') THEN 1 ELSE 0 END AS is_amendment,
          c.amendmentno AS amendment_number, c.amendmenttype AS amendment_type,
          CASE WHEN UPPER(p.isconfidentialomitted) = 'Y' THEN 1 ELSE 0 END AS is_confidential_omitted,
          c.form13ffilenumber AS form13f_file_number,
          CASE WHEN s.accession_number IN (SELECT accession_number FROM r_infotable) THEN 1 ELSE 0 END
            AS has_information_table
        FROM r_submission s LEFT JOIN r_coverpage c USING (accession_number)
        LEFT JOIN r_summarypage p USING (accession_number)""",
    "d_kinds": """
        SELECT *, CASE WHEN is_amendment = 0 THEN 'BASE'
          WHEN UPPER(amendment_type) = 'RESTATEMENT' THEN 'RESTATEMENT'
          WHEN UPPER(amendment_type) = 'NEW HOLDINGS' THEN 'ADDITION' ELSE 'UNKNOWN' END AS component_type
        FROM d_filings WHERE submission_type ILIKE '13F-HR%' AND quarter_id IS NOT NULL""",
    "d_ordered": """
        SELECT *, component_type IN ('BASE', 'RESTATEMENT') AS resets,
          CAST(ROW_NUMBER() OVER (PARTITION BY manager_cik, quarter_id
            ORDER BY filing_date, COALESCE(amendment_number, -1), accession_number) AS INTEGER) AS component_sequence
        FROM d_kinds""",
    "d_components": """
        SELECT accession_number, manager_cik, quarter_id, component_type, component_sequence,
          CASE WHEN (resets AND component_sequence = final_reset)
            OR (component_type = 'ADDITION' AND component_sequence > final_reset) THEN 1 ELSE 0 END AS is_effective,
          CASE WHEN component_type NOT IN ('UNKNOWN', 'EXCLUDE') THEN next_reset END
            AS superseded_by_accession_number,
          is_amendment, is_confidential_omitted, filing_date, earlier_reset
        FROM (SELECT *,
            COALESCE(MAX(CASE WHEN resets THEN component_sequence END)
              OVER (PARTITION BY manager_cik, quarter_id), 0) AS final_reset,
            COALESCE(BOOL_OR(resets) OVER (PARTITION BY manager_cik, quarter_id ORDER BY component_sequence
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS earlier_reset,
            FIRST_VALUE(CASE WHEN resets THEN accession_number END IGNORE NULLS)
              OVER (PARTITION BY manager_cik, quarter_id ORDER BY component_sequence
              ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_reset
          FROM d_ordered) o""",
    "d_canonical": """
        SELECT manager_cik, quarter_id, resolution_status,
          CASE WHEN resolution_status = 'RESOLVED' AND n > 0 THEN 1 ELSE 0 END AS is_analytics_ready,
          has_amendment, has_confidential_omission, n AS effective_component_count, latest_accession_number
        FROM (SELECT manager_cik, quarter_id,
            CASE WHEN BOOL_OR(component_type = 'ADDITION')
                  AND NOT BOOL_OR(component_type IN ('BASE', 'RESTATEMENT')) THEN 'INCOMPLETE_HISTORY'
                 WHEN BOOL_OR(component_type = 'UNKNOWN' OR (component_type = 'BASE' AND earlier_reset))
                 THEN 'REVIEW_REQUIRED' ELSE 'RESOLVED' END AS resolution_status,
            MAX(is_amendment) AS has_amendment,
            MAX(CASE WHEN is_effective = 1 THEN is_confidential_omitted ELSE 0 END) AS has_confidential_omission,
            CAST(SUM(is_effective) AS BIGINT) AS n,
            ARG_MAX(accession_number, component_sequence) AS latest_accession_number
          FROM d_components GROUP BY ALL) g""",
    "d_recon": """
        SELECT accession_number, holding_row_count, h AS holding_raw_total, t AS summary_raw_total,
          h - t AS raw_difference,
          CASE WHEN t IS NULL THEN 'NO_SUMMARY' WHEN h = t THEN 'MATCH'
            WHEN ABS(h - t) < 2 THEN 'ROUNDING_DIFFERENCE' WHEN t = 0 THEN 'SUMMARY_ZERO'
            WHEN h >= 999 * t AND h <= 1001 * t THEN 'HOLDINGS_APPROX_1000X_SUMMARY'
            WHEN t >= 999 * h AND t <= 1001 * h THEN 'SUMMARY_APPROX_1000X_HOLDINGS' ELSE 'MISMATCH' END
            AS reconciliation_status
        FROM (SELECT i.accession_number, COUNT(*) AS holding_row_count, CAST(SUM(i.value) AS BIGINT) AS h,
            ANY_VALUE(p.tablevaluetotal) AS t
          FROM r_infotable i LEFT JOIN r_summarypage p USING (accession_number)
          WHERE i.accession_number IN (SELECT accession_number FROM d_components WHERE is_effective = 1)
          GROUP BY i.accession_number) x""",
    "d_lines": f"""
        SELECT c.accession_number, g.manager_cik, g.quarter_id, g.resolution_status, g.is_analytics_ready,
          g.has_confidential_omission, r.reconciliation_status AS value_reconciliation_status,
          i.* EXCLUDE (accession_number, value), i.value AS raw_reported_value,
          {big("CASE WHEN c.filing_date < DATE '2023-01-03' THEN 1000 ELSE 1 END")} AS value_multiplier,
          {big("i.value * CASE WHEN c.filing_date < DATE '2023-01-03' THEN 1000 ELSE 1 END")} AS value_usd
        FROM r_infotable i JOIN d_components c ON c.accession_number = i.accession_number AND c.is_effective = 1
        JOIN d_canonical g ON g.manager_cik = c.manager_cik AND g.quarter_id = c.quarter_id
        LEFT JOIN d_recon r ON r.accession_number = c.accession_number""",
    "d_variants": """
        SELECT i.cusip, c.reportcalendarorquarter, i.nameofissuer, i.titleofclass, i.figi,
          COUNT(*) AS occurrence_count
        FROM r_infotable i JOIN r_coverpage c USING (accession_number) GROUP BY ALL""",
    "d_current": """
        SELECT cusip, nameofissuer AS current_nameofissuer, titleofclass AS current_titleofclass,
          figi AS current_figi, reportcalendarorquarter, occurrence_count
        FROM d_variants
        QUALIFY ROW_NUMBER() OVER (PARTITION BY cusip ORDER BY
          CAST(SUBSTR(reportcalendarorquarter, 8) AS INTEGER) * 100
            + COALESCE(LIST_POSITION(['MAR', 'JUN', 'SEP', 'DEC'], SUBSTR(reportcalendarorquarter, 4, 3)), 0) DESC,
          SUBSTR(reportcalendarorquarter, 1, 2) DESC, occurrence_count DESC, nameofissuer, titleofclass,
          COALESCE(figi, '')) = 1""",
    "d_spellings": r"""
        SELECT cusip, nameofissuer, titleofclass, SUM(occurrence_count) AS n,
          TRIM(REGEXP_REPLACE(UPPER(nameofissuer), '\s+', ' ', 'g')) AS issuer_text,
          TRIM(REGEXP_REPLACE(UPPER(titleofclass), '\s+', ' ', 'g')) AS class_text
        FROM d_variants GROUP BY ALL""",
    "d_ruled": """
        SELECT s.cusip, s.nameofissuer, s.titleofclass, s.n, r.rule_id, r.type_id
        FROM d_spellings s LEFT JOIN c_rule r
          ON REGEXP_MATCHES(CASE r.field WHEN 'titleofclass' THEN s.class_text ELSE s.issuer_text END, r.pattern, 'i')
        QUALIFY ROW_NUMBER() OVER (PARTITION BY s.cusip, s.nameofissuer, s.titleofclass ORDER BY r.priority) = 1""",
    "d_class": _votes("d_ruled"),
    "d_rulebook": """
        SELECT id AS rule_id, 10 + id % 97 AS priority, CASE WHEN id % 4 = 0 THEN 'EXACT' ELSE 'CONTAINS' END AS match_type,
          TRIM(UPPER(CASE WHEN id % 4 = 0 THEN nameofissuer ELSE SUBSTR(nameofissuer, i, k) END)) AS pattern,
          [1, 2, 3, 4, 8, 9][id // 4 % 6 + 1] AS type_id
        FROM (SELECT *, CAST('0x' || SUBSTR(MD5(nameofissuer || ':' || i || ':' || k), 1, 7) AS BIGINT) AS id FROM
          (SELECT *, UNNEST([4, 6]) AS k FROM (SELECT *, UNNEST(RANGE(1, LENGTH(nameofissuer) + 1)) AS i FROM
            (SELECT DISTINCT nameofissuer FROM d_variants) x) y) z) u
        WHERE id % 5 <> 0""",
    "d_booked": """
        SELECT s.cusip, s.nameofissuer, s.titleofclass, s.n, r.rule_id, r.type_id
        FROM d_spellings s LEFT JOIN (
          SELECT t.issuer_text, t.class_text, b.rule_id, b.type_id, b.priority FROM (SELECT DISTINCT issuer_text, class_text FROM d_spellings) t
          JOIN d_rulebook b ON CASE b.match_type WHEN 'EXACT' THEN t.issuer_text = b.pattern ELSE CONTAINS(t.issuer_text, b.pattern) END
          UNION ALL
          SELECT t.issuer_text, t.class_text, c.rule_id, c.type_id, c.priority + 100 FROM (SELECT DISTINCT issuer_text, class_text FROM d_spellings) t
          JOIN c_rule c ON REGEXP_MATCHES(CASE c.field WHEN 'titleofclass' THEN t.class_text ELSE t.issuer_text END, c.pattern, 'i')) r
          USING (issuer_text, class_text)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY s.cusip, s.nameofissuer, s.titleofclass ORDER BY r.priority, r.rule_id) = 1""",
    "d_bookclass": _votes("d_booked"),
    "d_typed": """
        SELECT l.*,
          CAST(CASE WHEN UPPER(l.putcall) = 'CALL' THEN 5 WHEN UPPER(l.putcall) = 'PUT' THEN 6
            WHEN l.sshprnamttype = 'PRN' THEN 7 ELSE k.security_type_id END AS INTEGER) AS security_type_id,
          CASE WHEN UPPER(l.putcall) IN ('CALL', 'PUT') THEN UPPER(l.putcall) ELSE 'NONE' END AS option_type,
          CASE WHEN l.sshprnamttype IN ('SH', 'PRN') THEN l.sshprnamttype ELSE 'OTHER' END AS amount_type,
          k.classification_method
        FROM d_lines l JOIN d_class k USING (cusip) WHERE l.is_analytics_ready = 1""",
    "d_pos": f"""
        SELECT *, {QUALITY.format('quality_level')} AS value_quality_status,
          {div('value_usd', 'SUM(value_usd) OVER (PARTITION BY manager_cik, quarter_id)')} AS portfolio_weight
        FROM (SELECT {KEY}, quarter_id, {big('SUM(value_usd)')} AS value_usd,
            {big('SUM(sshprnamt)')} AS reported_amount, COUNT(*) AS source_row_count,
            COUNT(DISTINCT accession_number) AS effective_accession_count,
            MAX(CASE WHEN othermanager IS NULL AND investmentdiscretion = 'SOLE' THEN 0 ELSE 1 END)
              AS has_shared_discretion,
            MAX(has_confidential_omission) AS has_confidential_omission,
            MAX(CASE value_reconciliation_status WHEN 'MATCH' THEN 0 WHEN 'ROUNDING_DIFFERENCE' THEN 1 ELSE 2 END)
              AS quality_level
          FROM d_typed GROUP BY ALL) a""",
    "d_ranked": f"""
        SELECT *, ROW_NUMBER() OVER (PARTITION BY manager_cik, quarter_id ORDER BY value_usd DESC, {INSTRUMENT}) AS place
        FROM d_pos""",
    "d_msum": f"""
        SELECT manager_cik, quarter_id, {big('SUM(value_usd)')} AS portfolio_value_usd, COUNT(*) AS instrument_count,
          COUNT(DISTINCT cusip) AS cusip_count, {SUMS},
          MAX(has_shared_discretion) AS has_shared_discretion,
          MAX(has_confidential_omission) AS has_confidential_omission,
          {QUALITY.format('MAX(quality_level)')} AS value_quality_status,
          {', '.join(f'ANY_VALUE({c}) FILTER (place = 1) AS largest_{c}' for c in INSTRUMENT.split(', '))},
          ANY_VALUE(value_usd) FILTER (place = 1) AS largest_position_value_usd,
          ANY_VALUE(portfolio_weight) FILTER (place = 1) AS largest_position_weight,
          SUM(portfolio_weight) FILTER (place <= 10) AS top_10_weight
        FROM d_ranked GROUP BY ALL""",
    "d_mcq": f"""
        SELECT manager_cik, cusip, quarter_id, {big('SUM(value_usd)')} AS value_usd, COUNT(*) AS instrument_count,
          MAX(has_shared_discretion) AS has_shared_discretion,
          MAX(has_confidential_omission) AS has_confidential_omission,
          {QUALITY.format('MAX(quality_level)')} AS value_quality_status
        FROM d_pos GROUP BY ALL""",
    "d_hhi": f"""
        SELECT cusip, quarter_id, manager_cik, value_usd,
          {div('value_usd', 'SUM(value_usd) OVER (PARTITION BY cusip, quarter_id)')} AS share
        FROM d_mcq""",
    "d_ssum": f"""
        SELECT p.*, h.largest_manager_cik, h.largest_manager_value_usd, h.manager_concentration_hhi
        FROM (SELECT cusip, quarter_id, COUNT(DISTINCT manager_cik) AS manager_count,
            {big('SUM(value_usd)')} AS total_value_usd, {SUMS},
            MAX(has_shared_discretion) AS has_shared_discretion,
            MAX(has_confidential_omission) AS has_confidential_omission,
            {QUALITY.format('MAX(quality_level)')} AS value_quality_status FROM d_pos GROUP BY ALL) p
        JOIN (SELECT cusip, quarter_id, FIRST(manager_cik ORDER BY value_usd DESC, manager_cik) AS largest_manager_cik,
            MAX(value_usd) AS largest_manager_value_usd, SUM(share * share) AS manager_concentration_hhi
          FROM d_hhi GROUP BY ALL) h USING (cusip, quarter_id)""",
    "d_pairs": f"""
        SELECT n.manager_cik, o.quarter_id AS from_quarter_id, n.quarter_id AS to_quarter_id,
          CASE WHEN o.has_confidential_omission + n.has_confidential_omission > 0 THEN 1 ELSE 0 END
            AS has_confidential_omission
        FROM d_msum n JOIN d_msum o ON o.manager_cik = n.manager_cik AND o.quarter_id = {prev('n.quarter_id')}""",
    "d_sides": f"""
        SELECT {KEY}, p.from_quarter_id, p.to_quarter_id, p.has_confidential_omission AS hidden,
          MAX(CASE WHEN x.quarter_id = p.from_quarter_id THEN x.value_usd END) AS prior_value_usd,
          MAX(CASE WHEN x.quarter_id = p.to_quarter_id THEN x.value_usd END) AS current_value_usd,
          MAX(CASE WHEN x.quarter_id = p.from_quarter_id THEN x.reported_amount END) AS prior_reported_amount,
          MAX(CASE WHEN x.quarter_id = p.to_quarter_id THEN x.reported_amount END) AS current_reported_amount,
          MAX(x.quality_level) AS worst
        FROM d_pairs p JOIN d_pos x USING (manager_cik)
        WHERE x.quarter_id IN (p.from_quarter_id, p.to_quarter_id) GROUP BY ALL""",
    "d_chg": f"""
        SELECT {KEY}, from_quarter_id, to_quarter_id, prior_value_usd, current_value_usd,
          COALESCE(current_value_usd, 0) - COALESCE(prior_value_usd, 0) AS value_change_usd,
          prior_reported_amount, current_reported_amount,
          COALESCE(current_reported_amount, 0) - COALESCE(prior_reported_amount, 0) AS amount_change,
          {div('COALESCE(current_reported_amount, 0) - prior_reported_amount', 'prior_reported_amount')}
            AS amount_change_percent,
          CASE WHEN hidden = 1 THEN 'UNKNOWN' WHEN prior_reported_amount IS NULL THEN 'NEW'
            WHEN current_reported_amount IS NULL THEN 'EXITED'
            ELSE CASE SIGN(current_reported_amount - prior_reported_amount)
              WHEN 1 THEN 'ADDED' WHEN -1 THEN 'REDUCED' ELSE 'UNCHANGED' END END AS action,
          1 - hidden AS is_comparable,
          CASE hidden WHEN 1 THEN 'CONFIDENTIAL_OMISSION' END AS noncomparable_reason,
          {QUALITY.format('worst')} AS value_quality_status
        FROM d_sides""",
    "d_mact": f"""
        SELECT manager_cik, to_quarter_id AS quarter_id,
          {', '.join(f"COUNT(CASE action WHEN '{a.upper()}' THEN 1 END) AS {a}_count"
                     for a in ('new', 'added', 'reduced', 'exited'))},
          {big("SUM(CASE WHEN action IN ('ADDED', 'NEW') THEN value_change_usd ELSE 0 END)")} AS gross_buy_value_usd,
          {big("SUM(CASE WHEN action IN ('EXITED', 'REDUCED') THEN ABS(value_change_usd) ELSE 0 END)")}
            AS gross_sell_value_usd,
          {big('SUM(is_comparable * ABS(value_change_usd))')} AS gross_value_change_usd,
          {big('SUM(is_comparable * value_change_usd)')} AS net_value_change_usd
        FROM d_chg GROUP BY ALL""",
    "d_maa": f"""
        SELECT manager_cik, to_quarter_id AS quarter_id, action, COUNT(*) AS position_count,
          {big('SUM(COALESCE(current_value_usd, prior_value_usd))')} AS position_value_usd,
          {big('SUM(amount_change)')} AS amount_change, {big('SUM(value_change_usd)')} AS value_change_usd
        FROM d_chg GROUP BY ALL""",
    "d_sact": f"""
        SELECT cusip, to_quarter_id AS quarter_id,
          {', '.join(f"COUNT(DISTINCT CASE action WHEN '{a}' THEN manager_cik END) AS {n}_count" for a, n in
                     (('NEW', 'new_investor'), ('EXITED', 'exited_investor'), ('ADDED', 'added_holder'),
                      ('REDUCED', 'reduced_holder')))},
          {big('SUM(is_comparable * value_change_usd)')} AS net_value_change_usd
        FROM d_chg GROUP BY ALL""",
    "d_saa": f"""
        SELECT cusip, to_quarter_id AS quarter_id, action, COUNT(DISTINCT manager_cik) AS institution_count,
          {big('SUM(value_change_usd)')} AS value_change_usd
        FROM d_chg GROUP BY ALL""",
    "d_calendar": f"""
        SELECT q AS quarter_id, {label('q')} AS quarter_label, LAST_DAY(d) AS quarter_end_date,
          CAST(q // 100 AS INTEGER) AS year, CAST(q % 100 AS INTEGER) AS quarter_number,
          LAG(q) OVER (ORDER BY q) AS previous_quarter_id
        FROM (SELECT d, CAST(YEAR(d) * 100 + QUARTER(d) AS INTEGER) AS q
          FROM (SELECT CAST(UNNEST(GENERATE_SERIES(MIN(DATE_TRUNC('quarter', report_date)), MAX(report_date),
              INTERVAL 3 MONTH)) + INTERVAL 2 MONTH AS DATE) AS d FROM d_filings) s) t""",
    "d_roles": f"""
        SELECT {cik('cik')} AS cik, accession_number, 'FILING_MANAGER' AS relationship_type FROM r_submission
        UNION ALL SELECT {cik('cik')}, accession_number, 'OTHER_MANAGER' FROM r_othermanager
        UNION ALL SELECT {cik('cik')}, accession_number, 'INCLUDED_OTHER_MANAGER' FROM r_othermanager2""",
    "d_filer": f"""
        SELECT {cik('s.cik')} AS cik, c.*, s.filing_date, s.periodofreport,
          COUNT(*) OVER (PARTITION BY {cik('s.cik')}) AS submission_count
        FROM r_submission s JOIN r_coverpage c USING (accession_number)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY {cik('s.cik')} ORDER BY s.accession_number DESC) = 1""",
    "d_mentions": f"""
        SELECT {cik('cik')} AS cik, name, form13ffilenumber, crdnumber, secfilenumber, accession_number,
          1 AS priority, othermanager_sk AS source_key FROM r_othermanager
        UNION ALL
        SELECT {cik('cik')}, name, form13ffilenumber, NULL, NULL, accession_number, 2, sequencenumber
        FROM r_othermanager2""",
    "d_other": """
        SELECT cik, name, form13ffilenumber, crdnumber, secfilenumber, accession_number,
          COUNT(*) OVER (PARTITION BY cik) AS mention_count
        FROM d_mentions
        QUALIFY ROW_NUMBER() OVER (PARTITION BY cik
          ORDER BY accession_number DESC, priority, source_key DESC, name, form13ffilenumber) = 1""",
    "d_tickers": f"""
        SELECT {cik('cik')} AS cik, ARG_MIN(name, pos) AS sec_company_name,
          STRING_AGG(ticker, ', ' ORDER BY pos) AS ticker,
          STRING_AGG(COALESCE(exchange, ''), ', ' ORDER BY pos) AS exchange
        FROM r_listings GROUP BY 1""",
    "d_mgr": f"""
        SELECT k.cik, t.sec_company_name, COALESCE(f.filingmanager_name, o.name, t.sec_company_name) AS manager_name,
          t.ticker, t.exchange, f.filingmanager_street1, f.filingmanager_street2, f.filingmanager_city,
          f.filingmanager_stateorcountry, f.filingmanager_zipcode,
          COALESCE(f.form13ffilenumber, o.form13ffilenumber) AS form13ffilenumber,
          COALESCE(f.crdnumber, o.crdnumber) AS crdnumber,
          COALESCE(f.secfilenumber, o.secfilenumber) AS secfilenumber,
          CASE WHEN f.accession_number IS NULL OR o.accession_number > f.accession_number THEN o.accession_number
            ELSE f.accession_number END AS latest_related_accession_number,
          f.filing_date AS latest_filing_date, f.periodofreport AS latest_period_of_report,
          COALESCE(f.submission_count, 0) AS submission_count,
          COALESCE(o.mention_count, 0) AS other_manager_mention_count
        FROM (SELECT cik FROM d_roles UNION SELECT {cik('cik')} FROM r_listings) k
        LEFT JOIN d_filer f USING (cik) LEFT JOIN d_other o USING (cik) LEFT JOIN d_tickers t USING (cik)""",
    "d_listing": f"""
        SELECT {cik('l.cik')} AS cik, l.name AS sec_company_name, l.ticker, l.exchange, s.sic,
          s.sicdescription AS sic_description, v.division AS sic_major_group_division,
          CAST(NULL AS VARCHAR) AS sic_as_of_date,
          CASE WHEN s.cik IS NOT NULL THEN 'SEC_SUBMISSIONS_API' END AS sic_source
        FROM r_listings l LEFT JOIN r_sic s ON s.cik = l.cik
        LEFT JOIN c_division v ON TRY_CAST(SUBSTR(s.sic, 1, 2) AS INTEGER) BETWEEN v.lo AND v.hi""",
    "d_view": f"""
        SELECT p.manager_cik, p.quarter_id, p.cusip, p.security_type_id, p.option_type, p.amount_type,
          p.value_usd AS market_value_usd, p.reported_amount, p.portfolio_weight,
          COALESCE(x.action, 'UNCHANGED') AS action, x.amount_change, x.amount_change_percent, x.value_change_usd,
          x.is_comparable
        FROM d_pos p LEFT JOIN (SELECT * EXCLUDE (value_quality_status), to_quarter_id AS quarter_id FROM d_chg) x
          USING ({KEY}, quarter_id)
        UNION ALL
        SELECT manager_cik, to_quarter_id, {INSTRUMENT}, prior_value_usd, prior_reported_amount, NULL, action,
          amount_change, amount_change_percent, value_change_usd, is_comparable
        FROM d_chg WHERE current_reported_amount IS NULL""",
    "d_hist": f"""
        SELECT manager_cik, cusip, quarter_id, {label('quarter_id')} AS quarter_label,
          {big('SUM(value_usd)')} AS market_value_usd,
          CASE COUNT(DISTINCT amount_type) WHEN 1 THEN {big('SUM(reported_amount)')} END AS reported_amount,
          {big("SUM(reported_amount) FILTER (amount_type = 'SH')")} AS shares,
          {big("SUM(reported_amount) FILTER (amount_type = 'PRN')")} AS principal_amount,
          STRING_AGG(DISTINCT amount_type, ',' ORDER BY amount_type) AS amount_type,
          MAX(portfolio_weight) AS portfolio_weight, COALESCE(MAX(action), 'UNCHANGED') AS action,
          CASE COUNT(DISTINCT amount_type) WHEN 1 THEN {big('COALESCE(SUM(amount_change), 0)')} END AS amount_change,
          CASE COUNT(DISTINCT amount_type) WHEN 1 THEN MAX(amount_change_percent) END AS amount_change_percent,
          {big('COALESCE(SUM(value_change_usd), 0)')} AS value_change_usd
        FROM d_pos LEFT JOIN (SELECT {KEY}, to_quarter_id AS quarter_id, action, amount_change,
            amount_change_percent, value_change_usd FROM d_chg) c USING ({KEY}, quarter_id)
        GROUP BY ALL""",
}

_WORD = re.compile(r"\b[a-z]_[a-z0-9]+\b")


def _needed(text: str, found: dict[str, None]) -> None:
    for name in _WORD.findall(text):
        if name in CTES and name not in found:
            _needed(CTES[name], found)
            found[name] = None


def statement(query: str) -> str:
    found: dict[str, None] = {}
    _needed(query, found)
    if not found:
        return query
    return "WITH " + ",\n".join(f"{name} AS ({CTES[name]})" for name in found) + "\n" + query


def significant(query: str, *columns: str) -> str:
    """Doubles with nine significant digits, however small they are."""
    changes = ", ".join(f"CAST(PRINTF('%.8e', {c}) AS DOUBLE) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({changes}) FROM ({query}) q"
