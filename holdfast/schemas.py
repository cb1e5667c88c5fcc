"""Raw table schemas and the fixed reference data of the holdings domain."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, INT, LONG = T.StringType(), T.IntegerType(), T.LongType()


def _schema(*columns: str, **numbers: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(c, numbers.get(c, TEXT)) for c in columns])


# Column order is the header order of the published tab-separated files.
RAW_SCHEMAS: dict[str, T.StructType] = {
    "submission": _schema("accession_number", "filing_date", "submissiontype", "cik", "periodofreport"),
    "coverpage": _schema(
        "accession_number", "reportcalendarorquarter", "isamendment", "amendmentno", "amendmenttype",
        "confdeniedexpired", "datedeniedexpired", "datereported", "reasonfornonconfidentiality",
        "filingmanager_name", "filingmanager_street1", "filingmanager_street2", "filingmanager_city",
        "filingmanager_stateorcountry", "filingmanager_zipcode", "reporttype", "form13ffilenumber",
        "crdnumber", "secfilenumber", "provideinfoforinstruction5", "additionalinformation",
        amendmentno=INT,
    ),
    "othermanager": _schema(
        "accession_number", "othermanager_sk", "cik", "form13ffilenumber", "crdnumber", "secfilenumber", "name",
        othermanager_sk=LONG,
    ),
    "signature": _schema(
        "accession_number", "name", "title", "phone", "signature", "city", "stateorcountry", "signaturedate",
    ),
    "summarypage": _schema(
        "accession_number", "otherincludedmanagerscount", "tableentrytotal", "tablevaluetotal",
        "isconfidentialomitted",
        otherincludedmanagerscount=INT, tableentrytotal=INT, tablevaluetotal=LONG,
    ),
    "othermanager2": _schema(
        "accession_number", "sequencenumber", "cik", "form13ffilenumber", "crdnumber", "secfilenumber", "name",
        sequencenumber=INT,
    ),
    "infotable": _schema(
        "accession_number", "infotable_sk", "nameofissuer", "titleofclass", "cusip", "figi", "value", "sshprnamt",
        "sshprnamttype", "putcall", "investmentdiscretion", "othermanager", "voting_auth_sole",
        "voting_auth_shared", "voting_auth_none",
        infotable_sk=LONG, value=LONG, sshprnamt=LONG, voting_auth_sole=LONG, voting_auth_shared=LONG,
        voting_auth_none=LONG,
    ),
}
RAW_TABLES = tuple(RAW_SCHEMAS)

# Text columns in which an as-filed blank stays a blank instead of becoming NULL.
KEEP_BLANK = {"infotable": {"nameofissuer"}}

INSTRUMENT_KEY = ["cusip", "security_type_id", "option_type", "amount_type"]
RELATIONSHIP_KEY = ["manager_cik", *INSTRUMENT_KEY]
MANAGER_QUARTER = ["manager_cik", "quarter_id"]
SECURITY_QUARTER = ["cusip", "quarter_id"]

# ---- fixed values -----------------------------------------------------------
# First filing date on which reported values are whole dollars, not thousands.
DOLLAR_VALUES_FROM = "2023-01-03"

ACTIONS = ("NEW", "ADDED", "REDUCED", "EXITED", "UNCHANGED", "UNKNOWN")
COMPONENT_KINDS = ("BASE", "RESTATEMENT", "ADDITION", "UNKNOWN", "EXCLUDE")
RESOLUTIONS = ("RESOLVED", "REVIEW_REQUIRED", "INCOMPLETE_HISTORY")
QUALITY_STATUSES = ("OK", "ROUNDING_DIFFERENCE", "ISSUE")

COMMON, ETF, CALL, PUT, DEBT, UNCLASSIFIED = 1, 2, 5, 6, 7, 99

# id, code, label, counted as a core holding
SECURITY_TYPES = [
    (1, "COMMON_STOCK", "Common Stock", 1),
    (2, "ETF", "Exchange-Traded Fund", 1),
    (3, "ADR", "Depositary Receipt", 0),
    (4, "PREFERRED_STOCK", "Preferred Stock", 0),
    (5, "OPTION_CALL", "Call Option", 0),
    (6, "OPTION_PUT", "Put Option", 0),
    (7, "DEBT_BOND", "Debt or Principal Amount", 0),
    (8, "CONVERTIBLE", "Convertible Security", 0),
    (9, "FUND_OTHER", "Other Fund", 0),
    (99, "UNKNOWN", "Unknown", 0),
]
SECURITY_TYPE_COLUMNS = ("security_type_id", "security_type_code", "security_type_name", "include_in_core_holdings")

# rule id, priority, field, match type, pattern, security type id
CLASS_RULES = [
    (1, 10, "titleofclass", "REGEX", r"\b(ADR|ADS|DEPOSITARY|DEPOSITORY|N Y REGISTRY)\b", 3),
    (2, 20, "titleofclass", "REGEX", r"\b(PFD|PREFERRED|PREF SH|PREFERENCE)\b", 4),
    (3, 30, "titleofclass", "REGEX", r"\b(CONV|CONVERTIBLE|CVT)\b", 8),
    (4, 40, "titleofclass", "REGEX", r"\bETF\b|EXCHANGE[\s-]?TRADED|UIT EXCHANGE", 2),
    (5, 50, "nameofissuer", "REGEX",
     r"^(ISHARES|SPDR|PROSHARES|DIREXION|GLOBAL X|ARK ETF|FIRST TR EXCHANGE|INVESCO EXCH|WISDOMTREE)", 2),
    (6, 60, "titleofclass", "REGEX", r"^(FUND|CEF|MF CLOSED AND MF OPEN)$", 9),
    (7, 100, "titleofclass", "REGEX",
     r"^(COM|COMMON|COMMON STOCKS?|COMMON SHARES?|COM NEW|CMN|STOCK|COM CL [A-Z]|CL [A-Z] COM|CLASS [A-Z] COM|"
     r"COM SHS|COM STK|COMM STK|COMMON / ORDINARY STOCK|ORD|ORD SHS|ORDINARY SHARES|COMMON EQUITY SHARES|EQUITY|"
     r"EQUITIES|CS|SC|CL [A-Z]( NEW)?|CAP STK CL [A-Z]|COM SER [A-Z]|REIT)$", 1),
]

# first and last two-digit major group, division name (1987 SIC manual)
SIC_DIVISIONS = [
    (1, 9, "Agriculture, Forestry, and Fishing"),
    (10, 14, "Mining"),
    (15, 17, "Construction"),
    (20, 39, "Manufacturing"),
    (40, 49, "Transportation, Communications, Electric, Gas, and Sanitary Services"),
    (50, 51, "Wholesale Trade"),
    (52, 59, "Retail Trade"),
    (60, 67, "Finance, Insurance, and Real Estate"),
    (70, 89, "Services"),
    (91, 99, "Public Administration"),
]
SIC_SOURCE = "SEC_SUBMISSIONS_API"
