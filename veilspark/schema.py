"""Schemas of the engine's tables and the fixed values of its rules."""

from __future__ import annotations

FRAGMENTS = "doc_id string, seq int, frag_id string, text string, x int, y int, w int, h int, conf double, block_num int, par_num int, line_num int"
LABELS = "doc_id string, frag_id string, ftype string"
DECISIONS = "doc_id string, purpose string, frag_id string, outcome string, ordinal int"
REPLIES = "doc_id string, batch int, raw string"
RULES = "purpose string, ftype string, outcome string, critical boolean, reveal string, format string"

# They define the results.
FIELD_TYPES = (
    "name", "father_name", "address", "phone_number", "email", "date_of_birth", "transaction_date",
    "account_number", "ifsc_code", "aadhaar_number", "pan_number", "voter_id_number", "salary_amount",
    "other_amount", "employer_name", "designation", "pf_number", "institution_name", "qualification",
    "cgpa_or_marks", "roll_number", "category", "transaction_line", "signature_marker", "photo_marker",
    "label_text", "remarks", "other",
)
DOCUMENT_TYPES = ("bank_statement", "pan_card", "salary_slip", "marksheet", "aadhaar_card", "voter_id", "other")
#: PII patterns in their order of precedence; \b, \d and \w are Unicode-aware ((?U)).
PATTERNS = {
    "aadhaar": r"\b\d{4}\s?\d{4}\s?\d{4}\b",
    "pan": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "phone": r"\b[6-9]\d{9}\b",
    "ifsc": r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
    "long_digits": r"\b\d{10,19}\b",
    "email": r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b",
}
CONTEXT_DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
DOB_ANCHORS = ("DATE OF BIRTH", "D.O.B", "DOB", "BIRTH DATE", "BIRTH", "जन्म", "जन्म की तारीख")
SALARY_ANCHORS = ("SALARY CREDIT", "SALARY", "GROSS", "NET PAY", "NET SALARY", "BASIC", "EARNINGS", "CTC")
NAME_ANCHORS = ("ACCOUNT HOLDER", "EMPLOYEE NAME", "CUSTOMER NAME", "ACCOUNT NAME")
THIRD_PARTY = ("FATHER", "MOTHER", "SPOUSE", "GUARDIAN", "NOMINEE")
TXN_HINTS = ("PURCHASE", "PAYMENT", "UPI/", "NEFT/", "IMPS/", "ATM/", "DEBIT", "CREDIT", "TXN", "WITHDRAWAL", "DEPOSIT")
REPAIR_AMOUNT = r"^[₹$]?[\d,]+(\.\d+)?$"
REPAIR_NAME = r"^[A-Za-z][A-Za-z.'-]*$"
MONEY = r"^[₹$]?\d[\d,]*(\.\d{1,2})?$"
LEDGER_DATE = r"^\d{1,2}[-/][A-Za-z0-9]{1,3}[-/]\d{2,4}$"
LABEL_PHRASE = (
    "FATHER", "FATHERS", "MOTHER", "MOTHERS", "SPOUSE", "SPOUSES", "GUARDIAN", "GUARDIANS", "NOMINEE", "NAME",
    "RELATION", "S/O", "D/O", "W/O", "SON", "DAUGHTER", "WIFE", "HUSBAND", "PHOTO", "ADDRESS", "OF", "NO",
    "NUMBER", "CARD", "IDENTITY", "ELECTOR", "ELECTORS",
)
#: Label groups in their order: the first that a row holds decides.
VALUE_LABELS = (
    (("PERMANENT ACCOUNT NUMBER", "PAN NO", "PAN NUMBER"), "pan_number"),
    (("AADHAAR", "AADHAR", "UIDAI"), "aadhaar_number"),
    (("ELECTOR'S PHOTO IDENTITY CARD", "VOTER ID", "EPIC"), "voter_id_number"),
    (("ADDRESS",), "address"),
    (("CATEGORY", "CASTE"), "category"),
)
RETYPEABLE = ("label_text", "other", "account_number", "ifsc_code", "phone_number", "pf_number", "roll_number", "aadhaar_number", "pan_number", "voter_id_number")
NO_FLAG_WORDS = ("none", "n/a", "na", "no", "nothing", "nil", "-", "[]", "{}", "no ids")
#: Tell-tale words of document types, as they are: a model is told the same.
CLASSIFY_WORDS = {
    "bank_statement": ("account number", "ifsc", "branch", "statement period", "balance"),
    "pan_card": ("permanent account number", "father's name", "income tax"),
    "salary_slip": ("basic", "hra", "gross", "net pay", "deductions", "employee code"),
    "marksheet": ("semester", "grade", "cgpa", "roll number", "university"),
    "aadhaar_card": ("aadhaar", "uidai", "vid"),
    "voter_id": ("elector", "epic", "constituency"),
}
LABEL_LINE = r"^[\s>*#`\-–—•]*(?:\d+[.)]\s*)?[`*_]*([A-Za-z][A-Za-z0-9]{1,3})[`*_]*\s*(?:[:=]|->|→)\s*(.+?)[\s.,;`*_]*$"
AUDIT_LINE = r"^[\s>*#`\-–—•]*([A-Z]+)\s*[:=]\s*(.*)$"
ROW_RATIO = 0.6
LINE_FLOOR, NEAR_RATIO, NEAR_FLOOR = 6, 2.5, 30
MIN_CONF, MIN_SIDE, MAX_SIDE, PADDING, MIN_HIDDEN, MIN_PREFIX, BATCH, CLASSIFY_LINES = 30, 1000, 3500, 5, 4, 4, 40, 60
