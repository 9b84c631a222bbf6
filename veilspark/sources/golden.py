"""Small layouts as literal tables, for both Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (document, character width, height, rows of (y, tokens)); words are 8 apart from x = 10 on.
LAYOUTS = (
    ("statement", 9, 18, ((10, "Account Holder: ARJUN MEHTA"), (40, "02-Apr-2026 SALARY CREDIT - INFOTECH SOLUTIONS PVT LTD 85,000.00"), (70, "15-Apr-2026 Card Purchase BIGBASKET 3,214.00"), (100, "Closing Balance: INR 3,42,118.00"))),
    ("pan", 9, 18, ((10, "Name PHOTO"), (40, "ARJUN MEHTA"), (70, "Father's Name"), (100, "RAKESH MEHTA"), (130, "Permanent Account Number"), (160, "ABCDE1234F"), (190, "Date of Birth"), (220, "14/08/1999"))),
    ("slip", 9, 18, ((10, "Employee Name: ARJUN MEHTA Employee ID: EMP20451"), (40, "GROSS SALARY 85,000"), (70, "PF KA/BNG/204518/000 A/c 5010023456789012"))),
    ("voter", 9, 18, ((10, "Elector's Photo Identity Card"), (40, "Elector's Name"), (70, "ARJUN MEHTA"), (100, "Elector's Photo Identity Card No."), (130, "ABC1234567"), (160, "Address"), (190, "Flat 12, MG Road, Bengaluru 560034"), (220, "Mother: SITA MEHTA"))),
    ("amount", 10, 20, ((10, "02-Apr-2026 SALARY CREDIT 85,000.00"), (40, "05-Apr-2026 UPI/REF/982134/Rent Payment 24,500.00"), (70, "Closing Balance: INR 3,42,118.00"), (100, "Gross Salary 1,23,456.00"))),
    ("dates", 10, 20, ((10, "02-Apr-2026 SALARY CREDIT 85,000.00"), (40, "05-Apr-2026 UPI/REF/982134/Rent 24,500.00"), (70, "Date of Birth 14/08/1999"), (100, "Statement Period: 01-Apr-2026 30-Jun-2026"))),
    ("marksheet", 10, 20, ((10, "BENGALURU University Semester 4"), (40, "Roll Number 2023CS1042"), (70, "Category GENERAL"), (100, "CGPA 8.72 Mobile 9812345670"), (400, "DOB"), (435, "14/08/1999"), (600, "22/09/2026 arjun@example.com"))),
)
#: (document, text, x, y, w, h): layouts that are told by their geometry.
PLACED = (
    ("merchant", "MERCHANT", 10, 100, 80, 20), ("merchant", "500.00", 500, 111, 60, 20),
    ("columns", "Card", 10, 100, 40, 20), ("columns", "Purchase", 90, 100, 80, 20), ("columns", "BIGBASKET", 260, 100, 90, 20),
    ("sizes", "Date", 10, 100, 40, 14), ("sizes", "value", 120, 96, 50, 30),
    ("drift", "A", 10, 100, 10, 20), ("drift", "B", 100, 108, 10, 20), ("drift", "C", 200, 116, 10, 20), ("drift", "D", 300, 124, 10, 20), ("drift", "E", 400, 124, 10, 40),
    ("aadhaar", "ARJUN", 10, 10, 50, 30), ("aadhaar", "MEHTA", 90, 10, 50, 30), ("aadhaar", "Aadhaar", 10, 50, 70, 30), ("aadhaar", "1234 5678 9012", 110, 50, 140, 30),
    ("aadhaar", "Flat", 10, 90, 40, 30), ("aadhaar", "MG", 60, 90, 20, 30), ("aadhaar", "Road", 100, 90, 40, 30), ("aadhaar", "9876543210", 10, 130, 100, 30),
)


def rows() -> list[tuple]:
    """(doc_id, seq, frag_id, text, x, y, w, h, conf) of all layouts."""
    out, seqs = [], {}
    for doc, char, height, lines in LAYOUTS:
        for y, tokens in lines:
            x = 10
            for t in tokens.split(" "):
                k = seqs[doc] = seqs.get(doc, -1) + 1
                out.append((doc, k, f"w{k:04d}", t, x, y, char * len(t), height, 96.0))
                x += char * len(t) + 8
    for doc, t, x, y, w, h in PLACED:
        k = seqs[doc] = seqs.get(doc, -1) + 1
        out.append((doc, k, f"w{k:04d}", t, x, y, w, h, 96.0))
    return out


def golden(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "doc_id string, seq int, frag_id string, text string, x int, y int, w int, h int, conf double")


def sql_value(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(sql_value, v)) + "]"
    return str(v).lower() if isinstance(v, bool) else str(v)


def values(table: list[tuple], names: str) -> str:
    """A SELECT over literal rows."""
    body = ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in table)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


GOLDEN_SQL = f"frags AS ({values([r[:8] for r in rows()], 'doc_id, seq, frag_id, text, x, y, w, h')})"
