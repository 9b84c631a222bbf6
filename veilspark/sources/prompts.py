"""What is said to a language model: one system text for each task, and the form of the answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.schema import CLASSIFY_WORDS, DOB_ANCHORS, DOCUMENT_TYPES, FIELD_TYPES

PLAIN = "Write plain lines only, nothing before or after them, no JSON and no explanation."
CLASSIFY = (
    "You are given the first lines of a scanned document. Name its type with one word of: " + ", ".join(DOCUMENT_TYPES) + ". "
    + " ".join(f"Signs of {k}: {', '.join(words)}." for k, words in CLASSIFY_WORDS.items()) + " Anything else is other."
)
DETECT = (
    "Each line you are given is one fragment of a scanned document, as `id: text`. Give every id one field type of: " + ", ".join(FIELD_TYPES) + ". "
    "A printed caption is label_text, and the value beside it is not. Only pay, on a row that speaks of pay, is salary_amount; all other money is other_amount. "
    "A date is date_of_birth only next to one of " + ", ".join(f"`{a}`" for a in DOB_ANCHORS) + "; other dates are transaction_date. "
    "Where a private type and other both seem possible, take the private one. You do not decide what is shown. "
    "Answer with a line `id: type` for each fragment, such as `a00: name`. What you leave out will be hidden. " + PLAIN
)
#: What else is said about documents of a type.
NOTES = {
    "bank_statement": "This is a bank statement: dates in its table are transaction_date, and the holder's own name is name.",
    "salary_slip": "This is a salary slip: dates of periods, joining and payment are transaction_date, and the employee's own name is name.",
    "marksheet": "This is a marksheet: dates of examinations and results are transaction_date; the student is name, a parent father_name.",
}
AUDIT = (
    "You are given a purpose and the fragments of a document that would be shown for it, as `id: text`. Flag each fragment that is private in itself: "
    "numbers of persons, accounts or cards, addresses, telephone numbers, e-mail addresses, birth dates, signatures, relatives. "
    "Captions, common words, amounts, other dates and names of employers or schools are not private. "
    "Answer with a line `FLAGGED: id, id` (`FLAGGED: none` if there is nothing) and a line `REASON: why`, with ids as given. " + PLAIN
)
WARM_UP = ("Answer in one short line.", "Say ready.")


def detect_system(document_type: Column) -> Column:
    """The system text of a document's detection, with the note on its type."""
    note = F.lit("")
    for name, text in NOTES.items():
        note = F.when(document_type == name, " " + text).otherwise(note)
    return F.concat(F.lit(DETECT), note)
