"""Column functions over fragment texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.schema import FIELD_TYPES, LABEL_PHRASE, LEDGER_DATE, MIN_HIDDEN, MIN_PREFIX, MONEY, PATTERNS

UNICODE = "(?U)"
#: Short ids of one batch, a00 to z25.
MOST_IDS = 26 * 26


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(UNICODE + pattern)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def label_word(text: Column) -> Column:
    """Upper-case letters A to Z of a text, for comparison with label phrases."""
    return F.regexp_replace(F.upper(text), "[^A-Z]", "")


def is_label_phrase(word: Column) -> Column:
    return word.isin(*LABEL_PHRASE)


def is_money(text: Column) -> Column:
    return matches(strip(text), MONEY)


def is_ledger_date(text: Column) -> Column:
    return matches(strip(text), LEDGER_DATE)


def may_hit(text: Column) -> Column:
    """What every pattern needs, a digit or an at sign: one cheap look spares most texts the patterns."""
    return matches(text, r"[\d@]")


def pii_hits(text: Column) -> Column:
    """array<struct<rank, pattern, matched_text>> of the patterns that a text matches, in order."""
    each = [F.struct(F.lit(i).alias("rank"), F.lit(name).alias("pattern"), F.regexp_extract(text, UNICODE + p, 0).alias("matched_text")) for i, (name, p) in enumerate(PATTERNS.items())]
    none = F.array().cast("array<struct<rank:int,pattern:string,matched_text:string>>")
    return F.when(may_hit(text), F.filter(F.array(*each), lambda s: s["matched_text"] != "")).otherwise(none)


def mask_spec(reveal: Column, template: Column) -> Column:
    """struct<side, shown, place> of a partial spec, or null if it could reveal too much.

    reveal is 'firstN' or 'lastN'; the template has exactly one placeholder, of the
    same side and number, and besides it no letter or digit but X."""
    side = F.regexp_extract(F.lower(reveal), r"^(first|last)(\d{1,9})$", 1)
    shown = F.regexp_extract(F.lower(reveal), r"^(first|last)(\d{1,9})$", 2).try_cast("int")
    place = F.concat(F.lit("{"), side, shown.cast("string"), F.lit("}"))
    one = F.regexp_count(template, F.lit(r"\{[^{}]*\}")) == 1
    rest = F.regexp_replace(template, r"\{[^{}]*\}", "")
    return F.when((shown > 0) & one & template.contains(place) & ~rest.rlike("[A-WYZa-wyz0-9]"), F.struct(side.alias("side"), shown.alias("shown"), place.alias("place")))


def masked(text: Column, spec: Column, template: Column) -> Column:
    """The mask of a value by a spec; null if fewer than MIN_HIDDEN + 1 characters would stay hidden."""
    raw = strip(text)
    part = F.when(spec["side"] == "last", F.right(raw, spec["shown"])).otherwise(F.left(raw, spec["shown"]))
    return F.when(F.length(raw) > spec["shown"] + MIN_HIDDEN, F.replace(template, spec["place"], part))


def mask_value(text: Column, reveal: Column, template: Column) -> Column:
    """A partial mask, or null wherever a mask could reveal too much."""
    return masked(text, mask_spec(reveal, template), template)


def match_type(token: Column) -> Column:
    """A model's type token as a field type, else null: exact, else the longest type
    that it contains, else the only type that it begins (MIN_PREFIX letters or more)."""
    t = F.lower(F.regexp_replace(strip(token), "^[`*_\"'.]+|[`*_\"'.]+$", ""))
    by_length = sorted(FIELD_TYPES, key=lambda x: -len(x))
    contained = F.lit(None).cast("string")
    for name in reversed(by_length):
        contained = F.when(t.contains(name), name).otherwise(contained)
    begun = F.filter(F.array(*[F.lit(x) for x in by_length]), lambda x: x.startswith(t))
    unique = F.when((F.length(t) >= MIN_PREFIX) & (F.size(begun) == 1), F.get(begun, F.lit(0)))
    return F.when(t == "", None).when(t.isin(*FIELD_TYPES), t).otherwise(F.coalesce(contained, unique))


def short_id(index: Column) -> Column:
    """a00, a01, … z25 for 0 to 675; null beyond, where the code ends."""
    return F.when(index < MOST_IDS, F.concat(F.char(97 + F.floor(index / 26)), F.lpad((index % 26).cast("string"), 2, "0")))


def clean_ids(ids: Column) -> Column:
    """Stripped, lower-case, without empty ones and repeats, in order; null is empty."""
    tidy = F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda x: F.lower(strip(x)))
    return F.array_distinct(F.filter(tidy, lambda x: x != ""))


def rule_label(text: Column) -> Column:
    """A deterministic, deliberately noisy labeler: every amount is a salary, every date
    a birth date, every capitalised word a name. The anchor rules correct it."""
    t = strip(text)
    return (
        F.when(is_money(text) & ~t.rlike("^[0-9]{10,}$"), "salary_amount")
        .when(is_ledger_date(text), "date_of_birth")
        .when(t.rlike("^[6-9][0-9]{9}$"), "phone_number")
        .when(t.rlike("^[0-9]{10,19}$"), "account_number")
        .when(t.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), "ifsc_code")
        .when(t.rlike(r"^[A-Za-z0-9.+_-]+@[A-Za-z0-9.-]+$"), "email")
        .when(t.rlike(":$") | is_label_phrase(label_word(text)), "label_text")
        .when(t.rlike("^[A-Z][A-Za-z.'-]+$"), "name")
        .otherwise("other")
    )
