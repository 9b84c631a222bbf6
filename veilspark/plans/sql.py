"""The plan's steps in SQL, as lists of common table expressions.

`frags` comes first (LEDGER_SQL or GOLDEN_SQL); every step builds on the ones before."""

from __future__ import annotations

import json
import re

from veilspark.plans.presets import BUILT_IN
from veilspark.schema import (
    CONTEXT_DATE,
    DOB_ANCHORS,
    FIELD_TYPES,
    LABEL_PHRASE,
    LEDGER_DATE,
    LINE_FLOOR,
    MIN_HIDDEN,
    MONEY,
    NAME_ANCHORS,
    NEAR_FLOOR,
    NEAR_RATIO,
    PATTERNS,
    REPAIR_AMOUNT,
    REPAIR_NAME,
    RETYPEABLE,
    ROW_RATIO,
    SALARY_ANCHORS,
    THIRD_PARTY,
    TXN_HINTS,
    VALUE_LABELS,
)
from veilspark.sources.golden import sql_value, values


def any_of(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, {sql_value(w)})" for w in words) + ")"


def listed(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(sql_value, words)) + ")"


def word(text: str) -> str:
    return f"regexp_replace(upper({text}), '[^A-Z]', '', 'g')"


def found(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {sql_value(pattern)})"


RULE_LABEL = f"""CASE
  WHEN {found("text", MONEY)} AND NOT {found("text", "^[0-9]{10,}$")} THEN 'salary_amount'
  WHEN {found("text", LEDGER_DATE)} THEN 'date_of_birth'
  WHEN {found("text", "^[6-9][0-9]{9}$")} THEN 'phone_number'
  WHEN {found("text", "^[0-9]{10,19}$")} THEN 'account_number'
  WHEN {found("text", "^[A-Z]{5}[0-9]{4}[A-Z]$")} THEN 'ifsc_code'
  WHEN {found("text", r"^[A-Za-z0-9.+_-]+@[A-Za-z0-9.-]+$")} THEN 'email'
  WHEN {found("text", ":$")} OR {word("text")} IN {listed(LABEL_PHRASE)} THEN 'label_text'
  WHEN {found("text", "^[A-Z][A-Za-z.'-]+$")} THEN 'name'
  ELSE 'other' END"""

ROWS = f"""
centred AS (SELECT *, y + h / 2 AS c FROM frags),
broken AS (SELECT *, CASE WHEN abs(c - lag(c) OVER o) > greatest(h, lag(h) OVER o) * {ROW_RATIO}::DOUBLE THEN 1 ELSE 0 END AS brk FROM centred WINDOW o AS (PARTITION BY doc_id ORDER BY c, seq)),
rowed AS (SELECT * EXCLUDE (brk), CAST(sum(brk) OVER (PARTITION BY doc_id ORDER BY c, seq) AS INT) AS row_no FROM broken),
heights AS (SELECT doc_id, list_sort(list(h))[len(list(h)) // 2 + 1] AS med FROM frags GROUP BY doc_id)"""

FLAGS = f"""
row_base AS (SELECT doc_id, row_no, upper(string_agg(text, ' ' ORDER BY x, c, seq)) AS row_text, avg(c) AS row_centre, min(x) AS row_x0, max(x + w) AS row_x1, bool_or({found("text", MONEY)}) AS row_money, bool_or({found("text", LEDGER_DATE)}) AS row_dated FROM rowed GROUP BY doc_id, row_no),
row_flags AS (SELECT *, {any_of("row_text", TXN_HINTS)} AS row_hinted, {any_of("row_text", SALARY_ANCHORS)} AS row_salary, {any_of("row_text", NAME_ANCHORS)} AS row_holder, {any_of("row_text", THIRD_PARTY)} AS row_third_party, {any_of("row_text", DOB_ANCHORS)} AS row_dob FROM row_base),
wide AS (SELECT r.*, f.* EXCLUDE (doc_id, row_no), {RULE_LABEL} AS t0 FROM rowed r JOIN row_flags f USING (doc_id, row_no))"""


def _grp() -> str:
    return "CASE " + " ".join(f"WHEN {any_of('row_text', a)} THEN {i}" for i, (a, _) in enumerate(VALUE_LABELS)) + " END"


def _inside() -> str:
    cases = []
    for i, (anchors, _) in enumerate(VALUE_LABELS):
        letters = ["".join(ch for ch in a if "A" <= ch <= "Z") for a in anchors]
        cases.append(f"(grp = {i} AND ({' OR '.join(f'contains({sql_value(x)}, word)' for x in letters)}))")
    return " OR ".join(cases)


VALUES = f"""
titles AS (SELECT doc_id, row_no AS title_no, {_grp()} AS grp, row_centre AS tc, row_x0 AS tx0, row_x1 AS tx1, greatest(med * {NEAR_RATIO}::DOUBLE, {NEAR_FLOOR}) AS reach FROM row_flags JOIN heights USING (doc_id) WHERE {_grp()} IS NOT NULL),
met AS (SELECT w.doc_id, w.row_no, w.frag_id, w.seq, w.x, w.c, {word("w.text")} AS word, t.*  EXCLUDE (doc_id), w.row_no - t.title_no AS off, abs(t.tc - w.row_centre) <= t.reach AS is_near, (w.row_x0 < t.tx1 AND t.tx0 < w.row_x1) AS laps FROM wide w JOIN titles t ON w.doc_id = t.doc_id AND w.row_no BETWEEN t.title_no AND t.title_no + 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, title_no, row_no ORDER BY x, c, seq) AS i, (word <> '' AND (word IN {listed(LABEL_PHRASE)} OR {_inside()})) AS is_label FROM met),
after AS (SELECT *, i > coalesce(max(CASE WHEN is_label THEN i END) OVER (PARTITION BY doc_id, title_no, row_no), 0) AS is_value, coalesce(min(CASE WHEN off = 1 THEN is_near::INT END) OVER (PARTITION BY doc_id, title_no), 1) AS goes_on FROM numbered),
fitting AS (SELECT *, is_value AND (off = 0 OR (is_near AND laps)) AND (off < 2 OR goes_on = 1) AS fits FROM after),
best AS (SELECT *, min(CASE WHEN fits THEN off END) OVER (PARTITION BY doc_id, title_no) AS best_off FROM fitting),
forced AS (SELECT doc_id, frag_id, arg_min([{", ".join(sql_value(t) for _, t in VALUE_LABELS)}][grp + 1], title_no) AS forced FROM best WHERE fits AND off = best_off GROUP BY ALL)"""

ANCHORS = f"""
t_value AS (SELECT w.*, CASE WHEN forced IS NOT NULL AND t0 IN {listed(RETYPEABLE)} THEN forced ELSE t0 END AS t1 FROM wide w LEFT JOIN forced USING (doc_id, frag_id)),
t_amount AS (SELECT *, CASE WHEN t1 = 'salary_amount' AND NOT row_salary THEN 'other_amount' ELSE t1 END AS t2 FROM t_value),
t_name AS (SELECT *, CASE WHEN t2 = 'name' AND row_money AND (row_dated OR row_hinted) THEN 'other' ELSE t2 END AS t3 FROM t_amount),
own AS (SELECT *, t3 = 'name' AND row_third_party AND {word("text")} NOT IN {listed(LABEL_PHRASE)} AS is_own FROM t_name),
bare AS (SELECT doc_id, row_no + 1 AS row_no FROM own GROUP BY doc_id, row_no HAVING bool_or(row_third_party) AND NOT bool_or(is_own)),
t_third AS (SELECT o.*, CASE WHEN is_own OR (t3 = 'name' AND b.row_no IS NOT NULL) THEN 'father_name' ELSE t3 END AS t4 FROM own o LEFT JOIN bare b USING (doc_id, row_no)),
typed AS (SELECT *, CASE WHEN t4 = 'date_of_birth' AND NOT row_dob AND (row_dated OR row_hinted) THEN 'transaction_date' ELSE t4 END AS ftype FROM t_third)"""


def rule_rows() -> list[tuple]:
    """(purpose, ftype, outcome, critical, reveal, format) of the built-in presets."""
    out = []
    for purpose, p in json.loads(BUILT_IN.read_text(encoding="utf-8")).items():
        partial = p.get("partial_types", {})
        for t in dict.fromkeys([*p["keep_types"], *p["redact_types"], *p["purpose_critical_types"], *partial]):
            outcome = "partial" if t in partial else "keep" if t in p["keep_types"] and t not in p["redact_types"] else "redact"
            out.append((purpose, t, outcome, t in p["purpose_critical_types"], partial.get(t, {}).get("reveal"), partial.get(t, {}).get("format")))
    return out


RULES = f"rules AS ({values(rule_rows(), 'purpose, ftype, outcome, critical, reveal, format')}), purposes AS (SELECT DISTINCT purpose FROM rules)"
TYPES = f"types AS ({values([(t,) for t in FIELD_TYPES], 'ftype')})"


def mask(text: str, reveal: str, template: str) -> str:
    """The mask of a value in SQL: the same guards, for texts without outer white space but spaces."""
    raw, n = f"trim({text})", f"TRY_CAST(regexp_extract(lower({reveal}), '^(first|last)([0-9]{{1,9}})$', 2) AS INT)"
    side = f"regexp_extract(lower({reveal}), '^(first|last)([0-9]{{1,9}})$', 1)"
    place = f"'{{' || {side} || {n} || '}}'"
    one = f"len(regexp_extract_all({template}, '\\{{[^{{}}]*\\}}')) = 1"
    rest = f"NOT regexp_matches(regexp_replace({template}, '\\{{[^{{}}]*\\}}', '', 'g'), '[A-WYZa-wyz0-9]')"
    return f"CASE WHEN {raw} <> '' AND {n} > 0 AND length({raw}) > {n} + {MIN_HIDDEN} AND {one} AND contains({template}, {place}) AND {rest} THEN replace({template}, {place}, CASE {side} WHEN 'last' THEN right({raw}, {n}) ELSE left({raw}, {n}) END) END"


POLICY = f"""
looked AS (SELECT t.*, p.purpose, coalesce(r.outcome, 'redact') AS asked, coalesce(r.critical, false) AS critical, CASE WHEN r.outcome = 'partial' THEN {mask("t.text", "r.reveal", "r.format")} END AS mask FROM typed t CROSS JOIN purposes p LEFT JOIN rules r ON r.purpose = p.purpose AND r.ftype = t.ftype),
policed AS (SELECT *, CASE WHEN asked = 'partial' AND mask IS NULL THEN 'redact' ELSE asked END AS outcome0, asked = 'partial' AND mask IS NULL AS unmaskable FROM looked)"""



def lines(source: str, out: str, keys: str = "doc_id") -> str:
    """`out`: (keys, frag_id, line_no) of the fragments in `source`, folded over their
    distinct centres in order, as operators.layout.with_lines has it."""
    same = " AND ".join(f"o.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"o.{k.strip()}" for k in keys.split(","))
    joins = "abs(o.lc - f.s / f.n) <= o.tol"
    return f"""
{out}_h AS (SELECT {keys}, list_sort(list(h))[len(list(h)) // 2 + 1] AS lmed FROM {source} GROUP BY ALL),
{out}_c AS MATERIALIZED (SELECT {keys}, lc, tol, n, row_number() OVER (PARTITION BY {keys} ORDER BY lc) AS i FROM (SELECT {keys}, (y + h / 2)::DOUBLE AS lc, greatest(any_value(lmed) / 2, {LINE_FLOOR}) AS tol, count(*) AS n FROM {source} JOIN {out}_h USING ({keys}) GROUP BY {keys}, (y + h / 2)::DOUBLE)),
{out}_fold AS (SELECT {keys}, i, lc, lc * n AS s, n, 0 AS line_no FROM {out}_c WHERE i = 1
  UNION ALL SELECT {own}, o.i, o.lc, CASE WHEN {joins} THEN f.s ELSE 0 END + o.lc * o.n, CASE WHEN {joins} THEN f.n ELSE 0 END + o.n, f.line_no + CASE WHEN {joins} THEN 0 ELSE 1 END FROM {out}_fold f JOIN {out}_c o ON {same} AND o.i = f.i + 1),
{out} AS MATERIALIZED (SELECT {keys}, frag_id, line_no FROM {source} s JOIN {out}_fold USING ({keys}) WHERE (s.y + s.h / 2)::DOUBLE = {out}_fold.lc)"""


PATTERN_TABLE = "CASE " + " ".join(f"WHEN {found('text', p)} THEN {sql_value(k)}" for k, p in PATTERNS.items()) + " END"
NETS = f"""{lines("frags", "lined")},
line_base AS (SELECT doc_id, line_no, upper(string_agg(text, ' ' ORDER BY x, c, seq)) AS line_text, avg(c) AS line_centre FROM rowed JOIN lined USING (doc_id, frag_id) GROUP BY doc_id, line_no),
line_next AS (SELECT doc_id, line_no, line_text, line_centre, lag(line_centre) OVER o AS up, lead(line_centre) OVER o AS down, greatest(med * {NEAR_RATIO}::DOUBLE, {NEAR_FLOOR}) AS reach FROM line_base JOIN heights USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
dob AS (SELECT * FROM line_next WHERE {any_of("line_text", DOB_ANCHORS)}),
regions AS (SELECT doc_id, line_no FROM dob UNION ALL SELECT doc_id, line_no - 1 FROM dob WHERE abs(line_centre - up) <= reach UNION ALL SELECT doc_id, line_no + 1 FROM dob WHERE abs(line_centre - down) <= reach),
context AS (SELECT r.doc_id, r.frag_id, regexp_extract(r.text, {sql_value(CONTEXT_DATE)}) AS matched_text FROM rowed r JOIN lined USING (doc_id, frag_id) JOIN regions g USING (doc_id, line_no) WHERE {found("r.text", CONTEXT_DATE)}),
single AS (SELECT doc_id, frag_id, {PATTERN_TABLE} AS pattern FROM rowed WHERE {PATTERN_TABLE} IS NOT NULL),
nets AS (SELECT r.doc_id, r.frag_id, s.pattern AS one, CASE WHEN c.frag_id IS NOT NULL THEN 'date_of_birth' END AS two FROM rowed r LEFT JOIN single s USING (doc_id, frag_id) LEFT JOIN (SELECT DISTINCT doc_id, frag_id FROM context) c USING (doc_id, frag_id))"""

DECIDED = f"""
netted AS (SELECT p.*, CASE outcome0 WHEN 'keep' THEN coalesce(one, two) WHEN 'partial' THEN two END AS pattern FROM policed p JOIN nets USING (doc_id, frag_id)),
ruled AS (SELECT *, CASE WHEN pattern IS NOT NULL THEN 'redact' ELSE outcome0 END AS outcome1 FROM netted),
decided AS (SELECT u.*, (purpose = 'proof_of_income' AND outcome1 = 'redact' AND NOT row_third_party AND n.one IS NULL AND n.two IS NULL AND ((row_salary AND {found("text", REPAIR_AMOUNT)}) OR (row_holder AND {found("text", REPAIR_NAME)} AND length(text) > 1))) AS repaired FROM ruled u JOIN nets n USING (doc_id, frag_id)),
final AS (SELECT *, CASE WHEN repaired THEN 'keep' ELSE outcome1 END AS outcome FROM decided)"""


#: Steps that several others read: computed once, whatever the database would do with them.
ONCE = ("frags", "centred", "rowed", "heights", "row_flags", "wide", "forced", "t_value", "own", "typed", "policed", "lined", "nets", "ruled", "decided", "final")


def steps(*parts: str) -> str:
    text = ", ".join(p.strip() for p in parts)
    for name in ONCE:
        text = text.replace(f"{name} AS (", f"{name} AS MATERIALIZED (") if text.startswith(f"{name} AS (") else re.sub(rf"(?<=[\s,(]){name} AS \(", f"{name} AS MATERIALIZED (", text)
    return f"WITH RECURSIVE {text} "


def plan(frags: str) -> str:
    """Everything from fragments to `final`."""
    return steps(frags, ROWS, FLAGS, VALUES, ANCHORS, RULES, POLICY, NETS, DECIDED)
