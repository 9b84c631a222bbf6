"""The engine's queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.replies import document_type, failed_replies, label_lines, parse_audits, parse_labels, short_ids
from veilspark.functions.text import clean_ids, mask_value, match_type, matches, may_hit, pii_hits, rule_label
from veilspark.operators import anchors, cache, decide, verify
from veilspark.operators.boxes import merge_boxes, own_boxes, redacted_text, uncovered
from veilspark.operators.layout import laid_out, median_heights, near, overlaps, row_flags, row_of, row_texts, with_lines, with_rows
from veilspark.operators.nets import context_hits, pii_ids
from veilspark.operators.policy import apply_policy
from veilspark.plans import sql
from veilspark.plans.pipeline import run_plan
from veilspark.plans.presets import partial_specs, policy_matrix, policy_rules, read_presets, violations
from veilspark.schema import BATCH, CLASSIFY_WORDS, DOCUMENT_TYPES, MAX_SIDE, MIN_SIDE, PADDING, PATTERNS
from veilspark.sources.golden import GOLDEN_SQL, golden, sql_value, values
from veilspark.sources.images import image_scale
from veilspark.sources.ledger import LEDGER_SQL, ledger
from veilspark.sources.model import classify_by_words, rule_labels
from veilspark.sources.tables import materialized, table
from veilspark.sources.text import from_ocr, strip_tags, words

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql_text: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql_text:
            ORACLES[f.__name__] = sql_text
        return f

    return register


def rules_of(spark: SparkSession) -> DataFrame:
    return policy_rules(read_presets(spark))


def marked(frags: DataFrame) -> DataFrame:
    """Fragments with the rule labeler's label as a column: no join."""
    return frags.withColumn("ftype", rule_label(F.col("text")))


def wide_of(frags: DataFrame) -> DataFrame:
    return anchors.labelled(with_rows(marked(frags)))


def decided_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_plan(materialized(marked(ledger(spark, sf_dir))), None, rules_of(spark))


def decided_golden(spark: SparkSession) -> DataFrame:
    frags = golden(spark)
    return run_plan(frags, rule_labels(frags), rules_of(spark))


# --- policy -------------------------------------------------------------------


@query(sql.steps(sql.RULES, sql.TYPES) + "SELECT p.purpose, t.ftype, coalesce(r.outcome, 'redact') AS outcome, r.outcome IS NOT NULL AS listed, coalesce(r.critical, false) AS critical FROM purposes p CROSS JOIN types t LEFT JOIN rules r ON r.purpose = p.purpose AND r.ftype = t.ftype")
def policy_matrix_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy_matrix(spark, rules_of(spark))


@query(sql.steps(sql.RULES) + "SELECT purpose, outcome, count(*) AS n, count(*) FILTER (critical) AS n_critical FROM rules GROUP BY ALL")
def preset_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_of(spark).groupBy("purpose", "outcome").agg(F.count("*").alias("n"), F.count_if("critical").alias("n_critical"))


BAD_PRESETS = '{"good": {"label": "x", "keep_types": ["name"], "redact_types": []}, "nolabel": {"keep_types": [], "redact_types": []}, "nolists": {"label": "y", "keep_types": []}, "legacy": {"label": "z", "keep": ["name"], "redact": ["email"]}, "spec": {"label": "s", "keep_types": ["name"], "redact_types": [], "partial_types": {"pan_number": {"reveal": "last4"}, "name": {"reveal": "last4", "format": "X{last4}"}}}}'
_PROBLEMS = values([("nolabel", "no label"), ("nolists", "no keep and redact types"), ("spec", "no reveal and format: pan_number"), ("spec", "kept and masked: name")], "purpose, problem")


@query(_PROBLEMS)
def preset_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.plans.presets import PRESET

    parsed = spark.createDataFrame([(BAD_PRESETS,)], "value string").select(F.explode(F.from_json("value", f"map<string,{PRESET}>")).alias("purpose", "p"))
    return violations(parsed.select("purpose", "p.label", "p.keep_types", "p.redact_types", "p.keep", "p.redact", F.col("p.purpose_critical_types").alias("critical"), "p.partial_types"))


@query(sql.steps(sql.RULES) + "SELECT purpose, ftype, reveal, format FROM rules WHERE outcome = 'partial'")
def partial_spec_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partial_specs(read_presets(spark))


MASKS = [("1234 5678 9012", "last4", "XXXX XXXX {last4}"), ("ABCPM1234C", "first2", "{first2}XXXXXXX"), ("123", "last4", "XXXX XXXX {last4}"), ("12345678", "last4", "XXXX XXXX {last4}"), ("123456789", "last4", "XXXX XXXX {last4}"), ("", "last4", "X{last4}"), (None, "last4", "X{last4}"), ("1234 5678 9012", "middle3", "X{middle3}"), ("1234 5678 9012", None, "X{last4}"), ("1234 5678 9012", "last4", "XXXX XXXX"), ("1234 5678 9012", "last4", "XXXX {first4} {last4}"), ("1234 5678 9012", "last4", "XXXX {first4}"), ("1234 5678 9012", "last4", "ABCD XXXX {last4}"), ("1234 5678 9012", "last4", "1234 XXXX {last4}"), ("1234 5678 9012", "LAST4", "xx-{last4}"), ("1234 5678 9012", "last0", "X{last0}")]


@query(f"WITH m AS ({values(MASKS, 'raw, reveal, template')}) SELECT raw, reveal, template, {sql.mask('raw', 'reveal', 'template')} AS mask FROM m")
def mask_fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.createDataFrame(MASKS, "raw string, reveal string, template string")
    return m.select("raw", "reveal", "template", mask_value(F.col("raw"), F.col("reveal"), F.col("template")).alias("mask"))


@query(f"SELECT c_custkey, {sql.mask('c_name', chr(39) + 'last4' + chr(39), chr(39) + 'XXXXXX{last4}' + chr(39))} AS mask FROM customer")
def mask_last4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", mask_value(F.col("c_name"), F.lit("last4"), F.lit("XXXXXX{last4}")).alias("mask"))


# --- PII nets on plain texts --------------------------------------------------


def _words_sql(source: str, key: str, text: str = "text") -> str:
    return f"""lines AS (SELECT CAST({key} AS VARCHAR) AS doc_id, string_split({text}, chr(10)) AS ls FROM {source}),
split_lines AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM lines)),
split_words AS (SELECT doc_id, line_no, string_split(line, ' ') AS ws FROM split_lines),
words AS (SELECT doc_id, line_no, j - 1 AS tok, ws[j] AS text FROM (SELECT doc_id, line_no, ws, unnest(range(1, len(ws) + 1)) AS j FROM split_words) WHERE ws[j] <> '')"""


_PATTERNS_SQL = f"patterns AS ({values([(i, k, p) for i, (k, p) in enumerate(PATTERNS.items())], 'rank, pattern, regex')})"


def _by_pattern(words_df: DataFrame, spark: SparkSession) -> DataFrame:
    names = spark.createDataFrame([(k,) for k in PATTERNS], "pattern string")
    hit = words_df.select("doc_id", F.inline(pii_hits(F.col("text")))).groupBy(F.col("pattern").alias("_p")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
    joined = names.join(F.broadcast(hit), F.col("pattern") == F.col("_p"), "left")  # six rows
    return joined.select("pattern", F.coalesce("n", F.lit(0)).alias("n_fragments"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


_BY_PATTERN = "SELECT p.pattern, count(w.doc_id) AS n_fragments, count(DISTINCT w.doc_id) AS n_docs FROM patterns p LEFT JOIN words w ON regexp_matches(w.text, p.regex) GROUP BY p.pattern"


@query("WITH " + _words_sql("documents", "doc_id") + ", " + _PATTERNS_SQL + _BY_PATTERN)
def pii_hits_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_pattern(words(table(spark, sf_dir, "documents")), spark)


@query("WITH " + _words_sql("conversations", "conv_id") + ", " + _PATTERNS_SQL + _BY_PATTERN)
def pii_hits_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_pattern(words(table(spark, sf_dir, "conversations"), "conv_id"), spark)


_BARE = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g')"


@query("WITH " + _words_sql("pages", "page_id", _BARE) + ", " + _PATTERNS_SQL + _BY_PATTERN)
def pii_hits_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", strip_tags(F.col("html")).alias("text"))
    return _by_pattern(words(pages, "page_id"), spark)


@query("WITH " + _words_sql("documents", "doc_id") + ", " + _PATTERNS_SQL + "SELECT doc_id, line_no, tok, arg_min(pattern, rank) AS pattern, count(*) AS n_patterns FROM words JOIN patterns ON regexp_matches(text, regex) GROUP BY ALL")
def pii_primary_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = words(table(spark, sf_dir, "documents")).withColumn("hits", pii_hits(F.col("text"))).where(F.size("hits") > 0)
    return hit.select("doc_id", "line_no", "tok", F.col("hits")[0]["pattern"].alias("pattern"), F.size("hits").cast("long").alias("n_patterns"))


_HIDDEN = """hit AS (SELECT doc_id, line_no, tok, arg_min(pattern, rank) AS pattern FROM words JOIN patterns ON regexp_matches(text, regex) GROUP BY ALL)
SELECT p.purpose, p.pattern, coalesce(r.outcome, 'redact') AS policy, count(h.doc_id) AS n_fragments, count(DISTINCT h.doc_id) AS n_docs
FROM (SELECT purpose, pattern, CASE pattern WHEN 'aadhaar' THEN 'aadhaar_number' WHEN 'pan' THEN 'pan_number' WHEN 'phone' THEN 'phone_number' WHEN 'ifsc' THEN 'ifsc_code' WHEN 'long_digits' THEN 'account_number' ELSE pattern END AS ftype FROM purposes, patterns) p
LEFT JOIN rules r ON r.purpose = p.purpose AND r.ftype = p.ftype LEFT JOIN hit h ON h.pattern = p.pattern GROUP BY ALL"""


@query("WITH " + ", ".join([_words_sql("documents", "doc_id"), _PATTERNS_SQL, sql.RULES, _HIDDEN]))
def hidden_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: which fragments of documents are hidden, by which pattern, per purpose."""
    kinds = {"aadhaar": "aadhaar_number", "pan": "pan_number", "phone": "phone_number", "ifsc": "ifsc_code", "long_digits": "account_number", "email": "email"}
    hit = pii_primary_pattern(spark, sf_dir).groupBy(F.col("pattern").alias("_hit")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"))
    rules = rules_of(spark)
    grid = rules.select("purpose").distinct().crossJoin(spark.createDataFrame(list(kinds.items()), "pattern string, kind string"))
    known = grid.join(F.broadcast(rules.select(F.col("purpose").alias("_p"), "ftype", "outcome")), (F.col("purpose") == F.col("_p")) & (F.col("kind") == F.col("ftype")), "left")
    joined = known.join(F.broadcast(hit), F.col("pattern") == F.col("_hit"), "left")  # six rows
    return joined.select("purpose", "pattern", F.coalesce("outcome", F.lit("redact")).alias("policy"), F.coalesce("n", F.lit(0)).alias("n_fragments"), F.coalesce("d", F.lit(0)).alias("n_docs"))


# --- layout -------------------------------------------------------------------


@query(sql.steps(LEDGER_SQL, sql.ROWS) + "SELECT doc_id, frag_id, row_no FROM rowed")
def rows_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rows(ledger(spark, sf_dir)).select("doc_id", "frag_id", "row_no")


@query(sql.steps(GOLDEN_SQL, sql.ROWS) + "SELECT doc_id, frag_id, row_no FROM rowed")
def rows_reconstruct_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_rows(golden(spark)).select("doc_id", "frag_id", "row_no")


def _lines_sql(frags: str) -> str:
    """Lines fragment by fragment, where sql.lines folds over centres."""
    return sql.steps(frags, sql.ROWS) + """, o AS (SELECT r.doc_id, frag_id, c::DOUBLE AS c, greatest(med / 2, 6) AS tol, row_number() OVER (PARTITION BY r.doc_id ORDER BY c, x, seq) AS i FROM centred r JOIN heights USING (doc_id)),
fold AS (SELECT doc_id, i, frag_id, c AS s, 1 AS n, 0 AS line_no FROM o WHERE i = 1
  UNION ALL SELECT o.doc_id, o.i, o.frag_id, CASE WHEN abs(o.c - f.s / f.n) <= o.tol THEN f.s + o.c ELSE o.c END, CASE WHEN abs(o.c - f.s / f.n) <= o.tol THEN f.n + 1 ELSE 1 END, CASE WHEN abs(o.c - f.s / f.n) <= o.tol THEN f.line_no ELSE f.line_no + 1 END FROM fold f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1)
SELECT doc_id, frag_id, line_no FROM fold"""


@query(_lines_sql(GOLDEN_SQL))
def lines_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_lines(golden(spark)).select("doc_id", "frag_id", "line_no")


@query(_lines_sql(LEDGER_SQL))
def lines_grouped_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_lines(ledger(spark, sf_dir)).select("doc_id", "frag_id", "line_no")


@query("SELECT CAST(o_custkey AS VARCHAR) AS doc_id, list_sort(list(CAST(o_orderkey % 97 AS INT)))[count(*) // 2 + 1] AS med FROM orders GROUP BY o_custkey")
def upper_median_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    heights = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), (F.col("o_orderkey") % 97).cast("int").alias("h"))
    return median_heights(heights)


@query(sql.steps(LEDGER_SQL, sql.ROWS) + "SELECT doc_id, row_no, string_agg(text, ' ' ORDER BY x, c, seq) AS text, CAST(min(x) AS INT) AS x0, CAST(max(x + w) AS INT) AS x1, count(*) AS n FROM rowed GROUP BY doc_id, row_no")
def row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_texts(with_rows(ledger(spark, sf_dir))).select("doc_id", "row_no", "text", "x0", "x1", "n")


@query(sql.steps(LEDGER_SQL, sql.ROWS, sql.FLAGS) + "SELECT doc_id, row_no, row_money, row_dated, row_hinted, row_salary, row_holder, row_third_party, row_dob FROM row_flags")
def row_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_flags(with_rows(ledger(spark, sf_dir))).select("doc_id", "row_no", "row_money", "row_dated", "row_hinted", "row_salary", "row_holder", "row_third_party", "row_dob")


@query(sql.steps(GOLDEN_SQL, sql.ROWS) + "SELECT r.doc_id, r.frag_id, q.frag_id AS wanted_id FROM rowed r JOIN (SELECT * FROM rowed WHERE text IN ('ARJUN', 'RAKESH', '14/08/1999')) q USING (doc_id, row_no)")
def row_for_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    frags = with_rows(golden(spark))
    return row_of(frags, frags.where(F.col("text").isin("ARJUN", "RAKESH", "14/08/1999"))).select("doc_id", "frag_id", "wanted_id")


@query(sql.steps(GOLDEN_SQL, sql.ROWS, sql.FLAGS) + "SELECT a.doc_id, a.row_no, b.row_no AS other_no, abs(a.row_centre - b.row_centre) <= greatest(med * 2.5::DOUBLE, 30) AS is_near, (b.row_x0 < a.row_x1 AND a.row_x0 < b.row_x1) AS laps FROM row_flags a JOIN row_flags b ON a.doc_id = b.doc_id AND b.row_no > a.row_no JOIN heights h ON h.doc_id = a.doc_id")
def rows_near_and_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    frags = with_rows(golden(spark))
    a = row_flags(frags).join(median_heights(frags), "doc_id")
    b = row_flags(frags).select(F.col("doc_id").alias("_d"), F.col("row_no").alias("other_no"), F.col("row_centre").alias("oc"), F.col("row_x0").alias("o0"), F.col("row_x1").alias("o1"))
    pairs = a.join(b, (F.col("doc_id") == F.col("_d")) & (F.col("other_no") > F.col("row_no")))
    return pairs.select("doc_id", "row_no", "other_no", near(F.col("row_centre"), F.col("oc"), F.col("med")).alias("is_near"), overlaps(F.col("row_x0"), F.col("row_x1"), F.col("o0"), F.col("o1")).alias("laps"))


# --- anchors ------------------------------------------------------------------


def _rule(name: str, frags: DataFrame) -> DataFrame:
    """What one rule changes, after the rules before it."""
    wide = wide_of(frags)
    for rule, f in anchors.RULES.items():
        after = f(wide)
        if rule == name:
            return anchors.changed(wide, after)
        wide = after
    raise KeyError(name)


def _register_anchors() -> None:
    chain = ["t0", "t1", "t2", "t3", "t4", "ftype"]
    for source, sql_source, read in (("", LEDGER_SQL, lambda s, d: ledger(s, d)), ("_golden", GOLDEN_SQL, lambda s, d: golden(s))):
        for i, rule in enumerate(anchors.RULES):
            text = sql.steps(sql_source, sql.ROWS, sql.FLAGS, sql.VALUES, sql.ANCHORS) + f"SELECT doc_id, frag_id, {chain[i]} AS old_type, {chain[i + 1]} AS new_type FROM typed WHERE {chain[i]} <> {chain[i + 1]}"

            def run(spark: SparkSession, sf_dir: str, rule: str = rule, read=read) -> DataFrame:  # noqa: ANN001
                return _rule(rule, read(spark, sf_dir))

            run.__name__ = f"anchor_{rule}{source}"
            query(text)(run)


_register_anchors()


@query(sql.steps(LEDGER_SQL, sql.ROWS, sql.FLAGS, sql.VALUES, sql.ANCHORS) + "SELECT t0 AS old_type, ftype AS new_type, count(*) AS n FROM typed GROUP BY ALL")
def anchor_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = wide_of(ledger(spark, sf_dir)).withColumn("old_type", F.col("ftype"))
    return anchors.anchor_all(wide).groupBy("old_type", F.col("ftype").alias("new_type")).agg(F.count("*").alias("n"))


# --- nets and decisions -------------------------------------------------------


def _context(frags: DataFrame) -> DataFrame:
    return context_hits(with_lines(frags)).groupBy("doc_id", "frag_id", "pattern", "matched_text").agg(F.count("*").alias("n"))


_CONTEXT = "SELECT doc_id, frag_id, 'date_of_birth' AS pattern, matched_text, count(*) AS n FROM context GROUP BY ALL"


@query(sql.steps(LEDGER_SQL, sql.ROWS, sql.FLAGS, sql.NETS) + _CONTEXT)
def context_dob_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(ledger(spark, sf_dir))


@query(sql.steps(GOLDEN_SQL, sql.ROWS, sql.FLAGS, sql.NETS) + _CONTEXT)
def context_dob_hits_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(golden(spark))


@query(sql.steps(LEDGER_SQL, sql.ROWS, sql.FLAGS, sql.NETS) + "SELECT doc_id, frag_id FROM nets WHERE one IS NOT NULL OR two IS NOT NULL")
def pii_word_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_ids(with_lines(ledger(spark, sf_dir)))


CLAIMS = [(d, p, f"w{k:04d}", o, k) for d in ("pan", "slip", "voter", "nosuch") for p in ("id_verification", "proof_of_income") for k, o in ((0, "keep"), (1, "redact"), (1, "keep"), (2, "partial"), (2, "keep"), (3, "partial"), (3, "redact"), (99, "keep"), (4, "odd"))]
_CLAIMS_SQL = f"claims AS ({values(CLAIMS, 'doc_id, purpose, frag_id, outcome, ordinal')})"
_RECONCILE = "best AS (SELECT doc_id, purpose, frag_id, min(CASE outcome WHEN 'redact' THEN 0 WHEN 'partial' THEN 1 WHEN 'keep' THEN 2 END) AS rank FROM claims GROUP BY ALL), every AS (SELECT f.doc_id, p.purpose, f.frag_id FROM frags f JOIN (SELECT DISTINCT doc_id, purpose FROM claims) p USING (doc_id)), settled AS (SELECT e.*, CASE rank WHEN 1 THEN 'partial' WHEN 2 THEN 'keep' ELSE 'redact' END AS outcome, rank IS NULL AS unfilled FROM every e LEFT JOIN best USING (doc_id, purpose, frag_id))"


@query(sql.steps(GOLDEN_SQL, _CLAIMS_SQL, _RECONCILE) + "SELECT doc_id, purpose, frag_id, outcome, unfilled FROM settled")
def decision_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.reconcile(golden(spark), spark.createDataFrame(CLAIMS, "doc_id string, purpose string, frag_id string, outcome string, ordinal int"))


@query(sql.steps(GOLDEN_SQL, _CLAIMS_SQL, _RECONCILE) + "SELECT doc_id, purpose, count(*) FILTER (unfilled) AS n_unfilled, count(*) AS n FROM settled GROUP BY ALL")
def unfilled_fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_reconcile(spark, sf_dir).groupBy("doc_id", "purpose").agg(F.count_if("unfilled").alias("n_unfilled"), F.count("*").alias("n"))


_LEDGER_CLAIMS = """, asserted AS (SELECT doc_id, purpose, frag_id, outcome0 AS outcome FROM policed WHERE ftype <> 'other' UNION ALL SELECT doc_id, purpose, frag_id, 'redact' FROM nets CROSS JOIN purposes WHERE one IS NOT NULL OR two IS NOT NULL),
strongest AS (SELECT doc_id, purpose, frag_id, min(CASE outcome WHEN 'redact' THEN 0 WHEN 'partial' THEN 1 WHEN 'keep' THEN 2 END) AS rank FROM asserted GROUP BY ALL),
settled AS (SELECT f.doc_id, p.purpose, f.frag_id, CASE rank WHEN 1 THEN 'partial' WHEN 2 THEN 'keep' ELSE 'redact' END AS outcome, rank IS NULL AS unfilled FROM frags f JOIN (SELECT DISTINCT doc_id, purpose FROM asserted) p USING (doc_id) LEFT JOIN strongest s ON s.doc_id = f.doc_id AND s.purpose = p.purpose AND s.frag_id = f.frag_id) """
_LEDGER_RECONCILE = sql.steps(LEDGER_SQL, sql.ROWS, sql.FLAGS, sql.VALUES, sql.ANCHORS, sql.RULES, sql.POLICY, sql.NETS) + _LEDGER_CLAIMS


@query(_LEDGER_RECONCILE + "SELECT doc_id, purpose, frag_id, outcome, unfilled FROM settled")
def reconcile_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy's claims on all labelled fragments of the ledger and the nets' claims on
    what they hit; fragments of type other have no claim but the nets'."""
    frags, rules = materialized(laid_out(marked(ledger(spark, sf_dir)))), rules_of(spark)
    policed = apply_policy(anchors.anchor_all(materialized(anchors.labelled(frags))), rules).where("ftype <> 'other'").select("doc_id", "purpose", "frag_id", "outcome")
    hit = pii_ids(frags).crossJoin(F.broadcast(rules.select("purpose").distinct()))  # four rows
    return decide.reconcile(frags, policed.unionByName(hit.withColumn("outcome", F.lit("redact"))))


@query(_LEDGER_RECONCILE + "SELECT doc_id, purpose, count(*) FILTER (unfilled) AS n_unfilled, count(*) AS n FROM settled GROUP BY ALL")
def unfilled_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile_ledger(spark, sf_dir).groupBy("doc_id", "purpose").agg(F.count_if("unfilled").alias("n_unfilled"), F.count("*").alias("n"))


@query(sql.steps(LEDGER_SQL, sql.RULES) + "SELECT doc_id, purpose, count(*) AS n FROM frags CROSS JOIN purposes GROUP BY ALL")
def fail_closed_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.fail_closed(ledger(spark, sf_dir), rules_of(spark)).where("outcome = 'redact'").groupBy("doc_id", "purpose").agg(F.count("*").alias("n"))


@query(sql.plan(LEDGER_SQL) + "SELECT doc_id, purpose, frag_id, outcome, pattern, mask FROM final WHERE outcome = 'partial' OR pattern IS NOT NULL OR repaired")
def decisions_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decided_ledger(spark, sf_dir).where("outcome = 'partial' OR pattern IS NOT NULL OR repaired")
    return d.select("doc_id", "purpose", "frag_id", "outcome", "pattern", "mask")


@query(sql.plan(GOLDEN_SQL) + "SELECT doc_id, purpose, frag_id, ftype, outcome, pattern, mask, repaired FROM final")
def decisions_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided_golden(spark).select("doc_id", "purpose", "frag_id", "ftype", "outcome", "pattern", "mask", "repaired")


_UNLABELLED = "typed AS (SELECT *, CAST(NULL AS VARCHAR) AS ftype FROM wide)"


@query(sql.steps(LEDGER_SQL, sql.ROWS, sql.FLAGS, _UNLABELLED, sql.RULES, sql.POLICY, sql.NETS, sql.DECIDED) + "SELECT doc_id, purpose, frag_id, text FROM final WHERE outcome <> 'redact'")
def repair_keeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without any label all is redacted, but for what the repair brings back."""
    frags = ledger(spark, sf_dir)
    decided = run_plan(frags, rule_labels(frags).where("false"), rules_of(spark))
    return decided.where("outcome <> 'redact'").select("doc_id", "purpose", "frag_id", "text")


@query(sql.plan(LEDGER_SQL) + "SELECT doc_id, purpose, count(*) AS fragments, count(*) FILTER (outcome = 'keep') AS visible, count(*) FILTER (outcome = 'partial') AS masked, count(*) FILTER (outcome = 'redact') AS redacted FROM final GROUP BY ALL")
def visible_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.summary(decided_ledger(spark, sf_dir))


@query(sql.plan(GOLDEN_SQL) + "SELECT doc_id, purpose, count(*) FILTER (outcome = 'keep') AS n_visible, string_agg(CASE WHEN outcome = 'partial' THEN frag_id || '=' || mask END, ',' ORDER BY frag_id) AS masks FROM final GROUP BY ALL")
def plan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decide.results(decided_golden(spark))
    entries = F.array_sort(F.map_entries("partial_masks"))
    return r.select("doc_id", "purpose", F.size("visible_ids").cast("long").alias("n_visible"), F.when(F.size(entries) > 0, F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")).alias("masks"))


@query(sql.steps(LEDGER_SQL, sql.ROWS, sql.FLAGS, sql.VALUES, sql.ANCHORS, sql.RULES, sql.POLICY) + "SELECT doc_id, purpose, frag_id, mask FROM policed WHERE outcome0 = 'partial'")
def partial_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = anchors.anchor_all(wide_of(ledger(spark, sf_dir)))
    return apply_policy(typed, rules_of(spark)).where("outcome = 'partial'").select("doc_id", "purpose", "frag_id", "mask")


TYPED = [("d1", "w0000", "123", "pan_number"), ("d1", "w0001", "ABCDE1234F", "pan_number"), ("d1", "w0002", "12345678", "aadhaar_number"), ("d1", "w0003", "ABC1234567", "voter_id_number"), ("d1", "w0004", "x", None), ("d1", "w0005", "ARJUN", "name"), ("d1", "w0006", "y", "nonsense")]


@query(f"WITH typed AS ({values(TYPED, 'doc_id, frag_id, text, ftype')}), {sql.RULES}, {sql.POLICY.strip()} SELECT doc_id, purpose, frag_id, outcome0 AS outcome, unmaskable, critical FROM policed")
def unmaskable(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = spark.createDataFrame(TYPED, "doc_id string, frag_id string, text string, ftype string")
    return apply_policy(typed, rules_of(spark)).select("doc_id", "purpose", "frag_id", "outcome", F.coalesce("unmaskable", F.lit(False)).alias("unmaskable"), "critical")


FLAGS = [("pan", "id_verification", 1, i, f) for i, f in enumerate(["w0002", "w0008", "w0002", "w0011", "w0006", "w9999", "w0000"])] + [("pan", "proof_of_address", 1, 0, "w0012"), ("pan", "id_verification", 2, 0, "w0012"), ("pan", "id_verification", 2, 1, "w0003")]
_FLAGS_SQL = f"flags AS ({values(FLAGS, 'doc_id, purpose, round, ordinal, frag_id')})"


@query(sql.plan(GOLDEN_SQL) + f", {_FLAGS_SQL} SELECT f.doc_id, f.purpose, f.frag_id, min(f.ordinal) AS ordinal, bool_or(d.critical) AS blocked FROM flags f JOIN decided d ON d.doc_id = f.doc_id AND d.purpose = f.purpose AND d.frag_id = f.frag_id WHERE d.outcome1 = 'keep' AND f.round = 1 GROUP BY ALL")
def audit_guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = spark.createDataFrame(FLAGS, "doc_id string, purpose string, round int, ordinal int, frag_id string").where("round = 1")
    return decide.audit_guardrail(decided_golden(spark).where("NOT repaired"), flags)


@query(sql.plan(GOLDEN_SQL) + f", {_FLAGS_SQL} SELECT d.doc_id, d.purpose, d.frag_id FROM decided d WHERE d.outcome1 = 'keep' AND NOT d.critical AND EXISTS (SELECT 1 FROM flags f WHERE f.doc_id = d.doc_id AND f.purpose = d.purpose AND f.frag_id = d.frag_id)")
def audit_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    frags = golden(spark)
    flags = spark.createDataFrame(FLAGS, "doc_id string, purpose string, round int, ordinal int, frag_id string")
    return run_plan(frags, rule_labels(frags), rules_of(spark), flags).where("audited").select("doc_id", "purpose", "frag_id")


# --- boxes and texts ----------------------------------------------------------

_BOXES = f""", covered AS MATERIALIZED (SELECT doc_id, purpose, seq, frag_id, x, y, w, h, c FROM final WHERE outcome <> 'keep'),
{sql.lines("covered", "covered_lines", "doc_id, purpose").strip()},
gaps AS (SELECT *, CASE WHEN x - lag(x + w) OVER o > greatest(h, lag(h) OVER o) THEN 1 ELSE 0 END AS brk FROM covered JOIN covered_lines USING (doc_id, purpose, frag_id) WINDOW o AS (PARTITION BY doc_id, purpose, line_no ORDER BY x, c, seq)),
runs AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, purpose, line_no ORDER BY x, c, seq) AS run FROM gaps),
boxes AS MATERIALIZED (SELECT doc_id, purpose, line_no, run, CAST(min(x) - {PADDING} AS INT) AS x0, CAST(min(y) - {PADDING} AS INT) AS y0, CAST(max(x + w) + {PADDING} AS INT) AS x1, CAST(max(y + h) + {PADDING} AS INT) AS y1 FROM runs GROUP BY ALL) """
_HELD = ", held AS (SELECT c.doc_id, c.purpose, c.frag_id, count(b.doc_id) AS n FROM covered c LEFT JOIN boxes b ON b.doc_id = c.doc_id AND b.purpose = c.purpose AND x0 <= c.x AND y0 <= c.y AND x1 >= c.x + c.w AND y1 >= c.y + c.h GROUP BY ALL) SELECT purpose, count(*) AS n_covered, count(*) FILTER (n = 0) AS n_uncovered FROM held GROUP BY purpose"
PAGE = ("doc_id", "purpose")


def _covered(decided: DataFrame) -> DataFrame:
    """What boxes must cover."""
    return decided.where("outcome <> 'keep'").select("doc_id", "purpose", "frag_id", "seq", "x", "y", "w", "h")


def _hidden(decided: DataFrame) -> DataFrame:
    """The same, written once: lines, boxes and the check each read it."""
    return materialized(_covered(decided))


def _uncovered(decided: DataFrame) -> DataFrame:
    """Hidden words under each purpose, and those outside the boxes of their page. A word
    meets the box of its own run first; only if one is outside do words meet the others."""
    n = materialized(own_boxes(_covered(decided), keys=PAGE).groupBy("purpose").agg(F.sum("n").alias("n_covered"), F.sum("outside").alias("outside")))
    if n.where("outside > 0").isEmpty():
        return n.select("purpose", "n_covered", F.col("outside").alias("n_uncovered"))
    hidden = _hidden(decided)
    bad = uncovered(hidden, merge_boxes(hidden, keys=PAGE), PAGE).groupBy(F.col("purpose").alias("_p")).agg(F.count("*").alias("bad"))
    return n.join(F.broadcast(bad), F.col("purpose") == F.col("_p"), "left").select("purpose", "n_covered", F.coalesce("bad", F.lit(0)).alias("n_uncovered"))  # a row a purpose


@query(sql.plan(LEDGER_SQL) + _BOXES + "SELECT doc_id, purpose, x0, y0, x1, y1 FROM boxes")
def merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_boxes(_covered(decided_ledger(spark, sf_dir)), keys=PAGE).select("doc_id", "purpose", "x0", "y0", "x1", "y1")


@query(sql.plan(GOLDEN_SQL) + _BOXES + "SELECT doc_id, purpose, line_no, x0, y0, x1, y1 FROM boxes")
def merged_boxes_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_boxes(_covered(decided_golden(spark)), keys=PAGE).select("doc_id", "purpose", "line_no", "x0", "y0", "x1", "y1")


@query(sql.plan(GOLDEN_SQL) + _BOXES + _HELD)
def uncovered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uncovered(decided_golden(spark))


@query(sql.plan(LEDGER_SQL) + _BOXES + _HELD)
def uncovered_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uncovered(decided_ledger(spark, sf_dir))


_SHOWN = "SELECT doc_id, purpose, line_no, string_agg(CASE outcome WHEN 'keep' THEN text WHEN 'partial' THEN mask ELSE repeat('█', length(text)) END, ' ' ORDER BY x, c, seq) AS text FROM final JOIN lined USING (doc_id, frag_id) GROUP BY doc_id, purpose, line_no"


@query(sql.plan(LEDGER_SQL) + _SHOWN)
def redacted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_text(decided_ledger(spark, sf_dir))


@query(sql.plan(GOLDEN_SQL) + _SHOWN)
def redacted_lines_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_text(decided_golden(spark))


_ANY_PATTERN = " OR ".join(f"regexp_matches(text, {sql_value(p)})" for p in PATTERNS.values())


@query("WITH " + _words_sql("documents", "doc_id") + f" SELECT doc_id, line_no, string_agg(CASE WHEN {_ANY_PATTERN} THEN repeat('█', length(text)) ELSE text END, ' ' ORDER BY tok) AS text FROM words WHERE (doc_id, line_no) IN (SELECT (doc_id, line_no) FROM words WHERE {_ANY_PATTERN}) GROUP BY doc_id, line_no")
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with a hit, with the hit words hidden; narrow but for one grouping of the lines hit."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    any_hit = F.lit(False)
    for p in PATTERNS.values():
        any_hit = any_hit | matches(F.col("line"), p)
    tokens = F.filter(F.split("line", " "), lambda t: t != "")

    def hide(t):  # noqa: ANN001, ANN202
        bad = F.lit(False)
        for p in PATTERNS.values():
            bad = bad | matches(t, p)
        return F.when(may_hit(t) & bad, F.repeat(F.lit("█"), F.length(t))).otherwise(t)

    hidden = lines.where(may_hit(F.col("line")) & any_hit).withColumn("text", F.array_join(F.transform(tokens, hide), " "))
    return hidden.where(F.col("text") != F.array_join(tokens, " ")).select("doc_id", "line_no", "text")


# --- replies, ids, cache ------------------------------------------------------

#: Fixed values from here on to CASES: small literal inputs and what must come of them.
REPLIES = [
    ("r1", 0, "a00: name\na01: account_num"), ("r2", 0, "a00: trans\na01: o"), ("r3", 0, "- **a00**: name\n* a01 = address\n1. `a02` -> phone_number"),
    ("r4", 0, "a00: the type is other_amount\na01: it is other"), ("r5", 0, "a00: name\nZZ: address\nb99: nonsense_type"), ("r6", 0, "a00: name\na00: address"),
    ("r7", 0, '{"labels": [{"id": "a00", "type": "name"}]}'), ("r8", 0, "I cannot help with that."), ("r9", 0, '[{"id": "a01", "type": "father name"}, {"id": "a01", "type": "email"}]'),
]
PARSED = [("r1", "w0001", "name"), ("r1", "w0002", "account_number"), ("r3", "w0001", "name"), ("r3", "w0002", "address"), ("r3", "w0003", "phone_number"), ("r4", "w0001", "other_amount"), ("r4", "w0002", "other"), ("r5", "w0001", "name"), ("r6", "w0001", "name"), ("r7", "w0001", "name"), ("r9", "w0002", "name")]


def _reply_ids(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r[0], 0, f"a{k:02d}", f"w{k + 1:04d}") for r in REPLIES for k in range(3)], "doc_id string, batch int, short_id string, frag_id string")


@query(values(PARSED, "doc_id, frag_id, ftype"))
def parse_label_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_labels(spark.createDataFrame(REPLIES, "doc_id string, batch int, raw string"), _reply_ids(spark)).select("doc_id", "frag_id", "ftype")


@query("SELECT 'r2' AS doc_id, 0 AS batch")
def failed_label_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed_replies(spark.createDataFrame(REPLIES, "doc_id string, batch int, raw string"), _reply_ids(spark))


@query("WITH r AS (SELECT c_custkey, 'a' || lpad(CAST(c_custkey % 26 AS VARCHAR), 2, '0') || ': ' || lower(c_mktsegment) || '.' AS line FROM customer) SELECT CAST(c_custkey AS VARCHAR) AS doc_id, lower(regexp_extract(line, '^([A-Za-z][A-Za-z0-9]{1,3})', 1)) AS short_id, regexp_extract(line, ': (.+?)[.]*$', 1) AS token FROM r")
def label_line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.concat(F.lit("a"), F.lpad((F.col("c_custkey") % 26).cast("string"), 2, "0"), F.lit(": "), F.lower("c_mktsegment"), F.lit("."))
    replies = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit(0).alias("batch"), lines.alias("raw"))
    return label_lines(replies).select("doc_id", "short_id", "token")


TOKENS = ["name", "NAME ", "`email`", "the type is other_amount", "it is other", "account_num", "date", "o", "trans", "", "father name", "employer name", "phone", "nonsense", "salary_amount.", "cgpa", "sign", "voter_id", "pan_"]
MATCHED = ["name", "name", "email", "other_amount", "other", "account_number", None, None, None, None, "name", "name", "phone_number", None, "salary_amount", "cgpa_or_marks", "signature_marker", "voter_id_number", "pan_number"]


@query(f"WITH t AS ({values([(t,) for t in TOKENS], 'token')}), u AS (SELECT token, lower(regexp_replace(regexp_replace(trim(token), '^[`*_\"''.]+', ''), '[`*_\"''.]+$', '')) AS k FROM t), {sql.TYPES}, c AS (SELECT token, arg_max(ftype, length(ftype)) AS best FROM u JOIN types ON k <> '' AND contains(k, ftype) GROUP BY token), b AS (SELECT token, min(ftype) AS single FROM u JOIN types ON length(k) >= 4 AND starts_with(ftype, k) GROUP BY token HAVING count(*) = 1) SELECT token, coalesce(best, single) AS ftype FROM u LEFT JOIN c USING (token) LEFT JOIN b USING (token)")
def match_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TOKENS], "token string").select("token", match_type(F.col("token")).alias("ftype"))


AUDITS = [("a1", 0, "FLAGGED: w0002, W0007\nREASON: card number is visible"), ("a2", 0, "FLAGGED: none\nREASON: fine"), ("a3", 0, "FLAGGED: [w0001] `w0003`."), ("a4", 0, "REASON: looks fine"), ("a5", 0, '{"flagged_ids": ["W0004 "], "reasoning": " seen "}'), ("a6", 0, "- FLAGGED: -\nREASON: first\nREASON: second"), ("a7", 0, "nothing at all")]
AUDITED = [("a1", "w0002,w0007", "card number is visible", True), ("a2", "", "fine", True), ("a3", "w0001,w0003", "", True), ("a4", "", "", False), ("a5", "w0004", "seen", True), ("a6", "", "first", True), ("a7", "", "", False)]


@query(values(AUDITED, "doc_id, flagged, reason, ok"))
def parse_audit_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_audits(spark.createDataFrame(AUDITS, "doc_id string, batch int, raw string"))
    return parsed.select("doc_id", F.array_join("flagged", ",").alias("flagged"), F.when(F.col("ok"), F.col("reason")).otherwise("").alias("reason"), "ok")


@query("WITH " + _words_sql("conversations", "conv_id || '-' || turn") + f", n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, tok) - 1 AS i FROM words) SELECT doc_id, CAST(i + 1 AS INT) AS seq, CAST(i // {BATCH} AS INT) AS batch, chr(CAST(97 + (i % {BATCH}) // 26 AS INT)) || lpad(CAST(i % {BATCH} % 26 AS VARCHAR), 2, '0') AS short_id FROM n")
def short_id_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.sources.text import fragments

    texts = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"), "text")
    return short_ids(fragments(texts)).select("doc_id", "seq", "batch", "short_id")


@query("WITH " + _words_sql("documents", "doc_id") + f", n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, tok) - 1 AS i FROM words) SELECT doc_id, CAST(i + 1 AS INT) AS seq, CAST(i // {BATCH} AS INT) AS batch, chr(CAST(97 + (i % {BATCH}) // 26 AS INT)) || lpad(CAST(i % {BATCH} % 26 AS VARCHAR), 2, '0') AS short_id FROM n")
def short_id_codes_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all words of documents, where short_id_codes has those of conversations."""
    from veilspark.sources.text import fragments

    return short_ids(fragments(table(spark, sf_dir, "documents"))).select("doc_id", "seq", "batch", "short_id")


@query("WITH " + _words_sql("documents", "doc_id") + f", n AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id) SELECT doc_id, (n + {BATCH} - 1) // {BATCH} AS batches, n AS fragments FROM n")
def detect_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = words(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("fragments"))
    return n.select("doc_id", F.ceil(F.col("fragments") / BATCH).alias("batches"), "fragments")


_KEYS = "keys AS (SELECT doc_id, CAST(max(x + w) AS VARCHAR) || 'x' || CAST(max(y + h) AS VARCHAR) || ':' || sha256(string_agg(x || ',' || y || ',' || w || ',' || h || ',' || text, chr(10) ORDER BY seq)) AS key FROM frags GROUP BY doc_id)"


@query(sql.steps(LEDGER_SQL, _KEYS) + "SELECT doc_id, key FROM keys")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.content_keys(ledger(spark, sf_dir))


@query(sql.steps(LEDGER_SQL, _KEYS) + "SELECT doc_id, key FROM keys WHERE CAST(doc_id AS INT) % 3 <> 0")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = cache.content_keys(ledger(spark, sf_dir))
    cached = keys.where(F.col("doc_id").cast("int") % 3 == 0)
    return cache.misses(keys, cached).select("doc_id", "key")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(length(text) AS VARCHAR) || 'x1:' || sha256(text) AS key FROM documents")
def image_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), cache.image_key(F.length("text"), F.lit(1), F.col("text").cast("binary")).alias("key"))


_CACHED = [(f"k{i:02d}", "w0000", i) for i in range(12)]


@query(values([(k, f) for k, f, i in _CACHED if i >= 4], "key, frag_id"))
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.retained(spark.createDataFrame(_CACHED, "key string, frag_id string, inserted_at int"), 8).select("key", "frag_id")


_CLASSIFY = "CASE " + " ".join(f"WHEN {sql.any_of('text', w)} THEN {sql_value(k)}" for k, w in CLASSIFY_WORDS.items()) + " ELSE 'other' END"


@query(sql.steps(GOLDEN_SQL, sql.ROWS, sql.lines("frags", "lined")) + f", line_text AS (SELECT doc_id, line_no, lower(string_agg(text, ' ' ORDER BY x, c, seq)) AS t FROM rowed JOIN lined USING (doc_id, frag_id) GROUP BY doc_id, line_no), doc AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY line_no) AS text FROM line_text GROUP BY doc_id) SELECT doc_id, {_CLASSIFY} AS document_type FROM doc")
def classify_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_by_words(row_texts(with_lines(golden(spark)), "line_no"))


@query(f"WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lower(array_to_string(string_split(text, chr(10))[1:60], chr(10))) AS text FROM documents) SELECT doc_id, {_CLASSIFY} AS document_type FROM l")
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return classify_by_words(lines)


ANSWERS = ["bank_statement", "It is a PAN_CARD.", "salary_slip or marksheet", "unsure", "voter_id card", "aadhaar_card"]
_TYPE = "CASE " + " ".join(f"WHEN contains(lower(answer), '{t}') THEN '{t}'" for t in DOCUMENT_TYPES) + " ELSE 'other' END"


@query(f"SELECT answer, {_TYPE} AS document_type FROM ({values([(a,) for a in ANSWERS], 'answer')})")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(a,) for a in ANSWERS], "answer string").select("answer", document_type(F.col("answer")).alias("document_type"))


IDS = [("i1", [" W0001", "w0001", "w0002 ", ""]), ("i2", None), ("i3", ["B", "a", "b"])]


@query(values([("i1", "w0001,w0002"), ("i2", ""), ("i3", "b,a")], "k, ids"))
def cleaned_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(IDS, "k string, ids array<string>").select("k", F.array_join(clean_ids(F.col("ids")), ",").alias("ids"))


# --- sources ------------------------------------------------------------------

_OCR = "SELECT o_orderkey, o_custkey, o_orderpriority, o_orderkey % 120 AS c FROM orders"


@query(f"WITH raw AS ({_OCR}), kept AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM raw WHERE c <> 7 AND c >= 30 AND trim(CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE ' ' || o_orderpriority || ' ' END) <> '') SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(seq AS INT) AS seq, 'w' || lpad(CAST(seq AS VARCHAR), 4, '0') AS frag_id, o_orderpriority AS text, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE CAST(o_orderkey % 1000 AS INT) END AS x FROM kept")
def ocr_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    blank = lambda c: F.lit(None).cast("string").alias(c)
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("doc_id"), k.alias("ordinal"), F.when(k % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" "))).alias("text"),
        F.when(k % 120 == 7, "bad").otherwise((k % 120).cast("string")).alias("conf"), F.when(k % 4 == 0, "?").otherwise((k % 1000).cast("string")).alias("left"), *[blank(c) for c in ("top", "width", "height", "block_num", "par_num", "line_num")],
    )
    return from_ocr(raw).select("doc_id", "seq", "frag_id", "text", "x")


@query(f"WITH s AS (SELECT p_partkey, 100 + p_partkey % 3000 AS wd, 200 + p_size * 100 AS ht FROM part), u AS (SELECT *, CASE WHEN least(wd, ht) < {MIN_SIDE} THEN {MIN_SIDE}::DOUBLE / least(wd, ht) ELSE 1 END AS up FROM s) SELECT p_partkey, CAST(round(1000 * CASE WHEN greatest(wd, ht) * up > {MAX_SIDE} THEN {MAX_SIDE}::DOUBLE / greatest(wd, ht) ELSE up END) AS BIGINT) AS scale_milli FROM u")
def image_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = 100 + F.col("p_partkey") % 3000, 200 + F.col("p_size") * 100
    return table(spark, sf_dir, "part").select("p_partkey", F.round(1000 * image_scale(w, h)).cast("long").alias("scale_milli"))


@query("SELECT coalesce(CASE WHEN page_id % 2 = 0 THEN url END, CASE WHEN page_id % 3 = 0 THEN html END, '') AS picked, page_id FROM pages")
def resolve_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two optional inputs."""
    return table(spark, sf_dir, "pages").select(F.coalesce(F.when(F.col("page_id") % 2 == 0, F.col("url")), F.when(F.col("page_id") % 3 == 0, F.col("html")), F.lit("")).alias("picked"), "page_id")


# --- verification -------------------------------------------------------------


@query(sql.plan(LEDGER_SQL) + "SELECT purpose, count(*) AS fragments, count(*) FILTER (outcome = 'keep' AND (n.one IS NOT NULL OR n.two IS NOT NULL)) AS visible_pii FROM final JOIN nets n USING (doc_id, frag_id) GROUP BY purpose")
def acceptance_pii_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.shown_pii(decided_ledger(spark, sf_dir))


@query(sql.plan(LEDGER_SQL) + "SELECT count(*) AS masked, count(*) FILTER (NOT ends_with(mask, right(trim(text), 4))) AS bad FROM final WHERE outcome = 'partial'")
def acceptance_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = decided_ledger(spark, sf_dir)
    bad = verify.bad_masks(decided.select("doc_id", "purpose", "frag_id", "text", "outcome", "mask"), rules_of(spark)).agg(F.count("*").alias("bad"))
    return decided.where("outcome = 'partial'").agg(F.count("*").alias("masked")).crossJoin(bad)


CASES = [
    ("statement", "proof_of_income", ["3,214.00", "BIGBASKET"], ["ARJUN", "85,000.00"]), ("pan", "id_verification", ["14/08/1999", "RAKESH", "ABCDE1234F"], ["ARJUN"]),
    ("slip", "proof_of_income", ["5010023456789012", "KA/BNG/204518/000"], ["ARJUN", "85,000"]), ("voter", "id_verification", ["ABC1234567", "Flat", "SITA"], ["ARJUN"]),
    ("voter", "proof_of_address", ["ABC1234567", "SITA"], ["Flat", "Bengaluru"]), ("marksheet", "education_proof", ["2023CS1042", "GENERAL", "14/08/1999", "9812345670"], ["BENGALURU", "8.72", "gone"]),
]
CASE_ROWS = [(d, p, x, k) for d, p, hidden, visible in CASES for k, xs in (("hidden", hidden), ("visible", visible)) for x in xs]
_CASES_SQL = f"cases AS ({values(CASE_ROWS, 'doc_id, purpose, literal, kind')})"
_MET = "looked_for AS (SELECT c.*, count(f.frag_id) AS n, count(*) FILTER (f.outcome = 'keep') AS shown FROM cases c LEFT JOIN final f ON f.doc_id = c.doc_id AND f.purpose = c.purpose AND contains(lower(f.text), lower(c.literal)) GROUP BY ALL)"


@query(sql.plan(GOLDEN_SQL) + f", {_CASES_SQL}, {_MET} SELECT doc_id, purpose, literal, CASE WHEN n = 0 THEN 'stale' WHEN kind = 'hidden' AND shown > 0 THEN 'leak' ELSE 'note: hidden' END AS problem FROM looked_for WHERE n = 0 OR (kind = 'hidden' AND shown > 0) OR (kind = 'visible' AND shown = 0)")
def acceptance_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame(CASE_ROWS, "doc_id string, purpose string, literal string, kind string")
    return verify.case_failures(golden(spark), decided_golden(spark), cases)


@query(sql.steps(GOLDEN_SQL) + f", {_CASES_SQL} SELECT c.doc_id, c.purpose, c.literal, c.kind, f.frag_id FROM cases c JOIN frags f ON f.doc_id = c.doc_id AND contains(lower(f.text), lower(c.literal))")
def literal_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.literal_matches(golden(spark), spark.createDataFrame(CASE_ROWS, "doc_id string, purpose string, literal string, kind string"))


CALLS = [("classify", "a", 2.5), ("detect", "b", 8.25), ("detect", "c", 4.5), ("audit", "d", 3.0)]


@query(f"SELECT layer, sum(total_s)::DOUBLE AS total_s, count(*) AS calls FROM ({values(CALLS, 'layer, preview, total_s')}) GROUP BY layer")
def layer_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.layer_timings(spark.createDataFrame(CALLS, "layer string, preview string, total_s double"))
