import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions.replies import document_type, parse_labels
from veilspark.functions.text import mask_value, match_type, pii_hits, short_id
from veilspark.operators import anchors, boxes, decide, verify
from veilspark.operators.boxes import merge_boxes, own_boxes, redacted_text, uncovered
from veilspark.operators.cache import clear_store, content_keys, hits, labels_through, misses, read_store
from veilspark.operators.layout import laid_out, median_heights, row_texts, with_lines, with_rows
from veilspark.operators.nets import context_hits, pattern_hits, with_nets
from veilspark.plans import queries
from veilspark.plans.pipeline import run_plan
from veilspark.plans.presets import checked, policy_matrix, policy_rules, read_presets, violations
from veilspark.schema import FIELD_TYPES
from veilspark.sources.golden import golden
from veilspark.sources.ledger import ledger
from veilspark.sources.model import asked, halves, http_classes, http_flags, http_labels, reachable, rule_labels, warm_up
from veilspark.sources.text import dropped_words, fragments, from_ocr, words

FRAGS = "doc_id string, seq int, frag_id string, text string, x int, y int, w int, h int"


def layout(spark, lines, char=10, height=20, doc="d"):
    out, k = [], 0
    for y, tokens in lines:
        x = 10
        for t in tokens.split(" "):
            out.append((doc, k, f"w{k:04d}", t, x, y, char * len(t), height))
            x, k = x + char * len(t) + 8, k + 1
    return spark.createDataFrame(out, FRAGS)


def typed(spark, frags, given):
    labels = spark.createDataFrame([("d", k, v) for k, v in given.items()] or [("none", "none", "other")], "doc_id string, frag_id string, ftype string")
    return anchors.labelled(with_rows(frags), labels)


def types(wide):
    return {r["frag_id"]: r["ftype"] for r in wide.select("frag_id", "ftype").collect()}


AMOUNT = [(10, "02-Apr-2026 SALARY CREDIT 85,000.00"), (40, "05-Apr-2026 UPI/REF/982134/Rent Payment 24,500.00"), (70, "Closing Balance: INR 3,42,118.00"), (100, "Gross Salary 1,23,456.00")]
PAN = [(10, "Name PHOTO"), (40, "ARJUN MEHTA"), (70, "Father's Name"), (100, "RAKESH MEHTA")]
VOTER = [(10, "Elector's Photo Identity Card"), (40, "Elector's Name"), (70, "ARJUN MEHTA"), (100, "Elector's Photo Identity Card No."), (130, "ABC1234567"), (160, "Address"), (190, "Flat 12, MG Road, Bengaluru 560034")]
DATES = [(10, "02-Apr-2026 SALARY CREDIT 85,000.00"), (40, "05-Apr-2026 UPI/REF/982134/Rent 24,500.00"), (70, "Date of Birth 14/08/1999"), (100, "Statement Period: 01-Apr-2026 30-Jun-2026")]


def test_amounts_need_a_salary_row(spark):
    got = types(anchors.anchor_amounts(typed(spark, layout(spark, AMOUNT), dict.fromkeys(["w0003", "w0006", "w0010", "w0013"], "salary_amount"))))
    assert [got[k] for k in ("w0003", "w0006", "w0010", "w0013")] == ["salary_amount", "other_amount", "other_amount", "salary_amount"]


def test_names_on_ledger_rows_are_counterparties(spark):
    frags = layout(spark, [(10, "Account Holder: ARJUN MEHTA"), (40, "15-Apr-2026 Card Purchase BIGBASKET 3,214.00")])
    got = types(anchors.anchor_names(typed(spark, frags, {"w0002": "name", "w0007": "name"})))
    assert got["w0002"] == "name" and got["w0007"] == "other"


def test_third_party_names_on_the_next_row_and_the_same(spark):
    got = types(anchors.anchor_third_parties(typed(spark, layout(spark, PAN), dict.fromkeys(["w0002", "w0003", "w0005", "w0006", "w0007"], "name"))))
    assert got["w0006"] == got["w0007"] == "father_name" and got["w0002"] == got["w0005"] == "name"
    got = types(anchors.anchor_third_parties(typed(spark, layout(spark, [(10, "Father's Name: RAKESH MEHTA")]), dict.fromkeys(["w0000", "w0001", "w0002", "w0003"], "name"))))
    assert [got[f"w000{k}"] for k in range(4)] == ["name", "name", "father_name", "father_name"]


def test_birth_dates_need_an_anchor(spark):
    got = types(anchors.anchor_dates(typed(spark, layout(spark, DATES), {"w0000": "date_of_birth", "w0009": "date_of_birth"})))
    assert got["w0000"] == "transaction_date" and got["w0009"] == "date_of_birth"


def test_label_values(spark):
    frags = layout(spark, VOTER, 9, 18)
    given = {"w0013": "phone_number", "w0012": "label_text", **{f"w{k:04d}": "label_text" for k in range(15, 21)}, "w0003": "label_text"}
    got = types(anchors.anchor_values(typed(spark, frags, given)))
    assert got["w0013"] == "voter_id_number" and got["w0012"] == "label_text" and got["w0003"] == "label_text"
    assert {got[f"w{k:04d}"] for k in range(15, 21)} == {"address"}
    assert types(anchors.anchor_values(typed(spark, frags, {"w0013": "date_of_birth"})))["w0013"] == "date_of_birth"
    assert set(types(anchors.anchor_values(typed(spark, frags, {}))).values()) == {None}


def test_anchors_are_idempotent(spark):
    once = anchors.anchor_all(anchors.labelled(with_rows(golden(spark)), rule_labels(golden(spark))))
    twice = anchors.anchor_all(once)
    assert anchors.changed(once.where("doc_id <> 'voter'"), twice.where("doc_id <> 'voter'")).count() == 0


def py_rows(frags, ratio=0.6):
    out, row, last = {}, 0, None
    for f in sorted(frags, key=lambda f: (f[5] + f[7] / 2, f[1])):
        if last and abs(f[5] + f[7] / 2 - last[5] - last[7] / 2) > max(f[7], last[7]) * ratio:
            row += 1
        out[f[2]], last = row, f
    return out


def py_lines(frags):
    hs = sorted(f[7] for f in frags)
    tolerance = max(hs[len(hs) // 2] / 2, 6)
    out, line, total, n = {}, -1, 0.0, 0
    for f in sorted(frags, key=lambda f: (f[5] + f[7] / 2, f[4], f[1])):
        c = f[5] + f[7] / 2
        if n and abs(c - total / n) <= tolerance:
            total, n = total + c, n + 1
        else:
            line, total, n = line + 1, c, 1
        out[f[2]] = line
    return out


def test_rows_and_lines_follow_the_plain_model(spark):
    rng = random.Random(7)
    docs = {f"d{d}": [(f"d{d}", k, f"w{k:04d}", "t", rng.randint(0, 500), rng.randint(0, 200), 30, rng.randint(10, 40)) for k in range(rng.randint(1, 30))] for d in range(40)}
    frags = spark.createDataFrame([f for fs in docs.values() for f in fs], FRAGS)
    rows = {(r["doc_id"], r["frag_id"]): r["row_no"] for r in with_rows(frags).collect()}
    lines = {(r["doc_id"], r["frag_id"]): r["line_no"] for r in with_lines(frags).collect()}
    for doc, fs in docs.items():
        assert {k: rows[doc, k] for _, _, k, *_ in fs} == py_rows(fs)
        assert {k: lines[doc, k] for _, _, k, *_ in fs} == py_lines(fs)


def test_two_notions_of_a_row(spark):
    merchant = golden(spark).where("doc_id = 'merchant'")
    assert with_rows(merchant).select("row_no").distinct().count() == 1
    assert with_lines(merchant).select("line_no").distinct().count() == 2


def test_upper_median(spark):
    frags = spark.createDataFrame([("d", k, f"w{k}", "t", 0, 0, 1, h) for k, h in enumerate([4, 1, 3, 2])], FRAGS)
    assert median_heights(frags).first()["med"] == 3


def test_row_text_in_order_of_x(spark):
    frags = spark.createDataFrame([("d", 0, "a", "world", 100, 0, 1, 20), ("d", 1, "b", "hello", 10, 2, 1, 20)], FRAGS)
    assert row_texts(with_rows(frags)).first()["text"] == "hello world"


@pytest.mark.parametrize(("text", "found"), [("Aadhaar 1234 5678 9012", ["aadhaar"]), ("123456789012", ["aadhaar", "long_digits"]), ("PAN ABCDE1234F", ["pan"]), ("abcde1234f", []), ("Call 9876543210", ["phone", "long_digits"]), ("Office 0221234567", ["long_digits"]), ("IFSC HDFC0001234", ["ifsc"]), ("A/c 5010023456789012", ["long_digits"]), ("write to arjun@example.com", ["email"]), ("22/09/2026", []), ("85,000.00", []), ("é1234567890", [])])
def test_patterns(spark, text, found):
    got = spark.createDataFrame([(text,)], "text string").select(pii_hits(F.col("text")).alias("h")).first()["h"]
    assert [h["pattern"] for h in got] == found


@pytest.mark.parametrize(("raw", "reveal", "template", "mask"), [("1234 5678 9012", "last4", "XXXX XXXX {last4}", "XXXX XXXX 9012"), ("ABCPM1234C", "first2", "{first2}XXXXXXX", "ABXXXXXXX"), ("12345678", "last4", "X{last4}", None), ("123456789", "last4", "X{last4}", "X6789"), (None, "last4", "X{last4}", None), ("1234 5678 9012", "middle3", "X", None), ("1234 5678 9012", "last4", "1234 XXXX {last4}", None), ("1234 5678 9012", "last99999999999", "X{last99999999999}", None)])
def test_masks(spark, raw, reveal, template, mask):
    df = spark.createDataFrame([(raw, reveal, template)], "raw string, reveal string, template string")
    assert df.select(mask_value(F.col("raw"), F.col("reveal"), F.col("template"))).first()[0] == mask


def test_geometry_equals_the_plain_rows_and_lines(spark):
    rng = random.Random(9)
    rows = [(f"d{rng.randrange(6)}", k, f"w{k:04d}", "t", rng.randrange(300), rng.randrange(0, 400, rng.choice([1, 7])), 10, rng.choice([8, 12, 13, 20, 41])) for k in range(900)]
    rows += [("long", k, f"w{k:04d}", "t", 10, 9 * k + (k % 3), 10, 11 + k % 5) for k in range(700)]
    frags = spark.createDataFrame(rows, FRAGS)
    got = {(r["doc_id"], r["frag_id"]): (r["row_no"], r["line_no"], r["med"]) for r in laid_out(frags).collect()}
    plain_rows = {(r["doc_id"], r["frag_id"]): r["row_no"] for r in with_rows(frags).collect()}
    assert len(got) == len(rows)
    for doc in {r[0] for r in rows}:
        own = sorted((y + h / 2, x, k, h, f) for d, k, f, _, x, y, _, h in rows if d == doc)
        heights = sorted(o[3] for o in own)
        med = heights[len(heights) // 2]
        line, total, n = -1, 0.0, 0
        for c, _, _, _, f in own:
            if not n or abs(c - total / n) > max(med / 2, 6):
                line, total, n = line + 1, 0.0, 0
            total, n = total + c, n + 1
            assert got[doc, f] == (plain_rows[doc, f], line, med)


def test_context_net(spark):
    near = context_hits(with_lines(layout(spark, [(10, "14/08/1999"), (40, "Date of Birth")])))
    assert [r["frag_id"] for r in near.collect()] == ["w0000"]
    far = context_hits(with_lines(layout(spark, [(10, "01/02/2026 x"), (40, "03/02/2026 y"), (400, "Date of Birth 14/08/1999")])))
    assert [r["matched_text"] for r in far.collect()] == ["14/08/1999"]
    assert context_hits(with_lines(layout(spark, [(520, "DOB"), (555, "14/08/1999")]))).count() == 1


def test_policy_matrix(spark):
    got = {(r["purpose"], r["ftype"]): (r["outcome"], r["critical"]) for r in policy_matrix(spark, policy_rules(read_presets(spark))).collect()}
    assert len(got) == 4 * len(FIELD_TYPES)
    assert [k for k, v in sorted(got.items()) if v[0] == "partial"] == [("id_verification", t) for t in ("aadhaar_number", "pan_number", "voter_id_number")]
    assert got["proof_of_income", "salary_amount"] == ("keep", True) and got["education_proof", "email"] == ("redact", False)


def test_presets_are_checked(spark):
    assert violations(read_presets(spark)).count() == 0
    bad = read_presets(spark).withColumn("label", F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="no label"):
        checked(bad)


CLAIMS = "doc_id string, purpose string, frag_id string, outcome string"


def test_reconcile_gives_one_outcome_each_and_fails_closed(spark):
    frags = layout(spark, [(10, "a b c d e")])
    claims = spark.createDataFrame([("d", "p", "w0002", "redact"), ("d", "p", "w0000", "keep"), ("d", "p", "w9999", "keep"), ("d", "p", "w0001", "partial"), ("d", "p", "w0001", "keep"), ("d", "p", "w0003", "partial"), ("d", "p", "w0003", "redact")], CLAIMS)
    got = {r["frag_id"]: (r["outcome"], r["unfilled"]) for r in decide.reconcile(frags, claims).collect()}
    assert got == {"w0000": ("keep", False), "w0001": ("partial", False), "w0002": ("redact", False), "w0003": ("redact", False), "w0004": ("redact", True)}


def test_fail_closed_decides_the_whole_ledger(spark, sf_dir):
    got = queries.QUERIES["fail_closed_decision"](spark, sf_dir).agg(F.sum("n"), F.countDistinct("purpose")).first()
    assert got[0] == 4 * ledger(spark, sf_dir).count() and got[1] == 4


def test_guardrail(spark):
    decided = spark.createDataFrame([("d", "p", "a", "keep", False), ("d", "p", "b", "keep", False), ("d", "p", "z", "keep", True), ("d", "p", "r", "redact", False)], CLAIMS + ", critical boolean")
    flags = spark.createDataFrame([("d", "p", k, f) for k, f in enumerate(["b", "a", "b", "z", "r", "nosuch"])], "doc_id string, purpose string, ordinal int, frag_id string")
    got = [(r["frag_id"], r["blocked"]) for r in decide.audit_guardrail(decided, flags).orderBy("ordinal").collect()]
    assert got == [("b", False), ("a", False), ("z", True)]


def run_golden(spark, labels=None):
    frags = golden(spark)
    return run_plan(frags, labels if labels is not None else rule_labels(frags), policy_rules(read_presets(spark)))


def test_plan_decides_each_fragment_once_and_shows_no_pii(spark):
    decided = run_golden(spark)
    assert decided.count() == 4 * golden(spark).count() == decided.select("doc_id", "purpose", "frag_id").distinct().count()
    assert {r[0] for r in decided.select("outcome").distinct().collect()} == {"keep", "partial", "redact"}
    assert verify.visible_pii(decided, with_lines(golden(spark))).count() == 0
    aadhaar = {r["text"]: r["outcome"] for r in decided.where("doc_id = 'aadhaar' AND purpose = 'id_verification'").collect()}
    assert aadhaar["9876543210"] == "redact" and aadhaar["ARJUN"] == "keep"


def test_without_labels_only_the_repair_shows_anything(spark):
    decided = run_golden(spark, rule_labels(golden(spark)).where("false"))
    shown = {(r["doc_id"], r["text"]) for r in decided.where("outcome <> 'redact'").collect()}
    assert ("statement", "85,000.00") in shown and ("slip", "ARJUN") in shown and not any("RAKESH" in t for _, t in shown)
    assert decided.where("outcome <> 'redact' AND (purpose <> 'proof_of_income' OR NOT repaired)").count() == 0


def test_nets_never_show_more(spark):
    frags = with_lines(golden(spark))
    wide = anchors.anchor_all(anchors.labelled(with_nets(with_rows(frags)), rule_labels(frags)))
    from veilspark.operators.policy import apply_policy

    before = apply_policy(wide, policy_rules(read_presets(spark)))
    after = decide.apply_nets(before)
    both = before.select("doc_id", "purpose", "frag_id", F.col("outcome").alias("o")).join(after, ["doc_id", "purpose", "frag_id"])
    assert both.where("o = 'redact' AND outcome <> 'redact'").count() == 0 and both.where("o <> outcome").count() > 0


def test_boxes_cover_what_is_hidden(spark):
    frags = golden(spark)
    boxes = merge_boxes(frags)
    assert uncovered(frags, boxes).count() == 0 and 0 < boxes.count() < frags.count()
    row = boxes.where("doc_id = 'columns'").collect()
    assert len(row) == 2 or len(row) == 3  # a wide gap parts the run


def test_uncovered_words_are_found_in_whatever_line_their_box_is(spark):
    frags = golden(spark)
    boxes = merge_boxes(frags)
    assert uncovered(frags, boxes.withColumn("line_no", F.col("line_no") + 1)).count() == 0
    small = boxes.withColumn("x1", F.when(F.col("doc_id") == "pan", F.col("x1") - 30).otherwise(F.col("x1")))
    assert [r[0] for r in uncovered(frags, small).select("doc_id").distinct().collect()] == ["pan"]


def plain_boxes(words):
    """Boxes of one page of (seq, x, y, w, h), one word at a time."""
    order = sorted(words, key=lambda f: (f[2] + f[4] / 2, f[0]))
    tolerance, lines = max(sorted(f[4] for f in words)[len(words) // 2] / 2, 6), []
    for f in order:
        c = f[2] + f[4] / 2
        if not lines or abs(c - sum(a[2] + a[4] / 2 for a in lines[-1]) / len(lines[-1])) > tolerance:
            lines.append([])
        lines[-1].append(f)
    out = []
    for no, line in enumerate(lines):
        runs = []
        for f in sorted(line, key=lambda f: (f[1], f[2] + f[4] / 2, f[0])):
            if not runs or f[1] - (runs[-1][-1][1] + runs[-1][-1][3]) > max(f[4], runs[-1][-1][4]):
                runs.append([])
            runs[-1].append(f)
        out += [(no, k, min(f[1] for f in r) - 5, min(f[2] for f in r) - 5, max(f[1] + f[3] for f in r) + 5, max(f[2] + f[4] for f in r) + 5) for k, r in enumerate(runs)]
    return out


def test_boxes_of_whole_pages_equal_the_plain_ones_and_words_meet_their_own_first(spark, monkeypatch):
    rng = random.Random(5)
    pages = {(f"d{d}", p): [(k, rng.randrange(800), rng.randrange(rng.choice([60, 900])), rng.randrange(5, 90), rng.choice([8, 13, 20, 40])) for k in range(rng.choice([1, 3, 40, 150]))] for d in range(30) for p in "ab"}
    frags = spark.createDataFrame([(*page, f"w{f[0]}", *f) for page, fs in pages.items() for f in fs], "doc_id string, purpose string, frag_id string, seq int, x int, y int, w int, h int").repartition(5)
    monkeypatch.setattr(boxes, "PAGE_CHUNK", 50)  # pages over the ends of chunks
    got = {}
    for r in merge_boxes(frags, keys=queries.PAGE).collect():
        got.setdefault((r["doc_id"], r["purpose"]), []).append(tuple(r)[2:])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(plain_boxes(v)) for k, v in pages.items()}
    own = own_boxes(frags, keys=queries.PAGE)
    assert own.agg(F.sum("n"), F.sum("outside")).first()[:] == (frags.count(), 0) and own.count() == len(pages)
    plan = own_boxes(frags.localCheckpoint(), keys=queries.PAGE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan  # one look at each word, no word meets a box
    nowhere = frags.withColumn("outcome", F.lit("redact")).withColumn("x", F.when(~((F.col("doc_id") == "d3") & (F.col("seq") == 0) & (F.col("purpose") == "a")), F.col("x")))
    assert {r["purpose"]: r["n_uncovered"] for r in queries._uncovered(nowhere).collect()} == {"a": 1, "b": 0}


def test_whole_job_queries_leave_no_fragment_out(spark, sf_dir):
    run = lambda name: queries.QUERIES[name](spark, sf_dir)
    n = ledger(spark, sf_dir).count()
    assert run("reconcile_ledger").count() == 4 * n
    assert run("unfilled_ledger").agg(F.sum("n")).first()[0] == 4 * n
    hidden = run("uncovered_ledger").collect()
    assert len(hidden) == 4 and all(0 < r["n_covered"] <= n and r["n_uncovered"] == 0 for r in hidden)
    assert run("redacted_lines").select("purpose").distinct().count() == 4
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert run("short_id_codes_documents").count() == words(docs).count()


def test_text_sink(spark):
    decided = spark.createDataFrame([("d", "p", 0, "ab", 0, 0, 10, "keep", None), ("d", "p", 1, "1234567890", 20, 0, 10, "partial", "XX7890"), ("d", "p", 2, "xyz", 90, 0, 10, "redact", None)], "doc_id string, purpose string, seq int, text string, x int, y int, h int, outcome string, mask string").withColumn("line_no", F.lit(0))
    assert redacted_text(decided).first()["text"] == "ab XX7890 ███"


def test_types_and_ids(spark):
    df = spark.createDataFrame([("father name",), ("account_num",), ("trans",), (None,)], "t string")
    assert [r[0] for r in df.select(match_type(F.col("t"))).collect()] == ["name", "account_number", None, None]
    assert [r[0] for r in spark.range(0, 700, 27).select(short_id(F.col("id"))).collect()][:2] == ["a00", "b01"]
    assert spark.range(676, 677).select(short_id(F.col("id"))).first()[0] is None
    assert spark.createDataFrame([("Looks like a PAN_CARD",)], "a string").select(document_type(F.col("a"))).first()[0] == "pan_card"


def test_cache(spark):
    keys = content_keys(golden(spark))
    assert keys.select("key").distinct().count() == keys.count()
    known = keys.where("doc_id < 'm'")
    assert misses(keys, known).count() + hits(keys, known.drop("doc_id")).count() == keys.count()


def test_ocr_rows(spark):
    raw = spark.createDataFrame([("d", 0, " a ", "95", "1", "2", "3", "4", "1", "1", "1"), ("d", 1, "  ", "95", "1", "2", "3", "4", "1", "1", "1"), ("d", 2, "b", "29", "1", "2", "3", "4", "1", "1", "1"), ("d", 3, "c", "bad", "1", "2", "3", "4", "1", "1", "1"), ("d", 4, "e", "30", "x", None, "3", "4", "1", "1", "1")], "doc_id string, ordinal int, text string, conf string, left string, top string, width string, height string, block_num string, par_num string, line_num string")
    got = [(r["frag_id"], r["text"], r["x"], r["y"]) for r in from_ocr(raw).orderBy("seq").collect()]
    assert got == [("w0001", "a", 1, 2), ("w0002", "e", 0, 0)]


def test_text_source(spark):
    docs = spark.createDataFrame([("d", "ab  c\n\nd"), ("e", None), ("f", "")], "doc_id string, text string")
    got = [(r["frag_id"], r["text"], r["x"], r["y"]) for r in fragments(docs).orderBy("seq").collect()]
    assert got == [("w0001", "ab", 10, 10), ("w0002", "c", 38, 10), ("w0003", "d", 10, 70)]
    assert words(docs).count() == 3


def models(log=None):
    """(echo, broken, shaky): a model that fails on long prompts, one without a server,
    and one that fails at its first call for a prompt. Made here so that they travel to
    the workers by value; log is a folder where calls leave a file each."""

    def echo(system, user):
        if log:
            import tempfile

            tempfile.mkstemp(dir=log)
        lines = user.split("\n")
        kind = "email" if "marksheet" in system.split("Where a private")[-1] else "name"
        return "\n".join(f"{x.split(': ')[0]}: {'???' if len(lines) > 5 else kind}" for x in lines)

    def broken(system, user):
        raise OSError("no server")

    def shaky(system, user):
        import hashlib
        import os

        mark = os.path.join(log, hashlib.md5(user.encode()).hexdigest())
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("not yet")
        return "FLAGGED: w0001, w0009\nREASON: x" if "Purpose" in user else "\n".join(f"{x.split(': ')[0]}: email" for x in user.split("\n"))

    return echo, broken, shaky


def test_model_labels_are_split_on_failure_and_fail_closed(spark, tmp_path):
    echo, broken, shaky = models(str(tmp_path))
    frags = layout(spark, [(10, "a b c d e f g h i j k")])
    got = http_labels(frags, echo, batch_size=11)  # eleven fail, then five succeed and six fail, then three and three
    assert {r["ftype"] for r in got.collect()} == {"name"} and got.select("frag_id").distinct().count() == got.count() == 11
    assert http_labels(frags, broken).count() == 0
    assert {r["ftype"] for r in http_labels(frags, shaky).collect()} == {"email"}  # a failed call is made again
    noted = spark.createDataFrame([("d", "marksheet")], "doc_id string, document_type string")
    assert {r["ftype"] for r in http_labels(frags, echo, batch_size=5, types=noted).collect()} == {"email"}
    replies = asked(spark.createDataFrame([("d", 0, "p")], "doc_id string, batch int, prompt string"), broken, "s").first()
    assert replies["raw"] is None and "no server" in replies["error"]
    with pytest.raises(ValueError, match="676"):
        http_labels(frags, echo, batch_size=677)


def test_batches_are_halved_by_position(spark):
    ids = spark.createDataFrame([("d", k, f"w{k}", 3 if k < 7 else 4, "x") for k in range(12)], "doc_id string, seq int, frag_id string, batch int, short_id string")
    got = [(r["seq"], r["batch"], r["short_id"]) for r in halves(ids).orderBy("seq").collect()]
    assert got == [(0, 6, "a00"), (1, 6, "a01"), (2, 6, "a02"), (3, 7, "a00"), (4, 7, "a01"), (5, 7, "a02"), (6, 7, "a03")]  # five are halved no more


def test_model_classes_flags_and_warm_up(spark, tmp_path):
    echo, broken, shaky = models(str(tmp_path))
    frags = with_lines(layout(spark, [(10, "a b c")]))
    assert [tuple(r)[:2] for r in http_classes(frags, lambda system, user: "A marksheet.").collect()] == [("d", "marksheet")]
    failed = http_classes(frags, broken).first()
    assert failed["document_type"] == "other" and "no server" in failed["error"]
    visible = frags.withColumn("purpose", F.lit("p")).withColumn("frag_id", F.concat(F.lit("w000"), F.col("seq")))
    assert [tuple(r) for r in http_flags(visible, shaky).collect()] == [("d", "p", 0, "w0001")]  # asked again; w0009 is not shown
    assert http_flags(visible, broken).count() == 0
    assert warm_up(lambda system, user: "ready") and not warm_up(broken)
    assert reachable("http://127.0.0.1:9")[0] is False


def test_labels_are_stored_by_content(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    echo, broken, _ = models(str(calls))
    store = str(tmp_path / "store")
    texts = spark.createDataFrame([("a", "one two"), ("b", "one two"), ("c", "three")], "doc_id string, text string")
    frags = fragments(texts)
    assert labels_through(frags, lambda f: http_labels(f, broken), store).count() == 0  # failures are not stored
    got = {(r["doc_id"], r["frag_id"], r["ftype"]) for r in labels_through(frags, lambda f: http_labels(f, echo), store).collect()}
    assert got == {("a", "w0001", "name"), ("a", "w0002", "name"), ("b", "w0001", "name"), ("b", "w0002", "name"), ("c", "w0001", "name")}
    n = len(list(calls.iterdir()))
    assert n == 2  # two contents
    assert labels_through(frags, lambda f: http_labels(f, echo), store).count() == 5 and len(list(calls.iterdir())) == n
    clear_store(spark, store)
    assert read_store(spark, store).count() == 0


def test_results_tell_what_happened(spark):
    decided = run_golden(spark)
    got = {(r["doc_id"], r["purpose"]): r for r in decide.results(decided).collect()}
    aadhaar = got["aadhaar", "id_verification"]
    assert sum(len(aadhaar[k]) for k in ("visible_ids", "partial_ids", "redact_ids")) == golden(spark).where("doc_id = 'aadhaar'").count()
    for r in got.values():
        assert {h["frag_id"] for h in r["hits"]} <= set(r["redact_ids"]) | {x for x in r["visible_ids"]}
        assert any("net for personal data" in w for w in r["warnings"]) == any(h["pattern"] != "audit" for h in r["hits"])
        assert set(r["partial_masks"]) == set(r["partial_ids"]) and not r["unlabelled_ids"]
    bare = decide.results(run_golden(spark, rule_labels(golden(spark)).where("false"))).where("doc_id = 'pan' AND purpose = 'education_proof'").first()
    assert len(bare["unlabelled_ids"]) == len(bare["redact_ids"]) and bare["warnings"][0].endswith("without a label: redacted")


def test_dropped_words_are_counted(spark):
    raw = spark.createDataFrame([("d", "a", "95"), ("d", " ", "95"), ("d", "b", "29"), ("d", "c", "bad"), ("d", None, "99")], "doc_id string, text string, conf string")
    assert tuple(dropped_words(raw).first()) == ("d", 2, 2, 1)


def test_streaming_decides_each_document(spark, tmp_path):
    from veilspark.streaming.documents import read_documents, redact_stream

    source, calls = str(tmp_path / "in"), tmp_path / "calls"
    calls.mkdir()
    text = "Account Holder: ARJUN 9876543210"
    rows = [("d1", text, "2026-01-01"), ("d2", text, "2026-01-01"), ("d1", text, "2026-01-01"), ("d3", None, "2026-01-01"), ("d4", None, "2026-01-01")]
    spark.createDataFrame(rows, "doc_id string, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(source)
    seen = []

    def sink(batch, number):
        seen.extend((r["doc_id"], r["text"], r["purpose"], r["outcome"]) for r in batch.collect())

    echo, _, _ = models(str(calls))
    redact_stream(read_documents(spark, source), policy_rules(read_presets(spark)), sink, str(tmp_path / "check"), lambda f: http_labels(f, echo), store=str(tmp_path / "store")).awaitTermination()
    assert {d for d, *_ in seen} == {"d1", "d2"} and len(seen) == 2 * 4 * 4  # d3 and d4 have no fragments
    assert {o for _, t, _, o in seen if t == "9876543210"} == {"redact"}
    assert len(list(calls.iterdir())) == 1  # one content, one call


def test_pattern_hits_keep_all_matches(spark):
    assert pattern_hits(layout(spark, [(10, "123456789012")])).count() == 2


def test_parse_labels_prefers_json(spark):
    ids = spark.createDataFrame([("d", 0, "a00", "w0001")], "doc_id string, batch int, short_id string, frag_id string")
    replies = spark.createDataFrame([("d", 0, '{"labels": [{"id": "A00", "type": "email"}]}')], "doc_id string, batch int, raw string")
    assert [r["ftype"] for r in parse_labels(replies, ids).collect()] == ["email"]
