"""Quality rules: divergence of character classes and common words from the language.

DataFrame functions only. Each text is split into words once; everything else is
computed from that array inside its row, so nothing but a few sums per language is
ever shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import table, written

SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Base rules: fewest words, and the greatest percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Guards: texts with fewer words are not judged by a histogram.
GUARD_CHARS, GUARD_WORDS = 30, 100
#: Greatest Jensen-Shannon distances (0 to 1) from the language's reference.
MOST_CHARS, MOST_WORDS = 0.25, 0.30
#: Languages whose references are broadcast; more are joined by shuffle.
BROADCAST_LANGS = 10_000
#: Signs after a word that are no part of it where common words are counted.
STOPS = ".,;:!?"
#: Common words of four languages. They are counted whatever their capitals
#: and with STOPS after them.
COMMON = {
    "en": "the of and to in is that it for was on are with as be at by this".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein".split(),
    "fr": "de la le et les des en un du une que est pour qui dans sur pas au".split(),
    "es": "de la que el en y a los se del las un por con no una su para".split(),
}
WORDS = sorted({w for words in COMMON.values() for w in words})
SYMBOLS = "[#*$%&|<>]"
#: Character classes besides white space, symbols and the rest.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "stop": "[.,;:!?'\"()-]"}


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside runs of WINDOW words that occur twice or more in the array.

    Runs are compared by 64-bit hash. Only where some hash repeats are hashes sorted
    with their positions; then each repeated run adds the words that no earlier one
    has covered."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    runs = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]).eqNullSafe(True))
            at = F.array_sort(F.transform(again, lambda x: x["i"]))
            start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
            return F.aggregate(at, start, lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total")), lambda a: a["total"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(placed, twice))

    return F.when(n < WINDOW + 1, 0).otherwise(let(runs, covered))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars, common).

    chars: counts of upper-case letters, digits, stops, symbols, white space and the
    rest; common: counts of WORDS, whatever their capitals and the stops after them, and
    of all other words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    given = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP)).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counts = [F.regexp_count("text", F.lit(c)).alias(k) for k, c in CLASSES.items()]
    read = given.select(
        "id",
        "lang",
        F.size("words").alias("n_words"),
        F.length("text").alias("length"),
        F.length(F.regexp_replace("text", GAP, "")).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        let(F.filter(F.transform("words", lambda w: F.lower(F.rtrim(w, F.lit(STOPS)))), lambda w: w.isin(*WORDS)), lambda hits: F.struct(F.size(hits).alias("n"), F.concat(F.lit(" "), F.array_join(hits, "  "), F.lit(" ")).alias("all"))).alias("hits"),
        *counts,
    )
    known, size = F.col("hits.n"), F.octet_length("hits.all")
    each = [(size - F.octet_length(F.replace("hits.all", F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2) for w in WORDS]  # how often " w " occurs
    rest = F.col("word_chars") - sum((F.col(k) for k in CLASSES), F.col("n_symbols"))
    return read.select(
        "id",
        "lang",
        *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.array(*CLASSES, "n_symbols", F.col("length") - F.col("word_chars"), rest).cast("array<int>").alias("chars"),
        F.array(*each, F.col("n_words") - known).cast("array<int>").alias("common"),
    )


def references(feats: DataFrame) -> DataFrame:
    """(_lang, _chars, _common): both histograms summed over all rows of each language."""
    sums = lambda c, n: F.array(*[F.sum(F.col(c)[i]) for i in range(n)])
    return feats.groupBy(F.col("lang").alias("_lang")).agg(sums("chars", len(CLASSES) + 3).alias("_chars"), sums("common", len(WORDS) + 1).alias("_common"))


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return let(total, lambda t: F.transform(counts, lambda x: F.when(t > 0, x / t).otherwise(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two lists of shares."""

    def term(a: Column, b: Column) -> Column:
        half = lambda x: F.when(x > 0, x * F.log2(2 * x / (a + b))).otherwise(0.0)
        return (half(a) + half(b)) / 2

    total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def judge(docs: DataFrame, most_chars: float = MOST_CHARS, most_words: float = MOST_WORDS, guard_chars: int = GUARD_CHARS, guard_words: int = GUARD_WORDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, counts of features(), base_failed, chars_distance, words_distance, kept).

    A row is kept if the base rules pass and neither histogram is further from its
    language's reference than allowed; a text too short for a histogram is not judged
    by it. References are sums over all rows of the language. Defined cases: null
    texts have no words and fail; a null language is a language of its own; repeated
    rows are judged alike and count in the reference each time; null ids pass; other
    columns are ignored; an empty table gives an empty table."""
    feats = written(features(docs, id_col, text_col, lang_col), "features")
    known = written(references(feats), "references")
    refs = known.select("_lang", shares(F.col("_chars")).alias("_chars"), shares(F.col("_common")).alias("_common"))
    joined = feats.join(F.broadcast(refs) if known.count() <= BROADCAST_LANGS else refs, F.col("lang").eqNullSafe(F.col("_lang")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = joined.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), js_distance(shares(F.col("chars")), F.col("_chars")).alias("chars_distance"), js_distance(shares(F.col("common")), F.col("_common")).alias("words_distance")
    )
    far = ((F.col("n_words") >= guard_chars) & (F.col("chars_distance") > most_chars)) | ((F.col("n_words") >= guard_words) & (F.col("words_distance") > most_words))
    return judged.withColumn("kept", ~F.col("base_failed") & ~far)


def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_HALF = "CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / (p + q)) ELSE 0 END"
ORACLE = f"""
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
runs AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM texts WHERE len(ws) > {WINDOW})),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs) WHERE n > 1),
covered AS (SELECT doc_id, sum(least({WINDOW}, i - before)) AS n_repeat_words FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -{WINDOW}) AS before FROM again) GROUP BY doc_id),
base AS (
  SELECT t.doc_id, lang, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(text) AS chars,
    {", ".join(f"len(regexp_extract_all(text, '{c.replace(chr(39), chr(39) * 2)}')) AS {k}" for k, c in CLASSES.items())}
  FROM texts t LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id)),
char_bins AS (
  {" UNION ALL ".join(f"SELECT doc_id, lang, '{k}' AS bin, {k} AS n FROM base" for k in (*CLASSES, "n_symbols"))}
  UNION ALL SELECT doc_id, lang, 'space', chars - word_chars FROM base UNION ALL SELECT doc_id, lang, 'rest', word_chars - n_symbols - {" - ".join(CLASSES)} FROM base),
hits AS (SELECT doc_id, w AS bin, count(*) AS n FROM (SELECT doc_id, lower(rtrim(unnest(ws), '{STOPS}')) AS w FROM texts) WHERE w IN ({_sql_list(WORDS)}) GROUP BY ALL),
words AS (SELECT unnest([{_sql_list(WORDS)}]) AS bin),
word_bins AS (
  SELECT b.doc_id, b.lang, w.bin, coalesce(h.n, 0) AS n FROM base b CROSS JOIN words w LEFT JOIN hits h ON h.doc_id = b.doc_id AND h.bin = w.bin
  UNION ALL SELECT b.doc_id, b.lang, '', b.n_words - coalesce((SELECT sum(n) FROM hits h WHERE h.doc_id = b.doc_id), 0) FROM base b),
bins AS (SELECT 'chars' AS kind, * FROM char_bins UNION ALL SELECT 'words', * FROM word_bins),
shares AS (SELECT kind, doc_id, lang, bin, CASE WHEN sum(n) OVER d > 0 THEN n / sum(n) OVER d ELSE 0 END AS p, sum(n) OVER (PARTITION BY kind, lang, bin) / sum(n) OVER (PARTITION BY kind, lang) AS q FROM bins WINDOW d AS (PARTITION BY kind, doc_id)),
far AS (SELECT doc_id, kind, sqrt(greatest(sum(({_HALF.format(x="p")} + {_HALF.format(x="q")}) / 2), 0)) AS distance FROM shares GROUP BY doc_id, kind),
judged AS (SELECT b.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, c.distance AS chars_distance, w.distance AS words_distance FROM base b JOIN far c ON c.doc_id = b.doc_id AND c.kind = 'chars' JOIN far w ON w.doc_id = b.doc_id AND w.kind = 'words')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ((n_words >= {GUARD_CHARS} AND chars_distance > {MOST_CHARS}) OR (n_words >= {GUARD_WORDS} AND words_distance > {MOST_WORDS})) AS kept
FROM judged
"""
