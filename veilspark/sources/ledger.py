"""Fragments of account ledgers, made from customers and their orders.

Each customer is a document: an identity card's rows, then a row for each order. The
same table in SQL is LEDGER_SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEAD = (
    "array('Account', 'Holder:', c_mktsegment)",
    "array('Name')",
    "array(c_mktsegment, 'MEHTA')",
    "array('Father''s', 'Name')",
    "array('RAKESH', 'MEHTA')",
    "array('Date', 'of', 'Birth')",
    "array({day})",
    "array('Permanent', 'Account', 'Number')",
    "array(concat('ABCDE', {four}, 'F'))",
    "array('Address')",
    "array('Flat', concat({nation}, ','), 'MG', 'Road')",
    "array('Mobile', concat('98', {eight}), concat('c', {nation}, '@example.com'))",
)
ORDER = "array({date}, {what}, {whom}, {amount})"


def _expressions(day: str, four: str, eight: str, nation: str) -> list[str]:
    return [h.format(day=day, four=four, eight=eight, nation=nation) for h in HEAD]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments (doc_id, seq, frag_id, text, x, y, w, h, conf) of all customers.

    Orders are numbered inside their customer, the only shuffle, which deals rows out
    by document for all that follows."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment", "c_nationkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    key = "c_custkey"
    day = f"concat(lpad(cast({key} % 28 + 1 as string), 2, '0'), '/', lpad(cast({key} % 12 + 1 as string), 2, '0'), '/', cast(1950 + {key} % 50 as string))"
    exprs = _expressions(day, f"lpad(cast({key} % 10000 as string), 4, '0')", f"lpad(cast({key} % 100000000 as string), 8, '0')", "cast(c_nationkey as string)")
    head = customers.select(F.col(key).alias("cust"), F.posexplode(F.expr(f"array({', '.join(exprs)})")).alias("row", "tokens"))
    what = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("SALARY"), F.lit("CREDIT"))).when(F.col("o_orderpriority") == "2-HIGH", F.array(F.concat(F.lit("UPI/"), F.col("o_orderkey").cast("string")))).otherwise(F.array(F.lit("Card"), F.lit("Purchase")))
    whom = F.element_at(F.array(F.lit("BIGBASKET"), F.lit("Infotech"), F.lit("METRO")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    tokens = F.concat(F.array(F.date_format("o_orderdate", "dd-MM-yyyy")), what, F.array(whom, F.col("o_totalprice").cast("decimal(12,2)").cast("string")))
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    lines = orders.select(F.col("o_custkey").alias("cust"), (number + (len(HEAD) - 1)).alias("row"), tokens.alias("tokens"))
    return placed(head.union(lines))


def placed(rows: DataFrame) -> DataFrame:
    """Fragments of rows of tokens (cust, row, tokens): x goes on by ten a character and
    eight a word; every other word sits two lower; seq counts a hundred a row."""
    before = F.transform("tokens", lambda t, i: F.aggregate(F.slice("tokens", 1, i), F.lit(10), lambda a, x: a + F.length(x) * 10 + 8))
    each = rows.select("cust", "row", F.posexplode(F.arrays_zip(F.col("tokens").alias("text"), before.alias("x"))).alias("tok", "t"))
    seq = (F.col("row") * 100 + F.col("tok")).cast("int")
    return each.select(
        F.col("cust").cast("string").alias("doc_id"), seq.alias("seq"), F.format_string("w%06d", seq).alias("frag_id"), "t.text", "t.x", (10 + F.col("row") * 30 + F.col("tok") % 2 * 2).cast("int").alias("y"), (F.length("t.text") * 10).alias("w"), F.lit(20).alias("h"), F.lit(96.0).alias("conf")
    )


_DAY = "lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') || '/' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '/' || CAST(1950 + c_custkey % 50 AS VARCHAR)"
_HEAD_SQL = ", ".join(_expressions(_DAY, "lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')", "lpad(CAST(c_custkey % 100000000 AS VARCHAR), 8, '0')", "CAST(c_nationkey AS VARCHAR)")).replace("array(", "list_value(")
LEDGER_SQL = f"""
ledger_head AS (SELECT c_custkey AS cust, list_value({_HEAD_SQL}) AS rows FROM customer),
ledger_rows AS (
  SELECT cust, i - 1 AS "row", rows[i] AS tokens FROM (SELECT cust, rows, unnest(range(1, len(rows) + 1)) AS i FROM ledger_head)
  UNION ALL
  SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) + {len(HEAD) - 1},
    list_concat(list_concat(list_value(strftime(o_orderdate, '%d-%m-%Y')),
      CASE o_orderpriority WHEN '1-URGENT' THEN list_value('SALARY', 'CREDIT') WHEN '2-HIGH' THEN list_value('UPI/' || CAST(o_orderkey AS VARCHAR)) ELSE list_value('Card', 'Purchase') END),
      list_value(list_value('BIGBASKET', 'Infotech', 'METRO')[CAST(o_orderkey % 3 + 1 AS INT)], CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR)))
  FROM orders),
ledger_tokens AS (SELECT cust, "row", tokens, unnest(range(1, len(tokens) + 1)) AS tok FROM ledger_rows),
frags AS (
  SELECT CAST(cust AS VARCHAR) AS doc_id, CAST("row" * 100 + tok - 1 AS INT) AS seq, 'w' || lpad(CAST("row" * 100 + tok - 1 AS VARCHAR), 6, '0') AS frag_id, tokens[tok] AS text,
    CAST(10 + coalesce(list_sum(list_transform(tokens[1:tok - 1], lambda t: length(t) * 10 + 8)), 0) AS INT) AS x,
    CAST(10 + "row" * 30 + (tok - 1) % 2 * 2 AS INT) AS y, CAST(length(tokens[tok]) * 10 AS INT) AS w, 20 AS h
  FROM ledger_tokens)"""
