import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veilspark.llm import binary, bpe, components, jaccard, langid, mixing, mjpeg, quality, sharding, toxicity, urls
from veilspark.llm.common import prefix_sums, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use themselves.
CLASH = """id size score shard taken node key range rank group kept n comp host ids toxic label good _id _h _k _copies _range _source _epochs _cut _kept _kept_key
_text_key _n _c _g _p _comp _node _doc _at _of _size _start _inside _total _r _left _ends _lang _chars part nid band sig words hits batch seq block all one deal""".split()
LONG = " ".join(f"word{k % 4001}" for k in range(30_000))
ODD = [(1, None, "en", "a", 0), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "a", 3), (4, "one", "en", "b", 3), (5, "same text here with more than five words", "en", "a", 40), (6, "same text here with more than five words", "en", "a", 40), (6, "same text here with more than five words", "en", "a", 40), (7, LONG, "en", "hot", len(LONG)), (8, "é" * 5000, "fr", "hot", 5000), (None, "no id at all but some words in it", None, None, 30), (9, "1234 567 ### $$$", "de", "hot", 15)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- op1 ----------------------------------------------------------------------


def test_urls_rules_and_parts(spark):
    pages = spark.createDataFrame([(1, "HTTPS://WWW.Example.com/en/x?a"), (2, "http://a.example.com/en/"), (3, "http://b.com"), (4, "x://y.net/fr/#z"), (5, None), (6, "no scheme"), (7, "http://é.net:80/es/q"), (7, "http://é.net:80/es/q"), (8, "http://evilcom/")], "page_id long, url string").select("*", *[F.lit(1).alias(c) for c in ("host", "id", "verdict", "good")])
    outcomes = spark.createDataFrame([(1, 1), (1, 0), (99, 1), (None, 1), (2, None)], "id long, good int")
    got = {r["page_id"]: r for r in urls.judge(pages, outcomes).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (got[2]["rule"], got[2]["verdict"]) == ("example.com/en/", "block")
    assert (got[3]["path"], got[3]["rule"]) == ("", None) and (got[4]["rule"], got[4]["verdict"]) == ("net/fr/", "block")
    assert got[5]["host"] == got[6]["host"] == "" and got[7]["host"] == "é.net:80" and got[7]["rule"] is None and got[8]["rule"] is None
    assert urls.judge(pages, outcomes).count() == 9 and urls.judge(pages.where("false"), outcomes).count() == 0
    assert urls.judge(pages, outcomes.where("false")).count() == 9


def test_reputation_shrinks_towards_the_parent(spark):
    hosts = spark.createDataFrame([("a.x.com", 100, 5), ("b.x.com", 1, 1), ("c.x.com", 0, 0), ("a.y.com", 200, 195), ("b.y.com", 0, 0), ("z.co.uk", 3, 3)], "host string, n long, s long")
    got = {r["host"]: r for r in urls.reputations(hosts).collect()}
    assert got["a.x.com"]["mean"] < got["c.x.com"]["mean"] < got["b.x.com"]["mean"] < got["b.y.com"]["mean"] < got["a.y.com"]["mean"]
    assert got["a.y.com"]["reputable"] and not got["a.x.com"]["reputable"]


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.gob.mx:8080": ("x.gob.mx", "gob.mx"), "www.example.com": ("example.com", "com"), "co.uk": ("co.uk", "uk"), "localhost": ("localhost", "localhost"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "": ("", ""), "t.co": ("t.co", "co"), "net.io": ("net.io", "io")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string").withColumn("d", urls.domain_of(F.col("host"))).withColumn("s", urls.suffix_of(F.col("d")))
    assert {r["host"]: (r["d"], r["s"]) for r in df.collect()} == hosts


# --- op2 ----------------------------------------------------------------------


def brute_classes(texts):
    sets = {k: ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.encode().split()) else {()}) for k, t in texts.items()}
    root, links = {k: k for k in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (find(k), links[k]) for k in keys}


def test_jaccard_equals_brute_force_on_near_copies(spark):
    rng = random.Random(5)
    texts, k = {}, 0
    for _ in range(8):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(4, 120))]
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            texts[k], k = " ".join(copy), k + 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (1, 4, 256):
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.link_classes(docs, jaccard.Settings(block=block)).collect()}
        assert got == brute_classes(texts)


def test_chains_cost_their_length(spark):
    words = [f"w{k}" for k in range(1200)]
    texts = {k: " ".join(words[5 * k : 5 * k + 100]) for k in range(200)}  # each like the next ones only
    s = jaccard.Settings(block=4)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.link_classes(docs, s).collect()} == brute_classes(texts)
    classes = jaccard.sketches(docs, s, "doc_id", "text").select(F.col("id").alias("nid"), "sig")
    placed = jaccard.blocks_of(classes.withColumn("comp", F.lit(0).cast("long")), s)
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    n = jaccard.meeting_blocks(jaccard.band_rows(classes, s), placed).count()
    assert sum(sizes) == 200 and n < len(sizes) * (len(sizes) + 1) // 2 * 0.8


def test_jaccard_odd_rows(odd, empty):
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.link_classes(odd).collect())
    assert got[6, 5, 2] == 2 and got[5, 5, 2] == 1 and got[1, 1, 0] == 2 and got[None, None, 0] == 1 and got[2, 2, 1] == got[3, 2, 1] == 1
    assert sorted(r["doc_id"] or 0 for r in jaccard.keep_one(odd).collect()) == [0, 1, 1, 2, 4, 5, 7, 8, 9]
    assert jaccard.keep_one(odd).columns == odd.columns
    assert jaccard.link_classes(empty).count() == jaccard.keep_one(empty).count() == 0


def test_keep_one_keeps_a_row_of_each_text_of_an_id(spark):
    a, b, c, d = ("".join(f"{x}{k} " for k in range(40)) for x in "abcd")
    rows = [(1, a), (1, b), (2, b), (3, a), (4, c), (5, c), (5, d), (5, d)]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, a), (1, b), (4, c), (5, d)]


def test_pruning_keeps_what_reaches_the_threshold():
    for n in range(16, 161, 16):
        m = jaccard.least_matches(n, 0.8, 1e-6)
        assert 0 <= m < 0.8 * n


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: find(k) for k in root if find(k) != k}


# --- op3 ----------------------------------------------------------------------


def test_quality_base_counts_equal_plain_python(spark, sf_dir, odd, empty):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").union(odd.select("doc_id", "text", "lang"))
    texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["id"]: r for r in quality.judge(docs.where("doc_id > 9 OR doc_id = 7")).collect()}
    for (k, t), _ in texts.items():
        if k not in got or k is not None and k <= 9 and t != LONG:
            continue
        w = words_of(t)
        n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        if k > 9:
            r = got[k]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
    assert quality.judge(odd).count() == len(ODD) and quality.judge(empty).count() == 0
    kept = {r["id"]: r["kept"] for r in quality.judge(odd).collect()}
    assert kept[1] is False and kept[2] is False


def test_common_words_are_counted_whatever_their_capitals(spark):
    df = spark.createDataFrame([(1, "The cat, and THE dog. the! Und so;weiter und, the-", "en")], "doc_id long, text string, lang string")
    common = quality.features(df).first()["common"]
    got = {w: n for w, n in zip(quality.WORDS, common) if n}
    assert got == {"the": 3, "and": 1, "und": 2} and common[-1] == len(words_of(df.first()["text"])) - 6


def test_js_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.0, 0.5, 0.5]
    df = spark.createDataFrame([(p, q), (p, p)], "p array<double>, q array<double>").select(quality.js_distance(F.col("p"), F.col("q")).alias("d"))
    assert [round(r["d"], 6) for r in df.collect()] == [round(0.5**0.5, 6), 0.0]


# --- op4 ----------------------------------------------------------------------


def test_bpe_equals_the_library(spark, sf_dir, odd, empty):
    import public_tokenizers

    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    docs = odd.select("doc_id", "text").union(table(spark, sf_dir, "documents").select(F.col("doc_id") + 100, "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = bpe.digests(bpe.encode_documents(docs, long_chars=2000)).collect()
    assert len(got) == docs.count() and bpe.encode_documents(empty).count() == 0
    for r in got:
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_bpe_cuts_are_safe():
    import public_tokenizers

    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice("ab c1  2\n\n'sé. ß漢’\x1c") for _ in range(rng.randrange(200)))
        assert bpe.encode_text(enc, t, 8).tolist() == enc.encode_ordinary(t)
    assert bpe.encode_text(enc, "a" * 3000, 100).tolist() == enc.encode_ordinary("a" * 3000)


# --- op5 ----------------------------------------------------------------------


def py_targets(sizes, weights):
    total, caps = 1.5 * sum(sizes), [2.0 * s for s in sizes]
    t, capped = [0.0] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(caps[i] for i in capped)
        for i in range(len(sizes)):
            t[i] = caps[i] if i in capped else rest * weights[i] / sum(weights[j] for j in free)
        over = {i for i in free if t[i] > caps[i]}
        if not over:
            return t
        capped |= over


def test_mixing_targets_and_cuts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    for s, size, target in zip(names, sizes, py_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True):
        assert all(r["source_size"] == size and abs(r["target"] - target) < 1e-6 * max(1, target) for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target) <= 1
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    taken = Counter(r["doc_id"] for r in mixing.take(docs).select("doc_id").collect())
    assert taken == Counter({r["id"]: r["copies"] for r in rows if r["copies"]})


def test_mixing_query_equals_the_plain_cut(spark, sf_dir):
    df = entry.queries()["op5_mixing"](spark, sf_dir)
    assert df.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    got = {r["doc_id"]: r for r in df.collect()}
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.xxhash64("doc_id", F.lit(mixing.SEED)).alias("key")).collect()
    by = {}
    for r in docs:
        by.setdefault(r["source"], []).append((r["key"], r["doc_id"], len(words_of(r["text"]))))
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(n for _, _, n in by[s]) for s in names]
    for s, size, target in zip(names, sizes, py_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))]), strict=True):
        epochs = int(target // size) if size else 0
        left = int(target) - epochs * size
        for _, k, n in sorted(by[s]):
            part = min(n, max(left, 0))
            left -= n
            assert (got[k]["size"], got[k]["source_size"], got[k]["taken"]) == (n, size, epochs * n + part) and abs(got[k]["target"] - target) < 1e-6 * target


def test_mixing_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and {r["taken"] for r in rows if r["size"] == 0} == {0}
    assert mixing.mix(empty).count() == mixing.take(empty).count() == 0
    assert mixing.take(odd).columns == odd.columns


def test_prefix_sums(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("p"), F.xxhash64("id").alias("k"), "id", (F.col("id") % 7).alias("w"))
    got = prefix_sums(df, ["p"], "k", ["id"], "w", "before", 64).collect()
    for p in range(3):
        total = 0
        for r in sorted((r for r in got if r["p"] == p), key=lambda r: r["k"]):
            assert r["before"] == total
            total += r["w"]


# --- op6 ----------------------------------------------------------------------


def check_shards(rows, shards):
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_sharding_is_even_and_keeps_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sharding.shard(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check_shards(rows, 24)
    assert all(r["size"] == len(texts[r["id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["id"]].encode()) for r in rows)
    where = {}
    for r in rows:
        where.setdefault(texts[r["id"]], set()).add(r["shard"])
    groups = Counter(texts.values())
    room = len(texts) // 24
    assert sum(len(where[t]) > 1 for t, n in groups.items() if 1 < n <= room) <= 1


def test_sharding_splits_a_group_too_large_for_a_shard(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 90, "hot").when(F.col("id") < 120, F.concat(F.lit("p"), F.col("id") % 15)).otherwise(F.col("id").cast("string")).alias("text"))
    rows = sharding.shard(docs, 4).collect()
    check_shards(rows, 4)
    assert sum(n for _, n in Counter(r["shard"] for r in rows if r["id"] < 90).most_common(2)) >= 75  # two shards hold 100


def parted(rows, group):
    where = {}
    for r in rows:
        where.setdefault(group(r["id"]), set()).add(r["shard"])
    return sum(len(x) > 1 for x in where.values())


def test_sharding_keeps_pairs_where_no_text_is_unique(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("p"), F.col("id") % 1000).alias("text"))
    rows = sharding.shard(docs).collect()
    check_shards(rows, 24)
    assert parted(rows, lambda k: k % 1000) == 8  # 16 shards of 83 places: one is left in each
    triples = docs.where("doc_id < 120").select("doc_id", F.concat(F.lit("t"), F.col("doc_id") % 40).alias("text"))
    rows = sharding.shard(triples, 4).collect()
    check_shards(rows, 4)
    assert parted(rows, lambda k: k % 40) == 0


def test_sharding_moves_more_rows_than_are_free(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 980, F.col("id") % 490).otherwise(F.col("id")).alias("text").cast("string"))
    rows = sharding.shard(docs).collect()
    check_shards(rows, 24)
    assert parted(rows, lambda k: k % 490 if k < 980 else k) == 0  # 16 odd shards take a unique row each


@pytest.mark.parametrize("level", [True, False])
def test_packing_fills_and_parts_few(level):
    rng = np.random.default_rng(1)
    for _ in range(200):
        sizes = Counter(int(n) for n in rng.zipf(1.6, 40) if 1 < n < 500) or Counter([2])
        total, shards = sum(n * c for n, c in sizes.items()), int(rng.integers(1, 9))
        caps = [total // shards + (s < total % shards) for s in range(shards)]
        groups, load = {}, [0] * shards
        for n, lo, hi, s, part in sharding.pack(sizes, caps, level):
            load[s] += (hi - lo) * part
            for i in range(lo, hi):
                groups.setdefault((n, i), []).append(part)
        assert load == caps and all(sum(p) == n for (n, _), p in groups.items()) and len(groups) == sum(sizes.values())
        assert sum(len(p) > 1 for p in groups.values()) < shards


def test_sharding_query(spark, sf_dir):
    df = entry.queries()["op6_sharding"](spark, sf_dir)
    assert df.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    rows, texts = df.collect(), {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    check_shards(rows, 24)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)} and sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]].encode()) + 8, zlib.crc32(texts[r["doc_id"]].encode())) for r in rows)


def test_sharding_odd_rows(odd, empty):
    rows = sharding.shard(odd, 3).collect()
    assert len(rows) == len(ODD) and sharding.shard(empty).count() == 0
    check_shards(rows, 3)


# --- op7 ----------------------------------------------------------------------


def plain_kneser_ney(texts, query, alphabet_of=None):
    """Bits a character by a dictionary implementation of the same model."""
    def chars(t):
        t = "".join(c.lower() if c.isalpha() else " " for c in t)
        return re.sub(" +", " ", t) + ("" if t.endswith(" ") else " ")

    def grams(t):
        s = "   " + chars(t).removeprefix(" ") if chars(t).startswith(" ") else "   " + chars(t)
        return [s[i : i + 4] for i in range(len(s) - 3)]

    counts = Counter(g for t in texts for g in grams(t))
    tables = [counts]
    for _ in range(3):
        tables.append(Counter(g[1:] for g in tables[-1]))
    alphabet = len({g[-1] for own in (alphabet_of or {"": texts}).values() for t in own for g in grams(t)})

    def discount(t):
        once, twice = (sum(v == k for v in t.values()) for k in (1, 2))
        return min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5

    total = 0.0
    asked = grams(query)
    for g in asked:
        p = 1 / (alphabet + 1)
        for n in (1, 2, 3, 4):
            t, key = tables[4 - n], g[4 - n :]
            ctx = {k: v for k, v in t.items() if k[:-1] == key[:-1]}
            if ctx:
                s = sum(ctx.values())
                p = max(t.get(key, 0) - discount(t), 0) / s + discount(t) * len(ctx) / s * p
        total -= np.log2(p)
    return total / len(asked), len(asked)


def test_kneser_ney_equals_the_plain_model():
    texts = ["the cat sat on the mat", "a dog ate the cat's hat", "Zwölf Boxkämpfer"]
    grams, counts = np.unique(langid.grams_of(texts)[0], return_counts=True)
    model = langid.LanguageModel.of({"xx": (grams, counts)})
    for q in ("the hat of a dog", "qqq zzz", "Übermut", "x"):
        bits, n = plain_kneser_ney(texts, q)
        h, size = model.entropies([q])
        assert size[0] == n and abs(h[0, 0] - bits) < 1e-4


def test_langid_learns_and_holds_out(spark, sf_dir, odd, empty):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, langid.is_training())
    found = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    assert held.count() > 30 and held.where("lang = lang_pred").count() >= 0.95 * held.count()
    assert found.where("rejected").count() <= 0.01 * docs.count() and found.where("score < 0 OR score > 1").count() == 0
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", True) and got[4][0] in model.langs
    assert langid.keep_identified(odd, model).columns == odd.columns and langid.predict(empty, model).count() == 0
    foreign = {0: "Это русский текст о том, как люди живут в большом городе. " * 4, 1: "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)), 2: "QmFzZTY0IGlzIG5vIGxhbmd1YWdl" * 20, 3: "qwzx jkvq", 4: "42 !"}
    strange = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(list(foreign.items()), "doc_id long, text string"), model).collect()}
    assert all(strange[k]["rejected"] and strange[k]["score"] < 0.01 for k in (0, 1, 2, 4)) and strange[4]["lang_pred"] == "und"
    assert found.where("NOT rejected AND score < 0.5").count() <= 0.02 * docs.count()
    none = langid.train(empty, langid.is_training())
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}


def test_a_few_garbled_rows_lift_no_limit(spark):
    rng = random.Random(7)
    words = "the cat sat on a mat and then it ran to the old house by the sea where many dogs live".split()
    rows = [(k, " ".join(rng.choice(words) for _ in range(40)), "en") for k in range(300)] + [(900 + k, "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(200)), "en") for k in range(3)]
    rows += [(2000 + k, " ".join(rng.choice(["kala", "meri", "talo", "puu", "vesi"]) for _ in range(4)), "fi") for k in range(5)]  # a rare language of short texts
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    garbled = "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(300))
    langs, scores, _, rejected = model.predict([rows[0][1], garbled, "kala meri talo", "kala " + garbled, None])
    assert (langs[0], langs[2], langs[4]) == ("en", "fi", "und") and rejected.tolist() == [False, True, False, True, True]
    assert set(model.limits) == {"en", ""} and scores[0] > 0.9 > 0.1 > scores[1]
    tie = langid.train(spark.createDataFrame([(k, "one and the same", x) for k, x in enumerate(["b", "a"])], "doc_id long, text string, lang string"), F.lit(True))
    assert tie.predict(["one and the same"])[0] == ["a"]


@pytest.mark.parametrize("query", ["op7_langid", "pipeline"])
def test_limits_of_rejection_come_from_every_training_row(spark, query):
    rng = random.Random(11)
    words = "the cat sat on a mat and then it ran to the old house by the sea where many dogs live".split()
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 10, 40]))), "en") for k in range(4000)] + [(9000 + k, " ".join(rng.choice(["kala", "meri", "talo"]) for _ in range(5)), "fi") for k in range(30)] + [(9900, "42 !", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    own = {}
    for _, text, lang in rows[:-1]:
        h, size = model.entropies([text])
        own.setdefault(lang, []).append(h[0, model.langs.index(lang)] - langid.SHORT / size[0] ** 0.5)
    for lang, bits in (own | {"": sum(own.values(), [])}).items():
        middle = np.median(bits)
        most = middle + max(langid.DEVIATIONS * 1.4826 * np.median(np.abs(bits - middle)), langid.LEAST_BITS)
        assert abs(model.limits[lang] - most) < 0.02, lang
    if query == "pipeline":  # what keep_identified drops is what those limits reject
        assert {r["doc_id"] for r in langid.keep_identified(docs, model).collect()} == {k for (k, *_), bad in zip(rows, model.predict([t for _, t, _ in rows])[3], strict=True) if not bad}
    else:
        assert langid.median(np.array([3.0, 1.0, 2.0]), np.array([1, 1, 2])) == 2 and langid.median(np.array([1.0, 2.0]), np.array([2, 2])) == 1.5


def test_langid_query_equals_the_plain_model(spark, sf_dir):
    df = entry.queries()["op7_langid"](spark, sf_dir)
    assert df.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    got = {r["doc_id"]: r for r in df.collect()}
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()
    training = {}
    for r in docs:
        held = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        assert got[r["doc_id"]]["held_out"] == held
        if not held and r["lang"] is not None and r["text"] is not None:
            training.setdefault(r["lang"], []).append(r["text"])
    some = [r for r in docs if r["text"] and got[r["doc_id"]]["held_out"] and len(r["text"]) < 400][:4]
    assert some
    for r in some:  # each language's plain model over all training texts
        alphabet_bits = {x: plain_kneser_ney(t, r["text"][:60], alphabet_of=training)[0] for x, t in training.items()}
        h, _ = langid.train(table(spark, sf_dir, "documents"), langid.is_training()).entropies([r["text"][:60]]) if r is some[0] else (None, None)
        if h is not None:
            assert np.allclose(h[0], [alphabet_bits[x] for x in sorted(alphabet_bits)], atol=1e-4)
            break


# --- op8 ----------------------------------------------------------------------


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms, prefixes = ["idiot", "moron", "trash", "scum", "idiom"], ["lowe"]
    automaton = toxicity.Automaton(terms, prefixes)
    for _ in range(20_000):
        w = list(rng.choice(terms + prefixes))
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice(["", "x", "o", "m"])
        w = "".join(w)
        near = [(distance(w, t), t) for t in terms if w == t or len(t) >= 5 and distance(w, t) <= 1]
        wanted = ("lowe", 0) if w.startswith("lowe") else (min(near)[1], min(near)[0]) if near else None
        assert automaton.match(w) == wanted


def test_quotation_counts_less():
    model = toxicity.ToxicityModel({"idiot": 6.0}, frozenset(), 2.0, 1.0, -3.0)
    plain, quoted, told, wrong = (model.evidence(t) for t in ("you idiot there", 'the word "idiot" itself', 'she said "you idiot" again', "you idioot"))
    assert plain == 6.0 and told < quoted < plain and wrong == 2.0 and model.evidence("a clean text") == 0.0


def plain_evidence(model, text):
    """The score by edit distances to every term, without any automaton."""
    low, best, kinds = text.lower(), {}, {}
    words = [t for t in model.weights if t[-1] != "*"]
    begins = [t[:-1] for t in model.weights if t[-1] == "*"]
    for m in toxicity.WORDS.finditer(low):
        w = m[0]
        hit = next(((p, 0) for n in range(1, len(w) + 1) for p in begins if p == w[:n]), None)
        if hit is None:
            near = sorted((distance(w, t), t) for t in words if w == t or len(t) >= toxicity.FUZZY_LETTERS and abs(len(w) - len(t)) < 2 and distance(w, t) <= 1)
            hit = (near[0][1], near[0][0]) if near else None
        if hit and not (hit[1] and w in model.harmless):
            best[hit] = max(best.get(hit, 0.0), toxicity.context(low, m.start(), m.end()))
            kinds.setdefault(hit, set()).add(w)
    total = 0.0
    for (term, edits), share in best.items():
        weight = model.weights.get(term, model.weights.get(term + "*", 0.0))
        total += share * (min(weight, model.fuzzy_weight) if edits else weight * (1 + np.log2(len(kinds[term, edits]))))
    return total


def test_toxicity_query_equals_the_plain_score_and_finds_held_out_rows(spark):
    import os

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("needs the larger tables")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    df = entry.queries()["op8_toxicity"](spark, sf)
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = df.join(docs.select("doc_id", "text"), "doc_id").join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", "left").collect()
    assert len(rows) == docs.count() and all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    toxic, clean = ([r["predicted"] for r in held if (r["toxic"] > 0) == kind] for kind in (True, False))
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)
    model = toxicity.train(docs, labels, toxicity.is_training())
    for r in [r for r in held if r["predicted"]][:25] + held[:25]:
        x = plain_evidence(model, r["text"])
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -40, 40)))) < 1e-9


def test_toxicity_learns(spark, odd, empty):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)) + (" stupid clown" if k % 8 == 0 else "")) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(800)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, toxicity.is_training())
    assert {"stupid", "clown"} >= set(model.weights) and model.weights
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((s >= 0.5) == (k % 8 == 0) for k, s in got.items())
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(empty, model).count() == 0
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    none = toxicity.train(docs, labels.where("false"), toxicity.is_training())
    assert toxicity.score(docs, none).where("score >= 0.5").count() == 0


# --- op9 ----------------------------------------------------------------------


def test_pack_round_trip():
    v = np.array([0, 1, 255, 256, 65535, 65536, 1 << 24, 2**32 - 1] * 3 + [7], np.uint32)
    for n in range(len(v) + 1):
        assert (binary.unpack(*binary.pack(v[:n]), n) == v[:n]).all()


def library_of(vocabulary=binary.VOCABULARY):
    """The library as it is by default, apart from the operator's own."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(vocabulary))


SPECIAL = ["<|endoftext|>", "x <|endoftext|> y", "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext |>"]


def test_atoms_encode_as_whole_texts(monkeypatch):
    rng = random.Random(3)
    letters = "\n.,(-9ñłЖ 'ab c1  2\n\n'sé. ß漢\t’ré\x85\xa0<| ×÷µ\u2003\u3000—\x1c\r\0\u0301\u00ad"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(8000)]
    texts += ["".join(rng.choice(" \n\t a.\u2003") for _ in range(rng.randrange(9))) for _ in range(4000)]
    texts += ["  a", "a  b", " \n x", " ", " a", "a\rb", "don't", " they'll.\nGo", "it''s 'S", LONG, *SPECIAL]
    whole = [e.ids for e in library_of().encode_batch(texts, add_special_tokens=False)]
    encoder = binary.Encoder(binary.VOCABULARY)
    for _ in range(2):
        assert [np.frombuffer(x, encoder.width).tolist() for x in encoder.encode(pa.array(texts)).to_pylist()] == whole
    monkeypatch.setattr(binary, "WINDOW_BYTES", 1000)
    monkeypatch.setattr(binary, "CACHED_ATOMS", 100)
    some = texts[:500] + texts[-15:]
    sliced = pa.array(["x", *some]).slice(1)
    assert [np.frombuffer(x, encoder.width).tolist() for x in encoder.encode(sliced).to_pylist()] == whole[:500] + whole[-15:]
    assert [i for a, b in binary.windows(sliced) for i in range(a, b)] == list(range(len(some)))


def test_kinds_of_bytes_agree_with_unicode():
    for cp in [*range(0x3100), 0x1F600]:
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        kinds = set(binary.kinds_of(np.frombuffer(c.encode(), np.uint8)).tolist())
        assert len(kinds) == 1
        (kind,) = kinds
        if c.isspace() and cp not in (0x1C, 0x1D, 0x1E, 0x1F):
            assert kind in (binary.SPACE, binary.BREAK, binary.UNSURE)
        if kind == binary.LETTER:
            assert c.isalpha()


def test_token_files_round_trip(spark, sf_dir, odd, empty):
    library = library_of()
    special = spark.createDataFrame([(50 + k, t) for k, t in enumerate(SPECIAL)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(special).union(table(spark, sf_dir, "documents").select(F.col("doc_id") + 100, "text"))
    path = binary.write_ids(docs, block_ids=5000)
    rows = binary.read_ids(spark.newSession(), path).orderBy("start").collect()  # all that reading needs is in the files
    keys = [r["doc_id"] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k)) and len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    at = 0
    for r in rows:
        ids = [*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (at, len(ids), ids)
        at += len(ids)
    assert binary.read_ids(spark, binary.write_ids(empty)).count() == 0


def test_token_ids_query(spark, sf_dir):
    df = entry.queries()["op9_token_ids"](spark, sf_dir)
    assert df.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    got = {r["doc_id"]: tuple(r)[1:] for r in df.collect()}
    library, at = library_of(), 0
    for r in table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert got[r["doc_id"]] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# --- op10 ---------------------------------------------------------------------


def test_frames_round_trip():
    rng = np.random.default_rng(1)
    for s in (rng.integers(0, 256, (7, 576)).astype(np.uint8), np.full((2, 576), 255, np.uint8), np.zeros((1, 576), np.uint8)):
        images = mjpeg.encode_frames(s)
        assert (mjpeg.decode_frames(images) == s).all() and mjpeg.avi_frames(mjpeg.avi(images)) == images
    other = mjpeg.SOI + mjpeg.DHT + mjpeg.SOF3 + mjpeg.SOS + images[0][len(mjpeg.HEADER) :]
    assert (mjpeg.decode_frames([other]) == s).all()
    for bad in (b"", b"RIFFxxxx", mjpeg.avi(images)[:40]):
        with pytest.raises(ValueError):
            mjpeg.avi_frames(bad)


def test_shots_are_found():
    rng = np.random.default_rng(2)
    dark, light = rng.integers(0, 60, (20, 576)), rng.integers(150, 255, (15, 576))
    film = np.concatenate([dark, light]).astype(np.uint8)
    assert np.flatnonzero(mjpeg.cuts_of(film, np.zeros(35, np.int64))).tolist() == [0, 20]
    two = np.concatenate([film, film])
    assert np.flatnonzero(mjpeg.cuts_of(two, np.repeat([0, 35], 35))).tolist() == [0, 20, 35, 55]


def plain_cuts(film):
    """The shots of one film, by the rule as it reads."""
    hists = [np.bincount(f >> 4, minlength=16) for f in film]
    d = [int(abs(a - b).sum()) for a, b in zip(hists, hists[1:])]
    cuts = [0]
    for k, x in enumerate(d):
        past = d[max(0, k - 8) : k]
        if len(past) < 2:
            cut = x > 576
        else:
            mean = Fraction(sum(past), len(past))
            var = Fraction(sum(p * p for p in past), len(past)) - mean**2
            cut = x > 138 and x > mean and (x - mean) ** 2 > 9 * var
        cuts += [k + 1] * cut
    return cuts


def test_shots_do_not_depend_on_other_films():
    rng = np.random.default_rng(4)
    films = [rng.integers(0, rng.integers(20, 256), (rng.integers(1, 60), 576)).astype(np.uint8) for _ in range(60)]
    for f in films[::2]:
        for k in range(1, len(f), 5):
            f[k:] = np.roll(f[k:], 7, axis=1) // rng.integers(1, 4)
    steady = np.zeros((40, 576), np.uint8)
    steady[1::2, :100] = 200  # a constant difference of 200
    hard = np.zeros((3, 576), np.uint8)
    hard[1:] = 255
    films += [steady, hard, steady]
    starts = np.cumsum([0, *map(len, films)])
    cut = mjpeg.cuts_of(np.concatenate(films), np.repeat(starts[:-1], [len(f) for f in films]))
    found = [np.flatnonzero(cut[a:b]).tolist() for a, b in zip(starts, starts[1:])]
    assert found == [plain_cuts(f) for f in films] and any(len(x) > 1 for x in found)
    assert found[-1] == found[-3] == [0] and found[-2] == [0, 1]


def plain_image(samples):
    """A lossless JPEG of one frame, sample by sample."""
    bits = ""
    for y in range(24):
        for x in range(24):
            d = int(samples[y, x]) - (int(samples[y, x - 1]) if x else int(samples[y - 1, 0]) if y else 128)
            c = abs(d).bit_length()
            code, n = mjpeg.CODES[c]
            bits += f"{code:0{n}b}" + (f"{d if d > 0 else d + (1 << c) - 1:0{c}b}" if c else "")
    bits += "1" * (-len(bits) % 8)
    return mjpeg.HEADER + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + mjpeg.EOI


def test_media_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    df = entry.queries()["op10_avi_mjpeg"](spark, sf_dir)
    assert df.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string")]
    got = {r["doc_id"]: r for r in df.collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        payload = t + b"\xff" * (-len(t) % 576 or (0 if t else 576))
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        film = np.frombuffer(payload, np.uint8).reshape(-1, 576)
        ends = [*plain_cuts(film)[1:], len(film)]
        assert r["feature"] == f"frames={len(film)};clips=" + ",".join(f"{a}-{b - 1}" for a, b in zip([0, *ends], ends))
        if len(film) < 3:
            media = mjpeg.avi([plain_image(x.reshape(24, 24)) for x in film])
            assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


def test_equal_texts_have_equal_media(spark, sf_dir):
    other = table(spark, sf_dir, "documents").select("doc_id", "text").limit(30)
    same = spark.range(30).select((F.col("id") + 10_000).alias("doc_id"), F.lit(LONG[:40_000]).alias("text"))
    docs = other.union(same).orderBy(F.xxhash64("doc_id")).select("doc_id", F.col("text").cast("binary").alias("payload"))
    read = mjpeg.read_media(mjpeg.write_media(docs)).where("doc_id >= 10000")
    assert read.count() == 30 and read.select("media", "clips").distinct().count() == 1


def test_media_round_trip(spark, odd, empty):
    docs = odd.select("doc_id", F.col("text").cast("binary").alias("payload"), F.col("text"))
    read = mjpeg.read_media(mjpeg.write_media(docs)).collect()
    texts = Counter(((r["text"] or "").encode(), r["doc_id"]) for r in docs.collect())
    assert Counter((bytes(r["payload"]).rstrip(b"\xff"), r["doc_id"]) for r in read) == texts
    for r in read:
        assert len(r["payload"]) % 576 == 0 and r["payload"] and r["clips"][0]["first_frame"] == 0 and r["clips"][-1]["last_frame"] + 1 == len(r["payload"]) // 576
    empties = [r for r in read if r["n_bytes"] == 0]
    assert len({bytes(r["media"]) for r in empties}) == 1 and bytes(empties[0]["payload"]) == b"\xff" * 576
    assert mjpeg.read_media(mjpeg.write_media(docs.where("false"))).count() == 0
    assert mjpeg.clip_table(mjpeg.read_media(mjpeg.write_media(docs))).count() >= len(ODD)


# --- pipeline -----------------------------------------------------------------


def test_pipeline_keeps_its_promises(spark, sf_dir):
    import corpus_pipeline as pipeline
    from veilspark.llm.common import written

    docs = table(spark, sf_dir, "documents")
    steps = {}
    for name, stage in pipeline.STAGES:
        out = written(stage(spark, docs, sf_dir), "step")
        if name != "encoding":
            assert out.columns == table(spark, sf_dir, "documents").columns
        steps[name], docs = out, out
    ids = {n: [r["doc_id"] for r in d.select("doc_id").collect()] for n, d in steps.items()}
    assert set(ids["toxicity"]) <= set(ids["language"]) and set(ids["near-duplicates"]) <= set(ids["toxicity"])
    texts = {r["doc_id"]: r["text"] for r in steps["toxicity"].collect()}
    assert set(ids["near-duplicates"]) == {c for c, _ in brute_classes(texts).values()} and len(ids["near-duplicates"]) == len(set(ids["near-duplicates"]))
    assert set(ids["mixing"]) <= set(ids["near-duplicates"]) and max(Counter(ids["mixing"]).values()) <= 2
    assert Counter(ids["encoding"]) == Counter(ids["mixing"])
    assert pipeline.run(spark, sf_dir).count() == len(ids["encoding"])


def test_pipeline_takes_odd_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(6)
    words = "the cat sat on a mat and then it ran to the old house by the sea where many dogs live".split()
    rows = [(100 + k, " ".join(rng.choice(words) for _ in range(30)) + (" stupid clown" if k % 6 == 0 else ""), "en", rng.choice(["a", "hot", None]), 1) for k in range(120)]
    docs = spark.createDataFrame(rows + rows[1:3] + [(100, rows[5][1], "en", "a", 1)] + ODD, DOCS).select("*", *[F.lit("x").alias(c) for c in CLASH])
    labels = spark.createDataFrame([(100 + k, 1, int(k % 6 == 0)) for k in range(120)] + [(None, None, 1), (1, 1, None)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("y"))
    for name, given in (("odd", docs), ("empty", docs.where("false"))):
        folder = str(tmp_path / name)
        given.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        read = spark.read.parquet(f"{folder}/documents.parquet")
        for step, stage in pipeline.STAGES[:-1]:
            read = stage(spark, read, folder)
            assert read.columns == docs.columns, step
        out = pipeline.run(spark, folder)
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (out.count() > 0) == (name == "odd")
    kept = {r["doc_id"] for r in pipeline.run(spark, str(tmp_path / "odd")).collect()}
    assert not kept & {1, 2, 3, 9} and not any(k and k >= 100 and (k - 100) % 6 == 0 for k in kept - {100})
