"""N-gram Jaccard self-join with Bayesian candidate pruning.

1. Each text becomes the set of its five-word shingles. Equal sets are one class
   from here on, so copies cost nothing more however many there are.
2. MinHash bands propose candidates; a band's documents are linked to one centre, so
   a group of n gives n - 1 rows, never n^2. Linked documents form clusters.
3. A cluster larger than a block is cut into blocks of like signatures, and only pairs
   of blocks that share a band meet: a chain of documents costs its length, not its
   square. Between two blocks signatures are compared a few values at a time; a pair is
   dropped once the posterior probability that it reaches the threshold falls below a
   tolerance. What survives is verified on the exact sets.
4. Each block gives back, for each document, its number of links and its root in the
   block, so that no list of pairs ever exists. Verified roots form the classes."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import drop_written, table, unused, written
from veilspark.llm.components import components

PRIME = np.uint64(0x9E3779B97F4A7C15)
CACHED_WORDS = 400_000


@dataclass(frozen=True)
class Settings:
    """A pair at exactly the threshold shares no band with probability
    (1 - threshold**rows)**bands: 3e-6 at 0.8, less above. Pruning may lose
    `tolerance` of what reaches the threshold at each of its hashes / step looks: 1e-5
    in all, so a pair at 0.8 is lost with a probability under 1.4e-5."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 5
    tolerance: float = 1e-6
    step: int = 16
    block: int = 128

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


class WordHashes(dict):
    """64-bit hash of each word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str, hashes: WordHashes, words: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of `words` words; a shorter text is one run.

    bytes.split cuts at ASCII white space and nowhere else."""
    tokens = text.encode("utf-8", "surrogatepass").split()
    if not tokens:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    k = min(words, len(w))
    n = len(w) - k + 1
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h = h * PRIME + w[i : i + n]
    h = np.sort(mixed(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


@functools.lru_cache(maxsize=4)
def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1 << 8, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(h: np.ndarray, n: int) -> np.ndarray:
    """The low 16 bits of n MinHash values."""
    a, low, high = multipliers(n), h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    best = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 1024):
        x = low[at : at + 1024, None] * a
        x += high[at : at + 1024, None]
        np.minimum(best, x.min(0), out=best)
    return best.astype(np.uint16)


def sketches(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, node, size, sig): node names the class of texts with the same
    shingles, by a hash of 128 bits; null for a null text."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in it:
            nodes, sizes, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                h = shingles(text, hashes, s.words) if text is not None else np.empty(0, np.uint64)
                nodes.append(xxhash.xxh128_digest(h.tobytes()) if text is not None else None)
                sizes.append(len(h))
                sigs.append(signature(h, s.hashes).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], names=["id", "text_key", "node", "size", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(batches, f"id {kind}, text_key long, node binary, size long, sig binary")


def band_rows(classes: DataFrame, s: Settings) -> DataFrame:
    """(band, nid, centre). A class is linked to the smallest of its Arrow batch in the
    same band at once; only one row for each band and batch is dealt out later (centre
    null), so a band that very many share is small before any shuffle."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            nids = batch.column(0).to_numpy()
            order = np.argsort(nids, kind="stable")
            nids = nids[order]
            sig = np.frombuffer(b"".join(batch.column(1).take(pa.array(order)).to_pylist()), np.uint16).reshape(-1, s.bands, s.rows).astype(np.uint64)
            for b in range(s.bands):
                key = np.full(len(nids), np.uint64(b + 1))
                for r in range(s.rows):
                    key = key * PRIME + sig[:, b, r]
                key = mixed(key).view(np.int64)
                _, first, back = np.unique(key, return_index=True, return_inverse=True)
                centre = first[back]  # the smallest: they are in order
                own = centre == np.arange(len(nids))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(nids), pa.array(nids[centre], mask=own)], names=["band", "nid", "centre"])

    return classes.where("sig IS NOT NULL").select("nid", "sig").mapInArrow(batches, "band long, nid long, centre long")


def candidate_edges(rows: DataFrame) -> DataFrame:
    near = rows.where("centre IS NOT NULL").select(F.col("nid").alias("u"), F.col("centre").alias("v"))
    firsts = rows.where("centre IS NULL").select("band", "nid")
    shared = written(firsts.groupBy(F.col("band").alias("_band")).agg(F.min("nid").alias("v"), F.count("*").alias("n")).where("n > 1").select("_band", "v"), "shared")
    far = firsts.join(shared, F.col("band") == F.col("_band")).select(F.col("nid").alias("u"), "v")  # a hot band's rows can be split over tasks
    return near.union(far)


def blocks_of(clusters: DataFrame, s: Settings) -> DataFrame:
    """(nid, comp, sig, ...) -> the same with `part`: null in a cluster of one block at
    most, else its block there. A class goes by its first MinHash value, which like
    documents mostly share; what is still too many for a block is dealt by a hash. So
    blocks come from counts alone, and nothing is sorted."""
    sizes = written(clusters.groupBy(F.col("comp").alias("_c")).agg(F.count("*").alias("members")).where(F.col("members") > s.block), "sizes")  # large clusters only; written, else the join would sit on the counts' dealing
    first = F.conv(F.hex(F.substring("sig", 1, 2)), 16, 10).cast("long")
    parts = F.ceil(F.col("members") / s.block)
    dealt = clusters.join(sizes, F.col("comp") == F.col("_c"), "left").withColumn("group", F.when(parts > 1, F.pmod(first, parts))).drop("_c", "members")
    groups = written(dealt.where("group IS NOT NULL").groupBy(F.col("comp").alias("_c"), F.col("group").alias("_g")).agg(F.count("*").alias("many")), "groups")
    cut = dealt.join(groups, (F.col("comp") == F.col("_c")) & (F.col("group") == F.col("_g")), "left")
    part = F.shiftleft("group", 24) + F.pmod(F.xxhash64("nid"), F.ceil(F.col("many") / s.block))
    return cut.withColumn("part", F.when(F.col("group").isNotNull(), part)).drop("_c", "_g", "group", "many")


def meeting_blocks(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """(comp, bi, bj), bi <= bj: blocks of the large clusters that share a band, and each
    block with itself."""
    large = placed.where("part IS NOT NULL").select(F.col("nid").alias("_n"), "comp", "part")
    seen = written(rows.select("band", "nid").join(large, F.col("nid") == F.col("_n")).select("comp", "band", "part").distinct(), "block-bands")
    other = seen.select(F.col("comp").alias("_c"), F.col("band").alias("_b"), F.col("part").alias("bj"))
    shared = seen.join(other, (F.col("comp") == F.col("_c")) & (F.col("band") == F.col("_b")) & (F.col("part") <= F.col("bj"))).select("comp", F.col("part").alias("bi"), "bj")
    return shared.distinct()


@functools.lru_cache(maxsize=8)
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest matches of n MinHash values with which a pair goes on.

    With a uniform prior the similarity's posterior is Beta(m + 1, n - m + 1), so
    P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def surviving_pairs(a: np.ndarray, b: np.ndarray, same: bool, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature blocks that are never ruled out."""
    first = (a[:, None, : s.step] == b[None, :, : s.step]).sum(2, dtype=np.uint8)
    i, j = np.nonzero(first >= least_matches(s.step, s.threshold, s.tolerance))
    if same:
        i, j = i[i < j], j[i < j]
    m = first[i, j].astype(np.int64)
    for at in range(s.step, s.hashes, s.step):
        if not len(i):
            break
        upto = min(at + s.step, s.hashes)
        m += np.concatenate([np.empty(0, np.int64), *((a[i[k : k + 65536], at:upto] == b[j[k : k + 65536], at:upto]).sum(1) for k in range(0, len(i), 65536))])
        go = m >= least_matches(upto, s.threshold, s.tolerance)
        i, j, m = i[go], j[go], m[go]
    return i, j


def intersections(sets_a: list[np.ndarray], sets_b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the given pairs of sorted sets."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    rows, at_a = np.unique(i, return_inverse=True)
    cols, at_b = np.unique(j, return_inverse=True)
    left, right = [sets_a[x] for x in rows.tolist()], [sets_b[y] for y in cols.tolist()]
    flat_a, flat_b = np.concatenate(left), np.concatenate(right)
    of_a, of_b = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (left, right))
    shared = np.intersect1d(np.unique(flat_a), np.unique(flat_b), assume_unique=True)
    total = np.zeros((len(rows), len(cols)), np.float32)
    for k in range(0, len(shared), 4096):  # incidence matrices of some shingles at a time
        some = shared[k : k + 4096]
        x, y = np.zeros((len(rows), len(some)), np.float32), np.zeros((len(cols), len(some)), np.float32)
        for m, flat, of in ((x, flat_a, of_a), (y, flat_b, of_b)):
            p = np.minimum(np.searchsorted(some, flat), len(some) - 1)
            hit = some[p] == flat
            m[of[hit], p[hit]] = 1
        total += x @ y.T
    return total[at_a, at_b].astype(np.int64)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row linked to each of n rows."""
    r = np.arange(n)
    while len(i):
        low = np.minimum(r[i], r[j])
        new = r.copy()
        np.minimum.at(new, r[i], low)
        np.minimum.at(new, r[j], low)
        new = new[new]
        if (new == r).all():
            break
        r = new
    while (r[r] != r).any():
        r = r[r]
    return r


def compare_block(rows: pa.Table, s: Settings) -> pa.Table:
    """Links between two blocks, or within one: (nid, root, links), a row for each class with links."""
    data = rows.sort_by([("part", "ascending"), ("nid", "ascending")])
    part = data["part"].to_numpy()
    nids, copies, size = data["nid"].to_numpy(), data["copies"].to_numpy(), data["size"].to_numpy()
    sig = np.frombuffer(b"".join(data["sig"].to_pylist()), np.uint16).reshape(-1, s.hashes)
    sets = [np.frombuffer(x, np.uint64) for x in data["shingles"].to_pylist()]
    cut = int((part == part[0]).sum())
    if data["bi"][0] == data["bj"][0]:
        i, j = surviving_pairs(sig, sig, True, s)
    else:
        i, j = surviving_pairs(sig[:cut], sig[cut:], False, s)
        j = j + cut
    low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    go = low >= s.threshold * high - 1e-9
    i, j = i[go], j[go]
    common = intersections(sets, sets, i, j)
    go = common >= s.threshold * (size[i] + size[j] - common) - 1e-9
    i, j = i[go], j[go]
    links = np.bincount(i, copies[j], len(nids)) + np.bincount(j, copies[i], len(nids))
    root = roots(len(nids), i, j)
    some = np.flatnonzero(links)
    return pa.table({"nid": pa.array(nids[some]), "root": pa.array(nids[root[some]]), "links": pa.array(links[some].astype(np.int64))})


def link_classes(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """(id_col, class_id, n_links) of every row.

    class_id is the smallest id of the rows linked to the row, directly or through
    others; n_links is the number of other rows with a Jaccard similarity of at
    least s.threshold, copies included. Defined cases: texts of fewer than s.words
    words are one shingle; texts without words are equal to each other; a row with a
    null text is a class of its own and has no links, even to its like; rows with a null
    id are in no class (null) and have no links; repeated rows count as copies; other
    columns are ignored; an empty table gives an empty table."""
    return linked(docs, s, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "n_links")


def linked(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, comp, class_id, n_links) of every row: comp names the class (null
    without a text or id), which class_id does not where an id has several texts;
    text_key is xxhash64 of the text."""
    sk = written(sketches(docs, s, id_col, text_col), "sketches")
    given = sk.where("id IS NOT NULL AND node IS NOT NULL")
    firsts = given.groupBy("node").agg(F.min(F.struct("id", "size", "sig")).alias("first"), F.count("*").alias("copies"))
    numbered = firsts.select(F.monotonically_increasing_id().alias("nid"), "node", F.col("first.id").alias("id"), F.col("first.size").alias("size"), F.col("first.sig").alias("sig"), "copies")
    classes = written(numbered, "classes")  # written, so that numbers stay
    rows = written(band_rows(classes, s), "bands")
    comps = components(candidate_edges(rows))
    clusters = comps.select(F.col("node").alias("_n"), "comp").union(comps.select(F.col("comp").alias("_n"), "comp").distinct())
    candidates = classes.join(clusters, F.col("nid") == F.col("_n")).drop("_n")
    placed = written(blocks_of(candidates, s), "blocks")
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    schema = "nid long, size long, sig binary, copies long, comp long, part long, shingles binary"

    def with_shingles(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in it:
            sets = [shingles(t, hashes, s.words).tobytes() for t in batch.column(7).to_pylist()]
            own = pa.array([xxhash.xxh128_digest(x) == n for x, n in zip(sets, batch.column(6).to_pylist(), strict=True)])  # an id may have several texts
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(sets, pa.binary())], names=[*batch.schema.names[:6], "shingles"]).filter(own)

    met = placed.join(texts, F.col("id") == F.col("_doc")).select("nid", "size", "sig", "copies", "comp", "part", "node", "text")
    members = written(met.mapInArrow(with_shingles, schema).dropDuplicates(["nid"]), "members")
    pairs = meeting_blocks(rows, placed)
    sides = pairs.select(F.col("comp").alias("_c"), "bi", "bj", F.explode(F.array_distinct(F.array("bi", "bj"))).alias("_p"))
    columns = ["comp", "bi", "bj", "part", "nid", "size", "sig", "copies", "shingles"]
    large = members.where("part IS NOT NULL").join(sides, (F.col("comp") == F.col("_c")) & (F.col("part") == F.col("_p"))).select(columns)
    zero = F.lit(0).cast("long")
    small = members.where("part IS NULL").withColumns({"bi": zero, "bj": zero, "part": zero}).select(columns)

    def compared(block: pa.Table) -> pa.Table:
        return compare_block(block, s)

    found = written(small.union(large).groupBy("comp", "bi", "bj").applyInArrow(compared, "nid long, root long, links long"), "links")
    for done in (rows, placed, members):
        drop_written(done)
    links = found.groupBy(F.col("nid").alias("_ln")).agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("nid").alias("u"), F.col("root").alias("v")))
    info = classes.select("nid", "node", "id", "copies").join(links, F.col("nid") == F.col("_ln"), "left").drop("_ln")
    info = info.join(groups.select(F.col("node").alias("_gn"), "comp"), F.col("nid") == F.col("_gn"), "left").select("node", "id", F.coalesce("comp", "nid").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    lowest = written(info.groupBy(F.col("comp").alias("_comp")).agg(F.min("id").alias("class_id")), "lowest")  # written as the sizes are
    named = info.join(lowest, F.col("comp") == F.col("_comp")).select(F.col("node").alias("_node"), "comp", "class_id", "n_links")
    result = sk.select("id", "text_key", "node").join(named, (F.col("node") == F.col("_node")) & F.col("id").isNotNull(), "left")
    return result.select("id", "text_key", "comp", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """The rows, with all their columns, without near duplicates: of each class the
    row with the smallest id stays (of its texts in the class, that with the smallest
    hash; of repeated rows with that id and text, one); rows with a null id or text stay.
    An id with unrelated texts is in several classes and may stay for each. An empty
    table gives an empty table."""
    named = linked(docs, s, id_col, text_col)
    kept = named.where("comp IS NOT NULL AND class_id = id").groupBy("comp").agg(F.min("id").alias("id"), F.min("text_key").alias("text_key"))
    key, kept_id, kept_key = (unused(c, *docs.columns) for c in ("_text_key", "_kept", "_kept_key"))
    known = F.col(id_col).isNotNull() & F.col(text_col).isNotNull()
    keyed = docs.where(known).withColumn(key, F.xxhash64(text_col))
    kept = kept.select(F.col("id").alias(kept_id), F.col("text_key").alias(kept_key))
    left = keyed.join(kept, (F.col(id_col) == F.col(kept_id)) & (F.col(key) == F.col(kept_key)), "left_semi")
    return left.dropDuplicates([id_col, key]).drop(key).union(docs.where(~known))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_classes(table(spark, sf_dir, "documents"))


#: Brute force over an inverted index of all shingles.
ORACLE = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
sets AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM shared JOIN sizes m ON m.doc_id = u JOIN sizes n ON n.doc_id = v WHERE 5 * c >= 4 * (m.n + n.n - c)),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT u, v FROM ways UNION SELECT r.u, b.v FROM reach r JOIN ways b ON r.v = b.u),
lowest AS (SELECT u, min(v) AS v FROM reach GROUP BY u),
counts AS (SELECT u, count(*) AS n FROM ways GROUP BY u)
SELECT doc_id, least(doc_id, coalesce(l.v, doc_id)) AS class_id, coalesce(c.n, 0)::BIGINT AS n_links FROM documents LEFT JOIN lowest l ON l.u = doc_id LEFT JOIN counts c ON c.u = doc_id
"""
