"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank by frequency, so that common ids need one byte. Of
each rank the bytes that it needs are stored, low byte first; its number of bytes is
two bits of a separate control byte, four ranks to a control byte. Reading looks the
lengths up in a table of the 256 control bytes and gathers all ranks at once."""

from __future__ import annotations

import functools
import itertools
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilspark.llm.common import drop_written, shared_dir, table, written

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
#: Ids in a block of a file, about: a block ends with the document that reaches this.
BLOCK_IDS = 1 << 21
#: Starts of at most this many blocks are broadcast (a few MB); more are joined by shuffle.
BROADCAST_BLOCKS = 100_000
CACHED_ATOMS = 850_000
#: Bytes of text that are cut at once; a longer text is cut in parts of about this size.
WINDOW_BYTES = 1 << 24
MAGIC, RANKS_MAGIC = b"VBYTE01\n", b"VRANK01\n"
#: Where texts longer than a window are parted: a match of the vocabulary's pre-split
#: pattern always begins at a space after anything but white space.
BOUNDARY = re.compile(r"(?<=\S)(?= )")
#: Atoms that stand alone between separators: the pre-split pattern makes one match
#: of the separator after anything but white space and before one space or none.
SEPARATOR, PLAIN = "\r", re.compile(r" ?[^\s](?:[^\r]*[^\s])?")
#: Atoms that are one match of the pattern: of Latin letters, digits or signs.
ONE_MATCH = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
#: Kinds of bytes. LETTER: Latin letters up to U+00FF; SIGN: ASCII signs but the
#: apostrophe; OTHER: bytes of characters that are surely no white space; BREAK: ASCII
#: white space but the space; UNSURE: what must not be cut off on either side.
LETTER, DIGIT, SIGN, APOSTROPHE, OTHER, SPACE, BREAK, UNSURE = range(8)
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def _kinds() -> np.ndarray:
    """The kind of each byte on its own; two- and three-byte characters are corrected later."""
    kinds = np.full(256, OTHER, np.uint8)
    for b in range(128):
        c = chr(b)
        kinds[b] = LETTER if c.isalpha() else DIGIT if c.isdigit() else APOSTROPHE if c == "'" else SPACE if c == " " else BREAK if c in "\t\n\x0b\x0c\r" else SIGN if c.isprintable() else UNSURE
    return kinds


def _cuts() -> np.ndarray:
    """Whether a match of the pre-split pattern surely ends between two kinds, at [before * 8 + after].

    Between runs of letters, digits and signs; before an apostrophe after letters or
    digits (it begins a match, maybe with letters after it); before white space after
    anything else; after white space that is no space, before anything else."""
    cuts = np.zeros((8, 8), bool)
    solid = [LETTER, DIGIT, SIGN, APOSTROPHE, OTHER]
    for a in (LETTER, DIGIT, SIGN):
        for b in (LETTER, DIGIT, SIGN):
            cuts[a, b] = a != b
    cuts[LETTER, APOSTROPHE] = cuts[DIGIT, APOSTROPHE] = True
    for x in solid:
        cuts[x, SPACE] = cuts[x, BREAK] = cuts[BREAK, x] = True
    return cuts.ravel()


def _byte_letters() -> dict[int, int]:
    """The character that stands for each byte in vocabularies of bytes: itself if it is
    printable Latin, else the next one from U+0100 on."""
    odd = itertools.count(0x100)
    return {b: b if chr(b).isprintable() and b not in (0x20, 0xAD) else next(odd) for b in range(256)}


KINDS, CUTS, BYTE_LETTERS = _kinds(), _cuts(), _byte_letters()


@functools.lru_cache(maxsize=2)
def tokenizer(vocabulary: str) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(vocabulary))


def kinds_of(raw: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8 texts."""
    kinds = KINDS[raw]
    lead = np.flatnonzero(raw >= 0xC2)
    if len(lead):
        first = raw[lead]
        second = raw[np.minimum(lead + 1, len(raw) - 1)]
        third = raw[np.minimum(lead + 2, len(raw) - 1)]
        latin = lead[(first == 0xC3) & (second != 0x97) & (second != 0xB7)]  # U+00C0 to U+00FF but the signs of times and division
        kinds[latin] = LETTER
        kinds[latin + 1] = LETTER
        blank = (first == 0xC2) & ((second == 0x85) | (second == 0xA0))
        blank |= (first == 0xE1) & ((second == 0x9A) | (second == 0xA0)) & ((third == 0x80) | (third == 0x8E))  # U+1680, U+180E
        blank |= (first == 0xE2) & (((second == 0x80) & ((third <= 0x8F) | ((third >= 0xA8) & (third <= 0xAF)))) | ((second == 0x81) & (third == 0x9F)))
        blank |= (first == 0xE3) & (second == 0x80) & (third == 0x80)
        at, size = lead[blank], np.where(first[blank] == 0xC2, 2, 3)
        for k in range(3):
            kinds[at[size > k] + k] = UNSURE
    return kinds


def atom_starts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where atoms begin in the bytes of texts that begin at `starts`.

    Atoms encode on their own to what they are in their text: they begin and end where
    the pre-split pattern always ends a match. Of a run of white space the pattern takes
    the last character apart, if more than white space follows."""
    kinds = kinds_of(raw)
    pair = (kinds[:-1] << 3) | kinds[1:]
    first = np.zeros(len(raw) + 1, bool)
    first[starts] = True
    cut = first[:-1].copy()
    cut[1:] |= CUTS[pair]
    blank = (kinds == SPACE) | (kinds == BREAK)
    last = np.flatnonzero(blank[:-1] & blank[1:]) + 1
    last = last[last + 1 < len(raw)]
    last = last[(kinds[last + 1] < SPACE) & ~first[last + 1]]
    cut[last] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes texts with the library, each distinct atom (see atom_starts) once while
    it is remembered. Atoms are found, made distinct and put together again by numpy and
    Arrow, not one by one; CACHED_ATOMS bounds what is remembered, what does not fit is
    encoded each time. Texts with the string of a special token go to the library whole."""

    def __init__(self, vocabulary: str) -> None:
        self.library = tokenizer(vocabulary)
        self.width = width_of(vocabulary)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        (self.separator,) = self.alone_ids(SEPARATOR)
        parts = json.loads(self.library.to_str())
        pre = parts["pre_tokenizer"]
        self.model = self.library.model if parts["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] else None

    def alone_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def alone(self, text: str) -> bytes:
        return np.array(self.alone_ids(text), self.width).tobytes()

    def single(self, atoms: list[bytes]) -> list[bytes]:
        """Ids of atoms that are one match each: the library's model alone gives them."""
        tokens, ids, ends = self.model.tokenize, [], [0]
        for x in atoms:
            ids += [t.id for t in tokens(x.decode("latin-1").translate(BYTE_LETTERS))]
            ends.append(len(ids))
        raw, w = np.array(ids, self.width).tobytes(), self.width.itemsize
        return [raw[a * w : b * w] for a, b in itertools.pairwise(ends)]

    def apart(self, atoms: list[str]) -> list[bytes]:
        """Ids of each PLAIN atom, many at once between separators."""
        found: list[bytes] = []
        w = self.width.itemsize
        for at in range(0, len(atoms), 4096):
            part = atoms[at : at + 4096]
            ids = np.array(self.library.encode_batch_fast([SEPARATOR.join(part)], add_special_tokens=False)[0].ids, self.width)
            ends = [*(np.flatnonzero(ids == self.separator) * w).tolist(), len(ids) * w]
            if len(ends) != len(part):
                raise ValueError("the vocabulary does not keep the separator apart")
            raw = ids.tobytes()
            found += [raw[a:b] for a, b in zip([0, *[x + w for x in ends[:-1]]], ends, strict=True)]
        return found

    def ids_of(self, atoms: list[bytes]) -> list[bytes]:
        """Ids of distinct atoms, remembered ones or new ones. What was not asked for
        while CACHED_ATOMS / 2 others were is forgotten."""
        found = list(map(self.young.get, atoms))
        missing = [i for i, x in enumerate(found) if x is None]
        plain, rest, single = [], [], []
        for i in missing:
            x = atoms[i]
            if (known := self.old.get(x)) is not None:
                found[i] = known
            elif self.model and ONE_MATCH.fullmatch(x):
                single.append(i)
            else:
                (plain if PLAIN.fullmatch(x.decode()) else rest).append(i)
        for at, ids in ((single, self.single([atoms[i] for i in single])), (plain, self.apart([atoms[i].decode() for i in plain])), (rest, [self.alone(atoms[i].decode()) for i in rest])):
            for i, x in zip(at, ids, strict=True):
                found[i] = x
        self.young.update([(atoms[i], found[i]) for i in missing])
        if len(self.young) > CACHED_ATOMS // 2:
            self.old, self.young = self.young, {}
        return found

    def encode(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """Ids of each text, and `end`, as little-endian unsigned integers of self.width."""
        texts = texts.fill_null("")
        whole = np.zeros(len(texts), bool)
        for token in self.special:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        size = pc.binary_length(texts).to_numpy()
        long = ~whole & (size > WINDOW_BYTES)
        if not (whole.any() or long.any()):
            return self.together(texts, end)
        out: list[bytes | None] = self.together(pc.if_else(pa.array(whole | long), "", texts), end).to_pylist()
        for i in np.flatnonzero(whole):
            out[i] = self.alone(texts[int(i)].as_py()) + end
        for i in np.flatnonzero(long):
            out[i] = b"".join(self.together(pa.array([x]), b"")[0].as_py() for x in parts_of(texts[int(i)].as_py())) + end
        return pa.array(out, pa.binary())

    def together(self, texts: pa.Array, end: bytes) -> pa.Array:
        texts = texts.cast(pa.binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        if low == high:
            return pa.array([end] * len(texts), pa.binary())
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[low:high]
        starts = offsets - low
        at = atom_starts(raw, starts).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, np.int32(len(raw)))), pa.py_buffer(raw)]).dictionary_encode()
        atoms = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = [*self.ids_of(atoms), end]
        ends_at = np.searchsorted(at, starts[1:])  # the number of the first atom after each text
        index = np.insert(coded.indices.to_numpy(), ends_at, len(atoms))  # the end id after each text
        w = self.width.itemsize
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // w
        flat = np.frombuffer(b"".join(values), self.width)
        n = sizes[index]
        ends = np.cumsum(n)
        source = np.repeat((np.cumsum(sizes) - sizes)[index] - ends + n, n)
        source += np.arange(len(source))
        done = np.concatenate([[0], ends[ends_at + np.arange(len(texts))]]) * w
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(done.astype(np.int32)), pa.py_buffer(flat[source])])


def parts_of(text: str, most: int = WINDOW_BYTES // 2) -> Iterator[str]:
    """A long text, parted before the first space after each `most` characters."""
    start = 0
    while len(text) - start > most and (cut := BOUNDARY.search(text, start + most)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def windows(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring texts with at most WINDOW_BYTES together, or one longer text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(texts):
        before = size[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(size, before + WINDOW_BYTES, "right")))
        yield a, b
        a = b


@functools.lru_cache(maxsize=2)
def encoder_of(vocabulary: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(vocabulary)


def width_of(vocabulary: str) -> np.dtype:
    return np.dtype("<u2" if tokenizer(vocabulary).get_vocab_size() <= 1 << 16 else "<u4")


def encode_ids(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n): ids with the end id, little-endian, in 16 bits if the vocabulary allows, else in 32."""
    width = width_of(vocabulary)
    end = np.array([end_id], width).tobytes()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in it:
            for a, b in windows(batch.column(1)):
                part = batch.slice(a, b - a)
                ids = encoder.encode(part.column(1), end)
                n = pc.divide(pc.binary_length(ids), width.itemsize).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, n], names=["id", "ids", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(batches, f"id {kind}, ids binary, n long")


def frequencies(encoded: DataFrame, width: np.dtype) -> DataFrame:
    """(token, n): how often each id occurs; at most a row for each id of the vocabulary."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in it:
            n = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), width))
            if len(n) > len(total):
                total, n = n, total
            total[: len(n)] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["token", "n"])

    return encoded.select("ids").mapInArrow(batches, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(size, dtype=np.int64)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    at = ends - size
    return (raw[at] | raw[at + 1] << 8 | raw[at + 2] << 16 | raw[at + 3] << 24) & MASKS[size]


def block(ids: list[bytes], width: np.dtype, rank: np.ndarray) -> bytes:
    """One block: magic, number of documents and of ids, ids of each document, control bytes, data bytes."""
    values = np.frombuffer(b"".join(ids), width)
    control, data = pack(rank[values])
    return MAGIC + np.array([len(ids), len(values)], "<u8").tobytes() + np.array([len(x) // width.itemsize for x in ids], "<u4").tobytes() + control + data


def unblock(raw: bytes, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each document's end, and all ids of a block."""
    if raw[:8] != MAGIC:
        raise ValueError("no block of token ids")
    docs, n = np.frombuffer(raw, "<u8", 2, 8).tolist()
    counts = np.frombuffer(raw, "<u4", docs, 24)
    at = 24 + 4 * docs
    middle = at + -(-n // 4)
    return counts, token[unpack(raw[at:middle], raw[middle:], n)]


def write_ids(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> str:
    """Encode all texts and store them in ascending order of the id under `path` (by
    default a new folder of the shared one), which is given back. All that reading needs
    is there:

    - blocks: (part, seq, doc_ids, n_ids, block), blocks of the format above;
    - index: (part, seq, block_start), the number of ids before each block;
    - ranks: one row, RANKS_MAGIC and the ids by rank as unsigned 32-bit integers.

    Files are written through Spark, so any store will do. A part is a range of ids and
    is coded as a stream; a task holds one block at a time. Strings of special tokens
    become their ids, as the library has it. Defined cases: null texts are empty (only
    the end id); null document ids come first; rows with equal ids stand in the order of
    their tokens; other columns are ignored."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/veilspark-ids-{uuid.uuid4().hex}"
    width = width_of(vocabulary)
    encoded = written(encode_ids(docs, vocabulary, end_id, id_col, text_col), "encoded")
    counted = frequencies(encoded, width).collect()  # bounded by the vocabulary
    by_rank = np.array([r["token"] for r in sorted(counted, key=lambda r: (-r["n"], r["token"]))], "<u4")
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    spark.createDataFrame([(bytearray(RANKS_MAGIC + by_rank.tobytes()),)], "ranks binary").write.parquet(f"{path}/ranks")
    shared = spark.sparkContext.broadcast(rank)
    total = sum(r["n"] for r in counted)
    parts = max(1, total // (4 * block_ids), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (block_ids // 4)))
    kind = docs.schema[id_col].dataType.simpleString()

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, size, part, seq = [], [], 0, 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([keys], pa.list_(key_type)), pa.array([size], pa.int64()), pa.array([block(held, width, shared.value)], pa.binary())], names=["part", "seq", "doc_ids", "n_ids", "block"])

        for batch in it:
            key_type = batch.schema.field(0).type
            for key, ids, n, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007
                held.append(ids)
                keys.append(key)
                size += n
                if size >= block_ids:
                    yield out()
                    held, keys, size, seq = [], [], 0, seq + 1
        if held:
            yield out()

    ordered = encoded.repartitionByRange(parts, F.col("id").asc_nulls_first(), F.xxhash64("ids")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("ids"))
    made = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(blocks, f"part int, seq int, doc_ids array<{kind}>, n_ids long, block binary")
    made.write.option("compression", "zstd").parquet(f"{path}/blocks")
    meta = spark.read.parquet(f"{path}/blocks").select("part", "seq", "n_ids")
    totals = meta.groupBy("part").agg(F.sum("n_ids").alias("all"))  # a row a part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("part").alias("_p"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = meta.join(totals, F.col("part") == F.col("_p")).select("part", "seq", (F.col("base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("block_start"))
    starts.coalesce(1).write.parquet(f"{path}/index")  # a row a block
    drop_written(encoded)
    return path


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids) of each document, decoded from what write_ids has
    stored under `path`; ids as little-endian unsigned 32-bit integers, start: ids of
    all documents before."""
    blocks = spark.read.parquet(f"{path}/blocks")
    raw = bytes(spark.read.parquet(f"{path}/ranks").first()["ranks"])  # as long as the vocabulary
    if raw[:8] != RANKS_MAGIC:
        raise ValueError("no ranks of token ids")
    shared = spark.sparkContext.broadcast(np.frombuffer(raw, "<u4", offset=8))
    starts = spark.read.parquet(f"{path}/index").withColumnsRenamed({"part": "_part", "seq": "_seq"})
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, seq, keys, raw in zip(*(c if i == 2 else c.to_pylist() for i, c in enumerate(batch.columns)), strict=True):
                counts, ids = unblock(raw, shared.value)
                ends = np.cumsum(counts, dtype=np.int64)
                flat, n = ids.tobytes(), len(counts)
                for at in range(0, n, 4096):
                    some = range(at, min(at + 4096, n))
                    each = [flat[4 * int(ends[k] - counts[k]) : 4 * int(ends[k])] for k in some]
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int32()), pa.array([seq] * len(some), pa.int32()), keys.values.slice(at, len(some)), pa.array((ends - counts)[at : at + len(some)]), pa.array(counts[at : at + len(some)].astype(np.int64)), pa.array(each, pa.binary())], names=["part", "seq", "id", "offset", "n_tokens", "ids"])

    read = blocks.select("part", "seq", "doc_ids", "block").mapInArrow(batches, f"part int, seq int, id {kind}, offset long, n_tokens long, ids binary")
    placed = read.join(F.broadcast(starts) if starts.count() <= BROADCAST_BLOCKS else starts, (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq")))
    return placed.select(F.col("id").alias(id_col), (F.col("block_start") + F.col("offset")).alias("start"), "n_tokens", "ids")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_ids(spark, write_ids(table(spark, sf_dir, "documents")))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
