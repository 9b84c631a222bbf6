"""Media columns: AVI motion-JPEG written, parsed, decoded and cut into shots.

A byte payload is kept as a film of 24 x 24 grey frames, one 8-bit sample a byte,
in the lossless process of JPEG (SOF3, left predictor, Huffman), so that decoding
gives back every byte. Frames of a batch are coded in lockstep: one numpy step
handles the same sample of all frames, so no Python loop runs over samples of a
single frame."""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import table

SIDE = 24
FRAME = SIDE * SIDE  # 576 samples
FPS = 25
PAD = 255
#: Code length of each difference category 0..8, chosen for text bytes.
CODE_LENGTHS = {4: 2, 7: 2, 3: 3, 5: 3, 0: 4, 2: 4, 1: 5, 6: 5, 8: 6}
FRAMES_AT_ONCE = 4096
#: Histogram bins a frame. Shots: a difference is the number of samples that change bins,
#: counted on both sides (0 to 2 x FRAME). A cut is over CUT_FLOOR (12 %) and over the mean and
#: CUT_SIGMA deviations of the film's last WINDOW differences; over CUT_HARD (half) where
#: there are not two of them yet.
BINS, WINDOW, CUT_FLOOR, CUT_HARD, CUT_SIGMA = 16, 8, 138, 576, 3
CLIPS = "array<struct<clip:int,first_frame:int,last_frame:int,start_ms:int,end_ms:int>>"


def canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """JPEG's BITS and HUFFVAL lists, and category -> (code, length)."""
    order = sorted(lengths, key=lambda c: (lengths[c], c))
    codes, code, last = {}, 0, 0
    for c in order:
        code <<= lengths[c] - last
        last = lengths[c]
        codes[c] = (code, last)
        code += 1
    return [sum(n == k for n in lengths.values()) for k in range(1, 17)], order, codes


@functools.lru_cache(maxsize=8)
def decode_table(bits: tuple[int, ...], values: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each window of 16 bits: the difference that it starts with, and its length (0: no code)."""
    diff, size = np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.uint8)
    code, k = 0, 0
    for n in range(1, 17):
        for _ in range(bits[n - 1]):
            c = values[k]
            k += 1
            if n + c > 16:
                raise ValueError("a code with more than 16 bits")
            extra = np.arange(1 << c)
            value = np.where(extra >= (1 << c) >> 1, extra, extra - (1 << c) + 1) if c else extra
            span = 1 << (16 - n - c)
            start = code << (16 - n)
            diff[start : start + (span << c)] = np.repeat(value, span)
            size[start : start + (span << c)] = n + c
            code += 1
        code <<= 1
    return diff, size


BITS, VALUES, CODES = canonical(CODE_LENGTHS)
SOI, EOI = b"\xff\xd8", b"\xff\xd9"
SOF3 = b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
DHT = b"\xff\xc4" + struct.pack(">HB", 2 + 1 + 16 + len(VALUES), 0) + bytes(BITS) + bytes(VALUES)
SOS = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
HEADER = SOI + SOF3 + DHT + SOS


def _encode_table() -> tuple[np.ndarray, np.ndarray]:
    value, size = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        code, n = CODES[c]
        value[d + 255] = code << c | (d if d > 0 else d + (1 << c) - 1 if c else 0)
        size[d + 255] = n + c
    return value, size


ENC_VALUE, ENC_SIZE = _encode_table()


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG images of frames (n x 576 unsigned bytes)."""
    n = len(samples)
    x = samples.astype(np.int16).reshape(n, SIDE, SIDE)
    guess = np.empty_like(x)
    guess[:, :, 1:] = x[:, :, :-1]  # left neighbour
    guess[:, 1:, 0] = x[:, :-1, 0]  # first of a row: the one above
    guess[:, 0, 0] = 128
    at = (x - guess).reshape(n, FRAME) + 255
    value, size = np.ascontiguousarray(ENC_VALUE[at].T), np.ascontiguousarray(ENC_SIZE[at].T)
    ends = np.cumsum(size, axis=0)
    total = ends[-1]
    pad = -total % 8  # the last byte is filled with ones
    words = int(total.max(initial=0)) // 32 + 3
    buf = np.zeros(n * words, np.uint64)
    base = np.arange(n) * words
    for j in range(FRAME + 1):
        v, s, p = (value[j], size[j], ends[j] - size[j]) if j < FRAME else (((1 << pad) - 1).astype(np.uint64), pad, total)
        w = v << (64 - (p & 31) - s).astype(np.uint64) if j < FRAME else np.where(pad > 0, v << ((64 - (p & 31) - s) & 63).astype(np.uint64), np.uint64(0))
        k = base + (p >> 5)
        buf[k] |= w >> np.uint64(32)
        buf[k + 1] |= w & np.uint64(0xFFFFFFFF)
    raw = buf.astype(">u4").reshape(n, words).tobytes()
    length = (total + pad) // 8
    return [HEADER + raw[i * words * 4 : i * words * 4 + m].replace(b"\xff", b"\xff\x00") + EOI for i, m in enumerate(length.tolist())]


def scan_of(jpeg: bytes) -> tuple[tuple[int, ...], tuple[int, ...], bytes]:
    """Walk the markers of one image: its Huffman table and its entropy-coded bytes."""
    if jpeg[:2] != SOI:
        raise ValueError("no JPEG image")
    if jpeg.startswith(HEADER):
        return tuple(BITS), tuple(VALUES), jpeg[len(HEADER) : -2].replace(b"\xff\x00", b"\xff")
    at, bits, values, shape = 2, (), (), None
    while True:
        marker, n = struct.unpack_from(">HH", jpeg, at)
        body = jpeg[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xFFC3:
            shape = struct.unpack_from(">BHHB", body)
        elif marker == 0xFFC4:
            bits, values = tuple(body[1:17]), tuple(body[17 : 17 + sum(body[1:17])])
        elif marker == 0xFFDA:
            if shape != (8, SIDE, SIDE, 1) or body[3] != 1:
                raise ValueError("only 24 x 24 grey lossless frames with the left predictor are read")
            return bits, values, jpeg[at : jpeg.rindex(EOI)].replace(b"\xff\x00", b"\xff")
        elif not 0xFFC0 <= marker <= 0xFFFE:
            raise ValueError("a broken JPEG image")


def decode_frames(images: list[bytes]) -> np.ndarray:
    """Samples (n x 576) of lossless JPEG images."""
    out = np.empty((len(images), FRAME), np.uint8)
    by_table: dict[tuple, list[int]] = {}
    scans = []
    for i, image in enumerate(images):
        bits, values, scan = scan_of(image)
        by_table.setdefault((bits, values), []).append(i)
        scans.append(scan)
    for (bits, values), rows in by_table.items():
        diff, size = decode_table(bits, values)
        n, width = len(rows), max(len(scans[i]) for i in rows) + 4
        flat = np.frombuffer(b"".join(scans[i].ljust(width, b"\xff") for i in rows) + b"\xff\xff\xff", np.uint8).astype(np.uint32)
        window = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]  # 24 bits from each byte on
        p = np.arange(n, dtype=np.int64) * width * 8
        got = np.empty((FRAME, n), np.uint8)
        above = left = np.full(n, 128, np.int16)
        for j in range(FRAME):
            code = window[p >> 3] >> (8 - (p & 7)).astype(np.uint32) & 0xFFFF
            step = size[code]
            guess = above if j % SIDE == 0 else left
            left = (guess + diff[code]) & 255
            if j % SIDE == 0:
                above = left
            got[j] = left
            p += step
        out[rows] = got.T
    return out


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(images: list[bytes]) -> bytes:
    """An AVI file with one MJPG stream and an idx1 index."""
    n, largest = len(images), max(map(len, images))
    head = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", head) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    sizes = np.array([len(x) for x in images], np.uint32)
    index = np.zeros((n, 4), np.uint32)
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, sizes
    index[1:, 2] = np.cumsum(8 + sizes + (sizes & 1))[:-1]
    index[:, 2] += 4
    movi = chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", x) for x in images))
    return chunk(b"RIFF", b"AVI " + hdrl + movi + chunk(b"idx1", index.astype("<u4").tobytes()))


def avi_frames(data: bytes) -> list[bytes]:
    """The images of an AVI file, found through its idx1 index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= len(data):
        name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = np.frombuffer(data, "<u4", n // 4, at + 8).reshape(-1, 4)
        at += 8 + n + (n & 1)
    if movi is None or index is None:
        raise ValueError("an AVI file without frames or index")
    return [data[movi + o + 8 : movi + o + 8 + n] for o, n in index[:, 2:].tolist()]


def cuts_of(samples: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a shot begins. samples: frames of several films; first: for each frame,
    the number of its film's first frame. The threshold adapts to the mean and
    deviation of the last WINDOW histogram differences of the same film.

    All in integers, so that the films beside a film do not show: with m differences of
    sum s and sum of squares q, d > s/m + k * sqrt(q/m - (s/m)^2) is m*d - s > 0 and
    (m*d - s)^2 > k^2 * (m*q - s^2)."""
    n = len(samples)
    at = np.arange(n)
    hist = np.bincount((at[:, None] * BINS + (samples >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)
    d = np.zeros(n, np.int64)
    d[1:] = np.abs(np.diff(hist, axis=0)).sum(1)
    d[at == first] = 0
    sums, squares = (np.concatenate([[0], np.cumsum(x)]) for x in (d, d * d))
    low = np.minimum(np.maximum(first + 1, at - WINDOW), at)  # earlier differences of this film
    m, s, q = at - low, sums[at] - sums[low], squares[at] - squares[low]
    above = m * d - s
    adaptive = (d > CUT_FLOOR) & (above > 0) & (above * above > CUT_SIGMA**2 * (m * q - s * s))
    return (at == first) | np.where(m >= 2, adaptive, d > CUT_HARD)


def clip_rows(cuts: list[int], n: int) -> list[dict]:
    ends = [*cuts[1:], n]
    return [{"clip": i, "first_frame": a, "last_frame": b - 1, "start_ms": a * 1000 // FPS, "end_ms": b * 1000 // FPS} for i, (a, b) in enumerate(zip(cuts, ends, strict=True))]


def in_groups(counts: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours with about `most` frames together (one film may have more)."""
    a = total = 0
    for b, n in enumerate(counts):
        if total and total + n > most:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(counts):
        yield a, len(counts)


def write_media(df: DataFrame, id_col: str = "doc_id", payload_col: str = "payload") -> DataFrame:
    """Store each payload as a motion-JPEG film: (id_col, n_bytes, media).

    The payload is padded with bytes 255 to a positive multiple of 576. Defined
    cases: null or empty payloads give one frame of padding; equal payloads give
    equal films; repeated rows, null ids and other columns do no harm. Narrow: no
    shuffle; films are coded FRAMES_AT_ONCE frames at a time, so memory is bounded
    by an Arrow batch and the longest single payload."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            padded = [x + b"\xff" * (-len(x) % FRAME or (0 if x else FRAME)) for x in raw]
            counts = [len(x) // FRAME for x in padded]
            for a, b in in_groups(counts, FRAMES_AT_ONCE):
                samples = np.frombuffer(b"".join(padded[a:b]), np.uint8).reshape(-1, FRAME)
                images = [y for k in range(0, len(samples), FRAMES_AT_ONCE) for y in encode_frames(samples[k : k + FRAMES_AT_ONCE])]
                films, k = [], 0
                for n in counts[a:b]:
                    films.append(avi(images[k : k + n]))
                    k += n
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) for x in raw[a:b]], pa.int64()), pa.array(films, pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(payload_col).cast("binary").alias("payload")).mapInArrow(batches, f"`{id_col}` {kind}, n_bytes long, media binary")


def read_media(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode films: (id_col, n_bytes, media, payload with its padding, clips).

    clips lists the shots with frame numbers and times. Null films give null payload
    and null clips; a broken film raises ValueError."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(x, pa.int32()) for x in ("clip", "first_frame", "last_frame", "start_ms", "end_ms")]))
        for batch in it:
            films = [avi_frames(x) if x is not None else [] for x in batch.column(2).to_pylist()]
            counts = [len(x) for x in films]
            for a, b in in_groups(counts, FRAMES_AT_ONCE):
                images = [y for x in films[a:b] for y in x]
                samples = np.concatenate([np.empty((0, FRAME), np.uint8), *(decode_frames(images[k : k + FRAMES_AT_ONCE]) for k in range(0, len(images), FRAMES_AT_ONCE))])
                starts = np.concatenate([[0], np.cumsum(counts[a:b])]).astype(np.int64)
                cut = cuts_of(samples, np.repeat(starts[:-1], counts[a:b]))
                where = np.flatnonzero(cut)
                of = np.searchsorted(where, starts)
                raw = samples.tobytes()
                payload, clips = [], []
                for i, n in enumerate(counts[a:b]):
                    s = int(starts[i])
                    payload.append(raw[s * FRAME : (s + n) * FRAME] if n else None)
                    clips.append(clip_rows((where[of[i] : of[i + 1]] - s).tolist(), n) if n else None)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(payload, pa.binary()), pa.array(clips, kind)], names=[id_col, "n_bytes", "media", "payload", "clips"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, "n_bytes", "media").mapInArrow(batches, f"`{id_col}` {kind}, n_bytes long, media binary, payload binary, clips {CLIPS}")


def clip_table(read: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One timed row a clip: (id_col, clip, first_frame, last_frame, start_ms, end_ms).
    Films without clips (null films) give no row; equal rows give equal rows."""
    return read.select(id_col, F.inline("clips"))


def op10_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))
    read = read_media(write_media(docs))
    shots = F.transform("clips", lambda c: F.concat(c["first_frame"].cast("string"), F.lit("-"), c["last_frame"].cast("string")))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("frames="), (F.octet_length("payload") / FRAME).cast("int").cast("string"), F.lit(";clips="), F.array_join(shots, ",")).alias("feature"),
    )
