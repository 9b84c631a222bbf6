"""Rectangles over hidden fragments, and the check that they cover them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.layout import with_lines
from veilspark.schema import LINE_FLOOR, PADDING

#: Fragments that are held until the page of the last of them is whole, and laid out at once.
PAGE_CHUNK = 1 << 16
PLACE = ("x", "y", "w", "h", "seq")


def line_starts(c: np.ndarray, n: np.ndarray, page: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    """Which of the distinct centres, in order of page and centre, begin a line: the fold
    of layout.geometry. A centre further than the tolerance from the one before it always
    does, and in a chain of near ones no wider than the tolerance no other does; so only
    wider chains are folded. n counts the fragments of a centre."""
    starts = np.ones(len(c), bool)
    starts[1:] = (page[1:] != page[:-1]) | (c[1:] - c[:-1] > tolerance[1:])
    first = np.flatnonzero(starts)
    end = np.append(first[1:], len(c))
    for a, b in zip(*(v[c[end - 1] - c[first] > tolerance[first]].tolist() for v in (first, end)), strict=True):
        total = count = 0.0
        for i, (at, k) in enumerate(zip(c[a:b].tolist(), n[a:b].tolist(), strict=True)):
            if count and abs(at - total / count) > tolerance[a]:
                starts[a + i], total, count = True, 0.0, 0
            total, count = total + at * k, count + k
    return starts


def runs_of(new_page: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, seq: np.ndarray, padding: int) -> tuple[np.ndarray, ...]:
    """(order, first, line_no, run, boxes) of whole pages: the fragments in order of their
    runs, where each run begins in it, and for each run its numbers and its box."""
    page, c = np.cumsum(new_page) - 1, y + h / 2
    begins, size = np.flatnonzero(new_page), np.diff(np.append(np.flatnonzero(new_page), len(page)))
    med = h[np.lexsort((h, page))][begins + size // 2]
    tolerance = np.maximum(np.trunc(med) / 2, LINE_FLOOR)
    o = np.lexsort((c, page))
    other = np.ones(len(o), bool)
    other[1:] = (page[o][1:] != page[o][:-1]) | (c[o][1:] != c[o][:-1])
    at = np.flatnonzero(other)
    g = page[o][at]
    lines = np.cumsum(line_starts(c[o][at], np.diff(np.append(at, len(o))), g, tolerance[g]))  # numbered over all pages
    line = np.empty(len(o), np.int64)
    line[o] = lines[np.cumsum(other) - 1]
    low = lambda v: np.where(np.isnan(v), -np.inf, v)
    o = np.lexsort((low(seq), c, low(x), line))
    same = line[o][1:] == line[o][:-1]
    starts = np.ones(len(o), bool)
    starts[1:] = ~same | (x[o][1:] - (x + w)[o][:-1] > np.maximum(h[o][1:], h[o][:-1]))
    first = np.flatnonzero(starts)
    own = line[o][first]
    run = np.arange(len(first)) - np.searchsorted(own, own)
    boxes = np.stack([f.reduceat(v[o], first) + d for f, v, d in ((np.fmin, x, -padding), (np.fmin, y, -padding), (np.fmax, x + w, padding), (np.fmax, y + h, padding))])
    return o, first, own - lines[np.searchsorted(g, page[o][first])], run, boxes


def by_page(covered: DataFrame, keys: tuple[str, ...], made: Callable[[pa.Table, np.ndarray, dict[str, np.ndarray]], list], schema: str) -> DataFrame:
    """Deals fragments out by page and calls made(fragments, where a page begins, places)
    on whole pages, many at once; a page must fit in a worker. Fragments without a key or
    a centre are on no page."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(t: pa.Table, new: np.ndarray) -> pa.RecordBatch:
            places = {k: pc.cast(t.column(k), pa.float64()).to_numpy() for k in PLACE}
            return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in made(t, new, places)], names=names)

        held: list[pa.RecordBatch] = []
        most, n = PAGE_CHUNK, 0
        for batch in it:
            held.append(batch)
            n += len(batch)
            if n < most:
                continue
            t = pa.Table.from_batches(held)
            new = beginnings(t)
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield finished(t.slice(0, last), new[:last])
            held = t.slice(last).to_batches()
            n = len(t) - last
            most = max(PAGE_CHUNK, 2 * n)  # a page of many batches is not looked at again for each
        if n:
            t = pa.Table.from_batches(held)
            yield finished(t, beginnings(t))

    def beginnings(t: pa.Table) -> np.ndarray:
        new = np.ones(len(t), bool)
        new[1:] = False
        for k in keys:
            v = t.column(k).combine_chunks()
            new[1:] |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
        return new

    names = [part.rsplit(" ", 1)[0].strip("`") for part in schema.split(", ")]
    known = covered.select(*keys, *PLACE).dropna(subset=[*keys, "y", "h"])
    return known.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(batches, schema)


def _key_schema(covered: DataFrame, keys: tuple[str, ...]) -> str:
    return ", ".join(f"`{k}` {covered.schema[k].dataType.simpleString()}" for k in keys)


def merge_boxes(covered: DataFrame, padding: int = PADDING, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, line_no, run, x0, y0, x1, y1): padded boxes over runs of neighbours.

    `keys` tell one page from another: the document, or document and purpose. Lines are
    those of the covered fragments of a page alone. In a line, in order of x, a fragment
    goes on with the run if the gap to the one before is at most the larger of their
    heights."""

    def made(t: pa.Table, new: np.ndarray, p: dict[str, np.ndarray]) -> list:
        order, first, line, run, boxes = runs_of(new, *(p[k] for k in PLACE), padding)
        whole = lambda v: pa.array(v, mask=np.isnan(v)).cast(pa.int32())
        return [*(t.column(k).take(pa.array(order[first])) for k in keys), pa.array(line, pa.int32()), pa.array(run, pa.int32()), *map(whole, boxes)]

    return by_page(covered, keys, made, f"{_key_schema(covered, keys)}, line_no int, run int, x0 int, y0 int, x1 int, y1 int")


def own_boxes(covered: DataFrame, padding: int = PADDING, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, n, outside): how many fragments a page has, and how many of them the box of
    their own run (see merge_boxes) does not contain. Only those need to meet other boxes."""

    def made(t: pa.Table, new: np.ndarray, p: dict[str, np.ndarray]) -> list:
        order, first, _, _, boxes = runs_of(new, *(p[k] for k in PLACE), padding)
        x0, y0, x1, y1 = np.repeat(boxes, np.diff(np.append(first, len(order))), axis=1)
        x, y, w, h = (p[k][order] for k in PLACE[:4])
        begins = np.flatnonzero(new)
        outside = np.add.reduceat(~((x0 <= x) & (y0 <= y) & (x1 >= x + w) & (y1 >= y + h)), begins, dtype=np.int64)  # pages keep their places
        return [*(t.column(k).take(pa.array(begins)) for k in keys), pa.array(np.diff(np.append(begins, len(new)))), pa.array(outside)]

    return by_page(covered, keys, made, f"{_key_schema(covered, keys)}, n long, outside long")


def uncovered(covered: DataFrame, boxes: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Covered fragments that no box of their page contains.

    A fragment meets its own line's boxes first (lines as in merge_boxes), the other
    boxes of its page only where those do not contain it."""
    b = boxes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("line_no").alias("_l"), "x0", "y0", "x1", "y1")
    inside = (F.col("x0") <= F.col("x")) & (F.col("y0") <= F.col("y")) & (F.col("x1") >= F.col("x") + F.col("w")) & (F.col("y1") >= F.col("y") + F.col("h"))
    for i, k in enumerate(keys):
        inside = inside & (F.col(k) == F.col(f"_k{i}"))
    lined = with_lines(covered.drop("line_no"), keys)
    left = lined.join(b, inside & (F.col("line_no") == F.col("_l")), "left_anti")
    return left.join(b, inside, "left_anti").drop("line_no")


def redacted_text(decided: DataFrame, no: str = "line_no", blank: str = "█") -> DataFrame:
    """The text sink: (doc_id, purpose, no, text) with masks, and blanks as long as what they hide."""
    shown = F.when(F.col("outcome") == "keep", F.col("text")).when(F.col("outcome") == "partial", F.col("mask")).otherwise(F.repeat(F.lit(blank), F.length("text")))
    parts = F.array_sort(F.collect_list(F.struct("x", (F.col("y") + F.col("h") / 2).alias("c"), "seq", shown.alias("t"))))
    return decided.groupBy("doc_id", "purpose", no).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))
