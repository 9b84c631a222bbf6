"""Images to OCR fragments. Needs Pillow and pytesseract on the executors; both are
imported only where an image is read."""

from __future__ import annotations

import io
import os
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.schema import MAX_SIDE, MIN_SIDE
from veilspark.sources.text import from_ocr

RAW = "doc_id string, ordinal int, text string, conf string, left string, top string, width string, height string, block_num string, par_num string, line_num string"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")


def image_scale(width: Column, height: Column) -> Column:
    """What an image is scaled by: up to a short side of MIN_SIDE, then down to a long side of MAX_SIDE."""
    short, long = F.least(width, height), F.greatest(width, height)
    up = F.when(short < MIN_SIDE, F.lit(float(MIN_SIDE)) / short).otherwise(F.lit(1.0))
    return F.when(long * up > MAX_SIDE, F.lit(float(MAX_SIDE)) / long).otherwise(up)


def find_tesseract() -> str:
    """The configured program (VEILSPARK_TESSERACT), else the one on the path."""
    found = os.environ.get("VEILSPARK_TESSERACT") or shutil.which("tesseract")
    if not found:
        raise RuntimeError("tesseract was not found: set VEILSPARK_TESSERACT or the path")
    return found


def ocr(images: DataFrame, psm: int = 3) -> DataFrame:
    """Fragments of images (doc_id, content), one image at a time in a task."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pytesseract
        from PIL import Image

        pytesseract.pytesseract.tesseract_cmd = find_tesseract()
        columns = ["text", "conf", "left", "top", "width", "height", "block_num", "par_num", "line_num"]
        for batch in it:
            for doc, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                image = Image.open(io.BytesIO(content)).convert("RGB")
                short, long = sorted(image.size)
                scale = max(1.0, MIN_SIDE / short)
                scale = min(scale, MAX_SIDE / long) if long * scale > MAX_SIDE else scale
                if scale != 1.0:
                    image = image.resize(tuple(max(1, round(x * scale)) for x in image.size), Image.LANCZOS)
                data = pytesseract.image_to_data(image, config=f"--psm {psm}", output_type=pytesseract.Output.DICT)
                n = len(data["text"])
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n), pa.array(range(n), pa.int32()), *[pa.array([str(v) for v in data[c]]) for c in columns]], names=["doc_id", "ordinal", *columns])

    return from_ocr(images.select("doc_id", "content").mapInArrow(batches, RAW))


def render(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, content): PNG images with opaque rectangles over the boxes of each document."""
    listed = boxes.groupBy("doc_id").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from PIL import Image, ImageDraw

        for batch in it:
            out = []
            for content, rects in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                image = Image.open(io.BytesIO(content)).convert("RGB")
                pen = ImageDraw.Draw(image)
                for r in rects or []:
                    pen.rectangle([r["x0"], r["y0"], r["x1"], r["y1"]], fill=(0, 0, 0))
                buffer = io.BytesIO()
                image.save(buffer, "PNG")
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    return images.select("doc_id", "content").join(listed, "doc_id", "left").mapInArrow(batches, "doc_id string, content binary")
