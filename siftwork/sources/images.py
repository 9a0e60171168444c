"""Sizes of images: pixels of PNG and JPEG files, boxes of EPS and PDF files."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SIZE = "path string, kind string, width double, height double"


def png(data: bytes) -> tuple[float, float] | None:
    """Width and height from the header chunk."""
    return tuple(map(float, struct.unpack(">II", data[16:24]))) if len(data) >= 24 and data[12:16] == b"IHDR" else None


def jpeg(data: bytes) -> tuple[float, float] | None:
    """Width and height from the first frame header; other segments are passed over by their length."""
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return float(width), float(height)
        at += 2 + size
    return None


def _box(data: bytes, pattern: bytes) -> tuple[float, float] | None:
    m = re.search(pattern + rb"\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", data)
    if not m:
        return None
    a, b, c, d = map(float, m.groups())
    return abs(c - a), abs(d - b)


def size(data: bytes) -> tuple[str, float | None, float | None]:
    """(kind, width, height); a kind that is not known, or a broken file, has no size."""
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        kind, found = "png", png(data)
    elif data.startswith(b"\xff\xd8"):
        kind, found = "jpeg", jpeg(data)
    elif data.startswith(b"%PDF"):
        kind, found = "pdf", _box(data, rb"/CropBox\s*\[") or _box(data, rb"/MediaBox\s*\[")
    elif data.startswith(b"%!PS"):
        kind, found = "eps", _box(data, rb"%%HiResBoundingBox:") or _box(data, rb"%%BoundingBox:")
    else:
        kind, found = "unknown", None
    return kind, *(found or (None, None))


def images(spark: SparkSession, path: str) -> DataFrame:
    """SIZE of every file under a path; the reader passes over empty files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(p, *size(bytes(c))) for p, c in pdf.itertuples(index=False)], columns=["path", "kind", "width", "height"])

    return rows.mapInPandas(run, SIZE)
