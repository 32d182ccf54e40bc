"""Netpbm containers: P4, P5, P6 and P7, as bytes and as Spark sources and sinks over the binaryFile format."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")
CHANNELS = {"BLACKANDWHITE": 1, "GRAYSCALE": 1, "GRAYSCALE_ALPHA": 2, "RGB": 3, "RGB_ALPHA": 4}


def parse(raw: bytes) -> np.ndarray:
    """Samples of an image, (height, width, channels), 8 bits; 16-bit samples keep their high byte. A body that is
    too short, or another format, raises ValueError."""
    kind = raw[:2]
    if kind == b"P7":
        end = raw.find(b"ENDHDR")
        fields = dict(line.split(None, 1) for line in raw[2:end].decode("ascii", "replace").splitlines() if " " in line.strip() and not line.startswith("#"))
        try:
            w, h, depth, top = (int(fields[k]) for k in ("WIDTH", "HEIGHT", "DEPTH", "MAXVAL"))
        except KeyError as e:
            raise ValueError(f"PAM header lacks {e}") from None
        at = raw.index(b"\n", end) + 1
    elif kind in (b"P4", b"P5", b"P6"):
        at, numbers = 2, []
        for _ in range(2 if kind == b"P4" else 3):
            m = _TOKEN.match(raw, at)
            if not m:
                raise ValueError("short header")
            numbers.append(int(m[1]))
            at = m.end()
        at += 1
        w, h, top = (*numbers, 1)[:3]
        depth = 3 if kind == b"P6" else 1
    else:
        raise ValueError("not a PNM or PAM image")
    if kind == b"P4":
        stride = (w + 7) // 8
        body = np.frombuffer(raw, np.uint8, -1, at)
        if len(body) < stride * h:
            raise ValueError("short body")
        bits = np.unpackbits(body[: stride * h].reshape(h, stride), axis=1)[:, :w]
        return np.where(bits == 1, 0, 255).astype(np.uint8)[:, :, None]
    size = 2 if top > 255 else 1
    if len(raw) - at < w * h * depth * size:
        raise ValueError("short body")
    return np.frombuffer(raw, np.uint8, w * h * depth * size, at).reshape(h, w, depth, size)[..., 0].copy()


def gray(samples: np.ndarray) -> np.ndarray:
    """One channel as it is, colour as (r + 2g + b) / 4; alpha is left out."""
    if samples.shape[2] < 3:
        return samples[:, :, 0]
    r, g, b = (samples[:, :, k].astype(np.int32) for k in range(3))
    return ((r + g + g + b) // 4).astype(np.uint8)


def pnm_bytes(samples: np.ndarray) -> bytes:
    """P5 of one channel, P6 of three; four lose their alpha."""
    h, w, c = samples.shape
    return f"P{5 if c == 1 else 6}\n{w} {h}\n255\n".encode() + (samples if c == 1 else samples[:, :, :3]).tobytes()


def pam_bytes(samples: np.ndarray) -> bytes:
    h, w, c = samples.shape
    kind = {1: "GRAYSCALE", 2: "GRAYSCALE_ALPHA", 3: "RGB", 4: "RGB_ALPHA"}[c]
    return f"P7\nWIDTH {w}\nHEIGHT {h}\nDEPTH {c}\nMAXVAL 255\nTUPLTYPE {kind}\nENDHDR\n".encode() + samples.tobytes()


IMAGES = "image_id string, width int, height int, buf binary, error string"
FILES = "path string, modificationTime timestamp, length long, content binary"


def to_images(files: DataFrame) -> DataFrame:
    """binaryFile rows to images(image_id, width, height, buf, error): gray; a file that fails has error and no buf.
    Works on batch and streaming rows alike."""

    def run(batches):
        for b in batches:
            rows = []
            for path, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    im = gray(parse(raw or b""))
                    rows.append({"image_id": path, "width": im.shape[1], "height": im.shape[0], "buf": im.tobytes(), "error": None})
                except ValueError as e:
                    rows.append({"image_id": path, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("image_id", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("buf", pa.binary()), ("error", pa.string())]))

    return files.select("path", "content").mapInArrow(run, IMAGES)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return to_images(spark.read.format("binaryFile").load(path))


def read_image_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same over files that arrive; stateless."""
    return to_images(spark.readStream.format("binaryFile").schema(FILES).load(path))


def read_jpeg(spark: SparkSession, path: str) -> DataFrame:
    """images from JPEG and PNG files, decoded by Spark's image source; its samples are blue, green, red."""
    found = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                s = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                im = gray(s[:, :, 2::-1] if s.shape[2] >= 3 else s)
                rows.append({"image_id": r["origin"], "width": im.shape[1], "height": im.shape[0], "buf": im.tobytes(), "error": None})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("image_id", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("buf", pa.binary()), ("error", pa.string())]))

    return found.mapInArrow(run, IMAGES)


def pixels(images: DataFrame) -> DataFrame:
    """images to pixels(image_id, y, x, v), for the relational operators."""
    each = F.posexplode(F.transform(F.sequence(F.lit(1), F.col("width") * F.col("height")), lambda i: F.conv(F.hex(F.substring(F.col("buf"), i, F.lit(1))), 16, 10).cast("int")))
    p = images.filter("buf IS NOT NULL").select("image_id", "width", each.alias("i", "v"))
    return p.select("image_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), "v")


def encoded(images: DataFrame, pam: bool = False) -> DataFrame:
    """(image_id, content): each image as a P5 file, or P7."""

    def run(batches):
        make = pam_bytes if pam else pnm_bytes
        for b in batches:
            ids, out = [], []
            for r in b.to_pylist():
                if r["buf"] is not None:
                    ids.append(r["image_id"])
                    out.append(make(np.frombuffer(r["buf"], np.uint8, r["width"] * r["height"]).reshape(r["height"], r["width"], 1)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary())], names=["image_id", "content"])

    return images.select("image_id", "width", "height", "buf").mapInArrow(run, "image_id string, content binary")
