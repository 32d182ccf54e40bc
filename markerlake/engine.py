"""The engine: images to detections to poses, one Arrow row an image."""

from __future__ import annotations

from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .families import Family, family, family_tables
from .operators import codes as code_ops
from .operators.detect import DetectorConfig, detect
from .operators.pose import pose_candidates

DETECTIONS = "image_id string, family string, id int, hamming int, decision_margin float, h array<double>, c array<double>, p array<array<double>>"
POSES = "image_id string, family string, id int, r array<double>, t array<double>, err double"


class MarkerEngine:
    """families: names or Family objects; options: fields of DetectorConfig."""

    def __init__(self, spark: SparkSession, families: list[str | Family], **options):
        self.spark = spark
        self.families = [family(f) if isinstance(f, str) else f for f in families]
        self.config = DetectorConfig(**options)
        if self.config.max_hamming > code_ops.MOST:
            raise ValueError(f"max_hamming is {code_ops.MOST} at most")
        if any(self.config.max_hamming > (f.h - 1) // 2 and self.config.max_hamming > 2 for f in self.families):
            raise ValueError("max_hamming exceeds what a family's distance can correct")

    def detect(self, images: DataFrame) -> DataFrame:
        """Detections of images(image_id, width, height, buf); an image is a task's unit and never shuffled. Null or
        short buffers and null sizes give none."""
        families, options = self.families, asdict(self.config)

        def run(batches):
            cfg = DetectorConfig(**options)
            for b in batches:
                rows: list[dict] = []
                for i, w, h, buf in zip(*(b.column(c).to_pylist() for c in ("image_id", "width", "height", "buf"))):
                    if None in (w, h, buf) or w <= 0 or h <= 0 or len(buf) < w * h:
                        continue
                    for d in detect(np.frombuffer(buf, np.uint8, w * h).reshape(h, w), families, cfg):
                        rows.append(d | {"image_id": i, "h": d["h"].ravel().tolist(), "c": d["c"].tolist(), "p": d["p"].tolist()})
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

        return images.select(F.col("image_id").cast("string"), F.col("width").cast("int"), F.col("height").cast("int"), "buf").mapInArrow(run, DETECTIONS)

    def pose(self, detections: DataFrame, tag_sizes: DataFrame, fx: float, fy: float, cx: float, cy: float, all_candidates: bool = False) -> DataFrame:
        """Poses of detections; tag_sizes (family, tagsize) has a row for each family. all_candidates keeps both minima."""
        sized = detections.join(F.broadcast(tag_sizes), "family").select("image_id", "family", "id", "h", "p", F.col("tagsize").cast("double"))

        def run(batches):
            for b in batches:
                rows = []
                for d in b.to_pylist():
                    found = pose_candidates(np.array(d["h"]).reshape(3, 3), np.array(d["p"]), d["tagsize"], fx, fy, cx, cy)
                    for r, t, e in found if all_candidates else [min(found, key=lambda x: x[2])]:
                        rows.append({"image_id": d["image_id"], "family": d["family"], "id": d["id"], "r": r.ravel().tolist(), "t": t.tolist(), "err": e})
                yield pa.RecordBatch.from_pylist(rows, _POSE_ARROW)

        return sized.mapInArrow(run, POSES)

    def render(self) -> DataFrame:
        """(family, id, y, x, v): every marker as pixels."""
        tables, codes, bits = family_tables(self.spark, self.families)
        return code_ops.render(bits, tables, codes)

    def histogram(self, detections: DataFrame) -> DataFrame:
        """Counts by errors for each image and in all."""
        return code_ops.hamming_histogram(detections)


_ARROW = pa.schema([("image_id", pa.string()), ("family", pa.string()), ("id", pa.int32()), ("hamming", pa.int32()), ("decision_margin", pa.float32()), ("h", pa.list_(pa.float64())), ("c", pa.list_(pa.float64())), ("p", pa.list_(pa.list_(pa.float64())))])
_POSE_ARROW = pa.schema([("image_id", pa.string()), ("family", pa.string()), ("id", pa.int32()), ("r", pa.list_(pa.float64())), ("t", pa.list_(pa.float64())), ("err", pa.float64())])
