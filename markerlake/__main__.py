"""python -m markerlake FOLDER: detects markers in a folder of Netpbm images and prints them and their histogram."""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="markerlake", description=__doc__)
    p.add_argument("folder")
    p.add_argument("-f", "--family", action="append", help="repeat for several (default tag16h5)")
    p.add_argument("--hamming", type=int, default=1, help="errors corrected")
    p.add_argument("--decimate", type=float, default=2.0)
    p.add_argument("--blur", type=float, default=0.0, help="sigma; negative sharpens")
    p.add_argument("--no-refine-edges", action="store_true")
    p.add_argument("--out", help="a folder to write the detections to, as Parquet")
    a = p.parse_args(args)

    from pyspark.sql import SparkSession

    from .engine import MarkerEngine
    from .sources.netpbm import read_images

    spark = SparkSession.builder.appName("markerlake").getOrCreate()
    engine = MarkerEngine(spark, a.family or ["tag16h5"], quad_decimate=a.decimate, quad_sigma=a.blur, refine_edges=not a.no_refine_edges, max_hamming=a.hamming)
    images = read_images(spark, a.folder)
    for r in images.filter("error IS NOT NULL").select("image_id", "error").toLocalIterator():
        print(f"{r.image_id}: {r.error}")
    found = engine.detect(images)
    if a.out:
        found.write.mode("errorifexists").parquet(a.out)
        found = spark.read.parquet(a.out)
    for r in found.orderBy("image_id", "id").toLocalIterator():
        print(f"{r.image_id}: id {r.id} ({r.family}), hamming {r.hamming}, margin {r.decision_margin:.3f}")
    engine.histogram(found).orderBy("image_id").show(1000, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
