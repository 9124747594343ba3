"""Command line: ``extract`` a graph from a map extract, ``patch-bbox`` of graph files.

Exit codes: 0 done, 2 wrong arguments, 3 failed.
"""

from __future__ import annotations

import argparse
import math
import sys
from pathlib import Path


def parse_box(text: str) -> tuple[float, float, float, float]:
    """min lon, min lat, max lon, max lat."""
    try:
        box = tuple(float(x) for x in text.split(","))
    except ValueError as e:
        raise argparse.ArgumentTypeError(f"not numbers: {text}") from e
    if len(box) != 4 or not all(map(math.isfinite, box)):
        raise argparse.ArgumentTypeError("four finite numbers are needed")
    if not (-180 <= box[0] < box[2] <= 180 and -90 <= box[1] < box[3] <= 90):
        raise argparse.ArgumentTypeError("corners are out of order or range")
    return box


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="roadloom", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract")
    e.add_argument("--input", required=True)
    e.add_argument("--output", required=True, help="a folder of tables, or a file that ends in .odrg")
    e.add_argument("--bbox", type=parse_box, required=True)
    e.add_argument("--profiles", default="car", help="names or JSON files, comma-separated")
    p = sub.add_parser("patch-bbox")
    p.add_argument("--target", required=True, help="a file, or a folder of files with .map.json beside them")
    p.add_argument("--bbox", type=parse_box)
    return out


def extract(args, spark=None) -> None:
    """Nodes and ways in a box to a graph, as Parquet tables or one file."""
    from pyspark.sql import SparkSession

    from roadloom.functions import geo
    from roadloom.functions.profiles import InvalidProfile, Profile
    from roadloom.operators import extract as x
    from roadloom.sources import odrg, pbf

    profiles = [Profile.resolve(n.strip()) for n in args.profiles.split(",") if n.strip()]
    if len({p.name for p in profiles}) < len(profiles):
        raise InvalidProfile("profile names repeat")
    spark = spark or SparkSession.builder.appName("roadloom extract").getOrCreate()
    pbf.register(spark)
    load = lambda e: spark.read.format("roadloom_pbf").option("entity", e).load(args.input)
    nodes = load("node").withColumnRenamed("id", "node_id").select("node_id", "lat", "lon")
    ways = x.road_ways(load("way").withColumnRenamed("id", "way_id"))
    low_lon, low_lat, high_lon, high_lat = args.bbox
    ways = x.ways_touching(ways, x.nodes_in(nodes, geo.normal_bounds(low_lat, low_lon, high_lat, high_lon))).persist()
    verts, edges = x.graph(ways, x.needed_nodes(nodes, ways))
    edges = edges.persist()
    baked = x.bake(edges, profiles)
    if args.output.endswith(".odrg"):
        Path(args.output).write_bytes(odrg.pack(verts, edges, baked, args.input, args.bbox))
    else:
        verts.write.mode("overwrite").parquet(f"{args.output}/vertices")
        edges.write.mode("overwrite").parquet(f"{args.output}/edges")
        baked.write.mode("overwrite").partitionBy("profile").parquet(f"{args.output}/baked")


def patch(args) -> None:
    """Sets the requested box of one file, or of each file from its map file."""
    from roadloom.sources import odrg
    from roadloom.sources.documents import map_box

    target = Path(args.target)
    if target.is_file():
        if not args.bbox:
            raise ValueError("a file needs --bbox")
        target.write_bytes(odrg.with_requested_box(target.read_bytes(), args.bbox))
        return
    for f in sorted(target.glob("*.odrg")):
        if box := map_box(str(f.with_suffix("")) + ".map.json"):
            f.write_bytes(odrg.with_requested_box(f.read_bytes(), (box[1], box[0], box[3], box[2])))


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    try:
        (extract if args.command == "extract" else patch)(args)
    except Exception as e:  # noqa: BLE001  any failure is code 3
        print(f"failed: {e}", file=sys.stderr)
        return 3
    return 0


if __name__ == "__main__":
    sys.exit(main())
