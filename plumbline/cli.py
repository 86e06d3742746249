"""Command line: import archives, choose frames, level, label and re-fuse stored scenes."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import load_config
from .functions import text
from .functions.imaging import frame_features
from .operators import frames as fr
from .plans import labelling, levelling
from .session import build_session
from .sources import clouds, folders
from .sources.store import SceneStore


def print_rows(df: DataFrame) -> None:
    """Every row, tab separated under the column names; rows stream through, one partition at a time."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def _extract(args, spark, config) -> None:
    if folders.source_kind(args.source) == "video":
        raise SystemExit("video decoding needs a decoder this build does not ship; supply a folder of frames")
    images = folders.read_images(spark, args.source)
    features = images.withColumn("f", frame_features("image")).select("room", "idx", "ts", "image", "f.sharpness", "f.thumb")
    c = config.frames
    kept = fr.select_frames(
        features.select("room", "idx", "sharpness", "thumb"), args.n_frames or c.n_frames,
        blur_percentile=c.blur_percentile, dedup_correlation=c.dedup_correlation, min_frames=c.min_frames,
    )
    print_rows(folders.write_frames(features.join(kept, ["room", "idx"], "left_semi"), args.out).orderBy("room", "index"))


def _load(args, spark, config) -> None:
    clouds.register(spark)
    read = lambda table: spark.read.format("framearchive").option("table", table).load(args.archives)
    print("version", SceneStore(spark, args.store).write({"points": read("points"), "cameras": read("cameras")}))


def _level(args, spark, config) -> None:
    done = levelling.level_store(SceneStore(spark, args.store), up=args.up)
    print("version", done.version, "rewrote", ", ".join(done.tables))
    print_rows(done.records.select("room", "rotation_deg", "estimate.source", "estimate.confidence", "estimate.notes"))


def _label(args, spark, config) -> None:
    store = SceneStore(spark, args.store)
    replies = spark.read.schema("room string, frame_idx int, reply string").json(args.replies)
    found = labelling.label_scene(
        store.read("points"), store.read("cameras"), labelling.detections_from_replies(replies), config.label
    )
    print("version", store.write({"observations": found.observations, "objects": found.objects}))
    print_rows(labelling.report_lines(store.read("objects")).orderBy("room", text.object_number("object_id")))


def _refuse(args, spark, config) -> None:
    store = SceneStore(spark, args.store)
    objects, observations = labelling.refuse(
        store.read("observations"), radius_floor=args.radius_floor, radius_scale=args.radius_scale,
        min_obb_iou=args.min_iou, min_confidence=args.min_confidence, min_observations=args.min_observations,
    )
    if args.save:
        print("version", store.write({"objects": objects, "observations": observations}))
    print_rows(labelling.report_lines(objects).orderBy("room", text.object_number("object_id")))


def _view(args, spark, config) -> None:
    shown = SceneStore(spark, args.store).read("objects").where(F.coalesce("confidence", F.lit(0.0)) >= args.min_confidence)
    print_rows(labelling.report_lines(shown).orderBy("room", text.object_number("object_id")))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    top.add_argument("--config", help="settings YAML")
    top.add_argument("--master", help="Spark master, when not set by spark-submit")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, run, help):
        made = sub.add_parser(name, help=help)
        made.set_defaults(run=run)
        return made

    c = command("extract", _extract, "folder of images -> sharp, distinct frames")
    c.add_argument("source")
    c.add_argument("out")
    c.add_argument("--n-frames", type=int)
    c = command("load", _load, "frame archives -> store")
    c.add_argument("archives")
    c.add_argument("store")
    c = command("level", _level, "stand all rooms of a store upright")
    c.add_argument("store")
    c.add_argument("--up", help="declare the up axis: x, y, z, -x, -y, -z")
    c = command("label", _label, "detector replies -> observations and objects")
    c.add_argument("store")
    c.add_argument("replies")
    c = command("refuse", _refuse, "merge stored observations again")
    c.add_argument("store")
    for name, value in (("radius-floor", 0.30), ("radius-scale", 0.50), ("min-iou", 0.10), ("min-confidence", 0.0)):
        c.add_argument(f"--{name}", type=float, default=value)
    c.add_argument("--min-observations", type=int, default=1)
    c.add_argument("--save", action="store_true")
    c = command("view", _view, "list objects")
    c.add_argument("store")
    c.add_argument("--min-confidence", type=float, default=0.0)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(args, build_session(master=args.master), load_config(args.config))


if __name__ == "__main__":
    main()
