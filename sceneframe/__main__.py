"""Command line: ``python -m sceneframe inspect|audit|answers|extract``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from sceneframe.operators import profile as P
from sceneframe.operators.slots import subject_categories
from sceneframe.plans.extraction import extract
from sceneframe.sources import annotations as AN


def _videos(spark: SparkSession, args: argparse.Namespace):
    docs = AN.read_video_annotations(spark, args.annotations, args.split, args.max_videos, not args.json_lines)
    return docs, AN.video_detections(docs), AN.video_subjects(docs)


def _print_all(report: DataFrame) -> None:
    """Every row, tab-separated; rows stream through the driver partition by partition."""
    print(*report.columns, sep="\t")
    for row in report.toLocalIterator():
        print(*("" if v is None else str(v).lower() if isinstance(v, bool) else v for v in row), sep="\t")


def inspect(spark: SparkSession, args: argparse.Namespace) -> int:
    """Viability of every category, and of all videos together."""
    docs, detections, subjects = _videos(spark, args)
    frames = detections.select("video_id", "fid").distinct()
    if args.frames:
        frames = frames.join(AN.list_frames(spark, args.frames), ["video_id", "fid"], "left_semi")
    P.viability_total(frames, args.threshold).show()
    primaries = P.primary_category(detections, subject_categories(subjects), docs) if args.strict else None
    report = P.viability(subjects, frames, args.threshold, primaries=primaries)
    if args.category:
        report = report.where(F.col("category") == args.category)
    _print_all(report.orderBy(F.col("listed_videos").desc(), "category"))
    return 0


def audit(spark: SparkSession, args: argparse.Namespace) -> int:
    """Fails when a loaded video has another primary category than the requested one."""
    docs, detections, subjects = _videos(spark, args)
    primaries = P.primary_category(detections, subject_categories(subjects), docs)
    if args.loose:
        loaded = primaries.join(subjects.where(F.col("category") == args.category).select("video_id"), "video_id", "left_semi")
    else:
        loaded = primaries.where(F.col("primary") == args.category)
    _print_all(P.category_audit(loaded, args.category))
    return 0 if P.audit_verdict(loaded, args.category).first()["passed"] else 1


def answers(spark: SparkSession, args: argparse.Namespace) -> int:
    """Detector answers to labelled images, with label metrics."""
    images = AN.labelled_from_answers(AN.read_vlm_answers(spark, args.input, not args.json_lines))
    images.write.mode("overwrite").json(args.output)
    written = spark.read.schema(AN.IMAGE_SCHEMA).json(args.output)
    _print_all(P.annotation_metrics(written).where("metric <> 'label'").orderBy("metric", F.col("item").try_cast("int")))
    _print_all(P.top_labels(AN.image_detections(written), "class"))
    return 0


def run_extract(spark: SparkSession, args: argparse.Namespace) -> int:
    states = spark.read.parquet(args.input)
    names = "object_names" if "object_names" in states.columns else None
    image = "image" if "image" in states.columns else None
    extract(states, args.state, args.output, args.units, args.arguments, args.predicates, args.objects, names, image,
            args.num, args.confidence, args.show_negated)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sceneframe")
    sub = p.add_subparsers(dest="command", required=True)
    for name, fn in (("inspect", inspect), ("audit", audit)):
        c = sub.add_parser(name)
        c.set_defaults(run=fn)
        c.add_argument("--annotations", required=True)
        c.add_argument("--split")
        c.add_argument("--category", required=name == "audit")
        c.add_argument("--max-videos", type=int)
        c.add_argument("--json-lines", action="store_true")
        if name == "inspect":
            c.add_argument("--frames")
            c.add_argument("--strict", action="store_true", help="count a video for its primary category only")
            c.add_argument("--threshold", type=int, default=P.VIABLE_TRANSITIONS)
        else:
            c.add_argument("--loose", action="store_true")
    c = sub.add_parser("answers")
    c.set_defaults(run=answers)
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--json-lines", action="store_true")
    c = sub.add_parser("extract")
    c.set_defaults(run=run_extract)
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--state", default="state_id")
    for n in ("units", "arguments", "predicates", "objects"):
        c.add_argument(f"--{n}", type=int, required=True)
    c.add_argument("--num", type=int)
    c.add_argument("--confidence", type=float, default=0.5)
    c.add_argument("--show-negated", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
