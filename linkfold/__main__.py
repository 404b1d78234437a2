"""Command line: one run of the analysed scripts on any edge or vector file.

    python -m linkfold components --input edges.tsv --output out/ [--sep TAB] [--header]
        [--id-type long|string] [--comment '#'] [--skip-lines N] [--on-bad fail|drop] [--strategy join]
        [--resume NAME]
        [--format parquet|csv] [--include-roots] [--partitions N] [--checkpoint-dir DIR] [--top 20]
    python -m linkfold kmeans --input points.csv --output out/ [--k 3] [--features 4]
        [--sep ,] [--seed 42] [--max-steps 100] [--format parquet|csv] [--checkpoint-dir DIR]

With ``spark-submit``, pass this file's path instead of ``-m linkfold``. The run prints
one JSON line: input rows, rejected rows and input partitions, rounds and the ``(round, new_pairs, pairs)``
trace, the component count, processing and write seconds and the largest components (or, for k-means, steps,
whether it converged, error, per-step switches and the centroids). Results are written in parallel and
replace what was at ``--output``.

The checkpoint folder is the session's ``spark.checkpoint.dir``; ``--checkpoint-dir``
is used only where the session names none, and must be shared by all executors.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linkfold.storage import scratch


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m linkfold")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("components", "kmeans"):
        s = sub.add_parser(name)
        s.add_argument("--input", required=True)
        s.add_argument("--output", required=True)
        s.add_argument("--format", choices=("parquet", "csv"), default="parquet")
        s.add_argument("--partitions", type=int, default=None,
                       help="partitions of the round tables (components) or of shuffles (k-means)")
        s.add_argument("--checkpoint-dir", default=None)
    c = sub.choices["components"]
    c.add_argument("--sep", default="\t")
    c.add_argument("--header", action="store_true")
    c.add_argument("--comment", default=None)
    c.add_argument("--skip-lines", type=int, default=0, help="lead lines of every file to leave out")
    c.add_argument("--on-bad", choices=("fail", "drop"), default="fail",
                   help="rows with a missing field or one that is not of the id type")
    c.add_argument("--id-type", choices=("long", "string"), default="long")
    c.add_argument("--strategy", choices=("join", "collect", "sorted", "window", "grouped", "contract"), default="join")
    c.add_argument("--resume", default=None, metavar="NAME",
                   help="name of the run: started again under it, a run goes on after its last finished round")
    c.add_argument("--include-roots", action="store_true")
    c.add_argument("--top", type=int, default=20)
    k = sub.choices["kmeans"]
    k.add_argument("--sep", default=",")
    k.add_argument("--k", type=int, default=3)
    k.add_argument("--features", type=int, default=4)
    k.add_argument("--seed", type=int, default=42)
    k.add_argument("--max-steps", type=int, default=100)
    k.add_argument("--on-bad", choices=("fail", "drop"), default="fail",
                   help="rows with a missing field or a feature that is no number")
    return p


def _use_checkpoint_dir(spark: SparkSession, fallback: str | None) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return
    if not fallback:
        raise SystemExit("no checkpoint folder: set spark.checkpoint.dir to a shared folder "
                         "or pass --checkpoint-dir")
    sc.setCheckpointDir(fallback)


def run_components(spark: SparkSession, a: argparse.Namespace) -> dict:
    from linkfold.operators.components import connected_components
    from linkfold.operators.reports import component_count, top_components
    from linkfold.sources.edges import edge_report, read_edges_csv
    from linkfold.sources.sinks import write_result

    source = {"sep": a.sep, "header": a.header, "id_type": a.id_type, "comment": a.comment, "skip_lines": a.skip_lines}
    edges = read_edges_csv(spark, a.input, on_bad=a.on_bad, **source)
    t0 = time.time()
    if a.resume and a.strategy in ("grouped", "contract"):
        raise SystemExit("--resume needs a strategy of rounds, not grouped or contract")
    resume = {"resume": a.resume} if a.resume else {}
    res = connected_components(edges, strategy=a.strategy, num_partitions=a.partitions, **resume)
    read = edge_report(spark, a.input, **source).first()
    t1 = time.time()
    write_result(res.membership(include_roots=a.include_roots), a.output, fmt=a.format)
    t2 = time.time()
    m = res.membership()
    top = top_components(m, a.top).collect()          # at most --top rows
    n_components = component_count(m).first()[0]
    res.release()                                     # the result is at --output now
    return {"command": "components", "strategy": a.strategy,
            "input_rows": read["n_rows"], "rejected_rows": read["n_short"] + read["n_unreadable"],
            "input_partitions": edges.rdd.getNumPartitions(), "rounds": res.rounds,
            "trace": [list(t) for t in res.trace], "components": n_components,
            "process_s": round(t1 - t0, 3), "write_s": round(t2 - t1, 3),
            "top": [[r["component"], r["n_nodes"]] for r in top]}


def run_kmeans(spark: SparkSession, a: argparse.Namespace) -> dict:
    from linkfold.operators import kmeans as km
    from linkfold.operators.ordering import row_index
    from linkfold.sources.edges import read_vectors_csv, vector_report
    from linkfold.sources.sinks import write_result

    raw = read_vectors_csv(spark, a.input, n_features=a.features, sep=a.sep, on_bad=a.on_bad)
    # contiguous ids from 0 (what zipWithIndex gives), in the order of Spark's input splits
    points = row_index(raw.withColumn("_pos", F.monotonically_increasing_id()), ["_pos"], "id", position=["_pos"]) \
        .select("id", "features", "label")
    t0 = time.time()
    res = km.kmeans(points, km.init_by_sample(points, a.k, a.seed), max_steps=a.max_steps)
    t1 = time.time()
    features = ["features"] if a.format == "parquet" else [F.col("features")[i].alias(f"f{i}") for i in range(a.features)]
    write_result(res.assignment.select("id", "cid", "dist", *features, "label"), a.output, fmt=a.format)
    t2 = time.time()
    read = vector_report(spark, a.input, n_features=a.features, sep=a.sep).first()
    return {"command": "kmeans", "k": a.k, "input_rows": read["n_rows"], "rejected_rows": read["n_short"] + read["n_unreadable"],
            "steps": res.steps, "converged": res.converged, "error": res.error,
            "switches": [t[1] for t in res.trace], "centers": [[c, v] for c, v in res.centers],
            "process_s": round(t1 - t0, 3), "write_s": round(t2 - t1, 3)}


def main(argv: list[str] | None = None) -> dict:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"linkfold-{a.command}").getOrCreate()
    if a.partitions and a.command == "kmeans":
        spark.conf.set("spark.sql.shuffle.partitions", str(a.partitions))
    _use_checkpoint_dir(spark, a.checkpoint_dir)
    with scratch(spark):   # results are at --output when it ends
        report = (run_components if a.command == "components" else run_kmeans)(spark, a)
    print(json.dumps(report))
    return report


if __name__ == "__main__":
    main(sys.argv[1:])
