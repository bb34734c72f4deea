"""Command line: ``python -m vastlin generate PATH``, ``fit KIND PATH``, ``rosenbrock``."""

from __future__ import annotations

import argparse

import numpy as np


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="vastlin")
    sub = top.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate", help="write synthetic libsvm text")
    g.add_argument("path")
    for name, value in (("dimension", 100), ("splits", 100), ("records", 100), ("features", 10), ("seed", 7)):
        g.add_argument(f"--{name}", type=int, default=value)
    f = sub.add_parser("fit", help="fit a model to libsvm text")
    f.add_argument("kind", choices=("logistic", "linear", "softmax", "baseline"))
    f.add_argument("path")
    f.add_argument("--model", help="where to save it")
    for name, kind, value in (("features", int, None), ("max-iter", int, 100), ("reg", float, 0.0), ("elastic-net", float, 0.0), ("corrections", int, 10), ("cols-per-block", int, 10_000), ("rows-per-block", int, 10_000), ("row-partitions", int, 10), ("col-partitions", int, 10)):
        f.add_argument(f"--{name}", type=kind, default=value)
    f.add_argument("--layout", default="auto")
    f.add_argument("--no-intercept", action="store_true")
    f.add_argument("--no-standardization", action="store_true")
    r = sub.add_parser("rosenbrock", help="minimise the Rosenbrock function")
    r.add_argument("--dimension", type=int, default=100)
    r.add_argument("--iterations", type=int, default=100)
    r.add_argument("--corrections", type=int, default=4)
    r.add_argument("--block", type=int, default=10, help="components of a block")
    r.add_argument("--distributed", action="store_true")
    c = sub.add_parser("compare", help="fit a model to libsvm text with coefficients on the driver and distributed, and show both")
    c.add_argument("kind", choices=("logistic", "linear", "softmax"))
    c.add_argument("path")
    for name, kind, value in (("features", int, None), ("max-iter", int, 20), ("reg", float, 0.5), ("elastic-net", float, 0.0), ("cols-per-block", int, 100), ("rows-per-block", int, 1000), ("row-partitions", int, 3), ("col-partitions", int, 3)):
        c.add_argument(f"--{name}", type=kind, default=value)
    a = top.parse_args(args)
    if a.command == "rosenbrock":
        from vastlin.operators.dvector import LocalVector
        from vastlin.plans.lbfgs import LBFGS, rosenbrock

        start = LocalVector(np.random.default_rng(42).uniform(-10, 10, a.dimension))
        if a.distributed:
            from pyspark.sql import SparkSession

            from vastlin.operators.dvector import DistVector

            start = DistVector.of(SparkSession.builder.appName("vastlin").getOrCreate(), start.values, a.block)
        for s in LBFGS(a.iterations, a.corrections).iterations(rosenbrock, start):
            print(s.iteration, s.value)
        return 0
    from pyspark.sql import SparkSession

    from vastlin import models, sources

    spark = SparkSession.builder.appName("vastlin").getOrCreate()
    if a.command == "generate":
        sources.write_text(sources.generate(spark, a.dimension, a.splits, a.records, a.features, a.seed), a.path)
        return 0
    if a.command == "compare":
        kind = {"logistic": models.LogisticRegression, "linear": models.LinearRegression, "softmax": models.SoftmaxRegression}[a.kind]
        rows = sources.read_libsvm(spark, a.path, a.features)
        params = {"max_iter": a.max_iter, "reg_param": a.reg, "elastic_net_param": a.elastic_net, "cols_per_block": a.cols_per_block, "rows_per_block": a.rows_per_block, "row_partitions": a.row_partitions, "col_partitions": a.col_partitions}
        for layout in ("local", "distributed"):
            print(layout, kind(**params, layout=layout).fit(rows).objectiveHistory)
        return 0
    kind = {"logistic": models.LogisticRegression, "linear": models.LinearRegression, "softmax": models.SoftmaxRegression, "baseline": models.LocalLogisticRegression}[a.kind]
    params = {"max_iter": a.max_iter, "reg_param": a.reg, "elastic_net_param": a.elastic_net, "num_corrections": a.corrections, "cols_per_block": a.cols_per_block, "rows_per_block": a.rows_per_block, "row_partitions": a.row_partitions, "col_partitions": a.col_partitions, "fit_intercept": not a.no_intercept, "standardization": not a.no_standardization}
    model = kind(**params | ({} if a.kind == "baseline" else {"layout": a.layout})).fit(sources.read_libsvm(spark, a.path, a.features))
    print(model.objectiveHistory)
    if a.model:
        model.save(a.model, spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
