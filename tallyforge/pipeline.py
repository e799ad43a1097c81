"""The retail stages in order, on one session: each reads what the ones before it wrote."""

from __future__ import annotations

import argparse
import subprocess
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyforge.operators import aggregates, cleansing, features, metrics, models
from tallyforge.plans import catalog
from tallyforge.session import Settings, get_logger, get_session
from tallyforge.sources import readers, sinks
from tallyforge.sources.schema import Vocabulary


@dataclass(frozen=True)
class Result:
    stage: str
    status: str  # success, failed, errored (never started) or skipped
    seconds: float = 0.0
    error: str = ""


def _at(s: Settings, name: str) -> str:
    return f"{s.out}/{name}"


def _get(spark: SparkSession, s: Settings, name: str) -> DataFrame:
    return readers.read_table(spark, _at(s, name), s.table_format)


def _put(df: DataFrame, s: Settings, name: str, *by: str) -> None:
    sinks.write_table(df, _at(s, name), s.table_format, partition_by=by)


def ingest(spark: SparkSession, s: Settings) -> None:
    """Raw transactions: of a CSV file, or the dirty twin of a star schema."""
    raw = readers.ingest(spark, s.data)[0] if s.data.endswith(".csv") else readers.dirty_transactions(spark, s.data)
    _put(raw, s, "raw")


def cleanse(spark: SparkSession, s: Settings) -> None:
    steps = cleansing.DataCleanser(_get(spark, s, "raw"), Vocabulary.load(s.vocabulary), ages=(s.age_min, s.age_max), factor=s.iqr_factor)
    _put(steps.run(), s, "cleansed")
    sinks.write_report(steps.report(), _at(s, "reports/cleansing"))


def transform(spark: SparkSession, s: Settings) -> None:
    """The base dataset, dealt by customer and written once, and the five tables that share it."""
    dealt = s.partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    _put(aggregates.base_dataset(_get(spark, s, "cleansed"), readers.region_dimension(spark), dealt), s, "base")
    rows = _get(spark, s, "base")
    _put(aggregates.daily_revenue(rows), s, "daily_revenue", "region")
    _put(aggregates.monthly_revenue(rows), s, "monthly_revenue", "region")
    _put(aggregates.customer_rfm(rows), s, "customer_rfm")
    _put(aggregates.top_products(rows, s.top_n), s, "top_products", "category")
    _put(aggregates.payment_distribution(rows), s, "payment_distribution")


def sql_analytics(spark: SparkSession, s: Settings) -> None:
    catalog.register_views(spark, {"transactions": _get(spark, s, "cleansed"), "region_dim": readers.region_dimension(spark)})
    for name, query in catalog.catalog().items():
        _put(spark.sql(query.sql), s, f"analytics/{name}")


def feature_engineering(spark: SparkSession, s: Settings) -> None:
    rows = _get(spark, s, "cleansed")
    _put(features.clustering_features(rows, _get(spark, s, "customer_rfm")), s, "clustering_features")
    _put(features.churn_features(rows, s.churn_days), s, "churn_features")


def train_model(spark: SparkSession, s: Settings) -> None:
    rows = _get(spark, s, "clustering_features")
    sweep = models.k_sweep(rows, s.k_min, s.k_max, s.seed)
    sinks.write_report(sweep, _at(s, "reports/k_sweep"))
    models.save(models.fit_segments(rows, sweep.filter("chosen").first()["k"], s.seed), _at(s, "models/segments"))
    split = models.churn_split(_get(spark, s, "churn_features"), s.test_share, s.seed)
    models.save(models.fit_churn(split.filter("not is_test"), s.trees, s.depth, s.seed), _at(s, "models/churn"))


def evaluate(spark: SparkSession, s: Settings) -> None:
    segments, churn = (models.load(spark, _at(s, f"models/{m}")) for m in ("segments", "churn"))
    assigned = models.assign(segments, _get(spark, s, "clustering_features"))
    sinks.write_report(metrics.cluster_profile(assigned, models.SEGMENT_COLUMNS), _at(s, "reports/clusters"), "csv")
    test = models.churn_split(_get(spark, s, "churn_features"), s.test_share, s.seed).filter("is_test")
    scored = models.churn_scores(churn, test)
    _put(scored, s, "churn_scores")
    scored = _get(spark, s, "churn_scores")
    for name, df in (("churn_metrics", metrics.binary_metrics(scored)), ("confusion", metrics.confusion_matrix(scored)), ("roc_auc", metrics.roc_auc(scored))):
        sinks.write_report(df, _at(s, f"reports/{name}"))


STAGES: dict[str, Callable[[SparkSession, Settings], None]] = {f.__name__: f for f in (ingest, cleanse, transform, sql_analytics, feature_engineering, train_model, evaluate)}


def chosen(names: list[str]) -> list[str]:
    """Stages in their own order, whatever order they are asked for in; ``all`` wins. An unknown name is an error."""
    unknown = set(names) - set(STAGES) - {"all"}
    if unknown:
        raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}; known: {', '.join(STAGES)}")
    return list(STAGES) if not names or "all" in names else [n for n in STAGES if n in names]


def run_apart(name: str, config: str | None = None, environment: str | None = None, python: str = sys.executable) -> Result:
    """Run one stage in a process of its own; its output goes through. A process that cannot start is errored."""
    command = [python, "-m", "tallyforge.pipeline", name, *(["--config", config] if config else []), *(["--environment", environment] if environment else [])]
    began = time.perf_counter()
    try:
        code = subprocess.run(command, check=False).returncode
    except OSError as error:
        get_logger().exception("stage %s did not start", name)
        return Result(name, "errored", time.perf_counter() - began, f"{type(error).__name__}: {error}"[:300])
    return Result(name, "failed" if code else "success", time.perf_counter() - began, f"exit code {code}" if code else "")


def run(spark: SparkSession | None, settings: Settings, names: list[str], keep_going: bool = False, dry: bool = False, stages=None, apart: Callable[[str], Result] | None = None) -> list[Result]:
    """Run stages; after a failure the rest are skipped unless ``keep_going``. A dry run only lists them; ``apart`` runs
    each in a process of its own instead of on the session."""
    stages = stages or STAGES
    log, results, failed = get_logger(), [], False
    for name in names:
        if dry:
            results.append(Result(name, "planned"))
            continue
        if failed and not keep_going:
            results.append(Result(name, "skipped"))
            continue
        if apart is not None:
            results.append(apart(name))
            failed = failed or results[-1].status != "success"
            continue
        began = time.perf_counter()
        try:
            stages[name](spark, settings)
            results.append(Result(name, "success", time.perf_counter() - began))
        except Exception as error:  # a stage may fail in any way; the summary says how
            log.exception("stage %s failed", name)
            results.append(Result(name, "failed", time.perf_counter() - began, f"{type(error).__name__}: {error}"[:300]))
            failed = True
    return results


def summary(results: list[Result]) -> str:
    return "\n".join(f"{r.stage:<20} {r.status:<8} {r.seconds:8.2f} s {r.error}".rstrip() for r in results)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Retail pipeline")
    parser.add_argument("stages", nargs="*", default=[])
    parser.add_argument("--config")
    parser.add_argument("--environment")
    parser.add_argument("--apart", action="store_true", help="run each stage in a process of its own")
    parser.add_argument("--continue-on-failure", action="store_true")
    parser.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    settings, names = Settings.load(args.config, args.environment), chosen(args.stages)
    apart = (lambda name: run_apart(name, args.config, args.environment)) if args.apart else None
    spark = None if args.dry_run or args.apart else get_session()
    results = run(spark, settings, names, args.continue_on_failure, args.dry_run, apart=apart)
    print(summary(results))
    return int(any(r.status in ("failed", "errored") for r in results))


if __name__ == "__main__":
    raise SystemExit(main())
