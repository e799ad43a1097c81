"""The catalog of named SQL queries: parsing, views, running."""

from __future__ import annotations

import argparse
import re
import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyforge.session import get_logger
from tallyforge.sources import readers

CATALOG = Path(__file__).with_name("catalog.sql")


@dataclass(frozen=True)
class NamedQuery:
    name: str
    description: str
    sql: str


def parse_catalog(text: str) -> dict[str, NamedQuery]:
    """Queries by name: each begins with ``-- @name:`` and ``-- @description:`` lines. None at all is an error."""
    heads = list(re.finditer(r"^--\s*@name:\s*(\S+)\s*\n--\s*@description:\s*(.*)$", text, re.M))
    if not heads:
        raise ValueError("the catalog holds no query")
    ends = [h.start() for h in heads[1:]] + [len(text)]
    return {h[1]: NamedQuery(h[1], h[2].strip(), text[h.end() : end].strip().rstrip(";").strip()) for h, end in zip(heads, ends)}


def catalog(path: Path = CATALOG) -> dict[str, NamedQuery]:
    return parse_catalog(path.read_text())


def register_views(spark: SparkSession, tables: dict[str, DataFrame], optional: tuple[str, ...] = ()) -> list[str]:
    """Make temp views of the tables that are there; the names of missing optional ones. A missing required one raises."""
    for name in ("transactions", "region_dim"):
        if tables.get(name) is None:
            raise KeyError(f"the catalog needs {name}")
    for name, df in tables.items():
        if df is not None:
            df.createOrReplaceTempView(name)
    return [name for name in optional if tables.get(name) is None]


def run(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    """A query of the catalog over the star schema of ``sf_dir``; an unknown name is an error that lists the known."""
    queries = catalog()
    if name not in queries:
        raise ValueError(f"unknown query {name!r}; one of {', '.join(queries)}")
    return query(spark, queries[name].sql, sf_dir)


def query(spark: SparkSession, sql: str, sf_dir: str) -> DataFrame:
    register_views(spark, {"transactions": readers.transactions(spark, sf_dir), "region_dim": readers.region_dimension(spark)})
    return spark.sql(sql)


def timed(df: DataFrame) -> float:
    """Seconds to make every row and column; unlike a count, nothing is pruned."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def run_query(spark: SparkSession, found: NamedQuery, preview: int = 20) -> tuple[DataFrame, int, float]:
    """The rows of a catalog query over the registered views, how many, and the seconds it took; all three are logged.

    The result is counted as it is made, by an observation, so that it is made once; the preview takes its first rows.
    """
    df = spark.sql(found.sql)
    seen = Observation(found.name)
    seconds = timed(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    rows = seen.get["rows"]
    get_logger().info("query %s: %d rows in %.2f s", found.name, rows, seconds)
    if preview:
        df.show(preview, truncate=False)
    return df, rows, seconds


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Named SQL queries")
    parser.add_argument("--data", default="/root/testdata/sf0.001")
    parser.add_argument("--list", action="store_true", help="names and descriptions; starts no session")
    parser.add_argument("--query")
    parser.add_argument("--compare", action="store_true", help="time both plans of each pair")
    parser.add_argument("--notes", help="write plans and times as Markdown to this file")
    args = parser.parse_args(argv)
    queries = catalog()
    if args.list:
        print("\n".join(f"{q.name}: {q.description}" for q in queries.values()))
        return 0
    if args.query and args.query not in queries:
        raise ValueError(f"unknown query {args.query!r}; one of {', '.join(queries)}")
    from tallyforge.plans import pairs
    from tallyforge.session import get_session

    spark = get_session()
    if args.compare or args.notes:
        notes = pairs.compare(spark, args.data)
        print(notes) if not args.notes else Path(args.notes).write_text(notes)
        return 0
    register_views(spark, {"transactions": readers.transactions(spark, args.data), "region_dim": readers.region_dimension(spark)})
    for name in [args.query] if args.query else queries:
        print(name)
        run_query(spark, queries[name])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
