"""Sources, sinks, catalog, plans, orchestration, streaming."""

import dataclasses
import logging

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyforge import pipeline, session
from tallyforge.plans import catalog, pairs
from tallyforge.sources import readers, sinks
from tallyforge.sources.schema import TERRITORIES, SchemaValidationError, raw_schema, validate_schema
from tallyforge.streaming import revenue
from tests.factories import raw

SF = "/root/testdata/sf0.001"


def test_schema_check(spark):
    df = raw(spark, {})
    assert validate_schema(df, raw_schema()) == []
    assert validate_schema(df.withColumn("extra_col", F.lit(1)), raw_schema()) == ["extra_col"]
    with pytest.raises(SchemaValidationError, match="customer_id"):
        validate_schema(df.drop("customer_id"), raw_schema())
    with pytest.raises(SchemaValidationError, match="quantity"):
        validate_schema(df.withColumn("quantity", F.lit("x")), raw_schema())


def test_csv(spark, tmp_path):
    head = ",".join(raw_schema().names)
    good = "T1,C1,P1,PROMO,2024-01-15,2,19.99,39.98,ASIA,2-HIGH,35,BUILDING"
    file = tmp_path / "in.csv"
    file.write_text("\n".join([head, good, "T2,C1,P1", f"{good},more", good.replace("39.98", "many")]) + "\n")
    df, counts = readers.ingest(spark, str(file))
    assert (counts["rows"], counts["corrupt"], df.count()) == (4, 3, 4)
    file.write_text(f"{head}\n")
    with pytest.raises(ValueError, match="no rows"):
        readers.ingest(spark, str(file))
    other = tmp_path / "swapped.csv"
    other.write_text(head.replace("transaction_id,customer_id", "customer_id,transaction_id") + f"\n{good}\n")
    with pytest.raises(SchemaValidationError):
        readers.ingest(spark, str(other))
    with pytest.raises(FileNotFoundError):
        readers.ingest(spark, str(tmp_path / "none.csv"))


def test_formats(spark, tmp_path):
    df = readers.region_dimension(spark)
    for kind in ("parquet", "orc", "json"):
        sinks.write_table(df, str(tmp_path / kind), kind)
        assert readers.read_table(spark, str(tmp_path / kind), kind).count() == len(TERRITORIES)
    sinks.write_table(df, str(tmp_path / "parquet"), mode="append")
    assert readers.read_table(spark, str(tmp_path / "parquet")).count() == 2 * len(TERRITORIES)
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path), "xml")


def test_partitions_are_pruned(spark, tmp_path):
    sinks.write_table(readers.transactions(spark, SF).select("region", "total_amount"), str(tmp_path / "t"), partition_by=("region",))
    plan = pairs.explained(readers.read_table(spark, str(tmp_path / "t")).filter("region = 'ASIA'"))
    assert "PartitionFilters: [isnotnull(region" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = pairs.explained(__spark_entry__.queries()["scan_filter_project"](spark, SF))
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_comment" not in plan and "l_tax" not in plan


def test_hints_choose_the_join(spark):
    assert "SortMergeJoin" in pairs.explained(pairs.run(spark, "join_region_sort_merge", SF))
    assert "BroadcastHashJoin" in pairs.explained(pairs.run(spark, "join_region_broadcast", SF))


def test_ranking_needs_no_self_join(spark):
    ours = sorted(map(tuple, pairs.run(spark, "ltv_rank_window", SF).collect()))
    assert ours == sorted(map(tuple, pairs.run(spark, "ltv_rank_self_join", SF).collect()))


def test_catalog():
    found = catalog.catalog()
    assert len(found) == 11 and all(not q.sql.endswith(";") for q in found.values())
    with pytest.raises(ValueError):
        catalog.parse_catalog("SELECT 1")
    with pytest.raises(ValueError, match="revenue_trend_daily"):
        catalog.main(["--query", "nothing"])
    assert catalog.main(["--list"]) == 0


def test_orchestration():
    ran = []
    stages = {"a": lambda *_: ran.append("a"), "b": lambda *_: 1 / 0, "c": lambda *_: ran.append("c")}
    settings = session.Settings()
    results = pipeline.run(None, settings, list(stages), stages=stages)
    assert [r.status for r in results] == ["success", "failed", "skipped"] and "ZeroDivisionError" in results[1].error
    results = pipeline.run(None, settings, list(stages), keep_going=True, stages=stages)
    assert [r.status for r in results] == ["success", "failed", "success"] and ran == ["a", "a", "c"]
    assert pipeline.chosen(["evaluate", "ingest"]) == ["ingest", "evaluate"] and pipeline.chosen(["cleanse", "all"]) == list(pipeline.STAGES)
    with pytest.raises(ValueError):
        pipeline.chosen(["nothing"])
    assert pipeline.main(["--dry-run"]) == 0


def test_stages_in_processes_of_their_own():
    done = lambda name: pipeline.Result(name, "errored" if name == "b" else "success")
    assert [r.status for r in pipeline.run(None, session.Settings(), ["a", "b", "c"], stages={}, apart=done)] == ["success", "errored", "skipped"]
    assert pipeline.run_apart("ingest", python="/no/such/python").status == "errored"
    failed = pipeline.run_apart("nothing")  # an unknown stage
    assert failed.status == "failed" and failed.error == "exit code 1"


def test_a_query_is_counted_and_timed(spark):
    catalog.register_views(spark, {"transactions": readers.transactions(spark, SF), "region_dim": readers.region_dimension(spark)})
    df, rows, seconds = catalog.run_query(spark, catalog.catalog()["regional_category_breakdown"], preview=2)
    assert rows == df.count() > 0 and seconds > 0


def test_environments(tmp_path, monkeypatch):
    file = tmp_path / "s.json"
    file.write_text('{"out": "/a", "environment": "here", "environments": {"here": {"top_n": 3}, "there": {"out": "/b"}}}')
    assert session.Settings.load(str(file)).top_n == 3
    assert session.Settings.load(str(file), "there").out == "/b"
    monkeypatch.setenv("TALLYFORGE_ENVIRONMENT", "there")
    assert session.Settings.load(str(file)) == session.Settings(out="/b")
    with pytest.raises(ValueError, match="here, there"):
        session.Settings.load(str(file), "nowhere")


def test_settings_reach_the_stages(spark, tmp_path):
    """Each setting of the cleanser changes what its stage writes, and the tables share one base dataset."""
    words = tmp_path / "words.json"
    words.write_text('{"region": ["Asia Pacific", "AFRICA"]}')
    base = session.Settings(out=str(tmp_path / "0"))
    pipeline.ingest(spark, base)
    found = {}
    for name, change in {"none": {}, "ages": {"age_min": 30, "age_max": 60}, "factor": {"iqr_factor": 0.1}, "words": {"vocabulary": str(words)}}.items():
        s = dataclasses.replace(base, **change)
        pipeline.cleanse(spark, s)
        rows = readers.read_table(spark, f"{s.out}/cleansed")
        found[name] = (rows.agg(F.min("customer_age"), F.max("customer_age")).first(), rows.agg(F.max("total_amount")).first()[0], {r.region for r in rows.select("region").distinct().collect()})
    assert found["none"][0] == (18, 80) and found["ages"][0] == (30, 60)
    assert found["factor"][1] < found["none"][1]
    assert "ASIA" in found["none"][2] and "ASIA" not in found["words"][2] and "AFRICA" in found["words"][2]
    pipeline.transform(spark, dataclasses.replace(base, partitions=3))
    shared = readers.read_table(spark, f"{base.out}/base")
    assert {"sales_territory", "purchase_year_month"} <= set(shared.columns)
    assert readers.read_table(spark, f"{base.out}/daily_revenue").agg(F.sum("num_transactions")).first()[0] == shared.filter("purchase_date is not null").count()


def test_settings(tmp_path, monkeypatch):
    file = tmp_path / "s.json"
    file.write_text('{"churn_days": 30, "out": "/x"}')
    monkeypatch.setenv("TALLYFORGE_OUT", "/y")
    found = session.Settings.load(str(file))
    assert (found.churn_days, found.out) == (30, "/y")
    file.write_text('{"nothing": 1}')
    with pytest.raises(ValueError):
        session.Settings.load(str(file))


def test_logger_has_one_handler():
    assert len(session.get_logger("x").handlers) == len(session.get_logger("x").handlers) == 1
    assert isinstance(logging.getLogger("x").handlers[0].formatter, session.JsonFormatter)


def test_stream_gives_the_batch_of_closed_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    query = revenue.stream(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    batch = revenue.windowed(events)
    assert found.count() > 0 and found.exceptAll(batch).count() == 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
