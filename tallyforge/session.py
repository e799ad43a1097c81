"""The session, its settings and logging."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """What a run needs; ``load`` takes a JSON or YAML file, environment variables of the same names come first.

    A file may have a part ``environments``: by name, settings that hold in that environment only. The one that acts is
    named by ``environment`` in the call, by TALLYFORGE_ENVIRONMENT or in the file, in this order.
    """

    data: str = "/root/testdata/sf0.001"
    out: str = "/tmp/tallyforge"
    table_format: str = "parquet"
    iqr_factor: float = 1.5
    age_min: int = 18
    age_max: int = 100
    vocabulary: str = ""  # JSON file of known spellings by column; those of the test tables without one
    partitions: int = 0  # into which the base dataset is dealt by customer; the session's shuffle partitions if 0
    top_n: int = 10
    churn_days: int = 90
    k_min: int = 3
    k_max: int = 8
    seed: int = 42
    trees: int = 300
    depth: int = 10
    test_share: float = 0.2

    @classmethod
    def load(cls, path: str | None = None, environment: str | None = None) -> Settings:
        found: dict = {}
        if path:
            text = Path(path).read_text()
            if path.endswith((".yml", ".yaml")):
                import yaml

                found = yaml.safe_load(text) or {}
            else:
                found = json.loads(text)
        parts, named = found.pop("environments", {}), found.pop("environment", None)
        environment = environment or os.environ.get("TALLYFORGE_ENVIRONMENT") or named
        if environment is not None:
            if environment not in parts:
                raise ValueError(f"unknown environment {environment!r}; one of {', '.join(sorted(parts)) or 'none'}")
            found |= parts[environment]
        kinds = {f.name: type(f.default) for f in fields(cls)}
        unknown = set(found) - set(kinds)
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        found |= {k: os.environ[f"TALLYFORGE_{k.upper()}"] for k in kinds if f"TALLYFORGE_{k.upper()}" in os.environ}
        return cls(**{k: kinds[k](v) for k, v in found.items()})


def get_session(app: str = "tallyforge", master: str | None = None, delta: bool = False) -> SparkSession:
    """A session that plans adaptively, in UTC. ``delta`` needs the Delta package and says so where it is not."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    if delta:
        try:
            from delta import configure_spark_with_delta_pip
        except ImportError as error:
            raise ImportError("the delta format needs the delta-spark package; use parquet without it") from error
        builder = configure_spark_with_delta_pip(builder)
    return builder.getOrCreate()


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        row = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            row["error"] = self.formatException(record.exc_info)
        return json.dumps(row)


def get_logger(name: str = "tallyforge") -> logging.Logger:
    """A logger with one JSON handler, however often it is asked for."""
    logger = logging.getLogger(name)
    if not any(isinstance(h.formatter, JsonFormatter) for h in logger.handlers):
        handler = logging.StreamHandler()
        handler.setFormatter(JsonFormatter())
        logger.addHandler(handler)
        logger.setLevel(logging.INFO)
        logger.propagate = False
    return logger
