"""The transactions model: columns, vocabularies and the check of a schema."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class SchemaValidationError(ValueError):
    """A table lacks a column or has one of another type."""


def raw_schema() -> T.StructType:
    """Transactions as they arrive: dates are text, numbers are doubles, everything may be null."""
    text, number = T.StringType(), T.DoubleType()
    return T.StructType(
        [
            T.StructField(name, kind)
            for name, kind in (
                ("transaction_id", text), ("customer_id", text), ("product_id", text), ("category", text), ("purchase_date", text), ("quantity", number),
                ("unit_price", number), ("total_amount", number), ("region", text), ("payment_method", text), ("customer_age", number), ("customer_segment", text),
            )
        ]
    )


COLUMNS = tuple(raw_schema().names)


@dataclass(frozen=True)
class Vocabulary:
    """Known spellings of the categorical columns."""

    category: tuple[str, ...] = ("PROMO", "ECONOMY", "STANDARD", "MEDIUM", "SMALL", "LARGE")
    region: tuple[str, ...] = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    payment_method: tuple[str, ...] = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    customer_segment: tuple[str, ...] = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a JSON file of lists by column; columns that it leaves out keep theirs."""
        found = json.loads(Path(path).read_text()) if path else {}
        unknown = set(found) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) for k, v in found.items()})


#: Region and territory, for every region of the data.
TERRITORIES = (("AFRICA", "Territory 1"), ("AMERICA", "Territory 1"), ("ASIA", "Territory 2"), ("EUROPE", "Territory 2"), ("MIDDLE EAST", "Territory 3"))


def validate_schema(df: DataFrame, expected: T.StructType) -> list[str]:
    """Names of extra columns. Raises where a column is missing or of another type; order and nullability are free."""
    found = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: missing" for f in expected if f.name not in found]
    wrong += [f"{f.name}: {found[f.name].simpleString()} instead of {f.dataType.simpleString()}" for f in expected if f.name in found and found[f.name] != f.dataType]
    if wrong:
        raise SchemaValidationError("; ".join(wrong))
    return sorted(set(found) - set(expected.names))
