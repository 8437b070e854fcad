"""Fixed schemas of the inputs; nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

BID_REQUEST = T.StructType(
    [
        T.StructField("appOrSite", T.StringType()),
        T.StructField("bidfloor", T.DoubleType()),
        T.StructField("city", T.StringType()),
        T.StructField("exchange", T.StringType()),
        T.StructField("impid", T.StringType()),
        T.StructField("interests", T.StringType()),
        T.StructField("label", T.BooleanType()),
        T.StructField("media", T.StringType()),
        T.StructField("network", T.StringType()),
        T.StructField("os", T.StringType()),
        T.StructField("publisher", T.StringType()),
        T.StructField("size", T.ArrayType(T.LongType())),
        T.StructField("timestamp", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("user", T.StringType()),
    ]
)

TAXONOMY = T.StructType(
    [
        T.StructField("Interest", T.StringType()),
        T.StructField("Description", T.StringType()),
    ]
)

# Columns the models never see (identifiers, the price floor and
# two columns left out after screening), besides the label itself.
MODEL_EXCLUDES = ("label", "impid", "bidfloor", "exchange", "publisher", "user", "request_key")


@dataclass(frozen=True)
class FeatureSpec:
    """The model's columns, in order. Saved with the model so that training
    and scoring cannot disagree about them."""

    columns: tuple[str, ...]
    label: str = "label"
    key: str = "request_key"

    @classmethod
    def excluding(
        cls,
        columns: Iterable[str],
        exclude: Iterable[str] = MODEL_EXCLUDES,
        label: str = "label",
        key: str = "request_key",
    ) -> FeatureSpec:
        skipped = {name.lower() for name in (*exclude, label, key)}
        return cls(tuple(c for c in columns if c.lower() not in skipped), label, key)

    def missing_from(self, df: DataFrame) -> list[str]:
        present = {name.lower() for name in df.columns}
        return [c for c in self.columns if c.lower() not in present]

    def check(self, df: DataFrame) -> None:
        missing = self.missing_from(df)
        if missing:
            raise ValueError(f"feature columns missing from the table: {missing}")

    def select(self, df: DataFrame) -> DataFrame:
        """Key, label (where the table has one) and the features, in order."""
        self.check(df)
        present = {name.lower() for name in df.columns}
        lead = [c for c in (self.key, self.label) if c.lower() in present]
        return df.select(*lead, *self.columns)

    @classmethod
    def from_dict(cls, raw: dict) -> FeatureSpec:
        return cls(tuple(raw["columns"]), raw["label"], raw["key"])
