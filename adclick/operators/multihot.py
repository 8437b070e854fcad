"""Vocabulary of array elements, index arrays and multi-hot columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from adclick.functions.constants import sql_constant
from adclick.operators.encoders import ValueEncoder, fit_dictionary
from adclick.operators.lookup import BROADCAST_BYTES, LITERAL_ENTRIES, ElementMap, lookup_elements
from adclick.sources.scratch import materialise


# Names that may be collected.
NAMES = 65_536


def fit_vocabulary(df: DataFrame, column: str) -> ValueEncoder:
    """Codes 1, 2, 3 … of the distinct non-null elements, in value order."""
    elements = df.select(F.explode(column).alias(column)).filter(F.col(column).isNotNull())
    return fit_dictionary(elements, [column])


def vocabulary_names(vocabulary: ValueEncoder, column: str, limit: int = NAMES) -> list[str]:
    """The names in code order, of a vocabulary of at most ``limit``; a longer
    one stays a table (``sparse_vectors``)."""
    values = vocabulary.stats[column].values
    if values > limit:
        raise ValueError(f"{values} names of {column!r} are too many for the driver; use sparse_vectors")
    return [r[0] for r in vocabulary.mapping_of(column).orderBy("code").select("value").collect()]


def element_indices(
    df: DataFrame,
    column: str,
    vocabulary: ValueEncoder,
    out: str,
    literal_entries: int = LITERAL_ENTRIES,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Fill ``out`` with the indices of the elements; unknown ones are 0."""
    mapping = vocabulary.mapping_of(column).withColumn("code", F.col("code").cast("bigint"))
    unknown = F.lit(0).cast("bigint")
    elements = ElementMap.of(mapping, literal_entries, vocabulary.stats[column].rows)
    return lookup_elements(df, column, elements, lambda _: unknown, out, broadcast_bytes)


def column_names(names: Sequence[str], prefix: str = "interest_") -> list[str]:
    """Safe, distinct column names: other characters become ``_``, and names
    that fall together are numbered in order."""
    taken: set[str] = set()
    safe = []
    for name in names:
        base = prefix + re.sub(r"[^0-9a-z]+", "_", name.lower())
        candidate, i = base, 2
        while candidate in taken:
            candidate, i = f"{base}_{i}", i + 1
        taken.add(candidate)
        safe.append(candidate)
    return safe


def multi_hot_columns(column: str, names: Sequence[str], prefix: str = "interest_") -> list[Column]:
    """One 0/1 int column per name; a null array holds none of them.

    The first column is tested with ``exists``, which keeps the projection out
    of whole-stage code: there, this many columns make one method too long for
    the JVM to compile, and every row is interpreted.
    """
    tests = [
        f"exists({column}, e -> e = {sql_constant(name)})" if i == 0 else f"array_contains({column}, {sql_constant(name)})"
        for i, name in enumerate(names)
    ]
    return [
        F.expr(f"int(coalesce({test}, false))").alias(safe)
        for test, safe in zip(tests, column_names(names, prefix), strict=True)
    ]


def multi_hot(
    df: DataFrame, column: str, names: Sequence[str], prefix: str = "interest_"
) -> DataFrame:
    return df.select("*", *multi_hot_columns(column, names, prefix))


def multi_hot_vector(df: DataFrame, column: str, names: Sequence[str], out: str) -> DataFrame:
    """The same flags as one sparse vector, for names that are collected."""
    if not names:
        raise ValueError("empty vocabulary")
    model = CountVectorizerModel.from_vocabulary(list(names), inputCol="__names", outputCol=out)
    held = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return model.setBinary(True).transform(df.withColumn("__names", held)).drop("__names")


_STORED = "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"


def sparse_vectors(
    df: DataFrame,
    column: str,
    vocabulary: ValueEncoder,
    out: str,
    flipped: Sequence[int] = (),
    literal_entries: int = LITERAL_ENTRIES,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The flags as one sparse vector, for a vocabulary of any length.

    Elements meet the vocabulary as ``element_indices`` does it, and a row's
    codes are put in order; no name reaches the driver. The flags of the codes in
    ``flipped`` (from 0) are turned round. A vector is stored as a struct; the
    rows are written as such and read as vectors.
    """
    size = vocabulary.stats[column].values
    if not size:
        raise ValueError("empty vocabulary")
    indexed = element_indices(df, column, vocabulary, "__indices", literal_entries, broadcast_bytes)
    none = F.array().cast("array<int>")
    known = F.filter(F.transform("__indices", lambda i: (i - 1).cast("int")), lambda i: i >= 0)
    held = F.coalesce(F.array_distinct(known), none)
    if flipped:
        turned = F.expr(f"array({', '.join(map(str, flipped))})")
        held = F.array_union(F.array_except(held, turned), F.array_except(turned, held))
    indices = F.array_sort(held)
    ones = F.transform(indices, lambda _: F.lit(1.0))
    vector = F.struct(F.lit(0).cast("tinyint"), F.lit(size), indices, ones).cast(_STORED)
    stored = indexed.withColumn(out, vector).drop("__indices")
    kinds = [f if f.name != out else StructField(out, VectorUDT()) for f in stored.schema.fields]
    return materialise(stored, "vectors", schema=StructType(kinds))
