"""Repeated lines: the first document that holds a line keeps it.

Nothing but DataFrame functions. A line's key is the line stripped of ASCII
white space with A-Z lower-cased; 128 bits of hash stand for it.

1. Lines are written down once as (hash, document, position): no text moves.
2. Hashes that hold a large share of all lines are found by a mergeable
   frequent-items sketch, which misses none above the share. There are at most
   ``1 / SHARE`` and a few more; the first document of each comes from a
   combined minimum, and their lines are answered from a broadcast.
3. All other lines are range-partitioned by hash and sorted within by document
   and position. The first row of a hash names the document that keeps the
   line; every row of another document is dropped. One pass, in order.
4. Dropped positions meet by document and become a run-length compressed
   bitmap: the runs of lines to keep. Documents that lose nothing have none.

``drop_lines`` applies the bitmaps to the text. Only there does text move.

Null text is the empty text, which is one empty line. A null id comes after all
others; rows with one id, null included, are one document, each with a bitmap
of its own. Repeated rows get equal results. Columns of the same names as the
results are replaced, others pass through.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adclick.sources.scratch import discard, materialise

LEAST = 10
# A hash with this share of all lines is hot.
SHARE = 1 / 512
# Items that the sketch of frequent hashes holds; it errs by 1.4 / TRACKED.
TRACKED = 16_384

_WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The fast way where a line is all ASCII, as other letters stay as they are."""
    own = F.btrim(line, F.lit(_WHITE))
    plain = F.octet_length(own) == F.length(own)
    return F.when(plain, F.lower(own)).otherwise(F.translate(own, ascii_uppercase, ascii_lowercase))


def _parts(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _row_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_table(df: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """(h1, h2, key, row, n, pos) of every line whose key is long enough."""
    parts = _parts(F.col(text))
    # keys are made before lines become rows: as columns of rows they would be
    # made again wherever they are used
    keys = F.posexplode(F.transform(parts, line_key)).alias("pos", "line")
    lines = df.select(F.col(key).alias("key"), _row_of(F.col(text)).alias("row"), F.size(parts).alias("n"), keys)
    lines = lines.where(F.length("line") >= least)
    return lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "key", "row", "n", "pos")


def frequent(lines: DataFrame, share: float = SHARE) -> list[int]:
    """The hashes that hold ``share`` of the lines or more, and perhaps a few
    with a little less."""
    most = int(2 / share)
    found = lines.agg(F.expr(f"approx_top_k(h1, {most}, {TRACKED})").alias("top"), F.count("*").alias("n")).first()
    return [r["item"] for r in found["top"] or [] if r["count"] >= share * found["n"]]


def dropped(lines: DataFrame, share: float = SHARE) -> DataFrame:
    """(key, row, n, pos) of the lines that an earlier document holds."""
    hot = frequent(lines, share)
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)
    order = [F.col("key").isNull(), "key", "row", "pos"]
    in_order = Window.partitionBy("h1", "h2").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = lines.where(~is_hot).repartitionByRange("h1", "h2")
    cold = ranged.withColumn("first", F.first("key").over(in_order))
    columns = ["key", "row", "n", "pos", "first"]
    heads = lines.where(is_hot).groupBy("h1", "h2").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key"))["key"].alias("first"))
    answered = lines.where(is_hot).join(F.broadcast(heads), ["h1", "h2"])
    both = cold.select(*columns).unionAll(answered.select(*columns))
    return both.where(~F.col("key").eqNullSafe(F.col("first"))).drop("first")


def keep_bitmaps(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(key, row, n_lines, n_dropped, keep) for each document that loses lines.

    ``row`` is a hash of the text, ``keep`` the ascending runs (first, length)
    of the lines that stay, counted from 0.
    """
    lines = materialise(line_table(df, key, text, least), "lines")
    gone = dropped(lines, share).groupBy("key", "row").agg(F.first("n").alias("n"), F.array_sort(F.collect_set("pos")).alias("gone"))
    before = F.concat(F.array(F.lit(-1)), "gone")
    after = F.concat("gone", F.array("n"))
    runs = F.zip_with(before, after, lambda a, b: F.struct((a + 1).alias("first"), (b - a - 1).alias("length")))
    bitmaps = gone.select(
        "key", "row", F.col("n").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
        F.filter(runs, lambda r: r["length"] > 0).alias("keep"),
    )
    bitmaps = materialise(bitmaps, "bitmaps")
    discard(lines)
    return bitmaps


def _kept_text(parts: Column, keep: Column, n: Column) -> Column:
    """The lines of the runs, joined; linear in the lines."""
    ends = F.transform(keep, lambda r: r["first"] + r["length"])
    before = F.concat(F.array(F.lit(0)), ends)
    gaps = F.zip_with(before, F.concat(F.transform(keep, lambda r: r["first"]), F.array(n)), lambda a, b: b - a)
    lengths = F.concat(F.transform(keep, lambda r: r["length"]), F.array(F.lit(0)))
    bits = F.flatten(
        F.zip_with(gaps, lengths, lambda g, k: F.concat(F.array_repeat(F.lit(False), g), F.array_repeat(F.lit(True), k)))
    )
    return F.array_join(F.zip_with(parts, bits, lambda line, bit: F.when(bit, line)), "\n")


def drop_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, share: float = SHARE) -> DataFrame:
    """``df`` with ``n_lines``, ``n_dropped``, ``keep`` and ``kept_text``."""
    added = ("n_lines", "n_dropped", "keep", "kept_text")
    df = df.drop(*added)
    bitmaps = keep_bitmaps(df, key, text, least, share)
    found = bitmaps.select(
        F.struct(F.col("key").alias("k"), F.col("row").alias("r")).alias("__of"),
        F.struct("n_lines", "n_dropped", "keep").alias("__found"),
    ).hint("merge")
    # structs, as names of theirs cannot meet the caller's; null ids are equal
    mine = F.struct(F.col(key).alias("k"), _row_of(F.col(text)).alias("r"))
    left = df.select(F.struct(*df.columns).alias("__row"), mine.alias("__mine"))
    joined = left.join(found, F.col("__mine") == F.col("__of"), "left")
    value = F.col("__row").getField(text)
    n = F.coalesce(F.col("__found.n_lines"), F.size(_parts(value)).cast("long"))
    whole = F.array(F.struct(F.lit(0).alias("first"), n.cast("int").alias("length")))
    kept = _kept_text(_parts(value), F.col("__found.keep"), F.col("__found.n_lines").cast("int"))
    return joined.select(
        *[F.col("__row").getField(c).alias(c) for c in df.columns],
        n.alias("n_lines"),
        F.coalesce(F.col("__found.n_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.col("__found.keep"), whole).alias("keep"),
        F.when(F.col("__found").isNull(), F.coalesce(value, F.lit(""))).otherwise(kept).alias("kept_text"),
    )
