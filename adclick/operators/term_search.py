"""Terms in texts, for term tables of any length, as a join.

A term can only be in a text that has all its grams (runs of ``GRAM``
characters; a shorter term is its own gram). So

1. the grams of the terms are counted over the texts, each once a text; a term
   with a gram that no text has is dropped, and the rarest gram of every other
   term is its anchor;
2. the distinct grams of each text meet the anchors in a join, which gives every
   text the few terms it may hold;
3. each such term is looked for in the whole text.

Neither terms nor texts pass through the driver. A term table or an anchor table
is broadcast up to its measured size only; beyond it the join is by shuffle,
where the grams that many texts have, which are known by their counts, are
spread over ``SALTS`` places. Texts move once, to meet their terms, and only
those that have any.

Null terms and null categories are left out; an empty term is in every text.
A null text has no term. Repeated terms count once in each of their categories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adclick.operators.lookup import BROADCAST_BYTES, HOT_SHARE
from adclick.sources.scratch import discard, materialise

GRAM = 4
SALTS = 32


def _grams(text: Column, lengths: list[int]) -> Column:
    """The distinct runs of these lengths, in one pass each."""
    runs = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]
    return F.array_distinct(F.concat(*runs) if len(runs) > 1 else runs[0])


def _bytes(table: DataFrame, columns: list[str]) -> int:
    size = sum((F.octet_length(c) for c in columns), F.lit(64))
    return int(table.agg(F.sum(size.cast("long"))).first()[0] or 0)


def _meet(grams: DataFrame, side: DataFrame, size: int, broadcast_bytes: int) -> DataFrame:
    """Join (row, gram) to a table with ``gram`` and ``hot``."""
    if size <= broadcast_bytes:
        return grams.join(F.broadcast(side), "gram")
    # a gram that is hot on one side has all its places on the other
    hot = F.broadcast(side.where("hot").select("gram", F.lit(True).alias("spread")).distinct())
    left = grams.join(hot, "gram", "left").withColumn("place", F.when(F.col("spread"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).otherwise(0))
    places = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = side.withColumn("place", F.explode(places))
    return left.drop("spread").join(right, ["gram", "place"]).drop("place")


def term_masks(terms: DataFrame) -> DataFrame:
    """(term, mask) of a table (category, term): bit k for category k, 0 to 62."""
    known = terms.where("term is not null and category between 0 and 62")
    return known.groupBy("term").agg(F.bit_or(F.expr("shiftleft(1L, int(category))")).alias("mask"))


def categories_of_terms(
    texts: DataFrame, row: str, text: str, terms: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(row, found) for the rows of ``texts`` that hold a term: bit k of
    ``found`` is set for a term of category k in the table (category, term).
    ``row`` tells the rows apart, so ``texts`` should be a written table."""
    masks = materialise(term_masks(terms).withColumn("size", F.least(F.length("term"), F.lit(GRAM))), "terms")
    lengths = sorted(r["size"] for r in masks.select("size").distinct().collect() if r["size"])
    rows = texts.select(F.col(row).alias("row"), F.col(text).alias("text")).where("text is not null")
    empty = masks.where("size = 0").first()  # at most one, as terms are distinct
    everywhere = rows.where(F.lit(empty is not None)).select("row", F.lit(empty["mask"] if empty else 0).cast("long").alias("found"))
    if not lengths:
        return everywhere
    in_terms = masks.where("size > 0").select("term", "mask", F.explode(_grams(F.col("term"), lengths)).alias("gram"), "size")
    # a term is found by grams of its own size
    in_terms = materialise(in_terms.where(F.length("gram") == F.col("size")).drop("size"), "grams")
    in_texts = rows.select("row", F.explode(_grams(F.col("text"), lengths)).alias("gram"))

    wanted = in_terms.select("gram", F.lit(False).alias("hot")).distinct()
    # the texts are cut into grams once; what is read again are those of some term
    shared = materialise(_meet(in_texts, wanted, _bytes(wanted, ["gram"]), broadcast_bytes).select("row", "gram"), "shared")
    counts = materialise(shared.groupBy("gram").agg(F.count("*").alias("n")), "counts")
    n_rows = rows.count()
    rarest = in_terms.join(counts, "gram", "left").groupBy("term", "mask").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("anchor")
    )
    hot = (F.col("anchor.n") >= F.lit(max(2.0, HOT_SHARE * n_rows))).alias("hot")
    anchors = rarest.where("anchor.n > 0").select("term", "mask", F.col("anchor.gram").alias("gram"), hot)
    anchors = materialise(anchors, "anchors")
    met = _meet(shared, anchors, _bytes(anchors, ["term", "gram"]), broadcast_bytes)
    candidates = met.groupBy("row").agg(F.collect_list(F.struct("term", "mask")).alias("terms"))
    held = rows.join(candidates, "row").select(
        "row",
        F.aggregate(
            "terms",
            F.lit(0).cast("long"),
            lambda found, t: F.when(F.contains(F.col("text"), t["term"]), found.bitwiseOR(t["mask"])).otherwise(found),
        ).alias("found"),
    )
    found = held.unionAll(everywhere).groupBy("row").agg(F.bit_or("found").alias("found"))
    found = materialise(found.where("found <> 0"), "found")
    discard(masks, in_terms, shared, counts, anchors)
    return found
