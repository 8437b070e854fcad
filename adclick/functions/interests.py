"""Interest tagging: 26 category flags and taxonomy names.

The taxonomy (code, name) is an input, read with ``sources.readers``; the
category terms follow from it by rule, so no keyword list is kept here.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adclick.functions.constants import constant_lookup, sql_array
from adclick.operators.lookup import BROADCAST_BYTES
from adclick.operators.term_search import categories_of_terms
from adclick.sources.scratch import materialise

CATEGORIES = range(1, 27)

# Top-level names of the public IAB content taxonomy.
TOP_LEVEL = (
    ("IAB1", "Arts & Entertainment"),
    ("IAB2", "Automotive"),
    ("IAB3", "Business"),
    ("IAB4", "Careers"),
    ("IAB5", "Education"),
    ("IAB6", "Family & Parenting"),
    ("IAB7", "Health & Fitness"),
    ("IAB8", "Food & Drink"),
    ("IAB9", "Hobbies & Interests"),
    ("IAB10", "Home & Garden"),
    ("IAB11", "Law & Government & Politics"),
    ("IAB12", "News"),
    ("IAB13", "Personal Finance"),
    ("IAB14", "Society"),
    ("IAB15", "Science"),
    ("IAB16", "Pets"),
    ("IAB17", "Sports"),
    ("IAB18", "Style & Fashion"),
    ("IAB19", "Technology & Computing"),
    ("IAB20", "Travel"),
    ("IAB21", "Real Estate"),
    ("IAB22", "Shopping"),
    ("IAB23", "Religion & Spirituality"),
    ("IAB24", "Uncategorized"),
    ("IAB25", "Non-Standard Content"),
    ("IAB26", "Illegal Content"),
)

# Names whose category is searched by these words instead.
HEAD_WORDS = {
    "arts & entertainment": ("arts", "entertainment"),
    "books & literature": ("books", "literature"),
    "family & parenting": ("family", "parenting"),
    "health & fitness": ("health", "fitness"),
    "food & drink": ("food", "drink"),
    "hobbies & interests": ("hobbies", "interest"),
    "home & garden": ("home", "garden"),
    "law & government & politics": ("law", "politics"),
    "pets": ("pet",),
    "sports": ("sport",),
    "style & fashion": ("style", "fashion"),
    "technology & computing": ("technology", "computing"),
    "religion & spirituality": ("religion", "spirituality"),
}

Terms = Mapping[int, Sequence[str]]


def category_of(code: str) -> int | None:
    """``IAB7-3`` -> 7; None for anything that is not such a code."""
    head = code.removeprefix("IAB").partition("-")[0]
    if not code.startswith("IAB") or not head.isdigit() or int(head) not in CATEGORIES:
        return None
    return int(head)


def category_terms(taxonomy: Iterable[tuple[str, str]]) -> dict[int, list[str]]:
    """Terms of each category: its code, then its names in lower case, with
    the head words in place of compound names."""
    terms: dict[int, dict[str, None]] = {k: {f"iab{k}": None} for k in CATEGORIES}
    for code, name in taxonomy:
        category = category_of(code)
        if category is not None:
            for term in HEAD_WORDS.get(name.lower(), (name.lower(),)):
                terms[category][term] = None
    return {k: list(found) for k, found in terms.items()}


def category_term_table(taxonomy: DataFrame) -> DataFrame:
    """``category_terms`` as a table (category, term), for a taxonomy of any length."""
    spark = taxonomy.sparkSession
    code, name = (F.col(c) for c in taxonomy.columns[:2])
    head = F.regexp_extract(code, r"^IAB([0-9]+)(?=-|\z)", 1).try_cast("int").alias("category")
    rows = taxonomy.select(head, F.lower(name).alias("name")).where(F.col("category").between(CATEGORIES[0], CATEGORIES[-1]))
    # fixed words, a handful
    heads = spark.createDataFrame([(n, w) for n, words in HEAD_WORDS.items() for w in words], "name string, word string")
    terms = rows.join(F.broadcast(heads), "name", "left").select("category", F.coalesce("word", "name").alias("term"))
    codes = spark.createDataFrame([(k, f"iab{k}") for k in CATEGORIES], "category int, term string")
    return terms.unionAll(codes).where("term is not null").distinct()


def taxonomy_rows(taxonomy: DataFrame, limit: int = 50_000) -> list[tuple[str, str]]:
    """The taxonomy as configuration. It becomes part of the plan's text, so a
    table larger than ``limit`` is refused rather than pulled to the driver;
    ``category_term_table`` takes one of any length."""
    rows = taxonomy.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"taxonomy exceeds {limit} rows; search its category_term_table instead")
    return [(row[0], row[1]) for row in rows]


def _prefix_tree(terms: Iterable[str]) -> str:
    """A pattern for the longest term at a place: common beginnings are shared,
    so a search tries each character of the text against one branch."""
    tree: dict = {}
    for term in terms:
        node = tree
        for char in term:
            node = node.setdefault(char, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = [_quoted(char) + pattern(below) for char, below in sorted(node.items()) if char]
        if not branches:
            return ""
        inner = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return f"{inner}?" if "" in node else inner

    return pattern(tree)


def _quoted(char: str) -> str:
    return char if char.isalnum() else f"\\x{{{ord(char):x}}}"


def categories_found(text: Column, terms: Terms) -> Column:
    """Bit k is set where a term of category k occurs in the text.

    One search finds the longest term at every place; each distinct hit stands
    for all terms it begins with, and their categories are joined. So the cost
    does not grow with the number of terms. Null text has no hit.
    """
    masks: dict[str, int] = {}
    for category, listed in terms.items():
        for term in listed:
            masks[term] = masks.get(term, 0) | 1 << category
    always = masks.pop("", 0)  # an empty term is in every text
    if not masks:
        return F.when(text.isNotNull(), F.lit(always)).otherwise(F.lit(0)).cast("bigint")
    within = {}
    for term in masks:
        within[term] = 0
        for end in range(1, len(term) + 1):
            within[term] |= masks.get(term[:end], 0)
    hits = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({_prefix_tree(masks)}))"), F.lit(1)))
    each = F.transform(hits, constant_lookup(list(within), list(within.values())))
    found = F.aggregate(each, F.lit(always).cast("bigint"), lambda held, bit: held.bitwiseOR(bit))
    return F.coalesce(found, F.lit(0).cast("bigint"))


def any_token(tokens: str, category: int, terms: Sequence[str]) -> Column:
    """True where a token is the category's code, lies below it, or is a term."""
    listed = f"arrays_overlap({tokens}, {sql_array(terms)})"
    below = f"exists({tokens}, token -> startswith(token, 'iab{category}-'))"
    return F.expr(f"{listed} or {below}")


def interest_text(interests: Column) -> Column:
    """Lower-case text searched by the substring mode; null reads ``[null]``."""
    return F.lower(F.concat(F.lit("["), F.coalesce(interests, F.lit("null")), F.lit("]")))


def interest_tokens(interests: Column) -> Column:
    """Trimmed lower-case tokens; no tokens for null."""
    parts = F.split(F.coalesce(F.lower(interests), F.lit("")), ",")
    return F.transform(parts, lambda part: F.trim(part))


def split_interests(interests: Column) -> Column:
    """Comma-separated parts as they are: untrimmed, empty parts kept."""
    return F.split(interests, ",")


def has_code(part: Column) -> Column:
    return part.startswith("IAB")


def tag_by_table(df: DataFrame, column: str, terms: DataFrame, prefix: str = "i", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``tag`` in substring mode with a table (category, term) of any length.

    The rows are numbered and written down, as their own keys may be null or
    repeated; what is found comes back by that number. They are written in even
    parts, so that a few large input files do not make a few long tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__searched", interest_text(F.col(column)))
    numbered = materialise(numbered.repartition(parts), "numbered")
    found = categories_of_terms(numbered, "__row", "__searched", terms, broadcast_bytes)
    joined = numbered.join(found.select(F.col("row").alias("__row"), F.col("found").alias("__found")), "__row", "left")
    held = F.coalesce(F.col("__found"), F.lit(0).cast("long"))
    flags = [(held.bitwiseAND(F.lit(1 << k)) != 0).cast("double").alias(f"{prefix}{k}") for k in CATEGORIES]
    return joined.select(*df.columns, *flags)


def tag(
    df: DataFrame, column: str, terms: Terms | DataFrame, mode: str = "substring", prefix: str = "i"
) -> DataFrame:
    """Append one 0/1 double per category.

    ``substring`` searches the whole text for the terms (``iab1`` is also found
    in ``IAB10``); ``token`` compares whole comma-separated tokens. The searched
    form is computed once per row, in the projection below the flags. Terms
    given as a table are searched by a join, in substring mode.
    """
    if isinstance(terms, DataFrame):
        if mode != "substring":
            raise ValueError("a table of terms is searched in substring mode")
        return tag_by_table(df, column, terms, prefix)
    if mode == "substring":
        held = categories_found(interest_text(F.col(column)), terms)
        test = lambda k: F.col("__searched").bitwiseAND(F.lit(1 << k)) != 0
    elif mode == "token":
        held, test = interest_tokens(F.col(column)), lambda k: any_token("__searched", k, terms[k])
    else:
        raise ValueError(f"unknown mode {mode!r}")
    flags = [test(k).cast("double").alias(f"{prefix}{k}") for k in sorted(terms)]
    return df.withColumn("__searched", held).select("*", *flags).drop("__searched")
