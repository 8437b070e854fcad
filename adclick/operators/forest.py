"""Decision trees and random forests by weighted histograms, level by level.

All trees grow together. A row's weight in a tree is a Poisson(1) number that
follows from a hash of the row's key and the tree, and the features a node may
cut are drawn by a hash of the tree and the node, so the forest depends on the
rows and the seed alone, never on partitions, their order or retries.

1. The rows are written down once. Values are cut into bins: midpoints where a feature has few values, else
   quantiles, both from the rows with the least hashes (at most about
   ``CUT_ROWS``; a bounded sample is enough to place cuts). The binned rows are
   written down too.
2. Each level is one aggregation: weights by tree, node, feature, bin and class,
   combined in the tasks before the shuffle. The best cut of each node comes from
   running totals over its bins. A node with a gain becomes two.
3. What reaches the driver are the cuts: at most a row for each node of each
   tree, so their number is bounded by the settings.

Gain is the fall of the Gini impurity. Of equal gains the first feature wins,
then the lower cut. Weights are whole numbers, so sums do not depend on their
order. A node stops without a gain, at ``max_depth``, or with a side below
``min_rows``. Two leaves that predict the same class become one.

Null features go right, as NaN does. Rows without a label take no part. Rows
with a null key are told apart by a hash of all their columns. One class, or no
row, gives trees of a single leaf.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adclick.functions.constants import sql_array
from adclick.sources.scratch import discard, materialise

# Rows that places of cuts are taken from, about.
CUT_ROWS = 50_000
# A Poisson(1) number is at least k where a uniform one is at
# least the share of numbers below k.
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k)) for k in range(1, 9))
# Hexadecimal digits of a row's uniform number for one tree.
_DIGITS = 4
_PER_HASH = 32 // _DIGITS


@dataclass(frozen=True)
class Settings:
    trees: int = 64
    max_depth: int = 5
    max_bins: int = 32
    bootstrap: bool = True
    subset: str = "auto"
    min_rows: int = 1
    seed: int = 12345

    def features_of_node(self, tree: int, node: int, features: int) -> list[int]:
        """The features that a node may cut: all, or as many as the square root
        of their number (``auto`` with several trees), by least hash."""
        every = self.subset == "all" or (self.subset == "auto" and self.trees == 1)
        if every:
            return list(range(features))
        order = sorted(range(features), key=lambda f: hashlib.md5(f"{self.seed}:{tree}:{node}:{f}".encode()).hexdigest())
        return sorted(order[: math.ceil(math.sqrt(features))])


def bag_weights(key: Column, settings: Settings) -> Column:
    """The weights of a row in all trees, as an array."""
    if not settings.bootstrap:
        return F.array_repeat(F.lit(1), settings.trees)
    digests = [F.md5(F.concat(F.lit(f"bag{settings.seed}:{k}:"), key)) for k in range(-(-settings.trees // _PER_HASH))]
    wanted = [math.ceil(p * 16**_DIGITS) for p in POISSON]
    # a digest is bound to a variable, or each tree would hash the key again
    places = F.sequence(F.lit(0), F.lit(_PER_HASH - 1))
    numbers = F.flatten(F.transform(F.array(*digests), lambda d: F.transform(places, lambda i: F.conv(F.substr(d, i * _DIGITS + 1, F.lit(_DIGITS)), 16, 10).cast("int"))))
    each = F.slice(numbers, 1, settings.trees)
    return F.transform(each, lambda u: sum((F.when(u >= w, 1).otherwise(0) for w in wanted), F.lit(0)))


def place_cuts(rows: DataFrame, key: Column, features: Sequence[str], max_bins: int) -> list[list[float]]:
    """Ascending cuts of each feature, at most ``max_bins`` - 1."""
    total = rows.count()
    share = min(1.0, CUT_ROWS / max(total, 1))
    chosen = rows.where(F.conv(F.substring(F.md5(F.concat(F.lit("cut:"), key)), 1, 8), 16, 10).cast("long") < F.lit(int(share * 2**32)))
    long = chosen.select(*[F.col(f"`{f}`").cast("double").alias(str(i)) for i, f in enumerate(features)]).unpivot([], [str(i) for i in range(len(features))], "feature", "v")
    counts = long.where("v is not null and not isnan(v)").groupBy("feature", "v").agg(F.count("*").alias("n"))
    counts = counts.withColumn("feature", F.col("feature").cast("int"))
    by_value = Window.partitionBy("feature").orderBy("v")
    every = Window.partitionBy("feature")
    counts = counts.select(
        "feature", "v", F.lead("v").over(by_value).alias("after"), F.sum("n").over(by_value).alias("below"),
        F.sum("n").over(every).alias("all"), F.count("*").over(every).alias("values"), "n",
    )
    few = F.col("values") <= max_bins
    # a value ends a bin where the running share passes the next multiple of 1 / bins
    bin_of = lambda n: F.floor(n * max_bins / F.col("all"))
    ends = bin_of(F.col("below")) > bin_of(F.col("below") - F.col("n"))
    cuts = counts.where(F.col("after").isNotNull() & (few | ends)).select("feature", ((F.col("v") + F.col("after")) / 2).alias("cut")).collect()
    found: list[list[float]] = [[] for _ in features]
    for row in cuts:
        found[row["feature"]].append(row["cut"])
    return [sorted(x) for x in found]


def _bins(features: Sequence[str], cuts: list[list[float]]) -> Column:
    """The bin of each feature: how many cuts are below the value."""
    numbers = []
    for name, own in zip(features, cuts, strict=True):
        value = F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(float("nan")))
        # the value is named once, as it may be a long expression itself
        numbers.append((value > own[0]).cast("int") if len(own) == 1 else _count_below(own, value))
    return F.array(*numbers)


def _count_below(cuts: list[float], value: Column) -> Column:
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.expr(sql_array(cuts)), lambda c: c < value))


def _array(values: Sequence[int]) -> Column:
    return F.expr(f"array({', '.join(map(str, values))})")


def _walk(bins: Column, tree: Column, cut: dict[tuple[int, int], tuple[int, int]], places: dict[tuple[int, int], int], trees: int, steps: int) -> Column:
    """The place a row comes to in a tree, null where it stopped earlier. ``cut``
    names the feature and the last bin that goes left of (tree, node), ``places``
    numbers the nodes. The steps are a loop over flat lists: a step written out
    holds the one before it several times, so plans grew by a power of the depth."""
    if not steps:
        return F.get(_array([places.get((t, 1), -1) for t in range(trees)]), tree)
    feature, last, left, right = ([-1] * len(places) for _ in range(4))
    for (t, n), (f, b) in cut.items():
        at = places[t, n]
        feature[at], last[at], left[at], right[at] = f, b, places.get((t, 2 * n), -1), places.get((t, 2 * n + 1), -1)

    def step(at: Column, _: Column) -> Column:
        goes_right = F.get(bins, F.get(_array(feature), at)) > F.get(_array(last), at)
        # past the end of a path there is no such place: null, and it stays so
        return F.when(goes_right, F.get(_array(right), at)).otherwise(F.get(_array(left), at))

    root = F.get(_array([places.get((t, 1), -1) for t in range(trees)]), tree)
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), root, step)
    return F.when(end >= 0, end)


@dataclass(frozen=True)
class Forest:
    """Fitted trees as rows (tree, node, feature, cut, gain, counts, leaf):
    nodes by heap number, the root being 1; ``feature`` and ``cut`` are null in
    a leaf; a value up to the cut goes to node 2n, another to 2n + 1."""

    features: tuple[str, ...]
    classes: tuple[float, ...]
    nodes: tuple[tuple, ...]

    def table(self, spark) -> DataFrame:
        """The nodes with the shares of classes, for SQL."""
        rows = []
        for tree, node, feature, cut, gain, counts, leaf in self.nodes:
            name = None if feature is None else self.features[feature]
            rows.append((tree, node, name, cut, gain, float(sum(counts)), [float(c) for c in counts], leaf))
        return spark.createDataFrame(rows, "tree int, node int, feature string, cut double, gain double, n double, counts array<double>, leaf boolean")

    def probabilities(self) -> Column:
        """The mean of the leaves' class shares over all trees, as an array; one
        expression over the feature columns. Rounded to 12 digits, so that sums in
        another order are equal."""
        by = {(n[0], n[1]): n for n in self.nodes}
        depth = max(n[1].bit_length() for n in self.nodes)
        # nodes of all trees in one list, so that a step is a few look-ups
        number = {place: i for i, place in enumerate(by)}
        feature = [-1 if n[6] else n[2] for n in by.values()]
        cut = [0.0 if n[6] else n[3] for n in by.values()]
        left = [i if n[6] else number[n[0], 2 * n[1]] for i, n in enumerate(by.values())]
        right = [i if n[6] else number[n[0], 2 * n[1] + 1] for i, n in enumerate(by.values())]
        roots = [i for place, i in number.items() if place[1] == 1]
        shares = [[c / max(sum(n[5]), 1e-300) for c in n[5]] for n in by.values()]
        listed = F.expr(f"array({', '.join(sql_array([float(x) for x in s]) for s in shares)})")
        values = F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float("nan"))) for f in self.features])

        def step(node: Column, x: Column) -> Column:
            own = F.get(_array(feature), node)
            goes_right = F.get(x, F.greatest(own, F.lit(0))) > F.get(F.expr(sql_array(cut)), node)
            return F.when((own >= 0) & goes_right, F.get(_array(right), node)).otherwise(F.get(_array(left), node))

        def mean(x: Column) -> Column:
            steps = F.sequence(F.lit(1), F.lit(max(depth - 1, 1)))
            leaves = F.transform(_array(roots), lambda root: F.aggregate(steps, root, lambda node, _: step(node, x)))
            total = F.aggregate(
                leaves, F.expr(sql_array([0.0] * len(self.classes))),
                lambda held, leaf: F.zip_with(held, F.get(listed, leaf), lambda a, b: a + b),
            )
            return F.transform(total, lambda t: F.round(t / len(roots), 12))

        # the values are bound to a variable, or each step would put them together again
        return F.get(F.transform(F.array(values), mean), 0)

    def transform(self, df: DataFrame, out: str = "shares") -> DataFrame:
        """``df`` with the class shares (``out``, an array in the order of
        ``classes``) and ``prediction``, the first class with the largest share."""
        best = F.array_position(F.col(out), F.array_max(out)).cast("int") - 1
        classes = F.expr(sql_array([float(c) for c in self.classes]))
        return df.withColumn(out, self.probabilities()).withColumn("prediction", F.get(classes, best))


def fit_forest(df: DataFrame, key: str, label: str, features: Sequence[str], settings: Settings) -> Forest:
    """Grow all trees together on the rows of ``df`` that have a label, one of
    the whole numbers from 0; the classes go up to the largest."""
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])))
    number = F.col(f"`{label}`").cast("double")
    # Written down, in even parts: what comes before is computed once, few or
    # uneven input files keep no core idle, and a filter on the key, which may
    # name every column, does not meet the expressions behind them (the optimizer
    # would put each in place of its name in every combination).
    own = [f"f{i}" for i in range(len(features))]
    values = [F.col(f"`{f}`").cast("double").alias(n) for f, n in zip(features, own, strict=True)]
    rows = df.where(F.col(f"`{label}`").isNotNull()).select(*values, number.alias("class"), name.alias("key"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(rows.repartition(parts), "rows")
    odd = F.count(F.when((F.col("class") < 0) | (F.col("class") != F.floor("class")), 1))
    most, wrong = rows.agg(F.max("class"), odd).first()
    if wrong:
        discard(rows)
        raise ValueError(f"{wrong} labels are not whole numbers from 0")
    classes = tuple(float(k) for k in range(int(most) + 1)) if most is not None else ()
    cuts = place_cuts(rows, F.col("key"), own, settings.max_bins)
    binned = rows.select(F.col("class").cast("int").alias("class"), _bins(own, cuts).alias("bins"), bag_weights(F.col("key"), settings).alias("weights"))
    if not settings.bootstrap:  # equal rows are one
        binned = binned.groupBy("class", "bins").agg(F.count("*").alias("rows"), F.first("weights").alias("weights"))
        binned = binned.withColumn("weights", F.transform("weights", lambda w: w * F.col("rows"))).drop("rows")
    binned = materialise(binned, "binned")
    discard(rows)
    weighed = F.transform("weights", lambda w, t: F.struct(t.alias("tree"), w.alias("w")))
    in_bags = F.filter(weighed, lambda x: x["w"] > 0)

    sums = [F.sum(F.when(F.col("class") == k, F.col("w")).otherwise(0)).cast("double").alias(f"c{k}") for k in range(len(classes))]
    names = [f"c{k}" for k in range(len(classes))]
    nodes: dict[tuple[int, int], tuple] = {}
    of_trees = binned.select("class", F.explode(in_bags).alias("x")).select("class", "x.tree", "x.w")
    roots = {r["tree"]: [r[c] for c in names] for r in of_trees.groupBy("tree").agg(*sums).collect()} if classes else {}
    for tree in range(settings.trees):
        nodes[tree, 1] = (None, None, 0.0, roots.get(tree, [0.0] * max(len(classes), 1)))
    cut_at: dict[tuple[int, int], tuple[int, int]] = {}
    for depth in range(settings.max_depth if len(classes) > 1 and any(cuts) else 0):
        at_level = 1 << depth
        open_nodes = [p for p in nodes if p[1] >= at_level and p[1] < 2 * at_level]
        places = {p: i for i, p in enumerate([*open_nodes, *cut_at])}
        # found before the rows of trees are told apart, so it is not computed again by what reads it
        at = lambda x: _walk(F.col("bins"), x["tree"], cut_at, places, settings.trees, depth)  # noqa: B023, E731
        reached = F.filter(F.transform(in_bags, lambda x: F.struct(at(x).alias("place"), x["w"].alias("w"))), lambda x: x["place"].isNotNull())
        state = binned.select("class", "bins", F.explode(reached).alias("x")).select("class", "bins", "x.place", "x.w")
        chosen = {}
        for r in _best_cuts(state, open_nodes, settings, [len(c) for c in cuts], sums, names):
            place, left = open_nodes[r["place"]], [r[f"l{k}"] for k in range(len(classes))]
            whole = nodes[place][3]
            chosen[place] = (r["feature"], r["bin"])
            nodes[place] = (r["feature"], cuts[r["feature"]][r["bin"]], r["gain"], whole)
            nodes[place[0], 2 * place[1]] = (None, None, 0.0, left)
            nodes[place[0], 2 * place[1] + 1] = (None, None, 0.0, [a - b for a, b in zip(whole, left, strict=True)])
        if not chosen:
            break
        cut_at |= chosen
    discard(binned)
    return Forest(tuple(features), classes or (0.0,), _pruned(nodes))


def _best_cuts(state: DataFrame, open_nodes: list, settings: Settings, cuts: list[int], sums: list[Column], names: list[str]) -> list:
    """(place, feature, bin, gain, l0, l1, …): the cut of each of the open nodes that
    has one, ``place`` being its number; one aggregation over the rows, the rest
    over its bins."""
    drawn = [[f for f in settings.features_of_node(tree, node, len(cuts)) if cuts[f]] for tree, node in open_nodes]
    if not any(drawn):
        return []
    if all(d == drawn[0] for d in drawn):
        of_node = _array(drawn[0])
    else:
        listed = ", ".join(f"array({', '.join(map(str, d))})" if d else "cast(array() as array<int>)" for d in drawn)
        of_node = F.get(F.expr(f"array({listed})"), F.col("place"))
    long = state.select("place", "class", "w", F.explode(F.transform(of_node, lambda f: F.struct(f.alias("feature"), F.get(F.col("bins"), f).alias("bin")))).alias("x"))
    hist = long.select("place", "class", "w", "x.*").groupBy("place", "feature", "bin").agg(*sums)
    by_bin = Window.partitionBy("place", "feature").orderBy("bin")
    whole = Window.partitionBy("place", "feature")
    hist = hist.select(
        "place", "feature", "bin", F.lead("bin").over(by_bin).isNotNull().alias("inner"),
        *[F.sum(c).over(by_bin).alias(f"l{k}") for k, c in enumerate(names)],
        *[F.sum(c).over(whole).alias(f"a{k}") for k, c in enumerate(names)],
    )
    left = sum((F.col(f"l{k}") for k in range(1, len(names))), F.col("l0"))
    all_ = sum((F.col(f"a{k}") for k in range(1, len(names))), F.col("a0"))

    def purity(columns: list[Column], n: Column) -> Column:
        return sum((c * c for c in columns[1:]), columns[0] * columns[0]) / n

    lefts, wholes = ([F.col(f"{s}{k}") for k in range(len(names))] for s in "la")
    rights = [a - b for a, b in zip(wholes, lefts, strict=True)]
    hist = hist.where("inner").withColumn("n", left).withColumn("m", all_)
    hist = hist.where((F.col("n") >= settings.min_rows) & (F.col("m") - F.col("n") >= settings.min_rows))
    gain = (purity(lefts, F.col("n")) + purity(rights, F.col("m") - F.col("n")) - purity(wholes, F.col("m"))) / F.col("m")
    hist = hist.withColumn("gain", F.round(gain, 12)).where("gain > 0")
    best = F.max_by(F.struct("feature", "bin", "gain", *[f"l{k}" for k in range(len(names))]), F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("b")
    return hist.groupBy("place").agg(best).select("place", "b.*").collect()


def _pruned(nodes: dict[tuple[int, int], tuple]) -> tuple[tuple, ...]:
    """Nodes in order; two leaves that predict the same class are given up."""
    kept = dict(nodes)
    leaf = {p: v[0] is None for p, v in nodes.items()}
    best = {p: max(range(len(v[3])), key=lambda k, v=v: (v[3][k], -k)) for p, v in nodes.items()}
    for place in sorted(nodes, key=lambda p: -p[1]):
        if leaf[place]:
            continue
        sides = [(place[0], 2 * place[1] + s) for s in (0, 1)]
        if all(leaf[s] for s in sides) and best[sides[0]] == best[sides[1]]:
            leaf[place] = True
            for s in sides:
                del kept[s]
    rows = []
    for (tree, node), (feature, cut, gain, counts) in sorted(kept.items()):
        end = leaf[tree, node]
        rows.append((tree, node, None if end else feature, None if end else cut, 0.0 if end else gain, tuple(counts), end))
    return tuple(rows)
