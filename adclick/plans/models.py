"""Classifiers: training, scoring, saving, parameters as tables.

A saved model is a folder with the fitted model and the feature spec it was
trained on: a ``PipelineModel`` for naive Bayes and logistic regression, a table
of nodes for forests and trees (``operators.forest``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adclick.functions.features import predicted_click
from adclick.operators.forest import Forest, Settings, fit_forest
from adclick.sources.schema import FeatureSpec
from adclick.sources.settings import read_json, write_json

KINDS = ("nb", "lr", "rf", "dt")
TREES = ("rf", "dt")


# The settings the job has always used.
SETTINGS = {
    "nb": {"smoothing": 1.0, "modelType": "multinomial"},
    "lr": {"maxIter": 1000, "regParam": 0.3},
    "rf": {"numTrees": 64, "featureSubsetStrategy": "auto"},
    "dt": {},
}
_CLASSIFIERS = {"nb": NaiveBayes, "lr": LogisticRegression}
# Names of settings in ``pyspark.ml`` and here.
_TREE_SETTINGS = {
    "numTrees": "trees", "maxDepth": "max_depth", "maxBins": "max_bins", "bootstrap": "bootstrap",
    "featureSubsetStrategy": "subset", "minInstancesPerNode": "min_rows",
}


def classifier(kind: str, label: str = "label", **settings):
    """Naive Bayes or logistic regression; ``settings`` of ``pyspark.ml`` go
    before the usual ones."""
    return _CLASSIFIERS[kind](featuresCol="features", labelCol=label, **SETTINGS[kind] | settings)


def tree_settings(kind: str, seed: int, **settings) -> Settings:
    """A forest's settings by their names in ``pyspark.ml``; a decision tree is
    one tree on all rows and features."""
    one = {"numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "all"} if kind == "dt" else {}
    named = {_TREE_SETTINGS[k]: v for k, v in (SETTINGS[kind] | one | settings).items()}
    return Settings(seed=seed, **named)


@dataclass(frozen=True)
class ForestModel:
    """A fitted forest in the place of a ``PipelineModel``. ``hot`` names the
    coded columns that went in as flags, with their largest code."""

    forest: Forest
    hot: dict[str, int]

    @property
    def stages(self) -> list:
        return [self]

    @property
    def getNumTrees(self) -> int:  # noqa: N802
        return len({node[0] for node in self.forest.nodes})

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` and ``prediction``."""
        flags = {name: x for c, most in self.hot.items() for name, x in _flags(c, most).items()}
        wide = df.withColumns(flags) if flags else df
        scored = self.forest.transform(wide, "probability").drop(*flags)
        return scored.withColumn("probability", array_to_vector("probability"))


def _flags(column: str, most: int) -> dict[str, Column]:
    """A flag for each code up to ``most``, and one for all others."""
    value = F.col(f"`{column}`")
    flags = {f"{column}__hot{k}": F.coalesce(value == k, F.lit(False)).cast("double") for k in range(most + 1)}
    return flags | {f"{column}__hot{most + 1}": F.coalesce(~value.between(0, most), F.lit(True)).cast("double")}


def _fit_trees(rows: DataFrame, spec: FeatureSpec, settings: Settings, one_hot: Sequence[str]) -> ForestModel:
    columns = [c for c in spec.columns if c in one_hot]
    largest = rows.agg(*[F.max(f"`{c}`").alias(c) for c in columns]).first() if columns else {}
    hot = {c: int(largest[c] or 0) for c in columns}
    flags = {c: _flags(c, most) for c, most in hot.items()}
    names = [n for c in spec.columns for n in flags.get(c, [c])]
    wide = rows.withColumns({n: x for own in flags.values() for n, x in own.items()}) if flags else rows
    return ForestModel(fit_forest(wide, spec.key, spec.label, names, settings), hot)


def assemble(df: DataFrame, spec: FeatureSpec, invalid: str = "error") -> DataFrame:
    """Append ``features``. A null feature fails, or is NaN with ``keep``."""
    spec.check(df)
    return VectorAssembler(
        inputCols=list(spec.columns), outputCol="features", handleInvalid=invalid
    ).transform(df)


def vector_stages(spec: FeatureSpec, one_hot: Sequence[str] = ()) -> list:
    """From the columns to ``features``; codes not seen in the fit have a flag
    of their own, the last."""
    names = [f"{c}__hot" if c in one_hot else c for c in spec.columns]
    hot = [c for c in spec.columns if c in one_hot]
    encoders = []
    if hot:
        outputs = [f"{c}__hot" for c in hot]
        encoders = [OneHotEncoder(inputCols=hot, outputCols=outputs, dropLast=False, handleInvalid="keep")]
    return [*encoders, VectorAssembler(inputCols=names, outputCol="features")]


def fit_model(
    train: DataFrame,
    spec: FeatureSpec,
    kind: str,
    seed: int = 12345,
    one_hot: Sequence[str] = (),
    **settings,
) -> PipelineModel | ForestModel:
    """Fit on the rows of ``train``. Logistic regression holds them while it
    iterates and forests write them down, binned, so the work upstream is done
    once; naive Bayes reads them once anyway. Every model is the same however the
    rows were partitioned, up to rounding. Coded columns named in ``one_hot`` go
    in as one flag for each code, not as magnitudes."""
    if kind not in KINDS:
        raise ValueError(f"unknown model kind {kind!r}; one of {KINDS}")
    rows = spec.select(train)
    if kind in TREES:
        return _fit_trees(rows, spec, tree_settings(kind, seed, **settings), one_hot)
    stages = [*vector_stages(spec, one_hot), classifier(kind, spec.label, **settings)]
    if kind == "nb":
        return Pipeline(stages=stages).fit(rows)
    held = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Pipeline(stages=stages).fit(held)
    finally:
        held.unpersist()


def score(model: PipelineModel | ForestModel, df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """``df`` with the model's columns; every input column stays on its row."""
    spec.check(df)
    return model.transform(df)


def attach_predictions(scored: DataFrame, columns: list[str]) -> DataFrame:
    """``label`` as predicted, then the given original columns."""
    kept = [c for c in columns if c.lower() not in ("label", "size")]
    return scored.select(predicted_click(F.col("prediction")).alias("label"), *kept)


def save_model(model: PipelineModel | ForestModel, spec: FeatureSpec, path: str) -> None:
    spark = SparkSession.active()
    if isinstance(model, ForestModel):
        forest = model.forest
        rows = [(t, n, f, c, g, list(k), e) for t, n, f, c, g, k, e in forest.nodes]
        spark.createDataFrame(rows, _NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/forest")
    else:
        model.write().overwrite().save(f"{path}/pipeline")
    trees = {"features": forest.features, "classes": forest.classes, "hot": model.hot} if isinstance(model, ForestModel) else None
    write_json(spark, asdict(spec) | {"trees": trees}, f"{path}/spec")


_NODES = "tree int, node int, feature int, cut double, gain double, counts array<double>, leaf boolean"


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel | ForestModel, FeatureSpec]:
    """The model, set to score rows with null features for naive Bayes and the
    trees (as NaN), and to refuse them for logistic regression."""
    raw = read_json(spark, f"{path}/spec")
    spec, trees = FeatureSpec.from_dict(raw), raw.get("trees")
    if trees is not None:
        rows = spark.read.parquet(f"{path}/forest").orderBy("tree", "node").collect()
        nodes = tuple((r["tree"], r["node"], r["feature"], r["cut"], r["gain"], tuple(r["counts"]), r["leaf"]) for r in rows)
        return ForestModel(Forest(tuple(trees["features"]), tuple(trees["classes"]), nodes), trees["hot"]), spec
    model = PipelineModel.load(f"{path}/pipeline")
    if "LogisticRegression" not in type(model.stages[-1]).__name__:
        model.stages[-2].setHandleInvalid("keep")
    return model, spec


def forest_nodes(model: ForestModel) -> DataFrame:
    """(tree, node, feature, cut, gain, n, counts, leaf) of a fitted forest or
    tree: the root is node 1, a value up to the cut goes to node 2n, others to
    2n + 1."""
    return model.forest.table(SparkSession.active())


def nb_parameters(model: PipelineModel, spec: FeatureSpec) -> DataFrame:
    """(class, feature, log_prior, log_likelihood) of a fitted naive Bayes;
    one row per class and feature."""
    fitted = model.stages[-1]
    prior, theta = fitted.pi.toArray(), fitted.theta.toArray()
    rows = [
        (float(c), feature, float(prior[c]), float(theta[c, j]))
        for c in range(fitted.numClasses)
        for j, feature in enumerate(spec.columns)
    ]
    return SparkSession.active().createDataFrame(
        rows, "class double, feature string, log_prior double, log_likelihood double"
    )


def lr_coefficients(model: PipelineModel, spec: FeatureSpec) -> DataFrame:
    """(class, feature, weight) of a fitted logistic regression, its intercept
    under the name ``intercept``; a binary model has the rows of class 1."""
    fitted = model.stages[-1]
    weights, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    first = 1 if fitted.numClasses == 2 else 0
    rows = []
    for c in range(len(intercepts)):
        rows.append((float(first + c), "intercept", float(intercepts[c])))
        rows += [
            (float(first + c), name, float(weights[c, j])) for j, name in enumerate(spec.columns)
        ]
    return SparkSession.active().createDataFrame(
        rows, "class double, feature string, weight double"
    )


def lr_gradient(model: PipelineModel, rows: DataFrame, spec: FeatureSpec) -> DataFrame:
    """(class, feature, moment, variance, gradient) of a logistic regression and
    the rows it was fitted on: the mean of the feature among rows of the class
    (times their share), the feature's variance, and the slope of the penalised loss,
    per standard deviation of the feature. The loss is convex and its penalty
    strictly so: if no slope is left, these are the weights.

    One aggregation over (row, feature); intercepts are a feature that is 1 and
    has no penalty. Rows with a null label or feature take no part."""
    fitted = model.stages[-1]
    if fitted.getElasticNetParam():
        raise ValueError("the slope of an absolute penalty is not defined")
    names = ["intercept", *spec.columns]
    classes = [1] if fitted.numClasses == 2 else list(range(fitted.numClasses))
    scored = model.transform(spec.select(rows).dropna(subset=[spec.label, *spec.columns]))
    values = F.concat(F.array(F.lit(1.0)), vector_to_array("features"))
    long = scored.select(F.col(spec.label).alias("y"), vector_to_array("probability").alias("p"), F.posexplode(values).alias("feature", "x"))
    is_class = lambda c: (F.col("y") == c).cast("double")
    sums = [
        F.struct(
            F.lit(float(c)).alias("class"), F.avg(is_class(c) * F.col("x")).alias("moment"),
            F.avg((F.col("p")[c] - is_class(c)) * F.col("x")).alias("slope"),
        )
        for c in classes
    ]
    found = long.groupBy("feature").agg(F.var_samp("x").alias("variance"), F.array(*sums).alias("of"))
    found = found.select("feature", F.coalesce("variance", F.lit(0.0)).alias("variance"), F.explode("of").alias("c"))
    named = found.select(F.get(F.expr(f"array({', '.join(map(repr, names))})"), F.col("feature")).alias("feature"), "variance", "c.*")
    both = named.join(F.broadcast(lr_coefficients(model, spec)), ["class", "feature"])
    penalty = F.when(F.col("feature") == "intercept", 0.0).otherwise(fitted.getRegParam() * F.col("variance") * F.col("weight"))
    scale = F.when(F.col("variance") > 0, F.sqrt("variance")).otherwise(1.0)
    return both.select("class", "feature", "moment", "variance", ((F.col("slope") + penalty) / scale).alias("gradient"))
