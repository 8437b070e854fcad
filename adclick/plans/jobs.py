"""Composite jobs: clean to features, clean to a multi-hot vector, train and
evaluate, predict, screen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adclick.functions import features as X
from adclick.functions import interests as I
from adclick.operators import metrics, multihot, sampling
from adclick.operators.anova import anova_screen
from adclick.operators.encoders import (
    ValueEncoder,
    dictionary_of,
    fit_dictionary,
    frequency_index_of,
    value_counts,
)
from adclick.operators.lookup import LITERAL_ENTRIES, ElementMap, lookup_elements
from adclick.plans import models
from adclick.sources.schema import FeatureSpec
from adclick.sources.scratch import discard, materialise
from adclick.sources.settings import read_json, write_json

# Columns coded by dictionary. The last two are near-unique: no model uses
# them, so they are coded only where asked for.
CODED = ("exchange", "media", "network", "os", "publisher", "type")
CODED_WITH_IDENTIFIERS = (*CODED, "impid", "user")


@dataclass(frozen=True)
class FeatureModel:
    """Everything the cleaning learned: dictionaries and category terms, these
    as a mapping or, if they are very many, as a table (category, term)."""

    encoder: ValueEncoder
    terms: Mapping[int, Sequence[str]] | DataFrame
    mode: str = "substring"
    zone: str = "UTC"

    def transform(self, requests: DataFrame, carry: bool = False) -> DataFrame:
        """All columns as doubles, ``request_key`` being the raw identifier.

        ``carry`` keeps the raw request as the struct ``original``. One projection and one broadcast lookup per coded column: no shuffle,
        unless an identifier column with a large dictionary is coded or the terms
        are a table.
        """
        coded = self.encoder.columns
        tagged = I.tag(requests, "interests", self.terms, self.mode)
        original = [F.struct(*requests.columns).alias("original")] if carry else []
        plain = {
            "appOrSite": X.app_or_site_code(F.col("appOrSite")),
            "bidfloor": F.col("bidfloor").cast("double"),
            "city": X.located_code(F.col("city")),
            "label": X.label_double(F.col("label")),
            "size": X.size_bucket(X.size_text(F.col("size"))),
            "timestamp": X.day_part(X.event_hour(F.col("timestamp"), self.zone)),
        }
        flags = [f"i{k}" for k in (I.CATEGORIES if isinstance(self.terms, DataFrame) else sorted(self.terms))]
        cleaned = tagged.select(
            F.col("impid").alias("request_key"),
            *[x.alias(name) for name, x in plain.items()],
            *[_os_first(c).alias(c) for c in coded],
            *flags,
            *original,
        )
        ordered = sorted([*plain, *coded], key=str.lower)
        return self.encoder.transform(cleaned).select(
            "request_key", *ordered, *flags, *(["original"] if carry else [])
        )

    def save(self, path: str) -> None:
        self.encoder.save(f"{path}/encoder")
        listed = None if isinstance(self.terms, DataFrame) else dict(self.terms)
        if listed is None:
            self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        setting = {"terms": listed, "mode": self.mode, "zone": self.zone}
        write_json(self.encoder.mapping.sparkSession, setting, f"{path}/setting")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureModel:
        raw = read_json(spark, f"{path}/setting")
        terms = spark.read.parquet(f"{path}/terms") if raw["terms"] is None else {int(k): v for k, v in raw["terms"].items()}
        return cls(ValueEncoder.load(spark, f"{path}/encoder"), terms, raw["mode"], raw["zone"])


def _os_first(column: str):
    """A coded column as text; systems are coded by family."""
    return X.os_family(F.col("os")) if column == "os" else F.col(column)


def fit_features(
    requests: DataFrame,
    terms: Mapping[int, Sequence[str]] | DataFrame,
    coded: Sequence[str] = CODED,
    mode: str = "substring",
    zone: str = "UTC",
) -> FeatureModel:
    """Fit the dictionaries of all coded columns in one scan."""
    values = requests.select(*[_os_first(c).alias(c) for c in coded])
    return FeatureModel(fit_dictionary(values, list(coded)), terms, mode, zone)


MULTI_HOT_INDEXED = (
    "appOrSite", "city", "label", "located", "media", "network", "os", "publisher", "type", "user",
)


@dataclass(frozen=True)
class MultiHotModel:
    """Fitted names, indices and taxonomy of the multi-hot cleaning. Flags in
    ``flipped`` are given as 1 - flag. ``names`` is empty where the vocabulary
    is too long to be collected; it is joined then."""

    taxonomy: ElementMap
    media: ValueEncoder
    index: ValueEncoder
    vocabulary: ValueEncoder
    names: Sequence[str]
    flipped: frozenset[str] = frozenset()

    def transform(self, requests: DataFrame, wide: bool = False) -> DataFrame:
        """(impid, labelIndex, <column>Index …, features), the interest flags
        being the sparse end of ``features``; ``wide`` also gives each a column,
        which is meant for few names. Flipped flags are wide if the names are few."""
        named = self.media.transform(_multi_hot_base(requests, self.taxonomy))
        indexed = self.index.transform(named, suffix="Index")
        inputs = [f"{c}Index" for c in MULTI_HOT_INDEXED if c != "label"]
        n_names = self.vocabulary.stats["names"].values
        if n_names and not self.names:
            if wide:
                raise ValueError(f"{n_names} names are too many for a column each")
            codes = self.vocabulary.mapping_of("names").filter(F.col("value").isin(list(self.flipped)))
            flipped = sorted(int(row["code"]) - 1 for row in codes.collect())
            indexed = multihot.sparse_vectors(indexed, "names", self.vocabulary, "__flags", flipped)
        elif n_names and not wide and not self.flipped:
            indexed = multihot.multi_hot_vector(indexed, "names", self.names, "__flags")
        if "__flags" in indexed.columns or not n_names:
            flags = ["__flags"] if n_names else []
            assembler = VectorAssembler(inputCols=[*inputs, *flags], outputCol="features")
            return assembler.transform(indexed.select("impid", "labelIndex", *inputs, *flags)).drop("__flags")
        flags = [
            (1 - flag if name in self.flipped else flag).alias(column)
            for name, column, flag in zip(
                self.names,
                multihot.column_names(self.names),
                multihot.multi_hot_columns("names", self.names),
                strict=True,
            )
        ]
        table = indexed.select("impid", "labelIndex", *inputs, *flags)
        assembler = VectorAssembler(inputCols=table.columns[2:], outputCol="features")
        return assembler.transform(table)


def taxonomy_map(taxonomy: DataFrame, literal_entries: int = LITERAL_ENTRIES) -> ElementMap:
    """Lower-case names by interest code; of several names the least."""
    return ElementMap.of(
        taxonomy.filter(I.has_code(F.col("Interest"))).select(
            F.col("Interest").alias("value"), F.lower("Description").alias("code")
        ),
        literal_entries,
    )


def interest_names(
    df: DataFrame,
    column: str,
    taxonomy: ElementMap,
    out: str,
    strict: bool = False,
) -> DataFrame:
    """Array of interest codes -> distinct lower-case names, in first-seen order.

    Parts that are not codes stay as they are; an unknown code becomes itself
    in lower case, or fails the job when ``strict``. Null gives no names.
    """

    def unknown(part):
        if not strict:
            return F.lower(part)
        failure = F.raise_error(F.concat(F.lit("unknown interest code "), part)).cast("string")
        return F.when(I.has_code(part), failure).otherwise(F.lower(part))

    named = lookup_elements(df, column, taxonomy, unknown, out)
    empty = F.array().cast("array<string>")
    return named.withColumn(out, F.coalesce(F.array_distinct(out), empty))


def _multi_hot_base(requests: DataFrame, taxonomy: ElementMap) -> DataFrame:
    parts = requests.select(
        "impid",
        "appOrSite",
        "city",
        X.label_int(F.col("label")).alias("label"),
        X.located_name(F.col("city")).alias("located"),
        "media",
        "network",
        X.os_family(F.col("os")).alias("os"),
        "publisher",
        "type",
        "user",
        I.split_interests(F.col("interests")).alias("parts"),
    )
    return interest_names(parts, "parts", taxonomy, "names").drop("parts")


def fit_multi_hot(
    requests: DataFrame, taxonomy: DataFrame, index_flags: bool = False, most_names: int = multihot.NAMES
) -> MultiHotModel:
    """Fit the multi-hot cleaning in one scan: every vocabulary, dictionary and
    index follows from the counts of values.

    Flags pass through as 0/1. ``index_flags`` gives them frequency indices
    like the other columns: 0 is then the commoner of the two values. More than
    ``most_names`` names stay a table.
    """
    codes = taxonomy_map(taxonomy)
    counted = value_counts(_multi_hot_base(requests, codes), MULTI_HOT_INDEXED, ["names"])
    fitted = dictionary_of(counted, ["media", "names"])
    few = fitted.stats["names"].values <= most_names
    names = multihot.vocabulary_names(fitted, "names", most_names) if few else []
    recoded = fitted.mapping.filter("feature = 'media'").select(
        "feature", F.col("code").cast("string").alias("value"), "n"
    )
    counts = counted.filter("feature not in ('media', 'names')").unionByName(recoded)
    flipped = frozenset()
    if index_flags:
        common = fitted.mapping.filter(
            (F.col("feature") == "names") & (2 * F.col("n") > fitted.stats["media"].rows)
        )
        # at most twice as many as a row has names on average
        flipped = frozenset(row["value"] for row in common.collect())
    index = frequency_index_of(counts, MULTI_HOT_INDEXED)
    discard(counted)
    return MultiHotModel(codes, fitted.only("media"), index, fitted.only("names"), names, flipped)


def train(
    table: DataFrame,
    spec: FeatureSpec,
    kind: str,
    seed: int = 12345,
    negative_fraction: float | str = 0.03,
    split_seed: int = 36,
    **settings,
) -> tuple[PipelineModel, DataFrame]:
    """Hold out 20 % by hash of the key, balance the rest, fit, evaluate.

    The features are written down once; balancing, fitting and scoring read
    them from there. Returns the model and its report: the hold-out metrics of
    ``metrics.report``, ``auc_score`` of the probability of class 1, and rows
    and positives of both parts. The test part keeps its class ratio. Rows
    without a label take no part.
    """
    labelled = sampling.stratified_sample(
        spec.select(table), spec.label, {1.0: 1.0, 0.0: 1.0}, spec.key, split_seed
    )
    labelled = materialise(labelled, "features")
    train_part, test_part = sampling.hash_split(labelled, spec.key, (0.8, 0.2), split_seed)
    balanced = sampling.balance(train_part, spec.key, spec.label, negative_fraction, split_seed)
    model = models.fit_model(balanced, spec, kind, seed, **settings)
    probability = F.round(vector_to_array("probability")[1], 12)
    scored = models.score(model, test_part, spec).select(
        F.col(spec.label).alias("label"), "prediction", probability.alias("score")
    )
    scored = materialise(scored, "scored")
    counts = [_part_counts(balanced, spec.label, "train"), _part_counts(scored, "label", "test")]
    area = metrics.auc_score(scored).select(
        F.lit("auc_score").alias("metric"), F.lit(None).cast("double").alias("label"), F.col("auc").alias("value")
    )
    report = metrics.report(scored)
    for more in (*counts, area):
        report = report.unionByName(more)
    report = materialise(report, "report")
    discard(labelled, scored)
    return model, report


def _part_counts(part: DataFrame, label: str, name: str) -> DataFrame:
    """Rows and positives of one part, as report rows."""
    items = [
        F.struct(F.lit(f"{name}_{c}").alias("metric"), F.col(n).cast("double").alias("value"))
        for c, n in (("rows", "n"), ("positives", "positives"))
    ]
    rows = sampling.class_counts(part, label).select(F.explode(F.array(*items)).alias("i"))
    return rows.select("i.metric", F.lit(None).cast("double").alias("label"), "i.value")


def save_predictor(
    features: FeatureModel, model: PipelineModel, spec: FeatureSpec, path: str
) -> None:
    """One folder with all that ``predict`` needs."""
    features.save(f"{path}/features")
    models.save_model(model, spec, f"{path}/model")


def predict(spark: SparkSession, requests: DataFrame, path: str) -> DataFrame:
    """Score raw requests: predicted ``label``, then every original column but
    ``label`` and ``size``. The originals ride along under a struct, so no join
    puts predictions and requests back together."""
    features = FeatureModel.load(spark, f"{path}/features")
    model, spec = models.load_model(spark, f"{path}/model")
    return predict_with(features, model, spec, requests)


def predict_with(
    features: FeatureModel, model: PipelineModel, spec: FeatureSpec, requests: DataFrame
) -> DataFrame:
    scored = models.score(model, features.transform(requests, carry=True), spec)
    return models.attach_predictions(scored.select("prediction", "original.*"), requests.columns)


def screen(table: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """ANOVA of feature columns against the class, one row per column."""
    named = table.select(X.class_text(F.col(label)).alias("__class"), *columns)
    return anova_screen(named, "__class", columns)
