"""Checks of training, scoring and the composite jobs."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from adclick.checks import sql as S
from adclick.checks.encoding import NAMES, feature_table, model_spec
from adclick.checks.fixture import bids, table, taxonomy, terms
from adclick.checks.registry import query
from adclick.checks.scalar import lower_names
from adclick.checks.statistics import AUC_SCORE, rounded
from adclick.operators import metrics, sampling
from adclick.plans import jobs, models
from adclick.sources.schema import FeatureSpec
from adclick.sources.scratch import scratch_path
from adclick.streaming import scoring as streaming


def trained(spark, sf_dir, kind, fraction=0.03, spec=None, **settings):
    """Feature table, spec and a model of the balanced training part."""
    features = feature_table(spark, sf_dir)
    spec = spec or model_spec(features)
    train_part, test_part = sampling.hash_split(spec.select(features), spec.key)
    balanced = sampling.balance(train_part, spec.key, fraction=fraction)
    return features, spec, models.fit_model(balanced, spec, kind, **settings), test_part


@query(
    "l1_features",
    f"""with {S.FEATURES} select * from features""",
)
def l1(spark, sf_dir):
    return lower_names(feature_table(spark, sf_dir, jobs.CODED_WITH_IDENTIFIERS))


INDEXED = {
    "apporsite": "apporsite",
    "city": "city",
    "label": "label",
    "located": "located",
    "media": "media",
    "network": "network",
    "os": "os",
    "publisher": "publisher",
    "type": "type",
    "user": "person",
}


def _multi_hot_sql(flag: str) -> str:
    """Indices of the ten columns, and all flags in vocabulary order as digits.
    The media dictionary keeps value order, but its codes tie as text."""
    ctes, picks = [], []
    for i, (name, column) in enumerate(INDEXED.items()):
        ctes.append(
            f"""x{i} as (select v, row_number() over (order by count(*) desc, v) - 1 as code
              from (select cast({column} as varchar) as v from base) where v is not null group by v)"""
        )
        picks.append(
            f"""coalesce((select code from x{i} where v = cast({column} as varchar)),
              (select count(*) from x{i}))::double as {name}index"""
        )
    return f"""with {NAMES},
      base as (select impid, apporsite, city, label::int as label,
        case when city is null then 'not located' else 'located' end as located,
        dense_rank() over (order by media nulls first)::double as media,
        network, {S.OS_FAMILY} as os, publisher, type, "user" as person from bids),
      {', '.join(ctes)},
      shares as (select vocabulary.name, code, count(*) as n from vocabulary join named on named.name = vocabulary.name group by all),
      hot as (select bids.impid, string_agg({flag}, '' order by shares.code) as flags
        from bids cross join shares left join named on named.impid = bids.impid and named.name = shares.name
        group by bids.impid)
      select base.impid, {', '.join(picks)}, flags from base join hot on base.impid = hot.impid"""


def multi_hot_table(spark, sf_dir, index_flags, **more):
    """Unpacks the vector, so that the assembled order is checked as well."""
    requests = bids(spark, sf_dir)
    model = jobs.fit_multi_hot(requests, taxonomy(spark, sf_dir), index_flags, **more)
    indexed = [f"{c}Index" for c in jobs.MULTI_HOT_INDEXED if c != "label"]
    values = vector_to_array("features")
    digits = F.transform(F.slice(values, len(indexed) + 1, model.vocabulary.stats["names"].values), lambda x: x.cast("int").cast("string"))
    return model.transform(requests).select(
        "impid",
        F.col("labelIndex").alias("labelindex"),
        *[values[i].alias(c.lower()) for i, c in enumerate(indexed)],
        F.array_join(digits, "").alias("flags"),
    )


@query("l2_multi_hot_vector", _multi_hot_sql("case when named.name is null then '0' else '1' end"))
def l2(spark, sf_dir):
    return multi_hot_table(spark, sf_dir, False)


@query(
    "l2_multi_hot_vector_indexed_flags",
    _multi_hot_sql(
        """case when (named.name is not null) = (2 * shares.n > (select count(*) from bids)) then '0' else '1' end"""
    ),
)
def l2_indexed(spark, sf_dir):
    """The flags put through the frequency index: 0 is the commoner value."""
    return multi_hot_table(spark, sf_dir, True)


@query(
    "l2_multi_hot_vector_joined",
    _multi_hot_sql(
        """case when (named.name is not null) = (2 * shares.n > (select count(*) from bids)) then '0' else '1' end"""
    ),
)
def l2_joined(spark, sf_dir):
    """The way taken for a vocabulary too long to collect."""
    return multi_hot_table(spark, sf_dir, True, most_names=0)


# --- models

NB = f"with {S.naive_bayes()} "


@query(
    "j1_nb_parameters",
    NB + "select class, feature, round(log_prior, 9) as log_prior, round(log_likelihood, 9) as log_likelihood from params",
)
def j1(spark, sf_dir):
    _, spec, model, _ = trained(spark, sf_dir, "nb")
    params = models.nb_parameters(model, spec).withColumn(
        "feature", F.lower("feature")
    )
    return rounded(params, "log_prior", "log_likelihood", digits=9)


@query("j5_nb_scores", NB + "select request_key, label, prediction, round(p, 6) as p from scored")
def j5_nb(spark, sf_dir):
    features, spec, model, _ = trained(spark, sf_dir, "nb")
    scored = models.score(model, features, spec)
    p = F.round(vector_to_array("probability")[1], 6)
    return scored.select("request_key", "label", "prediction", p.alias("p"))


@query(
    "a5_saved_model",
    NB + "select class, feature, round(log_prior, 9) as log_prior, round(log_likelihood, 9) as log_likelihood from params",
)
def a5(spark, sf_dir):
    _, spec, model, _ = trained(spark, sf_dir, "nb")
    path = scratch_path(spark, "model")
    models.save_model(model, spec, path)
    saved, kept = models.load_model(spark, path)
    params = models.nb_parameters(saved, kept).withColumn("feature", F.lower("feature"))
    return rounded(params, "log_prior", "log_likelihood", digits=9)


@query("a6_loaded_model_scores", NB + "select request_key, prediction from scored")
def a6(spark, sf_dir):
    features, spec, model, _ = trained(spark, sf_dir, "nb")
    path = scratch_path(spark, "model")
    models.save_model(model, spec, path)
    loaded, kept = models.load_model(spark, path)
    return models.score(loaded, features, kept).select("request_key", "prediction")


@query("j7_attached_predictions", NB + 'select prediction = 1 as label, impid, os, "user", interests from scored join bids on impid = request_key')
def j7(spark, sf_dir):
    requests = bids(spark, sf_dir)
    features = jobs.fit_features(requests, terms(spark, sf_dir))
    table_ = features.transform(requests, carry=True)
    spec = model_spec(table_.drop("original"))
    train_part, _ = sampling.hash_split(spec.select(table_), spec.key)
    model = models.fit_model(sampling.balance(train_part, spec.key), spec, "nb")
    scored = models.score(model, table_, spec).select("prediction", "original.*")
    return models.attach_predictions(scored, ["impid", "os", "user", "interests"])


def _probabilities(kind, digits=None):
    def run(spark, sf_dir):
        features, spec, model, _ = trained(spark, sf_dir, kind, "auto")
        scored = models.score(model, features, spec)
        p = vector_to_array("probability")[1]
        return scored.select("request_key", "label", "prediction", (F.round(p, digits) if digits else p).alias("p"))

    return run


# The usual forest and tree, whole: weights, draws and cuts follow from hashes.
_FORESTS = {
    "rf": f"with {S.forest(S.AUTO_FRACTION, 64, drawn=6)}",
    "dt": f"with {S.forest(S.AUTO_FRACTION, 1)}",
}
for _name, _kind in (("j3_rf", "rf"), ("j4_dt", "dt")):
    query(f"{_name}_scores", _FORESTS[_kind] + " select request_key, label, prediction, round(p, 9) as p from scored")(_probabilities(_kind, 9))


def _nodes(kind):
    def run(spark, sf_dir):
        _, _, model, _ = trained(spark, sf_dir, kind, "auto")
        counts = [F.col("counts")[k].alias(f"c{k}") for k in (0, 1)]
        name = F.lower("feature").alias("feature")
        return rounded(models.forest_nodes(model).select("tree", "node", name, "cut", "gain", *counts, "leaf"), "gain", digits=9)

    return run


_NODES = " select tree, node, feature, cut, round(gain, 9) as gain, c0, c1, leaf from nodes"
query("j3_rf_nodes", _FORESTS["rf"] + _NODES)(_nodes("rf"))
query("j4_dt_nodes", _FORESTS["dt"] + _NODES)(_nodes("dt"))


@query("j2_lr_coefficients")
def j2(spark, sf_dir):
    _, spec, model, _ = trained(spark, sf_dir, "lr", "auto")
    return models.lr_coefficients(model, spec)


@query("j6_lr_scores")
def j6(spark, sf_dir):
    return _probabilities("lr")(spark, sf_dir)


def _balanced(spark, sf_dir):
    features = feature_table(spark, sf_dir)
    spec = model_spec(features)
    train_part, _ = sampling.hash_split(spec.select(features), spec.key)
    return sampling.balance(train_part, spec.key, fraction="auto"), spec


def _gradient(model, rows, spec):
    """The gradient to three digits: nought, or the weights are no optimum."""
    found = models.lr_gradient(model, rows, spec)
    found = rounded(found, "moment", "variance", digits=9)
    return found.select("class", F.lower("feature").alias("feature"), "moment", "variance", (F.round("gradient", 3) + 0.0).alias("gradient"))


@query(
    "j2_lr_gradient",
    f"""with {S.parts(S.AUTO_FRACTION)}
      select 1::double as class, lower(name) as feature, round(avg(label * v), 9) as moment, round(var_samp(v), 9) as variance, 0::double as gradient
      from (select label, name, v from (select label, {', '.join(f'"{c}"' for c in S.MODEL_COLUMNS)} from balanced)
        unpivot (v for name in ({', '.join(f'"{c}"' for c in S.MODEL_COLUMNS)}))) group by name
      union all select 1, 'intercept', round(avg(label), 9), 0, 0 from balanced""",
)
def j2_gradient(spark, sf_dir):
    """The usual regression is at the optimum of its penalised loss, which is
    the only one."""
    rows, spec = _balanced(spark, sf_dir)
    return _gradient(models.fit_model(rows, spec, "lr"), rows, spec)


# Small models that SQL can fit as well: one tree with one cut, without
# bootstrap and on all features, and logistic regression on one feature.
STUMP = {"maxDepth": 1}
ONE_TREE = {"maxDepth": 1, "numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "all"}
EXACT = {"tol": 1e-12}
ONE_FEATURE = FeatureSpec(("publisher",))
_STUMP_SQL, _LOGIT_SQL = f"with {S.stump(S.AUTO_FRACTION)}", f"with recursive {S.logit('publisher', S.AUTO_FRACTION)}"


def _small_scores(kind, spec, settings, digits, saved=False):
    def run(spark, sf_dir):
        features, used, model, _ = trained(spark, sf_dir, kind, "auto", spec, **settings)
        if saved:
            path = scratch_path(spark, "model")
            models.save_model(model, used, path)
            model, used = models.load_model(spark, path)
        scored = models.score(model, features, used)
        p = F.round(vector_to_array("probability")[1], digits).alias("p")
        return scored.select("request_key", "label", "prediction", p)

    return run


for _name, _kind, _spec, _settings, _sql, _digits in (
    ("j3_rf_one_tree", "rf", None, ONE_TREE, _STUMP_SQL, 9),
    ("j4_dt_stump", "dt", None, STUMP, _STUMP_SQL, 9),
    ("j6_lr_one_feature", "lr", ONE_FEATURE, EXACT, _LOGIT_SQL, 4),
):
    _scores = f"{_sql} select request_key, label, prediction, round(p, {_digits}) as p from scored"
    query(f"{_name}_scores", _scores)(_small_scores(_kind, _spec, _settings, _digits))
    query(f"a6_loaded_{_kind}_scores", _scores)(_small_scores(_kind, _spec, _settings, _digits, saved=True))


@query(
    "j2_lr_one_feature_coefficients",
    f"""{_LOGIT_SQL} select 1::double as class, 'intercept' as feature, round(b, 3) as weight from fitted
      union all select 1, 'publisher', round(w, 3) from fitted""",
)
def j2_small(spark, sf_dir):
    _, spec, model, _ = trained(spark, sf_dir, "lr", "auto", ONE_FEATURE, **EXACT)
    return rounded(models.lr_coefficients(model, spec), "weight", digits=3)


def _embedding_parts(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    width = vectors.select(F.max(F.size("embedding"))).first()[0]
    names = [f"e{i}" for i in range(width)]
    wide = vectors.select(
        F.col("vec_id").cast("string").alias("request_key"),
        F.col("label").cast("double").alias("label"),
        *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
    )
    spec = FeatureSpec(tuple(names))
    return *sampling.hash_split(wide, spec.key), spec


@query(
    "j2_lr_gradient_ten_classes",
    f"""with rows as (select label::double as label, unnest(embedding)::double as v, unnest(range(len(embedding))) as i
        from embeddings where {S.unit('vec_id', 'split36')} < 0.8),
      classes as (select distinct label as class from rows)
      select class, 'e' || cast(i as varchar) as feature, round(avg(case when label = class then v else 0 end), 9) as moment,
        round(var_samp(v), 9) as variance, 0::double as gradient from rows cross join classes group by class, i
      union all select class, 'intercept', round(avg(case when label = class then 1 else 0 end), 9), 0, 0
      from rows cross join classes where i = 0 group by class""",
)
def j2_gradient_ten_classes(spark, sf_dir):
    rows, _, spec = _embedding_parts(spark, sf_dir)
    return _gradient(models.fit_model(rows, spec, "lr"), rows, spec)


def _embedding_report(kind):
    """Ten classes told apart by the components of their embeddings."""

    def run(spark, sf_dir):
        train_part, test_part, spec = _embedding_parts(spark, sf_dir)
        model = models.fit_model(train_part, spec, kind)
        return metrics.report(models.score(model, test_part, spec))

    return run


query("j2_lr_embeddings")(_embedding_report("lr"))
query("j3_rf_embeddings")(_embedding_report("rf"))


# --- composite jobs

REPORT = f"""held as (select label, round(p, 12) as score, prediction from scored where not train),
  area as ({AUC_SCORE.replace('from scored', 'from held')}),
  counts as (select c, count_if(label = c and prediction = c) as hits, count_if(label = c) as actual,
    count_if(prediction = c) as predicted
  from scored, (select distinct label as c from scored where not train) where not train group by c)
select metric, label, round(value, 6) as value from (
  select 'accuracy' as metric, null::double as label, sum(hits)::double / sum(actual) as value from counts
  union all select 'test_error', null, 1 - sum(hits)::double / sum(actual) from counts
  union all select 'precision', c, coalesce(hits::double / nullif(predicted, 0), 0) from counts
  union all select 'recall', c, hits::double / actual from counts
  union all select 'auc_hard', null, sum(hits::double / actual) / 2 from counts
  union all select 'auc_score', null, auc from area
  union all select 'predicted_' || prediction::int, label, count(*)::double from held group by all
  union all select 'train_rows', null, count(*)::double from balanced
  union all select 'train_positives', null, count_if(label = 1)::double from balanced
  union all select 'test_rows', null, count(*)::double from held
  union all select 'test_positives', null, count_if(label = 1)::double from held)"""


@query("l3_nb_train_evaluate", f"with {S.naive_bayes()}, {REPORT}")
def l3_nb(spark, sf_dir):
    features = feature_table(spark, sf_dir)
    return rounded(jobs.train(features, model_spec(features), "nb")[1], "value")


@query("l3_nb_train_evaluate_auto", f"with {S.naive_bayes(S.AUTO_FRACTION)}, {REPORT}")
def l3_nb_auto(spark, sf_dir):
    features = feature_table(spark, sf_dir)
    return rounded(jobs.train(features, model_spec(features), "nb", negative_fraction="auto")[1], "value")


@query("l3_nb_score_auc", f"with {S.naive_bayes()}, held as (select label, p as score from scored where not train) {AUC_SCORE.replace('from scored', 'from held')}")
def l3_nb_auc(spark, sf_dir):
    """Area under ROC of the held-out probabilities."""
    _, spec, model, test_part = trained(spark, sf_dir, "nb")
    scored = models.score(model, test_part, spec)
    score = F.round(vector_to_array("probability")[1], 12).alias("score")
    return rounded(metrics.auc_score(scored.select("label", score)), "auc", digits=9)


def _train_evaluate(kind):
    def run(spark, sf_dir):
        features = feature_table(spark, sf_dir)
        return jobs.train(features, model_spec(features), kind, negative_fraction="auto")[1]

    return run


query("l3_lr_train_evaluate")(_train_evaluate("lr"))
query("l3_rf_train_evaluate", f"{_FORESTS['rf']}, {REPORT}")(lambda spark, sf_dir: rounded(_train_evaluate("rf")(spark, sf_dir), "value"))
query("l3_dt_train_evaluate", f"{_FORESTS['dt']}, {REPORT}")(lambda spark, sf_dir: rounded(_train_evaluate("dt")(spark, sf_dir), "value"))


def _small_report(kind, spec, settings):
    def run(spark, sf_dir):
        features = feature_table(spark, sf_dir)
        used = spec or model_spec(features)
        return rounded(jobs.train(features, used, kind, negative_fraction="auto", **settings)[1], "value")

    return run


query("l3_lr_one_feature", f"{_LOGIT_SQL}, {REPORT}")(_small_report("lr", ONE_FEATURE, EXACT))
query("l3_rf_one_tree", f"{_STUMP_SQL}, {REPORT}")(_small_report("rf", None, ONE_TREE))
query("l3_dt_stump", f"{_STUMP_SQL}, {REPORT}")(_small_report("dt", None, STUMP))


def _predict(kind, spec=None, negative_fraction=0.03, **settings):
    """Train, save everything, load it again and score the raw requests."""

    def run(spark, sf_dir):
        requests = bids(spark, sf_dir)
        features = jobs.fit_features(requests, terms(spark, sf_dir))
        table_ = features.transform(requests)
        used = spec or model_spec(table_)
        model, _ = jobs.train(table_, used, kind, negative_fraction=negative_fraction, **settings)
        path = scratch_path(spark, "predictor")
        jobs.save_predictor(features, model, used, path)
        return lower_names(jobs.predict(spark, requests, path))

    return run


_PREDICTED = """ select prediction = 1 as label, apporsite, bidfloor, city, exchange, impid, interests, media, network,
      os, publisher, "timestamp", type, "user" from scored join bids on impid = request_key"""
query("l4_predictions", NB + _PREDICTED)(_predict("nb"))
query("l4_predictions_lr_one_feature", _LOGIT_SQL + _PREDICTED)(_predict("lr", ONE_FEATURE, "auto", **EXACT))
query("l4_predictions_rf_one_tree", _STUMP_SQL + _PREDICTED)(_predict("rf", None, "auto", **ONE_TREE))
query("l4_predictions_lr")(_predict("lr"))
query("l4_predictions_rf", f"with {S.forest('0.03', 64, drawn=6)}" + _PREDICTED)(_predict("rf"))


# --- streams


def _event_stream(spark, sf_dir):
    """The event table as files that arrive; each row twice, as it may be sent again."""
    events = table(spark, sf_dir, "events")
    stream = streaming.read_files(spark, f"{sf_dir}/events.parquet*", events.schema, "parquet")
    return stream.withColumn("sent", F.explode(F.array(F.lit(1), F.lit(2)))).drop("sent")


@query("m1_stream_scores", NB + _PREDICTED)
def m1(spark, sf_dir):
    """A model fitted on the table scores the stream, every request once."""
    features = jobs.fit_features(bids(spark, sf_dir), terms(spark, sf_dir))
    table_ = features.transform(bids(spark, sf_dir))
    spec = model_spec(table_)
    train_part, _ = sampling.hash_split(spec.select(table_), spec.key)
    model = models.fit_model(sampling.balance(train_part, spec.key), spec, "nb")
    stream = bids(spark, sf_dir, _event_stream(spark, sf_dir))
    return lower_names(streaming.run_once(streaming.scored(stream, features, model, spec, "100 days"), "scores"))


@query(
    "m2_stream_clicks_after_views",
    """select v.event_id as view_id, c.event_id as click_id from events v join events c on v.user_id = c.user_id
      where v.event_type = 'view' and c.event_type = 'click' and c.ts >= v.ts and c.ts <= v.ts + interval 6 hours""",
)
def m2(spark, sf_dir):
    """Clicks of a user up to six hours after a view, each sent twice."""
    events = _event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    once = streaming.first_of_each(events, "event_id", "ts", "100 days").select("event_id", "user_id", "event_type", "ts")
    both = streaming.joined_within(
        once.where("event_type = 'view'"), once.where("event_type = 'click'"), "user_id", "ts", "ts", "6 hours", None
    )
    joined = both.select(F.col("event_id").alias("view_id"), F.col("click_event_id").alias("click_id"))
    return streaming.run_once(joined, "clicks")
