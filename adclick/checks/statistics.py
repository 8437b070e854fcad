"""Checks of aggregation, ANOVA, sampling and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from adclick.checks import sql as S
from adclick.checks.encoding import feature_table, feature_table_of
from adclick.checks.fixture import bids, table
from adclick.checks.registry import query
from adclick.checks.scalar import B
from adclick.functions import features as X
from adclick.operators import anova, metrics, sampling
from adclick.operators.rollup import merge_rollups, read_rollup, roll_up
from adclick.plans import jobs
from adclick.sources.scratch import materialise

# --- aggregation and analysis of variance


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


GROUPS = """select l_returnflag, count(*) as n, sum(l_quantity) as total, avg(l_quantity) as mean,
  sum(l_quantity * l_quantity) as total_squares, count(*) * var_pop(l_quantity) as squared_deviations
  from lineitem where l_returnflag is not null and l_quantity is not null group by l_returnflag"""


@query(
    "g1_group_statistics",
    f"""select l_returnflag, n, round(total, 3) as total, round(mean, 6) as mean,
      round(total_squares, 3) as total_squares, round(squared_deviations, 3) as squared_deviations from ({GROUPS})""",
)
def g1(spark, sf_dir):
    groups = anova.group_statistics(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")
    return rounded(
        rounded(groups, "mean"), "total", "total_squares", "squared_deviations", digits=3
    )


@query(
    "g2_group_totals",
    f"""select count(*) as groups, sum(n)::bigint as n, round(sum(total), 3) as total,
      round(sum(total_squares), 3) as total_squares, round(sum(squared_deviations), 3) as squared_deviations
      from ({GROUPS})""",
)
def g2(spark, sf_dir):
    groups = anova.group_statistics(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")
    totals = anova.group_totals(groups)
    return rounded(totals, "total", "total_squares", "squared_deviations", digits=3)


@query(
    "f2_group_mean",
    """select l_orderkey, l_linenumber, l_returnflag, l_quantity, round(m, 6) as group_mean
      from lineitem join (select l_returnflag, avg(l_quantity) as m from lineitem group by 1) using (l_returnflag)""",
)
def f2(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"
    )
    return rounded(anova.with_group_mean(rows, "l_returnflag", "l_quantity"), "group_mean")


@query(
    "f3_group_aggregates",
    f"""select c.l_returnflag, c.n, round(t.total, 3) as total, round(q.total_squares, 3) as total_squares,
      round(m.mean, 6) as mean
      from (select l_returnflag, n from ({GROUPS})) c join (select l_returnflag, total from ({GROUPS})) t using (l_returnflag)
        join (select l_returnflag, total_squares from ({GROUPS})) q using (l_returnflag)
        join (select l_returnflag, mean from ({GROUPS})) m using (l_returnflag)""",
)
def f3(spark, sf_dir):
    """The four aggregates come from one aggregation, so nothing is joined."""
    groups = anova.group_statistics(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")
    return rounded(
        rounded(groups.drop("squared_deviations"), "mean"), "total", "total_squares", digits=3
    )


def anova_sql(source: str, cat: str, value: str, lead: str = "") -> str:
    """Sums of squares straight from the rows, without variances."""
    return f"""select {lead}k - 1 as dfb, (n - k)::double as dfw,
        round((ssb / nullif(k - 1, 0)) / nullif(ssw / nullif(n - k, 0), 0), 6) as f_value,
        round(ssb / nullif(ssb + ssw, 0), 9) as eta_sq,
        round((ssb - (k - 1) * ssw / nullif(n - k, 0)) / nullif(ssb + ssw + ssw / nullif(n - k, 0), 0), 9) as omega_sq
      from (select count(distinct c) as k, count(*) as n, sum((gm - tm) * (gm - tm)) as ssb, sum((v - gm) * (v - gm)) as ssw
        from (select c, v, avg(v) over (partition by c) as gm, avg(v) over () as tm
          from (select {cat} as c, {value}::double as v from {source}) where c is not null and v is not null))"""


def rounded_anova(df):
    return df.withColumns(
        {"f_value": F.round("f_value", 6), "eta_sq": F.round("eta_sq", 9), "omega_sq": F.round("omega_sq", 9)}
    )


@query("g3_anova", anova_sql("lineitem", "l_returnflag", "l_extendedprice"))
def g3(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return rounded_anova(anova.anova(lines, "l_returnflag", "l_extendedprice"))


@query("g3_anova_requests", f"with {S.BIDS} " + anova_sql("bids", "city", "bidfloor"))
def g3_requests(spark, sf_dir):
    """Null cities drop out."""
    return rounded_anova(anova.anova(bids(spark, sf_dir), "city", "bidfloor"))


SCREENED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "g4_anova_screen",
    " union all ".join(
        f"({anova_sql('lineitem', 'l_returnflag', c, f"'{c}' as feature, ")})" for c in SCREENED
    ),
)
def g4(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return rounded_anova(anova.anova_screen(lines, "l_returnflag", SCREENED))


L5_COLUMNS = [
    "bidfloor", "exchange", "appOrSite", "city", "media", "network", "os", "publisher", "type", "user",
]


@query(
    "l5_feature_screening",
    f"with {S.FEATURES} " + " union all ".join(
        f"({anova_sql('features', "case when label = 1 then 'true' else 'false' end", f'"{c.lower()}"', f"'{c}' as feature, ")})"
        for c in L5_COLUMNS
    ),
)
def l5(spark, sf_dir):
    features = feature_table(spark, sf_dir, jobs.CODED_WITH_IDENTIFIERS)
    return rounded_anova(jobs.screen(features, "label", L5_COLUMNS))


@query(
    "l5_feature_screening_unlabelled",
    f"with {S.FEATURES} " + " union all ".join(
        f"({anova_sql('(select * from features where cast(request_key as bigint) % 3 <> 0)', "case when label = 1 then 'true' else 'false' end", f'"{c.lower()}"', f"'{c}' as feature, ")})"
        for c in ("bidfloor", "media")
    ),
)
def l5_unlabelled(spark, sf_dir):
    """A third of the requests has no label and must not count."""
    requests = bids(spark, sf_dir)
    labelled_ = F.when(F.col("impid").cast("bigint") % 3 != 0, F.col("label"))
    features = feature_table_of(spark, sf_dir, requests.withColumn("label", labelled_))
    return rounded_anova(jobs.screen(features, "label", ["bidfloor", "media"]))


@query("g5_distinct_values", B + "select distinct publisher, os from bids")
def g5(spark, sf_dir):
    return bids(spark, sf_dir).select("publisher", "os").distinct()


@query(
    "g6_class_counts",
    B + "select count(*) as n, count(*) filter (label) as positives, count(*) filter (not label) as negatives from bids",
)
def g6(spark, sf_dir):
    label = X.label_double(F.col("label")).alias("label")
    return sampling.class_counts(bids(spark, sf_dir).select(label))


@query(
    "g7_indicator_mean",
    "select round(avg(case when quality = toxic then 1 else 0 end), 6) as accuracy, round(1 - avg(case when quality = toxic then 1 else 0 end), 6) as test_error from labels",
)
def g7(spark, sf_dir):
    return rounded(
        metrics.accuracy(table(spark, sf_dir, "labels"), "quality", "toxic"), "accuracy", "test_error"
    )


# --- sampling and splitting


def labelled(spark, sf_dir):
    return bids(spark, sf_dir).select("impid", X.label_double(F.col("label")).alias("label"))


L = f"with {S.BIDS}, labelled as (select impid, label::int::double as label from bids) "


@query(
    "h1_stratified_sample_whole",
    L + "select impid, label from labelled where label in (0, 1)",
)
def h1_whole(spark, sf_dir):
    """Both classes at 1.0: only rows without a label go."""
    return sampling.stratified_sample(labelled(spark, sf_dir), "label", {1.0: 1.0, 0.0: 1.0}, "impid")


@query(
    "h1_stratified_sample",
    L + f"select impid, label from labelled where {S.unit('impid', 'stratum36')} < case when label = 1 then 0.5 else 0.25 end",
)
def h1(spark, sf_dir):
    return sampling.stratified_sample(labelled(spark, sf_dir), "label", {1.0: 0.5, 0.0: 0.25}, "impid")


@query(
    "h2_hash_split",
    L + f"select impid, label, case when {S.unit('impid', 'split36')} < 0.8 then 'train' else 'test' end as part from labelled",
)
def h2(spark, sf_dir):
    train, test = sampling.hash_split(labelled(spark, sf_dir), "impid")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "h2_order_split",
    f"select o_orderkey, o_orderstatus, o_totalprice from orders where {S.unit('o_orderkey', 'split7')} >= 0.8",
)
def h2_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return sampling.hash_split(orders, "o_orderkey", seed=7)[1]


@query("h3_downsample", L + f"select impid, label from labelled where label = 0 and {S.unit('impid', 'down36')} < 0.03")
def h3(spark, sf_dir):
    negatives = labelled(spark, sf_dir).filter("label = 0.0")
    return sampling.downsample(negatives, 0.03, "impid")


@query(
    "h4_balanced",
    L + f"""select impid, label from labelled where label = 1
      union all select impid, label from labelled where label = 0 and {S.unit('impid', 'down36')} < 0.03""",
)
def h4(spark, sf_dir):
    return sampling.balance(labelled(spark, sf_dir), "impid")


@query(
    "h4_balanced_odd_keys",
    L + """select case when cast(impid as bigint) % 5 = 0 then null else impid end as impid, label
      from labelled where label in (0, 1)""",
)
def h4_odd_keys(spark, sf_dir):
    """All negatives are asked for, so those without a key stay as well."""
    rows = labelled(spark, sf_dir)
    rows = rows.withColumn("impid", F.when(F.col("impid").cast("bigint") % 5 != 0, F.col("impid")))
    return sampling.balance(rows, "impid", fraction=1.0)


@query(
    "h4_balanced_auto",
    L + f""", share as (select {S.AUTO_FRACTION} as f from labelled)
      select impid, label from labelled, share where label = 1 or {S.unit('impid', 'down36')} < f""",
)
def h4_auto(spark, sf_dir):
    return sampling.balance(labelled(spark, sf_dir), "impid", fraction="auto")


# --- evaluation: quality read as a prediction of toxicity


def judged(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.col("toxic").cast("double").alias("label"), F.col("quality").cast("double").alias("prediction")
    )


J = "with judged as (select doc_id, toxic::double as label, quality::double as prediction from labels) "


@query(
    "k1_accuracy",
    J + "select round(count_if(label = prediction) / count(*), 6) as accuracy, round(1 - count_if(label = prediction) / count(*), 6) as test_error from judged",
)
def k1(spark, sf_dir):
    return rounded(metrics.accuracy(judged(spark, sf_dir)), "accuracy", "test_error")


@query(
    "k2_precision_recall",
    J + """select c as label,
        round(coalesce(count_if(label = c and prediction = c) / nullif(count_if(prediction = c), 0), 0)::double, 6) as precision,
        round(count_if(label = c and prediction = c) / count_if(label = c)::double, 6) as recall
      from judged, (select distinct label as c from judged) group by c""",
)
def k2(spark, sf_dir):
    return rounded(metrics.precision_recall(judged(spark, sf_dir)), "precision", "recall")


@query(
    "k3_confusion",
    J + "select label, count(*) filter (prediction = 0) as predicted_0, count(*) filter (prediction = 1) as predicted_1 from judged group by label",
)
def k3(spark, sf_dir):
    return metrics.confusion_matrix(judged(spark, sf_dir))


AUC_HARD = """round((1 + count_if(label = 1 and prediction = 1) / count_if(label = 1)
  - count_if(label = 0 and prediction = 1) / count_if(label = 0)) / 2, 6)"""


@query("k4_auc_hard", J + f"select {AUC_HARD} as auc from judged")
def k4(spark, sf_dir):
    return rounded(metrics.auc_hard(judged(spark, sf_dir)), "auc")


AUC_SCORE = """select round(((sum(case when label = 1 then r end) - p * (p + 1) / 2) / (p * f))::double, 9) as auc from (
  select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r,
    (count(*) filter (label = 1) over ())::double as p, (count(*) filter (label = 0) over ())::double as f
  from scored where label in (0, 1)) group by p, f"""


@query("k5_auc_score", f"with {S.BIDS}, scored as (select label::int as label, bidfloor as score from bids) {AUC_SCORE}")
def k5(spark, sf_dir):
    scored = bids(spark, sf_dir).select(
        X.label_double(F.col("label")).alias("label"), F.col("bidfloor").alias("score")
    )
    return rounded(metrics.auc_score(scored), "auc", digits=9)


@query(
    "k5_auc_documents",
    f"with scored as (select quality as label, n_chars::double as score from labels join documents using (doc_id)) {AUC_SCORE}",
)
def k5_documents(spark, sf_dir):
    """Length as a score for quality; documents of one length tie."""
    joined = table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    scored = joined.select(F.col("quality").cast("double").alias("label"), F.col("n_chars").alias("score"))
    return rounded(metrics.auc_score(scored), "auc", digits=9)



# --- stored sketches


def _rollup(by):
    """Sketches by day, written, read and merged to the groups ``by``; exact
    numbers beside whether the sketches are within their bounds: four standard errors
    of a distinct count, two per cent of the rows in the rank of the median."""

    def run(spark, sf_dir):
        events = table(spark, sf_dir, "events")
        rows = events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "user_id", "value")
        stored = materialise(roll_up(rows, ["day", "event_type"], ["user_id"], ["value"]), "rollup")
        numbers = read_rollup(merge_rollups(stored, by), (0.5,)).withColumn("q", F.col("quantiles_value")[0])
        both = rows.join(F.broadcast(numbers.select(*by, "q", "distinct_user_id", "rows")), by)
        share = lambda test: F.count_if(test) / F.count("*")
        exact = both.groupBy(*by, "rows", "distinct_user_id").agg(
            F.count_distinct("user_id").alias("users"), share(F.col("value") < F.col("q")).alias("below"), share(F.col("value") <= F.col("q")).alias("up_to")
        )
        error = F.abs(F.col("distinct_user_id") - F.col("users"))
        return exact.select(
            *by, "rows", "users", (error <= F.greatest(F.lit(1.0), 4 * 0.0163 * F.col("users"))).alias("users_within"),
            ((F.col("below") <= 0.52) & (F.col("up_to") >= 0.48)).alias("median_within"),
        )

    return run


def _rollup_sql(day):
    return f"""select {day}, count(*) as rows, count(distinct user_id) as users, true as users_within, true as median_within
      from events group by 1"""


query("g6_rollup_by_day", _rollup_sql("strftime(ts, '%Y-%m-%d') as day"))(_rollup(["day"]))
query("g6_rollup_by_event_type", _rollup_sql("event_type"))(_rollup(["event_type"]))
