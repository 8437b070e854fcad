"""Checks of the sources, projections and scalar features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adclick.checks import sql as S
from adclick.checks.fixture import bids, table
from adclick.checks.registry import query
from adclick.functions import features as X
from adclick.functions import interests as I
from adclick.operators.anova import group_statistics, group_totals, with_group_mean
from adclick.plans.models import attach_predictions
from adclick.sources import readers, sinks
from adclick.sources.schema import BID_REQUEST
from adclick.sources.scratch import scratch_path

B = f"with {S.BIDS} "
ALL = [f.name for f in BID_REQUEST if f.name != "size"]
ALL_SQL = ", ".join(f'"{c.lower()}"' for c in ALL)


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


@query(
    "click_rate_by_os_and_day_part",
    B + f"""select {S.OS_FAMILY} as os_family, {S.DAY_PART} as day_part, {S.SIZE_BUCKET} as size_bucket,
      count(*) as impressions, count(*) filter (label) as clicks,
      round(avg(label::int), 6) as click_rate from bids group by all""",
)
def click_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        bids(spark, sf_dir)
        .groupBy(
            X.os_family(F.col("os")).alias("os_family"),
            X.day_part(X.event_hour(F.col("timestamp"))).alias("day_part"),
            X.size_bucket(X.size_text(F.col("size"))).alias("size_bucket"),
        )
        .agg(
            F.count(F.lit(1)).alias("impressions"),
            F.count_if("label").alias("clicks"),
            F.round(F.avg(X.label_int(F.col("label"))), 6).alias("click_rate"),
        )
    )


@query("a1_json_scan", B + f"select {ALL_SQL}, size from bids")
def a1(spark, sf_dir):
    path = scratch_path(spark, "requests")
    bids(spark, sf_dir).write.json(path)
    scanned = readers.read_requests(spark, path)
    return lower_names(scanned.select(*ALL, X.size_text(F.col("size")).alias("size")))


def broken_requests(spark, sf_dir):
    """A path of JSON lines of which every seventh breaks off."""
    path = scratch_path(spark, "requests")
    line = F.to_json(F.struct("*"))
    cut = F.when(F.col("impid").cast("bigint") % 7 == 0, F.substring(line, 1, 20)).otherwise(line)
    bids(spark, sf_dir).select(cut.alias("value")).write.text(path)
    return path


@query("a1_json_readable_lines", B + "select impid, bidfloor, label from bids where cast(impid as bigint) % 7 <> 0")
def a1_readable(spark, sf_dir):
    return readers.read_requests(spark, broken_requests(spark, sf_dir)).select("impid", "bidfloor", "label")


@query(
    "a1_json_corrupt_lines",
    B + "select case when cast(impid as bigint) % 7 <> 0 then impid end as impid, cast(impid as bigint) % 7 = 0 as broken from bids",
)
def a1_corrupt(spark, sf_dir):
    """Lines that cannot be read are kept apart, with their text."""
    rows = readers.read_requests(spark, broken_requests(spark, sf_dir), corrupt="text")
    return rows.select("impid", (F.length("text") == 20).eqNullSafe(True).alias("broken"))


@query(
    "a2_taxonomy_csv",
    """select concat('IAB', cast(p_partkey % 26 + 1 as varchar), '-', cast(p_partkey as varchar)) as interest,
      p_name as description from part""",
)
def a2(spark, sf_dir):
    code = F.concat(F.lit("IAB"), F.col("p_partkey") % 26 + 1, F.lit("-"), F.col("p_partkey"))
    path = scratch_path(spark, "taxonomy")
    table(spark, sf_dir, "part").select(
        code.alias("Interest"), F.col("p_name").alias("Description")
    ).write.option("header", True).csv(path)
    return lower_names(readers.read_taxonomy(spark, path))


@query(
    "a3_prediction_csv",
    B + f"select bidfloor > 25 as label, {', '.join(c for c in ALL_SQL.split(', ') if c != chr(34) + 'label' + chr(34))} from bids",
)
def a3(spark, sf_dir):
    requests = bids(spark, sf_dir)
    scored = requests.withColumn("prediction", (F.col("bidfloor") > 25).cast("double"))
    predictions = attach_predictions(scored, requests.columns)
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(predictions, path)
    back = spark.read.schema(predictions.schema).option("header", True).csv(path)
    return lower_names(back)


# --- projections and filters


@query(
    "b1_drop_columns",
    B + 'select apporsite, city, interests, label, media, network, os, publisher, type, "user" from bids',
)
def b1(spark, sf_dir):
    dropped = bids(spark, sf_dir).drop("exchange", "bidfloor", "timestamp", "impid", "size")
    return lower_names(dropped)


@query("b2_select", B + "select impid, interests from bids")
def b2(spark, sf_dir):
    return bids(spark, sf_dir).select("impid", "interests")


@query(
    "b3_with_columns",
    B + """select impid, (case when city is null then 1 else 2 end)::double as city,
      case when city is null then 'not located' else 'located' end as located, label::int as label from bids""",
)
def b3(spark, sf_dir):
    changed = bids(spark, sf_dir).withColumns(
        {
            "located": X.located_name(F.col("city")),
            "city": X.located_code(F.col("city")),
            "label": X.label_int(F.col("label")),
        }
    )
    return changed.select("impid", "city", "located", "label")


@query("b4_rename", B + 'select impid as request, label as cat, "user" as value from bids')
def b4(spark, sf_dir):
    picked = bids(spark, sf_dir).select("impid", "label", "user").toDF("request", "cat", "user")
    return picked.withColumnRenamed("user", "value")


@query("b6_filter_class", B + "select impid, label::int::double as label from bids where label")
def b6(spark, sf_dir):
    label = X.label_double(F.col("label")).alias("label")
    return bids(spark, sf_dir).select("impid", label).filter(F.col("label") == 1.0)


@query(
    "b7_join_group_mean",
    B + """select impid, a.network as cat, bidfloor as value, round(m, 6) as group_mean from bids a
      join (select network, avg(bidfloor) as m from bids group by network) b on a.network = b.network""",
)
def b7(spark, sf_dir):
    rows = bids(spark, sf_dir).select(
        "impid", F.col("network").alias("cat"), F.col("bidfloor").alias("value")
    )
    return with_group_mean(rows, "cat", "value").withColumn("group_mean", F.round("group_mean", 6))


@query("b8_first_rows", B + "select impid, media, os from bids order by impid limit 10")
def b8(spark, sf_dir):
    return bids(spark, sf_dir).select("impid", "media", "os").orderBy("impid").limit(10)


# --- scalar features


def per_request(name: str, expression_sql: str, columns: Callable[[], dict[str, Column]]) -> None:
    """Register a query of (impid, columns) over all bid requests."""

    @query(name, B + f"select impid, {expression_sql} from bids")
    def run(spark, sf_dir):
        return bids(spark, sf_dir).select("impid", *[x.alias(n) for n, x in columns().items()])


c = F.col


def hour() -> Column:
    return X.event_hour(c("timestamp"))


def parts() -> Column:
    return I.split_interests(c("interests"))


per_request(
    "c1_located_code",
    "(case when city is null then 1 else 2 end)::double as city",
    lambda: {"city": X.located_code(c("city"))},
)
per_request(
    "c2_located_name",
    "city, case when city is null then 'not located' else 'located' end as located",
    lambda: {"city": c("city"), "located": X.located_name(c("city"))},
)
per_request(
    "c3_app_or_site_code",
    "(case when apporsite = 'site' then 1 else 2 end)::double as apporsite",
    lambda: {"apporsite": X.app_or_site_code(c("appOrSite"))},
)
per_request(
    "c4a_label_double",
    "label::int::double as label",
    lambda: {"label": X.label_double(c("label"))},
)
per_request("c4b_label_int", "label::int as label", lambda: {"label": X.label_int(c("label"))})
per_request(
    "c5_os_family",
    f"{S.OS_FAMILY} as os_family",
    lambda: {"os_family": X.os_family(c("os"))},
)
per_request(
    "c6_time_parts",
    "strftime(ts, '%Y-%m-%d') as date, strftime(ts, '%H:%M:%S') as event_time, hour(ts)::int as hour",
    lambda: {
        "date": X.event_date(X.event_time(c("timestamp"))),
        "event_time": X.event_clock(X.event_time(c("timestamp"))),
        "hour": hour(),
    },
)
per_request(
    "c7_day_part", f"{S.DAY_PART} as day_part", lambda: {"day_part": X.day_part(hour())}
)
per_request(
    "c8_size_bucket",
    f"{S.SIZE_BUCKET} as size_bucket",
    lambda: {"size_bucket": X.size_bucket(X.size_text(c("size")))},
)
per_request("c9_size_text", "size", lambda: {"size": X.size_text(c("size"))})
per_request(
    "c10_contains_ignoring_case",
    "lower(os) like '%ios%' as is_ios, lower(interests) like '%segment%' as is_segment",
    lambda: {
        "is_ios": X.contains_ignoring_case(c("os"), "iOS"),
        "is_segment": X.contains_ignoring_case(c("interests"), "Segment"),
    },
)
per_request(
    "c11_code_prefix",
    "starts_with(interests, 'IAB') as has_code",
    lambda: {"has_code": I.has_code(c("interests"))},
)
per_request(
    "c12_split_interests",
    """len(string_split(interests, ','))::int as n,
      array_to_string(string_split(interests, ','), '|') as parts""",
    lambda: {
        "n": F.when(c("interests").isNotNull(), F.size(parts())),
        "parts": F.array_join(parts(), "|"),
    },
)
per_request(
    "c13_distinct_names",
    """array_to_string(list_sort(list_distinct(string_split(interests || ',' || interests, ','))), '|')
      as names""",
    lambda: {
        "names": F.array_join(
            F.array_sort(
                F.array_distinct(
                    I.split_interests(F.concat(c("interests"), F.lit(","), c("interests")))
                )
            ),
            "|",
        )
    },
)
per_request(
    "c14_map_elements",
    "array_to_string(list_transform(string_split(interests, ','), lambda x: lower(x)), '|') as lowered",
    lambda: {"lowered": F.array_join(F.transform(parts(), F.lower), "|")},
)
per_request(
    "c15_array_contains",
    "coalesce(list_contains(string_split(interests, ','), 'IAB1'), false)::int as has_iab1",
    lambda: {
        "has_iab1": F.coalesce(F.array_contains(parts(), "IAB1"), F.lit(False)).cast("int")
    },
)
per_request(
    "c16_predicted_click",
    f"{S.DAY_PART} = 1 as click",
    lambda: {"click": X.predicted_click(X.day_part(hour()))},
)
per_request(
    "c17_class_text",
    "case when label then 'true' else 'false' end as class",
    lambda: {"class": X.class_text(X.label_double(c("label")))},
)
per_request(
    "c18_arithmetic",
    """round(bidfloor * bidfloor, 6) as squared, round((bidfloor - 10) * (bidfloor - 10), 6) as deviation,
      round(bidfloor / nullif("timestamp" % 7, 0), 6) as quotient""",
    lambda: {
        "squared": F.round(X.square(c("bidfloor")), 6),
        "deviation": F.round(X.squared_deviation(c("bidfloor"), F.lit(10.0)), 6),
        "quotient": F.round(X.ratio(c("bidfloor"), (c("timestamp") % 7).cast("double")), 6),
    },
)


@query(
    "c19_grand_mean_column",
    B + """select network, count(*) as n, round(avg(bidfloor), 6) as mean,
      round((select avg(bidfloor) from bids), 6) as grand_mean from bids group by network""",
)
def c19(spark, sf_dir):
    groups = group_statistics(bids(spark, sf_dir), "network", "bidfloor")
    grand = group_totals(groups).select(F.col("total") / F.col("n")).scalar()
    return groups.select(
        "network", "n", F.round("mean", 6).alias("mean"), F.round(grand, 6).alias("grand_mean")
    )


@query(
    "c20_row_key",
    B + "select count(*) as n, count(distinct impid) as keys, min(impid) as first, max(impid) as last from bids",
)
def c20(spark, sf_dir):
    """Rows are told apart by the request's own key. Its uniqueness is counted
    per key first, so no task holds all keys."""
    keys = bids(spark, sf_dir).groupBy("impid").agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("keys"),
        F.min("impid").alias("first"),
        F.max("impid").alias("last"),
    )
