"""Checks of the encoders, interest tagging and lookups."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from adclick.checks import sql as S
from adclick.checks.fixture import bids, table, taxonomy, terms
from adclick.checks.registry import query
from adclick.checks.scalar import B, lower_names
from adclick.functions import features as X
from adclick.functions import interests as I
from adclick.operators import multihot
from adclick.operators.asof import asof_join
from adclick.operators.encoders import fit_dictionary, fit_frequency_index
from adclick.operators.intervals import interval_join
from adclick.plans import jobs, models
from adclick.sources import readers, sinks
from adclick.sources.schema import FeatureSpec
from adclick.sources.scratch import scratch_path

DICTIONARY_COLUMNS = ["exchange", "impid", "media", "network", "os", "publisher", "type", "user"]
INDEX_COLUMNS = ["media", "network", "os", "publisher", "type"]
FLAG_LIST = [f"i{k}" for k in range(1, 27)]
FEATURE_SQL = [
    "apporsite", "bidfloor", "city", "exchange", "label", "media", "network", "os", "publisher",
    "size", '"timestamp"', "type", *FLAG_LIST,
]


def with_family(requests):
    return requests.withColumn("os", X.os_family(F.col("os")))


@query(
    "d1_dictionary",
    B + f"""select impid as request_key, {S.code('exchange', 'exchange')}, {S.code('impid', 'impid')},
      {S.code('media', 'media')}, {S.code('network', 'network')}, {S.code(S.OS_FAMILY, 'os')},
      {S.code('publisher', 'publisher')}, {S.code('type', 'type')}, {S.code('"user"', '"user"')} from bids""",
)
def d1(spark, sf_dir):
    requests = with_family(bids(spark, sf_dir))
    encoder = fit_dictionary(requests, DICTIONARY_COLUMNS)
    keyed = requests.select(F.col("impid").alias("request_key"), *DICTIONARY_COLUMNS)
    return encoder.transform(keyed)


@query(
    "d1_dictionary_mapping",
    B + "".join(
        f"""{' union all ' if i else ''}select '{c}' as feature, {e} as value, count(*) as n,
          row_number() over (order by {e} nulls first)::double as code from bids group by {e}"""
        for i, (c, e) in enumerate((("os", S.OS_FAMILY), ("type", "type"), ("user", '"user"')))
    ),
)
def d1_mapping(spark, sf_dir):
    return fit_dictionary(with_family(bids(spark, sf_dir)), ["os", "type", "user"]).mapping


@query(
    "d1_dictionary_unseen",
    B + """, fitted as (select "user" as v, row_number() over (order by "user")::double as code
        from (select distinct "user" from bids where network = 'ASIA'))
      select impid, coalesce(code, 0)::double as "user" from bids left join fitted on "user" = v""",
)
def d1_unseen(spark, sf_dir):
    """Fitted on one network's requests, applied to all: the users of the
    other networks were not seen and are coded 0."""
    requests = bids(spark, sf_dir)
    encoder = fit_dictionary(requests.filter("network = 'ASIA'"), ["user"])
    return encoder.transform(requests.select("impid", "user"))


def _index_sql(column: str, alias: str, source: str) -> str:
    return f"""{alias} as (select v, row_number() over (order by count(*) desc, v) - 1 as code
      from (select {column} as v from {source}) where v is not null group by v)"""


def _indexed(columns: dict[str, str], source: str, key: str) -> str:
    ctes = ", ".join(_index_sql(e, f"x{i}", source) for i, e in enumerate(columns.values()))
    picks = ", ".join(
        f"coalesce((select code from x{i} where v = {e}), (select count(*) from x{i}))::double as {c}"
        for i, (c, e) in enumerate(columns.items())
    )
    return f"{ctes} select {key}, {picks} from {source}"


@query(
    "d2_frequency_index",
    B.rstrip() + ", " + _indexed({c + "index": S.OS_FAMILY if c == "os" else c for c in INDEX_COLUMNS}, "bids", "impid"),
)
def d2(spark, sf_dir):
    requests = with_family(bids(spark, sf_dir)).select("impid", *INDEX_COLUMNS)
    encoder = fit_frequency_index(requests, INDEX_COLUMNS)
    return lower_names(encoder.transform(requests, suffix="Index").drop(*INDEX_COLUMNS))


@query("d2_frequency_index_parts", "with " + _indexed({"p_brand": "p_brand", "p_type": "p_type"}, "part", "p_partkey"))
def d2_parts(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return fit_frequency_index(part, ["p_brand", "p_type"]).transform(part)


# Interest names of each request, as the taxonomy lookup gives them.
NAMES = f"""{S.BIDS}, {S.TAXONOMY},
parts as (select impid, unnest(string_split(interests, ',')) as part,
    generate_subscripts(string_split(interests, ','), 1) as pos from bids),
named as (select impid, min(pos) as pos,
    case when starts_with(part, 'IAB') then lower(coalesce(name, part)) else lower(part) end as name
  from parts left join taxonomy on part = code group by impid, 3),
vocabulary as (select name, row_number() over (order by name) as code from (select distinct name from named))"""


def named_requests(spark, sf_dir):
    parts = bids(spark, sf_dir).select("impid", I.split_interests(F.col("interests")).alias("parts"))
    codes = jobs.taxonomy_map(taxonomy(spark, sf_dir))
    return jobs.interest_names(parts, "parts", codes, "names").drop("parts")


@query(
    "d3_interest_vocabulary",
    f"with {NAMES} select name, code::bigint as code, n from vocabulary join (select name, count(*) as n from named group by name) using (name)",
)
def d3(spark, sf_dir):
    vocabulary = multihot.fit_vocabulary(named_requests(spark, sf_dir), "names")
    return vocabulary.mapping_of("names").select(
        F.col("value").alias("name"), F.col("code").cast("bigint").alias("code"), "n"
    )


@query(
    "d3_interest_indices",
    f"""with {NAMES} select bids.impid, coalesce(string_agg(cast(code as varchar), ' ' order by pos), '') as indices
      from bids left join named on bids.impid = named.impid left join vocabulary using (name) group by bids.impid""",
)
def d3_indices(spark, sf_dir):
    named = named_requests(spark, sf_dir)
    vocabulary = multihot.fit_vocabulary(named, "names")
    indexed = multihot.element_indices(named, "names", vocabulary, "indices")
    return indexed.select("impid", F.array_join(F.col("indices").cast("array<string>"), " ").alias("indices"))


@query(
    "d3_interest_indices_joined",
    f"""with {NAMES} select bids.impid, coalesce(string_agg(cast(code as varchar), ' ' order by pos), '') as indices
      from bids left join named on bids.impid = named.impid left join vocabulary using (name) group by bids.impid""",
)
def d3_indices_joined(spark, sf_dir):
    """The way taken for a vocabulary too long to broadcast."""
    named = named_requests(spark, sf_dir)
    vocabulary = multihot.fit_vocabulary(named, "names")
    indexed = multihot.element_indices(named, "names", vocabulary, "indices", 0, 0)
    return indexed.select("impid", F.array_join(F.col("indices").cast("array<string>"), " ").alias("indices"))


FLAG_TEXT = f"""with {NAMES} select bids.impid, string_agg(case when named.name is null then '0' else '1' end, '' order by code) as flags
  from bids cross join vocabulary left join named on named.impid = bids.impid and named.name = vocabulary.name
  group by bids.impid"""


@query("d4_multi_hot", FLAG_TEXT)
def d4(spark, sf_dir):
    """Every flag of every request, as digits in vocabulary order."""
    named = named_requests(spark, sf_dir)
    names = multihot.vocabulary_names(multihot.fit_vocabulary(named, "names"), "names")
    wide = multihot.multi_hot(named, "names", names)
    return wide.select("impid", F.concat(*multihot.column_names(names)).alias("flags"))


@query("d4_multi_hot_vector", FLAG_TEXT)
def d4_vector(spark, sf_dir):
    named = named_requests(spark, sf_dir)
    names = multihot.vocabulary_names(multihot.fit_vocabulary(named, "names"), "names")
    vectors = multihot.multi_hot_vector(named, "names", names, "flags")
    digits = F.transform(vector_to_array("flags"), lambda x: x.cast("int").cast("string"))
    return vectors.select("impid", F.array_join(digits, "").alias("flags"))


@query("d4_multi_hot_vector_joined", FLAG_TEXT)
def d4_joined(spark, sf_dir):
    """The way taken for a vocabulary too long to collect or broadcast."""
    named = named_requests(spark, sf_dir)
    vocabulary = multihot.fit_vocabulary(named, "names")
    vectors = multihot.sparse_vectors(named, "names", vocabulary, "flags", (), 0, 0)
    digits = F.transform(vector_to_array("flags"), lambda x: x.cast("int").cast("string"))
    return vectors.select("impid", F.array_join(digits, "").alias("flags"))


@query(
    "d5_vector_assembly",
    f"""with {S.FEATURES} select request_key, {', '.join(f'"{c}" as f{i}' for i, c in enumerate(S.MODEL_COLUMNS))} from features""",
)
def d5(spark, sf_dir):
    features = feature_table(spark, sf_dir)
    spec = model_spec(features)
    values = vector_to_array("features")
    columns = [values[i].alias(f"f{i}") for i in range(len(spec.columns))]
    return models.assemble(features, spec, "keep").select("request_key", *columns)


@query(
    "d5_one_hot_vector",
    f"""with {S.FEATURES}, codes as (select c from range(0, 1000) t(c))
      select request_key, bidfloor,
        (select string_agg(case when c = os then '1' else '0' end, '' order by c) from codes where c <= (select max(os) from features)) || '0' as os,
        (select string_agg(case when c = media then '1' else '0' end, '' order by c) from codes where c <= (select max(media) from features)) || '0' as media
      from features""",
)
def d5_one_hot(spark, sf_dir):
    """Two coded columns as flags; the last flag is for codes not seen."""
    features = feature_table(spark, sf_dir)
    stages = models.vector_stages(FeatureSpec(("bidfloor", "os", "media")), ["os", "media"])
    vectors = Pipeline(stages=stages).fit(features).transform(features)
    flags = {c: F.array_join(F.transform(vector_to_array(f"{c}__hot"), lambda x: x.cast("int").cast("string")), "") for c in ("os", "media")}
    return vectors.select("request_key", vector_to_array("features")[0].alias("bidfloor"), *[x.alias(c) for c, x in flags.items()])


def feature_table(spark, sf_dir, coded=jobs.CODED):
    return feature_table_of(spark, sf_dir, bids(spark, sf_dir), coded)


def feature_table_of(spark, sf_dir, requests, coded=jobs.CODED):
    return jobs.fit_features(requests, terms(spark, sf_dir), coded).transform(requests)


def model_spec(features) -> FeatureSpec:
    """The default columns without the event type, which gives the label away."""
    spec = FeatureSpec.excluding(features.columns)
    return FeatureSpec.excluding(spec.columns, ["type"])


@query("b5_feature_columns", f"with {S.FEATURES} select {', '.join(FEATURE_SQL[i] for i in (0, 2, 5, 6, 7, 9, 10, 11))}, {S.FLAG_NAMES}, request_key, label from features")
def b5(spark, sf_dir):
    features = feature_table(spark, sf_dir)
    return lower_names(FeatureSpec.excluding(features.columns).select(features))


@query("a4_feature_parquet", f"with {S.FEATURES} select request_key, {', '.join(FEATURE_SQL)} from features")
def a4_parquet(spark, sf_dir):
    features = feature_table(spark, sf_dir)
    path = scratch_path(spark, "features")
    sinks.write_features(features, path)
    return lower_names(readers.read_features(spark, path, features.schema))


@query("a4_feature_csv", f"with {S.FEATURES} select request_key, {', '.join(FEATURE_SQL)} from features")
def a4_csv(spark, sf_dir):
    features = feature_table(spark, sf_dir)
    path = scratch_path(spark, "features")
    sinks.write_features(features, path, "csv")
    return lower_names(readers.read_features(spark, path, features.schema, "csv"))


# --- interest tagging


_DOCUMENT_FLAGS = f"""with {S.TERMS} select doc_id, {S.flag_columns()}
  from documents left join terms on contains('[' || lower(text) || ']', term) group by doc_id"""


@query("e1_interest_flags_term_table", f"with {S.BIDS}, {S.TERMS}, {S.FLAGS} select * from flags")
def e1_term_table(spark, sf_dir):
    """The terms as a table that meets the texts in a join."""
    requests = bids(spark, sf_dir).select("impid", "interests")
    return I.tag(requests, "interests", I.category_term_table(taxonomy(spark, sf_dir))).drop("interests")


@query("e1_document_flags_term_table", _DOCUMENT_FLAGS)
def e1_documents_term_table(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return I.tag(documents, "text", I.category_term_table(taxonomy(spark, sf_dir))).drop("text")


@query("e1_document_flags_term_table_shuffled", _DOCUMENT_FLAGS)
def e1_documents_shuffled(spark, sf_dir):
    """The way taken for tables too large to broadcast."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    terms_ = I.category_term_table(taxonomy(spark, sf_dir))
    return I.tag_by_table(documents, "text", terms_, broadcast_bytes=0).drop("text")


@query("e1_interest_flags_substring", f"with {S.BIDS}, {S.TERMS}, {S.FLAGS} select * from flags")
def e1(spark, sf_dir):
    requests = bids(spark, sf_dir).select("impid", "interests")
    return I.tag(requests, "interests", terms(spark, sf_dir)).drop("interests")


@query("e1_document_flags", _DOCUMENT_FLAGS)
def e1_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return I.tag(documents, "text", terms(spark, sf_dir)).drop("text")


@query(
    "e2_interest_flags_token",
    f"""with {S.BIDS}, {S.TERMS},
      tokens as (select impid, trim(unnest(string_split(lower(interests), ','))) as token from bids)
      select bids.impid, {S.flag_columns()} from bids left join tokens on bids.impid = tokens.impid
        left join terms on token = term or (term = 'iab' || cast(k as varchar) and starts_with(token, term || '-'))
      group by bids.impid""",
)
def e2(spark, sf_dir):
    requests = bids(spark, sf_dir).select("impid", "interests")
    return I.tag(requests, "interests", terms(spark, sf_dir), "token").drop("interests")


@query(
    "e3_taxonomy_names",
    f"""with {NAMES} select bids.impid, coalesce(string_agg(name, '|' order by pos), '') as names
      from bids left join named on bids.impid = named.impid group by bids.impid""",
)
def e3(spark, sf_dir):
    return named_requests(spark, sf_dir).select("impid", F.array_join("names", "|").alias("names"))


# Requests some of which have no key and some the same one.
ODD_KEY = "case cast(bids.impid as bigint) % 5 when 0 then null when 1 then 'again' else bids.impid end"


def odd_keys(requests):
    number = F.col("impid").cast("bigint") % 5
    key = F.when(number == 0, None).when(number == 1, "again").otherwise(F.col("impid"))
    return requests.withColumn("impid", key)


def _odd_names(literal_entries):
    def run(spark, sf_dir):
        requests = odd_keys(bids(spark, sf_dir))
        parts = requests.select("impid", I.split_interests(F.col("interests")).alias("parts"))
        codes = jobs.taxonomy_map(taxonomy(spark, sf_dir), literal_entries)
        named = jobs.interest_names(parts, "parts", codes, "names")
        return named.select("impid", F.array_join("names", "|").alias("names"))

    return run


_ODD_NAMES = f"""with {NAMES} select {ODD_KEY} as impid, coalesce(string_agg(name, '|' order by pos), '') as names
  from bids left join named on bids.impid = named.impid group by bids.impid"""
query("e3_taxonomy_names_odd_keys", _ODD_NAMES)(_odd_names(1024))
query("e3_taxonomy_names_odd_keys_joined", _ODD_NAMES)(_odd_names(0))


@query(
    "d3_interest_indices_odd_keys",
    f"""with {NAMES} select {ODD_KEY} as impid, coalesce(string_agg(cast(code as varchar), ' ' order by pos), '') as indices
      from bids left join named on bids.impid = named.impid left join vocabulary using (name) group by bids.impid""",
)
def d3_indices_odd_keys(spark, sf_dir):
    named = odd_keys(named_requests(spark, sf_dir))
    vocabulary = multihot.fit_vocabulary(named, "names")
    indexed = multihot.element_indices(named, "names", vocabulary, "indices", 0, 0)
    return indexed.select("impid", F.array_join(F.col("indices").cast("array<string>"), " ").alias("indices"))


# --- joins


@query("f1_carried_key", B + "select impid, bidfloor > 25 as label, os, media from bids")
def f1(spark, sf_dir):
    """Predictions meet their requests by staying in one row, even across a
    shuffle that would break any generated row number."""
    requests = bids(spark, sf_dir).repartition(7, "media")
    scored = requests.withColumn("prediction", (F.col("bidfloor") > 25).cast("double"))
    return models.attach_predictions(scored, requests.columns).select("impid", "label", "os", "media")


@query(
    "f4_dimension_lookup",
    """with dim as (select c_mktsegment, row_number() over (order by c_mktsegment)::double as code
        from (select distinct c_mktsegment from customer))
      select o_orderkey, code as segment from orders join customer on o_custkey = c_custkey join dim using (c_mktsegment)""",
)
def f4(spark, sf_dir):
    """The fitted dictionary as a dimension of another table."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    encoder = fit_dictionary(customer, ["c_mktsegment"])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return encoder.transform(joined).select("o_orderkey", F.col("c_mktsegment").alias("segment"))


@query(
    "f4_shuffled_lookup",
    B + f"select impid as request_key, {S.code('type', 'type')}, {S.code('\"user\"', '\"user\"')} from bids",
)
def f4_shuffled(spark, sf_dir):
    """The way taken for a dictionary too large to broadcast: hot values are
    answered from a bounded table, the rest joined by shuffle."""
    requests = bids(spark, sf_dir).select(F.col("impid").alias("request_key"), "type", "user")
    return fit_dictionary(requests, ["type", "user"]).transform(requests, broadcast_bytes=0)


# --- joins by time


@query(
    "f5_last_earlier_event",
    """select events.event_id, events.user_id, last.event_id as last_event_id, last.event_type as last_event_type, last.value as last_value
      from events left join lateral (select event_id, event_type, value from events e
        where e.user_id = events.user_id and e.ts < events.ts order by e.ts desc, e.event_id desc limit 1) last on true""",
)
def f5_asof(spark, sf_dir):
    """Each event with the latest earlier one of its user."""
    events = table(spark, sf_dir, "events")
    return asof_join(
        events.select("event_id", "user_id", "ts"), events, "user_id", "ts", "ts", ["event_id", "event_type", "value"],
        ties=["event_id"], strict=True,
    ).drop("ts")


@query(
    "f5_last_event_of_a_hot_key",
    """with kinds as (select o_orderkey, o_orderdate + interval 10 year as moment, case when o_orderkey % 4 = 0 then 'click' else 'view' end as kind from orders),
      timed as (select event_type, ts, event_id, lead(ts) over (partition by event_type order by ts, event_id) as until from events)
      select o_orderkey, event_id as last_event_id from kinds left join timed
        on event_type = kind and ts <= moment and (until is null or moment < until)""",
)
def f5_hot(spark, sf_dir):
    """Two keys for all orders and events, which many ranges share."""
    kind = F.when(F.col("o_orderkey") % 4 == 0, "click").otherwise("view")
    at = F.col("o_orderdate") + F.expr("interval 10 years")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), at.alias("at"))
    events = table(spark, sf_dir, "events")
    joined = asof_join(orders, events.withColumnRenamed("event_type", "kind"), "kind", "at", "ts", ["event_id"], ties=["event_id"], range_rows=500)
    return joined.select("o_orderkey", "last_event_id")


_FLIGHTS = """flights as (select event_id as flight_id, user_id, ts as a,
    ts + to_hours(cast(regexp_extract(props, '([0-9]+)', 1) as int) * case when event_id % 10 = 0 then 100 else 1 end) as b
  from events where event_type = 'purchase')"""


def _flights(events):
    hours = F.regexp_extract("props", "([0-9]+)", 1).cast("int") * F.when(F.col("event_id") % 10 == 0, 100).otherwise(1)
    end = F.timestamp_add("HOUR", hours, F.col("ts"))
    bought = events.where("event_type = 'purchase'")
    return bought.select(F.col("event_id").alias("flight_id"), "user_id", F.col("ts").alias("a"), end.alias("b"))


@query(
    "f6_events_in_flight",
    f"""with {_FLIGHTS} select event_id, flight_id from events join flights
      on events.user_id = flights.user_id and ts >= a and ts < b""",
)
def f6_intervals(spark, sf_dir):
    """Events of a user within the windows that the user's purchases open."""
    events = table(spark, sf_dir, "events")
    met = interval_join(events.select("event_id", "user_id", "ts"), _flights(events), "ts", "a", "b", "user_id")
    return met.select("event_id", F.col("interval_flight_id").alias("flight_id"))


@query(
    "f6_flights_by_day",
    f"""with {_FLIGHTS}, days as (select distinct date_trunc('day', ts)::timestamp as day from events)
      select strftime(day, '%Y-%m-%d') as day, count(*) as flights from days join flights on day >= a and day < b group by day""",
)
def f6_by_day(spark, sf_dir):
    """Flights open at the beginning of each day, without a key."""
    events = table(spark, sf_dir, "events")
    days = events.select(F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("day")).distinct()
    met = interval_join(days, _flights(events), "day", "a", "b")
    return met.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("flights"))
