"""One query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adclick.llm import language_id, license_scan, quality, toxicity
from adclick.llm.bpe import encode_and_decode
from adclick.llm.decontaminate import find_benchmark
from adclick.llm.folds import held_out
from adclick.llm.hard_negatives import mine_negatives
from adclick.llm.line_dedup import drop_lines
from adclick.llm.merkle import edit_report
from adclick.llm.near_dedup import near_duplicates
from adclick.llm.registry import QUERIES, SQL, query  # noqa: F401
from adclick.llm.runs import find_runs
from adclick.llm.substring_dedup import remove_repeated
from adclick.llm.tables import table
from adclick.llm.url_filter import Rule, judge

#: The rules for pages.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


@query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited copy."""
    return edit_report(table(spark, sf_dir, "documents"))


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that each document is of good quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    apart = held_out("doc_id", 5, 0)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "doc_id", ~apart)
    found = quality.score(docs, model)
    return found.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that each document is toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    apart = held_out("doc_id", 5, 0)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "doc_id", ~apart)
    found = toxicity.score(docs, model)
    return found.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


_OP4_SQL = """
with parts as (
  select page_id, url,
    case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest
  from pages),
split as (
  select page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts),
ruled as (
  select *, case
      when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/')
        then 'www.example.com/en/'
      when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/')
        then 'example.com/en/'
      when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
      when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
      when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/'
    end as rule
  from split),
judged as (
  select *, case when rule in ('www.example.com/en/', 'com/') then 'allow' when rule is not null then 'block' end as kind
  from ruled),
urls as (select distinct coalesce(url, '') as url, kind from judged),
padded as (select url, kind, concat('^^^', url, '$') as p from urls),
places as (select url, kind, p, unnest(range(1, length(p) - 2)) as i from padded),
groups as (select url, kind, substr(p, i, 4) as g from places),
counts as (
  select g, count(*) filter (kind = 'allow') as a, count(*) filter (kind = 'block') as r from groups group by g),
total as (select sum(a) as ta, sum(r) as tr, count(distinct substr(g, 4, 1)) as v from counts),
p0 as (
  select substr(g, 4, 1) as g, (sum(a) + 1.0) / (any_value(ta) + any_value(v)) as pa,
    (sum(r) + 1.0) / (any_value(tr) + any_value(v)) as pr
  from counts, total group by 1),
g1 as (select substr(g, 3, 2) as g, sum(a) as a, sum(r) as r from counts group by 1),
p1 as (
  select x.g, (x.a + p.pa) / (sum(x.a) over w + 1.0) as pa, (x.r + p.pr) / (sum(x.r) over w + 1.0) as pr
  from g1 x join p0 p on p.g = substr(x.g, 2) window w as (partition by substr(x.g, 1, 1))),
g2 as (select substr(g, 2, 3) as g, sum(a) as a, sum(r) as r from counts group by 1),
p2 as (
  select x.g, (x.a + p.pa) / (sum(x.a) over w + 1.0) as pa, (x.r + p.pr) / (sum(x.r) over w + 1.0) as pr
  from g2 x join p1 p on p.g = substr(x.g, 2) window w as (partition by substr(x.g, 1, 2))),
p3 as (
  select x.g, (x.a + p.pa) / (sum(x.a) over w + 1.0) as pa, (x.r + p.pr) / (sum(x.r) over w + 1.0) as pr
  from counts x join p2 p on p.g = substr(x.g, 2) window w as (partition by substr(x.g, 1, 3))),
scores as (
  select url, kind, avg(ln(pa) - ln(pr)) as score from groups join p3 using (g) group by url, kind),
sides as (
  select avg(score) filter (kind = 'allow') as ma, stddev_pop(score) filter (kind = 'allow') + 1e-9 as sa,
    avg(score) filter (kind = 'block') as mr, stddev_pop(score) filter (kind = 'block') + 1e-9 as sr
  from scores),
free as (select url, score from scores where kind is null)
select j.page_id, j.host, j.path, j.rule,
  coalesce(j.kind, case when ma is null or mr is null or f.score >= (ma * sr + mr * sa) / (sa + sr)
    then 'allow' else 'block' end) as verdict
from judged j cross join sides left join free f on j.kind is null and f.url = coalesce(j.url, '')
"""


@query("op4_url_filters", _OP4_SQL)
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each page's URL, by rule or by language model."""
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op5_license_scans")
def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence families stated in each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan_licenses(docs, license_scan.fit(docs, "doc_id"))
    families = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"])))
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("licenses").cast("bigint").alias("n_licensed"),
        F.array_join(families, ",").alias("families"),
        F.round(F.array_max(F.transform("licenses", lambda x: x["score"])), 6).alias("score"),
    )


@query("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of each document after repeated windows are removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = remove_repeated(docs, key="doc_id")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op8_near_dedup")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of each document."""
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", size=3, percent=85)


@query("op9_benchmark_decontamination")
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark words in each document, and the items they come from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"), window=10)
    ids = F.coalesce(F.transform("matches", lambda m: m["item_id"]), F.array().cast("array<string>"))
    ids = F.array_compact(ids)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "matches",
    )


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the text decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = encode_and_decode(docs, path, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    apart = held_out("doc_id", 4, 2)
    network = language_id.fit(docs, "doc_id", ~apart)
    found = language_id.identify(docs.drop("lang"), network)
    return found.select("doc_id", apart.alias("held_out"), "lang_pred", "score")


def _made_periodic(key: str, text: str) -> Column:
    """For ids whose checksum ends in 0, the text's words repeated from some
    word on; the checksum gives that word and the period."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(words)
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.slice(words, a + 1, p)
    times = F.floor((n - a) / p).cast("int")
    periodic = F.concat(F.slice(words, F.lit(1), a), F.flatten(F.array_repeat(block, times)), F.slice(block, F.lit(1), (n - a) % p))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(periodic, " ")).otherwise(F.col(text))


@query("op11_runs")
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of each document's words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _made_periodic("doc_id", "text").alias("text"))
    found = find_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["start"]).alias("start"),
        best["length"].alias("length"),
        (-best["period"]).alias("period"),
        F.floor(1000 * best["length"] / -best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_OP12_SQL = """
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
lines as (select doc_id, unnest(parts) as line, unnest(range(len(parts))) as pos from split),
keyed as (
  select *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
firsts as (select k, min(doc_id) as first_id from keyed where length(k) >= 10 group by k),
marked as (
  select doc_id, line, pos, coalesce(first_id <> doc_id, false) as gone
  from keyed left join firsts using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""


@query("op12_line_dedup", _OP12_SQL)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the lines that an earlier one holds."""
    kept = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_OP13_SQL = """
with sound as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * cast(x as double)) for x in embedding] as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
anchors as (select * from sound where vec_id % 100 = 0),
scored as (
  select a.vec_id as anchor_id, r.vec_id as id, a.label = r.label as alike,
    cast(list_inner_product(a.q, r.q) as bigint) as score
  from anchors a join sound r on a.vec_id <> r.vec_id),
positives as (
  select anchor_id, id as positive_id, score as positive_score from scored where alike
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
ranked as (
  select p.anchor_id, p.positive_id, n.id as negative_id, p.positive_score, n.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.id) as rank
  from positives p join scored n on n.anchor_id = p.anchor_id and not n.alike
    and 100 * n.score between 30 * p.positive_score and 90 * p.positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score
from ranked where rank <= 10
"""


@query("op13_hard_negatives", _OP13_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
