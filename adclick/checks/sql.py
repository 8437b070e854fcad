"""SQL building blocks, written apart from the Spark code they check."""

from __future__ import annotations

# The public top-level names, and the words searched in place of
# compound names, written out here so that a slip in the library shows.
_TOP_LEVEL = """values
    ('IAB1', 'Arts & Entertainment'),
    ('IAB2', 'Automotive'),
    ('IAB3', 'Business'),
    ('IAB4', 'Careers'),
    ('IAB5', 'Education'),
    ('IAB6', 'Family & Parenting'),
    ('IAB7', 'Health & Fitness'),
    ('IAB8', 'Food & Drink'),
    ('IAB9', 'Hobbies & Interests'),
    ('IAB10', 'Home & Garden'),
    ('IAB11', 'Law & Government & Politics'),
    ('IAB12', 'News'),
    ('IAB13', 'Personal Finance'),
    ('IAB14', 'Society'),
    ('IAB15', 'Science'),
    ('IAB16', 'Pets'),
    ('IAB17', 'Sports'),
    ('IAB18', 'Style & Fashion'),
    ('IAB19', 'Technology & Computing'),
    ('IAB20', 'Travel'),
    ('IAB21', 'Real Estate'),
    ('IAB22', 'Shopping'),
    ('IAB23', 'Religion & Spirituality'),
    ('IAB24', 'Uncategorized'),
    ('IAB25', 'Non-Standard Content'),
    ('IAB26', 'Illegal Content')"""
_HEAD_WORDS = """values
    ('arts & entertainment', 'arts'),
    ('arts & entertainment', 'entertainment'),
    ('books & literature', 'books'),
    ('books & literature', 'literature'),
    ('family & parenting', 'family'),
    ('family & parenting', 'parenting'),
    ('health & fitness', 'health'),
    ('health & fitness', 'fitness'),
    ('food & drink', 'food'),
    ('food & drink', 'drink'),
    ('hobbies & interests', 'hobbies'),
    ('hobbies & interests', 'interest'),
    ('home & garden', 'home'),
    ('home & garden', 'garden'),
    ('law & government & politics', 'law'),
    ('law & government & politics', 'politics'),
    ('pets', 'pet'),
    ('sports', 'sport'),
    ('style & fashion', 'style'),
    ('style & fashion', 'fashion'),
    ('technology & computing', 'technology'),
    ('technology & computing', 'computing'),
    ('religion & spirituality', 'religion'),
    ('religion & spirituality', 'spirituality')"""

BIDS = """bids as (
  select case when k % 2 = 0 then 'site' else 'app' end as apporsite,
    value as bidfloor,
    case when user_id % 3 = 0 then null else n_name end as city,
    n_name as exchange,
    cast(event_id as varchar) as impid,
    case when k % 11 = 0 then null when k % 11 = 1 then 'Custom Segment'
      else concat('IAB', cast(1 + user_id % 26 as varchar), ',IAB',
                  cast(1 + k % 26 as varchar), '-1,', c_mktsegment) end as interests,
    event_type = 'click' as label,
    c_mktsegment as media,
    r_name as network,
    case k % 7 when 0 then 'Android 9' when 1 then 'iOS 13' when 2 then 'WindowsPhone'
      when 3 then 'ANDROID' when 4 then null when 5 then 'BlackBerry' else 'ios' end as os,
    concat('pub', cast(k % 40 as varchar)) as publisher,
    case k % 6 when 0 then '[320, 50]' when 1 then '[300, 250]' when 2 then '[640, 360]'
      when 3 then '[320, 480]' when 4 then '[768, 1024]' else null end as size,
    cast(floor(epoch(ts)) as bigint) as "timestamp",
    ts,
    case when k % 10 = 9 then null else event_type end as type,
    c_name as "user"
  from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events) e
    join customer on user_id = c_custkey
    join nation on c_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey)"""

OS_FAMILY = """case when lower(os) like '%android%' then 'android' when lower(os) like '%ios%' then 'ios'
    when lower(os) like '%windows%' then 'windows' else 'other' end"""

DAY_PART = """case when hour(ts) < 6 then 0.0 when hour(ts) < 12 then 1.0
    when hour(ts) < 17 then 3.0 when hour(ts) < 24 then 4.0 else 5.0 end::double"""

# The sizes of each bucket.
SIZE_BUCKET = """(case
    when size in ('[380, 214]', '[358, 201]', '[343, 193]', '[288, 162]', '[291, 164]', '[300, 169]',
      '[569, 320]', '[600, 350]', '[328, 185]', '[640, 360]', '[306, 172]', '[1280, 720]') then 0
    when size = '[320, 480]' then 1
    when size in ('[325, 183]', '[320, 50]', '[320, 250]', '[300, 250]') then 2
    when size in ('[480, 320]', '[610, 390]') then 3
    when size = '[500, 300]' then 4
    when size = '[768, 1024]' then 5 else 6 end)::double"""


def unit(key: str, salt: str) -> str:
    digits = f"'0x' || substr(md5('{salt}:' || cast({key} as varchar)), 1, 13)"
    return f"(cast({digits} as bigint)::double / 4503599627370496::double)"


TAXONOMY = f"""taxonomy as (
  select * from ({_TOP_LEVEL}) t(code, name)
  union all select 'IAB' || cast(n_nationkey + 1 as varchar) || '-1', n_name from nation
  union all select 'IAB' || cast(length(name) % 26 + 1 as varchar) || '-' || name, name from (
    select p_name as name from part union select p_brand || ' ' || p_type from part
    union select p_type || ' ' || cast(p_size as varchar) from part))"""

TERMS = f"""{TAXONOMY},
heads as (select * from ({_HEAD_WORDS}) t(name, word)),
terms as (
  select distinct cast(regexp_extract(code, '^IAB([0-9]+)', 1) as int) as k,
    coalesce(word, lower(taxonomy.name)) as term
  from taxonomy left join heads on lower(taxonomy.name) = heads.name
  union select range, 'iab' || cast(range as varchar) from range(1, 27))"""


def flag_columns(prefix: str = "i") -> str:
    return ", ".join(
        f"max(case when k = {k} then 1 else 0 end)::double as {prefix}{k}" for k in range(1, 27)
    )


FLAG_NAMES = ", ".join(f"i{k}" for k in range(1, 27))

FLAGS = f"""flags as (
  select impid, {flag_columns()}
  from (select impid, '[' || lower(coalesce(interests, 'null')) || ']' as text from bids) b
    left join terms on contains(text, term)
  group by impid)"""


def code(column: str, alias: str) -> str:
    return f"dense_rank() over (order by {column} nulls first)::double as {alias}"


FEATURES = f"""{BIDS}, {TERMS}, {FLAGS},
features as (
  select bids.impid as request_key,
    (case when apporsite = 'site' then 1 else 2 end)::double as apporsite,
    bidfloor,
    (case when city is null then 1 else 2 end)::double as city,
    {code('exchange', 'exchange')},
    {code('bids.impid', 'impid')},
    label::int::double as label,
    {code('media', 'media')},
    {code('network', 'network')},
    {code(OS_FAMILY, 'os')},
    {code('publisher', 'publisher')},
    {SIZE_BUCKET} as size,
    {DAY_PART} as "timestamp",
    {code('type', 'type')},
    {code('"user"', '"user"')},
    {FLAG_NAMES}
  from bids join flags on bids.impid = flags.impid)"""

# The columns the models of the checks use: no identifiers, nothing screened
# out, and not the event type, which gives the label away.
MODEL_COLUMNS = [
    "apporsite", "city", "media", "network", "os", "size", "timestamp",
    *[f"i{k}" for k in range(1, 27)],
]


_COLUMNS = ", ".join(f'"{c}"' for c in MODEL_COLUMNS)


def parts(fraction: str) -> str:
    """Split the features and balance the training part."""
    return f"""{FEATURES},
parts as (select *, {unit('request_key', 'split36')} < 0.8 as train,
    {unit('request_key', 'down36')} as u from features),
share as (select {fraction} as f from parts where train),
balanced as (select parts.* from parts cross join (select max(f) as f from share) where train
    and (label = 1 or (label = 0 and u < f)))"""


def stump(fraction: str) -> str:
    """The one cut of one feature that leaves the least Gini impurity; where both
    sides get the same class, as the library prunes it, there is no cut."""
    impurity = "ln * (lp / ln) * (1 - lp / ln) + (n - ln) * ((p - lp) / (n - ln)) * (1 - (p - lp) / (n - ln))"
    return f"""{parts(fraction)},
tallies as (select feature, v, count(*)::double as n, count_if(label = 1)::double as p
  from (select label, name as feature, v from (select label, {_COLUMNS} from balanced)
    unpivot (v for name in ({_COLUMNS}))) group by feature, v),
cuts as (select feature, v, sum(n) over w as ln, sum(p) over w as lp, sum(n) over (partition by feature) as n,
    sum(p) over (partition by feature) as p, lead(v) over w as after
  from tallies window w as (partition by feature order by v)),
cut as (select feature, v, lp / ln as below, (p - lp) / (n - ln) as above, p / n as whole from cuts where after is not null
  order by round({impurity}, 9), feature, v limit 1),
best as (select feature, v, case when (below > 0.5) = (above > 0.5) then whole else below end as below,
    case when (below > 0.5) = (above > 0.5) then whole else above end as above from cut),
sides as (select request_key, train, label, case when long.v <= best.v then below else above end as p
  from (select request_key, train, label, name as feature, v
    from (select request_key, train, label, {_COLUMNS} from parts) unpivot (v for name in ({_COLUMNS}))) long
    join best using (feature)),
scored as (select *, (p > 0.5)::int::double as prediction from sides)"""


def logit(column: str, fraction: str, penalty: float = 0.3) -> str:
    """Logistic regression on one column by Newton steps over its values; the
    penalty is on the standardised weight. Needs ``with recursive``."""
    p = "(1 / (1 + exp(-(b + w * x))))"
    return f"""{parts(fraction)},
tallies as (select {column} as x, count(*)::double as n, count_if(label = 1)::double as y from balanced group by 1),
scale as (select count(*)::double as total, {penalty} * var_samp({column}) as ridge from balanced),
newton as (
  select 0 as step, 0::double as b, 0::double as w
  union all
  select step + 1, b - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), w - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12)
  from (select step, b, w, sum(n * {p} - y) / max(total) as g1, sum((n * {p} - y) * x) / max(total) + max(ridge) * w as g2,
      sum(n * {p} * (1 - {p})) / max(total) as h11, sum(n * {p} * (1 - {p}) * x) / max(total) as h12,
      sum(n * {p} * (1 - {p}) * x * x) / max(total) + max(ridge) as h22
    from newton cross join tallies cross join scale where step < 25 group by step, b, w)),
fitted as (select b, w from newton where step = 25),
sides as (select request_key, train, label, 1 / (1 + exp(-(b + w * {column}))) as p from parts cross join fitted),
scored as (select *, (p > 0.5)::int::double as prediction from sides)"""


def naive_bayes(fraction: str = "0.03") -> str:
    """Split, balance and fit naive Bayes by counting; score every request."""
    columns = _COLUMNS
    return f"""{parts(fraction)},
long as (select request_key, train, label, name as feature, v
  from (select request_key, train, label, {columns} from parts)
  unpivot (v for name in ({columns}))),
sums as (select label as class, feature, sum(v) as s
  from long where request_key in (select request_key from balanced) group by all),
priors as (select label as class, ln(count(*) + 1) - ln((select count(*) from balanced) + 2) as log_prior
  from balanced group by label),
params as (select class, feature, log_prior,
    ln(s + 1) - ln(sum(s) over (partition by class) + {len(MODEL_COLUMNS)}) as log_likelihood
  from sums join priors using (class)),
joint as (select request_key, train, label, class, max(log_prior) + sum(v * log_likelihood) as score
  from long join params using (feature) group by request_key, train, label, class),
scored as (select request_key, any_value(train) as train, any_value(label) as label,
    arg_max(class, score) as prediction,
    1 / (1 + exp(max(case when class = 0 then score end) - max(case when class = 1 then score end))) as p
  from joint group by request_key)"""


# From these 16-bit numbers on a row is at least once, twice, …
# in a bag, its times being Poisson(1).
_BAG = (24110, 48219, 60274, 64292, 65297, 65497, 65531, 65536)


def forest(fraction: str, trees: int, depth: int = 5, drawn: int | None = None, seed: int = 12345) -> str:
    """Trees grown level by level on the features in order: ``drawn`` of them a
    node (all if null) by least hash, rows weighed by their bags unless there is one
    tree. Ends in ``nodes`` and ``scored``."""
    u = f"cast('0x' || substr(md5('bag{seed}:' || (tree // 8) || ':' || request_key), tree % 8 * 4 + 1, 4) as int)"
    weight = " + ".join(f"(({u}) >= {b})::int" for b in _BAG) if trees > 1 else "1"
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(MODEL_COLUMNS))
    hashed = f"row_number() over (partition by tree, node order by md5('{seed}:' || tree || ':' || node || ':' || f))"
    draw = f"qualify {hashed} <= {drawn}" if drawn else ""
    square = lambda a, b, n: f"({a} * {a} + {b} * {b}) / {n}"
    gain = f"round(({square('l0', 'l1', 'n')} + {square('(a0 - l0)', '(a1 - l1)', '(m - n)')} - {square('a0', 'a1', 'm')}) / m, 12)"
    ctes = [
        f"""{parts(fraction)},
names as (select * from (values {names}) t(f, feature)),
flat as materialized (select request_key, f, v from (select request_key, name as feature, v
    from (select request_key, {_COLUMNS} from parts) unpivot (v for name in ({_COLUMNS}))) join names using (feature)),
edges as (select f, v, (v + lead(v) over w) / 2 as cut, row_number() over w - 1 as bin
  from (select distinct f, v from flat semi join balanced using (request_key)) window w as (partition by f order by v)),
binned as materialized (select request_key, f, bin from flat semi join balanced using (request_key) join edges using (f, v)),
bags as (select request_key, label, tree::int as tree, {weight} as w from balanced cross join (select range as tree from range({trees}))),
state0 as materialized (select request_key, label, tree, w, 1 as node from bags where w > 0)"""
    ]
    for d in range(depth + 1):
        ctes.append(
            f"""level{d} as materialized (select tree, node, coalesce(sum(w) filter (label = 0), 0)::double as c0,
    coalesce(sum(w) filter (label = 1), 0)::double as c1 from state{d} group by tree, node)"""
        )
        if d == depth:
            break
        ctes.append(
            f"""drawn{d} as (select tree, node, f from level{d} cross join names {draw}),
hist{d} as (select tree, node, f, bin, coalesce(sum(w) filter (label = 0), 0)::double as c0,
    coalesce(sum(w) filter (label = 1), 0)::double as c1
  from state{d} join drawn{d} using (tree, node) join binned using (request_key, f) group by tree, node, f, bin),
sides{d} as (select tree, node, f, bin, sum(c0) over w as l0, sum(c1) over w as l1, sum(c0) over p as a0,
    sum(c1) over p as a1, lead(bin) over w as after, l0 + l1 as n, a0 + a1 as m
  from hist{d} window w as (partition by tree, node, f order by bin), p as (partition by tree, node, f)),
best{d} as materialized (select tree, node, f, bin, {gain} as gain from sides{d} where after is not null and gain > 0
  qualify row_number() over (partition by tree, node order by gain desc, f, bin) = 1),
state{d + 1} as materialized (select state{d}.request_key, label, state{d}.tree, w,
    2 * state{d}.node + (binned.bin > best{d}.bin)::int as node
  from state{d} join best{d} using (tree, node) join binned on binned.request_key = state{d}.request_key and binned.f = best{d}.f)"""
        )
    ctes.append(f"ends{depth} as (select tree, node, c0, c1 from level{depth})")
    for d in reversed(range(depth)):
        ctes.append(
            f"""given_up{d} as (select b.tree, b.node from best{d} b join ends{d + 1} e on e.tree = b.tree and e.node // 2 = b.node
  group by all having count(*) = 2 and min((e.c1 > e.c0)::int) = max((e.c1 > e.c0)::int)),
ends{d} as (select tree, node, c0, c1 from level{d} anti join (select tree, node from best{d} anti join given_up{d} using (tree, node)) s using (tree, node)),
split{d} as materialized (select * from best{d} anti join given_up{d} using (tree, node))"""
        )
    # leaves below a node that was given up are no part of the tree
    live, walks = ["select tree::int as tree, 1 as node from range(0, %d) t(tree)" % trees], []
    ctes.append(f"live0 as ({live[0]})")
    walks.append("walk0 as (select request_key, tree, 1 as node from parts cross join live0)")
    for d in range(depth):
        ctes.append(f"live{d + 1} as (select tree, unnest([2 * node, 2 * node + 1]) as node from live{d} semi join split{d} using (tree, node))")
        walks.append(
            f"""walk{d + 1} as materialized (select walk{d}.request_key, walk{d}.tree, 2 * walk{d}.node + (flat.v > edges.cut)::int as node
  from walk{d} join split{d} using (tree, node) join edges on edges.f = split{d}.f and edges.bin = split{d}.bin
    join flat on flat.request_key = walk{d}.request_key and flat.f = split{d}.f)"""
        )
    inner = [
        f"""select tree, node, feature, cut, gain, c0, c1, false as leaf from live{d} join level{d} using (tree, node)
    join split{d} using (tree, node) join edges using (f, bin) join names using (f)"""
        for d in range(depth)
    ]
    leaves = [f"select tree, node, null, null, 0.0::double, c0, c1, true from live{d} join ends{d} using (tree, node)" for d in range(depth + 1)]
    shares = " union all ".join(f"select request_key, c0 / (c0 + c1) as s0, c1 / (c0 + c1) as s1 from walk{d} join ends{d} using (tree, node)" for d in range(depth + 1))
    ctes.append(f"nodes as ({' union all '.join([*inner, *leaves])})")
    ctes += walks
    ctes.append(
        f"""votes as (select request_key, round(sum(s0) / {trees}, 12) as p0, round(sum(s1) / {trees}, 12) as p from ({shares}) group by request_key),
scored as (select request_key, train, label, p, (p > p0)::int::double as prediction from parts join votes using (request_key))"""
    )
    return ",\n".join(ctes)


AUTO_FRACTION = "least(1.0::double, count_if(label = 1)::double / count_if(label = 0))"
