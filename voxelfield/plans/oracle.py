"""The queries of `queries.py` as independent SQL for the check engine."""

from __future__ import annotations

import math

from voxelfield.functions import counter, gamma, normal
from voxelfield.operators.ingest import IMAGE_SUFFIX
from voxelfield.plans import fixtures as fx

L, SEED, TAU = fx.N_BASIS, fx.SEED, f"{fx.TAU}e0"
EPS = f"{normal.EPSILON!r}"


def num(x: float) -> str:
    """A double literal (a plain 0.1 would be a decimal)."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


def poly(x: str, coefficients) -> str:
    text = num(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {num(c)})"
    return text


def cdf(x: str) -> str:
    """Normal distribution function of a column name."""
    a = f"abs({x})"
    near = f"exp(-{a} * {a} / 2e0) * {poly(a, normal.TAIL_NUMERATOR)} / {poly(a, normal.TAIL_DENOMINATOR)}"
    far = f"exp(-{a} * {a} / 2e0) / ({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 0.65e0))))) / {num(normal.TAIL_SCALE)}"
    tail = f"(case when {a} < {num(normal.TAIL_SWITCH)} then {near} when {a} <= 37e0 then {far} else 0e0 end)"
    return f"(case when {x} > 0 then 1e0 - {tail} else {tail} end)"


def ppf(p: str) -> str:
    """Normal quantile of a column name."""
    q = f"({p} - 0.5e0)"
    r = f"(0.180625e0 - {q} * {q})"
    s = f"sqrt(-ln(least({p}, 1e0 - {p})))"
    central = f"{q} * {poly(r, normal.CENTRAL_NUMERATOR)} / {poly(r, normal.CENTRAL_DENOMINATOR)}"
    m, f = f"({s} - 1.6e0)", f"({s} - 5e0)"
    middle = f"{poly(m, normal.MIDDLE_NUMERATOR)} / {poly(m, normal.MIDDLE_DENOMINATOR)}"
    far = f"{poly(f, normal.FAR_NUMERATOR)} / {poly(f, normal.FAR_DENOMINATOR)}"
    outer = f"(case when {s} <= 5e0 then {middle} else {far} end)"
    return f"(case when abs({q}) <= 0.425e0 then {central} when {q} < 0 then -{outer} else {outer} end)"


def uniform(*parts: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT + 0.5e0) / pow(16::DOUBLE, 13))"


def counted(source: str, key: str, first: str, second: str) -> str:
    """The rows of ``source`` with ``u``, the uniform of a pair of counters in the stream that ``key`` names."""
    word, carried = f"& {counter.WORD}", "* exclude (a, b)"
    text = f"select *, md5({key}) as m from ({source})"
    text = f"select * exclude m, ('0x' || substr(m, 1, 8))::BIGINT as k0, ('0x' || substr(m, 9, 8))::BIGINT as k1 from ({text})"
    text = f"select *, xor(xor({counter.PARITY}, k0), k1) as k2, (({first} {word}) + k0) {word} as a, (({second} {word}) + k1) {word} as b from ({text})"
    for i in range(counter.ROUNDS):
        turn, step = counter.ROTATIONS[i % len(counter.ROTATIONS)], i // 4 + 1
        text = f"select {carried}, (a + b) {word} as a, ((b << {turn}) {word}) | (b >> {32 - turn}) as b from ({text})"
        text = f"select {carried}, a, xor(a, b) as b from ({text})"
        if i % 4 == 3:
            text = f"select {carried}, (a + k{step % 3}) {word} as a, (b + k{(step + 1) % 3} + {step}) {word} as b from ({text})"
    low = counter.LOW_BITS
    return f"select * exclude (a, b, k0, k1, k2), (((a << {low}) | (b >> {32 - low})) + 0.5e0) / {num(counter.SPAN)} as u from ({text})"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def basis(degree: int, source: str = "images8", value: str = "value") -> str:
    c = math.sqrt(fx.KERNEL_A**2 + 2 * fx.KERNEL_A * fx.KERNEL_B)
    terms = [f"{num((2 * c / math.pi) ** 0.25)} * exp(-{num(c)} * {value} * {value}) as h0"]
    for k in range(1, degree + 1):
        text = f"{num(math.sqrt(2.0 / k))} * {num(math.sqrt(2 * c))} * {value} * h{k - 1}"
        if k > 1:
            text += f" - {num(math.sqrt((k - 1.0) / k))} * h{k - 2}"
        terms.append(f"{text} as h{k}")
    return f"select *, {', '.join(terms)} from {source}"


DOT = " + ".join(f"h{k} * theta[{k + 1}]" for k in range(L))
THETA = ", ".join(f"((voxel_id * {k + 3}) % 7 - 3) / 10e0" for k in range(L))
LOGLIK = f"(y * ln(p + {EPS}) + (1 - y) * ln(1 - p + {EPS}))"

# Tables by name; a query lists those it needs, in dependency order.
TABLES = {
    "images8": "select vec_id as subject_id, v - 1 as voxel_id, embedding[v]::DOUBLE as value "
    "from (select *, unnest(range(1, len(embedding) + 1)) as v from embeddings)",
    "labels8": "select vec_id as subject_id, (label = 8)::int as y from embeddings",
    "voxels8": f"""select voxel_id, voxel_id % 8 as "row", voxel_id // 8 as col,
        ((voxel_id * 7 + 3) % 5 < 2)::int as delta, [{THETA}] as theta, (voxel_id % 9 + 1) / 10e0 as p,
        (voxel_id % 8 < 2 and voxel_id < 16) as excluded, voxel_id % 3 + 1 as partition_id
        from (select distinct voxel_id from images8)""",
    "z8": "select subject_id, (2 * y - 1) * (0.1e0 + (subject_id % 9) / 5e0) as z from labels8",
    "scalars": f"select avg(y) as alpha, {TAU} as inv_sigma_sq, 0.8e0 as inv_a from labels8",
    "basis8": basis(fx.DEGREE),
    "effects8": f"""select subject_id, voxel_id, delta, {DOT} as f, delta * ({DOT}) as df
        from basis8 join voxels8 using (voxel_id) where not excluded""",
    "eta8": """select subject_id, (select alpha from scalars) + sum(case when delta = 1 then f else 0 end) as eta
        from effects8 group by 1""",
    "subjects8": "select * from eta8 join z8 using (subject_id)",
    "loglik8": f"""select subject_id, {LOGLIK} as loglik
        from (select subject_id, y, {cdf('eta')} as p from eta8 join labels8 using (subject_id))""",
    "cells": """select o_orderkey as voxel_id, (o_orderkey % 100)::int as "row", (o_orderkey // 100)::int as col,
        case when o_totalprice > 250000 then 1 else 2 end as partition_id,
        (o_orderpriority = '1-URGENT' or (o_orderkey % 100 < 4 and o_orderkey // 100 < 4)) as excluded,
        (o_custkey % 5 < 2)::int as delta from orders""",
    "volume": "select o_orderkey as voxel_id, (o_orderkey % 10)::int as x, (o_orderkey // 10 % 10)::int as y, "
    "(o_orderkey // 100)::int as z from orders",
    "volume_parcels": """select o_orderkey as voxel_id, (case when o_totalprice < 20000 then 0 else
        (o_orderkey % 10 // 5 + 2 * (o_orderkey // 10 % 10 // 5) + 4 * (o_orderkey // 1000) + 1) * 10 end)::int as parcel_id
        from orders""",
    "image_parcels": """select voxel_id, (("row" // 4 + 2 * (col // 4)) * 10)::int as parcel_id from voxels8""",
    "parcel_means8": "select subject_id, parcel_id, avg(value) as value from images8 join image_parcels using (voxel_id) group by 1, 2",
    "flashes": """select char_id, seq_no, code, is_true, value + 30 * is_true as score, value + 10 * is_true as score_b from (
        select user_id as char_id, event_id as seq_no, (event_id % 12 + 1)::int as code, value,
        (event_id % 12 + 1 in (user_id % 6 + 1, user_id % 6 + 7))::int as is_true from events)""",
    "flashes_lineitem": """select char_id, seq_no, code, is_true, q + 30 * is_true as score, d * 100 + 5 * is_true as score_b from (
        select l_suppkey as char_id, l_orderkey * 10 + l_linenumber as seq_no, l_quantity as q, l_discount as d,
        ((l_orderkey + l_linenumber) % 12 + 1)::int as code,
        ((l_orderkey + l_linenumber) % 12 + 1 in (l_suppkey % 6 + 1, l_suppkey % 6 + 7))::int as is_true from lineitem)""",
    "draws": f"""select (o_orderkey % 3)::int as chain_id, (o_orderkey // 3 % 40)::int as iter, (o_orderkey // 120)::int as voxel_id,
        (cents % 2)::int as delta, [{', '.join(f'(cents % {17 + k} - 8) / 10e0' for k in range(L))}] as theta
        from (select *, round(o_totalprice * 100)::BIGINT as cents from orders)""",
    "subject_draws": """select (o_orderkey % 3)::int as chain_id, (o_orderkey // 3 % 40)::int as iter,
        o_orderkey // 120 as subject_id, o_totalprice / 7000 as z from orders""",
    "global_draws": """select chain_id, iter, avg(z) as alpha, 1 + count(*) filter (z > 20) / count(*) as inv_sigma_sq,
        1 + count(*) filter (z > 50) / count(*) as inv_a, -sum(z) as loglik from subject_draws group by 1, 2""",
    "post": f"""select chain_id, voxel_id, avg(delta) as delta_mean, (avg(delta) >= 0.6e0)::int as delta,
        [{', '.join(f'avg(theta[{k + 1}])' for k in range(L))}] as theta
        from draws where iter > 20 and (iter - 20) % 4 = 0 group by 1, 2""",
    "paths": f"select '/scans/' || lower(c_mktsegment) || '_' || lpad(c_custkey::varchar, 7, '0') || '{IMAGE_SUFFIX}' as path from customer",
    "image_files": f"""select path, split_part(path, '/', 3) as filename,
        upper(regexp_extract(path, '/scans/(.*)_[0-9]{{7}}_falff', 1)) as site_id,
        regexp_extract(path, '([0-9]{{7}})_falff', 1) as sub_id from paths""",
    "pheno": """select upper(c_mktsegment) as site_id, lpad(c_custkey::varchar, 7, '0') as sub_id,
        (c_custkey % 2 + 1)::int as DX_GROUP, c_acctbal / 100 as AGE_AT_SCAN,
        case c_nationkey % 3 when 1 then 'Male' when 2 then 'Female' end as SEX, c_nationkey + 80 as FIQ,
        case when c_acctbal > 5000 then 'R' else 'L' end as HANDEDNESS_CATEGORY from customer""",
    "scores": """select o_orderkey as subject_id, 'price' as model, round(o_totalprice / 500000, 3) as score from orders
        union all select o_orderkey, 'customer', round((o_custkey % 997) / 997e0, 3) from orders""",
    "order_labels": "select o_orderkey as subject_id, (o_orderstatus = 'F')::int as y from orders",
    "order_predictions": "select o_orderkey as subject_id, o_totalprice / 500000 as prob from orders",
    "roc": """select model, score, pos, neg,
        sum(neg) over w / sum(neg) over (partition by model) as fpr, sum(pos) over w / sum(pos) over (partition by model) as tpr
        from (select model, score, sum(y) as pos, sum(1 - y) as neg from scores join order_labels using (subject_id) group by 1, 2)
        window w as (partition by model order by score desc)""",
    "split8": f"""select subject_id, row_number() over (order by md5('{SEED}|' || subject_id), subject_id)
        <= ceil(round(count(*) over (partition by y) * 0.9e0, 9)) as ignored from labels8""",
    "channel_nodes": """select timepoint * 16 + channel as node, channel, timepoint from (
        select distinct (user_id % 16)::int as channel, dayofyear(ts) * 24 + hour(ts) as timepoint from events)""",
    "confusion": """select y as truth, count(*) filter (prob <= 0.5e0) as pred_0, count(*) filter (prob > 0.5e0) as pred_1
        from order_predictions join order_labels using (subject_id) group by 1""",
    "window8": """select a.partition_id, r.radius, a.voxel_id, avg(b.delta) as p from voxels8 a, (values (1), (2)) r(radius), voxels8 b
        where abs(a."row" - b."row") <= r.radius and abs(a.col - b.col) <= r.radius group by 1, 2, 3""",
    "radius8": """select partition_id, radius, -0.5e0 * sum(pow(z - (select alpha from scalars) - fit, 2)) as loglik from (
        select subject_id, c.partition_id, c.radius, sum(f * case when v.partition_id = c.partition_id then w.p else v.p end) as fit
        from (select distinct partition_id, radius from window8) c, effects8 e join voxels8 v using (voxel_id), window8 w
        where w.voxel_id = e.voxel_id and w.radius = c.radius group by 1, 2, 3) join z8 using (subject_id) group by 1, 2""",
    "dic8": f"""select replicate, chain_id, 2 * mean_dev - dev as dic from
        (select 1 as replicate, chain_id, -2 * avg(loglik / 100) as mean_dev from global_draws group by chain_id)
        join (select chain_id, -2 * sum({LOGLIK}) as dev from (
            select chain_id, y, {cdf('eta')} as p from (
                select chain_id, subject_id, (select alpha from scalars) + sum(chain_id * df) as eta
                from effects8, (values (0), (1), (2)) c(chain_id) group by 1, 2) join labels8 using (subject_id)) group by 1)
        using (chain_id)""",
}

IMAGES = ["images8", "labels8", "voxels8"]
MODEL = [*IMAGES, "z8", "scalars", "basis8", "effects8", "eta8", "subjects8"]


def sql(body: str, *tables: str) -> str:
    if not tables:
        return body
    return "with " + ",\n".join(f"{t} as ({TABLES[t]})" for t in dict.fromkeys(tables)) + "\n" + body


def window_sum(radius: str, masked: bool) -> str:
    """Mean over the square around each cell by summing a list of shifted cells."""
    kept = "and not b.excluded" if masked else ""
    return f"""select a.voxel_id, a.partition_id, r.radius, avg(b.delta) as p
        from cells a join ({radius}) r on true
        left join (select {radius_steps()}) s on abs(s.dr) <= r.radius and abs(s.dc) <= r.radius
        left join cells b on b."row" = a."row" + s.dr and b.col = a.col + s.dc {kept}
        group by 1, 2, 3"""


def radius_steps() -> str:
    return "dr, dc from range(-2, 3) t(dr), range(-2, 3) u(dc)"


BY_PARTITION = "select 1 as radius union all select 2"
FACES = "(values (1, 0, 0), (0, 1, 0), (0, 0, 1)) s(dx, dy, dz)"
CHARS = """truth as (select char_id, string_agg(code::varchar, '-' order by code) as truth
    from (select distinct char_id, code from {t} where is_true = 1) group by 1),
numbered as (select *, row_number() over (partition by char_id order by seq_no) as rn from {t}),
long as (select 'score' as method, char_id, code, rn, score from numbered
    union all select 'score_b', char_id, code, rn, score_b from numbered),
sums as (select k, method, char_id, code, sum(score) as s from long, range(1, 10) r(k) where rn / 12e0 <= k group by all),
best as (select *, max(s) over (partition by k, method, char_id, code <= 6) as top from sums),
predicted as (select k, method, char_id, string_agg(code::varchar, '-' order by code) as predict
    from best where top - s <= 1e-9 * abs(top) group by all)
"""


def curve(table: str) -> str:
    return sql("", table).rstrip() + ",\n" + CHARS.format(t=table) + f"""select k::int as k, method, {r6('avg((coalesce(truth = predict, false))::int)')} as accuracy
from (select truth.*, k, method from truth, range(1, 10) r(k), (values ('score'), ('score_b')) m(method))
left join predicted using (k, method, char_id) group by 1, 2"""


def block_of(coord: str, dim: str) -> str:
    starts = [f"floor(1 + {i} * ({dim} - {dim} // 4 - 1) / 3e0 + 1e-9)" for i in range(4)]
    return "(" + " + ".join(f"({coord} + 1 >= {s})::int" for s in starts) + ")"


PRIORITIES = ["URGENT", "HIGH", "MEDIUM", "NOT_SPECIFIED", "LOW"]
H = [f"h{k}" for k in range(L)]
QUOTED = f"'{SEED}'"
SPLIT = f"row_number() over (partition by y order by md5('{SEED}|' || subject_id), subject_id) <= ceil(round(count(*) over (partition by y) * 0.9e0, 9))"
GAUSS = "0.5e0 * ff - rf + ln((1 - p + {e}) / (p + {e}))".format(e=EPS)

ORACLE: dict[str, str] = {
    "list_image_files": sql("select * from image_files", "paths", "image_files"),
    "read_phenotype": sql(f"select site_id, sub_id, DX_GROUP, {r6('AGE_AT_SCAN')} as AGE_AT_SCAN, HANDEDNESS_CATEGORY from pheno", "pheno"),
    "match_phenotype": sql(
        f"select site_id, sub_id, filename, DX_GROUP, {r6('AGE_AT_SCAN')} as AGE_AT_SCAN from image_files join pheno using (site_id, sub_id)",
        "paths", "image_files", "pheno"),
    "covariate_projection": sql(
        f"select sub_id, {r6('AGE_AT_SCAN')} as AGE_AT_SCAN, SEX, FIQ, HANDEDNESS_CATEGORY, DX_GROUP from image_files join pheno using (site_id, sub_id)",
        "paths", "image_files", "pheno"),
    "image_to_long": sql(
        f"select subject_id, voxel_id, {r6('value')} as value, voxel_id % 4 as x, voxel_id // 4 % 4 as y, voxel_id // 16 as z, "
        "'Vox_' || (voxel_id + 1) as voxel_name from images8", "images8"),
    "long_to_image": sql(f"select subject_id, voxel_id, {r6('value')} as value from images8", "images8"),
    "events_to_lattice": f"""select u.subject_id, c.voxel_id::int as voxel_id, {r6('coalesce(m.value, 0)')} as value
        from (select distinct user_id as subject_id from events) u cross join range(168) c(voxel_id)
        left join (select user_id as subject_id, hour(ts) + 24 * dayofweek(ts) as voxel_id, avg(value) as value from events group by 1, 2) m
        on m.subject_id = u.subject_id and m.voxel_id = c.voxel_id""",
    "wide_distance_to_edges": f"""select n.name as src, m.name as dst, round(avg(o_totalprice), 4) + 0.0 as dist from orders
        join (values {', '.join(f"({i}, '{p}')" for i, p in enumerate(PRIORITIES))}) n(i, name) on o_custkey % 5 = n.i
        join (values {', '.join(f"({i}, '{p}')" for i, p in enumerate(PRIORITIES))}) m(i, name)
        on substr(o_orderpriority, 1, 1)::int = m.i + 1 group by 1, 2""",
    "binarise_outcome": sql("select * from labels8", "labels8"),
    "save_load_dataset": sql(
        f"select subject_id, voxel_id, {r6('2 * value')} as value, 'digits' as dataset, 150 as sample_size, 1 as replicate, 2 as chain from images8", "images8"),
    "scale_constant": sql(f"select subject_id, voxel_id, {r6('value / 255e0')} as value from images8", "images8"),
    "scale_global_maxabs": sql(
        f"""select i.subject_id, i.voxel_id, case when s.t then 'train' else 'test' end as part,
        {r6('i.value / (select max(abs(value)) from images8 join (select subject_id, ' + SPLIT + ' as t from labels8) q using (subject_id) where q.t)')} as value
        from images8 i join (select subject_id, {SPLIT} as t from labels8) s using (subject_id)""", "images8", "labels8"),
    "excluded_voxels": sql(
        """select voxel_id, sum(value) <= 0 as excluded, 'nonpos_sum' as mode from images8 group by 1
        union all select voxel_id, max(abs(case when voxel_id % 8 < 1 then 0 else value end)) = 0, 'all_zero' from images8 group by 1""",
        "images8"),
    "voxel_variance": sql(f"select voxel_id, {r6('var_samp(value)')} as variance from images8 group by 1", "images8"),
    "partition_by_threshold": sql(
        "select voxel_id, case when var_samp(value) > 0.0156e0 then 1 else 2 end as partition_id from images8 group by 1", "images8"),
    "partition_by_quantile": sql(
        """select voxel_id, case when v > (select quantile_cont(v, 0.5) from
        (select var_samp(value) as v from images8 group by voxel_id)) then 1 else 2 end as partition_id
        from (select voxel_id, var_samp(value) as v from images8 group by 1)""", "images8"),
    "partition_grid": sql(
        f"""select voxel_id, "row", col, ({block_of('"row"', '100')} - 1) * 4 + {block_of('col', 'n')} as partition_id
        from cells, (select max(col) + 1 as n from cells)""", "cells"),
    "stratified_split": f"select subject_id, y, {SPLIT} as in_train from (select o_orderkey as subject_id, o_orderstatus as y from orders)",
    "random_init": sql(
        f"""select voxel_id, {r6('u')} as u, (u < 0.5e0)::int as delta, l, {r6(ppf('w'))} as theta_l,
        {r6(ppf('ua'))} as alpha, {r6(f'2e0 / pow({ppf("ub")}, 2)')} as a
        from (select voxel_id, l::int as l, {uniform(f"'{SEED}'", "'delta0'", 'voxel_id')} as u,
            {uniform(f"'{SEED}'", "'theta0'", 'voxel_id', 'l')} as w,
            {uniform(f"'{SEED}'", "'alpha0'")} as ua, {uniform(f"'{SEED}'", "'a0'")} as ub
            from voxels8, range({L}) r(l))""", *IMAGES),
    "random_latent": sql(f"select subject_id, {r6('0.3e0 + sum(df)')} as z from effects8 group by 1", *MODEL),
    "remap_labels": sql(
        "select voxel_id, parcel_id, (dense_rank() over (order by parcel_id) - 1)::int as new_id from volume_parcels", "volume_parcels"),
    "parcel_means": sql(f"select subject_id, parcel_id, {r6('value')} as value from parcel_means8", *IMAGES, "image_parcels", "parcel_means8"),
    "parcel_adjacency": sql(
        f"""select parcel_id, coalesce(string_agg(b::varchar, ',' order by b), '') as neighbors
        from (select distinct parcel_id from volume_parcels) left join (
            select distinct case when d = 1 then a else b end as parcel_id, case when d = 1 then b else a end as b from (
                select p.parcel_id as a, q.parcel_id as b from volume v, {FACES}, volume w, volume_parcels p, volume_parcels q
                where w.x = v.x + dx and w.y = v.y + dy and w.z = v.z + dz and p.voxel_id = v.voxel_id and q.voxel_id = w.voxel_id
                and p.parcel_id <> q.parcel_id and p.parcel_id > 0 and q.parcel_id > 0), (values (1), (2)) t(d)) using (parcel_id)
        group by 1""", "volume", "volume_parcels"),
    "broadcast_parcel_means": sql(
        f"select subject_id, voxel_id, {r6('value')} as value from parcel_means8 join image_parcels using (parcel_id)",
        *IMAGES, "image_parcels", "parcel_means8"),
    "roi_voxels": sql(
        """select x, y, z, voxel_id as flat_index, count(*) over () as n_voxels from volume join volume_parcels using (voxel_id)
        where parcel_id = 20""", "volume", "volume_parcels"),
    "shape_mismatch": sql(
        "select voxel_id, 'parcels' as missing_in from volume join volume_parcels using (voxel_id) where parcel_id = 0", "volume", "volume_parcels"),
    "voxel_neighbors6": sql(
        f"""select case when d = 1 then a else b end as src, case when d = 1 then b else a end as dst from (
            select v.voxel_id as a, w.voxel_id as b from volume v, {FACES}, volume w, volume_parcels p, volume_parcels q
            where w.x = v.x + dx and w.y = v.y + dy and w.z = v.z + dz and p.voxel_id = v.voxel_id and q.voxel_id = w.voxel_id
            and p.parcel_id > 0 and q.parcel_id > 0), (values (1), (2)) t(d)""", "volume", "volume_parcels"),
    "channel_time_graph": sql(
        """select a.node as src, b.node as dst from channel_nodes a, channel_nodes b, range(-1, 2) s(dt)
        where b.timepoint = a.timepoint + dt and abs(a.channel - b.channel) / 4e0 <= 2 and a.node <> b.node""", "channel_nodes"),
    "lattice_graph": sql(
        """select a.voxel_id as src, b.voxel_id as dst from cells a, (values (1, 0), (-1, 0), (0, 1), (0, -1)) s(dr, dc), cells b
        where b."row" = a."row" + dr and b.col = a.col + dc and not a.excluded and not b.excluded""", "cells"),
    "window_inclusion": sql(
        f"select voxel_id, {r6('p')} as p from ({window_sum(BY_PARTITION, False)}) where radius = partition_id", "cells"),
    "window_inclusion_masked": sql(
        f"select voxel_id, {r6('p * 0.8e0 + 0.1e0')} as p from ({window_sum(BY_PARTITION, True)}) where radius = partition_id", "cells"),
    "window_inclusion_candidates": sql(
        f"select partition_id, radius, voxel_id, {r6('p')} as p from ({window_sum(BY_PARTITION, False)})", "cells"),
    "neighbor_inclusion": sql(
        f"""select a.voxel_id, {r6('avg(b.delta)')} as p from cells a
        left join (values (1, 0), (-1, 0), (0, 1), (0, -1)) s(dr, dc) on true
        left join cells b on b."row" = a."row" + dr and b.col = a.col + dc and not a.excluded and not b.excluded group by 1""", "cells"),
    "clamp_inclusion": sql(
        f"select voxel_id, {r6('case p when 1 then 0.95e0 when 0 then 0.05e0 else p end')} as p from ({window_sum(BY_PARTITION, False)}) where radius = partition_id",
        "cells"),
    "basis_expand": sql(
        " union all ".join(f"select subject_id, voxel_id, {l}::int as l, {r6(h)} as b_l from basis8" for l, h in enumerate(H)), "images8", "basis8"),
    "voxel_effects": sql(f"select subject_id, voxel_id, delta, {r6('f')} as f, {r6('df')} as df from effects8", *MODEL),
    "linear_predictor": sql(f"select subject_id, {r6('eta')} as eta from eta8", *MODEL),
    "probit_loglik": sql(f"select subject_id, {r6('loglik')} as loglik from loglik8", *MODEL, "loglik8"),
    "total_loglik": sql(f"select {r6('sum(loglik)')} as loglik from loglik8", *MODEL, "loglik8"),
    "log_posterior": sql(
        f"""select {r6(f'''2 * ln(inv_a) - inv_a + 2 * ln(inv_sigma_sq) - inv_a * inv_sigma_sq - 0.5e0 * alpha * alpha * inv_sigma_sq
        + 0.5e0 * {L} * p * ln(inv_sigma_sq) - 0.5e0 * inv_sigma_sq * sq + ll''')} as logpost
        from scalars, (select sum(list_sum([t * t for t in theta])) as sq, count(*) as p from voxels8),
        (select sum(loglik) as ll from loglik8)""", *MODEL, "loglik8"),
    "voxel_gram": sql(
        " union all ".join(
            f"select voxel_id, {i}::int as l1, {j}::int as l2, {r6(f'sum({H[i]} * {H[j]})')} as g from basis8 group by 1"
            for i in range(L) for j in range(L)), "images8", "basis8"),
    "residual_crossprod": sql(
        " union all ".join(
            f"select voxel_id, {l}::int as l, {r6(f'sum({h} * (z - eta + df))')} as c_l from basis8 join effects8 using (subject_id, voxel_id) join subjects8 using (subject_id) group by 1"
            for l, h in enumerate(H)), *MODEL),
    "theta_conditional": sql(
        f"""select voxel_id, delta, {r6('m0')} as mean_0, {r6('m1')} as mean_1, {r6('v0')} as var_0, {r6('v1')} as var_1,
        {r6('case when delta = 1 then m0 + e0 / r00 - r10 * e1 / (r00 * r11) else e0 / sqrt(' + TAU + ') end')} as theta_0,
        {r6('case when delta = 1 then m1 + e1 / r11 else e1 / sqrt(' + TAU + ') end')} as theta_1
        from (select *, sqrt(a) as r00, b / sqrt(a) as r10, sqrt(c - b * b / a) as r11,
            case when delta = 1 then (c * c0 - b * c1) / (a * c - b * b) else 0 end as m0,
            case when delta = 1 then (a * c1 - b * c0) / (a * c - b * b) else 0 end as m1,
            case when delta = 1 then c / (a * c - b * b) else 1 / {TAU} end as v0,
            case when delta = 1 then a / (a * c - b * b) else 1 / {TAU} end as v1
            from (select voxel_id, {TAU} + sum(h0 * h0) as a, sum(h0 * h1) as b, {TAU} + sum(h1 * h1) as c,
                sum(h0 * (z - eta + df)) as c0, sum(h1 * (z - eta + df)) as c1
                from basis8 join effects8 using (subject_id, voxel_id) join subjects8 using (subject_id) group by 1)
            join (select voxel_id, delta, {ppf('u0')} as e0, {ppf('u1')} as e1 from (
                select voxel_id, delta, {uniform(f"'{SEED}'", "'theta'", 'voxel_id', "'0'")} as u0,
                {uniform(f"'{SEED}'", "'theta'", 'voxel_id', "'1'")} as u1 from voxels8 where not excluded)) using (voxel_id))""", *MODEL),
    "inclusion_logodds_probit": sql(
        f"""select voxel_id, {r6('loglik0')} as loglik0, {r6('loglik1')} as loglik1, {r6('posterior')} as posterior,
        ({uniform(f"'{SEED}'", "'delta'", 'voxel_id')} < posterior)::int as delta
        from (select *, 1 / (1 + exp(loglik0 + ln(1 - p + {EPS}) - loglik1 - ln(p + {EPS}))) as posterior
            from (select voxel_id, sum(y * ln(p0 + {EPS}) + (1 - y) * ln(1 - p0 + {EPS})) as loglik0,
                sum(y * ln(p1 + {EPS}) + (1 - y) * ln(1 - p1 + {EPS})) as loglik1
                from (select voxel_id, y, {cdf('e0')} as p0, {cdf('e1')} as p1 from (
                    select voxel_id, y, eta - df as e0, eta - df + f as e1 from effects8 join eta8 using (subject_id) join labels8 using (subject_id)))
                group by 1) join voxels8 using (voxel_id))""", *MODEL),
    "inclusion_logodds_gaussian": sql(
        f"""select voxel_id, {r6('ff')} as ff, {r6('rf')} as rf, {r6(f'1 / (1 + exp(least({GAUSS}, 700)))')} as posterior, ({GAUSS} <= 0)::int as delta
        from (select voxel_id, sum(f * f) as ff, sum((z - eta + df) * f) as rf from effects8 join subjects8 using (subject_id) group by 1)
        join voxels8 using (voxel_id)""", *MODEL),
    "radius_scores": sql(f"select partition_id, radius, {r6('loglik')} as loglik from radius8", *MODEL, "window8", "radius8"),
    "radius_select": sql(
        f"select partition_id, arg_max(radius, loglik) as radius, {r6('max(loglik)')} as loglik from radius8 group by 1", *MODEL, "window8", "radius8"),
    "alpha_conditional": sql(
        f"""select {r6('m')} as mean, {r6('v')} as var, {r6(f'm + sqrt(v) * {ppf("u")}')} as alpha
        from (select sum(z - eta + (select alpha from scalars)) / (count(*) + {TAU}) as m, 1 / (count(*) + {TAU}) as v,
        {uniform(f"'{SEED}'", "'alpha'")} as u from subjects8)""", *MODEL),
    "latent_draw": sql(
        f"""select subject_id, {r6(f'side * (m - {ppf("q")})')} as z from (select *, u * {cdf('m')} as q from (
            select subject_id, side, side * eta as m, {uniform(f"'{SEED}'", "'z'", 'subject_id')} as u
            from (select *, case when y = 1 then 1 else -1 end as side from eta8 join labels8 using (subject_id))))""", *MODEL),
    "variance_conditional": sql(
        f"""select {r6(f'0.5e0 * {L} * p + 1')} as shape, {r6('inv_a + 0.5e0 * sq + 0.5e0 * alpha * alpha')} as rate
        from scalars, (select sum(list_sum([t * t for t in theta])) as sq, count(*) as p from voxels8)""", *MODEL),
    # tau from the first proposal taken; a proposal is a function of its number.
    "variance_draw": sql(
        f"""select {r6('shape')} as shape, {r6('rate')} as rate, {r6('tau')} as inv_sigma_sq,
        {r6(f"-ln({uniform(QUOTED, chr(39) + 'inv_a' + chr(39))}) / (tau + 1)")} as inv_a
        from (select shape, rate, least(arg_min(d * v, k) / rate, 10e0) as tau
            from (select *, pow(1e0 + x / sqrt(9e0 * d), 3) as v from (select *, shape - 1 / 3e0 as d, {ppf('ux')} as x from (
                select k, {uniform(QUOTED, "'tau'", "'x'", 'k')} as ux, {uniform(QUOTED, "'tau'", "'u'", 'k')} as u,
                0.5e0 * {L} * p + 1 as shape, inv_a + 0.5e0 * sq + 0.5e0 * alpha * alpha as rate
                from range({gamma.ATTEMPTS}) r(k), scalars,
                (select sum(list_sum([t * t for t in theta])) as sq, count(*) as p from voxels8))))
            where v > 0 and ln(u) < 0.5e0 * x * x + d - d * v + d * ln(greatest(v, 1e-300)) group by 1, 2)""", *MODEL),
    "lasso_init": sql(
        """select voxel_id, (select round(max(abs((sy - m * s) / n / sqrt((ss - s * s / n) / (n - 1)))), 6) from moments) as first_penalty,
        true as optimal, true as on_path from (select distinct voxel_id from images8)""", "images8", "labels8").replace(
        "\nselect voxel_id", """,
        moments as (select voxel_id, sum(value) as s, sum(value * value) as ss, sum(value * y) as sy,
            (select avg(y) from labels8) as m, (select count(*) from labels8)::DOUBLE as n
            from images8 join labels8 using (subject_id) group by 1)
        select voxel_id""", 1),
    "fit_alpha": sql(
        f"""select iter::int as iter, {r6(f'm + sqrt(v) * {ppf("u")}')} as alpha, 1e0 as inv_sigma_sq
        from (select sum(z - eta + (select alpha from scalars)) / (count(*) + 1) as m, 1e0 / (count(*) + 1) as v from subjects8),
        (select i as iter, {uniform(QUOTED, "'alpha'", 'i', "'0'", "'0'")} as u from range(5) r(i))""", *MODEL),
    "fit_latent": sql(
        f"""select iter::int as iter, subject_id, {r6(f'side * (m - {ppf("q")})')} as z from (select *, u * {cdf('m')} as q from (select *, side * eta0 as m from ({counted(
            "select i as iter, subject_id, side, eta - (select alpha from scalars) + 0.3e0 as eta0"
            " from (select *, case when y = 1 then 1 else -1 end as side from eta8 join labels8 using (subject_id)), range(2, 5) r(i)",
            f"concat_ws('|', {QUOTED}, 'z', iter, '0', '0')", 'subject_id', '(subject_id >> 32)')})))""", *MODEL),
    "fit_prior_theta": sql(
        f"""select iter::int as iter, voxel_id, l::int as l, {r6(ppf('u'))} as theta_l from ({counted(
            f"select i as iter, voxel_id, l from voxels8, range(2, 5) r(i), range({L}) t(l) where not excluded",
            f"concat_ws('|', {QUOTED}, 'theta', iter, '0', '0')", 'voxel_id', 'l')})""", *IMAGES),
    "fit_one_delta": sql(
        f"""select i::int as iter, voxel_id, case when voxel_id = 20 then (select (0.5e0 * sum(f * f) - sum((z - 0.3e0) * f)
            + ln((1 - max(p) + {EPS}) / (max(p) + {EPS})) <= 0)::int from effects8 join z8 using (subject_id) join voxels8 using (voxel_id)
            where voxel_id = 20) else 0 end as delta from voxels8, range(2, 5) r(i)""", *MODEL),
    "fit_roi": """select i::int as iter, count(*) as n_voxels, min(o_orderkey)::int as first, max(o_orderkey)::int as last
        from orders, range(1, 3) r(i) where o_orderkey < 1000 and o_orderkey % 10 < 5 and o_orderkey // 10 % 10 < 5
        and not o_totalprice < 20000 group by 1""",
    "retain_draws": sql(
        f"""select chain_id, iter, voxel_id, delta, ((iter - 20) // 4)::int as slot, l::int as l, {r6('theta[l + 1]')} as theta_l
        from draws, range({L}) r(l) where iter > 20 and (iter - 20) % 4 = 0""", "draws"),
    "posterior_mean": sql(
        f"select chain_id, voxel_id, {r6('delta_mean')} as delta_mean, delta, l::int as l, {r6('theta[l + 1]')} as theta_l from post, range({L}) r(l)",
        "draws", "post"),
    "posterior_mean_subject": sql(
        f"select chain_id, subject_id, {r6('avg(z)')} as z from subject_draws where iter > 20 and (iter - 20) % 4 = 0 group by 1, 2", "subject_draws"),
    "posterior_mean_global": sql(
        f"""select chain_id, {r6('avg(alpha)')} as alpha, {r6('avg(1 / inv_sigma_sq)')} as sigma_sq, {r6('avg(1 / inv_a)')} as a
        from global_draws where iter > 20 and (iter - 20) % 4 = 0 group by 1""", "subject_draws", "global_draws"),
    "last_radius": """select chain_id, partition_id, arg_max(radius, iter) as radius from (
        select (o_orderkey % 3)::int as chain_id, (o_orderkey // 3 % 40)::int as iter,
        case when o_totalprice > 250000 then 1 else 2 end as partition_id, (count(*) % 2 + 1)::int as radius from orders group by 1, 2, 3) group by 1, 2""",
    "selected_voxels": sql("select chain_id, voxel_id from post where delta = 1", "draws", "post"),
    "fit_trace": sql(f"select chain_id, iter, {r6('loglik')} as loglik from global_draws where iter % 5 = 0", "subject_draws", "global_draws"),
    "subject_trace": sql(
        f"""select 0 as chain_id, iter, subject_id, {r6(LOGLIK)} as loglik from (
            select iter, y, subject_id, {cdf('eta')} as p from (
                select iter, subject_id, (select alpha from scalars) + sum(iter * df / 2e0) as eta
                from effects8, (values (0), (2)) t(iter) group by 1, 2) join labels8 using (subject_id))""", *MODEL),
    "draw_table": sql(
        f"""select *, 20 as burnin, 4 as thinning, 5 as mcmc_sample from (select chain_id, iter, subject_id, {r6('z')} as z,
        ((iter - 20) // 4)::int as slot from subject_draws where iter > 20 and (iter - 20) % 4 = 0)""", "subject_draws"),
    "chain_dic": sql(f"select replicate, chain_id, {r6('dic')} as dic from dic8", *MODEL, "subject_draws", "global_draws", "dic8"),
    "select_chain_dic": sql(
        f"select replicate, arg_min(chain_id, dic) as chain_id, {r6('min(dic)')} as dic from dic8 group by 1",
        *MODEL, "subject_draws", "global_draws", "dic8"),
    "predict_probability": sql(f"select subject_id, {r6(cdf('eta'))} as prob from eta8", *MODEL),
    "predict_label": sql(
        "select subject_id, (prob > 0.7e0)::int as above, (prob >= 0.521e0)::int as pred from order_predictions", "order_predictions"),
    "predict_label_random": sql(
        f"select subject_id, ({uniform(f'{chr(39)}{SEED}{chr(39)}', chr(39) + 'label' + chr(39), 'subject_id')} < prob)::int as pred from order_predictions",
        "order_predictions"),
    "predict_linear_probit": sql(
        f"""select subject_id, {r6(cdf('eta'))} as prob, ({cdf('eta')} > 0.5e0)::int as pred
        from (select subject_id, sum(value * theta[1]) as eta from images8 join voxels8 using (voxel_id) group by 1)""", *IMAGES),
    "accuracy": f"""select o_orderpriority as replicate, {r6("avg(((o_totalprice / 500000 > 0.5e0) = (o_orderstatus = 'F'))::int)")} as accuracy
        from orders group by 1""",
    "confusion_matrix": sql("select * from confusion", "order_labels", "order_predictions", "confusion"),
    "confusion_summary": sql(
        f"""select {r6('o')} as accuracy, {r6('(o - e) / (1 - e)')} as kappa, {r6('a / (a + b)')} as sensitivity, {r6('d / (c + d)')} as specificity
        from (select *, (a + d) / (a + b + c + d) as o, ((a + b) * (a + c) + (c + d) * (b + d)) / pow(a + b + c + d, 2) as e
        from (select sum(pred_0) filter (truth = 0)::DOUBLE as a, sum(pred_1) filter (truth = 0)::DOUBLE as b,
        sum(pred_0) filter (truth = 1)::DOUBLE as c, sum(pred_1) filter (truth = 1)::DOUBLE as d from confusion))""",
        "order_labels", "order_predictions", "confusion"),
    "roc_curve": sql(
        f"select model, {r6('score')} as score, pos::BIGINT as pos, neg::BIGINT as neg, {r6('fpr')} as fpr, {r6('tpr')} as tpr from roc",
        "scores", "order_labels", "roc"),
    "roc_auc": sql(
        f"""select model, {r6('sum((fpr - f0) * (tpr + t0) / 2)')} as auc from (select model, fpr, tpr,
        lag(fpr, 1, 0) over w as f0, lag(tpr, 1, 0) over w as t0 from roc window w as (partition by model order by score desc)) group by 1""",
        "scores", "order_labels", "roc"),
    "effect_curve": sql(
        f"select voxel_id, subject_id, {r6('value')} as x, {r6(DOT)} as y from basis8 join voxels8 using (voxel_id) where delta = 1 and not excluded", *MODEL),
    "true_characters": sql("", "flashes").rstrip() + ",\n" + CHARS.format(t="flashes") + "select * from truth",
    "first_k_sequences": sql("", "flashes").rstrip() + ",\n" + CHARS.format(t="flashes")
    + f"select char_id, seq_no, code, is_true, {r6('score')} as score from numbered where rn / 12e0 <= 3",
    "code_scores": sql(f"select char_id, code, {r6('sum(score)')} as score from flashes group by 1, 2", "flashes"),
    "predicted_characters": sql(
        """select char_id, string_agg(code::varchar, '-' order by code) as predict from (
        select *, max(s) over (partition by char_id, code <= 6) as top from
        (select char_id, code, sum(score) as s from flashes group by 1, 2)) where top - s <= 1e-9 * abs(top) group by 1""", "flashes"),
    "character_accuracy": f"select accuracy from ({curve('flashes')}) where k = 4 and method = 'score'",
    "character_accuracy_curve": curve("flashes"),
    "character_accuracy_lineitem": curve("flashes_lineitem"),
    "inclusion_map": sql(
        f"""select a.voxel_id, a.delta, {r6('avg(b.delta)')} as p from map a, map b
        where abs(a.voxel_id % 8 - b.voxel_id % 8) <= a.radius and abs(a.voxel_id // 8 - b.voxel_id // 8) <= a.radius group by 1, 2""",
        "images8").replace("\nselect a.voxel_id, a.delta", """,
        variances as (select voxel_id, var_samp(value) as v from images8 group by 1),
        map as (select voxel_id, (v > (select quantile_cont(v, 0.5) from variances))::int as delta,
            case when v > (select quantile_cont(v, 0.5) from variances) then 1 else 2 end as radius from variances)
        select a.voxel_id, a.delta""", 1),
}
