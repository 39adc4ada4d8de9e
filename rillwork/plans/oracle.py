"""DuckDB statements that answer the same questions as the queries, written without looking at their plans."""

from __future__ import annotations

_HOLES = "(select event_id, case when event_id % 7 <> 0 then value end as value, case when event_id % 5 <> 0 then event_type end as event_type from events)"
_C = "(select c_custkey, c_nationkey from customer)"
_O = "(select o_orderkey, o_custkey from orders)"
_DAILY = "(select datediff('day', date '1992-01-01', cast(o_orderdate as date)) as day, round(sum(o_totalprice), 2) as total from orders group by 1)"
_BAND = "(select c_nationkey, c_mktsegment, cast(floor(c_acctbal / 2500) as int) as band from customer)"
_SIZES = "(select c_nationkey, c_mktsegment, count(*) as n from customer group by all)"
_VALUES = f"(select c_nationkey, c_mktsegment, band, count(*) as c from {_BAND} group by all)"
_GRID = f"(select cast(unnest(generate_series(min(day), max(day), 3)) as int) as day from {_DAILY})"
_NEAR = f"""(select g.day, p.day as pd, p.total as pt, n.day as nd, n.total as nt from {_GRID} g asof join {_DAILY} p on g.day >= p.day asof join {_DAILY} n on g.day <= n.day)"""


def _joined(kind: str, columns: str = "c_custkey, c_nationkey, o_orderkey, o_custkey") -> str:
    return f"select {columns} from {_C} {kind} join {_O} on c_custkey = o_custkey"


def _bucketed(buckets: int, last: int) -> str:
    return f"(select c_custkey, c_acctbal, cast(least(floor((c_acctbal - lo) / ((hi - lo) / {buckets})), {last}) as int) as b, lo, hi from customer, (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer))"


def _label(value: str, cuts: str) -> str:
    at = f"len(list_filter({cuts}, lambda x: x <= {value}))"
    shown = lambda i, end: f"coalesce(printf('%.6f', {cuts}[{i}]), '{end}')"
    return f"'range' || ({at} + 1) || '[' || case when {at} = 0 then '-Infinity' else {shown(at, '')} end || '-' || {shown(at + ' + 1', 'Infinity')} || ']'"


def _suppressed(where: str) -> str:
    return f"""select c_custkey, case when {where} then '*' else cast(c_nationkey as varchar) end as c_nationkey, case when {where} then '*' else c_mktsegment end as c_mktsegment
      from (select *, count(*) over (partition by c_nationkey, c_mktsegment) as n from customer)"""



def oracle_sql() -> dict[str, str]:
    return {
        "filter_less_than": "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity < 10",
        "filter_equal": "select p_partkey, p_size from part where p_size = 15",
        "filter_large_equal": "select p_partkey, p_size from part where p_size >= 45",
        "filter_exist": "select o_orderkey, o_orderpriority from orders where contains(o_orderpriority, 'URGENT')",
        "filter_like": "select p_partkey, p_type from part where regexp_matches(p_type, '^[A-M].*E')",
        "filter_sql": "select c_custkey, c_acctbal * 2 as doubled from customer where c_acctbal > 5000 and c_mktsegment <> 'BUILDING'",
        "having_count": "select o_orderkey, o_custkey from orders qualify count(*) over (partition by o_custkey) >= 12",
        "having_sum": "select o_orderkey, o_custkey from orders qualify sum(o_totalprice) over (partition by o_custkey) > 2000000",
        "topk": "select o_totalprice, o_orderkey from orders order by 1 desc, 2 limit 20",
        "select_cols": "select p_partkey, p_retailprice, p_brand from part",
        "select_ordered": "select p_size, p_partkey from part",
        "drop_cols": "select s_suppkey, s_nationkey from supplier",
        "rename_cols": "select n_nationkey, n_name as land, n_regionkey as region from nation",
        "rename_positions": "select cast(n_nationkey as bigint) as k, n_name as name, n_regionkey from nation",
        "cast_cols": "select cast(l_orderkey as varchar) as l_orderkey, l_linenumber, cast(trunc(l_quantity) as int) as l_quantity, try_cast(l_returnflag as double) as l_returnflag from lineitem",
        "add_conditional": "select o_orderkey, case when o_totalprice > 300000 then 'large' when o_totalprice > 100000 then 'medium' when o_totalprice <= 10000 then 'tiny' end as size from orders",
        "column_arith": "select l_orderkey, l_linenumber, l_extendedprice, l_quantity * 3 as l_quantity, round(l_extendedprice / l_quantity + 1e-9, 6) as unit from lineitem",
        "zone_ids": "select s_suppkey, cast(row_number() over (order by s_acctbal, s_suppkey) - 1 as int) as zone from supplier",
        "concat_cols": "select n_nationkey, n_name || '-' || n_regionkey as joined from nation",
        "null_replace": "select nullif(c_custkey, 0) as c_custkey, nullif(c_nationkey, 0) as c_nationkey, case when c_nationkey = 3 then null else nullif(c_mktsegment, '') end as c_mktsegment from customer",
        "time_index": "select o_orderkey, cast(epoch(date_trunc('minute', o_orderdate)) as bigint) as epoch from orders",
        "drop_first_rows": "select s_suppkey, s_acctbal from supplier qualify row_number() over (order by s_suppkey) > 10 and row_number() over (order by s_suppkey desc) > 5",
        "aggregate_basic": "select l_returnflag, l_linestatus, round(avg(l_quantity), 6) as l_quantity_avg, round(sum(l_extendedprice), 2) as l_extendedprice_sum, count(l_orderkey) as l_orderkey_count from lineitem group by 1, 2",
        "aggregate_concat": "select n_regionkey, string_agg(n_name, '|' order by n_name) as n_name_concat from nation group by 1",
        "group_min_max_avg_sum_count": "select event_type, min(value) as min_value, max(value) as max_value, round(avg(value), 4) as avg_value, round(sum(value), 4) as sum_value, count(value) as count_value from events group by 1",
        "tumbling_window": "select event_type, round(sum(value), 4) as sum_value, count(value) as count_value, cast(epoch(time_bucket(interval 1 hour, ts)) as bigint) as start from events group by 1, 4",
        "sliding_window": "select count(value) as count_value, cast(epoch(w) as bigint) as start from (select value, unnest([time_bucket(interval 30 minutes, ts), time_bucket(interval 30 minutes, ts) - interval 30 minutes]) as w from events) group by 2",
        "window_all_columns": "select event_type, max(value) as value, cast(epoch(date_trunc('day', ts)) as bigint) as start from events group by 1, 3",
        "window_median": "select cast(epoch(date_trunc('day', ts)) as bigint) as start, round(median(value), 6) as value from events group by 1",
        "session_window": """select user_id, count(*) as events, cast(min(floor(epoch(ts))) as bigint) as session_start from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from
          (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minutes then 0 else 1 end as new from events)) group by user_id, s""",
        "pivot_avg": "select o_orderpriority, round(avg(o_totalprice) filter (o_orderstatus = 'F'), 4) as F, round(avg(o_totalprice) filter (o_orderstatus = 'O'), 4) as O, round(avg(o_totalprice) filter (o_orderstatus = 'P'), 4) as P from orders group by 1",
        "pivot_sum": "select o_orderpriority, round(sum(o_totalprice) filter (o_orderstatus = 'F'), 2) as F, round(sum(o_totalprice) filter (o_orderstatus = 'O'), 2) as O, round(sum(o_totalprice) filter (o_orderstatus = 'P'), 2) as P from orders group by 1",
        "transpose_col": "select " + ", ".join(f"max(case when rn = {i + 1} then r_name end) as \"{i}\"" for i in range(5)) + " from (select r_name, row_number() over (order by r_regionkey) as rn from region)",
        "freq_table": "select p_brand, p_size, count(*) as freq from part group by 1, 2",
        "most_frequent": "select p_type, count(*) as freq from part group by 1 order by 2 desc, 1 limit 1",
        "least_frequent": "select p_type, count(*) as freq from part group by 1 order by 2, 1 limit 1",
        "describe_stats": "select round(min(c_acctbal), 4) as min, round(max(c_acctbal), 4) as max, round(avg(c_acctbal), 4) as avg, round(stddev_samp(c_acctbal), 4) as std, round(median(c_acctbal), 4) as median, count(c_acctbal) as count from customer",
        "column_means": "select round(avg(l_quantity), 6) as l_quantity, round(avg(l_discount), 6) as l_discount, round(avg(l_tax), 6) as l_tax from lineitem",
        "ensemble_aggregate": "select vec_id, cast(pos as int) as pos, round(cast(x as double) * 2, 5) as score from (select vec_id, unnest(embedding) as x, unnest(range(len(embedding))) as pos from embeddings)",
        "flatten_arrays": "select label, cast(sum(len(embedding)) as int) as n, round(cast(arg_min(embedding[2], vec_id) as double), 5) as second from embeddings group by 1",
        "latest_message": "select event_type, arg_max(props, event_id) as props from events group by 1",
        "row_window_sliding": "with o as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as rn, count(*) over () as n from orders), w as (select cast(unnest(range(0, cast((n - 3) // 2 + 1 as bigint))) as bigint) as window_id from (select max(n) as n from o)) select window_id, o_orderkey from w join o on rn >= window_id * 2 and rn < window_id * 2 + 3",
        "row_window_tumbling": "select (row_number() over (order by o_orderdate, o_orderkey) - 1) // 100 as window_id, o_orderkey from orders",
        "row_window_groups": "with o as (select *, row_number() over (partition by o_custkey order by o_orderkey) - 1 as rn, count(*) over (partition by o_custkey) as n from orders) select rn - d as window_id, o_orderkey, o_custkey from o, (values (0), (1)) t(d) where rn - d >= 0 and rn - d <= n - 2",
        "union_all": "select s_nationkey from supplier union all select c_nationkey from customer",
        "union": "select s_nationkey from supplier union select c_nationkey from customer",
        "intersect": "select s_nationkey from supplier intersect select c_nationkey from customer",
        "except": "select s_nationkey from supplier except select c_nationkey from customer",
        "join_inner": _joined("inner"),
        "join_left": _joined("left"),
        "join_right": _joined("right"),
        "join_full": _joined("full"),
        "join_semi": _joined("semi", "c_custkey, c_nationkey"),
        "join_anti": _joined("anti", "c_custkey, c_nationkey"),
        "join_multiway": "select n_name, c_mktsegment, count(*) as n from customer join nation on c_nationkey = n_nationkey join supplier on s_nationkey = c_nationkey group by 1, 2",
        "broadcast_join": "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey",
        "join_interval": "select a.event_id, b.event_id as before_id from events a join events b on a.user_id = b.user_id and a.ts >= b.ts and a.ts <= b.ts + interval 30 minutes",
        "join_range": "select o_orderkey, p_partkey from orders join part on o_totalprice between p_retailprice * 100 and p_retailprice * 100 + 20",
        "join_asof": """select event_id, r.e as event_id_right, r.v as value from (select a.event_id, (select arg_max({e: b.event_id, v: b.value}, (b.ts, b.event_id)) from events b where b.event_id % 2 = 1 and b.user_id = a.user_id and b.ts <= a.ts) as r from events a where a.event_id % 2 = 0)""",
        "append_columns": "select r_regionkey, r_name, n_nationkey, n_name from (select *, row_number() over (order by n_nationkey) as rn from nation) n left join (select *, row_number() over (order by r_regionkey) as rn from region) r using (rn)",
        "merge_tables": "select k, n_name, r_name from (select n_regionkey as k, n_name from nation union all select n_regionkey, lower(n_name) from nation) left join (select r_regionkey as k, r_name from region where r_regionkey > 0) using (k)",
        "impute_drop": f"select * from {_HOLES} where value is not null or event_type is not null",
        "impute_constant": f"select event_id, coalesce(value, -1.0) as value, coalesce(event_type, 'none') as event_type from {_HOLES}",
        "impute_median": f"select event_id, round(coalesce(value, (select median(value) from {_HOLES})), 6) as value, event_type from {_HOLES}",
        "impute_mean": f"select event_id, round(coalesce(value, (select avg(value) from {_HOLES})), 6) as value, event_type from {_HOLES}",
        "equal_width_bin": "select p_partkey, " + _label("p_retailprice", "cuts") + " as bin from part, (select [lo + (hi - lo) / 4 * i for i in [1, 2, 3]] as cuts from (select min(p_retailprice) as lo, max(p_retailprice) as hi from part))",
        "equal_depth_bin": "with o as (select p_size, row_number() over (order by p_size) as rn, count(*) over () as n from part), e as (select i, max(p_size) filter (rn = ceil(n * i / 5.0)) as v from o, range(1, 5) t(i) group by i), c as (select list(v + ((select min(p_size) from part where p_size > v) - v) / 2 order by i) as cuts from e) select p_partkey, p_size, " + _label("p_size", "cuts") + " as p_size_result from part, c",
        "minmax_scale": "select c_custkey, round((c_acctbal - lo) / (hi - lo) * 2 - 1, 8) as c_acctbal from customer, (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer)",
        "minmax_declared": "select c_custkey, round((c_acctbal + 1000) / 11000 * 10, 8) as c_acctbal from customer",
        "interpolate_linear": f"select day, round(case when pd = nd then pt else pt + (day - pd) * (nt - pt) / (nd - pd) end + 1e-9, 4) as total from {_NEAR}",
        "interpolate_previous": f"select day, round(pt + 1e-9, 4) as total from {_NEAR}",
        "interpolate_nearest": f"select day, round(case when day - pd <= nd - day then pt else nt end + 1e-9, 4) as total from {_NEAR}",
        "time_sync": f"""with d as (select day, total from {_DAILY}), a as (select cast(unnest(generate_series(min(day), max(day), 2)) as int) as g from d), b as (select cast(unnest(generate_series(min(day) + 2, max(day) + 2, 2)) as int) as g from d)
          select a.g as time, round(x.total, 2) as total, round(-y.total, 2) as total_right from a join b on a.g = b.g asof join d x on a.g >= x.day asof join (select day + 2 as day, total from d) y on a.g >= y.day""",
        "explode_col": "select doc_id, count(*) as lines, cast(sum(length(line)) as bigint) as chars from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by 1",
        "split_array": "select vec_id, " + ", ".join(f"round(cast(embedding[{i + 1}] as double), 5) as embedding{i}" for i in range(4)) + " from embeddings",
        "split_struct": "select n_nationkey, n_name as a, n_regionkey + 1 as b from nation",
        "json_props": "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events",
        "one_hot": "select r_name, case when ix < n - 1 then '(' || (n - 1) || ',[' || ix || '],[1.0])' else '(' || (n - 1) || ',[],[])' end as vec from region join (select r_name, row_number() over (order by count(*) desc, r_name) - 1 as ix, count(*) over () as n from region group by 1) using (r_name)",
        "vectorize": "select p_partkey, '[' || cast(p_size as double) || ',' || p_retailprice || ']' as v from part",
        "agglomerative_single": "with g as (select v, v - lag(v) over (order by v) as gap from (select distinct c_acctbal as v from customer)), c as (select list(v) as cuts from (select v from g where gap is not null order by gap desc, v desc limit 4)) select c_custkey, c_acctbal, cast(len(list_filter(cuts, lambda x: x <= c_acctbal)) as int) as \"CLUSTER\" from customer, c",
        "dbscan": """with recursive p as (select c_custkey as id, c_acctbal as x, c_nationkey as y from customer), e as (select a.id as a, b.id as b from p a join p b on a.y between b.y - 2 and b.y + 2 and abs(a.x - b.x) + abs(a.y - b.y) <= 2), core as (select a from e group by a having count(*) >= 4),
          c as (select a, b from e where a in (from core) and b in (from core)), r as (select a, a as l from core union select c.b, r.l from r join c on c.a = r.a), m as (select a, min(l) as l from r group by a), near as (select e.a, min(m.l) as l from e join m on m.a = e.b group by 1), k as (select l, row_number() over (order by l) as n from (select distinct l from m))
          select c_custkey, c_acctbal, c_nationkey, cast(coalesce(n, 0) as int) as "CLUSTER" from customer left join m on m.a = c_custkey left join near on near.a = c_custkey left join k on k.l = coalesce(m.l, near.l)""",
        "string_index": "select p_partkey, cast(ix as double) as ix from part join (select p_brand, row_number() over (order by count(*) desc, p_brand) - 1 as ix from part group by 1) using (p_brand)",
        "linear_regression": "select 'l_quantity' as attribute, round(regr_slope(l_extendedprice, l_quantity), 4) as weight from lineitem",
        "batch_predict": "select l_orderkey, l_linenumber, l_quantity, l_quantity * 2 + 1 as score from lineitem",
        "priv_aggregate": f"select c_custkey, round(avg(c_acctbal) over (partition by b), 4) as c_acctbal from {_bucketed(10, 10)}",
        "priv_partial_aggregate": f"select c_custkey, round(case when abs(c_acctbal - a) > 1.5 * coalesce(s, 0) then a else c_acctbal end, 4) as c_acctbal from (select *, avg(c_acctbal) over (partition by b) as a, stddev_samp(c_acctbal) over (partition by b) as s from {_bucketed(10, 9)})",
        "priv_partial_boxplot": f"select c_custkey, round(case when c_acctbal < q1 - 0.5 * (q3 - q1) or c_acctbal > q3 + 0.5 * (q3 - q1) then m else c_acctbal end, 4) as c_acctbal from {_bucketed(10, 9)} join (select b, quantile_cont(c_acctbal, 0.25) as q1, quantile_cont(c_acctbal, 0.75) as q3, max(c_acctbal) as m from {_bucketed(10, 9)} group by b) using (b)",
        "priv_range": f"select c_custkey, '[' || cast(trunc(lo + b * ((hi - lo) / 10)) as bigint) || ',' || cast(trunc(lo + (b + 1) * ((hi - lo) / 10)) as bigint) || ']' as c_acctbal from {_bucketed(10, 10)}",
        "priv_round": "select c_custkey, cast(case when c_nationkey % 4 >= 2 then c_nationkey - c_nationkey % 4 + 4 else c_nationkey - c_nationkey % 4 end as bigint) as c_nationkey from customer",
        "priv_round_up": "select cast(ceil(c_custkey / 10.0) * 10 as bigint) as c_custkey, c_name from customer",
        "priv_round_text": "select c_custkey, 'No.' || cast(c_custkey // 100 * 100 as bigint) || '.0x' as t from customer",
        "priv_hide": "select c_custkey, 'k' || max(c_custkey) over (partition by least(floor((c_custkey - lo) / ((hi - lo) / 10.0)), 10)) || '.0' as t from customer, (select min(c_custkey) as lo, max(c_custkey) as hi from customer)",
        "priv_blank": "select c_custkey, c_name[1:2] || '**' || c_name[5:6] || '**' || c_name[9:] as c_name from customer",
        "priv_generalize_num": "select c_custkey, cast(trunc(c_nationkey / w) * w as varchar) || '~' || cast((trunc(c_nationkey / w) + 1) * w as varchar) as c_nationkey from customer, (select max(c_nationkey) / 8.0 * 2 as w from customer)",
        "priv_generalize_str": "select c_custkey, left(c_mktsegment, length(c_mktsegment) - cast(floor(length(c_mktsegment) / 4.0 * 2) as int)) || '*' as c_mktsegment from customer",
        "priv_hierarchy": "select distinct c_mktsegment as level0, " + ", ".join(f"left(c_mktsegment, cast(length(c_mktsegment) - floor(length(c_mktsegment) / 3.0 * {k} + 1e-9) as int)) || '*' as level{k}" for k in (1, 2, 3)) + " from customer",
        "priv_drop_identifier": "select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer",
        "priv_drop_quasi": "select c_custkey, c_name, c_acctbal, c_mktsegment from customer",
        "priv_record_reduction": """select c_custkey, abs(c_acctbal - a) > 1.5 * s as gone, case when n < lim then '*' else c_mktsegment end as c_mktsegment from customer,
          (select avg(c_acctbal) as a, stddev_samp(c_acctbal) as s from customer), (select c_mktsegment as g, count(*) as n from customer group by 1), (select avg(n) - 1.5 * stddev_pop(n) as lim from (select count(*) as n from customer group by c_mktsegment)) where g = c_mktsegment""",
        "priv_record_reduction_all": f"select c_custkey, case when n < lim then '*' else cast(c_nationkey as varchar) end as c_nationkey, case when n < lim then '*' else c_mktsegment end as c_mktsegment from customer join {_SIZES} using (c_nationkey, c_mktsegment), (select avg(n) - 1.5 * stddev_pop(n) as lim from {_SIZES})",
        "priv_classes": "select c_nationkey, c_mktsegment, count(*) as class_size from customer group by 1, 2",
        "priv_suppress_k": _suppressed("n < 10"),
        "priv_suppress_risk": _suppressed("1.0 / n > 0.11"),
        "priv_pseudonym": "select c_custkey, c_name from customer",
        "priv_encrypt": "select c_custkey, c_name from customer",
        "priv_rearrange_manual": "with r as (select c_custkey, c_acctbal, row_number() over (order by c_custkey) - 1 as rn from customer) select a.c_custkey, b.c_acctbal from r a join r b on b.rn = case a.rn when 0 then 9 when 9 then 0 when 3 then 5 when 5 then 3 else a.rn end",
        "priv_noise_fixed": "select c_custkey, c_acctbal * 2 as c_acctbal from customer",
        "k_anonymity": f"select min(n) as k, min(n) >= 5 as satisfied from {_SIZES}",
        "l_diversity_distinct": f"select cast(min(d) as double) as l from (select count(distinct band) as d from {_BAND} group by c_nationkey, c_mktsegment)",
        "l_diversity_prob": f"select round(max(m), 6) as l, round(min(m), 6) as least from (select max(c) / sum(c) as m from {_VALUES} group by c_nationkey, c_mktsegment)",
        "l_diversity_entropy": f"select round(min(e), 6) as l from (select -sum(p * ln(p)) as e from (select c_nationkey, c_mktsegment, c / sum(c) over (partition by c_nationkey, c_mktsegment) as p from {_VALUES}) group by c_nationkey, c_mktsegment)",
        "l_diversity_recursive": f"select bool_and(d >= 3 and m < 2.0 * (n - m)) as satisfied from (select count(*) as d, max(c) as m, sum(c) as n from (select c_nationkey, band, count(*) as c from {_BAND} group by all) group by c_nationkey)",
        "t_closeness": f"""with o as (select band, count(*) / (select count(*) from customer) as q from {_BAND} group by 1), k as (select c_nationkey, c_mktsegment, n from {_SIZES}), g as (select c_nationkey, c_mktsegment, o.band, q, coalesce(c, 0) / n as p from k cross join o left join {_VALUES} v using (c_nationkey, c_mktsegment, band)),
          t as (select sum(abs(p - q)) / 2 as t from g group by c_nationkey, c_mktsegment) select round(max(t), 6) as t, round(sum(t), 5) as t_sum from t""",
        "loss_aecs": f"select sum(n) / count(*) as aecs from {_SIZES}",
        "loss_dm": f"select cast(sum(case when n >= 10 then n * n else 0 end) + sum(case when n < 10 then n else 0 end) * sum(n) as bigint) as dm from {_SIZES}",
        "loss_cardinality": "select (greatest(0, 1 - count(distinct c_nationkey // 5) / count(distinct c_nationkey)) + 0) / 2 as cardinality_loss from customer",
        "loss_equivalence": "select 1 - (select count(*) from (select distinct c_nationkey // 5, c_mktsegment from customer)) / (select count(*) from (select distinct c_nationkey, c_mktsegment from customer)) as equivalence_loss",
        "loss_hierarchy": "select cast(count(*) * 0.5 as double) as hierarchical_loss from customer",
        "risk_reid": f"select 1.0 / min(n) as risk from {_SIZES}",
        "risk_global": f"select round(avg(1.0 / n), 8) as global_risk from {_SIZES}",
        "priv_check": f"with s as ({_suppressed('n < 10')}), z as (select count(*) as n from s group by c_nationkey, c_mktsegment) select sum(n) / count(*) as loss, cast(1.0 / min(n) as double) as risk, cast(min(n) as double) as anonymity from z",
        "priv_lattice": "select cast(a as int) as c_mktsegment, cast(b as int) as c_nationkey, round((a / 2.0 + b / 3.0) / 2, 6) as height from range(0, 3) t(a), range(0, 4) u(b)",
        "file_round_trip": "select n_nationkey, n_name, n_regionkey from nation",
        "workflow_batch": "select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey where s_acctbal > 1000",
        "order_by": "select p_partkey, p_size from part",
        "merge_inner": "select n_regionkey as k, n_name, r_name from nation join region on n_regionkey = r_regionkey",
        "stream_filter": "select event_id, value from events where value > 50",
        "stream_groupby_window": "select event_type, count(value) as count_value, round(sum(value), 4) as sum_value, cast(epoch(time_bucket(interval 1 hour, ts)) as bigint) as start from events group by 1, 4",
        "stream_interval_join": "select a.event_id, b.event_id as before_id from events a join events b on a.user_id = b.user_id and a.ts >= b.ts and a.ts <= b.ts + interval 30 minutes",
        "stream_count_window": "with o as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as rn, count(*) over (partition by user_id) as n from events), w as (select user_id, unnest(range(0, max(n) // 2)) as window_id, max(n) as n from o group by user_id) select window_id, w.user_id, event_id from w join o on o.user_id = w.user_id and rn >= window_id * 2 and rn < window_id * 2 + 4 where window_id * 2 + 4 <= w.n",
        "udf_scalar": "select n_nationkey, n_name || '!' as loud from nation",
        "udf_pandas": "select p_partkey, cast(floor(p_retailprice / 100) as bigint) as price_class from part",
        "udaf_pandas": "select p_brand, round(exp(avg(ln(p_retailprice))), 4) as mean from part group by 1",
        "udtf_split": "select p_partkey, cast(unnest(range(len(w))) as int) as position, unnest(w) as word from (select p_partkey, regexp_split_to_array(trim(p_name), '\\s+') as w from part)",
        "route_lookup": "select event_id, case event_id % 4 when 0 then 'a' when 1 then 'b' when 2 then 'c' end as route from events",
    }
