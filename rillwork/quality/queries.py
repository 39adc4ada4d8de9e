"""Queries over the sensor, traffic and file tables, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hotdeck, lateness, missing, regrid, rejects, spikes, trailing

FIELDS = ("prcs_spd", "prcs_trv_time")
#: Added before rounding, here and in the oracles, so that halves go the same way in both.
EPS = 1e-9


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rules(train: DataFrame, fields: tuple[str, ...] = FIELDS) -> missing.MissingRules:
    return missing.fit(train, "link_id", "detector_id", fields)


def p1_doubtful(spark: SparkSession, d: str) -> DataFrame:
    train = _read(spark, d, "trainset")
    return spikes.flag_spikes(train, _rules(train), missing.minute_number(), strict=False)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    train = _read(spark, d, "trainset")
    return spikes.flag_spikes(train, _rules(train), missing.minute_number()).where("flagged").select("rec_id")


def p1_medians(spark: SparkSession, d: str) -> DataFrame:
    train = _read(spark, d, "trainset")
    rules = _rules(train)
    a, b = rules.value("prcs_spd"), rules.value("prcs_trv_time")
    a, b = F.when((a > 0) & (a <= spikes.SPEED_MAX), a), F.when(b > 0, b)
    rows = train.select(rules.source("link_id").alias("src"), a.alias("a"), b.alias("b")).select("src", F.stack(F.lit(3), F.lit(0), F.col("a"), F.lit(1), F.col("b"), F.lit(2), F.col("a") * F.col("b")).alias("field", "v"))
    return spikes.exact_medians(rows.where("src is not null and v is not null")).select(F.col("src").alias("link_id"), "field", F.round("median", 6).alias("median"))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    train = _read(spark, d, "trainset")
    rules = _rules(train, ("prcs_spd",))
    key = train.select(rules.source("link_id").alias("src"), missing.minute_number().alias("at"), missing.day_number().alias("day"), "detector_id", rules.value("prcs_spd").alias("value"), rules.value("prcs_trv_time").alias("other"))
    # a record sent again under a new id is the same reading
    return key.where("src is not null").groupBy("src", "day", "at", "detector_id", "value", "other").agg(F.lit(1).alias("one"))


def _days(spark: SparkSession, d: str) -> DataFrame:
    train = _read(spark, d, "trainset")
    rules = _rules(train, ("prcs_spd",))
    return train.select(rules.source("link_id").alias("src"), missing.day_number().alias("day"), rules.value("prcs_spd").alias("value"))


def _date(col: str) -> F.Column:
    return F.date_format(F.date_from_unix_date(F.col(col).cast("int")), "yyyy-MM-dd")


def p2_rolling(spark: SparkSession, d: str) -> DataFrame:
    t = trailing.trailing_totals(_daily(spark, d))
    return t.select(F.col("src").alias("link_id"), _date("day").alias("prcs_date"), "readings_7", F.round("total_7", 3).alias("total_7"), F.round(F.col("mean_7") + EPS, 6).alias("mean_7"), "readings_30", F.round("total_30", 3).alias("total_30"), F.round(F.col("mean_30") + EPS, 6).alias("mean_30"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    t = trailing.trailing_totals(_days(spark, d))
    return t.where("records = 0 and next_day - last_day <= 30").select(F.col("src").alias("link_id"), _date("day").alias("prcs_date"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return lateness.judge_lateness(_read(spark, d, "sensor_stream"), _read(spark, d, "pipe_conf"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("late").select("msg_id")


def p3_revisions(spark: SparkSession, d: str) -> DataFrame:
    r = lateness.revised_aggregates(_judged(spark, d))
    return r.withColumns({c: F.round(F.col(c) + EPS, 6) for c in ("total", "mean")})


def _parsed(spark: SparkSession, d: str, cells: bool) -> DataFrame:
    return rejects.parse_lines(_read(spark, d, "input_lines"), rejects.read_specs(_read(spark, d, "datadescript"), _read(spark, d, "columndescript")), cells=cells)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, False).where("reason is not null").select("line_id")


def p4_rejected(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, False).where("reason is not null").select("line_id", "in_data_path", "reason", F.explode_outer("bad_cells").alias("c")).select("line_id", "in_data_path", "reason", F.col("c.column_id"), F.col("c.text").alias("bad_value"))


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    good = _parsed(spark, d, True).where("reason is null")
    return good.select("line_id", "in_data_path", F.inline("cells")).withColumn("as_epoch", F.unix_timestamp(F.col("as_time").cast("timestamp"))).drop("as_time")


def _gridded(spark: SparkSession, d: str) -> DataFrame:
    return regrid.regular_grid(_read(spark, d, "sensor_stream"), _read(spark, d, "pipe_conf"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _gridded(spark, d).where("n_records = 0").select("sensor_id", "slot_epoch")


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    return _gridded(spark, d).withColumn("value", F.round(F.col("value") + EPS, 6))


def p6_filled(spark: SparkSession, d: str) -> DataFrame:
    train = _read(spark, d, "trainset")
    rules = _rules(train)
    link = rules.source("link_id")
    rows = train.select(F.coalesce("detector_id", link).alias("grp"), missing.minute_number().cast("long").alias("t"), F.col("rec_id").alias("rec"), link.alias("link"), rules.value("prcs_spd").alias("speed"), rules.value("prcs_trv_time").alias("travel"))
    return hotdeck.fill_from_similar(rows, {"link": "link_id", "speed": "prcs_spd", "travel": "prcs_trv_time"}, constant=("link",))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_filled(spark, d).select("rec_id", "field_name")


def queries() -> dict:
    names = "p1_found p1_doubtful p1_medians p2_found p2_rolling p3_found p3_revisions p4_found p4_rejected p4_loaded p5_found p5_grid p6_found p6_filled"
    return {n: globals()[n] for n in names.split()}


# --- oracles: written independently, with the stand-ins of the test tables spelled out ---

_TRAIN = """
  select rec_id, detector_id,
    case when trim(coalesce(link_id, '')) in ('', '-', 'NULL', '0000000000') then null else link_id end as link,
    case when isnan(prcs_spd) or prcs_spd = -1 then null else prcs_spd end as spd,
    case when isnan(prcs_trv_time) or prcs_trv_time = 9999 then null else prcs_trv_time end as trv,
    make_date(cast(prcs_year as int), cast(prcs_mon as int), cast(prcs_day as int)) as day,
    (make_date(cast(prcs_year as int), cast(prcs_mon as int), cast(prcs_day as int)) - date '1970-01-01') * 1440 + cast(prcs_hh as int) * 60 + cast(prcs_min as int) as minute
  from trainset"""

_POSSIBLE = f"""
  select *, case when spd > 0 and spd <= 200 then spd end as s, case when trv > 0 then trv end as v from ({_TRAIN}) where link is not null"""


def _runs(field: str) -> str:
    return f"""select rec_id from (select rec_id, count(*) over (partition by link, grp) as n from (
      select *, sum(case when {field} = before then 0 else 1 end) over (partition by link order by minute, rec_id) as grp from (
        select *, lag({field}) over (partition by link order by minute, rec_id) as before from x where {field} is not null))) where n >= 10"""


def _donated(field: str, name: str) -> str:
    """Each record's value of a field as text, with the observed ones before and after it in its group."""
    val = f"case when {field} is not null then {{'minute': minute, 'rec_id': rec_id, 'val': cast({field} as varchar)}} end"
    return f"""select rec_id, '{name}' as field_name, minute, cast({field} as varchar) as val,
      case when grp is not null then last_value({val} ignore nulls) over (partition by grp order by minute, rec_id rows between unbounded preceding and 1 preceding) end as p,
      case when grp is not null then first_value({val} ignore nulls) over (partition by grp order by minute, rec_id rows between 1 following and unbounded following) end as n from t"""


_USABLE = """
  select s.*, k.kind, c.step_size, c.method_option, regexp_extract(c.watermark_delay, '([0-9]+)', 1)::bigint * case when c.watermark_delay like '%minute%' then 60 when c.watermark_delay like '%hour%' then 3600 else 1 end as delay_s,
    regexp_extract(c.window_length, '([0-9]+)', 1)::bigint * case when c.window_length like '%minute%' then 60 when c.window_length like '%hour%' then 3600 else 1 end as window_s, epoch_us(ts) as ts_us, epoch_us(arrived_at) as arr_us,
    try_cast(coalesce(case when event_body like '{%' then json_extract_string(event_body, '$.val') end, event_body) as double) as v
  from sensor_stream s join (select sensor_id, max(sensor_type) as kind from sensor_stream where ts <= arrived_at group by 1) k using (sensor_id) left join pipe_conf c on c.sensor_type = k.kind
  where s.sensor_id is not null and ts <= arrived_at"""

_JUDGED = f"""select *, coalesce(ts_us < max(ts_us) over (partition by sensor_id order by arr_us, msg_id rows between unbounded preceding and 1 preceding) - delay_s * 1000000, false) as late from ({_USABLE})"""


#: Fields (f), cells (v) and failing cells (b) of the lines.
_LINES = r"""with l as (select line_id, in_data_path, raw_line, field_delimiter as d, column_count as k from input_lines left join datadescript using (in_data_path)),
  s as (select *, replace(raw_line, d, chr(1)) as flat from l),
  q as (select *, case when contains(raw_line, '"') then null else string_split(flat, chr(1)) end as plain from s),
  f as (select line_id, in_data_path, k, plain as fields from q where plain is not null
    union all select line_id, in_data_path, k, case when regexp_full_match(raw_line, '(?s)(?:"(?:[^"]|"")*"|[^";]*)(?:;(?:"(?:[^"]|"")*"|[^";]*))*') then regexp_extract_all(d || raw_line, '(?s);("(?:[^"]|"")*"|[^";]*)', 1) end from q where plain is null and d = ';'
    union all select line_id, in_data_path, k, case when regexp_full_match(raw_line, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') then regexp_extract_all(d || raw_line, '(?s),("(?:[^"]|"")*"|[^",]*)', 1) end from q where plain is null and d = ','
    union all select line_id, in_data_path, k, case when regexp_full_match(raw_line, '(?s)(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') then regexp_extract_all(d || raw_line, '(?s)\t("(?:[^"]|"")*"|[^"\t]*)', 1) end from q where plain is null and d = chr(9)
    union all select line_id, in_data_path, k, case when regexp_full_match(raw_line, '(?s)(?:"(?:[^"]|"")*"|[^"|]*)(?:\|(?:"(?:[^"]|"")*"|[^"|]*))*') then regexp_extract_all(d || raw_line, '(?s)\|("(?:[^"]|"")*"|[^"|]*)', 1) end from q where plain is null and d = '|'
    union all select line_id, in_data_path, k, case when regexp_full_match(raw_line, '(?s)(?:"(?:[^"]|"")*"|(?:[^"|]|\|[^"|])*)(?:\|\|(?:"(?:[^"]|"")*"|(?:[^"|]|\|[^"|])*))*') then regexp_extract_all(d || raw_line, '(?s)\|\|("(?:[^"]|"")*"|(?:[^"|]|\|[^"|])*)', 1) end from q where plain is null and d = '||'),
  c as (select line_id, in_data_path, unnest(fields) as raw, unnest(range(len(fields))) as column_id from f where fields is not null and len(fields) = k),
  v as (select line_id, in_data_path, column_id, column_type as t, case when starts_with(raw, '"') then replace(raw[2:-2], '""', '"') else raw end as x from c join columndescript using (in_data_path, column_id)),
  b as (select line_id, in_data_path, column_id, t, x from v where x <> '' and not case
    when t in ('BYTE', 'INTEGER', 'LONG') then regexp_full_match(x, '-?[0-9]+') and coalesce(try_cast(x as hugeint) between case t when 'BYTE' then -128 when 'INTEGER' then -2147483648 else -9223372036854775808::hugeint end and case t when 'BYTE' then 127 when 'INTEGER' then 2147483647 else 9223372036854775807::hugeint end, false)
    when t in ('FLOAT', 'DOUBLE') then regexp_full_match(x, '-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?')
    when t = 'BOOLEAN' then lower(x) in ('true', 'false')
    when t = 'TIMESTAMP' then regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') and try_cast(x as timestamp) is not null and x[12:13] < '24'
    else true end)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""with x as ({_POSSIBLE}), m as (select link, median(s) as ms, median(v) as mv, median(s * v) as mp from x group by link)
          select distinct rec_id from (
            select rec_id from x join m using (link) where (spd is not null and s is null) or (trv is not null and v is null) or s > 1.8 * ms or s < 0.2 * ms or v > 5 * mv or v < 0.5 * mv or s * v > 1.5 * mp or s * v < mp * 2 / 3
            union all {_runs('spd')} union all {_runs('trv')})""",
        "p1_medians": f"""with x as ({_POSSIBLE}), y as (select link as link_id, 0 as field, median(s) as m from x group by 1 union all select link, 1, median(v) from x group by 1 union all select link, 2, median(s * v) from x group by 1)
          select link_id, field, round(m, 6) as median from y where m is not null""",
        "p2_found": f"""with d as (select distinct link, day from ({_TRAIN}) where link is not null and day is not null), g as (select link, day, lead(day) over (partition by link order by day) as nxt from d)
          select link as link_id, strftime(cast(u as date), '%Y-%m-%d') as prcs_date from (select link, unnest(generate_series(day + 1, nxt - 1, interval 1 day)) as u from g where nxt - day between 2 and 30)""",
        "p2_rolling": f"""with r as (select distinct link, day, minute, detector_id, spd, case when isnan(trv0) then null else trv0 end as o from (select a.*, b.prcs_trv_time as trv0 from ({_TRAIN}) a join trainset b using (rec_id)) where link is not null and day is not null),
          t as (select link, day, count(spd) as n, sum(spd) as s from r group by all),
          c as (select link, cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as day from t group by link),
          f as (select c.link, c.day, coalesce(n, 0) as n, s from c left join t using (link, day))
          select link as link_id, strftime(day, '%Y-%m-%d') as prcs_date,
            cast(sum(n) over w7 as bigint) as readings_7, round(sum(s) over w7, 3) as total_7, round(sum(s) over w7 / nullif(sum(n) over w7, 0) + 1e-9, 6) as mean_7,
            cast(sum(n) over w30 as bigint) as readings_30, round(sum(s) over w30, 3) as total_30, round(sum(s) over w30 / nullif(sum(n) over w30, 0) + 1e-9, 6) as mean_30 from f
          window w7 as (partition by link order by day rows between 6 preceding and current row), w30 as (partition by link order by day rows between 29 preceding and current row)""",
        "p3_found": f"select msg_id from ({_JUDGED}) where late",
        "p3_revisions": f"""with j as ({_JUDGED}), e as (select sensor_id, ts_us, event_body, min(arr_us) as arr_us, arg_min(late, (arr_us, msg_id)) as late, max(window_s) as w, any_value(v) as v from j where window_s > 0 group by sensor_id, ts_us, event_body),
          c as (select sensor_id, cast(floor(ts_us / 1000000 / w) as bigint) * w as period_start, cast(floor(arr_us / 1000000 / w) as bigint) * w as arrival_start, count(*) filter (not late) as n, count(*) filter (late) as nl, sum(v) filter (not late) as s, count(v) filter (not late) as k, min(v) filter (not late) as lo, max(v) filter (not late) as hi from e group by 1, 2, 3)
          select a.sensor_id, a.period_start, a.arrival_start, cast(count(*) as int) as revision, cast(sum(b.n) as bigint) as records, cast(sum(b.k) as bigint) as readings, round(sum(b.s) + 1e-9, 6) as total, round(sum(b.s) / nullif(sum(b.k), 0) + 1e-9, 6) as mean, min(b.lo) as low, max(b.hi) as high, cast(sum(b.nl) as bigint) as rejected,
            a.arrival_start = max(a.arrival_start) over (partition by a.sensor_id, a.period_start) as is_final
          from c a join c b on a.sensor_id = b.sensor_id and a.period_start = b.period_start and b.arrival_start <= a.arrival_start group by a.sensor_id, a.period_start, a.arrival_start""",
        "p4_found": _LINES + " select line_id from f where fields is null or len(fields) <> k union select line_id from b",
        "p4_rejected": _LINES + """ select line_id, in_data_path, case when fields is null then 'broken quoting' else 'wrong column count' end as reason, null::int as column_id, null as bad_value from f where fields is null or len(fields) <> k
          union all select line_id, in_data_path, 'invalid ' || arg_min(t, column_id) over (partition by line_id), column_id, x from b""",
        "p4_loaded": _LINES + """ select line_id, in_data_path, column_id, nullif(x, '') as text, case when t in ('BYTE', 'INTEGER', 'LONG') and x <> '' then cast(x as bigint) end as as_long, case when t in ('FLOAT', 'DOUBLE') and x <> '' then cast(x as double) end as as_double,
          case when t = 'BOOLEAN' and x <> '' then lower(x) = 'true' end as as_bool, case when t = 'TIMESTAMP' and x <> '' then cast(epoch(cast(x as timestamp)) as bigint) end as as_epoch from v where line_id not in (select line_id from b)""",
        "p5_found": f"""with u as (select sensor_id, ts_us, step_size as w, lead(ts_us) over (partition by sensor_id order by ts_us, msg_id) as nxt from ({_USABLE}) where step_size > 0)
          select sensor_id, cast(unnest(generate_series(cast(floor(ts_us / 1000000 / w) as bigint) * w + w, cast(floor(nxt / 1000000 / w) as bigint) * w - w, w)) as bigint) as slot_epoch from u where nxt - ts_us <= 86400000000""",
        "p5_grid": f"""with u as (select sensor_id, msg_id, ts_us, v, step_size::bigint * 1000000 as w, method_option, cast(floor(ts_us / 1000000 / step_size) as bigint) * step_size * 1000000 as slot from ({_USABLE}) where step_size > 0),
          c as (select sensor_id, slot, w, method_option, count(*) as n, count(v) as k, avg(v) as mean, min(ts_us) as t0, max(ts_us) as t1 from u group by all),
          s as (select *, coalesce(t0 - lag(t1) over o <= 86400000000, false) as tied_back, coalesce(lead(t0) over o - t1 <= 86400000000, false) as tied_on, lead(slot) over o as nxt from c window o as (partition by sensor_id order by slot)),
          g as (select *, unnest(range(slot, case when tied_on then nxt else slot + 1 end, w)) as gt from s),
          lo as (select sensor_id, ts_us, arg_max(v, msg_id) as v from u where v is not null group by all), hi as (select sensor_id, ts_us, arg_min(v, msg_id) as v from u where v is not null group by all),
          a as (select g.*, lo.ts_us as pt, lo.v as pv from g asof left join lo on g.sensor_id = lo.sensor_id and g.gt > lo.ts_us),
          b as (select a.*, hi.ts_us as qt, hi.v as qv from a asof left join hi on a.sensor_id = hi.sensor_id and a.gt <= hi.ts_us),
          f as (select *, coalesce((gt > slot or tied_back) and gt - pt <= 86400000000, false) as bef, coalesce(tied_on and qt - gt <= 86400000000 + w, false) as aft from b)
          select sensor_id, gt // 1000000 as slot_epoch, case when gt = slot then n else 0 end as n_records, coalesce(method_option, '') as method,
            case when gt = slot and k > 0 then 'observed' when value is null then 'marked' else 'filled' end as status, round(value + 1e-9, 6) as value
          from (select *, case when gt = slot and k > 0 then mean when method_option = 'LINEAR' and bef and aft and qt - pt <= 86400000000 then pv + (qv - pv) * (gt - pt) / (qt - pt)
            when method_option = 'NEAREST' then case when bef and (not aft or gt - pt <= qt - gt) then pv when aft then qv end when method_option = 'PREVIOUS' and bef then pv end as value from f)""",
        "p6_found": f"""with t as ({_TRAIN}) select rec_id, 'link_id' as field_name from t where link is null union all select rec_id, 'prcs_spd' from t where spd is null union all select rec_id, 'prcs_trv_time' from t where trv is null""",
        "p6_filled": "with t as (select *, coalesce(detector_id, link) as grp from (" + _TRAIN + ")), a as (" + " union all ".join(_donated(f, n) for f, n in (("link", "link_id"), ("spd", "prcs_spd"), ("trv", "prcs_trv_time"))) + """),
          h as (select field_name, cast(floor(minute / 60) as bigint) as hour, arg_min(val, (minute, rec_id)) as v, arg_min(rec_id, (minute, rec_id)) as r, min(minute) as t from a where val is not null group by 1, 2),
          m as (select *, minute - p.minute as pd, n.minute - minute as nd from a where val is null)
          select m.rec_id, m.field_name, case when pd is null and nd is null then h.v when pd is null or nd < pd then n.val else p.val end as filled, case when pd is null and nd is null then h.r when pd is null or nd < pd then n.rec_id else p.rec_id end as donor_id,
            cast(case when pd is null and nd is null then abs(h.t - m.minute) when pd is null or nd < pd then nd else pd end as bigint) as distance, case when pd is not null or nd is not null then 'group' when h.v is not null then 'hour' end as donor_kind
          from m left join h on h.field_name = m.field_name and h.hour = cast(floor(m.minute / 60) as bigint)""",
    }
