"""Late and out-of-order events: watermark lateness and corrected per-period aggregates. SQL only.

Lateness needs, for each record, the greatest event time among the source's earlier arrivals.
That is a running maximum over a source's whole history; here it is the maximum over earlier
arrival slices (one row per source and slice, pre-aggregated) combined with a running maximum
inside the record's own slice, so that a hot source is spread over many tasks.

Aggregates come from an event-period by arrival-period triangle: each cell is aggregated once,
then summed up across arrivals with windows, which gives every corrected revision of a period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Seconds of the units in which delays and windows are written.
_UNITS = "map('second', 1, 'minute', 60, 'hour', 3600, 'day', 86400, 'week', 604800)"

_MICROS = "(datediff({c}, date'1970-01-01') * 86400L + hour({c}) * 3600 + minute({c}) * 60) * 1000000L + cast(extract(second from {c}) * 1000000 as bigint)"


def seconds_sql(col: str) -> str:
    """SQL for the seconds in texts like '10 minutes'; null where there is no such text."""
    text = f"lower(trim({col}))"
    return f"try_cast(regexp_extract({text}, '^([0-9]+) *([a-z]+?)s?$', 1) as bigint) * element_at({_UNITS}, regexp_extract({text}, '^([0-9]+) *([a-z]+?)s?$', 2))"


def reading_sql(body: str) -> str:
    """SQL for the number in an event body: bare, or under `val` in a JSON object, as number or text."""
    return f"try_cast(coalesce(get_json_object({body}, '$.val'), {body}) as double)"


_USABLE = f"""
  select msg_id, sensor_id, sensor_type, event_body, {_MICROS.format(c='ts')} as ts_us, {_MICROS.format(c='arrived_at')} as arr_us
  from {{records}} where sensor_id is not null and ts is not null and ts <= arrived_at"""

_JUDGED = f"""
with usable as ({_USABLE}),
sliced as (select *, arr_us div {{slice_us}} as slice from usable),
slices as (select sensor_id, slice, max(ts_us) as top, max(sensor_type) as kind from sliced group by sensor_id, slice),
carried as (select sensor_id, slice, max(top) over (partition by sensor_id order by slice rows between unbounded preceding and 1 preceding) as before_us,
  max(kind) over (partition by sensor_id) as kind from slices),
conf as (select sensor_type as kind, first({seconds_sql('watermark_delay')}) as delay_s, first({seconds_sql('window_length')}) as window_s from {{conf}} group by sensor_type),
seen as (select s.*, c.kind, greatest(c.before_us, max(s.ts_us) over (partition by s.sensor_id, s.slice order by s.arr_us, s.msg_id rows between unbounded preceding and 1 preceding)) as high_us
  from sliced s join carried c on s.sensor_id = c.sensor_id and s.slice = c.slice)
select seen.msg_id, seen.sensor_id, seen.kind as sensor_type, seen.event_body, seen.ts_us, seen.arr_us, seen.high_us, conf.delay_s, conf.window_s,
  coalesce(seen.ts_us < seen.high_us - conf.delay_s * 1000000L, false) as late
from seen left join conf on seen.kind = conf.kind"""

_REVISIONS = """
with events as (select sensor_id, ts_us, event_body, min(arr_us) as arr_us, min_by(late, struct(arr_us, msg_id)) as late, max(window_s) as window_s from {judged} group by sensor_id, ts_us, event_body),
valued as (select *, try_cast(coalesce(get_json_object(event_body, '$.val'), event_body) as double) as v from events where window_s > 0),
cells as (select sensor_id, floor(ts_us / 1000000 / window_s) * window_s as period_start, floor(arr_us / 1000000 / window_s) * window_s as arrival_start,
    count_if(not late) as n, count_if(late) as n_late, sum(case when not late then v end) as total, count(case when not late then v end) as readings, min(case when not late then v end) as low, max(case when not late then v end) as high
  from valued group by all)
select sensor_id, period_start, arrival_start, row_number() over by_arrival as revision, sum(n) over so_far as records, sum(readings) over so_far as readings,
  sum(total) over so_far as total, try_divide(sum(total) over so_far, sum(readings) over so_far) as mean, min(low) over so_far as low, max(high) over so_far as high,
  sum(n_late) over so_far as rejected, lead(arrival_start) over by_arrival is null as is_final
from cells
window by_arrival as (partition by sensor_id, period_start order by arrival_start),
  so_far as (partition by sensor_id, period_start order by arrival_start rows between unbounded preceding and current row)"""


def judge_lateness(records: DataFrame, conf: DataFrame, slice_seconds: int = 3_600) -> DataFrame:
    """Every usable record with its sensor's type, the greatest event time before it and `late`.

    Usable: sensor and event time are known and the event is not after its arrival; the rest is left
    out. A sensor's type is the one seen anywhere in its records. Records of a type without settings
    are never late. Arrival ties are ordered by msg_id; redelivered records are judged one by one."""
    # conf holds one row per sensor type: a fixed table; grouped by type, so its size is that of the types
    return records.sparkSession.sql(_JUDGED.replace("{slice_us}", str(slice_seconds * 1_000_000)), records=records, conf=conf)


def revised_aggregates(judged: DataFrame) -> DataFrame:
    """All revisions of each sensor's event periods, from the result of `judge_lateness`.

    A redelivered record (same sensor, event time and body) counts once, by its first arrival. Late
    records are left out of the aggregates and counted as `rejected`. A body without a number counts
    as a record, not as a reading. Times are seconds since 1970."""
    return judged.sparkSession.sql(_REVISIONS, judged=judged)
