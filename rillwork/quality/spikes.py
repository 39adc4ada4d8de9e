"""Implausible readings per source: a hidden Markov model with hard bounds.

Each measured field of a source is a chain of readings in time order. Its hidden states are
normal, spike, stuck and out-of-range. Emissions are relative to the source's own medians:

* normal: Laplace in the log ratio to the source's median and in the log ratio of
  speed x travel time, with density 0 beyond the hard bounds;
* spike: flat in both; stuck: as normal but nearly always equal to a neighbouring reading;
* out-of-range: physically impossible values, and only these.

Forward-backward gives each reading's state probabilities, and the likeliest state is the flag. The hard
bounds are part of the emissions: beyond them nothing is normal, and with `strict` a spike can only be
beyond them and only a run of STUCK_RUN equal readings can be stuck, which leaves to the chain whether it
is. Without `strict`, spikes and stuck values may be anywhere, and their probability is a doubt.

Scale: one shuffle by source. Forward-backward is a product of 4x4 matrices, so a worker
scans all series of a block at once in numpy. Sources above `hot_rows` rows are taken apart into one
chain per field and cut into chunks with halo (series.cut_series). As every row of such a chain has a reading, the
halo is one of readings: the influence of a reading on another's state fades by far more than any number's
precision within `halo` of them, and runs are seen whole. Their quartiles come from an exact two-step selection
(histogram, then the quartiles' buckets only), so a source is judged alike whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..series import CORE, HEADER, cut_series, grouped_quartiles, split_hot, whole_series
from .missing import MissingRules

STATES = ("normal", "spike", "stuck", "out_of_range")
#: Rows: from; columns: to; in the order of STATES.
MOVES = np.array([[0.985, 0.010, 0.002, 0.003], [0.800, 0.150, 0.010, 0.040], [0.040, 0.005, 0.950, 0.005], [0.700, 0.060, 0.010, 0.230]])
START = np.array([0.97, 0.01, 0.01, 0.01])
TIE = np.array([0.10, 0.02, 0.98])
FLAT, FLOOR = 0.12, 1e-4

#: The exact bounds: physical limits, and limits relative to the source's medians.
SPEED_MAX, SPEED_HIGH, SPEED_LOW = 200.0, 1.8, 0.2
TRAVEL_HIGH, TRAVEL_LOW = 5.0, 0.5
PRODUCT_HIGH, PRODUCT_LOW = 1.5, 2 / 3
STUCK_RUN = 10

SCHEMA = "rec_id long, source string, speed_state string, travel_state string, speed_doubt double, travel_doubt double, flagged boolean, reason string"
_JUDGED = "rec_id long, source string, speed_state string, travel_state string, speed_doubt double, travel_doubt double"


def posteriors(emit: np.ndarray, start: np.ndarray, blocks: int = 256) -> np.ndarray:
    """State probabilities for chains laid end to end; `start` marks each chain's first row.

    A blocked scan: products of step matrices per block, then carries between blocks, then
    vectors inside all blocks at once."""
    n, k = emit.shape
    if n == 0:
        return emit
    blocks = max(1, min(blocks, n // 8))
    length = -(-n // blocks)
    pad = blocks * length - n
    e = np.ones((blocks * length, k))
    e[:n] = emit
    s = np.zeros(blocks * length, bool)
    s[:n] = start
    e = np.ascontiguousarray(e.reshape(blocks, length, k).transpose(1, 0, 2))
    s = np.ascontiguousarray(s.reshape(blocks, length).T)
    any_start = s.any(axis=1)
    prod = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for i in range(length):
        step = (prod.reshape(-1, k) @ MOVES).reshape(blocks, k, k)
        if any_start[i]:
            at = s[i]
            step[at] = prod[at].sum(axis=2, keepdims=True) * START
        prod = step * e[i][:, None, :]
        prod /= np.maximum(prod.max(axis=(1, 2), keepdims=True), 1e-300)
    ahead, behind = np.empty((blocks, k)), np.empty((blocks, k))
    carry = START.copy()
    for b in range(blocks):
        ahead[b] = carry
        carry = carry @ prod[b]
        carry /= max(carry.sum(), 1e-300)
    carry = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        behind[b] = carry
        carry = prod[b] @ carry
        carry /= max(carry.max(), 1e-300)
    forward = np.empty_like(e)
    a = ahead
    for i in range(length):
        step = a @ MOVES
        if any_start[i]:
            step[s[i]] = START
        a = step * e[i]
        a /= np.maximum(a.sum(axis=1, keepdims=True), 1e-300)
        forward[i] = a
    b = behind
    for i in range(length - 1, -1, -1):
        forward[i] *= b
        back = e[i] * b
        b = back @ MOVES.T
        if any_start[i]:
            b[s[i]] = (back[s[i]] @ START)[:, None]
        b = b / np.maximum(b.max(axis=1, keepdims=True), 1e-300)
    gamma = forward.transpose(1, 0, 2).reshape(blocks * length, k)[: blocks * length - pad]
    return gamma / np.maximum(gamma.sum(axis=1, keepdims=True), 1e-300)


def _laplace(x: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.exp(-np.abs(x) / scale) / (2 * scale)


def _field_chain(value: np.ndarray, first: np.ndarray, possible: np.ndarray, within: np.ndarray, ratio: np.ndarray, scale: np.ndarray, product: np.ndarray, product_scale: np.ndarray, strict: bool) -> np.ndarray:
    """Posteriors of one field's chain."""
    same = np.zeros(len(value) + 1, bool)
    same[1:-1] = (value[1:] == value[:-1]) & ~first[1:]
    tie = same[:-1] | same[1:]
    run = np.cumsum(~same[:-1]) - 1
    long_run = np.bincount(run)[run] >= STUCK_RUN
    joint = np.where(np.isnan(product), 1.0, _laplace(np.nan_to_num(product), product_scale))
    flat = FLAT * np.where(np.isnan(product), 1.0, FLAT)
    density = np.fmax(_laplace(ratio, scale) * joint, FLOOR)  # a chunk of halo only has no statistics
    tied = np.where(tie[:, None], TIE, 1 - TIE)
    emit = np.zeros((len(value), 4))
    emit[:, 0] = np.where(possible & within, density * tied[:, 0], 0)
    emit[:, 1] = np.where(possible & ~(within & strict), flat * tied[:, 1], 0)
    emit[:, 2] = np.where(possible & (long_run | (not strict)), density * tied[:, 2], 0)
    emit[:, 3] = ~possible
    return posteriors(emit, first)


def _judge(doubt: float, everything: bool, strict: bool, cut: bool):
    out_schema = pa.schema([("rec_id", pa.int64()), ("source", pa.string()), ("speed_state", pa.string()), ("travel_state", pa.string()), ("speed_doubt", pa.float64()), ("travel_doubt", pa.float64())])
    names = pa.array(STATES)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_series(batches):
            kind = table["kind"].to_numpy()
            rec = table["rec"].to_numpy()
            a = table["a"].to_numpy(zero_copy_only=False).astype(float)
            b = table["b"].to_numpy(zero_copy_only=False).astype(float)
            only = table["chunk"].to_numpy() % 2 if cut else np.full(len(a), -1)
            series = np.cumsum(first) - 1
            groups = int(series[-1]) + 1
            header = kind == HEADER
            a_has, b_has = ~np.isnan(a) & ~header, ~np.isnan(b) & ~header
            a_ok, b_ok = a_has & (a > 0) & (a <= SPEED_MAX), b_has & (b > 0)
            both = a_ok & b_ok
            with np.errstate(all="ignore"):
                p = np.where(both, a * b, np.nan)
                mid, spread = np.full((3, groups), np.nan), np.full((3, groups), np.nan)
                if cut:  # a cut source brings its own statistics
                    for i in np.flatnonzero(header):
                        (mid if rec[i] < 3 else spread)[rec[i] % 3, series[i]] = a[i]
                else:
                    for f, (v, ok) in enumerate(((a, a_ok), (b, b_ok), (p, both))):
                        mid[f], low, high = grouped_quartiles(v[ok], series[ok], groups)
                        spread[f] = np.log(high / low) / 2
                scale = np.maximum(np.nan_to_num(spread, nan=0.1), 0.02)
                ra, rb, rp = a / mid[0, series], b / mid[1, series], p / mid[2, series]
                a_in, b_in = (ra <= SPEED_HIGH) & (ra >= SPEED_LOW), (rb <= TRAVEL_HIGH) & (rb >= TRAVEL_LOW)
                p_in = ~both | ((rp <= PRODUCT_HIGH) & (rp >= PRODUCT_LOW))
                log_p = np.where(both, np.log(np.where(both, rp, 1)), np.nan)
                normal = np.ones((2, len(a)))
                state = np.full((2, len(a)), -1)
                for f, (v, has, ok, inside, ratio) in enumerate(((a, a_has, a_ok, a_in, ra), (b, b_has, b_ok, b_in, rb))):
                    at = np.flatnonzero(has & (only != 1 - f))
                    if len(at) == 0:
                        continue
                    begin = np.ones(len(at), bool)
                    begin[1:] = np.diff(series[at]) != 0
                    log_r = np.where(ok[at], np.log(np.where(ok[at], ratio[at], 1)), 0.0)
                    gamma = _field_chain(v[at], begin, ok[at], inside[at] & p_in[at], log_r, scale[f, series[at]], log_p[at], scale[2, series[at]], strict)
                    normal[f, at], state[f, at] = gamma[:, 0], gamma.argmax(axis=1)
            shown = (state >= 0) & (everything | (normal < doubt) | (state > 0))
            state, normal = np.where(shown, state, -1), np.where(shown, normal, 1)
            keep = np.flatnonzero((kind == CORE) & shown.any(axis=0))
            pick = lambda f: names.take(pa.array(np.where(state[f, keep] < 0, 0, state[f, keep]), mask=state[f, keep] < 0))
            src = table["src"].combine_chunks() if isinstance(table["src"], pa.ChunkedArray) else table["src"]
            yield from pa.Table.from_arrays([pa.array(rec[keep]), src.take(pa.array(keep)), pick(0), pick(1), pa.array(1 - normal[0, keep]), pa.array(1 - normal[1, keep])], schema=out_schema).to_batches()

    return judge


def exact_medians(rows: DataFrame) -> DataFrame:
    """Per (src, field) of rows (src, field, v > 0): exact median, and as spread half the log ratio of the
    values at three quarters and a quarter.

    Counts per logarithmic bucket give the buckets of these ranks; only those buckets' values
    are counted one by one. No task gets a source's values as a group."""
    bucket = F.floor(F.ln("v") * 64)
    hist = rows.groupBy("src", "field", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every, upto = Window.partitionBy("src", "field"), Window.partitionBy("src", "field").orderBy("bucket")
    hist = hist.withColumns({"total": F.sum("n").over(every), "end": F.sum("n").over(upto)}).withColumn("begin", F.col("end") - F.col("n"))
    covers = lambda rank: (F.col("begin") <= rank) & (rank < F.col("end"))
    total = F.col("total")
    ranks = [F.floor((total - 1) / 2), F.floor(total / 2), F.floor(total / 4), F.floor(total * 3 / 4)]
    wanted = hist.where(covers(ranks[0]) | covers(ranks[1]) | covers(ranks[2]) | covers(ranks[3])).select("src", "field", "bucket", "begin", "total")
    values = rows.withColumn("bucket", bucket).join(wanted, ["src", "field", "bucket"]).groupBy("src", "field", "bucket", "begin", "total", "v").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("src", "field", "bucket").orderBy("v")
    values = values.withColumn("end", F.col("begin") + F.sum("n").over(inside)).withColumn("begin", F.col("end") - F.col("n"))
    low, high, first, third = (F.max(F.when(covers(r), F.col("v"))) for r in ranks)
    return values.groupBy("src", "field").agg(((low + high) / 2).alias("median"), (F.ln(third / first) / 2).alias("spread"))


def _hot_rows(hot: DataFrame, hot_rows: int, halo: int) -> DataFrame:
    """Rows of hot sources, one chain per field (told by the parity of `chunk`), under headers with their statistics."""
    field = F.explode(F.array_compact(F.array(F.when(F.col("a").isNotNull(), F.lit(0)), F.when(F.col("b").isNotNull(), F.lit(1)))))
    rows, chunks = cut_series(hot.select("*", field.alias("field")), ["src", "field"], hot_rows, halo, unit=1440)
    a, b = F.when((F.col("a") > 0) & (F.col("a") <= SPEED_MAX), F.col("a")), F.when(F.col("b") > 0, F.col("b"))
    stats = exact_medians(hot.select("src", F.stack(F.lit(3), F.lit(0), a, F.lit(1), b, F.lit(2), a * b).alias("of", "v")).where("v is not null").withColumnRenamed("of", "field"))
    per = F.explode(F.array(F.struct(F.col("of").cast("long").alias("rec"), F.col("median").alias("a")), F.struct((F.col("of") + 3).cast("long").alias("rec"), F.col("spread").alias("a"))))
    heads = chunks.join(stats.withColumnRenamed("field", "of"), "src").select("src", "field", "chunk", per.alias("h"))
    parted = (F.col("chunk") * 2 + F.col("field")).alias("chunk")
    return rows.select("src", "t", "rec", "a", "b", parted, "kind").unionByName(heads.select("src", F.lit(-(2**62)).alias("t"), "h.rec", "h.a", F.lit(None).cast("double").alias("b"), parted, F.lit(HEADER).alias("kind")))


def flag_spikes(df: DataFrame, rules: MissingRules, t, *, rec: str = "rec_id", source: str = "link_id", speed: str = "prcs_spd", travel: str = "prcs_trv_time", strict: bool = True, doubt: float = 0.95, everything: bool = False, hot_rows: int = 200_000, halo: int = 1024) -> DataFrame:
    """Judge each reading of `df`; `t` is the column expression of the reading's time.

    Returns one row per record id and source with SCHEMA, for flagged records and those of which a reading
    is normal with a probability below `doubt` (`everything`: for all). `flagged`: a field's likeliest state is not normal.
    A field that is neither flagged nor doubtful has no state and doubt 0.
    Defined cases: a record without known source belongs to no source and is never judged; a missing value is
    no reading and is passed over; records without a valid time sort first; ties in time are
    ordered by record id; records sent under the same id are readings of their own and share a row; other columns are ignored."""
    base = df.select(rules.source(source).alias("src"), t.cast("long").alias("t"), F.col(rec).cast("long").alias("rec"), rules.value(speed).alias("a"), rules.value(travel).alias("b")).where("src is not null and rec is not null and (a is not null or b is not null)")
    cold, hot, _ = split_hot(base, "src", hot_rows)
    run = lambda rows, cut: rows.repartition("src", "chunk").sortWithinPartitions("src", "chunk", "t", "rec").mapInArrow(_judge(doubt, everything, strict, cut), _JUDGED)
    judged = run(cold.withColumns({"chunk": F.lit(0), "kind": F.lit(CORE)}), False)
    if hot is not None:
        judged = judged.unionByName(run(_hot_rows(hot, hot_rows, halo), True))
    one = judged.groupBy("rec_id", "source").agg(*(F.max(F.when(F.col(c).isNotNull(), F.array_position(F.array(*map(F.lit, STATES)), F.col(c)))).alias(c) for c in ("speed_state", "travel_state")), F.max("speed_doubt").alias("speed_doubt"), F.max("travel_doubt").alias("travel_doubt"))
    named = lambda c: F.get(F.array(*map(F.lit, STATES)), (F.col(c) - 1).cast("int"))
    out = one.withColumns({c: named(c) for c in ("speed_state", "travel_state")})
    any_ = lambda s: F.coalesce(F.col("speed_state") == s, F.lit(False)) | F.coalesce(F.col("travel_state") == s, F.lit(False))
    reason = F.when(any_("out_of_range"), "out_of_range").when(any_("spike"), "spike").when(any_("stuck"), "stuck").when(F.greatest("speed_doubt", "travel_doubt") > 1 - doubt, "doubtful").otherwise("")
    return out.select("rec_id", "source", "speed_state", "travel_state", "speed_doubt", "travel_doubt", (any_("out_of_range") | any_("spike") | any_("stuck")).alias("flagged"), reason.alias("reason"))
