"""Exact order statistics per key by counting, without sorting or numbering the rows of a key.

A key of any size only contributes counts that are combined on the map side. The count table is walked from coarse
to fine blocks, and a window sees the blocks inside one chosen block, never the rows themselves. Each function is one
SQL statement: its plan is analysed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from opslens.functions.ranking import never_null

# first cut of doubles: buckets of a 1024th of a factor e, zero at code 0; then linear parts of the chosen bucket
LOG_STEP, LOG_ZERO = 1024, 1 << 20
SUB_BUCKETS = 65535


def newest_cutoff(df: DataFrame, key: str, order: str, newest: str) -> DataFrame:
    """Per key: total rows, recent_rows = `newest` (SQL over total) and cutoff, the number of the recent_rows-th newest.

    `order` is a unique long; a null there is an error. Where numbers repeat, rows that share one fall on one side.
    The rows are read once: 64 numbers are one row with a bit per number that occurs. These are summed up per 2^24
    numbers (a batch of sources.batches), so a window meets a row per batch or the rows of one batch.
    """
    return df.sparkSession.sql(
        f"""
        WITH bits AS (
          SELECT k, shiftright(at, 24) AS batch, shiftright(at, 6) AS block, count(*) AS n,
                 bit_or(shiftleft(1L, cast(at & 63 AS int))) AS bits
          FROM {{numbers}} GROUP BY ALL),
        batches AS (SELECT k, batch, sum(n) AS n FROM bits GROUP BY ALL),
        summed AS (
          SELECT *, sum(n) OVER (PARTITION BY k) AS total, sum(n) OVER (PARTITION BY k ORDER BY batch DESC) AS through
          FROM batches),
        sized AS (SELECT *, {newest} AS recent_rows FROM summed),
        picked AS (
          SELECT k, batch, total, recent_rows, recent_rows - (through - n) AS need
          FROM sized WHERE recent_rows > through - n AND recent_rows <= through),
        inside AS (
          SELECT b.*, total, recent_rows, need, sum(b.n) OVER (PARTITION BY b.k, b.batch ORDER BY b.block DESC) AS through
          FROM bits b JOIN picked p ON b.k <=> p.k AND b.batch = p.batch)
        SELECT k AS `{key}`, total, recent_rows, shiftleft(block, 6) + element_at(
                 filter(sequence(63, 0, -1), i -> getbit(bits, i) = 1), cast(least(need - (through - n), bit_count(bits)) AS int)
               ) AS cutoff
        FROM inside WHERE need > through - n AND need <= through
        """,
        numbers=df.select(df[key].alias("k"), never_null(order).alias("at")),
    )


def medians(values: DataFrame, keys: Sequence[str], value: str = "value", n: str = "n") -> DataFrame:
    """Per key: samples and their median, from (keys, value, n) rows that each stand for n equal samples.

    Values may repeat over rows; keys and values must not be null. Three rounds over the table: the bucket of a logarithmic
    scale that holds the middle rank, the linear part of it that does, the values in there. Both scales
    grow with the value, so all other buckets lie below or above the middle. NaN is above all numbers.
    """
    k = ", ".join(f"`{name}`" for name in keys)
    holds = "WHERE through - n <= middle AND middle < through"
    return values.sparkSession.sql(
        f"""
        WITH coded AS (
          SELECT {k}, {value} AS v, {n} AS n, CASE
                   WHEN isnan({value}) THEN {4 * LOG_ZERO}L WHEN {value} = 0 THEN 0L
                   ELSE cast(sign({value}) * ({LOG_ZERO} + floor(least(ln(abs({value})), 720D) * {LOG_STEP})) AS bigint) END AS a
          FROM {{values}}),
        buckets AS (SELECT {k}, a, sum(n) AS n, min(v) AS lo, max(v) AS hi FROM coded GROUP BY ALL),
        ranked AS (
          SELECT *, sum(n) OVER o AS through, sum(n) OVER (PARTITION BY {k}) AS samples, lead(lo) OVER o AS following
          FROM buckets WINDOW o AS (PARTITION BY {k} ORDER BY a)),
        top AS (
          SELECT {k}, a, lo, hi, samples, following, middle - (through - n) AS middle
          FROM (SELECT *, (samples - 1) div 2 AS middle FROM ranked) {holds}),
        inside AS (
          SELECT {k}, v, n, samples, middle, following,
                 if(hi > lo, cast(floor((v - lo) / (hi - lo) * {SUB_BUCKETS}) AS bigint), 0L) AS b
          FROM coded JOIN top USING ({k}, a)),
        parts AS (
          SELECT {k}, b, sum(n) AS n, min(v) AS lo, max(samples) AS samples, max(middle) AS middle, max(following) AS following
          FROM inside GROUP BY {k}, b),
        part_ranks AS (
          SELECT *, sum(n) OVER o AS through, lead(lo) OVER o AS next_lo FROM parts WINDOW o AS (PARTITION BY {k} ORDER BY b)),
        part AS (
          SELECT {k}, b, middle - (through - n) AS middle, coalesce(next_lo, following) AS following FROM part_ranks {holds}),
        last AS (
          SELECT {k}, i.v, i.n, samples, p.middle, coalesce(lead(i.v) OVER o, p.following) AS next_v,
                 sum(i.n) OVER (PARTITION BY {k} ORDER BY i.v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through
          FROM inside i JOIN part p USING ({k}, b) WINDOW o AS (PARTITION BY {k} ORDER BY i.v))
        -- an even number of samples has two middle ones
        SELECT {k}, samples, if(samples % 2 = 1 OR through > middle + 1, v, 0.5D * v + 0.5D * next_v) AS median FROM last {holds}
        """,
        values=values,
    )
