"""Matching of records to the nearest record in time of the same entity, within a tolerance.

Both tables are hash-partitioned by entity and slice of time into Arrow groups of bounded size; records near the border
of a slice of the right table go to both slices. Inside each group DuckDB runs one ASOF join backward and one forward,
and the nearer candidate within the tolerance is kept.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiloom.session import shuffle_partitions

#: Rows of the right table that a group holds on average.
GROUP_ROWS = 100_000

ASOF = """
WITH back AS (SELECT l.id, r.id AS rid, l.t - r.t AS d FROM l ASOF JOIN r ON l.k = r.k AND l.s = r.s AND l.t >= r.t),
     fore AS (SELECT l.id, r.id AS rid, r.t - l.t AS d FROM l ASOF JOIN r ON l.k = r.k AND l.s = r.s AND l.t <= r.t),
     both_ AS (SELECT * FROM back UNION ALL SELECT * FROM fore)
SELECT id, arg_min(rid, (d, rid)) AS rid, min(d) AS d FROM both_ WHERE d <= {tolerance} GROUP BY id
"""


def _join(tolerance: int):
    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("d", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        try:
            con.register("l", left)
            con.register("r", right)
            got = con.sql(ASOF.format(tolerance=tolerance)).to_arrow_table()
        finally:
            con.close()
        return got.cast(out)

    return join


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_us: int, slice_us: int = 10_000_000) -> DataFrame:
    """For each row of ``left`` the row of ``right`` of the same entity nearest in time, at most ``tolerance_us`` away.

    Both have the columns id BIGINT, k STRING (the entity) and t BIGINT (microseconds); others are not read. Returns
    (id, rid, d): the left id, the right id and their distance. A left row without a right row in reach gives none, and
    nor does one with a NULL in id, k or t; such right rows are never matched. Of right rows equally near the least id
    is taken. Left rows that repeat an id are one record, held at the least (k, t). A right row may serve several left rows. Empty
    tables give no row.

    Right rows of one entity and time are collapsed to the least id before the shuffle, so bursts and redelivered rows
    add nothing; an entity that holds most rows is spread over its slices of time.
    """
    spark = left.sparkSession
    assert 0 <= tolerance_us < slice_us
    n = max(shuffle_partitions(spark), -(-right.count() // GROUP_ROWS))
    l = left.where("id IS NOT NULL AND k IS NOT NULL AND t IS NOT NULL").groupBy("id").agg(F.min(F.struct("k", "t")).alias("x"))
    l = l.select(F.col("id").cast("bigint"), "x.k", "x.t", F.floor(F.col("x.t") / slice_us).cast("bigint").alias("s"))
    r = right.where("id IS NOT NULL AND k IS NOT NULL AND t IS NOT NULL").groupBy("k", "t").agg(F.min("id").cast("bigint").alias("id"))
    first, last = (F.floor((F.col("t") + x) / slice_us).cast("bigint") for x in (-tolerance_us, tolerance_us))
    r = r.select("id", "k", "t", F.explode(F.array_distinct(F.array(first, last))).alias("s"))
    part = F.pmod(F.xxhash64("k", "s"), F.lit(n)).cast("int")
    l, r = (x.select(part.alias("p"), "id", "k", "t", "s") for x in (l, r))
    return l.groupBy("p").cogroup(r.groupBy("p")).applyInArrow(_join(tolerance_us), "id BIGINT, rid BIGINT, d BIGINT")
