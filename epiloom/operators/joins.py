"""Joins by time: as-of, nearest, interpolation, containment and overlap of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiloom.functions.images import hash_distance


#: Seconds of one slice of a series in the as-of joins.
SLICE = 60.0


def _neighbours(left: DataFrame, right: DataFrame, keys: list[str], t: str, payload: list[str], tie: list[str], width: float = SLICE) -> DataFrame:
    """The left rows as ``_l``, with the right row before (``_b``) and the one at or after (``_a``) as structs of r_t and r_payload.

    Both tables go into one series by key, cut into slices of time, so that a key with most rows is spread over many tasks
    and no row is multiplied. Within a slice, two running windows, one along and one against the time, find the neighbours;
    from the first and last right row of each slice, those of slices without one are filled in. Right rows with a NULL in a
    key or the time match nothing; such left rows find nothing.
    """
    l = left.select(*keys, F.col(t).cast("double").alias("_t"), F.lit(0).alias("_side"), F.struct("*").alias("_l"), F.lit(None).cast("double").alias("r_t"), *[F.lit(None).cast(right.schema[p].dataType).alias(f"r_{p}") for p in payload])
    known = [F.col(k).isNotNull() for k in [*keys, t]]
    r = right.where(_all(known))
    r = r.select(*keys, F.col(t).cast("double").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.col(t).cast("double").alias("r_t"), *[F.col(p).alias(f"r_{p}") for p in payload])
    both = l.unionByName(r).withColumn("_slice", F.floor(F.col("_t") / width))
    part = [*keys, "_slice"]
    order = ["_t", "_side", *[f"r_{c}" for c in tie]]
    hit = F.when(F.col("_side") == 1, F.struct("r_t", *[f"r_{c}" for c in tie], *[f"r_{p}" for p in payload if p not in tie]))
    so_far = lambda cols: Window.partitionBy(*part).orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_hit", hit).withColumn("_b", F.last("_hit", ignorenulls=True).over(so_far(order))).withColumn("_a", F.last("_hit", ignorenulls=True).over(so_far([F.desc(c) for c in order])))
    ends = both.groupBy(*part).agg(F.min("_hit").alias("_first"), F.max("_hit").alias("_last"))
    others = lambda o: Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(part)], F.last("_last", ignorenulls=True).over(others("_slice")).alias("_before"), F.last("_first", ignorenulls=True).over(others(F.desc("_slice"))).alias("_after"))
    rows = both.where("_side = 0").join(ends, _all([F.col(c) == F.col(f"_k{i}") for i, c in enumerate(part)]), "left")
    return rows.select("_l", "_t", F.coalesce("_b", "_before").alias("_b"), F.coalesce("_a", "_after").alias("_a"))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for x in tests[1:]:
        out = out & x
    return out


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], t: str, payload: list[str], tie: list[str], clamp: bool = True) -> DataFrame:
    """Each left row with the first right row at or after its time (r_t and the payload); past the end, with the last one.

    ``tie`` are payload columns ordering right rows of one time. A left row without any right row of its key gets NULLs, and
    without ``clamp`` so does one past the end.
    """
    rows = _neighbours(left, right, keys, t, payload, tie)
    found = F.coalesce("_a", "_b") if clamp else F.col("_a")
    return rows.withColumn("_r", found).select("_l.*", "_r.r_t", *[f"_r.r_{p}" for p in payload])


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], t: str, payload: list[str], tie: list[str]) -> DataFrame:
    """Each left row with the right row nearest in time; the earlier one only where strictly nearer."""
    rows = _neighbours(left, right, keys, t, payload, tie)
    a, b = F.col("_a.r_t"), F.col("_b.r_t")
    pick = F.when(a.isNull(), F.col("_b")).when(b.isNull(), F.col("_a")).when(F.col("_t") - b < a - F.col("_t"), F.col("_b")).otherwise(F.col("_a"))
    return rows.withColumn("_r", pick).select("_l.*", "_r.r_t", *[f"_r.r_{p}" for p in payload])


def interpolated(left: DataFrame, right: DataFrame, keys: list[str], t: str, x: str) -> DataFrame:
    """Each left row with ``value``: x of the right rows at its time, piecewise linear, held at both ends; 0 without right rows.

    Of right rows of one time their mean x counts. Left rows need no order and may repeat.
    """
    r = right.where(F.col(x).isNotNull()).groupBy(*keys, t).agg(F.avg(x).alias(x))
    rows = _neighbours(left, r, keys, t, [x], [])
    at, ax, bx = F.col("_t"), F.col(f"_a.r_{x}"), F.col(f"_b.r_{x}")
    between = bx + (ax - bx) * F.try_divide(at - F.col("_b.r_t"), F.col("_a.r_t") - F.col("_b.r_t"))
    value = F.when(ax.isNull() & bx.isNull(), F.lit(0.0)).when(F.col("_a.r_t") == at, ax).when(ax.isNull(), bx).when(bx.isNull(), ax).otherwise(between)
    return rows.select("_l.*", value.alias("value"))


def points_in_intervals(points: DataFrame, spans: DataFrame, keys: list[str], t: str, start: str, end: str, width: float, closed: bool = False) -> DataFrame:
    """All pairs of a point and an interval of the same key that holds it: start <= t < end (or <= end).

    Both sides are cut into slices of ``width`` seconds, so that the join is by equality and an entity that holds most rows is
    spread over its slices; a point lies in one slice, so no pair comes twice.
    """
    p = points.withColumn("_slice", F.floor(F.col(t) / width))
    s = spans.where(F.col(end) >= F.col(start)).withColumn("_slice", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    inside = (F.col(t) >= F.col(start)) & ((F.col(t) <= F.col(end)) if closed else (F.col(t) < F.col(end)))
    return p.join(s, [*keys, "_slice"]).where(inside).drop("_slice")


def overlap_pairs(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: float) -> DataFrame:
    """All pairs of intervals of the same key that overlap, with ``overlap`` (> 0) and ``iou``.

    Joined by slices of ``width`` seconds; a pair is taken in the slice where its overlap begins.
    """
    cut = lambda df, s: df.where(F.col(s[1]) > F.col(s[0])).withColumn("_slice", F.explode(F.sequence(F.floor(F.col(s[0]) / width), F.floor(F.col(s[1]) / width))))
    j = cut(a, a_span).join(cut(b, b_span), [*keys, "_slice"])
    begin, end = F.greatest(a_span[0], b_span[0]), F.least(a_span[1], b_span[1])
    j = j.where((F.col("_slice") == F.floor(begin / width)) & (end > begin))
    union = F.greatest(a_span[1], b_span[1]) - F.least(a_span[0], b_span[0])
    return j.withColumn("overlap", end - begin).withColumn("iou", (end - begin) / union).drop("_slice")


def overlap_fraction(spans: DataFrame, bad: DataFrame, keys: list[str], span: tuple[str, str], bad_span: tuple[str, str], id_: str, width: float) -> DataFrame:
    """(keys, id, bad_fraction): the summed overlap of each interval with the bad ones, as a share of its length; 0 without any."""
    pairs = overlap_pairs(spans.select(*keys, id_, *span), bad.select(*keys, *bad_span), keys, span, bad_span, width)
    total = pairs.groupBy(id_).agg(F.sum("overlap").alias("_o"))
    share = F.when(F.col(span[1]) > F.col(span[0]), F.coalesce("_o", F.lit(0.0)) / (F.col(span[1]) - F.col(span[0])))
    return spans.select(*keys, id_, *span).join(total, id_, "left").select(*keys, id_, F.coalesce(share, F.lit(0.0)).alias("bad_fraction"))


def bound(labels: DataFrame, spans: DataFrame, id_: str, fields: list[str]) -> DataFrame:
    """Labels bound to their source by id, with ``issues``: unknown_id, duplicate_label, or the fields in which they differ."""
    w = Window.partitionBy(id_).orderBy("label_order")
    s = spans.select(F.col(id_), F.lit(True).alias("_known"), *[F.col(f).alias(f"_s_{f}") for f in fields])
    j = labels.join(s, id_, "left").withColumn("_n", F.row_number().over(w))
    known = F.coalesce("_known", F.lit(False))
    tests: list[Column] = [F.when(~known, F.lit("unknown_id")), F.when(F.col("_n") > 1, F.lit("duplicate_label"))]
    tests += [F.when(known & ~F.col(f).eqNullSafe(F.col(f"_s_{f}")), F.lit(f"mismatch_{f}")) for f in fields]
    return j.withColumn("issues", F.filter(F.array(*tests), lambda x: x.isNotNull())).drop("_known", "_n", *[f"_s_{f}" for f in fields])


def aligned(samples: Column) -> Column:
    """Eight samples at even distances along an array; NULL with under three."""
    at = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.bround(k * (F.size(samples) - 1) / 7).cast("int"))
    return F.when(F.size(samples) >= 3, F.transform(at, lambda i: F.get(samples, i)))


def duplicate_pairs(clips: DataFrame) -> DataFrame:
    """(left_id, right_id, kind, mean_hash_distance) of the duplicates among clips (id, file_hash, decoded_hash, frame_count, duration, samples).

    ``samples`` are structs of a hash (63 characters 0 or 1) and a contrast. The first kind that holds is given: identical_file;
    identical_decoded_frames (as many frames, durations less than 0.05 apart); near_duplicate_candidate (durations closer than 0.15
    or 3 % of the left one's, aligned hashes with 0.18 of the bits different at most and 0.10 on average, contrasts over 8).

    Near ones differ in 50 of 504 bits at most, so that of 56 pieces of 9 bits some are equal: joined on those and on bands of duration, without loss.
    """
    side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in df.columns])
    ordered, apart = F.col("left_id") < F.col("right_id"), F.abs(F.col("left_duration") - F.col("right_duration"))
    ids = ["left_id", "right_id"]

    f = clips.select("id", "file_hash")
    files = side(f, "left").join(side(f, "right"), (F.col("left_file_hash") == F.col("right_file_hash")) & ordered).select(*ids, F.lit(0).alias("k"), F.lit(None).cast("double").alias("d"))
    f = clips.select("id", "decoded_hash", "frame_count", "duration")
    same = (F.col("left_decoded_hash") == F.col("right_decoded_hash")) & (F.col("left_frame_count") == F.col("right_frame_count"))
    frames = side(f, "left").join(side(f, "right"), same & ordered & (apart < 0.05)).select(*ids, F.lit(1).alias("k"), F.lit(None).cast("double").alias("d"))

    n = clips.select("id", "duration", aligned(F.col("samples")).alias("s")).where(F.forall("s", lambda x: x["contrast"] > 8))
    n = n.select("id", "duration", F.transform("s", lambda x: x["hash"]).alias("hashes"))
    # Durations that match are less than a band apart.
    band = F.floor(F.when(F.col("duration") <= 5, F.col("duration") / 0.15).otherwise(5 / 0.15 + F.log(F.col("duration") / 5) / 0.03) / 1.05)
    pieces = F.flatten(F.transform("hashes", lambda h, i: F.transform(F.sequence(F.lit(0), F.lit(6)), lambda p: F.concat_ws(":", i, p, F.substr(h, p * 9 + 1, F.lit(9))))))
    keyed = n.select("id", "duration", band.alias("band"), F.explode(pieces).alias("piece"))
    left = keyed.select(F.col("id").alias("left_id"), F.col("duration").alias("left_duration"), "piece", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"))
    right = keyed.select(F.col("id").alias("right_id"), F.col("duration").alias("right_duration"), "piece", "band")
    near = left.join(right, ["band", "piece"]).where(ordered & (apart < F.greatest(F.lit(0.15), F.col("left_duration") * 0.03))).select(*ids).distinct()
    h = n.select("id", "hashes")
    near = near.join(side(h, "left"), "left_id").join(side(h, "right"), "right_id").withColumn("ds", F.zip_with("left_hashes", "right_hashes", hash_distance))
    mean = F.aggregate("ds", F.lit(0.0), lambda a, x: a + x) / 8
    near = near.where((F.array_max("ds") <= 0.18) & (mean <= 0.10)).select(*ids, F.lit(2).alias("k"), mean.alias("d"))

    kinds = F.array(*[F.lit(x) for x in ("identical_file", "identical_decoded_frames", "near_duplicate_candidate")])
    first = files.unionByName(frames).unionByName(near).groupBy(*ids).agg(F.min(F.struct("k", "d")).alias("x"))
    return first.select(*ids, F.get(kinds, F.col("x.k")).alias("kind"), F.col("x.d").alias("mean_hash_distance"))
