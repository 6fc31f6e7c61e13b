"""Queries of the order-dependent folds. SQL can't express most of them; tests/test_folds.py checks the folds against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from epiloom.operators import folds, joins
from epiloom.operators.signal import box_smooth, dwelt
from epiloom.plans.records import spans
from epiloom.plans.registry import fixed, query, sql_fixed
from epiloom.plans.signals import CE, KEYS, ORDER, contacts
from epiloom.session import load


def kept_rows(df, keys, order, pick, columns):
    """The rows of each group whose positions ``pick`` gives."""
    f = lambda p: p.iloc[pick(p)][columns]
    return folds.grouped(df, keys, order, f, df.select(*columns).schema.simpleString()[7:-1])


@query(
    "w8_dwell",
    f"""WITH {CE}, a AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR type IS DISTINCT FROM lag(type) OVER w THEN 1 ELSE 0 END AS new FROM ce WINDOW w AS (PARTITION BY episode, side ORDER BY t, event_id)),
    b AS (SELECT *, sum(new) OVER (PARTITION BY episode, side ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS k FROM a),
    c AS (SELECT episode, side, k, min(type) AS type, min(t) AS s, max(t) AS l FROM b GROUP BY episode, side, k),
    d AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY episode, side ORDER BY k), l) AS e FROM c),
    f AS (SELECT episode, side, k, last_value(CASE WHEN k = 1 OR e - s >= 0.5 THEN type END IGNORE NULLS) OVER (PARTITION BY episode, side ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM d)
    SELECT event_id, state FROM b JOIN f ON b.episode = f.episode AND b.side = f.side AND b.k = f.k""",
)
def w8(spark, sf_dir):
    """Event types with runs of under half a second taken into the one before: one pass over the runs, since taking in only lengthens a run."""
    return dwelt(contacts(spark, sf_dir), "type", "t", KEYS, ORDER, 0.5).select("event_id", F.col("dwelt").alias("state"))


@query("w10_prominent_minima")
def w10(spark, sf_dir):
    """Troughs of wrist speed: 0.06 deep, 1.5 s apart."""
    pick = lambda p: folds.prominent_minima(p.v.to_numpy(), p.t.to_numpy(), 0.06, 1.5)
    return kept_rows(contacts(spark, sf_dir), KEYS, ORDER, pick, ["event_id", "episode", "side", "t"])


@query("w14_alternating")
def w14(spark, sf_dir):
    """Contacts and releases accepted in turn, at least 0.3 s apart."""
    return kept_rows(contacts(spark, sf_dir), KEYS, ORDER, lambda p: folds.alternating(p.type.tolist(), p.t.tolist(), 0.3), ["event_id", "episode", "side", "type", "t"])


@query(
    "w16_activity",
    f"""WITH {CE}, p AS (SELECT episode, side, greatest(quantile_cont(v, 0.9), 1e-9) AS pv, greatest(quantile_cont(abs(r), 0.9), 1e-9) AS pr FROM ce GROUP BY episode, side HAVING count(*) >= 8),
    a AS (SELECT ce.*, greatest(v / pv, abs(r) / pr) AS a, count(*) OVER (PARTITION BY episode, side) AS n FROM ce JOIN p USING (episode, side))
    SELECT event_id, {sql_fixed("avg(a) OVER (PARTITION BY episode, side ORDER BY t, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")} AS activity FROM a""",
)
def w16(spark, sf_dir):
    """The greatest of the channels, each in units of its 90th percentile, smoothed; sides of under eight rows are left out."""
    c = contacts(spark, sf_dir)
    p = c.groupBy(*KEYS).agg(F.greatest(F.percentile("v", F.lit(0.9)), F.lit(1e-9)).alias("pv"), F.greatest(F.percentile(F.abs("r"), F.lit(0.9)), F.lit(1e-9)).alias("pr"), F.count(F.lit(1)).alias("n")).where("n >= 8")
    a = c.join(p, KEYS).withColumn("a", F.greatest(F.col("v") / F.col("pv"), F.abs("r") / F.col("pr")))
    return a.select("event_id", fixed(box_smooth(F.col("a"), 3, KEYS, ORDER)).alias("activity"))


@query("w25_thinned")
def w25(spark, sf_dir):
    """Events at least half a second apart, the first kept."""
    return kept_rows(contacts(spark, sf_dir), KEYS, ORDER, lambda p: folds.thinned(p.t.tolist(), 0.5), ["event_id", "episode", "side", "t"])


def with_minima(spark, sf_dir, rows):
    """(episode, kind, a, z, v): intervals (kind 0) and speed minima (kind 1, at a) of each episode, for one grouped map."""
    s = rows.select("episode", F.lit(0).alias("kind"), F.col("start_ts").alias("a"), F.col("end_ts").alias("z"), F.lit(0.0).alias("v"))
    m = contacts(spark, sf_dir).select("episode", F.lit(1).alias("kind"), F.col("t").alias("a"), F.col("t").alias("z"), F.col("v"))
    return s.unionByName(m)


def split(p):
    s, m = p[p.kind == 0], p[p.kind == 1]
    return list(zip(s.a, s.z)), list(zip(m.a, m.v))


def troughs(m, depth, gap=0.0):
    """The prominent minima of (time, level) samples."""
    if not m:
        return []
    t, v = (np.array(x) for x in zip(*m))
    return [(t[i], v[i]) for i in folds.prominent_minima(v, t, depth, gap)]


def by_episode(rows, f, schema):
    """The rows that ``f`` gives for each episode's intervals and its samples (time, level), with the episode; ``schema`` is that of f's rows."""
    names = [x.split()[0] for x in schema.split(", ")]

    def block(p, at):
        kind, a, z, v = (folds.numbers(p, c) for c in ("kind", "a", "z", "v"))
        first, out = [], []
        for i, j in zip(at, at[1:]):
            m = i + np.searchsorted(kind[i:j], 1)
            own = f(list(zip(a[i:m].tolist(), z[i:m].tolist())), list(zip(a[m:j].tolist(), v[m:j].tolist())))
            first += [i] * len(own)
            out += own
        columns = zip(*out) if out else [[] for _ in names]
        return {"episode": p.column("episode").combine_chunks().take(pa.array(first, pa.int64())), **dict(zip(names, columns))}

    return folds.blocked(rows, ["episode"], ["kind", "a", "z", F.asc_nulls_last("v")], block, f"episode STRING, {schema}")


@query("w18_banded")
def w18(spark, sf_dir):
    """The spans of each episode brought into the band of durations."""

    def f(p):
        s, m = split(p)
        out = folds.banded(s, m, troughs(m, 0.06 * 0.35))
        return pd.DataFrame({"episode": [p.episode.iloc[0]] * len(out), "a": [a for a, _ in out], "z": [z for _, z in out]})

    rows = spans(spark, sf_dir).where("end_ts > start_ts")
    return folds.grouped(with_minima(spark, sf_dir, rows), ["episode"], ["kind", "a", "z", "v"], f, "episode STRING, a DOUBLE, z DOUBLE")


@query("w19_refined")
def w19(spark, sf_dir):
    """The starts of each episode's spans as boundaries, moved to speed minima."""

    def f(s, m):
        return folds.refined(sorted({a for a, _ in s}), m, troughs(m, 0.06))

    rows = spans(spark, sf_dir).where("end_ts > start_ts")
    return by_episode(with_minima(spark, sf_dir, rows), f, "boundary DOUBLE, candidates BIGINT, reason STRING")


#: What a span and a caption both say of an activity.
SAID = ("cls", "hand", "ap_trend")


def intervals(spark, sf_dir):
    """Spans and captions that are intervals."""
    s = spans(spark, sf_dir).where("end_ts > start_ts").select("segment", "span_id", F.col("start_ts").alias("a"), F.col("end_ts").alias("z"), *SAID)
    c = load(spark, sf_dir, "baseline_vision").where("end_ts > start_ts").select("segment", "record_id", F.col("start_ts").alias("ca"), F.col("end_ts").alias("cz"), *[F.col(x).alias(f"c_{x}") for x in SAID])
    return s, c


def overlapping(spark, sf_dir):
    """Overlapping pairs of a span and a caption of one segment, each segment's pairs being one group.

    ``pair_score`` is the share of the fields SAID in which the two agree; NULL agrees with nothing.
    """
    pairs = joins.overlap_pairs(*intervals(spark, sf_dir), ["segment"], ("a", "z"), ("ca", "cz"), 4.0)
    agree = sum((F.coalesce(F.lower(F.trim(x)) == F.lower(F.trim(f"c_{x}")), F.lit(False)).cast("int") for x in SAID), F.lit(0))
    return pairs.select("segment", "span_id", "record_id", "a", "ca", "iou", (agree / len(SAID)).alias("pair_score"))


def matrix(p):
    i, rows = pd.factorize(pd.MultiIndex.from_frame(p[["a", "span_id"]]), sort=True)
    j, cols = pd.factorize(pd.MultiIndex.from_frame(p[["ca", "record_id"]]), sort=True)
    m = np.zeros((len(rows), len(cols)))
    m[i, j] = p.iou
    return m, [r[1] for r in rows], [c[1] for c in cols]


@query("j8_greedy_iou")
def j8(spark, sf_dir):
    """One-to-one pairs of spans and captions by descending overlap."""

    def f(p, at):
        kept = []
        span, record = (p.column(c).to_pylist() for c in ("span_id", "record_id"))
        for a, z in zip(at, at[1:]):
            kept += [a + k for k in folds.unmatched(zip(span[a:z], record[a:z]))]
        taken = p.take(pa.array(kept, pa.int64()))
        return {c: taken.column(c).combine_chunks() for c in ("span_id", "record_id", "iou")}

    pairs = overlapping(spark, sf_dir).drop("pair_score").where("iou >= 0.3 AND NOT isnan(iou)")
    return folds.blocked(pairs, ["segment"], [F.desc("iou"), "a", "span_id", "ca", "record_id"], f, "span_id STRING, record_id BIGINT, iou DOUBLE")


@query("a16_monotone_alignment")
def a16(spark, sf_dir):
    """The alignment of captions with spans in order, by segment: its sum over all of either side, and F1; 0 without a pair.

    A pair counts its overlap times its pair score. Spans have no text, so the share of equal fields stands in for METEOR.
    """

    def f(p):
        m, _, _ = matrix(p)
        return pd.DataFrame({"segment": [p.segment.iloc[0]], "total": [folds.monotone_alignment(m)]})

    pairs = overlapping(spark, sf_dir).withColumn("iou", F.col("iou") * F.col("pair_score"))
    totals = folds.grouped(pairs, ["segment"], ["a", "span_id", "ca", "record_id"], f, "segment STRING, total DOUBLE")
    s, c = (x.groupBy("segment").agg(F.count(F.lit(1)).alias(n)) for x, n in zip(intervals(spark, sf_dir), ("spans", "captions")))
    sides = s.unionByName(c, allowMissingColumns=True).unionByName(totals, allowMissingColumns=True).groupBy("segment")
    sides = sides.agg(*[F.sum(x).alias(x) for x in ("spans", "captions", "total")])
    share = lambda n: F.coalesce(F.col("total") / F.col(n), F.lit(0.0))
    out = sides.select("segment", share("captions").alias("precision"), share("spans").alias("recall"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


@query("j9_greedy_nearest")
def j9(spark, sf_dir):
    """Hand-labelled events and detected ones of the same hand and type, one to one, within 0.15 s."""
    g = load(spark, sf_dir, "gold").select(F.lower(F.trim("episode")).alias("episode"), F.explode("events").alias("e")).where("e.t IS NOT NULL AND e.hand IS NOT NULL")
    side = F.when(F.lower(F.trim("e.hand")).startswith("l"), "left").otherwise("right")
    g = g.select("episode", side.alias("side"), F.col("e.type").alias("type"), F.lit(0).alias("seen"), F.col("e.gold_event_id").alias("id"), F.col("e.t").alias("t")).distinct()
    c = contacts(spark, sf_dir).select("episode", "side", "type", F.lit(1).alias("seen"), F.col("event_id").alias("id"), "t")
    labelled = g.select("episode", "side", "type").distinct()

    def f(p, at):
        seen, t, ids = folds.numbers(p, "seen"), folds.numbers(p, "t"), p.column("id").combine_chunks()
        gold, found = [], []
        for a, z in zip(at, at[1:]):
            m = a + np.searchsorted(seen[a:z], 1)
            for i, j in folds.greedy_nearest(t[a:m].tolist(), t[m:z].tolist(), 0.15) if a < m < z else ():
                gold.append(a + i)
                found.append(m + j)
        return {"gold_event_id": ids.take(pa.array(gold, pa.int64())), "event_id": ids.take(pa.array(found, pa.int64()))}

    keys = ["episode", "side", "type"]
    return folds.blocked(g.unionByName(c.join(labelled, keys, "left_semi")), keys, ["seen", "t", "id"], f, "gold_event_id BIGINT, event_id BIGINT")


def boxes(spark, sf_dir):
    """A box for each detected event: its place from the aperture's change and rate, its size from the speed; a frame is 0.1 s."""
    c = contacts(spark, sf_dir).withColumn("frame", F.floor(F.col("t") * 10).cast("bigint"))
    x, y, s = F.col("d") * 1000, F.col("r") * 50, 40 + F.col("v") * 20
    return c.select("episode", "event_id", "frame", x.alias("x1"), y.alias("y1"), (x + s).alias("x2"), (y + s).alias("y2"), F.col("v").alias("score"), (F.col("v") > 0.4).alias("strong"))


@query("j21_suppressed")
def j21(spark, sf_dir):
    """Boxes of each second that no better one overlaps by half."""
    b = boxes(spark, sf_dir).withColumn("second", F.floor(F.col("frame") / 10).cast("bigint"))
    columns = ["episode", "second", "event_id"]

    def f(p, at):
        corners = np.column_stack([folds.numbers(p, x) for x in ("x1", "y1", "x2", "y2")])
        kept = p.take(folds.suppressed_by_group(corners, folds.numbers(p, "score"), at))
        return {c: kept.column(c).combine_chunks() for c in columns}

    return folds.blocked(b, columns[:2], ["event_id"], f, "episode STRING, second BIGINT, event_id BIGINT")


@query("t1_tracks")
def t1(spark, sf_dir):
    """Boxes bound to tracks, frame by frame."""

    def f(p):
        frames = []
        for frame, rows in p.groupby("frame", sort=True):
            frames.append((int(frame), frame / 10, [(np.array(r[:4], dtype=np.float64), bool(r[4])) for r in rows[["x1", "y1", "x2", "y2", "strong"]].to_numpy()]))
        out = folds.track(frames)
        return pd.DataFrame([(p.episode.iloc[0], *o) for o in out], columns=["episode", "frame", "track", "detection", "status"])

    return folds.grouped(boxes(spark, sf_dir), ["episode"], ["frame", "event_id"], f, "episode STRING, frame BIGINT, track INT, detection INT, status STRING")


@query("a17_bleu")
def a17(spark, sf_dir):
    """Each caption against the first one of its span, by smoothed BLEU."""
    c = load(spark, sf_dir, "baseline_vision").where("text IS NOT NULL").select("record_id", "span_id", "text")
    first = c.groupBy("span_id").agg(F.min_by("text", "record_id").alias("reference"), F.min("record_id").alias("first_id"))
    pairs = c.join(first, "span_id").where("record_id <> first_id").select("record_id", "text", "reference")

    def score(batches):
        for p in batches:
            yield pd.DataFrame({"record_id": p.record_id, "bleu": [folds.bleu(a.lower().split(), b.lower().split()) for a, b in zip(p.text, p.reference)]})

    return pairs.mapInPandas(score, "record_id BIGINT, bleu DOUBLE")


@query("a30_principal_components")
def a30(spark, sf_dir):
    """The first six principal components of the embeddings, from summed outer products: one 65 x 65 matrix a partition."""

    def partial(batches):
        total = None
        for p in batches:
            x = np.stack(p.embedding.to_numpy()).astype(np.float64) if len(p) else np.empty((0, 0))
            if len(x):
                y = np.hstack([np.ones((len(x), 1)), x])
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pd.DataFrame({"i": np.arange(total.size), "s": total.ravel()})

    sums = load(spark, sf_dir, "embeddings").select("embedding").mapInPandas(partial, "i INT, s DOUBLE").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toPandas()
    m = sums.s.to_numpy().reshape(int(len(sums) ** 0.5), -1)  # as large as the vectors are long, whatever their number
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    values, vectors = np.linalg.eigh(m[1:, 1:] / n - np.outer(mean, mean))
    top = [(k, float(values[-1 - k] / values.sum()), (vectors[:, -1 - k] * np.sign(vectors[np.abs(vectors[:, -1 - k]).argmax(), -1 - k])).tolist()) for k in range(6)]
    return spark.createDataFrame(top, "component INT, ratio DOUBLE, direction ARRAY<DOUBLE>")


@query("w33_chunk_plan", "WITH e AS (SELECT episode, CAST(floor(duration_s) AS BIGINT) AS n FROM episodes WHERE duration_s >= 1 AND duration_s < 1e6) SELECT episode, chunk, chunk * 16 AS first, least(n, chunk * 16 + 17) AS last FROM (SELECT episode, n, unnest(range(0, CAST(ceil(n / 16.0) AS BIGINT))) AS chunk FROM e)")
def w33(spark, sf_dir):
    """Overlapping chunks of 17 seconds, each second owned by the chunk it is first in."""
    e = load(spark, sf_dir, "episodes").where("duration_s >= 1 AND duration_s < 1e6").select("episode", F.floor("duration_s").alias("n"))
    c = e.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / 16) - 1)))
    return c.select("episode", "chunk", (F.col("chunk") * 16).alias("first"), F.least("n", F.col("chunk") * 16 + 17).alias("last"))
