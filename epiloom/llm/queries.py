"""The queries of this subpackage: name -> callable of (spark, sf_dir), and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiloom.llm.bpe import token_counts, token_ids
from epiloom.llm.cutoff import fraction_cutoffs
from epiloom.llm.digest import certified_percentiles
from epiloom.llm.formatting import collapsed, copies
from epiloom.llm.nearest import nearest_in_time
from epiloom.llm.packing import packed
from epiloom.llm.truncation import truncation_evidence
from epiloom.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def measured_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct clips of quality that aren't hard-rejected and whose head motion was measured."""
    clips = load(spark, sf_dir, "quality").where(~F.col("hard_reject") & F.col("clip_id").isNotNull() & (F.col("head_motion") >= 0) & ~F.isnan("head_motion"))
    # A redelivery repeats the record: any deliveries that differ are settled by the earliest.
    return clips.groupBy("clip_id").agg(F.min_by(F.struct("episode", "head_motion"), F.struct("ingested_at", "record_id")).alias("c")).select("clip_id", "c.*")


@query(
    "p1_found",
    """
    WITH c AS (SELECT clip_id, arg_min(episode, (ingested_at, record_id)) AS episode, arg_min(head_motion, (ingested_at, record_id)) AS v
      FROM quality WHERE NOT hard_reject AND clip_id IS NOT NULL AND head_motion >= 0 AND NOT isnan(head_motion) GROUP BY clip_id),
    r AS (SELECT episode, v, count(*) OVER (PARTITION BY episode ORDER BY v) AS upto, count(*) OVER (PARTITION BY episode) AS n FROM c)
    SELECT episode, CAST(floor(min(v) * 10000 + 0.5) AS BIGINT) AS cutoff_e4, CAST(min(upto) AS BIGINT) AS n_kept
    FROM r WHERE upto * 10 >= n * 3 GROUP BY episode
    """,
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each episode the head-motion cutoff that keeps three tenths of its clips, and the number kept."""
    cut = fraction_cutoffs(measured_clips(spark, sf_dir), "episode", "head_motion", (3, 10))
    return cut.select("episode", F.floor(F.col("cutoff") * 10000 + 0.5).cast("bigint").alias("cutoff_e4"), "n_kept")


@query("p2_percentiles")
def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of wrist speed and both aperture numbers of each class, by day of arrival and over all days.

    Every delivered row counts, redeliveries too: days are summed up apart, so none knows what another received.
    """
    measures = {"wrist_speed": F.col("wrist_speed"), "aperture_first": F.get("aperture_mm", F.lit(0)), "aperture_second": F.get("aperture_mm", F.lit(1))}
    return certified_percentiles(load(spark, sf_dir, "spans"), "cls", "ingested_at", measures, [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99])


def _plain_name(name: Column) -> Column:
    """An episode name or path in lower case, without white space around it, folders and file ending."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(F.regexp_replace(name, r"\s+", " "))), "^.*/", ""), r"\.[a-z0-9]{1,5}$", "")


def _side(hand: Column) -> Column:
    """'l' or 'r' for the spellings of left and right; any other word as it is, in lower case."""
    plain = F.trim(F.lower(F.regexp_replace(hand, r"\s+", " ")))
    return F.when(plain.isin("l", "left", "left hand", "lh"), "l").when(plain.isin("r", "right", "right hand", "rh"), "r").otherwise(F.nullif(plain, F.lit("")))


#: Odd paths (see _with_episode_key) up to which they are sent to every executor; more are joined by shuffle.
ODD_PATHS = 100_000


def _with_episode_key(df: DataFrame, episodes: DataFrame, column: str) -> DataFrame:
    """``df`` with ``ep``: the plain name of the episode that ``column`` names or gives the path of.

    Plain names settle all but the episodes whose path doesn't end in their name; these are looked up.
    """
    odd = episodes.select(_plain_name(F.col("source_path")).alias("path"), _plain_name(F.col("episode")).alias("ep2")).where("path <> ep2").distinct()
    odd = odd.join(episodes.select(_plain_name(F.col("episode")).alias("path")).distinct(), "path", "left_anti").groupBy("path").agg(F.min("ep2").alias("ep2"))
    named = df.withColumn("ep", _plain_name(F.col(column)))
    n = odd.count()
    if not n:
        return named
    return named.join(F.broadcast(odd) if n <= ODD_PATHS else odd, named["ep"] == odd["path"], "left").withColumn("ep", F.coalesce("ep2", "ep")).drop("path", "ep2")


@query(
    "p5_found",
    r"""
    WITH plain AS (SELECT *, regexp_replace(regexp_replace(trim(lower(regexp_replace(episode, '\s+', ' ', 'g'))), '^.*/', ''), '\.[a-z0-9]{1,5}$', '') AS ep FROM contact_events),
    e AS (SELECT event_id, ep, lower(left(trim(hand), 1)) AS h, CAST(floor(t * 1e6 + 0.5) AS BIGINT) AS t FROM plain WHERE t IS NOT NULL AND hand IS NOT NULL),
    u AS (SELECT unnest(events) AS x, episode FROM gold),
    g AS (SELECT DISTINCT x.gold_event_id AS gold_event_id, regexp_replace(regexp_replace(trim(lower(regexp_replace(episode, '\s+', ' ', 'g'))), '^.*/', ''), '\.[a-z0-9]{1,5}$', '') AS ep,
      lower(left(trim(x.hand), 1)) AS h, CAST(floor(x.t * 1e6 + 0.5) AS BIGINT) AS t FROM u WHERE x.t IS NOT NULL AND x.hand IS NOT NULL)
    SELECT g.gold_event_id, arg_min(e.event_id, (abs(e.t - g.t), e.event_id)) AS event_id
    FROM g JOIN e ON g.ep = e.ep AND g.h = e.h AND e.t BETWEEN g.t - 150000 AND g.t + 150000 GROUP BY g.gold_event_id
    """,
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detected event nearest to each hand-labelled one, of the same episode and hand, at most 150 ms away."""
    episodes = load(spark, sf_dir, "episodes")
    us = lambda t: F.floor(F.when(~F.isnan(t), t) * 1_000_000 + 0.5).cast("bigint")
    key = F.concat("ep", F.lit("\t"), _side(F.col("hand")))
    gold = _with_episode_key(load(spark, sf_dir, "gold").select("episode", F.explode("events").alias("x")).select("episode", "x.gold_event_id", "x.hand", "x.t"), episodes, "episode")
    seen = _with_episode_key(load(spark, sf_dir, "contact_events").select("event_id", "episode", "hand", "t"), episodes, "episode")
    left = gold.select(F.col("gold_event_id").alias("id"), key.alias("k"), us(F.col("t")).alias("t"))
    right = seen.select(F.col("event_id").alias("id"), key.alias("k"), us(F.col("t")).alias("t"))
    return nearest_in_time(left, right, 150_000).select(F.col("id").alias("gold_event_id"), F.col("rid").alias("event_id"))


@query("p6_ids")
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document by byte_bpe_50k."""
    return token_ids(load(spark, sf_dir, "documents"), "doc_id", "text")


#: Sources whose texts set a task or are its input; they bear no loss in training. All others are answers.
PROMPTS = ("task_spec", "guideline", "dataset_card", "device_log")


def batches(docs: DataFrame, prompts: tuple[str, ...] = PROMPTS, capacity: int = 2048, segments: int = 256, loss_limit: int = 1536) -> DataFrame:
    """Documents (doc_id, text, source) packed by tokens of byte_bpe_50k; those of the sources ``prompts`` bear no loss, all others in full."""
    docs = docs.select(F.struct("doc_id", F.coalesce(~F.col("source").isin(*prompts), F.lit(True)).alias("answer")).alias("id"), "text")
    sized = token_counts(docs, "id", "text").select(F.col("id.doc_id").alias("id"), "n_tokens", F.when(F.col("id.answer"), F.col("n_tokens")).otherwise(0).alias("n_loss"))
    return packed(sized, capacity, segments, loss_limit).withColumnRenamed("id", "doc_id")


@query("p7_batches")
def p7_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in batches of 2,048 tokens of byte_bpe_50k, with at most 256 segments and 1,536 loss-bearing tokens."""
    return batches(load(spark, sf_dir, "documents"))


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captions equal but for formatting: the least record of each set with each of its copies."""
    return copies(load(spark, sf_dir, "baseline_vision"), "record_id", "text", ("verb", "noun"))


@query("p4_collapsed")
def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each caption once, with the number of its copies and of their forms."""
    return collapsed(load(spark, sf_dir, "baseline_vision"), "record_id", "text", ("verb", "noun"))


@query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose text was cut off before its end."""
    return truncation_evidence(load(spark, sf_dir, "documents"), "doc_id", "text", "source").where("cut").select("doc_id")


@query("p8_shares")
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source the share of texts that were cut off, and the storage limit most of them sit at."""
    each = truncation_evidence(load(spark, sf_dir, "documents"), "doc_id", "text", "source")
    limit = F.mode(F.when(F.col("cut"), F.col("at_limit")), True)
    return each.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("n_cut"), limit.alias("main_limit")).withColumn("share", F.col("n_cut") / F.col("texts"))
