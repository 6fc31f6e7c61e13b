"""Filling batches of fixed capacity with items, as vector bin packing by the dot-product heuristic.

Each item is a vector of tokens, one segment, and loss-bearing tokens; a batch limits all three at once. A batch is
opened empty and takes, again and again, the item that fits and has the greatest dot product with what is left of the
batch, both measured in shares of the limits; the loss counts by the DEMAND-th power of its share in the items left, against
that at the start, so that items with and without loss run out together. Items of one vector are interchangeable and are held as a count. Vectors are
arranged in chains in which both tokens and loss rise; along a chain fit and dot product are monotone, so the greatest
vector of each chain that still fits is looked up by binary search, and the best of these is the best of all.

Items are hashed into groups of bounded size, packed apart. The batches of a group that stayed poorly filled, a few at
most, are opened again and their items packed together with those of the other groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiloom.session import stored

#: Items a group holds on average.
GROUP_ITEMS = 20_000
#: Share of a batch's tokens below which it is opened again.
POOR = 0.98
#: The power by which the loss-bearing tokens still to be placed weigh.
DEMAND = 4


class _Chain:
    """Vectors of rising tokens and loss, and which of them are left."""

    def __init__(self) -> None:
        self.tokens: list[int] = []
        self.loss: list[int] = []
        self.members: list[list[int]] = []

    def add(self, tokens: int, loss: int, members: list[int]) -> None:
        self.tokens.append(tokens)
        self.loss.append(loss)
        self.members.append(members)
        self.before = list(range(len(self.tokens) + 1))  # position + 1 -> the last one left up to there, by path halving

    def best(self, tokens: int, loss: int) -> int:
        """The greatest position left that fits the room, or -1."""
        i, before = min(bisect_right(self.tokens, tokens), bisect_right(self.loss, loss)), self.before
        while before[i] != i:
            before[i] = before[before[i]]
            i = before[i]
        return i - 1

    def take(self, i: int) -> int:
        member = self.members[i].pop()
        if not self.members[i]:
            self.before[i + 1] = i
        return member


def _chains(tokens: np.ndarray, loss: np.ndarray) -> list[_Chain]:
    kinds, kind, count = np.unique(np.stack([tokens, loss], axis=1), axis=0, return_inverse=True, return_counts=True)
    members = np.split(np.argsort(kind.ravel(), kind="stable")[::-1], np.cumsum(count[::-1])[:-1])[::-1]
    chains: list[_Chain] = []
    tops: list[int] = []  # minus the greatest loss of each chain; chains are in falling order of it
    for (n, l), own in zip(kinds.tolist(), members):
        at = bisect_left(tops, -l)
        if at == len(chains):
            chains.append(_Chain())
            tops.append(0)
        tops[at] = -l
        chains[at].add(n, l, own.tolist())
    return chains


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_limit: int) -> np.ndarray:
    """The batch number, from 0, of each item. Every item must fit an empty batch; of equal dot products more tokens go first."""
    chains = _chains(tokens, loss)
    batch = np.empty(len(tokens), dtype=np.int64)
    left, number = len(tokens), -1
    open_tokens, open_loss = int(tokens.sum()), int(loss.sum())
    share = open_loss / open_tokens if open_loss else 1.0
    while left:
        number += 1
        room, room_loss, weight = capacity, loss_limit, (open_loss / open_tokens / share) ** DEMAND
        for _ in range(segments):
            by_token, by_loss = room / capacity / capacity, weight * room_loss / loss_limit / loss_limit if loss_limit else 0.0
            best, chosen, at = (-1.0, 0), None, 0
            for chain in chains:
                i = chain.best(room, room_loss)
                if i >= 0 and (score := (chain.tokens[i] * by_token + chain.loss[i] * by_loss, chain.tokens[i])) > best:
                    best, chosen, at = score, chain, i
            if chosen is None:
                break
            room, room_loss = room - chosen.tokens[at], room_loss - chosen.loss[at]
            open_tokens, open_loss = open_tokens - chosen.tokens[at], open_loss - chosen.loss[at]
            batch[chosen.take(at)] = number
            left -= 1
    return batch


def _pack_group(round_: int, capacity: int, segments: int, loss_limit: int):
    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("start").to_numpy(), table.column("h").to_numpy()))
        table = table.take(pa.array(order))
        tokens = table.column("n").to_numpy().astype(np.int64)
        # An item with more loss than the limit fills it whole.
        number = pack(tokens, np.minimum(table.column("loss").to_numpy(), loss_limit).astype(np.int64), capacity, segments, loss_limit)
        fill = np.bincount(number, tokens)[number] / capacity
        batch = (np.int64(round_) << 52) + (table.column("grp").to_numpy().astype(np.int64) << 20) + number
        return pa.table([*(table.column(c) for c in ("id", "start", "n", "loss", "h")), pa.array(batch), pa.array(fill)], ["id", "start", "n", "loss", "h", "batch", "fill"])

    return run


def packed(items: DataFrame, capacity: int = 2048, segments: int = 256, loss_limit: int = 1536, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Assigns every item (id, n_tokens, n_loss) to batches: (id, start, n_tokens, n_loss, over, batch), one row for each piece.

    An item longer than ``capacity`` is cut into pieces of ``capacity`` tokens and a rest; no other item is cut. ``start``
    is the first token of the piece, n_loss its loss-bearing tokens; those of an item are its last ones. In no batch do the
    tokens exceed ``capacity`` or the pieces ``segments``. The loss-bearing tokens don't exceed ``loss_limit`` but for a piece
    that has more of them by itself: since only ``capacity`` cuts an item, it is put in a batch where no other piece bears
    loss, and ``over`` is true for it. Items without tokens (or with a NULL in n_tokens) fill nothing: one row with batch
    NULL. A NULL in n_loss counts as 0. Repeated rows are items each. An empty table gives no row.
    """
    kind = items.select("id").schema[0].dataType.simpleString()
    n = F.coalesce("n_tokens", F.lit(0)).cast("bigint")
    # Written once, so that the sizes aren't computed again for the items without tokens.
    base = stored(items.select("id", n.alias("n_all"), F.least(F.greatest(F.coalesce("n_loss", F.lit(0)), F.lit(0)), n).cast("bigint").alias("loss_all")))
    zero = F.lit(0).cast("bigint")
    empty = base.where("n_all <= 0").select("id", zero.alias("start"), zero.alias("n_tokens"), zero.alias("n_loss"), F.lit(False).alias("over"), F.lit(None).cast("bigint").alias("batch"))
    pieces = base.where("n_all > 0").withColumn("start", F.explode(F.sequence(zero, F.col("n_all") - 1, F.lit(capacity).cast("bigint"))))
    pieces = pieces.withColumn("n", F.least(F.lit(capacity).cast("bigint"), F.col("n_all") - F.col("start")))
    loss = F.greatest(F.lit(0), F.least(F.col("n"), F.col("start") + F.col("n") - (F.col("n_all") - F.col("loss_all"))))
    pieces = pieces.select("id", "start", "n", loss.cast("bigint").alias("loss"), F.xxhash64("id", "start").alias("h"))
    schema = f"id {kind}, start BIGINT, n BIGINT, loss BIGINT, h BIGINT, batch BIGINT, fill DOUBLE"

    def one_round(rows: DataFrame, round_: int) -> DataFrame:
        groups = max(1, -(-rows.count() // group_items))
        rows = rows.withColumn("grp", F.pmod(F.xxhash64("h", F.lit(round_)), F.lit(groups)))
        return stored(rows.groupBy("grp").applyInArrow(_pack_group(round_, capacity, segments, loss_limit), schema))

    first = one_round(pieces, 0)
    again = one_round(first.where(F.col("fill") < POOR).select("id", "start", "n", "loss", "h"), 1)
    out = first.where(F.col("fill") >= POOR).unionAll(again)
    return out.select("id", "start", F.col("n").alias("n_tokens"), F.col("loss").alias("n_loss"), (F.col("loss") > loss_limit).alias("over"), "batch").unionAll(empty)
