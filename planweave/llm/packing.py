"""Problem 7: filling fixed-capacity containers with items by swap-based local search.

Items are spread over shards of a bounded number of items. In each shard best-fit decreasing makes a first packing;
then documents are moved, exchanged one for one and two for one between underfull bins wherever that raises the sum
of squared fills, until bins run empty. Best fit leaves at most one bin of a shard at most half full; those bins
of many shards are emptied into one another in further rounds, each over a bounded number of bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.session import cut

CAPACITY = 2048
SHARD_ITEMS = 4096
SHARDS_A_ROUND = 64


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing; bins as lists of item positions. Bins by free space lie in one bit mask, so each item is placed in constant time."""
    open_bins: dict[int, list[int]] = defaultdict(list)
    mask, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[i]
        above = mask >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                mask &= ~(1 << free)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if left := free - size:
            open_bins[left].append(b)
            mask |= 1 << left
    return bins


class _Bins:
    """The underfull bins during the search, with their items ordered by size."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items = {b: sorted((sizes[i], i) for i in members) for b, members in enumerate(bins)}
        self.fill = {b: sum(s for s, _ in members) for b, members in self.items.items()}

    def shift(self, source: int, target: int, give: list[tuple[int, int]], take: list[tuple[int, int]]) -> None:
        for x in give:
            self.items[source].remove(x)
            insort(self.items[target], x)
        for x in take:
            self.items[target].remove(x)
            insort(self.items[source], x)
        change = sum(s for s, _ in give) - sum(s for s, _ in take)
        self.fill[source] -= change
        self.fill[target] += change

    def best_exchange(self, source: int, target: int) -> tuple[int, list, list]:
        """The largest gain of ``target`` that fits: a move, one for one, two for one or one for two."""
        room = self.capacity - self.fill[target]
        mine, theirs = self.items[source], self.items[target]
        best: tuple[int, list, list] = (0, [], [])
        k = bisect_left(mine, (room + 1, -1)) - 1
        if k >= 0:
            best = (mine[k][0], [mine[k]], [])
        if best[0] == room:
            return best
        for x in theirs:
            k = bisect_left(mine, (x[0] + room + 1, -1)) - 1
            if k >= 0 and mine[k][0] - x[0] > best[0]:
                best = (mine[k][0] - x[0], [mine[k]], [x])
                if best[0] == room:
                    return best
        for j, y in enumerate(mine):
            for x in theirs:
                k = bisect_left(mine, (x[0] + room - y[0] + 1, -1), 0, j) - 1
                if k >= 0 and (gain := y[0] + mine[k][0] - x[0]) > best[0]:
                    best = (gain, [y, mine[k]], [x])
                    if gain == room:
                        return best
            for j2, x in enumerate(theirs):
                k = bisect_left(theirs, (y[0] - room - x[0], -1), 0, j2)
                if k < j2 and 0 < y[0] - x[0] - theirs[k][0] <= room and y[0] - x[0] - theirs[k][0] > best[0]:
                    best = (y[0] - x[0] - theirs[k][0], [y], [x, theirs[k]])
        return best


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Exchanges between underfull bins that each raise the sum of squared fills, until none does; emptied bins are left out."""
    full = [b for b in bins if sum(sizes[i] for i in b) == capacity]
    state = _Bins([b for b in bins if sum(sizes[i] for i in b) < capacity], sizes, capacity)
    changed = True
    while changed:
        changed = False
        for source in sorted(state.items, key=lambda b: (state.fill[b], b)):
            targets = sorted((b for b in state.items if b != source and state.fill[b] < capacity), key=lambda b: (-state.fill[b], b))
            for target in targets:
                if not state.items[source]:
                    break
                gain, give, take = state.best_exchange(source, target)
                if gain and state.fill[target] + gain > state.fill[source]:
                    state.shift(source, target, give, take)
                    changed = True
            if not state.items[source]:
                del state.items[source], state.fill[source]
    return full + [[i for _, i in members] for members in state.items.values() if members]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item positions; every item of at most ``capacity`` lies in exactly one bin."""
    return improve(best_fit(sizes, capacity), sizes, capacity)


def _pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece"]).reset_index(drop=True)
    bins = pack(pdf["size"].tolist())
    order = [i for b in bins for i in b]
    number = [k for k, b in enumerate(bins) for _ in b]
    filled = [sum(pdf["size"].iloc[i] for i in b) for b in bins]
    out = pdf.iloc[order].copy()
    out["bin"] = number
    out["fill"] = [int(filled[k]) for k in number]
    return out[["doc_id", "piece", "start_token", "size", "shard", "bin", "fill"]]


_PACKED = "doc_id long, piece int, start_token int, size int, shard long, bin long, fill int"


def items(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start_token, size)``: a document of at most ``capacity`` tokens whole, a longer one in pieces.

    Documents without a token, with a null id or a null count are no items; rows repeated count once, but two texts of
    one id, told apart by a column ``text_key`` if there is one, are two.
    """
    key = ["text_key"] * ("text_key" in sizes.columns)
    some = sizes.where("doc_id is not null and n_tokens > 0").select("doc_id", *key, "n_tokens").distinct()
    starts = some.select("doc_id", "n_tokens", F.posexplode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int"))).alias("piece", "k"))
    return starts.select("doc_id", "piece", (F.col("k") * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("k") * capacity).cast("int").alias("size"))


def containers(sizes: DataFrame) -> DataFrame:
    """``(container_id, doc_id, piece, start_token, size, fill)`` from ``(doc_id, n_tokens)``.

    ``fill`` is the number of tokens in the container. An empty input gives no containers.
    """
    rows = cut(items(sizes))
    n = rows.count()
    shards = max(1, -(-n // SHARD_ITEMS))
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    placed = cut(sharded.groupBy("shard").applyInPandas(_pack_group, _PACKED))
    done, level = [], 0
    while True:
        numbered = placed.withColumn("container_id", (F.lit(level) * (1 << 56)) + F.col("shard") * (1 << 24) + F.col("bin"))
        if shards == 1:
            done.append(numbered)
            break
        done.append(numbered.where(F.col("fill") * 2 > CAPACITY))
        shards = -(-shards // SHARDS_A_ROUND)
        level += 1
        again = placed.where(F.col("fill") * 2 <= CAPACITY).drop("bin", "fill").withColumn("shard", (F.col("shard") / SHARDS_A_ROUND).cast("long"))
        placed = cut(again.groupBy("shard").applyInPandas(_pack_group, _PACKED))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("container_id", "doc_id", "piece", "start_token", "size", "fill")
