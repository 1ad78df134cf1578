"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in the order of a hash of their ids, form blocks.
Weights are exact fractions.  In the ideal mixture every source that has blocks
left gets, at each moment, its weight's part of the weights of all such sources.
A block is released at the slot in which it begins there and due at the end of the
slot in which it ends there; in each slot the released block that is due first is
scheduled.  The ideal mixture fills every slot and keeps all these times, so there
is an order that does, and earliest deadline first finds it: after every slot each
source has less than one block more or fewer than the ideal, however long the
mixture is and whichever sources have ended.  Every document is placed once and
none is dropped or repeated.

Null sources are a source of their own; repeated rows are placed each; ties of the
hash go to the id.  An empty table gives no rows.  Columns `position`, `slot` and
`block` are added; columns of these names that the table has already are replaced.
"""

from __future__ import annotations

import bisect
import heapq
import math
from array import array
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderspark.operators.ranking import rank_rows


def shares(weights: list[float], period: int) -> list[int]:
    """Slots of each period, summing to `period`, at least one each, as near the weights as can be."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources need a period of at least as many slots")
    total = math.fsum(weights)
    spare = period - len(weights)
    exact = [w / total * spare for w in weights]
    out = [1 + math.floor(x) for x in exact]
    for i in sorted(range(len(weights)), key=lambda i: (math.floor(exact[i]) - exact[i], i))[:period - sum(out)]:
        out[i] += 1
    return out


def schedule(slots: list[int]) -> list[int]:
    """The source of every slot of one period in which each source has `slots`."""
    out = np.empty(sum(slots), np.int64)
    for i, places in enumerate(phases(slots, slots)):
        out[places] = i
    return out.tolist()


def exact(weights: list[float]) -> list[int]:
    """Whole numbers in the exact ratio of the weights, floats as they are written in decimals."""
    fractions = [Fraction(str(w)) if isinstance(w, float) else Fraction(w) for w in weights]
    scale = math.lcm(*(f.denominator for f in fractions))
    return [int(f * scale) for f in fractions]


def phases(blocks: list[int], weights: list[float], period: int | None = None) -> list[np.ndarray]:
    """The slot of every block of each source.  There are no periods any more: `period` has no effect.

    Work is in proportion to the blocks.
    """
    left = [i for i, n in enumerate(blocks) if n > 0]
    share = dict(zip(left, exact([weights[i] for i in left])))
    # Until `ends[k]` of virtual time, in which a source gets its share each unit, `gone[k]` blocks are those of ended sources.
    by_end = sorted((Fraction(blocks[i], share[i]), i) for i in left)
    ends, gone, rest = [e for e, _ in by_end], [0], [sum(share.values())]
    for _, i in by_end:
        gone.append(gone[-1] + blocks[i])
        rest.append(rest[-1] - share[i])
    at = dict.fromkeys(left, 0)

    def moment(i: int, j: int) -> tuple[int, int]:
        """The time at which the ideal mixture has `j` blocks of source `i`, rounded down and up."""
        k = at[i]
        if j * ends[k].denominator > ends[k].numerator * share[i]:
            k = at[i] = bisect.bisect_left(ends, Fraction(j, share[i]), lo=k)
        whole, part = divmod(j * rest[k], share[i])
        return gone[k] + whole, gone[k] + whole + (part > 0)

    def window(i: int, begin: int, j: int) -> tuple[int, int, int, int, int]:
        down, up = moment(i, j)
        return begin, i, j, up, down

    waiting = [window(i, 0, 1) for i in left]  # release, source, block, due, release of the next
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    out = [array("q") for _ in blocks]
    for t in range(sum(blocks)):
        while waiting and waiting[0][0] <= t:
            _, i, j, due, following = heapq.heappop(waiting)
            heapq.heappush(ready, (due, i, j, following))
        due, i, j, following = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a block is late")
        out[i].append(t)
        if j < blocks[i]:
            heapq.heappush(waiting, window(i, following, j + 1))
    return [np.array(slots, np.int64) for slots in out]


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, block: int = 64, period: int | None = None,
        key: str = "doc_id", source: str = "source") -> DataFrame:
    """Adds ``position`` (from 0, without gaps), ``slot`` and ``block``.

    `weights` by source; without them a source weighs its number of documents to
    `power`.  The driver sees a count for each source and works out a slot for each
    block, which every task gets (8 bytes for `block` documents).  `period` has no
    effect.
    """
    kept = [c for c in docs.columns if c not in ("position", "slot", "block")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    sizes = sorted(((r[0], r[1]) for r in docs.groupBy(F.col(source)).count().collect()), key=lambda r: (r[0] is not None, r[0]))
    if not sizes:
        return docs.select("*", *[F.lit(0).cast("long").alias(c) for c in ("position", "slot", "block")])
    if weights is None:
        weights = {s: n ** power for s, n in sizes}
    if lacking := [s for s, _ in sizes if weights.get(s, 0) <= 0]:
        raise ValueError(f"no weight for sources {lacking[:5]}")
    counts = [-(-n // block) for _, n in sizes]
    plan = phases(counts, [weights[s] for s, _ in sizes])
    spark = docs.sparkSession
    # Fewer documents than a full block stand in a source's last block, and shift what comes after.
    short = []
    for i, ((_, n), total) in enumerate(zip(sizes, counts)):
        if total * block > n:
            short.append((_slot(plan, i, total - 1), total * block - n))
    short.sort()
    late, missing = np.array([s for s, _ in short], np.int64), np.append(0, np.cumsum([m for _, m in short])).astype(np.int64)
    rows = [(s, i) for i, (s, _) in enumerate(sizes)]
    named = spark.createDataFrame(rows, f"`_source` {docs.schema[source].dataType.simpleString()}, `_number` int")
    hashed = docs.withColumn("_hash", F.xxhash64(F.col(key)))
    buckets = max(1, sum(n for _, n in sizes) // 20_000)
    spread = F.floor((F.col("_hash") / F.lit(2.0 ** 64) + 0.5) * buckets)  # rises with the hash
    ranked = rank_rows(hashed, [source], [F.col("_hash"), F.col(key)], [(spread, True)], "_rank")
    placed = ranked.join(named, F.col(source).eqNullSafe(F.col("_source")))
    number = (F.col("_rank") - 1)

    # One function for both, so that a task needs one Python worker.
    @F.pandas_udf("struct<slot:long,begin:long>")
    def place(sources, blocks):
        import pandas as pd

        out = np.empty(len(sources), np.int64)
        s, b = sources.to_numpy(), blocks.to_numpy()
        for i in np.unique(s):
            at = np.flatnonzero(s == i)
            out[at] = _slots(plan, int(i), b[at])
        return pd.DataFrame({"slot": out, "begin": out * block - missing[np.searchsorted(late, out, side="left")]})

    return (placed.withColumn("block", F.floor(number / block)).withColumn("_place", place("_number", "block"))
            .withColumn("slot", F.col("_place.slot")).withColumn("position", F.col("_place.begin") + F.pmod(number, F.lit(block)))
            .select(*kept, "position", "slot", "block"))


def _slots(plan: list[np.ndarray], source: int, blocks: np.ndarray) -> np.ndarray:
    """The slots of the given blocks (from 0) of a source."""
    return plan[source][blocks]


def _slot(plan: list[np.ndarray], source: int, block: int) -> int:
    return int(_slots(plan, source, np.array([block]))[0])


def deviation(order: list[int], weights: list[Fraction]) -> Fraction:
    """The largest distance, over all prefixes and sources, between blocks scheduled and blocks due by weight."""
    done, worst = [0] * len(weights), Fraction(0)
    for t, i in enumerate(order, 1):
        done[i] += 1
        worst = max(worst, *(abs(n - w * t) for n, w in zip(done, weights)))
    return worst
