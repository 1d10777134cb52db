"""Mixing sources to target weights by fitting subset sums.

Documents are counted by exact size. A source's target is reached with whole copies of all its documents, then a
share of each size, then a bounded-knapsack dynamic programme over the counts for what is left of the budget.
Which documents of a size are taken is a matter of a seeded hash.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vespera.llm.common import WORD, checked, stored
from vespera.operators.merge import numbered

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
CAP = 2
SEED = 17
#: Sizes up to this many words are small; the budget that is left for them is cut down to it before the dynamic programme.
DP_BUDGET = 1 << 17
#: Large sizes whose sums are tabled, cells of that table, and sums that are tried with what small sizes add.
WIDE, CELLS, TRIED = 64, 1 << 19, 8
#: Bits of a table over a whole budget, at most (64 MB).
TABLE_BITS = 1 << 29
#: Ranks within a size are dealt over so many hash buckets at least, and as many as leave about BUCKET_ROWS rows of one
#: source and size in each, so that no group of equal sizes meets in one task.
BUCKETS, BUCKET_ROWS = 64, 50_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: Fraction = SHARE, cap: int = CAP) -> DataFrame:
    """sizes: source, source_size. source, source_size, target.

    Sources in code point order (null last) weigh `weights`, repeating. A target is its weight times a unit, or cap times its
    size where that is less; capping only raises the unit, so the unit is found by a few sums over all sources, exactly.
    """
    ranked = numbered(sizes.select("source", "source_size", F.col("source").isNull().alias("last")), ["last", "source"])
    ranked = stored(ranked.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("n") - 1, F.lit(len(weights))).cast("int") + 1).alias("weight")), "weights")
    whole = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    full, over = F.col("source_size") * cap, F.lit(False)
    budget, unit, before = None, Fraction(0), None
    while True:
        got = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, full)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("free"), F.count_if(over).alias("n")).first()
        budget = share * (got["all"] or 0)
        if not got["free"] or got["n"] == before:
            break
        before, unit = got["n"], (budget - (got["full"] or 0)) / got["free"]
        over = F.col("weight").cast("decimal(10,0)") * whole(unit.numerator) > full.cast("decimal(20,0)") * whole(unit.denominator)
    each = F.create_map(*[F.lit(x) for w in sorted(set(weights)) for x in (w, float(w * unit))])[F.col("weight")]
    return ranked.select("source", "source_size", F.when(over, full.cast("double")).otherwise(each).alias("target"))


def fit(size: np.ndarray, count: np.ndarray, budget: int, dp_budget: int = DP_BUDGET) -> np.ndarray:
    """How many of each size to take so that the sum comes as near to budget as the programme finds, never more than count.

    Large sizes first: a table of their sums (in cells, beyond CELLS of words) tells which of them leave a budget that the
    small ones can fill; the sums nearest to the large sizes' share of the budget are tried. Then the small ones take their
    share, then whole copies greedily, then what the dynamic programme finds. Where more than WIDE large sizes are there,
    the others take their share, rounded so that it is met over all of them. Where the result still misses and few sizes
    are there, the table covers the whole budget.
    """
    take = np.zeros(len(size), np.int64)
    whole = int((size * count).sum())
    if budget <= 0 or not whole:
        return take
    if budget >= whole:
        return count.copy()
    order = [i for i in np.argsort(-size, kind="stable").tolist() if size[i] > 0 and count[i] > 0]
    large, small = [i for i in order if size[i] > dp_budget], [i for i in order if size[i] <= dp_budget]
    tabled = large if len(large) <= WIDE else [large[k * len(large) // WIDE] for k in range(WIDE)]
    owed = 0
    for i in sorted(set(large) - set(tabled), key=order.index) if len(large) > WIDE else ():
        owed += int(size[i] * count[i]) * budget
        take[i] = min(int(count[i]), owed // (whole * int(size[i])))
        owed -= int(take[i]) * int(size[i]) * whole
    left = budget - int((size * take).sum())
    room, best, missed = sum(int(size[i] * count[i]) for i in small), take, budget
    for some in _sums(size, count, tabled, left, room):
        mine = take.copy()
        mine[tabled] += some
        mine = _filled(size, count, mine, small, budget - int((size * mine).sum()), room, dp_budget)
        off = abs(budget - int((size * mine).sum()))
        if off < missed:
            best, missed = mine, off
        if not missed:
            return best
    if 2 * budget * sum(int(c).bit_length() for c in count) <= TABLE_BITS:
        again = _table(size, count, np.zeros(len(size), np.int64), order, budget)
        best = again if abs(budget - int((size * again).sum())) < missed else best
    return best


def _sums(size: np.ndarray, count: np.ndarray, tabled: list, left: int, room: int):
    """Counts of the tabled sizes whose sum, with room words of small ones, can come near to left; the likeliest first."""
    none = np.zeros(len(tabled), np.int64)
    whole = int((size[tabled] * count[tabled]).sum()) if tabled else 0
    if not whole or left <= 0:
        yield none
        return
    unit = max(1, -(-min(whole, left + int(size[tabled[0]])) // CELLS))
    top = min(whole, left + int(size[tabled[0]])) // unit + 1
    full, reach, steps = (1 << (top + 1)) - 1, 1, []
    cell = [max(1, (int(size[i]) + unit // 2) // unit) for i in tabled]
    for k, i in enumerate(tabled):
        spare, part = min(int(count[i]), top // cell[k]), 1
        while spare > 0:
            n = min(part, spare)
            new = (reach << (n * cell[k])) & full & ~reach
            if new:
                steps.append((k, n, new))
                reach |= new
            spare, part = spare - n, part * 2
    low, high = max(0, -(-(left - room) // unit)), left // unit
    share = min(max(left * whole // (whole + room) // unit, low), high)
    found, below, above = [], share, share + 1
    while len(found) < TRIED:  # the nearest cells on both sides in turn
        a, b = (_below(reach, below) if below >= 0 else -1), _above(reach, above, top) if above <= top else None
        if a < 0 and b is None:
            break
        if a >= 0:
            found.append(a)
            below = a - 1
        if b is not None:
            found.append(b)
            above = b + 1
    inside = lambda x: max(low - x, x - high, 0)  # noqa: E731  how far from what small sizes can fill
    for best in sorted(found, key=lambda x: (inside(x), abs(x - share))):
        out = none.copy()
        for k, n, new in reversed(steps):
            if new >> best & 1:
                out[k] += n
                best -= n * cell[k]
        yield out


def _filled(size: np.ndarray, count: np.ndarray, take: np.ndarray, small: list, left: int, room: int, dp_budget: int) -> np.ndarray:
    """take with what small sizes add to come as near as they can to left."""
    if left <= 0:
        return take
    if left >= room:
        take[small] = count[small]
        return take
    shared = max(0, left - 2 * dp_budget)  # what the table adds is left to it
    take[small] = [int(count[i]) * shared // room for i in small]
    left -= sum(int(size[i] * take[i]) for i in small)
    for i in small if left > 4 * dp_budget else ():  # large sizes first, until the rest fits the table
        k = min(int(count[i] - take[i]), (left - 2 * dp_budget) // int(size[i]))
        if k > 0:
            take[i] += k
            left -= k * int(size[i])
    return _table(size, count, take, small, left) if left > 0 else take


def _table(size: np.ndarray, count: np.ndarray, take: np.ndarray, order: list, left: int) -> np.ndarray:
    """take and what is added to it from the spare counts so that the sum added is the nearest there is to left."""
    take = take.copy()
    # reach[w]: the item whose addition first reached the sum w; items are binary parts of the spare counts
    top = min(left + int(size.max()), 2 * left)
    full = (1 << (top + 1)) - 1
    reach, steps = 1, []
    for i in order:
        spare, part = min(int(count[i] - take[i]), top // int(size[i])), 1
        while spare > 0:
            k = min(part, spare)
            new = (reach << (k * int(size[i]))) & full & ~reach
            if new:
                steps.append((int(i), k, new))
                reach |= new
            spare, part = spare - k, part * 2
    best = min((w for w in (_below(reach, left), _above(reach, left, top)) if w is not None), key=lambda w: (abs(w - left), w))
    for i, k, new in reversed(steps):
        if new >> best & 1:
            take[i] += k
            best -= k * int(size[i])
    return take


def _below(bits: int, at: int) -> int:
    return (bits & ((1 << (at + 1)) - 1)).bit_length() - 1


def _above(bits: int, at: int, top: int) -> int | None:
    rest = bits >> at
    return at + (rest & -rest).bit_length() - 1 if rest else None


def mix(docs: DataFrame, weights=WEIGHTS, share: Fraction = SHARE, cap: int = CAP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (copies x size) for every row.

    Size is the number of words, 0 for a null text; such rows have no copies. A null source is a source of its own,
    the last. Rows that share an id and a text are interchangeable; otherwise reruns take the same documents.
    Each source's counts by size are fitted in a task of their own: a row a distinct size, whatever the rows.
    """
    sized = stored(docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    histogram = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    plan = checked(stored(targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")), weights, share, cap), "targets"))
    buckets = max(BUCKETS, -(-(histogram.agg(F.max("n")).first()[0] or 0) // BUCKET_ROWS))

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", kind="stable")
        size, n = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        budget, whole = int(round(rows["target"].iloc[0])), int((size * n).sum())
        copies = budget // whole if whole else 0
        rows["copies"], rows["more"] = copies, fit(size, n, budget - copies * whole)
        return rows[["source", "size", "copies", "more"]]

    joined = histogram.join(plan, histogram["source"].eqNullSafe(plan["source"])).select(histogram["source"], "size", "n", "target")
    takes = stored(joined.groupBy("source").applyInPandas(fitted, "source string, size long, copies long, more long"), "takes")
    # rank within (source, size) by hash: the count of lower buckets plus the rank within the bucket
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    ranked = sized.withColumn("h", h).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    counts = ranked.groupBy("source", "size", "bucket").agg(F.count("*").alias("k"))
    before = counts.withColumn("before", F.sum("k").over(Window.partitionBy("source", "size").orderBy("bucket")) - F.col("k")).drop("k")
    t, b = takes.alias("t"), before.alias("b")
    plans = b.join(t, F.col("b.source").eqNullSafe(F.col("t.source")) & (F.col("b.size") == F.col("t.size"))).select("b.source", "b.size", "bucket", "before", "copies", "more")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id")))
    r, p, q = ranked.alias("r"), plans.alias("p"), plan.alias("q")
    out = r.join(p, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.size") == F.col("p.size")) & (F.col("r.bucket") == F.col("p.bucket")))
    out = out.join(q, F.col("r.source").eqNullSafe(F.col("q.source")))
    copies = F.when(F.col("r.size") > 0, F.col("copies") + (F.col("before") + F.col("rank") <= F.col("more")).cast("long")).otherwise(F.lit(0).cast("long"))
    copies = F.least(copies, F.lit(cap).cast("long"))
    return out.select("r.doc_id", "r.source", "r.size", "q.source_size", "q.target", copies.alias("copies"), (copies * F.col("r.size")).alias("taken"))
