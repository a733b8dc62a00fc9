"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintframe.llm.common import SPACE, counted, key_filter, maybe_in, written

#: A fraction this near to 0 or 1 counts as decided.
EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> dict[str | None, float]:
    """Each source's target. Sources by code point, null last, have the weights in
    turn and share the sum of all sizes; a target stops at cap times its source's
    size, and the excess is shared by weight again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    open_ = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    left, out = float(sum(sizes.values())), {}
    while open_:
        each = left / sum(open_.values())
        over = [s for s, w in open_.items() if each * w > cap * sizes[s]]
        if not over:
            return out | {s: each * w for s, w in open_.items()}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
            del open_[s]
    return out


def _coin(seed: int, a: int, b: int) -> float:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{a}:{b}".encode(), digest_size=7).digest(), "big") / (1 << 56)


def _pivot(rows: Iterator[tuple[int, int, int, float]], seed: int) -> Iterator[tuple[int, float]]:
    """(uid, hash, size, fraction) in a fixed order -> (uid, outcome). All outcomes are 0
    or 1 but for at most the last one's. Of each pair, mass moves (size times
    fraction stays in sum, and each fraction's expectation is kept) until one of
    the two is decided; the other meets the next row."""
    held = None
    for uid, mark, size, p in rows:
        if size <= 0 or p <= EPS or p >= 1 - EPS:
            yield uid, float(p >= 0.5)
            continue
        if held is None:
            held = (uid, mark, size, p)
            continue
        u, m, v, q = held
        up = min((1 - q) * v, p * size)  # words that can move to the held row
        down = min(q * v, (1 - p) * size)
        move = up if _coin(seed, m, mark) * (up + down) < down else -down
        q, p = q + move / v, p - move / size
        done_q, done_p = q <= EPS or q >= 1 - EPS, p <= EPS or p >= 1 - EPS
        if done_q:
            yield u, float(q >= 0.5)
        if done_p:
            yield uid, float(p >= 0.5)
        held = (u, m, v, q) if not done_q else (uid, mark, size, p) if not done_p else None
    if held is not None:
        yield held[0], held[3]


#: A row up to this share of the words of its source's last group isn't forced: it goes on in pairs.
NEAR = 0.03


def _against_the_rest(row: tuple, size: np.ndarray, p: np.ndarray, seed: int, force: bool) -> tuple[float | None, np.ndarray, bool]:
    """A pivotal step whose other side is many rows together: the row (unit, hash, size,
    fraction) is taken with the probability that is its fraction, and the rest give
    the words that it lacks, or get those that it had, in proportion to their
    fractions p, or else to what these lack of 1, so that each one's expectation
    stays what it was. Returns the outcome, the rest's new fractions, and whether
    it was forced.

    Where neither way has room on both sides, nothing is decided (None); with force,
    the side that ends nearer is taken.
    """
    _, mark, n, q = row
    have, lack, give, get = float(size @ p), float(size @ (1 - p)), n * (1 - q), n * q
    by_share = have > 0 and give <= have and (1 + get / have) * p.max(initial=0) <= 1
    by_lack = lack > 0 and get <= lack and (1 + give / lack) * (1 - p).max(initial=0) <= 1
    if not by_share and not by_lack and not force:
        return None, p, False
    fair = by_share or by_lack
    taken = _coin(seed, mark, -1) < q if fair else max(give - have, 0.0) < max(get - lack, 0.0)
    words = give if taken else -get  # that the rest give
    if by_share or (not fair and words > 0):
        p = p * (1 - min(words / have, 1.0)) if have else p
    else:
        p = 1 - (1 - p) * (1 + max(words / lack, -1.0)) if lack else p
    return float(taken), np.clip(p, 0.0, 1.0), not fair


def _settled(todo: list[tuple], seed: int) -> tuple[dict[int, float], set[int]]:
    """Outcomes, all 0 or 1, of a source's last group of (unit, hash, size, fraction), and
    the units that were forced.

    Rows go by falling size, those within a factor of two at a time, in pairs. What
    these leave undecided, one row, meets all smaller rows together, so that its
    words end among rows that can settle them. If they have no room for it, it
    goes on in pairs with smaller rows, or, being more than NEAR of all words, is
    forced. A coin decides the last one."""
    rows = sorted(todo, key=lambda r: (-r[2], r[0]))
    size, p = np.array([r[2] for r in rows], dtype=float), np.array([r[3] for r in rows], dtype=float)
    goal, done, forced, held, k = float(size @ p), {}, set(), [], 0
    while k < len(rows):
        end = k + int(np.searchsorted(-size[k:], -size[k] / 2, side="left")) if size[k] > 0 else len(rows)
        end = max(end, k + 1)
        now = held + [(u, m, n, float(x)) for (u, m, n, _), x in zip(rows[k:end], p[k:end])]
        got, held, k = dict(_pivot(now, seed)), [], end
        for row in now:
            if got[row[0]] not in (0.0, 1.0):
                row = (*row[:3], got[row[0]])
                taken, p[k:], hard = _against_the_rest(row, size[k:], p[k:], seed, row[2] > NEAR * goal)
                if taken is None:
                    held = [row]
                got[row[0]] = taken
                forced |= {row[0]} if hard else set()
        done |= {u: x for u, x in got.items() if x is not None}
    return done | {u: float(_coin(seed, m, -2) < x) for u, m, _, x in held}, forced


def _rounds(seed: int):
    """Rounds one group. In a source's last group nothing stays undecided."""

    def run(rows: pa.Table) -> pa.Table:
        last = rows.column("buckets")[0].as_py() == 1
        rows = rows.sort_by([("unit", "ascending")])
        todo = list(zip(*(rows.column(c).to_pylist() for c in ("unit", "unit", "size", "p"))))
        got, forced = _settled(todo, seed) if last else (dict(_pivot(todo, seed)), set())
        units = rows.column("unit").to_pylist()
        rows = rows.set_column(rows.schema.get_field_index("p"), "p", pa.array([got[u] for u in units], pa.float64()))
        return rows.append_column("forced", pa.array([u in forced for u in units], pa.bool_()))

    return run


def _unit(id_col: str, text_col: str, source_col: str) -> Column:
    """Hash of id, text and source: rows that repeat these are one unit."""
    source = F.col(source_col).cast("string")
    return F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), F.coalesce(F.col(text_col), F.lit("")), F.coalesce(source, F.lit("")), source.isNull())


def _shared_out() -> Column:
    """Of a unit's copies those of its row `at`."""
    return (F.floor(F.col("copies") / F.col("rows")) + (F.col("at") < F.col("copies") % F.col("rows")).cast("int")).cast("int")


def _numbered(df: DataFrame) -> DataFrame:
    """A written df(unit, uid, ...) with `at`, each row's place in its unit, from 0.
    No group is larger than a unit's rows in one partition, whose number uid holds;
    what partitions have together are a few numbers each."""
    df = df.withColumn("_part", F.shiftright("uid", 33))
    each = df.groupBy("unit", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("unit").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = written(each.select("unit", "_part", before.alias("_before")), "before")
    own = F.row_number().over(Window.partitionBy("unit", "_part").orderBy("uid")) - 1
    return df.withColumn("_own", own).join(each, ["unit", "_part"]).withColumn("at", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def _units(df: DataFrame, id_col: str, text_col: str, source_col: str, weights, cap, seed, bucket_rows, fan_in, max_sources) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The table's narrow rows (written), what is planned for each source, its units
    (unit, rows, whole copies, copies of all these), and how many rows there are."""
    spark = df.sparkSession
    narrow = df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _unit(id_col, text_col, source_col).alias("unit")
    )
    rows, seen = counted(narrow.withColumn("uid", F.monotonically_increasing_id()), "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    goal = targets({r.source: r.source_size for r in totals}, weights, cap)
    plan = spark.createDataFrame(
        [(r.source, r.source_size, goal[r.source], goal[r.source] / r.source_size if r.source_size else 0.0, max(1, -(-r.n // bucket_rows))) for r in totals],
        "source string, source_size long, target double, rate double, buckets long",
    )
    plan = F.broadcast(plan) if len(totals) <= 10_000 else plan
    each = rows.groupBy("unit").agg(F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("rows"))
    dealt = each.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("unit", "r.source", "size", "rows", "rate", "buckets")
    whole = F.floor(F.col("rows") * F.col("rate") + EPS)
    state = written(
        dealt.select(
            "unit", "source", "size", "rows", whole.alias("whole"), F.greatest(F.col("rows") * F.col("rate") - whole, F.lit(0.0)).alias("p"), "buckets",
            F.pmod(F.xxhash64("unit", F.lit(seed)), F.col("buckets")).alias("bucket"),
        ),
        "units", rows=seen["rows"],
    )
    schema = "unit long, source string, size long, p double, buckets long, bucket long, forced boolean"
    left, decided, most = state.select("unit", "source", "size", "p", "buckets", "bucket"), [], max([-(-r.n // bucket_rows) for r in totals], default=1)
    while True:
        at = written(left.groupBy("source", "bucket").applyInArrow(_rounds(seed), schema), "pivot", rows=seen["rows"])
        decided.append(at.where("p = 0 or p = 1"))
        if most <= 1:
            break
        most = -(-most // fan_in)
        left = at.where("p <> 0 and p <> 1").drop("forced").withColumn("bucket", F.floor(F.col("bucket") / fan_in)).withColumn("buckets", F.ceil(F.col("buckets") / fan_in))
    extra = decided[0]
    for d in decided[1:]:
        extra = extra.union(d)
    copies = F.when(F.col("size") == 0, F.col("rows")).otherwise((F.col("whole") + F.coalesce(F.col("p"), F.lit(0.0))).cast("long"))
    units = state.drop("p").join(extra.select("unit", "p", "forced"), "unit", "left").select("unit", "rows", "whole", copies.alias("copies"), F.coalesce("forced", F.lit(False)).alias("forced"))
    return rows, plan, units, seen["rows"]


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, seed: int = 17, bucket_rows: int = 5_000, fan_in: int = 64, max_sources: int = 1_000_000,
) -> DataFrame:
    """One row per row of df: doc_id, source, size, source_size, target, copies, taken and forced.

    A row's expected number of copies is its source's target over its source's
    size. All get the whole part; the fractional parts are rounded by the pivotal
    method with words as mass, each row's expectation being kept, so that a source's
    words meet its target to within the size of one small row. Units of work are rows
    that differ in id, text or source; rows that repeat a unit are counted first,
    rounded as one, and share out its copies, the first ones getting one more if the
    number can't be divided. Units are dealt by source and hash into buckets of about
    bucket_rows, each rounded by itself; a bucket leaves one undecided at most, and
    those meet in a tree, fan_in buckets at a time, until one bucket per source is
    left. There, rows go by falling size, and a large one that is left undecided meets
    all smaller ones together. Coins are hashes, so reruns agree on any layout.

    Where a row is so large that the rest of its last bucket can't make up for it on
    either side, no fair coin ends near the target: it is `forced` to the side that
    ends nearer. Such rows' copies are biased, and so are, by what they would have
    had on the average, those of the others of their bucket.

    Nulls: a null text has size 0, a null source is a source, a null id counts as
    -1 in hashes. Which of the rows repeating a unit gets a copy more is open,
    how many they get together is not. Rows of size 0 have one copy, which takes
    no words. An empty table gives an empty table. Sources' totals (one row each;
    max_sources at most, or this raises) are read by the driver.
    """
    rows, plan, units, _ = _units(df, id_col, text_col, source_col, weights, cap, seed, bucket_rows, fan_in, max_sources)
    met = rows.join(units.drop("whole"), "unit")
    again = written(met.where("rows > 1"), "repeats")
    all_ = met.where("rows = 1").withColumn("at", F.lit(0).cast("long")).unionByName(_numbered(again).withColumn("at", F.col("at").cast("long")))
    k = _shared_out()
    told = all_.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    return told.select("doc_id", "r.source", "size", "source_size", "target", k.alias("copies"), (k * F.col("size")).cast("long").alias("taken"), "forced")


def mix_rows(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, seed: int = 17, bucket_rows: int = 5_000, fan_in: int = 64, max_sources: int = 1_000_000,
) -> DataFrame:
    """df's rows, all columns, each repeated as often as mix() takes it.

    A row that is its unit's only one has its source's whole copies, or one more. Filters
    tell which, so that texts don't move: one of the units with one more, and one of
    those that it is wrong about, and of all that are otherwise. Only rows that this
    second filter lets through meet their decisions; those that repeat a unit are
    written and numbered before they share out its copies.
    """
    cols = df.columns
    named = [f"c{i}" for i in range(len(cols))]
    key, text, source = (named[cols.index(c)] for c in (id_col, text_col, source_col))
    docs = df.toDF(*named).withColumn("unit", _unit(key, text, source))
    _, plan, units, n = _units(docs, key, text, source, weights, cap, seed, bucket_rows, fan_in, max_sources)
    units = written(units.withColumn("over", F.when(F.col("rows") == 1, F.col("copies") - F.col("whole"))), "copies", rows=n)
    bits, blocks = key_filter(units.where("over = 1"), "unit", n)
    more = written(bits, "more")
    tested = maybe_in(units, "unit", more, blocks, "_more").withColumn("_odd", F.coalesce(~F.col("over").isin(0, 1), F.lit(True)) | ((F.col("over") == 0) & F.col("_more")))
    odd, seen = counted(tested.where("_odd").select("unit"), "odd", n)
    bits, odd_blocks = key_filter(odd, "unit", max(seen["rows"], 1))
    bits = written(bits, "odd")

    told = maybe_in(docs, "unit", bits, odd_blocks, "_odd")
    plain = maybe_in(told.where("not _odd").drop("_odd"), "unit", more, blocks, "_more")
    plain = plain.join(plan.select(F.col("source").alias("_source"), F.floor(F.col("rate") + EPS).alias("_whole")), F.col(source).cast("string").eqNullSafe(F.col("_source")))
    alone = plain.select(*named, (F.col("_whole") + F.col("_more").cast("int")).cast("int").alias("k"))
    if seen["rows"]:
        few = maybe_in(units, "unit", bits, odd_blocks, "_odd").where("_odd").select("unit", "rows", "copies")
        some = written(told.where("_odd").drop("_odd").join(few, "unit").withColumn("uid", F.monotonically_increasing_id()), "met")
        alone = alone.union(some.where("rows = 1").select(*named, F.col("copies").cast("int").alias("k")))
        alone = alone.union(_numbered(some.where("rows > 1")).select(*named, _shared_out().alias("k")))
    return alone.where("k > 0").select(*named, F.explode(F.array_repeat(F.lit(0), F.col("k")))).select(*named).toDF(*cols)
