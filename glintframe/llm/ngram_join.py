"""Documents linked by the Jaccard similarity of their word n-grams.

The join is a sparse product of the document by n-gram incidence with itself. The
incidence is found in one pass over the texts and kept, a row for each distinct set,
its columns cut into blocks by hash. Pairs come from the columns of each set's rarest
n-grams, as many as two linked sets can't avoid to share one of. Then the blocks are
multiplied one after the other for these pairs alone: overlap counts are summed up,
and after each block go the pairs whose count and what is left of both sets can't
reach the overlap that their sizes ask for.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintframe.llm.common import BLOCK_BITS, bounded_batches, connected, counted, drop_written, give_back, key_filter, maybe_in, written

U = np.uint64
#: Counters of n-grams by their hash, and bits of the filters of n-grams and sets, by
#: the rows of the table, within these bounds (as exponents of 2). Sums of counters
#: (2 bytes each) and filters are sent to all tasks, 32 MB each at most.
COUNTERS, FILTERS = (16, 24), (20, 28)
#: 64-bit words of a set's parity map, and of the folded one that goes with its n-grams.
PARITY, FOLDED = 8, 2
#: Where the columns of the incidence are cut into blocks: upper ends, in 64ths of the hashes.
BLOCKS = (8, 24, 64)
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_CODES = _mixed(np.arange(1, 257, dtype=U) * U(_BASE))[_LOWER]
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2^64, kept from call to call."""
    if len(_tables.get("up", ())) < n:
        size = max(n, 1 << 18)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, U(base))
                steps[0] = U(1)
                _tables[name] = np.cumprod(steps, dtype=U)
    return _tables["up"], _tables["down"]


def word_hashes(data: np.ndarray, starts_new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of UTF-8 bytes, A-Z lower-cased; starts_new marks
    bytes at which a new text begins. Hashes are differences of prefix sums."""
    space = _SPACE[data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    begin = np.flatnonzero(~space & (before | starts_new))
    after = np.empty_like(space)
    after[-1], after[:-1] = True, space[1:] | starts_new[1:]
    end = np.flatnonzero(~space & after) + 1
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(_CODES[data] * up[: len(data)], out=sums[1:])
    return begin, _mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U))


def _chunks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of `size` bytes together, or single larger ones."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def gram_sets(texts: pa.Array, width: int, chunk: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last, size of each one's set, all sets' hashes one
    after the other, each sorted), chunk by chunk. A text's set has its distinct
    `width`-word n-grams; with fewer words, all of them as one; with none, nothing."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=texts.offset + len(texts) + 1)[texts.offset :].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw else np.zeros(0, np.uint8)
    old = np.seterr(over="ignore")
    try:
        for lo, hi in _chunks(offsets, chunk):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo:hi] - offsets[lo]
            if not len(part):
                yield lo, hi, np.zeros(hi - lo, np.int64), np.zeros(0, U)
                continue
            new = np.zeros(len(part), dtype=bool)
            new[at[at < len(part)]] = True
            begin, words = word_hashes(part, new)
            doc = np.searchsorted(at, begin, "right") - 1
            count = np.bincount(doc, minlength=hi - lo)
            first = np.concatenate(([0], np.cumsum(count)))
            grams = np.zeros(max(len(words) - width + 1, 0), dtype=U)
            for k in range(width):
                grams = _mixed(grams * U(0xD6E8FEB86659FD93) + words[k : k + len(grams)])
            whole = np.flatnonzero(doc[: len(grams)] == doc[width - 1 :]) if len(grams) else np.zeros(0, np.int64)
            owner, value = doc[whole], grams[whole]
            short = np.flatnonzero((count > 0) & (count < width))
            if len(short):
                h = np.full(len(short), U(7))
                for k in range(width - 1):
                    there = k < count[short]
                    nxt = words[np.minimum(first[short] + k, len(words) - 1)]
                    h = np.where(there, _mixed(h * U(0xA24BAED4963EE407) + nxt), h)
                owner, value = np.concatenate((owner, short)), np.concatenate((value, h))
            order = np.lexsort((value, owner))
            owner, value = owner[order], value[order]
            fresh = np.ones(len(value), dtype=bool)
            fresh[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
            owner, value = owner[fresh], value[fresh]
            yield lo, hi, np.bincount(owner, minlength=hi - lo), value
    finally:
        np.seterr(**old)


def _per_set(op, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """op.reduce of each set's values; 0 for empty sets."""
    out = np.zeros(len(sizes), dtype=values.dtype)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = op.reduceat(values, (np.cumsum(sizes) - sizes)[full])
    return out


def _set_id(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits for each set, alike for equal sets."""
    return _mixed(_per_set(np.add, _mixed(values ^ U(0x5851F42D4C957F2D)), sizes) + sizes.astype(U)).view(np.int64)


def _parity(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Maps of which bits an odd number of a set's n-grams fall on: where two maps
    differ in k bits, at least k n-grams are in one set only."""
    mark = _mixed(values ^ U(0x2545F4914F6CDD1D))
    bit, word = U(1) << (mark & U(63)), (mark >> U(6)) & U(PARITY - 1)
    return [_per_set(np.bitwise_xor, np.where(word == U(k), bit, U(0)), sizes).view(np.int64) for k in range(PARITY)]


_MAPS = [f"p{k}" for k in range(PARITY)]
_GRAMS = [f"g{k}" for k in range(len(BLOCKS))]
_ENDS = np.array([(e << 58) - 1 for e in BLOCKS], dtype=U)
SURVEY = (
    "doc_id long, mark long, n long, sid long, uid long, " + "".join(f"{p} long, " for p in _MAPS) + "".join(f"{g} array<long>, " for g in _GRAMS) + "part int, counts binary"
)
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _exponent(n: int, bounds: tuple[int, int]) -> int:
    return min(max(n.bit_length(), bounds[0]), bounds[1])


def _surveyed(width: int, counters: int, remembered: int = 100_000):
    """The pass over the texts: (doc_id, mark, n, sid) of each, with the parity map and
    the n-grams, by blocks, of each set that the task hasn't met (of those met, it
    remembers so many), and a number `uid` of the row; at the end the n-grams' counters, cut in parts."""
    names, kinds = zip(*((x.split()[0], _ARROW[x.split()[1]]) for x in SURVEY.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, told, uid = np.zeros(1 << counters, dtype=np.int32), set(), TaskContext.get().partitionId() << 40
        for b in batches:
            for lo, hi, size, values in gram_sets(b.column("text"), width):
                at, k = np.unique(values >> U(64 - counters), return_counts=True)
                counts[at.astype(np.int64)] += k.astype(np.int32)
                sid = _set_id(values, size)
                if len(told) > remembered:
                    told.clear()
                fresh = np.zeros(hi - lo, dtype=bool)
                for i in np.flatnonzero(size).tolist():
                    s = int(sid[i])
                    if s not in told:
                        told.add(s)
                        fresh[i] = True
                maps = [pa.array(p, mask=~fresh) for p in _parity(values, size)]
                doc = np.repeat(np.arange(hi - lo), size)
                mine = fresh[doc]
                doc, kept = doc[mine], values[mine]
                block = np.searchsorted(_ENDS, kept)
                held = np.bincount(doc * len(BLOCKS) + block, minlength=(hi - lo) * len(BLOCKS)).reshape(-1, len(BLOCKS))
                lists = []
                for j in range(len(BLOCKS)):
                    ends = pa.array(np.concatenate(([0], np.cumsum(held[:, j]))).astype(np.int32), mask=np.append(~fresh, False))
                    lists.append(pa.ListArray.from_arrays(ends, pa.array(kept[block == j].view(np.int64))))
                none = [pa.nulls(hi - lo, t) for t in kinds[-2:]]
                own = [b.column(c).slice(lo, hi - lo) for c in ("doc_id", "mark")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(size.astype(np.int64)), pa.array(sid), pa.array(uid + np.arange(hi - lo)), *maps, *lists, *none], names=list(names))
                uid += hi - lo
        if counts.any():
            for k, part in enumerate(np.split(counts, 64)):
                row = [pa.nulls(1, t) for t in kinds[:-2]] + [pa.array([k], pa.int32()), pa.array([zlib.compress(part.astype("<i4").tobytes(), 1)], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=list(names))

    return run


def _sum_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of counters, and of these the logarithm, in 2 bytes, which no sum exceeds."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column("part").to_pylist(), b.column("counts").to_pylist()):
            got = np.frombuffer(zlib.decompress(raw), dtype="<i4").astype(np.int64)
            sums[k] = sums[k] + got if k in sums else got
    rows = [(k, zlib.compress((np.log2(v + 1.0) * 1000).astype("<u2").tobytes(), 1)) for k, v in sums.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "counts"])


def _least(n, num: int, den: int):
    """How much of a set of n must be shared with any partner: n * num / den, rounded up."""
    return -(-n * num // den)


def _prefixes(num: int, den: int, counts):
    """The rarest n-grams of each set, with np, its size and their places in it (see
    _n and _pos). Sets too small to be linked with a different one have none."""
    names = ["gram", "sid", "np", *[f"q{k}" for k in range(FOLDED)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = counts.value
        shift = U(65 - len(rare).bit_length())
        for b in batches:
            size, sid = b.column("n").to_numpy(), b.column("sid").to_numpy()
            maps = [b.column(p).to_numpy() for p in _MAPS]
            folded = [np.bitwise_xor.reduce(maps[k::FOLDED]) for k in range(FOLDED)]
            lists = [b.column(g) for g in _GRAMS]
            doc = np.concatenate([np.repeat(np.arange(len(size)), np.diff(x.offsets.to_numpy())) for x in lists])
            values = np.concatenate([x.flatten().to_numpy().view(U) for x in lists])
            order = np.lexsort((values, rare[(values >> shift).astype(np.int64)], doc))
            doc, values = doc[order], values[order]
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
            keep = pos <= size[doc] - _least(size[doc], num, den)
            doc, values, pos = doc[keep], values[keep], pos[keep]
            cols = [values.view(np.int64), sid[doc], (pos << 32) + size[doc], *[q[doc] for q in folded]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return run


def _table(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """A filter of 1 << bits bits, those of the keys being set, as an array for all tasks."""
    place = F.pmod(F.col(key), F.lit(1 << bits))
    made = keys.groupBy(F.floor(place / BLOCK_BITS).alias("block")).agg(F.bitmap_construct_agg(place % BLOCK_BITS).alias("bits"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for block, raw in made.collect():
        out[block * BLOCK_BITS // 8 : (block + 1) * BLOCK_BITS // 8] = np.frombuffer(raw, dtype=np.uint8)
    return out


def _in_table(bits, column: str, only=None):
    """Adds `there`: whether the column's value may be among those of a filter. With
    `only`, another one, rows that can't be among those of that are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def holds(table: np.ndarray, value: np.ndarray) -> np.ndarray:
            place = value % (len(table) * 8)
            return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1

        for b in batches:
            value = b.column(column).to_numpy()
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(holds(bits.value, value))], names=[*b.schema.names, "there"])
            yield out if only is None else out.filter(pa.array(holds(only.value, value)))

    return run


def _pos(np_: Column) -> Column:
    return F.shiftright(np_, 32)


def _n(np_: Column) -> Column:
    return np_.bitwiseAND(F.lit((1 << 32) - 1))


def _differ(words: int, name: str) -> Column:
    """Bits in which a's and b's parity maps differ."""
    return sum((F.bit_count(F.col(f"a.{name}{k}").bitwiseXOR(F.col(f"b.{name}{k}"))) for k in range(words)), F.lit(0))


def _may_link(num: int, den: int) -> Column:
    """Bounds on two rows a and b of one n-gram: sizes, places and folded parity maps."""
    na, nb, pa_, pb = _n(F.col("a.np")), _n(F.col("b.np")), _pos(F.col("a.np")), _pos(F.col("b.np"))
    return (
        (F.least(na, nb) * den >= F.greatest(na, nb) * num)
        & (F.least(na - pa_, nb - pb) * (num + den) >= (na + nb) * num)
        & (_differ(FOLDED, "q") * (num + den) <= (na + nb) * (den - num))
    )


def _size_class(n: Column, num: int, den: int) -> Column:
    """Sizes of linked sets are of one class, or of two next to each other."""
    return F.floor(F.log(n) / (1.000001 * math.log(den / num))) if num < den else n


def _paired(met: DataFrame, hub: Column) -> DataFrame:
    """Rows a and b of one n-gram as pairs (lo, hi, hub) of sets, each pair once. Of a
    pair with a set that many are paired with, hub says which that is."""
    lo, hi = F.least("a.sid", "b.sid"), F.greatest("a.sid", "b.sid")
    return met.select(lo.alias("lo"), hi.alias("hi"), hub.alias("hub"))


def _linked(pairs: DataFrame, sets: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (see _paired) of sets, as (a, b), those whose Jaccard similarity is num / den or more.

    Whole parity maps come first. For the pairs that they can't tell apart, the
    blocks of sets are multiplied, one after the other: a pair's overlap in the block
    is added to `got`, what the block holds of its sets is taken from what is
    `left` of them, and pairs for which got and the lesser one left can't reach
    num / (num + den) of both sizes go. The set of the pair that is in fewer pairs
    travels to the other one.
    """
    once = pairs.groupBy("lo", "hi").agg(F.max("hub").alias("hub"))
    ends = once.select(F.when(F.col("hub") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("a"), F.when(F.col("hub") == F.col("lo"), F.col("lo")).otherwise(F.col("hi")).alias("b"))
    a, b = (nodes.select(*[F.col(c).alias(c if c in _MAPS else f"{x}_{c}") for c in nodes.columns]).alias(x) for x in "ab")
    met = ends.join(a, F.col("a") == F.col("a.a_sid")).join(b, F.col("b") == F.col("b.b_sid"))
    near = met.where(_differ(PARITY, "p") * (num + den) <= (F.col("a_n") + F.col("b_n")) * (den - num))
    need = F.col("a_n") + F.col("b_n")
    now, seen = counted(near.select("a", "b", F.col("a_uid").alias("ua"), F.col("b_uid").alias("ub"), (need * num).alias("need"), F.col("a_n").alias("la"), F.col("b_n").alias("lb"), F.lit(0).cast("long").alias("got")), "pairs")
    if not seen["rows"]:
        return now.select("a", "b")
    held = now.select(F.explode(F.array("ua", "ub")).alias("uid")).withColumn("h", F.xxhash64("uid"))
    bits, blocks = key_filter(held, "h", 2 * seen["rows"])
    mine = maybe_in(sets.withColumn("h", F.xxhash64("uid")), "h", written(bits, "held"), blocks, "there").where("there").select("uid", *_GRAMS)
    for g in _GRAMS:
        block = mine.select("uid", g)
        both = now.join(block.select(F.col("uid").alias("ua"), F.col(g).alias("ga")), "ua").join(block.select(F.col("uid").alias("ub"), F.col(g).alias("gb")), "ub")
        summed = both.select(
            "a", "b", "ua", "ub", "need", (F.col("la") - F.size("ga")).alias("la"), (F.col("lb") - F.size("gb")).alias("lb"),
            (F.col("got") + F.size(F.array_intersect("ga", "gb"))).alias("got"),
        )
        now = written(summed.where((F.col("got") + F.least("la", "lb")) * (num + den) >= F.col("need")), "overlaps")
    return now.select("a", "b")


def _members(df: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, crowd: int) -> tuple[DataFrame, int]:
    """A written row for each row of df: doc_id, mark (hash of the text), n and
    component, of linked sets, and how many rows there are."""
    spark = df.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    rows = df.count()
    counters, bits = _exponent(rows * 16, COUNTERS), _exponent(rows * 256, FILTERS)
    seen = written(docs.mapInArrow(give_back(_surveyed(width, counters)), SURVEY), "survey")
    parts = seen.where("part is not null").select("part", "counts").repartition(16, "part").mapInArrow(_sum_parts, "part int, counts binary").collect()  # 64 rows
    counts = np.zeros(1 << counters, dtype=np.uint16)
    for k, raw in parts:
        counts[k * (len(counts) // 64) : (k + 1) * (len(counts) // 64)] = np.frombuffer(zlib.decompress(raw), dtype="<u2")
    known, sets = seen.where("part is null").select("doc_id", "mark", "n", "sid"), seen.where("p0 is not null")
    nodes = written(sets.groupBy("sid").agg(F.min("uid").alias("uid"), F.first("n").alias("n"), *[F.first(p).alias(p) for p in _MAPS]), "nodes", rows=rows)

    schema = "gram long, sid long, np long" + "".join(f", q{k} long" for k in range(FOLDED))
    rare = spark.sparkContext.broadcast(counts)
    large = sets.where(F.col("n") * den >= (F.col("n") + 1) * num).select("n", "sid", *_MAPS, *_GRAMS)
    first, told = counted(large.mapInArrow(give_back(_prefixes(num, den, rare)), schema), "prefixes")
    rare.unpersist()
    del counts, parts
    often = written(first.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1"), "often", rows=told["rows"])
    again, hot = (spark.sparkContext.broadcast(_table(often.where(x), "gram", bits)) for x in ("true", f"k > {crowd}"))
    shared, told = counted(first.mapInArrow(give_back(_in_table(hot, "gram", again)), schema + ", there boolean"), "shared")
    again.unpersist(), hot.unpersist()
    drop_written(first), drop_written(often)

    few, crowded = shared.where("not there").drop("there"), shared.where("there").drop("there")
    close = few.alias("a").join(few.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.sid") < F.col("b.sid")) & _may_link(num, den))
    lead = F.min(F.struct("np", "sid", *[f"q{k}" for k in range(FOLDED)])).alias("p")
    front = written(crowded.groupBy("gram").agg(lead, F.max("sid").alias("hi"), F.min("sid").alias("lo")).where("lo <> hi").select("gram", "p.*"), "fronts", rows=told["rows"])
    stars = crowded.alias("a").join(front.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.sid") != F.col("b.sid")) & _may_link(num, den))
    none = F.lit(None).cast("long")
    links = _linked(_paired(close, none).union(_paired(stars, F.col("b.sid"))), sets, nodes, num, den)
    groups, grouped = counted(connected(links), "groups")

    # most sets are linked with none: only those that may be meet the groups, the others are groups of their own
    mine = spark.sparkContext.broadcast(_table(groups, "id", bits))
    tested = lambda df, c: df.mapInArrow(_in_table(mine, c), df.select("*", F.lit(True).alias("there")).schema)

    def met(df: DataFrame, of: str, name: str) -> DataFrame:
        told = tested(df, of)
        some = told.where("there").drop("there").join(groups.select(F.col("id").alias(of), F.col("component").alias(name)), of, "left").withColumn(name, F.coalesce(name, of))
        return some.select(*df.columns, name).union(told.where("not there").select(*df.columns, F.col(of).alias(name)))

    leads = met(front.select("gram", F.col("sid").alias("lead")), "lead", "group").drop("lead")
    mixed = met(crowded, "sid", "component").join(leads, "gram").withColumn("class", _size_class(_n(F.col("np")), num, den))
    mixed = written(mixed, "mixed")  # a crowded n-gram's rows can be split again
    outside = mixed.where("component <> group").withColumn("class", F.explode(F.array(*[F.col("class") + k for k in (-1, 0, 1)])))
    across = outside.alias("a").join(
        mixed.alias("b"),
        (F.col("a.gram") == F.col("b.gram")) & (F.col("a.class") == F.col("b.class")) & (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("b.group")) | (F.col("a.sid") < F.col("b.sid"))) & _may_link(num, den),
    )
    more = _linked(_paired(across, none), sets, nodes, num, den)
    if more.take(1):
        groups = written(connected(links.union(more)), "groups", rows=2 * rows)
    whole = known.join(groups.select(F.col("id").alias("sid"), "component"), "sid", "left").select("doc_id", "mark", "n", F.coalesce("component", "sid").alias("component"))
    return written(whole, "members"), rows


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, num: int = 90, den: int = 100, crowd: int = 32) -> DataFrame:
    """One row per row of df: doc_id, n_shingles (size of its set), component_id (the
    smallest id that links lead to, its own included).

    Two texts are linked when den * overlap >= num * union of their sets (see
    gram_sets). Equal sets are one node. Pairs that share a prefix n-gram and keep
    the bounds are looked at: of n-grams with `crowd` rows or fewer all of them. Rows
    of the others are first held against that which stands nearest to its front, one
    pair per row: that joins large groups of near copies without their pairs. Then
    those pairs are looked at whose groups are still different, so that no link
    between groups is missed. A pair within a group is of no consequence.

    Null and empty texts have no n-grams and are linked with nothing. A row with a
    null id links like others, but is no component's id: where only such rows are
    linked, that is null. Rows that repeat an id are nodes of their own. Other
    columns aren't read. An empty table gives an empty table. Hashes have 64 bits.
    """
    whole, rows = _members(df, id_col, text_col, width, num, den, crowd)
    least = written(whole.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least", rows=rows)
    full = whole.where("n > 0").join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(whole.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, num: int = 80, den: int = 100, crowd: int = 32) -> DataFrame:
    """df's rows, all columns, of each component one: that with the smallest id (null
    ids last; of several texts with that id the one with the smallest hash; of rows
    that repeat id and text any). Rows without n-grams all stay.

    Rows are told apart by id and text, so that a row whose id stands for another
    text as well is never taken for that. Only rows that a filter of the decisions
    lets through are shuffled to meet these.
    """
    whole, rows = _members(df, id_col, text_col, width, num, den, crowd)
    each = whole.where("n > 0").groupBy("component", "doc_id", "mark").agg(F.count("*").alias("k"))
    order = F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "mark")
    each = written(each.select("component", order.alias("key"), "k"), "keys", rows=rows)
    best = written(each.groupBy("component").agg(F.min("key").alias("best"), F.count("*").alias("keys"), F.sum("k").alias("k")).where("k > 1").drop("k"), "best", rows=rows)
    told = each.join(best, "component").select(F.col("key.doc_id").alias("_i"), F.col("key.mark").alias("_m"), (F.col("key") == F.col("best")).alias("_stays"), "k").where("not _stays or k > 1")
    told, seen = counted(told.select("_i", "_m", "_stays", F.xxhash64("_i", "_m").alias("_h")), "decisions", rows)
    if not seen["rows"]:
        return df

    cols = df.columns
    named = [f"c{i}" for i in range(len(cols))]
    flat = df.toDF(*named)
    key, text = F.col(named[cols.index(id_col)]).cast("long"), F.coalesce(F.col(named[cols.index(text_col)]), F.lit(""))
    flat = flat.withColumn("_i", key).withColumn("_m", F.xxhash64(text)).withColumn("_h", F.xxhash64("_i", "_m"))
    bits, blocks = key_filter(told, "_h", seen["rows"])
    tested = maybe_in(flat, "_h", written(bits, "decided"), blocks, "_maybe")
    d = told.alias("d")
    found = tested.where("_maybe").alias("r").join(d, (F.col("r._h") == F.col("d._h")) & F.col("r._i").eqNullSafe(F.col("d._i")) & (F.col("r._m") == F.col("d._m")), "left")
    found = found.select(*named, "r._i", "r._m", F.col("d._stays").alias("_stays"))
    stay = tested.where("not _maybe").select(*named).union(found.where("_stays is null").select(*named))
    one = found.where("_stays").groupBy("_i", "_m").agg(F.first(F.struct(*named)).alias("_row")).select("_row.*")
    return stay.union(one.select(*named)).toDF(*cols)
