"""Source divergence audit: how far the sources of a language are from each other
and from the language, in exact whole numbers, over terms that enough documents use."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintframe.llm.common import bounded_batches, counted, give_back, scratch, written

#: Shares are in units of 1 / UNIT.
UNIT = 1_000_000_000
#: As bytes of UTF-8: letters A-Z in lower case, a-z and all above ASCII stay, anything else separates.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SEEN = "lang string, term string, df long, sources array<struct<source: string, n: long>>"
#: Counters of one row of a block of the sketch.
WIDTH = 1 << 13


def _tally(most: int):
    """Rows (lang, source, text) -> SEEN: each language's terms with the number of the
    task's rows that have them, and their occurrences by source. Up to `most` terms of
    sources are held at a time; what is told of a term in several rows adds up. A
    language's row with an empty term has all its sources."""
    names = [c.split()[0] for c in SEEN.split(", ")[:4]]
    pair = pa.struct([("source", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        docs: dict[str, Counter] = defaultdict(Counter)

        def told() -> Iterator[pa.RecordBatch]:
            for lang, by in times.items():
                df = docs.pop(lang)
                place = {t: k for k, t in enumerate(df, 1)}
                at = np.concatenate([np.zeros(len(by), dtype=np.int64), *(np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in by.values())])
                n = np.concatenate([np.zeros(len(by), dtype=np.int64), *(np.fromiter(c.values(), np.int64, len(c)) for c in by.values())])
                code = np.concatenate([np.arange(len(by)), np.repeat(np.arange(len(by)), [len(c) for c in by.values()])])
                order = np.argsort(at, kind="stable")
                offsets = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(df) + 1))))
                source = pa.array(list(by), pa.string()).take(pa.array(code[order]))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([source, pa.array(n[order])], fields=list(pair)))
                terms = pa.array([b"", *df], pa.binary()).cast(pa.string())
                yield from pa.Table.from_arrays([pa.array([lang] * (len(df) + 1), pa.string()), terms, pa.array([0, *df.values()], pa.int64()), lists], names=names).to_batches(20_000)
            times.clear()

        held = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                terms = text.as_py().translate(TERM_BYTES).split()
                mine = times[lang][source]
                held -= len(mine)
                mine.update(terms)
                docs[lang].update(set(terms))
                held += len(mine)
                if held > most:
                    yield from told()
                    held = 0
        yield from told()

    return run


def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", most: int = 500_000) -> DataFrame:
    """SEEN of df, pre-aggregated within tasks, in one pass over the texts."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(none(lang_col).alias("lang"), none(source_col).alias("source"), none(text_col).alias("text")).mapInArrow(give_back(_tally(most)), SEEN)


def _slots(depth: int) -> list[Column]:
    """The counter of its block that a mark falls on, in each row of the block."""
    draw = F.xxhash64("mark")
    return [F.shiftright(draw, 13 * k).bitwiseAND(F.lit(WIDTH - 1)) + k * WIDTH for k in range(depth)]


def _block(blocks: int) -> Column:
    return F.pmod("mark", F.lit(blocks))


def sketch(marks: DataFrame, blocks: int, depth: int, at_least: int, tasks: int | None = None) -> DataFrame:
    """(block, bits): of a count-min sketch of marks(mark, df), which counters reach
    at_least, 64 to a number.

    A mark's hash gives its block, and one counter in each of the block's depth (at
    most 4) rows. Every task adds up its own sketch, counters that stop at at_least (a
    byte each below 128); the tasks' sketches are merged block by block. No counter
    is below the document frequency of any term on it, or it reached at_least. Few
    large tasks, as each sends what it has met of the sketch.
    """
    kind = np.uint8 if at_least < 128 else np.int64
    size = WIDTH * depth
    names = [f"s{k}" for k in range(depth)]
    first = _block(blocks) * size
    placed = marks.select(F.least(F.col("df"), F.lit(at_least)).cast("int").alias("df"), *[(first + s).alias(n) for s, n in zip(_slots(depth), names)])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(blocks * size, dtype=kind)
        for b in batches:
            df = b.column(0).to_numpy()
            for n in names:
                slot, at = np.unique(b.column(n).to_numpy(), return_inverse=True)
                table[slot] = np.minimum(table[slot] + np.minimum(np.bincount(at, df, len(slot)), at_least), at_least)
        rows = table.reshape(-1, size)
        for k in np.flatnonzero(rows.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([rows[k].tobytes()], pa.binary())], names=["block", "counters"])

    def merge(rows: pa.Table) -> pa.Table:
        total = None
        for c in rows.column("counters"):
            one = np.frombuffer(c.as_buffer(), dtype=kind)
            total = one.copy() if total is None else np.minimum(total + one, at_least)
        bits = np.packbits(total >= at_least, bitorder="little").view("<i8")
        return pa.table({"block": rows.column("block")[:1].cast(pa.int64()), "bits": pa.array([bits], pa.list_(pa.int64()))})

    few = placed.coalesce(tasks or 2 * marks.sparkSession.sparkContext.defaultParallelism)
    return few.mapInArrow(give_back(own), "block long, counters binary").groupBy("block").applyInArrow(merge, "block long, bits array<long>")


def possible(df: DataFrame, bits: DataFrame, blocks: int, depth: int) -> DataFrame:
    """Rows of df(mark, ...) whose counters all reach the sketch's bound; the others' terms can't."""
    out = df.withColumn("_block", _block(blocks)).join(F.broadcast(bits.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))), "_block")
    for s in _slots(depth):
        word = F.get("_bits", F.shiftright(s, 6).cast("int"))
        out = out.where(F.getbit(word, s.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return out.drop("_block", "_bits")


def kept_terms(seen: DataFrame, types: int, at_least: int = 3, *, depth: int = 4, max_counters: int = 1 << 26) -> tuple[DataFrame, dict]:
    """(lang, source, term, n, whole, first) of the terms that at_least documents of their
    language use, counted exactly, as a written table, with the language's count and
    a mark on one row of each term; and what the sketch did (ranges, survivors).

    seen is SEEN, types about how many (lang, term) it has. The sketch has two
    counters a type in each of its rows, and max_counters at most, so that what
    is broadcast is 8 MB at most: with more types, ranges of their hashes take
    their turn, each with a sketch of its own over its own rows.
    """
    spark = seen.sparkSession
    size = WIDTH * depth
    most = max(1, max_counters // size)
    blocks = max(1, -(-types * 2 * depth // size))
    ranges = -(-blocks // most)
    marked = seen.where("term <> ''").withColumn("mark", F.xxhash64("lang", "term"))
    if ranges > 1:
        blocks, path = most, scratch(spark, "ranges")
        marked.withColumn("range", F.pmod(F.shiftright("mark", 32), F.lit(ranges)).cast("int")).write.partitionBy("range").parquet(path)
        marked = spark.read.parquet(path)
    out, survivors = None, 0
    for r in range(ranges):
        mine = marked.where(F.col("range") == r) if ranges > 1 else marked
        bits = written(sketch(mine.select("mark", "df"), blocks, depth, at_least), "sketch")
        # one exchange, by term; a source's counts, and one row's df, are summed where they are then
        dealt = possible(mine, bits, blocks, depth).select("lang", "term", "df", "sources").repartition("lang", "term")
        flat = dealt.select("lang", "term", F.posexplode("sources").alias("k", "s"), "df").select("lang", "term", "s.source", "s.n", F.when(F.col("k") == 0, F.col("df")).otherwise(0).alias("df"))
        exact = flat.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        w = Window.partitionBy("lang", "term")
        all_ = exact.select("lang", "source", "term", "n", F.sum("df").over(w).alias("_df"), F.sum("n").over(w).alias("whole"), (F.row_number().over(w.orderBy("source")) == 1).alias("first"))
        exact, told = counted(all_, "survivors")
        good = exact.where(F.col("_df") >= at_least).drop("_df")
        out = good if out is None else out.union(good)
        survivors += told["rows"]
    return out, {"ranges": ranges, "survivors": survivors}


def _share(count: Column, total: Column, types: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + types)), exact for any count."""
    wide = lambda c: c.cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", wide(count + 1) * F.lit(UNIT).cast("decimal(10,0)"), wide(total + types))).cast("long")


def _far(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def audit(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *, at_least: int = 3, top: int = 200, depth: int = 4, max_counters: int = 1 << 26,
) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language, part "pair"
    how far every other source of it (item) is, and part "term" its `top` most
    over-used terms against the language.

    Terms are runs of letters A-Z, taken as lower case, and of characters above
    ASCII. A language keeps the V terms that at_least of its rows use. With N
    occurrences of kept terms in a group, a term with `count` of them has the
    share p = 1 + floor(UNIT * (count + 1) / (N + V)); a divergence is the sum, or
    for a term the value, of floor((p - q)^2 / q). Ranks fall with the value, ties
    rise with the item as UTF-8.

    One pass over the texts leaves each task's counts. From these a count-min sketch
    of document frequencies is merged, and terms that it rules out go before
    anything is shuffled; the others are counted exactly. For pairs, terms that
    neither, or one alone, of two sources has need no join: their shares depend on
    the source and a count only, so a histogram of counts (a row for each source
    and count that occurs) stands for them. Terms that both have meet in a join of
    sources by term, of the rows that aren't zero. No vocabulary is collected.

    Null texts, languages and sources count as ''. A group without terms has its
    pairs, too (0 if V = 0); a source alone in its language has none. Repeated
    rows count each. Other columns aren't read. An empty table gives an empty table.
    """
    bounded_batches(df.sparkSession)
    seen, told = counted(term_counts(df, text_col, lang_col, source_col), "terms", None, F.approx_count_distinct(F.xxhash64("lang", "term")).alias("types"))
    kept, _ = kept_terms(seen, told["types"] or 0, at_least, depth=depth, max_counters=max_counters)
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    lang = kept.groupBy("lang").agg(F.sum("n").alias("all"), F.sum(F.col("first").cast("long")).alias("V"))
    # one row per source of a language, and its share of a term that it doesn't have
    there = seen.where("term = ''").select("lang", F.explode("sources.source").alias("source")).distinct()
    groups = there.join(sums, ["lang", "source"], "left").join(lang, "lang", "left").na.fill(0, ["total", "own", "all", "V"])
    p0 = F.when(F.col("V") > 0, _share(F.lit(0), F.col("total"), F.col("V")))
    groups = written(groups.withColumn("p0", p0), "sources")

    shares = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("V")).alias("p"), _share(F.col("whole"), F.col("all"), F.col("V")).alias("q"), "p0")
    shares = written(shares, "shares")
    over = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _far("p", "q").alias("value"))

    # what each source's own terms add where the other has none, and the other way round, by counts that occur
    a = groups.select("lang", "source", F.col("p0").alias("a0"), F.col("own").alias("na"), "V")
    b = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("b0"), F.col("own").alias("nb"))
    pairs = written(a.join(b, "lang").where("source <> item"), "pairs")
    counts = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    mine = counts.join(pairs.select("lang", "source", "item", "b0"), ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.col("k") * _far("p", "b0")).alias("v"))
    other = counts.withColumnRenamed("source", "item").join(pairs.select("lang", "source", "item", "a0"), ["lang", "item"]).groupBy("lang", "source", "item").agg(F.sum(F.col("k") * _far("a0", "p")).alias("v"))
    # terms of both: in place of the two sums above, each pair of sources once
    x = shares.select("lang", "term", F.col("source").alias("s"), F.col("p").alias("ps"), F.col("p0").alias("s0"))
    y = shares.select("lang", "term", F.col("source").alias("t"), F.col("p").alias("pt"), F.col("p0").alias("t0"))
    less = lambda p, q, p0, q0: _far(p, q) - _far(p, q0) - _far(p0, q)
    both = x.join(y, ["lang", "term"]).where("s < t").groupBy("lang", "s", "t").agg(
        F.sum(less("ps", "pt", "s0", "t0")).alias("st"), F.sum(less("pt", "ps", "t0", "s0")).alias("ts"), F.count("*").alias("k")
    )
    turned = F.explode(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item"), F.col("st").alias("v")), F.struct(F.col("t").alias("source"), F.col("s").alias("item"), F.col("ts").alias("v"))))
    met = both.select("lang", "k", turned.alias("e")).select("lang", "e.*", "k")
    zero = F.lit(0).cast("long")
    all_ = pairs.select("lang", "source", "item", ((F.col("V") - F.col("na") - F.col("nb")) * F.when(F.col("V") > 0, _far("a0", "b0")).otherwise(zero)).alias("v"), zero.alias("k"))
    all_ = all_.union(mine.select("lang", "source", "item", "v", zero)).union(other.select("lang", "source", "item", "v", zero)).union(met.select("lang", "source", "item", "v", "k"))
    f0 = pairs.select("lang", "source", "item", F.when(F.col("V") > 0, _far("a0", "b0")).otherwise(zero).alias("f0"))
    apart = all_.groupBy("lang", "source", "item").agg(F.sum("v").alias("v"), F.sum("k").alias("k")).join(f0, ["lang", "source", "item"])
    apart = apart.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("v") + F.col("k") * F.col("f0")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item")))
    return apart.withColumn("rank", rank).union(over.withColumn("rank", rank).where(F.col("rank") <= top))
