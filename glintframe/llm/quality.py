"""Quality rules: repetition and length, and divergence from language references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from glintframe.llm.common import SPACE, SPACE_CHARS, counted, written

#: Character classes, each counted in what the classes before it leave over; the
#: last class is what none of them matches.
CLASSES = (
    ("lower", "[a-z]+"), ("space", f"[{SPACE}]+"), ("upper", "[A-Z]+"), ("letter", r"[\p{L}\p{M}]+"), ("digit", r"\p{N}+"),
    ("stop", r"[.,;:!?'\"()\-]+"), ("other", None),
)
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Languages whose references, of some 300 bytes each, are sent to all tasks; more meet their texts by a join.
BROADCAST = 10_000


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being found once, and not copied into rows in between."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def class_counts(text: Column) -> Column:
    """How many of the text's characters are in each of CLASSES, as an array."""
    taken = F.array(*[F.lit(p) for _, p in CLASSES[:-1]])
    rests = F.aggregate(taken, F.array(text), lambda acc, p: F.concat(acc, F.array(F.regexp_replace(F.element_at(acc, -1), p, F.lit("")))))
    sizes = F.transform(rests, lambda r: F.length(r).cast("long"))
    return _let(sizes, lambda n: F.transform(n, lambda x, i: x - F.coalesce(F.get(n, i + 1), F.lit(0).cast("long"))))


def repeat_words(words: Column) -> Column:
    """Words in windows of 8 words that the text has twice or more, the first ones included.

    Windows' hashes come by doubling, four per word, where there are two windows or
    more; those of the last seven words, which begin no window, are like no others.
    Only where they aren't all different are they sorted with their places, to find
    which ones are repeated.
    """

    def doubled(h: Column, step: Column) -> Column:
        """Hash of each item and the one `step` after it (past the end: of itself alone)."""
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return F.aggregate(
            F.array_sort(F.transform(again, lambda x: x["i"])), F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")), lambda acc: acc["n"],
        )

    hashes = F.aggregate(F.array(*[F.lit(1 << k) for k in range(WINDOW.bit_length() - 1)]), F.transform(words, lambda w: F.xxhash64(w)), doubled)
    found = _let(hashes, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), _let(F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)).otherwise(0))
    return F.when(F.size(words) > WINDOW, found).otherwise(0).cast("long")


def base_counts(df: DataFrame, common: Column | None = None) -> DataFrame:
    """df(text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    base_failed, and, for further rules, chars (see class_counts) and hits, how
    often the text has each of the words in `common`; without text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    doubles = F.when(F.contains(text, F.lit("\n")), _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0)
    none = F.array().cast("array<string>")
    common = none if common is None else common
    words = _let(F.btrim(text, F.lit(SPACE_CHARS)), lambda t: F.when(t == "", none).otherwise(F.split(t, f"[{SPACE}]+")))
    of_words = _let(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("again"), F.transform(common, lambda c: (F.size(w) - F.size(F.array_remove(w, c))).cast("long")).alias("hits")),
    )
    out = df.select(
        *[c for c in df.columns if c != "text"], of_words.alias("_w"), class_counts(text).alias("chars"), doubles.cast("long").alias("n_dup_lines"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    space = [k for k, _ in CLASSES].index("space")
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda a, n: a + n)
    out = out.withColumns({
        "n_words": F.col("_w.n"), "n_repeat_words": F.col("_w.again"), "hits": F.col("_w.hits"), "word_chars": total - F.get("chars", F.lit(space)),
    }).drop("_w")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _key(lang_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(lang_col)), F.lit(""))


def _small(table: DataFrame, languages: int) -> DataFrame:
    """A table of a row for each language, to be sent to all tasks if it is small."""
    return F.broadcast(table) if languages <= BROADCAST else table


def references(df: DataFrame, text_col: str = "text", lang_col: str = "lang", *, top: int = 12, least_share: float = 0.005) -> tuple[DataFrame, int]:
    """What words texts of a language hold, a written row for each language, and their
    number: lang (coded), common (its common words), word_share (of each of them, then
    of all other words).

    Counts are over all words of all rows; a null lang is a language. Common words
    are the `top` most frequent ones that make up least_share of the words or more
    (ties by the word).
    """
    words = df.select(_key(lang_col).alias("lang"), F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), f"[{SPACE}]+")).alias("w")).where("w <> ''")
    sums, seen = counted(words.groupBy("lang", "w").agg(F.count("*").alias("n")), "words")
    sizes, told = counted(sums.groupBy("lang").agg(F.sum("n").alias("all_words")), "languages", seen["rows"])
    # at most 1 / least_share words are left of a language
    often = sums.join(_small(sizes, told["rows"]), "lang").where(F.col("n") >= least_share * F.col("all_words"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    kept = often.withColumn("r", rank).where(F.col("r") <= top)
    by = sizes.join(kept.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "w", "n"))).alias("c")), "lang", "left")
    c = F.coalesce("c", F.array().cast("array<struct<r:int,w:string,n:bigint>>"))
    rest = F.col("all_words") - F.aggregate(c["n"], F.lit(0).cast("long"), lambda x, n: x + n)
    shares = F.transform(F.concat(c["n"], F.array(rest)), lambda n: n / F.greatest("all_words", F.lit(1)))
    return written(by.select("lang", c["w"].alias("common"), shares.alias("word_share")), "references", rows=told["rows"]), told["rows"]


def class_references(scored: DataFrame) -> DataFrame:
    """(lang, class_share): shares of CLASSES in all texts of each language, from scored(key, chars)."""
    sums = [F.sum(F.get("chars", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    each = scored.groupBy(F.col("key").alias("lang")).agg(*sums)
    total = F.greatest(sum((F.col(f"c{i}") for i in range(len(CLASSES))), F.lit(0)), F.lit(1))
    return each.select("lang", F.array(*[F.col(f"c{i}") / total for i in range(len(CLASSES))]).alias("class_share"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, from 0 to 1) of two arrays of shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda x, t: x + t) / 2, F.lit(0.0)))


def judged(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
    min_words: int = 40, min_chars: int = 200, max_class_distance: float = 0.3, max_word_distance: float = 0.45, top: int = 12, least_share: float = 0.005,
) -> DataFrame:
    """For each row its id, as doc_id, the base counts, class_distance,
    word_distance and kept.

    A row is kept if it hasn't failed the base rules and its shares of character
    classes and of common words are near its language's (Jensen-Shannon
    distance). The first distance is judged from min_chars characters on, the
    second from min_words words on, since short texts are far from any reference
    by chance. Null and empty texts have no words and fail; a null lang is a
    language, of which there may be any number; repeated rows are judged alike;
    other columns aren't read. An empty table gives an empty table.
    """
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    refs, languages = references(df, top=top, least_share=least_share)
    met = lambda frame, table: frame.join(_small(table.withColumnRenamed("lang", "_lang"), languages), F.col("key") == F.col("_lang"), "left").drop("_lang")

    out = base_counts(met(df.withColumn("key", _key("lang")).drop("lang"), refs), F.coalesce("common", F.array().cast("array<string>")))
    rest = F.col("n_words") - F.aggregate("hits", F.lit(0).cast("long"), lambda a, n: a + n)
    share = lambda a, n: F.transform(a, lambda x: x / F.greatest(n, F.lit(1)))
    own = share(F.concat("hits", F.array(rest)), F.col("n_words"))
    out = out.withColumn("word_distance", F.when(F.col("n_words") >= min_words, js_distance(own, F.col("word_share"))))
    # the texts are done with: what follows is about a few numbers per row
    out = written(out.drop("hits", "common", "word_share"), "scored")
    out = met(out, class_references(out))
    length = F.aggregate("chars", F.lit(0).cast("long"), lambda a, n: a + n)
    out = out.withColumn("class_distance", F.when(length >= min_chars, js_distance(share(F.col("chars"), length), F.col("class_share"))))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= max_class_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance)
    return out.withColumn("kept", ~F.col("base_failed") & near).drop("class_share", "chars", "key")
