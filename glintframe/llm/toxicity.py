"""Toxicity scores of texts restored by a noisy-channel decoder."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.llm.common import bounded_batches, give_back, written

#: Letters that a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "¡": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
#: Letters of other scripts that pass for Latin ones, in tokens that have Latin ones too.
FOREIGN = str.maketrans("аеорсухіјѕԁһӏԛԝαοιρυνκτ", "aeopcyxijsdhlqwaoipuvkt")
#: Log probabilities of the channel: a letter written as a sign that looks like
#: it; such a sign put in for nothing at an edge of a word (the same, for a digit)
#: and inside it; a sign repeated; a vowel and another letter hidden by a star; a
#: star for nothing; a letter written twice that is meant twice, and once.
SWAPPED, EDGE, DIGIT_EDGE, INSIDE, AGAIN, STARRED, STARRED_OTHER, STAR, TWICE, ONCE = (math.log(p) for p in (0.3, 0.3, 0.02, 1e-5, 0.3, 0.1, 0.01, 0.3, 0.99, 0.01))
#: What a hidden letter may be.
HIDDEN = [(chr(c), STARRED if chr(c) in "aeiou" else STARRED_OTHER) for c in range(97, 123)]
#: A sign or gap between letters for nothing and for a word's edge; a gap wider than
#: others for these; a sign that looks like a letter for an edge; letters of a run
#: on both sides of an edge.
KEPT, SPLIT, WIDE_KEPT, WIDE_SPLIT, SIGN_SPLIT, RUN_SPLIT = (math.log(p) for p in (0.5, 0.5, 0.01, 0.99, 0.01, 0.1))
#: A number of digits as they are, and each of its digits, repeated or not.
NUMBER, DIGIT = math.log(0.05), math.log(0.1)
#: Readings of a token's beginning that are followed up, in tokens of over LONG signs.
BEAM, LONG = 64, 60
#: Classes of the character model: 0 is a word's edge, 27 any letter beyond a to z.
CLASSES = 28
#: Three or more characters that stand alone, one after the other.
SPACED = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")
#: Greek and Cyrillic letters; tokens that have such and Latin ones.
OTHER_SCRIPT = re.compile(r"[Ͱ-ԯ]")
MIXED = re.compile(r"(?=[^\sa-z]*[a-z])(?=[^\sͰ-ԯ]*[Ͱ-ԯ])\S+")
RUN = re.compile(r"([^\W\d_])\1{2,}")
DOUBLE = re.compile(r"([^\W\d_])\1")
PAIR = re.compile(r"(\w)\1")


def _class_of(category: str) -> str:
    """A regex class of all characters of a category, as ranges."""
    out, last = [], -2
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == category:
            if c != last + 1:
                out.append([c, c])
            out[-1][1] = last = c
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out) + "]"


#: Characters without a width or a look of their own.
UNSEEN = re.compile(_class_of("Cf"))
PARTS = re.compile(r"[0-9]+|[^\s0-9]+")
NEEDS = re.compile(r"[0-9@$!¡|+(<€£*]|([^\W\d_])\1\1|[^\W\d_](?:[.\-_~,'/\\:;\"&%#=^?)\[\]{}>’…–—·•]|\s)+[^\W\d_]")
_STRIP = ".,;:?\"'()[]{}%&#*~^=_-/\\><"


def _class_of_byte() -> np.ndarray:
    out = np.zeros(256, dtype=np.int32)
    out[ord("a") : ord("z") + 1] = out[ord("A") : ord("Z") + 1] = np.arange(1, 27)
    out[128:] = 27
    return out


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of each three successive character classes in the whole texts."""
    table, total = _class_of_byte(), np.zeros(CLASSES**3, dtype=np.int64)
    for b in batches:
        for text in b.column(0):
            if text.is_valid:
                raw = text.as_buffer() if hasattr(text, "as_buffer") else text.as_py().encode()
                c = np.concatenate(([0, 0], table[np.frombuffer(raw, dtype=np.uint8)], [0]))
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES**3)), pa.array(total)], names=["gram", "n"])


def character_model(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(third class | first two), interpolated with shorter contexts, from the
    whole texts of all rows. One table of fixed size per task is summed up."""
    rows = df.select(text_col).mapInArrow(give_back(_count_trigrams), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(CLASSES**3)
    for gram, k in rows:  # CLASSES ** 3 at most
        n[gram] = k
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    one = (n.sum((0, 1)) + 1) / (n.sum() + CLASSES)
    two = (n.sum(0) + 5 * one) / (n.sum((0, 2))[:, None] + 5)
    return np.log((n + 5 * two[None]) / (n.sum(2)[:, :, None] + 5))


def _class(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27


def lattice(token: str, edges: bool = True) -> list[list[tuple[str, float]]]:
    """For each sign of a lower-case token or run of lone characters, what it may be
    and at what log probability; "" is nothing, " " a word's edge (with edges only),
    a digit itself.
    Of a letter written twice, two or one are meant; three times or more, one or two,
    or words that meet in it. Each star has a place of its own."""
    out, i, n = [], 0, len(token)
    gaps = [len(g) for g in re.findall(r"\s+", token)]
    least = min(gaps, default=0)
    while i < n:
        ch, run, end = token[i], 1, i + 1
        while end < n:
            at = end
            while ch.isalpha() and at < n and token[at].isspace() and at - end < least:
                at += 1  # a narrow gap
            if at == n or token[at] != ch:
                break
            run, end = run + 1, at + 1
        if ch.isalpha():
            spaced = edges and end - i > run
            if run < 3 and spaced:
                out += [[(ch, 0.0)], [("", KEPT), (" ", SPLIT)], [(ch, 0.0)]]
            elif run == 2:
                out += [[(ch, 0.0)], [(ch, TWICE), ("", ONCE)]]
            elif run == 1:
                out.append([(ch, 0.0)])
            else:
                out += [[(ch, 0.0)], [(ch, -0.7), ("", -0.7)] + ([(f" {ch}", RUN_SPLIT), (f"{ch} {ch}", RUN_SPLIT)] if spaced else [])]
        elif ch.isspace():
            out.append(([("", KEPT), (" ", SPLIT)] if run == least else [("", WIDE_KEPT), (" ", WIDE_SPLIT)]) if edges else [("", 0.0)])
        else:
            edge = i == 0 or end == n
            split = [(" ", SIGN_SPLIT)] if edges and not edge and not ch.isdigit() else []
            if ch in LOOKALIKES:
                gone = EDGE if edge and not ch.isdigit() else DIGIT_EDGE if edge and end - i < n else INSIDE
                one = [(x, SWAPPED) for x in LOOKALIKES[ch]]
                if ch.isdigit():  # as it is, all of a run or none
                    again = AGAIN if run > 1 else 0.0
                    two = [(x + y, 2 * SWAPPED) for x, _ in one for y, _ in one] if run > 1 else []
                    out.append([(x, c + again) for x, c in one] + two + [(ch * run, DIGIT), ("", gone + AGAIN * (run - 1))])
                else:
                    out.append([*one, ("", gone), *split])
                    if run > 1:
                        out.append([*one, ("", AGAIN)])
            elif ch == "*" and not edge:
                out += [[*HIDDEN, ("", STAR), *split]] * run
            elif edges and not edge and not unicodedata.category(ch).startswith("M"):
                out.append([("", KEPT), (" ", SPLIT)])
        i = end
    return out


def decode(token: str, model: list, edges: bool = True) -> str:
    """The likeliest word or words behind a lower-case token or run of lone
    characters: Viterbi over its lattice, the states being the last two character
    classes and whether a number ends there. Numbers are weighed against words; of
    long tokens the BEAM best states go on."""
    states: dict = {(0, 0, False): (0.0, None)}
    beam = BEAM if len(token) > LONG else CLASSES**2 * 2
    for options in lattice(token, edges):
        new: dict = {}
        for (a, b, number), (score, word) in states.items():
            for text, cost in options:
                p, q, k, s, w = a, b, number, score + cost, word
                for ch in text:
                    if ch == " " and not q:  # an edge already
                        k = False
                        continue
                    if ch in LOOKALIKES:  # a digit as it is
                        s, w = s + (0.0 if k else NUMBER), (w, ch)
                        if q:
                            s, p, q = s + model[p][q][0], q, 0
                        k = True
                        continue
                    c = 0 if ch == " " else _class(ch)
                    s, p, q, k, w = s + model[p][q][c], q, c, False, (w, ch)
                if (p, q, k) not in new or new[p, q, k][0] < s:
                    new[p, q, k] = (s, w)
        states = new if len(new) <= beam else dict(heapq.nlargest(beam, new.items(), key=lambda x: x[1][0]))
    word = max(((s + (model[a][b][0] if b else 0.0), i, w) for i, ((a, b, _), (s, w)) in enumerate(states.items())), key=lambda x: x[:2], default=(0.0, 0, None))[2]
    out = []
    while word:
        word, ch = word
        out.append(ch)
    return "".join(reversed(out)).strip()


def meant_once(token: str, model: list) -> list[int]:
    """Where a letter is written twice that is likelier meant once, by its neighbours (all
    that the character model asks of it, as far as these aren't in doubt themselves)."""
    out = []
    for m in DOUBLE.finditer(token):
        i, c = m.start(), _class(m.group(1))
        b, d = (_class(token[i - 1]) if i else 0), (_class(token[i + 2]) if i + 2 < len(token) else 0)
        if model[b][c][d] + ONCE > model[b][c][c] + model[c][c][d] + TWICE:
            out.append(i)
    return out


def restore(token: str, model: list, edges: bool = True) -> str:
    """A lower-case token, or run of lone characters, as the word or words it stands
    for: signs around it gone, and decoded, whatever its length, where it holds more
    than letters."""
    core = token if token.isalpha() else token.strip(_STRIP)
    if not PAIR.search(core):
        return core if core.isalpha() or not NEEDS.search(core) else decode(core, model, edges)
    if not RUN.search(core) and (core.isalpha() or not NEEDS.search(core)):
        once = meant_once(core, model)
        if any(b - a < 4 for a, b in zip(once, once[1:])):
            return decode(core, model, edges)
        for i in reversed(once):
            core = core[:i] + core[i + 1 :]
        return core
    return decode(core, model, edges) if NEEDS.search(core) else core


def readings(token: str, model: list) -> list[str]:
    """The distinct words that a token or run stands for, and, if these are several,
    all of it as one."""
    words = PARTS.findall(restore(token, model))
    return words if len(words) < 2 else list({*words, "".join(restore(token, model, False).split())})


def plain(text: str | None) -> str:
    """The text in lower case, compatibility forms (full width and the like) made plain,
    characters without a look of their own gone, and look-alikes of other scripts
    made Latin in tokens that are Latin beside."""
    if not text or text.isascii():
        return (text or "").lower()
    low = UNSEEN.sub("", unicodedata.normalize("NFKC", text)).lower()
    return MIXED.sub(lambda m: m.group().translate(FOREIGN), low) if OTHER_SCRIPT.search(low) else low


def words_of(text: str | None) -> tuple[list[str], list[str]]:
    """A text's distinct lower-case tokens, and its runs of lone characters."""
    low = plain(text)
    return list(set(low.split())), [m.group() for m in SPACED.finditer(low)]


def restored_text(text: str | None, model: np.ndarray) -> str:
    """The whole text in lower case, each token and each run of lone characters restored."""
    rows = model.tolist()
    return re.sub(rf"{SPACED.pattern}|\S+", lambda m: restore(m.group(), rows), plain(text))


def features(word: str) -> list[str]:
    """A word, and the beginnings that it may share with its inflections."""
    return [f"={word}"] * (len(word) >= 2) + [word[:n] for n in (4, 5, 6) if len(word) >= n]


@dataclass
class Model:
    """characters: see character_model. weights: log odds of features. scale: of the logistic."""

    characters: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    scale: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0)


def _evidence(weights: dict[str, float], words) -> tuple[float, float]:
    total = most = 0.0
    for w in words:
        best = max((weights.get(f, 0.0) for f in features(w)), default=0.0)
        total, most = total + best, max(most, best)
    return total, most


def _design(total: float, most: float, n: int) -> tuple[float, ...]:
    return 1.0, most, math.log1p(total), math.log1p(n) / 10


def _train_rows(characters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = characters.value.tolist()
        for b in batches:
            label, words, sig = [], [], []
            for text, y in zip(b.column("text"), b.column("toxic").to_pylist()):
                tokens, runs = words_of(text.as_py())
                found = sorted({w for t in tokens + runs for w in readings(t, model)})
                label.append(y)
                words.append(found)
                sig.append(hashlib.sha256(" ".join(found).encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(words, pa.list_(pa.string())), pa.array(sig, pa.string())], names=["toxic", "words", "sig"])

    return run


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *,
    sample: int = 20_000, min_g2: float = 27.0, min_odds: float = math.log(4), max_features: int = 20_000,
) -> Model:
    """A model from labels(id, label) of df's rows; labels that aren't 0 or 1 are
    left out, and an id labelled twice counts as toxic if it is once.

    The character model is from all rows. The classifier is fitted on at most
    `sample` labelled rows, those with the smallest id hashes; of rows with one
    label and the same set of words (copies), one counts.
    Features are words and beginnings of words, each with its log odds of being in
    a toxic text, as far as its log-likelihood ratio is min_g2 or more. Without
    labels of both kinds every score is low.
    """
    spark = df.sparkSession
    bounded_batches(df.sparkSession)
    model = Model(character_model(df, text_col))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    few = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # `sample` rows of 12 bytes at most
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(few), "_id").select("text", "toxic")
    shared = spark.sparkContext.broadcast(model.characters)
    seen = rows.mapInArrow(give_back(_train_rows(shared)), "toxic int, words array<string>, sig string")
    once = written(seen.groupBy("sig", "toxic").agg(F.first("words").alias("words")), "train")
    size = dict(once.groupBy("toxic").count().collect())
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        return model
    each = once.select("toxic", F.explode(F.array_distinct(F.flatten(F.transform("words", lambda x: _features(x))))).alias("f"))
    found = each.groupBy("f").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b")).where(F.col("a") >= 4)
    odds = F.log(((F.col("a") + 0.5) / (n1 + 1)) / ((F.col("b") + 0.5) / (n0 + 1)))
    expect = (F.col("a") + F.col("b")) / (n0 + n1)
    term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    g2 = 2 * (term(F.col("a"), expect * n1) + term(F.col("b"), expect * n0) + term(n1 - F.col("a"), (1 - expect) * n1) + term(n0 - F.col("b"), (1 - expect) * n0))
    best = found.select("f", odds.alias("odds"), g2.alias("g2")).where((F.col("odds") >= min_odds) & (F.col("g2") >= min_g2)).orderBy(F.desc("g2"), "f").limit(max_features)
    model.weights = {r.f: r.odds for r in best.collect()}
    weights = spark.sparkContext.broadcast(model.weights)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*_evidence(weights.value, ws), len(ws)) for ws in b.column("words").to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64())], names=["toxic", "total", "most", "n"])

    train = once.mapInArrow(evidence, "toxic int, total double, most double, n long").collect()  # `sample` rows at most
    x = np.array([_design(r.total, r.most, r.n) for r in train])
    y = np.array([r.toxic for r in train], dtype=float)
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-3, 0.05, 0.05, 0.05])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    model.scale = tuple(beta.tolist())
    return model


def _features(w):
    none = F.array().cast("array<string>")
    whole = F.when(F.length(w) >= 2, F.array(F.concat(F.lit("="), w))).otherwise(none)
    return F.concat(whole, *[F.when(F.length(w) >= n, F.array(F.substring(w, 1, n))).otherwise(none) for n in (4, 5, 6)])


def _scorer(shared, cache_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        chars, weights, scale = model.characters.tolist(), model.weights, model.scale
        known: dict[str, tuple[float, float] | None] = {}  # a token's evidence, if any, forgotten from time to time
        get = known.get

        def weigh(token: str) -> tuple[float, float] | None:
            found = _evidence(weights, readings(token, chars))
            return found if found[0] else None

        for b in batches:
            out = []
            for text in b.column("text"):
                tokens, runs = words_of(text.as_py())
                if len(known) > cache_size:
                    known.clear()
                total = most = 0.0
                for t in tokens:
                    v = get(t, 0)
                    if v == 0:
                        v = known[t] = weigh(t)
                    if v:
                        total, most = total + v[0], max(most, v[1])
                for t in runs:
                    v = weigh(t)
                    if v:
                        total, most = total + v[0], max(most, v[1])
                z = sum(a * x for a, x in zip(scale, _design(total, most, len(tokens))))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(b.columns, b.schema.names) if n != "text"), pa.array(out, pa.float64())], names=[*(n for n in b.schema.names if n != "text"), "score"])

    return run


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cache_size: int = 100_000) -> DataFrame:
    """(id, score) for each row: how likely its restored text is toxic. Null and
    empty texts have the score of a text without evidence; repeated rows and null
    ids are scored like others. Nothing shuffles; what a task remembers is bounded."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(give_back(_scorer(shared, cache_size)), f"id {kind}, score double")


def clean_rows(df: DataFrame, model: Model, text_col: str = "text", limit: float = 0.7, cache_size: int = 100_000) -> DataFrame:
    """df's rows with a score under limit, all columns as they are, in one pass."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns
    coded = [f"c{i}" for i in range(len(names))]
    flat = df.toDF(*coded)
    score = _scorer(shared, cache_size)
    spot = coded[names.index(text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept() -> Iterator[pa.RecordBatch]:
            for b in batches:
                held.append(b)
                yield pa.RecordBatch.from_arrays([b.column(spot)], names=["text"])

        held: list[pa.RecordBatch] = []
        for s in score(kept()):
            b = held.pop(0)
            yield b.filter(pa.array(s.column("score").to_numpy() < limit))

    return flat.mapInArrow(give_back(run), flat.schema).toDF(*names)
