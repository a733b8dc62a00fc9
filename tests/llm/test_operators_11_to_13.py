"""Source divergence, whitening and token files, held against plain computations."""

import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from glintframe.llm import divergence, queries, token_files, whitening
from tests.llm import helpers

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


# --- source divergence ----------------------------------------------------------


def brute_audit(rows, at_least=3, top=200):
    """rows of (text, lang, source) -> {(lang, source, part, item): (value, rank)}."""
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        docs[lang].update(set(terms))
        count[lang, source].update(terms)
    out = {}
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= at_least]
        mine = sorted(s for g, s in groups if g == lang)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(count[lang, s]) for s in mine}
        q = shares(sum((count[lang, s] for s in mine), Counter()))
        for s in mine:
            pair = {o: sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept) for o in mine if o != s}
            term = {t: (p[s][t] - q[t]) ** 2 // q[t] for t in kept if count[lang, s][t] and p[s][t] > q[t]}
            for part, got, most in (("pair", pair, None), ("term", term, top)):
                for rank, (item, v) in enumerate(sorted(got.items(), key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out[lang, s, part, item] = (v, rank)
    return out


def told(df):
    return {(r.lang, r.source, r.part, r.item): (r.value, r.rank) for r in df.collect()}


def test_audit_of_odd_rows(spark):
    got = divergence.audit(helpers.docs(spark))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute_audit([(t, g, s) for _, t, g, s, *_ in helpers.rows()])
    assert told(got) == want and ("", "", "pair", "x") not in want and len(want) > 10
    assert divergence.audit(helpers.none(spark)).collect() == []


def test_audit_by_ranges_and_small_sketches(spark, monkeypatch):
    """A sketch too small to tell anything, and many ranges of hashes, change nothing."""
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "abcdéfgh漢" for b in "jklmnopqrs"]
    rows = [(i, " ".join(rng.choice(words, 12, p=np.arange(90, 0, -1) / 4095)).upper() + ("\x00Z9z" if i % 7 == 0 else ""), "xy"[i % 2], f"s{i % 5 % 3}" if i % 4 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = brute_audit([r[1:] for r in rows], top=20)
    monkeypatch.setattr(divergence, "WIDTH", 64)
    for args in ({}, {"max_counters": 256}, {"depth": 1, "max_counters": 64}, {"depth": 2}):
        assert told(divergence.audit(df.repartition(3), top=20, **args)) == want


def test_sketch_never_underestimates(spark):
    """Every term of three documents or more passes; with room, hardly any other does."""
    rows = [(f"t{k}", min(k % 5, 2) + (k % 11 == 0) * 4 or 1) for k in range(4000)]
    from pyspark.sql import functions as F

    marks = spark.createDataFrame(rows, "term string, df long").repartition(5).select("term", "df", F.xxhash64("term").alias("mark"))
    bits = divergence.sketch(marks, 2, 4, 3)
    passed = {r.term for r in divergence.possible(marks, bits, 2, 4).collect()}
    true = {t for t, n in rows if n >= 3}
    assert true <= passed and len(passed - true) < 0.15 * (len(rows) - len(true))
    seen = divergence.term_counts(spark.createDataFrame([(f"one{i}x common", "a", "b") for i in range(50)], "text string, lang string, source string"))
    kept, did = divergence.kept_terms(seen, 51)
    assert [(r.term, r.n) for r in kept.collect()] == [("common", 50), ("one", 50), ("x", 50)] or {r.term: r.n for r in kept.collect()} == {"common": 50, "one": 50, "x": 50}
    assert did == {"ranges": 1, "survivors": 3}


def test_counts_beyond_a_long(spark):
    """Shares are exact where a billion times a count doesn't fit a long."""
    row = spark.range(1).select(divergence._share(divergence.F.lit(10**12), divergence.F.lit(3 * 10**12 + 7), divergence.F.lit(11)).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**12 + 1) // (3 * 10**12 + 18)


def test_rare_terms_never_shuffle(spark):
    """Of the rows that a task tells, only those that the sketch lets through are exchanged by term."""
    rows = [(f"aa bb cc {''.join(chr(97 + int(d)) for d in str(i))}zz", "en", f"s{i % 3}") for i in range(2000)]
    seen = divergence.written(divergence.term_counts(spark.createDataFrame(rows, "text string, lang string, source string")), "seen")
    _, did = divergence.kept_terms(seen, 2003)
    assert did["survivors"] <= 9 + 0.1 * 2000


# --- whitening ------------------------------------------------------------------


def vectors(n=400, d=7, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 5).astype(np.float32)


def brute_whiten(x):
    """Exact sums in fractions; eigenvectors from them."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in row] for row in x]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    c = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in c), n**3)) for j in range(d)] for i in range(d)])
    values, e = np.linalg.eigh(v)
    return [sum(y * y for y in r) for r in c], np.array(c, dtype=float) / n, v, values[::-1], e.T[::-1]


def test_whitening(spark):
    x = vectors()
    rows = [(i, v.tolist(), 0, "extra") for i, v in enumerate(x)] + [
        (900, None, 0, ""), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0, 6.0], 0, ""), (902, [float("nan")] * 7, 0, ""), (903, [float("inf")] + [0.0] * 6, 0, ""), (904, [1.0], 0, ""), (905, [], 0, ""),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component int, n string").repartition(5)
    got = whitening.whiten(df, fan_in=2).collect()
    deviation, c, v, values, e = brute_whiten(x)
    assert Counter(r.vec_id for r in got) == {i: 7 for i in range(400)}
    white = np.zeros((400, 7))
    for r in got:
        k = r.component - 1
        white[r.vec_id, k] = r.whitened
        assert r.n == 400 and r.deviation == deviation[r.vec_id] and r.explained == pytest.approx(values[k] / v.trace(), rel=1e-9) and r.identity_error < 1e-9
    want = c @ e.T / np.sqrt(values)
    for k in range(7):
        assert np.allclose(white[:, k], want[:, k], atol=1e-8) or np.allclose(white[:, k], -want[:, k], atol=1e-8)
    assert np.abs(np.cov(white.T, bias=True) - np.eye(7)).max() < 1e-9
    assert {(r.vec_id, r.component): r.whitened for r in whitening.whiten(df, most=2).collect()} == pytest.approx({(r.vec_id, r.component): r.whitened for r in got if r.component <= 2}, abs=1e-9)


def test_whitening_of_few_and_equal_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)] + [(None, [9.0, 18.0])], schema)).collect()
    assert {r.component for r in line} == {1} and len(line) == 10 and line[0].explained == pytest.approx(1.0) and None in {r.vec_id for r in line}
    far = whitening.whiten(spark.createDataFrame([(i, [1e30 * (i % 2), 1.0 * i]) for i in range(5)], schema)).collect()
    assert {r.vec_id for r in far} == set(range(5)) and all(r.deviation is None or r.deviation >= 0 for r in far)


def test_covariance_is_compensated():
    """Sums that plain doubles lose: the double-double matrix is right to 100 bits or so."""
    rng = np.random.default_rng(1)
    c = rng.normal(size=(5000, 4)) * np.array([1e8, 1.0, 1e-6, 3e3])
    c[::2] *= -1
    want = [[sum((Fraction(float(a)) * Fraction(float(b)) for a, b in zip(c[:, i], c[:, j])), Fraction(0)) for j in range(4)] for i in range(4)]
    hi, lo = np.zeros((4, 4)), np.zeros((4, 4))
    for part in np.array_split(c, 7):
        hi, lo = whitening.outer_sums(part, hi, lo)
    size = np.sqrt(np.outer((c**2).sum(0), (c**2).sum(0)))
    off = max(abs(float((Fraction(float(hi[i, j])) + Fraction(float(lo[i, j])) - want[i][j]) / Fraction(float(size[i, j])))) for i in range(4) for j in range(4))
    plain = max(abs(float((Fraction(float((c.T @ c)[i, j])) - want[i][j]) / Fraction(float(size[i, j])))) for i in range(4) for j in range(4))
    assert off < 1e-19 < plain


def test_slices_add_up_and_two_sums_are_exact():
    c = np.random.default_rng(2).normal(size=(50, 3)) * [1, 1e200, 1e-200]
    parts = whitening.slices(c)
    assert np.array_equal(sum(parts[::-1]), c)
    s, e = whitening.two_sum(np.array([1e16, 1.0]), np.array([1.0, 1e-20]))
    assert [Fraction(a) + Fraction(b) for a, b in zip(s, e)] == [Fraction(10**16 + 1), Fraction(1) + Fraction(1e-20)]


# --- token files ----------------------------------------------------------------


@pytest.fixture(scope="module")
def plain_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer()[0])
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_token_files(spark, tmp_path, plain_ids):
    folder = f"file://{tmp_path}/t"
    files = token_files.write_tokens(helpers.docs(spark), folder, queries.tokenizer(), partitions=3, frame_ids=1000)
    got = token_files.read_tokens(files, folder, docs=4).collect()
    rows = helpers.rows()
    ids = lambda r: np.frombuffer(r.ids, dtype="<u4").tolist()
    assert Counter((r.doc_id, tuple(ids(r))) for r in got) == Counter((i, tuple(plain_ids(t))) for i, t, *_ in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(ids(r)) and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    some = token_files.read_tokens(files, folder, spark.createDataFrame([(2,), (7,), (2,), (999,), (None,)], "doc_id long")).collect()
    assert Counter(map(tuple, some)) == Counter(tuple(r) for r in got if r.doc_id in (2, 7))
    empty = token_files.write_tokens(helpers.none(spark), f"file://{tmp_path}/none", queries.tokenizer())
    assert empty.count() == 0 and token_files.read_tokens(empty, f"file://{tmp_path}/none").count() == 0


def one_file(path, docs, **args):
    with pa_file(path, "wb") as f:
        w, pack = token_files.Writer(f, args.get("width", 2)), token_files.Frames(**args)
        for i, ids in docs:
            w.add(i, len(ids), *pack(np.array(ids, dtype="<u4")))
        w.close()
    return path


def pa_file(path, mode):
    import pyarrow as pa

    return pa.OSFile(str(path), mode)


def test_only_requested_documents_are_unpacked(tmp_path):
    docs = [(i, list(range(i, i + 500 + i))) for i in range(100)]
    src = token_files.Reader(pa_file(one_file(tmp_path / "a", docs, frame_ids=256), "rb"))
    assert {k: x.tolist() for k, x in src.read([3, 4, 60])} == {k: docs[k][1] for k in (3, 4, 60)}
    assert src.unpacked == 2 * sum(len(docs[k][1]) for k in (3, 4, 60))
    assert src.before[60] == sum(len(x) for _, x in docs[:60]) and src.doc_id(60) == 60


def test_any_reader_of_the_format_reads_them(tmp_path):
    """A plain zstandard decoder skips the tables; the seek table is where the format has it."""
    import zstandard

    docs = [(5, [1, 2, 3]), (None, []), (9, list(range(60000)))]
    raw = one_file(tmp_path / "a", docs, width=4, frame_ids=7000).read_bytes()
    out, rest = b"", raw
    while rest:
        if struct.unpack("<I", rest[:4])[0] & 0xFFFFFFF0 == 0x184D2A50:
            rest = rest[8 + struct.unpack("<I", rest[4:8])[0] :]
            continue
        d = zstandard.ZstdDecompressor().decompressobj()
        out += d.decompress(rest)
        rest = d.unused_data
    assert np.frombuffer(out, dtype="<u4").tolist() == [1, 2, 3, *range(60000)]
    count, flags, magic = struct.unpack("<IBI", raw[-9:])
    assert (count, flags, magic) == (1 + 1 + 9, 0x80, 0x8F92EAB1)
    src = token_files.Reader(pa_file(tmp_path / "a", "rb"))
    assert [src.doc_id(k) for k in range(3)] == [5, None, 9] and [len(x) for _, x in src.read(range(3))] == [3, 0, 60000]


def test_damage_is_found(tmp_path):
    """A flipped bit anywhere, or a file cut short, raises; it never gives other ids."""
    docs = [(i, [(7 * i * k) % 50000 for k in range(40)]) for i in range(5)]
    raw = one_file(tmp_path / "a", docs).read_bytes()
    for at in range(len(raw)):
        bad = bytearray(raw)
        bad[at] ^= 4
        (tmp_path / "b").write_bytes(bad)
        try:
            got = [x.tolist() for _, x in token_files.Reader(pa_file(tmp_path / "b", "rb")).read(range(5))]
        except (ValueError, OverflowError):
            continue
        assert got == [d for _, d in docs]
    for n in (0, 5, 16, len(raw) // 2, len(raw) - 1):
        (tmp_path / "c").write_bytes(raw[:n])
        with pytest.raises(ValueError):
            token_files.Reader(pa_file(tmp_path / "c", "rb"))
