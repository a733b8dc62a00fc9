"""Each operator on a small table of odd rows, held against a plain computation."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from glintframe.llm import chat, common, dedup, html_extract, mixing, ngram_join, packing, quality, queries, sharding, toxicity, warc
from tests.llm import helpers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_connected(spark):
    pairs = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 6), (6, 3), (None, 1)]
    got = {r.id: r.component for r in common.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 1, 7: 1, 4: 4, 5: 4}
    chain = [(i, i + 1) for i in range(40)]
    assert {r.component for r in common.connected(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}
    assert common.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(spark):
    got = dedup.exact_groups(helpers.docs(spark)).collect()
    by = defaultdict(list)
    for r in helpers.rows():
        by[r[1] or ""].append(r[0])
    assert len(got) == len(helpers.rows())
    for text, ids in by.items():
        mine = [r for r in got if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        assert Counter(r.doc_id for r in mine) == Counter(ids)
        assert {(r.keep_id, r.group_size) for r in mine} == {(max((i for i in ids if i is not None), default=None), len(ids))}
        assert sum(r.kept for r in mine) == 1
    kept = dedup.exact_dedup(helpers.docs(spark))
    assert kept.columns == helpers.docs(spark).columns
    assert Counter(r.text or "" for r in kept.collect()) == Counter(by.keys())
    assert dedup.exact_groups(helpers.none(spark)).count() == 0 and dedup.exact_dedup(helpers.none(spark)).count() == 0


def test_exact_dedup_with_a_full_filter(spark):
    """Where the filter can tell nothing, the result is the same."""
    a = dedup.exact_groups(helpers.docs(spark), max_bits=1).collect()
    b = dedup.exact_groups(helpers.docs(spark)).collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))


def test_byte_shards(spark):
    got = sharding.byte_shards(helpers.docs(spark), 5).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in helpers.rows())
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)
    total, at, slots = sum(r.size for r in got), 0, Counter()
    for r in order:
        assert r.shard == sum(at * 5 >= total * k for k in range(1, 5)) and r.slot == slots[r.shard]
        slots[r.shard] += 1
        at += r.size
    assert sharding.byte_shards(helpers.none(spark), 5).count() == 0


def test_write_shards(spark, tmp_path):
    """Null and repeated ids, repeated rows and clashing columns: what is written is what was there, in order."""
    docs = helpers.docs(spark)
    where = sharding.write_shards(docs, str(tmp_path / "out"), 3, partitions=4).collect()
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == set(docs.columns) | {"slot"}
    rows = back.collect()
    assert Counter((r.doc_id, r.text, r.lang, r.source, r.maybe) for r in rows) == Counter((r.doc_id, r.text, r.lang, r.source, r.maybe) for r in docs.collect())
    assert Counter((r.doc_id, r.shard, r.slot, zlib.crc32((r.text or "").encode())) for r in rows) == Counter((r.doc_id, r.shard, r.slot, r.text_crc32) for r in where)
    assert {(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in where} == {tuple(r) for r in sharding.byte_shards(docs, 3).collect()}
    for k in range(3):
        slots = [r.slot for r in spark.read.parquet(str(tmp_path / "out" / f"shard={k}")).collect()]
        assert sorted(slots) == list(range(len(slots)))
    assert sharding.write_shards(helpers.none(spark), str(tmp_path / "none"), 3).count() == 0


def test_targets():
    assert mixing.targets({"b": 100, "a": 100, None: 100}) == pytest.approx({"a": 187.5, "b": 75, None: 37.5})
    capped = mixing.targets({"a": 10, "b": 100, "c": 100})
    assert capped["a"] == 30 and sum(capped.values()) == pytest.approx(210) and capped["b"] == pytest.approx(120)
    assert mixing.targets({"a": 0}) == {"a": 0} and mixing.targets({}) == {}


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 90 + 1)), f"s{min(i % 7, 4)}" if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, bucket_rows=50, fan_in=4).collect()
    again = mixing.mix(df.repartition(7), bucket_rows=50, fan_in=4).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again} and len(got) == 3000
    taken = Counter()
    for r in got:
        assert r.taken == r.copies * r.size and r.copies <= 3
        rate = r.target / r.source_size
        assert r.copies in (int(rate), int(rate) + 1)
        taken[r.source] += r.taken
    for r in got:
        assert abs(taken[r.source] - r.target) <= 90
    flat = mixing.mix_rows(df, bucket_rows=50, fan_in=4)
    assert Counter(r.doc_id for r in flat.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mix_of_small_sources(spark):
    """A source of a few rows comes near its target too, though one of them is large."""
    rows = [(100 * s + i, " ".join(["w"] * (900 if i == 0 else 10 + i)), f"s{s}") for s in range(9) for i in range(25)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.02 * mine[0].target


def test_each_row_is_taken_as_often_as_it_should():
    """Over seeds, rows of any size are taken at their fraction, though a source's words stay near the target."""
    rng = np.random.default_rng(4)
    sizes = [*rng.integers(5, 60, 60).tolist(), *[300] * 6, 480]
    for fraction in (0.3, 0.55, 0.8):
        todo = [(i, i * 7919 + 3, n, fraction) for i, n in enumerate(sizes)]
        goal, hits, runs = sum(n * p for _, _, n, p in todo), Counter(), 1500
        for seed in range(runs):
            got, forced = mixing._settled(todo, seed)
            assert not forced and set(got.values()) <= {0.0, 1.0} and len(got) == len(todo)
            assert abs(sum(sizes[u] * p for u, p in got.items()) - goal) <= 60
            hits.update(u for u, p in got.items() if p)
        off = 4.5 * (fraction * (1 - fraction) / runs) ** 0.5
        assert all(abs(hits[u] / runs - fraction) < off for u in range(len(sizes)))


def test_a_row_beyond_the_rest_is_forced():
    """One row of 900 words beside 24 small ones: no fair coin ends near 40 % of all; told, and as near as can be."""
    sizes = [900, *[20] * 24]
    for seed in range(20):
        got, forced = mixing._settled([(i, i, n, 0.4) for i, n in enumerate(sizes)], seed)
        assert forced == {0} and sum(sizes[u] * p for u, p in got.items()) == 480
    assert mixing._settled([], 1) == ({}, set()) and mixing._settled([(1, 1, 50, 0.0)], 1)[0] == {1: 0.0}
    alone = Counter(mixing._settled([(1, 1, 50, 0.4)], s)[0][1] for s in range(9))
    assert set(alone) == {0.0}


def test_mix_of_a_hot_row(spark):
    """100,000 rows that repeat id, text and source are one unit, whose copies they share out."""
    from pyspark.sql import functions as F

    df = spark.range(100_000, numPartitions=4).select(F.lit(5).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    rest = spark.createDataFrame([(i, "w " * 30, "t") for i in range(50)], "doc_id long, text string, source string")
    got = mixing.mix(df.union(rest))
    hot = got.where("source = 's'").agg(F.sum("taken"), F.max("copies") - F.min("copies"), F.first("target"), F.count("*")).first()
    assert hot[3] == 100_000 and abs(hot[0] - hot[2]) <= 3 and hot[1] <= 1
    assert mixing.mix_rows(df.union(rest)).where("source = 's'").count() * 3 == hot[0]


def test_mix_odd_rows(spark):
    got = mixing.mix(helpers.docs(spark)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t, *_ in helpers.rows())
    out = mixing.mix_rows(helpers.docs(spark))
    assert out.columns == helpers.docs(spark).columns and out.count() == sum(r.copies for r in got)
    assert mixing.mix(helpers.none(spark)).count() == 0 and mixing.mix_rows(helpers.none(spark)).count() == 0


def check_packing(rows, got, size=2048):
    slow = packing.Ids(queries.tokenizer()[0])
    want = Counter()
    for i, t in rows:
        ids = np.append(slow(t or ""), np.uint32(0))
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids), size)]
        for k, start in enumerate(cuts):
            part = ids[start : start + (first if k == 0 else size)]
            want[i, k, start, len(part), zlib.crc32(part.astype("<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
    return len(seqs), -(-sum(r.length for r in got) // size)


def test_pack(spark):
    docs = helpers.docs(spark)
    check_packing([r[:2] for r in helpers.rows()], packing.pack(docs, queries.tokenizer()).collect())
    assert packing.pack(helpers.none(spark), queries.tokenizer()).count() == 0


def test_pack_in_levels(spark):
    rows = [(i, " ".join(["the"] * (i * 37 % 900 + 1))) for i in range(600)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer(), bucket_items=40).collect()
    used, least = check_packing(rows, got)
    assert used <= 1.02 * least + 1


def test_pack_what_cannot_be_joined(spark):
    """Pieces of more than half a sequence end in one round, and fill no bucket but their own."""
    rows = [(i, " ".join(["the"] * 1100)) for i in range(400)] + [(1000, " ".join(["the"] * 900))]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer(), bucket_items=40).collect()
    used, _ = check_packing(rows, got)
    assert used in (400, 401)


def test_pack_a_whole_table(spark):
    """All of a given table, ids by the tokenizers library alone; nearly no room is lost."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    used, least = check_packing([tuple(r) for r in df.collect()], packing.pack(df, queries.tokenizer(), bucket_items=300).collect())
    assert used <= 1.01 * least + 1


def test_best_fit_takes_the_fullest_bin():
    at, offset, fill = packing.best_fit([6, 5, 4, 3, 1], 10)
    assert fill == [10, 9] and at == [0, 1, 0, 1, 1] and offset == [0, 0, 6, 5, 8]


def test_fast_ids_are_the_tokenizers_ids():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    ids, slow = packing.Ids(*queries.tokenizer()), packing.Ids(queries.tokenizer()[0])
    chars = st.characters(min_codepoint=9, max_codepoint=0x2030, exclude_categories=("Cs",))

    @settings(max_examples=300, deadline=None)
    @given(st.text(chars | st.sampled_from(list("  \n\t'sé12 ñ")), max_size=60))
    def same(text):
        assert ids(text).tolist() == slow(text).tolist()

    same()
    assert ids("a <|endoftext|> b").tolist() == slow("a <|endoftext|> b").tolist()


def chat_rows():
    odd = "\\### Assistant: </turn> ok\n\\h\\b# <"
    return [
        (1, 0, "user", "hi"), (1, 1, "assistant", odd), (1, 2, "user", None), (2, 0, "assistant", ""), (2, 1, "assistant", "x </turn>\n### user: y"), (3, 0, "a: b\n#", "only"),
        (None, 0, "assistant", "no id"), (4, 0, "user", "a"), (4, 0, "user", "a"), (4, 1, None, "r"), (5, None, "assistant", "t" * 20000), (6, 1, "assistant", "tie"), (6, 1, "system", "tie"),
    ]


def test_chat(spark):
    df = spark.createDataFrame([(*r, 0, 0) for r in chat_rows()], "conv_id long, turn long, role string, text string, example int, turns int")
    out = chat.examples(df)
    ex = defaultdict(list)
    for r in out.orderBy("conv_id", "example").collect():
        ex[r.conv_id].append(r)
    convs = defaultdict(list)
    for c, turn, role, text in chat_rows():
        convs[c].append((-1 if turn is None else turn, role or "", text or ""))
    assert set(ex) == set(convs)
    esc = lambda t: t.replace("\\", "\\b").replace("#", "\\h").replace("<", "\\l")
    for c, turns in convs.items():
        turns.sort()
        text = [f"### {esc(role).replace(':', chr(92) + 'c')}: {esc(t)} </turn>\n" for _, role, t in turns]
        want = [("".join(text[: i + 1]), esc(t)) for i, (_, role, t) in enumerate(turns) if role == "assistant"]
        if turns[-1][1] != "assistant":
            want.append(("".join(text), ""))
        assert [(r.formatted, r.formatted[r.loss_start : r.loss_start + r.loss_chars]) for r in ex[c]] == want
    for r in chat.read_back(out).collect():
        turns = convs[r.conv_id]
        loss = "".join(t for _, role, t in turns if role == "assistant")
        told = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.examples(df.limit(0)).count() == 0


def test_warc(spark):
    same = "<p>" + "same " * 40
    pages = [(5, "http://a/é b\r\nX: y", same), (3, None, same), (9, "http://c", same), (1, "", "short"), (2, "u%20%", "short"), (4, "u", None), (6, "u", ""), (None, "n", same), (7, "big", "é" * 3_000_000), (3, "again", same)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, file string, offset int").repartition(3)
    folder = warc.archive_folder(spark)
    index = warc.write_archives(df, folder)
    got = warc.read_records(index, folder).collect()
    want = Counter()
    for p, _, h in pages:
        raw = (h or "").encode()
        again = len(raw) >= 100 and p is not None and h == same and p > 3
        want[p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 3 if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got)
    assert Counter((r.page_id, r.url) for r in got) == Counter((p, u) for p, u, _ in pages)
    one = warc.read_records(index.where("page_id = 7"), folder).collect()
    assert len(one) == 1 and len(one[0].payload) == 6_000_000
    spans = index.orderBy("file", "offset").collect()
    for a, b in zip(spans, spans[1:]):
        assert a.file != b.file or a.offset + a.length == b.offset
    empty = warc.archive_folder(spark)
    assert warc.read_records(warc.write_archives(df.limit(0), empty), empty).count() == 0


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    spans = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(spans)
    hit = {i + k for i, s in enumerate(spans) if n[s] > 1 for k in range(8)}
    base = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), base


def test_quality(spark):
    more = [
        (100, "a b c d e f g h i " * 3), (101, " ".join(f"w{i}" for i in range(50)) + " " + " ".join(f"w{i}" for i in range(9))), (102, "x " * 25), (103, "# * $ | <p> % & " * 9), (104, "w " * 7),
    ]
    df = spark.createDataFrame([*helpers.rows(), *[(i, t, "en", "a", *helpers.rows()[0][4:]) for i, t in more]], helpers.DOCS)
    got = quality.judged(df).collect()
    want = Counter((i, *brute_quality(t)) for i, t in [r[:2] for r in helpers.rows()] + more)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.judged(helpers.none(spark)).count() == 0


def test_quality_divergence(spark):
    good = [(i, " ".join(["the", "of", f"word{'abcdefgh'[i % 8]}", "and", f"more{'abcdefgh'[i % 7]}"][(i + k) % 5] + "xyzuvw"[k % 6] * (k % 3 == 0) for k in range(150)), "en") for i in range(60)]
    bad = [(900, " ".join(f"%%{k}$$" for k in range(150)), "en"), (901, " ".join("q" * (k % 5 + 1) + str(k) for k in range(150)), "en")]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(good + bad, "doc_id long, text string, lang string"), max_class_distance=0.4).collect()}
    assert not got[900] and not got[901] and sum(got[i] or brute_quality(t)[5] for i, t, _ in good) == len(good)


@pytest.mark.parametrize("broadcast", [10_000, 5])
def test_quality_of_many_languages(spark, tmp_path, monkeypatch, broadcast):
    """70 languages, against the query's SQL, references sent to all tasks or joined."""
    import random

    import duckdb

    monkeypatch.setattr(quality, "BROADCAST", broadcast)
    rng = random.Random(2)
    rows = []
    for lang in range(70):
        common = [f"{rng.choice('abcdefghij')}{'verylongword' * (k % 2)}{lang}" for k in range(8)]
        for i in range(6):
            text = [rng.choice(common) if rng.random() < 0.5 else f"{rng.randrange(9999)}" * (i != 5) + "x" for _ in range(rng.randrange(30, 90))]
            rows.append((lang * 10 + i, " ".join(text), f"l{lang}" if lang else None))
    rows += [(9000, "%$ " * 100, "l3"), (9001, "other words altogether in this text " * 9, "l4")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = con.execute(queries.SQL["op6_divergence_rules"]).fetchall()
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    got = [tuple(r[c] for c in names) for r in quality.judged(df).collect()]
    assert Counter(got) == Counter(want) and len({g[-1] for g in got}) == 2


def brute_components(rows, width, num, den):
    sets = []
    for _, text in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text or "")]
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * (len(a) + len(sets[j]) - both):
                group[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)].append(doc)
    return Counter((doc, len(s), min(least[find(i)], default=None) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_ngram_join(spark, width, num):
    import random

    rng = random.Random(5)
    words = [f"v{i}" for i in range(400)]
    rows = [r[:2] for r in helpers.rows()]
    for base in range(6):
        text = [rng.choice(words) for _ in range(rng.choice([8, 30, 120]))]
        for k in range(25):
            t = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((1000 * base + 20 + k, (" \n" if k % 2 else "\t").join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.components(df, width=width, num=num).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, width, num, 100)


def near_rows(rng, bases=6, variants=25, words=400, sizes=(8, 30, 120)):
    """Groups of texts with a few words changed."""
    known = [f"v{i}" for i in range(words)]
    rows = []
    for base in range(bases):
        text = [rng.choice(known) for _ in range(rng.choice(sizes))]
        for k in range(variants):
            t = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(known)
            rows.append((1000 * base + 20 + k, " ".join(t)))
    return rows


def test_ngram_join_of_crowded_grams(spark):
    """Groups of over `crowd` different near copies, and boilerplate that many texts share."""
    import random

    rng = random.Random(8)
    rows = near_rows(rng, bases=3, variants=70, sizes=(60, 90))
    common = " ".join(f"c{i}" for i in range(60))
    rows += [(9000 + i, f"{common} {' '.join(rng.choice('abcdefgh') for _ in range(rng.randrange(1, 7)))}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for crowd in (2, 32):
        got = ngram_join.components(df, width=3, num=90, crowd=crowd).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 3, 90, 100)


def test_ngram_join_over_null_ids(spark):
    """A row with a null id links two others that aren't near each other."""
    words = [f"w{i}" for i in range(200)]
    a, b, c = (" ".join(words[k : k + 180]) for k in (0, 9, 18))
    rows = [(1, a), (None, b), (2, c), (None, "one more text without partner in this table"), (None, "another one of these texts here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.components(df, width=3, num=90).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 3, 90, 100)
    assert sorted(r.component_id or 0 for r in got) == [0, 0, 1, 1, 1]
    kept = ngram_join.one_of_each(df, width=3, num=90).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([rows[0], *rows[3:]])


def test_ngram_join_finds_all_of_a_table(spark):
    """All rows of a given table, against sets held in memory."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for width, num in ((3, 90), (5, 80)):
        got = ngram_join.components(df, width=width, num=num).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components([tuple(r) for r in df.collect()], width, num, 100)


def test_one_of_each(spark):
    out = ngram_join.one_of_each(helpers.docs(spark), width=3, num=90)
    assert out.columns == helpers.docs(spark).columns
    assert Counter(r.doc_id for r in out.collect()) == Counter([1, 3, 4, 5, 6, None, None, 8, 9, 10, 11, 12])
    assert ngram_join.one_of_each(helpers.none(spark)).count() == 0 and ngram_join.components(helpers.none(spark)).count() == 0


@pytest.mark.parametrize("again", [None, 5])
def test_one_of_each_tells_texts_of_one_id_apart(spark, again):
    """An id, or null, that stands for an unrelated text as well loses that by no means."""
    a, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"x{i}" for i in range(60))
    rows = [(1, a), (again, a), (again, a + " end"), (again, other), (7, other), (7, other), (8, "a b"), (8, "b a")]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(1, a), (7 if again is None else 5, other), (8, "a b"), (8, "b a")]
    assert Counter((r.doc_id, r.text) for r in got) == Counter(want)


def test_word_hashes_over_chunks():
    import pyarrow as pa

    texts = pa.array(["aa bb cc dd", "", "bb cc dd", "x" * 3000 + " y z", " lead", "AA BB CC DD"])
    whole = [(s.tolist(), v.tolist()) for _, _, s, v in ngram_join.gram_sets(texts, 3)]
    cut = [(s.tolist(), v.tolist()) for _, _, s, v in ngram_join.gram_sets(texts, 3, chunk=5)]
    assert sum((s for s, _ in whole), []) == sum((s for s, _ in cut), []) == [2, 0, 1, 1, 1, 2]
    assert sum((v for _, v in whole), []) == sum((v for _, v in cut), [])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy this now</div>
%s<aside>More to read</aside><div id="cookie-notice">We use cookies</div><form>Name <input></form>
<section class="comments"><article><p>A reader's long comment about this and that, and so on, and so on.</p></article></section><footer>(c) 2024</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE % "<article><h1>Head&amp;line</h1><p>One  <b>two</b>\n three.<p>Four &lt;five&gt;<br>six</article>", "Head&line\nOne two three.\nFour <five> six"),
        (PAGE % "<div id=main><p>One two three four five six seven.</p><p>Eight nine ten, eleven and twelve.</p><p>x</p></div>", "One two three four five six seven.\nEight nine ten, eleven and twelve.\nx"),
        (PAGE % "<main><section><p>a b</p></section><section><p>c d e f g h</p></section></main>", "a b\nc d e f g h"),
        (PAGE % "<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><p hidden>no</p><!-- c --></article>", "x\ny\n1\n2"),
        ("just text &eacute;", "just text é"), ("<p>a<p>b", "a\nb"), ("", ""), (None, ""), ("<div", ""), ("<!-- only", ""), ("<nav>menu</nav>", ""), ("a < b", "a < b"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


LINKS = "<ul>" + "".join(f'<li><a href="/{i}">Some other story {i}</a>' for i in range(6)) + "</ul>"
STORY = "".join(f"<p>Paragraph {i} of a story that goes on for quite a while, with commas, and without any links in it.</p>" for i in range(4))


@pytest.mark.parametrize(
    ("body", "there", "lost"),
    [
        (f"<article><h1>Title</h1>{STORY}<div>{LINKS}</div><p>End.</p></article>", ["Title", "Paragraph 3", "End."], ["other story"]),
        (f"<main><h1>Title</h1><div>{STORY}</div><section>{LINKS}</section></main>", ["Title", "Paragraph 0"], ["other story"]),
        (f"<article><p>Short.</p></article><div>{STORY}</div>", ["Paragraph 0", "Paragraph 3"], ["Short"]),
        (f"<article><h1>Title</h1>{STORY}</article><article>{LINKS}</article>", ["Title", "Paragraph 0"], ["other story"]),
        (f"<article><h1>Title</h1>{STORY}<p>See <a href='x'>this</a> too.</p></article>", ["Title", "See this too."], []),
        (f"<main><article>{STORY}</article><article>{STORY.replace('Para', 'Second para')}</article></main>", ["Paragraph 0", "Second paragraph 0"], []),
    ],
)
def test_density_chooses_in_articles_too(body, there, lost):
    text = html_extract.main_text(f"<html><head><title>t</title></head><body>{body}</body></html>")
    assert all(t in text for t in there) and not any(t in text for t in lost), text


@pytest.mark.parametrize(
    "start",
    [
        "<html><head><title>x</title><body>", "<head><meta charset=utf-8><title>x</title>", "<head><title>x</title><script>a</script>\n<BODY class=a>", "<head><link rel=x></head></head><body>",
        "<head><template><div>gone</div></template><body>", "<head><head><body>", "<title>x</title>",
    ],
)
def test_head_ends_where_the_body_starts(start):
    assert html_extract.main_text(f"{start}<article><h1>Head</h1><p>One two.</article>") == "Head\nOne two."
    assert html_extract.main_text(f"{start}just text") == "just text"


def brute_densities(root):
    """Link-adjusted characters per tag of each element, and the sums over children,
    found anew for every element from all texts below it."""
    import math

    def below(x):
        for k in x.items:
            if not isinstance(k, str) and not k.gone:
                yield k
                yield from below(k)

    def texts(x):
        return sum(len(" ".join(k.split())) for y in [x, *below(x)] for k in y.items if isinstance(k, str))

    def linked(x):
        return sum(texts(k) if k.tag == "a" else linked(k) for k in x.items if not isinstance(k, str) and not k.gone)

    share = linked(root) / max(texts(root), 1)
    density = {}
    for x in [root, *below(root)]:
        c, t, lc, links = texts(x), sum(1 for _ in below(x)), linked(x), sum(k.tag == "a" for k in below(x))
        t = max(t, 1)
        if c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            density[x] = c / t * max(math.log(c / max(lc, 1) * t / max(links, 1)) / max(base, 1e-9), 0.0)
    return density, {x: sum(density.get(k, 0.0) for k in x.items if not isinstance(k, str) and not k.gone and k.tag not in html_extract.INLINE) for x in density}


def given_pages(spark):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("html is not null").collect()]


def made_page(rng):
    """A page without a name to prune by: (html, blocks that are its text, all others)."""
    say = lambda n: " ".join("".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(3, 9))) for _ in range(n))
    own, other = [], []

    def block(n, kept):
        t = say(n)
        (own if kept else other).append(t)
        return t

    links = lambda n: "<ul>" + "".join(f"<li><a href='/{k}'>{block(rng.randint(1, 3), False)}</a></li>" for k in range(n)) + "</ul>"
    paragraphs = lambda n: "".join(f"<p>{block(rng.randint(25, 80), True)}</p>" for _ in range(n))
    loose = block(rng.randint(2, 3), False)
    body = [loose, f"<div>{links(rng.randint(6, 12))}</div>", f"<div><h1>{block(5, True)}</h1>{paragraphs(rng.randint(3, 8))}</div>"]
    if rng.random() < 0.5:
        body[2] = f"<div>{body[2]}</div>"
    if rng.random() < 0.5:  # text of the article's own kind, loose in the body
        body.append(block(rng.randint(60, 90), True))
    body.append(f"<div>{links(rng.randint(4, 9))}<div>{block(2, False)}</div></div>")
    return "<html><body>" + "\n".join(body) + "</body></html>", own, other


def test_made_pages_with_loose_text():
    """Known blocks, stray text and no names: what is found, and what is found beside it."""
    import random

    rng, found, missed, wrong = random.Random(12), 0, 0, 0
    for _ in range(150):
        page, own, other = made_page(rng)
        lines = set(html_extract.main_text(page).split("\n"))
        found, missed, wrong = found + len(lines & set(own)), missed + len(set(own) - lines), wrong + len(lines - set(own))
    assert found / (found + missed) >= 0.99 and found / (found + wrong) >= 0.99, (found, missed, wrong)


def test_loose_text_brings_nothing_else():
    page = "<body>Skip to content<div><ul>" + "<li><a href=x>menu entry</a></li>" * 9 + "</ul></div><div><p>" + "one long line of prose about a thing. " * 9 + "</p><p>" + "and more of it to read. " * 12 + "</p></div></body>"
    assert "menu" not in html_extract.main_text(page) and "Skip" not in html_extract.main_text(page) and "prose" in html_extract.main_text(page)
    both = page.replace("Skip to content", "This stands <b>loose</b> in the body, " + "and is as much prose as the rest of it is. " * 12)
    assert html_extract.main_text(both).startswith("This stands loose in") and "menu" not in html_extract.main_text(both)


def test_densities_against_brute_force(spark):
    for page in given_pages(spark)[:60]:
        nodes = html_extract._elements(html_extract.tree(page))
        html_extract.prune(nodes)
        html_extract.measure(nodes)
        density, total = brute_densities(nodes[0])
        for x in density:
            assert x.density == pytest.approx(density[x]) and x.total == pytest.approx(total[x])


def test_densities_decide(spark, monkeypatch):
    """With densities in disorder many pages have another text, though all else of a page is dropped for its names."""
    import random

    pages = given_pages(spark)
    plain = [html_extract.main_text(p) for p in pages]
    measure, rng = html_extract.measure, random.Random(1)

    def scrambled(nodes):
        measure(nodes)
        values = [(x.density, x.total) for x in nodes]
        rng.shuffle(values)
        for x, (x.density, x.total) in zip(nodes, values):
            pass

    monkeypatch.setattr(html_extract, "measure", scrambled)
    assert sum(html_extract.main_text(p) != t for p, t in zip(pages, plain)) > len(pages) / 6


def test_text_is_found_without_hints(spark):
    """Where article and main are plain div elements, the same lines are found."""
    lines = found = told = 0
    for page in given_pages(spark):
        want = Counter(html_extract.main_text(page).split("\n"))
        got = Counter(html_extract.main_text(re.sub(r"(?i)<(/?)(?:article|main)\b", r"<\1div", page)).split("\n"))
        lines, found, told = lines + want.total(), found + (want & got).total(), told + got.total()
    assert found >= 0.98 * lines and found >= 0.98 * told, (lines, found, told)


@pytest.mark.parametrize("part", ["</i>", "<li>", "<td>", "<div>", "<div></p>", "<ul><li>", "<article>", "<p><b>", "<table><td>", "</div><p>"])
def test_broken_pages_take_linear_time(part):
    import time

    took = []
    for n in (4000, 32000):
        began = time.perf_counter()
        html_extract.main_text("<div>" * 500 + part * n + "text")
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0] + 0.5


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", "<p>a&amp;b", "old", 0), (2, None, None, None, None), (None, "", "<p>" + "é " * 20000, "t", 1), (1, "u", "<p>a&amp;b", "old", 0)], "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter((r.page_id, r.text[:5], r.n_chars) for r in got.collect()) == Counter([(1, "a&b", 3), (1, "a&b", 3), (2, "", 0), (None, "é é é", 39999)])
    assert html_extract.extract(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def toxic_world(spark):
    """A made-up language, in which some texts hold bad words."""
    import random

    rng = random.Random(3)
    parts = ["la", "men", "tor", "ik", "os", "un", "dra", "pel", "sa", "vi"]
    bad = ["grumbak", "snotzel", "wurpidon"]
    rows, labels = [], []
    for i in range(1500):
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 80))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    return rows, dict(labels), docs, known, toxicity.fit(docs, known.where("doc_id % 3 <> 1"))


def test_toxicity_held_out(spark, toxic_world):
    rows, labels, docs, _, model = toxic_world
    got = {r.id: r.score for r in toxicity.scored(docs, model).collect()}
    held = [i for i in got if i % 3 == 1]
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.7) == bool(labels[i]) for i in held) >= 0.98 * len(held)


def test_toxicity_restores(toxic_world):
    model = toxic_world[4]
    rows = model.characters.tolist()
    for hidden, word in {"gr|_|mbak": None, "gru-mb-ak": "grumbak", "Grum84k".lower(): "grumbak", "gruuuumbak!!": "grumbak", "$n0tze1": "snotzel", "wurp1d0n": "wurpidon", "men,": "men", "2024": "2024", "": "", "***": ""}.items():
        if word is not None:
            assert toxicity.restore(hidden, rows) == word, hidden
    assert "grumbak" in toxicity.restored_text("la G R U M B A K men", model.characters)


def test_toxicity_of_hidden_words(spark, toxic_world):
    model = toxic_world[4]
    clean = "la men tor ik osun dra pelsa vimen torla"
    odd = [(1, clean), (2, clean + " gru.mb.ak wurp1d0n"), (3, None), (4, ""), (5, clean + " g r u m b a k snooootzel"), (None, clean), (6, "la " * 50000), (1, clean)]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in odd], "doc_id long, text string, score double, id int")
    got = toxicity.scored(df, model).collect()
    assert Counter((r.id, r.score >= 0.7) for r in got) == Counter([(1, False), (1, False), (2, True), (3, False), (4, False), (5, True), (None, False), (6, False)])
    kept = toxicity.clean_rows(df, model)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 1, 3, 4, None, 6])
    assert toxicity.scored(df.limit(0), model).count() == 0 and toxicity.clean_rows(df.limit(0), model).count() == 0


def test_toxicity_of_words_that_meet(spark, toxic_world):
    model = toxic_world[4]
    clean = "la men tor ik osun dra pelsa vimen torla"
    hidden = ["sa a g r u m b a k", "v i g r u m b a k", "g r u m b a k s n o t z e l", "grumbak/snotzel", "l'grumbak", "vimen:grumbak", "d r a  g r u m b a k", "la-grum8ak", "g r u u u u m b a k  i k"]
    for h in hidden:
        assert {"grumbak"} <= set(toxicity.restored_text(h, model.characters).split()), (h, toxicity.restored_text(h, model.characters))
    twice = ["sa a g r u m b a k d r a w u r p i d o n", "vimen/grumbak l'snotzel"]
    df = spark.createDataFrame([(0, clean), (1, clean + " d r a p e l vimen/torla"), *[(i + 2, f"{clean} {h}") for i, h in enumerate(twice)]], "doc_id long, text string")
    assert {r.id: r.score >= 0.7 for r in toxicity.scored(df, model).collect()} == {0: False, 1: False, 2: True, 3: True}


def test_toxicity_of_digits_and_long_tokens(spark, toxic_world):
    model = toxic_world[4]
    rows = model.characters.tolist()
    for hidden in ("9rum84k", "5n0723l", "5n07z31", "g-----------r-----------u-----------m-----------b-----------a-----------k", "gr" + "u" * 100 + "mbak", " ".join("grumbak") + "  " + "  ".join(map(" ".join, ["dra"] * 20)), "vimen-" * 20 + "grumbak"):
        assert {"grumbak", "snotzel"} & set(toxicity.readings(hidden, rows)), (hidden, toxicity.readings(hidden, rows))
    for hidden in ("g" + "r" * 70 + "umbak", "grum8ak" + "!" * 60, ("." * 13).join("grumbak"), "g" + "r" * 120 + "um8@k"):
        assert "grumbak" in toxicity.readings(hidden, rows), (hidden, toxicity.readings(hidden, rows))
    for number in ("2024", "10", "1999", "3000000", "12/2024", "7", "0" * 100):
        assert toxicity.restore(number, rows) == number.replace("/", " ") or "/" in number, (number, toxicity.restore(number, rows))
    clean = "la men tor ik osun dra pelsa vimen torla"
    df = spark.createDataFrame([(0, clean + " 2024 1b9c 0815"), (1, clean + " 5n0723l 9rum84k"), (2, clean + " " + "vimen-" * 20 + "grumbak " + "snot-" + "-" * 80 + "zel")], "doc_id long, text string")
    assert {r.id: r.score >= 0.7 for r in toxicity.scored(df, model).collect()} == {0: False, 1: True, 2: True}
    assert toxicity.features("grumbak" + "la" * 30) == ["=grumbak" + "la" * 30, "grum", "grumb", "grumba"]


def test_toxicity_of_what_looks_alike(toxic_world):
    """Doubled letters, characters without a look, other forms and scripts, and stars for any letters."""
    model = toxic_world[4]
    for hidden in (
        "gruumbak", "ggrummbaakk", "g\u200bru\u00admb\u2060ak", "\uff47\uff52\uff55\uff4d\uff42\uff41\uff4b", "grumb\u0430k", "gr\u03c5mbak", "g\u2024r\u2024u\u2024m\u2024b\u2024a\u2024k",
        "gr*mb*k", "g*umb*k", "gr**bak", "GRUM**K",
    ):
        assert toxicity.restored_text(f"la {hidden} men", model.characters).split() == ["la", "grumbak", "men"], (hidden, toxicity.restored_text(hidden, model.characters))
    rows = model.characters.tolist()
    for stars in range(1, 6):  # each star has a place
        hidden = "g" + "*" * stars + "grumbak"[stars + 1 :]
        assert max(map(len, toxicity.readings(hidden, rows))) <= 7 and len(toxicity.lattice(hidden)) == len(hidden)
    assert toxicity.restored_text("\u0441\u043e\u043d \u03bb\u03cc\u03b3\u03bf\u03c2", model.characters) == "\u0441\u043e\u043d \u03bb\u03cc\u03b3\u03bf\u03c2"  # words of one script stay


def test_decoder_against_all_paths(toxic_world):
    """On short tokens Viterbi finds what trying out every path of the lattice finds."""
    import itertools
    import random

    model, rng = toxic_world[4].characters.tolist(), random.Random(9)

    def best(token):
        top = None
        for path in itertools.product(*toxicity.lattice(token)):
            p = q = 0
            score, number, out = 0.0, False, ""
            for text, cost in path:
                score += cost
                for ch in text:
                    if ch == " " and not q:
                        number = False
                    elif ch in toxicity.LOOKALIKES:
                        score += 0.0 if number else toxicity.NUMBER
                        if q:
                            score, p, q = score + model[p][q][0], q, 0
                        number, out = True, out + ch
                    else:
                        c = 0 if ch == " " else toxicity._class(ch)
                        score, p, q, number, out = score + model[p][q][c], q, c, False, out + ch
            score += model[p][q][0] if q else 0.0
            top = max(top or (score, out.strip()), (score, out.strip()), key=lambda x: x[0])
        return top

    for _ in range(150):
        token = "".join(rng.choice("gruumbaalno01345@$*.-") for _ in range(rng.randint(1, 4)))
        assert toxicity.decode(token, model) == best(token)[1], (token, toxicity.decode(token, model), best(token))


def test_doubled_letters_by_their_neighbours(toxic_world):
    """Tokens of letters alone take a shorter way; it ends where the lattice does."""
    import random

    model, rng = toxic_world[4].characters.tolist(), random.Random(2)
    same = 0
    for _ in range(400):
        token = "".join(c * rng.choice((1, 1, 1, 1, 2)) for c in "".join(rng.choice(("la", "men", "tor", "ik", "grum", "bak", "zel")) for _ in range(rng.randint(1, 4))))
        if not toxicity.RUN.search(token):
            spots = toxicity.meant_once(token, model)
            got = toxicity.restore(token, model)
            doubles = [m.start() for m in toxicity.DOUBLE.finditer(token)]
            assert got == toxicity.decode(token, model) or any(b - a < 4 for a, b in zip(doubles, doubles[1:])), (token, got, spots)
            same += got == toxicity.decode(token, model)
    assert same > 330


def test_toxicity_without_labels(spark):
    docs = helpers.docs(spark)
    model = toxicity.fit(docs, spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int"))
    assert all(r.score < 0.7 for r in toxicity.scored(docs, model).collect())
    assert toxicity.fit(helpers.none(spark), spark.createDataFrame([], "doc_id long, toxic int")).weights == {}


def test_mix_moves_no_texts_but_few(spark):
    """Rows and decisions meet by filters: where all units are single, next to no text is shuffled, and counts are those of mix()."""
    import collections

    df = spark.range(3000).selectExpr("id doc_id", "repeat(concat('w', id, ' '), cast(1 + id % 40 as int)) text", "element_at(array('a', 'b', 'c', null), cast(1 + id % 4 as int)) source")
    df = df.union(df.where("doc_id < 40")).union(df.where("doc_id < 5"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = mixing.mix_rows(df, bucket_rows=50, fan_in=4)
        got = collections.Counter(r.doc_id for r in rows.select("doc_id").collect())
        want = collections.Counter()
        for r in mixing.mix(df, bucket_rows=50, fan_in=4).collect():
            want[r.doc_id] += r.copies
        assert got == +want
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # the rows that aren't odd come by filters and the table of sources, all of them broadcast
    assert plan.count("strategy=broadcast") >= 3
