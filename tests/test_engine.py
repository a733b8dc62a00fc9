"""Sources, motion, seeds, units, streaming and the whole analysis on planted inputs."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.functions import expr
from glintframe.operators import PIXEL, frames, graph, motion, project, seeds, signal, stencil, units
from glintframe.plans import pipeline, registry
from glintframe.plans.adapters import Inputs
from glintframe.runtime import written
from glintframe.sources import catalog, params, video
from glintframe.streaming import traces as stream

MOVIE = "frame int, height int, width int, value double"


def movie_of(spark, a):
    t, y, x = np.indices(a.shape)
    return spark.createDataFrame([tuple(r) for r in zip(t.ravel().tolist(), y.ravel().tolist(), x.ravel().tolist(), a.ravel().astype(float).tolist())], MOVIE)


def array_of(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.frame, r.height, r.width] = r.value
    return out


@pytest.fixture(scope="module")
def noise(spark):
    a = np.random.default_rng(1).integers(0, 50, (3, 9, 7)).astype(float)
    return a, movie_of(spark, a)


def test_frames_and_back(noise):
    a, m = noise
    assert (array_of(frames.to_movie(frames.to_frames(m)), a.shape) == a).all()


@pytest.mark.parametrize("radius", [1, 3, 12])
def test_disks_at_borders(noise, radius):
    a, m = noise
    y, x = np.mgrid[:9, :7]
    want = np.array([[[f[(y - i) ** 2 + (x - j) ** 2 <= radius**2].max() for j in range(7)] for i in range(9)] for f in a])
    assert (array_of(stencil.dilate(m, radius), a.shape) == want).all()
    assert (array_of(stencil.tophat(m, radius), a.shape) >= 0).all()


@pytest.mark.parametrize(("size", "mode", "pad"), [(3, "reflect", "symmetric"), (4, "reflect", "symmetric"), (5, "reflect101", "reflect"), (3, "replicate", "edge"), (15, "reflect", "symmetric")])
def test_box_borders(noise, size, mode, pad):
    a, m = noise
    p = np.pad(a, ((0, 0), *[(size // 2, (size - 1) // 2)] * 2), mode=pad)
    want = np.lib.stride_tricks.sliding_window_view(p, (size, size), (1, 2)).mean((3, 4))
    assert np.allclose(array_of(stencil.box_mean(m, size, mode), a.shape), want)


def test_parts_are_independent(spark, noise):
    a, m = noise
    both = m.withColumn("part", F.lit(0)).union(m.withColumn("value", F.col("value") * 2).withColumn("part", F.lit(1)))
    out = stencil.gaussian(both, 5, by=("part",))
    one = array_of(stencil.gaussian(m, 5), a.shape)
    assert np.allclose(array_of(out.where("part = 1"), a.shape), 2 * one) and np.allclose(array_of(out.where("part = 0"), a.shape), one)
    assert project.top_pixels(project.projection(both, by=("part",)), 2, ("part",)).count() == 4


def test_unknown_methods(noise):
    for call in (lambda: stencil.denoise(noise[1], "x"), lambda: stencil.remove_background(noise[1], "x"), lambda: stencil.local_max_any(noise[1], 2, 2)):
        with pytest.raises(ValueError):
            call()


def test_windows():
    assert project.rolling_windows(10, 4, 5) == [(0, 0, 2), (1, 2, 7), (2, 7, 10)]
    assert project.rolling_windows(1, 4, 5) == [(0, 0, 1), (1, 0, 1)] and len(project.random_windows(9, 4, 3)) == 3


def test_merge_conflict(spark):
    a = spark.createDataFrame([(0, 0, 1.0)], "height int, width int, v double")
    assert project.merge(a, a, ["height", "width"]).count() == 1
    with pytest.raises(Exception, match="conflicting"):
        project.merge(a, a.withColumn("v", F.col("v") + 1), ["height", "width"]).collect()


def test_constant_movie_has_no_seeds(spark):
    m = movie_of(spark, np.full((6, 8, 8), 3.0))
    assert seeds.find(m, 6, 4, 2, 4, 2).count() == 0
    flat = signal.arrays(m, ["height", "width"]).limit(2).withColumn("id", F.monotonically_increasing_id())
    ids = [r.id for r in flat.collect()]
    edge = spark.createDataFrame([(ids[0], ids[1])], "src long, dst long")
    assert graph.edge_correlation(edge, flat.select("id", "trace")).first()["corr"] == 0


def test_labels(spark):
    nodes = spark.createDataFrame([(i,) for i in (3, 5, 7, 9, 11)], "id long")
    edges = spark.createDataFrame([(5, 9), (9, 11)], "src long, dst long")
    assert {r.id: r.label for r in graph.labels(nodes, edges).collect()} == {3: 0, 5: 1, 9: 1, 11: 1, 7: 2}
    assert {r.id: r.label for r in graph.labels(nodes, edges, True).collect()} == {3: -1, 5: 1, 9: 1, 11: 1, 7: -1}


def test_ties_go_to_the_first_seed(spark):
    a = np.zeros((30, 6, 6))
    wave = np.sin(np.arange(30.0))
    a[:, 1, 1] = a[:, 1, 3] = 5 + wave
    s = spark.createDataFrame([(0, 1, 1), (1, 1, 3), (2, 5, 5)], "seed_id long, height int, width int")
    m = movie_of(spark, a)
    got = {r.seed_id: r.mask_mrg for r in seeds.merge(m, project.projection(m), s, 3, 0.9).collect()}
    assert got == {0: True, 1: False, 2: True}


def test_jaccard_is_strict(spark):
    rows = [(0, 0, x, 1.0) for x in range(4)] + [(1, 0, x, 1.0) for x in range(2, 6)]
    A = spark.createDataFrame(rows, "unit_id long, height int, width int, value double")
    lab = lambda t: len({r.label for r in units.jaccard_groups(A, t).collect()})
    assert lab(1 / 3) == 2 and lab(0.3) == 1


def test_background_residual_is_orthogonal(spark):
    rng = np.random.default_rng(2)
    b, f = rng.random((5, 5)), rng.random(20) + 1
    m = movie_of(spark, f[:, None, None] * b)
    none = spark.createDataFrame([], "unit_id long, height int, width int, value double")
    got_b, got_f = units.update_background(m, none, spark.createDataFrame([], "unit_id long, frame int, value double"))
    fs = {r.frame: r.value for r in got_f.collect()}
    assert np.allclose([fs[t] * f.mean() for t in range(20)], f)


def test_least_squares_traces(spark):
    rng = np.random.default_rng(3)
    A = rng.random((3, 6, 6)) * (rng.random((3, 6, 6)) < 0.5)
    C = rng.random((3, 10))
    m = movie_of(spark, np.einsum("uhw,ut->thw", A, C))
    u, y, x = np.nonzero(A)
    a = spark.createDataFrame([(int(i), int(j), int(k), float(A[i, j, k])) for i, j, k in zip(u, y, x)], "unit_id long, height int, width int, value double")
    got = np.zeros((3, 10))
    for r in units.init_traces(m, a).collect():
        got[r.unit_id, r.frame] = r.value
    assert np.allclose(got, C, atol=1e-6)


def test_motion_is_found(spark):
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:40, :40]
    im = sum(np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 12) for cy, cx in rng.uniform(8, 32, (9, 2)))
    shifts = np.array([[0, 0], [1, 0], [1, -2], [0.5, 0.5], [0, 3], [-2, 1], [0, 0]])
    f = np.fft.fft2(im)
    ky, kx = np.fft.fftfreq(40)[:, None], np.fft.fftfreq(40)[None]
    a = np.array([np.fft.ifft2(f * np.exp(-2j * np.pi * (ky * dy + kx * dx))).real for dy, dx in shifts])
    m = movie_of(spark, a)
    got = {r.frame: (r.dy, r.dx) for r in motion.estimate(m, upsample=50).collect()}
    moved = np.array([got[t] for t in range(7)])
    rest = moved + shifts
    assert np.abs(rest - rest.mean(0)).max() < 0.1  # what is left is the same for all frames
    by_template = {r.frame: (r.dy, r.dx) for r in motion.template_motion(m, a[0], 5).collect()}
    assert np.allclose(np.abs(by_template[4]), (0, 3))


def test_elastic_motion_is_found(spark):
    """Over three levels of chunks, with as many steps as the operator has."""
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:32, :32]
    im = sum(np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 12) for cy, cx in rng.uniform(7, 25, (9, 2)))
    shifts = np.round(rng.uniform(-2, 2, (11, 2)) * 2) / 2
    f = np.fft.fft2(im)
    ky, kx = np.fft.fftfreq(32)[:, None], np.fft.fftfreq(32)[None]
    a = np.array([np.fft.ifft2(f * np.exp(-2j * np.pi * (ky * dy + kx * dx))).real for dy, dx in shifts])
    m = movie_of(spark, a)
    found = motion.estimate(m, mesh=(1, 1)).collect()
    assert sorted(r.frame for r in found) == list(range(11)) and {(r.rows, r.columns) for r in found} == {(4, 4)}
    moved = np.array([np.array(r.coef).reshape(2, -1).mean(1) for r in sorted(found, key=lambda r: r.frame)])
    rest = moved + shifts
    assert np.abs(rest - rest.mean(0)).max() < 0.3
    placed = array_of(motion.apply(m, spark.createDataFrame(found)), a.shape)[:, 6:-6, 6:-6]
    assert placed.std(0).mean() < 0.2 * a[:, 6:-6, 6:-6].std(0).mean()


def test_elastic_query_moves_all_frames(spark):
    run = registry.queries()
    rigid, elastic = (sorted({r.frame for r in run[q](spark, "/root/testdata/sf0.001").collect()}) for q in ("motion_rigid", "motion_elastic"))
    assert elastic == rigid == list(range(83))


def test_motion_of_one_frame(spark):
    m = movie_of(spark, np.random.default_rng(0).random((1, 8, 8)))
    assert [(r.dy, r.dx) for r in motion.estimate(m).collect()] == [(0, 0)]


def test_params(spark, tmp_path):
    p = {"get_noise": {"noise_range": (0.06, 0.5)}, "denoise": {"method": "median", "ksize": 7}, "remove_glow": {"on": True}, "first_spatial": {"size_thres": (25, None)}}
    params.write(p, str(tmp_path / "p"), spark)
    assert params.as_dict(params.read(spark, str(tmp_path / "p"))) == p
    assert params.parsed("None") is None and params.parsed("-1") == "-1" and params.parsed(".5") == 0.5


def test_catalog(spark, tmp_path, noise):
    _, m = noise
    root = str(tmp_path)
    for animal in ("a1", "a2"):
        for session in ("s1", "s2"):
            catalog.save(m, f"{root}/{animal}/{session}", "Y", overwrite=True)
    one = f"{root}/a1/s1"
    catalog.save(project.projection(m), one, "hi")
    catalog.save(project.projection(m, "min"), one, "lo")
    assert catalog.names(spark, one) == ["Y", "hi", "lo"] and set(catalog.open_all(spark, one)) == {"Y", "hi", "lo"}
    assert catalog.open_merged(spark, one, ["height", "width"], ["hi", "lo"]).columns == ["height", "width", "hi", "lo"]
    many = catalog.open_many(spark, root, "Y", {"session": -1, "animal": -2})
    assert {(r.animal, r.session) for r in many.select("animal", "session").distinct().collect()} == {(a, s) for a in ("a1", "a2") for s in ("s1", "s2")}
    assert catalog.open_many(spark, root, "Y", {"animal": -2}, sub_dirs=["s2"]).count() == 2 * m.count()
    with pytest.raises(Exception):
        catalog.save(m, one, "Y")
    assert catalog.update_meta(spark, one, "Y", {"session": -1}).select("session").distinct().first()[0] == "s1"


def tiff(pages):
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for im in pages:
        data = len(out)
        out += im.astype("<u2").tobytes()
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        tags = [(256, 4, im.shape[1]), (257, 4, im.shape[0]), (258, 3, 16), (259, 3, 1), (273, 4, data), (279, 4, im.nbytes)]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def test_videos(spark, tmp_path):
    rng = np.random.default_rng(6)
    parts = {n: rng.integers(0, 255, (k, 4, 5), dtype=np.uint8) for n, k in ((2, 3), (10, 2), (1, 4))}
    for n, a in parts.items():
        (tmp_path / f"cam{n}.raw").write_bytes(a.tobytes())
    whole = np.concatenate([parts[1], parts[2], parts[10]])
    got = video.load(spark, str(tmp_path), video.raw_decoder(4, 5), pattern=r"cam\d+\.raw$")
    assert (array_of(got, whole.shape) == whole).all()
    assert (array_of(video.load(spark, str(tmp_path), video.raw_decoder(4, 5), flip=True), whole.shape) == whole[:, ::-1]).all()
    assert video.load(spark, str(tmp_path), video.raw_decoder(4, 5), stride=2).select("frame").distinct().count() == 5
    assert {r.frame for r in video.load(spark, str(tmp_path), video.raw_decoder(4, 5), mean=4).select("frame").collect()} == {0, 4}
    pages = [rng.integers(0, 60000, (3, 6), dtype=np.uint16).astype("<u2") for _ in range(3)]
    (tmp_path / "t1.tif").write_bytes(tiff(pages))
    assert (array_of(video.load(spark, str(tmp_path), video.tiff_pages, glob="*.tif"), (3, 3, 6)) == np.array(pages)).all()
    def chunk(name, body):
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)

    def avi(ims, bits):
        head = struct.pack("<IiiHH4s", 40, 5, 4, 1, bits, b"\0\0\0\0") + b"\0" * 20
        line = lambda r: r.tobytes() + b"\0" * (-r.size % 4)
        movi = b"".join(chunk(b"00db", b"".join(line(r) for r in im[::-1])) for im in ims)
        body = b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"LIST", b"strl" + chunk(b"strf", head))) + chunk(b"LIST", b"movi" + movi)
        return chunk(b"RIFF", body)

    grey = rng.integers(0, 255, (3, 4, 5), dtype=np.uint8)
    (tmp_path / "v1.avi").write_bytes(avi(grey, 8))
    (tmp_path / "v2.avi").write_bytes(avi(np.repeat(grey[..., None], 3, -1), 24))
    assert (array_of(video.load(spark, str(tmp_path), video.avi_frames, glob="*.avi"), (6, 4, 5)) == np.concatenate([grey, grey])).all()
    own = lambda path, data: iter(np.frombuffer(data, dtype=np.uint8).reshape(-1, 4, 5))
    assert (array_of(video.load(spark, str(tmp_path), own, glob="*.raw"), whole.shape) == whole).all()
    assert (array_of(video.load(spark, str(tmp_path), video.raw_decoder(4, 5), glob="*.raw", frames_a_task=1), whole.shape) == whole).all()
    with pytest.raises(FileNotFoundError):
        video.load(spark, str(tmp_path), video.tiff_pages, glob="*.none")


def test_divisors_of_a_batch():
    for x in (np.arange(0, 3000), np.arange(60_000, 60_400), np.array([7, -3, 0, 7, 1, 99_991, 99_856]), np.array([], dtype=np.int64)):
        size, value = expr._divisors(x)
        assert [v.tolist() for v in np.split(value, np.cumsum(size)[:-1])][: len(x)] == [[k for k in range(1, n + 1) if n % k == 0] for n in x.tolist()]
    size, value = expr._divisors(np.array([2**31 - 1, 46337 * 46337]))
    assert value.tolist() == [1, 2**31 - 1, 1, 46337, 46337 * 46337]


def test_factors(spark):
    got = {r.x: r.f for r in spark.range(0, 61).select(F.col("id").alias("x"), expr.factors(F.col("id")).alias("f")).collect()}
    assert all(f == [k for k in range(1, x + 1) if x % k == 0] for x, f in got.items())


@pytest.mark.parametrize("name", ["temporal_invariants", "temporal_certified"])
def test_units_without_spikes_are_told_of(spark, tmp_path, name):
    """Unit 0 is a decaying start and noise; unit 1 is active in later frames; unit 2 has nothing above 0."""
    start = [292.7, 120.0, 701.7, 212.8, 98.0, 73.3, 110.7, 243.0, 56.5, 152.6, 146.3, 158.3, 94.2, 0.0, 55.0, 379.2, 0.0, 41.9, 39.2, 177.8, 35.7, 26.6, 0.0, 65.0, 24.6, 283.4, 37.3, 43.3, 139.3, 206.4]
    rows = [(0, d, v) for d, v in enumerate(start)] + [(1, 900 + d, v) for d, v in enumerate(start)] + [(2, 5, 0.0)] + [(1, 1799, 1.0)]
    day = F.expr("timestampadd(DAY, day, timestamp '2024-01-01 12:00:00')").cast("timestamp_ntz").alias("ts")
    spark.createDataFrame(rows, "user_id long, day int, value double").select("user_id", day, "value").write.parquet(str(tmp_path / "events.parquet"))
    silent = units.update_temporal(*(lambda i: (i.T.select("unit_id", F.lit(0).alias("height"), F.col("unit_id").cast("int").alias("width"), F.lit(1.0).alias("value")).distinct(), i.T))(Inputs(spark, str(tmp_path))), penalty=0.1)
    assert {r.unit_id for r in silent.select("unit_id").distinct().collect()} == {1}
    got = registry.queries()[name](spark, str(tmp_path)).collect()
    assert sorted(r.unit_id for r in got) == ([0, 1] if name == "temporal_invariants" else [0, 0, 1, 1])
    assert all(r.frames == 1800 and all(v for k, v in r.asDict().items() if isinstance(v, bool)) for r in got)


def test_stream_equals_batch(spark, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy("/root/testdata/sf0.001/events.parquet", tmp_path / "in" / "events.parquet")
    live = stream.windowed(stream.stream(spark, str(tmp_path / "in")))
    q = live.writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = stream.windowed(spark.read.parquet(str(tmp_path / "in")))
    key = lambda df: sorted((r.unit_id, r.start, round(r.value, 6), r.n) for r in df.collect())
    assert key(spark.table("live")) == key(batch)
    stream.start(stream.windowed(stream.stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    closed = key(spark.read.parquet(str(tmp_path / "out")))
    assert closed and set(closed) <= set(key(batch))


def test_planted_units_are_recovered(spark):
    _, truth, _ = pipeline.planted_truth()
    out = pipeline.run(pipeline.planted(spark), pipeline.PLANTED)
    centres = {}
    for r in out["A"].collect():
        if r.value > centres.get(r.unit_id, (0,))[0]:
            centres[r.unit_id] = (r.value, r.height, r.width)
    found = set()
    traces = {u: [0.0] * truth.shape[1] for u in centres}
    for r in out["C"].collect():
        if r.unit_id in traces:
            traces[r.unit_id][r.frame] = r.value
    for k, (cy, cx) in enumerate(pipeline.CENTRES):
        near = [u for u, (_, y, x) in centres.items() if (y - cy) ** 2 + (x - cx) ** 2 <= 4]
        if any(np.corrcoef(traces[u], truth[k])[0, 1] > 0.8 for u in near):
            found.add(k)
    assert len(found) == 5 and len(centres) == 5


def test_session(spark, tmp_path):
    from glintframe.plans.session import Session

    s = Session(pipeline.planted(spark).where("frame < 40"))
    s.step("denoise", method="gaussian", ksize=3).step("background_removal", method="tophat", wnd=7).step("seeds_init", wnd_size=40, stp_size=20, max_wnd=6, diff_thres=6)
    s.step("pnr_refine", noise_freq=0.25, thres=1.2).step("seeds_merge", thres_dist=5, thres_corr=0.7).step("initialize", thres_corr=0.6, wnd=6).step("get_noise", noise_range=(0.25, 0.5))
    s.step("first_spatial", dl_wnd=2, sparse_penal=0.01, size_thres=(5, None)).step("first_temporal", noise_freq=0.25, jac_thres=0.2)
    assert s["A"].select("unit_id").distinct().count() >= 3 and s["temporal"].count() > 0
    for name in ("denoise", "remove_background", "seeds_init", "contours"):
        assert s.preview(name, 3).count() > 0
    s.save_params(str(tmp_path / "p"))
    assert params.as_dict(params.read(spark, str(tmp_path / "p")))["seeds_init"]["max_wnd"] == 6
    with pytest.raises(ValueError):
        s.step("nothing")


def test_parts(spark):
    out = pipeline.run_parts(pipeline.planted(spark).where("frame < 80"), 40, pipeline.PLANTED)
    assert {r.part for r in out["C"].select("part").distinct().collect()} == {0, 1} and out["C"].agg(F.max("frame")).first()[0] >= 78


def test_products_over_tiles_and_blocks(spark):
    rng = np.random.default_rng(4)
    a, c = rng.normal(size=(13, 5, 7)), rng.normal(size=(3, 13))
    where = [(u, y, x) for u in range(3) for y in range(5) for x in range(7) if (u + y * x) % 3]
    C = spark.createDataFrame([(u, t, float(c[u, t])) for u in range(3) for t in range(13)], "unit_id long, frame int, value double")
    got = units.products(movie_of(spark, a), C, spark.createDataFrame(where, "unit_id long, height int, width int"), tile=2, frames=4).collect()
    assert {(r.unit_id, r.height, r.width) for r in got} == set(where)
    assert all(np.isclose(r.cy, (c[r.unit_id] * a[:, r.height, r.width]).sum()) for r in got)


def test_spatial_weights_by_covariances(spark):
    """The same weights as from whole traces, for pixels of one and of several units."""
    from glintframe.functions import kernels

    rng = np.random.default_rng(5)
    c = rng.random((3, 40))
    mix = rng.random((3, 4, 4)) * (rng.random((3, 4, 4)) < 0.6)
    a = np.einsum("ut,uyx->tyx", c, mix) + rng.normal(0, 0.05, (40, 4, 4))
    where = [(u, y, x) for u in range(3) for y in range(4) for x in range(4) if u == 0 or (y + x) % 3 == 0]
    C = spark.createDataFrame([(u, t, float(c[u, t])) for u in range(3) for t in range(40)], "unit_id long, frame int, value double")
    sn = spark.createDataFrame([(y, x, 0.02) for y in range(4) for x in range(4)], "height int, width int, sn double")
    got = {(r.unit_id, r.height, r.width): r.value for r in units.spatial_weights(movie_of(spark, a), C, spark.createDataFrame(where, "unit_id long, height int, width int"), sn, 0.5).collect()}
    for y in range(4):
        for x in range(4):
            ids = [u for u, i, j in where if (i, j) == (y, x)]
            for u, w in zip(ids, kernels.positive_lasso(c[ids].T, a[:, y, x], 0.01)):
                assert np.isclose(got.get((u, y, x), 0.0), w, atol=1e-6)


def test_traces_by_groups_of_units(spark):
    """Units that overlap are solved together, others apart, in blocks of frames."""
    rng = np.random.default_rng(6)
    foot = np.zeros((4, 6, 6))
    foot[0, :3, :2], foot[1, 1:4, 1:3], foot[2, 4:, 4:], foot[3, 0, 5] = (rng.random(s) + 0.5 for s in ((3, 2), (3, 2), (2, 2), ()))
    true = rng.random((4, 11))
    A = spark.createDataFrame([(u, y, x, float(foot[u, y, x])) for u, y, x in np.argwhere(foot > 0).tolist()], "unit_id long, height int, width int, value double")
    got = units.init_traces(movie_of(spark, np.einsum("ut,uyx->tyx", true, foot)), A, frames=4).collect()
    assert len(got) == 44 and all(np.isclose(r.value, true[r.unit_id, r.frame], atol=1e-6) for r in got)


def test_accumulated_over_blocks(spark):
    rng = np.random.default_rng(7)
    steps = rng.normal(size=(30, 2))
    df = spark.createDataFrame([(t, *map(float, s)) for t, s in enumerate(steps)], "frame int, dy double, dx double")
    want = steps.cumsum(0) - steps.cumsum(0).mean(0)
    for r in motion.accumulated(df, block=7).collect():
        assert np.allclose((r.dy, r.dx), want[r.frame])
    both = df.withColumn("part", F.lit(0)).union(df.withColumn("part", F.lit(1)))
    assert motion.accumulated(both, ("part",), 7).count() == 60


def exchanges(df):
    """The exchanges of a plan, as text."""
    return [line.strip() for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


def test_layouts_need_no_exchange(spark, tmp_path, noise):
    movie = noise[1]
    frames = catalog.save(movie, str(tmp_path), "f", layout="frames", buckets=3)
    pixels = catalog.save(movie, str(tmp_path), "p", layout="pixels", buckets=5)
    plain = catalog.save(movie, str(tmp_path), "x")
    chain = lambda m: stencil.sobel(stencil.tophat(stencil.median(m, 3), 2))
    assert exchanges(chain(frames)) == [] and len(exchanges(chain(plain))) == 1
    key = "hashpartitioning(height"
    by_pixel = lambda m: signal.noise(project.deglow(m), keys=tuple(PIXEL))
    assert not any(key in e for e in exchanges(by_pixel(pixels))) and any(key in e for e in exchanges(by_pixel(plain)))
    near = movie.select(*PIXEL).distinct().limit(7).withColumn("seed_id", F.monotonically_increasing_id())
    joined = seeds.traces_at(project.deglow(pixels), spark.createDataFrame(near.collect(), near.schema))
    assert sum(key in e for e in exchanges(joined)) <= 1  # the seeds come to the movie
    for a, b in ((chain(frames), chain(plain)), (by_pixel(pixels), by_pixel(plain))):
        cols = sorted(a.columns)
        assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_layout_is_found_again(spark, tmp_path, noise):
    """Another session has no table of this name; partition columns and overwriting work, too."""
    folder = str(tmp_path / "mouse1" / "day2")
    saved = catalog.save(noise[1], folder, "m", meta={"animal": -2, "session": -1}, layout="frames", buckets=2)
    other = spark.newSession()
    other.sql(f"DROP TABLE IF EXISTS {catalog._table(f'{folder}/m')}")
    again = catalog.load(other, folder, "m")
    assert exchanges(stencil.dilate(again, 1)) == [] and sorted(map(tuple, again.collect())) == sorted(map(tuple, saved.collect())) and again.first().animal == "mouse1"
    with pytest.raises(FileExistsError):
        catalog.save(noise[1], folder, "m", layout="pixels")
    few = catalog.save(noise[1].where("frame < 2"), folder, "m", overwrite=True, layout="pixels", buckets=2)
    assert few.count() == noise[1].where("frame < 2").count() and catalog.names(spark, folder) == ["m"]


def test_parts_move_each_trace_once(spark):
    """Correlations by parts are those of numpy; a trace goes once to each part that needs it."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20, 20, 130)).cumsum(axis=2)
    x[3, 4] = 7.0
    points = spark.createDataFrame([(int(h * 20 + w), h, w) for h in range(20) for w in range(20)], "id long, height int, width int")
    rows = spark.createDataFrame([(int(h * 20 + w), x[h, w].tolist()) for h in range(20) for w in range(20)], "id long, trace array<double>")
    edges = written(graph.radius_pairs(points, 3), "edges")
    flat = x.reshape(400, -1)
    for args in ({"points": points, "side": 10}, {"points": points, "side": 7}, {}):
        got = graph.edge_correlation(edges, rows, **args).collect()
        assert len(got) == edges.count()
        for r in got:
            a, b = flat[r.src], flat[r.dst]
            want = 0.0 if a.std() == 0 or b.std() == 0 else np.corrcoef(a, b)[0, 1]
            assert r.corr == pytest.approx(want, abs=1e-9) and r.distance > 0
    moved = graph.members(edges, graph.tiles(points, 10)).count()
    assert moved <= 4 * (10 + 3 + 3) ** 2 and edges.count() * 2 > 10 * moved
    dots = graph.edge_products(edges.select("src", "dst"), rows, graph.tiles(points, 10), frames=50)
    assert all(r["dot"] == pytest.approx(float(flat[r.src] @ flat[r.dst]), rel=1e-9, abs=1e-6) for r in dots.collect())


def written_bytes(spark):
    """Bytes that shuffles of this session have written so far."""
    execs = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(execs.apply(k).totalShuffleWrite() for k in range(execs.size()))


def test_parts_shuffle_less_than_edges(spark):
    """With 28 neighbours each, traces of 500 frames: what moves is a fraction of a copy for each edge's end."""
    rng = np.random.default_rng(8)
    side, frames = 24, 500
    points = spark.createDataFrame([(h * side + w, h, w) for h in range(side) for w in range(side)], "id long, height int, width int")
    rows = written(spark.createDataFrame([(i, rng.normal(size=frames).tolist()) for i in range(side * side)], "id long, trace array<double>"), "rows")
    edges = written(graph.radius_pairs(points, 3).select("src", "dst"), "edges")
    began = written_bytes(spark)
    got = graph.edge_correlation(edges, rows, points, 12).count()
    assert got == edges.count() and written_bytes(spark) - began < 0.2 * edges.count() * 2 * frames * 8


def test_covariances_are_linear_in_frames(spark):
    """Eight times the frames don't take 64 times the work: the trace isn't summed up anew for each of its values."""
    import time

    took = []
    for frames in (2_000, 16_000):
        C = written(spark.range(12).select(F.col("id").alias("unit_id"), F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame")).select("unit_id", F.col("frame").cast("int").alias("frame"), F.rand(3).alias("value")), "C")
        pairs = spark.range(12).select(F.col("id").alias("u1"), F.explode(F.sequence("id", F.lit(11).cast("long"))).alias("u2"))
        began = time.time()
        got = {(r.u1, r.u2): r.cov for r in units.covariances(C, pairs).collect()}
        took.append(time.time() - began)
        x = np.zeros((12, frames))
        for r in C.toPandas().itertuples():
            x[r.unit_id, r.frame] = r.value
        want = np.cov(x, bias=True)
        assert len(got) == 78 and all(v == pytest.approx(want[k], abs=1e-12) for k, v in got.items())
    assert took[1] < 8 * took[0] + 3


def test_mixture_against_plain_steps(spark):
    """The same expectation maximisation in numpy; and what can't be told apart is all upper."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, 80), rng.normal(6, 2, 40), [50.0]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "seed_id long, value double").repartition(3)
    for k in (2, 3):
        w, m, v, was = np.full(k, 1 / k), np.quantile(x, (np.arange(k) + 0.5) / k), np.full(k, x.var() * (1 + 1e-6)), None
        for _ in range(100):
            logs = np.log(w) - 0.5 * np.log(v) - (x[:, None] - m) ** 2 / (2 * v)
            top = np.logaddexp.reduce(logs, axis=1)
            r = np.exp(logs - top[:, None])
            w, m = r.mean(0), (r * x[:, None]).sum(0) / r.sum(0)
            v = (r * (x[:, None] - m) ** 2).sum(0) / r.sum(0) + 1e-6 * x.var()
            if was is not None and top.mean() - was < 1e-6:
                break
            was = top.mean()
        assert np.array(seeds.mixture(df, k)) == pytest.approx(np.stack([w, m, v], axis=1), rel=1e-6)
    odd = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, None), (3, float("nan"))], "seed_id long, value double")
    assert all(r.upper for r in seeds.gaussian_split(odd).collect())
    some = seeds.gaussian_split(df.union(spark.createDataFrame([(900, None), (901, float("inf"))], "seed_id long, value double"))).collect()
    assert not any(r.upper for r in some if r.seed_id >= 900) and sum(r.upper for r in some) > 10
