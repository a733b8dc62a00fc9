"""The movie data source, and decoders held against encoders of the tests' own."""

import struct
import zlib

import numpy as np
import pytest

from glintframe.sources import codecs, movies, video
from tests.test_engine import array_of, movie_of

SHAPE = (23, 6, 7)


@pytest.fixture(scope="module")
def film():
    return np.random.default_rng(5).integers(0, 256, SHAPE, dtype=np.uint8)


@pytest.mark.parametrize("layout", ["raw", "avi", "tif"])
def test_round_trip_and_filters(spark, tmp_path, film, layout):
    path = str(tmp_path / "film")
    movies.write_movie(movie_of(spark, film), path, layout, frames_a_file=5)
    size = {"height": 6, "width": 7} if layout == "raw" else {}
    whole = movies.read_movie(spark, path, layout=layout, frames_a_task=3, **size)
    assert (array_of(whole, SHAPE) == film).all() and whole.count() == film.size
    got = array_of(whole.where("frame between 4 and 11 and height >= 2 and height < 5 and width = 3"), SHAPE)
    want = np.full(SHAPE, np.nan)
    want[4:12, 2:5, 3] = film[4:12, 2:5, 3]
    assert np.array_equal(got, want, equal_nan=True)
    some = whole.where("frame in (2, 20, 99) and value > 100")
    assert sorted((r.frame, r.height, r.width) for r in some.collect()) == sorted((n, y, x) for n in (2, 20) for y, x in zip(*np.nonzero(film[n] > 100)))
    assert whole.where("frame > 500").count() == 0
    with pytest.raises(Exception):
        movies.write_movie(movie_of(spark, film), path, layout)  # there already
    movies.write_movie(movie_of(spark, film[:4]), path, layout, overwrite=True)
    assert movies.read_movie(spark, path, layout=layout, **size).select("frame").distinct().count() == 4


def test_filters_become_byte_ranges(tmp_path, film):
    """What is read shrinks with the filter, by frames and, of plain bytes, by rows."""
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains

    (tmp_path / "a.raw").write_bytes(film.tobytes())

    def planned(*filters):
        r = movies.MovieReader({"path": str(tmp_path / "a.raw"), "height": "6", "width": "7"})
        left = list(r.pushFilters(list(filters)))
        return sum(p.bytes() for p in r.partitions()), len(left)

    assert planned() == (film.size, 0)
    assert planned(GreaterThanOrEqual(("frame",), 10), LessThan(("frame",), 12)) == (2 * 42, 0)
    assert planned(In(("frame",), (1, 7, 400, None))) == (2 * 42, 0)
    assert planned(EqualTo(("frame",), 3), GreaterThanOrEqual(("height",), 4)) == (2 * 7, 0)
    assert planned(EqualTo(("value",), 3), StringContains(("frame",), "x"), EqualTo(("frame",), 2.5)) == (film.size, 3)


def test_failed_writes_leave_nothing(spark, tmp_path, film):
    path = tmp_path / "film"
    from pyspark.sql import functions as F

    broken = movie_of(spark, film).withColumn("value", F.when(F.col("frame") == 21, F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(Exception):
        movies.write_movie(broken, str(path), frames_a_file=2)
    assert not path.exists() or not list(path.iterdir())
    with pytest.raises(FileNotFoundError):
        movies.files_of(str(tmp_path), "*.none")


def pack_bits(raw):
    out = b""
    for k in range(0, len(raw), 100):
        part = raw[k : k + 100]
        out += bytes([257 - len(part)]) + part[:1] if len(part) > 1 and len(set(part)) == 1 else bytes([len(part) - 1]) + part
    return out + b"\x80"


def pack_lzw(raw):
    bits, width, table, last = [], 9, {bytes([k]): k for k in range(256)}, b""
    put = lambda code: bits.append(format(code, f"0{width}b"))
    put(256)
    n = 258
    for byte in raw:
        now = last + bytes([byte])
        if now in table:
            last = now
            continue
        put(table[last])
        table[now] = n
        n += 1
        if n == 4094:
            put(256)
            table, n, width = {bytes([k]): k for k in range(256)}, 258, 9
        elif n == (1 << width) - 1 + 1:
            width += 1
        last = bytes([byte])
    if last:
        put(table[last])
        n += 1
        if n == (1 << width) and width < 12:
            width += 1
    put(257)
    text = "".join(bits)
    return bytes(int(text[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(text), 8))


def tif(pages, order, kind, scheme, predictor, tile=None):
    """A TIFF of pages in strips of two rows, or in tiles of 16 x 16."""
    pack = {1: bytes, 5: pack_lzw, 8: zlib.compress, 32946: zlib.compress, 32773: pack_bits}[scheme]
    out, link = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0)), 4
    for im in pages:
        h, w = im.shape
        if tile:
            full = np.zeros((-(-h // 16) * 16, -(-w // 16) * 16), dtype=im.dtype)
            full[:h, :w] = im
            parts = [full[y : y + 16, x : x + 16] for y in range(0, h, 16) for x in range(0, w, 16)]
        else:
            parts = [im[y : y + 2] for y in range(0, h, 2)]
        if predictor == 2:
            parts = [np.diff(p, axis=1, prepend=p.dtype.type(0)).astype(p.dtype) for p in parts]
        raws = [pack(p.astype(order + kind).tobytes()) for p in parts]
        offsets = []
        for r in raws:
            offsets.append(len(out))
            out += r
        lists = []
        for values in (offsets, [len(r) for r in raws]):
            lists.append(values[0] if len(values) == 1 else len(out))
            out += b"" if len(values) == 1 else struct.pack(f"{order}{len(values)}I", *values)
        where = [(322, 4, 1, 16), (323, 4, 1, 16), (324, 4, len(raws), lists[0]), (325, 4, len(raws), lists[1])] if tile else [(273, 4, len(raws), lists[0]), (278, 4, 1, 2), (279, 4, len(raws), lists[1])]
        tags = sorted([(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 8 * int(kind[1])), (259, 3, 1, scheme), (317, 3, 1, predictor), *where])
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags))
        for tag, code, n, v in tags:
            out += struct.pack(order + "HHI", tag, code, n) + (struct.pack(order + "HH", v, 0) if code == 3 else struct.pack(order + "I", v))
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


@pytest.mark.parametrize("scheme", [1, 5, 8, 32946, 32773])
def test_compressed_tiff(tmp_path, scheme):
    rng = np.random.default_rng(scheme)
    for order in "<>":
        for kind, top in (("u1", 256), ("u2", 65536)):
            for predictor in (1, 2):
                for tile in (None, 16):
                    pages = [rng.integers(0, top, (37, 21)).astype(kind), (np.indices((37, 21)).sum(0) // 9).astype(kind)]
                    (tmp_path / "a.tif").write_bytes(tif(pages, order, kind, scheme, predictor, tile))
                    r = movies.MovieReader({"path": str(tmp_path / "a.tif")})
                    got = np.concatenate([b.column("value").to_numpy() for p in r.partitions() for b in r.read(p)]).reshape(2, 37, 21)
                    assert (got == np.array(pages)).all(), (order, kind, predictor, tile)


def test_lzw_of_long_inputs():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5000, 70_000):
        raw = rng.choice(np.frombuffer(b"abcdef", dtype=np.uint8), n, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05]).tobytes()
        assert codecs.unpack_lzw(pack_lzw(raw)) == raw
    with pytest.raises(ValueError):
        codecs.unpack(b"", 7)


def jpeg(im, quality=1, restart=0, colour=False, tables=True, sub=1):
    """A baseline JPEG of a grey picture, or of a colour one whose brightness it is, with the common Huffman tables."""
    h, w = im.shape
    q = np.full(64, quality, dtype=np.uint8)

    def code_of(kind, k):
        counts, values = codecs.COMMON[kind, k]
        out, code, at = {}, 0, 0
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                out[values[at]] = format(code, f"0{n}b")
                code, at = code + 1, at + 1
            code <<= 1
        return out

    bits, last = [], {}
    size = 8 * (sub if colour else 1)
    full = np.pad(im, ((0, -h % size), (0, -w % size)), mode="edge").astype(float) - 128
    units = [(y, x) for y in range(0, full.shape[0], size) for x in range(0, full.shape[1], size)]
    data, parts = b"", []

    def block(c, values, tab):
        k = codecs.COSINES @ values @ codecs.COSINES.T
        z = np.rint(k.ravel()[codecs.ZIGZAG] / q).astype(int).tolist()
        diff, last[c] = z[0] - last.get(c, 0), z[0]
        number = lambda v: format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b") if v else ""
        bits.append(code_of(0, tab)[abs(diff).bit_length()] + number(diff))
        run, ac = 0, code_of(1, tab)
        end = max((i for i in range(1, 64) if z[i]), default=0)
        for v in z[1 : end + 1]:
            if not v:
                run += 1
                continue
            while run > 15:
                bits.append(ac[0xF0])
                run -= 16
            bits.append(ac[run << 4 | abs(v).bit_length()] + number(v))
            run = 0
        if end < 63:
            bits.append(ac[0])

    def close():
        text = "".join(bits)
        text += "1" * (-len(text) % 8)
        bits.clear()
        last.clear()
        return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")

    for n, (y, x) in enumerate(units):
        if restart and n and n % restart == 0:
            parts.append(close())
        for dy in range(0, size, 8):
            for dx in range(0, size, 8):
                block(0, full[y + dy : y + dy + 8, x + dx : x + dx + 8], 0)
        if colour:
            for c in (1, 2):
                block(c, np.full((8, 8), 10.0 * c), 1)
    parts.append(close())
    for k, p in enumerate(parts):
        data += (b"\xff" + bytes([0xD0 + (k - 1) % 8]) if k else b"") + p
    seg = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    ids = [1, 2, 3] if colour else [1]
    out = b"\xff\xd8" + seg(0xE0, b"AVI1") + seg(0xDB, b"\0" + q.tobytes())
    out += seg(0xC0, struct.pack(">BHHB", 8, h, w, len(ids)) + b"".join(bytes([i, 0x11 * (sub if i == 1 and colour else 1), 0]) for i in ids))
    if tables:
        out += seg(0xC4, b"".join(bytes([kind << 4 | k]) + counts + values for (kind, k), (counts, values) in codecs.COMMON.items()))
    out += seg(0xDD, struct.pack(">H", restart)) if restart else b""
    return out + seg(0xDA, bytes([len(ids)]) + b"".join(bytes([i, 0x11 if i > 1 else 0]) for i in ids) + b"\0\x3f\0") + data + b"\xff\xd9"


@pytest.mark.parametrize("args", [{}, {"restart": 2}, {"tables": False}, {"colour": True}, {"colour": True, "sub": 2, "restart": 1}, {"colour": True, "sub": 2, "tables": False}])
def test_jpeg(args):
    rng = np.random.default_rng(2)
    for shape in ((16, 24), (13, 21), (8, 8), (40, 33)):
        smooth = np.clip(np.add.outer(np.arange(shape[0]) * 3, np.arange(shape[1]) * 2) + rng.integers(0, 9, shape), 0, 255).astype(np.uint8)
        for im in (smooth, rng.integers(0, 256, shape, dtype=np.uint8), np.full(shape, 200, dtype=np.uint8)):
            assert np.abs(codecs.jpeg_grey(jpeg(im, **args)).astype(int) - im).max() <= 1
    raw = jpeg(rng.integers(0, 256, (16, 16), dtype=np.uint8))
    for bad in (raw[: len(raw) // 2], b"", raw[:2], raw.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            codecs.jpeg_grey(bad)


def test_motion_jpeg(spark, tmp_path, film):
    """An AVI of JPEG pictures, with an index and without one, dealt by ranges of frames."""
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    _, h, w = SHAPE
    for index in (True, False):
        bodies = [jpeg(im, tables=k % 2 == 0) for k, im in enumerate(film)]
        movi, at, rows = b"movi", 4, b""
        for b in bodies:
            rows += struct.pack("<4sIII", b"00dc", 16, at, len(b))
            c = chunk(b"00dc", b)
            movi, at = movi + c, at + len(c)
        strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", 0, 0, 0, 0, 0)
        body = b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"LIST", b"strl" + chunk(b"strf", strf))) + chunk(b"LIST", movi) + (chunk(b"idx1", rows) if index else b"")
        (tmp_path / f"f{index}.avi").write_bytes(chunk(b"RIFF", body))
        got = array_of(movies.read_movie(spark, str(tmp_path / f"f{index}.avi"), frames_a_task=4), SHAPE)
        assert np.abs(got - film).max() <= 1
        few = movies.read_movie(spark, str(tmp_path / f"f{index}.avi"), frames_a_task=4).where("frame >= 20")
        assert few.count() == 3 * h * w
    assert (array_of(video.load(spark, str(tmp_path), video.avi_frames, glob="fTrue.avi"), SHAPE) == array_of(movies.read_movie(spark, str(tmp_path / "fTrue.avi")), SHAPE)).all()


def read_netcdf(raw):
    """A reader of the classic format: (dimensions, attributes, {variable: (dimension names, array)})."""
    at = [4]

    def word():
        at[0] += 4
        return struct.unpack_from(">I", raw, at[0] - 4)[0]

    def text():
        n = word()
        out = raw[at[0] : at[0] + n].decode()
        at[0] += -(-n // 4) * 4
        return out

    def attributes():
        tag, n = word(), word()
        assert (tag, n) == (0, 0) or tag == 12
        out = {}
        for _ in range(n):
            key = text()
            assert word() == 2
            out[key] = text()
        return out

    assert raw[:4] == b"CDF\x02" and word() == 0 and word() == 10
    dims = [(text(), word()) for _ in range(word())]
    atts, out = attributes(), {}
    assert word() == 11
    for _ in range(word()):
        name = text()
        ids = [word() for _ in range(word())]
        attributes()
        kind = {4: ">i4", 5: ">f4", 6: ">f8"}[word()]
        size, begin = word(), struct.unpack_from(">Q", raw, at[0])[0]
        at[0] += 8
        shape = [dims[i][1] for i in ids]
        n = int(np.prod(shape))
        assert size == -(-n * np.dtype(kind).itemsize // 4) * 4 and begin % 4 == 0
        out[name] = ([dims[i][0] for i in ids], np.frombuffer(raw, dtype=kind, count=n, offset=begin).reshape(shape))
    return dict(dims), atts, out


def test_netcdf(spark, tmp_path, film):
    from pyspark.sql import functions as F

    from glintframe.sources import netcdf

    movie = movie_of(spark, film)
    holes = movie.where("not (frame = 3 and height = 2) and frame <> 7").withColumn("frame", F.col("frame") * 2 + 10)
    path = str(tmp_path / "a" / "film.nc")
    netcdf.write_netcdf(holes, path, attributes={"animal": "m1", "säson": "2"}, slab=4)
    dims, atts, got = read_netcdf((tmp_path / "a" / "film.nc").read_bytes())
    assert dims == {"frame": 22, "height": 6, "width": 7} and atts == {"animal": "m1", "säson": "2"}
    frames = [n for n in range(23) if n != 7]
    assert got["frame"][1].tolist() == [2 * n + 10 for n in frames] and got["height"][1].tolist() == list(range(6))
    want = film[frames].astype(float)
    want[3, 2] = np.nan
    assert got["value"][0] == ["frame", "height", "width"] and np.array_equal(got["value"][1], want, equal_nan=True)
    with pytest.raises(FileExistsError):
        netcdf.write_netcdf(holes, path)
    for kind in ("f4", "i4"):
        netcdf.write_netcdf(movie, path, kind=kind, name="Y", overwrite=True, slab=1)
        assert (read_netcdf((tmp_path / "a" / "film.nc").read_bytes())[2]["Y"][1] == film).all()
    traces = spark.createDataFrame([(5, 0.5, 1.0), (2, 1.5, 2.0), (None, 0.5, 9.0)], "unit_id long, t double, value double")
    netcdf.write_netcdf(traces, path, dims=("unit_id", "t"), overwrite=True)
    told = read_netcdf((tmp_path / "a" / "film.nc").read_bytes())[2]
    assert told["t"][1].tolist() == [0.5, 1.5] and np.array_equal(told["value"][1], [[np.nan, 2.0], [1.0, np.nan]], equal_nan=True)
    netcdf.write_netcdf(traces.limit(0), path, dims=("unit_id", "t"), overwrite=True)
    assert read_netcdf((tmp_path / "a" / "film.nc").read_bytes())[0] == {"unit_id": 0, "t": 0}
    (tmp_path / "a" / "film.nc").unlink()
    broken = movie.withColumn("value", F.when(F.col("frame") == 21, F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(Exception):
        netcdf.write_netcdf(broken, path)
    assert list((tmp_path / "a").iterdir()) == []
    with pytest.raises(ValueError):
        netcdf.write_netcdf(movie, "s3://bucket/film.nc")


def zarr_store(folder, a, chunks, dims, *, kind="<f8", order="C", compressor=None, fill=0, sep=".", leave=()):
    """A version 2 array, chunk by chunk; `leave` are chunks of fill values that aren't stored."""
    import gzip
    import json
    from itertools import product

    folder.mkdir(parents=True)
    meta = {"zarr_format": 2, "shape": list(a.shape), "chunks": list(chunks), "dtype": kind, "order": order, "compressor": compressor and {"id": compressor, "level": 1}, "fill_value": fill, "filters": None, "dimension_separator": sep}
    (folder / ".zarray").write_text(json.dumps(meta))
    (folder / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": list(dims)}))
    for at in product(*(range(-(-n // c)) for n, c in zip(a.shape, chunks))):
        if at in leave:
            continue
        full = np.zeros(chunks, dtype=kind)
        part = a[tuple(slice(k * c, (k + 1) * c) for k, c in zip(at, chunks))]
        full[tuple(slice(0, n) for n in part.shape)] = part
        raw = full.tobytes(order=order)
        raw = {None: bytes, "zlib": zlib.compress, "gzip": gzip.compress}[compressor](raw)
        f = folder / sep.join(map(str, at))
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(raw)


@pytest.mark.parametrize("args", [{}, {"compressor": "zlib", "kind": ">i2"}, {"compressor": "gzip", "order": "F", "sep": "/"}, {"kind": "|u1", "fill": 7, "leave": ((1, 0, 0), (2, 1, 1))}, {"fill": "NaN", "leave": ((0, 0, 0),), "compressor": "zlib"}])
def test_zarr(spark, tmp_path, film, args):
    from glintframe.sources import zarr

    chunks, want = (10, 4, 5), film.astype(float)
    for at in args.get("leave", ()):
        want[tuple(slice(k * c, (k + 1) * c) for k, c in zip(at, chunks))] = float(args["fill"])
    zarr_store(tmp_path / "Y", film, chunks, ("frame", "height", "width"), **args)
    whole = zarr.read_zarr(spark, str(tmp_path / "Y"), 3)
    assert whole.columns == ["frame", "height", "width", "value"]
    assert np.array_equal(array_of(whole, SHAPE), want, equal_nan=True) and whole.count() == film.size
    some = whole.where("frame >= 8 and frame < 12 and height in (1, 5) and width > 4")
    assert sorted((r.frame, r.height, r.width) for r in some.collect()) == [(n, y, x) for n in range(8, 12) for y in (1, 5) for x in (5, 6)]
    # coordinates beside the array take the place of places
    zarr_store(tmp_path / "frame", np.arange(23) * 2 + 100, (8,), ("frame",), kind="<i8", compressor="zlib")
    assert {r.frame for r in zarr.read_zarr(spark, str(tmp_path / "Y")).where("frame > 140").select("frame").distinct().collect()} == {142, 144}


def test_zarr_reads_no_other_chunks(tmp_path, film):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    from glintframe.sources import zarr

    zarr_store(tmp_path / "Y", film, (5, 2, 7), ("frame", "height", "width"))
    r = zarr.ZarrReader({"path": str(tmp_path / "Y")})
    left = list(r.pushFilters([GreaterThanOrEqual(("frame",), 4), LessThan(("frame",), 6), EqualTo(("height",), 3), EqualTo(("value",), 1)]))
    assert len(left) == 1 and [c for p in r.partitions() for c in p.at] == [(0, 1, 0), (1, 1, 0)]
    none = zarr.ZarrReader({"path": str(tmp_path / "Y")})
    list(none.pushFilters([EqualTo(("frame",), 900)]))
    assert [c for p in none.partitions() for c in p.at] == []
    with pytest.raises(FileNotFoundError):
        zarr.Array(str(tmp_path / "no"))
    with pytest.raises(ValueError):
        zarr.unpacker({"id": "blosc"})
