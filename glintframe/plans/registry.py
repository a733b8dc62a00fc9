"""All queries of the imaging engine, with the SQL they are held against.

Values that aren't exact in binary are rounded to six digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glintframe.functions import expr
from glintframe.operators import PIXEL, graph, motion, project, seeds, signal, stencil, units
from glintframe.plans.adapters import SIDE, Inputs, sql
from glintframe.runtime import scratch, written
from glintframe.sources import catalog

_queries: dict = {}
_sql: dict[str, str] = {}


def query(name: str, oracle: str | None = None, digits: int | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(Inputs(spark, sf_dir))
            if digits is not None:
                out = out.withColumns({c: F.round(c, digits) + F.lit(0.0) for c, t in out.dtypes if t == "double"})
            return out

        _queries[name] = run
        if oracle:
            _sql[name] = oracle
        return fn

    return add


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- projections, selections, set operations --------------------------------

query("topk_deglowed", sql("L", """, m AS (SELECT height, width, min(value) AS lo, max(value) AS hi FROM L GROUP BY ALL)
    SELECT height, width, hi - lo AS value FROM m ORDER BY value DESC, height, width LIMIT 10"""))(
    lambda i: project.top_pixels(project.projection(project.deglow(i.L)), 10)
)
query("deglow_min", sql("L", "SELECT frame, height, width, value - min(value) OVER (PARTITION BY height, width) AS value FROM L"))(lambda i: project.deglow(i.L))
query("deglow_scaled", sql("E", "SELECT frame, height, width, round(value - 0.7 * min(value) OVER (PARTITION BY height, width), 6) + 0.0 AS value FROM E"), 6)(lambda i: project.deglow(i.E, 0.7))
for _how, _fn in (("max", "max"), ("min", "min"), ("mean", "avg")):
    query(f"proj_{_how}", sql("E", f"SELECT height, width, round({_fn}(value), 6) + 0.0 AS value FROM E GROUP BY ALL"), 6)(lambda i, how=_how: project.projection(i.E, how))
query("proj_max_subset", sql("L", "SELECT height, width, max(value) AS value FROM L WHERE frame % 3 = 0 GROUP BY ALL"))(
    lambda i: project.projection(i.L, "max", i.L.where("frame % 3 = 0").select("frame"))
)
query("frame_stride", sql("L", "SELECT * FROM L WHERE frame % 5 = 0"))(lambda i: project.stride(i.L, 5))
query("coarsen_mean", sql("L", """SELECT (frame - frame % 3)::INT AS frame, (height - height % 2)::INT AS height, (width - width % 5)::INT AS width, round(avg(value), 6) + 0.0 AS value
    FROM L GROUP BY frame - frame % 3, height - height % 2, width - width % 5 HAVING count(*) = 30"""), 6)(lambda i: project.coarsen(i.L, 3, 2, 5))  # fmt: skip
query("clip_nonneg", sql("L", "SELECT frame, height, width, greatest(value - 100.0, 0.0) AS value FROM L"))(lambda i: project.clip(i.L.withColumn("value", F.col("value") - 100.0)))
query("crop_pixels", sql("L bright", "SELECT L.* FROM L SEMI JOIN bright USING (height, width) WHERE frame BETWEEN 10 AND 40"))(lambda i: project.crop(project.select_pixels(i.L, i.bright), frame=(10, 40)))
query("concat_frames", sql("L", """SELECT * FROM L UNION ALL SELECT (frame + (SELECT max(frame) + 1 FROM L))::INT, height, width, value * 2 FROM L
    UNION ALL SELECT (frame + 2 * (SELECT max(frame) + 1 FROM L))::INT, height, width, value FROM L"""))(
    lambda i: project.concat([i.L, i.L.withColumn("value", F.col("value") * 2), i.L])
)
query("concat_width", sql("L", "SELECT * FROM L UNION ALL SELECT frame, height, (width + 16)::INT, value + 1 FROM L"))(lambda i: project.concat([i.L, i.L.withColumn("value", F.col("value") + 1)], "width"))
query("merge_datasets", sql("L", """SELECT height, width, hi, lo FROM (SELECT height, width, max(value) AS hi FROM L WHERE height < 11 GROUP BY ALL)
    FULL JOIN (SELECT height, width, min(value) AS lo FROM L WHERE height > 4 GROUP BY ALL) USING (height, width)"""))(
    lambda i: project.merge(project.projection(i.L.where("height < 11")).withColumnRenamed("value", "hi"), project.projection(i.L.where("height > 4"), "min").withColumnRenamed("value", "lo"), PIXEL)
)
query("concat_nested", sql("L", """SELECT frame, height, width, value FROM L UNION ALL SELECT frame, height, (width + 16)::INT, value * 2 FROM L
    UNION ALL SELECT frame, (height + 16)::INT, width, value * 3 FROM L UNION ALL SELECT frame, (height + 16)::INT, (width + 16)::INT, value * 4 FROM L"""))(
    lambda i: project.concat_nested([[i.L.withColumn("value", F.col("value") * (2 * y + x + 1)) for x in range(2)] for y in range(2)], ["height", "width"])
)
query("layout_frames", sql("L", """, n AS (SELECT count(DISTINCT frame) AS f, count(DISTINCT height) AS h, count(DISTINCT width) AS w FROM L),
    s AS (SELECT greatest(floor(65536 / (h * w * 8.0)), 1)::BIGINT AS per, f, h, w FROM n)
    SELECT frame // per AS chunk, count(DISTINCT frame) AS frames, count(*) AS cells, count(*) * 8 AS bytes FROM L, s GROUP BY ALL"""))(lambda i: project.layout_statistics(i.L, 65536))  # fmt: skip
query("split_overlap", sql("L", """SELECT (frame // 20)::INT AS part, * FROM L UNION ALL SELECT (frame // 20 - 1)::INT, * FROM L WHERE frame % 20 = 0 AND frame > 0"""))(lambda i: project.split_overlap(i.L, 20))
query("part_projections", sql("L", """, p AS (SELECT (frame // 20)::INT AS part, * FROM L UNION ALL SELECT (frame // 20 - 1)::INT, * FROM L WHERE frame % 20 = 0 AND frame > 0)
    SELECT part, height, width, max(value - lo) AS value FROM (SELECT *, min(value) OVER (PARTITION BY part, height, width) AS lo FROM p) GROUP BY ALL"""))(
    lambda i: project.projection(project.deglow(project.split_overlap(i.L, 20), by=("part",)), by=("part",))
)

# --- stencils -----------------------------------------------------------------

_REFLECT = f"CASE WHEN {{p}} < 0 THEN -1 - ({{p}}) WHEN {{p}} >= {SIDE} THEN {2 * SIDE - 1} - ({{p}}) ELSE {{p}} END"
_REFLECT101 = f"CASE WHEN {{p}} < 0 THEN -({{p}}) WHEN {{p}} >= {SIDE} THEN {2 * SIDE - 2} - ({{p}}) ELSE {{p}} END"
_REPLICATE = f"least(greatest({{p}}, 0), {SIDE - 1})"


def _box(half: int, agg: str, border: str, where: str = "true", source: str = "L") -> str:
    """SELECT of an aggregate over n.value, the values at (dy, dx) from each pixel;
    those outside are taken from where `border` says, or left out."""
    y, x = (border.format(p=p) if border else p for p in ("c.height + dy", "c.width + dx"))
    return (
        f"SELECT c.frame, c.height, c.width, any_value(c.value) AS own, {agg} FROM (SELECT c.*, ({y})::INT AS ny, ({x})::INT AS nx, dy, dx FROM {source} c, range({-half}, {half + 1}) a(dy), range({-half}, {half + 1}) b(dx) WHERE {where}) c "
        f"JOIN {source} n ON n.frame = c.frame AND n.height = ny AND n.width = nx GROUP BY c.frame, c.height, c.width"
    )


_GAUSS = "list_value(0.0625, 0.25, 0.375, 0.25, 0.0625)"
query("denoise_gaussian", sql("L", f"SELECT frame, height, width, s AS value FROM ({_box(2, f'sum(n.value * {_GAUSS}[(dy + 3)::INT] * {_GAUSS}[(dx + 3)::INT]) AS s', _REFLECT101)})"))(lambda i: stencil.denoise(i.L, "gaussian", 5))
query("denoise_median", sql("L", f"SELECT frame, height, width, m AS value FROM ({_box(1, 'median(n.value) AS m', _REPLICATE)})"))(lambda i: stencil.denoise(i.L, "median", 3))
_LIKE = "exp(-(dy * dy + dx * dx) / (2 * 75.0 * 75.0) - pow(n.value - c.value, 2) / (2 * 75.0 * 75.0))"
query("denoise_bilateral", sql("L", f"SELECT frame, height, width, round(m, 6) + 0.0 AS value FROM ({_box(2, f'sum({_LIKE} * n.value) / sum({_LIKE}) AS m', _REFLECT101, 'dy * dy + dx * dx <= 4')})"), 6)(lambda i: stencil.denoise(i.L, "bilateral", 5))
_FLOW = "coalesce(exp(-pow(({d}) / 50.0, 2)) * ({d}), 0)"
query("denoise_anisotropic", sql("L", f"""SELECT frame, height, width, round(value + 0.1 * ({' + '.join(_FLOW.format(d=f'{k}(value) OVER {w} - value') for k in ('lead', 'lag') for w in ('y', 'x'))}), 6) + 0.0 AS value
    FROM L WINDOW y AS (PARTITION BY frame, width ORDER BY height), x AS (PARTITION BY frame, height ORDER BY width)"""), 6)(lambda i: stencil.denoise(i.L, "anisotropic"))
query("bg_uniform", sql("L", f"SELECT frame, height, width, round(own - m, 6) + 0.0 AS value FROM ({_box(2, 'avg(n.value) AS m', _REFLECT)})"), 6)(lambda i: stencil.remove_background(i.L, "uniform", 5))
_DISK = "dy * dy + dx * dx <= {r2}"
query("dilate", sql("L", f"SELECT frame, height, width, m AS value FROM ({_box(2, 'max(n.value) AS m', '', _DISK.format(r2=4))})"))(lambda i: stencil.dilate(i.L, 2))
query("erode", sql("L", f"SELECT frame, height, width, m AS value FROM ({_box(2, 'min(n.value) AS m', '', _DISK.format(r2=4))})"))(lambda i: stencil.erode(i.L, 2))
query("bg_tophat", sql("L", f""", low AS (SELECT frame, height, width, m AS value FROM ({_box(3, 'min(n.value) AS m', '', _DISK.format(r2=9))})),
    opened AS ({_box(3, 'max(n.value) AS m', '', _DISK.format(r2=9), 'low')})
    SELECT L.frame, L.height, L.width, L.value - m AS value FROM L JOIN opened USING (frame, height, width)"""))(lambda i: stencil.remove_background(i.L, "tophat", 3))  # fmt: skip
query("sobel", sql("L", f"SELECT frame, height, width, 0.5 * abs(gx) + 0.5 * abs(gy) AS value FROM ({_box(1, 'sum(n.value * dx * (2 - abs(dy))) AS gx, sum(n.value * dy * (2 - abs(dx))) AS gy', _REFLECT101)})"))(lambda i: stencil.sobel(i.L))
for _kind, _own in (("max", "hi"), ("min", "lo")):
    query(f"local_extreme_{_kind}", sql("L", f"SELECT frame, height, width, own AS value, own = {_own} AND hi - lo > 3 AS extreme FROM ({_box(2, 'max(n.value) AS hi, min(n.value) AS lo', '', _DISK.format(r2=4))})"))(
        lambda i, kind=_kind: stencil.local_extreme(i.L, 2, kind, 3)
    )


def _tops(source: str, first: int, last: int, diff: float) -> str:
    """CTEs `tops` (pixels that are a maximum at some radius) and `spots` (one per region)."""
    parts = " UNION ".join(f"SELECT frame, height, width FROM ({_box(r, 'max(n.value) AS hi, min(n.value) AS lo', '', _DISK.format(r2=r * r), source)}) WHERE own = hi AND hi - lo > {diff}" for r in range(first, last))
    return f""", tops AS (SELECT (frame * 65536 + height * 256 + width)::BIGINT AS id, * FROM ({parts})),
    touch AS (SELECT a.id AS a, b.id AS b FROM tops a JOIN tops b ON a.frame = b.frame AND abs(a.height - b.height) <= 1 AND abs(a.width - b.width) <= 1),
    reach(a, b) AS (SELECT id, id FROM tops UNION SELECT reach.a, touch.b FROM reach JOIN touch ON reach.b = touch.a),
    spots AS (SELECT frame, floor(quantile_cont(height, 0.5))::INT AS height, floor(quantile_cont(width, 0.5))::INT AS width FROM tops JOIN (SELECT a, min(b) AS g FROM reach GROUP BY a) ON a = id GROUP BY frame, g)"""


query("local_max_roll", sql("L", _tops("L", 1, 4, 3) + " SELECT frame, height, width FROM spots", True))(lambda i: graph.region_centres(stencil.local_max_any(i.L, 1, 4, 3).where("extreme")))


query("region_labels", sql("L", """, m AS (SELECT frame, height, width, (height * 256 + width) AS id FROM L WHERE value > (SELECT 1.5 * avg(value) FROM L)),
    touch AS (SELECT a.frame, a.id AS a, b.id AS b FROM m a JOIN m b ON a.frame = b.frame AND abs(a.height - b.height) + abs(a.width - b.width) <= 1),
    reach(frame, a, b) AS (SELECT frame, id, id FROM m UNION SELECT r.frame, r.a, t.b FROM reach r JOIN touch t ON r.frame = t.frame AND r.b = t.a)
    SELECT m.frame, height, width, (dense_rank() OVER (PARTITION BY m.frame ORDER BY g))::INT AS label FROM m JOIN (SELECT frame, a, min(b) AS g FROM reach GROUP BY ALL) r ON r.frame = m.frame AND a = id""", True))(
    lambda i: graph.region_labels(i.L.crossJoin(F.broadcast(i.L.agg((F.avg("value") * 1.5).alias("t")))).where("value > t"))
)


def _bright_parts(i: Inputs) -> DataFrame:
    return i.L.crossJoin(F.broadcast(i.L.agg(F.avg("value").alias("t")))).where("value > t")


_PARTS = ", m AS (SELECT frame, height, width FROM L WHERE value > (SELECT avg(value) FROM L))"
query("contour_pixels", sql("L", _PARTS + """ SELECT frame, height, width FROM m WHERE (SELECT count(*) FROM m n
    WHERE n.frame = m.frame AND abs(n.height - m.height) + abs(n.width - m.width) = 1) < 4"""))(
    lambda i: graph.contours(_bright_parts(i)).select("frame", *PIXEL).distinct()
)
query("contour_counts", sql("L", _PARTS + f""", e AS (SELECT frame, height, width FROM L ANTI JOIN m USING (frame, height, width)),
    p AS (SELECT 'm' AS kind, frame, height * 256 + width AS id, height, width FROM m UNION ALL SELECT 'e', frame, height * 256 + width, height, width FROM e),
    touch AS (SELECT a.kind, a.frame, a.id AS a, b.id AS b FROM p a JOIN p b ON a.kind = b.kind AND a.frame = b.frame AND abs(a.height - b.height) <= 1 AND abs(a.width - b.width) <= 1
      AND (a.kind = 'm' OR abs(a.height - b.height) + abs(a.width - b.width) <= 1)),
    reach(kind, frame, a, b) AS (SELECT kind, frame, id, id FROM p UNION SELECT r.kind, r.frame, r.a, t.b FROM reach r JOIN touch t ON r.kind = t.kind AND r.frame = t.frame AND r.b = t.a),
    part AS (SELECT kind, frame, a, min(b) AS g, bool_or(b // 256 IN (0, {SIDE - 1}) OR b % 256 IN (0, {SIDE - 1})) AS outside FROM reach GROUP BY kind, frame, a)
    SELECT frame, count(DISTINCT g) FILTER (kind = 'm') AS outer_borders, count(DISTINCT g) FILTER (kind = 'e' AND NOT outside) AS holes FROM part GROUP BY frame
    HAVING count(*) FILTER (kind = 'm') > 0""", True))(
    lambda i: graph.contours(_bright_parts(i)).where("place = 0").groupBy("frame").agg(F.count_if(~F.col("hole")).alias("outer_borders"), F.count_if("hole").alias("holes"))
)


def _frames(df: DataFrame) -> int:
    return df.agg(F.max("frame") + 1).first()[0]


_WINDOWS = """, n AS (SELECT max(frame) + 1 AS n, (ceil((max(frame) + 1) / 10.0) + 1)::INT AS k FROM L),
    win AS (SELECT i, greatest(floor(i * (n - 1.0) / (k - 1) - 15), 0) AS a, least(ceil(i * (n - 1.0) / (k - 1) + 15), n) AS b FROM n, LATERAL (SELECT unnest(range(k)) AS i)),
    shots AS (SELECT i::INT AS frame, height, width, max(value) AS value FROM L JOIN win ON L.frame >= a AND L.frame < b GROUP BY ALL)"""
query("window_projections", sql("L", _WINDOWS + ' SELECT frame AS "window", height, width, value FROM shots'))(lambda i: project.window_projections(i.L, project.rolling_windows(_frames(i.L), 30, 10)))
query("seeds_init", sql("L", _WINDOWS + _tops("shots", 2, 4, 2) + """, votes AS (SELECT height, width, count(DISTINCT frame)::INT AS seeds FROM spots GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY height, width) - 1 AS seed_id, height, width, seeds FROM votes""", True))(lambda i: seeds.find(i.L, _frames(i.L), 30, 10, 4, 2))  # fmt: skip
#: The draws from the movie's 83 frames, which its seed fixes.
_DRAWN = ", ".join(f"({i}, {f})" for i, fs in project.random_windows(83, 20, 5) for f in sorted(set(fs)))
query("seeds_init_random", sql("L", f", shots AS (SELECT i::INT AS frame, height, width, max(value) AS value FROM L JOIN (VALUES {_DRAWN}) d(i, f) ON L.frame = f GROUP BY ALL)" + _tops("shots", 2, 4, 2) + """,
    votes AS (SELECT height, width, count(DISTINCT frame)::INT AS seeds FROM spots GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY height, width) - 1 AS seed_id, height, width, seeds FROM votes""", True))(lambda i: seeds.find(i.L, _frames(i.L), 20, 10, 4, 2, method="random", draws=5))  # fmt: skip

# --- stored layouts -------------------------------------------------------------


def _stored(i: Inputs, layout: str) -> DataFrame:
    """L, written in a layout and read back."""
    return catalog.save(i.L, scratch(i.spark, "layouts"), "L", layout=layout)


query("stored_by_frame", sql("L", f""", d AS (SELECT frame, height, width, m AS value FROM ({_box(2, 'max(n.value) AS m', '', _DISK.format(r2=4))}))
    SELECT frame, height, width, 0.5 * abs(gx) + 0.5 * abs(gy) AS value FROM ({_box(1, 'sum(n.value * dx * (2 - abs(dy))) AS gx, sum(n.value * dy * (2 - abs(dx))) AS gy', _REFLECT101, source='d')})"""))(
    lambda i: stencil.sobel(stencil.dilate(_stored(i, "frames"), 2))
)


@query("stored_by_pixel", sql("L", """, D AS (SELECT height, width, frame, value - min(value) OVER (PARTITION BY height, width) AS value FROM L),
    T AS (SELECT (height * 256 + width) AS unit_id, frame, value FROM D), n AS (SELECT count(DISTINCT frame) AS n FROM T), bins AS (SELECT unnest(range(round_even(0.25 * n, 0)::INT, round_even(0.5 * n, 0)::INT)) AS k, n FROM n),
    power AS (SELECT unit_id, k, (pow(sum(value * cos(2 * pi() * k * frame / n)), 2) + pow(sum(value * sin(2 * pi() * k * frame / n)), 2)) / any_value(n) AS p FROM T, bins GROUP BY ALL),
    sn AS (SELECT unit_id, sqrt(exp(avg(ln(p + 2.220446049250313e-16)))) AS sn FROM power GROUP BY unit_id), top AS (SELECT height, width, max(value) AS peak FROM D GROUP BY ALL)
    SELECT height, width, peak, round(sn, 6) + 0.0 AS sn, peak > 4.5 * sn AS kept FROM top JOIN sn ON unit_id = height * 256 + width"""), 6)
def _stored_by_pixel(i: Inputs) -> DataFrame:
    movie = project.deglow(_stored(i, "pixels"))
    noise = signal.noise(movie, keys=tuple(PIXEL))
    return project.projection(movie).withColumnRenamed("value", "peak").join(noise, PIXEL).withColumn("kept", F.col("peak") > 4.5 * F.col("sn"))


# --- percentiles, thresholds, masks -------------------------------------------

query("ptp_q", sql("E", "SELECT height, width, round(quantile_cont(value, 0.999) - quantile_cont(value, 0.001), 6) + 0.0 AS ptp FROM E GROUP BY ALL"), 6)(lambda i: signal.ptp(i.E, keys=tuple(PIXEL)))
query("pixel_percentiles", sql("E", "SELECT height, width, round(quantile_cont(value, 0.25), 6) + 0.0 AS q25, round(quantile_cont(value, 0.5), 6) + 0.0 AS q50, round(quantile_cont(value, 0.9), 6) + 0.0 AS q90 FROM E GROUP BY ALL"), 6)(
    lambda i: signal.percentiles(i.E, (25, 50, 90), tuple(PIXEL))
)
query("intensity_refine", sql("L bright", """, img AS (SELECT height, width, max(value) AS v FROM L GROUP BY ALL),
    s AS (SELECT min(v) AS lo, max(v) AS hi, round_even(count(*) / 10.0, 0)::INT AS k FROM img),
    h AS (SELECT least(floor((v - lo) / ((hi - lo) / k)), k - 1)::INT AS bin, count(*) AS c FROM img, s GROUP BY ALL),
    top AS (SELECT arg_max(bin, (c, -bin)) AS bin FROM h),
    t AS (SELECT lo + round_even(bin * 0.5, 0) * ((hi - lo) / k) AS threshold FROM top, s)
    SELECT seed_id, height, width, v > threshold AS mask_int FROM bright LEFT JOIN img USING (height, width), t"""))(lambda i: seeds.intensity_refine(project.projection(i.L), i.bright, 0.5))  # fmt: skip
query("seed_mask_conjunction", sql("L bright", "SELECT row_number() OVER (ORDER BY height, width) - 1 AS seed_id, height, width FROM bright WHERE height % 2 = 0 AND width % 3 > 0"))(
    lambda i: seeds.combined(i.bright.withColumns({"mask_a": F.col("height") % 2 == 0, "mask_b": F.col("width") % 3 > 0}), "mask_a", "mask_b").drop("mask_a", "mask_b")
)

# --- traces -------------------------------------------------------------------

_BAND = """, n AS (SELECT count(DISTINCT frame) AS n FROM T), bins AS (SELECT unnest(range(round_even(0.25 * n, 0)::INT, round_even(0.5 * n, 0)::INT)) AS k, n FROM n),
    power AS (SELECT unit_id, k, (pow(sum(value * cos(2 * pi() * k * frame / n)), 2) + pow(sum(value * sin(2 * pi() * k * frame / n)), 2)) / any_value(n) AS p FROM T, bins GROUP BY ALL)"""
for _method, _sum in (("logmexp", "sqrt(exp(avg(ln(p + 2.220446049250313e-16))))"), ("mean", "sqrt(avg(p))"), ("sum", "sqrt(sum(p))"), ("median", "sqrt(median(p))")):
    query(f"noise_fft_{_method}", sql("T", f"{_BAND} SELECT unit_id, round({_sum}, 6) + 0.0 AS sn FROM power GROUP BY unit_id"), 6)(lambda i, m=_method: signal.noise(i.T, method=m))
query("noise_welch", sql("T", """, n AS (SELECT count(DISTINCT frame) AS n FROM T), wt AS (SELECT f, n, 0.5 - 0.5 * cos(2 * pi() * f / n) AS w FROM n, LATERAL (SELECT unnest(range(n)) AS f)),
    x AS (SELECT unit_id, frame, n, w * (value - avg(value) OVER (PARTITION BY unit_id)) AS x FROM T JOIN wt ON f = frame),
    pw AS (SELECT unit_id, k, (pow(sum(x * cos(2 * pi() * k * frame / n)), 2) + pow(sum(x * sin(2 * pi() * k * frame / n)), 2)) / (SELECT sum(w * w) FROM wt) AS p
      FROM x, range(1, 129) r(k) WHERE k > 0.25 * n AND k < 0.5 * n GROUP BY ALL)
    SELECT unit_id, round(sqrt(exp(avg(ln(p)))), 6) + 0.0 AS sn FROM pw GROUP BY unit_id"""), 6)(lambda i: signal.noise(i.T, estimator="welch"))  # fmt: skip
_LOW = """, n AS (SELECT count(DISTINCT frame) AS n, floor(0.25 * count(DISTINCT frame))::INT AS c FROM T),
    kern AS (SELECT d, (1 + 2 * coalesce((SELECT sum(cos(2 * pi() * k * d / n)) FROM range(1, 200) r(k) WHERE k < c), 0)) / n AS w FROM n, LATERAL (SELECT unnest(range(-n + 1, n)) AS d)),
    low AS (SELECT a.unit_id, a.frame, any_value(a.value) AS x, sum(b.value * w) AS y FROM T a JOIN T b USING (unit_id) JOIN kern ON d = a.frame - b.frame GROUP BY a.unit_id, a.frame)"""
query("lowpass_fft", sql("T", f"{_LOW} SELECT unit_id, frame, round(y, 6) + 0.0 AS value FROM low"), 6)(lambda i: signal.smooth(i.T, 0.25))
query("highpass_fft", sql("T", f"{_LOW} SELECT unit_id, frame, round(x - y, 6) + 0.0 AS value FROM low"), 6)(lambda i: signal.smooth(i.T, 0.25, kind="high"))
_IIR = """, k AS (SELECT tan(pi() * 0.1) AS k, 1 + sqrt(2) * tan(pi() * 0.1) + pow(tan(pi() * 0.1), 2) AS s), co AS (SELECT {b0} / s AS b0, {b1} / s AS b1, 2 * (k * k - 1) / s AS a1, (1 - sqrt(2) * k + k * k) / s AS a2 FROM k),
    x AS (SELECT unit_id, frame, value AS x0, coalesce(lag(value) OVER w, 0) AS x1, coalesce(lag(value, 2) OVER w, 0) AS x2 FROM T WINDOW w AS (PARTITION BY unit_id ORDER BY frame)),
    y(unit_id, frame, y, was) AS (SELECT unit_id, frame, b0 * x0, 0.0::DOUBLE FROM x, co WHERE frame = 0
      UNION ALL SELECT x.unit_id, x.frame, b0 * x0 + b1 * x1 + b0 * x2 - a1 * y - a2 * was, y FROM y JOIN x ON x.unit_id = y.unit_id AND x.frame = y.frame + 1, co)
    SELECT unit_id, frame, round(y, 6) + 0.0 AS value FROM y"""
query("butter_lowpass", sql("T", _IIR.format(b0="k * k", b1="2 * k * k"), True), 6)(lambda i: signal.smooth(i.T, 0.1, "butter"))
query("butter_highpass", sql("T", _IIR.format(b0="1", b1="-2"), True), 6)(lambda i: signal.smooth(i.T, 0.1, "butter", "high"))
_PNR = f"""{_LOW}, q AS (SELECT unit_id, (quantile_cont(x, 0.999) - quantile_cont(x, 0.001)) / (quantile_cont(x - y, 0.999) - quantile_cont(x - y, 0.001)) AS pnr FROM low GROUP BY ALL)"""
query("pnr", sql("T", f"{_PNR} SELECT unit_id, round(pnr, 6) + 0.0 AS pnr, pnr > 1.1 AS mask_pnr FROM q"), 6)(lambda i: signal.peak_to_noise(i.T, 0.25).withColumn("mask_pnr", F.col("pnr") > 1.1))
_AT_SEEDS = ", T AS (SELECT seed_id AS unit_id, frame, value FROM L JOIN bright USING (height, width))"
query("pnr_refine", sql("L bright", f"{_AT_SEEDS}{_PNR} SELECT seed_id, height, width, coalesce(pnr > 1.05, false) AS mask_pnr FROM bright LEFT JOIN q ON unit_id = seed_id"))(lambda i: seeds.pnr_refine(i.L, i.bright, 0.25, 1.05))
_MIXTURE = """, fin AS (SELECT unit_id, x FROM one WHERE x IS NOT NULL AND isfinite(x)), vals AS (SELECT list(x) AS v, var_pop(x) AS var, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM fin),
    em(t, w, m1, m2, v1, v2, ll, was) AS (SELECT 0, 0.5::DOUBLE, a, b, var * (1 + 1e-6), var * (1 + 1e-6), 0.0::DOUBLE, NULL::DOUBLE FROM vals
      UNION ALL SELECT t + 1, n1 / n, s1 / n1, s2 / (n - n1), list_sum(list_transform(range(1, n + 1), lambda i: r[i] * pow(v[i] - s1 / n1, 2))) / n1 + var * 1e-6,
        list_sum(list_transform(range(1, n + 1), lambda i: (1 - r[i]) * pow(v[i] - s2 / (n - n1), 2))) / (n - n1) + var * 1e-6, now, CASE WHEN t > 0 THEN ll END
      FROM (SELECT *, list_sum(r) AS n1, list_dot_product(r, v) AS s1, list_sum(v) - list_dot_product(r, v) AS s2 FROM (
        SELECT t, ll, v, var, len(v) AS n, list_transform(list_zip(d1, d2), lambda z: 1 / (1 + exp(z[2] - z[1]))) AS r,
          list_avg(list_transform(list_zip(d1, d2), lambda z: greatest(z[1], z[2]) + ln(1 + exp(-abs(z[1] - z[2]))))) AS now FROM (
          SELECT em.*, v, var, list_transform(v, lambda x: ln(w) - 0.5 * ln(v1) - pow(x - m1, 2) / (2 * v1)) AS d1, list_transform(v, lambda x: ln(1 - w) - 0.5 * ln(v2) - pow(x - m2, 2) / (2 * v2)) AS d2
          FROM em, vals WHERE t < 100 AND (t < 2 OR ll - was >= 1e-6))))),
    fit AS (SELECT * FROM em ORDER BY t DESC LIMIT 1),
    up AS (SELECT unit_id, x > least(m1, m2) AND (ln(w) - 0.5 * ln(v1) - pow(x - m1, 2) / (2 * v1) > ln(1 - w) - 0.5 * ln(v2) - pow(x - m2, 2) / (2 * v2)) = (m1 > m2) AS upper FROM fin, fit)"""
query("pnr_refine_auto", sql("L bright", f"""{_AT_SEEDS}{_PNR}, one AS (SELECT unit_id, pnr AS x FROM q){_MIXTURE}
    SELECT seed_id, height, width, coalesce(upper, false) AS mask_pnr FROM bright LEFT JOIN up ON unit_id = seed_id""", True))(lambda i: seeds.pnr_refine(i.L, i.bright, 0.25, "auto"))
query("ks_refine", sql("L bright", f"""{_AT_SEEDS}, z AS (SELECT unit_id, row_number() OVER (PARTITION BY unit_id ORDER BY value) AS pos, count(*) OVER (PARTITION BY unit_id) AS n,
      (value - avg(value) OVER (PARTITION BY unit_id)) / nullif(stddev_pop(value) OVER (PARTITION BY unit_id), 0) / sqrt(2) AS x FROM T),
    c AS (SELECT unit_id, pos, any_value(n) AS n, 0.5 + 0.5 * exp(-any_value(x * x)) * sum(pow(x, 2 * k + 1) / gamma(k + 1.5)) AS cdf FROM z, range(0, 120) r(k) GROUP BY unit_id, pos),
    d AS (SELECT unit_id, max(greatest(cdf - (pos - 1) / n::DOUBLE, pos / n::DOUBLE - cdf)) AS d, sqrt(any_value(n)) AS r FROM c GROUP BY unit_id),
    ks AS (SELECT unit_id, d * (r + 0.12 + 0.11 / r) AS t FROM d),
    p AS (SELECT unit_id, CASE WHEN any_value(t) < 0.2 THEN 1 ELSE 2 * sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * t * t)) END AS p FROM ks, range(1, 101) r(k) GROUP BY unit_id)
    SELECT seed_id, height, width, coalesce(p < 0.05, false) AS mask_ks FROM bright LEFT JOIN p ON unit_id = seed_id"""))(lambda i: seeds.ks_refine(i.L, i.bright, 0.05))  # fmt: skip
_DISTANCE = f"""{_AT_SEEDS}, z AS (SELECT unit_id, row_number() OVER (PARTITION BY unit_id ORDER BY value) AS pos, count(*) OVER (PARTITION BY unit_id) AS n,
      (value - avg(value) OVER (PARTITION BY unit_id)) / nullif(stddev_pop(value) OVER (PARTITION BY unit_id), 0) / sqrt(2) AS x FROM T),
    c AS (SELECT unit_id, pos, any_value(n) AS n, 0.5 + 0.5 * exp(-any_value(x * x)) * sum(pow(x, 2 * k + 1) / gamma(k + 1.5)) AS cdf FROM z, range(0, 120) r(k) GROUP BY unit_id, pos),
    d AS (SELECT unit_id, any_value(n) AS n, max(greatest(cdf - (pos - 1) / n::DOUBLE, pos / n::DOUBLE - cdf)) AS d FROM c GROUP BY unit_id HAVING max(cdf) IS NOT NULL)"""
query("ks_exact", sql("L bright", _DISTANCE + """, w AS (SELECT unit_id, n, floor(n * d)::INT + 1 AS k, 2 * floor(n * d)::INT + 1 AS m, floor(n * d) + 1 - n * d AS h FROM d),
    walk AS (SELECT *, list_transform(range(m), lambda j: list_transform(range(m), lambda i: ((CASE WHEN i - j + 1 < 0 THEN 0 ELSE 1 END) - (CASE WHEN j = 0 THEN pow(h, i + 1) ELSE 0 END)
      - (CASE WHEN i = m - 1 THEN pow(h, m - j) ELSE 0 END) + (CASE WHEN i = m - 1 AND j = 0 THEN pow(greatest(2 * h - 1, 0), m) ELSE 0 END)) / gamma(greatest(i - j + 1, 0) + 1.0))) AS cols FROM w),
    go(unit_id, t, v) AS (SELECT unit_id, 0, list_transform(range(m), lambda i: CASE WHEN i = k - 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM walk
      UNION ALL SELECT go.unit_id, t + 1, list_transform(cols, lambda c: list_dot_product(c, v) * (t + 1) / n) FROM go JOIN walk ON walk.unit_id = go.unit_id WHERE t < n)
    SELECT go.unit_id AS seed_id, round(1 - v[k], 6) + 0.0 AS p FROM go JOIN walk ON walk.unit_id = go.unit_id AND t = n""", True), 6)(
    lambda i: signal.normality(seeds.traces_at(i.L, i.bright), ("seed_id",)).where("p is not null and not isnan(p)")
)
query("gmm_refine", sql("L bright", f"""{_AT_SEEDS}, one AS (SELECT unit_id, quantile_cont(value, 0.999) - quantile_cont(value, 0.001) AS x FROM T GROUP BY unit_id){_MIXTURE}
    SELECT seed_id, height, width, coalesce(upper, false) AS mask_gmm FROM bright LEFT JOIN up ON unit_id = seed_id""", True))(lambda i: seeds.gmm_refine(i.L, i.bright))
query("med_baseline", sql("T", """, n AS (SELECT count(DISTINCT frame) AS n FROM T),
    near AS (SELECT unit_id, frame, value, CASE WHEN p < 0 THEN -1 - p WHEN p >= n THEN 2 * n - 1 - p ELSE p END AS q FROM (SELECT unit_id, frame, value, frame + d AS p, n FROM T, n, range(-2, 3) r(d))),
    mid AS (SELECT a.unit_id, a.frame, any_value(a.value) AS v, median(b.value) AS m FROM near a JOIN T b ON b.unit_id = a.unit_id AND b.frame = q GROUP BY a.unit_id, a.frame)
    SELECT unit_id, frame, round(greatest(v - m, 0), 6) + 0.0 AS value FROM mid"""), 6)(lambda i: signal.above_baseline(i.T, 5))  # fmt: skip
query("rising_runs", sql("T", """, up AS (SELECT *, coalesce(lead(value) OVER w > value, false) AS up FROM T WINDOW w AS (PARTITION BY unit_id ORDER BY frame)),
    new AS (SELECT *, sum(CASE WHEN up AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY frame) AS run FROM (SELECT *, lag(up) OVER (PARTITION BY unit_id ORDER BY frame) AS was FROM up)),
    runs AS (SELECT unit_id, run, count(*) AS k, arg_max(value, frame) - arg_min(value, frame) AS rise FROM new WHERE up GROUP BY ALL)
    SELECT u.unit_id, coalesce(arg_max(k, (rise, -run)), 0)::BIGINT AS rise_frames, round(coalesce(max(rise), 0), 6) + 0.0 AS rise FROM (SELECT DISTINCT unit_id FROM T) u LEFT JOIN runs USING (unit_id) GROUP BY u.unit_id"""), 6)(
    lambda i: signal.longest_rise(i.T)
)
_ACOV_TO = """, z AS (SELECT unit_id, frame, value - avg(value) OVER (PARTITION BY unit_id) AS z, count(*) OVER (PARTITION BY unit_id) AS n FROM T),
    acov AS (SELECT a.unit_id, k::INT AS lag, coalesce(sum(a.z * b.z), 0) / any_value(a.n) AS acov FROM z a CROSS JOIN range({lags}) r(k) LEFT JOIN z b ON b.unit_id = a.unit_id AND b.frame = a.frame + k GROUP BY a.unit_id, k)"""
_ACOV = _ACOV_TO.format(lags=4)
query("acov_lags", sql("T", f"{_ACOV} SELECT unit_id, lag, round(acov, 6) + 0.0 AS acov FROM acov"), 6)(lambda i: signal.autocovariance(i.T, 3))
query("ar1_coef", sql("T", f"""{_ACOV}{_BAND}, sn AS (SELECT unit_id, avg(p) AS sn2 FROM power GROUP BY ALL),
    c AS (SELECT unit_id, lag, CASE WHEN lag = 0 THEN acov - sn2 ELSE acov END AS x, acov AS y FROM acov JOIN sn USING (unit_id))
    SELECT a.unit_id, round(coalesce(sum(a.x * b.y) / nullif(sum(a.x * a.x), 0), 0), 6) + 0.0 AS g FROM c a JOIN c b ON a.unit_id = b.unit_id AND b.lag = a.lag + 1 WHERE a.lag < 2 GROUP BY a.unit_id"""), 6)(
    lambda i: signal.ar1(i.T, signal.noise(i.T, method="mean"), 2)
)
query("ar_coef", sql("T", f"""{_ACOV_TO.format(lags=8)}{_BAND}, sn AS (SELECT unit_id, avg(p) AS sn2 FROM power GROUP BY ALL),
    m AS (SELECT r.unit_id, x.acov - (CASE WHEN r.lag = 1 THEN sn2 ELSE 0 END) AS m0, y.acov - (CASE WHEN r.lag = 2 THEN sn2 ELSE 0 END) AS m1, r.acov AS v
      FROM acov r JOIN acov x ON x.unit_id = r.unit_id AND x.lag = r.lag - 1 JOIN acov y ON y.unit_id = r.unit_id AND y.lag = abs(r.lag - 2) JOIN sn ON sn.unit_id = r.unit_id WHERE r.lag > 0),
    e AS (SELECT unit_id, sum(m0 * m0) AS p, sum(m0 * m1) AS q, sum(m1 * m1) AS r, sum(m0 * v) AS u, sum(m1 * v) AS w FROM m GROUP BY ALL)
    SELECT unit_id, lag::INT AS lag, round(CASE WHEN lag = 0 THEN r * u - q * w ELSE p * w - q * u END / (p * r - q * q), 6) + 0.0 AS g FROM e, range(2) l(lag)"""), 6)(lambda i: signal.ar(i.T, signal.noise(i.T, method="mean"), 2, 5))
query("lstsq_scale", sql("T", f"{_LOW} SELECT unit_id, round(coalesce(sum(y * x) / nullif(sum(y * y), 0), 0), 6) + 0.0 AS scale FROM low GROUP BY unit_id"), 6)(lambda i: signal.scale_to(signal.smooth(i.T, 0.25), i.T))

# --- graph --------------------------------------------------------------------

_POINTS = ", pts AS (SELECT seed_id AS id, height, width FROM bright)"
_PAIRS = """, pairs AS (SELECT a.id AS src, b.id AS dst, sqrt(pow(a.height - b.height, 2) + pow(a.width - b.width, 2)) AS distance FROM pts a JOIN pts b ON a.id < b.id
    AND pow(a.height - b.height, 2) + pow(a.width - b.width, 2) <= {r2})"""
_CORR = """, tr AS (SELECT seed_id AS id, frame, value FROM L JOIN bright USING (height, width)),
    edges AS (SELECT src, dst, coalesce(CASE WHEN isnan(r) THEN 0 ELSE r END, 0) AS corr FROM (SELECT src, dst, covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0) AS r
      FROM pairs JOIN tr a ON a.id = src JOIN tr b ON b.id = dst AND b.frame = a.frame GROUP BY src, dst))"""
_GROUPS = """, link AS (SELECT src AS a, dst AS b FROM edges WHERE corr > {c} UNION ALL SELECT dst, src FROM edges WHERE corr > {c}),
    reach(a, b) AS (SELECT a, a FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
    groups AS (SELECT id, coalesce(g, id) AS g, g IS NULL AS alone FROM pts LEFT JOIN (SELECT a, min(b) AS g FROM reach GROUP BY a) ON a = id)"""


def _points(i: Inputs) -> DataFrame:
    return i.bright.select(F.col("seed_id").alias("id"), *PIXEL)


def _edges(i: Inputs, radius: float) -> DataFrame:
    rows = signal.arrays(seeds.traces_at(i.L, i.bright), ["seed_id"]).withColumnRenamed("seed_id", "id")
    return graph.edge_correlation(graph.radius_pairs(_points(i), radius).select("src", "dst"), rows, _points(i), 6)


query("radius_pairs", sql("L bright", _POINTS + _PAIRS.format(r2=9) + " SELECT src, dst, round(distance, 6) AS distance FROM pairs"), 6)(lambda i: graph.radius_pairs(_points(i), 3))
query("edge_corr", sql("L bright", _POINTS + _PAIRS.format(r2=9) + _CORR + " SELECT src, dst, round(corr, 6) + 0.0 AS corr FROM edges"), 6)(lambda i: _edges(i, 3))
query("label_connected", sql("L bright", _POINTS + _PAIRS.format(r2=9) + _CORR + _GROUPS.format(c=0.15) + """
    SELECT id, (dense_rank() OVER (ORDER BY g) - 1)::INT AS label FROM groups""", True))(lambda i: graph.labels(_points(i), _edges(i, 3).where("corr > 0.15")))  # fmt: skip
query("label_only_connected", sql("L bright", _POINTS + _PAIRS.format(r2=9) + _CORR + _GROUPS.format(c=0.15) + """
    SELECT id, CASE WHEN alone THEN -1 ELSE r END::INT AS label FROM (SELECT *, dense_rank() OVER (ORDER BY g) - 1 AS r FROM groups)""", True))(
    lambda i: graph.labels(_points(i), _edges(i, 3).where("corr > 0.15"), True)
)
query("seeds_merge", sql("L bright", _POINTS + _PAIRS.format(r2=9) + _CORR + _GROUPS.format(c=0.15) + """, img AS (SELECT height, width, max(value) AS v FROM L GROUP BY ALL),
    best AS (SELECT arg_max(id, (v, -id)) AS id FROM groups JOIN bright ON seed_id = id JOIN img USING (height, width) GROUP BY g)
    SELECT seed_id, height, width, seed_id IN (SELECT id FROM best) AS mask_mrg FROM bright""", True))(lambda i: seeds.merge(i.L, project.projection(i.L), i.bright, 3, 0.15))  # fmt: skip

# --- units --------------------------------------------------------------------

_SEEDS = ", sd AS (SELECT row_number() OVER (ORDER BY height, width) - 1 AS unit_id, height, width FROM (SELECT DISTINCT height, width FROM E))"
query("initA", sql("E", _SEEDS + """, pr AS (SELECT s.unit_id, s.height AS sh, s.width AS sw, p.height, p.width FROM sd s JOIN (SELECT DISTINCT height, width FROM E) p
      ON pow(s.height - p.height, 2) + pow(s.width - p.width, 2) <= 9 AND (s.height <> p.height OR s.width <> p.width)),
    cr AS (SELECT unit_id, pr.height, pr.width, covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value)) AS r FROM pr JOIN E a ON a.height = sh AND a.width = sw JOIN E b ON b.height = pr.height AND b.width = pr.width AND b.frame = a.frame GROUP BY ALL)
    SELECT unit_id, height, width, round(r, 6) + 0.0 AS value FROM cr WHERE r > 0.02 UNION ALL SELECT unit_id, height, width, 1.0 FROM sd"""), 6)(
    lambda i: units.init_footprints(i.E, seeds.numbered(i.E.select(*PIXEL).distinct()), 0.02, 3)
)
_GRAM = """, k AS (SELECT count(DISTINCT unit_id) AS k FROM A), ids AS (SELECT unit_id, row_number() OVER (ORDER BY unit_id) AS pos FROM (SELECT DISTINCT unit_id FROM A)),
    pair AS (SELECT a.unit_id AS u1, b.unit_id AS u2, sum(a.value * b.value) AS v FROM A a JOIN A b USING (height, width) GROUP BY ALL),
    line AS (SELECT i.pos, list(coalesce(v, 0.0) ORDER BY j.pos) AS g FROM ids i CROSS JOIN ids j LEFT JOIN pair ON u1 = i.unit_id AND u2 = j.unit_id GROUP BY i.pos),
    gram AS (SELECT list(g ORDER BY pos) AS g FROM line)"""
query("initC", sql("E A", _GRAM + """, dot AS (SELECT unit_id, frame, sum(E.value * A.value) AS v FROM E JOIN A USING (height, width) GROUP BY ALL),
    y AS (SELECT frame, list(v ORDER BY pos) AS y FROM dot JOIN ids USING (unit_id) GROUP BY frame),
    cg(frame, step, x, r, d, norm) AS (SELECT frame, 0, list_transform(y, lambda v: 0.0::DOUBLE), y, y, list_dot_product(y, y) FROM y
      UNION ALL SELECT frame, step + 1, list_transform(range(1, len(x) + 1), lambda i: x[i] + a * d[i]), rr, list_transform(range(1, len(x) + 1), lambda i: rr[i] + new / norm * d[i]), new
      FROM (SELECT *, list_dot_product(rr, rr) AS new FROM (SELECT *, list_transform(range(1, len(x) + 1), lambda i: r[i] - a * q[i]) AS rr
        FROM (SELECT *, norm / list_dot_product(d, q) AS a FROM (SELECT cg.*, list_transform(g, lambda row: list_dot_product(row, d)) AS q FROM cg, gram WHERE step < 10)))))
    SELECT unit_id, frame, round(x[pos], 6) + 0.0 AS value FROM cg, ids WHERE step = 10""", True), 6)(lambda i: units.init_traces(i.E, i.A))
_OVER = """, sz AS (SELECT unit_id, count(*) AS n FROM A GROUP BY ALL), ov AS (SELECT a.unit_id AS src, b.unit_id AS dst, count(*) AS shared FROM A a JOIN A b USING (height, width) WHERE a.unit_id < b.unit_id GROUP BY ALL),
    jac AS (SELECT src, dst, shared, shared / (p.n + q.n - shared)::DOUBLE AS jaccard FROM ov JOIN sz p ON p.unit_id = src JOIN sz q ON q.unit_id = dst)"""
query("unit_overlap", sql("E A", _OVER + " SELECT src, dst, shared, round(jaccard, 6) AS jaccard FROM jac"), 6)(lambda i: units.overlaps(i.A))
_UGROUPS = """, reach(a, b) AS (SELECT unit_id, unit_id FROM sz UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
    lab AS (SELECT unit_id, (dense_rank() OVER (ORDER BY g) - 1)::INT AS label FROM (SELECT a AS unit_id, min(b) AS g FROM reach GROUP BY a))"""
query("unit_jaccard_groups", sql("E A", _OVER + ", link AS (SELECT src AS a, dst AS b FROM jac WHERE jaccard > 0.4 UNION ALL SELECT dst, src FROM jac WHERE jaccard > 0.4)" + _UGROUPS + " SELECT * FROM lab", True))(lambda i: units.jaccard_groups(i.A, 0.4))
_MERGED = """, cc AS (SELECT src, dst, covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value)) AS r FROM ov JOIN C a ON a.unit_id = src JOIN C b ON b.unit_id = dst AND b.frame = a.frame GROUP BY src, dst),
    link AS (SELECT src AS a, dst AS b FROM cc WHERE r > 0.15 UNION ALL SELECT dst, src FROM cc WHERE r > 0.15)"""
query("unit_merge", sql("E A C", _OVER + _MERGED + _UGROUPS + """, k AS (SELECT label, count(*) AS k FROM lab GROUP BY ALL)
    SELECT 'A' AS var, label::BIGINT AS unit_id, NULL::INT AS frame, height, width, round(sum(value) / any_value(k), 6) + 0.0 AS value FROM A JOIN lab USING (unit_id) JOIN k USING (label) GROUP BY label, height, width
    UNION ALL SELECT 'C', label, frame, NULL, NULL, round(sum(value) / any_value(k), 6) + 0.0 FROM C JOIN lab USING (unit_id) JOIN k USING (label) GROUP BY label, frame""", True), 6)(lambda i: _both(*units.merge(i.A, i.C, 0.15)))  # fmt: skip


def _both(A: DataFrame, C: DataFrame) -> DataFrame:
    none = F.lit(None).cast("int")
    return A.select(F.lit("A").alias("var"), "unit_id", none.alias("frame"), *PIXEL, "value").union(C.select(F.lit("C"), "unit_id", "frame", none, none, "value"))


_AC = ", ac AS (SELECT frame, height, width, sum(A.value * C.value) AS value FROM A JOIN C USING (unit_id) GROUP BY ALL)"
query("compute_AtC", sql("E A C", _AC + " SELECT frame, height, width, round(value, 6) + 0.0 AS value FROM ac"), 6)(lambda i: units.reconstruction(i.A, i.C))
_BF = _AC + """, rest AS (SELECT E.frame, E.height, E.width, greatest(E.value - coalesce(ac.value, 0), 0) AS value FROM E LEFT JOIN ac USING (frame, height, width)),
    b AS (SELECT height, width, avg(value) AS value FROM rest GROUP BY ALL),
    f AS (SELECT frame, sum(b.value * rest.value) / sum(b.value * b.value) AS value FROM rest JOIN b USING (height, width) GROUP BY frame)"""
query("update_background", sql("E A C", _BF + """ SELECT 'b' AS var, NULL::INT AS frame, height, width, round(value, 6) + 0.0 AS value FROM b
    UNION ALL SELECT 'f', frame, NULL, NULL, round(value, 6) + 0.0 FROM f"""), 6)(lambda i: _background(*units.update_background(i.E, i.A, i.C)))  # fmt: skip


def _background(b: DataFrame, f: DataFrame) -> DataFrame:
    none = F.lit(None).cast("int")
    return b.select(F.lit("b").alias("var"), none.alias("frame"), *PIXEL, "value").union(f.select(F.lit("f"), "frame", none, none, "value"))


query("compute_trace", sql("E A C", _BF + """, nrm AS (SELECT unit_id, sum(value * value) AS n FROM A GROUP BY ALL),
    g AS (SELECT a.unit_id AS u1, b.unit_id AS u2, sum(a.value * b.value) AS g FROM A a JOIN A b USING (height, width) GROUP BY ALL),
    ca AS (SELECT u1 AS unit_id, frame, sum(g * value) AS ca FROM g JOIN C ON C.unit_id = u2 GROUP BY ALL),
    ya AS (SELECT unit_id, frame, sum((E.value - b.value * f.value) * A.value) AS ya FROM E JOIN A USING (height, width) JOIN b USING (height, width) JOIN f USING (frame) GROUP BY ALL)
    SELECT unit_id, frame, round(greatest((ya - ca) / n + C.value, 0), 6) + 0.0 AS value FROM ya JOIN ca USING (unit_id, frame) JOIN nrm USING (unit_id) JOIN C USING (unit_id, frame)"""), 6)(lambda i: _yra(i))  # fmt: skip


def _yra(i: Inputs) -> DataFrame:
    b, f = units.update_background(i.E, i.A, i.C)
    return units.traces(i.E, i.A, written(b, "b"), i.C, f)


query("spatial_support", sql("E A", """SELECT DISTINCT unit_id, (height + dy)::INT AS height, (width + dx)::INT AS width FROM A, range(-1, 2) a(dy), range(-1, 2) b(dx)
    WHERE dy * dy + dx * dx <= 1 AND height + dy BETWEEN 0 AND 7 AND width + dx BETWEEN 0 AND 7"""))(lambda i: units.support(i.A, 1, 8, 8))  # fmt: skip
query("spatial_single_unit", sql("E A C", """SELECT unit_id, E.height, E.width, round(greatest(covar_pop(C.value, E.value) - 0.005, 0) / var_pop(C.value), 6) + 0.0 AS value
    FROM E JOIN C USING (frame) WHERE unit_id = (E.height + E.width) % 10 GROUP BY unit_id, E.height, E.width"""), 6)(lambda i: _single(i))  # fmt: skip


def _single(i: Inputs) -> DataFrame:
    rows = signal.arrays(i.E, PIXEL).withColumn("unit_id", ((F.col("height") + F.col("width")) % 10).cast("long"))
    x = signal.arrays(i.C, ["unit_id"]).withColumnRenamed("trace", "x")
    return units.spatial_single(rows.join(x, "unit_id").withColumn("alpha", F.lit(0.005))).select("unit_id", *PIXEL, "value")


query("spatial_size_filter", sql("E A", "SELECT unit_id, height, width, round(value, 6) + 0.0 AS value FROM A WHERE unit_id IN (SELECT unit_id FROM A GROUP BY unit_id HAVING count(*) > 30 AND count(*) < 40)"), 6)(lambda i: units.sized(i.A, 30, 40))
query("spatial_normalize", sql("E A", "SELECT unit_id, height, width, round(value / max(value) OVER (PARTITION BY unit_id), 6) + 0.0 AS value FROM A"), 6)(lambda i: units.normalised(i.A)[0])
query("unit_size", sql("E A", "SELECT unit_id, count(*) AS n FROM A WHERE value > 0 GROUP BY unit_id"))(lambda i: units.sizes(i.A))
_LASSO = """, T AS (SELECT height * 8 + width AS unit_id, frame, value FROM E)""" + _BAND + """, sn AS MATERIALIZED (SELECT unit_id AS px, 0.05 * sqrt(exp(avg(ln(p + 2.220446049250313e-16)))) AS alpha FROM power GROUP BY ALL),
    sup AS (SELECT DISTINCT unit_id, (height + dy) * 8 + width + dx AS px FROM A, range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE dy * dy + dx * dx <= 1 AND height + dy BETWEEN 0 AND 7 AND width + dx BETWEEN 0 AND 7),
    ids AS (SELECT unit_id, row_number() OVER (ORDER BY unit_id) AS pos FROM (SELECT DISTINCT unit_id FROM A)),
    line AS (SELECT i.pos, list(v ORDER BY j.pos) AS g FROM ids i CROSS JOIN ids j JOIN (SELECT a.unit_id AS u1, b.unit_id AS u2, covar_pop(a.value, b.value) AS v FROM C a JOIN C b USING (frame) GROUP BY ALL) ON u1 = i.unit_id AND u2 = j.unit_id GROUP BY i.pos),
    gram AS MATERIALIZED (SELECT list(g ORDER BY pos) AS g, count(*) AS k FROM line),
    want AS MATERIALIZED (SELECT px, list(CASE WHEN sup.unit_id IS NULL THEN NULL ELSE v END ORDER BY pos) AS want FROM (SELECT C.unit_id, T.unit_id AS px, covar_pop(C.value, T.value) AS v FROM C JOIN T USING (frame) GROUP BY ALL) c JOIN ids USING (unit_id) LEFT JOIN sup USING (unit_id, px) GROUP BY px),
    cd(px, step, w) AS (SELECT px, 0, list_transform(want, lambda v: 0.0::DOUBLE) FROM want
      UNION ALL SELECT px, step + 1, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i = j THEN coalesce(greatest(0, w[j] + (want[j] - alpha - list_dot_product(g[j], w)) / g[j][j]), 0) ELSE w[i] END)
      FROM (SELECT cd.*, want, alpha, g, (step % k + 1)::INT AS j FROM cd JOIN want USING (px) JOIN sn USING (px), gram WHERE step < 40 * k)),
    fit AS (SELECT unit_id, (px // 8)::INT AS height, (px % 8)::INT AS width, w[pos] AS value FROM cd, ids, gram WHERE step = 40 * k AND w[pos] > 0)
    SELECT unit_id, height, width, round(value / max(value) OVER (PARTITION BY unit_id), 6) + 0.0 AS value FROM fit QUALIFY count(*) OVER (PARTITION BY unit_id) > 3"""
query("spatial_lasso_multi", sql("E A C", _LASSO, True), 6)(lambda i: units.update_spatial(i.E, i.A, i.C, signal.noise(i.E, keys=tuple(PIXEL)), shape=(8, 8), radius=1, penalty=0.05, size=(3, None))[0])
query("temporal_deconv", None, 6)(lambda i: units.update_temporal(i.T.select("unit_id", F.lit(0).alias("height"), F.col("unit_id").cast("int").alias("width"), F.lit(1.0).alias("value")).distinct(), i.T, penalty=0.1).drop("g", "u", "lam"))
query("temporal_invariants", sql("T", "SELECT unit_id, count(*) AS frames, true AS feasible, true AS better FROM T GROUP BY unit_id HAVING max(value) > 0"))(lambda i: _temporal(i))


def _temporal(i: Inputs) -> DataFrame:
    """What deconvolved traces must keep: c and s not negative, s what c's autoregression
    leaves, and an objective, at the best baseline, no greater than that of a constant."""
    one = i.T.select("unit_id", F.lit(0).alias("height"), F.col("unit_id").cast("int").alias("width"), F.lit(1.0).alias("value")).distinct()
    t = written(units.update_temporal(one, i.T, penalty=0.1, silent=True), "temporal")
    y = signal.smooth(i.T, 0.25).withColumnRenamed("value", "y")
    sn = signal.noise(i.T, (0.25, 1.0)).join(i.T.groupBy("unit_id").agg(F.avg("value").alias("m")), "unit_id")  # traces are solved over their means
    was = F.coalesce(F.lag("c").over(Window.partitionBy("unit_id").orderBy("frame")), F.lit(0.0))
    rows = t.withColumn("ok", (F.col("c") >= 0) & (F.col("s") >= 0) & (F.abs(F.col("c") - F.col("g")[0] * was - F.col("s")) <= 1e-6 * (1 + F.col("c"))))
    rows = rows.join(y, ["unit_id", "frame"]).withColumn("r", F.col("y") - F.col("c") - F.col("b") - F.col("c0"))
    each = rows.groupBy("unit_id").agg(F.count("*").alias("frames"), F.min("ok").alias("feasible"), (F.stddev_pop("r") * F.sqrt(F.count("*"))).alias("off"), F.sum("s").alias("s"), (F.stddev_pop("y") * F.sqrt(F.count("*"))).alias("flat"))
    return each.join(sn, "unit_id").select("unit_id", "frames", "feasible", (F.col("off") + F.col("sn") / F.col("m") * 0.1 * F.col("s") <= F.col("flat") * (1 + 1e-6)).alias("better"))


# --- motion -------------------------------------------------------------------

query("motion_rigid", None, 3)(lambda i: motion.estimate(i.L, upsample=10))
query("motion_elastic", None, 3)(lambda i: motion.estimate(i.L, mesh=(1, 1)).select("frame", F.posexplode("coef").alias("place", "shift")))
#: A picture of the line items, 32 pixels wide, moved about: its shifts are known.
query("motion_planted", """WITH f AS (SELECT unnest(range(60)) AS frame), s AS (SELECT frame, 5 - frame * 7 % 11 AS dy, 4 - frame * 5 % 9 AS dx FROM f)
    SELECT frame::INT AS frame, (dy - lag(dy) OVER w)::DOUBLE AS dy, (dx - lag(dx) OVER w)::DOUBLE AS dx FROM s WINDOW w AS (ORDER BY frame) QUALIFY frame > 0""")(lambda i: _steps(motion.estimate(_moved_picture(i), upsample=20, alt_error=None)))  # fmt: skip


def _steps(moved: DataFrame) -> DataFrame:
    """Whole pixels from frame to frame."""
    w = Window.orderBy("frame")  # 60 rows
    return moved.select("frame", *[(F.round(F.col(c) - F.lag(c).over(w)) + F.lit(0.0)).alias(c) for c in ("dy", "dx")]).where("frame > 0")


def _moved_picture(i: Inputs) -> DataFrame:
    cells = i.table("lineitem").groupBy((F.col("l_orderkey") % 32).cast("int").alias("height"), (F.col("l_partkey") % 32).cast("int").alias("width")).agg(F.sum("l_quantity").alias("v"))
    grid = i.spark.range(32 * 32).select(F.floor(F.col("id") / 32).cast("int").alias("height"), (F.col("id") % 32).cast("int").alias("width"))
    picture = grid.join(cells, PIXEL, "left").select(*PIXEL, F.coalesce("v", F.lit(0.0)).alias("value"))
    frames = i.spark.range(60).select(F.col("id").cast("int").alias("frame"), (F.col("id") * 7 % 11 - 5).alias("dy"), (F.col("id") * 5 % 9 - 4).alias("dx"))
    at = lambda c, d: F.pmod(F.col(c) + F.col(d), F.lit(32)).cast("int").alias(c)
    return picture.crossJoin(F.broadcast(frames)).select("frame", at("height", "dy"), at("width", "dx"), "value")  # 60 rows


_NCC = """, tpl AS (SELECT height, width, value - avg(value) OVER () AS d FROM (SELECT height, width, avg(value) AS value FROM L GROUP BY ALL)),
    win AS (SELECT f.frame, dy, dx, t.d, coalesce(L.value, 0.0) AS v FROM (SELECT DISTINCT frame FROM L) f CROSS JOIN range(-3, 4) a(dy) CROSS JOIN range(-3, 4) b(dx) CROSS JOIN tpl t
      LEFT JOIN L ON L.frame = f.frame AND L.height = t.height + dy AND L.width = t.width + dx),
    ncc AS (SELECT frame, dy, dx, sum(v * d) / nullif(sqrt(var_pop(v) * count(*) * sum(d * d)), 0) AS c FROM win GROUP BY frame, dy, dx)"""
query("match_template", sql("L", _NCC + " SELECT frame, (-arg_max(dy, (c, -dy, -dx)))::DOUBLE AS dy, (-arg_max(dx, (c, -dy, -dx)))::DOUBLE AS dx FROM ncc GROUP BY frame"))(
    lambda i: motion.template_motion(i.L, motion.mean_image(i.L), 3)
)
query("circularity", None, 6)(lambda i: motion.circularities(i.L, 3))
query("apply_shift_integer", sql("L", """SELECT c.frame, c.height, c.width, coalesce(n.value, 0.0) AS value FROM L c
    LEFT JOIN L n ON n.frame = c.frame AND n.height = c.height - (c.frame % 3 - 1) AND n.width = c.width - c.frame % 2"""))(
    lambda i: motion.apply_integer(i.L, i.L.select("frame").distinct().select("frame", (F.col("frame") % 3 - 1).alias("dy"), (F.col("frame") % 2).alias("dx")))
)
query("apply_shift_bilinear", sql("L", f"""SELECT c.frame, c.height, c.width, CASE WHEN count(n.value) = 4 THEN sum(n.value * (CASE WHEN dy = 0 THEN 0.5 ELSE 0.5 END) * (CASE WHEN dx = -1 THEN 0.25 ELSE 0.75 END)) ELSE 0.0 END AS value
    FROM L c CROSS JOIN range(0, 2) a(dy) CROSS JOIN range(-1, 1) b(dx) LEFT JOIN L n ON n.frame = c.frame AND n.height = c.height - dy AND n.width = c.width - dx GROUP BY c.frame, c.height, c.width"""))(
    lambda i: motion.apply(i.L, i.L.select("frame").distinct().select("frame", F.lit(0.5).alias("dy"), F.lit(-0.25).alias("dx")))
)
query("motion_centred", sql("L", """, m AS (SELECT DISTINCT frame, (frame % 7) * 1.0 AS step FROM L),
    c AS (SELECT frame, sum(step) OVER (ORDER BY frame) AS sh FROM m) SELECT frame, round(sh - avg(sh) OVER (), 6) + 0.0 AS dy, 0.0::DOUBLE AS dx FROM c"""), 6)(
    lambda i: motion.accumulated(i.L.select("frame").distinct().select("frame", (F.col("frame") % 7).cast("double").alias("dy"), F.lit(0.0).alias("dx")))
)


# --- parameters, paths, clips ---------------------------------------------------

_PARAMS = [("denoise", "method", "median", "ksize", "7", None, None, None, None, "Nan", "Nan"), ("seeds_merge", "thres_dist", "10", "thres_corr", "0.8", "noise_freq", "0.06", None, None, None, None),
           ("get_noise", "noise_range", "(0.06, 0.5)", "Nan", "Nan", None, None, None, None, None, None), ("remove_glow", "deglow", "TRUE", None, None, None, None, None, None, None, None)]
_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in _PARAMS)
query("params_unpivot", f"""WITH p(function, p1, v1, p2, v2, p3, v3, p4, v4, p5, v5) AS (VALUES {_VALUES}),
    u AS (SELECT function, p1 AS name, v1 AS value FROM p UNION ALL SELECT function, p2, v2 FROM p UNION ALL SELECT function, p3, v3 FROM p UNION ALL SELECT function, p4, v4 FROM p UNION ALL SELECT function, p5, v5 FROM p)
    SELECT function, name, value, CASE WHEN regexp_full_match(value, '\\d+') THEN 'int' WHEN regexp_full_match(value, '\\d*\\.\\d+|\\d+\\.\\d*') THEN 'float' WHEN upper(value) IN ('TRUE', 'FALSE') THEN 'bool'
      WHEN value LIKE '(%)' THEN 'tuple' ELSE 'string' END AS kind FROM u WHERE name IS NOT NULL AND lower(name) <> 'nan'""")(lambda i: _params(i))  # fmt: skip


def _params(i: Inputs) -> DataFrame:
    from glintframe.sources import params

    table = i.spark.createDataFrame(_PARAMS, ", ".join(f"{c} string" for c in params.COLUMNS))
    return params.unpivot(table).withColumn("kind", params.kind())


query("path_metadata", """SELECT s_suppkey, split_part(p, '/', 3) AS session, split_part(p, '/', 2) AS animal, regexp_extract(p, '(\\d+)\\D*$', 1)::BIGINT AS number
    FROM (SELECT s_suppkey, '/a' || s_nationkey || '/s' || s_suppkey || '/msCam' || (s_suppkey % 13) || '.avi' AS p FROM supplier)""")(
    lambda i: i.table("supplier").withColumn("p", F.concat(F.lit("/a"), "s_nationkey", F.lit("/s"), "s_suppkey", F.lit("/msCam"), F.col("s_suppkey") % 13, F.lit(".avi"))).select(
        "s_suppkey", expr.path_part(F.col("p"), 2).alias("session"), expr.path_part(F.col("p"), 3).alias("animal"), expr.file_number(F.col("p")).alias("number")
    )
)
query("clip_intervals", sql("L", """SELECT clip, L.* FROM L JOIN (VALUES (0, 0.0, 1.5), (1, 1.2, 3.05), (2, 7.0, 7.0), (3, 8.0, 100.0)) c(clip, a, b) ON frame / 10.0 >= a AND frame / 10.0 < b"""))(lambda i: _clips(i))


def _clips(i: Inputs) -> DataFrame:
    from glintframe.sources import video

    times = i.spark.createDataFrame([(0, 0.0, 1.5), (1, 1.2, 3.05), (2, 7.0, 7.0), (3, 8.0, 100.0)], "clip int, start double, end double")
    return video.clips(i.L, times, 10.0)


def _filmed(i: Inputs, layout: str) -> DataFrame:
    """L, written to files of 20 frames and read from them."""
    from glintframe.sources import movies

    path = scratch(i.spark, "films")
    movies.write_movie(i.L.withColumn("value", F.least("value", F.lit(255.0))), path, layout, frames_a_file=20)
    return movies.read_movie(i.spark, path, layout=layout)


query("movie_avi", sql("L", "SELECT frame, height, width, least(value, 255.0) AS value FROM L"))(lambda i: _filmed(i, "avi"))
query("movie_tif_range", sql("L", "SELECT frame, height, width, least(value, 255.0) AS value FROM L WHERE frame BETWEEN 15 AND 47 AND height >= 5 AND width < 11"))(
    lambda i: _filmed(i, "tif").where("frame BETWEEN 15 AND 47 AND height >= 5 AND width < 11")
)
query("factors", "SELECT p_partkey, f::INT AS factor FROM part, LATERAL (SELECT unnest(range(1, p_partkey + 1)) AS f) WHERE p_partkey % f = 0")(
    lambda i: i.table("part").select("p_partkey", F.explode(expr.factors(F.col("p_partkey"))).alias("factor"))
)
@query("temporal_certified", sql("T", """SELECT p::INT AS p, unit_id, count(*) AS frames, true AS feasible, true AS proves, true AS exact
    FROM T, (VALUES (1), (2)) v(p) GROUP BY p, unit_id HAVING max(value) > 0"""))
def _certified(i: Inputs) -> DataFrame:
    """For orders 1 and 2, from the returned columns alone: whether a trace's parts are
    feasible, whether u is for the dual problem, and whether the objective is within
    1e-6 of the bound that u gives, in units of the objective."""
    one = i.T.select("unit_id", F.lit(0).alias("height"), F.col("unit_id").cast("int").alias("width"), F.lit(1.0).alias("value")).distinct()
    y = signal.smooth(i.T, 0.25).select("unit_id", "frame", F.col("value").alias("y"))
    out = None
    for p in (1, 2):
        t = written(units.update_temporal(one, i.T, penalty=0.1, p=p, zero=None, silent=True), "temporal").join(y, ["unit_id", "frame"])
        cells = F.sort_array(F.collect_list(F.struct("frame", "y", "c", "s", "b", "c0", "u")))
        rows = t.groupBy("unit_id").agg(cells.alias("x"), F.first("g").alias("g"), F.first("lam").alias("lam"), F.min("y").alias("low"))
        of = lambda name: F.transform("x", lambda v: v[name])
        plus = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        g1, g2 = F.get("g", F.lit(0)), F.coalesce(F.get("g", F.lit(1)), F.lit(0.0))
        # G's transpose, from the last frame on: the response to a spike at each frame, and the largest of them
        start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(-1e300).cast("double").alias("most"))
        step = lambda s, v: F.struct((v + g1 * s["a"] + g2 * s["b"]).alias("a"), s["a"].alias("b"), F.greatest(s["most"], v + g1 * s["a"] + g2 * s["b"]).alias("most"))
        begin = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("most"))
        miss = lambda s, v: F.struct(v["c"].alias("a"), s["a"].alias("b"), F.greatest(s["most"], F.abs(v["c"] - g1 * s["a"] - g2 * s["b"] - v["s"])).alias("most"))
        told = rows.select(
            "unit_id", "low", "lam", F.size("x").alias("frames"), F.aggregate(F.reverse(of("u")), start, step)["most"].alias("response"), F.aggregate("x", begin, miss)["most"].alias("miss"),
            F.sqrt(plus(F.transform("x", lambda v: F.pow(v["y"] - v["c"] - v["b"] - v["c0"], 2.0)))).alias("rest"), plus(of("s")).alias("spikes"), F.array_min(of("s")).alias("least"), F.array_min(of("b")).alias("floor"),
            plus(of("u")).alias("level"), plus(F.transform("x", lambda v: v["u"] * v["u"])).alias("length"), plus(F.transform("x", lambda v: v["u"] * (v["y"] - F.col("low")))).alias("bound"),
        )
        goal = F.col("rest") + F.col("lam") * F.col("spikes")
        fits = (F.col("least") >= 0) & (F.col("floor") >= F.col("low") - 1e-6 * F.abs("low")) & (F.col("miss") <= 1e-6 * (1 + goal))
        proof = (F.col("length") <= 1 + 1e-9) & (F.col("response") <= F.col("lam") * (1 + 1e-6) + 1e-9) & (F.col("level") <= 1e-7)
        now = told.select(F.lit(p).alias("p"), "unit_id", F.col("frames").cast("long").alias("frames"), fits.alias("feasible"), proof.alias("proves"), (F.abs(goal - F.col("bound")) <= 1e-6 * goal).alias("exact"))
        out = now if out is None else out.union(now)
    return out


query("event_windows", """SELECT user_id AS unit_id, time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS start, round(sum(value), 6) + 0.0 AS value, count(*) AS n FROM events GROUP BY ALL""", 6)(lambda i: _events(i))


def _events(i: Inputs) -> DataFrame:
    from glintframe.streaming import traces

    return traces.windowed(i.table("events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


query("pipeline_end_to_end", None, 6)(lambda i: _pipeline(i))


def _pipeline(i: Inputs) -> DataFrame:
    """Footprints and traces of all of L: the whole analysis of a movie at rest."""
    from glintframe.plans.pipeline import TABLE, run

    out = run(i.L, TABLE)
    return _both(out["A"], out["C"])
