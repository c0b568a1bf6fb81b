"""Image features of the vectors' 8 x 8 gray planes: numpy kernels beside plain SQL over pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pellucid.functions.kernels import DB4
from pellucid.operators import images, pixels, resample
from pellucid.plans.registry import ORACLE, query
from pellucid.plans.views import PIXELS, SIDE, planes, table


def _size() -> tuple[Column, Column]:
    return F.lit(SIDE), F.lit(SIDE)


def _rounded(values: Column, names: list[str]) -> list[Column]:
    return [F.round(F.get(values, F.lit(i)), 6).alias(n) for i, n in enumerate(names)]


@query(f"WITH {PIXELS} SELECT vec_id, y, x, g FROM pixels")
def gray_planes(spark: SparkSession, sf: str) -> DataFrame:
    """The planes as rows of pixels."""
    p = planes(spark, sf).select("vec_id", F.posexplode("g").alias("i", "g"))
    return p.select("vec_id", F.floor(F.col("i") / SIDE).alias("y"), (F.col("i") % SIDE).cast("long").alias("x"), F.col("g").cast("long").alias("g"))


@query(f"WITH {PIXELS} SELECT vec_id, round(avg(g), 6) AS mean, round(stddev_pop(g), 6) AS std, CAST(median(g) AS DOUBLE) AS median, CAST(sum(g) AS BIGINT) AS total, round(var_pop(g), 6) AS var FROM pixels GROUP BY 1")
def array_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of the pixels that a table function yields."""
    p = pixels.rows(planes(spark, sf).select("vec_id", F.col("g").alias("plane")), "plane", SIDE)
    return p.groupBy("vec_id").agg(F.round(F.avg("g"), 6).alias("mean"), F.round(F.stddev_pop("g"), 6).alias("std"), F.median("g").alias("median"), F.sum("g").alias("total"), F.round(F.var_pop("g"), 6).alias("var"))


@query(f"WITH {PIXELS}, b AS (SELECT vec_id, least(CAST(floor(g * 8 / 255.0) AS BIGINT), 7) AS bin FROM pixels) SELECT vec_id, bin, count(*) AS n, round(count(*) / (64 + 1e-8), 6) AS share FROM b GROUP BY 1, 2")
def histogram_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """Eight bins over 0 to 255, the last closed on the right."""
    bin_ = (F.least(F.width_bucket(F.col("g").cast("double"), F.lit(0.0), F.lit(255.0), F.lit(8)), F.lit(8)) - 1).alias("bin")
    p = planes(spark, sf).select("vec_id", F.explode("g").alias("g"))
    return p.groupBy("vec_id", bin_).agg(F.count("*").alias("n"), F.round(F.count("*") / (64 + 1e-8), 6).alias("share"))


@query(f"WITH {PIXELS} SELECT vec_id, y, x, (g * 19595 + (255 - g) * 38470 + ((g * 7) % 256) * 7471 + 32768) >> 16 AS luma FROM pixels")
def img_gray(spark: SparkSession, sf: str) -> DataFrame:
    """Luma of colours made from a plane."""
    p = gray_planes(spark, sf)
    rgb = p.select("vec_id", "y", "x", F.col("g").alias("r"), (255 - F.col("g")).alias("g"), (F.col("g") * 7 % 256).alias("b"))
    return images.gray(rgb).select("vec_id", "y", "x", "luma")


@query(f"""WITH {PIXELS}, l AS (
  SELECT c.vec_id, u.g + d.g + w.g + e.g - 4 * c.g AS v FROM pixels c
  JOIN pixels u ON u.vec_id = c.vec_id AND u.x = c.x AND u.y = abs(c.y - 1)
  JOIN pixels d ON d.vec_id = c.vec_id AND d.x = c.x AND d.y = 7 - abs(6 - c.y)
  JOIN pixels w ON w.vec_id = c.vec_id AND w.y = c.y AND w.x = abs(c.x - 1)
  JOIN pixels e ON e.vec_id = c.vec_id AND e.y = c.y AND e.x = 7 - abs(6 - c.x))
SELECT vec_id, round(var_pop(v) + 1e-7, 4) AS laplacian FROM l GROUP BY 1""")
def img_laplacian(spark: SparkSession, sf: str) -> DataFrame:
    return planes(spark, sf).select("vec_id", F.round(images.laplacian(F.col("g"), *_size()) + 1e-7, 4).alias("laplacian"))


#: Distance, angle, and the offset in rows and columns that they stand for.
_PAIRS = [
    (1, 0, 0, 1), (1, 45, 1, 1), (1, 90, 1, 0), (1, 135, 1, -1),
    (2, 0, 0, 2), (2, 45, 1, 1), (2, 90, 2, 0), (2, 135, 1, -1),
    (3, 0, 0, 3), (3, 45, 2, 2), (3, 90, 3, 0), (3, 135, 2, -2),
]
_OFFSETS = ", ".join(f"({d}, {a}, {r}, {c})" for d, a, r, c in _PAIRS)
_GLCM = f"""{PIXELS}, q AS (SELECT vec_id, y, x, CAST(floor(g / 255.0 * 63) AS BIGINT) AS v FROM pixels),
o(d, a, dr, dc) AS (VALUES {_OFFSETS}),
one AS (SELECT s.vec_id, o.d, o.a, s.v AS i, t.v AS j FROM q s, o, q t WHERE t.vec_id = s.vec_id AND t.y = s.y + o.dr AND t.x = s.x + o.dc)"""


@query(f"""WITH {_GLCM}, sym AS (SELECT * FROM one UNION ALL SELECT vec_id, d, a, j, i FROM one),
p AS (SELECT vec_id, d, a, i, j, count(*) AS c, sum(count(*)) OVER (PARTITION BY vec_id, d, a) AS n FROM sym GROUP BY 1, 2, 3, 4, 5)
SELECT vec_id, d, a, round(sum(c / n * (i - j) * (i - j)), 6) AS contrast, round(sum(c / n * abs(i - j)), 6) AS dissimilarity,
  round(sum(c / n / (1 + (i - j) * (i - j))), 6) AS homogeneity, round(sqrt(sum(c / n * c / n)), 6) AS energy FROM p GROUP BY 1, 2, 3""")
def img_glcm(spark: SparkSession, sf: str) -> DataFrame:
    """Co-occurrence features, a row for each distance and angle."""
    f = planes(spark, sf).select("vec_id", images.features(F.col("g"), *_size(), "glcm").alias("f"))
    parts = [F.struct(F.lit(d).alias("d"), F.lit(a).alias("a"), *[F.round(F.get("f", F.lit(12 * p + k)), 6).alias(n) for p, n in enumerate(("contrast", "dissimilarity", "homogeneity", "energy"))]) for k, (d, a, _, _) in enumerate(_PAIRS)]
    return f.select("vec_id", F.explode(F.array(*parts)).alias("p")).select("vec_id", "p.*")


@query(f"WITH {_GLCM} SELECT vec_id, d, a, least(i, j) AS lo, greatest(i, j) AS hi, count(*) AS n FROM one GROUP BY 1, 2, 3, 4, 5")
def glcm_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of level pairs at every offset, from pixels with twelve neighbours that a table function yields."""
    q = planes(spark, sf).select("vec_id", F.transform("g", lambda g: F.floor(g / 255.0 * 63).cast("int")).alias("plane"))
    px = pixels.rows(q, "plane", SIDE, [(r, c) for _, _, r, c in _PAIRS])
    p = pixels.pairs(px, ["vec_id"], [F.struct(F.lit(d).alias("d"), F.lit(a).alias("a")) for d, a, _, _ in _PAIRS])
    lo, hi = (f("g", "neighbour").cast("long") for f in (F.least, F.greatest))
    return p.groupBy("vec_id", "name.d", "name.a", lo.alias("lo"), hi.alias("hi")).agg(F.count("*").alias("n"))


_DFT = f"""{PIXELS}, f AS (SELECT u, v, y, x, cos(2 * pi() * (u * y + v * x) / 8) AS c, sin(2 * pi() * (u * y + v * x) / 8) AS s
  FROM range(8) a(u), range(8) b(v), range(8) c(y), range(8) d(x)),
spec AS (SELECT vec_id, (u + 4) % 8 - 4 AS fy, (v + 4) % 8 - 4 AS fx, pow(sum(g * c), 2) + pow(sum(g * s), 2) AS p FROM pixels JOIN f USING (y, x) GROUP BY 1, u, v),
pw AS (SELECT vec_id, sqrt(fy * fy + fx * fx) AS r, p, ln(p + 1e-8) AS lp FROM spec)"""


def _ring(i: int) -> str:
    return f"round(COALESCE(avg(p) FILTER (r >= {i} / 16.0 * 4 AND r < {i + 1} / 16.0 * 4), 0.0), 3) AS ring{i}"


@query(f"""WITH {_DFT} SELECT vec_id, round(avg(lp), 6) AS mean, round(stddev_pop(lp), 6) AS std, round(median(lp), 6) AS median,
  round(COALESCE(sum(p) FILTER (r < 0.15 * 4), 0.0) / (sum(p) + 1e-8), 6) AS low, round(COALESCE(sum(p) FILTER (r >= 0.15 * 4 AND r < 0.35 * 4), 0.0) / (sum(p) + 1e-8), 6) AS middle,
  round(COALESCE(sum(p) FILTER (r >= 0.35 * 4 AND r < 4), 0.0) / (sum(p) + 1e-8), 6) AS high, {", ".join(_ring(i) for i in range(16))} FROM pw GROUP BY 1""")
def img_fft(spark: SparkSession, sf: str) -> DataFrame:
    f = planes(spark, sf).select("vec_id", images.features(F.col("g"), *_size(), "fft").alias("f"))
    rings = [F.round(F.get("f", F.lit(6 + i)), 3).alias(f"ring{i}") for i in range(16)]
    return f.select("vec_id", *_rounded(F.col("f"), ["mean", "std", "median", "low", "middle", "high"]), *rings)


_DCT = f"""{PIXELS}, k AS (SELECT u, v, y, x, (CASE u WHEN 0 THEN sqrt(0.125) ELSE 0.5 END) * (CASE v WHEN 0 THEN sqrt(0.125) ELSE 0.5 END) * cos(pi() * (2 * y + 1) * u / 16) * cos(pi() * (2 * x + 1) * v / 16) AS w
  FROM range(8) a(u), range(8) b(v), range(8) c(y), range(8) d(x)),
coef AS (SELECT vec_id, u * 8 + v AS i, sum(g * w) AS c FROM pixels JOIN k USING (y, x) GROUP BY 1, u, v)"""


@query(f"""WITH {_DCT} SELECT vec_id, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, round(median(c), 6) AS median, round(avg(CASE WHEN abs(c) < 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS zeros,
  round(avg(abs(c)) FILTER (i = 0), 6) AS dc, round(avg(abs(c)) FILTER (i BETWEEN 1 AND 9), 6) AS low, round(avg(abs(c)) FILTER (i >= 10), 6) AS high,
  round(sum(c * c) FILTER (i BETWEEN 1 AND 9) / (sum(c * c) + 1e-8), 6) AS low_share, round(sum(c * c) FILTER (i >= 10) / (sum(c * c) + 1e-8), 6) AS high_share FROM coef GROUP BY 1""")
def img_dct(spark: SparkSession, sf: str) -> DataFrame:
    f = planes(spark, sf).select("vec_id", images.features(F.col("g"), *_size(), "dct").alias("f"))
    return f.select("vec_id", *_rounded(F.col("f"), ["mean", "std", "median", "zeros", "dc", "low", "high", "low_share", "high_share"]))


def _at(r: str, c: str) -> str:
    return f"(CASE WHEN y + {r} BETWEEN 0 AND 7 AND x + {c} BETWEEN 0 AND 7 THEN gs[CAST((y + {r}) * 8 + x + {c} + 1 AS INTEGER)] ELSE 0 END)"


_SAMPLE = f"(1 - dr) * ((1 - dc) * {_at('r0', 'c0')} + dc * {_at('r0', 'c1')}) + dr * ((1 - dc) * {_at('r1', 'c0')} + dc * {_at('r1', 'c1')})"


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor((CAST(e AS DOUBLE) + 1.0) * 127.5)) AS gs FROM embeddings),
circle AS (SELECT p, round(-3 * sin(2 * pi() * p / 24), 5) AS r, round(3 * cos(2 * pi() * p / 24), 5) AS c FROM range(24) t(p)),
o AS (SELECT p, floor(r) AS r0, floor(c) AS c0, ceil(r) AS r1, ceil(c) AS c1, r - floor(r) AS dr, c - floor(c) AS dc FROM circle),
bits AS (SELECT vec_id, y, x, p, CASE WHEN {_SAMPLE} - gs[CAST(y * 8 + x + 1 AS INTEGER)] >= 0 THEN 1 ELSE 0 END AS bit FROM v, range(8) a(y), range(8) b(x), o),
turns AS (SELECT *, lag(bit) OVER (PARTITION BY vec_id, y, x ORDER BY p) AS before FROM bits),
codes AS (SELECT vec_id, CASE WHEN count(*) FILTER (bit <> before) <= 2 THEN sum(bit) ELSE 25 END AS bin FROM turns GROUP BY vec_id, y, x)
SELECT v.vec_id, CAST(b.bin AS INTEGER) AS bin, round(count(codes.bin) / (64 + 1e-8), 6) AS share FROM embeddings v CROSS JOIN range(26) b(bin) LEFT JOIN codes ON codes.vec_id = v.vec_id AND codes.bin = b.bin GROUP BY 1, 2""")
def img_lbp(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of all local binary patterns, zeros included."""
    f = planes(spark, sf).select("vec_id", images.features(F.col("g"), *_size(), "lbp").alias("f"))
    return f.select("vec_id", F.posexplode("f").alias("bin", "share")).withColumn("share", F.round("share", 6))


#: Eighths of the circle from -pi on, closed on the left; whole gradients lie on their bounds exactly.
_EIGHTH = """CASE WHEN ry < 0 AND rx < 0 THEN CASE WHEN -ry < -rx THEN 0 ELSE 1 END WHEN ry < 0 THEN CASE WHEN -ry > rx THEN 2 ELSE 3 END
  WHEN rx > 0 THEN CASE WHEN ry < rx THEN 4 ELSE 5 END WHEN rx = 0 AND ry = 0 THEN 4 WHEN ry > -rx THEN 6 ELSE 7 END"""
_NEAR = {"w": (0, -1), "e": (0, 1), "n": (-1, 0), "s": (1, 0), "nw": (-1, -1), "ne": (-1, 1), "sw": (1, -1), "se": (1, 1)}
_AROUND = ", ".join(f"COALESCE(max(o.m) FILTER (o.y = c.y + {dy} AND o.x = c.x + {dx}), 0) AS {k}" for k, (dy, dx) in _NEAR.items())
_EDGES = f"""WITH RECURSIVE {PIXELS},
k AS (SELECT i - 1 AS dy, j - 1 AS dx FROM range(3) a(i), range(3) b(j)),
grad AS (SELECT c.vec_id, c.y, c.x, CAST(sum(k.dx * (2 - abs(k.dy)) * n.g) AS BIGINT) AS ex, CAST(sum(k.dy * (2 - abs(k.dx)) * n.g) AS BIGINT) AS ey,
    CAST(sum(k.dx * (2 - abs(k.dy)) * m.g) AS BIGINT) AS rx, CAST(sum(k.dy * (2 - abs(k.dx)) * m.g) AS BIGINT) AS ry
  FROM pixels c CROSS JOIN k
  JOIN pixels n ON n.vec_id = c.vec_id AND n.y = greatest(0, least(7, c.y + k.dy)) AND n.x = greatest(0, least(7, c.x + k.dx))
  JOIN pixels m ON m.vec_id = c.vec_id AND m.y = 7 - abs(7 - abs(c.y + k.dy)) AND m.x = 7 - abs(7 - abs(c.x + k.dx)) GROUP BY 1, 2, 3),
mag AS (SELECT *, abs(ex) + abs(ey) AS m FROM grad),
near AS (SELECT c.vec_id, c.y, c.x, c.ex, c.ey, c.rx, c.ry, c.m, {_AROUND} FROM mag c JOIN mag o ON o.vec_id = c.vec_id AND abs(o.y - c.y) <= 1 AND abs(o.x - c.x) <= 1 GROUP BY 1, 2, 3, 4, 5, 6, 7, 8),
thin AS MATERIALIZED (SELECT vec_id, y, x, rx, ry, m FROM near WHERE m > 50 AND CASE WHEN abs(ey) < abs(ex) * CAST(0.41421356237 AS DOUBLE) THEN m > w AND m >= e
  WHEN abs(ey) > abs(ex) * CAST(2.41421356237 AS DOUBLE) THEN m > n AND m >= s WHEN (ex < 0) = (ey < 0) THEN m > nw AND m > se ELSE m > ne AND m > sw END),
edge AS (SELECT vec_id, y, x FROM thin WHERE m > 150
  UNION SELECT t.vec_id, t.y, t.x FROM edge JOIN thin t ON t.vec_id = edge.vec_id AND abs(t.y - edge.y) <= 1 AND abs(t.x - edge.x) <= 1),
found AS (SELECT vec_id, {_EIGHTH} AS d FROM edge JOIN thin USING (vec_id, y, x))"""
_DIRECTIONS = ", ".join(f"round(count(d) FILTER (d = {i}) / (count(d) + 1e-8), 6) AS d{i}" for i in range(8))


@query(f"{_EDGES} SELECT v.vec_id, round(count(d) / 64, 6) AS density, {_DIRECTIONS} FROM embeddings v LEFT JOIN found ON found.vec_id = v.vec_id GROUP BY 1")
def img_edge(spark: SparkSession, sf: str) -> DataFrame:
    """The share of edge pixels and of gradient directions there."""
    f = planes(spark, sf).select("vec_id", images.features(F.col("g"), *_size(), "edge").alias("f"))
    return f.select("vec_id", *_rounded(F.col("f"), ["density", *(f"d{i}" for i in range(8))]))


_TAPS = ", ".join(f"({t}, CAST({lo!r} AS DOUBLE), CAST({hi!r} AS DOUBLE))" for t, (lo, hi) in enumerate(zip(DB4.tolist(), (x * (-1) ** (t + 1) for t, x in enumerate(DB4[::-1].tolist())))))


@query(f"""WITH {PIXELS}, taps(t, lo, hi) AS (VALUES {_TAPS}),
terms AS (SELECT b, j, 2 * j + 1 - t AS i, CASE b WHEN 'a' THEN lo ELSE hi END AS w FROM taps, range(7) r(j), (VALUES ('a'), ('d')) k(b)),
f AS (SELECT b, j, CASE WHEN i < 0 THEN -1 - i WHEN i > 7 THEN 15 - i ELSE i END AS i, sum(w) AS w FROM terms GROUP BY 1, 2, 3),
coef AS (SELECT vec_id, h.b || v.b AS band, h.j AS hj, v.j AS vj, sum(g * h.w * v.w) AS c FROM pixels JOIN f h ON h.i = x JOIN f v ON v.i = y GROUP BY 1, 2, 3, 4),
bands AS (SELECT vec_id, band, avg(c) AS mean, stddev_pop(c) AS std, sum(c * c) AS energy FROM coef GROUP BY 1, 2),
shares AS (SELECT *, energy / (sum(energy) OVER (PARTITION BY vec_id) + 1e-8) AS share FROM bands)
SELECT vec_id, band, round(mean, 6) AS mean, round(std, 6) AS std, round(energy, 2) AS energy, round(avg(share) OVER p, 6) AS share_mean, round(stddev_pop(share) OVER p, 6) AS share_std FROM shares WINDOW p AS (PARTITION BY vec_id)""")
def img_wavelet(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of the four bands of a plane's one level."""
    f = planes(spark, sf).select("vec_id", images.features(F.col("g"), *_size(), "wavelet").alias("f"))
    x = lambda i, n=6: F.round(F.get("f", F.lit(i)), n)
    bands = [F.struct(F.lit(b).alias("band"), x(3 * k).alias("mean"), x(3 * k + 1).alias("std"), x(3 * k + 2, 2).alias("energy")) for k, b in enumerate(("aa", "ad", "da", "dd"))]
    return f.select("vec_id", F.explode(F.array(*bands)).alias("b"), x(12).alias("share_mean"), x(13).alias("share_std")).select("vec_id", "b.*", "share_mean", "share_std")


def _group(kind: str, columns: list[str]) -> str:
    return f"SELECT vec_id, '{kind}' AS kind, CAST(unnest(range({len(columns)})) AS INTEGER) AS i, unnest([{', '.join(columns)}]) AS value FROM ({ORACLE['img_' + kind]})"


_LBP_GROUP = f"SELECT vec_id, 'lbp' AS kind, bin AS i, share AS value FROM ({ORACLE['img_lbp']})"
_GLCM_GROUP = f"SELECT vec_id, 'glcm' AS kind, CAST(12 * unnest(range(4)) + (d - 1) * 4 + a // 45 AS INTEGER) AS i, unnest([contrast, dissimilarity, homogeneity, energy]) AS value FROM ({ORACLE['img_glcm']})"
_FFT_GROUP = _group("fft", ["mean", "std", "median", "low", "middle", "high", *(f"ring{i}" for i in range(16))])
_DCT_GROUP = _group("dct", ["mean", "std", "median", "zeros", "dc", "low", "high", "low_share", "high_share"])
_LAPLACIAN_GROUP = _group("laplacian", ["laplacian"])
_EDGE_GROUP = _group("edge", ["density", *(f"d{i}" for i in range(8))])


@query(f"SELECT vec_id, kind, i, value + 0.0 AS value FROM ({' UNION ALL '.join((_LBP_GROUP, _GLCM_GROUP, _EDGE_GROUP, _FFT_GROUP, _DCT_GROUP, _LAPLACIAN_GROUP))})")
def feature_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """All feature groups in one pass, a row for each value, zeros included."""
    kinds = ("lbp", "glcm", "edge", "fft", "dct", "laplacian")
    p = planes(spark, sf).select("vec_id", images.bundle(F.col("g"), *_size(), kinds).alias("f"))
    digits = lambda kind: lambda v, i: F.when(i < 6, F.round(v, 6)).otherwise(F.round(v, 3)) if kind == "fft" else F.round(v + 1e-7, 4) if kind == "laplacian" else F.round(v, 6)
    groups = F.array(*[F.struct(F.lit(k).alias("kind"), F.transform(f"f.{k}", digits(k)).alias("values")) for k in kinds])
    rows = p.select("vec_id", F.explode(groups).alias("g"))
    return rows.select("vec_id", "g.kind", F.posexplode("g.values").alias("i", "value")).withColumn("value", F.col("value") + 0.0)


@query(f"""WITH {PIXELS}, s AS (
  SELECT c.vec_id, c.y, c.x, sum(CASE n.x - c.x WHEN 1 THEN 1 WHEN -1 THEN -1 ELSE 0 END * (2 - abs(n.y - c.y)) * n.g) AS gx, sum(CASE n.y - c.y WHEN 1 THEN 1 WHEN -1 THEN -1 ELSE 0 END * (2 - abs(n.x - c.x)) * n.g) AS gy
  FROM pixels c JOIN pixels n ON n.vec_id = c.vec_id AND abs(n.y - c.y) <= 1 AND abs(n.x - c.x) <= 1 WHERE c.y BETWEEN 1 AND 6 AND c.x BETWEEN 1 AND 6 GROUP BY 1, 2, 3),
b AS (SELECT vec_id, least(CAST(floor((atan2(gy, gx) + pi()) / (2 * pi()) * 8) AS BIGINT), 7) AS bin FROM s WHERE gx <> 0 OR gy <> 0)
SELECT vec_id, bin, count(*) AS n FROM b GROUP BY 1, 2""")
def sobel_directions(spark: SparkSession, sf: str) -> DataFrame:
    """Gradient directions of inner pixels in eight bins, in column functions alone."""

    def g(y: int, x: int) -> Column:
        return F.get("g", F.lit(y * SIDE + x))

    bins = []
    for y in range(1, SIDE - 1):
        for x in range(1, SIDE - 1):
            gx = g(y - 1, x + 1) - g(y - 1, x - 1) + 2 * (g(y, x + 1) - g(y, x - 1)) + g(y + 1, x + 1) - g(y + 1, x - 1)
            gy = g(y + 1, x - 1) - g(y - 1, x - 1) + 2 * (g(y + 1, x) - g(y - 1, x)) + g(y + 1, x + 1) - g(y - 1, x + 1)
            bins.append(F.struct(gx.alias("gx"), gy.alias("gy")))
    s = planes(spark, sf).select("vec_id", F.explode(F.array(*bins)).alias("s")).filter("s.gx <> 0 or s.gy <> 0")
    bin_ = F.least(F.floor((F.atan2("s.gy", "s.gx") + F.pi()) / (2 * F.pi()) * 8), F.lit(7))
    return s.groupBy("vec_id", bin_.alias("bin")).agg(F.count("*").alias("n"))


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """Planes repeated to 8, 16 or 24 columns and 8 or 16 rows, as rows of pixels."""
    across, down = 1 + F.col("vec_id") % 3, 1 + F.col("vec_id") % 2
    p = planes(spark, sf).select(F.col("vec_id").alias("image_id"), (SIDE * down).cast("int").alias("height"), (SIDE * across).cast("int").alias("width"), across.cast("int").alias("across"), "g", F.explode(F.sequence(F.lit(0), (SIDE * down - 1).cast("int"))).alias("y"))
    return p.select("image_id", "height", "width", "y", F.flatten(F.array_repeat(F.slice("g", F.col("y") % SIDE * SIDE + 1, SIDE), F.col("across"))).alias("g"))


def _resampled(width: str, height: str) -> str:
    """SQL of the planes at other sizes, over the same weights."""
    return f"""{PIXELS}, px AS (SELECT vec_id AS image_id, 8 * (1 + vec_id % 3) AS w0, 8 * (1 + vec_id % 2) AS h0, u * 8 + y AS y, a * 8 + x AS x, g FROM pixels, range(3) r(a), range(2) s(u) WHERE a <= vec_id % 3 AND u <= vec_id % 2),
im AS (SELECT DISTINCT image_id, w0, h0, CAST({width} AS BIGINT) AS w1, CAST({height} AS BIGINT) AS h1 FROM px),
pairs AS (SELECT w0 AS n, w1 AS m FROM im UNION SELECT h0, h1 FROM im),
arg AS (SELECT n, m, j, i, (i + 0.5 - (j + 0.5) * n::DOUBLE / m) / greatest(1.0, n::DOUBLE / m) AS x FROM pairs, range(24) r(i), range(24) s(j) WHERE i < n AND j < m),
ker AS (SELECT n, m, j, i, CASE WHEN abs(x) >= 3 THEN 0.0 WHEN x = 0 THEN 1.0 ELSE sin(pi() * x) / (pi() * x) * sin(pi() * x / 3) / (pi() * x / 3) END AS k FROM arg),
wt AS (SELECT n, m, j, i, k / sum(k) OVER (PARTITION BY n, m, j) AS w FROM ker),
side AS (SELECT image_id, w1, h0, h1, y, j AS x, sum(g * w) AS v FROM px JOIN im USING (image_id, w0, h0) JOIN wt ON n = w0 AND m = w1 AND i = x GROUP BY 1, 2, 3, 4, 5, 6),
new AS (SELECT image_id, w1, h1, j AS y, x, greatest(0, least(255, floor(round(sum(v * w), 6) + 0.5)))::INTEGER AS g FROM side JOIN wt ON n = h0 AND m = h1 AND i = y GROUP BY 1, 2, 3, 4, 5)"""


_WITHIN, _COVER = "least(1.0, least(13.0 / w0, 11.0 / h0))", "greatest(6.0 / w0, 5.0 / h0)"


@query(f"WITH {_resampled(f'floor(w0 * {_WITHIN})', f'floor(h0 * {_WITHIN})')} SELECT image_id, h1::INTEGER AS height, w1::INTEGER AS width, y::INTEGER AS y, x::INTEGER AS x, g FROM new")
def img_resize(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of planes shrunk to 13 x 11 at most."""
    return resample.within(_rows(spark, sf), 13, 11)


CROPPED = f"WITH {_resampled(f'greatest(6, round_even(w0 * {_COVER}, 0))', f'greatest(5, round_even(h0 * {_COVER}, 0))')} SELECT image_id, (y - (h1 - 5) // 2)::INTEGER AS y, (x - (w1 - 6) // 2)::INTEGER AS x, g FROM new WHERE y - (h1 - 5) // 2 BETWEEN 0 AND 4 AND x - (w1 - 6) // 2 BETWEEN 0 AND 5"


@query(CROPPED)
def img_crop(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of planes scaled to cover 6 x 5 and cut around the centre."""
    return resample.centre_crop(_rows(spark, sf), 6, 5).select("image_id", "y", "x", "g")


_MASKED = f"""WITH {PIXELS}, t AS (SELECT vec_id, y, x, g, CASE WHEN (y + x) % 2 = 0 THEN 255 ELSE 255 - g END AS m FROM pixels)"""


def _masked(spark: SparkSession, sf: str) -> DataFrame:
    mask = F.transform("g", lambda g, i: F.when((F.floor(i / SIDE) + i % SIDE) % 2 == 0, 255).otherwise(255 - g))
    return planes(spark, sf).withColumn("m", mask)


@query(f"{_MASKED} SELECT vec_id, CAST(sum(greatest(g, m)) AS BIGINT) AS total FROM t GROUP BY 1")
def img_mask_union(spark: SparkSession, sf: str) -> DataFrame:
    union = images.mask_union(F.col("g"), F.col("m"))
    return _masked(spark, sf).select("vec_id", F.aggregate(union, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(f"{_MASKED} SELECT vec_id, CAST(sum(greatest(g, m)) AS BIGINT) AS total, max(greatest(g, m)) AS top FROM t GROUP BY 1")
def mask_union(spark: SparkSession, sf: str) -> DataFrame:
    """As a set operation over rows of pixels."""
    p = _masked(spark, sf).select("vec_id", F.explode(F.arrays_zip("g", "m")).alias("p"))
    either = F.greatest("p.g", "p.m")
    return p.groupBy("vec_id").agg(F.sum(either).alias("total"), F.max(either).cast("long").alias("top"))


@query(f"{_MASKED} SELECT vec_id, CAST(sum(CASE WHEN m = 255 THEN g ELSE 0 END) AS BIGINT) AS total FROM t GROUP BY 1")
def img_mask_apply(spark: SparkSession, sf: str) -> DataFrame:
    kept = images.mask_apply(F.col("g"), F.col("m"))
    return _masked(spark, sf).select("vec_id", F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT event_id, round(ln(abs(value) + 1e-8), 6) AS log, round(sqrt(value * value + 9), 6) AS radius, round(abs(value - 50), 6) AS distance FROM events")
def math_log_sqrt_abs(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.round(F.ln(F.abs(v) + 1e-8), 6).alias("log"), F.round(F.sqrt(v * v + 9), 6).alias("radius"), F.round(F.abs(v - 50), 6).alias("distance"))


@query("SELECT event_id, round(atan2(value - 50, event_id % 7 - 3), 6) AS angle FROM events")
def math_atan2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(F.atan2(F.col("value") - 50, (F.col("event_id") % 7 - 3).cast("double")), 6).alias("angle"))


@query("SELECT event_id, greatest(least(CAST(floor(value) AS BIGINT), 63), 0) AS level FROM events")
def math_clip_floor(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.greatest(F.least(F.floor("value"), F.lit(63)), F.lit(0)).alias("level"))


@query("SELECT event_id, round(value / 7 + 1e-9, 4) AS rounded FROM events")
def math_round(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(F.col("value") / 7 + 1e-9, 4).alias("rounded"))


@query("SELECT doc_id, (8 - n_chars % 8) % 8 AS pad FROM documents")
def math_pad_mod(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.pmod(8 - F.col("n_chars") % 8, F.lit(8)).alias("pad"))
