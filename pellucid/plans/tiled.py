"""Features of large planes by tiles, beside plain SQL over their pixels.

Sixty-four vectors make a square of 64 x 64 pixels, and nine such squares, every second one inverted, an image of 192 x 192:
576 cosine blocks, three strips, three wavelet levels. Places of missing vectors are 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pellucid.functions import kernels as k
from pellucid.operators import tiles
from pellucid.plans.registry import query
from pellucid.plans.views import PIXELS, SIDE, planes

ACROSS, REPEATS = 8, 3
EDGE = SIDE * ACROSS * REPEATS


def strips(spark: SparkSession, sf: str) -> DataFrame:
    g = planes(spark, sf)
    each = F.explode(F.sequence(F.lit(0), F.lit(REPEATS * REPEATS - 1))).alias("square")
    one = g.select("vec_id", "g", each).withColumns({"v": F.col("vec_id") % (ACROSS * ACROSS), "up": F.floor(F.col("square") / REPEATS), "along": F.col("square") % REPEATS})
    byte = lambda x: F.lpad(F.hex(F.when((F.col("up") + F.col("along")) % 2 == 0, x).otherwise(255 - x)), 2, "0")
    place = lambda square, at: (F.col(square) * ACROSS * SIDE + at * SIDE).cast("int")
    blocks = one.select(
        F.floor(F.col("vec_id") / (ACROSS * ACROSS)).alias("image_id"),
        F.lit(EDGE).alias("height"),
        F.lit(EDGE).alias("width"),
        place("up", F.floor(F.col("v") / ACROSS)).alias("top"),
        place("along", F.col("v") % ACROSS).alias("left"),
        F.lit(SIDE).alias("side"),
        F.unhex(F.array_join(F.transform("g", byte), "")).alias("data"),
    )
    return tiles.assemble(blocks)


_IMAGES = f"""{PIXELS}, part AS (SELECT vec_id // 64 AS image_id, u * 64 + (vec_id % 64) // 8 * 8 + y AS y, a * 64 + vec_id % 8 * 8 + x AS x, CASE WHEN (u + a) % 2 = 0 THEN g ELSE 255 - g END AS g
  FROM pixels, range(3) r(u), range(3) s(a)),
img AS MATERIALIZED (SELECT i.image_id, y, x, COALESCE(g, 0) AS g FROM (SELECT DISTINCT image_id FROM part) i CROSS JOIN range({EDGE}) r(y) CROSS JOIN range({EDGE}) s(x) LEFT JOIN part USING (image_id, y, x))"""


def _at(r: str, c: str) -> str:
    return f"(CASE WHEN y + {r} BETWEEN 0 AND {EDGE - 1} AND x + {c} BETWEEN 0 AND {EDGE - 1} THEN gs[CAST((y + {r}) * {EDGE} + x + {c} + 1 AS INTEGER)] ELSE 0 END)"


_SAMPLE = f"(1 - dr) * ((1 - dc) * {_at('r0', 'c0')} + dc * {_at('r0', 'c1')}) + dr * ((1 - dc) * {_at('r1', 'c0')} + dc * {_at('r1', 'c1')})"


@query(f"""WITH {_IMAGES}, v AS (SELECT image_id, list(CAST(g AS DOUBLE) ORDER BY y, x) AS gs FROM img GROUP BY 1),
circle AS (SELECT p, round(-3 * sin(2 * pi() * p / 24), 5) AS r, round(3 * cos(2 * pi() * p / 24), 5) AS c FROM range(24) t(p)),
o AS (SELECT p, floor(r) AS r0, floor(c) AS c0, ceil(r) AS r1, ceil(c) AS c1, r - floor(r) AS dr, c - floor(c) AS dc FROM circle),
bits AS (SELECT image_id, y, x, p, CASE WHEN {_SAMPLE} - gs[CAST(y * {EDGE} + x + 1 AS INTEGER)] >= 0 THEN 1 ELSE 0 END AS bit FROM v, range({EDGE}) a(y), range({EDGE}) b(x), o),
turns AS (SELECT *, lag(bit) OVER (PARTITION BY image_id, y, x ORDER BY p) AS before FROM bits),
codes AS (SELECT image_id, CASE WHEN count(*) FILTER (bit <> before) <= 2 THEN sum(bit) ELSE 25 END AS bin FROM turns GROUP BY image_id, y, x)
SELECT i.image_id, CAST(b.bin AS INTEGER) AS bin, round(count(codes.bin) / ({EDGE * EDGE} + 1e-8), 6) AS share FROM (SELECT DISTINCT image_id FROM img) i CROSS JOIN range(26) b(bin)
LEFT JOIN codes ON codes.image_id = i.image_id AND codes.bin = b.bin GROUP BY 1, 2""")
def tiled_lbp(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of all local binary patterns, zeros included."""
    return tiles.lbp(strips(spark, sf)).select("image_id", F.posexplode("bins").alias("bin", "share")).withColumn("share", F.round("share", 6))


_CHOSEN = ", ".join(f"({b})" for b in sorted(tiles.chosen_blocks((EDGE // 8) ** 2, k.BLOCKS).tolist()))


@query(f"""WITH {_IMAGES}, chosen(b) AS (VALUES {_CHOSEN}),
k AS (SELECT u, v, y, x, (CASE u WHEN 0 THEN sqrt(0.125) ELSE 0.5 END) * (CASE v WHEN 0 THEN sqrt(0.125) ELSE 0.5 END) * cos(pi() * (2 * y + 1) * u / 16) * cos(pi() * (2 * x + 1) * v / 16) AS w
  FROM range(8) a(u), range(8) b(v), range(8) c(y), range(8) d(x)),
p AS (SELECT image_id, y // 8 * {EDGE // 8} + x // 8 AS b, y % 8 AS y, x % 8 AS x, g FROM img),
coef AS (SELECT image_id, b, u * 8 + v AS i, sum(g * w) AS c FROM p JOIN chosen USING (b) JOIN k USING (y, x) GROUP BY 1, 2, 3)
SELECT image_id, round(avg(c), 6) + 0.0 AS mean, round(stddev_pop(c), 6) AS std, round(median(c), 6) + 0.0 AS median, round(avg(CASE WHEN abs(c) < 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS zeros,
  round(avg(abs(c)) FILTER (i = 0), 6) AS dc, round(avg(abs(c)) FILTER (i BETWEEN 1 AND 9), 6) AS low, round(avg(abs(c)) FILTER (i >= 10), 6) AS high,
  round(sum(c * c) FILTER (i BETWEEN 1 AND 9) / (sum(c * c) + 1e-8), 6) AS low_share, round(sum(c * c) FILTER (i >= 10) / (sum(c * c) + 1e-8), 6) AS high_share FROM coef GROUP BY 1""")
def tiled_dct(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine statistics over the fixed sample of 512 of the 576 blocks."""
    f = tiles.dct(strips(spark, sf))
    return f.select("image_id", *[(F.round(c, 6) + 0.0).alias(c) for c in f.columns[1:]])


def _level(n: int, source: str, size: int) -> str:
    """One level: filters along the rows, then down the columns, of a square of that size."""
    return f"""t{n} AS (SELECT b, j, CASE WHEN i < 0 THEN -1 - i WHEN i >= {size} THEN {2 * size - 1} - i ELSE i END AS i, w FROM (
    SELECT b, j, 2 * j + 1 - t AS i, CASE b WHEN 'a' THEN lo ELSE hi END AS w FROM taps, range({(size + 7) // 2}) r(j), (VALUES ('a'), ('d')) k(b))),
f{n} AS (SELECT b, j, i, sum(w) AS w FROM t{n} GROUP BY 1, 2, 3),
h{n} AS (SELECT image_id, b, y, j AS x, sum(v * w) AS v FROM {source} JOIN f{n} ON i = x GROUP BY 1, 2, 3, 4),
c{n} AS MATERIALIZED (SELECT image_id, h.b || f.b AS band, f.j AS y, h.x, sum(v * w) AS v FROM h{n} h JOIN f{n} f ON f.i = h.y GROUP BY 1, 2, 3, 4),
a{n} AS (SELECT image_id, y, x, v FROM c{n} WHERE band = 'aa')"""


_TAPS = ", ".join(f"({t}, CAST({lo!r} AS DOUBLE), CAST({hi!r} AS DOUBLE))" for t, (lo, hi) in enumerate(zip(k.DB4.tolist(), k.HIGH.tolist())))


@query(f"""WITH {_IMAGES}, taps(t, lo, hi) AS (VALUES {_TAPS}), a0 AS (SELECT image_id, y, x, CAST(g AS DOUBLE) AS v FROM img),
{_level(1, 'a0', EDGE)}, {_level(2, 'a1', (EDGE + 7) // 2)}, {_level(3, 'a2', ((EDGE + 7) // 2 + 7) // 2)},
coef AS (SELECT 1 AS level, * FROM c1 WHERE band <> 'aa' UNION ALL SELECT 2, * FROM c2 WHERE band <> 'aa' UNION ALL SELECT 3, * FROM c3),
bands AS (SELECT image_id, level, band, avg(v) AS mean, stddev_pop(v) AS std, sum(v * v) AS energy FROM coef GROUP BY 1, 2, 3),
shares AS (SELECT *, energy / (sum(energy) OVER (PARTITION BY image_id) + 1e-8) AS share FROM bands)
SELECT image_id, level, band, round(mean, 5) + 0.0 AS mean, round(std, 5) AS std, round(energy, 1) AS energy, round(avg(share) OVER p, 6) AS share_mean, round(stddev_pop(share) OVER p, 6) AS share_std FROM shares WINDOW p AS (PARTITION BY image_id)""")
def tiled_wavelet(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of the ten bands of three levels."""
    f = tiles.wavelet(strips(spark, sf))
    return f.select("image_id", "level", "band", (F.round("mean", 5) + 0.0).alias("mean"), F.round("std", 5).alias("std"), F.round("energy", 1).alias("energy"), F.round("share_mean", 6).alias("share_mean"), F.round("share_std", 6).alias("share_std"))


_EIGHTH = """CASE WHEN ry < 0 AND rx < 0 THEN CASE WHEN -ry < -rx THEN 0 ELSE 1 END WHEN ry < 0 THEN CASE WHEN -ry > rx THEN 2 ELSE 3 END
  WHEN rx > 0 THEN CASE WHEN ry < rx THEN 4 ELSE 5 END WHEN rx = 0 AND ry = 0 THEN 4 WHEN ry > -rx THEN 6 ELSE 7 END"""
_TOP = EDGE - 1


@query(f"""WITH RECURSIVE {_IMAGES}, k AS (SELECT i - 1 AS dy, j - 1 AS dx FROM range(3) a(i), range(3) b(j)),
v AS (SELECT image_id, list(g ORDER BY y, x) AS gs FROM img GROUP BY 1),
spread AS (SELECT image_id, y, x, dy, dx, gs[CAST(greatest(0, least({_TOP}, y + dy)) * {EDGE} + greatest(0, least({_TOP}, x + dx)) + 1 AS INTEGER)] AS n,
    gs[CAST(({_TOP} - abs({_TOP} - abs(y + dy))) * {EDGE} + {_TOP} - abs({_TOP} - abs(x + dx)) + 1 AS INTEGER)] AS m FROM v, range({EDGE}) a(y), range({EDGE}) b(x), k),
grad AS (SELECT image_id, y, x, CAST(sum(dx * (2 - abs(dy)) * n) AS BIGINT) AS ex, CAST(sum(dy * (2 - abs(dx)) * n) AS BIGINT) AS ey,
    CAST(sum(dx * (2 - abs(dy)) * m) AS BIGINT) AS rx, CAST(sum(dy * (2 - abs(dx)) * m) AS BIGINT) AS ry FROM spread GROUP BY 1, 2, 3),
mag AS MATERIALIZED (SELECT *, abs(ex) + abs(ey) AS m FROM grad),
tall AS (SELECT *, COALESCE(lag(m) OVER d, 0) AS n, COALESCE(lead(m) OVER d, 0) AS s FROM mag WINDOW d AS (PARTITION BY image_id, x ORDER BY y)),
near AS (SELECT *, COALESCE(lag(m) OVER r, 0) AS w, COALESCE(lead(m) OVER r, 0) AS e, COALESCE(lag(n) OVER r, 0) AS nw, COALESCE(lead(n) OVER r, 0) AS ne, COALESCE(lag(s) OVER r, 0) AS sw, COALESCE(lead(s) OVER r, 0) AS se
  FROM tall WINDOW r AS (PARTITION BY image_id, y ORDER BY x)),
thin AS MATERIALIZED (SELECT image_id, y, x, rx, ry, m FROM near WHERE m > 50 AND CASE WHEN abs(ey) < abs(ex) * CAST(0.41421356237 AS DOUBLE) THEN m > w AND m >= e
  WHEN abs(ey) > abs(ex) * CAST(2.41421356237 AS DOUBLE) THEN m > n AND m >= s WHEN (ex < 0) = (ey < 0) THEN m > nw AND m > se ELSE m > ne AND m > sw END),
edge AS (SELECT image_id, y, x FROM thin WHERE m > 150
  UNION SELECT t.image_id, t.y, t.x FROM (SELECT image_id, y + dy AS y, x + dx AS x FROM edge CROSS JOIN k) e JOIN thin t ON t.image_id = e.image_id AND t.y = e.y AND t.x = e.x),
found AS (SELECT image_id, {_EIGHTH} AS d FROM edge JOIN thin USING (image_id, y, x))
SELECT i.image_id, round(count(d) / {EDGE * EDGE}, 6) AS density, {", ".join(f"round(count(d) FILTER (d = {i}) / (count(d) + 1e-8), 6) AS d{i}" for i in range(8))} FROM (SELECT DISTINCT image_id FROM img) i LEFT JOIN found USING (image_id) GROUP BY 1""")
def tiled_edge(spark: SparkSession, sf: str) -> DataFrame:
    """The share of edge pixels and of gradient directions there; edges go on across strips."""
    f = tiles.edges(strips(spark, sf))
    return f.select("image_id", F.round("density", 6).alias("density"), *[F.round(F.get("directions", F.lit(i)), 6).alias(f"d{i}") for i in range(8)])
