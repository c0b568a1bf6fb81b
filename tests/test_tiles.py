"""Features by tiles equal those of whole planes."""

import numpy as np
import pytest

from pellucid.functions import kernels as k
from pellucid.operators import tiles

SHAPES = [(192, 192), (200, 130), (333, 71), (64, 90), (65, 64), (9, 40), (130, 9), (1, 30), (20, 1), (127, 128)]


def images():
    r = np.random.default_rng(7)
    out = []
    for i, (h, w) in enumerate(SHAPES):
        g = r.integers(0, 256, (h, w))
        if i % 2:  # smooth, with long edges that cross strips
            y, x = np.mgrid[:h, :w]
            g = ((np.sin(x / 9.0 + y / 31.0) > 0.2) * 120 + (np.hypot(x - w / 2, y - h / 2) < min(h, w) / 3) * 60 + r.integers(0, 40, (h, w))).astype(int)
        out.append((i, h, w, g.astype(np.uint8)))
    return out


@pytest.fixture(scope="module")
def strips(spark):
    planes = spark.createDataFrame([(i, h, w, g.tobytes()) for i, h, w, g in images()], "image_id long, height int, width int, data binary")
    return tiles.cut(planes).repartition(5)


def test_strips_hold_the_image_once(strips):
    found = {}
    for r in strips.collect():
        assert len(r.data) % r.width == 0 and len(r.data) // r.width < 2 * tiles.ROWS
        found.setdefault(r.image_id, []).append((r.y0, bytes(r.data)))
    for i, _, _, g in images():
        assert b"".join(d for _, d in sorted(found[i])) == g.tobytes()
    assert len(found[0]) == 3 and len(found[2]) == 5


def test_lbp(strips):
    got = {r.image_id: r.bins for r in tiles.lbp(strips).collect()}
    for i, _, _, g in images():
        assert np.allclose(got[i], k.lbp_histogram(g[None].astype(int))[0])


def test_dct(strips):
    got = {r.image_id: list(r)[1:] for r in tiles.dct(strips).collect()}
    for i, h, w, g in images():
        assert np.allclose(got[i], k.dct_features(g[None])[0], atol=1e-8)
    assert any(-(-h // 8) * -(-w // 8) > k.BLOCKS for _, h, w, _ in images())


def test_wavelet(strips):
    got = {}
    for r in tiles.wavelet(strips).collect():
        got.setdefault(r.image_id, {})[r.level, r.band] = r
    for i, h, w, g in images():
        want = k.wavelet_features(g[None])[0]
        levels = k.wavelet_levels(h, w, 3)
        order = [(levels, "aa")] + [(n, b) for n in range(levels, 0, -1) for b in ("ad", "da", "dd")]
        assert set(got[i]) == set(order)
        for at, key in enumerate(order):
            r = got[i][key]
            assert np.allclose([r.mean, r.std, r.energy], want[3 * at : 3 * at + 3], rtol=1e-6, atol=1e-5)
            assert np.allclose([r.share_mean, r.share_std], want[-2:])


def test_edges(strips):
    got = {r.image_id: [r.density, *r.directions] for r in tiles.edges(strips).collect()}
    for i, _, _, g in images():
        assert np.allclose(got[i], k.edge_features(g[None].astype(int))[0]), i


def test_an_edge_is_strong_far_from_where_it_is_seen(spark):
    """One weak line through all strips, with one strong pixel at its end; and a weak line alone."""
    g = np.zeros((640, 40), np.uint8)
    g[:, 10:] = 15
    g[:, 30:] = 30
    g[636:, 10:30] = 90
    planes = spark.createDataFrame([(1, 640, 40, g.tobytes())], "image_id long, height int, width int, data binary")
    row = tiles.edges(tiles.cut(planes)).first()
    want = k.edge_features(g[None].astype(int))[0]
    assert want[0] > 0.02 and np.allclose([row.density, *row.directions], want)


def test_blocks_become_strips(spark):
    r = np.random.default_rng(1)
    g = r.integers(0, 256, (136, 72)).astype(np.uint8)
    rows = [(1, 136, 72, y, x, 8, g[y : y + 8, x : x + 8].tobytes()) for y in range(0, 136, 8) for x in range(0, 72, 8) if (y, x) != (64, 8)]
    g[64:72, 8:16] = 0
    df = spark.createDataFrame(rows, "image_id long, height int, width int, top int, left int, side int, data binary").repartition(7)
    got = sorted(tiles.assemble(df).collect(), key=lambda x: x.y0)
    assert b"".join(bytes(x.data) for x in got) == g.tobytes() and [x.y0 for x in got] == [0, 64]


def test_no_strips(spark):
    none = spark.createDataFrame([], tiles.STRIP)
    assert tiles.lbp(none).count() == tiles.dct(none).count() == tiles.wavelet(none).count() == tiles.edges(none).count() == 0


def test_few_strips_are_objects_at_once():
    """A batch of many strips is worked on in slices: what a task holds doesn't grow with the batch."""
    import pyarrow as pa

    class Frame:
        def mapInArrow(self, run, ddl):
            return run

    alive, most = [0], [0]

    class Data(bytes):
        def __new__(cls, x):
            alive[0] += 1
            most[0] = max(most[0], alive[0])
            return super().__new__(cls, x)

        def __del__(self):
            alive[0] -= 1

    run = tiles._mapped(Frame(), lambda r: {"image_id": r["image_id"], "data": Data(8)}, "image_id long, data binary")
    got = list(run(iter([pa.RecordBatch.from_pydict({"image_id": list(range(1000))})])))
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(1000)) and most[0] <= 100
