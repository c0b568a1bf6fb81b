import math

import numpy as np
import pytest

from pellucid.functions import kernels as k


def test_constant_plane():
    g = np.full((1, 8, 8), 7)
    assert k.laplacian_variance(g)[0] == 0
    f = k.glcm_features(g)[0]
    assert np.allclose(f[:24], 0) and np.allclose(f[24:], 1)
    assert np.allclose(k.edge_features(g), 0)
    d = k.dct_features(g)[0]
    assert d[4] == pytest.approx(56) and d[7] == pytest.approx(0) and d[8] == pytest.approx(0)
    assert k.lbp_histogram(g)[0].sum() == pytest.approx(1)


def test_impulse_has_a_flat_spectrum():
    g = np.zeros((1, 8, 8))
    g[0, 3, 4] = 1
    f = k.fft_features(g)[0]
    assert f[0] == pytest.approx(0, abs=1e-7) and f[1] == pytest.approx(0, abs=1e-7)
    assert k.laplacian_variance(g)[0] == pytest.approx(20 / 64)


def test_checkerboard_and_ramp():
    y, x = np.mgrid[:8, :8]
    board = ((x + y) % 2 * 255)[None]
    f = k.glcm_features(board)[0].reshape(4, 3, 4)
    assert f[0, 0, 0] == 63**2 and f[0, 1, 0] == 0
    dx, dy = k.sobel((x * 10)[None])
    assert np.all(dx[0][:, 1:-1] == 80) and np.all(dy[0][1:-1] == 0)


def test_step_edge():
    g = np.zeros((1, 16, 16))
    g[:, :, 8:] = 255
    e = k.canny(g)[0]
    assert e.any(axis=1).all() and e.sum(axis=1).max() == 1


def test_dct_is_orthonormal_and_pads():
    c = k.dct_matrix(8)
    assert np.allclose(c @ c.T, np.eye(8))
    assert k.dct_features(np.arange(35).reshape(1, 7, 5)).shape == (1, 9)
    assert k.dct_features(np.arange(200 * 200).reshape(1, 200, 200)).shape == (1, 9)


def test_wavelet_keeps_energy_inside():
    g = np.random.default_rng(0).normal(size=(2, 64, 64))
    f = k.wavelet_features(g)
    assert f.shape == (2, 32)
    assert math.sqrt(2) == pytest.approx(k.DB4.sum())
    flat = k.wavelet_features(np.full((1, 64, 64), 3.0))[0]
    assert flat[30] == pytest.approx(0.1)


def test_resize_and_crop():
    flat = np.full((20, 30), 9, np.uint8)
    assert (k.resize(flat, 7, 5) == 9).all() and k.centre_crop(flat, 16, 16).shape == (16, 16)


def test_luma():
    assert k.luma(np.array([[255, 255, 255], [255, 0, 0]])).tolist() == [255, 76]


def test_png_round_trip(spark, tmp_path):
    from pellucid.sources import images

    g = np.random.default_rng(1).integers(0, 256, (9, 5)).astype(np.uint8)
    assert (images.read_png(images.png(g)) == g).all()
    (tmp_path / "a.png").write_bytes(images.png(g))
    (tmp_path / "b.PNG").write_bytes(b"broken")
    (tmp_path / "c.gif").write_bytes(b"x")
    assert images.list_images(spark, str(tmp_path)).count() == 2
    rows = {r.path[-5:]: r for r in images.decode(spark, str(tmp_path)).filter("path not like '%.gif'").collect()}
    assert rows["b.PNG"].error and rows["b.PNG"].data is None
    assert rows["a.png"].error is None and (rows["a.png"].height, rows["a.png"].width) == (9, 5)
    from pyspark.sql import functions as F

    plane = images.decode(spark, str(tmp_path)).filter("path like '%a.png'").select(images.luma_plane(F.col("data"), F.col("channels")).alias("g")).first().g
    assert plane == g.reshape(-1).tolist()


def test_many_small_images_are_read_by_few_tasks(spark, tmp_path):
    from pellucid.sources import images

    data = images.png(np.zeros((2, 2), np.uint8))
    for i in range(1100):
        (tmp_path / f"v{i}.png").write_bytes(b"broken" if i % 100 == 0 else data)
    (tmp_path / "v.webp").write_bytes(b"RIFF")
    listed, decoded = images.list_images(spark, str(tmp_path)), images.decode(spark, str(tmp_path))
    assert all(df.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism for df in (listed, decoded))
    rows = decoded.select("path", "error").collect()
    assert {r.path for r in rows} == {r.path for r in listed.select(images.same_uri(listed["path"]).alias("path")).collect()}
    assert len(rows) == 1101 and sum(r.error is not None for r in rows) == 12


def test_image_scan_reads_its_folder_once(spark):
    import __spark_entry__ as e

    df = e.queries()["image_scan"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_bundle_takes_settings_and_registered_extractors(spark):
    from pyspark.sql import functions as F

    from pellucid.operators import images, plugins

    g = np.random.default_rng(3).integers(0, 256, (2, 64, 48))
    rows = [(g[0].ravel().tolist(), 64, 48), (g[1].ravel().tolist(), 64, 48), (None, 64, 48), ([1, 2], 64, 48)]
    df = spark.createDataFrame(rows, "g array<int>, h int, w int")
    known = plugins.default_features()
    known.register("mean", lambda x: x.mean(axis=(1, 2))[:, None])
    made = images.bundle(F.col("g"), F.col("h"), F.col("w"), ("fft", "wavelet", "mean", "lbp"), {"radial_bins": 4, "wavelet_levels": 2}, known, {"lbp": False})
    got = [r.f for r in df.select(made.alias("f")).collect()]
    assert got[0].__fields__ == ["fft", "wavelet", "mean"]
    for f, x in zip(got, g):
        assert len(f.fft) == 6 + 4 and f.mean == [pytest.approx(x.mean())]
        assert len(f.wavelet) == 3 * (1 + 3 * 2) + 2
    assert all(v is None for f in got[2:] for v in f)
    with pytest.raises(ValueError):
        images.bundle(F.col("g"), F.col("h"), F.col("w"), ("nothing",))
    with pytest.raises(ValueError):
        images.bundle(F.col("g"), F.col("h"), F.col("w"), ("fft",), switches={"fft": False})


def test_files_are_whole_and_written_again(spark):
    from pyarrow.fs import FileSelector, FileSystem

    from pellucid.sources.files import new_folder, write_files

    folder = new_folder(spark)
    df = spark.createDataFrame([("a.txt", bytearray(b"x")), ("b.txt", bytearray(b""))], "name string, content binary")
    for _ in range(2):
        assert write_files(df.repartition(2), folder) == 2
    fs, base = FileSystem.from_uri(folder)
    got = [f for f in fs.get_file_info(FileSelector(base)) if not f.base_name.startswith(".")]
    assert sorted((f.base_name, f.size) for f in got) == [("a.txt", 1), ("b.txt", 0)]
    assert new_folder(spark) != folder
    assert write_files(df.limit(0), folder) == 0
