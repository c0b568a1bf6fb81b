import re

import pytest

from pellucid.sources import manifests, results


def _csv(path, text):
    path.write_text(text)
    return str(path)


def test_minimal_manifest(spark, tmp_path):
    f = _csv(tmp_path / "test.csv", "image_path,gt_label\nimages/a.jpg,1\n")
    (r,) = manifests.read(spark, [f]).collect()
    assert (r.image_path, r.gt_label, r.dataset_name) == (f"{tmp_path}/images/a.jpg", 1, "test")


def test_image_root_and_own_dataset(spark, tmp_path):
    f = _csv(tmp_path / "rooted.csv", "image_path,gt_label,dataset_name\nnested/a.png,0,custom\n")
    (r,) = manifests.read(spark, f, "/pictures").collect()
    assert (r.image_path, r.gt_label, r.dataset_name) == ("/pictures/nested/a.png", 0, "custom")


def test_later_rows_and_files_win(spark, tmp_path):
    a = _csv(tmp_path / "a.csv", "image_path,gt_label\nx.jpg,0\nx.jpg,1\ny.jpg,1\n")
    b = _csv(tmp_path / "b.csv", "image_path,gt_label\n./z/../y.jpg,0.9\nhttps://h/i.jpg,1.9\n")
    got = {r.image_path.rsplit("/", 1)[-1]: (r.gt_label, r.dataset_name) for r in manifests.read(spark, [a, " ", b]).collect()}
    assert got == {"x.jpg": (1, "a"), "y.jpg": (0, "b"), "i.jpg": (1, "b")}


def test_bad_manifests(spark, tmp_path):
    with pytest.raises(ValueError, match="gt_label"):
        manifests.read(spark, _csv(tmp_path / "m.csv", "image_path,label\na,1\n"))
    with pytest.raises(ValueError, match="no manifest"):
        manifests.read(spark, _csv(tmp_path / "e.csv", "image_path,gt_label\n"))
    with pytest.raises(Exception, match="CAST"):
        manifests.read(spark, _csv(tmp_path / "j.csv", "image_path,gt_label\na,abc\n")).collect()
    assert manifests.paths_of(None) == [] and manifests.paths_of(["", "a "]) == ["a "]


def test_results_round_trip(spark, tmp_path):
    out = str(tmp_path / "run")
    assert results.read_lines(spark, out).count() == 0
    rows = spark.createDataFrame([(f"r{i}", f"p{i}", True, "", i % 2, (i + 1) % 2 if i == 3 else i % 2, "d") for i in range(4)], results.FINAL)
    results.write(rows, out)
    assert sorted(results.read_lines(spark, out).collect()) == sorted(rows.collect())
    (m,) = results.write_metrics(rows, out).collect()
    assert (m.Sample_Count, m.Accuracy) == (4, 0.75)
    assert spark.read.option("header", True).csv(f"{tmp_path}/run/prediction_metrics.csv").count() == 1
    assert results.write_metrics(rows.limit(0), out).count() == 0


def test_quoted_lines_and_missing_labels(spark, tmp_path):
    f = _csv(tmp_path / "q.csv", 'image_path,gt_label,note\n"x\ny.jpg",1,"two\nlines"\nz.jpg,0,\n')
    got = {r.image_path.rsplit("/", 1)[-1]: r.gt_label for r in manifests.read(spark, f).collect()}
    assert got == {"x\ny.jpg": 1, "z.jpg": 0}
    with pytest.raises(Exception, match="null"):
        manifests.read(spark, _csv(tmp_path / "n.csv", "image_path,gt_label\na.jpg,\n")).collect()


def test_hundreds_of_files_in_one_plan(spark, tmp_path):
    """As a sequential read has it: later files and rows win, whatever the files' columns."""
    want, given = {}, []
    for i in range(240):
        odd = i % 3 == 1
        lines = [("gt_label,note,image_path" if odd else "image_path,gt_label")]
        for j in range(5):
            path, label = f"/p/{(i * 7 + j * 11) % 90}.jpg", (i + j) % 2
            lines.append(f"{label},x,{path}" if odd else f"{path},{label}")
            want[path] = (label, f"m {i}")
        given.append(_csv(tmp_path / f"m {i}.csv", "\n".join(lines) + "\n"))
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    df = manifests.read(spark, given)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before)
    assert {r.image_path: (r.gt_label, r.dataset_name) for r in df.collect()} == want
    assert jobs <= 8  # of listing, and of one look for a row
    assert len(re.findall(r"Relation ?\[", df._jdf.queryExecution().optimizedPlan().toString())) == 2


def test_one_file_of_many_splits(spark, tmp_path):
    n, want = 30_000, {}
    with open(tmp_path / "big.csv", "w") as f:
        f.write("image_path,gt_label\n")
        for i in range(n):
            path, label = f"/p/{i * 7919 % 1000}.jpg", i % 5
            want[path] = label
            f.write(f"{path},{label}\n")
    conf = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = manifests.read(spark, str(tmp_path / "big.csv"), multiline=False)
        got = {r.image_path: r.gt_label for r in df.collect()}
        splits = spark.read.csv(str(tmp_path / "big.csv")).rdd.getNumPartitions()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == want and splits > 10


def test_label_maps(spark):
    from pellucid.operators import manifest as man

    rows = [(f"p{i}", i % 2) for i in range(500)] + [("p3", 7), (None, 1)]
    m = spark.createDataFrame(rows, "image_path string, gt_label int")
    maps = man.label_maps(m, 16)
    sizes = [len(r.labels) for r in maps.collect()]
    assert sum(sizes) == 500 and max(sizes) < 80 and len(sizes) == 16
    asked = spark.createDataFrame([("p3",), ("p8",), ("none",), (None,), ("p8",)], "image_path string")
    assert sorted(((r.image_path, r.label) for r in man.label_of(asked, maps, 16).collect()), key=repr) == sorted([("p3", 7), ("p8", 0), ("p8", 0), ("none", None), (None, None)], key=repr)


def test_first_and_last_rows(spark):
    from pellucid.operators import manifest as man

    df = spark.createDataFrame([("a", 1, "x"), ("a", None, "y"), ("a", 3, None), ("b", None, "z"), (None, 1, "n")], "k string, o int, v string")
    last, first = ({r.k: r.v for r in f(df, "k", "o").collect()} for f in (man.keep_last, man.keep_first))
    assert last == {"a": None, "b": "z", None: "n"} and first == {"a": "x", "b": "z", None: "n"}
