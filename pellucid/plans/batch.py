"""Manifests, results, profiles and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pellucid.functions import paths, text
from pellucid.operators import evaluation, results
from pellucid.operators import manifest as man
from pellucid.plans.registry import query
from pellucid.plans.views import MANIFEST, VERDICTS, manifest, table, verdicts
from pellucid.sources import manifests, profiles
from pellucid.sources import results as stored
from pellucid.sources.files import make_folder, new_folder, write_files

_CONFUSION = f"""WITH {VERDICTS}, c AS (
  SELECT dataset_name, count(*) AS n, count(*) FILTER (gt_label = 1 AND finally_result = 1) AS tp, count(*) FILTER (gt_label = 0 AND finally_result = 1) AS fp,
    count(*) FILTER (gt_label = 1 AND finally_result = 0) AS fn, count(*) FILTER (gt_label = 0 AND finally_result = 0) AS tn
  FROM verdicts WHERE finally_result IN (0, 1) AND gt_label IN (0, 1) GROUP BY {{by}})"""
_METRICS = """n AS "Sample_Count", round((tp + tn) / n, 4) AS "Accuracy", CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE round(2 * tp / (2 * tp + fp + fn), 4) END AS "F1",
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp / (tp + fp), 4) END AS "Precision", CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp / (tp + fn), 4) END AS "Recall" FROM c"""
_WHOLE = _CONFUSION.replace("SELECT dataset_name, count(*) AS n", "SELECT count(*) AS n").replace(" GROUP BY {by}", "")


@query(f"{_WHOLE} SELECT {_METRICS} WHERE n > 0")
def only_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluation of a whole run."""
    return evaluation.metrics(verdicts(spark, sf))


@query(f"{_CONFUSION.format(by='1')} SELECT dataset_name, {_METRICS}")
def metrics_by_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.metrics(verdicts(spark, sf), "dataset_name")


@query(f"{_CONFUSION.format(by='1')} SELECT dataset_name, n, tp, fp, fn, tn FROM c")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.confusion(verdicts(spark, sf), "dataset_name")


@query(f"{_WHOLE} SELECT n AS sample_count FROM c")
def sample_count(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.confusion(verdicts(spark, sf)).select(F.col("n").alias("sample_count"))


for _name, _col in (("accuracy", "Accuracy"), ("f1", "F1"), ("precision", "Precision"), ("recall", "Recall")):

    def _one(spark: SparkSession, sf: str, col: str = _col) -> DataFrame:
        return evaluation.metrics(verdicts(spark, sf)).select(F.col(col).alias(col.lower()))

    query(f'{_WHOLE} SELECT "{_col}" AS {_col.lower()} FROM (SELECT {_METRICS})', _name)(_one)


@query(f"WITH {VERDICTS} SELECT image_path, finally_result, gt_label FROM verdicts WHERE finally_result IN (0, 1) AND gt_label IN (0, 1)")
def valid_labels(spark: SparkSession, sf: str) -> DataFrame:
    v = verdicts(spark, sf)
    return v.filter(evaluation.is_binary(F.col("finally_result")) & evaluation.is_binary(F.col("gt_label"))).select("image_path", "finally_result", "gt_label")


def _files(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The manifest as two files: the second overrides the paths of even ids, with other labels, and has no dataset column."""
    m = manifest(spark, sf)
    first = m.select("image_path", F.col("gt_label").cast("string").alias("gt_label"), "dataset_name", F.col("doc_id").alias("row_ord"))
    second = m.filter("doc_id % 2 = 0").select("image_path", F.concat((1 - F.col("gt_label")).cast("string"), F.lit(".9")).alias("gt_label"), F.col("doc_id").alias("row_ord"))
    return [first, second]


_FILES = f"""{MANIFEST}, files AS (
  SELECT image_path, CAST(gt_label AS VARCHAR) AS gt_label, dataset_name, doc_id AS row_ord, 0 AS file_ord FROM manifest
  UNION ALL SELECT image_path, (1 - gt_label) || '.9', 'second', doc_id, 1 FROM manifest WHERE doc_id % 2 = 0)"""
_LABEL = "CAST(trunc(CAST(gt_label AS DOUBLE)) AS INTEGER) AS gt_label"


def _union(spark: SparkSession, sf: str) -> DataFrame:
    files = [man.with_dataset(f, F.lit("second")).withColumn("gt_label", man.label(F.col("gt_label"))) for f in _files(spark, sf)]
    return man.union(files)


_UNION = f"WITH {_FILES}, u AS (SELECT image_path, {_LABEL}, dataset_name, row_ord, file_ord FROM files)"


@query(f"{_UNION} SELECT '/' || image_path AS image_path, gt_label, dataset_name FROM u QUALIFY row_number() OVER (PARTITION BY image_path ORDER BY file_ord DESC, row_ord DESC) = 1")
def manifest_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Two manifests written as CSV, each as many files, and read, checked and united; the later row of a path is kept."""
    folder = new_folder(spark)
    given = [f"{folder}/first", f"{folder}/second"]
    for df, path in zip(_files(spark, sf), given):
        df.repartition(12).drop("row_ord").write.option("header", True).csv(path)
    return manifests.read(spark, given, "/", multiline=False)


@query(f"{_UNION} SELECT * FROM u")
def union_manifests(spark: SparkSession, sf: str) -> DataFrame:
    return _union(spark, sf)


@query(f"{_UNION} SELECT row_ord, file_ord, gt_label FROM u")
def label_cast(spark: SparkSession, sf: str) -> DataFrame:
    return _union(spark, sf).select("row_ord", "file_ord", "gt_label")


@query(f"{_UNION} SELECT row_ord, file_ord, dataset_name FROM u")
def dataset_default(spark: SparkSession, sf: str) -> DataFrame:
    return _union(spark, sf).select("row_ord", "file_ord", "dataset_name")


@query(f"WITH {MANIFEST} SELECT image_path, COALESCE(NULLIF(dataset_name, 'src0'), 'nan') AS dataset_name FROM manifest")
def dataset_name_out(spark: SparkSession, sf: str) -> DataFrame:
    """A missing dataset is called nan; src0 stands for a missing one."""
    return manifest(spark, sf).select("image_path", F.coalesce(F.nullif("dataset_name", F.lit("src0")), F.lit("nan")).alias("dataset_name"))


_KEYED = f"WITH {MANIFEST}, k AS (SELECT doc_id % 50 AS key, doc_id, gt_label, dataset_name FROM manifest)"


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    return manifest(spark, sf).select((F.col("doc_id") % 50).alias("key"), "doc_id", "gt_label", "dataset_name")


@query(f"{_KEYED} SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id DESC) = 1")
def dedup_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    return man.keep_last(_keyed(spark, sf), "key", "doc_id")


@query(f"{_KEYED} SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1")
def dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return man.keep_first(_keyed(spark, sf), "key", "doc_id")


@query(f"{_UNION} SELECT DISTINCT image_path FROM u")
def distinct_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _union(spark, sf).select("image_path").distinct()


@query(f"{_UNION} SELECT image_path, first(gt_label ORDER BY file_ord, row_ord) AS gt_label, first(dataset_name ORDER BY file_ord, row_ord) AS dataset_name, count(*) AS n FROM u GROUP BY 1")
def group_by_image(spark: SparkSession, sf: str) -> DataFrame:
    return man.by_image(_union(spark, sf).withColumn("o", F.struct("file_ord", "row_ord")), "o")


@query(f"{_UNION} SELECT image_path, first(gt_label ORDER BY file_ord, row_ord) AS gt_label FROM u GROUP BY 1")
def group_first(spark: SparkSession, sf: str) -> DataFrame:
    return _union(spark, sf).groupBy("image_path").agg(F.min_by("gt_label", F.struct("file_ord", "row_ord")).alias("gt_label"))


@query(f"WITH {MANIFEST} SELECT 'images/' || d.source || '/' || d.doc_id || '.jpg' AS image_path, CAST(m.gt_label AS INTEGER) AS label FROM documents d LEFT JOIN manifest m USING (doc_id)")
def label_map(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's label, looked up in the maps of its path's bucket; most have none."""
    m = manifest(spark, sf)
    buckets = 1 + m.count() // man.IN_A_MAP
    d = table(spark, sf, "documents").select(F.concat(F.lit("images/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image_path"))
    return man.label_of(d, man.label_maps(m, buckets), buckets).select("image_path", F.col("label").cast("int").alias("label"))


@query(f"WITH {MANIFEST} SELECT image_path, gt_label FROM manifest ORDER BY image_path")
def sort_by_path(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest in code-point order of its paths, sorted by ranges."""
    return manifest(spark, sf).select("image_path", "gt_label").orderBy("image_path")


@query(f"WITH {MANIFEST} SELECT image_path, md5(image_path) || '.json' AS result_id FROM manifest")
def result_id(spark: SparkSession, sf: str) -> DataFrame:
    return manifest(spark, sf).select("image_path", paths.result_id(F.col("image_path")).alias("result_id"))


@query(f"WITH {MANIFEST} SELECT image_path, sha256(CASE WHEN doc_id % 2 = 0 THEN image_path ELSE 'b64-' || doc_id END) AS session_id FROM manifest")
def session_id(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(F.col("doc_id") % 2 == 0, F.col("image_path"))
    return manifest(spark, sf).select("image_path", paths.session_id(path, F.concat(F.lit("b64-"), F.col("doc_id").cast("string"))).alias("session_id"))


@query(f"WITH {MANIFEST} SELECT image_path, md5(image_path) || '.json' AS result_id FROM manifest WHERE doc_id % 3 <> 0")
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of a run of which every third image is done."""
    m = manifest(spark, sf)
    done = m.filter("doc_id % 3 = 0").select(paths.result_id(F.col("image_path")).alias("result_id"))
    return results.pending(m, done).select("image_path", "result_id")


_SAVABLE = "finally_result IS NOT NULL AND is_success IS DISTINCT FROM FALSE"


@query(f"WITH {VERDICTS} SELECT image_path FROM verdicts WHERE {_SAVABLE}")
def savable(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts(spark, sf).filter(results.savable(F.col("is_success"), F.col("finally_result"))).select("image_path")


@query(f"WITH {VERDICTS} SELECT md5(image_path) || '.json' AS result_id, image_path, is_success, CAST(finally_result AS INTEGER) AS finally_result, CAST(gt_label AS INTEGER) AS gt_label, dataset_name FROM verdicts WHERE {_SAVABLE}")
def final_sink(spark: SparkSession, sf: str) -> DataFrame:
    """The results that may be saved, written in two appends and read back."""
    v = verdicts(spark, sf).filter(results.savable(F.col("is_success"), F.col("finally_result")))
    rows = v.select(paths.result_id(F.col("image_path")).alias("result_id"), "image_path", "is_success", F.lit("why").alias("reasoning"), "finally_result", "gt_label", "dataset_name", "doc_id")
    folder = new_folder(spark)
    for part in (0, 1):
        stored.write(rows.filter(F.col("doc_id") % 2 == part).drop("doc_id"), folder)
    return stored.read_lines(spark, folder).drop("reasoning")


@query(f"WITH {VERDICTS} SELECT v.image_path, v.finally_result, m.gt_label, m.dataset_name FROM verdicts v JOIN manifest m ON v.image_path = m.image_path")
def label_attach(spark: SparkSession, sf: str) -> DataFrame:
    v = verdicts(spark, sf).select("image_path", "finally_result")
    return results.attach_labels(v, manifest(spark, sf)).select("image_path", "finally_result", "gt_label", "dataset_name")


@query(f"WITH {VERDICTS} SELECT image_path, CAST(finally_result AS INTEGER) AS finally_result, CAST(gt_label AS INTEGER) AS gt_label FROM verdicts WHERE finally_result IS NOT NULL")
def results_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of JSON files, a result in each over several lines, read by result_id's names."""
    v = verdicts(spark, sf).filter("finally_result is not null")
    doc = F.to_json(F.struct("image_path", "finally_result", "gt_label"), {"pretty": "true"})
    folder = stored.final_output(new_folder(spark))
    make_folder(spark, folder)
    write_files(v.select(paths.result_id(F.col("image_path")).alias("name"), F.encode(doc, "UTF-8").alias("content")), folder)
    return stored.read(spark, folder).select("image_path", "finally_result", "gt_label")


#: Buckets of the queries' caches.
_BUCKETS = 32


def _saved(rows: DataFrame) -> DataFrame:
    """Rows as profiles; columns that they lack are blank."""
    blank = F.lit("")
    have = {"observations": blank, "detected_anomalies": blank, "limitations": blank, "pred_label": F.lit(0), "version": F.lit(1)}
    return rows.select("image_path", *[(F.col(c) if c in rows.columns else v).alias(c) for c, v in have.items()]).withColumns({"pred_label": F.col("pred_label").cast("int"), "version": F.col("version").cast("long")})


def _cache(spark: SparkSession, sf: str, part: int) -> DataFrame:
    m = manifest(spark, sf).filter(F.col("doc_id") % 4 >= part)
    return m.select("image_path", (F.col("doc_id") + part * 1000).alias("version"), F.concat(F.lit(f"seen {part} "), "dataset_name").alias("observations"), F.col("gt_label").alias("pred_label"))


@query(f"""WITH {MANIFEST}, c AS (
  SELECT image_path, doc_id AS version, 'seen 0 ' || dataset_name AS observations, gt_label AS pred_label, 0 AS p FROM manifest
  UNION ALL SELECT image_path, doc_id + 2000, 'seen 2 ' || dataset_name, gt_label, 2 FROM manifest WHERE doc_id % 4 >= 2)
SELECT image_path, version, observations, pred_label FROM c QUALIFY row_number() OVER (PARTITION BY image_path ORDER BY version DESC, p DESC) = 1""")
def profile_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The state of a cache after three saves, of which the last is a replay."""
    root = new_folder(spark)
    for part in (0, 2, 2):
        state = profiles.save(spark, root, _saved(_cache(spark, sf, part)), _BUCKETS)
    return state.select("image_path", "version", "observations", "pred_label")


_PROFILES = f"""{MANIFEST}, profiles AS (
  SELECT image_path AS key, dataset_name || doc_id AS profile FROM manifest WHERE doc_id % 3 = 0
  UNION ALL SELECT '/data/' || image_path, dataset_name FROM manifest WHERE doc_id % 4 = 0)"""


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    m = manifest(spark, sf)
    a = m.filter("doc_id % 3 = 0").select(F.col("image_path").alias("key"), F.concat("dataset_name", F.col("doc_id").cast("string")).alias("profile"))
    return a.unionByName(m.filter("doc_id % 4 = 0").select(F.concat(F.lit("/data/"), "image_path").alias("key"), F.col("dataset_name").alias("profile")))


def _wanted(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("image_path")
    return manifest(spark, sf).select(F.col("doc_id").alias("id"), paths.candidates(path, paths.normalize_lexical(path)).alias("keys"))


_LOOKUP = f"""WITH {_PROFILES}, found AS (
  SELECT m.doc_id AS id, COALESCE(a.key, b.key) AS key, COALESCE(a.profile, b.profile) AS profile
  FROM manifest m LEFT JOIN profiles a ON a.key = m.image_path LEFT JOIN profiles b ON b.key = '/data/' || m.image_path)"""


@query(f"{_LOOKUP} SELECT * FROM found")
def profile_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return results.lookup(_wanted(spark, sf), _profiles(spark, sf))


@query(f"{_LOOKUP} SELECT id, key, profile FROM found WHERE id % 50 = 0")
def cached_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Lookups in a stored cache; buckets of no wanted key are not read."""
    root = new_folder(spark)
    profiles.save(spark, root, _saved(_profiles(spark, sf).select(F.col("key").alias("image_path"), F.col("profile").alias("observations"))), _BUCKETS)
    return profiles.lookup(spark, root, _wanted(spark, sf).filter("id % 50 = 0")).select("id", "key", F.col("profile.observations").alias("profile"))


@query(f"{_LOOKUP} SELECT id, profile IS NULL AS generated, COALESCE(profile, 'generated ' || id) AS profile FROM found")
def cache_miss(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles from a stored cache, and new ones for the images that it lacks only; the new ones are saved and found the next time."""
    root, wanted = new_folder(spark), _wanted(spark, sf)
    profiles.save(spark, root, _saved(_profiles(spark, sf).select(F.col("key").alias("image_path"), F.col("profile").alias("observations"))), _BUCKETS)
    misses = profiles.lookup(spark, root, wanted).filter("profile is null").select("id").join(wanted, "id")
    made = misses.select(F.get("keys", F.lit(0)).alias("image_path"), F.concat(F.lit("generated "), F.col("id").cast("string")).alias("observations"))
    profiles.save(spark, root, _saved(made))
    found = profiles.lookup(spark, root, wanted).select("id", F.col("profile.observations").alias("profile"))
    return found.select("id", F.startswith("profile", F.lit("generated ")).alias("generated"), "profile")


@query(f"WITH {MANIFEST} SELECT image_path, CASE WHEN doc_id % 2 = 0 THEN 'again' ELSE dataset_name END AS observations, CAST(gt_label AS INTEGER) AS pred_label FROM manifest")
def profile_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The newest state of a cache that was saved twice; rows without a path are not kept."""
    m = manifest(spark, sf)
    rows = _saved(m.select("image_path", F.col("dataset_name").alias("observations"), F.col("gt_label").alias("pred_label")))
    root = new_folder(spark)
    profiles.save(spark, root, rows.unionByName(rows.withColumn("image_path", F.lit(""))), _BUCKETS)
    newer = m.filter("doc_id % 2 = 0").select("image_path", F.lit("again").alias("observations"), F.col("gt_label").alias("pred_label"), F.lit(2).alias("version"))
    return profiles.save(spark, root, _saved(newer)).select("image_path", "observations", "pred_label")


@query(f"WITH {MANIFEST} SELECT image_path, sha256(image_path || ':0') AS session_key FROM manifest")
def session_key(spark: SparkSession, sf: str) -> DataFrame:
    """A key of an image and a workflow that is the same in every process."""
    return manifest(spark, sf).select("image_path", F.sha2(F.concat("image_path", F.lit(":0")), 256).alias("session_key"))


@query(f"WITH {MANIFEST} SELECT result_id FROM (SELECT md5(image_path) || '.json' AS result_id FROM manifest) ORDER BY 1")
def sorted_files(spark: SparkSession, sf: str) -> DataFrame:
    """Result files by name."""
    return manifest(spark, sf).select(paths.result_id(F.col("image_path")).alias("result_id")).orderBy("result_id")


@query(f"WITH {MANIFEST} SELECT doc_id FROM manifest WHERE doc_id % 3 <> 0")
def valid_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles with all their keys; every third lacks one, values may be null."""
    full = F.create_map(F.lit("observations"), F.lit("o"), F.lit("detected_anomalies"), F.lit(None).cast("string"), F.lit("pred_label"), F.lit("1"))
    part = F.create_map(F.lit("observations"), F.lit("o"))
    p = F.when(F.col("doc_id") % 3 == 0, part).otherwise(full)
    return manifest(spark, sf).filter(results.valid_profile(p)).select("doc_id")


@query(f"WITH {MANIFEST} SELECT doc_id, dataset_name AS semantic_observations, image_path AS semantic_detected_anomalies, CAST(gt_label AS INTEGER) AS semantic_result FROM manifest")
def tool_project(spark: SparkSession, sf: str) -> DataFrame:
    m = manifest(spark, sf)
    return m.select("doc_id", F.col("dataset_name").alias("semantic_observations"), F.col("image_path").alias("semantic_detected_anomalies"), F.col("gt_label").cast("int").alias("semantic_result"))


@query("SELECT page_id, url, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') AS is_url FROM pages")
def is_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url", paths.is_url(F.col("url")).alias("is_url"))


@query("""WITH s AS (SELECT page_id, CASE WHEN regexp_matches(u, '^https?://') THEN u ELSE 'https://' || u END AS u FROM (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://api.openai.com/v1' WHEN 1 THEN regexp_replace(url, '^https?://', '') ELSE trim(url) END AS u FROM pages)),
p AS (SELECT page_id, regexp_extract(u, '^(https?)://', 1) AS s, regexp_extract(u, '^https?://([^/?#]*)', 1) AS h, regexp_replace(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS q FROM s)
SELECT page_id, CASE WHEN h <> '' THEN s || '://' || h || CASE WHEN q LIKE '%/v1' THEN q ELSE q || '/v1' END END AS base_url FROM p""")
def base_url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses given in full, without scheme, or not at all."""
    given = F.when(F.col("page_id") % 4 == 0, "").when(F.col("page_id") % 4 == 1, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", paths.base_url(given).alias("base_url"))


_RAW_PATH = """p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN url WHEN 3 THEN './a/../b' || page_id || '.jpg' WHEN 4 THEN '/x/./y/../z' || page_id || '.png' ELSE '../../up' || page_id || '/..//c.bmp' END AS raw FROM pages)"""
_NORMAL = "CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN raw WHEN 3 THEN '{base}/b' || page_id || '.jpg' WHEN 4 THEN '/x/z' || page_id || '.png' ELSE '{up}/c.bmp' END"


def _raw_paths(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    raw = (
        F.when(F.col("page_id") % 6 == 0, F.lit(None).cast("string"))
        .when(F.col("page_id") % 6 == 1, "  ")
        .when(F.col("page_id") % 6 == 2, F.col("url"))
        .when(F.col("page_id") % 6 == 3, F.concat(F.lit("./a/../b"), i, F.lit(".jpg")))
        .when(F.col("page_id") % 6 == 4, F.concat(F.lit("/x/./y/../z"), i, F.lit(".png")))
        .otherwise(F.concat(F.lit("../../up"), i, F.lit("/..//c.bmp")))
    )
    return table(spark, sf, "pages").select("page_id", raw.alias("raw"))


@query(f"WITH {_RAW_PATH} SELECT page_id, {_NORMAL.format(base='/data', up='')} AS path FROM p")
def path_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _raw_paths(spark, sf).select("page_id", paths.normalize_lexical(F.col("raw")).alias("path"))


@query(f"WITH {_RAW_PATH} SELECT page_id, {_NORMAL.format(base='/root/images', up='')} AS path FROM p WHERE page_id % 6 >= 2")
def path_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Paths below an image root; blank ones are no manifest rows."""
    p = _raw_paths(spark, sf).filter(F.coalesce(paths.strip(F.col("raw")), F.lit("")) != "")
    return p.select("page_id", paths.resolve(F.col("raw"), F.lit("/csv"), "/root/images").alias("path"))


@query(f"WITH {_RAW_PATH} SELECT page_id, array_to_string(list_filter(list_distinct_ordered, lambda x: x IS NOT NULL AND x <> ''), '|') AS keys FROM (SELECT page_id, CASE WHEN raw IS NOT DISTINCT FROM n THEN [raw] ELSE [raw, n] END AS list_distinct_ordered FROM (SELECT page_id, raw, {_NORMAL.format(base='/data', up='')} AS n FROM p))")
def path_candidates(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.col("raw")
    return _raw_paths(spark, sf).select("page_id", F.array_join(paths.candidates(raw, paths.normalize_lexical(raw)), "|").alias("keys"))


@query("SELECT page_id, 'data:image/' || lower(CASE WHEN page_id % 2 = 0 THEN 'PNG' ELSE 'JPEG' END) || ';base64,' || to_base64(encode(url)) AS data_url FROM pages")
def data_url(spark: SparkSession, sf: str) -> DataFrame:
    fmt = paths.format_of(F.when(F.col("page_id") % 2 == 0, "a/b.png").otherwise("a/b"))
    return table(spark, sf, "pages").select("page_id", paths.data_url(F.encode("url", "UTF-8"), fmt).alias("data_url"))


@query("SELECT page_id, url AS decoded FROM pages")
def image_b64_decode(spark: SparkSession, sf: str) -> DataFrame:
    s = paths.data_url(F.encode("url", "UTF-8"), F.lit("png"))
    return table(spark, sf, "pages").select("page_id", F.decode(paths.decode_base64(s), "UTF-8").alias("decoded"))


@query("SELECT event_id, CASE WHEN event_id % 10 - 3 > 0 THEN round(value / (event_id % 10 - 3), 6) ELSE -1.0 END AS ratio FROM events")
def safe_division(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("event_id") % 10 - 3
    return table(spark, sf, "events").select("event_id", F.round(text.safe_division(F.col("value"), d, F.lit(-1.0)), 6).alias("ratio"))


@query("SELECT event_id, '[' || CASE WHEN event_id % 2 = 0 THEN 'CONFIG_ERROR_' ELSE 'FEATURE_ERROR_' END || event_type || '] ' || props AS error FROM events")
def error_text(spark: SparkSession, sf: str) -> DataFrame:
    code = F.concat(F.when(F.col("event_id") % 2 == 0, "CONFIG_ERROR_").otherwise("FEATURE_ERROR_"), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", text.error_text(code, F.col("props")).alias("error"))
