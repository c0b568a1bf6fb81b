"""Path and URL expressions."""

import base64

from pyspark.sql import functions as F

from pellucid.functions import paths


def test_data_url_is_one_line(spark):
    data = [bytes(range(n)) for n in (0, 56, 57, 58, 200)]
    df = spark.createDataFrame([(bytearray(d),) for d in data], "d binary").coalesce(1)
    url = paths.data_url(F.col("d"), F.lit("PNG"))
    got = df.select(url.alias("u"), paths.decode_base64(url).alias("back")).collect()
    assert [r.u for r in got] == ["data:image/png;base64," + base64.b64encode(d).decode() for d in data]
    assert [bytes(r.back) for r in got] == data
