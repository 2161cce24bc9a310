"""Session defaults, the shared folder, and instants without zone."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linkloom import session
from linkloom.functions.keys import micros


def test_shared_dir_where_unset(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "local[2]", "app-test"

    class Fake:
        conf, sparkContext = Conf(), Context()

    first = session.shared_dir(Fake())
    assert first and session.shared_dir(Fake()) == first
    for master in ("local-cluster[2,1,1024]", "spark://h:7077", "yarn"):
        Context.master = master
        with pytest.raises(RuntimeError):
            session.shared_dir(Fake())


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_micros_in_any_zone(spark, zone):
    times = [datetime(2025, 3, 9, 2, 30), datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(2024, 2, 29, 1, 2, 3, 4)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in times] + [(None,)], "t timestamp_ntz").select(micros("t").alias("m"), F.monotonically_increasing_id().alias("i"))
        got = [x["m"] for x in df.orderBy("i").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [(t - datetime(1970, 1, 1)) // timedelta(microseconds=1) for t in times] + [None]
