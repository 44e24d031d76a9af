import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("tandem-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):  # tests only: set one where unset
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tandem-test-ckpt-"))
    yield s


def games_df(spark, rows):
    """rows: (game_id, date 'YYYY-MM-DD', away, home, score_away, score_home[, total])."""
    import datetime as dt

    from tandem.functions.scalars import season_of
    from pyspark.sql import functions as F
    data = []
    for r in rows:
        gid, d, a, h, sa, sh = r[:6]
        total = r[6] if len(r) > 6 else 200.0
        data.append((gid, dt.date.fromisoformat(d), a, h, sa, sh, total))
    df = spark.createDataFrame(data, "game_id long, date date, away string, home string, "
                                     "score_away long, score_home long, total double")
    q = {f"{p}_{s}": F.lit(0).cast("long") for s in ("away", "home") for p in ("q1", "q2", "q3", "q4", "ot")}
    return df.withColumns(q).withColumn("season", season_of(F.col("date")))
