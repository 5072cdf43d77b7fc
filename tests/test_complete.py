"""The whole job of ``complete_only``: the ensemble's votes on every event, and the lines of every order."""

from polyphon.plans.catalog import CHECKS, QUERIES
from compare import differences, duck


def tables(spark, folder):
    labels = ["click", "view", "buy"]
    events = [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", i % 7, labels[i * i % 3], float(i % 11), f'{{"k": {i % 5}}}') for i in range(90)]
    frame = spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double, props string")
    frame.selectExpr("event_id", "cast(ts AS timestamp_ntz) AS ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{folder}/events.parquet")
    lines = [(o, j, "ANR"[(o + j) % 3]) for o in range(1, 7) for j in range(o)]
    frame = spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_returnflag string")
    frame.selectExpr(
        "*", "1D AS l_quantity", "0.05D AS l_discount", "0.02D AS l_tax", "'O' AS l_linestatus", "timestamp '1995-01-01' AS l_shipdate"
    ).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")


def test_every_event_and_every_order_takes_part(spark, tmp_path):
    tables(spark, tmp_path)
    rows = QUERIES["complete_only"](spark, str(tmp_path)).cache()
    assert {r.instance_id for r in rows.where("stream = 'event'").collect()} == set(range(90))
    assert {r.instance_id for r in rows.where("stream = 'order'").collect()} == {3}
    con = duck(str(tmp_path / "none"))
    for name in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert differences(rows, con, CHECKS["complete_only"]) == []
