"""Input tables of the queries, derived from the star schema by integer arithmetic, once for Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

E = "event_id"
C = "(event_id div 8)"
H = "(event_id div 16)"

#: table, then (column, expression); a filter may follow.
TABLES: dict[str, tuple] = {
    "pose": (
        "events",
        [
            ("seq_id", "user_id"), ("pose_id", E), ("t_us", "unix_micros(cast(ts as timestamp))"),
            ("x", "((event_id * 7919) % 4000) / 10.0D - 200"), ("y", "((event_id * 104729) % 4000) / 10.0D - 200"), ("z", "((event_id * 31) % 100) / 100.0D"),
            ("pitch_deg", "((event_id * 13) % 41 - 20) / 10.0D"), ("roll_deg", "((event_id * 17) % 41 - 20) / 10.0D"), ("yaw_deg", "cast((event_id * 37) % 360 - 180 as double)"),
        ],
    ),
    "inst": (
        "events",
        [
            ("id", E), ("cid", C), ("k", "event_id % 8"), ("frame_id", "event_id div 20"), ("road_class", f"cast({C} % 5 as int)"),
            ("x", f"(({C} * 7919) % 40009) / 10.0D + ((event_id * 13) % 11 - 5) / 20.0D"), ("y", f"(({C} * 104729) % 40013) / 10.0D + ((event_id * 29) % 11 - 5) / 20.0D"),
            ("z", "((event_id * 31) % 100) / 200.0D"), ("h", "1.4D + (event_id % 50) / 10.0D"), ("w", "0.1D + (event_id % 7) / 10.0D"), ("yaw_deg", f"cast(({C} * 37) % 180 + (event_id % 5) - 2 as double)"),
            *[(f"sigma{j}", f"0.05D + ((event_id * {j + 3}) % 100) / 100.0D") for j in range(4)],
            ("percept_distance", "(event_id % 200) / 10.0D"), ("frozen", "event_id % 97 = 0"), ("merged", "event_id % 89 = 0"),
        ],
    ),
    "line_vtx": (
        "events",
        [
            ("line_id", C), ("vtx", "cast(event_id % 8 as int)"),
            ("x", f"(({H} * 7919) % 40009) / 10.0D + (event_id % 8) + ({C} % 2) * 4"), ("y", f"(({H} * 104729) % 40013) / 10.0D + ((event_id * 13) % 11 - 5) / 40.0D"),
            ("z", "((event_id * 17) % 50) / 100.0D"), ("sigma", "0.05D + (event_id % 20) / 100.0D"),
        ],
    ),
    "gt": ("orders", [("t", "o_orderkey"), ("X0", "-2267800 + (o_orderkey % 1000) / 10.0D"), ("Y0", "5009300 + ((o_orderkey * 7) % 1000) / 10.0D"), ("Z0", "3221000 + ((o_orderkey * 13) % 1000) / 10.0D")]),
    "res": (
        "orders",
        [
            ("t", "o_orderkey"),
            ("X1", "-2267800 + (o_orderkey % 1000) / 10.0D + ((o_custkey * 7) % 200 - 100) / 100.0D"),
            ("Y1", "5009300 + ((o_orderkey * 7) % 1000) / 10.0D + ((o_custkey * 11) % 200 - 100) / 100.0D"),
            ("Z1", "3221000 + ((o_orderkey * 13) % 1000) / 10.0D + ((o_custkey * 13) % 200 - 100) / 100.0D"),
        ],
        "o_orderkey % 10 <> 0",
    ),
    "stamp": ("events", [("stamp_id", E), ("t_us", "unix_micros(cast(ts as timestamp))")], "event_type = 'click'"),
    "stream_pose": ("events", [("pose_id", E), ("pose_us", "unix_micros(cast(ts as timestamp))")], "event_type = 'view'"),
}

#: A calibrated camera, its mounting over ground, and the raster.
PINHOLE = {
    "model_type": "pinhole", "image_width": 1024, "image_height": 768,
    "fx": 889.9367809211368, "fy": 882.4596986525857, "cx": 507.25941868010946, "cy": 384.8847191080022,
    "k1": -0.12611479151190178, "k2": 0.05718240346837818, "p1": -0.0005881695148494001, "p2": -0.0002349224902416051,
}
ALPHA_DEG, THETA_DEG, HEIGHT_M = 0.82258, -0.62140, 1.82
RASTER = {"height": 800, "width": 400, "resolution": 0.05}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns, *only = TABLES[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if only:
        df = df.filter(only[0])
    return df.selectExpr(*[f"{e} as {c}" for c, e in columns])


def to_duck(sql: str) -> str:
    sql = sql.replace("unix_micros(cast(ts as timestamp))", "epoch_us(ts)").replace(" div ", " // ")
    return re.sub(r"(\d+\.\d+)D\b", r"\1::DOUBLE", sql)


def sql(name: str) -> str:
    """The same table as a DuckDB query."""
    table, columns, *only = TABLES[name]
    where = f" where {only[0]}" if only else ""
    return to_duck("select " + ", ".join(f"{e} as {c}" for c, e in columns) + f" from {table}{where}")


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label images of 8 x 8 pixels from the embeddings, background included."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vector = next(f.name for f in df.schema if f.dataType.typeName() == "array")
    px = df.selectExpr("vec_id as frame_id", "label", f"posexplode({vector}) as (i, value)")
    gray = "cast(case when value <= 0.05D then 0 when i % 8 >= 6 then 5 else 1 + label % 4 end as int)"
    return px.selectExpr("frame_id", "cast(i div 8 as int) as row", "cast(i % 8 as int) as col", f"{gray} as gray")


def mask_sql(vector: str = "embedding") -> str:
    return f"""select vec_id as frame_id, (i // 8)::int as row, (i % 8)::int as col,
      (case when v <= 0.05 then 0 when i % 8 >= 6 then 5 else 1 + label % 4 end)::int as gray
      from (select vec_id, label, unnest({vector}) as v, unnest(range(len({vector}))) as i from embeddings)"""
