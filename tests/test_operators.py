"""Fixtures with values worked out by hand, readers, steps and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from planlake.functions import geom as G
from planlake.functions import labels as L
from planlake.functions.steps import apply_steps, numpy_step
from planlake.operators import openings as O
from planlake.operators import walls as W
from planlake.operators.graph import components
from planlake.operators.rooms import rooms_from_walls
from planlake.sources import readers, writers
from planlake.streaming import job_state, streams

RING = "array<struct<x: double, y: double>>"


def rings(spark, *polys):
    return spark.createDataFrame([(i, [dict(x=float(x), y=float(y)) for x, y in p]) for i, p in enumerate(polys)], f"id int, points {RING}")


def one(df, c):
    return df.select(c.alias("v")).first()["v"]


def test_grid_snap(spark):
    d = rings(spark, [(123.7, 456.3), (123.7, 456.3), (123.7, 456.3)])
    assert tuple(one(d, G.snap_to_grid(F.col("points"), F.lit(50.0)))[0]) == (100.0, 450.0)
    assert tuple(one(d, G.snap_to_grid(F.col("points"), F.lit(10.0)))[0]) == (120.0, 460.0)


def test_wall_area_and_rect(spark):
    d = rings(spark, [(0, 0), (5000, 0), (5000, 240), (0, 240)])
    assert one(d, G.polygon_area(F.col("points"))) == 1.2e6
    r = one(d, G.oriented_rect(F.col("points")))
    assert (r["width"], r["length"]) == (240.0, 5000.0)


def test_iou_of_axis_rectangle(spark):
    d = rings(spark, [(0, 0), (3000, 0), (3000, 200), (0, 200)])
    axis = G.rect_from_axis(*[F.lit(v) for v in (0.0, 0.0, 3000.0, 0.0, 200.0)])
    assert one(d, G.iou(axis, F.col("points"))) == pytest.approx(1 / 3)


def test_window_clip(spark):
    d = rings(spark, [(90, 5), (120, 5), (120, 15), (90, 15)])
    wall = F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (100, 0), (100, 20), (0, 20))])
    assert one(d, G.bounds(G.convex_clip(F.col("points"), wall)))["x1"] == 100.0


def test_labels(spark):
    d = spark.createDataFrame([("Außenwand Ext",), ("Tür",), ("FENSTER 2",), ("wnd",), ("winter",)], "label string")
    got = [r[0] for r in d.select(L.classify(F.col("label"))).collect()]
    assert got == ["WALL", "DOOR", "WINDOW", "WINDOW", "winter"]


def test_rooms_of_two_room_plan(spark):
    boxes = [(0, 0, 5000, 240), (0, 0, 240, 5000), (4760, 0, 5000, 5000), (0, 4760, 5000, 5000), (2500, 0, 2740, 5000)]
    w = spark.createDataFrame([(1, *map(float, b)) for b in boxes], "plan_id long, x0 double, y0 double, bx double, by_ double")
    assert sorted(r["area_m2"] for r in rooms_from_walls(w, cell=20.0).collect()) == pytest.approx([9.1304, 10.2152], rel=0.05)


def test_components_of_a_chain_and_nulls(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, None), (9, 8)], "src long, dst long")
    got = {r["node"]: r["component"] for r in components(e).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and got[5] == 5 and got[9] == got[8] == 8 and 7 not in got
    assert components(e.where("false")).count() == 0


def test_rate_limit_fixture(spark):
    t = [0, 10, 20, 30, 60, 61, 70]
    e = spark.createDataFrame([(i, 1, s * 1_000_000) for i, s in enumerate(t)], "event_id long, key long, us long")
    got = [r["admitted"] for r in streams.rate_limit_batch(e, 3, 1000).orderBy("event_id").collect()]
    assert got == [True, True, True, False, True, False, True]


def test_rate_limit_without_keys(spark):
    e = spark.createDataFrame([(1, None, 5), (2, 7, 0), (3, 7, 1), (4, None, 5), (5, 7, None)], "event_id long, key long, us long")
    assert {r["event_id"]: r["admitted"] for r in streams.rate_limit_batch(e, 1, 10).collect()} == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_rate_limit_against_a_direct_simulation(spark):
    rng = np.random.default_rng(3)
    data = [(i, int(rng.integers(3)), int(rng.integers(7200)) * 1_000_000) for i in range(600)]
    e = spark.createDataFrame(data, "event_id long, key long, us long")
    kept, want = {}, {}
    for i, k, us in sorted(data, key=lambda x: (x[1], x[2], x[0])):
        mine = kept.setdefault(k, [])
        want[i] = sum(us - v < streams.MINUTE for v in mine) < 2 and sum(us - v < streams.HOUR for v in mine) < 30
        if want[i]:
            mine.append(us)
    assert {r["event_id"]: r["admitted"] for r in streams.rate_limit_batch(e, 2, 30).collect()} == want


def test_stream_twins(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, (i // 2) * 20_000_000) for i in range(60)], "event_id long, key long, us long")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streams.rate_limit_stream(live, 2, 100).writeStream.format("memory").queryName("limited").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r["event_id"]: r["admitted"] for r in streams.rate_limit_batch(rows, 2, 100).collect()}
    assert {r["event_id"]: r["admitted"] for r in spark.table("limited").collect()} == want


def test_job_state_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "queued"), ("a", 2, "running"), ("b", 3, "queued"), ("a", 2, "running")], "job_id string, event_id long, status string")
    rows = rows.withColumn("ts", F.timestamp_seconds("event_id"))
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streams.job_state_stream(live, str(tmp_path / "state"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {r["job_id"]: r["status"] for r in job_state.read(spark, str(tmp_path / "state")).collect()}
    assert got == {"a": "running", "b": "queued"}


def test_windowed_counts_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, "click", i * 1800) for i in range(10)], "event_id long, event_type string, s long").withColumn("ts", F.timestamp_seconds("s"))
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streams.windowed_counts(live).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("hourly").collect()) == sorted(r["n"] for r in streams.windowed_counts(rows, watermark=False).collect())


MODEL = {
    "image": {"width": 1000, "height": 1000},
    "predictions": [
        {"class": "internal-walls", "confidence": 0.95, "points": [{"x": 100, "y": 100}, {"x": 900, "y": 100}]},
        {"class": "internal-walls", "confidence": 0.9, "points": [{"x": 1, "y": 1}]},
        {"class": "window", "confidence": 0.9, "points": [{"x": 3, "y": 8}, {"x": 5, "y": 2}], "x": 350, "y": 140, "width": 100, "height": 120},
        {"class": "room", "confidence": 0.8, "points": [{"x": 0, "y": 0}, {"x": 4, "y": 0}, {"x": 0, "y": 4}]},
        {"class": "wall", "confidence": 0.7, "x": 50, "y": 10, "width": 100, "height": 20, "points": []},
        {"class": "wall", "confidence": 0.7, "x": 50, "y": 10, "width": 0, "height": 20, "points": []},
    ],
}


def test_model_readers(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(MODEL, indent=1))
    walls, openings = readers.read_topology_model(spark, str(tmp_path))
    assert walls.count() == 1 and walls.first()["image_width"] == 1000
    assert tuple(openings.where("class = 'window'").first()["box"]) == (3.0, 2.0, 5.0, 8.0)
    assert readers.read_room_model(spark, str(tmp_path)).first()["area"] == 8.0
    boxes, rest = readers.read_box_model(spark, str(tmp_path))
    assert [tuple(r["line"]) for r in boxes.collect()] == [(0.0, 10.0, 100.0, 10.0)] and rest.count() == 1


def test_geojson_round_trip(spark, tmp_path):
    d = rings(spark, [(0, 0), (2, 0), (2, 2), (0, 2)]).withColumns({"plan_id": F.lit(1), "det_id": F.lit("a"), "label": F.lit("x")})
    text = writers.feature_collections(d).first()["geojson"]
    (tmp_path / "g.json").write_text(text)
    multi = {"features": [{"type": "Feature", "properties": {"type": "DOOR"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [0, 1]]], [[[0, 0], [9, 0], [0, 9]]]]}}]}
    (tmp_path / "h.json").write_text(json.dumps(multi))
    got = {r["type"]: [tuple(p) for p in r["points"]] for r in readers.read_geojson(spark, str(tmp_path)).collect()}
    assert got["WALL"][:4] == [(0, 0), (2, 0), (2, 2), (0, 2)] and got["DOOR"][1] == (9, 0)
    writers.write_geojson(d, str(tmp_path / "out"), "walls")
    writers.write_report(d, str(tmp_path / "report"))
    writers.mirror(d.withColumn("job_id", F.lit("j")), str(tmp_path / "store"))
    assert (tmp_path / "out/walls/plan_id=1").exists() and (tmp_path / "report/plan_id=1").exists() and (tmp_path / "store/artifacts/job_id=j").exists()


def test_spf_and_jobs(spark, tmp_path):
    (tmp_path / "a.ifc").write_text("ISO-10303-21;\nDATA;\n#1=IFCWALL('x',#2,\n$);\n#2= IfcOwner();\nENDSEC;")
    e = readers.read_spf_entities(spark, str(tmp_path / "a.ifc"))
    assert {(r["id"], r["type"]) for r in e.collect()} == {(1, "IFCWALL"), (2, "IFCOWNER")}
    assert [(r["id"], r["ref"]) for r in readers.spf_references(e).collect()] == [(1, 2)]
    jobs = tmp_path / "jobs"
    jobs.mkdir()
    (jobs / "j.json").write_text('{"id": "1", "status": "queued", "progress": 0, "input_files": ["f"]}')
    assert readers.read_jobs(spark, str(jobs)).first()["status"] == "queued"


def test_failing_step_keeps_the_last_good_points(spark):
    d = rings(spark, [(0, 0), (3, 0), (3, 3)])
    r = apply_steps(d, {"double": numpy_step(lambda a: a * 2), "cut": numpy_step(lambda a: a[:1]), "more": lambda p: G.snap_to_grid(p, F.lit(100.0))}).first()
    assert r["failed_step"] == "cut" and tuple(r["points"][1]) == (6.0, 0.0)


def test_clean_stream_equals_batch(spark, tmp_path):
    d = rings(spark, [(0, 0), (101, 2), (100, 52), (0, 50)], [(3, 4), (57, 4), (57, 36), (3, 36)])
    d.repartition(1).write.parquet(str(tmp_path / "in"))
    steps = [lambda x: apply_steps(x, {"grid": lambda p: G.snap_to_grid(p, F.lit(10.0)), "right": G.right_angle})]
    live = streams.clean_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), *steps)
    q = live.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("cleaned").collect())) == sorted(map(str, streams.clean_stream(d, *steps).collect()))


WALL = "plan_id long, det_id string, x1 double, y1 double, x2 double, y2 double, thickness double, confidence double"


def test_walls_at_an_angle(spark):
    # Fixed directions: (3, 4, 5) triangles.
    rows = [(1, "a", 0.0, 0.0, 600.0, 800.0, 100.0, 0.9), (1, "b", 8.0, -6.0, 608.0, 794.0, 100.0, 0.5), (1, "c", 600.0, 800.0, 0.0, 1250.0, 100.0, 0.9), (1, "d", None, 0.0, 1.0, 1.0, 100.0, 0.9), (2, "a", 5.0, 5.0, 5.0, 5.0, 100.0, 0.9)]
    w = spark.createDataFrame(rows, WALL)
    assert [(r["a_det_id"], r["b_det_id"], r["how"]) for r in W.wall_connections(w).orderBy("a_det_id", "b_det_id").collect()] == [("a", "b", "near"), ("a", "c", "cross"), ("b", "c", "near")]
    assert [(r["det_id"], r["other"]) for r in W.match_walls(w.where("det_id = 'a'"), w.where("det_id = 'b'")).collect()] == [("a", "b")]
    assert {r["det_id"] for r in W.dedupe_lines(w.where("plan_id = 1")).collect()} == {"a", "c", "d"}
    over = W.wall_overlaps(w).collect()
    assert [(r["a_det_id"], r["b_det_id"]) for r in over] == [("a", "b")] and over[0]["overlap"] == pytest.approx(900, abs=1e-6)
    assert {r["det_id"] for r in W.resolve_overlaps(w.where("x1 IS NOT NULL")).collect()} == {"a", "c"}
    closed = {r["det_id"]: (r["x1"], r["y1"], r["x2"], r["y2"]) for r in W.close_gaps(w.where("det_id <> 'd'")).where("plan_id = 1").collect()}
    assert closed["a"][2:] == closed["b"][2:] == closed["c"][:2] and closed["a"][:2] == (4.0, -3.0)


def test_openings_far_from_every_axis(spark):
    walls = spark.createDataFrame([(1, "near", 0.0, 0.0, 3000.0, 0.0, 200.0, 1.0), (1, "far", 0.0, 9000.0, 3000.0, 9000.0, 200.0, 1.0)], WALL)
    ring = lambda x, y: [dict(x=x + a, y=y + b) for a, b in ((-450.0, -50.0), (450.0, -50.0), (450.0, 50.0), (-450.0, 50.0))]
    o = spark.createDataFrame([(1, "on", "DOOR", ring(1000.0, 30.0)), (1, "off", "DOOR", ring(1000.0, 6000.0)), (3, "alone", "DOOR", ring(0.0, 0.0))], f"plan_id long, det_id string, kind string, points {RING}")
    a = O.assign_openings(o, walls)
    assert {r["det_id"]: (r["wall_id"], r["axis_distance"], r["wall_distance"]) for r in a.collect()} == {"on": ("near", 30.0, 0.0), "off": ("far", None, 2900.0), "alone": (None, None, None)}
    placed = O.opening_placement(a, o, walls)
    got = {r["det_id"]: (r["width"], r["depth"], r["cx"], r["cy"]) for r in placed.collect()}
    assert got["on"] == pytest.approx((900.0, 100.0, 1000.0, 0.0))
    assert {r["det_id"]: r["scale"] for r in O.fit_inside(placed, walls).collect()} == {"on": 1.0, "off": 1.0}
    fit = {r["det_id"]: (r["step"], r["cy"]) for r in O.fit_opening(a, o, walls).collect()}
    assert fit["on"] == (-10, 0.0) and fit["off"][0] is None
    clipped = {r["det_id"]: r["area"] for r in O.clip_to_wall(o, walls).collect()}
    assert clipped == {"on": pytest.approx(90_000.0), "off": None, "alone": None}


def test_clip_against_concave_polygons(spark):
    l_shape = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]
    square = [(1, 1), (1, 3), (3, 3), (3, 1)]  # turns the other way
    df = rings(spark, l_shape, square).agg(F.max_by("points", -F.col("id")).alias("p"), F.max_by("points", "id").alias("q"))
    got = df.select(G.shared_area(F.col("p"), F.col("q")).alias("a"), G.iou(F.col("q"), F.col("p")).alias("i")).first()
    assert got["a"] == pytest.approx(3.0) and got["i"] == pytest.approx(3 / 13)


def test_area_inside_a_rectangle_against_clipping(spark):
    r = np.random.default_rng(8)
    data = []
    for i in range(120):
        c, (w, h), t = r.uniform(0, 10, 2), r.uniform(1, 8, 2), r.uniform(0, 7)
        u = np.array([np.cos(t), np.sin(t)])
        v = np.array([-u[1], u[0]]) * (1 if i % 2 else -1)
        rect = [c, c + w * u, c + w * u + h * v, c + h * v]
        turn = np.sort(r.uniform(0, 2 * np.pi, int(r.integers(3, 8))))
        poly = r.uniform(2, 8, 2) + np.column_stack([np.cos(turn), np.sin(turn)]) * r.uniform(1, 6, len(turn))[:, None]
        data.append((i, *[[dict(x=float(x), y=float(y)) for x, y in q] for q in (poly, rect)]))
    df = spark.createDataFrame(data, f"id int, p {RING}, q {RING}")
    got = df.select(G.is_rectangle(F.col("q")).alias("is"), G.rect_share(F.col("p"), F.col("q")).alias("a"), G.polygon_area(G.convex_clip(F.col("p"), F.col("q"))).alias("b")).collect()
    assert all(x["is"] for x in got) and sum(x["a"] > 0 for x in got) > 40
    for x in got:
        assert x["a"] == pytest.approx(x["b"] or 0.0, abs=1e-9)
    assert not df.select(G.is_rectangle(F.transform("q", lambda p, i: G.point(p["x"] + i, p["y"]))).alias("is")).where("is").count()


def test_written_tables_are_dropped_on_demand(spark):
    from planlake.session import drop_materialized, materialize, shared_dir

    drop_materialized(spark)
    t = materialize(spark.range(3), "some")
    assert t.count() == 3 and drop_materialized(spark) == 1 and drop_materialized(spark) == 0
    import glob

    assert not glob.glob(f"{shared_dir(spark)}/some-*")


def test_scratch_scopes_drop_their_own_tables(spark):
    from pathlib import Path

    from planlake.session import materialize, scratch, shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    kept = materialize(spark.range(2), "outer")
    with scratch(spark):
        own = materialize(spark.range(3), "inner")
        with scratch(spark):
            materialize(spark.range(4), "innermost")
        assert not list(folder.glob("innermost-*")) and own.count() == 3
    assert not list(folder.glob("inner-*")) and kept.count() == 2


def test_session_without_a_folder_of_its_own(tmp_path):
    import os
    import subprocess
    import sys

    code = "from planlake.session import *; s = build_session(cpus=1); t = materialize(s.range(3), 'x'); print(t.count(), drop_materialized(s))"
    done = subprocess.run([sys.executable, "-c", code], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=180, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert done.stdout.split()[-2:] == ["3", "1"], done.stderr[-2000:]


def test_openings_that_just_fit_do_not_hang_on_the_last_bit(spark):
    walls = spark.createDataFrame([(1, "w", 0.0, 0.0, 400.0, 0.0, 100.0)], "plan_id long, det_id string, x1 double, y1 double, x2 double, y2 double, thickness double")
    rows = [(1, f"o{i}", "w", 200.0, 0.0, 390.0 + w, 90.0 + d) for i, (w, d) in enumerate(((1e-10, 0.0), (0.0, 1e-10), (0.0, 0.0), (0.01, 0.0)))]
    placed = spark.createDataFrame(rows, "plan_id long, det_id string, wall_id string, cx double, cy double, width double, depth double")
    assert {r["det_id"]: r["scale"] for r in O.fit_inside(placed, walls).collect()} == {"o0": 1.0, "o1": 1.0, "o2": 1.0, "o3": 0.98}


def test_component_rounds_shuffle_numbers(spark, monkeypatch):
    from planlake.operators import graph

    seen = {}
    kept = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: (seen.setdefault(name, {t for _, t in df.dtypes}), kept(df, name))[1])
    e = spark.createDataFrame([(1, "b", "c"), (1, "c", "a"), (2, "b", "z"), (2, "x", "x"), (None, "p", "q"), (3, None, "q")], "plan_id long, src string, dst string")
    got = {tuple(r) for r in components(e, keys=("plan_id",)).collect()}
    assert got == {(1, "a", "a"), (1, "b", "a"), (1, "c", "a"), (2, "b", "b"), (2, "z", "b"), (2, "x", "x"), (None, "p", "p"), (None, "q", "q")}
    assert seen["cc-edges"] == seen["cc-hooks"] == seen["cc-parents"] == {"bigint"}


def test_a_wall_is_written_to_few_cells(spark):
    from planlake.operators.spatial import CELL, _celled

    w = spark.createDataFrame([(0.0, 0.0, 3000.0, 140.0)], "x0 double, y0 double, x1 double, y1 double")
    assert _celled(w, ("x0", "y0", "x1", "y1"), 0.0, CELL, "a").count() == 1


def test_pairs_of_one_table_are_not_broadcast(spark):
    from planlake.operators.spatial import self_pairs

    w = spark.createDataFrame([(1, "a", 0.0, 0.0), (1, "b", 1.0, 1.0)], "plan_id long, det_id string, x double, y double")
    pairs = self_pairs(w, ("x", "y", "x", "y"), [], 5.0)
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().toString() and pairs.count() == 1
