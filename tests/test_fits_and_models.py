"""Closed-form fits against numpy, and the checks on a small model file."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from planlake.functions import geom as G
from planlake.operators import model as M
from planlake.operators.fits import fit_similarity, line_fit
from planlake.sources import readers


def test_line_fit_against_eigenvectors(spark):
    rng = np.random.default_rng(1)
    data = {k: rng.normal(size=(12, 2)) @ np.diag([1.0 + k, 0.3]) @ np.array([[math.cos(k), math.sin(k)], [-math.sin(k), math.cos(k)]]) + k for k in range(6)}
    rows = [(k, float(x), float(y)) for k, p in data.items() for x, y in p] + [(0, None, 1.0), (None, 1.0, 1.0)]
    got = line_fit(spark.createDataFrame(rows, "plan_id long, x double, y double")).collect()
    assert len(got) == 6
    for r in got:
        p = data[r["plan_id"]]
        centre = p.mean(axis=0)
        v = np.linalg.eigh(np.cov(p.T))[1][:, 1]
        s = (p - centre) @ v
        want = sorted([tuple(centre + v * s.min()), tuple(centre + v * s.max())])
        assert sorted([(r["x1"], r["y1"]), (r["x2"], r["y2"])]) == [pytest.approx(w) for w in want]


def test_lines_without_covariance(spark):
    rows = [(1, 0.0, 2.0), (1, 4.0, 2.0), (2, 3.0, 0.0), (2, 3.0, 5.0), (3, 7.0, 8.0)]
    got = {r["plan_id"]: r for r in line_fit(spark.createDataFrame(rows, "plan_id long, x double, y double")).collect()}
    ends = lambda r: [r["x1"], r["y1"], r["x2"], r["y2"]]
    assert ends(got[1]) == pytest.approx([0, 2, 4, 2]) and got[1]["angle"] == 0
    assert ends(got[2]) == pytest.approx([3, 0, 3, 5])
    assert ends(got[3]) == pytest.approx([7, 8, 7, 8])


def test_similarity_gives_the_second_model(spark):
    rng, rows = random.Random(3), []
    for k in range(5):
        turn, scale = rng.uniform(-3.1, 3.1), rng.uniform(0.2, 5)
        for _ in range(8):
            x, y = rng.uniform(-9, 9), rng.uniform(-9, 9)
            rows.append((k, x, y, scale * (math.cos(turn) * x - math.sin(turn) * y) + 10 * k, scale * (math.sin(turn) * x + math.cos(turn) * y) - k))
    rows += [(8, 1.0, 1.0, 2.0, 2.0)] * 2 + [(9, 1.0, 1.0, 5.0, 6.0)] * 3
    pairs = spark.createDataFrame(rows, "plan_id long, x1 double, y1 double, x2 double, y2 double")
    fit = fit_similarity(pairs)
    moved = G.apply_similarity(F.array(G.point(F.col("x1"), F.col("y1"))), F.col("scale"), F.col("cos"), F.col("sin"), F.col("tx"), F.col("ty"))[0]
    j = pairs.join(fit, "plan_id").select("plan_id", G.hypot(moved["x"] - F.col("x2"), moved["y"] - F.col("y2")).alias("off")).collect()
    assert {r["plan_id"] for r in j} == {0, 1, 2, 3, 4, 9}
    assert max(r["off"] for r in j) < 1e-9


TEXT = """DATA;
#1=IFCWALL('w1',$,'Wall; one');#2=IFCWALLSTANDARDCASE('w2',$,$);
#3=IFCOPENINGELEMENT('o1',$,'a');#4=IFCOPENINGELEMENT('o2',$,'b');
#5=IFCDOOR('d1',$,'it''s');#6=IFCWINDOW('n1',$,$);#7=IFCSLAB('f1',$,$,.FLOOR.);
#8=IFCSPACE('s1',$,$);#9=IFCSPACE('s2',$,$);#10=IFCBUILDINGSTOREY('y',$,$);#11=IFCBUILDING('z',$,$);#12=IFCMATERIAL('m');
#13=IFCCOVERING('c1',$,$,.CEILING.);
#20=IFCRELVOIDSELEMENT('r',$,$,$,#1,#3);
#21=IFCRELFILLSELEMENT('r',$,$,'#4;',#3,#5);
#22=IFCRELASSOCIATESMATERIAL('r',$,$,$,(#1,#7),#12);
#23=IFCRELCONTAINEDINSPATIALSTRUCTURE('r',$,$,$,(#1,#5),#10);
#24=IFCRELCONTAINEDINSPATIALSTRUCTURE('r',$,$,$,(#2,#6,#7),#11);
#25=IFCRELSPACEBOUNDARY('r',$,$,$,#8,#7,$,.PHYSICAL.,.INTERNAL.);
#26=IFCRELSPACEBOUNDARY('r',$,$,$,#8,#99,$,.PHYSICAL.,.INTERNAL.);
#27=IFCRELSPACEBOUNDARY('r',$,$,$,#8,$,$,.VIRTUAL.,.INTERNAL.);
#28=IFCRELSPACEBOUNDARY('r',$,$,$,#8,#13,$,.PHYSICAL.,.INTERNAL.);
#29=IFCRELCONNECTSPATHELEMENTS('r',$,$,$,$,#1,#2,(),(),.ATEND.,.ATSTART.);
#30=IFCRELCONNECTSPATHELEMENTS('r',$,$,$,$,#1,#5,(),(),.ATEND.,.ATSTART.);
ENDSEC;
"""


def test_seven_checks_of_a_model_file(spark, tmp_path):
    (tmp_path / "a.ifc").write_text(TEXT)
    (tmp_path / "b.ifc").write_text("DATA;#3=IFCWALL('x',$,$);ENDSEC;")
    e = readers.read_spf_entities(spark, str(tmp_path)).cache()
    elements, relations = M.model_elements(e), M.model_relations(e)
    assert elements.where("id = 1").first()["name"] == "Wall; one" and elements.where("id = 5").first()["name"] == "it's"
    found = {(r["file"][-5], r["issue"]): (r["n"], r["first_ids"]) for r in M.referential_checks(elements, relations).collect()}
    assert len(found) == 14
    assert {c: v[1] for (f, c), v in found.items() if f == "a"} == {
        "opening_without_void": [4],
        "opening_without_fill": [4],
        "element_without_material": [2],
        "element_without_storey": [2, 6, 7],
        "space_without_boundary": [9],
        "filling_without_host": [6],
        M.DANGLING: [26, 30],
    }
    assert {c: v for (f, c), v in found.items() if f == "b" and v[0]} == {"element_without_material": (1, [3]), "element_without_storey": (1, [3])}
    spaces = {r["id"]: (r["n_boundaries"], r["floor"], r["ceiling"], r["wall"]) for r in M.boundary_completeness(elements, relations).collect()}
    assert spaces == {8: (4, True, True, False), 9: (0, False, False, False)}
