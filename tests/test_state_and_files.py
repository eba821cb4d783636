"""Job states over batches, requests parted at idle hours, model files with semicolons in strings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from planlake.sources import readers
from planlake.streaming import job_state, streams


def test_job_state_over_batches_replays_and_compaction(spark, tmp_path):
    rng, path, want = random.Random(5), str(tmp_path / "state"), {}
    for number in range(9):
        rows = [(rng.choice("abcdefgh"), rng.randrange(50), rng.randrange(1000), rng.choice(("queued", "running", "done"))) for _ in range(6)]
        batch = spark.createDataFrame(rows, "job_id string, s long, event_id long, status string").withColumn("ts", F.timestamp_seconds("s"))
        for _ in range(2 if number % 3 == 1 else 1):
            job_state.upsert(batch, path, number, buckets=4, parts=3)
        for job, s, event, status in rows:
            want[job] = max(want.get(job, (-1, -1, "")), (s, event, status))
    got = job_state.read(spark, path).select("job_id", F.unix_seconds("ts").alias("s"), "event_id", "status").collect()
    assert len(got) == len(want) and {r["job_id"]: (r["s"], r["event_id"], r["status"]) for r in got} == want
    _, parts = job_state._parts(spark, path)
    assert parts and all(len(of) <= 4 for of in parts.values())


def test_a_batch_writes_the_buckets_of_its_own_jobs(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = lambda jobs: spark.createDataFrame([(j, 1, "queued") for j in jobs], "job_id string, event_id long, status string").withColumn("ts", F.timestamp_seconds("event_id"))
    job_state.upsert(rows([str(i) for i in range(200)]), path, 0)
    job_state.upsert(rows(["7"]), path, 1)
    job_state.upsert(rows([]), path, 2)
    assert len(list((tmp_path / "state/part=batch-1").glob("bucket=*"))) == 1
    assert job_state.read(spark, path).count() == 200


def test_a_large_part_is_left_until_small_ones_add_up():
    assert job_state._smaller([(1000, "big"), (10, "a"), (12, "b")]) == ["a", "b"]
    assert job_state._smaller([(60, "big"), (10, "a"), (12, "b")]) == ["a", "b", "big"]


def requests(rng, n):
    """Bursts of a hot key with idle spells, exact hours between some, and a key that is never idle."""
    rows, at = [], 0
    for i in range(n):
        at += rng.choice((0, 1, 20, 59, 60, 61, 1800, 3599, 3600, 3601, 9000)) * 1_000_000 + rng.choice((0, 0, 1, -1)) * (i % 5 == 0)
        rows.append((i, 1 if rng.random() < 0.7 else 2, max(at, 0)))
    return rows


def test_parted_requests_against_a_simulation(spark):
    rng = random.Random(11)
    data = requests(rng, 500)
    kept, want = {}, {}
    for i, k, us in sorted(data, key=lambda x: (x[1], x[2], x[0])):
        mine = kept.setdefault(k, [])
        want[i] = sum(us - v < streams.MINUTE for v in mine) < 2 and sum(us - v < streams.HOUR for v in mine) < 4
        if want[i]:
            mine.append(us)
    e = spark.createDataFrame(data, "event_id long, key long, us long")
    assert {r["event_id"]: r["admitted"] for r in streams.rate_limit_batch(e, 2, 4).collect()} == want
    parts = streams.busy_parts(e).groupBy("key", "part").agg(F.min("us").alias("a"), F.max("us").alias("b")).orderBy("key", "part").collect()
    assert len(parts) > 20
    for p, q in zip(parts, parts[1:], strict=False):
        assert p["key"] != q["key"] or q["a"] - p["b"] >= streams.HOUR


def test_request_rate_against_counting(spark):
    data = requests(random.Random(2), 300) + [(900, 1, None), (901, 1, None), (902, None, 5)]
    e = spark.createDataFrame(data, "event_id long, key long, us long")
    got = {r["event_id"]: (r["minute"], r["hour"]) for r in streams.request_rate(e).collect()}
    assert len(got) == len(data)
    for i, k, us in data:
        if us is not None:
            count = lambda width: sum(k2 == k and u is not None and us - width < u <= us for _, k2, u in data)  # noqa: B023, E731
            assert got[i] == (count(streams.MINUTE), count(streams.HOUR))
    assert got[900] == got[901] == (2, 2)


SPF = """ISO-10303-21;
HEADER;FILE_DESCRIPTION(('a;b'),'2;1');ENDSEC;
DATA;
#1=IFCWALL('g''1;',#2,$,(#3,#4),IFCLABEL('x,(;'));
/* a note */ #2= IfcOwner ( ) ;
#3=IFCPOINT((0.,1.,(2,#9)),'see #77; ''#78''');
#4=IFCDOOR(';;;''',
#1,$);#5=IFCSLAB('',*);
ENDSEC;
END-ISO-10303-21;
"""


@pytest.mark.parametrize("split", ["128m", "16b", "7b"])
def test_statements_across_quotes_and_splits(spark, tmp_path, split):
    """Splits of a few bytes cut inside strings, statements and runs of semicolons."""
    for name in ("a", "b"):
        (tmp_path / f"{name}.ifc").write_text(SPF)
    old = [spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        e = readers.read_spf_entities(spark, str(tmp_path)).cache()
        found = {r["id"]: (r["type"], r["args"]) for r in e.where(F.col("file").endswith("a.ifc")).collect()}
        assert e.count() == 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert found == {
        1: ("IFCWALL", "'g''1;',#2,$,(#3,#4),IFCLABEL('x,(;')"),
        2: ("IFCOWNER", " "),
        3: ("IFCPOINT", "(0.,1.,(2,#9)),'see #77; ''#78'''"),
        4: ("IFCDOOR", "';;;''', #1,$"),
        5: ("IFCSLAB", "'',*"),
    }
    refs = readers.spf_references(e.where(F.col("file").endswith("b.ifc"))).select("id", "ref").collect()
    assert sorted(map(tuple, refs)) == [(1, 2), (1, 3), (1, 4), (3, 9), (4, 1)]
    args = e.where("id = 1").select(readers.spf_arguments(F.col("args")).alias("a")).first()["a"]
    assert args == ["'g''1;'", "#2", "$", "(#3,#4)", "IFCLABEL('x,(;')"]


def test_statements_against_a_scanner(spark, tmp_path):
    rng = random.Random(4)
    text = "".join(f"#{i}=T({','.join(rng.choice((chr(39) + ''.join(rng.choice((';', 'x', chr(39) * 2, ',', chr(10))) for _ in range(rng.randrange(9))) + chr(39), '$', f'#{i}')) for _ in range(3))});\n" for i in range(300))
    (tmp_path / "m.ifc").write_text(text)
    want, inside, start = [], False, 0
    for i, c in enumerate(text):
        inside ^= c == "'"
        if c == ";" and not inside:
            want.append(text[start:i])
            start = i + 1
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512b")
    try:
        got = [r["s"] for r in readers.spf_statements(spark, str(tmp_path / "m.ifc")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(s for s in got if s.strip()) == sorted(want)
    assert len(want) == len(re.findall(r"#\d+=T\(", text))


def test_statements_are_put_together_within_their_split(spark, tmp_path):
    """Strings with semicolons are in every statement: one table is written, and its rows are statements but for those at the edges of splits."""
    from planlake import session

    text = "".join(f"#{i}=A('a;\n{i};b;c',$);" for i in range(3000)) + "#9000=B('cut; off"
    (tmp_path / "m.ifc").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        before = len(session._scopes[-1])
        got = sorted(r["s"] for r in readers.spf_statements(spark, str(tmp_path / "m.ifc")).collect())
        (path,) = session._scopes[-1][before:]
        assert got == sorted([f"#{i}=A('a;\n{i};b;c',$)" for i in range(3000)] + ["#9000=B('cut; off"])
        rows, splits = spark.read.parquet(path), -(-len(text) // 5000)
        assert rows.where("NOT begins OR ended = 0").count() <= 2 * splits and rows.count() <= 3001 + splits
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
