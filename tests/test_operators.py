"""Operators against plain Python on small inputs, with nulls, ties, empty frames and boundaries."""

from __future__ import annotations

import io
import json
import random
import zipfile

import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

from geoloom import catalog
from geoloom.functions import text, vectors
from geoloom.operators import areas, metrics, pca, prior, raster, search, select, spatial, splits
from geoloom.operators.order import numbered, running
from geoloom.sources import readers
from geoloom.streaming import streams


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def vecs(spark, n, d=6, seed=1, groups=5):
    r = np.random.default_rng(seed)
    m = r.normal(size=(n, d))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m, frame(spark, [(i, m[i].tolist(), f"g{i % groups}") for i in range(n)], "row_id long, embedding array<double>, seq string")


@pytest.mark.parametrize("broadcast", [1 << 20, 700])
def test_topk_equals_brute_force(spark, broadcast):
    m, d = vecs(spark, 60)
    got = search.topk(d.where("row_id < 20"), d, 4, exclude="seq", broadcast_bytes=broadcast).collect()
    want = []
    for q in range(20):
        s = sorted((-(m[q] @ m[b]), b) for b in range(60) if b % 5 != q % 5)[:4]
        want += [(q, k + 1, b) for k, (_, b) in enumerate(s)]
    assert sorted((r.query_id, r["rank"], r.row_id) for r in got) == want


def test_topk_boundaries(spark):
    _, d = vecs(spark, 5)
    assert search.topk(d.where("row_id = 0"), d, 32).count() == 5
    assert search.topk(d.where("row_id < 0"), d, 3).count() == 0
    assert search.topk(d, d.where("row_id < 0"), 3).count() == 0
    with pytest.raises(ValueError):
        search.topk(d, d, 0)
    same = frame(spark, [(i, [1.0, 0.0], None) for i in (5, 3, 9)], "row_id long, embedding array<double>, seq string")
    assert [r.row_id for r in search.topk(same, same, 2).where("query_id = 9").orderBy("rank").collect()] == [3, 5]
    assert search.topk(same, same, 2, exclude="seq").count() == 0  # null groups equal each other


def test_shortlist_with_every_row_probed_is_exact(spark):
    _, d = vecs(spark, 40, 8)
    a = search.topk(d.where("row_id < 6"), d, 5).select("query_id", "rank", "row_id").collect()
    b = search.shortlist(d.where("row_id < 6"), d, 5, dim=2, probe=40).select("query_id", "rank", "row_id").collect()
    assert sorted(a) == sorted(b)


def test_round_robin_merge_pads(spark):
    found = frame(spark, [(1, 1, 10, 0.9), (1, 2, 11, 0.8), (2, 1, 10, 0.7), (2, 2, 12, 0.6)], "query_id long, rank int, row_id long, sim double")
    photos = frame(spark, [(1, 7, 0), (2, 7, 1)], "query_id long, group int, place int")
    got = search.merge_round_robin(found, photos, 5).orderBy("slot").collect()
    assert [r.row_id for r in got] == [10, 11, 12, 12, 12]
    assert [round(r.score, 6) for r in got] == [0.0, -0.1, -0.1, -10000.0, -10000.0]


def test_radius_join_equals_brute_force(spark):
    random.seed(3)
    p = [(i, random.uniform(-90, 90), random.uniform(-180, 180)) for i in range(250)]
    p += [(900, 89.999, 10.0), (901, 89.999, -170.0), (902, 0.0, 179.99), (903, 0.0, -179.99), (904, -89.99, 0.0), (905, 0.0, 179.99)]
    d = frame(spark, p, "row_id long, lat double, lon double")

    def km(a, b):
        la, lb = np.radians(a[1]), np.radians(b[1])
        h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0088 * np.arcsin(min(1, np.sqrt(h)))

    for r in (5.0, 700.0, 9000.0):
        got = [(x.a, x.b) for x in spatial.within(d, d, r).collect()]
        want = [(a[0], b[0]) for a in p for b in p if km(a, b) <= r]
        assert sorted(got) == sorted(want)
    near = {r.query_id: r.km for r in spatial.nearest(d.where("row_id < 30"), d.where("row_id >= 30")).collect()}
    for a in p[:30]:
        assert near[a[0]] == pytest.approx(min(km(a, b) for b in p if b[0] >= 30), abs=1e-6)


def test_groups_never_span_splits(spark):
    d = frame(spark, [(i % 37, i % 3 if i % 37 else None) for i in range(400)], "g int, s int")
    a = splits.assign(d, "g", "s")
    assert a.count() == 37
    assert splits.spans(d.join(a.select("g", "split"), "g"), "g").count() == 0
    assert splits.assign(d.where("g < 0"), "g", "s").count() == 0


def test_gaps_compare_with_every_kept_time(spark):
    d = frame(spark, [(1, 0.0, 1), (1, 60.0, 2), (1, 1.0, 3), (1, None, 4), (2, 5.0, 5)], "drive int, t double, i int")
    got = {r.i: r.kept for r in select.drive_gaps(d, "drive", "t", "i", 30).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_quota_equals_a_plain_walk(spark):
    random.seed(9)
    rows = [(i, random.randrange(12), random.randrange(4), random.randrange(5000) if i % 11 else None) for i in range(300)]
    kept, seq, seed, times = [], {}, {}, {}
    for i, s, d, t in rows:
        if len(kept) == 25:
            break
        if seq.get(s, 0) >= 3 or seed.get(d, 0) >= 8 or (t is not None and any(abs(t - x) < 400 for x in times.get(s, []))):
            continue
        if t is not None:
            times.setdefault(s, []).append(t)
        seq[s], seed[d] = seq.get(s, 0) + 1, seed.get(d, 0) + 1
        kept.append(i)
    d = frame(spark, rows, "i int, s int, d int, t int")
    assert [r.i for r in select.quota(d, "i", "s", "d", "t", 25, 3, 8, 400).orderBy("i").collect()] == kept


def test_density_groups_use_each_row_once(spark):
    d = frame(spark, [(i, 0.0, 0.001 * i) for i in range(9)], "row_id long, lat double, lon double")
    g = spatial.density_groups(d, 10.0, 3).collect()
    assert len(g) == 9 and len({r.row_id for r in g}) == 9
    assert spatial.density_groups(d, 10.0, 30).count() == 0


def test_connected_areas(spark):
    d = frame(spark, [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)], "a long, b long")
    got = {r.node: r.component for r in areas.connected(d).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[200] == 200


def test_running_order(spark):
    d = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.lit(2).cast("long").alias("v"))
    assert numbered(d, [F.col("k")], "n").where("n <> k").count() == 0
    assert running(d, [F.col("k")], F.col("v"), "s").where("s <> 2 * k").count() == 0
    assert numbered(d.where("k < 0"), [F.col("k")], "n").count() == 0


def test_projection_keeps_variance_and_order(spark):
    m, d = vecs(spark, 80, 5)
    mean, axes = pca.fit(d, 5)
    assert np.allclose(mean, m.mean(axis=0))
    p = np.array([r.projected for r in pca.project(d, mean, axes).orderBy("row_id").collect()])
    assert np.allclose(p.var(axis=0).sum(), m.var(axis=0).sum()) and (np.diff(p.var(axis=0)) <= 1e-12).all()
    assert np.allclose(np.abs(np.corrcoef(p.T)[0, 1:]), 0, atol=1e-9)


def test_vector_functions(spark):
    r = spark.range(1).select(
        vectors.normalise(F.array(F.lit(0.0), F.lit(0.0))), vectors.softmax(F.array(*map(F.lit, (1.0, 2.0, 3.0)))), vectors.gem(F.array(F.array(F.lit(-1.0)), F.array(F.lit(-1.0))), 3.0),
        vectors.rotate(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(np.pi / 2))), vectors.entropy(F.array(F.lit(0.5), F.lit(0.5))), vectors.cosine_rate(F.lit(5), 10, 1.0),
    ).first()
    assert r[0] == [0.0, 0.0] and r[2] == [-1.0] and r[5] == pytest.approx(0.5)
    assert r[1] == pytest.approx((np.exp([1, 2, 3]) / np.exp([1, 2, 3]).sum()).tolist())
    assert r[3] == pytest.approx([0.0, 1.0]) and r[4] == pytest.approx(np.log(2))


def test_weighted_concatenation_blends_cosines(spark):
    rng = np.random.default_rng(2)
    a, b, c, d = (rng.normal(size=4) for _ in range(4))
    a, b, c, d = (x / np.linalg.norm(x) for x in (a, b, c, d))
    w = 0.3

    def made(x, y):
        return F.concat(vectors.scale(F.lit(x.tolist()), w**0.5), vectors.scale(F.lit(y.tolist()), (1 - w) ** 0.5))

    assert spark.range(1).select(vectors.dot(made(a, b), made(c, d))).first()[0] == pytest.approx(w * a @ c + (1 - w) * b @ d)


def test_beam_keeps_width_and_never_expands_the_sink(spark):
    q = spark.range(3).select(F.col("id").alias("query_id"))

    def logits(query_id, z, x, y, step):
        children = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda a: (query_id + x + 3 * y + a * 7) % 11 * 1.0)
        return F.concat(children, F.array(F.when(x % 2 == 0, 50.0).otherwise(-50.0)))

    b = prior.beam_search(q, logits, beams=4, top_m=4, sink=True, prune=0.5, score_steps=2)
    rows = b.collect()
    assert len(rows) == 12 and all(max(r.path) < 256 and len(r.path) == 4 for r in rows)
    for i in range(3):
        s = [r.score for r in sorted((r for r in rows if r.query_id == i), key=lambda r: r.beam)]
        assert len(s) == 4
    one = prior.beam_search(q, logits, beams=1, top_m=1, steps=1).first()
    assert len(one.path) == 1


def test_confidence_radius_of_one_candidate_is_zero(spark):
    c = frame(spark, [(1, 10.0, 20.0, 0.5), (2, 0.0, 0.0, 0.0), (2, 0.0, 2.0, 0.0)], "query_id long, lat double, lon double, score double")
    got = {r.query_id: r.radius_km for r in metrics.confidence_radius(c).collect()}
    assert got[1] == 0.0 and got[2] == pytest.approx(111.195, abs=0.01)


def test_intervals(spark):
    d = frame(spark, [(i, float(i), float(i) + 10) for i in range(30)], "id long, a double, b double")
    got = {r.statistic: r for r in metrics.paired_bootstrap(d, 30).collect()}
    assert got["mean"].lo == pytest.approx(-10) and got["mean"].separated
    flat = metrics.paired_bootstrap(d.withColumn("b", F.col("a")), 10)
    assert flat.where("separated").count() == 0


def test_majority_rules(spark):
    px = [(0, 0, 23), (1, 0, 46), (0, 1, 46), (1, 1, 23), (2, 0, 100), (3, 0, 100), (2, 1, 100), (3, 1, 100)]
    d = frame(spark, px, "x int, y int, v int")
    assert {(r.x, r.v) for r in raster.majority(d, 2).collect()} == {(0, 23), (1, 92)}  # the first in scan order; the snapped mean
    assert {(r.x, r.v) for r in raster.majority(d, 2, 0.5).collect()} == {(0, 23), (1, 255)}  # 2 votes over 2 values isn't flagged


def test_text(spark):
    d = frame(spark, [("N 51.5024 W O.O9O8",), ("nothing",), ("S1, 234 E2 . 3456",), (None,)], "t string")
    got = [r.c for r in d.select(text.overlay("t").alias("c")).collect()]
    assert got[0].lat == pytest.approx(51.5024) and got[0].lon == pytest.approx(-0.0908)
    assert got[1] is None and got[2].lat == pytest.approx(-1.234) and got[3] is None
    r = spark.range(1).select(text.tokens(F.lit("Straße Élan the Café-Rue öl 42abc")), text.shot_seconds(F.lit("2017-10-31 15:53:01.000")), text.shot_seconds(F.lit("?")), text.size_bytes(F.lit("20GB")), text.run_name(F.lit("d768-b350-e6-cell8"))).first()
    assert r[0] == ["stra", "elan", "42abc"] and r[1] == 1509465181 and r[2] is None and r[3] == 20 << 30
    assert tuple(r[4]) == (768, 350, 6, "cell8")


def test_eligibility_reads_like_the_source(spark):
    d = frame(spark, [("PLANE", "a", "5"), (None, "a", None), ("SPHERE", "a", "5"), ("", "a", "0"), ("PLANE", "", "5"), ("PLANE", "a", "x"), ("PLANE", None, "1")], "p string, n string, a string")
    got = [r.ok for r in d.select(select.eligible(F.col("p"), F.col("n"), F.col("a"), 20.0).alias("ok")).collect()]
    assert got == [True, False, False, False, False, False, False]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,latitude,longitude,country,sequence\n1,1.5,2.5,de,s\n2,,2.5,de,s\n3,3.0,4.0,fr,t\n")
    got = readers.places(spark, str(tmp_path / "a.csv"), frame(spark, [(1,), (2,), (1,)], "id long")).collect()
    assert [(r.id, r.latitude, r.country) for r in got] == [(1, 1.5, "de")]
    (tmp_path / "m.jsonl").write_text('{"id": 1, "v": "a"}\nbroken\n{"id": 2, "v": "b"}\n\n{"id": 1, "v": "c"}\n')
    for keep, v in (("last", "c"), ("first", "a")):
        assert {r.id: r.v for r in readers.json_lines(spark, str(tmp_path / "m.jsonl"), keep=keep).collect()} == {1: v, 2: "b"}
    (tmp_path / "side").mkdir()
    (tmp_path / "side/x.json").write_text(json.dumps({"rows": 5}))
    (tmp_path / "side/y.json").write_text("{")
    got = {r.file[-6:]: r.content for r in readers.sidecar(spark, str(tmp_path / "side"), "rows int").collect()}
    assert got["x.json"].rows == 5 and got["y.json"] is None
    (tmp_path / "log.txt").write_text("start\nloss 3\nstart\nloss 1\nloss 2\n")
    assert readers.last_attempt(spark, str(tmp_path / "log.txt"), "start", r"loss (\d)").first().matches == ["1", "2"]
    spark.range(5).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "p1"))
    spark.range(5).write.parquet(str(tmp_path / "p2"))
    assert readers.parquet(spark, str(tmp_path / "p1"), str(tmp_path / "p2"), columns=["id"]).count() == 10
    assert {r.files for r in readers.listing(spark, str(tmp_path / "side")).collect()} == {2}


def test_archives_and_packs(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for i in range(7):
            z.writestr(f"00/{i}.jpg", bytes([i]) * 10)
    (tmp_path / "00.zip").write_bytes(buf.getvalue())
    wanted = frame(spark, [("00/3.jpg", 0), ("00/9.jpg", 1)], "name string, pos int")
    got = readers.members(spark, str(tmp_path / "*.zip"), wanted)
    assert [r.content for r in got.orderBy("pos").collect()] == [bytearray([3] * 10), None]
    assert [r.name for r in readers.missing(got).collect()] == ["00/9.jpg"]
    files = readers.archive(spark, str(tmp_path / "*.zip")).select("name", "content")
    ids = select.packs(files.select(text.member("name")["id"].alias("id"), "name", "content"), "id", 3)
    assert sorted(r.pack for r in ids.collect()) == [0, 0, 0, 1, 1, 1, 2]
    readers.write_packs(ids, str(tmp_path / "packs"))
    packs = spark.read.parquet(str(tmp_path / "packs"))
    assert packs.count() == 3 and readers.pack_faults(files, packs).count() == 0
    assert readers.pack_faults(files.withColumn("content", F.lit(b"x")), packs).count() == 7


def test_streams_merge_and_sessions(spark):
    a = frame(spark, [(1, 1, 0.5), (1, 2, 0.4)], "query_id long, row_id long, sim double")
    b = frame(spark, [(1, 3, 0.9), (1, 1, 0.5)], "query_id long, row_id long, sim double")
    got = streams.merge_topk(streams.merge_topk(None, a, 2), b, 2).orderBy(F.desc("sim")).collect()
    assert [(r.row_id, r.sim) for r in got] == [(3, 0.9), (1, 0.5)]


@pytest.fixture
def small_pieces(spark):
    """Arrow batches of three rows, so that what belongs together comes in pieces."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "3")
    yield
    spark.conf.set(conf, before)


def test_stream_gaps_equal_a_plain_walk(spark, small_pieces, tmp_path):
    """Drives in pieces, rows that arrive together, without time or without a drive, and a second batch that finds the first one's state."""
    random.seed(4)
    rows = [(random.choice([1, 2, 3, None]), random.choice([None, *(float(random.randrange(2000)) for _ in range(9))]), random.randrange(40), i) for i in range(200)]
    schema = "drive long, t double, arrival long, i long"
    want, times, path = [], {}, f"{tmp_path}/in"
    for half in (rows[:120], rows[120:]):
        frame(spark, random.sample(half, len(half)), schema).coalesce(1).write.mode("append").parquet(path)
        s = spark.readStream.schema(schema).parquet(path)
        kept = streams.gap_filter(s, "drive", "t", "arrival", 30, "i")
        kept.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        for d, t, a, i in sorted(half, key=lambda r: r[2:]):
            if t is None or all(abs(t - o) >= 30 for o in times.setdefault(d, [])):
                want.append((d, a, i))
                if t is not None:
                    times[d].append(t)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=repr) == sorted(want, key=repr)


def test_stream_gaps_query_on_an_odd_table(spark, small_pieces, tmp_path):
    """Scrambled shots of users with long numbers, and of none, in pieces; two that arrive together, one of them too near an earlier one; a number below 0, and none."""
    import duckdb

    c = duckdb.connect()
    c.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds((i * 3001) % 400000) AS ts, CASE WHEN i < 90 THEN 1152921504606846977 + i % 3 END AS user_id FROM range(150) t(i)
        UNION ALL SELECT i, TIMESTAMP '2025-01-01' + to_days(d), 2 FROM (VALUES (127, 0), (1000004, 0), (1, 9), (-3, 20), (2, 20), (NULL, 30), (3, 30)) t(i, d)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = catalog.queries()["stream_gaps"](spark, str(tmp_path))
    same(got, c.sql(catalog.oracle_sql()["stream_gaps"]))
    assert sorted(r.event_id for r in got.where("user_id = 2").collect()) == [1, 3, 127]


def test_prior_masses_sum_to_one(spark):
    n = frame(spark, [(1, 5, 0.9, 32751, 21793), (1, 6, 0.8, 100, 100)], "query_id long, row_id long, sim double, x16 long, y16 long")
    w = prior.weights(n)
    t = frame(spark, [(1, 2, 127, 85)], "query_id long, step int, x long, y long")
    got = {r.child: r.mass for r in prior.child_prior(w, t).collect()}
    assert set(got) == {46, -1} and sum(got.values()) == pytest.approx(1.0)
