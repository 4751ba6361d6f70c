"""Operators without SQL against plain versions, and input that isn't there: nulls, empty tables, missing files."""

from __future__ import annotations

import json
import unicodedata
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import sql, text, vectors
from geoloom.operators import harvest, pca, probe, provenance, search, select
from geoloom.sources import matrices, readers


def plain_rounds(rows, budget, per_sequence, per_seed, gap, rounds=3):
    kept, tried = {}, set()
    for number in range(1, rounds + 1):
        in_seq, in_seed, times, picked = {}, {}, {}, []
        for r in kept.values():
            in_seq[r[1]], in_seed[r[2]] = in_seq.get(r[1], 0) + 1, in_seed.get(r[2], 0) + 1
            times.setdefault(r[1], []).append(r[3])
        for r in rows:
            if len(picked) >= budget - len(kept):
                break
            if r[0] in tried or in_seq.get(r[1], 0) >= per_sequence or in_seed.get(r[2], 0) >= per_seed or any(abs(t - r[3]) < gap for t in times.get(r[1], [])):
                continue
            in_seq[r[1]], in_seed[r[2]] = in_seq.get(r[1], 0) + 1, in_seed.get(r[2], 0) + 1
            times.setdefault(r[1], []).append(r[3])
            picked.append(r)
        tried |= {r[0] for r in picked}
        kept |= {r[0]: (*r, number) for r in picked if r[4]}
        if not picked:
            break
    return {i: r[5] for i, r in kept.items()}


@pytest.mark.parametrize("budget", [1000, 25])
def test_quota_rounds(spark, budget):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 12)), int(rng.integers(0, 5)), int(rng.integers(0, 400)), bool(rng.random() < 0.5)) for i in range(300)]
    d = spark.createDataFrame(rows, "i long, seq long, seed long, t long, ok boolean").repartition(3)
    got = {r.i: r["round"] for r in harvest.quota_rounds(d, "i", "seq", "seed", "t", "ok", budget, 4, 11, 30).collect()}
    assert got == plain_rounds(rows, budget, 4, 11, 30) and set(got.values()) >= {1, 2}


@pytest.mark.parametrize("written", ["ﬁrst Ｆｕｌｌ", "½ ㎞ Å éÀ ǆ x²", "plain ASCII, only", "Straße Œuvre №5 ℡", "𝐀𝐛 é", "éñ", "漢字 ab", "", "Ⅷ ⑩ ㏿"])
def test_fold_is_the_compatibility_form(spark, written):
    bare = "".join(c for c in unicodedata.normalize("NFKD", written) if not unicodedata.combining(c)).lower()
    want = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in bare).split())
    assert spark.createDataFrame([(written,)], "t string").select(text.fold("t")).first()[0] == want


def test_neighbours_leave_missing_vectors_out(spark):
    bank = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, []), (7, [None, 1.0])], "row_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, None), (1, [1.0, 0.0]), (2, [0.6, 0.8])], "row_id long, embedding array<double>")
    for most in (search.BROADCAST, 1):
        got = {(r.query_id, r["rank"]): (r.row_id, round(r.sim, 6)) for r in search.topk(asked, bank, 2, broadcast_bytes=most).collect()}
        assert got == {(1, 1): (1, 1.0), (1, 2): (3, 0.0), (2, 1): (3, 0.8), (2, 2): (1, 0.6)}
    assert search.topk(asked.limit(0), bank, 2).count() == 0 and search.topk(asked, bank.limit(0), 2).count() == 0
    with pytest.raises(ValueError, match="no row"):
        pca.fit(bank.limit(0), 1)


def test_matrices(spark, tmp_path):
    m = np.arange(35.0).reshape(7, 5)
    np.save(tmp_path / "a.npy", m.astype(np.float32))
    np.savez(tmp_path / "b.npz", x=m, ids=np.arange(3))
    got = {(r.path.rpartition("/")[2], r.member, r.row): r.v for r in matrices.npy(spark, f"{tmp_path}/*.np[yz]").collect()}
    assert len(got) == 17 and got["a.npy", "", 6] == m[6].tolist() and got["b.npz", "x", 2] == m[2].tolist() and got["b.npz", "ids", 1] == [1.0]
    assert [r.v for r in matrices.mapped(spark, str(tmp_path / "a.npy"), 7, block=3).orderBy("row").collect()] == m.tolist()


def test_archives_and_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x", "1")
        z.writestr("y", "22")
    wanted = spark.createDataFrame([("y", 0), ("gone", 1), ("d/x", 2)], "name string, pos int")
    got = [(r.name, r.content and bytes(r.content)) for r in readers.members(spark, str(tmp_path / "a.zip"), wanted).orderBy("pos").collect()]
    assert got == [("y", b"22"), ("gone", None), ("d/x", b"1")]
    lines = [json.dumps({"id": i % 50, "n": i}) for i in range(5000)]
    (tmp_path / "m.jsonl").write_text("\n".join([*lines, "{broken", ""]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        for keep, want in (("last", {i: 4950 + i for i in range(50)}), ("first", {i: i for i in range(50)})):
            rows = readers.json_lines(spark, str(tmp_path / "m.jsonl"), keep=keep, schema="id long, n long")
            assert {r.id: r.n for r in rows.collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(i, i % 3) for i in range(40)], "id long, part int")
    readers.write(d, str(tmp_path / "t"), ["part"])
    assert spark.read.parquet(str(tmp_path / "t")).where("part = 1").count() == 13
    readers.write_sidecar(d, str(tmp_path / "t.prov"), "id", release="one")
    one = spark.read.json(str(tmp_path / "t.prov")).first()
    assert one.rows == 40 and len(one.rows_digest) == 12 and one.release == "one"
    place = str(tmp_path / "r")
    matrices.resume(d.where("id < 10"), place, "id")
    matrices.resume(d.where("id < 20"), place, "id", mark=False)
    assert matrices.read_resumed(spark, place, "id").count() == 10
    matrices.resume(d, place, "id")
    assert sorted(r.id for r in matrices.read_resumed(spark, place, "id").collect()) == list(range(40))


def test_cohorts_and_splits_refuse(spark, tmp_path):
    d = spark.range(100).withColumnRenamed("id", "c")
    a = {r.c for r in select.frozen(d, "c", 10, str(tmp_path / "c")).collect()}
    assert a == {r.c for r in select.frozen(spark.range(1000).withColumnRenamed("id", "c"), "c", 10, str(tmp_path / "c")).collect()} and len(a) == 10
    with pytest.raises(ValueError, match="no longer"):
        select.frozen(d.where(F.col("c") != min(a)), "c", 10, str(tmp_path / "c"))
    with pytest.raises(ValueError, match="no split mode"):
        provenance.split_column(d, "x", ("y",), ("c",))
    with pytest.raises(ValueError, match="no column"):
        provenance.split_column(d, "y", ("y",), ("c",))


def test_linear_probe(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    d = spark.createDataFrame([(v.tolist(), int(c), i % 4 > 0) for i, (v, c) in enumerate(zip(x, y, strict=True))], "v array<double>, c int, train boolean")
    r = probe.linear(d, "v", "c", "train").first()
    assert r.n == 400 and r.train > 0.7 and r.val > 0.65


def test_sql_names(spark):
    assert set(sql.register(spark)) >= {"geo_tile_x", "geo_km", "vec_dot"}
    r = spark.sql("SELECT geo_tile_x(-0.0908D, 14) AS x, geo_tile_y(51.5024D, 14) AS y, vec_dot(array(1D, 2D), array(3D, 4D)) AS d, vec_norm(array(3D, 4D)) AS n").first()
    assert (r.x, r.y, r.d, r.n) == (8187, 5448, 11.0, 5.0)
    assert spark.range(1).select(vectors.crop_lefts(F.lit(398), 224, F.lit(3))).first()[0] == [0, 87, 174]
