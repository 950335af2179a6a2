"""Readers, writers, manifests, configuration, locks."""

import pytest
from pyspark.sql import functions as F

from swaplens.plans import govern
from swaplens.sources import tables


def test_round_trips_by_suffix(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    for suffix in ("parquet", "csv"):
        path = f"{tmp_path}/t.{suffix}"
        tables.save_table(df, path, single_file=True)
        back = tables.read_table(spark, path, "k long, v string")
        assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, None)]
    for f in (lambda: tables.read_table(spark, "x.txt"), lambda: tables.save_table(df, f"{tmp_path}/x.txt")):
        with pytest.raises(ValueError):
            f()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 3).alias("split"), F.lit("wide").alias("rest")).write.partitionBy("split").parquet(f"{tmp_path}/p")
    plan = spark.read.parquet(f"{tmp_path}/p").where("split = 1 AND id > 5").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "GreaterThan(id,5)" in plan and "rest" not in plan.split("ReadSchema")[1]


def test_split_names(spark):
    shard = lambda *centers: spark.createDataFrame([(c,) for c in centers], "center int")
    got = tables.read_shards({"train": shard(0, 3), "test": shard(2), "validation": shard(1, 4)}, "center")
    assert {(r.center, r.split) for r in got.collect()} == {(0, "train"), (3, "train"), (2, "test"), (1, "val"), (4, "id_val")}


def test_files_and_manifests(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/Patient_12_Node_3.tif").write_bytes(b"xyz")
    (tmp_path / "other.tif").write_bytes(b"??")
    found = {r.stem: (r.patient, r.node) for r in tables.discover_files(spark, str(tmp_path)).collect()}
    assert found == {"Patient_12_Node_3": ("12", "3"), "other": (None, None)}
    read = lambda: tables.manifest(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)))
    kept = spark.createDataFrame(read().collect())
    assert tables.verify_manifest(kept, read()).count() == 0
    (tmp_path / "other.tif").write_bytes(b"!")
    (tmp_path / "a/Patient_12_Node_3.tif").write_bytes(b"xyy")
    assert {r.reason for r in tables.verify_manifest(kept, read()).collect()} == {"size", "sha256"}
    assert tables.verify_manifest(kept, read().limit(0)).where("reason = 'missing'").count() == 2


def test_polygons_from_xml(spark, tmp_path):
    point = lambda i, x, y: f'<Coordinate Order="{i}" X="{x}" Y="{y}"/>'
    shape = lambda name, *ps: f'<Annotation Name="{name}"><Coordinates>{"".join(point(i, *p) for i, p in enumerate(ps))}</Coordinates></Annotation>'
    (tmp_path / "a.xml").write_text(f"<ASAP_Annotations><Annotations>{shape('t', (0, 0), (4, 0), (4, 4))}{shape('line', (0, 0), (1, 1))}</Annotations></ASAP_Annotations>")
    got = tables.read_polygons(spark, f"{tmp_path}/a.xml").collect()
    assert [(r.name, [(p.x, p.y) for p in r.polygon]) for r in got] == [("t", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)])]


def test_configuration(tmp_path, monkeypatch):
    monkeypatch.setenv("PLACE", "/data")
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}, "l": [1], "root": "$PLACE/in"}')
    (tmp_path / "own.json").write_text('{"extends": "base.json", "a": {"y": 3}, "l": [2]}')
    got = govern.load_config(tmp_path / "own.json", {"a": {"z": 4}})
    assert got == {"a": {"x": 1, "y": 3, "z": 4}, "l": [2], "root": "/data/in"}
    govern.require_keys(got, "a.x", "l")
    with pytest.raises(KeyError):
        govern.require_keys(got, "a.q")
    assert govern.frozen_differences(got, {"a": {"x": 1, "y": 9}, "k": 1}) == [("a.y", 9, 3), ("k", 1, None)]
    (tmp_path / "loop.json").write_text('{"extends": "loop.json"}')
    with pytest.raises(ValueError):
        govern.load_config(tmp_path / "loop.json")


def test_layers_lie_over_one_another():
    under = govern.flat({"a": {"x": 1, "y": {"z": 2}}, "b": 3, "c": {"d": 4}})
    over = govern.flat({"a": {"y": 5}, "b": {"e": 6}, "c": {}, "f": {}})
    assert govern.nested(govern.overlay(under, over)) == {"a": {"x": 1, "y": 5}, "b": {"e": 6}, "c": {"d": 4}, "f": {}}
    assert govern.frozen_differences({"a": {"x": 1}}, {"a": {"x": 2, "y": 3}}) == [("a.x", 2, 1), ("a.y", 3, None)]


def test_protocol_hash_ignores_the_order_of_keys(tmp_path):
    assert govern.protocol_hash({"a": 1, "b": [1, 2]}) == govern.protocol_hash({"b": [1, 2], "a": 1}) != govern.protocol_hash({"a": 1, "b": [2, 1]})
    with pytest.raises(ValueError):
        govern.protocol_hash({"a": float("nan")})
    govern.lock_protocol({"a": 1}, tmp_path)
    unlocked = "the protocol is not the locked one"
    assert unlocked not in govern.obstacles(tmp_path, {"a": 1}, [], "f", {})
    assert unlocked in govern.obstacles(tmp_path, {"a": 2}, [], "f", {})


def test_held_out_data_stays_locked(spark, tmp_path):
    protocol, passed = {"a": 1}, {"passed": True}
    ask = lambda p=protocol, f="f", pre=passed: govern.authorize_held_out(tmp_path, p, ["audit"], f, pre)
    def locked(*args):
        with pytest.raises(govern.HeldOutLocked):
            ask(*args)
    locked()
    digest = govern.lock_protocol(protocol, tmp_path)
    locked()
    govern.save_json({"status": "unlocked", "protocol_hash": digest}, tmp_path / "unlock.json")
    locked()
    (tmp_path / "out").write_text("x")
    govern.record_stage(tmp_path, "audit", "f", [str(tmp_path / "out")])
    assert ask() == digest
    locked({"a": 2})
    locked(protocol, "other fingerprint")
    locked(protocol, "f", {"passed": False})
    (tmp_path / "out").unlink()
    locked()
    df = spark.createDataFrame([("val",), ("test",)], "split string")
    assert [r.split for r in govern.readable(df).collect()] == ["val"] and govern.readable(df, True).count() == 2


def test_a_stage_without_a_fingerprint_is_stale(tmp_path):
    out = tmp_path / "out"
    out.write_text("x")
    govern.record_stage(tmp_path, "s", "f", [str(out)])
    assert govern.stage_done(tmp_path, "s", "f") and not govern.stage_done(tmp_path, "s", "g")
    (tmp_path / "s.json").write_text('{"status": "completed", "outputs": ["%s"]}' % out)
    assert not govern.stage_done(tmp_path, "s", "f")
