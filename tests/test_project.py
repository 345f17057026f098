"""Artifacts, builds, the store, the command line and the registered queries."""

import json

import pytest

from spindrift import cli
from spindrift.exceptions import CatalogParseError, ManifestNotFoundError, ManifestParseError
from spindrift.plans.build import LineageGraph, ranked
from spindrift.sources import artifacts, store


def node(uid, sql="", deps=(), kind="model", **more):
    return {"unique_id": uid, "name": uid.split(".")[-1], "resource_type": kind, "compiled_code": sql, "depends_on": {"nodes": list(deps), "macros": []}, "database": "dev", "schema": "public"} | more


#: A given project of three hops and one model that is no SQL.
MANIFEST = {
    "metadata": {"adapter_type": "postgres", "project_name": "shop"},
    "nodes": {
        "model.shop.staging": node("model.shop.staging", "SELECT id AS order_id, amount FROM dev.public.raw_data", ["source.shop.raw_data"]),
        "model.shop.mart": node("model.shop.mart", "SELECT order_id, amount * 1.1 AS amount_with_tax FROM staging", ["model.shop.staging"]),
        "model.shop.bad": node("model.shop.bad", "THIS IS NOT SQL AT ALL"),
        "test.shop.t": node("test.shop.t", kind="test"),
    },
    "sources": {"source.shop.raw_data": node("source.shop.raw_data", kind="source", columns={"id": {"name": "ID", "data_type": "INT"}, "amount": {"name": "amount"}})},
}
CATALOG = {"nodes": {"model.shop.staging": {"metadata": {"name": "staging"}, "columns": {"ORDER_ID": {"name": "ORDER_ID", "type": "BIGINT", "index": 1}, "amount": {"name": "amount", "type": "", "index": 2}}}}, "sources": {}}


@pytest.fixture
def manifest(tmp_path):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(MANIFEST))
    return str(path)


def test_manifest(spark, manifest):
    models, meta = artifacts.read_manifest(spark, manifest)
    assert meta["adapter_type"] == "postgres"
    assert {r["name"] for r in models.collect()} == {"staging", "mart", "bad", "raw_data"}
    lookup = {r["form"]: r["canonical"] for r in artifacts.table_lookup(models).collect()}
    assert lookup["dev.public.raw_data"] == lookup["public.raw_data"] == lookup["raw_data"] == "raw_data"
    assert {r["name"] for r in artifacts.selected(models, "+MART").collect()} == {"mart", "staging", "raw_data"}
    assert artifacts.selected(models, "nothing").count() == 4


def test_source_collisions_are_qualified(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"nodes": {}, "sources": {f"source.{s}.users": node(f"source.{s}.users", kind="source", schema=s) for s in ("a", "b")}}))
    models, _ = artifacts.read_manifest(spark, str(path))
    assert {r["name"] for r in models.collect()} == {"a.users", "b.users"}


def test_bad_artifacts(spark, tmp_path, manifest):
    with pytest.raises(ManifestNotFoundError):
        artifacts.read_manifest(spark, str(tmp_path / "none.json"))
    (tmp_path / "bad.json").write_text("{ not json")
    with pytest.raises(ManifestParseError):
        artifacts.read_manifest(spark, str(tmp_path / "bad.json"))
    with pytest.raises(CatalogParseError):
        LineageGraph(spark, manifest, str(tmp_path / "bad.json"), use_cache=False)


def test_three_hops(spark, manifest):
    g = LineageGraph(spark, manifest, use_cache=False)
    roots = [tuple(r) for r in g.trace("mart", "amount_with_tax")[1].collect()]
    assert roots == [("raw_data", "amount")]
    assert g.build_stats["unresolved_models"] == ["bad"] and g.build_stats["success_rate"] == 0.667
    assert g.to_dict()["stats"]["models"] == 3


def test_catalog_is_found_and_store_is_reused(spark, manifest, tmp_path):
    (tmp_path / "catalog.json").write_text(json.dumps(CATALOG))
    first = LineageGraph(spark, manifest, cache_dir=str(tmp_path / "cache"))
    LineageGraph.clear_cache()
    second = LineageGraph(spark, manifest, cache_dir=str(tmp_path / "cache"))
    assert sorted(map(str, first.edges.collect())) == sorted(map(str, second.edges.collect()))
    assert store.load(spark, second.folder, "another key") is None
    changed = json.loads(json.dumps(MANIFEST))
    changed["nodes"]["model.shop.mart"]["compiled_code"] = "SELECT order_id FROM staging"
    (tmp_path / "manifest.json").write_text(json.dumps(changed))
    third = LineageGraph(spark, manifest, cache_dir=str(tmp_path / "cache"))
    assert third.edges_between("staging", "mart").count() == 1
    # only the changed model was analysed again
    assert store.load_results(spark, third.folder).filter("unique_id = 'model.shop.staging'").count() == 1
    assert store.load_results(spark, third.folder).filter("unique_id = 'model.shop.mart'").count() == 2


def test_levels_of_models():
    rows = [{"unique_id": u, "depends_on": d} for u, d in (("c", ["b"]), ("a", []), ("b", ["a", "missing"]), ("x", ["y"]), ("y", ["x"]))]
    assert [[m["unique_id"] for m in level] for level in ranked(rows)] == [["a"], ["b"], ["c"], ["x", "y"]]


def test_cli(spark, manifest, capsys):
    for args, key in ((["trace", "mart", "order_id"], "source_columns"), (["impact", "raw_data", "id"], "affected_columns"), (["stats"], "build_stats"), (["export"], "nodes")):
        assert cli.main(["-m", manifest, *args], spark) == 0
        assert json.loads(capsys.readouterr().out)[key]
    assert cli.main(["-m", manifest, "list-models"], spark) == 0
    assert "mart" in json.loads(capsys.readouterr().out)


def test_streamed_edges(spark, tmp_path):
    from spindrift.streaming.incremental import follow, latest

    row = {"source_model": "a", "source_column": "x", "target_model": "b", "target_column": "y", "transform_type": "rename", "transform_sql": "x", "transform_chain": [], "model_unique_id": "m", "resolution_status": "resolved"}
    (tmp_path / "in").mkdir()
    for i, kind in enumerate(("rename", "aggregation", "cast")):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(row | {"transform_type": kind}))
        follow(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r["transform_type"] for r in latest(spark, str(tmp_path / "out")).collect()] == ["aggregation"]


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert {tuple(r) for r in entry.entry(spark).collect()} == {("lineitem", "l_extendedprice"), ("lineitem", "l_discount")}
    assert entry.oracle_sql().keys() <= entry.queries().keys()
