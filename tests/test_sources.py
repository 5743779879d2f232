"""What readers refuse, and what writers promise."""

from dataclasses import dataclass

import pytest

from siltstone.functions.types import struct_of
from siltstone.operators.contracts import ContractBroken, aligned_join, prefix_join, require_equal_keys
from siltstone.sources import readers, writers

ROW = struct_of("id long, name string")


def _lines(tmp_path, *lines):
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    return str(tmp_path / "x.jsonl")


def test_jsonl(spark, tmp_path):
    path = _lines(tmp_path, '{"id": 1, "name": "a"}', "", '{"name": null, "id": 2}')
    assert sorted(map(tuple, readers.jsonl(spark, path, ROW).collect())) == [(1, "a"), (2, None)]


@pytest.mark.parametrize("line,said", [("[1]", "not an object"), ("{", "line 2"), ('{"id": 1}', "missing"), ('{"id": 1, "name": "a", "z": 1}', "unknown"), ('{"id": true, "name": "a"}', "wrong type"), ('{"id": "1", "name": "a"}', "wrong type")])
def test_jsonl_faults(spark, tmp_path, line, said):
    path = _lines(tmp_path, '{"id": 1, "name": "a"}', line)
    with pytest.raises(Exception, match=said):
        readers.jsonl(spark, path, ROW).collect()


def test_parquet_columns_and_fixture(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    df.write.parquet(str(tmp_path / "p"))
    plan = readers.parquet(spark, str(tmp_path / "p"), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan
    with pytest.raises(ContractBroken):
        readers.parquet(spark, str(tmp_path / "p"), ["id", "gone"])
    listed = spark.createDataFrame([(2, 0), (3, 1)], "id long, position int")
    with pytest.raises(ContractBroken, match="lacks"):
        readers.fixture(df, listed, ["id"])
    with pytest.raises(ContractBroken, match="repeated"):
        readers.fixture(df.union(df), listed, ["id"])


def test_json_document(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"suite": "s",\n "items": [{"id": 1, "name": "a"},\n {"id": 2, "name": "b"}]}')
    schema = struct_of("suite string, items array<struct<id:long,name:string>>")
    assert [tuple(r) for r in readers.json_document(spark, str(tmp_path / "d.json"), schema, "items").collect()] == [(1, "a"), (2, "b")]


def test_typed_config():
    @dataclass(frozen=True)
    class Inner:
        rate: float

    @dataclass(frozen=True)
    class Outer:
        name: str
        size: int

    assert readers.typed_config(Outer, {"name": "a", "size": 3}) == Outer("a", 3)
    assert readers.typed_config(Inner, {"rate": 1}).rate == 1
    for bad in ({"name": "a"}, {"name": "a", "size": 3, "more": 1}, {"name": "a", "size": True}, {"name": 1, "size": 1}):
        with pytest.raises(ContractBroken):
            readers.typed_config(Outer, bad)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "é")], "id long, name string")
    path = str(tmp_path / "out")
    digest = writers.jsonl(df, path, "id")
    assert [r[0] for r in spark.read.text(path).collect()] == ['{"id":1,"name":"é"}', '{"id":2,"name":null}']
    with pytest.raises(ContractBroken, match="exists"):
        writers.jsonl(df, path, "id")
    assert writers.new_or_identical(df.repartition(3), path, "id") == digest
    with pytest.raises(ContractBroken, match="other rows"):
        writers.new_or_identical(df.limit(1), path, "id")
    assert writers.folder_digest(spark, path) == writers.folder_digest(spark, path)


def test_manifest_and_guard(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a")], "position int, id string")
    digest = writers.manifest(df, "id", "position", dataset="d").first()["manifest_sha256"]
    writers.require_manifest(df.repartition(2), "id", "position", digest, dataset="d")
    for rows, header in ((df, {"dataset": "e"}), (df.limit(1), {"dataset": "d"})):
        with pytest.raises(ContractBroken):
            writers.require_manifest(rows, "id", "position", digest, **header)
    parts = spark.createDataFrame([(1, "sealed"), (2, "open")], "id int, partition string")
    assert [r[0] for r in writers.guarded(parts, "partition").collect()] == [2] and writers.guarded(parts, "partition", allow_sealed=True).count() == 2
    with pytest.raises(ContractBroken):
        writers.guarded(parts.filter("id = 1"), "partition")


def test_contracts(spark):
    a, b = (spark.createDataFrame([(k, k * 2) for k in ks], "k int, v int") for ks in ([1, 2], [1, 2]))
    assert sorted(map(tuple, aligned_join({"a": a, "b": b}, "k").collect())) == [(1, 2, 2), (2, 4, 4)]
    for other, said in ((b.limit(1), "missing"), (b.union(b), "repeated"), (b.union(spark.createDataFrame([(None, 1)], "k int, v int")), "null")):
        with pytest.raises(ContractBroken, match=said):
            require_equal_keys({"a": a, "b": other}, "k")
    rows = spark.createDataFrame([("abc",), ("abx",), ("zz",)], "id string")
    prefixes = spark.createDataFrame([("ab",), ("abc",), ("",)], "p string")
    assert sorted(map(tuple, prefix_join(prefixes, "p", rows, "id").select("p", "id").collect())) == [("ab", "abc"), ("ab", "abx"), ("abc", "abc")]
