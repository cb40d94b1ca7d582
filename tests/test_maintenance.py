import pytest
from pyspark.sql import functions as F
from tidemark.operators.capture import broken_links, chained
from tidemark.operators.contracts import ContractError
from tidemark.operators.maintenance import Versions, append_ledger, prunable_versions, same_rows, stray_versions, write_json


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "store"))
    a, b = spark.range(3), spark.range(5)
    assert v.publish({"a": a, "b": b}) == ["a", "b"] and v.publish({"a": spark.range(3)}) == []
    assert v.publish({"a": spark.range(4)}) == ["a"] and v.read("a").count() == 4 and v.read("b").count() == 5

    def refuse(tables):
        assert tables["a"].count() == 9 and tables["b"].count() == 5
        raise ContractError("no")

    with pytest.raises(ContractError):
        v.publish({"a": spark.range(9)}, [refuse])
    assert v.read("a").count() == 4
    assert [tuple(r) for r in stray_versions(v.manifest(), v.found()).collect()] == [("a", 3)]
    v.undo()
    assert v.read("a").count() == 3
    assert v.publish({"c": spark.range(1)}) == ["c"]
    v.undo()
    with pytest.raises(KeyError):
        v.read("c")
    assert {tuple(r) for r in prunable_versions(v.manifest(), 1).collect()} == {("a", 2), ("c", 4)}
    assert v.rebuild([("n", lambda s: s.read("a").selectExpr("count(*) as n"))]) == ["n"] and v.read("n").first().n == 3
    calls = []
    for rows in (2, 2, 3):
        assert v.cached("k", {"x": spark.range(rows)}, lambda n=rows: calls.append(1) or spark.range(n)).count() == rows
    assert len(calls) == 2


def test_json_holds_no_nan(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c")], "x double, y string")
    with pytest.raises(ContractError):
        write_json(df, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    write_json(df.filter("y <> 'b'"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_same_rows_is_about_multisets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    assert same_rows(a, a.orderBy(F.desc("k"))) and not same_rows(a, a.distinct()) and not same_rows(a, a.withColumn("v", F.lit(1)))


def test_append_ledger(spark):
    rows = spark.createDataFrame([("c", 1, "x"), ("c", 2, "y")], "chain string, seq int, v string")
    ledger = chained(rows, "chain", "seq", ["v"])
    new = spark.createDataFrame([("c", 2, "y"), ("c", 3, "z"), ("d", 1, "q")], "chain string, seq int, v string")
    whole = ledger.unionByName(append_ledger(ledger, new, "chain", "seq", ["v"]))
    assert whole.count() == 4 and broken_links(whole, "chain", "seq", ["v"]).count() == 0
    with pytest.raises(ContractError):
        append_ledger(ledger, spark.createDataFrame([("c", 2, "other")], new.schema), "chain", "seq", ["v"])
    with pytest.raises(ContractError):
        append_ledger(ledger, spark.createDataFrame([("c", 0, "late")], new.schema), "chain", "seq", ["v"])
