"""Pipe-delimited text, declared schemas, the façade and growing tables."""

import pytest

from cairn.schemas import TABLES, schema_of
from cairn.session import Engine
from cairn.sources import read_pipe
from cairn.streaming import stream_table

SCHEMA = [("k", "int"), ("s", "str"), ("x", "float"), ("d", "date")]


def write(path, text):
    path.write_text(text)
    return str(path)


def test_fields(spark, tmp_path):
    at = write(tmp_path / "a.tbl", '1|plain|1.5|1996-01-02|\n\n2||  |1996-02-29|\n3| "quoted" it\'s |2|1996-03-01|extra|more|\n4|short\n|no key||\n')
    rows = [tuple(r) for r in read_pipe(spark, at, schema_of(SCHEMA)).orderBy("k").collect()]
    assert [r[:3] for r in rows] == [(None, "no key", None), (1, "plain", 1.5), (2, None, None), (3, '"quoted" it\'s', 2.0), (4, "short", None)]
    assert [str(r[3]) for r in rows] == ["None", "1996-01-02", "1996-02-29", "1996-03-01", "None"]


@pytest.mark.parametrize("line", ["x|a|1|1996-01-01|", "1|a|one|1996-01-01|", "1|a|1|1996-13-01|"])
def test_bad_value_raises(spark, tmp_path, line):
    df = read_pipe(spark, write(tmp_path / "a.tbl", line + "\n"), schema_of(SCHEMA))
    with pytest.raises(Exception, match="CAST|cast"):
        df.collect()


def test_unknown_type():
    with pytest.raises(ValueError, match="unknown type"):
        schema_of([("a", "blob")])


def test_load_table_and_execute(spark, tmp_path):
    engine = Engine(spark)
    engine.load_table("things", write(tmp_path / "a.tbl", "1|a|1.5|1996-01-02|\n2|b|2.5|1996-01-03|\n"), SCHEMA)
    assert Engine.to_dicts(engine.execute("SELECT s, x FROM things WHERE k = 2")) == [{"s": "b", "x": 2.5}]
    engine.load_table("things", write(tmp_path / "b.tbl", "7|c|0|1996-01-02|\n"), SCHEMA)  # takes the place of the first
    assert [r.k for r in engine.table("things").collect()] == [7]
    with pytest.raises(ValueError, match="no schema"):
        engine.load_table("other", str(tmp_path / "a.tbl"))
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        engine.execute("SELECT * FROM never_loaded")
    with pytest.raises(ValueError, match="more than 1 rows"):
        Engine.to_dicts(engine.execute("SELECT * FROM range(5)"), limit=1)


def test_load_folder(spark, tmp_path, small):
    write(tmp_path / "region.tbl", "0|AFRICA|none|\n1|ASIA|none|\n")
    write(tmp_path / "nation.tbl", "0|KENYA|0|none|\n1|JAPAN|1|none|\n")
    engine = Engine(spark)
    assert engine.load_tpch(str(tmp_path)) == ["region", "nation"]  # missing files are left out
    got = engine.execute("SELECT n_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name = 'ASIA'")
    assert [r.n_name for r in got.collect()] == ["JAPAN"]
    assert engine.load_tpch(str(tmp_path), ["nation"]) == ["nation"]
    assert "lineitem" in engine.load_tpch(small)  # Parquet
    assert len(TABLES) == 8


def test_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(5).selectExpr("id AS k", "id % 2 AS g").write.parquet(folder)
    stream_table(spark, "growing", folder, spark.read.parquet(folder).schema)
    run = lambda: spark.sql("SELECT g, count(*) AS n FROM growing GROUP BY g").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    run()
    assert {(r.g, r.n) for r in spark.table("counts").collect()} == {(0, 3), (1, 2)}
