"""Places of lines in files that many tasks read."""

import pytest

from mealgrid.sources import exchange, raw
from mealgrid.sources.lines import broken_line, numbered_lines


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_of_split_files(spark, tmp_path, small_ranges):
    files = {"a.txt": ["" if k % 7 == 0 else f"line {k} é" * (k % 5 + 1) for k in range(400)], "b.txt": ["one"], "c.txt": [""] * 900}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    found = numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = {name: [] for name in files}
    for r in found.selectExpr("regexp_extract(file, '[^/]+$', 0) AS name", "line_no", "value").collect():
        got[r.name].append((r.line_no, r.value))
    assert {name: sorted(rows) for name, rows in got.items()} == {name: list(enumerate(lines, 1)) for name, lines in files.items()}


def test_rejects_name_file_and_line(spark, tmp_path, small_ranges):
    lines = ['{"a": %d}' % k for k in range(200)]
    lines[50], lines[120], lines[199] = '{"a": 1', "[1, 2]", "x"
    lines[10] = "  "
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    records, rejects = raw.read_jsonl(spark, str(tmp_path), "a BIGINT")
    assert records.count() == 196
    told = rejects.select(broken_line().alias("place"), "reason", "line").collect()
    assert sorted(tuple(r) for r in told) == [
        ("in.jsonl:121", "not_an_object", "[1, 2]"), ("in.jsonl:200", "bad_json", "x"), ("in.jsonl:51", "bad_json", '{"a": 1'),
    ]


def test_case_files(spark, tmp_path, small_ranges):
    (tmp_path / "cases.jsonl").write_text('// first\n{"id": "a"}\n\n{"id": \n{"id": "b"}\n')
    cases, broken = exchange.read_cases(spark, str(tmp_path), "id STRING")
    assert sorted(r.id for r in cases.collect()) == ["a", "b"]
    assert [(r.line_no, r.line) for r in broken.collect()] == [(4, '{"id": ')]
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "none.jsonl").write_text("// nothing\n\n")
    with pytest.raises(ValueError, match="no cases"):
        exchange.read_cases(spark, str(empty), "id STRING")


def _records(n):
    inner = ["plain", 'a "quoted" } text', "back\\slash\\", "{[ open", "]} closed", "é\n한", "\\\\}", '\\"}']
    return [{"id": k, "text": inner[k % 8] * (k % 4), "deep": {"list": [{"x": "}"}, {"y": [k, "]"]}], "n": None}} for k in range(n)]


@pytest.mark.parametrize("indent", [None, 1])
def test_json_arrays_of_split_files(spark, tmp_path, small_ranges, indent):
    import json

    from mealgrid.sources.json_arrays import array_records

    want = {"a.json": _records(160), "b.json": _records(1), "c.json": [], "d.json": [{}, {"id": 1}]}
    for name, rows in want.items():
        (tmp_path / name).write_text(json.dumps(rows, indent=indent, ensure_ascii=indent is None) + "\n")
    assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 20
    got = {name: [] for name in want}
    for r in array_records(spark, str(tmp_path)).collect():
        got[r.file.rsplit("/")[-1]].append((r.record_no, json.loads(r.value)))
    assert {name: sorted(rows, key=lambda r: r[0]) for name, rows in got.items()} == {n: list(enumerate(rows, 1)) for n, rows in want.items()}


def test_json_records_of_both_shapes(spark, tmp_path, small_ranges):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2, "b": "x"}]')
    (tmp_path / "b.json").write_text('{"fields": [], "records": [{"a": 3}]}')
    assert sorted(r.a for r in raw.read_json_records(spark, str(tmp_path)).collect()) == [1, 2, 3]
    (tmp_path / "a.json").write_text('[{"a": 1}, 7, {"a": 2}]')
    with pytest.raises(Exception, match="records must be JSON objects"):
        raw.read_json_records(spark, str(tmp_path))


def test_files_of_two_schemas(spark, tmp_path):
    one, two = spark.range(7), spark.range(3).selectExpr("id AS b", "'x' AS a")
    one.coalesce(1).write.parquet(str(tmp_path / "d" / "one"))
    one.limit(0).coalesce(1).write.parquet(str(tmp_path / "d" / "none"))
    two.coalesce(1).write.parquet(str(tmp_path / "d" / "two"))
    files = raw.parquet_files(spark, str(tmp_path / "d"))
    assert sorted((r.fingerprint, r.columns, r.row_count) for r in files.collect()) == [
        ("a:string,b:bigint", ["a", "b"], 3), ("id:bigint", ["id"], 0), ("id:bigint", ["id"], 7),
    ]
    assert raw.parquet_files(spark, str(tmp_path / "d" / "one")).select("row_count").first().row_count == 7
