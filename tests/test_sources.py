import json

import pytest
from pyspark.sql import functions as F

from cashtrail import contract
from cashtrail.operators import quality, scoring
from cashtrail.session import new_folder
from cashtrail.sources import readers, writers


@pytest.fixture
def folder(spark):
    return new_folder(spark, "test-sources")


def _same(a, b):
    assert a.columns == b.columns
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_json_array_comes_before_csv(spark, tmp_path):
    record = {"complaint_id": "CG2024000001", "timestamp": "2024-01-02T03:04:05", "amount_lost": 12.5}
    (tmp_path / "data.json").write_text(json.dumps([record, {**record, "complaint_id": "CG2024000002"}], indent=2))
    (tmp_path / "data.csv").write_text("complaint_id,amount_lost\nfrom_csv,1\n")
    rows = readers.load_complaints(spark, str(tmp_path / "data"))
    assert {r["complaint_id"] for r in rows.collect()} == {"CG2024000001", "CG2024000002"}
    assert rows.first()["timestamp"].isoformat() == "2024-01-02T03:04:05"


def test_csv_when_there_is_no_json(spark, tmp_path):
    (tmp_path / "data.csv").write_text(
        "amount_lost,complaint_id,jurisdiction,timestamp\n1.5,a,Delhi,2024-01-02T03:04:05\n,b,,2024-01-02T03:04:05.25\n"
    )
    rows = readers.load_complaints(spark, str(tmp_path / "data"))
    assert rows.dtypes == [
        ("amount_lost", "double"),
        ("complaint_id", "string"),
        ("jurisdiction", "string"),
        ("timestamp", "timestamp"),
    ]
    assert [r["amount_lost"] for r in rows.orderBy("complaint_id").collect()] == [1.5, None]


def test_no_source_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.load_complaints(spark, str(tmp_path / "none"))


def test_malformed_csv_fails(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("complaint_id,amount_lost\na,not a number\n")
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_export_keeps_everything(spark, complaints, folder):
    json_path, csv_path = writers.export_both(complaints, folder + "/both")
    _same(readers.read_json(spark, json_path, array=False), complaints)
    _same(readers.load_complaints(spark, folder + "/both"), complaints)
    _same(readers.read_csv(spark, csv_path).select(*complaints.columns), complaints)


def test_feature_store_formats(complaints, folder):
    for kind in ("parquet", "csv"):
        _same(writers.write_feature_store(complaints, f"{folder}/{kind}", kind), complaints)


def test_replace_and_append(spark, complaints, folder):
    table = folder + "/table"
    n = complaints.count()
    writers.replace_table(complaints, table)
    writers.replace_table(complaints, table)
    assert spark.read.parquet(table).count() == n
    assert writers.append_table(complaints, table) == n
    assert spark.read.parquet(table).count() == 2 * n


def test_stage_paths():
    assert writers.stage_path("s3a://b/artifact/", "r1", "split") == "s3a://b/artifact/run_ts=r1/split"


def test_contract_texts():
    as_json = contract.CLEAN_SCHEMA.json()
    assert readers.load_contract(as_json) == contract.CLEAN_SCHEMA
    assert readers.load_contract("a int, b string").names == ["a", "b"]


def test_yaml_contract(complaints):
    pytest.importorskip("yaml")
    text = "columns:\n" + "".join(f"  - {c}: object\n" for c in contract.RAW_COLUMNS) + "targets:\n  - risk_score\n"
    loaded = readers.load_contract(text)
    assert quality.check_contract(complaints, loaded).names_ok
    assert not quality.check_contract(complaints.drop("status"), loaded).names_ok


def test_prediction_log_is_pruned(spark, complaints, folder):
    inputs = complaints.drop(*scoring.RESULT_COLUMNS[1:])
    log = scoring.prediction_log(scoring.score(inputs))
    path = folder + "/log"
    writers.append_prediction_log(log, path)
    as_of = "2024-01-20 12:00:00"
    found = readers.read_prediction_log(spark, path, as_of, 3)
    wanted = log.where("timestamp between timestamp'2024-01-17 12:00:00' and timestamp'2024-01-20 12:00:00'")
    assert found.count() == wanted.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan
    assert [(f.name, f.dataType) for f in found.drop("log_date").schema] == [
        (f.name, f.dataType) for f in contract.PREDICTION_LOG_SCHEMA
    ]


def test_json_records(spark):
    df = spark.createDataFrame([("a", None)], "complaint_id string, amount_lost double")
    assert json.loads(writers.json_records(df).first()[0]) == {"complaint_id": "a", "amount_lost": None}


def test_bulk_output_folder(spark, complaints, folder):
    scored = scoring.bulk_score(complaints.drop(*scoring.RESULT_COLUMNS[1:]), F.lit("2024-01-31"))
    path = writers.write_bulk_result(scored, folder, "20240131T000000")
    assert path.endswith("run_ts=20240131T000000")
    page = scoring.result_page(scored)
    assert page.columns == list(scoring.PAGE_COLUMNS) and page.count() == 10
    assert scoring.result_page(scored, None).count() == complaints.count()


def test_files_with_another_column_order_fail(spark, tmp_path):
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text("crime_type,status\nPhishing,Open\n")
    (tmp_path / "two" / "b.csv").write_text("status,crime_type\nOpen,Phishing\n")
    with pytest.raises(Exception, match="header"):
        readers.read_csv(spark, str(tmp_path / "two")).collect()


def test_one_line_arrays_and_mixed_folders(spark, tmp_path):
    records = [{"complaint_id": str(i), "amount_lost": float(i)} for i in range(5000)]
    (tmp_path / "one.json").write_text(json.dumps(records))
    assert readers.load_complaints(spark, str(tmp_path / "one")).count() == 5000
    (tmp_path / "mixed.json").mkdir()
    (tmp_path / "mixed.json" / "a").write_text(json.dumps(records[:2]))
    (tmp_path / "mixed.json" / "b").write_text("\n".join(map(json.dumps, records[:2])))
    with pytest.raises(Exception):
        readers.load_complaints(spark, str(tmp_path / "mixed")).collect()
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, records[:3])))
    assert readers.load_complaints(spark, str(tmp_path / "lines"), array=False).count() == 3
