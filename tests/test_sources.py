from pyspark.errors import PySparkException
import pytest

from basketry.sources import readers, sinks
from basketry.sources.schemas import CATALOG


def write(path, text):
    path.write_text(text)
    return str(path)


def test_quoted_line_breaks_stay_in_one_row(spark, tmp_path):
    path = write(tmp_path / "r.csv", 'id,message,title\n1,"line1\nline2 ""q""",\n2,plain,t\n')
    df = readers.read_csv(spark, path, {"id": "int"}, free_text=True)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'line1\nline2 "q"', None), (2, "plain", "t")]


def test_missing_markers_become_null(spark, tmp_path):
    path = write(tmp_path / "m.csv", "a,b,c\nNA,NaN,x\n1,2.5,null\n")
    rows = readers.read_csv(spark, path, {"a": "int", "b": "double"}).collect()
    assert {tuple(r) for r in rows} == {(None, None, "x"), (1, 2.5, None)}


def test_columns_are_matched_by_name(spark, tmp_path):
    path = write(tmp_path / "o.csv", "price,order_id\n1.5,x\n")
    df = readers.read_csv(spark, path, {"order_id": "string", "price": "double"})
    assert df.first().asDict() == {"price": 1.5, "order_id": "x"}


def test_bad_value_raises(spark, tmp_path):
    path = write(tmp_path / "b.csv", "ts\nbad\n")
    with pytest.raises(PySparkException):
        readers.read_csv(spark, path, {"ts": "timestamp_ntz"}).collect()


def test_catalog_with_rename_and_views(spark, tmp_path):
    for spec in CATALOG:
        names = list(spec.types) or ["code", "label"]
        misspelt = {new: old for old, new in spec.renames.items()}
        header = ",".join(misspelt.get(n, n) for n in names)
        (tmp_path / spec.file.replace("*", "shop_")).write_text(f"{header}\n" + "," * (len(names) - 1) + "\n")
    tables = readers.load_catalog(spark, str(tmp_path))
    assert "product_name_length" in tables["products"].columns
    assert "product_name_lenght" not in tables["products"].columns
    assert len(tables) == 9
    assert readers.sql_scan(spark, "SELECT count(*) AS n FROM sellers").first()["n"] == tables["sellers"].count()
    assert dict(tables["orders"].dtypes)["order_purchase_timestamp"] == "timestamp_ntz"


def test_broken_whole_numbers_raise(spark, tmp_path):
    path = write(tmp_path / "w.csv", "n\n58.0\n58\nNA\n")
    assert [r.n for r in readers.read_csv(spark, path, {"n": "int"}).collect()] == [58, 58, None]
    path = write(tmp_path / "v.csv", "n\n58.7\n")
    with pytest.raises(PySparkException):
        readers.read_csv(spark, path, {"n": "int"}).collect()


def test_two_exports_of_a_table_raise(spark, tmp_path):
    for name in ("a_orders_dataset.csv", "b_orders_dataset.csv"):
        write(tmp_path / name, "order_id,customer_id\n1,2\n")
    orders = next(s for s in CATALOG if s.name == "orders")
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path), orders)


def test_only_free_text_tables_are_read_whole(spark):
    assert [spec.name for spec in CATALOG if spec.free_text] == ["order_reviews"]


def test_sinks_replace_and_count(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(10), path)
    assert sinks.replace_table(spark.range(3), path).count() == 3
    assert sinks.import_table(spark.range(7), path) == 7
    counts = sinks.import_tables({"a": spark.range(2), "b": spark.range(5)}, str(tmp_path / "all"))
    assert {tuple(r) for r in counts.collect()} == {("a", 2), ("b", 5)}


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_report_round_trip(spark, tmp_path, fmt):
    report = spark.createDataFrame([("SP", 'a "b", c', 1.25)], "state string, text string, x double")
    sinks.write_reports({"r": report}, str(tmp_path), fmt)
    path = str(tmp_path / "r")
    back = readers.read_csv(spark, path, dict(report.dtypes)) if fmt == "csv" else spark.read.format(fmt).load(path)
    assert back.select(*report.columns).collect() == report.collect()


def test_table_schema_lists_columns(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [tuple(r) for r in readers.table_schema(df).collect()] == [(1, "a", "int", 2), (2, "b", "string", 1)]


def test_types_come_from_all_values(spark, tmp_path):
    header = "whole,gaps,big,real,code,when,text,empty,odd,late"
    body = ["1,NA,3000000000,1.5,00012,2018-01-02 03:04:05,a,,1,1"] * 300 + ["-2,7,-4,2e3,10,2018-01-02,7,,2018-01-01,x"]
    path = write(tmp_path / "i.csv", "\n".join([header, *body]) + "\n")
    df = readers.read_csv(spark, path, infer=True)
    assert dict(df.dtypes) == {
        "whole": "int", "gaps": "int", "big": "bigint", "real": "double", "code": "string", "when": "timestamp_ntz",
        "text": "string", "empty": "string", "odd": "string", "late": "string",
    }
    assert df.agg({"gaps": "sum", "real": "max"}).first().asDict() == {"sum(gaps)": 7, "max(real)": 2000.0}
    declared = readers.read_csv(spark, path, {"whole": "string"}, infer=True)
    assert dict(declared.dtypes)["whole"] == "string"


@pytest.mark.parametrize("value, kind", [("1d", "string"), ("1.", "double"), (".5", "double"), ("+3", "int"), ("-", "string"), ("0", "int"), ("Infinity", "string"), ("2018-13-01", "string"), ("9" * 30, "double")])
def test_odd_values(spark, tmp_path, value, kind):
    path = write(tmp_path / "o.csv", f"v\n{value}\n")
    df = readers.read_csv(spark, path, infer=True)
    assert dict(df.dtypes) == {"v": kind}
    assert df.count() == 1 and df.first().v is not None


def test_types_of_a_file_without_rows(spark, tmp_path):
    path = write(tmp_path / "n.csv", "a,b\n")
    assert readers.read_csv(spark, path, infer=True).dtypes == [("a", "string"), ("b", "string")]


@pytest.mark.parametrize("sink", [sinks.replace_table, sinks.import_table, sinks.write_report])
def test_a_write_that_fails_leaves_the_old_rows(spark, tmp_path, sink):
    path = tmp_path / "t"
    sink(spark.range(10), str(path))
    broken = spark.range(100).selectExpr("if(id = 77, raise_error('stop'), id) AS id")
    with pytest.raises(PySparkException):
        sink(broken, str(path))
    assert spark.read.parquet(str(path)).count() == 10
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_table_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "s")
    sinks.replace_table(spark.range(10), path)
    assert sinks.replace_table(spark.read.parquet(path).where("id < 4"), path).count() == 4
