import pytest

from labelfold.operators.quality import preprocess, preprocess_removed, validate, validate_profile
from labelfold.sources.columns import map_columns, resolve_mapping
from labelfold.sources.csv_source import load_dataset, read_labelled_csv


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_csv_quotes_newlines_and_na(spark, tmp_path):
    d = write(tmp_path, "product_titles.csv",
              'product_title,category\n"Phone, ""Pro""\nEdition",Electronics\nNA,Computers\n'
              '"Laptop",None\n')
    df = load_dataset(spark, d)
    rows = sorted(df.collect(), key=lambda r: str(r[0]))
    assert [tuple(r) for r in rows] == sorted([('Phone, "Pro"\nEdition', "Electronics"),
                                               (None, "Computers"), ("Laptop", None)],
                                              key=lambda r: str(r[0]))


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_dataset(spark, str(tmp_path), "nope.csv")


def test_overlong_row_fails(spark, tmp_path):
    d = write(tmp_path, "bad.csv", "product_title,category\na,b\nc,d,e\n")
    with pytest.raises(Exception):
        read_labelled_csv(spark, f"{d}/bad.csv").collect()


def test_short_row_padded(spark, tmp_path):
    d = write(tmp_path, "short.csv", "product_title,category\na,b\nc\n")
    rows = sorted(tuple(r) for r in read_labelled_csv(spark, f"{d}/short.csv").collect())
    assert rows == [("a", "b"), ("c", None)]


def test_autodetect_and_mapping(spark):
    df = spark.createDataFrame([("x", "y", "z")], "title string, category_name string, other string")
    assert map_columns(df).columns == ["product_title", "category"]
    assert tuple(map_columns(df).first()) == ("x", "y")
    m = map_columns(df, {"product_title": "other", "category": "category_name"})
    assert tuple(m.first()) == ("z", "y")


def test_empty_mapping_does_not_autodetect():
    with pytest.raises(ValueError, match="missing"):
        resolve_mapping(["title", "category_name"], {})


def test_undetectable_columns(spark):
    df = spark.createDataFrame([("a", "b")], "col1 string, col2 string")
    with pytest.raises(ValueError, match="product_title"):
        map_columns(df)


@pytest.mark.parametrize("rows,schema,msg", [
    ([], "product_title string, category string", "empty"),
    ([("a",)], "title string", "missing"),
    ([(1, "x"), (2, "y"), (3, "x")], "product_title int, category string", "type"),
    ([("a", "x"), (None, "y"), ("c", None)], "product_title string, category string", "nulls"),
    ([("a", "x"), ("", "y"), ("c", "x")], "product_title string, category string", "blank_title"),
    ([("a", "x"), ("b", "x")], "product_title string, category string", "too_few"),
])
def test_validation_order(spark, rows, schema, msg):
    df = spark.createDataFrame(rows, schema)
    with pytest.raises(ValueError, match=msg):
        validate(df)


def test_validation_ok_and_profile(spark, products):
    assert validate(products) is True
    p = validate_profile(products).first()
    assert (p["n_rows"], p["n_categories"], p["status"]) == (10, 3, "ok")


def test_preprocess_drops_blank(spark):
    df = spark.createDataFrame([("  A  ", " x "), ("   ", "y"), ("B", "z ")],
                               "product_title string, category string")
    out = sorted(tuple(r) for r in preprocess(df).collect())
    assert out == [("a", "x"), ("b", "z")]
    r = preprocess_removed(df).first()
    assert (r["n_before"], r["n_after"], r["n_removed"]) == (3, 2, 1)


def test_csv_alternative_names_and_mapping(spark, tmp_path):
    d = write(tmp_path, "alt.csv", "title,category_name\niPhone 15,Electronics\nMacBook,Computers\n"
              "Galaxy,Electronics\nDell XPS,Computers\n")
    auto = load_dataset(spark, d, "alt.csv")
    assert auto.columns == ["product_title", "category"] and auto.count() == 4
    mapped = load_dataset(spark, d, "alt.csv", {"product_title": "title", "category": "category_name"})
    assert sorted(r["category"] for r in mapped.collect()) == ["Computers", "Computers", "Electronics", "Electronics"]
    with pytest.raises(ValueError):
        load_dataset(spark, d, "alt.csv", {"product_title": "nope"})


def test_long_quoted_fields_in_rows_that_do_not_fit(spark, tmp_path):
    from labelfold.sources.csv_source import read_labelled_csv
    path = tmp_path / "long.csv"
    path.write_text('a,b,c\n"' + "x, " * 350_000 + '"\n"' + 'q""q,' * 50_000 + '",2\n1,2,3\n')
    rows = read_labelled_csv(spark, str(path)).collect()
    assert [r.c for r in rows] == [None, None, "3"] and len(rows[0].a) == 1_050_000 and rows[1].b == "2"
    path.write_text('a,b\n"' + 'q""q,' * 50_000 + '",2,3\n')
    with pytest.raises(Exception, match="more fields"):
        read_labelled_csv(spark, str(path)).collect()
