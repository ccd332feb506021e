import pytest

from labelfold.sources.csv_source import read_labelled_csv

CONF = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def block_bytes(spark):
    old = {k: spark.conf.get(k) for k in (CONF, "spark.sql.files.openCostInBytes")}

    def put(n):
        spark.conf.set(CONF, str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield put
    for k, v in old.items():
        spark.conf.set(k, v)


def _same(spark, path, multi=None):
    want = sorted(map(tuple, read_labelled_csv(spark, path).collect()), key=str)
    got = sorted(map(tuple, read_labelled_csv(spark, path, ranges=True).collect()), key=str)
    assert got == want
    return got


TEXT = ('product_title,category\n"Phone, ""Pro""\nEdition",Electronics\n\nplain,x\n"a\n\n""\n,""b\n",y\n'
        '"",z\nshort\n"\n\n\n\n\n\n\n\n\n\n\n\n",w\n"x\r\ny","p\n""q"\nlast,"no\nnewline"')


def test_equals_the_multiline_scan_at_every_range_size(spark, tmp_path, block_bytes):
    path = tmp_path / "a.csv"
    path.write_bytes(TEXT.encode())
    for n in (1, 2, 3, 5, 7, 11, 16, 23, 40, 90, 1000):
        block_bytes(n)
        assert len(_same(spark, str(path))) == 8


def test_line_ends_are_taken_as_pandas_does(spark, tmp_path, block_bytes):
    """Files of CR LF, and of both kinds of line ends, where Spark's own scan leaves a CR in the last field."""
    import pandas as pd
    for k, text in enumerate((TEXT.replace("\r\n", "\n").replace("\n", "\r\n"), TEXT.replace(',y\n', ',y\r\n'))):
        path = tmp_path / f"e{k}.csv"
        path.write_bytes(text.encode())
        want = pd.read_csv(path, dtype=str).astype(object)
        want = sorted((tuple(None if pd.isna(v) else v for v in r) for r in want.itertuples(index=False)), key=str)
        for n in (1, 7, 1000):
            block_bytes(n)
            assert sorted(map(tuple, read_labelled_csv(spark, str(path), ranges=True).collect()), key=str) == want


def test_a_quoted_line_break_at_every_offset(spark, tmp_path, block_bytes):
    block_bytes(16)
    for shift in range(0, 18, 3):
        path = tmp_path / f"s{shift}.csv"
        path.write_text("a,b\n" + "k" * shift + ',1\n"u\nv",2\n"""\n""",3\nw,4\n')
        assert len(_same(spark, str(path))) == 4


def test_folders_of_files_and_long_records(spark, tmp_path, block_bytes):
    block_bytes(4096)
    d = tmp_path / "d"
    d.mkdir()
    for i in range(3):
        rows = "".join(f'"t{i}-{j}\n{"ю" * (j % 50)}",c{j % 3}\n' for j in range(400))
        (d / f"{i}.csv").write_text("product_title,category\n" + rows + '"' + "long\n" * 5000 + f'",z{i}\n')
    assert len(_same(spark, str(d))) == 3 * 401


def test_what_would_make_the_count_wrong_raises(spark, tmp_path, block_bytes):
    for text, message in (('a,b\n5" pipe,1\n6" pipe,2\n', "unquoted"), ('a,b\n1,2\n"open,3\n4,5\n', "inside a quoted"),
                          ('a,b\n1,2,3\n', "more fields")):
        path = tmp_path / f"{abs(hash(text))}.csv"
        path.write_text(text)
        with pytest.raises(Exception, match=message):
            read_labelled_csv(spark, str(path), ranges=True).collect()


def test_only_records_of_several_lines_are_shuffled_and_ranges_run_in_parallel(spark, tmp_path, block_bytes):
    path = tmp_path / "big.csv"
    path.write_text("a,b\n" + "".join(f'"x{i}\ny",{i}\n' if i % 100 == 0 else f"x{i},{i}\n" for i in range(20_000)))
    block_bytes(32 * 1024)
    got = read_labelled_csv(spark, str(path), ranges=True)
    assert got.rdd.getNumPartitions() >= 8 and got.count() == 20_000


def test_empty_files(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text("a,b\n")
    assert read_labelled_csv(spark, str(path), ranges=True).count() == 0
