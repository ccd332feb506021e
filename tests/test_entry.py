import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"label", "precision", "recall", "f1", "support"}


def test_every_query_has_an_oracle_twin():
    optional = entry.llm.QUERIES.keys() | {"pipeline"} if entry.llm else set()  # those may go without SQL
    q, s = set(entry.queries()) - optional, set(entry.oracle_sql()) - optional
    assert q == s and len(q) >= 60


def test_optional_queries_are_all_there_or_none():
    names = {k for k in entry.queries() if k.startswith("op") and k[2].isdigit() or k == "pipeline"}
    assert len(names) == (14 if entry.llm else 0) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_optional_subpackage(tmp_path):
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("__spark_entry__.py", "labelfold"):
        os.makedirs(tmp_path / "r", exist_ok=True)
        if name.endswith(".py"):
            (tmp_path / "r" / name).write_text(open(f"{root}/{name}").read())
        else:
            os.makedirs(tmp_path / "r" / name)
            for part in os.listdir(f"{root}/{name}"):
                if part != "llm":
                    os.symlink(f"{root}/{name}/{part}", tmp_path / "r" / name / part)
    code = "import __spark_entry__ as e; q = e.queries(); assert e.llm is None and len(q) >= 60 and set(q) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": ""}, check=True)


def test_column_names_match_oracle_for_fast_keys(spark):
    con = duckdb.connect()
    for t in ("documents", "orders", "customer", "lineitem", "part", "supplier", "events", "nation", "region",
              "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for key in ("evaluate", "class_weights", "account_balance", "acceptance_rate", "latency_slo", "tx_tags"):
        spark_cols = sorted(entry.queries()[key](spark, SF).columns)
        duck_cols = sorted(d[0] for d in con.execute(entry.oracle_sql()[key]).description)
        assert spark_cols == duck_cols, key
