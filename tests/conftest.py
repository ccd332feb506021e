import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from labelfold.session import local_session
    s = local_session("*", 8, app="labelfold-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def products(spark):
    # shared 10-row product frame: Electronics 4, Computers 5, Tablets 1
    rows = [("iPhone 15 Pro", "Electronics"), ("Samsung Galaxy S24", "Electronics"),
            ("Sony WH-1000XM5", "Electronics"), ("Apple Watch", "Electronics"),
            ("MacBook Pro 16", "Computers"), ("Dell XPS 13", "Computers"),
            ("Lenovo ThinkPad", "Computers"), ("HP Spectre", "Computers"),
            ("Asus ROG", "Computers"), ("iPad Air", "Tablets")]
    return spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(rows)],
                                 "doc_id long, product_title string, category string")
