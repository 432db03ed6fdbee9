"""Queries over tables that are folders of part files."""

import os

import pytest

from queries.catalog import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name, table", [("check_stream", "documents"), ("tag_stream", "conversations")])
def test_stream_of_a_folder_equals_that_of_one_file(spark, tmp_path, name, table):
    spark.read.parquet(f"{SF_DIR}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    whole, parts = (QUERIES[name](spark, at) for at in (SF_DIR, str(tmp_path)))
    assert whole.count() > 0
    assert sorted(whole.collect()) == sorted(parts.collect())
