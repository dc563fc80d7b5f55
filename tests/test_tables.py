"""The stated schemas must equal what the files hold, at every scale."""

from __future__ import annotations

import pytest

from millrace.sources.tables import SCHEMAS, read_table


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_schema_equals_file(spark, name, sf):
    sf_dir = f"/root/testdata/{sf}"
    stated = read_table(spark, sf_dir, name).dtypes
    in_file = spark.read.parquet(f"{sf_dir}/{name}.parquet").dtypes
    assert stated == in_file


def test_absent_and_wrong_columns_raise(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "r_regionkey int, name string").write.parquet(
        str(tmp_path / "region.parquet")
    )
    with pytest.raises(ValueError, match="r_name"):
        read_table(spark, str(tmp_path), "region")
    spark.createDataFrame([(1, 2)], "item_id int, text long").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    with pytest.raises(ValueError, match="item_id.*text"):
        read_table(spark, str(tmp_path), "benchmark")
