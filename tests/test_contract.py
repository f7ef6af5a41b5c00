"""Tables are checked against their declared schemas when read and written."""

from __future__ import annotations

import tempfile

import pytest

from cairn import contract
from cairn.plans.substrate import view

from .conftest import SMALL


@pytest.mark.parametrize("table, name", [("places", "v_places"), ("designations", "v_designations"), ("temporal", "v_temporal"), ("rights", "v_rights")])
def test_views_keep_the_contract(spark, table, name):
    df = view(spark, SMALL, name)
    assert contract.differences(df.schema, table) == [] and contract.violations(df, table).count() == 0
    path = f"{tempfile.mkdtemp(prefix='spark-contract-')}/t"
    contract.write(df, table, path)
    again = contract.read(spark, table, path)
    assert again.columns == contract.schema(table).names and again.count() == df.count()


def test_differences_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", None)], "image_id int, licence string, other string")
    assert contract.differences(df.schema, "rights") == ["image_id is int, not bigint", "attribution is missing"]
    with pytest.raises(ValueError, match="attribution is missing"):
        contract.checked(df, "rights")
    odd = spark.createDataFrame([(None, "a", "b"), (2, None, None)], "image_id long, attribution string, licence string")
    assert contract.violations(odd, "rights").count() == 1
    path = f"{tempfile.mkdtemp(prefix='spark-contract-')}/t"
    with pytest.raises(Exception, match="rights.image_id is null"):
        contract.write(odd, "rights", path)
    spark.createDataFrame([(1, "x")], "image_id int, attribution string").write.parquet(f"{path}2")
    with pytest.raises(ValueError, match="not bigint"):
        contract.read(spark, "rights", f"{path}2")
