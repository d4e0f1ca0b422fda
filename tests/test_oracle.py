"""Every core query that has SQL, against that SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from oracle import compare

from planweave.plans import core_queries


@pytest.mark.parametrize("name", sorted(core_queries.ORACLE))
def test_query_equals_sql(spark, small, name):
    compare(spark, small, core_queries.QUERIES[name], core_queries.ORACLE[name])


def test_channel_union_with_ids_beyond_an_int(spark, small, tmp_path):
    for file in Path(small).iterdir():
        if file.name != "entities.parquet":
            (tmp_path / file.name).symlink_to(file)
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN entity_id % 3 = 0 THEN entity_id + 7000000000 ELSE entity_id END AS entity_id) FROM '{small}/entities.parquet') TO '{tmp_path}/entities.parquet' (FORMAT parquet)")
    assert compare(spark, str(tmp_path), core_queries.QUERIES["channel_union"], core_queries.ORACLE["channel_union"]) > 0


@pytest.mark.parametrize("name", sorted(set(core_queries.QUERIES) - set(core_queries.ORACLE)))
def test_query_without_sql_runs(spark, small, name):
    assert core_queries.QUERIES[name](spark, small).count() > 0


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["entity_type", "n", "documents"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
