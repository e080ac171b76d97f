"""Some registered queries side by side with their SQL, on the smallest tables."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["flagstat", "depth_histogram", "per_target_coverage", "samtools_sn", "picard_insert_metrics", "picard_alignment_summary", "wgs_overlap", "violations", "broken_rules", "typed_metric_diff", "target_partition", "uniformity_penalty"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{file}'")
    ours = entry.queries()[name](spark, FOLDER)
    columns = sorted(ours.columns)
    cursor = connection.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    theirs = [tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()]
    assert sorted(names) == columns
    assert sorted(map(repr, theirs)) == sorted(repr(tuple(r[c] for c in columns)) for r in ours.collect())


def test_every_query_has_a_name_and_most_have_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
