import random

import duckdb
import pytest

import __spark_entry__ as entry
from bicspark.operators import cells as cel
from bicspark.operators import predict as pre
from bicspark.operators import similar as sim
from workload import matrices as mat
from workload.oracles import ORACLES
from workload.queries import QUERIES, SEEDS, THETA

DATA = "/root/testdata/sf0.001"
QUICK = ["row_triples", "bucket_all", "closed_itemsets_by_month", "concepts_by_rows", "bucket_text_roundtrip"]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.queries()) >= set(entry.oracle_sql()) >= set(ORACLES)


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["bucket_id", "cols", "n_cols", "n_rows"] and result.count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("lineitem", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    expected = con.sql(entry.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    rows = con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, rows))


def test_both_stages_of_the_combined_queries_take_the_whole_matrix(spark, tmp_path):
    """Concepts of two columns predict too, and rows that the first stage predicts are mined again."""
    rng = random.Random(3)
    rows = [(r, [rng.randint(0, 9) / 100 for _ in range(5)], r % 3) for r in range(60)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    labels = QUERIES["combined_training_labels"](spark, str(tmp_path))
    got = {r.row_id for r in labels.collect()}
    first = {r.row_id for r in QUERIES["training_labels"](spark, str(tmp_path)).collect()}
    cells = cel.to_cells(mat.vectors(spark, str(tmp_path)), values="values")
    sets, found = sim.similar_value_biclusters(cells, THETA, mat.MINSUP, 2)
    second = {r.row_id for r in pre.training_rows(pre.seed_rows(sets, found, SEEDS)).collect()}
    assert first and second and got == first | second
