import pytest
from pyspark.sql import functions as F

from bicspark import sources
from bicspark.operators import cells as cel
from bicspark.operators import concepts as con
from bicspark.operators import grid as gr
from bicspark.operators import itemsets as its
from bicspark.plans.bicluster import biclusters, bucketed_triples
from bicspark.plans.stages import Stages, shared_folder


@pytest.fixture(scope="module")
def cells(spark):
    data = [(r, c, float((r * 7 + c * 3) % 11)) for r in range(40) for c in range(6)]
    return spark.createDataFrame(data, "row_id bigint, col int, value double")


def test_matrix_rows_are_numbered_in_file_order(spark, tmp_path):
    lines = [f"{i},{i * 2}.5,-{i}" for i in range(5000)]
    # Files of very different size, which the scan does not take up in path order.
    for name, part in (("a", lines[:10]), ("b", lines[10:4000]), ("c", lines[4000:])):
        (tmp_path / f"{name}.csv").write_text("\n".join(part) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        matrix = sources.read_matrix(spark, str(tmp_path))
        assert matrix.rdd.getNumPartitions() > 3
        rows = sorted((r.row_id, r["values"]) for r in matrix.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == [(i, [float(i), i * 2 + 0.5, float(-i)]) for i in range(5000)]


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("cell", ["x", "", "1 2"])
def test_a_cell_that_is_no_number_fails(spark, tmp_path, ansi, cell):
    (tmp_path / "m.csv").write_text(f"1,2\n3,{cell},4\n")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="not a number"):
            sources.read_matrix(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_empty_cells_at_the_end_of_a_line_are_none(spark, tmp_path):
    (tmp_path / "m.csv").write_text("7,8,9,\n1,2,,\n")
    rows = sources.read_matrix(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r["values"] for r in rows] == [[7.0, 8.0, 9.0], [1.0, 2.0]]


def test_prepared_lines(spark, tmp_path, cells):
    rows = cel.sort_cells(cells)
    back = sources.read_prepared(
        spark, _written(sources.prepared_lines(rows), tmp_path, "prepared")
    )
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    (tmp_path / "short.txt").write_text("x\n\n4\t1.5$2 3.0$0\n")
    assert [tuple(map(tuple, r.cells)) for r in sources.read_prepared(spark, str(tmp_path / "short.txt")).collect()] == [
        ((1.5, 2), (3.0, 0))
    ]


def _written(lines, folder, name):
    sources.write_stage(lines, str(folder), name, "text")
    return f"{folder}/{name}"


@pytest.mark.parametrize("per_line", [7, 10_000])
def test_bucket_lines(spark, tmp_path, cells, per_line):
    grid = gr.range_grid(0, 12, 3, 0.5)
    found = bucketed_triples(cells, grid).withColumn("bucket", gr.bucket_label("bucket_id", grid))
    lines = sources.bucket_lines(found, per_line)
    n_ranges = found.select("bucket").distinct().count()
    assert lines.count() == n_ranges if per_line > 1000 else lines.count() > n_ranges
    back = sources.read_buckets(spark, _written(lines, tmp_path, "reduced"))
    columns = ["bucket", "row_id", "cols", "values", F.col("variance7").alias("variance")]
    assert sorted(map(str, back.collect())) == sorted(map(str, found.select(*columns).collect()))


def test_concept_lines_hold_every_row_once(spark, tmp_path, cells):
    closed, ranked = biclusters(cells, gr.range_grid(0, 12, 3, 0.5), minsup=3, least_cols=2)
    whole = {r.value for r in sources.concept_lines(closed, ranked).collect()}
    assert len(whole) == ranked.count() > 3

    def parse(line):
        ids, shape = line.split(" % ")
        rows, cols = ids.split(",")
        return rows.split(), cols, shape

    merged = {}
    cut = sources.concept_lines(closed, ranked, per_line=4).collect()
    for r in cut:
        rows, cols, shape = parse(r.value)
        merged.setdefault((r.level, r.node, cols, shape), []).extend(rows)
    assert len(cut) > len(merged)
    again = {(tuple(sorted(map(int, rows))), cols, shape) for (_, _, cols, shape), rows in merged.items()}
    assert again == {(tuple(map(int, rows)), cols, shape) for rows, cols, shape in map(parse, whole)}

    sources.write_concepts(sources.concept_lines(closed, ranked), str(tmp_path / "final"), "text", files=1)
    assert {r.value for r in spark.read.text(str(tmp_path / "final")).collect()} == whole
    sources.write_concepts(ranked, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == len(whole)


def test_lines_are_written_by_rank_and_hold_rare_concepts(spark, tmp_path, cells):
    grid = gr.range_grid(0, 12, 3, 0.5)
    closed, ranked = biclusters(cells.where("row_id < 9"), grid, minsup=5, item="col_value", least_cols=1, include_subsupport=True)
    wanted = [(r.n_rows, r.n_cols) for r in ranked.collect()]
    assert ranked.where("level = -1").count() > 0
    for files in (1, None):
        path = str(tmp_path / f"ranked-{files}")
        sources.write_concepts(sources.concept_lines(closed, ranked), path, "text", files=files)
        parts = sorted((tmp_path / f"ranked-{files}").glob("part-*"))
        lines = [line for p in parts for line in p.read_text().splitlines()]
        assert [tuple(map(int, line.split(" % ")[1].split(","))) for line in lines] == wanted
        assert all(len(line.split(",")[0].split()) == n for line, (n, _) in zip(lines, wanted, strict=True))
    with pytest.raises(Exception, match="without its rows"):
        closed.extents(ranked.drop("rows")).collect()


def test_stages_use_the_shared_folder_of_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    stages = Stages(spark)
    table, n = stages.counted_table(spark.range(10), "ids", F.col("id") > 6)
    assert n == 3 and table.count() == 10 and stages.folder.startswith(folder)
    assert stages.spread(table, 100_000, "id").rdd.getNumPartitions() == 4


def test_pruned_columns_are_not_computed(spark, cells):
    plan = bucketed_triples(cells, gr.default_grid()).select("row_id", "bucket_id", "cols")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "sqrt" not in text.lower() and "variance" not in text


def test_grouping_by_row_reuses_the_partitioning_of_the_cells(spark, cells):
    trans = its.transactions(bucketed_triples(cells, gr.default_grid()))
    plan = trans._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "PythonUDF" not in plan


def test_lines_do_not_depend_on_sizes(spark, cells):
    """Rows of one block of ids share a line, however many triples or rows the rest has."""
    grid = gr.range_grid(0, 12, 3, 0.5)
    found = bucketed_triples(cells, grid).withColumn("bucket", gr.bucket_label("bucket_id", grid))
    for per_line in (1, 3, 1000):
        blocks = {(r.bucket, r.row_id // per_line) for r in found.collect()}
        lines = sources.bucket_lines(found, per_line).collect()
        assert len(lines) == len(blocks)
        some = {r.value for r in sources.bucket_lines(found.where(F.col("row_id") < 2 * per_line), per_line).collect()}
        assert some <= {r.value for r in lines}
    with pytest.raises(ValueError):
        sources.bucket_lines(found, 0)


def test_columns_in_the_order_of_their_text(spark):
    data = [(r, c, 1.0) for r in range(4) for c in (2, 10, 9)]
    matrix = spark.createDataFrame(data, "row_id bigint, col int, value double")
    closed, ranked = biclusters(matrix, gr.range_grid(0, 4, 4, 0), minsup=3, least_cols=3)
    by_text = sources.concept_lines(closed, ranked, item_order="text").collect()
    assert [r.value for r in by_text] == ["0 1 2 3,10 2 9 % 4,3"]
    assert [r.value for r in sources.concept_lines(closed, ranked).collect()] == ["0 1 2 3,2 9 10 % 4,3"]
    with pytest.raises(ValueError):
        sources.concept_lines(closed, ranked, item_order="size")


def test_positions_follow_the_ranking(spark, cells):
    _, ranked = biclusters(cells, gr.range_grid(0, 12, 3, 0.5), minsup=3, least_cols=2)
    placed = {(r.level, r.node): r.position for r in con.with_position(ranked).collect()}
    assert [placed[r.level, r.node] for r in ranked.collect()] == list(range(1, len(placed) + 1))
