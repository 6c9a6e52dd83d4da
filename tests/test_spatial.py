import pytest
from pyspark.sql import functions as F

from voxelfield.operators import graphs, inclusion, joins, parcels, screening

ROWS, COLS = 5, 4


@pytest.fixture(scope="module")
def lattice(spark):
    """Corner 2 x 2 cells are excluded, so a corner square has no kept cell."""
    return spark.createDataFrame(
        [(v, v % ROWS, v // ROWS, 1 + v % 2, v % ROWS < 2 and v // ROWS < 2, (v * 7 + 3) % 5 < 2) for v in range(ROWS * COLS)],
        "voxel_id int, row int, col int, partition_id int, excluded boolean, on boolean",
    ).withColumn("delta", F.col("on").cast("int")).drop("on")


def square(cells, v, r, masked):
    me = cells[v]
    near = [c for c in cells.values() if abs(c.row - me.row) <= r and abs(c.col - me.col) <= r and not (masked and c.excluded)]
    return sum(c.delta for c in near) / len(near) if near else None


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_windows_against_brute_force(spark, lattice, partitions):
    cells = {r.voxel_id: r for r in lattice.collect()}
    spread = lattice.repartition(partitions)
    radius = spark.createDataFrame([(1, 1), (2, 2)], "partition_id int, radius int")
    plain = inclusion.window_inclusion(spread.drop("delta"), spread, radius, [1, 2]).collect()
    masked = inclusion.window_inclusion_masked(spread.drop("delta"), spread, radius, [1, 2]).collect()
    for r in plain:
        assert r.p == pytest.approx(square(cells, r.voxel_id, cells[r.voxel_id].partition_id, False))
    for r in masked:
        want = square(cells, r.voxel_id, cells[r.voxel_id].partition_id, True)
        assert r.p is None if want is None else r.p == pytest.approx(want)
    assert cells[0].partition_id == 1 and next(r.p for r in masked if r.voxel_id == 0) is None
    for r in inclusion.window_inclusion_candidates(spread.drop("delta"), spread, [1, 2]).collect():
        assert r.p == pytest.approx(square(cells, r.voxel_id, r.radius, False))


@pytest.mark.parametrize("tile", [2, 3, 256])
def test_windows_on_a_lattice_with_holes(spark, lattice, tile, monkeypatch):
    """Places without a cell are absent, wherever the tiles are cut."""
    monkeypatch.setattr(inclusion, "TILE", tile)
    holed = lattice.where("voxel_id not in (6, 7, 12, 19)")
    cells = {r.voxel_id: r for r in holed.collect()}
    radius = spark.createDataFrame([(1, 1), (2, 3)], "partition_id int, radius int")
    sizes = {1: 1, 2: 3}
    plain = inclusion.window_inclusion(holed.drop("delta"), holed, radius, [1, 3]).collect()
    masked = inclusion.window_inclusion_masked(holed.drop("delta"), holed, radius, [1, 3]).collect()
    assert len(plain) == len(masked) == len(cells)
    for r in plain:
        assert r.p == pytest.approx(square(cells, r.voxel_id, sizes[cells[r.voxel_id].partition_id], False))
    for r in masked:
        want = square(cells, r.voxel_id, sizes[cells[r.voxel_id].partition_id], True)
        assert r.p is None if want is None else r.p == pytest.approx(want)


def test_a_task_holds_a_tile_not_a_row(spark, monkeypatch):
    monkeypatch.setattr(inclusion, "TILE", 8)
    row = spark.range(500).selectExpr("cast(id as int) as voxel_id", "0 as row", "cast(id as int) as col", "1 as partition_id", "cast(id % 3 = 0 as int) as delta")
    tiles = inclusion._tiles(row, 1, [], {"all": F.lit(True)})
    # A tile of 8 and its rim of 1 on both sides; the row above and below reach into no other cell.
    assert tiles.groupBy("__tile").count().agg(F.max("count")).first()[0] <= 10
    assert tiles.where("__cell is not null").count() == 500
    squares = inclusion._with_window_means(row, [1], [], {"all": F.lit(True)})
    assert squares.where("all_1 is null").count() == 0 and squares.count() == 500


def test_radius_zero_and_unlisted_radius(spark, lattice):
    zero = spark.createDataFrame([(1, 0), (2, 1)], "partition_id int, radius int")
    got = inclusion.window_inclusion_masked(lattice.drop("delta"), lattice, zero, [0, 1], 0.1, 0.9)
    values = {r.voxel_id: r.p for r in got.collect()}
    assert values[2] == pytest.approx(0.5)
    with pytest.raises(Exception, match="radius not among"):
        inclusion.window_inclusion(lattice.drop("delta"), lattice, zero.replace(0, 3), [1]).collect()


def test_clamp_moves_only_certain_values(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 0.3), (3, None)], "voxel_id int, p double")
    assert [r.p for r in inclusion.clamp_inclusion(df).orderBy("voxel_id").collect()] == [0.05, 0.95, 0.3, None]


def test_neighbors_leave_isolated_voxels_null(spark):
    coords = spark.createDataFrame([(0, 0, 0, 0), (1, 1, 0, 0), (2, 1, 1, 0), (3, 9, 9, 9)], "voxel_id int, x int, y int, z int")
    edges = graphs.voxel_neighbors6(coords)
    assert {tuple(r) for r in edges.collect()} == {(0, 1), (1, 0), (1, 2), (2, 1)}
    delta = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 1)], "voxel_id int, delta int")
    got = {r.voxel_id: r.p for r in inclusion.neighbor_inclusion(edges, delta).collect()}
    assert got == {0: 0.0, 1: 0.5, 2: 0.0, 3: None}


def test_channel_time_graph_against_pairs(spark):
    nodes = [(t * 3 + c, c, t) for t in (0, 1, 2, 5) for c in range(3)]
    dist = {(a, b): abs(a - b) * 1.5 for a in range(3) for b in range(3)}
    got = graphs.channel_time_graph(
        spark.createDataFrame(nodes, "node int, channel int, timepoint int"),
        spark.createDataFrame([(a, b, d) for (a, b), d in dist.items()], "src int, dst int, dist double"), 1, 2.0)
    want = {(a[0], b[0]) for a in nodes for b in nodes if a[0] != b[0] and abs(a[2] - b[2]) <= 1 and dist[(a[1], b[1])] <= 2}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_parcels(spark):
    labels = [0, 0, 7, 7, 3, 3, 3, 9]
    voxels = spark.createDataFrame([(i, i, 0, 0) for i in range(8)], "voxel_id int, x int, y int, z int")
    table = spark.createDataFrame(list(enumerate(labels)), "voxel_id int, parcel_id int")
    lists = {r.parcel_id: r.neighbors for r in parcels.parcel_adjacency(voxels, table).collect()}
    assert lists == {0: [], 7: [3], 3: [7, 9], 9: [3]}
    new = {r.parcel_id: r.new_id for r in parcels.remap_labels(table).collect()}
    assert new == {0: 0, 3: 1, 7: 2, 9: 3}
    images = spark.createDataFrame([(1, i, None if i == 2 else float(i)) for i in range(8)], "subject_id long, voxel_id int, value double")
    means = {r.parcel_id: r.value for r in parcels.parcel_means(images, table).collect()}
    assert means == {0: 0.5, 7: 3.0, 3: 5.0, 9: 7.0}
    back = parcels.broadcast_parcel_means(parcels.parcel_means(images, table), table)
    assert {r.voxel_id: r.value for r in back.collect()} == {i: means[l] for i, l in enumerate(labels)}
    assert parcels.shape_mismatch(images, table).count() == 0
    with pytest.raises(Exception, match="shapes differ"):
        parcels.parcel_means(images, table.where("voxel_id < 5")).collect()
    with pytest.raises(Exception, match="shapes differ"):
        parcels.parcel_means(images.where("voxel_id < 5"), table).collect()


def test_shape_mismatch_counts_rows_and_deals_ids_by_their_number(spark, monkeypatch):
    images = spark.createDataFrame([(s, v, 0.5) for s in (1, 2) for v in (None, 1, 2, 3, 3)], "subject_id long, voxel_id int, value double")
    table = spark.createDataFrame([(v, 1) for v in (None, None, 2, 2, 7, 7, 7)], "voxel_id int, parcel_id int")
    want = [(None, "images")] * 2 + [(None, "parcels"), (1, "parcels"), (3, "parcels")] + [(7, "images")] * 3
    for seen in (images, images.select("voxel_id", "value")):
        got = parcels.shape_mismatch(seen, table)
        assert got.columns == ["voxel_id", "missing_in"] and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    # No task gets much more than its share of the ids, however few bytes they take.
    monkeypatch.setattr(parcels, "IDS_PER_TASK", 100, raising=False)
    many = spark.range(2000).withColumnRenamed("id", "voxel_id")
    apart = parcels.shape_mismatch(many, many.select(F.col("voxel_id") + 2000, F.lit(1).alias("parcel_id")).toDF("voxel_id", "parcel_id"))
    shares = apart.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in shares) == 4000 and max(r["count"] for r in shares) < 500


@pytest.mark.parametrize("dim", range(7, 29))
@pytest.mark.parametrize("n_part", [1, 2, 3, 4])
def test_grid_blocks_follow_overwriting_intervals(dim, n_part):
    last = dim - dim // n_part
    steps = [1 + i * (last - 1) / (n_part - 1) for i in range(n_part)] if n_part > 1 else [1]
    cuts = [int(s + 1e-9) for s in steps] + [dim]
    block = {}
    for i in range(n_part):
        for r in range(cuts[i], cuts[i + 1] + 1):
            block[r] = i + 1
    starts = screening.block_starts(dim, n_part)
    assert [sum(r >= s for s in starts) for r in range(1, dim + 1)] == [block[r] for r in range(1, dim + 1)]


def test_screening_of_constant_images(spark):
    images = spark.createDataFrame([(i, v, 0.0 if v == 0 else float(i - 1)) for i in range(3) for v in range(2)],
                                   "subject_id long, voxel_id int, value double")
    assert {r.voxel_id: r.excluded for r in screening.excluded_voxels(images, "all_zero").collect()} == {0: True, 1: False}
    assert {r.voxel_id: r.excluded for r in screening.excluded_voxels(images).collect()} == {0: True, 1: True}
    train, _ = screening.scale_global_maxabs(images.where("voxel_id = 0"), images)
    assert all(r.value is None for r in train.collect())


def test_voxel_join_broadcasts_only_what_is_proven_to_fit(spark, monkeypatch):
    rows = spark.range(1000).withColumnRenamed("id", "voxel_id")
    voxels = spark.range(1000).select(F.col("id").alias("voxel_id"), F.lit(1.0).alias("p"))
    monkeypatch.setattr(joins, "planner_threshold", lambda df: 0)

    def plan(limit):
        monkeypatch.setattr(joins, "BROADCAST_BYTES", limit)
        joined = joins.voxel_join(rows, voxels, ["voxel_id"], row_bytes=10)
        assert joined.count() == 1000
        return "ResolvedHint" in joined._jdf.queryExecution().analyzed().toString()

    assert plan(10_000) and not plan(9_990)


def test_window_means_of_far_cells_and_wide_squares():
    """Cells strewn over a plane far too large for a box, squares wider than a tile."""
    import numpy as np

    rng = np.random.default_rng(1)
    place = np.unique(np.concatenate([
        rng.integers(0, 900, (400, 2)), rng.integers(0, 40, (200, 2)) + [5_000_000_000, 3], rng.integers(0, 9, (30, 2)) - [2_000_000, 7_000_000_000],
    ]), axis=0)
    delta, kept = rng.integers(0, 2, len(place)).astype(float), rng.random(len(place)) < 0.8
    for radius in (0, 1, 30, 300, 700):
        got = inclusion.window_means(place, delta, kept, radius)
        for i in range(0, len(place), 7):
            near = (np.abs(place - place[i]) <= radius).all(axis=1) & kept
            assert (np.isnan(got[i]) and not near.any()) or got[i] == pytest.approx(delta[near].mean())
