import random

import pytest
from pyspark.sql import functions as F

from voxelfield.operators import ingest, initial, posterior
from voxelfield.sources import datasets, files


def test_listing_reads_names_only(spark, tmp_path):
    for name in ("NYU_0050001_falff.nii.gz", "ucla_1_0050002_falff.nii.gz", "NYU_0050003_reho.nii.gz", "x_12_falff.nii.gz"):
        (tmp_path / name).write_bytes(b"x")
    rows = {r.filename: (r.site_id, r.sub_id) for r in files.list_image_files(spark, str(tmp_path)).collect()}
    assert rows == {
        "NYU_0050001_falff.nii.gz": ("NYU", "0050001"), "ucla_1_0050002_falff.nii.gz": ("UCLA_1", "0050002"),
        "x_12_falff.nii.gz": ("X_12", None),
    }


def test_phenotype_and_distances_from_csv(spark, tmp_path):
    (tmp_path / "pheno.csv").write_text("SITE_ID,SUB_ID\nnyu,50001\nucla_1,123456789\n")
    rows = files.read_phenotype(spark, str(tmp_path / "pheno.csv"), "SITE_ID STRING, SUB_ID LONG").collect()
    assert [(r.site_id, r.sub_id) for r in rows] == [("NYU", "0050001"), ("UCLA_1", "123456789")]
    (tmp_path / "dist.csv").write_text("row_no,A,B\n1,0,2.5\n2,2.5,0\n")
    edges = files.read_distance_csv(spark, str(tmp_path / "dist.csv"), ["A", "B"]).collect()
    assert {tuple(r) for r in edges} == {("A", "A", 0.0), ("A", "B", 2.5), ("B", "A", 2.5), ("B", "B", 0.0)}


def test_dataset_keys_prune_directories(spark, tmp_path):
    path = str(tmp_path / "sets")
    for chain in (1, 2):
        datasets.save_dataset(spark.range(chain), path, {"dataset": "d", "chain": chain})
    loaded = datasets.load_dataset(spark, path, chain=2)
    assert loaded.count() == 2
    assert "PartitionFilters: [isnotnull(chain" in loaded._jdf.queryExecution().executedPlan().toString()


def test_image_round_trip_and_empty_cells(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "id long, image array<double>")
    long = ingest.image_to_long(df, "id", "image", (2, 3))
    assert {(r.voxel_name, r.row, r.col) for r in long.collect()} >= {("Vox_1", 0, 0), ("Vox_2", 1, 0), ("Vox_6", 1, 2)}
    assert ingest.long_to_image(long.repartition(3)).first().image == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    events = spark.createDataFrame([(1, 0, 4.0), (1, 0, 6.0), (2, 9, 1.0)], "id long, at int, v double")
    grid = ingest.events_to_lattice(events, "id", F.col("at"), F.lit(0), F.col("v"), 3, 1)
    assert {(r.subject_id, r.voxel_id): r.value for r in grid.collect()} == {
        (1, 0): 5.0, (1, 1): 0.0, (1, 2): 0.0, (2, 0): 0.0, (2, 1): 0.0, (2, 2): 0.0}


def test_lasso_finds_the_informative_voxel(spark):
    rows = [(i, v, float((i * (v + 3)) % 11 - 5)) for i in range(200) for v in range(4)]
    images = spark.createDataFrame(rows, "subject_id long, voxel_id int, value double")
    labels = images.where("voxel_id = 2").select("subject_id", (F.col("value") > 0).cast("int").alias("y"))
    state = {r.voxel_id: r for r in initial.lasso_init(images, labels, 3, (0.2, 0.05)).collect()}
    assert state[2].delta == 1 and state[2].coef > 0 and abs(state[2].coef) > max(abs(state[v].coef) for v in (0, 1, 3))


def test_lasso_places_the_cells_of_ragged_images(spark):
    """Voxels missing from half of the subjects do not shift the others; the path comes from the data."""
    draw = random.Random(4)
    rows = [(i, v, draw.gauss(0, 1)) for i in range(300) for v in range(8)]
    images = spark.createDataFrame(rows, "subject_id long, voxel_id int, value double")
    signal = images.where("voxel_id in (3, 6)").groupBy("subject_id").agg(F.sum("value").alias("s"))
    labels = signal.select("subject_id", (F.col("s") > 0).cast("int").alias("y"))
    ragged = images.where("not (voxel_id = 0 and subject_id % 2 = 0) and not (voxel_id = 7 and subject_id % 2 = 1) and subject_id <> 5")
    state = {r.voxel_id: r for r in initial.lasso_init(ragged, labels, 3, path_length=6).collect()}
    size = {v: abs(r.coef) for v, r in state.items()}
    assert set(state) == set(range(8)) and min(size[3], size[6]) > 3 * max(size[v] for v in (0, 1, 2, 4, 5, 7))
    path = initial.penalty_path(ragged, labels, 6, 0.01)
    assert path == sorted(path, reverse=True) and len(path) == 6 and path[-1] == pytest.approx(path[0] * 0.01)
    none = initial.lasso_init(ragged, labels, 3, lambdas=[path[0] * 1.01])
    assert none.where("delta = 1").count() == 0


def test_distance_csv_with_row_names(spark, tmp_path):
    names = ["C3", "Cz"]
    (tmp_path / "named.csv").write_text("x,C3,Cz\nCz,1.5,0\nC3,0,1.5\n")
    (tmp_path / "numbered.csv").write_text("x,C3,Cz\n1,0,1.5\n2,1.5,0\n")
    want = {("C3", "C3", 0.0), ("C3", "Cz", 1.5), ("Cz", "C3", 1.5), ("Cz", "Cz", 0.0)}
    for file in ("named.csv", "numbered.csv"):
        assert {tuple(r) for r in files.read_distance_csv(spark, str(tmp_path / file), names).collect()} == want
    (tmp_path / "wrong.csv").write_text("x,C3,Cz\nPz,0,1.5\n")
    with pytest.raises(Exception, match="unknown row name"):
        files.read_distance_csv(spark, str(tmp_path / "wrong.csv"), names).collect()


def test_chain_choice_breaks_ties_by_id(spark):
    dics = spark.createDataFrame([(1, 2, 5.0), (1, 1, 5.0), (1, 0, 7.0), (2, 0, 1.0)], "replicate int, chain_id int, dic double")
    assert {tuple(r) for r in posterior.select_chain_dic(dics).collect()} == {(1, 1, 5.0), (2, 0, 1.0)}
    draws = spark.range(41).select(F.col("id").cast("int").alias("iter"))
    kept = posterior.retain_draws(draws, 20, 4)
    assert [(r.iter, r.slot) for r in kept.orderBy("iter").collect()] == [(24, 1), (28, 2), (32, 3), (36, 4), (40, 5)]


def test_an_aborted_write_leaves_the_old_version(spark, tmp_path):
    """Nothing is visible before a write's entry; writers of other keys go on; appended parts add up."""
    path = str(tmp_path / "sets")
    keys = {"dataset": "digits", "replicate": 1, "chain": 1}
    rows = lambda n: spark.range(n).select(F.col("id").alias("subject_id"))
    with pytest.raises(ValueError):
        datasets.load_dataset(spark, path, chain=1)
    datasets.save_dataset(rows(5), path, keys, "overwrite")
    broken = rows(100).repartition(4).withColumn("subject_id", F.when(F.col("subject_id") == 77, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("subject_id")))
    with pytest.raises(Exception, match="lost"):
        datasets.save_dataset(broken, path, keys, "overwrite")
    assert datasets.load_dataset(spark, path, dataset="digits", chain=1).count() == 5
    datasets.save_dataset(rows(7), path, {**keys, "chain": 2})
    datasets.save_dataset(rows(2), path, {**keys, "chain": 2})
    assert datasets.load_dataset(spark, path, chain=2).count() == 9
    datasets.save_dataset(rows(3), path, keys, "overwrite")
    assert datasets.load_dataset(spark, path, chain=1).count() == 3
    found = datasets.load_dataset(spark, path, dataset="digits")
    assert found.count() == 12 and {(r.replicate, r.chain) for r in found.select("replicate", "chain").collect()} == {(1, 1), (1, 2)}
    assert datasets.drop_unfinished(spark, path) == []
    dropped = datasets.drop_unfinished(spark, path, older_than_s=-1)
    assert len(dropped) == 2 and datasets.load_dataset(spark, path, dataset="digits").count() == 12
