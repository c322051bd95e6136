"""Trees of dataset files: numbers of rows and datasets, names, and operators fed with them."""

import random

import pytest

from lacuna.operators import features, prepare, simulate, validate
from lacuna.sources import io, panels


def write(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\t".join(f"x{k}" for k in range(5)) + "\n" + "".join("\t".join(map(str, r)) + "\n" for r in rows))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """Six files, two of one name, and a folder of parts."""
    root, rng = tmp_path_factory.mktemp("files"), random.Random(2)
    for k, (mechanism, name, n) in enumerate([("MCAR", "MCAR_a_boot001.txt", 40), ("MCAR", "plain.txt", 30), ("MAR", "MAR_b_boot002.txt", 3000), ("MNAR", "plain.txt", 25), ("MNAR", "c.txt", 50), ("other", "d.txt", 20)]):
        write(root / mechanism, name, [(("NaN" if rng.random() < 0.2 else k), i, rng.random(), "", rng.gauss(0, 1)) for i in range(1, n + 1)])
    for part in (1, 0):
        write(root / "mechanism=MAR" / "dataset_id=in%20parts", f"part-0000{part}-x.csv", [(1.5, 100 * part + i, 0, 0, 0) for i in range(1, 101)])
    return str(root)


@pytest.mark.parametrize("most", ["128m", "4k"])
def test_rows_keep_the_order_of_their_file(spark, tree, most):
    spark.conf.set("spark.sql.files.maxPartitionBytes", most)  # 4k: a file of many splits
    try:
        rows = io.read_datasets(spark, tree).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r["row_id"] == r["x1"] for r in rows) and all(r["x3"] is None or r["dataset_id"] == "in parts" for r in rows)
    sets = {(r["dataset_id"], r["dataset_no"], r["mechanism"], r["label"], r["source_group"]) for r in rows}
    assert {s[0] for s in sets} == {"MCAR_a_boot001", "MCAR/plain", "MAR_b_boot002", "MNAR/plain", "c", "d", "in parts"}
    assert sorted(s[1] for s in sets) == list(range(1, 8))
    assert {(s[0], s[3]) for s in sets} >= {("d", None), ("c", 2), ("in parts", 1), ("MCAR/plain", 0)}
    assert {s[4] for s in sets} == {"MCAR_a", "plain", "MAR_b", "c", "d", "in parts"}
    assert len({(r["dataset_id"], r["row_id"]) for r in rows}) == len(rows) == 40 + 30 + 3000 + 25 + 50 + 20 + 200


def test_files_feed_every_operator(spark, tree):
    panel = panels.checked(io.read_datasets(spark, tree))
    boots = prepare.bootstrap_datasets(panel, resamples=3, size=20, least_rate=0.0)
    assert boots.count() == 7 * 3 * 20
    masked = simulate.simulate(panel.withColumn("x0", panel["x1"]), "mcar_block", 0.1, 1)
    gone = {r[0]: r[1] for r in masked.where("x0 is null").groupBy("dataset_id").count().collect()}
    assert len(gone) == 7 and gone["MAR_b_boot002"] > 30
    assert features.mask_entropy(panel).count() == 7
    assert prepare.hotdeck_impute(panel, "x4").count() == panel.count() and prepare.cap_missing_rate(panel).count() == panel.count()
    assert {r["dataset_id"] for r in features.extract_features(panel.where("label is not null")).collect()} >= {"MAR_b_boot002", "c"}
    report = {r["dataset_id"]: r for r in validate.validate_datasets(panel, permutations=9).collect()}
    assert len(report) == 7 and report["in parts"]["missing_rate"] == 0.0


def test_written_panels_come_back(spark, tree, tmp_path):
    panel = io.read_datasets(spark, tree)
    io.write_datasets(panel, str(tmp_path / "again"))
    again = io.read_datasets(spark, str(tmp_path / "again"))
    plain = lambda df: sorted((r["mechanism"], r["dataset_id"].split("/")[-1], r["row_id"], r["x0"], r["x2"], r["x4"]) for r in df.fillna(-9.0).collect())
    assert plain(again) == plain(panel)


@pytest.mark.parametrize("rows", [[(1, 2), (1, 3)], [(1, 1), (1, 1), (1, 4)], [(1, 1), (2, 2)], [(1, 1), (1, None)], [(None, 1)]])
def test_odd_row_numbers_are_refused(spark, rows):
    panel = spark.createDataFrame([("a", no, row, 1.0) for no, row in rows], "dataset_id string, dataset_no long, row_id long, x0 double")
    with pytest.raises(ValueError):
        panels.checked(panel)
