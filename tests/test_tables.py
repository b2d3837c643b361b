import pytest
from pyspark.sql import functions as F

from fieldweave.operators import aggregates as A, hotspots as H, joins as J, schema as SC, transforms as T
from fieldweave.operators.association import find_marker
from fieldweave.sources import files as SF, genome as SG, vectors as SV


def test_provenance_is_required(spark):
    with pytest.raises(ValueError, match="fit-split provenance"):
        SC.assert_provenance(spark.createDataFrame([("a", 1.0)], "image_path string, IC0 double"))
    good = spark.createDataFrame([("genotype", 0.1, "fit", 3, "fit_rows_only", 1.0)], "fit_split_column string, fit_test_frac double, fit_split_role string, n_fit_rows int, ica_sign_source string, IC0 double")
    SC.assert_provenance(good)
    with pytest.raises(ValueError):
        SC.assert_provenance(good.unionByName(good.withColumn("fit_split_column", F.lit("other"))))


def test_traits_and_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, IC1 double, IC0 double")
    assert SC.named_traits(df, ["IC0", "IC1", "IC0"]) == ["IC0", "IC1"]
    with pytest.raises(ValueError):
        SC.named_traits(df, ["IC9"])
    with pytest.raises(ValueError):
        SC.matching_columns(df, "^PC")
    assert SC.split_columns(df, r"^IC\d+$") == (["id"], ["IC1", "IC0"])


def test_image_mean(spark):
    crops = spark.createDataFrame([("d/img1_0.png", [1.0]), ("d/img1_1.png", [3.0])], "image_path string, features array<double>")
    r = A.image_means(J.keyed(crops, "image_path"), "image_key").first()
    assert r["features"] == [2.0] and r["n_crops"] == 2 and r["image_path"] == "d/img1_0.png"


def test_conflicting_values(spark):
    df = spark.createDataFrame([("G1", 1.0), ("G1", 2.0), ("G2", 3.0), ("G2", 3.0)], "genotype string, trait double")
    with pytest.raises(ValueError, match="conflicting"):
        J.require_unique(J.collapse_unique(df, ["genotype"], "trait"))
    assert J.require_unique(J.collapse_unique(df.where("genotype = 'G2'"), ["genotype"], "trait")).first()["trait"] == 3.0


def test_intervals_across_bins(spark):
    pts = spark.createDataFrame([(1, 5), (1, 999_999), (1, 2_500_000), (2, 10)], "chrom int, pos long")
    iv = spark.createDataFrame([("a", 1, 0, 2_500_000), ("b", 1, 6, 10), ("c", 2, 10, 10)], "peak string, chrom int, start long, end long")
    got = {(r["peak"], r["pos"]) for r in J.in_intervals(pts, iv).collect()}
    assert got == {("a", 5), ("a", 999_999), ("a", 2_500_000), ("c", 10)}


def test_merge_windows_gap_rule(spark):
    w = spark.createDataFrame([(1, 0, 12), (1, 2, 11), (1, 5, 30), (1, 6, 3), (2, 5, 10)], "chrom int, window long, n_traits long")
    w = w.withColumn("window_start", F.col("window") * 100_000)
    got = sorted((r["chrom"], r["start"], r["end"], r["max_traits"]) for r in H.merge_windows(w, 100_000).collect())
    # 2 -> 5: start 500000 lies 200001 beyond the end 299999, so a new peak begins
    assert got == [(1, 0, 299_999, 12), (1, 500_000, 599_999, 30), (2, 500_000, 599_999, 10)]


def test_sliding_windows_brute_force(spark):
    hits = [(1, p, t) for p, t in [(0, "a"), (99_999, "a"), (100_000, "b"), (119_999, "c"), (150_000, "b")]]
    got = H.sliding_windows(spark.createDataFrame(hits, "chrom int, pos long, trait string"), spark.createDataFrame([(1, 170_000)], "chrom int, max_bp long")).collect()
    assert len(got) == 9
    for r in got:
        want = len({t for _, p, t in hits if r["window_start"] <= p <= r["window_end"]})
        assert r["n_traits"] == want and r["window_end"] == min(r["window"] * 20_000 + 99_999, 170_000)


def test_label_runs(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate("aabbbac", 1)], "i int, l string")
    assert [(r["l"], r["start"], r["end"], r["mid"]) for r in H.label_runs(df, "i", "l").orderBy("start").collect()] == [
        ("a", 1, 2, 1.5), ("b", 3, 5, 4.0), ("a", 6, 6, 6.0), ("c", 7, 7, 7.0)]


def test_coverage_gate(spark):
    df = spark.createDataFrame([("e", False, False, True, False), ("e", False, False, False, True), ("f", True, False, False, False)],
                               "environment string, excluded boolean, ungenotyped boolean, embedded boolean, explained_failure boolean")
    A.require_covered(df)
    tot = A.coverage_audit(df, "environment").where("environment = 'TOTAL'").first()
    assert (tot["metadata_total"], tot["excluded"], tot["expected"], tot["embedded"], tot["missing_failed"]) == (3, 1, 2, 1, 1)
    with pytest.raises(ValueError):
        A.require_covered(df.withColumn("explained_failure", F.lit(False)))


def test_zscore_without_variance(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 3.0)], "g string, v double")
    got = sorted((r["g"], r["z"]) for r in T.zscore(df, ["g"], "v", "z").collect() if r["g"] == "b")
    assert got == [("b", -1.0), ("b", 1.0)]
    assert all(r["z"] is None for r in T.zscore(df.where("g = 'a'"), ["g"], "v", "z").collect())


def test_group_splits(spark):
    df = spark.createDataFrame([(f"g{i % 7}", i) for i in range(70)] + [(None, 99)], "g string, i int")
    held = T.held_out_groups(df, "g", 0.3, 1)
    assert len(held) == 2 and held == T.held_out_groups(df.repartition(5), "g", 0.3, 1)
    flags = T.with_fit_flag(df, "g", 0.3, 1)
    assert {r["g"] for r in flags.where("NOT is_fit").collect()} == set(held)
    assert flags.where("g IS NULL").first()["is_fit"]
    folds = T.group_kfold(df, "g", 3).groupBy("g").agg(F.count_distinct("fold").alias("n")).collect()
    assert all(r["n"] == 1 for r in folds)
    h = T.hashed_folds(df.where("g IS NOT NULL"), "g", 3, 2)
    assert h.count() == 140 and h.groupBy("repeat", "g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_marker_lookup(spark):
    m = spark.createDataFrame([("m1", "1", 5, "A", "T"), ("m2", "1", 9, "A", "T"), ("m3", "1", 9, "A", "G")], "marker string, chrom string, pos long, ref string, alt string")
    assert find_marker(m, "m2").first()["pos"] == 9
    assert find_marker(m, "1:5").first()["marker"] == "m1"
    assert find_marker(m, "1:9:A:G").first()["marker"] == "m3"
    for bad in ("1:9", "zzz", "2:1"):
        with pytest.raises(ValueError):
            find_marker(m, bad)


# ---------------------------------------------------------------- sources and sinks
def test_vector_round_trip_and_backup(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, float("nan"))], "image_path string, embedding_mean_0 double, embedding_mean_1 double")
    v = SV.assemble_features(df, r"^embedding_mean_\d+$")
    path = str(tmp_path / "v")
    assert SV.write_vectors(v, path) is None
    back = SV.read_vectors(spark, path)
    assert {r["image_path"]: r["features"] for r in back.collect()} == {"a": [1.0, 2.0], "b": [3.0, None]}
    backup = SV.write_vectors(back.where("image_path = 'a'"), path)  # rewritten from itself
    assert spark.read.parquet(path).count() == 1 and spark.read.parquet(backup).count() == 2


def test_merge_refuses_overlap_and_other_features(spark):
    a = spark.createDataFrame([("x", 1.0)], "image_path string, IC0 double")
    b = spark.createDataFrame([("y", "extra", 2.0)], "image_path string, note string, IC0 double")
    assert SV.merge_vector_tables(a, b, "image_path").count() == 2
    with pytest.raises(ValueError, match="share"):
        SV.merge_vector_tables(a, a, "image_path")
    with pytest.raises(ValueError, match="missing"):
        SV.merge_vector_tables(a, b.drop("IC0"), "image_path")
    with pytest.raises(ValueError, match="feature"):
        SV.merge_vector_tables(a, b.withColumn("IC1", F.lit(1.0)), "image_path")


def test_lists_and_inventory(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b_Photo.png", "sub/a_Photo.jpg", "notes.md"):
        (tmp_path / name).write_text("x")
    inv = SF.file_inventory(spark, str(tmp_path))
    assert [r["image_key"] for r in inv.orderBy("path").collect()] == ["b_Photo", "a_Photo"]
    (tmp_path / "ex.csv").write_text("environment,image_id\nE,img1_3.png\nE,\nE,img2.jpg\n")
    assert {r[0] for r in SF.read_exclusions(spark, str(tmp_path / "ex.csv")).collect()} == {"img1", "img2"}
    (tmp_path / "ex.txt").write_text("img9_leaf.png\n\n img8 \n")
    assert {r[0] for r in SF.read_exclusions(spark, str(tmp_path / "ex.txt")).collect()} == {"img9", "img8"}


def test_observations_file(spark, tmp_path):
    f = tmp_path / "o.tsv"
    f.write_text("canonical_name\tenv_id\tgenotype\tvalue\nh\tE1\tPI 1\t2.5\nh\tE1\tPI2\tbad\nh\t\tPI3\t1\n")
    assert [tuple(r) for r in SF.read_observations(spark, str(f)).collect()] == [("h", "E1", "PI1", 2.5)]


def test_genotype_file(spark, tmp_path):
    f = tmp_path / "c.vcf"
    f.write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n"
                 "1\t10\t.\tA\tT\t.\t.\t.\tGT\t0/0\t1|1\n2\t20\trs2\tC\tG\t.\t.\t.\tGT:DP\t1/0:7\t./.:0\n")
    got = {(r["marker"], r["sample"]): r["dosage"] for r in SG.read_calls(spark, str(f)).collect()}
    assert got == {("1:10:A:T", "S1"): 0, ("1:10:A:T", "S2"): 2, ("rs2", "S1"): 1, ("rs2", "S2"): None}
    assert SG.read_calls(spark, str(f), ("2", 1, 30)).count() == 2


def test_result_tables_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t", 5, 0.1)], "trait string, pos long, p_value double")
    SF.save_table(df, str(tmp_path / "r"), SF.REGION_COLUMNS)
    assert dict(SF.load_table(spark, str(tmp_path / "r"), SF.REGION_COLUMNS).dtypes)["p_value"] == "float"
    with pytest.raises(ValueError):
        SF.save_table(df.drop("pos"), str(tmp_path / "r2"), SF.REGION_COLUMNS)
    SF.save_results(spark, str(tmp_path / "out"), {"summary": df}, {"seed": 1})
    assert spark.read.option("header", True).csv(str(tmp_path / "out/summary")).count() == 1
    assert '"seed": 1' in spark.read.text(str(tmp_path / "out/run_metadata")).first()[0]


def test_image_inputs_of_every_kind(spark, tmp_path):
    for name in ("a_1.png", "b.JPG", "c.txt", "sub/d.tiff"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(b"x")
    (tmp_path / "list.csv").write_text("image_path,other\na_1.png,1\n a_1.png ,2\n/abs/e.png,3\nnotes.txt,4\n,5\n")
    names = lambda source: sorted(r["path"].replace("file:", "").replace(str(tmp_path), "") for r in SF.image_inputs(spark, str(source)).collect())
    assert names(tmp_path) == ["/a_1.png", "/b.JPG", "/sub/d.tiff"]
    assert names(tmp_path / "a_1.png") == ["/a_1.png"] and names(tmp_path / "*.png") == ["/a_1.png"]
    assert names(tmp_path / "list.csv") == ["/a_1.png", "/abs/e.png"]
    with pytest.raises(ValueError, match="lacks column"):
        SF.image_inputs(spark, str(tmp_path / "list.csv"), "missing")


def test_saved_results_tell_of_the_run_and_drop_stale_ones(spark, tmp_path):
    import json

    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    out = tmp_path / "out"
    first = SF.save_results(spark, str(out), {"summary": df, "hits": df.where("v = 2")}, {"seed": 1})
    assert (out / "hits").exists() and first["results"]["summary"]["rows"] == 2 and first["results"]["hits"]["seconds"] >= 0
    again = SF.save_results(spark, str(out), {"summary": df.orderBy("v"), "hits": df.where("v > 2"), "top": None}, {"seed": 2})
    assert not (out / "hits").exists() and list(again["results"]) == ["summary"]
    assert again["results"]["summary"]["digest"] == first["results"]["summary"]["digest"] != first["results"]["hits"]["digest"]
    line = json.loads(spark.read.text(str(out / "run_metadata")).first()[0])
    assert line["params"] == {"seed": 2} and line["results"] == again["results"] and line["spark_version"] == spark.version
