"""Readers and writers on small generated files."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual

from probestats.operators import align
from probestats.sources import binary, sinks, tables


@pytest.mark.parametrize("sep, ending", [(",", "csv"), ("\t", "tsv"), (";", "txt"), ("|", "CSV")])
def test_read_matrix(spark, tmp_path, sep, ending):
    lines = [["s1", "CpG", "s2"], ["0.1", " cg2", "NA"], ["0.2", "cg1", "0.5"], ["0.9", "cg2 ", "0.9"], ["", "cg7", "nan"]]
    path = tmp_path / f"set.{ending}"
    path.write_text("\n".join(sep.join(x) for x in lines) + "\n")
    wide, samples = tables.read_matrix(spark, str(path), cohort="cases", dataset="set")
    assert samples.first()["sample_ids"] == ["s1", "s2"]
    got = {r.cpg_id: r["values"] for r in wide.collect()}
    assert got == {"cg2": [0.1, None], "cg1": [0.2, 0.5], "cg7": [None, None]}

    features = spark.createDataFrame([(0, "cg0"), (1, "cg1"), (2, "cg2")], "feature_pos int, cpg_id string")
    long = align.align_to_manifest(wide, samples, features)
    rows = {(r.sample_id, r.feature_pos): r.beta for r in long.collect()}
    assert rows == {("s1", 0): None, ("s2", 0): None, ("s1", 1): 0.2, ("s2", 1): 0.5, ("s1", 2): 0.1, ("s2", 2): None}
    assert long.select("cohort", "dataset").distinct().collect() == [("cases", "set")]
    ends = align.value_range(long).first()
    assert (ends.min_value, ends.max_value) == (0, 0.5)
    export = sinks.export_betas(long)
    assert export.where("beta = 0").count() == 3 and export.schema["beta"].dataType.simpleString() == "float"


def test_two_datasets_share_the_manifest(spark, tmp_path):
    parts = []
    for cohort, name, line in (("cases", "a", "cg1,1,2"), ("controls", "b", "cg2,3,4")):
        (tmp_path / f"{name}.csv").write_text(f"CpG,x,y\n{line}\n")
        parts.append(tables.read_matrix(spark, str(tmp_path / f"{name}.csv"), cohort=cohort, dataset=name))
    wide = parts[0][0].unionByName(parts[1][0])
    samples = parts[0][1].unionByName(parts[1][1])
    features = spark.createDataFrame([(0, "cg1"), (1, "cg2")], "feature_pos int, cpg_id string")
    out = align.align_to_manifest(wide, samples, features)
    assert out.count() == 8 and out.where("beta is not null").count() == 4


def test_quoted_fields_and_short_lines(spark, tmp_path):
    (tmp_path / "q.csv").write_text('"CpG","a","b","c"\r\n"cg1","0.5",1,\r\n\r\ncg2,0.25\r\n')
    wide, samples = tables.read_matrix(spark, str(tmp_path / "q.csv"), cohort="cases", dataset="q")
    assert samples.first()["sample_ids"] == ["a", "b", "c"]
    features = spark.createDataFrame([(0, "cg1"), (1, "cg2")], "feature_pos int, cpg_id string")
    rows = {(r.sample_id, r.feature_pos): r.beta for r in align.align_to_manifest(wide, samples, features).collect()}
    assert rows == {("a", 0): 0.5, ("b", 0): 1.0, ("c", 0): None, ("a", 1): 0.25, ("b", 1): None, ("c", 1): None}


def test_matrix_without_id_column(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,s1\n1,2\n")
    with pytest.raises(ValueError):
        tables.read_matrix(spark, str(tmp_path / "x.csv"), cohort="cases", dataset="x")


def test_find_by_stem(spark, tmp_path):
    for name in ("b/one.csv", "a/one.TSV", "a-b/one.txt", "a/one.npy", "a/two.csv.bak", "c/three.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    got = {r.stem: r.path.split(tmp_path.name)[1] for r in tables.find_by_stem(spark, str(tmp_path), ["one", "two", "three"]).collect()}
    assert got == {"one": "/a/one.TSV", "three": "/c/three.txt"}


def test_manifest_keeps_line_order_across_splits(spark, tmp_path):
    rng = np.random.default_rng(3)
    ids = [f"cg{i:07d}" for i in rng.permutation(60_000)]
    lines = ids + [ids[5] + " ", ids[0]]
    (tmp_path / "anno.csv").write_text("CpG,gene\n" + "\n".join(f"{c},g" for c in lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        out = tables.read_manifest(spark, str(tmp_path / "anno.csv"))
        assert out.rdd.getNumPartitions() >= 1
        got = [r.cpg_id for r in out.orderBy("feature_pos").select("cpg_id").collect()]
        positions = out.agg(F.min("feature_pos"), F.max("feature_pos"), F.countDistinct("feature_pos")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == ids and tuple(positions) == (0, len(ids) - 1, len(ids))


def test_gene_sets(spark, tmp_path):
    (tmp_path / "lib.gmt").write_text("Pancreatic cancer\t\tKRAS\ttp53\t\nOther\turl\tA\n")
    rows = tables.read_gene_sets(spark, str(tmp_path / "lib.gmt")).collect()
    assert sorted((r.term, r.gene) for r in rows) == [("Other", "A"), ("Pancreatic cancer", "KRAS"), ("Pancreatic cancer", "tp53")]
    order = {r.term: r.term_order for r in rows}
    assert order["Pancreatic cancer"] < order["Other"]


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("orientation", ["samples_first", "features_first"])
def test_binary_matrices(spark, tmp_path, order, orientation):
    data = np.arange(35, dtype=np.float16).reshape(5, 7) / 4
    data[2, 3], data[1, 1] = -1, np.nan
    stored = data if orientation == "samples_first" else data.T
    (tmp_path / "deep").mkdir()
    np.save(tmp_path / "deep" / "setA.npy", np.asarray(stored, order=order))
    out = binary.read_matrices(spark, str(tmp_path), cohort="cases", orientation=orientation, chunk_bytes=30)
    rows = {(int(r.sample_id), r.feature_pos): r.sq_err for r in out.collect()}
    assert len(rows) == 35 and out.select("dataset").distinct().first()[0] == "setA"
    for (i, j), v in rows.items():
        want = float(data[i, j])
        assert v is None if (np.isnan(want) or want == -1) else v == want


class CountingReader(binary.NpyReader):
    """Counts the bytes that are read behind the header."""

    def _open(self, path):
        file, counts = super()._open(path), self.__dict__.setdefault("read_bytes", [])

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                file.close()

            def read(self, n):
                return file.read(n)

            def read_at(self, n, start):
                counts.append(n)
                return file.read_at(n, start)

        return File()


def _read(root, filters, **options):
    columns = options.pop("columns", ["sample_id", "feature_pos", "sq_err"])
    reader = CountingReader({"path": str(root), "cohort": "cases", "chunkbytes": "4000", **options}, columns)
    assert not list(reader.pushFilters(filters))
    found = [row for part in reader.partitions() for batch in reader.read(part) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    return found, sum(reader.__dict__.get("read_bytes", []))


@pytest.mark.parametrize("order", ["C", "F"])
def test_binary_reads_only_wanted_rows(tmp_path, order):
    """200 samples of 300 half-precision values in two files."""
    data = np.arange(60_000, dtype=np.float16).reshape(200, 300) % 1000
    for name in ("a", "b"):
        np.save(tmp_path / f"{name}.npy", np.asarray(data, order=order))
    total = 2 * data.nbytes
    assert _read(tmp_path, [])[1] == total
    rows, read = _read(tmp_path, [EqualTo(("dataset",), "b"), In(("sample_id",), ("7", "8", "150", "x", "007", "400"))])
    assert {(int(s), f): v for s, f, v in rows} == {(s, f): float(data[s, f]) for s in (7, 8, 150) for f in range(300)} and len(rows) == 900
    assert read == 3 * 600 if order == "C" else read <= data.nbytes
    rows, read = _read(tmp_path, [GreaterThanOrEqual(("feature_pos",), 40), LessThan(("feature_pos",), 50), EqualTo(("dataset",), "a"), IsNotNull(("sample_id",))])
    assert sorted((int(s), f) for s, f, _ in rows) == [(s, f) for s in range(200) for f in range(40, 50)]
    assert read == 200 * 10 * 2
    rows, read = _read(tmp_path, [GreaterThan(("feature_pos",), 297), LessThanOrEqual(("feature_pos",), 299), In(("feature_pos",), (3, 298, 500))])
    assert len(rows) == 400 and {f for _, f, _ in rows} == {298} and read == 2 * 200 * 2
    for nothing in ([EqualTo(("cohort",), "controls")], [EqualTo(("dataset",), "c")], [EqualTo(("sample_id",), "-1")], [LessThan(("feature_pos",), 0)]):
        assert _read(tmp_path, nothing) == ([], 0)
    rows, read = _read(tmp_path, [], columns=["sample_id"])
    assert len(rows) == 120_000 and read == 0


def test_binary_filters_reach_the_source(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(12.0).reshape(3, 4))
    out = binary.read_matrices(spark, str(tmp_path), cohort="cases").where("sample_id = '1' and feature_pos >= 2 and sq_err > 6")
    assert [(r.sample_id, r.feature_pos, r.sq_err) for r in out.collect()] == [("1", 3, 7.0)]
    text = out._jdf.queryExecution().executedPlan().toString()
    left = re.findall(r"Filter \((.*)\)\n", text)
    assert len(left) == 1 and "sq_err" in left[0] and "feature_pos" not in left[0] and "sample_id" not in left[0]
    assert binary.read_matrices(spark, str(tmp_path), cohort="cases", columns=("sample_id", "feature_pos")).columns == ["sample_id", "feature_pos"]
    with pytest.raises(Exception, match="unknown columns"):
        binary.read_matrices(spark, str(tmp_path), cohort="cases", columns=("x",)).count()


@pytest.mark.parametrize("version", [(1, 0), (2, 0), (3, 0)])
def test_binary_headers_of_any_version_and_length(spark, tmp_path, version):
    """Headers padded to far more than a page; the third version holds text outside of Latin-1."""
    data, pad = np.arange(6, dtype=">f4").reshape(2, 3), 9_000
    note = "日本" if version == (3, 0) else ""
    head = (str({"descr": ">f4", "fortran_order": False, "shape": (2, 3), "note": note}) + " " * pad + "\n").encode("utf-8")
    size = len(head).to_bytes(2 if version == (1, 0) else 4, "little")
    (tmp_path / "x.npy").write_bytes(b"\x93NUMPY" + bytes(version) + size + head + data.tobytes())
    rows = binary.read_matrices(spark, str(tmp_path), cohort="cases").collect()
    assert {(int(r.sample_id), r.feature_pos): r.sq_err for r in rows} == {(i, j): float(data[i, j]) for i in range(2) for j in range(3)}


def test_binary_rejects_other_files(spark, tmp_path):
    (tmp_path / "x.npy").write_bytes(b"no matrix at all")
    with pytest.raises(Exception, match="not a matrix file"):
        binary.read_matrices(spark, str(tmp_path), cohort="cases").count()
    np.save(tmp_path / "x.npy", np.array([["a", "b"]]))
    with pytest.raises(Exception, match="holds no numbers"):
        binary.read_matrices(spark, str(tmp_path), cohort="cases").count()


def test_binary_must_be_a_matrix(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(3.0))
    with pytest.raises(Exception, match="2-D"):
        binary.read_matrices(spark, str(tmp_path), cohort="cases").count()


def test_matrix_sink_replaces_only_its_datasets_and_prunes(spark, tmp_path):
    path = str(tmp_path / "betas")
    schema = "cohort string, dataset string, sample_id string, feature_pos int, beta double"
    sinks.write_matrix(spark.createDataFrame([("cases", "a", "s", 0, 1.0), ("controls", "b", "s", 0, 2.0)], schema), path)
    sinks.write_matrix(spark.createDataFrame([("cases", "a", "s", 0, 5.0)], schema), path)
    back = spark.read.parquet(path)
    assert sorted(r.beta for r in back.collect()) == [2.0, 5.0]
    chosen = tables.select_datasets(back, ["a"], ["x"])
    assert [r.beta for r in chosen.collect()] == [5.0]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan
    with pytest.raises(ValueError):
        tables.select_datasets(back, [], ["x"])


def test_result_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "m", 0.5)], "k int, model string, auc double")
    sinks.write_table(rows, str(tmp_path / "t"))
    sinks.write_table(rows, str(tmp_path / "c"), export=True)
    sinks.append_run(rows, str(tmp_path / "runs"), mode="betas", k=1)
    sinks.append_run(rows.withColumn("k", F.lit(2)), str(tmp_path / "runs"), mode="betas", k=2)
    sinks.append_run(rows.withColumn("k", F.lit(2)), str(tmp_path / "runs"), mode="betas", k=2)
    sinks.write_lines(rows, "model", str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["k", "model", "auc"]
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "runs")).collect()) == [1, 2]
    assert spark.read.text(str(tmp_path / "l")).first()[0] == "m"


def test_optional_table(spark, tmp_path):
    empty = tables.read_optional(spark, str(tmp_path / "none"), "k int, auc double")
    assert empty.columns == ["k", "auc"] and empty.count() == 0
    spark.range(3).select(F.col("id").cast("int").alias("k"), F.lit(0.5).alias("auc")).write.parquet(str(tmp_path / "some"))
    assert tables.read_optional(spark, str(tmp_path / "some"), "k int, auc double").count() == 3
