"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from probestats.operators import evaluate, fdr, folds, ordered, rank, score, twosample
from probestats.plans import catalog, tables as t
from probestats.sources.tables import select_datasets

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def windows_over_all(text: str) -> list[str]:
    """Orders of the windows that have no key."""
    specs = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", text)
    return [x for x in specs if re.match(r"(\S+ (ASC|DESC)|$)", x.strip())]


def test_tests_and_ranks_never_sort_all_rows_in_one_task(spark, monkeypatch):
    """Windows without a key run over the ranges of a first cut, which are at most RANGES; smaller tables than HOT_ROWS aside."""
    texts, write = [], ordered.stage
    monkeypatch.setattr(ordered, "stage", lambda df, name: texts.append(plan(df)) or write(df, name))
    rows = t.two_groups(spark, SF).withColumn("p", F.col("score") / 1e6)
    for out in (
        fdr.bh_fdr(rows, "p", hot_rows=100),
        evaluate.roc_auc(rows.withColumn("label", (F.col("cohort") == "cases").cast("int")), hot_rows=100),
        ordered.row_ranks(rows, [], "score", hot_rows=100),
        ordered.exact_quantiles(rows, [], "score", {"m": 0.5}, sketch=200),
    ):
        texts.append(plan(out))
        found = [x for text in texts for x in windows_over_all(text)]
        assert any("Window [" in text for text in texts)
        assert all(x.startswith(("_top#", "j#")) or not x.strip() for x in found), found
        texts.clear()
    assert ordered.RANGES <= 4096
    text = plan(folds.capped_sample(t.table(spark, SF, "lineitem").select("l_orderkey"), 10, ["l_orderkey"]))
    assert all(x.startswith("_cell#") or not x.strip() for x in windows_over_all(text))


def test_scan_reads_only_what_is_needed(spark):
    text = plan(twosample.ks_statistic(t.two_groups(spark, SF)))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all("l_orderkey" not in s and "l_tax" not in s for s in schemas)


def test_levels_are_shuffled_once(spark):
    """Where no key is hot: values summed up by (key, value), then a window by key; one scan, nothing joined."""
    text = plan(twosample.ks_statistic(t.two_groups(spark, SF)))
    assert text.count("Exchange hashpartitioning") == 2 and text.count("FileScan") == 1 and "Join" not in text


def test_dataset_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "m")
    t.matrix(spark, SF).write.partitionBy("cohort", "dataset").parquet(path)
    text = plan(select_datasets(spark.read.parquet(path), ["ds_0"], ["ds_5"]))
    assert re.search(r"PartitionFilters: \[\(+cohort", text) and "PushedFilters: []" in text


def test_top_features_are_cut_before_the_shuffle(spark):
    rows = t.matrix(spark, SF).withColumn("fold", (F.col("sample_id") % 5 + 1).cast("int"))
    text = plan(rank.rank_features(rank.fold_moments(rows, value="value"), top=20))
    assert "WindowGroupLimit" in text


def test_baseline_is_broadcast(spark):
    rows = t.errors(spark, SF)
    out = score.rec_score(rows, score.control_baseline(rows))
    out.collect()
    assert "BroadcastHashJoin" in plan(out)


@pytest.mark.parametrize("name", ["median_normalize", "ks_stat", "auc_rank", "density_hist", "anova_f"])
def test_row_order_does_not_matter(spark, name, monkeypatch):
    query = catalog.all_queries()[name]
    before = sorted(map(tuple, query(spark, SF).collect()))
    table = t.table
    monkeypatch.setattr(t, "table", lambda s, d, n: table(s, d, n).repartition(5))
    assert sorted(map(tuple, query(spark, SF).collect())) == before
