"""The registered queries: every operator on the given tables, with rounded floats for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from probestats.functions.keys import block_of, case_label, dataset_stem, split_genes
from probestats.functions.missing import fill_missing, is_missing, sentinel_to_null
from probestats.functions.tails import neg_log10
from probestats.operators import (
    align,
    describe,
    enrich,
    errors,
    evaluate,
    fdr,
    folds,
    performance,
    rank,
    score,
    twosample,
)
from probestats.operators.stage import stage
from probestats.plans import study, tables as t
from probestats.sources import sinks
from probestats.sources.lines import gene_set, matrix_fields
from probestats.sources.tables import select_datasets, shared_features

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def r(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name), digits).alias(name)


def long(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


# --- alignment and duplicates ---------------------------------------------------------------------


@query
def dedup_first(spark, d):
    rows = t.table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
    return align.keep_first(rows, ["l_partkey"], order).drop("l_shipdate")


@query
def dup_resolve_mean(spark, d):
    rows = align.resolve_duplicates(t.table(spark, d, "lineitem"), ["l_partkey"], "l_quantity", "mean")
    return rows.select("l_partkey", r("l_quantity"))


@query
def dup_resolve_median(spark, d):
    rows = align.resolve_duplicates(t.table(spark, d, "lineitem"), ["l_partkey"], "l_extendedprice", "median")
    return rows.select("l_partkey", r("l_extendedprice"))


def _manifest(spark, d):
    part = t.table(spark, d, "part").where(F.col("p_type") != "SMALL")
    ids = part.select(F.concat(F.lit(" "), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit(" ")).alias("cpg_id"), "p_partkey")
    return align.number_features(ids, F.col("p_partkey"))


@query
def manifest_positions(spark, d):
    """Distinct trimmed names in order of their first row."""
    names = t.table(spark, d, "part").select(F.concat("p_name", F.lit(" ")).alias("cpg_id"), "p_partkey")
    return align.number_features(names, F.col("p_partkey")).select("cpg_id", "feature_pos", "p_partkey")


@query
def align_to_manifest(spark, d):
    """Prices by part (feature) and line number (sample), per return flag and line status."""
    cohort = F.when(F.col("l_returnflag") == "A", "cases").otherwise("controls")
    rows = t.table(spark, d, "lineitem").select(
        cohort.alias("cohort"), F.col("l_linestatus").alias("dataset"), "l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_orderkey", "l_suppkey"
    )
    first = align.keep_first(rows, ["cohort", "dataset", "l_partkey", "l_linenumber"], ["l_shipdate", "l_orderkey", "l_suppkey", "l_extendedprice"])
    numbers = [row[0] for row in rows.select("l_linenumber").distinct().orderBy("l_linenumber").collect()]
    wide = (
        first.groupBy("cohort", "dataset", "l_partkey").pivot("l_linenumber", numbers).agg(F.first("l_extendedprice"))
        .select(
            "cohort", "dataset", F.lpad(F.col("l_partkey").cast("string"), 8, "0").alias("cpg_id"),
            F.array(*[F.col(str(n)) for n in numbers]).alias("values"),
        )
    )
    samples = rows.select("cohort", "dataset").distinct().withColumn("sample_ids", F.array(*[F.lit(f"s{n}") for n in numbers]))
    return align.align_to_manifest(wide, samples, _manifest(spark, d))


@query
def matrix_lines(spark, d):
    """Lines as of a delimited file, some fields quoted with the separator in them, some lines short."""
    text = F.concat_ws(
        ",", F.concat(F.lit('"'), F.col("p_name"), F.lit(', ""'), F.col("p_brand"), F.lit('"""')), F.concat(F.lit(" "), F.col("p_size"), F.lit(" ")),
        F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit('"'), F.col("p_type"), F.lit('"'))),
    )
    cells = t.table(spark, d, "part").select("p_partkey", matrix_fields(text, ",", ["name", "size", "type"]).alias("cells"))
    return cells.select("p_partkey", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("name", "size", "type"))])


@query
def gene_set_lines(spark, d):
    """Lines of term, description and genes, with empty names among them."""
    genes = t.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), "\t \t").alias("genes"))
    nation = t.table(spark, d, "nation").join(genes, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    term, names = gene_set(F.concat_ws("\t", "n_name", F.lit("about"), "genes"))
    return nation.select(term.alias("term"), names.alias("genes")).select("term", F.explode("genes").alias("gene"))


@query
def export_betas(spark, d):
    rows = t.clean_errors(spark, d).withColumnRenamed("sq_err", "beta")
    return sinks.export_betas(rows).select("sample_id", "feature_pos", F.round(F.col("beta").cast("double"), 6).alias("beta"))


@query
def value_range(spark, d):
    return align.value_range(t.clean_errors(spark, d), "sq_err").select(r("min_value"), r("max_value"))


@query
def dataset_select(spark, d):
    rows = select_datasets(t.matrix(spark, d), ["ds_0", "ds_3"], ["ds_5", "ds_8"])
    return rows.groupBy("cohort", "dataset").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sample_id").alias("n_samples"))


@query
def stem_normalize(spark, d):
    """File-like names made from source and language, back to plain dataset names."""
    ending = F.when(F.col("n_chars") % 3 == 0, "_scores").when(F.col("n_chars") % 3 == 1, "_mse_per_sample_per_position").otherwise("")
    names = t.table(spark, d, "documents").select(F.concat_ws("", F.concat_ws("-", "source", "lang"), ending).alias("name"))
    return names.select(dataset_stem(F.col("name")).alias("dataset")).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query
def shared_features_by_cohort(spark, d):
    rows = t.two_groups(spark, d).withColumn("feature_pos", F.floor(F.col("score")))
    return shared_features(rows).groupBy("feature_pos").agg(F.count(F.lit(1)).alias("n"))


# --- missing values, scores ------------------------------------------------------------------------


@query
def sentinel_mask_fill(spark, d):
    value = F.col("sq_err")
    return t.errors(spark, d).select(
        "sample_id", "feature_pos", is_missing(value).alias("missing"), F.round(fill_missing(value), 6).alias("filled"),
        F.round(sentinel_to_null(value), 6).alias("no_sentinel"),
    )


@query
def block_mean(spark, d):
    return score.block_mean(t.errors(spark, d), group_size=3).select("sample_id", "feature_pos", r("sq_err"))


@query
def median_normalize(spark, d):
    rows = score.median_normalize(score.block_mean(t.errors(spark, d)))
    return rows.select("sample_id", "feature_pos", r("sq_err"))


@query
def control_baseline(spark, d):
    rows = stage(score.median_normalize(score.block_mean(t.errors(spark, d))), "normalized")
    base = score.control_baseline(rows.where(F.col("cohort") == "controls"))
    return base.select("feature_pos", r("ctrl_mean"), r("ctrl_std"))


@query
def rec_score(spark, d):
    return study.scores(t.errors(spark, d)).select("cohort", "sample_id", "feature_pos", r("score"))


@query
def rec_score_blocks(spark, d):
    rows = study.scores(t.errors(spark, d), group_size=10)
    return rows.select("cohort", "sample_id", "feature_pos", r("score"))


# --- reconstruction errors -------------------------------------------------------------------------


@query
def sq_error(spark, d):
    betas = t.matrix(spark, d).select("cohort", "dataset", "sample_id", "feature_pos", F.col("value").alias("beta"))
    betas = betas.withColumn("beta", F.when((F.col("sample_id") + F.col("feature_pos")) % 11 != 0, F.col("beta")))
    predictions = betas.withColumn("prediction", F.coalesce("beta", F.lit(0.0)) * 0.9 + 0.01)
    return errors.squared_error(betas, predictions).select("sample_id", "feature_pos", r("sq_err", 9))


@query
def error_metrics(spark, d):
    rows = errors.error_metrics(t.clean_errors(spark, d))
    numbers = ["missing_pct", "mse_global", "mae_global", "rmse_global", "median_ae", "p95_ae"]
    return rows.select("cohort", "dataset", *[r(c) for c in numbers])


@query
def segment_summary_pivot(spark, d):
    rows = errors.error_summary(t.clean_errors(spark, d), width=16)
    return rows.select("cohort", "dataset", *[r(c) for c in rows.columns[2:]])


@query
def missing_pct(spark, d):
    return errors.missing_share(t.errors(spark, d), "sq_err").select("cohort", "dataset", "n_missing", "n_total", r("missing_pct"))


@query
def matrix_checks(spark, d):
    """Samples that lost features to a filter on the value, and the segments that have no model."""
    rows = t.matrix(spark, d).where(F.abs("value") > 0.02)
    models = rows.select((F.col("feature_pos") / 16).cast("int").alias("segment_id")).distinct().where(F.col("segment_id") < 3)
    return errors.check_matrix(rows, models, n_features=64, width=16)


def _weights(rows, width):
    """A network per segment of the rows' features, its numbers given by rule."""
    sizes = [(1, width, 6), (2, 6, 3), (3, 3, 6), (4, 6, width)]
    segments = rows.select(block_of(F.col("feature_pos"), width).alias("segment_id")).distinct()
    layers = F.array(*[F.struct(F.lit(a).alias("layer"), F.lit(b).alias("n_in"), F.lit(c).alias("n_out")) for a, b, c in sizes])
    rows = segments.withColumn("_l", F.explode(layers)).select("segment_id", "_l.*")

    def outputs(fn):
        return F.transform(F.sequence(F.lit(0), F.col("n_out") - 1), fn)

    cell = F.transform(
        F.sequence(F.lit(0), F.col("n_out") * F.col("n_in") - 1),
        lambda at: (
            (F.col("segment_id") * 31 + F.col("layer") * 17 + F.floor(at / F.col("n_in")).cast("int") * 7 + (at % F.col("n_in")) * 13) % 19 - 9
        ) / F.lit(20.0),
    )
    hidden = F.col("layer") < 4
    return rows.select(
        "segment_id",
        "layer",
        F.when(hidden, "relu").otherwise("sigmoid").alias("activation"),
        cell.alias("weight"),
        outputs(lambda o: ((F.col("segment_id") * 5 + F.col("layer") * 3 + o * 11) % 7 - 3) / F.lit(10.0)).alias("bias"),
        F.when(hidden, outputs(lambda o: F.lit(1.0) + o % 3 / F.lit(10.0))).alias("bn_gamma"),
        F.when(hidden, outputs(lambda o: o % 2 / F.lit(10.0))).alias("bn_beta"),
        F.when(hidden, outputs(lambda o: o % 5 / F.lit(20.0))).alias("bn_mean"),
        F.when(hidden, outputs(lambda o: F.lit(1.0) + o % 4 / F.lit(4.0))).alias("bn_var"),
        F.lit(1e-5).alias("bn_eps"),
    )


@query
def autoencoder_error(spark, d):
    betas = t.matrix(spark, d).select(
        "cohort", "dataset", "sample_id", "feature_pos",
        F.when((F.col("sample_id") * 7 + F.col("feature_pos")) % 13 > 1, F.col("value")).alias("beta"),
    )
    return study.evaluate_matrix(betas, _weights(betas, 16), width=16).select("sample_id", "feature_pos", r("sq_err"))


@query
def autoencoder_wide(spark, d):
    """Networks of full width: segments of 10,000 features, one for each order number, most of them absent in a sample."""
    rows = t.wide_matrix(spark, d)
    found = study.evaluate_matrix(rows, _weights(rows, errors.SEGMENT_WIDTH)).where(F.col("sq_err").isNotNull())
    return found.select("cohort", "dataset", "sample_id", "feature_pos", r("sq_err"))


# --- two-sample tests ------------------------------------------------------------------------------


@query
def ks_stat(spark, d):
    rows = twosample.ks_statistic(t.two_groups(spark, d))
    return rows.select("feature_pos", "n_case", "n_ctrl", long("gap"), r("d"))


@query
def ks_pvalue_asymp(spark, d):
    rows = twosample.ks_pvalue(twosample.ks_statistic(t.two_groups(spark, d)), method="limit")
    return rows.select("feature_pos", r("d"), r("p_ks"))


@query
def ks_pvalue_exact(spark, d):
    rows = twosample.ks_pvalue(twosample.ks_statistic(t.matrix(spark, d), value="value"), method="exact")
    return rows.select("feature_pos", "n_case", "n_ctrl", long("gap"), r("p_ks"))


@query
def ks_pvalue_finite(spark, d):
    """Prices of returned and other lines per line number: few tests on many values."""
    cohort = F.when(F.col("l_returnflag") == "A", "cases").otherwise("controls")
    rows = t.table(spark, d, "lineitem")
    stats = twosample.ks_statistic(rows.withColumn("cohort", cohort), ["l_linenumber"], "l_extendedprice")
    return twosample.ks_pvalue(stats, method="finite").select("l_linenumber", "n_case", "n_ctrl", r("d"), r("p_ks"))


def _order_tests(spark, d):
    p = F.when(F.col("o_orderpriority").startswith("1"), F.lit(None)).otherwise(F.floor("o_totalprice") % 5000 / F.lit(5000.0))
    return t.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", p.alias("p"))


@query
def bh_fdr(spark, d):
    return fdr.bh_fdr(_order_tests(spark, d), "p", name="q").select("o_orderkey", r("p"), r("q"))


@query
def bh_fdr_grouped(spark, d):
    return fdr.bh_fdr(_order_tests(spark, d), "p", by=["o_orderstatus"], name="q").select("o_orderkey", r("p"), r("q"))


@query
def bh_fdr_null_group(spark, d):
    """Tests of one status have no group: they are a group of their own."""
    rows = _order_tests(spark, d).withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("O")))
    return fdr.bh_fdr(rows, "p", by=["o_orderstatus"], name="q").select("o_orderkey", "o_orderstatus", r("p"), r("q"))


@query
def ks_table(spark, d):
    rows = study.feature_tests(t.two_groups(spark, d))
    return rows.select("feature_pos", "n_case", "n_ctrl", r("d"), r("p_ks"), r("fdr_bh"))


@query
def ks_table_betas(spark, d):
    """Tests on raw values, where missing ones count as zeros."""
    value = F.when((F.col("sample_id") * 7 + F.col("feature_pos")) % 13 == 2, F.lit(0.0)).otherwise(F.col("value"))
    rows = study.feature_tests(t.matrix(spark, d).withColumn("value", value), value="value")
    return rows.select("feature_pos", "n_case", "n_ctrl", r("d"), r("p_ks"), r("fdr_bh"))


@query
def top_tests(spark, d):
    tests = twosample.ks_pvalue(twosample.ks_statistic(t.two_groups(spark, d)))
    return fdr.top_tests(tests.withColumn("p_ks", F.round("p_ks", 9)), 15).select("feature_pos", r("p_ks"))


@query
def score_tests(spark, d):
    """Which features differ between cases and controls: scores, tests, q-values.

    Scores are rounded first, so that two engines see the same ties.
    """
    rows = stage(study.scores(t.errors(spark, d)).withColumn("score", F.round("score", 9)), "scores")
    tests = study.feature_tests(rows)
    return tests.select("feature_pos", "n_case", "n_ctrl", r("d"), r("p_ks"), r("fdr_bh"))


# --- distributions ---------------------------------------------------------------------------------


@query
def feature_medians(spark, d):
    return describe.feature_medians(t.two_groups(spark, d)).select("feature_pos", r("median_cases"), r("median_controls"))


@query
def density_hist(spark, d):
    rows = t.matrix(spark, d).withColumn("value", F.col("value") * 8 + 1)
    out = describe.density_histogram(rows, "value", clip=1e-12)
    return out.select("cohort", long("bin"), r("center"), "n", r("density"))


@query
def error_hist(spark, d):
    out = describe.range_histogram(t.two_groups(spark, d), "score", by=["cohort"])
    return out.select("cohort", long("bin"), r("left_edge"), "n")


@query
def box_stats(spark, d):
    out = describe.box_stats(t.two_groups(spark, d), "score", ["cohort", "feature_pos"])
    return out.select("cohort", "feature_pos", "n", *[r(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")])


@query
def top_feature_boxes(spark, d):
    rows = t.two_groups(spark, d)
    tests = twosample.ks_pvalue(twosample.ks_statistic(rows)).withColumn("p_ks", F.round("p_ks", 9))
    out = describe.top_feature_boxes(rows, stage(tests, "ks"))
    return out.select("cohort", "feature_pos", "n", *[r(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")])


@query
def capped_sample(spark, d):
    rows = t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return folds.capped_sample(rows, 12_000, rows.columns)


# --- folds, ranking, evaluation --------------------------------------------------------------------


def _samples(spark, d):
    return t.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.when(F.col("label") < 5, 1).otherwise(0).alias("label")
    )


def _folded(spark, d):
    return t.matrix(spark, d).join(folds.assign_folds(_samples(spark, d)).select("sample_id", "fold"), "sample_id")


@query
def fold_assign(spark, d):
    return folds.assign_folds(_samples(spark, d)).select("sample_id", long("label"), long("fold"))


@query
def anova_f(spark, d):
    moments = rank.fold_moments(_folded(spark, d), value="value")
    return moments.select(long("fold"), "feature_pos", F.round(rank.anova_f(), 6).alias("f_stat"))


@query
def ratio_filter(spark, d):
    moments = rank.fold_moments(_folded(spark, d).withColumn("value", F.col("value") + 1.0), value="value")
    return moments.where(rank.passes_ratio(0.01)).select(long("fold"), "feature_pos", r("mean0"), r("mean1"))


@query
def fold_top20(spark, d):
    ranked = rank.rank_features(rank.fold_moments(_folded(spark, d), value="value"), top=20)
    return rank.stability_table(ranked).select(long("fold"), long("rank"), "feature_name", "feature_index")


@query
def fold_top20_nan(spark, d):
    """As fold_top20, with scores that are not numbers in every ninth feature."""
    value = F.when((F.col("feature_pos") % 9 == 0) & (F.col("sample_id") % 50 == 0), F.lit(float("nan"))).otherwise(F.col("value"))
    rows = _folded(spark, d).withColumn("value", value)
    return rank.stability_table(rank.rank_features(rank.fold_moments(rows, value="value"), top=64), 64).select(long("fold"), long("rank"), "feature_name", "feature_index")


@query
def fold_vectors(spark, d):
    """Values of each fold's twelve best features, best first, one row per place."""
    folded = _folded(spark, d)
    ranked = rank.rank_features(rank.fold_moments(folded, value="value"), top=12)
    vectors = evaluate.fold_vectors(folded, ranked, max_k=12, value="value")
    long_form = vectors.select("model_fold", "sample_id", "label", "held_out", F.posexplode("values").alias("at", "value"))
    return long_form.select(long("model_fold"), "sample_id", long("label"), "held_out", (F.col("at") + 1).cast("bigint").alias("rank"), r("value"))


@query
def folds_repeated_ids(spark, d):
    """Folds of samples that are numbered from 0 in each dataset."""
    rows = t.table(spark, d, "embeddings").select(
        F.when(F.col("label") < 5, "cases").otherwise("controls").alias("cohort"), F.concat(F.lit("ds_"), F.col("label")).alias("dataset"),
        F.expr("vec_id div 10").alias("sample_id"), F.when(F.col("label") < 5, 1).otherwise(0).alias("label"),
    ).distinct()
    return folds.assign_folds(rows, key=["cohort", "dataset", "sample_id"]).select("cohort", "dataset", "sample_id", long("label"), long("fold"))


@query
def blocks_with_gaps(spark, d):
    """Values by segment and place, with features absent by rule, back in long form."""
    rows = t.matrix(spark, d).select("cohort", "dataset", "sample_id", "feature_pos", F.col("value").alias("beta"))
    blocks = errors.to_blocks(rows.where((F.col("sample_id") * 5 + F.col("feature_pos")) % 7 != 0), width=10)
    return errors.to_long(blocks, width=10).where(F.col("beta").isNotNull()).select("cohort", "dataset", "sample_id", "feature_pos", r("beta"))


@query
def auc_rank(spark, d):
    rows = t.table(spark, d, "labels").join(t.table(spark, d, "documents"), "doc_id")
    out = evaluate.roc_auc(rows, ["lang"], score="n_chars", label="quality")
    return out.select("lang", "n_pos", "n_neg", r("auc"))


@query
def auc_global(spark, d):
    rows = t.two_groups(spark, d).withColumn("label", case_label(F.col("cohort")))
    return evaluate.roc_auc(rows).select("n_pos", "n_neg", r("auc"))


@query
def mean_auc_wide(spark, d):
    out = evaluate.mean_auc(t.performance(spark, d))
    return out.select("k", *[r(m) for m in out.columns[1:]])


@query
def bootstrap_ci(spark, d):
    out = folds.bootstrap_ci(t.performance(spark, d))
    return out.select("k", "model", r("mean_auc_boot", 10), r("ci95_low", 10), r("ci95_high", 10))


#: The feature count of the registered sweep; the default of ``study.classification`` is every one from 1 to 500.
SWEEP_GRID = (8,)


@query
def k_sweep(spark, d):
    """The four classifiers at their full size, five folds, on the vectors; of the feature counts only these."""
    aucs, _ = study.classification(t.matrix(spark, d), value="value", grid=SWEEP_GRID)
    return aucs.select("fold", "model", "k", r("auc"))


# --- performance tables ----------------------------------------------------------------------------


def _main(spark, d):
    return performance.mean_main([t.performance(spark, d).select("k", "model", F.col("auc").alias("auc_main"))])


def _boot(spark, d):
    """Interval columns for some models only."""
    auc = F.col("auc")
    rows = t.performance(spark, d).where(F.col("model") != "PROMO")
    return performance.mean_bootstrap([
        rows.select("k", "model", (auc * 0.98).alias("mean_auc_boot"), (auc * 0.9).alias("ci95_low"), F.least(auc * 1.05, F.lit(1.0)).alias("ci95_high"))
    ])


def _perf(spark, d):
    return performance.combine(_main(spark, d), _boot(spark, d))


@query
def melt_mean(spark, d):
    """Two wide result tables, melted and averaged together."""
    wide = t.performance(spark, d).groupBy("k", (F.col("fold") % 2).alias("part")).pivot("model").agg(F.avg("auc"))
    parts = [performance.melt_models(wide.where(F.col("part") == p).drop("part")) for p in (0, 1)]
    return performance.mean_main(parts).select("k", "model", r("auc_main"))


@query
def perf_join(spark, d):
    numbers = ["auc_main", "mean_auc_boot", "ci95_low", "ci95_high", "auc_plot"]
    return _perf(spark, d).select("k", "model", *[r(c) for c in numbers])


@query
def perf_without_bootstrap(spark, d):
    out = performance.combine(_main(spark, d))
    return out.select("k", "model", r("auc_main"), "mean_auc_boot", r("auc_plot"))


@query
def auc_series(spark, d):
    return performance.auc_series(_perf(spark, d)).select("model", "k", r("auc_plot"), r("band_low"), r("band_high"))


@query
def heatmap_pivot(spark, d):
    out = performance.heatmap(_perf(spark, d))
    return out.select("k", *[r(m) for m in out.columns[1:]])


@query
def model_boxes(spark, d):
    out = performance.model_boxes(_perf(spark, d))
    return out.select("model", "n", *[r(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")])


@query
def best_mean_model(spark, d):
    rows = _perf(spark, d).withColumn("auc_plot", F.round("auc_plot", 9))
    return performance.best_and_mean(rows).select("model", r("best_auc"), r("mean_auc"), "best_k")


@query
def best_mean_table(spark, d):
    return performance.best_mean_table(_perf(spark, d))


@query
def top20_model_k(spark, d):
    rows = _perf(spark, d).withColumn("auc_plot", F.round("auc_plot", 9))
    return performance.top_model_k(rows).select("model", "k", r("auc_plot"), r("ci95_low"), r("ci95_high"))


# --- annotation and enrichment ---------------------------------------------------------------------


def _annotated(spark, d):
    return stage(enrich.annotate_features(t.part_tests(spark, d), t.annotation(spark, d), "probe"), "annotated")


@query
def split_gene_lists(spark, d):
    text = F.when(F.col("p_size") % 7 == 0, F.lit(None)).otherwise(
        F.concat(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, "; ").otherwise(","), F.col("p_brand"), F.lit(";.;; "), F.col("p_type"), F.lit(" ,"))
    )
    return t.table(spark, d, "part").select("p_partkey", F.array_join(split_genes(text), "|").alias("genes"))


@query
def key_discovery(spark, d):
    annotation = t.annotation(spark, d).select("CpG", "probe", "size_key", "brand")
    return enrich.key_overlaps(t.part_tests(spark, d), annotation).select("column_name", "match", "overlap", long("column_order"))


@query
def annotate_features(spark, d):
    rows = enrich.annotate_features(t.part_tests(spark, d), t.annotation(spark, d), "probe")
    return rows.select("CpG", "feature", r("p_ks"), F.array_join("genes", ";").alias("genes"))


@query
def term_universe(spark, d):
    annotated = _annotated(spark, d)
    return enrich.terms_in_universe(t.gene_sets(spark, d), enrich.distinct_genes(annotated)).select("term", "k_term")


def _ora(spark, d):
    annotated = _annotated(spark, d)
    return annotated, enrich.over_representation(annotated, enrich.select_top(annotated), t.gene_sets(spark, d))


@query
def ora(spark, d):
    rows = _ora(spark, d)[1]
    return rows.select("term", "m_univ", "k_term", "n_sel", "x_overlap", r("expected"), r("p"))


@query
def term_filter(spark, d):
    rows = enrich.focus_terms(_ora(spark, d)[1], "nation_1[0-4]")
    return rows.select("term", "k_term", "x_overlap", r("p"))


@query
def focus_overlap_genes(spark, d):
    annotated, rows = _ora(spark, d)
    return enrich.focus_overlap(rows, "nation_1", enrich.select_top(annotated), t.gene_sets(spark, d))


@query
def top_terms(spark, d):
    rows = _ora(spark, d)[1].withColumn("p", F.round("p", 9))
    return enrich.top_terms(rows).select("term", r("p"), r("neg_log10_p"))


@query
def term_incidence(spark, d):
    return enrich.term_incidence(_annotated(spark, d), t.gene_sets(spark, d))


@query
def perm_enrichment(spark, d):
    rows = enrich.permutation_enrichment(_annotated(spark, d), t.gene_sets(spark, d))
    numbers = ["mean_perm", "sd_perm", "p_emp", "fdr_emp"]
    return rows.select("term", "k_cpg", "x_obs", *[r(c) for c in numbers])


@query
def run_summary(spark, d):
    """Heads of the report's tables, one under the other; of both modes where there are two."""
    sources = {"scores": (t.two_groups(spark, d), "score"), "betas": (t.matrix(spark, d), "value")}
    tests = {mode: twosample.ks_pvalue(twosample.ks_statistic(rows, value=value)).withColumn("p_ks", F.round("p_ks", 9)) for mode, (rows, value) in sources.items()}
    perf = {"scores": _perf(spark, d), "betas": performance.combine(_main(spark, d))}
    perf = {mode: rows.withColumn("auc_plot", F.round("auc_plot", 9)) for mode, rows in perf.items()}
    ora_rows = _ora(spark, d)[1].withColumn("p", F.round("p", 9))
    parts = study.run_summary({"term": "nation_1", "top_n": 100}, perf, tests, ora_rows)
    number = {"performance": ("auc_plot", F.concat_ws("/", "model", "k")), "tests": ("p_ks", F.col("feature_pos").cast("string")), "ora": ("p", F.col("term"))}
    none = F.lit(None).cast("string").alias("mode")
    out = parts["parameters"].select(F.lit("parameters").alias("section"), none, F.concat_ws("=", "name", "value").alias("subject"), F.lit(None).cast("double").alias("number"))
    for section, (value, subject) in number.items():
        mode = F.col("mode") if "mode" in parts[section].columns else none
        out = out.unionByName(parts[section].select(F.lit(section).alias("section"), mode, subject.alias("subject"), F.round(value, 6).alias("number")))
    return out


@query
def neg_log_p(spark, d):
    return t.part_tests(spark, d).select("feature", F.round(neg_log10(F.col("p_ks")), 6).alias("neg_log10_p"))
