"""The whole study as a chain of written tables: align, evaluate, score, test, classify, enrich, report."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from probestats.functions.keys import case_label
from probestats.operators import describe, enrich, errors, evaluate, fdr, folds, performance, rank, score, twosample
from probestats.operators.ordered import null_safe_join
from probestats.operators.stage import stage


def scores(
    sq_errors: DataFrame,
    norm_controls: DataFrame | None = None,
    *,
    value: str = "sq_err",
    sample: Sequence[str] = score.SAMPLE,
    group_size: int = 1,
    fill: float = 1.0,
    sentinels: tuple[float, ...] = (0.0, -1.0),
    std_offset: float = 1.0,
) -> DataFrame:
    """Scores of every sample. Without other normalisation controls, the scored controls serve as such."""
    def normalized(rows: DataFrame) -> DataFrame:
        blocks = score.block_mean(rows, value=value, sample=sample, group_size=group_size, fill=fill, sentinels=sentinels)
        return score.median_normalize(blocks, value=value, sample=sample)

    rows = stage(normalized(sq_errors), "normalized")
    controls = rows.where(F.col("cohort") == "controls") if norm_controls is None else normalized(norm_controls)
    return score.rec_score(rows, score.control_baseline(controls, value=value), value=value, std_offset=std_offset)


def evaluate_matrix(betas: DataFrame, weights: DataFrame, *, width: int = errors.SEGMENT_WIDTH, half_precision: bool = False) -> DataFrame:
    """Squared reconstruction errors of a long beta matrix."""
    blocks = errors.to_blocks(betas, width=width)
    found = errors.reconstruct(blocks, weights, half_precision=half_precision)
    return errors.to_long(found, values="sq_errs", value="sq_err", width=width)


def feature_tests(rows: DataFrame, *, value: str = "score", method: str = "auto") -> DataFrame:
    """Test table: feature, distance, p, q, smallest p first."""
    tests = stage(twosample.ks_pvalue(twosample.ks_statistic(rows, value=value), method=method), "ks")
    return fdr.ks_table(tests)


def classification(
    rows: DataFrame,
    *,
    value: str = "score",
    n_splits: int = 5,
    seed: int = 42,
    grid: Sequence[int] = evaluate.DEFAULT_GRID,
    models=None,
    ratio_threshold: float | None = None,
    sink: str | None = None,
    sample: Sequence[str] = score.SAMPLE,
) -> tuple[DataFrame, DataFrame]:
    """(fold AUCs, 20 best features per fold). rows: cohort, dataset, sample_id, feature_pos, value.

    A sample is told by all of ``sample``: readers number samples from 0 in each file.
    """
    labelled = rows.withColumn("label", case_label(F.col("cohort")))
    samples = labelled.select(*sample, "label").distinct()
    dealt = folds.assign_folds(samples, key=sample, n_splits=n_splits, seed=seed).select(*sample, "fold")
    folded = null_safe_join(labelled, dealt, sample)
    top = max([20, *grid])
    ranked = stage(
        rank.rank_features(
            rank.fold_moments(folded, value=value, n_splits=n_splits), top=top, ratio_threshold=ratio_threshold
        ),
        "ranked",
    )
    vectors = stage(evaluate.fold_vectors(folded, ranked, max_k=max(grid), value=value, sample=sample), "vectors")
    aucs = evaluate.k_sweep(vectors, folds=range(1, n_splits + 1), grid=grid, models=models, sink=sink)
    return aucs, rank.stability_table(ranked)


def performance_table(fold_aucs: DataFrame, *, n_resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(k, model, auc_main, bootstrap mean and interval, auc_plot)."""
    main = performance.mean_main([fold_aucs.select("k", "model", F.col("auc").alias("auc_main"))])
    return performance.combine(main, folds.bootstrap_ci(fold_aucs, n_resamples=n_resamples, seed=seed))


def enrichment(
    tests: DataFrame,
    annotation: DataFrame,
    gene_sets: DataFrame,
    *,
    key: str | None = None,
    top_n: int = 100,
    n_perm: int = 5000,
    seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """(over-representation, permutation table). tests: feature, p_ks."""
    key = key or enrich.discover_key(tests, annotation, exclude=("CpG", "gene_names", "cpg_order"))
    annotated = stage(enrich.annotate_features(tests, annotation, key), "annotated")
    selected = enrich.select_top(annotated, top_n)
    return (
        enrich.over_representation(annotated, selected, gene_sets),
        enrich.permutation_enrichment(annotated, gene_sets, top_n=top_n, n_perm=n_perm, seed=seed),
    )


#: What a study runs on: the scores, and the raw values they come from.
MODES = ("scores", "betas")


def _heads(of_modes: DataFrame | Mapping[str, DataFrame], head: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The head of each mode's table, one under the other; a single table is that of the scores."""
    tables = {MODES[0]: of_modes} if isinstance(of_modes, DataFrame) else of_modes
    heads = [head(rows).select(F.lit(mode).alias("mode"), "*") for mode, rows in tables.items()]
    return reduce(DataFrame.unionByName, heads)


def run_summary(
    parameters: dict[str, object],
    performance_rows: DataFrame | Mapping[str, DataFrame] | None = None,
    tests: DataFrame | Mapping[str, DataFrame] | None = None,
    ora: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """One DataFrame per report section; sections without input are left out.

    Performance and tests come by mode (``MODES``): the ten best models and sizes and the 15 smallest p of each.
    """
    given = [df for x in (performance_rows, tests, ora) if x is not None for df in ([x] if isinstance(x, DataFrame) else x.values())]
    pairs = [(name, str(value)) for name, value in parameters.items()]
    sections = {"parameters": given[0].sparkSession.createDataFrame(pairs, "name string, value string")}
    if performance_rows is not None:
        sections["performance"] = _heads(performance_rows, lambda rows: performance.top_model_k(rows, 10))
    if tests is not None:
        sections["tests"] = _heads(tests, lambda rows: fdr.top_tests(rows, 15))
    if ora is not None:
        sections["ora"] = ora.orderBy("p", "term_order").limit(20)
    return sections


def distribution_tables(rows: DataFrame, tests: DataFrame, *, value: str = "score") -> dict[str, DataFrame]:
    """Data behind the density, median and box figures."""
    return {
        "density": describe.density_histogram(rows, value, clip=1e-12),
        "medians": folds.capped_sample(describe.feature_medians(rows, value), 100_000, ["feature_pos"]),
        "boxes": describe.top_feature_boxes(rows, tests, value),
    }
