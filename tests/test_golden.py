"""Small cases checked by hand or by brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from probestats.functions import keys, missing, tails
from probestats.operators import describe, enrich, errors, evaluate, fdr, folds, rank, score, twosample

SAMPLE = dict(cohort="cases", dataset="d", sample_id="s")


def long(spark, table, cohort="controls", first=0):
    """Rows of numbers to the long error matrix; samples are numbered."""
    rows = [
        (cohort, "d", f"s{first + i}", j, None if v is None else float(v))
        for i, row in enumerate(table)
        for j, v in enumerate(row)
    ]
    return spark.createDataFrame(rows, "cohort string, dataset string, sample_id string, feature_pos int, sq_err double")


def values(df, column, *order):
    return [r[0] for r in df.orderBy(*order).select(column).collect()]


def test_fill_and_normalize(spark):
    filled = score.block_mean(long(spark, [[0, 0.04, -1, 0.02]]))
    assert values(filled, "sq_err", "feature_pos") == [1, 0.04, 1, 0.02]
    out = values(score.median_normalize(filled), "sq_err", "feature_pos")
    assert out == pytest.approx([1.923077, 0.076923, 1.923077, 0.038462], abs=1e-6)


def test_blocks(spark):
    blocks = score.block_mean(long(spark, [[0, 0.04, -1, 0.02]]), group_size=2)
    assert values(blocks, "sq_err", "feature_pos") == [0.04, 0.02]
    assert values(score.median_normalize(blocks), "sq_err", "feature_pos") == pytest.approx([4 / 3, 2 / 3])


def test_block_of_all_missing_is_filled_and_short_last_block(spark):
    blocks = score.block_mean(long(spark, [[0, None, 0.5]]), group_size=2)
    assert values(blocks, "sq_err", "feature_pos") == [1.0, 0.5]
    with pytest.raises(ValueError):
        score.block_mean(long(spark, [[1]]), group_size=0)


def test_extra_sentinel_and_zero_as_value(spark):
    rows = long(spark, [[0, -9, 2]])
    assert values(score.block_mean(rows, sentinels=(-9.0,)), "sq_err", "feature_pos") == [0, 1, 2]


def test_zero_median_gives_null(spark):
    out = score.median_normalize(long(spark, [[0, 0, 3]]))
    assert values(out, "sq_err", "feature_pos") == [None, None, None]


def test_every_sample_median_becomes_one(spark):
    rng = np.random.default_rng(1)
    out = score.median_normalize(long(spark, rng.random((5, 9))))
    medians = out.groupBy("sample_id").agg(F.median("sq_err").alias("m")).collect()
    assert [r.m for r in medians] == pytest.approx([1.0] * 5)


def test_baseline_and_score(spark):
    base = score.control_baseline(long(spark, [[1, 2], [2, 2], [3, 5]]))
    assert values(base, "ctrl_mean", "feature_pos") == [2, 3]
    assert values(base, "ctrl_std", "feature_pos") == pytest.approx([1, 1.732051], abs=1e-6)
    z = score.rec_score(long(spark, [[4, 1]], "cases"), base)
    assert values(z, "score", "feature_pos") == pytest.approx([1.0, -0.732051], abs=1e-6)


def test_one_control_gives_null_scores(spark):
    base = score.control_baseline(long(spark, [[1, 2]]))
    assert values(score.rec_score(long(spark, [[4, 1]], "cases"), base), "score", "feature_pos") == [None, None]


def two_sides(spark, x, y):
    rows = [(0, "cases", float(v)) for v in x] + [(0, "controls", float(v)) for v in y]
    return spark.createDataFrame(rows, "feature_pos int, cohort string, score double")


def test_ks_exact(spark):
    out = twosample.ks_pvalue(twosample.ks_statistic(two_sides(spark, [1, 2, 3], [2, 3, 4, 5]))).first()
    assert (out["n_case"], out["n_ctrl"], out["gap"], out["d"]) == (3, 4, 6, 0.5)
    assert out["p_ks"] == pytest.approx(23 / 35)


def test_ks_far_tail_keeps_its_digits():
    assert twosample.crossing_probability(60, 60, [3600])[0] == pytest.approx(2 / math.comb(120, 60), rel=1e-10)


def test_ks_exact_against_all_orders():
    for a, b in ((2, 3), (3, 3), (4, 2), (5, 4)):
        gaps = []
        for ups in itertools.combinations(range(a + b), a):
            i = j = 0
            worst = 0
            for t in range(a + b):
                if t in ups:
                    i += 1
                else:
                    j += 1
                worst = max(worst, abs(i * b - j * a))
            gaps.append(worst)
        wanted = sorted(set(gaps))
        got = twosample.crossing_probability(a, b, wanted)
        assert got == pytest.approx([np.mean([g >= w for g in gaps]) for w in wanted], rel=1e-12)


def test_ks_limit_law_meets_exact_for_many_values(spark):
    rows = spark.createDataFrame([(400, 500, 20_000, 0.1)], "n_case long, n_ctrl long, gap long, d double")
    limit = twosample.ks_pvalue(rows, method="limit").first()["p_ks"]
    exact = twosample.ks_pvalue(rows, method="exact").first()["p_ks"]
    assert limit == pytest.approx(exact, rel=0.1)


def test_finite_law_against_published_value_and_itself():
    assert twosample._matrix_cdf(10, 0.274) == pytest.approx(0.6284796154565, rel=1e-11)
    for n in (300, 500):
        for z in (0.5, 0.8, 1.1, 1.45):
            assert twosample._series_cdf(n, z / n**0.5) == pytest.approx(twosample._matrix_cdf(n, z / n**0.5), abs=2e-6)
        edge = (2.2 / n) ** 0.5
        assert 2 * twosample._one_sided_tail(n, edge) == pytest.approx(1 - twosample._matrix_cdf(n, edge), rel=1e-4)
    n, d = 5_000, 0.03
    assert twosample._one_sided_tail(n, d) == pytest.approx(np.exp(-((6 * n * d + 1) ** 2) / (18 * n)), rel=1e-2)
    assert (twosample.one_sample_tail(50, 0.001), twosample.one_sample_tail(50, 1.0)) == (1.0, 0.0)
    assert twosample.one_sample_tail(1, 0.75) == pytest.approx(0.5)


def test_finite_law_is_close_to_exact(spark):
    rows = spark.createDataFrame([(400, 500, g, g / 200_000) for g in (8_000, 14_000, 20_000, 30_000)], "n_case long, n_ctrl long, gap long, d double")
    finite = values(twosample.ks_pvalue(rows, method="finite"), "p_ks", "gap")
    exact = values(twosample.ks_pvalue(rows, method="exact"), "p_ks", "gap")
    assert finite == pytest.approx(exact, rel=0.08)


def test_ks_switches_by_size_and_keeps_empty_sides(spark):
    rows = two_sides(spark, [1, 2, 3], [2, 3, 4, 5]).unionByName(
        spark.createDataFrame([(1, "cases", 2.0), (2, "cases", None), (2, "controls", 1.0), (3, "cases", None)], "feature_pos int, cohort string, score double")
    )
    stats = twosample.ks_statistic(rows)
    out = {r.feature_pos: r for r in twosample.ks_pvalue(stats, exact_up_to=3).collect()}
    assert sorted(out) == [0, 1, 2, 3]
    assert out[0].p_ks == pytest.approx(twosample.one_sample_tail(2, 0.5))  # four values on one side
    assert [out[k].p_ks for k in (1, 2, 3)] == [None] * 3
    assert (out[2].n_case, out[2].n_ctrl, out[3].n_ctrl) == (0, 1, 0)


def test_ks_is_symmetric_and_minus_one_flag(spark):
    x, y = [1, 2, -1, 9], [0.5, 2, 2, 7, 8]
    d = twosample.ks_statistic(two_sides(spark, x, y)).first()["d"]
    assert d == twosample.ks_statistic(two_sides(spark, y, x)).first()["d"]
    masked = twosample.ks_statistic(two_sides(spark, x, y), neg_one_is_missing=True).first()
    assert masked["n_case"] == 3


@pytest.mark.parametrize(
    "p, q", [([0.01, 0.04, 0.03, 0.005], [0.02, 0.04, 0.04, 0.02]), ([0.01, None], [0.02, 1.0])]
)
def test_bh(spark, p, q):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p_ks double")
    assert values(fdr.bh_fdr(rows), "fdr_bh", "i") == pytest.approx(q)


def test_test_table_order(spark):
    rows = spark.createDataFrame([(3, None), (2, 0.5), (1, 0.5), (0, 0.9)], "feature_pos int, p_ks double")
    assert [r.feature_pos for r in fdr.ks_table(rows).collect()] == [1, 2, 0, 3]


def hyper(x, M, K, n):
    return sum(math.comb(K, j) * math.comb(M - K, n - j) for j in range(x, min(K, n) + 1)) / math.comb(M, n)


def test_hypergeometric_tail(spark):
    cases = [(2, 10, 4, 3), (0, 10, 4, 3), (1, 10, 0, 3), (1, 10, 4, 0), (4, 6, 5, 5), (5, 6, 5, 5), (30, 20_000, 300, 150), (3, 20_000, 40, 500), (12, 50, 20, 30)]
    rows = spark.createDataFrame(cases, "x long, M long, K long, n long")
    got = rows.select(tails.hypergeometric_tail(F.col("x"), F.col("M"), F.col("K"), F.col("n"))).collect()
    want = [1.0 if K == 0 or n == 0 else hyper(x, M, K, n) for x, M, K, n in cases]
    assert [r[0] for r in got] == pytest.approx(want, rel=1e-9)
    assert got[0][0] == pytest.approx(1 / 3)


def test_log_factorial(spark):
    numbers = [0, 1, 5, 15, 16, 17, 100, 12345, 10_000_000]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long")
    got = [r[0] for r in rows.select(tails.log_factorial(F.col("n"))).collect()]
    assert got == pytest.approx([math.lgamma(n + 1) for n in numbers], rel=1e-13, abs=1e-13)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "feature_pos int, sample_id int, fold int, label int, score double")


def test_anova(spark):
    rows = [(0, i, 1, 1, v) for i, v in enumerate([1.0, 2.0, 3.0])] + [(0, 9 + i, 1, 0, v) for i, v in enumerate([4.0, 5.0, 6.0])]
    rows += [(1, i, 1, int(i < 3), 2.0) for i in range(6)] + [(2, i, 1, int(i < 3), float(i < 3)) for i in range(6)]
    moments = rank.fold_moments(labelled(spark, rows), n_splits=2).where("fold = 2")
    got = {r[0]: r[1] for r in moments.select("feature_pos", rank.anova_f()).collect()}
    assert got == {0: pytest.approx(13.5), 1: None, 2: float("inf")}
    top = rank.rank_features(moments, top=3).collect()
    assert [r.feature_pos for r in sorted(top, key=lambda r: r["rank"])] == [2, 0, 1]
    assert [r.feature_pos for r in rank.rank_features(moments, top=3, ratio_threshold=0.01).collect()] == [2]


def test_auc(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.4, 1), (0.4, 0), (0.1, 0)], "score double, label int")
    assert evaluate.roc_auc(rows).first()["auc"] == 0.875
    turned = rows.withColumn("score", -F.col("score"))
    assert evaluate.roc_auc(turned).first()["auc"] == 0.125
    assert evaluate.roc_auc(rows.where("label = 1")).first()["auc"] is None


def test_error_quantiles(spark):
    out = errors.error_metrics(long(spark, [[1, 4, 16, None]])).first()
    assert (out["median_ae"], out["missing_pct"], out["mse_global"]) == (2, 25, 7)
    assert out["p95_ae"] == pytest.approx(3.8)


def test_dataset_of_missing_values_only(spark):
    out = errors.error_metrics(long(spark, [[None, None]])).first()
    assert (out["missing_pct"], out["mse_global"], out["median_ae"]) == (100, None, None)


def test_density(spark):
    rows = spark.createDataFrame([("a", -1.0), ("a", 3.0), ("a", 3.1), ("a", None)], "cohort string, score double")
    out = {r["bin"]: r for r in describe.density_histogram(rows).collect()}
    assert len(out) == 512 and (out[1].n, out[512].n, out[256].n) == (1, 1, 0)
    assert out[1].density == out[512].density == 64
    assert sum(r.density for r in out.values()) * 4 / 512 == pytest.approx(1)


def test_histogram_of_one_value(spark):
    rows = spark.createDataFrame([("a", "d", 2.0)] * 3, "cohort string, dataset string, v double")
    out = {r["bin"]: r.n for r in describe.range_histogram(rows, "v", bins=10).collect()}
    assert sum(out.values()) == 3 and out[6] == 3


def test_box(spark):
    rows = spark.createDataFrame([(0, float(v)) for v in (1, 2, 3, 4, 100)], "g int, v double")
    out = describe.box_stats(rows, "v", ["g"]).first()
    assert (out["q1"], out["median"], out["q3"], out["whisker_low"], out["whisker_high"]) == (2, 3, 4, 1, 4)


def test_folds(spark):
    samples = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(103)], "sample_id int, label int")
    out = folds.assign_folds(samples).toPandas()
    assert len(out) == 103
    for _, g in out.groupby("label"):
        sizes = g.fold.value_counts()
        assert set(sizes.index) == {1, 2, 3, 4, 5} and sizes.max() - sizes.min() <= 1
    again = folds.assign_folds(samples.repartition(5)).toPandas()
    assert out.sort_values("sample_id").fold.tolist() == again.sort_values("sample_id").fold.tolist()


def test_capped_sample(spark):
    rows = spark.range(1000)
    out = [r.id for r in folds.capped_sample(rows, 100, ["id"]).collect()]
    assert len(set(out)) == 100 and 300 < np.mean(out) < 700
    assert sorted(out) == sorted(r.id for r in folds.capped_sample(rows.repartition(3), 100, ["id"]).collect())
    assert folds.capped_sample(rows, 5000, ["id"]).count() == 1000


def test_bootstrap(spark):
    rows = spark.createDataFrame([(1, "m", f, a) for f, a in enumerate([0.5, 0.6, 0.7, 0.8, 0.9])] + [(2, "m", 1, 0.4), (3, "m", 1, None)], "k int, model string, fold int, auc double")
    out = {r.k: r for r in folds.bootstrap_ci(rows).collect()}
    assert sorted(out) == [1, 2]
    assert out[1].mean_auc_boot == pytest.approx(0.7, abs=0.01)
    assert 0.5 < out[1].ci95_low < 0.62 and 0.78 < out[1].ci95_high < 0.9
    assert (out[2].ci95_low, out[2].ci95_high) == (pytest.approx(0.4), pytest.approx(0.4))


def test_key_text(spark):
    rows = spark.createDataFrame([("A; b,.;;C",), (None,), (" ,",)], "t string")
    assert [r[0] for r in rows.select(keys.split_genes(F.col("t"))).collect()] == [["A", "b", "C"], [], []]
    zeros = spark.createDataFrame([("0070 ",), ("000",), (" 07",)], "t string")
    assert [r[0] for r in zeros.select(keys.strip_zeros(F.col("t"))).collect()] == ["70", "", "07"]
    stems = spark.createDataFrame([("a_scores",), ("a_mse_per_sample_per_position",), ("scores",)], "t string")
    assert [r[0] for r in stems.select(keys.dataset_stem(F.col("t"))).collect()] == ["a", "a", "scores"]


def test_missing_markers(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (-1.0,), (2.0,)], "v double")
    assert [r[0] for r in rows.select(missing.is_missing(F.col("v"))).collect()] == [True, True, True, True, False]
    assert [r[0] for r in rows.select(missing.finite_or_null(F.col("v"))).collect()] == [None, None, 0, -1, 2]


# --- annotation and enrichment ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def study(spark):
    annotation = spark.createDataFrame(
        [("cg1", "g1;g2", "007", "x", 0), ("cg2", "G2", "008", "y", 1), ("ch3", "g9", "009", "z", 2), ("cg4", ".", "010", "1", 3), ("cg2", "g5", "010", "2", 4)],
        "CpG string, gene_names string, probe string, other string, cpg_order int",
    )
    tests = spark.createDataFrame([("7", 0.2), ("8", 0.1), ("9", 0.01), ("10", 0.3)], "feature string, p_ks double")
    sets = spark.createDataFrame([("t1", "g2", 0), ("t1", "G2", 0), ("t2", "G1", 1), ("t2", "g7", 1), ("none", "g7", 2)], "term string, gene string, term_order long")
    return tests, annotation, sets


def test_key_discovery_and_annotation(study):
    tests, annotation, _ = study
    assert enrich.discover_key(tests, annotation.drop("other"), exclude=("CpG", "gene_names", "cpg_order")) == "probe"
    with pytest.raises(ValueError):
        enrich.discover_key(tests, annotation.select("CpG", F.lit("q").alias("only")))
    out = {r.CpG: r for r in enrich.annotate_features(tests, annotation, "probe").collect()}
    assert sorted(out) == ["cg1", "cg2", "cg4"]
    assert (out["cg2"].feature, out["cg2"].genes, out["cg4"].genes) == ("8", ["G2"], [])


def test_over_representation(study):
    tests, annotation, sets = study
    annotated = enrich.annotate_features(tests, annotation, "probe")
    selected = enrich.select_top(annotated, 1)  # cg2: gene G2
    out = {r.term: r for r in enrich.over_representation(annotated, selected, sets).collect()}
    assert (out["t1"].m_univ, out["t1"].k_term, out["t1"].n_sel, out["t1"].x_overlap) == (2, 1, 1, 1)
    assert out["t1"].p == pytest.approx(0.5) and out["t1"].expected == 0.5
    assert (out["t2"].x_overlap, out["t2"].p, out["none"].k_term, out["none"].p) == (0, 1, 0, 1)
    ora = enrich.over_representation(annotated, selected, sets)
    assert [r.term for r in enrich.focus_terms(ora, "T[12]").orderBy("term").collect()] == ["t1", "t2"]
    assert enrich.focus_terms(ora, "t[", literal=True).count() == 0
    assert [r.gene for r in enrich.focus_overlap(ora, "t", selected, sets).collect()] == ["G2"]


def test_term_incidence(study):
    tests, annotation, sets = study
    annotated = enrich.annotate_features(tests, annotation, "probe")
    pairs = {tuple(r) for r in enrich.term_incidence(annotated, sets).collect()}
    assert pairs == {("t1", "cg1"), ("t1", "cg2"), ("t2", "cg1")}


def test_draws_are_whole_subsets(spark):
    for k, n in ((3, 3), (4, 9), (0, 5)):
        out = enrich.permutation_draws(spark, 400, F.lit(k).cast("bigint"), F.lit(n).cast("bigint")).toPandas()
        assert len(out) == 400 * k
        if k:
            groups = out.groupby("perm").idx
            assert (groups.nunique() == k).all() and out.idx.between(0, n - 1).all()
            assert np.allclose(out.idx.value_counts() / 400, k / n, atol=0.1)


def test_permutations(spark):
    n, k, perms = 60, 12, 300
    annotated = spark.createDataFrame([(f"cg{i:03d}", i / n, [f"g{i % 6}"]) for i in range(n)], "CpG string, p_ks double, genes array<string>")
    sets = spark.createDataFrame([("t", "G0", 0), ("u", "g1", 1), ("u", "g2", 1), ("v", "zz", 2)], "term string, gene string, term_order long")
    out = {r.term: r for r in enrich.permutation_enrichment(annotated, sets, top_n=k, n_perm=perms).collect()}
    assert (out["t"].k_cpg, out["t"].x_obs, out["u"].k_cpg, out["u"].x_obs) == (10, 2, 20, 4)
    assert out["t"].mean_perm == pytest.approx(k * 10 / n, abs=0.25)
    assert out["u"].mean_perm == pytest.approx(k * 20 / n, abs=0.3)
    assert (out["v"].mean_perm, out["v"].sd_perm, out["v"].p_emp) == (0, 0, 1)
    assert all(r.fdr_emp >= r.p_emp for r in out.values())


def test_profiles_are_short(spark):
    """What every gene and draw of a feature carries does not grow with its genes."""
    rows = spark.createDataFrame([("cg1", [f"gene{i}" for i in range(500)]), ("cg2", [f"GENE{i}" for i in range(499, -1, -1)]), ("cg3", [])], "CpG string, genes array<string>")
    found = {r["CpG"]: bytes(r["profile"]) for r in enrich._with_profile(rows).collect()}
    assert {len(p) for p in found.values()} == {16} and found["cg1"] == found["cg2"] != found["cg3"]
