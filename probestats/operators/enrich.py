"""Annotation of tested features, and over-representation of gene sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from probestats.functions.draws import draw_cell, draw_key, permuted
from probestats.functions.keys import split_genes, strip, strip_zeros
from probestats.functions.tails import hypergeometric_tail, neg_log10
from probestats.operators.align import keep_first
from probestats.operators.fdr import bh_fdr
from probestats.operators.ordered import join_lookup, row_ranks
from probestats.operators.stage import stage


def key_overlaps(stats: DataFrame, annotation: DataFrame, *, feature: str = "feature", exclude: Sequence[str] = ("CpG",)) -> DataFrame:
    """How many tested features each annotation column knows, as written and without leading zeros.

    Best key first: matches as written win over stripped ones, then the larger overlap, then column order.
    """
    columns = [c for c in annotation.columns if c not in exclude]
    places = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.lit(i) for i in range(len(columns))]))
    text = annotation.select(*[F.col(c).cast("string").alias(c) for c in columns])
    cells = text.unpivot([], columns, "column_name", "_value")

    def overlap(clean, kind: str) -> DataFrame:
        known = cells.select("column_name", clean(F.col("_value")).alias("_id")).distinct()
        ids = stats.select(clean(F.col(feature)).alias("_id")).distinct()
        return (
            known.join(ids, "_id", "left_semi")
            .groupBy("column_name")
            .agg(F.count(F.lit(1)).alias("overlap"))
            .select("column_name", F.lit(kind).alias("match"), "overlap")
        )

    return (
        overlap(strip, "as_written")
        .unionByName(overlap(strip_zeros, "zeros_stripped"))
        .withColumn("column_order", F.element_at(places, F.col("column_name")))
        .orderBy("match", F.col("overlap").desc(), "column_order")
    )


def discover_key(stats: DataFrame, annotation: DataFrame, **options) -> str:
    best = key_overlaps(stats, annotation, **options).first()
    if best is None:
        raise ValueError("no annotation column matches the tested features")
    return best["column_name"]


def annotate_features(
    stats: DataFrame, annotation: DataFrame, key: str, *, feature: str = "feature", p: str = "p_ks", order: str = "cpg_order"
) -> DataFrame:
    """One row per known CpG with the best test that reaches it, and its gene list.

    annotation: CpG, gene_names, ``key`` and ``order`` (its own row order). Each key first keeps its best
    test, so that the join brings at most one row per annotation row.
    """
    first = [F.col(p).asc_nulls_last(), F.col(feature)]
    tests = keep_first(stats.withColumn("_key", strip_zeros(F.col(feature))), ["_key"], first)
    known = annotation.where(F.col("CpG").startswith("cg")).select(
        "CpG", "gene_names", F.col(order).alias("_order"), strip_zeros(F.col(key)).alias("_key")
    )
    merged = join_lookup(known.where(F.col("_key").isNotNull()), tests, ["_key"])
    return (
        keep_first(merged, ["CpG"], [*first, F.col("_order")])
        .withColumn("genes", split_genes(F.col("gene_names")))
        .drop("_key", "_order", "gene_names")
    )


def distinct_genes(annotated: DataFrame) -> DataFrame:
    return annotated.select(F.explode("genes").alias("gene")).select(F.upper("gene").alias("gene")).distinct()


def select_top(annotated: DataFrame, n: int = 100, *, p: str = "p_ks") -> DataFrame:
    return annotated.orderBy(F.col(p).asc_nulls_last(), "CpG").limit(n)


def _terms(gene_sets: DataFrame) -> DataFrame:
    return gene_sets.groupBy("term").agg(F.min("term_order").alias("term_order"))


def _upper_sets(gene_sets: DataFrame) -> DataFrame:
    return gene_sets.select("term", F.upper("gene").alias("gene")).distinct()


def terms_in_universe(gene_sets: DataFrame, universe: DataFrame) -> DataFrame:
    """Gene sets cut down to the known genes, as counts; terms left with none stay with 0."""
    known = join_lookup(_upper_sets(gene_sets), universe, ["gene"])
    sizes = known.groupBy("term").agg(F.count(F.lit(1)).alias("k_term"))
    return _terms(gene_sets).join(sizes, "term", "left").select("term", "term_order", F.coalesce("k_term", F.lit(0)).alias("k_term"))


def over_representation(annotated: DataFrame, selected: DataFrame, gene_sets: DataFrame) -> DataFrame:
    """Hypergeometric upper tail of the selected genes in each term.

    gene_sets: term, gene, term_order. Output: term, term_order, m_univ, k_term, n_sel, x_overlap, expected, p.
    """
    universe, chosen = distinct_genes(annotated), distinct_genes(selected)
    flagged = universe.join(chosen.withColumn("_hit", F.lit(1)), "gene", "left")
    counts = (
        join_lookup(_upper_sets(gene_sets), flagged, ["gene"])
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("k_term"), F.count("_hit").alias("x_overlap"))
    )
    rows = _terms(gene_sets).join(counts, "term", "left").select(
        "term",
        "term_order",
        universe.agg(F.count(F.lit(1))).scalar().alias("m_univ"),
        F.coalesce("k_term", F.lit(0)).alias("k_term"),
        chosen.agg(F.count(F.lit(1))).scalar().alias("n_sel"),
        F.coalesce("x_overlap", F.lit(0)).alias("x_overlap"),
    )
    expected = F.col("n_sel") * F.try_divide(F.col("k_term"), F.col("m_univ"))
    tail = hypergeometric_tail(F.col("x_overlap"), F.col("m_univ"), F.col("k_term"), F.col("n_sel"))
    return rows.withColumn("expected", expected).withColumn("p", tail)


def focus_terms(ora: DataFrame, query: str, *, literal: bool = False) -> DataFrame:
    """Terms whose name contains the query, in any case; the query is a regular expression unless literal."""
    if literal:
        return ora.where(F.contains(F.lower("term"), F.lower(F.lit(query))))
    return ora.where(F.col("term").rlike("(?i)" + query))


def focus_overlap(ora: DataFrame, query: str, selected: DataFrame, gene_sets: DataFrame, *, literal: bool = False) -> DataFrame:
    """Selected genes of the first matching term, in order."""
    first = focus_terms(ora, query, literal=literal).orderBy("term_order").limit(1).select("term")
    genes = _upper_sets(gene_sets).join(F.broadcast(first), "term", "left_semi").select("gene")
    return genes.join(distinct_genes(selected), "gene", "left_semi").orderBy("gene")


def top_terms(ora: DataFrame, n: int = 20) -> DataFrame:
    return (
        ora.orderBy("p", "term_order").limit(n).select("term", "p", neg_log10(F.col("p")).alias("neg_log10_p"))
    )


def _with_profile(annotated: DataFrame) -> DataFrame:
    """CpG, ``profile`` and ``genes``: features with equal sets of genes hit the same terms.

    The profile is a digest, so that what is carried by every gene and draw has 16 bytes, however many genes there are.
    """
    genes = F.array_sort(F.array_distinct(F.transform("genes", F.upper)))
    return annotated.select("CpG", F.unhex(F.md5(F.array_join(genes, ";"))).alias("profile"), genes.alias("genes"))


def _term_profiles(features: DataFrame, gene_sets: DataFrame) -> DataFrame:
    """profile, ``terms``: the terms that share a gene with it. One row per profile that has some.

    Terms are gathered by gene and then by profile, at most all terms there are, so that a gene or profile that many
    rows have meets one row, which a hot key's rows get by broadcast.
    """
    profiles = stage(features.groupBy("profile").agg(F.first("genes").alias("genes")), "profiles")  # read twice
    genes = profiles.select("profile", F.explode("genes").alias("gene")).where("gene <> ''")
    by_gene = _upper_sets(gene_sets).groupBy("gene").agg(F.collect_list("term").alias("terms"))
    hits = join_lookup(genes, by_gene, ["gene"]).select("profile", F.explode("terms").alias("term"))
    return hits.groupBy("profile").agg(F.collect_set("term").alias("terms"))


def term_incidence(annotated: DataFrame, gene_sets: DataFrame) -> DataFrame:
    """(term, CpG) wherever they share a gene."""
    features = _with_profile(annotated)
    links = stage(_term_profiles(features, gene_sets), "links")
    return join_lookup(features.drop("genes"), links, ["profile"]).select(F.explode("terms").alias("term"), "CpG")


def permutation_draws(spark, n_perm: int, size: Column, universe: Column, *, seed: int = 7) -> DataFrame:
    """(perm, idx): ``size`` different numbers of [0, universe) per permutation: the first of a keyed permutation."""
    perms = spark.range(1, n_perm + 1).select(F.col("id").alias("perm"), size.alias("_k"), universe.alias("_n"))
    steps = F.when(F.col("_k") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1))
    return perms.select("perm", "_n", F.explode(steps).alias("_s")).select("perm", permuted(F.col("_s"), F.col("_n"), seed, F.col("perm")).alias("idx"))


def permutation_enrichment(
    annotated: DataFrame,
    gene_sets: DataFrame,
    *,
    top_n: int = 100,
    n_perm: int = 5000,
    seed: int = 7,
) -> DataFrame:
    """Counts of the ``top_n`` features per term against random choices of as many, empirical p and its q.

    Features with equal genes are counted together before they meet the terms. Only permutations that hit a
    term make rows; the others enter mean, deviation and p through ``n_perm``.
    """
    spark = annotated.sparkSession
    selected = select_top(annotated, top_n)
    features = _with_profile(annotated)
    shuffled = features.withColumn("_draw", draw_key(seed, F.col("CpG")))
    keyed = row_ranks(shuffled, [], "_draw", ["CpG"], cells=[draw_cell(F.col("_draw"))], few_cells=True)
    indexed = keyed.select((F.col("row_rank") - 1).alias("idx"), "profile")
    links = stage(_term_profiles(features, gene_sets), "links")
    features = features.drop("genes")
    draws = permutation_draws(
        spark,
        n_perm,
        selected.agg(F.countDistinct("CpG")).scalar(),
        features.agg(F.count(F.lit(1))).scalar(),
        seed=seed,
    )
    # the selection itself runs along as permutation 0, and all features as -1
    chosen = features.join(selected.select("CpG"), "CpG", "left_semi")
    drawn = indexed.join(draws, "idx").select("perm", "profile")
    for number, rows in ((0, chosen), (-1, features)):
        drawn = drawn.unionByName(rows.select(F.lit(number).cast("bigint").alias("perm"), "profile"))
    counts = stage(drawn.groupBy("perm", "profile").agg(F.count(F.lit(1)).alias("_c")), "drawn")
    found = join_lookup(counts, links, ["profile"]).select("perm", "_c", F.explode("terms").alias("term"))
    hits = found.groupBy("term", "perm").agg(F.sum("_c").alias("_c"))
    # a term has at most n_perm + 2 rows here
    own = F.when(F.col("perm") == 0, F.col("_c"))
    observed = hits.withColumn("_x", F.coalesce(F.max(own).over(W.partitionBy("term")), F.lit(0)))
    drawn_only = F.col("perm") > 0
    counted = observed.groupBy("term").agg(
        F.max(F.when(F.col("perm") == -1, F.col("_c"))).alias("k_cpg"),
        F.max("_x").alias("x_obs"),
        F.sum(F.when(drawn_only, F.col("_c"))).alias("_s1"),
        F.sum(F.when(drawn_only, F.col("_c") * F.col("_c"))).alias("_s2"),
        F.count_if(drawn_only & (F.col("_c") >= F.col("_x"))).alias("_reach"),
    )
    s1, s2, x_obs = (F.coalesce(c, F.lit(0)) for c in ("_s1", "_s2", "x_obs"))
    reach = F.when(x_obs == 0, F.lit(n_perm)).otherwise(F.col("_reach"))
    variance = (s2 - s1 * s1 / F.lit(float(n_perm))) / F.lit(float(n_perm - 1)) if n_perm > 1 else F.lit(None).cast("double")
    table = _terms(gene_sets).join(counted, "term", "left").select(
        "term",
        F.coalesce("k_cpg", F.lit(0)).alias("k_cpg"),
        x_obs.alias("x_obs"),
        (s1 / F.lit(float(n_perm))).alias("mean_perm"),
        F.sqrt(F.greatest(variance, F.lit(0.0))).alias("sd_perm"),
        ((reach + 1) / F.lit(n_perm + 1.0)).alias("p_emp"),
    )
    # one row per term; written, so that the q-values do not repeat the permutations
    return bh_fdr(stage(table, "permutations"), "p_emp", name="fdr_emp").orderBy("fdr_emp", "p_emp", F.col("x_obs").desc(), "term")
