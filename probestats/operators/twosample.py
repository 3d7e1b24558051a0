"""Two-sample Kolmogorov-Smirnov tests, one per feature."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from probestats.functions.missing import finite_or_null
from probestats.functions.tails import kolmogorov_tail
from probestats.operators.ordered import join_lookup, running_totals
from probestats.operators.stage import stage

EXACT_UP_TO = 10_000
#: Numbers of one walk's arrays, which a core's cache should hold.
_BATCH_CELLS = 20_000
_LONG_SUM = 2_000_000
_SMALL_SAMPLE = 500


def ks_statistic(
    rows: DataFrame,
    keys: Sequence[str] = ("feature_pos",),
    value: str = "score",
    *,
    cohort: str = "cohort",
    cases: str = "cases",
    controls: str = "controls",
    neg_one_is_missing: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """Largest distance between the two empirical distribution functions of each key.

    ``gap`` is the distance times n_case * n_ctrl, a whole number, so that later steps need no rounding.
    Keys with one side empty stay, with NULL distance.
    """
    keys = list(keys)
    usable = finite_or_null(F.col(value).cast("double"))
    if neg_one_is_missing:
        usable = F.nullif(usable, F.lit(-1.0))
    data = rows.where(F.col(cohort).isin(cases, controls)).select(
        *keys, usable.alias("_v"), (F.col(cohort) == cases).cast("int").alias("_case")
    )
    known = F.col("_v").isNotNull().cast("int")
    weights = {"case": F.col("_case") * known, "ctrl": (1 - F.col("_case")) * known}
    steps, _ = running_totals(data, keys, "_v", weights, hot_rows=hot_rows)
    # products of two counts outgrow 64 bits
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("case_cum", "ctrl_cum", "case_total", "ctrl_total")}
    gap = F.abs(wide["case_cum"] * wide["ctrl_total"] - wide["ctrl_cum"] * wide["case_total"]).cast("decimal(38,0)")
    tested = steps.groupBy(*keys).agg(
        F.max("case_total").alias("n_case"), F.max("ctrl_total").alias("n_ctrl"), F.max(gap).alias("gap")
    )
    both = (F.col("n_case") > 0) & (F.col("n_ctrl") > 0)
    return tested.select(
        *keys,
        "n_case",
        "n_ctrl",
        F.when(both, F.col("gap")).alias("gap"),
        F.when(both, F.col("gap").cast("double") / (F.col("n_case").cast("double") * F.col("n_ctrl"))).alias("d"),
    )


def crossing_probability(n1: np.ndarray, n2: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """P(|i*n2 - j*n1| reaches the gap somewhere) on a random walk of n1 steps right and n2 steps up, for each test.

    Tests of like length are walked together, a diagonal i + j = t at a time, each in the band where its gap is not
    reached: 2 * gap / (n1 + n2) places of a diagonal, whatever its length. Mass that reaches the gap is taken off the walk
    and added up, so even tiny probabilities are sums of positive terms.
    """
    gaps = np.atleast_1d(np.asarray(gaps, dtype=np.int64))
    n1, n2 = (np.broadcast_to(np.asarray(n, dtype=np.int64), gaps.shape) for n in (n1, n2))
    width = 2 * gaps // (n1 + n2) + 4  # the band, and what one step may reach outside of it
    crossed = np.where(gaps <= 0, 1.0, 0.0)
    order = np.lexsort((width, n1 + n2))
    order = order[gaps[order] > 0]
    while len(order):
        widest = np.maximum.accumulate(width[order])
        together = max(1, int(np.searchsorted(widest * np.arange(1, len(order) + 1), _BATCH_CELLS)))
        some, order = order[:together], order[together:]
        crossed[some] = _walk(n1[some], n2[some], gaps[some], int(width[some].max()))
    return np.minimum(crossed, 1.0)


def _walk(n1: np.ndarray, n2: np.ndarray, gaps: np.ndarray, width: int) -> np.ndarray:
    n = n1 + n2
    base = -gaps // n  # the place before the first one in the band of the diagonal
    alive = np.zeros((len(gaps), width))
    alive[np.arange(len(gaps)), -base] = 1.0
    i = base[:, None] + np.arange(width, dtype=np.float64)
    apart = i * n[:, None]  # i * n2 - j * n1; whole numbers far below 2^53
    crossed, both = np.zeros(len(gaps)), np.zeros((len(gaps), width + 1))
    rights, ups, limits = n1[:, None].astype(np.float64), n2[:, None].astype(np.float64), gaps[:, None].astype(np.float64)
    for t in range(int(n.max())):
        left = np.maximum(n - t, 1)[:, None].astype(np.float64)
        both[:, :-1] = alive * ((ups - t + i) / left)
        both[:, -1] = 0.0
        both[:, 1:] += alive * ((rights - i) / left)
        following = ((t + 1) * n1 - gaps) // n
        moves = (following != base)[:, None]  # the band moves with the step to the right; what it leaves is empty
        alive = np.where(moves, both[:, 1:], both[:, :-1])
        base = following
        i += moves
        apart += np.where(moves, n[:, None], 0) - rights
        out = np.abs(apart) >= limits
        crossed += (alive * out).sum(axis=1)
        alive[out] = 0.0
    return crossed


def _log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def _one_sided_tail(n: int, d: float, lf: np.ndarray | None = None) -> float:
    """P(D+ >= d) for one sample of n: Smirnov's sum, or its expansion where it would have too many terms.

    Where they meet, at two million values, they differ by 4e-7 of p = 0.1, 3e-6 of 3e-4 and 5e-5 of 1e-14.
    """
    if n > _LONG_SUM:
        return float(np.exp(-((6.0 * n * d + 1.0) ** 2) / (18.0 * n)))
    lf = _log_factorials(n) if lf is None else lf
    j = np.arange(int(np.floor(n * (1.0 - d))) + 1)
    with np.errstate(divide="ignore"):
        rest = np.log(np.maximum(1.0 - d - j / n, 0.0))
    rest = np.where(j == n, 0.0, rest * np.maximum(n - j, 1))
    return float(d * np.exp(lf[n] - lf[j] - lf[n - j] + (j - 1) * np.log(d + j / n) + rest).sum())


def _matrix_cdf(n: int, d: float) -> float:
    """P(D < d) by Marsaglia, Tsang and Wang's matrix power; for small n."""
    k = int(np.ceil(n * d))
    m, h = 2 * k - 1, k - n * d
    i, j = np.indices((m, m))
    step = np.where(i - j + 1 >= 0, 1.0, 0.0)
    step[:, 0] -= h ** np.arange(1.0, m + 1)
    step[-1, :] -= h ** np.arange(float(m), 0, -1)
    step[-1, 0] += max(2 * h - 1, 0.0) ** m
    step /= np.exp(_log_factorials(m))[np.maximum(i - j + 1, 0)]
    # the factor n! / n^n goes into the matrix bit by bit, so that no power leaves the range of doubles
    shrink = np.exp((_log_factorials(n)[n] - n * np.log(n)) / n)
    return float(np.linalg.matrix_power(step * shrink, n)[k - 1, k - 1])


def _series_cdf(n: int, d: float) -> float:
    """P(D < d) by Pelz and Good's expansion in 1 / sqrt(n); for large n."""
    z = d * np.sqrt(n)
    z2, z4, z6 = z**2, z**4, z**6
    odd = np.pi**2 * (np.arange(0, 40) + 0.5) ** 2  # symmetric: each counts twice
    even = np.pi**2 * np.arange(1, 40) ** 2
    weight, weight_even = 2 * np.exp(-odd / (2 * z2)), 2 * np.exp(-even / (2 * z2))
    root = np.sqrt(np.pi / 2)
    k0 = root / z * weight.sum()
    k1 = root / (6 * z4) * ((odd - z2) * weight).sum()
    k2 = root / (72 * z**7) * ((6 * z6 + 2 * z4 + odd * (2 * z4 - 5 * z2) + odd**2 * (1 - 2 * z2)) * weight).sum()
    k2 -= root / (36 * z**3) * (even * weight_even).sum()
    k3 = odd**3 * (5 - 30 * z2) + odd**2 * (-60 * z2 + 212 * z4) + odd * (135 * z4 - 96 * z6) - 30 * z6 - 90 * z**8
    k3 = root / (6480 * z**10) * (k3 * weight).sum()
    k3 += root / (216 * z6) * ((3 * even * z2 - even**2) * weight_even).sum()
    return float(k0 + k1 / np.sqrt(n) + k2 / n + k3 / n**1.5)


def one_sample_tail(n: int, d: float, lf: np.ndarray | None = None) -> float:
    """P(D >= d) of the two-sided distance for one sample of n values (``lf``: ln 0! .. ln n!, if at hand).

    Up to 500 values by a matrix power, beyond by a series; where they meet, they differ by at most 2e-7.
    """
    if 2 * n * d <= 1:
        return 1.0
    if d >= 1:
        return 0.0
    if n * d * d >= 2.2 or d >= 0.5:  # both sides at once are too rare to count
        p = 2.0 * _one_sided_tail(n, d, lf)
    else:
        p = 1.0 - (_matrix_cdf(n, d) if n <= _SMALL_SAMPLE else _series_cdf(n, d))
    return min(max(p, 0.0), 1.0)


@F.pandas_udf(T.DoubleType())
def _tail(n_case: pd.Series, n_ctrl: pd.Series, gap: pd.Series, exact: pd.Series) -> pd.Series:
    p = np.full(len(gap), np.nan)
    sizes = pd.DataFrame({"a": n_case.to_numpy(), "b": n_ctrl.to_numpy(), "exact": exact.to_numpy()})
    walked = sizes["exact"].to_numpy(dtype=bool)
    p[walked] = crossing_probability(*(x[walked] for x in (sizes[["a", "b"]].min(axis=1).to_numpy(), sizes[["a", "b"]].max(axis=1).to_numpy(), gap.to_numpy())))
    for (a, b), at in sizes[~walked].groupby(["a", "b"]).groups.items():
        n = max(1, round(int(a) * int(b) / int(a + b)))
        lf = _log_factorials(n) if n <= _LONG_SUM else None
        p[at] = [one_sample_tail(n, g / (int(a) * int(b)), lf) for g in gap.to_numpy()[at]]
    return pd.Series(p)


def ks_pvalue(
    stats: DataFrame, *, method: str = "auto", exact_up_to: int = EXACT_UP_TO, tasks: int | None = None
) -> DataFrame:
    """Add the two-sided p-value ``p_ks`` to the output of ``ks_statistic``.

    exact   probability over all orders of the pooled values
    finite  law of one sample of n_case * n_ctrl / (n_case + n_ctrl) values, as used for large samples
    auto    exact while both sides have at most ``exact_up_to`` values, finite beyond
    limit   the limit law of the distance, as a plain expression

    All but ``limit`` run once per distinct (n_case, n_ctrl, gap), spread over ``tasks`` tasks. They run jobs: ``stats``, one
    row per test, are written once, as they are read three times and each reading would sort all values again.
    """
    if method not in ("auto", "exact", "finite", "limit"):
        raise ValueError(f"unknown method: {method}")
    if method == "limit":
        return stats.withColumn("p_ks", kolmogorov_tail(F.col("d"), F.col("n_case"), F.col("n_ctrl")))

    key = ["n_case", "n_ctrl", "gap"]
    stats = stage(stats, "ks_statistics")
    tested = stats.where(F.col("gap").isNotNull())
    exact = F.greatest("n_case", "n_ctrl") <= exact_up_to if method == "auto" else F.lit(method == "exact")
    tasks = tasks or int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (
        tested.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"))
        # by an expression of its own: by the keys, the count's own exchange would do, which may be cut down to one task
        .repartitionById(tasks, F.pmod(F.xxhash64(*key), F.lit(tasks)).cast("int"))
        .withColumn("p_ks", _tail("n_case", "n_ctrl", F.col("gap").cast("double"), exact))
    )
    done = join_lookup(tested, found, key, size="_n").select(*stats.columns, "p_ks")
    untested = stats.where(F.col("gap").isNull()).withColumn("p_ks", F.lit(None).cast("double"))
    return done.unionByName(untested)
