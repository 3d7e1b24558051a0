"""The same queries in plain SQL over the same tables, as an independent check."""

from __future__ import annotations

_SQL: dict[str, str] = {}


def all_oracles() -> dict[str, str]:
    return dict(_SQL)


def _r(name: str, digits: int = 6) -> str:
    return f"round({name}, {digits}) AS {name}"


def _rs(*names: str) -> str:
    return ", ".join(_r(n) for n in names)


# --- shared views ----------------------------------------------------------------------------------

MATRIX = """
m AS (
  SELECT CASE WHEN label < 5 THEN 'cases' ELSE 'controls' END AS cohort, 'ds_' || label AS dataset,
         vec_id AS sample_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label,
         CAST(i - 1 AS INTEGER) AS feature_pos, CAST(embedding[i] AS DOUBLE) AS value
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
)"""

ERRORS = MATRIX + """,
e AS (
  SELECT * EXCLUDE (value, label),
         CASE (sample_id * 7 + feature_pos) % 13 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN -1.0::DOUBLE WHEN 2 THEN NULL
              ELSE value * value END AS sq_err
  FROM m
)"""

CLEAN = ERRORS + """,
c AS (SELECT * REPLACE (CASE WHEN sq_err > 0 THEN sq_err END AS sq_err) FROM e)"""

FILLED = ERRORS + """,
f AS (SELECT * REPLACE (CASE WHEN sq_err IS NULL OR sq_err IN (0, -1) THEN 1.0::DOUBLE ELSE sq_err END AS sq_err) FROM e)"""

NORMALIZED = FILLED + """,
md AS (SELECT sample_id, quantile_cont(sq_err, 0.5) AS med FROM f GROUP BY sample_id),
n AS (SELECT f.* REPLACE (f.sq_err / nullif(md.med, 0) AS sq_err) FROM f JOIN md USING (sample_id))"""

BASELINE = """,
b AS (SELECT feature_pos, avg(sq_err) AS ctrl_mean, stddev_samp(sq_err) AS ctrl_std FROM n WHERE cohort = 'controls' GROUP BY feature_pos),
z AS (SELECT n.cohort, n.sample_id, n.feature_pos, (n.sq_err - b.ctrl_mean) / (b.ctrl_std + 1.0) AS score FROM n JOIN b USING (feature_pos))"""

BLOCKS = """
g AS (
  SELECT cohort, dataset, sample_id, CAST(feature_pos // {size} AS INTEGER) AS feature_pos,
         coalesce(avg(CASE WHEN sq_err NOT IN (0, -1) THEN sq_err END), 1.0) AS sq_err
  FROM e GROUP BY ALL
)"""

TWO_GROUPS = """
s AS (
  SELECT l_suppkey AS feature_pos, CASE l_returnflag WHEN 'A' THEN 'cases' ELSE 'controls' END AS cohort,
         l_extendedprice AS score
  FROM lineitem
)"""

KS = """,
lv AS (
  SELECT feature_pos, score, count(*) FILTER (cohort = 'cases') AS c, count(*) FILTER (cohort = 'controls') AS k
  FROM {rows} WHERE score IS NOT NULL GROUP BY ALL
),
st AS (
  SELECT feature_pos, sum(c) OVER up AS cc, sum(k) OVER up AS ck, sum(c) OVER al AS nc, sum(k) OVER al AS nk
  FROM lv WINDOW up AS (PARTITION BY feature_pos ORDER BY score), al AS (PARTITION BY feature_pos)
),
ks AS (
  SELECT feature_pos, CAST(max(nc) AS BIGINT) AS n_case, CAST(max(nk) AS BIGINT) AS n_ctrl,
         CAST(max(abs(cc * nk - ck * nc)) AS BIGINT) AS gap,
         max(abs(cc * nk - ck * nc)) / (max(nc)::DOUBLE * max(nk)) AS d
  FROM st GROUP BY feature_pos
),
kp AS (
  SELECT *, sqrt(n_case::DOUBLE * n_ctrl / (n_case + n_ctrl)) * d AS lam,
         CASE WHEN lam < 0.2 THEN 1.0::DOUBLE ELSE
           least(greatest(2 * list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0::DOUBLE * j * j * lam * lam))), 0.0), 1.0)
         END AS p_ks
  FROM ks
)"""

BH = """,
rk AS (
  SELECT *, coalesce(p_ks, 1.0) * count(*) OVER () / (count(*) OVER (ORDER BY coalesce(p_ks, 1.0))) AS raw FROM {rows}
),
bh AS (SELECT *, least(min(raw) OVER (ORDER BY coalesce(p_ks, 1.0) DESC), 1.0) AS fdr_bh FROM rk)"""

# --- alignment and duplicates ----------------------------------------------------------------------

_FIRST = "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice"

_SQL["dedup_first"] = f"""
SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey {_FIRST}) = 1"""

_SQL["dup_resolve_mean"] = """
SELECT l_partkey, round(avg(l_quantity), 6) AS l_quantity FROM lineitem GROUP BY l_partkey"""

_SQL["dup_resolve_median"] = """
SELECT l_partkey, round(quantile_cont(l_extendedprice, 0.5), 6) AS l_extendedprice FROM lineitem GROUP BY l_partkey"""

_SQL["manifest_positions"] = """
SELECT cpg_id, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS feature_pos, p_partkey
FROM (SELECT trim(p_name) AS cpg_id, min(p_partkey) AS p_partkey FROM part GROUP BY 1)"""

_SQL["align_to_manifest"] = """
WITH f AS (SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS feature_pos FROM part WHERE p_type <> 'SMALL'),
rows AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'cases' ELSE 'controls' END AS cohort, l_linestatus AS dataset, * FROM lineitem
),
first AS (
  SELECT cohort, dataset, l_partkey, l_linenumber, l_extendedprice FROM rows
  QUALIFY row_number() OVER (PARTITION BY cohort, dataset, l_partkey, l_linenumber
                             ORDER BY l_shipdate, l_orderkey, l_suppkey, l_extendedprice) = 1
),
sets AS (SELECT DISTINCT cohort, dataset FROM rows), nums AS (SELECT unnest(range(1, 8)) AS num)
SELECT sets.cohort, sets.dataset, 's' || num AS sample_id, f.feature_pos, first.l_extendedprice AS beta
FROM sets CROSS JOIN f CROSS JOIN nums
LEFT JOIN first ON first.cohort = sets.cohort AND first.dataset = sets.dataset AND first.l_partkey = f.p_partkey AND first.l_linenumber = num"""

_SQL["value_range"] = f"""
WITH {CLEAN} SELECT round(min(coalesce(sq_err, 0)), 6) AS min_value, round(max(coalesce(sq_err, 0)), 6) AS max_value FROM c"""

_SQL["dataset_select"] = f"""
WITH {MATRIX} SELECT cohort, dataset, count(*) AS n, count(DISTINCT sample_id) AS n_samples
FROM m WHERE dataset IN ('ds_0', 'ds_3', 'ds_5', 'ds_8') GROUP BY ALL"""

_SQL["stem_normalize"] = """
SELECT source || '-' || lang AS dataset, count(*) AS n FROM documents GROUP BY ALL"""

_SQL["shared_features_by_cohort"] = f"""
WITH {TWO_GROUPS} SELECT CAST(floor(score) AS BIGINT) AS feature_pos, count(*) AS n FROM s GROUP BY 1
HAVING count(DISTINCT cohort) = 2"""

# --- missing values, scores ------------------------------------------------------------------------

_SQL["sentinel_mask_fill"] = f"""
WITH {ERRORS} SELECT sample_id, feature_pos, sq_err IS NULL OR sq_err IN (0, -1) AS missing,
  round(CASE WHEN sq_err IS NULL OR sq_err IN (0, -1) THEN 1.0 ELSE sq_err END, 6) AS filled,
  round(nullif(sq_err, -1), 6) AS no_sentinel FROM e"""

_SQL["block_mean"] = f"""
WITH {ERRORS}, {BLOCKS.format(size=3)} SELECT sample_id, feature_pos, {_r('sq_err')} FROM g"""

_SQL["median_normalize"] = f"WITH {NORMALIZED} SELECT sample_id, feature_pos, {_r('sq_err')} FROM n"

_SQL["control_baseline"] = f"WITH {NORMALIZED}{BASELINE} SELECT feature_pos, {_rs('ctrl_mean', 'ctrl_std')} FROM b"

_SQL["rec_score"] = f"WITH {NORMALIZED}{BASELINE} SELECT cohort, sample_id, feature_pos, {_r('score')} FROM z"

_SQL["rec_score_blocks"] = f"""
WITH {ERRORS}, {BLOCKS.format(size=10)},
md AS (SELECT sample_id, quantile_cont(sq_err, 0.5) AS med FROM g GROUP BY sample_id),
n AS (SELECT g.* REPLACE (g.sq_err / nullif(md.med, 0) AS sq_err) FROM g JOIN md USING (sample_id)){BASELINE}
SELECT cohort, sample_id, feature_pos, {_r('score')} FROM z"""

# --- reconstruction errors -------------------------------------------------------------------------

_SQL["sq_error"] = f"""
WITH {MATRIX} SELECT sample_id, feature_pos,
  round(CASE WHEN (sample_id + feature_pos) % 11 <> 0 AND value <> 0 THEN pow(value * 0.9::DOUBLE + 0.01::DOUBLE - value, 2) END, 9) AS sq_err FROM m"""

_METRICS = """
  100.0 * count(*) FILTER (sq_err IS NULL) / count(*) AS missing_pct, avg(sq_err) AS mse_global, avg(sqrt(sq_err)) AS mae_global,
  sqrt(avg(sq_err)) AS rmse_global, quantile_cont(sqrt(sq_err), 0.5) AS median_ae, quantile_cont(sqrt(sq_err), 0.95) AS p95_ae"""
_METRIC_NAMES = ("missing_pct", "mse_global", "mae_global", "rmse_global", "median_ae", "p95_ae")

_SQL["error_metrics"] = f"""
WITH {CLEAN}, x AS (SELECT cohort, dataset, {_METRICS} FROM c GROUP BY ALL)
SELECT cohort, dataset, {_rs(*_METRIC_NAMES)} FROM x"""

_SEGMENTS = [f"mse_segment_{i + 1}" for i in range(4)]
_SQL["segment_summary_pivot"] = f"""
WITH {CLEAN}, x AS (
  SELECT cohort, dataset, {_METRICS},
    {", ".join(f"avg(sq_err) FILTER (feature_pos // 16 = {i}) AS {n}" for i, n in enumerate(_SEGMENTS))}
  FROM c GROUP BY ALL)
SELECT cohort, dataset, {_rs(*_METRIC_NAMES, *_SEGMENTS)} FROM x"""

_SQL["missing_pct"] = f"""
WITH {CLEAN} SELECT cohort, dataset, count(*) FILTER (sq_err IS NULL) AS n_missing, count(*) AS n_total,
  round(100.0 * count(*) FILTER (sq_err IS NULL) / count(*), 6) AS missing_pct FROM c GROUP BY ALL"""

_SQL["matrix_checks"] = f"""
WITH {MATRIX}, w AS (SELECT * FROM m WHERE abs(value) > 0.02)
SELECT 'feature_count' AS problem, cohort || '/' || dataset || '/' || sample_id AS subject, count(*) AS n_found
FROM w GROUP BY cohort, dataset, sample_id HAVING count(*) <> 64
UNION ALL SELECT 'segment_without_model', CAST(feature_pos // 16 AS VARCHAR), count(*) FROM w WHERE feature_pos // 16 >= 3 GROUP BY 2"""


def _layer(number: int, source: str, n_in: int, n_out: int) -> str:
    weight = f"((seg * 31 + {number} * 17 + o * 7 + i * 13) % 19 - 9) / 20.0::DOUBLE"
    bias = f"((seg * 5 + {number} * 3 + o * 11) % 7 - 3) / 10.0::DOUBLE"
    total = f"sum(x * {weight}) + {bias}"
    if number == 4:
        out = f"1 / (1 + exp(-({total})))"
    else:
        out = (
            f"(greatest({total}, 0) - (o % 5) / 20.0::DOUBLE) / sqrt(1 + (o % 4) / 4.0::DOUBLE + 1e-5::DOUBLE)"
            " * (1 + (o % 3) / 10.0::DOUBLE) + (o % 2) / 10.0::DOUBLE"
        )
    return f"""
y{number} AS (SELECT sample_id, seg, o AS i, {out} AS x FROM {source}, (SELECT unnest(range(0, {n_out})) AS o) GROUP BY sample_id, seg, o)"""


_SQL["autoencoder_error"] = f"""
WITH {MATRIX},
x0 AS (
  SELECT sample_id, feature_pos // 16 AS seg, feature_pos % 16 AS i, feature_pos,
         CASE WHEN (sample_id * 7 + feature_pos) % 13 > 1 AND value <> 0 THEN value END AS beta, coalesce(beta, 0) AS x FROM m
),{_layer(1, 'x0', 16, 6)},{_layer(2, 'y1', 6, 3)},{_layer(3, 'y2', 3, 6)},{_layer(4, 'y3', 6, 16)}
SELECT sample_id, feature_pos, round(pow(y4.x - beta, 2), 6) AS sq_err FROM x0 JOIN y4 USING (sample_id, seg, i)"""

_SQL["autoencoder_wide"] = f"""
WITH w AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'cases' ELSE 'controls' END AS cohort, 'ds_' || l_linestatus AS dataset, l_linenumber AS line,
         CAST(l_orderkey % 25000 AS INTEGER) AS feature_pos, min(l_extendedprice) / 100000 AS beta
  FROM lineitem GROUP BY ALL
),
x0 AS (SELECT *, (cohort, dataset, line) AS sample_id, feature_pos // 10000 AS seg, feature_pos % 10000 AS i, beta AS x FROM w WHERE beta <> 0),
{_layer(1, 'x0', 10000, 6)},{_layer(2, 'y1', 6, 3)},{_layer(3, 'y2', 3, 6)},{_layer(4, 'y3', 6, 10000)}
SELECT cohort, dataset, line AS sample_id, feature_pos, round(pow(y4.x - beta, 2), 6) AS sq_err FROM x0 JOIN y4 USING (sample_id, seg, i)"""

# --- two-sample tests ------------------------------------------------------------------------------

_SQL["ks_stat"] = f"WITH {TWO_GROUPS}{KS.format(rows='s')} SELECT feature_pos, n_case, n_ctrl, gap, {_r('d')} FROM ks"

_SQL["ks_pvalue_asymp"] = f"WITH {TWO_GROUPS}{KS.format(rows='s')} SELECT feature_pos, {_rs('d', 'p_ks')} FROM kp"

# the probability that a walk of n_case and n_ctrl steps in any order reaches the gap
WALK = """,
gaps AS (SELECT DISTINCT n_case AS a, n_ctrl AS b, gap FROM ks),
walk AS (
  SELECT a, b, gap, 0::BIGINT AS t, [1.0::DOUBLE] || list_transform(range(0, a), lambda i: 0.0::DOUBLE) AS alive, 0.0::DOUBLE AS crossed FROM gaps
  UNION ALL
  SELECT a, b, gap, t + 1,
         list_transform(range(0, a + 1), lambda i: CASE WHEN abs(i * b - (t + 1 - i) * a) >= gap THEN 0.0 ELSE moved[i + 1] END),
         crossed + list_sum(list_transform(range(0, a + 1), lambda i: CASE WHEN abs(i * b - (t + 1 - i) * a) >= gap THEN moved[i + 1] ELSE 0.0 END))
  FROM (
    SELECT *, list_transform(range(0, a + 1), lambda i:
        (CASE WHEN t - i BETWEEN 0 AND b THEN alive[i + 1] * (b - t + i) ELSE 0.0 END
         + CASE WHEN i > 0 AND t - i + 1 BETWEEN 0 AND b THEN alive[i] * (a - i + 1) ELSE 0.0 END) / (a + b - t)) AS moved
    FROM walk WHERE t < a + b
  )
),
kx AS (
  SELECT feature_pos, n_case, n_ctrl, ks.gap, d, least(crossed, 1.0) AS p_ks
  FROM ks JOIN walk ON walk.a = n_case AND walk.b = n_ctrl AND walk.gap = ks.gap AND t = a + b
)"""

_SQL["ks_pvalue_exact"] = f"""
WITH RECURSIVE {MATRIX}, v AS (SELECT feature_pos, cohort, value AS score FROM m){KS.format(rows='v')}{WALK}
SELECT feature_pos, n_case, n_ctrl, gap, {_r('p_ks')} FROM kx"""

# Smirnov's sum where n d^2 >= 2.2, Pelz and Good's expansion below; for more than 500 values
_SQL["ks_pvalue_finite"] = f"""
WITH s AS (
  SELECT l_linenumber AS feature_pos, CASE l_returnflag WHEN 'A' THEN 'cases' ELSE 'controls' END AS cohort, l_extendedprice AS score
  FROM lineitem
){KS.format(rows='s')},
g AS (SELECT *, CAST(round_even(n_case::DOUBLE * n_ctrl / (n_case + n_ctrl), 0) AS BIGINT) AS n, d * sqrt(n) AS z FROM ks),
o AS (SELECT unnest(range(0, 40)) AS k, pow(pi() * (k + 0.5::DOUBLE), 2) AS a, pow(pi() * k, 2) AS b),
t AS (
  SELECT feature_pos, n,
    sum(2 * exp(-a / (2 * z * z))) AS s0, sum((a - z * z) * 2 * exp(-a / (2 * z * z))) AS s1,
    sum((6 * pow(z, 6) + 2 * pow(z, 4) + a * (2 * pow(z, 4) - 5 * z * z) + a * a * (1 - 2 * z * z)) * 2 * exp(-a / (2 * z * z))) AS s2,
    sum(b * 2 * exp(-b / (2 * z * z))) AS e2,
    sum((pow(a, 3) * (5 - 30 * z * z) + a * a * (212 * pow(z, 4) - 60 * z * z) + a * (135 * pow(z, 4) - 96 * pow(z, 6))
         - 30 * pow(z, 6) - 90 * pow(z, 8)) * 2 * exp(-a / (2 * z * z))) AS s3,
    sum((3 * b * z * z - b * b) * 2 * exp(-b / (2 * z * z))) AS e3
  FROM g, o GROUP BY feature_pos, n
),
w AS (
  SELECT feature_pos, sum(d * exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + (j - 1) * ln(d + j / n::DOUBLE)
         + (n - j) * ln(greatest(1 - d - j / n::DOUBLE, 1e-300)))) AS one
  FROM (SELECT *, unnest(range(0, CAST(floor(n * (1 - d)) AS BIGINT) + 1)) AS j FROM g) GROUP BY feature_pos
)
SELECT feature_pos AS l_linenumber, n_case, n_ctrl, {_r('d')}, round(CASE WHEN n * d * d >= 2.2 THEN least(2 * one, 1.0) ELSE 1 - sqrt(pi() / 2) * (
    s0 / z + s1 / (6 * pow(z, 4)) / sqrt(n) + (s2 / (72 * pow(z, 7)) - e2 / (36 * pow(z, 3))) / n
    + (s3 / (6480 * pow(z, 10)) + e3 / (216 * pow(z, 6))) / pow(n, 1.5)) END, 6) AS p_ks
FROM g JOIN t USING (feature_pos, n) JOIN w USING (feature_pos)"""

ORDER_TESTS = """
o AS (
  SELECT o_orderkey, o_orderstatus,
         CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE (CAST(floor(o_totalprice) AS BIGINT) % 5000) / 5000.0::DOUBLE END AS p
  FROM orders
)"""


def _order_bh(by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"""
WITH {ORDER_TESTS},
x AS (SELECT *, coalesce(p, 1) AS f FROM o),
k AS (SELECT *, f * count(*) OVER ({part}) / (count(*) OVER ({part}ORDER BY f)) AS raw FROM x),
w AS (SELECT *, least(min(raw) OVER ({part}ORDER BY f DESC), 1.0) AS q FROM k)
SELECT o_orderkey, {_rs('p', 'q')} FROM w"""


_SQL["bh_fdr"] = _order_bh("")
_SQL["bh_fdr_grouped"] = _order_bh("o_orderstatus")

_SQL["bh_fdr_null_group"] = f"""
WITH {ORDER_TESTS.replace("o_orderstatus", "nullif(o_orderstatus, 'O') AS o_orderstatus", 1)},
x AS (SELECT *, coalesce(p, 1) AS f FROM o),
k AS (SELECT *, f * count(*) OVER (PARTITION BY o_orderstatus) / (count(*) OVER (PARTITION BY o_orderstatus ORDER BY f)) AS raw FROM x),
w AS (SELECT *, least(min(raw) OVER (PARTITION BY o_orderstatus ORDER BY f DESC), 1.0) AS q FROM k)
SELECT o_orderkey, o_orderstatus, {_rs('p', 'q')} FROM w"""

_TEST_TABLE = f"SELECT feature_pos, n_case, n_ctrl, {_rs('d', 'p_ks', 'fdr_bh')} FROM bh"

# both sides of all tests here have at most 10,000 values, so the default method is the exact one
_SQL["ks_table"] = f"WITH RECURSIVE {TWO_GROUPS}{KS.format(rows='s')}{WALK}{BH.format(rows='kx')} {_TEST_TABLE}"

_SQL["ks_table_betas"] = f"""
WITH RECURSIVE {MATRIX}, v AS (SELECT feature_pos, cohort, CASE WHEN (sample_id * 7 + feature_pos) % 13 = 2 THEN 0.0 ELSE value END AS score FROM m)
{KS.format(rows='v')}{WALK}{BH.format(rows='kx')} {_TEST_TABLE}"""

_SQL["top_tests"] = f"""
WITH RECURSIVE {TWO_GROUPS}{KS.format(rows='s')}{WALK} SELECT feature_pos, {_r('p_ks')} FROM kx ORDER BY round(kx.p_ks, 9), feature_pos LIMIT 15"""

_SQL["score_tests"] = f"""
WITH RECURSIVE {NORMALIZED}{BASELINE}, v AS (SELECT feature_pos, cohort, round(score, 9) AS score FROM z)
{KS.format(rows='v')}{WALK}{BH.format(rows='kx')} {_TEST_TABLE}"""

# --- distributions ---------------------------------------------------------------------------------

_SQL["feature_medians"] = f"""
WITH {TWO_GROUPS} SELECT feature_pos,
  round(quantile_cont(score, 0.5) FILTER (cohort = 'cases'), 6) AS median_cases,
  round(quantile_cont(score, 0.5) FILTER (cohort = 'controls'), 6) AS median_controls FROM s GROUP BY feature_pos"""

_SQL["density_hist"] = f"""
WITH {MATRIX}, v AS (SELECT cohort, value * 8 + 1 AS v FROM m),
h AS (
  SELECT cohort, CASE WHEN v = 3 THEN 512 ELSE CAST(floor((v + 1) / 0.0078125::DOUBLE) AS BIGINT) + 1 END AS bin, count(*) AS n
  FROM v WHERE v BETWEEN -1 AND 3 GROUP BY ALL),
spine AS (SELECT cohort, unnest(range(1, 513)) AS bin FROM (SELECT DISTINCT cohort FROM h)),
x AS (SELECT cohort, bin, coalesce(n, 0) AS n, -1 + (bin - 0.5::DOUBLE) * 0.0078125::DOUBLE AS center FROM spine LEFT JOIN h USING (cohort, bin))
SELECT cohort, bin, {_r('center')}, n, round(greatest(n / (sum(n) OVER (PARTITION BY cohort)::DOUBLE * 0.0078125::DOUBLE), 1e-12), 6) AS density FROM x"""

_SQL["error_hist"] = f"""
WITH {TWO_GROUPS}, ends AS (SELECT cohort, min(score) AS lo, max(score) AS hi FROM s GROUP BY cohort),
h AS (
  SELECT cohort, CASE WHEN score = hi THEN 100 ELSE CAST(floor((score - lo) / ((hi - lo) / 100)) AS BIGINT) + 1 END AS bin, count(*) AS n
  FROM s JOIN ends USING (cohort) GROUP BY ALL),
spine AS (SELECT *, unnest(range(1, 101)) AS bin FROM ends)
SELECT cohort, bin, round(lo + (bin - 1) * (hi - lo) / 100, 6) AS left_edge, coalesce(n, 0) AS n FROM spine LEFT JOIN h USING (cohort, bin)"""


def _boxes(rows: str, by: str, value: str) -> str:
    return f"""
q AS (SELECT {by}, count({value}) AS n, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
        quantile_cont({value}, 0.75) AS q3 FROM {rows} WHERE {value} IS NOT NULL GROUP BY ALL),
w AS (SELECT {by}, min(CASE WHEN {value} >= q1 - 1.5 * (q3 - q1) THEN {value} END) AS lo,
        max(CASE WHEN {value} <= q3 + 1.5 * (q3 - q1) THEN {value} END) AS hi FROM {rows} JOIN q USING ({by}) GROUP BY {by}),
bx AS (SELECT {by}, n, q1, median, q3, least(lo, q1) AS whisker_low, greatest(hi, q3) AS whisker_high FROM q JOIN w USING ({by}))
SELECT {by}, n, {_rs('q1', 'median', 'q3', 'whisker_low', 'whisker_high')} FROM bx"""


_SQL["box_stats"] = f"WITH {TWO_GROUPS}, {_boxes('s', 'cohort, feature_pos', 'score')}"

_SQL["top_feature_boxes"] = f"""
WITH RECURSIVE {TWO_GROUPS}{KS.format(rows='s')}{WALK},
top AS (SELECT feature_pos FROM kx ORDER BY round(p_ks, 9), feature_pos LIMIT 10),
ts AS (SELECT * FROM s WHERE feature_pos IN (FROM top)), {_boxes('ts', 'cohort, feature_pos', 'score')}"""


def _key(*parts: str) -> str:
    return "md5(" + " || ':' || ".join(parts) + ")"


def _draw(*parts: str) -> str:
    return f"('0x' || substr({_key(*parts)}, 1, 8))::BIGINT"


_SQL["capped_sample"] = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
ORDER BY {_key("'42'", 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')}, l_orderkey, l_linenumber, l_partkey, l_suppkey
LIMIT 12000"""

# --- folds, ranking, evaluation --------------------------------------------------------------------

FOLDS = f"""
fo AS (
  SELECT vec_id AS sample_id, CASE WHEN label < 5 THEN 1 ELSE 0 END::BIGINT AS label,
         (row_number() OVER (PARTITION BY label < 5 ORDER BY {_key("'42'", 'vec_id')}, vec_id) - 1) % 5 + 1 AS fold
  FROM embeddings
)"""

MOMENTS = FOLDS + """,
tr AS (
  SELECT f.fold, m.feature_pos, count(*) FILTER (m.label = 0) AS n0, count(*) FILTER (m.label = 1) AS n1,
         avg(v) FILTER (m.label = 0) AS mean0, avg(v) FILTER (m.label = 1) AS mean1,
         var_pop(v) FILTER (m.label = 0) * n0 AS ss0, var_pop(v) FILTER (m.label = 1) * n1 AS ss1, avg(v) AS grand
  FROM (SELECT *, value + {shift}::DOUBLE AS v FROM m) m JOIN fo USING (sample_id) JOIN (SELECT unnest(range(1, 6)) AS fold) f ON f.fold <> fo.fold
  GROUP BY ALL
)"""

_F = "(n0 * pow(mean0 - grand, 2) + n1 * pow(mean1 - grand, 2)) / ((ss0 + ss1) / (n0 + n1 - 2))"

_SQL["fold_assign"] = f"WITH {FOLDS} SELECT * FROM fo"

_SQL["anova_f"] = f"""
WITH {MATRIX}, {MOMENTS.format(shift=0)} SELECT fold, feature_pos, round({_F}, 6) AS f_stat FROM tr"""

_SQL["ratio_filter"] = f"""
WITH {MATRIX}, {MOMENTS.format(shift=1)} SELECT fold, feature_pos, {_rs('mean0', 'mean1')} FROM tr
WHERE tr.mean1 >= 1.01 * greatest(tr.mean0, 1e-12)"""

_SQL["fold_top20"] = f"""
WITH {MATRIX}, {MOMENTS.format(shift=0)}
SELECT fold, row_number() OVER (PARTITION BY fold ORDER BY {_F} DESC, feature_pos) AS rank,
  'f' || feature_pos AS feature_name, feature_pos AS feature_index FROM tr QUALIFY rank <= 20"""

_SQL["fold_vectors"] = f"""
WITH {MATRIX}, {MOMENTS.format(shift=0)},
rk AS (SELECT fold AS model_fold, feature_pos, row_number() OVER (PARTITION BY fold ORDER BY {_F} DESC, feature_pos) AS rank FROM tr QUALIFY rank <= 12)
SELECT model_fold, m.sample_id, fo.label, fo.fold = model_fold AS held_out, rank, round(value, 6) AS value
FROM rk JOIN m USING (feature_pos) JOIN fo ON fo.sample_id = m.sample_id"""

# a fold that trains on a value that is no number has no F for that feature
_SQL["fold_top20_nan"] = f"""
WITH {MATRIX}, {MOMENTS.format(shift=0)},
bad AS (
  SELECT DISTINCT f.fold, m.feature_pos, TRUE AS bad FROM m JOIN fo USING (sample_id) JOIN (SELECT unnest(range(1, 6)) AS fold) f ON f.fold <> fo.fold
  WHERE m.feature_pos % 9 = 0 AND m.sample_id % 50 = 0
)
SELECT fold, row_number() OVER (PARTITION BY fold ORDER BY CASE WHEN bad THEN '-Infinity'::DOUBLE ELSE {_F} END DESC, feature_pos) AS rank,
  'f' || feature_pos AS feature_name, feature_pos AS feature_index FROM tr LEFT JOIN bad USING (fold, feature_pos)"""

_SQL["folds_repeated_ids"] = """
WITH x AS (SELECT DISTINCT CASE WHEN label < 5 THEN 'cases' ELSE 'controls' END AS cohort, 'ds_' || label AS dataset, vec_id // 10 AS sample_id,
                  CASE WHEN label < 5 THEN 1 ELSE 0 END::BIGINT AS label FROM embeddings)
SELECT cohort, dataset, sample_id, label,
       (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || cohort || ':' || dataset || ':' || sample_id), cohort, dataset, sample_id) - 1) % 5 + 1 AS fold FROM x"""

_SQL["blocks_with_gaps"] = f"""
WITH {MATRIX} SELECT cohort, dataset, sample_id, feature_pos, round(value, 6) AS beta FROM m WHERE (sample_id * 5 + feature_pos) % 7 <> 0"""


def _auc(rows: str, by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
rk AS (SELECT *, rank() OVER ({part}ORDER BY score) + (count(*) OVER ({part.rstrip() + ', ' if part else 'PARTITION BY '}score) - 1) / 2.0::DOUBLE AS ar FROM {rows}),
au AS (SELECT {lead}count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, sum(ar) FILTER (label = 1) AS sr FROM rk {group})
SELECT {lead}n_pos, n_neg, round((sr - n_pos * (n_pos + 1) / 2.0::DOUBLE) / nullif(n_pos * n_neg, 0), 6) AS auc FROM au"""


_SQL["auc_rank"] = f"""
WITH dl AS (SELECT lang, n_chars AS score, quality AS label FROM labels JOIN documents USING (doc_id)), {_auc('dl', 'lang')}"""

_SQL["auc_global"] = f"""
WITH {TWO_GROUPS}, sl AS (SELECT score, CASE cohort WHEN 'cases' THEN 1 ELSE 0 END AS label FROM s), {_auc('sl', '')}"""

_MODELS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

PERF = """
pf AS (SELECT p_size AS k, p_type AS model, p_partkey % 5 + 1 AS fold, (p_retailprice % 100) / 100 AS auc FROM part)"""


def _pivot(value: str, rows: str) -> str:
    cells = ", ".join(f"round(avg({value}) FILTER (model = '{m}'), 6) AS {m}" for m in _MODELS)
    return f"SELECT k, {cells} FROM {rows} GROUP BY k"


_SQL["mean_auc_wide"] = f"WITH {PERF} {_pivot('auc', 'pf')}"

_SQL["bootstrap_ci"] = f"""
WITH {PERF},
a AS (SELECT k, model, list(auc ORDER BY fold) AS v FROM (SELECT k, model, fold, avg(auc) AS auc FROM pf GROUP BY ALL) GROUP BY ALL),
d AS (SELECT k, model, rep, v[{_draw("'42'", 'k', 'model', 'rep', 'd')} % len(v) + 1] AS x
      FROM (SELECT *, unnest(range(1, len(v) + 1)) AS d FROM (SELECT *, unnest(range(1, 1001)) AS rep FROM a))),
b AS (SELECT k, model, rep, avg(x) AS x FROM d GROUP BY ALL)
SELECT k, model, round(avg(x), 10) AS mean_auc_boot, round(quantile_cont(x, 0.025), 10) AS ci95_low, round(quantile_cont(x, 0.975), 10) AS ci95_high
FROM b GROUP BY ALL"""

# --- performance tables ----------------------------------------------------------------------------

COMBINED = PERF + """,
mn AS (SELECT k, model, avg(auc) AS auc_main FROM pf GROUP BY ALL),
bo AS (SELECT k, model, avg(auc * 0.98::DOUBLE) AS mean_auc_boot, avg(auc * 0.9::DOUBLE) AS ci95_low, avg(least(auc * 1.05::DOUBLE, 1)) AS ci95_high
       FROM pf WHERE model <> 'PROMO' GROUP BY ALL),
cb AS (SELECT k, model, auc_main, mean_auc_boot, ci95_low, ci95_high, coalesce(mean_auc_boot, auc_main) AS auc_plot FROM mn LEFT JOIN bo USING (k, model))"""

_SQL["melt_mean"] = f"""
WITH {PERF}, w AS (SELECT k, model, fold % 2 AS part, avg(auc) AS auc FROM pf GROUP BY ALL),
g AS (SELECT k, model FROM (SELECT DISTINCT k FROM pf), (SELECT DISTINCT model FROM pf))
SELECT k, model, round(avg(auc), 6) AS auc_main FROM g LEFT JOIN w USING (k, model) GROUP BY ALL"""

_SQL["perf_join"] = f"""
WITH {COMBINED} SELECT k, model, {_rs('auc_main', 'mean_auc_boot', 'ci95_low', 'ci95_high', 'auc_plot')} FROM cb"""

_SQL["perf_without_bootstrap"] = f"""
WITH {COMBINED} SELECT k, model, {_r('auc_main')}, NULL::DOUBLE AS mean_auc_boot, round(auc_main, 6) AS auc_plot FROM mn"""

_SQL["auc_series"] = f"""
WITH {COMBINED} SELECT model, k, {_r('auc_plot')}, round(ci95_low, 6) AS band_low, round(ci95_high, 6) AS band_high FROM cb"""

_SQL["heatmap_pivot"] = f"WITH {COMBINED} {_pivot('auc_plot', 'cb')}"

_SQL["model_boxes"] = f"WITH {COMBINED}, {_boxes('cb', 'model', 'auc_plot')}"

_SQL["best_mean_model"] = f"""
WITH {COMBINED}, x AS (SELECT * REPLACE (round(auc_plot, 9) AS auc_plot) FROM cb)
SELECT model, round(max(auc_plot), 6) AS best_auc, round(avg(auc_plot), 6) AS mean_auc, first(k ORDER BY auc_plot DESC, k) AS best_k FROM x GROUP BY model"""

_SQL["best_mean_table"] = f"""
WITH {COMBINED}
SELECT 'Best AUC' AS statistic, {", ".join(f"round(max(auc_plot) FILTER (model = '{m}'), 4) AS {m}" for m in _MODELS)} FROM cb
UNION ALL SELECT 'Mean AUC', {", ".join(f"round(avg(auc_plot) FILTER (model = '{m}'), 4)" for m in _MODELS)} FROM cb"""

_SQL["top20_model_k"] = f"""
WITH {COMBINED} SELECT model, k, {_rs('auc_plot', 'ci95_low', 'ci95_high')} FROM cb ORDER BY round(cb.auc_plot, 9) DESC, model, k LIMIT 20"""

# --- annotation and enrichment ---------------------------------------------------------------------

ANNOTATED = """
pt AS (SELECT CAST(p_partkey AS VARCHAR) AS feature, (p_partkey * 7919 % 1009 + 1) / 1010.0::DOUBLE AS p_ks FROM part),
an AS (
  SELECT (CASE p_type WHEN 'SMALL' THEN 'ch' ELSE 'cg' END) || lpad(p_partkey::VARCHAR, 8, '0') AS CpG, lpad(p_partkey::VARCHAR, 8, '0') AS probe,
         p_size::VARCHAR AS size_key, p_brand AS brand, CASE WHEN p_size % 10 = 0 THEN NULL ELSE genes END AS genes, p_partkey AS cpg_order
  FROM part LEFT JOIN (SELECT l_partkey, list_sort(list(DISTINCT 's' || l_suppkey || '_' || l_partkey % 50)) AS genes FROM lineitem GROUP BY 1) ON p_partkey = l_partkey
),
ad AS (
  SELECT CpG, feature, p_ks, coalesce(genes, []) AS genes FROM an JOIN pt ON ltrim(probe, '0') = ltrim(feature, '0')
  WHERE CpG LIKE 'cg%' QUALIFY row_number() OVER (PARTITION BY CpG ORDER BY p_ks, feature, cpg_order) = 1
),
fg AS (SELECT DISTINCT CpG, upper(unnest(genes)) AS gene FROM ad),
un AS (SELECT DISTINCT gene FROM fg),
gs AS (SELECT n_name AS term, 'S' || s_suppkey || '_' || g AS gene, n_nationkey AS term_order FROM nation JOIN supplier ON n_nationkey = s_nationkey CROSS JOIN (SELECT unnest(range(50)) AS g)),
tm AS (SELECT term, min(term_order) AS term_order FROM gs GROUP BY term)"""

ORA = ANNOTATED + """,
sl AS (SELECT CpG FROM ad ORDER BY p_ks, CpG LIMIT 100),
sg AS (SELECT DISTINCT gene FROM fg WHERE CpG IN (FROM sl)),
oc AS (
  SELECT term, term_order, (SELECT count(*) FROM un) AS m_univ, count(gs.gene) FILTER (gs.gene IN (FROM un)) AS k_term,
         (SELECT count(*) FROM sg) AS n_sel, count(gs.gene) FILTER (gs.gene IN (FROM sg)) AS x_overlap
  FROM tm JOIN gs USING (term, term_order) GROUP BY term, term_order
),
orx AS (
  SELECT *, n_sel * (k_term / m_univ::DOUBLE) AS expected,
    CASE WHEN k_term = 0 OR n_sel = 0 OR x_overlap = 0 THEN 1.0::DOUBLE ELSE least(1.0, (
      SELECT sum(exp(lgamma(k_term + 1) - lgamma(j + 1) - lgamma(k_term - j + 1)
               + lgamma(m_univ - k_term + 1) - lgamma(n_sel - j + 1) - lgamma(m_univ - k_term - n_sel + j + 1)
               - lgamma(m_univ + 1) + lgamma(n_sel + 1) + lgamma(m_univ - n_sel + 1)))
      FROM (SELECT unnest(range(greatest(x_overlap, n_sel - (m_univ - k_term)), least(k_term, n_sel) + 1)) AS j))) END AS p
  FROM oc
)"""

_SQL["split_gene_lists"] = """
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '' ELSE concat_ws('|', p_name, p_brand, p_type) END AS genes FROM part"""

_SQL["key_discovery"] = f"""
WITH {ANNOTATED},
cells AS (
  SELECT 'probe' AS column_name, 0 AS column_order, probe AS v FROM an UNION ALL SELECT 'size_key', 1, size_key FROM an
  UNION ALL SELECT 'brand', 2, brand FROM an)
SELECT column_name, 'as_written' AS match, count(DISTINCT v) AS overlap, column_order::BIGINT AS column_order FROM cells WHERE v IN (SELECT feature FROM pt) GROUP BY ALL
UNION ALL
SELECT column_name, 'zeros_stripped', count(DISTINCT ltrim(v, '0')), column_order FROM cells WHERE ltrim(v, '0') IN (SELECT ltrim(feature, '0') FROM pt) GROUP BY ALL"""

_SQL["annotate_features"] = f"""
WITH {ANNOTATED} SELECT CpG, feature, {_r('p_ks')}, array_to_string(genes, ';') AS genes FROM ad"""

_SQL["term_universe"] = f"""
WITH {ANNOTATED} SELECT term, count(DISTINCT gene) FILTER (gene IN (FROM un)) AS k_term FROM gs GROUP BY term"""

_SQL["ora"] = f"WITH {ORA} SELECT term, m_univ, k_term, n_sel, x_overlap, {_rs('expected', 'p')} FROM orx"

_SQL["term_filter"] = f"""
WITH {ORA} SELECT term, k_term, x_overlap, {_r('p')} FROM orx WHERE regexp_matches(term, '(?i)nation_1[0-4]')"""

_SQL["focus_overlap_genes"] = f"""
WITH {ORA} SELECT gene FROM gs WHERE gene IN (FROM sg)
AND term = (SELECT term FROM tm WHERE regexp_matches(term, '(?i)nation_1') ORDER BY term_order LIMIT 1)"""

_SQL["top_terms"] = f"""
WITH {ORA}, x AS (SELECT term, term_order, round(p, 9) AS p FROM orx ORDER BY round(p, 9), term_order LIMIT 20)
SELECT term, {_r('p')}, round(-log10(greatest(x.p, 1e-300)), 6) AS neg_log10_p FROM x"""

_SQL["term_incidence"] = f"WITH {ANNOTATED} SELECT DISTINCT term, CpG FROM gs JOIN fg USING (gene)"

_SQL["perm_enrichment"] = f"""
WITH RECURSIVE {ANNOTATED},
ix AS (SELECT CpG, row_number() OVER (ORDER BY md5('7:' || CpG), CpG) - 1 AS idx FROM ad),
sl AS (SELECT CpG FROM ad ORDER BY p_ks, CpG LIMIT 100),
nk AS (SELECT (SELECT count(*) FROM ad) AS n, (SELECT count(*) FROM sl) AS k),
gr AS (SELECT n, k, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b FROM nk),
-- the first numbers of a permutation of a grid of a times b places, moved on while they lie beyond n
pk AS (
  SELECT perm, x, TRUE AS beyond FROM (SELECT unnest(range(1, 5001)) AS perm) CROSS JOIN (SELECT unnest(range(0, k)) AS x FROM nk)
  UNION ALL
  SELECT perm, r2 * b + (c1 + {_draw("'7'", 'perm', '3', 'r2')}) % b, r2 * b + (c1 + {_draw("'7'", 'perm', '3', 'r2')}) % b >= n FROM (
    SELECT *, (r1 + {_draw("'7'", 'perm', '2', 'c1')}) % a AS r2 FROM (
      SELECT *, (x % b + {_draw("'7'", 'perm', '1', 'r1')}) % b AS c1 FROM (
        SELECT *, (x // b + {_draw("'7'", 'perm', '0', 'x % b')}) % a AS r1 FROM pk, gr WHERE beyond
      )
    )
  )
),
dr AS (SELECT perm, x AS idx FROM pk WHERE NOT beyond),
tf AS (SELECT DISTINCT term, CpG FROM gs JOIN fg USING (gene)),
ob AS (SELECT term, count(CpG) AS k_cpg, count(CpG) FILTER (CpG IN (FROM sl)) AS x_obs FROM tm LEFT JOIN tf USING (term) GROUP BY term),
ct AS (SELECT term, perm, count(*) AS c FROM dr JOIN ix USING (idx) JOIN tf USING (CpG) GROUP BY ALL),
al AS (SELECT term, k_cpg, x_obs, coalesce(c, 0) AS c FROM ob CROSS JOIN (SELECT unnest(range(1, 5001)) AS perm) LEFT JOIN ct USING (term, perm)),
pp AS (SELECT term, k_cpg, x_obs, avg(c) AS mean_perm, stddev_samp(c) AS sd_perm, (1 + count(*) FILTER (c >= x_obs)) / 5001.0::DOUBLE AS p_emp FROM al GROUP BY ALL),
rk AS (SELECT *, p_emp * count(*) OVER () / (count(*) OVER (ORDER BY p_emp)) AS raw FROM pp),
bh AS (SELECT *, least(min(raw) OVER (ORDER BY p_emp DESC), 1.0) AS fdr_emp FROM rk)
SELECT term, k_cpg, x_obs, {_rs('mean_perm', 'sd_perm', 'p_emp', 'fdr_emp')} FROM bh"""

_SQL["matrix_lines"] = """
SELECT p_partkey, p_name || ', "' || p_brand || '"' AS name, p_size::VARCHAR AS size, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS type FROM part"""

_SQL["gene_set_lines"] = "SELECT n_name AS term, s_name AS gene FROM nation JOIN supplier ON n_nationkey = s_nationkey"

_SQL["export_betas"] = f"""
WITH {CLEAN} SELECT sample_id, feature_pos, round(CAST(CAST(coalesce(sq_err, 0) AS FLOAT) AS DOUBLE), 6) AS beta FROM c"""

_SQL["neg_log_p"] = f"WITH {ANNOTATED} SELECT feature, round(-log10(p_ks), 6) AS neg_log10_p FROM pt"

_SQL["run_summary"] = f"""
WITH RECURSIVE {COMBINED.replace('cb AS', 'cbx AS')}, {ORA.replace('sl AS', 'slx AS').replace('FROM sl)', 'FROM slx)')},
p1 AS (SELECT model || '/' || k AS subject, round(auc_plot, 9) AS v FROM cbx ORDER BY v DESC, model, k LIMIT 10),
p1b AS (SELECT model || '/' || k AS subject, round(auc_main, 9) AS v FROM mn ORDER BY v DESC, model, k LIMIT 10),
p2 AS (WITH RECURSIVE {TWO_GROUPS}{KS.format(rows='s')}{WALK} SELECT feature_pos::VARCHAR AS subject, round(p_ks, 9) AS v FROM kx ORDER BY v, feature_pos LIMIT 15),
p2b AS (WITH RECURSIVE {MATRIX}, v AS (SELECT feature_pos, cohort, value AS score FROM m){KS.format(rows='v')}{WALK}
        SELECT feature_pos::VARCHAR AS subject, round(p_ks, 9) AS v FROM kx ORDER BY v, feature_pos LIMIT 15),
p3 AS (SELECT term AS subject, round(p, 9) AS v FROM orx ORDER BY v, term_order LIMIT 20)
SELECT 'parameters' AS section, NULL::VARCHAR AS mode, unnest(['term=nation_1', 'top_n=100']) AS subject, NULL::DOUBLE AS number
UNION ALL SELECT 'performance', 'scores', subject, round(v, 6) FROM p1 UNION ALL SELECT 'performance', 'betas', subject, round(v, 6) FROM p1b
UNION ALL SELECT 'tests', 'scores', subject, round(v, 6) FROM p2 UNION ALL SELECT 'tests', 'betas', subject, round(v, 6) FROM p2b
UNION ALL SELECT 'ora', NULL, subject, round(v, 6) FROM p3"""
