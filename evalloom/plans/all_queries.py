"""Imports every module that registers queries."""

import functools

from pyspark.sql import functions as F

from evalloom.plans import answer_queries, build_queries, link_queries, report_queries, statistics_queries, study_queries, text_queries, unit_queries  # noqa: F401
from evalloom.plans import registry

#: Columns of floating point numbers, which two engines sum in different orders: both round them to 9 digits, off the ties.
FLOATS = {
    "rate_wilson_by_lang": "rate lo hi",
    "pooled_rate_rollup": "rate lo hi",
    "macro_rate": "macro micro",
    "exposure_grouping_sets": "mean median share_2 mean_partial",
    "token_headroom": "mean",
    "token_ratios": "mean ratio",
    "cell_agreement": "mean_abs_diff share_within",
    "running_position": "position",
    "greedy_fill": "used",
    "cluster_bootstrap_ci": "rate wilson_lo wilson_hi boot_lo boot_hi",
    "permutation_test": "diff p",
    "interaction_bootstrap": "interaction lo hi",
    "macro_bootstrap": "macro lo hi",
    "poisson_bootstrap": "lo hi",
    "detection_draws": "d_prime d_lo d_hi criterion c_lo c_hi",
    "arm_contrasts": "rate_a rate_b diff diff_lo diff_hi p",
    "setting_summary": "tokens passages similarity gold_position",
    "paired_mcnemar": "rate_a rate_b diff diff_lo diff_hi p",
    "fisher_test": "p",
    "holm_adjusted": "p p_holm",
    "mcnemar_grid": "p",
    "kappa_by_lang": "agree kappa",
    "signal_detection": "hit_rate alarm_rate d_prime criterion",
    "normal_quantiles": "z",
    "three_way_split": "refused flagged silent",
}


def _rounded(function, names):
    @functools.wraps(function)
    def run(spark, sf_dir):
        df = function(spark, sf_dir)
        return df.select(*[F.round(F.col(c).cast("double") + 1e-12, 9).alias(c) if c in names else F.col(c) for c in df.columns])

    return run


QUERIES = {name: _rounded(f, FLOATS[name].split()) if name in FLOATS else f for name, f in registry.QUERIES.items()}
ORACLES = {name: f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE) + 1e-12::DOUBLE, 9) AS {c}' for c in FLOATS[name].split())}) FROM ({sql})" if name in FLOATS else sql for name, sql in registry.ORACLES.items()}
