"""The layered protocol: tests of MCAR, evidence of MAR, evidence of MNAR, diagnosis, one report row for each dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.sources.stage import materialize

from . import features as ft
from . import tests as ts
from .diagnose import diagnose_bayes, diagnose_rules, kde_loglik, mcar_vote, score_vector
from .forest import auc_self_delta, mask_auc_permutation, pklm
from .kernels import with_mask
from .nearest import mask_mutual_info
from .patterns import little_mcar

DS = ["dataset_id"]


def mnar_scores(panel: DataFrame, with_forest: bool = True) -> DataFrame:
    """dataset_id, caafe_auc_self_delta, caafe_kl_density, caafe_kurt_excess, caafe_cond_entropy as one record."""
    kurt = ft.moments(panel).select(*DS, F.col("caafe_kurtosis_excess").alias("caafe_kurt_excess"))
    entropy = ft.cond_entropy(panel).select(*DS, F.col("caafe_cond_entropy_X0_mask").alias("caafe_cond_entropy"))
    parts = [ft.kl_density(panel), kurt, entropy]
    if with_forest:
        parts.insert(0, auc_self_delta(panel))
    return reduce(lambda a, b: a.join(b, DS), parts)


def mcar_tests(panel: DataFrame, permutations: int = 200) -> DataFrame:
    """dataset_id, little_p (where Little's test has none, that of the combined Welch tests), pklm_p, pklm_stat, levene_p."""
    keys = panel.select(*DS).distinct()
    little = little_mcar(panel).select(*DS, F.col("little_p").alias("whole_p"))
    proxy = ts.little_proxy(panel).select(*DS, F.col("p").alias("proxy_p"))
    levene = ts.levene_bonferroni(panel).select(*DS, F.col("p").alias("levene_p"))
    forest = pklm(panel, permutations).select(*DS, "pklm_p", "pklm_stat")
    out = keys.join(little, DS, "left").join(proxy, DS, "left").join(forest, DS, "left").join(levene, DS, "left")
    return out.select(*DS, F.coalesce("whole_p", "proxy_p").alias("little_p"), "pklm_p", "pklm_stat", "levene_p")


def scores(panel: DataFrame, permutations: int = 200) -> DataFrame:
    """All scores of the three layers, one row for each dataset; written once, as the rules and the posterior read them.

    The filled panel is written once, too: every family reads it.
    """
    panel = materialize(with_mask(panel.select("dataset_id", "dataset_no", "row_id", *[f"x{k}" for k in range(5)])))
    layers = (mcar_tests(panel, permutations), mask_auc_permutation(panel, permutations), mask_mutual_info(panel), mnar_scores(panel))
    rate = panel.groupBy(*DS).agg(F.round(F.avg(F.when(F.col("x0").isNull() | F.isnan("x0"), 1.0).otherwise(0.0)), 4).alias("missing_rate"))
    return materialize(mcar_vote(reduce(lambda a, b: a.join(b, DS), layers, rate)))


def validate_datasets(panel: DataFrame, permutations: int = 200, thresholds: dict[str, float] | None = None, reference: DataFrame | None = None, bandwidth: float = 1.0) -> DataFrame:
    """The report: scores, verdict of the MCAR tests, prediction, confidence, posterior and rationale for each dataset.

    By rules, or where ``reference`` (label, ref: score vectors of a calibration) is given by kernel-density posteriors.
    """
    s = scores(panel, permutations)
    none = F.lit(None).cast("double")
    if reference is None:
        d = diagnose_rules(s, thresholds).select("*", *[none.alias(f"p_{m}") for m in ("mcar", "mar", "mnar")])
    else:
        d = diagnose_bayes(kde_loglik(score_vector(s), reference, bandwidth))
        d = d.select(*DS, "prediction", "confidence", F.when(F.col("ambiguous"), "posterior, ambiguous").otherwise("posterior").alias("rationale"), "p_mcar", "p_mar", "p_mnar")
    return s.join(d, DS)
