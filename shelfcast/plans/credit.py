"""Credit scores end to end: logistic and neural models on the same prepared tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from shelfcast.operators.credit import (
    LOGIT_TERMS,
    Logit,
    MlpEnsemble,
    fit_logit,
    fit_mlp_ensemble,
    prepare_applicants,
    stepwise_aic,
)
from shelfcast.operators.evaluate import hit_table
from shelfcast.operators.filters import hash_split
from shelfcast.schema import APPLICANT_CATEGORIES, APPLICANT_NUMBERS
from shelfcast.session import cut_lineage

PREDICTORS = (*APPLICANT_NUMBERS, *APPLICANT_CATEGORIES)


@dataclass(frozen=True)
class CreditScores:
    """Scored test rows, the validation hit table, the models and the prepared training rows."""

    scores: DataFrame
    hits: DataFrame
    logit: Logit
    networks: MlpEnsemble | None
    ready: DataFrame


def score_applicants(
    train: DataFrame, test: DataFrame, select_terms: bool = False, networks: int = 0, fraction: float = 0.7
) -> CreditScores:
    """Check a logistic model on a split of the training rows, refit it on all, score the test rows.

    The prepared training table is written once; every fit after it reads the written copy.
    """
    ready, rows = prepare_applicants(train, test, PREDICTORS)
    ready = cut_lineage(ready)
    terms = [t for t in LOGIT_TERMS if t in ready.columns]
    fitted, held = hash_split(ready, fraction)
    if select_terms:
        terms = list(stepwise_aic(fitted, terms)[0].terms)
    hits = hit_table(fit_logit(fitted, terms).score(held), "probability", "target_flag")
    logit = fit_logit(ready, terms)
    scores = logit.score(rows.drop("target_flag"), "p_target_flag")
    mlp = None
    if networks:
        mlp = fit_mlp_ensemble(ready, terms, fits=networks)
        scores = mlp.score(scores, "p_target_flag_network")
    return CreditScores(scores, hits, logit, mlp, ready)
