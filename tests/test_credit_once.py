"""The credit contract end to end."""

from shelfcast.catalog.credit import credit_contract
from shelfcast.operators import credit as cr
from shelfcast.plans import credit as plan


def test_applicants_are_prepared_once(spark, monkeypatch):
    made = []
    prepare = plan.prepare_applicants
    monkeypatch.setattr(plan, "prepare_applicants", lambda *args: made.append(1) or prepare(*args))
    monkeypatch.setattr(cr, "prepare_applicants", lambda *args: made.append(1) or prepare(*args))
    monkeypatch.setattr(plan, "fit_mlp_ensemble", lambda train, terms, fits: cr.fit_mlp_ensemble(train, terms, fits=1, max_iter=2))
    credit_contract(spark, "/root/testdata/sf0.001").collect()
    assert len(made) == 1
