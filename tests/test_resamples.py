"""The registered resampling queries take the reference's number of resamples."""

from querylens import catalog, plans  # noqa: F401
from querylens.operators import inference

SF = "/root/testdata/sf0.001"


def test_queries_take_ten_thousand_resamples(spark, monkeypatch):
    asked = []
    for name in ("bootstrap_interval", "sign_randomization"):
        whole = getattr(inference, name)
        monkeypatch.setattr(inference, name, lambda groups, samples, whole=whole: asked.append(samples) or whole(groups, samples))
    interval = catalog.QUERIES["bootstrap_ci"](spark, SF).first()
    p = catalog.QUERIES["sign_randomization"](spark, SF).first()["p"]
    assert asked == [10_000, 10_000] and interval["low"] < interval["high"]
    assert abs(p * 10_001 - round(p * 10_001)) < 1e-6
