"""Queries that run operators as a job would, with the operators' own defaults."""

from curbsight.plans import catalog


def test_models_are_trained_with_the_defaults(spark, sf):
    """A real run of one task: forest size, depth limit and tuned threshold of the fast mode."""
    run = catalog.fast_runs(spark, sf, ("closure",))["closure"]
    forest = run["model"].stages[-1]
    assert forest.getNumTrees == 120 and 10 <= max(t.depth for t in forest.trees) <= 16
    assert run["params"] == catalog.S.FAST_FOREST and run["threshold"] != 0.5
    assert run["n_test"] == run["held_out"].count() > 0
    top = catalog.feature_importance(spark, sf).first()
    assert tuple(run["importances"][0]) == (top.feature, top.importance)


def test_boosted_forecast_has_the_default_rounds(monkeypatch):
    seen = []
    monkeypatch.setattr(catalog, "_series", lambda spark, sf: "series")
    monkeypatch.setattr(catalog, "_two_places", lambda df: df)
    monkeypatch.setattr(catalog.FC, "forecast_gbt", lambda series, **options: seen.append(options))
    catalog.forecast_gbt(None, "folder")
    assert seen == [{}]


def test_json_records_cover_the_whole_table(spark, sf, monkeypatch):
    table = spark.range(700).selectExpr("id", "CAST(NULL AS STRING) AS zone")
    monkeypatch.setattr(catalog, "features_of", lambda spark, sf: table)
    assert catalog.json_records(spark, sf).count() == 700
