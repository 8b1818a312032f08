"""Nearest neighbours and density clusters against slow independent versions, on data where
one cell holds a large share of all rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from curbsight import settings as S
from curbsight.operators import components, density, hotspots, spatial_fill


def term(lat1, lon1, lat2, lon2):
    lat1, lon1, lat2, lon2 = map(np.radians, (lat1, lon1, lat2, lon2))
    return (np.sin((lat2 - lat1) / 2) ** 2
            + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2)


def incidents(seed: int, crowd: int = 150, spread: int = 250) -> pd.DataFrame:
    """A third of the rows within some 30 m, copies of one place, a ring, and scattered rows."""
    r = np.random.RandomState(seed)
    lat = np.concatenate([
        12.97 + r.normal(0, 1e-4, crowd), np.full(40, 12.9712), 12.95 + r.uniform(0, .03, spread),
        [13.39, 12.61, 12.97 + 1e-9, 12.97 + 2e-9]])
    lon = np.concatenate([
        77.59 + r.normal(0, 1e-4, crowd), np.full(40, 77.5931), 77.58 + r.uniform(0, .03, spread),
        [77.89, 77.21, 77.59, 77.59]])
    df = pd.DataFrame({"latitude": lat, "longitude": lon})
    df = df.sample(frac=1, random_state=seed).reset_index(drop=True)
    df["ordinal"] = np.arange(len(df), dtype="int64") * 3 + 1
    df["zone"] = [f"Z{i}" if i % 3 == 0 else None for i in range(len(df))]
    df["corridor"] = [f"C{i}" if i % 50 == 0 else None for i in range(len(df))]
    df["event_cause"] = np.where(np.arange(len(df)) % 2 == 0, "pot_holes", "others")
    return df


def slow_dbscan(df, eps, least):
    lat, lon = df.latitude.to_numpy(), df.longitude.to_numpy()
    limit = np.sin(eps / S.EARTH_RADIUS_M / 2) ** 2
    near = term(lat[:, None], lon[:, None], lat[None], lon[None]) <= limit
    core = near.sum(1) >= least
    label, n = np.full(len(df), -1), 0
    for i in np.argsort(df.ordinal.to_numpy()):
        if not core[i] or label[i] != -1:
            continue
        stack = [i]
        label[i] = n
        while stack:
            j = stack.pop()
            if core[j]:
                for k in np.flatnonzero(near[j] & (label == -1)):
                    label[k] = n
                    stack.append(k)
        n += 1
    return label, core


@pytest.mark.parametrize("seed,small_pair", [(1, density.SMALL_PAIR), (2, 1)])
def test_density_clusters_equal_slow_version(spark, monkeypatch, seed, small_pair):
    monkeypatch.setattr(density, "SMALL_PAIR", small_pair)
    pdf = incidents(seed)
    df = spark.createDataFrame(pdf).repartition(5)
    out = hotspots.dbscan(df, ["pot_holes"]).select("layer", "ordinal", "cluster", "is_core").toPandas()
    for layer, rows in (("all", pdf), ("pot_holes", pdf[pdf.event_cause == "pot_holes"])):
        label, core = slow_dbscan(rows, S.EPS_METERS, S.MIN_SAMPLES)
        want = pd.Series(label, index=rows.ordinal).sort_index()
        got = out[out.layer == layer].set_index("ordinal").sort_index()
        assert (got.cluster == want).all()
        assert (got.is_core == pd.Series(core, index=rows.ordinal).sort_index()).all()


def test_cells_that_are_connected_already_are_not_compared(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, 12.9 + y, 77.6 + x) for i, (y, x) in enumerate(rng.uniform(0, 0.008, (3000, 2)).tolist())]
    df = spark.createDataFrame(rows, "ordinal long, latitude double, longitude double")
    asked, listed = [], density._list_pairs
    monkeypatch.setattr(density, "_list_pairs", lambda pairs, *rest: asked.append(
        pairs.filter("need = 1").count()) or listed(pairs, *rest))
    layers = F.array(F.lit("all"))
    out = density.density_clusters(df, layers).label(df, layers)
    assert asked == [0]
    assert out.select("cluster").distinct().collect() == [(0,)]


@pytest.mark.parametrize("small_cell", [spatial_fill.SMALL_CELL, 1])
def test_nearest_label_equals_slow_version(spark, monkeypatch, small_cell):
    monkeypatch.setattr(spatial_fill, "SMALL_CELL", small_cell)
    pdf = incidents(3)
    df = spark.createDataFrame(pdf).repartition(4)
    out = spatial_fill.fill_from_nearest(df, ["zone", "corridor"]).toPandas().set_index("ordinal")
    for field in ("zone", "corridor"):
        have = pdf[pdf[field].notna()]
        for row in pdf[pdf[field].isna()].itertuples():
            d = term(row.latitude, row.longitude, have.latitude.to_numpy(), have.longitude.to_numpy())
            best = have[np.isclose(d, d.min(), rtol=1e-12, atol=0)].sort_values("ordinal")
            assert out.loc[row.ordinal, field] in set(best[field])
        assert (out.loc[have.ordinal, field].to_numpy() == have[field].to_numpy()).all()


def test_only_places_without_a_label_are_searched_and_few_cells_asked(spark, monkeypatch):
    rows = [(i, 12.8 + i % 40 / 500, 77.5 + i // 40 / 500, f"Z{i % 7}") for i in range(1, 400)]
    rows += [(1001, *rows[5][1:3], None), (1002, 12.8501, 77.5003, None), (1003, 13.2, 77.9, None)]
    df = spark.createDataFrame(rows, "ordinal long, latitude double, longitude double, zone string")
    places, levels = [], []
    first, reps = spatial_fill._first_bound, spatial_fill._own_reps
    monkeypatch.setattr(spatial_fill, "_first_bound", lambda p, *rest: places.append(p.count()) or first(p, *rest))
    monkeypatch.setattr(spatial_fill, "_own_reps", lambda p, n, v: levels.append(len(v)) or reps(p, n, v))
    out = {r.ordinal: r.zone for r in spatial_fill.fill_from_nearest(df, ["zone"]).collect()}
    assert places == [2] and levels[0] == 2
    monkeypatch.setattr(spatial_fill, "FEW_CELLS", 0)
    assert out == {r.ordinal: r.zone for r in spatial_fill.fill_from_nearest(df, ["zone"]).collect()}
    for n, lat, lon, _ in rows[-3:]:
        near = min(rows[:-3], key=lambda r: (term(lat, lon, r[1], r[2]), r[0]))
        assert out[n] == near[3]


def test_fill_without_labels_or_places(spark):
    rows = [(1, 12.9, 77.6, None), (2, None, None, None)]
    df = spark.createDataFrame(rows, "ordinal long, latitude double, longitude double, zone string")
    out = spatial_fill.fill_from_nearest(df, ["zone"])
    assert out.count() == 2 and out.filter("zone IS NOT NULL").count() == 0


def test_components_on_a_long_chain_and_a_star(spark):
    chain = [("c", i, i + 1) for i in range(40)]
    star = [("s", 100, i) for i in range(50)] + [("t", 7, 7)]
    edges = spark.createDataFrame(chain + star, "k string, a long, b long")
    vertices = edges.select("k", F.col("a").alias("v")).union(
        edges.select("k", F.col("b").alias("v"))).distinct()
    out = components.components(vertices, edges, ["k"]).toPandas()
    assert set(out[out.k == "c"].root) == {0} and set(out[out.k == "s"].root) == {0}
    assert set(out[out.k == "t"].root) == {7}


def test_hotspots_of_an_empty_table(spark):
    df = spark.createDataFrame(incidents(4).head(5)).withColumn("cause_severity", F.lit(0.5))
    assert hotspots.detect_hotspots(df).count() == 0
