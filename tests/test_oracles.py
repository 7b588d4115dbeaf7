"""Queries against their DuckDB statements."""

import pandas as pd
import pytest
from tests.conftest import DATA

from tomolake.plans import more_queries, table_queries, voxel_queries  # noqa: F401
from tomolake.plans.registry import ORACLES, QUERIES

SOME = ["a01_material_statistics", "a03_otsu", "a08_particles", "a13_pore_size_distribution", "a23_local_pore_size", "a24_t2_distribution", "a25_relaxation_summary", "f08_apparent_permeability", "f09_axial_pressures", "f14_poroelastic", "f17_fracture_probability", "f35_strain_from_pressure", "a29_glcm_features", "a30_lbp_histogram", "c02_components", "c05_remove_islands", "g06_orthogonal_selection", "g19_fill_between", "g22_smooth_mask", "g27_mask_fusion", "g33_box_points", "j06_connectable_pairs", "j13_density_from_gray", "k02_pressure_models", "n02_gaussian_3d", "n05_median_3d", "n10_sobel_3d", "r03_resample_gray", "v06_arrivals_and_velocities", "w08_run_lengths", "w12_envelope", "k07_youngs_modulus", "k09_yield", "k11_mohr_coulomb_power", "j16_vp_vs_by_density", "x01_bands_of_three_views", "x02_variance_bands", "x04_relaxation_response", "x05_permeability_comparison", "x06_best_planes", "c08_pores_from_particles", "g26_core_radius"]


def plain(x):
    if x is None or pd.isna(x):
        return None
    x = x.item() if hasattr(x, "item") else x
    return int(x) if isinstance(x, float) and x == int(x) else x if isinstance(x, (int, float)) else str(x)


def rows(df: pd.DataFrame) -> list:
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_query_matches_statement(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)


def test_every_statement_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
