"""Queries against their SQL in DuckDB. GENOQUERY_ALL=1 runs all of them, else one of each family."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from genoquery.plans import queries as plans

SQL = plans.oracle_sql()
SOME = [
    "a1_accession_counts", "a2_grand_totals", "a8_a9_expected_by_accession", "a10_histogram", "a16_compare_pairs", "f2_marker_filter", "f5_rectify_markers", "f10_quadrants", "f11_distinct_ids",
    "p_pairs", "p_reference_pairs", "p6_filtered_pairs", "p15_phase_switches", "c3_c4_components", "c10_ordered_wide", "u3_vote_wide", "u4_u7_unique_pedigrees", "h2_candidates_by_role",
    "h10_h11_expected_hgmr", "t1_t7_triple_statistics", "t12_t13_t15_direction", "q6_q7_q8_level2", "q12_other_pairs", "x2_parent_crossovers", "x4_phase_correction", "x8_triple_quality",
    "d2_two_means", "d4_jenks", "g2_ancestors", "g4_random_pedigrees", "s1_s7_vcf_scan", "s8_s9_vcf_filters", "s12_s13_matrix_scan", "s19_distance_matrix",
    "d1_left_boundary", "x3_two_parents", "q11_pedigree_test", "s22_bad_tokens", "h9_normalizing_means", "w2_duplicate_finder",
]


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted([tuple(value(r[i]) for i in order) for r in rows], key=str)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("GENOQUERY_ALL") else SOME)
def test_query(spark, duck, small, name):
    found = plans.queries()[name](spark, small)
    wanted = duck.execute(SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    assert plain([tuple(r) for r in found.collect()], found.columns) == plain(wanted.fetchall(), columns)


def test_every_query_has_a_name_of_its_own():
    assert set(SQL) <= set(plans.queries())
