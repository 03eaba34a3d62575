"""A share of the named queries against their SQL twins at the smallest scale; `tools/check_queries.py` runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from tools.check_queries import TABLES, canon

SF = "/root/testdata/sf0.001"
NAMES = (
    "reconcile_printed fire_table snapshot_diff triage_merge recall_table oracle_score one_to_one_match missing_lines intensity_outliers best_candidate replicate_stats normalise_to_anions "
    "compatibility_index noise_sigma composite_median trimmed_windows identify_bands fuzzy_match structural_relatives group_closure match_citations crossref_check bond_valence_sums powder_pattern "
    "fit_cell fit_cell_systems rule_symmetry radiation_verdict pair_sources stated_bands feature_flags formula_groups diagnosis_confusion finding_keys rule_pack rule_printed_lines formula_differences "
    "species_mentions search_names compare_refinement_numbers probe_table snapshot_round_trip dimension_json registered_rule "
    "merge_obs_calc stated_against_fitted rule_phrases formula_coefficients formula_findings diagnose_columns context_of_cells radiation_in_text broken_names reader_transitions"
).split()
#: what hangs on the words of real texts is held against its SQL on more of them
ON_MORE = {"species_mentions": "/root/testdata/sf0.01"}


@pytest.fixture(scope="module")
def cons():
    out = {}
    for sf in {SF, *ON_MORE.values()}:
        out[sf] = duckdb.connect()
        for table in TABLES:
            out[sf].execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, cons, name):
    sf = ON_MORE.get(name, SF)
    df = entry_points.queries()[name](spark, sf)
    cursor = cons[sf].execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon(df.collect(), df.columns) == canon(cursor.fetchall(), columns)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
