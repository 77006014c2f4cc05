"""Every query with an oracle matches DuckDB on the smallest scale (the
driver runs the same comparison at sf0.01)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from conftest import SF_SMALL  # noqa: E402

SQL = E.oracle_sql()
SKIP_SMALL = {"model_report", "scored_rows"}  # rows-only, trained separately


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from adflow.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


#: Every query of the catalogue; a query may join the list, none may leave it.
CATALOGUE = """
ad_status_changes advertiser_stats attributed_ctr attributed_labels attributed_labels_in_window
auction_exploration auction_results budget_filtered calibration_deciles campaign_listing
campaign_spend click_audit click_signatures click_verdicts conversion_attribution
ctr_pair_daily ctr_pair_lookback ctr_rollup dedup_impressions device_class
downsample_counts downsampling_correction eligible_counts enriched_clicks eval_metrics
extracted_click_urls feature_vectors fill_report first_clicks gate_baseline
impression_event_json impression_facts impression_log ingest_outcomes insert_absent
inventory_summary ips_ctr key_hashes late_events model_report
no_fill orphan_clicks orphan_conversions overspend page_keywords
parsed_clicks parsed_conversions parsed_impressions point_in_time_ctr point_in_time_ctr_bucketed
policy_report publisher_stats publisher_validation purge_prefix reconcile_drift
reconciled_ledger redacted_urls refused_model_auction rejected_ads rejected_campaigns rejected_conversions
rejected_requests rejected_status_changes rekey_spend rekey_unmapped retention
retention_log scored_rows servable_ads signed_urls smoothed_priors
spend_drift status_changes stream_auction_results stream_ctr_pair stream_dedup
stream_ingest stream_labels stream_spend time_split_sizes uuid_checks
""".split()


def test_contract_shapes():
    qs = E.queries()
    assert set(SQL) <= set(qs)
    assert sorted(n for n in qs if n != "pipeline" and not n.startswith("op")) == sorted(CATALOGUE)
    assert {n for n in CATALOGUE if n not in SQL} == SKIP_SMALL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    from oracle_check import digest

    got = digest(E.queries()[name](spark, SF_SMALL).toPandas())
    want = digest(duck.execute(SQL[name]).df())
    assert got[1] == want[1], "column names differ"
    assert got[0] == want[0], "row counts differ"
    assert got[2] == want[2], "values differ"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "request_id" in df.columns
