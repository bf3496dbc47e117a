"""The driver contract, and the schema gate."""

import __spark_entry__ as entry
import pytest
from pyspark.sql import types as T

from ledgerkeel.checks import QUERIES
from ledgerkeel.errors import StateError
from ledgerkeel.operators import ledger, validate
from ledgerkeel.session import scratch_path


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "o_orderkey" in df.columns
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(QUERIES) <= set(oracles)


def test_every_inventory_name_is_registered():
    names = """jsonl_scan jsonl_sink ordered_table_scan payload_scan ledger_scan applied_scan version_of companion_entry
    normalize_entry filter_entries check_ledger_paths status_basename status_path path_style utf8_check ensure_newline
    payload_digest text_digest render_json_value split_sections section_has_content excerpt observed_keys unknown_columns
    schema_gate json_row_check apply_insert apply_replace apply_replace_empty apply_upsert apply_upsert_composite
    delete_matching apply_dataset apply_report export_dataset roundtrip_check build_steps chain_hash build_ledger
    zero_ledger ledger_state check_header check_group check_head_digest orphan_snapshots new_in_input missing_from_input
    compare_steps check_sequential check_head duplicate_ledger_steps duplicate_entries is_clean fatal_diagnostics
    first_divergence ledger_divergence state_divergence prefix_check live_relation anchor_tail select_anchor expected_at
    drift plan_summary plan_rows plan_diff schema_plan line_diff verify_expected replay_tail capture_checkpoints
    rollback_roundtrip bootstrap apply_pending rollback carry_forward publish_delta desired_artifacts apply_result
    check_delta_overlap audit_directives audit_duplicate_versions audit_version_order audit_utf8 audit_no_up
    audit_basenames audit_down audit_flag audit_ledger audit_state audit_report""".split()
    assert set(names) <= set(entry.queries())


def test_schema_gate():
    live = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    for declared in (
        T.StructType([live[1], live[0]]),
        T.StructType([live[0]]),
        T.StructType([live[0], live[1], live[1]]),
        T.StructType([T.StructField("a", T.LongType(), False), live[1]]),
        T.StructType([T.StructField("a", T.IntegerType()), live[1]]),
    ):
        with pytest.raises(StateError):
            validate.require_schema(live, declared, "apply")
    validate.require_schema(live, live, "apply")


def test_scratch_is_below_the_named_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "x")
    assert path != scratch_path(spark, "x")
    assert base is None or path.startswith(base.rstrip("/") + "/")


def test_entries_without_payload(spark, rows):
    df = spark.createDataFrame([("g", "./migrations/a.sql"), ("g", "migrations/a.sql")], "grp string, entry string")
    assert rows(ledger.filter_entries(df)[0]) == [("g", "migrations/a.sql")]
