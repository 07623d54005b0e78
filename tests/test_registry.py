"""The driver contract, and a sample of registered queries against their SQL."""

import pytest

import __spark_entry__ as entry_module
from check import compare, database
from planloom.plans import registry

SAMPLE = ["sched_slack_critical", "doc_chunks", "cite_valid", "gap_validate", "val_staffing", "drift_reconcile", "checklist_diff"]


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).columns[:2] == ["project_id", "task_id"]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, small_folder, name):
    frame = entry_module.queries()[name](spark, small_folder)
    outcome = compare(frame, database(small_folder), entry_module.oracle_sql()[name])
    assert outcome.startswith("OK") and "TYPES" not in outcome, outcome
