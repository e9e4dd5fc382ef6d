"""Every query of the engine's own operators against its SQL."""

import pytest

from compare import difference, views
from lexforge.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return views(SF)


def test_every_query_has_sql_but_for_the_encoder():
    assert catalog.queries().keys() - catalog.oracle_sql().keys() == {"bpe_encode", "placed_blocks", "shared_filler", "dense_examples", "dense_counters", "bpe_merges"}  # held against plain Python


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sql, name):
    assert difference(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], sql) == ""


def test_entry_stands_without_the_part_that_can_be_left_out():
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_that_part():
    from pathlib import Path

    root = Path(__file__).parent.parent / "lexforge"
    for path in root.rglob("*.py"):
        if root / "llm" not in path.parents:
            assert "lexforge.llm" not in path.read_text(), path
