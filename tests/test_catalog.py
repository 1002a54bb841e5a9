"""Every catalogue query gives what its SQL gives, or rows where there is no SQL."""

import pytest

import compare
from lexmill.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert compare.differences(catalog.queries()[name](spark, sf_dir), compare.connection(sf_dir), SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_needs_no_optional_part():
    """Nothing but the driver entry names the optional subpackage."""
    import pathlib

    root = pathlib.Path(catalog.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "lexmill.llm" not in path.read_text(), path
