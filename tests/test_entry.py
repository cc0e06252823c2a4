"""Driver contract: entry() runs; every query has a name-matched twin or is
listed as rows-only."""
import re

import __spark_entry__ as E

ROWS_ONLY = set()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"page_id", "url", "markdown", "html_chars", "md_chars", "saving_pm"}


def test_registry_consistent():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    own = {n for n in set(qs) - set(sql) if not re.match(r"op\d+_|pipeline$", n)}  # those are tested by brute force
    assert own == ROWS_ONLY
