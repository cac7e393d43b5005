"""What the entry module registers for this subpackage."""

import re


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14))
    assert "pipeline" in names and not {n for n in __spark_entry__.oracle_sql() if n not in names}
