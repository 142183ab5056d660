import re
from pathlib import Path

import __spark_entry__ as entry


def test_names_and_statements():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and {"p1_found", "p3_found", "p4_found"} <= set(q)
    assert len([n for n in q if n.startswith("feat_")]) >= 65


def test_entry_runs(spark, data):
    assert entry.entry(spark).limit(5).count() == 5


def test_llm_is_imported_by_nothing_else():
    root = Path(entry.__file__).parent / "tidegrid"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"tidegrid\.llm|from \.+llm", p.read_text()), p
