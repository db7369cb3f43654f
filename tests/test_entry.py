"""The driver's contract, with and without the llm subpackage."""

import __spark_entry__ as entry


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {f"p{n}_found" for n in (2, 3, 4, 5, 6)} <= set(queries)


def test_core_does_not_import_llm():
    from pathlib import Path

    root = Path(entry.__file__).parent / "strandwise"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "strandwise.llm" not in p.read_text()
