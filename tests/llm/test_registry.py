"""What the driver holds against this package: names, SQL, and that nothing else depends on it."""

import ast
from pathlib import Path

import __spark_entry__ as contract

ROOT = Path(__file__).resolve().parents[2]


def test_names():
    found = contract.queries()
    assert [sum(n.startswith(f"op{k}_") for n in found) for k in range(1, 14)] == [1] * 13 and "pipeline" in found
    assert {"op5_quality_rules", "op7_substring_dedup", "op10_nearest", "op11_conversation_trie"} <= set(contract.oracle_sql()) <= set(found)


def test_nothing_else_imports_it():
    for file in ROOT.glob("planmatch/**/*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(file.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith(("planmatch.llm", "corpus_pipeline")) for n in names), file


def test_native_form():
    text = (ROOT / "planmatch/llm/quality_rules.py").read_text()
    assert not any(x in text for x in ("udf", "pandas", "mapIn", "applyIn", ".rdd", "collect("))
