import ast
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "tidelens").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), p


def test_works_without_the_corpus_operators(tmp_path):
    """A copy without the subpackage and the pipeline still has the other queries."""
    import shutil

    for name in ("tidelens", "__spark_entry__.py"):
        src = ROOT / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "tidelens" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'AGG14' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)


def test_works_without_a_library_of_the_corpus_operators(tmp_path):
    """Where a compressor cannot be imported, the other queries still are there."""
    (tmp_path / "zstandard.py").write_text("raise ImportError('not there')")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'AGG14' in q and not any(k.startswith('op') for k in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{ROOT}"}, timeout=120)
