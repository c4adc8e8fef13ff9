import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_works_without_the_optional_subpackage(tmp_path):
    """Without that folder the module still imports and keeps all other queries."""
    for name in ("veritab", "verification", "__spark_entry__.py"):
        source, target = ROOT / name, tmp_path / name
        if source.is_dir():
            shutil.copytree(source, target, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, target)
    code = "import __spark_entry__ as e; print(len(e.queries()), all(k in e.queries() for k in e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"} | {k: v for k, v in __import__("os").environ.items() if k not in ("PYTHONPATH",)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    count, twins, optional = said.stdout.split()
    assert int(count) > 80 and twins == "True" and optional == "False"


def test_nothing_else_imports_the_optional_subpackage():
    found = [
        p for folder in ("veritab", "verification", "tests") for p in (ROOT / folder).rglob("*.py")
        if "llm" not in p.parts and p.name != "test_entry.py" and "veritab.llm" in p.read_text()
    ]
    assert found == [] and "veritab.llm" not in (ROOT / "bench.py").read_text()
