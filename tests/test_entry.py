"""The entry module with and without the subpackage of training-data operators."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def names(folder: Path) -> tuple[set[str], set[str]]:
    out = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, check=True)
    queries, oracles = json.loads(out.stdout.splitlines()[-1])
    return set(queries), set(oracles)


@pytest.mark.parametrize("gone", [("quillstone/llm", "tests/llm"), ("quillstone/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_the_subpackage(tmp_path, gone):
    from quillstone.plans.registry import ORACLES, QUERIES

    whole = tmp_path / "repo"
    shutil.copytree(ROOT, whole, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        place = whole / name
        if place.is_dir():
            shutil.rmtree(place)
        elif place.exists():
            place.unlink()
    queries, oracles = names(whole)
    assert queries == set(QUERIES) and oracles == set(ORACLES)
    # names in the original: all that the registry has, and more only from the subpackage
    assert set(QUERIES) <= names(ROOT)[0]
