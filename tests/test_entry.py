import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in BLOCKED:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name.split(".")[0])
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert len(e.queries()) > 70 and set(e.oracle_sql()) <= set(e.queries())
assert not any(n.startswith("op") or n == "pipeline" for n in e.queries())
"""


@pytest.mark.parametrize("missing", [("llm", "corpus_pipeline"), ("ahocorasick",), ("public_tokenizers",), ("xxhash",)])
def test_entry_works_without_the_optional_operators(missing):
    subprocess.run([sys.executable, "-c", f"BLOCKED = {missing!r}\n{BLOCKED}"], cwd=ROOT, check=True, timeout=120)
