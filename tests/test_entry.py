"""The driver's entry without the libraries that only the corpus operators need."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_corpus_libraries():
    code = ("import sys\nfor m in ('tiktoken', 'regex', 'xxhash', 'public_tokenizers'): sys.modules[m] = None\n"
            "import __spark_entry__ as e\nprint(len(e.queries()), any(n.startswith('op1') for n in e.queries()), 'logo_folds_group' in e.oracle_sql())")
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    count, has_llm, has_core = said.stdout.split()
    assert int(count) > 100 and has_llm == "False" and has_core == "True", said.stderr
