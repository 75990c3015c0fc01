import subprocess
import sys

from tests.conftest import ROOT


def test_entry_imports_without_a_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=ROOT, check=True)
