"""The driver imports __spark_entry__ from its own working directory: Python
workers must not need the package on their path."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = f"""
import importlib.util
spec = importlib.util.spec_from_file_location('spark_entry', '{REPO}/__spark_entry__.py')
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '4') \\
    .config('spark.ui.enabled', 'false').getOrCreate()
q = m.queries()
print('COUNTS', q['rate_admit'](spark, '/root/testdata/sf0.001').count(),
      q['login_lockout'](spark, '/root/testdata/sf0.001').count())
"""


def test_python_worker_stages_run_from_another_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True,
                       timeout=600)
    assert "COUNTS 1000 1000" in r.stdout, r.stderr[-2000:]
