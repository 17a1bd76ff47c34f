"""The shared folder of intermediate tables."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from quern.session import clear_shared, local_session, shared_dir
spark = local_session(1, "shared")
path = shared_dir(spark, "rows")
spark.range(3).write.parquet(path)
n = spark.read.parquet(path).count()
clear_shared(spark)
print(path, n)
"""


@pytest.mark.parametrize("setting", ["", "spark.checkpoint.dir {}/shared"])
def test_shared_dir(tmp_path, setting):
    """The folder that the session names, or one of this machine where it names none (the setting cannot be changed in a running session)."""
    (tmp_path / "spark-defaults.conf").write_text(setting.format(tmp_path))
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path), "PYTHONPATH": ROOT}
    out = subprocess.run([sys.executable, "-c", CODE], env=env, cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    root = "shared" if setting else "quern-shared"
    assert out[0].startswith(f"file://{tmp_path}/{root}/rows-") and out[1] == "3"
