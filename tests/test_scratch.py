"""The shared folder, with and without the cluster's setting."""

import subprocess
import sys
from pathlib import Path

from trialframe.sources import scratch

_WITHOUT = """
from trialframe.session import local_session
from trialframe.sources import scratch
spark = local_session(2, "unset")
real = spark.conf.get
class Unset:
    def get(self, key, default=None):
        return default if key == "spark.checkpoint.dir" else real(key, default)
class Session:
    conf, sparkContext, read = Unset(), spark.sparkContext, spark.read
folder = scratch.shared_folder(Session())
assert folder == scratch.shared_folder(Session())
spark.range(5).write.parquet(scratch.fresh_path(Session(), "t"))
print("rows", spark.read.parquet(folder + "/t-*").count())
"""


def test_setting_absent():
    root = Path(__file__).resolve().parents[1]
    said = subprocess.run([sys.executable, "-c", _WITHOUT], cwd=root, capture_output=True, text=True, timeout=300)
    assert "rows 5" in said.stdout, said.stderr[-2000:]


def test_scope_drops_what_it_made(spark):
    with scratch.scratch_scope(spark) as made:
        kept = scratch.stored(spark.range(3), "scope")
        assert kept.count() == 3 and len(made) == 1
    folder = Path(made[0].removeprefix("file:"))
    assert not folder.exists()
