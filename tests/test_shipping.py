"""Workers find the package wherever the driver was started."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from dawnchorus.session import shared_dir

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from dawnchorus.plans.catalog import QUERIES
from dawnchorus.session import build_session
spark = build_session("local[2]", 2)
for name in ("species_kendall", "top_trend"):
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_with_python_workers_from_another_folder():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = str(Path(__file__).resolve().parent.parent)
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd="/", env=env, capture_output=True,
                         text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert "species_kendall 20" in run.stdout and "top_trend" in run.stdout


class _Cluster:
    """What shared_dir asks of a session, as on a cluster without a shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        shared_dir(_Cluster)
