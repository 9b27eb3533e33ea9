"""What executors get: functions of the plans must work with the shipped sources alone."""

import base64
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.core.files import SparkFiles

from veilmark import ship


@pytest.fixture
def shipped(spark):
    """Runs ``use(f)`` in an interpreter of its own, which has the shipped file and no other sources of this package; tells what it prints."""
    ship(spark)
    (path,) = Path(SparkFiles.getRootDirectory()).glob("veilmark*.zip")

    def run(f, use: str, cwd: Path) -> str:
        code = f"import base64, sys; sys.path.insert(0, {str(path)!r}); from pyspark import cloudpickle; f = cloudpickle.loads(base64.b64decode({base64.b64encode(cloudpickle.dumps(f)).decode()!r})); print({use})"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-c", code], cwd=cwd, env=env, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
        return done.stdout.strip()

    return run


def test_detector_of_ones_own(shipped, tmp_path):
    from veilmark.plans import derived

    words = derived._word_list({"words": ["the"]})
    assert shipped(words, "list(f().eval('see The thing'))", tmp_path) == "[(4, 7, 'ORGANIZATION', 0.8)]"


def test_model_of_token_classifier(shipped, tmp_path):
    from veilmark.plans import wider

    assert shipped(wider._stub, "f()(['see Anna'])", tmp_path) == str(wider._stub()(["see Anna"]))
