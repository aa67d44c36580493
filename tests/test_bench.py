"""bench.py prints one JSON line with a time for every headline query."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_line():
    own = os.environ | {"BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "4"}
    done = subprocess.run([sys.executable, f"{ROOT}/bench.py"], capture_output=True, text=True, env=own, timeout=1200, check=True)
    (line,) = done.stdout.strip().splitlines()
    told = json.loads(line)
    assert told["unit"] == "sec"
    assert told["value"] > 0
    assert "tile_coverage" in told["queries"]
    assert all(t > 0 for t in told["queries"].values())
