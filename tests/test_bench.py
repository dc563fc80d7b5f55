from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_bench_prints_one_json_line():
    env = {**os.environ, "BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "4"}
    out = subprocess.run(
        [sys.executable, "bench.py"],
        cwd=ROOT,
        env=env,
        stdout=subprocess.PIPE,
        text=True,
        check=True,
        timeout=900,
    ).stdout
    (line,) = out.strip().splitlines()
    report = json.loads(line)
    assert set(report) == {"metric", "value", "unit", "queries", "sf", "cold"}
    assert report["unit"] == "sec" and report["sf"] == 0.001
    assert set(report["queries"]) == set(__spark_entry__.queries())
    assert all(seconds > 0 for seconds in report["queries"].values())
