"""bench.py contract: one JSON line with metric, value, unit, queries, sf."""

import json
import os
import subprocess
import sys

from tests.conftest import SF001

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR=SF001, BENCH_REPEAT="1", BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py"), "extract_tuples", "hierarchy_codes"],
                         env=env, capture_output=True, text=True, timeout=600, cwd=ROOT)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert out.returncode == 0 and len(lines) == 1, out.stderr[-2000:]
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == 0.001 and set(d["queries"]) == {"extract_tuples", "hierarchy_codes"}
    assert abs(d["value"] - sum(d["queries"].values())) < 1e-6 * 10 + 0.01
