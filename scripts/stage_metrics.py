"""Run registered queries with Spark's event log in a scratch folder and
report, per query: wall time (query built and written to a ``noop`` sink),
output rows, tasks, shuffle bytes written and read, spill bytes (summed over
the query's tasks).

usage: python scripts/stage_metrics.py <sf_dir> <query> [<query> ...]
"""

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from claimtext.plans import catalog  # noqa: E402
from claimtext.session import ensure_checkpoint_dir  # noqa: E402


def main():
    sf = sys.argv[1]
    names = sys.argv[2:]
    logdir = tempfile.mkdtemp(prefix="run-eventlog-")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", f"file://{logdir}")
             .config("spark.eventLog.compress", "false")
             .config("spark.sql.shuffle.partitions", "16").config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             .config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("claimtext.scan.partitions", str(2 * int(cpus)))
    ensure_checkpoint_dir(spark)
    marks = []
    for name in names:
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.perf_counter()
        df = catalog.QUERIES[name](spark, sf)
        # materialise every column: a count() would let Catalyst drop work
        # (e.g. a left join whose right columns are unused)
        df.write.format("noop").mode("overwrite").save()
        sec = time.perf_counter() - t0
        spark.sparkContext.setJobGroup("_rows", "_rows")
        marks.append((name, sec, df.count()))
    spark.stop()
    stats = {m[0]: {"tasks": 0, "shuffle_write": 0, "shuffle_read": 0, "spill": 0} for m in marks}
    job_group, stage_group = {}, {}
    stage_info = {}
    for path in sorted(glob.glob(os.path.join(logdir, "**", "events_*"), recursive=True)
                       + glob.glob(os.path.join(logdir, "*.json"))):
        if os.path.isdir(path):
            continue
        with open(path, encoding="utf-8") as f:
            for line in f:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    g = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = g
                elif kind == "SparkListenerStageCompleted":
                    si = ev["Stage Info"]
                    dur = (si.get("Completion Time", 0) - si.get("Submission Time", 0)) / 1000
                    stage_info[si["Stage ID"]] = (dur, si.get("Number of Tasks"), si.get("Stage Name", "")[:60])
                elif kind == "SparkListenerTaskEnd":
                    g = stage_group.get(ev.get("Stage ID"))
                    tm = ev.get("Task Metrics") or {}
                    if g in stats:
                        s = stats[g]
                        s["tasks"] += 1
                        s["shuffle_write"] += (tm.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                        r = tm.get("Shuffle Read Metrics") or {}
                        s["shuffle_read"] += r.get("Remote Bytes Read", 0) + r.get("Local Bytes Read", 0)
                        s["spill"] += tm.get("Disk Bytes Spilled", 0)
    for name, sec, n in marks:
        print(json.dumps({"query": name, "sec": round(sec, 3), "rows": n, **stats[name]}))
        if os.environ.get("STAGES"):
            top = sorted(((v, k) for k, v in stage_info.items() if stage_group.get(k) == name), reverse=True)[:30]
            for (dur, ntasks, sname), sid in top:
                print(f"   stage {sid:4d} {dur:6.2f}s tasks={ntasks} {sname}")


if __name__ == "__main__":
    main()
