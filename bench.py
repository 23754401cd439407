"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vacancia.catalog import load_all  # noqa: E402
from vacancia.session import build_session  # noqa: E402

HEADLINE = [
    "plan_ranked_new_postings", "tgt08_fit", "flt02_location_filter", "jon01_unseen_urls", "jon06_mirrors", "jon09_addition_match",
    "jon15_best_role_url", "jon23_reposts", "dup01_same_url", "dup02_apply_links", "dup06_snapshot_dedup", "dup08_tracker_clusters",
    "win05_first_better", "win08_top_titles", "agg04_archetypes", "agg08_recommendations", "agg17_mined_boards", "enr01_skills",
    "enr03_experience", "enr08_mode_precedence", "src01_json_feed", "txt_b_strip_html",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    spark = build_session("bench")
    registry = load_all()
    registry["agg01_funnel"].run(spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeat):
            start = time.perf_counter()
            registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
