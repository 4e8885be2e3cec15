"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of test tables, BENCH_CPUS the local cores. Every query runs from
the raw tables to its last row, so the derivation of plays is part of each time.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

HEADLINE = (
    "receiver_relative", "team_pass_run", "third_and_long", "passer_epa_all", "low_win_prob_first",
    "player_plays", "offense_strength", "defense_strength", "stratified_split", "completion_score",
    "xry_model", "rusher_over_expected", "player_ratings", "passer_split", "mixed_backward_step",
    "cv_backward_subset", "line_rating", "war_fitted", "war_career",
)


def main() -> None:
    from yardframe.catalog import registry
    from yardframe.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(HEADLINE)
    spark = build_session(f"local[{cpus}]", "yardframe-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["agg_count"](spark, folder).collect()  # start the workers and read the footers
    seconds = {}
    for name in names:
        start = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
