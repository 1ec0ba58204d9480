"""Headline timings.  Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from touchline.plans import archive, corrections, feed, match, narrative, probability, tables
from touchline.plans.fixture import table
from touchline.session import build, scratch
from touchline.sources import archive as AR


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
                              "spark.driver.memory": os.environ.get("BENCH_MEM", "12g"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def run(name, fn):
        t0 = time.perf_counter()
        fn().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)

    t0 = time.perf_counter()
    for v in ("match_events", "matches", "corrections", "results_region", "posts"):
        table(spark, d, v)
    times["derive_inputs"] = round(time.perf_counter() - t0, 3)
    events, dates = table(spark, d, "match_events"), table(spark, d, "matches").select("match_id", "match_date")
    n_events, n_matches = events.count(), dates.count()
    root, flat = scratch(spark, "bench-archive"), scratch(spark, "bench-compact")
    t0 = time.perf_counter()
    AR.write(AR.conform(events.join(dates, "match_id")), root)
    times["archive_build"] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    AR.cluster_by_player(AR.read(spark, root), flat)
    times["archive_compact"] = round(time.perf_counter() - t0, 3)

    scan = lambda: AR.read(spark, root)
    LB, SH = archive.LB, archive.SH
    for m in LB.RANKED:
        run(f"leaderboard_{m}", lambda m=m: LB.leaderboard(LB.player_match(scan(), (m,)), m))
    run("archive_count", lambda: LB.archive_size(scan()))
    run("shots_outside_box", lambda: SH.shots(scan(), outside_box=True, limit=5000))
    run("shots_outside_box_by_player", lambda: SH.outside_box_by_player(scan()))
    run("player_career_compacted", lambda: LB.player_seasons(LB.player_match(AR.read(spark, flat).filter("player_id = '105'"))))
    run("player_seasons_all", lambda: LB.player_seasons(LB.player_match(scan())))
    sets = {
        "match_state": corrections.match_state, "score_changes": corrections._changes, "team_metrics": match.team_metrics, "pass_edges": match.pass_edges,
        "timeline": match.timeline, "minute_features": probability.features, "elo": probability.elo_region, "standings_liga": tables._standings("LIGA"),
        "standings_ucl_group": tables._standings("UCL_GROUP"), "moments": narrative.moments, "report": narrative.reports,
        "topics": feed.classify, "entities": feed.entities, "trends": feed.trends,
    }
    for name, fn in sets.items():
        run(name, lambda fn=fn: fn(spark, d))
    total = round(sum(times.values()), 3)
    refold = times["match_state"]
    print(json.dumps({"metric": "total headline query time", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(d).removeprefix("sf"),
                      "events": n_events, "matches": n_matches, "refold_matches_per_s": round(n_matches / refold, 1), "refold_events_per_s": round(n_events / refold, 1)}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
