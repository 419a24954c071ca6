"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from sentrylake.session import local_session
from sentrylake.workloads import all_cases

HEADLINE = ["cred_bruteforce", "cred_spray", "cred_success_after_failures", "scan_horizontal", "lateral_move", "c2_beacon", "exfil_dns",
            "exfil_volume", "vpn_pivot", "logon_brute", "c2_transfer", "pkt_scan_vertical", "pkt_hosts", "pkt_conversations",
            "mail_header_rules", "parse_firewall", "net_summary_counts", "indicators"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    cases = {c.name: c for c in all_cases()}
    spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count().collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        cases[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
