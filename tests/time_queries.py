"""Spark-only timing of registered queries (all rows computed, nothing returned)."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

if __name__ == "__main__":
    from sentrylake.session import local_session
    from sentrylake.workloads import all_cases
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    spark = local_session(8)
    for case in all_cases():
        if args and case.name not in args:
            continue
        t = time.time()
        case.run(spark, sf).write.format("noop").mode("overwrite").save()
        print(f"{case.name:32}{time.time() - t:7.1f}s", flush=True)
