"""Print the executed (post-AQE) physical plan of registered queries, keeping
the lines that matter for scale: scans with their pushed filters and pruned
columns, exchanges, join strategies, aggregates and pruning.

    python tests/show_plans.py [sf_dir] [key ...] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEP = re.compile(r"Scan|Exchange|Join|Aggregate|TakeOrdered|Window|Generate|Expand|Sort |"
                  r"dynamicpruning|BroadcastExchange|Union|Filter|Checkpoint|LogicalRDD")
DEFAULT = ["scan_where", "count_where", "scan_page", "sync_full", "sync_upsert", "reconcile",
           "committed_only", "catalog_state", "table_metadata", "profile_numeric", "profile_text",
           "table_sync_status", "queue_stats", "artifact_touch", "artifact_all_tags", "sql_join_revenue"]


def main():
    from cairn.session import build_session
    import __spark_entry__ as E
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    keys = sys.argv[2:] or DEFAULT
    spark = build_session("local[8]", 16)
    qs = E.queries()
    print(f"# Executed plans ({os.path.basename(sf)}, local[8], 16 shuffle partitions)\n")
    print("Generated by `tests/show_plans.py`: the final adaptive plan of each query after it ran,")
    print("reduced to scans (pushed filters, read schema), exchanges, joins and aggregates.\n")
    for k in keys:
        df = qs[k](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"## {k}\n\n```")
        for line in plan.splitlines():
            if KEEP.search(line):
                line = re.sub(r"#\d+L?", "", line)
                line = re.sub(r"Location: InMemoryFileIndex\([^)]*\)\[[^\]]*\], ", "", line)
                print(line.rstrip()[:230])
        print("```\n")


if __name__ == "__main__":
    main()
