"""Measure how much of a hot document's work lands in one task.

    python tools/skew_report.py [sf_dir] > SKEW.md

A third of all text pages (and of all binder replies) is moved into one
document; each operator runs with Spark's event log on (in a fresh scratch
folder) and, per stage, the largest share of the stage's rows read by a single
task is reported.  A plan that gathers the hot document in one task shows a
share of 1/3 or more.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import Window
from pyspark.sql import functions as F  # noqa: E402

from pagewright.functions.textfn import page_label, text_tokens  # noqa: E402
from pagewright.operators import budget, combine, paging  # noqa: E402
from pagewright.operators.ranking import rank_within  # noqa: E402
from pagewright.plans import views as V  # noqa: E402
from pagewright.session import DEFAULT_CONF, ensure_checkpoint_dir  # noqa: E402

HOT = -1


def session(log_dir: str) -> SparkSession:
    b = (SparkSession.builder.master("local[8]").appName("skew-report")
         .config("spark.sql.shuffle.partitions", "16")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
         .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false"))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    # Keep the planned partitioning visible: at this size AQE would coalesce
    # every shuffle into one partition, which reads as "one task has it all".
    b = b.config("spark.sql.adaptive.coalescePartitions.enabled", "false")
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    return s


def hot_pages(spark, sf):
    tp = V.text_pages(spark, sf)
    # every third document's pages move into the hot document, renumbered densely
    moved = tp.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(HOT)).otherwise(F.col("doc_id")))
    return paging.number_within(moved, ["doc_id"], [F.col("doc_id"), F.col("page_no"), F.col("text")], "page_no2") \
        .drop("page_no").withColumnRenamed("page_no2", "page_no").drop("num_pages")


def stage_shares(log_dir: str, job_group: str) -> list[tuple[int, str, int, int, float]]:
    """(stage, scan|shuffle, tasks, rows, max task share) for stages of the job group."""
    files = sorted(f for f in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(f))
    per_stage: dict[int, list[int]] = {}
    stage_group: dict[int, str] = {}
    stage_name: dict[int, str] = {}
    scan_stages: set[int] = set()
    for fn in files:
        with open(fn) as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") == "SparkListenerStageSubmitted":
                    props = ev.get("Properties", {})
                    stage_group[ev["Stage Info"]["Stage ID"]] = props.get("spark.jobGroup.id", "")
                    stage_name[ev["Stage Info"]["Stage ID"]] = ev["Stage Info"].get("Stage Name", "")
                if ev.get("Event") != "SparkListenerTaskEnd":
                    continue
                m = ev.get("Task Metrics") or {}
                scanned = m.get("Input Metrics", {}).get("Records Read", 0)
                rows = scanned + m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0)
                per_stage.setdefault(ev["Stage ID"], []).append(rows)
                if scanned:
                    scan_stages.add(ev["Stage ID"])
    out = []
    for st, rows in sorted(per_stage.items()):
        total = sum(rows)
        if stage_group.get(st) == job_group and total > 0:
            kind = "scan" if st in scan_stages else "shuffle"
            out.append((st, kind, len(rows), total, max(rows) / total))
    return out


def main(argv) -> None:
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="skew-eventlog-")
    spark = session(log_dir)
    sc = spark.sparkContext
    names = hot_pages(spark, sf).withColumn("name", page_label("page_no", padded=False)).checkpoint()
    cases = {
        "rank: plain window (hot group in one task)": lambda: names.withColumn(
            "r", F.row_number().over(Window.partitionBy("doc_id").orderBy("name"))),
        "rank: range path (rank_within)": lambda: rank_within(names, ["doc_id"], [F.col("name")], "r"),
        "budget: segments": lambda: budget.budget_batches(
            names.withColumn("tokens", text_tokens("text")), 4096, 10, doc="doc_id"),
        "combine: last non-empty": lambda: combine.combine_last_non_empty(
            V.batch_json(spark, sf).withColumn("doc", F.when(F.col("doc") % 3 == 0, F.lit(HOT)).otherwise(F.col("doc")))
            .withColumn("batch_no", F.col("batch_no") * 1000000 + F.col("doc")), V.BINDER_TEMPLATE),
    }
    def template_entries():
        bj = V.batch_json(spark, sf).withColumn("doc", F.when(F.col("doc") % 3 == 0, F.lit(HOT)).otherwise(F.col("doc")))
        numbered = bj.withColumn("j", F.regexp_replace("j", '"part_', F.concat(F.lit('"p'), F.col("batch_no"), F.lit("_"), F.xxhash64("j"), F.lit("_"))))
        return combine.combine_entries(numbered, V.BINDER_TEMPLATE)

    cases["template defaults: open keys of a hot document as rows"] = template_entries

    def hot_binder_values():
        from pagewright.operators import combine as C

        bj = V.batch_json(spark, sf).withColumn("doc", F.when(F.col("doc") % 3 == 0, F.lit(HOT)).otherwise(F.col("doc")))
        e = C.combine_entries(bj.withColumn("batch_no", F.col("batch_no") * 1000000 + F.col("doc")), V.BINDER_TEMPLATE)
        return e.where(F.substring("value", 1, 1) == '"').select("doc", "key", F.try_parse_json("value").cast("string").alias("value"))

    def hot_binder_pages():
        b = V.binder_pages(spark, sf)
        return b.select(F.when(F.col("doc") % 3 == 0, F.lit(HOT)).otherwise(F.col("doc")).alias("doc"), F.col("html").alias("text"))

    def grounded():
        from pagewright.operators import checks

        return checks.check_grounded(hot_binder_values(), hot_binder_pages())

    def stitched_parts():
        parts = names.withColumn("label", F.concat(F.lit("Pages_"), F.col("page_no").cast("string"), F.lit("_to_x")))
        return paging.stitch_parts(parts, "doc_id", "label", "text")

    cases["stitch: ordered parts (stitch_parts, range path)"] = stitched_parts
    # Page counts joined back onto the pages (no num_pages carried).  The
    # input is spread round-robin, as a file scan's splits are: AQE splits a
    # skewed partition along its map outputs, and ``names`` is partitioned by
    # document (one map task would hold the hot document whole).
    scanned = names.repartition(16)
    cases["page count join-back: plain equi-join"] = lambda: scanned.join(
        paging.page_count(scanned, "doc_id"), "doc_id", "left")
    cases["page count join-back: join_per_group"] = lambda: paging.assign_batches(scanned, 10, "doc_id")
    # Sort-merge join with AQE's skew split; thresholds lowered to this data size
    # (the defaults, 256 MB and 5x the median, apply at cluster scale).
    cases["grounding: chunks of values, AQE skew split"] = grounded
    skew_conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1024",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "65536",
    }
    conf_for = {label: skew_conf for label in cases if label.startswith(("grounding", "page count"))}
    results = {}
    for i, (label, build) in enumerate(cases.items()):
        group = f"case{i}"
        saved = {k: spark.conf.get(k, None) for k in conf_for.get(label, {})}
        for k, v in conf_for.get(label, {}).items():
            spark.conf.set(k, v)
        sc.setJobGroup(group, label)
        build().write.format("noop").mode("overwrite").save()
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
        results[label] = group
    spark.stop()
    print("# Hot-document skew report\n")
    print("Generated by `tools/skew_report.py` at", os.path.basename(sf),
          "(local[8], 16 shuffle partitions): every third document's pages are moved into one hot",
          "document (about 1/3 of all rows). Per stage: rows read (input + shuffle) and the largest share",
          "read by a single task. AQE partition coalescing is off here so the planned partitioning shows;",
          "a one-task stage is a single-split file scan (the test files have one row group).\n")
    shares = {label: stage_shares(log_dir, group) for label, group in results.items()}
    print("## Summary: largest share of one task over multi-task shuffle stages\n")
    print("| case | max share |")
    print("|---|---|")
    for label, rows in shares.items():
        m = max([sh for _, kind, tasks, total, sh in rows if kind == "shuffle" and tasks > 1 and total > 100] or [0])
        print(f"| {label} | {m:.2f} |")
    print("\n## All stages\n")
    print("| case | stage | reads | tasks | rows | max share of one task |")
    print("|---|---|---|---|---|---|")
    for label, rows in shares.items():
        for st, kind, tasks, total, share in rows:
            print(f"| {label} | {st} | {kind} | {tasks} | {total} | {share:.2f} |")


if __name__ == "__main__":
    main(sys.argv)
