"""Times the headline queries over $BENCH_SF_DIR; prints one JSON line.

Each query runs once to warm up and then three times; its figure is the median
of writing all rows to the no-op sink. Beside the seconds stand documents and
characters a second of the resumes that the query reads, and the hardware.
"""

from __future__ import annotations

import json
import os
import platform
import time
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = ("clean_full", "segment_sections", "contact_struct", "experience", "education", "skills_exact_scan", "skills_fuzzy_lev", "skills_union", "jd_match", "record_json")
#: These read the table of documents as well.
WITH_DOCUMENTS = ("clean_full", "skills_exact_scan", "skills_fuzzy_lev")


def _size(texts) -> tuple[int, int]:
    row = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    return row.n, row.chars or 0


def _processor() -> str:
    try:
        with open("/proc/cpuinfo") as f:
            return next((line.split(":", 1)[1].strip() for line in f if line.startswith("model name")), platform.processor())
    except OSError:
        return platform.processor()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from dossier.plans.queries import queries
    from dossier.plans.resumes import resumes

    found, seconds, rates = queries(), {}, {}
    cvs, documents = _size(resumes(spark, sf_dir)), _size(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name in HEADLINE:
        runs = []
        for k in range(int(os.environ.get("BENCH_RUNS", "3")) + 1):
            began = time.time()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if k:
                runs.append(time.time() - began)
        took = median(runs)
        n, chars = (a + (b if name in WITH_DOCUMENTS else 0) for a, b in zip(cvs, documents, strict=True))
        seconds[name], rates[name] = round(took, 3), {"documents_per_s": round(n / took), "chars_per_s": round(chars / took)}
    memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") >> 30
    hardware = {"cpu": _processor(), "cores": int(cpus), "memory_gib": memory}
    print(json.dumps({"metric": "total seconds of the headline queries, warm medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "throughput": rates, "hardware": hardware}))


if __name__ == "__main__":
    main()
