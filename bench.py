"""Headline queries on whole tables; one JSON line on standard output.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores. Each query is planned anew and run to the end into a sink
that discards rows; the best of three runs counts, so that compiling a plan for the first time does not.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import QUERIES  # noqa: E402
from rotativa.session import local_session  # noqa: E402

HEADLINE = (
    "clean_text", "word_tokens", "sentence_lengths", "style_slice", "style_core", "style_features", "emotion_signals",
    "lexicon_emotion", "oov_rate", "zipf_lexicon", "pos_counts", "style_features_tagged", "context_features", "url_domain",
    "parse_date", "pool_mean", "pool_mean_768", "pool_attention", "pool_attention_wide", "dep_depth", "local_features",
    "merge_fill_zero", "merge_last_wins", "merge_all", "dedupe_last", "label_distribution", "guess_label_columns",
)


def run(spark, name: str, sf: str) -> float:
    best = float("inf")
    for _ in range(3):
        started = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - started)
    return round(best, 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", **{
        "spark.driver.memory": "16g", "spark.driver.extraJavaOptions": "-XX:+UseParallelGC",
        "spark.sql.shuffle.partitions": cpus,
    })
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {name: run(spark, name, sf) for name in sys.argv[1:] or HEADLINE}
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(sf).name.removeprefix("sf"), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
