"""Times the operators that have kernels over blocks on generated recordings and prints one line of JSON.

BENCH_SESSIONS sessions (default 8) of 14 channels and 76,800 samples at 128 Hz, the size of a ten-minute recording, are written once as
Parquet in a new folder and read by each operator; BENCH_CPUS tells the cores.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectralake.operators import cleaning, complexity, coupling, events, joins, spectral, timefreq
from spectralake.shipping import ship

CHANNELS, SAMPLES, FS = 14, 76_800, 128.0


def generated(spark: SparkSession, sessions: int, path: str) -> DataFrame:
    """A tone of 7.8 Hz in all channels, louder in bursts, with noise; channel c00 is the reference."""
    rows = spark.range(0, sessions * CHANNELS * SAMPLES, numPartitions=max(8, sessions * CHANNELS // 4))
    k, c, s = F.col("id") % SAMPLES, F.floor(F.col("id") / SAMPLES) % CHANNELS, F.floor(F.col("id") / (SAMPLES * CHANNELS))
    noise = (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20) - 0.5) * 6
    tone = F.sin(2 * 3.141592653589793 * 7.8 * k / FS + c * 0.2) * (1 + 3 * ((k % 12_800) < 1280).cast("int"))
    rows.select(s.cast("string").alias("session_id"), F.format_string("c%02d", c).alias("channel"), k.alias("idx"), (k / FS).alias("t"), (tone + noise).alias("x")).write.parquet(path)
    return spark.read.parquet(path)


def workloads(spark: SparkSession, s: DataFrame) -> dict[str, callable]:
    lines = spark.createDataFrame([(7.8,), (15.6,)], "f0 double")
    grid = spark.createDataFrame([(k, 7.8 * k + 0.05 * d) for k in range(1, 6) for d in range(-9, 10)], "k int, f0 double")
    reads = lambda: spectral.lock_in(cleaning.frames(s, 256, 128), lines, 256, FS)
    phase = lambda: reads().where("f0 < 10").select("session_id", "channel", F.col("frame").alias("idx"), F.atan2("im", "re").alias("phase"), F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("amp"))
    first = s.where("channel = 'c00'")
    return {
        "P5 rolling robust z, 15,361 samples": lambda: cleaning.rolling_robust_z(s, 7680),
        "F15 wavelets, two lines at each sample": lambda: timefreq.morlet(s, lines, 257, 1, FS),
        "E6 drifting ridges, 5 orders x 19 wavelets, one channel": lambda: timefreq.ridge_tracks(first, grid, 257, FS, 32),
        "J7 covariances of all channels": lambda: joins.gram(s),
        "F1 Welch spectra": lambda: spectral.welch(s, 512, FS),
        "F12 sliding coherence over frames": lambda: spectral.sliding_coherence(reads(), "c00", 7),
        "C2 locking of all channels over frames": lambda: coupling.phase_edges(phase()),
        "C25 conditional Granger, frames of 10 s": lambda: coupling.conditional_granger(s, 4, 1280, 1280),
        "X12 recurrence of 4,800 points, one channel": lambda: complexity.recurrence_measures(complexity.embed(cleaning.coarse_grain(first, 16), 3, 4), 0.2),
        "W1 events: smoothed bursts, intervals, latencies": lambda: events.islands(cleaning.z_score(cleaning.hann_average(first, 12)), F.col("z") >= 2, ["session_id", "channel"], 8, "z"),
        "W2 contrast: coherence and locking with the reference": lambda: spectral.coherence(reads(), "c00").join(coupling.reference_lag(reads(), "c00"), ["session_id", "channel", "f0"]),
        "W3 ridges to spikes along them, one channel": lambda: timefreq.drifting_spikes(first, grid, 257, FS, 32, 12, 7680, 3.5, 32),
    }


def main() -> None:
    cpus, sessions = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_SESSIONS", "8"))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(4 * int(cpus))).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    s = generated(spark, sessions, tempfile.mkdtemp(prefix="spark-recordings-") + "/samples")
    found = {}
    for name, run in workloads(spark, s).items():
        began = time.time()
        run().write.format("noop").mode("overwrite").save()
        found[name] = round(time.time() - began, 2)
    print(json.dumps({"metric": "seconds by operator", "samples": sessions * CHANNELS * SAMPLES, "cpus": int(cpus), "operators": found}))


if __name__ == "__main__":
    main()
