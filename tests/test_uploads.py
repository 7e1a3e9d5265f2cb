"""Uploads that arrive file by file, and rejection within a horizon."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from keysift.sources.rules import Rule
from keysift.sources.store import load_store
from keysift.streaming.arrivals import arriving_files
from keysift.streaming.uploads import unseen_within, upload_stream

FILES = "app_key string, FileName string, file_path string, text string, arrived timestamp"
RULES = [Rule("own.yml", 1, "Token", r"tok_[0-9]+")]
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


def uploads_of(seed: int) -> list[tuple]:
    """Apps whose files come a minute apart; some apps upload again an hour later, some of it the same content."""
    rng = random.Random(seed)
    rows = []
    for app in range(8):
        for upload in range(1 + app % 3):
            for i in range(rng.randrange(1, 7)):
                text = f"tok_{i} of {app % 4}\n" if upload < 2 else f"tok_{app}{i}{upload}\n"
                rows.append((f"app{app}", f"app{app}.apk", f"f/{i}", text, at(60 * upload + app + i)))
    return rows


def run(spark, tmp_path, name: str, batches: list[list[tuple]]):
    folder, store = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-store")
    writer = None
    for k, rows in enumerate([*batches, [("end", "end", "f", "", at(10_000))], [("end", "end", "g", "", at(20_000))]]):
        spark.createDataFrame(rows, FILES).coalesce(1).write.mode("append").parquet(folder)
        if k == len(batches) // 2 or k > len(batches):  # restarted in between
            stream = arriving_files(spark, folder, FILES, per_batch=1)
            writer = upload_stream(stream, lambda: spark.read.schema(FILES).parquet(folder), RULES, store, str(tmp_path / f"{name}-check"), gap="10 minutes", delay="200 minutes")
            writer.trigger(availableNow=True).start().awaitTermination()
    rows = load_store(spark, store).select("app_key", "FileName", "APKHash", "n_findings", F.size("Findings").alias("found"))
    return sorted(map(tuple, rows.collect()))


def test_any_split_of_the_files_gives_the_same_store(spark, tmp_path):
    rows = uploads_of(1)
    results = []
    for k in range(3):
        rng = random.Random(k)
        shuffled = rng.sample(rows, len(rows))
        n = (1, 3, 5)[k]
        results.append(run(spark, tmp_path, f"s{k}", [shuffled[i::n] for i in range(n)]))
    assert results[0] == results[1] == results[2]
    named = {(r[0].split("@")[0], r[0].split("@")[1][11:16]) for r in results[0]}
    assert ("app1", "00:01") in named and ("end", "22:40") in named
    # Equal content of other apps and uploads is reported once.
    contents = {}
    for app, _, path, text, when in rows:
        contents.setdefault((app, (when - START) // timedelta(minutes=60)), []).append((path, text))
    assert len(results[0]) == len({tuple(sorted(c)) for c in contents.values()}) + 1
    by_upload = {r[0]: r for r in results[0]}
    assert by_upload["app5@2024-01-01T02:05:00.000"][3] == len({t for (a, u), c in contents.items() if (a, u) == ("app5", 2) for _, t in c})


def test_files_later_than_their_report_are_in_none(spark, tmp_path):
    first = [("a", "a", "f/1", "tok_1\n", at(0)), ("b", "b", "f/1", "tok_2\n", at(1000))]
    # The watermark has passed a's first file; its report is made with this micro-batch, and what lies there by then counts.
    late = [("a", "a", "f/2", "tok_3\n", at(1)), ("c", "c", "f/1", "tok_4\n", at(2000))]
    later = [("a", "a", "f/3", "tok_5\n", at(2)), ("d", "d", "f/1", "tok_6\n", at(3000))]
    found = run(spark, tmp_path, "late", [first, late, later])
    assert [(r[0][0], r[3]) for r in found if r[0][:3] != "end"] == [("a", 2), ("b", 1), ("c", 1), ("d", 1)]


def test_copies_after_the_horizon_are_reported_again(spark, tmp_path):
    folder = str(tmp_path / "in")
    days = [(k, c) for k in range(8) for c in ("x", "y") if c == "x" or k in (0, 1, 7)]
    for k in range(8):
        rows = [(c, at(1440 * k)) for d, c in days if d == k] * 2
        spark.createDataFrame(rows, "APKHash string, arrived timestamp").coalesce(1).write.mode("append").parquet(folder)
    stream = unseen_within(arriving_files(spark, folder, "APKHash string, arrived timestamp", per_batch=1), "1 day")
    stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(
        availableNow=True
    ).start().awaitTermination()
    found = [(r.APKHash, (r.arrived.replace(tzinfo=timezone.utc) - START).days) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(d for c, d in found if c == "y") == [0, 7]
    seen = sorted(d for c, d in found if c == "x")
    assert seen[0] == 0 and 2 <= len(seen) < 8 and all(b - a > 1 for a, b in zip(seen, seen[1:]))
