import pytest
from pyspark.sql import functions as F

from keysift.functions.text import fingerprint
from keysift.operators.attachments import requested_files
from keysift.operators.duplicates import known_content, new_content, skew_join
from keysift.operators.scan import regex_join
from keysift.plans.batch import duplicate_replies, likely_files, scan_apps, scan_batch
from keysift.sources.corpus import lines, parse_search_output, scannable
from keysift.sources.rules import Rule
from keysift.sources.store import append_store, compact_index, last_report, load_index, load_store
from keysift.streaming.arrivals import arriving_files, report_stream, scan_stream

RULES = [Rule("p.yml", 1, "tok", "tok_[0-9]+"), Rule("p.yml", 2, "any", "[a-z]+_1")]


def run(spark, apps, store, batch_id, **options):
    """apps: (app_key, content)."""
    frame = spark.createDataFrame(apps, "app_key string, text string")
    submissions = frame.select("app_key", F.concat("app_key", F.lit(".apk")).alias("FileName"), fingerprint(F.col("text")).alias("APKHash"))
    files = frame.select("app_key", F.lit("f").alias("file_path"), "text")
    none = frame.select("app_key", "text").limit(0)
    return scan_batch(submissions, files, none, none.withColumnRenamed("text", "json"), RULES, store, batch_id, **options), submissions


def stored(frame):
    return sorted((r.batch_id, r.app_key, r.n_findings) for r in frame.collect())


def test_batches(spark, tmp_path):
    store = str(tmp_path / "store")
    first, _ = run(spark, [("b", "tok_1\ntok_2"), ("a", "tok_1\ntok_2"), ("c", "none")], store, 0)
    assert stored(first.reports) == [(0, "a", 2), (0, "c", 0)]
    assert [tuple(r) for r in first.replies.select("app_key", "reply_batch", "reply_app").collect()] == [("b", 0, "a")]
    apps = [("d", "none"), ("e", "tok_9")]
    second, submissions = run(spark, apps, store, 1)
    assert stored(second.reports) == [(1, "e", 1)]
    assert [tuple(r) for r in second.replies.select("app_key", "reply_batch", "reply_app").collect()] == [("d", 0, "c")]
    again, _ = run(spark, apps, store, 1)  # a replay changes nothing
    assert stored(load_store(spark, store)) == [(0, "a", 2), (0, "c", 0), (1, "e", 1)]
    assert stored(again.reports) == [(1, "e", 1)]
    replies, answers = duplicate_replies(submissions, store)
    assert {r.app_key: r.reply_app for r in replies.collect()} == {"d": "c", "e": "e"}
    assert sorted(r.FileName for r in answers.collect()) == ["c.apk", "e.apk"]
    assert [r.app_key for r in last_report(load_store(spark, store)).collect()] == ["e"]
    rescan, _ = run(spark, apps, store, 2, rescan_duplicates=True)
    assert stored(rescan.reports) == [(2, "d", 0), (2, "e", 1)]


def test_many_findings_and_long_app_lists(spark):
    text = "\n".join(f"tok_{i}" for i in range(1500))
    files = spark.createDataFrame([("a", "f", text), ("b", "f", text)], "app_key string, file_path string, text string")
    apps = spark.createDataFrame([("a",)], "app_key string")
    found = scan_apps(files, apps, RULES)
    assert found.count() == 1500 and {r.app_key for r in found.collect()} == {"a"}


@pytest.mark.parametrize("bits", [8, 1 << 15, 1 << 27])
def test_likely_files_keeps_every_file_of_the_apps(spark, bits):
    files = spark.range(3000).selectExpr("concat('k', id) as app_key", "'t' as text")
    apps = spark.range(0, 3000, 7).selectExpr("concat('k', id) as app_key")
    kept = likely_files(files, apps, bits)
    assert kept.columns == files.columns and kept.join(apps, "app_key").count() == apps.count()
    assert bits < 1 << 20 or kept.count() < 450
    assert likely_files(files, apps.limit(0), bits).count() == 0


def rows_scanned(df) -> int:
    """Rows that come out of the file scans of a query, once run."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif name.startswith("Scan"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_a_batch_reads_a_small_share_of_the_index(spark, tmp_path):
    """A thousand contents, half of them stored, against an index of two million."""
    from keysift.sources.store import PROBES, _index, _write_index

    store = str(tmp_path / "store")
    keys = spark.range(2_000_000).selectExpr("md5(string(id)) as APKHash", "concat('a', id) as app_key", "bigint(0) as batch_id")
    _write_index(keys, f"{_index(store)}/chunk=0")
    contents = spark.range(1_000_000, 3_000_000, 2000).selectExpr("md5(string(id)) as APKHash")
    assert contents.count() == PROBES
    found = load_index(spark, store, contents)
    assert sorted(r.app_key for r in found.collect()) == sorted(f"a{i}" for i in range(1_000_000, 2_000_000, 2000))
    assert rows_scanned(found) < 0.2 * 2_000_000
    few = load_index(spark, store, contents.limit(50))
    assert rows_scanned(few) < 0.02 * 2_000_000
    # More contents than are looked up one by one: the whole index, the same answer.
    many = spark.range(1_000_000, 3_000_000, 900).selectExpr("md5(string(id)) as APKHash")
    assert load_index(spark, store, many).join(many, "APKHash").count() == len(range(1_000_000, 2_000_000, 900))


def test_index_of_batches(spark, tmp_path):
    store = str(tmp_path / "store")
    for batch_id in range(3):
        run(spark, [(f"a{batch_id}{i}", f"tok_{i}\n{batch_id}") for i in range(20)], store, batch_id)
    contents = load_index(spark, store).where("app_key in ('a01', 'a15')").select("APKHash")
    part = load_index(spark, store, contents)
    assert part.count() == 2 and part.join(contents, "APKHash").count() == 2
    assert "Findings" not in part._jdf.queryExecution().executedPlan().toString()
    assert len(list((tmp_path / "store-index" / "chunk=0").glob("*.parquet"))) <= 4
    before = sorted(map(tuple, load_index(spark, store).collect()))
    compact_index(spark, store, 2)
    compact_index(spark, store, 2)
    assert sorted(map(tuple, load_index(spark, store).collect())) == before
    assert sorted(p.name for p in (tmp_path / "store-index").iterdir()) == ["chunk=2", "chunk=below-2"]
    again, _ = run(spark, [("z", "tok_1\n0"), ("y", "new")], store, 3)
    assert stored(again.reports) == [(3, "y", 0)] and [r.reply_app for r in again.replies.collect()] == ["a01"]
    assert load_index(spark, store, before=1).count() == 20


def test_empty_store(spark, tmp_path):
    store = load_store(spark, str(tmp_path / "absent"))
    assert store.count() == 0 and last_report(store).count() == 0


def test_skew_join_keeps_all_rows(spark):
    left = spark.createDataFrame([("h" if i % 3 else f"k{i % 7}", f"r{i}") for i in range(300)], "k string, id string")
    right = spark.createDataFrame([("h", 1), ("k0", 2), ("k3", 3), ("zz", 4)], "k string, v int")
    plain = left.join(right, "k").select("k", "id", "v")
    for hot in (1, 10, 1000):
        assert sorted(skew_join(left, right, "k", "id", hot).select("k", "id", "v").collect()) == sorted(plain.collect())


def test_hot_keys_do_not_move_by_the_bare_key(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        left = spark.createDataFrame([("h", i) for i in range(100)], "k string, id long")
        right = spark.createDataFrame([("h", 1)], "k string, v int")
        plan = skew_join(left, right, "k", "id", 10)._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.split("\n") if "Exchange hashpartitioning(k" in line]
        # By the bare key moves only the list of counts; rows move by key and salt.
        assert sum("salt" in line for line in moved) == 2 and "BroadcastExchange" in plan
        assert "SortMergeJoin [k" in plan and "salt" in plan.split("SortMergeJoin [k")[1].split("\n")[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_new_and_known_content(spark):
    new = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z")], "app_key string, APKHash string")
    store = spark.createDataFrame([("s2", "y", 1), ("s1", "y", 1), ("s0", "y", 2)], "app_key string, APKHash string, batch_id long")
    assert sorted(tuple(r) for r in new_content(new, store).collect()) == [("x", "a", 2), ("z", "d", 1)]
    assert [(r.app_key, r.reply_batch, r.reply_app) for r in known_content(new, store, hot=1).collect()] == [("c", 1, "s1")]


def test_requested_files(spark):
    schema = "channel string, msg_pos long, ts string, files array<struct<url:string,name:string>>"
    rows = [("C", 1, "1", [("u1", "n1"), ("u2", "n2")]), ("C", 2, "1", [("u3", "n3")]), ("C", 3, "2", []), ("D", 4, "1", [("u4", "n4")]), ("C", 5, "1", [])]
    requests = spark.createDataFrame([("C", "1"), ("C", "2"), ("D", "9")], "channel string, ts string")
    assert [tuple(r) for r in requested_files(spark.createDataFrame(rows, schema), requests).collect()] == [("C", "1", "u3", "n3")]
    with pytest.raises(ValueError):
        requested_files(spark.createDataFrame(rows, schema), requests.drop("ts"))


def test_parse_search_output(spark):
    values = ["a:3:x", "a:3:x:y", "a:b:x", "a:3", "", "a: 3:x", "a:-4:x", "a:3.0:x", "a:99999999999:x", ":1:"]
    got = parse_search_output(spark.createDataFrame([(v,) for v in values], "value string")).collect()
    assert [tuple(r) for r in got] == [("a", 3, "x"), ("a", 3, "x:y"), ("a", -4, "x"), ("", 1, "")]


def test_regex_join(spark):
    rows = spark.createDataFrame([("a", "f", 7, "Tok_1 x"), ("a", "f", 9, "nope"), ("a", "f", 11, "")], "app_key string, file_path string, line_no int, line string")
    rules = [Rule("p", 1, "t", "(?i)tok_1"), Rule("p", 2, "s", r"x\s"), Rule("p", 3, "n", "zz"), Rule("p", 4, "e", "^$"), Rule("p", 5, "t2", "(?i)tok_1")]

    def hits(frame):
        return sorted((r.LineNo, r.Type) for r in regex_join(frame, rules).collect())

    assert hits(rows) == [(7, "s"), (7, "t"), (7, "t2"), (11, "e")]
    assert hits(rows.selectExpr("*", "false as ended")) == [(7, "t"), (7, "t2")]
    with pytest.raises(ValueError):
        regex_join(rows, [*rules, Rule("p", 6, "m", "a\nb", multiline=True)])
    parsed = parse_search_output(spark.createDataFrame([("a", "f:3:tok_1")], "app_key string, value string"))
    assert hits(parsed) == [(3, "t"), (3, "t2")]


def test_streams_equal_batches_and_survive_restarts(spark, tmp_path):
    schema = "app_key string, FileName string, text string"
    rows = [(f"a{i:02d}", f"a{i:02d}.apk", f"tok_{i % 5}\nx_1") for i in range(12)]
    incoming, store, found = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "found")

    def arrive(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(incoming)

    def drain():
        stream = arriving_files(spark, incoming, schema, per_batch=1)
        files = stream.select("app_key", F.col("FileName").alias("file_path"), "text")
        for writer in (
            report_stream(stream, RULES, store, str(tmp_path / "c1")),
            scan_stream(files, RULES, found, str(tmp_path / "c2")),
        ):
            writer.trigger(availableNow=True).start().awaitTermination()

    arrive(rows[:4])
    arrive(rows[4:7])
    drain()
    arrive(rows[7:])
    drain()
    drain()  # nothing new
    reports = load_store(spark, store)
    assert sorted(r.app_key for r in reports.collect()) == ["a00", "a01", "a02", "a03", "a04"]
    assert {r.n_findings for r in reports.collect()} == {2}
    assert reports.select("batch_id").distinct().count() >= 2
    assert spark.read.parquet(found).count() == sum(2 if i % 5 != 1 else 3 for i in range(12))


def test_stream_of_apps_with_several_files_and_facts(spark, tmp_path):
    schema = "app_key string, FileName string, file_path string, text string"
    incoming, store = str(tmp_path / "in"), str(tmp_path / "store")
    first = [("a", "a.apk", "x", "tok_1"), ("a", "a.apk", "y", "tok_2"), ("b", "b.apk", "x", "tok_1")]
    second = [("c", "c.apk", "y", "tok_2"), ("c", "c.apk", "x", "tok_1"), ("d", "d.apk", "z", "tok_1")]
    for part in (first, second):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(incoming)
    badging = spark.createDataFrame([("a", "package: name='pa'"), ("d", "package: name='pd'")], "app_key string, text string")
    documents = spark.createDataFrame([("a", '{"fileName": "fa"}')], "app_key string, json string")
    stream = arriving_files(spark, incoming, schema, per_batch=1)
    report_stream(stream, RULES, store, str(tmp_path / "c"), badging, documents).trigger(availableNow=True).start().awaitTermination()
    found = sorted((r.app_key, r.n_findings, r.PackageDataModel.PackageName, r.Metadata.fileName) for r in load_store(spark, store).collect())
    assert found == [("a", 2, "pa", "fa"), ("b", 1, "", ""), ("d", 1, "pd", "")]


def test_store_append_replaces_only_its_batch(spark, tmp_path):
    store = str(tmp_path / "s")
    (first, _) = run(spark, [("a", "tok_1"), ("b", "tok_2")], store, 5)
    append_store(first.reports.where("app_key = 'a'").cache(), store, 6)
    assert stored(load_store(spark, store)) == [(5, "a", 1), (5, "b", 1), (6, "a", 1)]
    assert stored(load_store(spark, store, before=6)) == [(5, "a", 1), (5, "b", 1)]
