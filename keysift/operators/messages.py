"""Size-limited notification messages.

Entries are packed greedily in report order: a message is closed when the next
entry would take it over the byte limit; an entry above the limit stands alone.
A report in one row is packed in that row.  A report of several parts is packed
part by part at the same time: a part's effect on the message being filled is a
short table (see :func:`_part_table`), the tables of an app are composed and chained level by level (see
:func:`_part_starts`), and then every part knows where it starts.  The messages are the same as from one fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.model import require
from keysift.operators.duplicates import skew_join
from keysift.session import stage

# Limits in bytes, the rule under each block, and the texts of the headers and entries below.
CHAT_LIMIT = 4000
TICKET_LIMIT = 32767
RULE = "----------------\n"
NO_SECRETS = "** No secrets found **"

#: Tables of parts that meet in one row.
FAN = 64


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def chat_header() -> Column:
    return _text(
        "APK Name: ", F.col("FileName"), "\n",
        "App Version: ", F.col("APKVersion"), "\n",
        "Package Name: ", F.col("PackageDataModel.PackageName"), "\n",
        "SHA1: ", F.col("APKHash"), "\n",
        "\n",
        "Secrets in APK: \n",
        RULE,
        F.col("n_findings"), " secrets found\n",
        RULE,
    )


def chat_entry(f: Column) -> Column:
    return _text(
        "Secret Type: ", f["Type"], "\n",
        "Secret Value: ", f["SecretString"], "\n",
        "Secret Type: ", f["SecretType"], "\n",
        "Line No: ", f["LineNo"], "\n",
        "File Location: ", f["FileLocation"], "\n",
        RULE,
    )


def ticket_header(title: str) -> Column:
    return _text(
        f"h2. {title}\n",
        "h4. APK Name: ", F.col("FileName"), "\n",
        "h4. App Version: ", F.col("APKVersion"), "\n",
        "h4. Package Name: ", F.col("PackageDataModel.PackageName"), "\n",
        "h4. SHA1: ", F.col("APKHash"), "\n",
        "h4. Secrets in APK:\n",
        RULE,
        F.col("n_findings"), " secrets found\n",
        RULE,
    )


def ticket_entry(f: Column) -> Column:
    return _text(
        "{noformat}\n === ", f["Type"], " ===\n",
        "Secret Value: ", f["SecretString"], "\n",
        "Line No: ", f["LineNo"], "\n",
        "File Location: ", f["FileLocation"], "\n",
        "{noformat}",
    )


def pack(entries: Column, limit: int, head: Column, start: Column) -> Column:
    """Fold entries into pieces; ``head`` and ``start`` are the open message and its bytes."""
    state = F.struct(
        F.array().cast("array<string>").alias("done"), head.alias("open"), start.cast("int").alias("size")
    )

    def step(acc: Column, entry: Column) -> Column:
        size = F.octet_length(entry)
        return F.when(
            acc["size"] + size > limit,
            F.struct(
                F.concat(acc["done"], F.array(acc["open"])).alias("done"),
                entry.alias("open"),
                size.alias("size"),
            ),
        ).otherwise(
            F.struct(
                acc["done"].alias("done"),
                F.concat(acc["open"], entry).alias("open"),
                (acc["size"] + size).alias("size"),
            )
        )

    return F.aggregate(entries, state, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))


def _part_table(sizes: Column, limit: int) -> list[Column]:
    """What a part does to the open message, for every size the message may have.

    ``upto``, ``left``, ``closed``: if the first break falls before entry ``k`` then
    ``left[k]`` bytes are open after the part and ``closed[k]`` messages were closed.
    The break falls before the first ``k`` with ``size + upto[k] > limit``, so only
    the few entries that start within ``limit`` can be that one.
    """
    sums = F.aggregate(
        sizes,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("upto")),
        lambda acc, s: F.when(acc["at"] > limit, acc).otherwise(
            F.struct(
                (acc["at"] + s).alias("at"),
                F.concat(acc["upto"], F.array(acc["at"] + s)).alias("upto"),
            )
        ),
        lambda acc: acc["upto"],
    )

    def rest(k: Column) -> Column:
        start = F.struct(F.get(sizes, k).cast("long").alias("left"), F.lit(1).cast("long").alias("closed"))
        return F.aggregate(
            F.slice(sizes, k + 2, F.size(sizes)),
            start,
            lambda acc, s: F.when(
                acc["left"] + s > limit,
                F.struct(s.cast("long").alias("left"), (acc["closed"] + 1).alias("closed")),
            ).otherwise(F.struct((acc["left"] + s).alias("left"), acc["closed"].alias("closed"))),
        )

    few = F.sequence(F.lit(0), F.size(sums) - 1)
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda acc, s: acc + s)
    return [sums.alias("upto"), F.transform(few, rest).alias("rest"), total.alias("total")]


def _chain(tables: Column, size: Column, message: Column, limit: int) -> Column:
    """Walk tables in order: where each block starts, from the open bytes and the message number before the first."""
    state = F.struct(
        size.cast("long").alias("size"),
        message.cast("long").alias("message"),
        F.array().cast("array<struct<block:bigint,start:bigint,first:bigint>>").alias("starts"),
    )

    def step(acc: Column, table: Column) -> Column:
        starts = F.concat(
            acc["starts"],
            F.array(F.struct(table["block"].alias("block"), acc["size"].alias("start"), acc["message"].alias("first"))),
        )
        after = _after(table, acc["size"], limit)
        return F.struct(
            after["left"].alias("size"), (acc["message"] + after["closed"]).alias("message"), starts.alias("starts")
        )

    return F.aggregate(tables, state, step, lambda acc: acc["starts"])


def _after(table: Column, size: Column, limit: int) -> Column:
    """Open bytes after a block that starts with ``size`` open ones, and the messages closed in it."""
    # Sums grow, so the sums that fit count the entries before the break.
    k = F.size(F.filter(table["upto"], lambda u: size + u <= limit))
    through = F.struct((size + table["total"]).alias("left"), F.lit(0).cast("long").alias("closed"))
    return F.when(size + table["total"] <= limit, through).otherwise(F.get(table["rest"], k))


def _composed(one: Column, other: Column, limit: int) -> Column:
    """The table of two blocks in a row; it is no longer than what starts within ``limit`` bytes."""
    later = F.transform(other["upto"], lambda u: u + one["total"])
    upto = F.when(one["total"] > limit, one["upto"]).otherwise(F.concat(one["upto"], later))
    kept = F.slice(upto, F.lit(1), F.size(F.filter(upto, lambda u: u <= limit)) + 1)

    def onward(r: Column) -> Column:
        after = _after(other, r["left"], limit)
        return F.struct(after["left"].alias("left"), (r["closed"] + after["closed"]).alias("closed"))

    rest = F.concat(F.transform(one["rest"], onward), other["rest"])
    return F.struct(kept.alias("upto"), F.slice(rest, F.lit(1), F.size(kept)).alias("rest"), (one["total"] + other["total"]).alias("total"))


def _part_starts(tables: DataFrame, keys: list[str], parts: int, limit: int) -> DataFrame:
    """``(keys, part, start, first)``: the open bytes and the message number before each part of a report.

    Tables of FAN neighbours are composed to one, level by level, until an app has FAN at most; then the starts go down the
    levels again.  No row holds more than FAN tables, however many parts an app has.
    """
    level = tables.select(*keys, F.col("part").cast("long").alias("block"), "upto", "rest", "total")
    levels, blocks = [level], parts
    gathered = lambda: F.array_sort(F.collect_list(F.struct("block", "upto", "rest", "total")))
    while blocks > FAN:
        parent = F.floor(F.col("block") / FAN).alias("parent")
        groups = levels[-1].groupBy(*keys, parent).agg(gathered().alias("own"))
        bare = lambda t: F.struct(t["upto"].alias("upto"), t["rest"].alias("rest"), t["total"].alias("total"))
        whole = F.aggregate(
            F.slice("own", F.lit(2), F.size("own")), bare(F.col("own")[0]), lambda acc, t: _composed(acc, t, limit)
        )
        level = groups.select(*keys, F.col("parent").alias("block"), whole.alias("t")).select(*keys, "block", "t.*")
        levels.append(stage(level, "part-tables"))
        blocks = -(-blocks // FAN)
    heads = tables.groupBy(*keys).agg(F.max("head_size").alias("size"))
    starts = heads.select(*keys, F.lit(0).cast("long").alias("parent"), F.col("size").cast("long").alias("start"), F.lit(0).cast("long").alias("first"))
    for k, level in enumerate(reversed(levels)):
        parent = F.floor(F.col("block") / FAN) if k else F.lit(0).cast("long")
        groups = level.groupBy(*keys, parent.alias("parent")).agg(gathered().alias("own"))
        placed = groups.join(starts, [*keys, "parent"])
        inner = placed.select(*keys, F.inline(_chain(F.col("own"), F.col("start"), F.col("first"), limit)))
        starts = inner.withColumnRenamed("block", "parent")
    return starts.withColumnRenamed("parent", "part")


def pack_reports(reports: DataFrame, header: Column, entry, limit: int) -> DataFrame:
    """Messages of reports: the key columns, ``seq`` from 0 and ``body``.

    Pass reports read from a table: those in several parts are read twice.
    """
    keys = [c for c in ("batch_id", "app_key") if c in reports.columns]
    no_findings = F.array().cast(reports.schema["Findings"].dataType)
    texts = reports.select(
        *keys,
        "part",
        "parts",
        header.alias("head"),
        F.transform(F.coalesce("Findings", no_findings), entry).alias("entries"),
    )
    single = texts.where(F.col("parts") == 1).select(
        *keys, F.posexplode(pack(F.col("entries"), limit, F.col("head"), F.octet_length("head"))).alias("seq", "body")
    )
    several = texts.where(F.col("parts") > 1)
    sizes = several.select(
        *keys,
        "part",
        F.octet_length("head").alias("head_size"),
        F.transform("entries", lambda e: F.octet_length(e)).alias("sizes"),
    )
    tables = sizes.select(*keys, "part", "head_size", *_part_table(F.col("sizes"), limit))
    most = several.agg(F.coalesce(F.max("part") + 1, F.lit(0)).alias("n")).first()["n"]
    starts = _part_starts(tables, keys, most, limit)
    # Parts are numbered from 0; the first one opens with the header.
    head = F.when(F.col("part") == 0, F.col("head")).otherwise("")
    pieces = several.join(starts, [*keys, "part"]).select(
        *keys, "part", "first", F.posexplode(pack(F.col("entries"), limit, head, F.col("start"))).alias("pos", "piece")
    )
    # The pieces of one message add up to at most the limit.
    ordered = F.array_sort(F.collect_list(F.struct("part", "piece")))
    joined = pieces.groupBy(*keys, (F.col("first") + F.col("pos")).cast("int").alias("seq")).agg(
        F.array_join(F.transform(ordered, lambda p: p["piece"]), "").alias("body")
    )
    return single.unionByName(joined)


def chat_messages(reports: DataFrame) -> DataFrame:
    """``(app_key, seq, body)``; a report that holds no findings value at all says so."""
    absent = F.col("n_findings").isNull()
    keys = [c for c in ("batch_id", "app_key") if c in reports.columns]
    none = reports.where(absent).select(*keys, F.lit(0).alias("seq"), F.lit(NO_SECRETS).alias("body"))
    return pack_reports(reports.where(~absent), chat_header(), chat_entry, CHAT_LIMIT).unionByName(none)


def ticket_messages(reports: DataFrame, title: str = "Secret scan report") -> DataFrame:
    """``(app_key, seq, body)`` in wiki markup; ``title`` heads the first message."""
    return pack_reports(reports, ticket_header(title), ticket_entry, TICKET_LIMIT)


def _answered(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with the messages of their own batch; the messages of a large app are spread."""
    if "batch_id" in messages.columns:
        require(requests, "batch_id")
    keys = [c for c in ("batch_id", "app_key") if c in messages.columns]
    key = F.to_json(F.struct(*keys))
    right = requests.withColumn("_key", key).drop(*keys)
    return skew_join(messages.withColumn("_key", key), right, "_key", "seq")


def chat_notifications(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """One reply per message in the thread of each ``requests(app_key, channel, ts)``.

    Messages of stored reports carry their batch; requests then name the batch they belong to.
    """
    return _answered(messages, requests).select(
        "channel",
        F.col("ts").alias("thread_ts"),
        "app_key",
        "seq",
        F.concat(F.lit("```"), "body", F.lit("```")).alias("body"),
    )


def ticket_notifications(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """One JSON comment body per message for each ``requests(app_key, ticket_id)``, by batch like the chat's."""
    return _answered(messages, requests).select(
        "ticket_id", "seq", F.to_json(F.struct("body")).alias("body")
    )
