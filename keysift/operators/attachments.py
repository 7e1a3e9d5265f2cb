"""Attachments of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.functions.text import is_app_file, last_segment
from keysift.model import require


def flatten_files(messages: DataFrame) -> DataFrame:
    """``messages(channel, msg_pos, ts, files)`` to one row per attachment."""
    return messages.select("channel", "msg_pos", "ts", F.posexplode("files").alias("file_pos", "file")).select(
        "channel", "msg_pos", "ts", "file_pos", F.col("file.url").alias("url"), F.col("file.name").alias("name")
    )


def requested_files(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """The last attachment of the message each ``requests(channel, ts)`` row names.

    Among messages of equal time the later one wins.  Attachments are reduced to
    one per message time before the join, so no message group meets the requests whole.
    """
    require(requests, "channel", "ts")
    last = (
        flatten_files(messages)
        .groupBy("channel", "ts")
        .agg(F.max_by(F.struct("url", "name"), F.struct("msg_pos", "file_pos")).alias("file"))
    )
    return requests.join(last, ["channel", "ts"]).select(
        *requests.columns, F.col("file.url").alias("url"), F.col("file.name").alias("name")
    )


def ticket_requests(requests: DataFrame) -> DataFrame:
    """``requests(ticket_id, file_url)`` that name an app file, with its name.

    Only these columns pass: credentials have no place in a table.
    """
    require(requests, "ticket_id", "file_url")
    named = requests.select("ticket_id", "file_url", last_segment(F.col("file_url")).alias("FileName"))
    return named.where(is_app_file(F.col("FileName")))
