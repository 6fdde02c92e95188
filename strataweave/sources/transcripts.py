"""Transcripts of agent sessions as JSON lines: what the user asked for last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions.text import BLANKS

# The turn type of a user and the marks around the request.
USER_TURN, OPEN, CLOSE = "USER_INPUT", "<USER_REQUEST>", "</USER_REQUEST>"


def last_requests(lines: DataFrame) -> DataFrame:
    """Rows (transcript, request) of lines (transcript, line_no, line): the request of the last user turn that has one.

    Lines that are no JSON, of another type, or without a request between the marks are passed over; a transcript
    without any has no row. Lines are reduced to one per transcript by an aggregation, however long it is.
    """
    turn = lines.select("transcript", "line_no", F.from_json("line", "type STRING, content STRING").alias("t")).where(F.col("t.type") == USER_TURN)
    begin, end = F.instr("t.content", OPEN), F.instr("t.content", CLOSE)
    inside = F.when((begin > 0) & (end > begin + len(OPEN)), F.substr(F.col("t.content"), begin + len(OPEN), end - begin - len(OPEN)))
    asked = turn.select("transcript", "line_no", F.regexp_replace(inside, f"^{BLANKS}+|{BLANKS}+$", "").alias("request")).where("request <> ''")
    return asked.groupBy("transcript").agg(F.max_by("request", "line_no").alias("request"))
