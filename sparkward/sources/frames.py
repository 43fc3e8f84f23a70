"""Messages on a pipe, cut into chunks at any place, as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stateful import BLOCK, running
from ..shared import saved

#: Characters that may wait for a line break, with the chunk at hand; a stream that has more ends there.
MOST = 10 << 20


def lines_of(chunks: DataFrame, most: int = MOST) -> DataFrame:
    """Lines of chunks (stream, seq, text), whatever the chunks: stream, nth, line, kind (json, blank, or dropped, which isn't JSON).

    What a chunk begins with belongs to the line that earlier chunks left unfinished, so each piece of a chunk has
    the number of line breaks before it as its line's number, a running sum; a line is put together from its pieces
    alone. A chunk with which over `most` characters wait ends its stream, and takes what waits with it; else what is
    left at the end is a line too, unless it is blank. Characters are whole: text was decoded before it was cut.
    """
    text = F.coalesce("text", F.lit(""))
    at = F.length(text) - F.locate("\n", F.reverse(text)) + 1  # after the last line break
    own = saved(chunks.select(F.struct("stream").alias("_key"), "seq", text.alias("text"), F.length(text).cast("long").alias("size"), (F.size(F.split(text, "\n")) - 1).cast("long").alias("breaks"), at.cast("long").alias("at")), "chunks")
    block = F.floor(F.col("seq") / BLOCK)
    rows = running(own.drop("text"), block, ["seq"], "size", F.sum, "upto")
    rows = running(rows, block, ["seq"], "breaks", F.sum, "number")
    # Where the last line break before each chunk is: the chunk's own counts from the next one on.
    ends = rows.withColumn("broken", F.when(F.col("breaks") > 0, F.col("upto") - F.col("size") + F.col("at")).otherwise(F.lit(0)))
    after = ends.select("_key", (F.col("seq") + 1).alias("seq"), "broken", F.lit(False).alias("is_chunk"), *[F.lit(0).cast("long").alias(c) for c in ("size", "upto", "number", "breaks")])
    both = saved(after.unionByName(ends.select("_key", "seq", F.lit(0).cast("long").alias("broken"), F.lit(True).alias("is_chunk"), "size", "upto", "number", "breaks")), "breaks")
    known = running(both, block, ["seq", "is_chunk"], "broken", F.max, "last").where("is_chunk")
    ended = known.where(F.col("upto") - F.col("last") > most).groupBy("_key").agg(F.min("seq").alias("end"))
    rows = known.join(ended, "_key", "left").where("end is null or seq < end")
    rows = rows.join(own.select("_key", "seq", "text"), ["_key", "seq"])
    pieces = rows.select("_key", "seq", "end", (F.col("number") - F.col("breaks")).alias("first"), F.posexplode(F.split("text", "\n")).alias("pos", "piece"))
    lines = pieces.groupBy("_key", (F.col("first") + F.col("pos")).alias("nth")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("line"), F.first("end").alias("end")  # `most` characters at most
    )
    total = rows.groupBy("_key").agg(F.max("number").alias("lines"))
    lines = lines.join(total, "_key").withColumn("open", F.col("nth") == F.col("lines"))
    blank = F.trim(F.translate("line", "\t\r", "  ")) == ""
    lines = lines.where(~F.col("open") | (F.col("end").isNull() & ~blank))
    line = F.when(F.col("open"), F.col("line")).otherwise(F.regexp_replace("line", "\r\\z", ""))
    kind = F.when(blank, "blank").when(F.try_parse_json("line").isNotNull(), "json").otherwise("dropped")
    return lines.select(F.col("_key.stream").alias("stream"), "nth", line.alias("line")).withColumn("kind", kind)
