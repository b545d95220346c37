"""Reading byte ranges through an index, and keeping track of what a sparse copy has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(index: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Chunks that hold bytes of a range. ranges: key, begin, length (0: to the end). A range that begins past the end has none."""
    end = F.when(F.col("length") > 0, F.col("begin") + F.col("length")).otherwise(F.lit(2**62))
    r = ranges.withColumn("stop", end)
    return index.join(r, key).where((F.col("start") < F.col("stop")) & (F.col("start") + F.col("size") > F.col("begin")))


def cat(chunks: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """key, begin, length, data of each range; chunks have payload. Only the chunks that overlap are read, first and last cut."""
    own = overlapping(chunks, ranges, key)
    begin = F.greatest(F.col("begin") - F.col("start"), F.lit(0))
    stop = F.least(F.col("stop") - F.col("start"), F.col("size"))
    own = own.withColumn("payload", F.substring(F.col("payload"), (begin + 1).cast("int"), (stop - begin).cast("int")))
    return own.groupBy(key, "begin", "length").agg(F.expr("listagg(payload) within group (order by pos)").alias("data"))


def positions(index: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """key, begin, length, first, last: the chunks to load for a range.

    The first is the first whose end lies past begin; with a length below 1 it is also the last. Past the end the
    last chunk stands in; there a length below 1 has no positions.
    """
    ends = index.groupBy(key).agg(F.max("pos").alias("top"))
    past = F.col("start") + F.col("size") > F.col("begin")
    found = ranges.join(index, key).groupBy(key, "begin", "length").agg(F.min(F.when(past, F.col("pos"))).alias("a"), F.max(F.when(F.col("start") <= F.col("begin") + F.col("length") - 1, F.col("pos"))).alias("b"))
    first = F.coalesce("a", F.when(F.col("length") >= 1, F.col("top")))
    last = F.when((F.col("length") < 1) | F.col("a").isNull(), first).otherwise(F.greatest("a", "b"))
    return found.join(ends, key).select(key, "begin", "length", first.cast("long").alias("first"), last.cast("long").alias("last"))


def to_load(index: DataFrame, wanted: DataFrame, loaded: DataFrame, key: str, null_id: str) -> DataFrame:
    """key, pos of chunks that ranges need and a sparse copy lacks; null chunks need no loading."""
    need = wanted.where("first is not null").select(key, F.explode(F.sequence("first", "last")).alias("pos")).distinct()
    return index.where(F.col("id") != null_id).join(need, [key, "pos"], "left_semi").join(loaded, [key, "pos"], "left_anti").select(key, "pos")


def saved_state(index: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """key, state: one bit for each position, lowest bit first, padded to whole bytes."""
    bits = index.select(key, "pos").join(loaded.select(key, "pos", F.lit(1).alias("on")), [key, "pos"], "left")
    octet = bits.groupBy(key, F.floor(F.col("pos") / 8).alias("byte")).agg(F.sum(F.coalesce("on", F.lit(0)) * F.expr("shiftleft(1, cast(pos % 8 as int))")).alias("v"))
    return octet.groupBy(key).agg(F.expr("unhex(listagg(lpad(hex(v), 2, '0')) within group (order by byte))").alias("state"))


def loaded_state(states: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(key, pos) of set bits; a state of another size than its index needs is an error."""
    n = index.groupBy(key).agg(F.count("*").alias("n"))
    ok = F.length("state") == F.ceil(F.col("n") / 8)
    checked = states.join(n, key).withColumn("state", F.when(ok, F.col("state")).otherwise(F.raise_error(F.lit("state doesn't fit the index"))))
    each = checked.select(key, "n", "state", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    octet = F.conv(F.hex(F.substring(F.col("state"), (F.floor(F.col("pos") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return each.withColumn("octet", octet).where(F.expr("shiftright(octet, cast(pos % 8 as int)) & 1") == 1).select(key, F.col("pos").cast("long").alias("pos"))
