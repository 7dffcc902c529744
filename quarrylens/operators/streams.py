"""Assembly of TCP streams, one direction at a time: positions, islands, heads, and the HTTP messages at their start.

``packets`` has file, frame_no (unique in a file), src_ip, src_port, dst_ip, dst_port, proto, tcp_flags, tcp_seq and
payload. A direction is the five columns of FLOW. A SYN without payload begins a new connection of its direction.

Sequence numbers have 32 bits and wrap. A position is the running sum of the signed differences between neighbours in
the order of frames, so that it grows on through any number of wraps; position 0 is behind the SYN or, if there is none,
at the least position of bytes. A byte that arrives more than once is taken from the frame that came first.

``part`` is an expression over a packet that never falls along frame_no; it cuts the packets of a hot direction, so
that no task sorts all of them. What a part needs of the earlier ones comes from one row a part and connection in it.

Defined results: null payloads are empty; packets of other protocols or without a sequence number are left out; bytes in
front of position 0 are dropped; a direction without bytes has no head and no island; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.indicators import let

FLOW = ["file", "src_ip", "src_port", "dst_ip", "dst_port"]
STREAM = [*FLOW, "connection"]
#: Bytes of a head, of the blocks in which overlaps are resolved, and of the parts in which islands are found.
HEAD_BYTES, BLOCK_BYTES, PART_BYTES = 16_384, 512, 1 << 28
# Request methods.
METHODS = ("GET", "POST", "HEAD", "PUT", "DELETE", "OPTIONS", "PATCH", "CONNECT", "TRACE", "PROPFIND", "MKCOL", "MOVE", "COPY")


def _signed(difference: Column) -> Column:
    """A difference of 32-bit numbers, from -2 ** 31 on."""
    return F.pmod(difference + (1 << 31), F.lit(1 << 32)) - (1 << 31)


def positions(packets: DataFrame, part: Column | None = None) -> DataFrame:
    """(FLOW, connection, frame_no, begin, end, payload): where each packet's bytes lie in their connection."""
    payload = F.coalesce("payload", F.lit(b""))
    rows = packets.where((F.col("proto") == 6) & F.col("tcp_seq").isNotNull()).select(*FLOW, "frame_no", F.col("tcp_seq").cast("long").alias("seq"), payload.alias("payload"), F.col("tcp_flags").bitwiseAND(2).alias("syn"))
    opens = (F.col("syn") != 0) & (F.length("payload") == 0)
    rows = rows.select(*FLOW, "frame_no", "payload", opens.alias("opens"), F.when(opens, F.col("seq") + 1).otherwise(F.col("seq")).alias("seq"), (part if part is not None else F.lit(0)).alias("_part"))
    by_frame = Window.partitionBy(*FLOW, "_part").orderBy("frame_no")
    so_far = by_frame.rowsBetween(Window.unboundedPreceding, 0)
    step = _signed(F.col("seq") - F.lag("seq").over(by_frame))
    rows = rows.withColumn("_step", F.coalesce(step, F.lit(0))).withColumn("_no", F.sum(F.col("opens").cast("long")).over(so_far)).withColumn("_at", F.sum("_step").over(so_far))
    data = rows.where(F.length("payload") > 0).select(*FLOW, "_part", "_no", "_at", "frame_no", "payload")
    found = data.join(_shifts(rows), [*FLOW, "_part", "_no"]).withColumn("from", F.col("_at") + F.col("shift")).withColumn("cut", F.greatest(-F.col("from"), F.lit(0)))
    out = found.select(*STREAM, "frame_no", F.greatest("from", F.lit(0)).alias("begin"), (F.col("from") + F.length("payload")).alias("end"), F.substring("payload", (F.col("cut") + 1).cast("int"), F.length("payload")).alias("payload"))
    return out.where(F.col("end") > F.col("begin"))


def _shifts(rows: DataFrame) -> DataFrame:
    """(FLOW, _part, _no, connection, shift): what turns the running sums within a part into connections and positions."""
    has = F.length("payload") > 0
    groups = rows.groupBy(*FLOW, "_part", "_no").agg(
        F.min_by("seq", "frame_no").alias("first"), F.max_by("seq", "frame_no").alias("last"), F.max_by("_at", "frame_no").alias("reach"), F.min(F.when(F.col("opens"), F.col("_at"))).alias("open_at"), F.min(F.when(has, F.col("_at"))).alias("data_at")
    )
    order = Window.partitionBy(*FLOW).orderBy("_part", "_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    within = F.lag("_part").over(order) == F.col("_part")
    grown = lambda c: F.col(c) - F.when(within, F.lag(c).over(order)).otherwise(0)
    jump = F.when(within, 0).otherwise(F.coalesce(_signed(F.col("first") - F.lag("last").over(order)), F.lit(0)))
    groups = groups.withColumn("_more", grown("_no")).withColumn("_moved", grown("reach") + jump)
    groups = groups.withColumn("connection", F.sum("_more").over(so_far)).withColumn("offset", F.sum("_moved").over(so_far) - F.col("reach"))
    one = Window.partitionBy(*STREAM)
    base = F.coalesce(F.min(F.col("open_at") + F.col("offset")).over(one), F.min(F.col("data_at") + F.col("offset")).over(one))
    return groups.select(*FLOW, "_part", "_no", "connection", (F.col("offset") - base).alias("shift"))


def islands(placed: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(STREAM, begin, end, segments): the runs of bytes without gap, of ``positions``; gaps lie between them.

    A connection's segments are merged in parts of ``part_bytes``, and the runs of its parts with each other.
    """

    def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("begin", "end")
        starts = F.coalesce(F.col("begin") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
        number = F.sum(F.col("_starts").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
        runs = rows.withColumn("_starts", starts).withColumn("_run", number)
        return runs.groupBy(*keys, "_run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("segments").alias("segments")).drop("_run")

    rows = placed.select(*STREAM, "begin", "end", F.lit(1).cast("long").alias("segments"), F.floor(F.col("begin") / part_bytes).alias("_part"))
    return merged(merged(rows, [*STREAM, "_part"]).drop("_part"), STREAM)


def heads(placed: DataFrame, most: int = HEAD_BYTES) -> DataFrame:
    """(STREAM, first_frame, head): each connection's bytes from position 0 to the first gap, ``most`` at most.

    Segments are cut at multiples of BLOCK_BYTES. Equal pieces are combined before the shuffle, so that retransmissions
    cost a row a task; a block's pieces and a head's blocks are bounded by these sizes.
    """
    near = placed.where(F.col("begin") < most).withColumn("end", F.least("end", F.lit(most)))
    block = near.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / BLOCK_BYTES), F.floor((F.col("end") - 1) / BLOCK_BYTES))))
    low, high = F.greatest("begin", F.col("block") * BLOCK_BYTES), F.least("end", (F.col("block") + 1) * BLOCK_BYTES)
    piece = block.select(*STREAM, "block", "frame_no", low.alias("low"), high.alias("high"), F.substring("payload", (low - F.col("begin") + 1).cast("int"), (high - low).cast("int")).alias("bytes"))
    first = piece.groupBy(*STREAM, "block", "low", "high").agg(F.min(F.struct("frame_no", "bytes")).alias("x"))
    pieces = first.groupBy(*STREAM, "block").agg(F.sort_array(F.collect_list(F.struct("x.frame_no", "low", "high", "x.bytes"))).alias("pieces"))

    def resolved(p: Column) -> Column:
        """Between neighbouring ends of pieces, the bytes of the first frame that has them."""
        stops = F.array_sort(F.array_distinct(F.concat(F.transform(p, lambda x: x["low"]), F.transform(p, lambda x: x["high"]))))

        def between(a: Column, b: Column) -> Column:
            holder = F.get(F.filter(p, lambda x: (x["low"] <= a) & (x["high"] >= b)), F.lit(0))
            return let(holder, lambda h: F.struct(a.alias("low"), b.alias("high"), F.substring(h["bytes"], (a - h["low"] + 1).cast("int"), (b - a).cast("int")).alias("bytes")))

        spans = lambda s: F.transform(F.slice(s, 1, F.size(s) - 1), lambda a, i: between(a, F.get(s, i + 1)))
        return F.filter(let(stops, spans), lambda x: x["bytes"].isNotNull())

    blocks = pieces.select(*STREAM, F.array_min(F.transform("pieces", lambda x: x["frame_no"])).alias("frame"), resolved(F.col("pieces")).alias("spans"))
    whole = blocks.groupBy(*STREAM).agg(F.min("frame").alias("first_frame"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("head"))
    grown = lambda a, x: F.when(x["low"] == a["at"], F.struct(x["high"].alias("at"), F.concat(a["head"], x["bytes"]).alias("head"))).otherwise(a)
    return whole.select(*STREAM, "first_frame", F.aggregate("spans", start, grown, lambda a: a["head"]).alias("head")).where(F.length("head") > 0)


def _head_lines(head: Column) -> Column:
    """The lines in front of the first empty one, null if there is none; both kinds of line ends count."""
    text = F.decode(head, "ISO-8859-1")
    ends = lambda t: F.when(t.contains("\r\n\r\n"), F.substring_index(t, "\r\n\r\n", 1)).when(t.contains("\n\n"), F.substring_index(t, "\n\n", 1))
    return let(text, lambda t: F.split(ends(t), r"\r\n|\n"))


def _field(lines: Column, name: str) -> Column:
    """The value of the last header of a name, an empty text if there is none."""
    named = F.filter(F.slice(lines, 2, F.size(lines)), lambda x: F.lower(F.trim(F.substring_index(x, ":", 1))) == name)
    return F.coalesce(F.trim(F.regexp_replace(F.try_element_at(F.filter(named, lambda x: x.contains(":")), F.lit(-1)), "^[^:]*:", "")), F.lit(""))


def http_requests(found: DataFrame) -> DataFrame:
    """(STREAM, first_frame, method, uri, host, user_agent, basic_auth) of the heads that begin with a request."""
    lines = found.withColumn("lines", _head_lines(F.col("head"))).where(F.col("lines").isNotNull())
    first = F.split(F.get("lines", F.lit(0)), " ", 3)
    asked = lines.where(F.get(first, F.lit(0)).isin(*METHODS) & (F.size(first) >= 2))
    return asked.select(*STREAM, "first_frame", F.get(first, F.lit(0)).alias("method"), F.get(first, F.lit(1)).alias("uri"), _field(F.col("lines"), "host").alias("host"), _field(F.col("lines"), "user-agent").alias("user_agent"), F.lower(_field(F.col("lines"), "authorization")).startswith("basic ").alias("basic_auth"))


def http_responses(found: DataFrame) -> DataFrame:
    """(STREAM, first_frame, status, reason, server, content_type, content_length) of the heads that begin with a response."""
    lines = found.withColumn("lines", _head_lines(F.col("head"))).where(F.col("lines").isNotNull())
    told = lines.where(F.get("lines", F.lit(0)).rlike(r"^HTTP/1\.\S* \d{1,9}(?: |$)"))
    first = F.split(F.get("lines", F.lit(0)), " ", 3)
    length = F.expr("try_cast(_length AS bigint)")
    out = told.withColumn("_length", _field(F.col("lines"), "content-length"))
    return out.select(*STREAM, "first_frame", F.get(first, F.lit(1)).cast("int").alias("status"), F.coalesce(F.get(first, F.lit(2)), F.lit("")).alias("reason"), _field(F.col("lines"), "server").alias("server"), _field(F.col("lines"), "content-type").alias("content_type"), F.coalesce(length, F.lit(0)).alias("content_length"))
