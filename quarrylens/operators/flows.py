"""Network analytics over ``packets`` and ``flows``: plain aggregations, which Spark combines before each shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.indicators import let
from quarrylens.functions.network import looks_generated, second_level_label

# Default thresholds.
BEACON_PACKETS, BEACON_INTERVALS, BEACON_CV, BEACON_LOW, BEACON_HIGH = 6, 5, 0.30, 1.0, 600.0
SCAN_PORTS, SWEEP_HOSTS = 25, 30
EXFIL_BYTES, EXFIL_RATIO = 262_144, 0.05
ICMP_BYTES, ICMP_COUNT = 64, 20
TXT_BYTES, QUERIES, QUERIES_A_SECOND = 4000, 50, 5.0
RESPONSES, NX_RATIO = 50, 0.5
GENERATED_NAMES, SHOWN_NAMES = 3, 8


def flows(packets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Bidirectional flows of ``packets(frame_no, ts, src_ip, src_port, dst_ip, dst_port, proto, size, tcp_flags)``.

    Side a sent the flow's first packet. Flags: SYN 2, ACK 16, FIN 1, RST 4. ``by`` names columns, such as the capture's
    file, that flows do not cross.
    """
    src, dst = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    keyed = packets.select("*", F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi"), (src <= dst).alias("up"))
    flag = lambda bits: F.bool_or(F.col("tcp_flags").bitwiseAND(bits) == bits)
    sums = keyed.groupBy(*by, "lo", "hi", "proto").agg(
        F.min_by("up", "frame_no").alias("a_is_lo"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count_if("up").alias("n_up"),
        F.count_if(~F.col("up")).alias("n_down"),
        F.coalesce(F.sum(F.when(F.col("up"), F.col("size"))), F.lit(0)).alias("b_up"),
        F.coalesce(F.sum(F.when(~F.col("up"), F.col("size"))), F.lit(0)).alias("b_down"),
        flag(2).alias("saw_syn"),
        flag(18).alias("saw_synack"),
        flag(1).alias("saw_fin"),
        flag(4).alias("saw_rst"),
    )
    side = lambda x, y: F.when(F.col("a_is_lo"), x).otherwise(y)
    return sums.select(
        *by,
        side(F.col("lo.ip"), F.col("hi.ip")).alias("a_ip"),
        side(F.col("lo.port"), F.col("hi.port")).alias("a_port"),
        side(F.col("hi.ip"), F.col("lo.ip")).alias("b_ip"),
        side(F.col("hi.port"), F.col("lo.port")).alias("b_port"),
        "proto",
        "first_ts",
        "last_ts",
        side(F.col("n_up"), F.col("n_down")).alias("packets_a2b"),
        side(F.col("n_down"), F.col("n_up")).alias("packets_b2a"),
        side(F.col("b_up"), F.col("b_down")).alias("bytes_a2b"),
        side(F.col("b_down"), F.col("b_up")).alias("bytes_b2a"),
        "saw_syn",
        "saw_synack",
        "saw_fin",
        "saw_rst",
    )


def top_talkers(flow: DataFrame, k: int = 10) -> DataFrame:
    both = flow.select(F.explode(F.array("a_ip", "b_ip")).alias("ip"), (F.col("packets_a2b") + F.col("packets_b2a")).alias("p"), (F.col("bytes_a2b") + F.col("bytes_b2a")).alias("b"))
    return both.groupBy("ip").agg(F.sum("p").alias("packets"), F.sum("b").alias("bytes")).orderBy(F.desc("bytes"), "ip").limit(k)


def top_ports(flow: DataFrame, k: int = 10) -> DataFrame:
    by = flow.where("b_port <> 0").groupBy("b_port").agg(F.count("*").alias("flows"), F.sum(F.col("packets_a2b") + F.col("packets_b2a")).alias("packets"))
    return by.orderBy(F.desc("flows"), "b_port").limit(k)


def _carried(rows: DataFrame, keys: list[str], last: Column) -> DataFrame:
    """(keys, _part, _carry): for each part of a key the newest ``last`` of its earlier parts; parts are few against rows."""
    lasts = rows.groupBy(*keys, "_part").agg(last.alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return lasts.select(*keys, "_part", F.last("_last", ignorenulls=True).over(before).alias("_carry"))


def with_carry(rows: DataFrame, keys: list[str], carried: DataFrame) -> DataFrame:
    names = [*keys, "_part"]
    carried = carried.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(names)], "_carry")
    same = [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(names)]
    return rows.join(carried, same, "left").drop(*[f"_of{i}" for i in range(len(names))])


def beacons(
    events: DataFrame, keys: list[str], ts: str, order: str, packets: int = BEACON_PACKETS, intervals: int = BEACON_INTERVALS, cv: float = BEACON_CV, low: float = BEACON_LOW, high: float = BEACON_HIGH, part: Column | None = None
) -> DataFrame:
    """Keys whose events come at even intervals: mean within bounds and a small coefficient of variation.

    ``part``, an expression that never falls along ``order``, cuts a key's events, so that no task sorts all of a hot
    key's; the last time of a part is carried over to the next.
    """
    rows = events.withColumn("_part", part if part is not None else F.lit(0))
    before = F.lag(ts).over(Window.partitionBy(*keys, "_part").orderBy(order))
    if part is not None:
        rows = with_carry(rows, keys, _carried(rows, keys, F.max_by(ts, order)))
        before = F.coalesce(before, F.col("_carry"))
    gaps = rows.withColumn("_gap", F.col(ts) - before)
    some = F.when(F.col("_gap") > 0, F.col("_gap"))
    by = gaps.groupBy(*keys).agg(F.count("*").alias("n"), F.count(some).alias("n_intervals"), F.avg(some).alias("mean"), F.stddev_pop(some).alias("sd"), F.count_distinct(F.bround(some, 2)).alias("n_distinct"))
    found = by.where((F.col("n") >= packets) & (F.col("n_intervals") >= intervals) & F.col("mean").between(low, high) & (F.col("sd") / F.col("mean") <= cv) & ~((F.col("n_distinct") < 3) & (F.col("mean") < 5)))
    return found.select(*keys, "n", "mean", (F.col("sd") / F.col("mean")).alias("cv"))


def _probes(packets: DataFrame) -> DataFrame:
    syn = F.col("tcp_flags").bitwiseAND(18) == 2
    return packets.where((F.col("dst_port") != 0) & (((F.col("proto") == 6) & syn) | (F.col("proto") == 17)))


def port_scans(packets: DataFrame, ports: int = SCAN_PORTS, by: tuple[str, ...] = ()) -> DataFrame:
    found = _probes(packets).groupBy(*by, "src_ip", "dst_ip", "proto").agg(F.count_distinct("dst_port").alias("n_ports"))
    return found.where(F.col("n_ports") >= ports)


def host_sweeps(packets: DataFrame, hosts: int = SWEEP_HOSTS, by: tuple[str, ...] = ()) -> DataFrame:
    found = _probes(packets).groupBy(*by, "src_ip", "proto", "dst_port").agg(F.count_distinct("dst_ip").alias("n_hosts"))
    return found.where(F.col("n_hosts") >= hosts)


def one_sided(flow: DataFrame, least: int = EXFIL_BYTES, ratio: float = EXFIL_RATIO) -> DataFrame:
    return flow.where((F.col("bytes_a2b") >= least) & (F.col("bytes_b2a") <= ratio * F.col("bytes_a2b")))


def icmp_tunnels(packets: DataFrame, least: int = ICMP_BYTES, count: int = ICMP_COUNT, by: tuple[str, ...] = ()) -> DataFrame:
    big = packets.where((F.col("proto") == 1) & (F.col("size") - 8 >= least))
    return big.groupBy(*by, "src_ip", "dst_ip").agg(F.count("*").alias("n"), F.avg(F.col("size") - 8).alias("avg_size")).where(F.col("n") >= count)


def dns_stats(messages: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Totals of ``messages(is_response, qname, qtype, rcode, size)``: queries, responses, NXDOMAIN, bytes of TXT answers."""
    r = F.col("is_response")
    return messages.groupBy(*by).agg(
        F.count_if(~r).alias("queries"), F.count_if(r).alias("responses"), F.count_if(r & (F.col("rcode") == 3)).alias("nxdomain"), F.coalesce(F.sum(F.when(r & (F.col("qtype") == 16), F.col("size"))), F.lit(0)).alias("txt_bytes")
    )


def dns_query_rates(messages: DataFrame, queries: int = QUERIES, rate: float = QUERIES_A_SECOND) -> DataFrame:
    """Second-level labels with many queries a second of ``messages(sld, ts, is_response)``."""
    by = messages.where(~F.col("is_response")).groupBy("sld").agg(F.count("*").alias("n"), (F.max("ts") - F.min("ts")).alias("seconds"))
    return by.where((F.col("n") >= queries) & (F.col("n") >= rate * F.greatest("seconds", F.lit(1.0))))


def dns_types(messages: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How many messages have each query type."""
    return messages.groupBy(*by, "qtype").agg(F.count("*").alias("n"))


def dns_names(messages: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(qname, queries, nxdomain, txt) for each name that was asked for or answered."""
    r = F.col("is_response")
    named = messages.where("qname <> ''")
    return named.groupBy(*by, "qname").agg(F.count_if(~r).alias("queries"), F.count_if(r & (F.col("rcode") == 3)).alias("nxdomain"), F.count_if(F.col("qtype") == 16).alias("txt"))


def _labelled(messages: DataFrame, by: tuple[str, ...], n: Column) -> DataFrame:
    """(by, qname, n, label): each name once, with its second-level label, which is taken after the aggregation, once a name."""
    named = messages.where("qname <> ''").groupBy(*by, "qname").agg(n.alias("n"), F.max("qname").alias("_name"))
    return named.select(*by, "qname", "n", let(F.col("_name"), second_level_label).alias("label"))


def generated_names(messages: DataFrame, by: tuple[str, ...], least: int = GENERATED_NAMES, shown: int = SHOWN_NAMES) -> DataFrame:
    """(by, n_names, many, names): captures with names that look generated; ``many`` from ``least`` on, the first ones in order."""
    names = _labelled(messages, by, F.count("*")).where(let(F.col("label"), looks_generated)).select(*by, "qname")
    first = names.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("qname"))).where(F.col("place") <= shown)
    first = first.groupBy(*by).agg(F.sort_array(F.collect_list("qname")).alias("names"))
    return names.groupBy(*by).agg(F.count("*").alias("n_names")).withColumn("many", F.col("n_names") >= least).join(first, list(by))


def txt_volume(stats: DataFrame, least: int = TXT_BYTES) -> DataFrame:
    return stats.where(F.col("txt_bytes") >= least)


def busy_labels(messages: DataFrame, durations: DataFrame, by: tuple[str, ...], queries: int = QUERIES, rate: float = QUERIES_A_SECOND) -> DataFrame:
    """Second-level labels with many queries a second of their capture, of ``durations(by, seconds)``."""
    asked = _labelled(messages, by, F.count_if(~F.col("is_response"))).groupBy(*by, F.col("label").alias("sld")).agg(F.sum("n").alias("n"))
    return asked.join(durations, list(by)).where((F.col("seconds") > 0) & (F.col("n") >= queries) & (F.col("n") / F.col("seconds") >= rate)).select(*by, "sld", "n")


def capture_summary(packets: DataFrame, hellos: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, packets, seconds, hosts, names, fingerprints): totals of each capture, of ``hellos(by, server_name, ja3)``.

    Hosts are counted once for both ends; each is expanded from its packet and combined before the shuffle.
    """
    ends = packets.select(*by, "ts", F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    totals = ends.groupBy(*by).agg((F.count("*") / 2).cast("long").alias("packets"), (F.max("ts") - F.min("ts")).alias("seconds"), F.count_distinct("ip").alias("hosts"))
    tls = hellos.groupBy(*by).agg(F.count_distinct(F.when(F.col("server_name") != "", F.col("server_name"))).alias("names"), F.count_distinct("ja3").alias("fingerprints"))
    zero = F.lit(0).cast("long")
    return totals.join(tls, list(by), "left").select(*by, "packets", "seconds", "hosts", F.coalesce("names", zero).alias("names"), F.coalesce("fingerprints", zero).alias("fingerprints"))


def nxdomain_ratio(stats: DataFrame, responses: int = RESPONSES, ratio: float = NX_RATIO) -> DataFrame:
    return stats.where((F.col("responses") >= responses) & (F.col("nxdomain") >= ratio * F.col("responses")))


def last_challenge(messages: DataFrame, flow: list[str], order: str, part: Column | None = None) -> DataFrame:
    """As-of fill: each message with the latest challenge before it on its flow; for ``part`` see ``beacons``."""
    rows = messages.withColumn("_part", part if part is not None else F.lit(0))
    w = Window.partitionBy(*flow, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    latest = F.last("challenge", ignorenulls=True).over(w)
    if part is not None:
        rows = with_carry(rows, flow, _carried(rows, flow, F.max_by("challenge", F.when(F.col("challenge").isNotNull(), F.col(order)))))
        latest = F.coalesce(latest, F.col("_carry"))
    return rows.withColumn("as_of", latest).select(*messages.columns, "as_of")
