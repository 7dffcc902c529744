"""Resharding by minimum-cost flow.

From the sizes of the old shards and the capacities of the new ones a flow network is solved on the driver; it has one
arc a shard and a hub, so work grows with the number of shards alone. Each unit of flow between different shards costs one byte moved,
staying costs nothing. The flow decides all transfers: how many bytes of which old shard go to which new one. It is
then applied to rows, which cannot be cut:

1. An old shard's rows above 1/256 of a new shard's size (at most 256 of them for each new shard, so this list is
   bounded by the shard count) are fitted into its transfers, the largest first, each into the one with most room.
2. The other rows are laid out along a byte axis, which is cut where the room that is left in the transfers says;
   every row goes where its middle byte lies.
3. What rounding is left, up to a row a transfer, is corrected by moving single rows of step 1 from the fullest to
   the emptiest shard, as long as that brings the two nearer to each other and they differ by more than 1/64.

Defined results: a null text has size 16 and CRC-32 0; a null source is an old shard like any other; repeated rows
each get a slot; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import materialize

ROW_OVERHEAD = 16
LARGE_SHARE, TOLERANCE = 256, 64
BLOCK_ROWS, TOP_BLOCKS = 8192, 1024
#: What names a row of a table of files.
FILE_ROW = ("_metadata.file_path", "_metadata.row_index")


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[dict[int, int]]:
    """Cheapest flow that ships every supply, as one {new shard: amount} for each old shard.

    Successive shortest paths with node potentials (Dijkstra on reduced costs). Costs are not negative. The
    capacities must hold the whole supply.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities do not hold the supply")
    flow: list[dict[int, int]] = [{} for _ in range(n)]
    left, room = list(supply), list(capacity)
    high = [0] * (n + m)  # potentials: old shards, then new shards
    while any(left):
        dist: list[float] = [float("inf")] * (n + m)
        came: list[int] = [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        done = [False] * (n + m)
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = True
            if u < n:
                steps = ((n + j, cost[u][j]) for j in range(m))
            else:
                steps = ((i, -cost[i][u - n]) for i in range(n) if flow[i].get(u - n))
            for v, c in steps:
                nd = d + c + high[u] - high[v]
                if nd < dist[v]:
                    dist[v], came[v] = nd, u
                    heapq.heappush(heap, (nd, v))
        ends = [j for j in range(m) if room[j] and dist[n + j] < float("inf")]
        end = min(ends, key=lambda j: dist[n + j] + high[n + j])
        far = max(x for x in dist if x < float("inf"))
        path, v = [n + end], n + end
        while came[v] >= 0:
            v = came[v]
            path.append(v)
        path.reverse()
        amount = min(left[path[0]], room[end])
        for a, b in zip(path, path[1:], strict=False):
            if a >= n:
                amount = min(amount, flow[b][a - n])
        for a, b in zip(path, path[1:], strict=False):
            if a < n:
                flow[a][b - n] = flow[a].get(b - n, 0) + amount
            else:
                flow[b][a - n] -= amount
        left[path[0]] -= amount
        room[end] -= amount
        high = [h + (d if d < float("inf") else far) for h, d in zip(high, dist, strict=True)]
    return [{j: f for j, f in sorted(x.items()) if f} for x in flow]


def stay_or_move(supply: list[int], capacity: list[int]) -> list[dict[int, int]]:
    """``min_cost_flow`` for costs of 0 to stay (old shard i in new shard i) and 1 to move, on a network of n + m arcs.

    Every old shard has one arc to its own new shard, and one to a hub from which all new shards are reached; the hub
    stands for n * m arcs of equal cost. The primal-dual method needs two steps there: with potentials of 0 the arcs that
    stay are filled as far as both ends allow; with potentials of 1 the arcs of the hub are, in the order of the shards.
    Work and result are linear in the shards.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities do not hold the supply")
    flow: list[dict[int, int]] = [{} for _ in supply]
    left, room = list(supply), list(capacity)
    for i in range(min(len(left), len(room))):
        if stays := min(left[i], room[i]):
            flow[i][i] = stays
            left[i] -= stays
            room[i] -= stays
    j = 0
    for i, rest in enumerate(left):
        while rest:
            if moved := min(rest, room[j]):
                flow[i][j] = flow[i].get(j, 0) + moved
                rest -= moved
                room[j] -= moved
            else:
                j += 1
    return [dict(sorted(x.items())) for x in flow]


def place_large(large: list[tuple[int, int, int]], flow: list[dict[int, int]]) -> tuple[dict[int, int], list[dict[int, int]]]:
    """Shards for (uid, size, old shard) within the transfers of ``flow``, and the room that each transfer has left."""
    room, at = [dict(x) for x in flow], {}
    for uid, size, old in sorted(large, key=lambda x: (-x[1], x[0])):
        at[uid] = max(room[old], key=lambda j: (room[old][j], -j))
        room[old][at[uid]] -= size
    return at, room


def correct(at: dict[int, int], large: list[tuple[int, int, int]], held: list[int], tolerance: float) -> int:
    """Even out ``held``, the bytes of the new shards, by moves of single large rows; changes both, returns their number."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for uid, size, _ in large:
        rows.setdefault(at[uid], []).append((size, uid))
    moves, fit = 0, []
    while True:
        empty = min(range(len(held)), key=held.__getitem__)
        for full in sorted(rows, key=lambda j: -held[j]):  # one that holds a single very large row cannot give any
            gap = held[full] - held[empty]
            fit = [x for x in rows[full] if x[0] < gap] if gap > tolerance else []
            if fit or gap <= tolerance:
                break
        if not fit:
            return moves
        size, uid = min(fit, key=lambda x: (abs(gap - 2 * x[0]), x[1]))
        rows[full].remove((size, uid))
        rows.setdefault(empty, []).append((size, uid))
        at[uid] = empty
        held[full] -= size
        held[empty] += size
        moves += 1


def cut_points(flow: list[dict[int, int]], room: list[dict[int, int]], small: list[int]) -> list[tuple[int, int, int, int]]:
    """(old, low, high, new): where the byte axis of each old shard's small rows is cut."""
    cuts = []
    for i, out in enumerate(room):
        free = {j: max(0, r) for j, r in out.items()}
        total, done, low = sum(free.values()), 0, 0
        for j, r in free.items():
            done += r
            high = small[i] * done // total if total else 0
            if high > low:
                cuts.append((i, low, high, j))
                low = high
        # The end is open, and an old shard whose transfers are full keeps to its largest one.
        last = cuts.pop()[1::2] if low else (0, max(flow[i], key=lambda j: (flow[i][j], -j), default=0))
        cuts.append((i, last[0], 1 << 62, last[1]))
    return cuts


def reshard(rows: DataFrame, n_old: int, n_new: int) -> DataFrame:
    """Shards for ``rows(size long, old int, ...)``, with old in 0 to n_old - 1; adds shard int and slot long.

    ``rows`` are written to the shared folder once; all later steps read that table, whose rows carry no text.
    """
    spark = rows.sparkSession
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    sizes = {r["old"]: (r["b"], r["n"]) for r in rows.groupBy("old").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    total, count = sum(b for b, _ in sizes.values()), sum(n for _, n in sizes.values())
    bar = max(1, int(total / n_new / LARGE_SHARE))
    large = [tuple(r) for r in rows.where(F.col("size") > bar).select("uid", "size", "old").collect()]  # at most LARGE_SHARE a shard
    supply = [sizes.get(i, (0, 0))[0] for i in range(n_old)]
    flow = stay_or_move(supply, [-(-total // n_new)] * n_new)
    at, room = place_large(large, flow)
    small = list(supply)
    for _, size, old in large:
        small[old] -= size
    cuts = cut_points(flow, room, small)
    held = [0] * n_new
    for uid, size, _ in large:
        held[at[uid]] += size
    for i, low, high, j in cuts:
        held[j] += min(high, small[i]) - low
    correct(at, large, held, total / n_new / TOLERANCE)
    cuts = spark.createDataFrame(cuts or [(0, 0, 0, 0)], "old int, low long, high long, to int")
    fixed = spark.createDataFrame(list(at.items()) or [(-1, 0)], "uid long, fixed int")

    blocks = max(1024, count // BLOCK_ROWS)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")).withColumn("small", F.when(F.col("size") > bar, 0).otherwise(F.col("size")))
    inside = Window.partitionBy("old", "block").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.repartition("block")
        .withColumn("inside", F.coalesce(F.sum("small").over(inside), F.lit(0)))
        .join(_starts(rows, "old", F.sum("small")), ["old", "block"])
        .withColumn("mid", F.col("start") + F.col("inside") + F.expr("small div 2"))
        .join(F.broadcast(fixed), "uid", "left")
        .join(F.broadcast(cuts), (rows["old"] == cuts["old"]) & (F.col("mid") >= cuts["low"]) & (F.col("mid") < cuts["high"]) & F.col("fixed").isNull(), "left")
        .drop(cuts["old"])
        .withColumn("shard", F.coalesce("fixed", "to").cast("int"))
        .drop("low", "high", "to", "fixed", "start", "inside", "mid", "small")
    )
    placed = materialize(placed, "placed")
    # Gapless numbers within each shard: numbers within a block plus what lies before.
    inside = Window.partitionBy("shard", "block").orderBy("uid")
    numbered = placed.repartition("block").withColumn("k", F.row_number().over(inside)).join(_starts(placed, "shard", F.count("*")), ["shard", "block"])
    return numbered.withColumn("slot", (F.col("start") + F.col("k") - 1).cast("long")).drop("start", "k", "uid", "block")


def _starts(rows: DataFrame, group: str, value: Column) -> DataFrame:
    """(group, block, start): running sums of ``value`` over the blocks before, in two levels, so that no task sees a whole group's blocks."""
    top = F.expr(f"block div {TOP_BLOCKS}")
    each = rows.groupBy(group, "block", top.alias("top")).agg(value.alias("v"))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = each.groupBy(group, "top").agg(F.sum("v").alias("v")).select(group, "top", F.coalesce(F.sum("v").over(before([group], "top")), F.lit(0)).alias("high"))
    low = F.coalesce(F.sum("v").over(before([group, "top"], "block")), F.lit(0)).alias("low")
    return each.select(group, "top", "block", low).join(tops, [group, "top"]).select(group, "block", (F.col("high") + F.col("low")).alias("start"))


def reshard_documents(docs: DataFrame, old_shard: Column, n_old: int = 32, n_new: int = 40, keep: tuple[str, ...] = ()) -> DataFrame:
    """Move documents from ``n_old`` shards (``old_shard`` gives each row's) to ``n_new`` of near equal bytes.

    ``keep`` adds columns, such as FILE_ROW for ``rewrite_affected``.
    """
    text = F.col("text").cast("binary")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        old_shard.cast("int").alias("old"),
        *keep,
    )
    return reshard(rows, n_old, n_new)


def rewrite_affected(docs: DataFrame, placed: DataFrame, out: str) -> DataFrame:
    """Write the shards that gain or lose rows to ``out`` (one folder a shard); the others stay as they are.

    ``placed`` is the result of ``reshard_documents`` over the same files with FILE_ROW kept: a row is known by its
    file and its place in it, so null and repeated ids and repeated rows go where they belong. Returns
    (shard, rewritten): shards that are missing there keep their old files. Rows are spread over 16 writers a shard.
    """
    changed = placed.where("old <> shard")
    touched = changed.select(F.explode(F.array("old", "shard")).alias("shard")).distinct()
    moves = placed.join(F.broadcast(touched), "shard", "left_semi").select(F.col("file_path").alias("_file"), F.col("row_index").alias("_row"), F.col("shard").alias("_shard"))
    rows = docs.select(F.struct("*").alias("_doc"), *[F.col(c).alias(n) for c, n in zip(FILE_ROW, ("_file", "_row"), strict=True)])
    rows = rows.join(moves, ["_file", "_row"]).select("_doc.*", "_file", "_row", F.col("_shard").alias("shard"))
    rows.repartition("shard", F.pmod(F.xxhash64("_file", "_row"), F.lit(16))).drop("_file", "_row").write.partitionBy("shard").parquet(out)
    return touched.withColumn("rewritten", F.lit(True))
