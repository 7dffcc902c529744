"""Members of nested archives rolled up to their archives: depth limit, byte budget, bomb test, verdicts carried upwards.

``members`` has file, id and parent (unique within a file; a file's own row has no parent), position among its siblings,
name, size and packed (bytes, after and before they are unpacked), encrypted and verdict (malicious, suspicious or another).
Joins of a level with its members walk from each file down, one level at a time as far as the depth limit, so members of a
cycle or of a parent that is missing are never reached. No table of members is broadcast, whatever size Spark expects.

Bytes are spent in the order of unpacking: all members of an archive, then the members of its first member, and so on. A
member is read whole while the budget lasts, then in part, then not at all. A huge file's running sum is
cut into parts by the places of its own members, which hand on their totals.

Defined results: null sizes are 0 and null flags false; a repeated id is a member each time; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.operators.findings import SEVERITY
from quarrylens.operators.flows import with_carry
from quarrylens.storage import fresh_path

# Depth, bytes of a member and of a file, and the shape of a bomb.
DEPTH, MEMBER_BYTES, TOTAL_BYTES = 4, 64 << 20, 512 << 20
BOMB_RATIO, BOMB_BYTES = 200, 8 << 20
#: Members of a file in one part of its running sum, by the place of their first ancestor below the file.
PART_PLACES = 1000


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _walk(rows: DataFrame, path: str, depth: int) -> DataFrame:
    """(file, id, depth, path, ids) of all that is reached, to one level beyond ``depth``; each level is stored."""
    columns = lambda n, path, ids: ["file", "id", F.lit(n).alias("depth"), path.alias("path"), ids.alias("ids"), "opens"]
    level = rows.where("parent IS NULL").select(*columns(0, F.array().cast("array<bigint>"), F.array("id")))
    level = walk = _stored(level, path + "/walk0")
    for n in range(1, depth + 2):
        above = level.where("opens").select("file", F.col("id").alias("parent"), F.col("path").alias("_path"), F.col("ids").alias("_ids"))
        below = rows.join(above.hint("merge"), ["file", "parent"])
        level = _stored(below.select(*columns(n, F.concat("_path", F.array("position")), F.concat("_ids", F.array("id")))), f"{path}/walk{n}")
        walk = walk.unionByName(level)
    return walk.drop("opens")


def expand(members: DataFrame, depth: int = DEPTH, member_bytes: int = MEMBER_BYTES, total_bytes: int = TOTAL_BYTES, bomb_ratio: int = BOMB_RATIO, bomb_bytes: int = BOMB_BYTES) -> DataFrame:
    """(file, id, name, depth, ids, status, taken, verdict): what happens to each member, and how many bytes are unpacked.

    status: read, partial, budget, bomb, encrypted, depth (beyond the limit), file (the file itself) or unreached.
    """
    spark = members.sparkSession
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    size, packed = F.coalesce(F.col("size").cast("long"), F.lit(0)), F.greatest(F.coalesce(F.col("packed").cast("long"), F.lit(0)), F.lit(1))
    rows = members.select("file", "id", "parent", F.col("position").cast("long").alias("position"), "name", size.alias("size"), flag("encrypted").alias("encrypted"), "verdict", ((size >= bomb_bytes) & (size >= bomb_ratio * packed)).alias("bomb"))
    # What is no bomb, not encrypted and not cut off by its own size may be opened.
    may = F.col("parent").isNull() | ~(F.col("bomb") | F.col("encrypted") | (F.col("size") > member_bytes))
    path = fresh_path(spark, "members")
    rows = _stored(rows.withColumn("opens", F.max(may).over(Window.partitionBy("file", "id"))), path + "/rows")
    walk = _walk(rows, path, depth).distinct()
    rows = rows.drop("opens")
    found = rows.join(walk.hint("merge"), ["file", "id"], "left")
    up = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    reached = F.col("depth").between(1, depth)
    spends = reached & ~F.col("bomb") & ~F.col("encrypted")
    cost = F.when(spends, F.least("size", F.lit(member_bytes))).otherwise(F.lit(0))
    first = F.when(F.size("path") > 1, F.floor(F.get("path", F.lit(0)) / PART_PLACES)).otherwise(F.lit(-1))
    spent = found.where(reached).select("file", "id", "path", up.alias("up"), F.try_element_at("path", F.lit(-1)).alias("place"), cost.alias("cost"), first.alias("_part"))
    total = spent.groupBy("file", "_part").agg(F.sum("cost").alias("x"))
    before = total.select("file", "_part", F.sum("x").over(Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    own = F.sum("cost").over(Window.partitionBy("file", "_part").orderBy("up", "place", "id").rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0).cast("long")
    spent = with_carry(spent, ["file"], before).select("file", "id", "path", (F.coalesce(own, zero) + F.coalesce("_carry", zero)).alias("before"))
    out = found.join(spent.hint("merge"), ["file", "id", "path"], "left")
    taken = F.when(spends, F.greatest(F.lit(0), F.least(F.col("size"), F.lit(member_bytes), F.lit(total_bytes) - F.col("before")))).otherwise(zero).cast("long")
    out = out.withColumn("taken", F.coalesce(taken, zero))
    status = (
        F.when(F.col("depth").isNull(), "unreached")
        .when(F.col("depth") == 0, "file")
        .when(F.col("depth") > depth, "depth")
        .when(F.col("encrypted"), "encrypted")
        .when(F.col("bomb"), "bomb")
        .when(F.col("taken") == F.col("size"), "read")
        .when(F.col("taken") > 0, "partial")
        .otherwise("budget")
    )
    return _stored(out.select("file", "id", "name", "depth", "ids", status.alias("status"), "taken", "verdict"), path + "/expanded")


def _rank(verdict: Column) -> Column:
    return F.when(verdict == "malicious", 2).when(verdict == "suspicious", 1).otherwise(0)


def rolled_up(expanded: DataFrame) -> DataFrame:
    """(file, id, verdict, members, bytes): the worst verdict of each archive or file and what was read below it, with counts.

    A member's verdict goes up to every ancestor; each row is combined within a task, at most once an ancestor.
    """
    seen = expanded.where(F.col("status").isin("file", "read", "partial"))
    each = seen.select("file", F.col("id").alias("own"), F.explode("ids").alias("id"), _rank(F.col("verdict")).alias("rank"), "taken")
    worst = each.groupBy("file", "id").agg(F.max("rank").alias("rank"), F.count_if(F.col("own") != F.col("id")).alias("members"), F.coalesce(F.sum(F.when(F.col("own") != F.col("id"), F.col("taken"))), F.lit(0)).alias("bytes"))
    verdict = F.when(F.col("rank") == 2, "malicious").when(F.col("rank") == 1, "suspicious").otherwise("clean")
    return worst.select("file", "id", verdict.alias("verdict"), "members", "bytes")


def findings(expanded: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(file, id, rule, severity, n): of each archive, how many of its members meet a rule."""
    inner = expanded.where("size(ids) > 1").select("file", F.element_at("ids", -2).alias("id"), F.col("id").alias("member"), "status")
    of = verdicts.select("file", F.col("id").alias("member"), "verdict")
    told = inner.join(of.hint("merge"), ["file", "member"], "left")
    open_ = F.col("status").isin("read", "partial")
    rule = (
        F.when(F.col("status") == "encrypted", F.struct(F.lit("archive.encrypted_member").alias("rule"), F.lit(SEVERITY["medium"]).alias("severity")))
        .when(F.col("status") == "bomb", F.struct(F.lit("archive.zip_bomb").alias("rule"), F.lit(SEVERITY["high"]).alias("severity")))
        .when(F.col("status") == "depth", F.struct(F.lit("archive.depth_limit").alias("rule"), F.lit(SEVERITY["info"]).alias("severity")))
        .when(F.col("status") == "budget", F.struct(F.lit("archive.budget_exhausted").alias("rule"), F.lit(SEVERITY["info"]).alias("severity")))
        .when(open_ & (F.col("verdict") == "malicious"), F.struct(F.lit("archive.member_malicious").alias("rule"), F.lit(SEVERITY["high"]).alias("severity")))
        .when(open_ & (F.col("verdict") == "suspicious"), F.struct(F.lit("archive.member_suspicious").alias("rule"), F.lit(SEVERITY["medium"]).alias("severity")))
    )
    return told.select("file", "id", rule.alias("r")).where("r IS NOT NULL").groupBy("file", "id", "r.rule", "r.severity").agg(F.count("*").alias("n"))
