"""Roll-up of archive members against a plain walk."""

import random

import pytest

from quarrylens.operators import rollup

SCHEMA = "file string, id long, parent long, position long, name string, size long, packed long, encrypted boolean, verdict string, depth int, x int"
LIMITS = {"depth": 2, "member_bytes": 50, "total_bytes": 300, "bomb_ratio": 10, "bomb_bytes": 40}


def walk(rows):
    """{id: (status, taken)} of one file: all members of an archive spend before those of its members."""
    kids, out, left = {}, {}, [LIMITS["total_bytes"]]
    for r in rows:
        kids.setdefault(r[2], []).append(r)

    def visit(node, depth):
        read = []
        for r in sorted(kids.get(node, []), key=lambda r: (r[3], r[1])):
            _, i, _, _, _, size, packed, encrypted, *_ = r
            size = size or 0
            if depth > LIMITS["depth"]:
                out[i] = ("depth", 0)
            elif encrypted:
                out[i] = ("encrypted", 0)
            elif size >= LIMITS["bomb_bytes"] and size >= LIMITS["bomb_ratio"] * max(packed or 0, 1):
                out[i] = ("bomb", 0)
            else:
                taken = max(0, min(size, LIMITS["member_bytes"], left[0]))
                left[0] -= min(size, LIMITS["member_bytes"])
                out[i] = ("read" if taken == size else "partial" if taken else "budget", taken)
                if size <= LIMITS["member_bytes"]:
                    read.append(i)
        for i in read:
            visit(i, depth + 1)

    roots = [r[1] for r in rows if r[2] is None]
    out |= {i: ("file", 0) for i in roots}
    for i in roots:
        visit(i, 1)
    return {r[1]: out.get(r[1], ("unreached", 0)) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_walk_budget_and_cycles(spark, monkeypatch, seed):
    monkeypatch.setattr(rollup, "PART_PLACES", 2)
    r = random.Random(seed)
    rows = []
    for f in range(12):
        rows.append((f"f{f}", 0, None, None, "root", None, None, None, "clean", 9, 9))
        for i in range(1, r.randrange(1, 45)):
            parent = r.choice([0, 0, r.randrange(i), r.randrange(i), i, i + 1, 99])
            rows.append((f"f{f}", i, parent, i, f"m{i}", r.choice([0, 5, 20, 45, 60, None]), r.choice([1, 4, 10, None]), r.random() < 0.1, r.choice(["clean", "clean", "suspicious", "malicious", None]), 9, 9))
    df = spark.createDataFrame(rows, SCHEMA)
    got = rollup.expand(df, **LIMITS)
    seen = {(x["file"], x["id"]): x for x in got.collect()}
    assert len(seen) == len(rows)
    for f in range(12):
        own = [x for x in rows if x[0] == f"f{f}"]
        assert {i: (seen[f"f{f}", i]["status"], seen[f"f{f}", i]["taken"]) for _, i, *_ in own} == walk(own)
    up = {(x["file"], x["id"]): x for x in rollup.rolled_up(got).collect()}
    rank = {"malicious": 2, "suspicious": 1}
    for key in up:
        below = [x for k, x in seen.items() if k[0] == key[0] and x["ids"] and key[1] in x["ids"] and x["status"] in ("file", "read", "partial")]
        worst = max(rank.get(x["verdict"], 0) for x in below)
        assert (up[key]["verdict"], up[key]["members"]) == (["clean", "suspicious", "malicious"][worst], len(below) - 1)
    assert {x["rule"] for x in rollup.findings(got, rollup.rolled_up(got)).collect()} <= {"archive.encrypted_member", "archive.zip_bomb", "archive.depth_limit", "archive.budget_exhausted", "archive.member_malicious", "archive.member_suspicious"}


def test_empty_table(spark):
    none = rollup.expand(spark.createDataFrame([], SCHEMA))
    assert none.count() == rollup.rolled_up(none).count() == rollup.findings(none, rollup.rolled_up(none)).count() == 0


def test_no_table_of_members_is_broadcast(spark):
    rows = [("f", i, None if i == 0 else 0, i, f"m{i}", 5, 5, False, "clean", 9, 9) for i in range(5)]
    expanded = rollup.expand(spark.createDataFrame(rows, SCHEMA), **LIMITS)
    plan = rollup.findings(expanded, rollup.rolled_up(expanded))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
