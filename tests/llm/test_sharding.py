"""Placement against a walk key by key."""

import pytest
from conftest import frame  # noqa: F401  (tests/llm/conftest.py)
from pyspark.sql import functions as F

from formpulse.llm.sharding import ring, shard


def walk(keys, points, cells, capacity):
    """Each key in ring order at home if there is room; the others then clockwise, first come first served."""
    load, placed, over = dict.fromkeys(capacity, 0), {}, []
    for cell, key in keys:
        p = next(i for i, (at, _) in enumerate(points + [(cells + points[0][0], points[0][1])]) if at >= cell) % len(points)
        s = points[p][1]
        if load[s] < capacity[s]:
            load[s] += 1
            placed[key] = s
        else:
            over.append((p, key))
    for i, (p, key) in enumerate(sorted(over, key=lambda x: x[0])):
        over[i] = (p, key)
    queue, at = [], 0
    for lap in range(2):
        for p, (_, s) in enumerate(points):
            if lap == 0:
                queue += [k for home, k in over if home == p]
            while queue and load[s] < capacity[s]:
                key = queue.pop(0)
                placed[key] = s
                load[s] += 1
    assert not queue and at == 0
    return placed


@pytest.mark.parametrize("n", [0, 1, 37, 500])
def test_matches_a_walk_key_by_key(spark, n):
    shards, nodes, cells = 7, 5, 64
    docs = spark.range(n).withColumnRenamed("id", "doc_id").withColumn("slot", F.lit("x"))
    got = {r.doc_id: (r.shard, r.slot) for r in shard(docs, shards=shards, virtual_nodes=nodes, cells=cells).collect()}
    owner = {r.cell: (r.point, r.shard) for r in ring(spark, shards, nodes, cells).collect()}
    assert sorted(owner) == list(range(cells))
    last = {}
    for cell in range(cells):  # the last cell of each point's arc, but for the tail of the first
        p, s = owner[cell]
        if not (p == 0 and cell > max(c for c in owner if owner[c][0] == max(x[0] for x in owner.values()))):
            last[p] = (cell, s)
    points = [last[p] for p in sorted(last)]
    hashed = docs.select("doc_id", F.xxhash64(F.lit("key"), "doc_id").alias("h")).collect()
    def cell_of(h):
        return ((h & (2 ** 64 - 1)) >> 16) % cells

    # In ring order the tail of the last cells belongs to point 0 and comes after its other cells.
    keys = [(cell_of(r.h), r.doc_id) for r in sorted(hashed, key=lambda r: (cell_of(r.h), r.h, r.doc_id))]
    capacity = {s: n // shards + (s < n % shards) for s in range(shards)}
    by_point = sorted(keys, key=lambda k: owner[k[0]][0])
    want = walk(by_point, points, cells, capacity)
    assert {k: s for k, (s, _) in got.items()} == want
    for s in range(shards):
        slots = sorted(slot for own, slot in got.values() if own == s)
        assert slots == list(range(capacity[s]))


def test_edge_rows_have_a_place(edge_docs, edge_rows):
    rows = shard(edge_docs, shards=3, virtual_nodes=4, cells=32).collect()
    assert len(rows) == len(edge_rows)
    counts = [sum(r.shard == s for r in rows) for s in range(3)]
    assert max(counts) - min(counts) <= 1
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)


def test_slack_moves_few_documents_when_a_shard_is_added(spark):
    docs = spark.range(4000).withColumnRenamed("id", "doc_id")
    a, b = ({r.doc_id: r.shard for r in shard(docs, shards=n, virtual_nodes=64, cells=4096, slack=0.25).collect()} for n in (8, 9))
    moved = sum(a[k] != b[k] for k in a)
    assert max(list(a.values()).count(s) for s in range(8)) <= 4000 * 1.25 / 8 + 1
    assert 4000 / 9 * 0.6 < moved < 4000 * 0.45
