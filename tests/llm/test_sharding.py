import zlib
from collections import Counter

from murmur.llm import sharding

from .helpers import awkward, frame, saved


def test_awkward_rows(spark, tmp_path):
    rows = awkward()
    got = sharding.op8_sharding(spark, saved(spark, tmp_path)).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = {}
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.shard(frame(spark, []), sharding.PLANNED, sharding.add_shard(sharding.PLANNED)).count() == 0


def test_shares_follow_weights_and_movement_is_confined(spark):
    def tree(w):
        leaf = sharding.Node
        racks = [sharding.Node(f"k{j}", children=tuple(leaf(f"s{3 * j + i}", 3 * j + i, w.get(3 * j + i, 1.0)) for i in range(3))) for j in range(4)]
        return sharding.Node("", children=(sharding.Node("r0", children=tuple(racks[:2])), sharding.Node("r1", children=tuple(racks[2:]))))

    ids = spark.range(40_000).selectExpr("cast(id as string) as id")
    before, after = tree({}), tree({5: 3.0})  # shard 5 is in region 0, rack 1
    from pyspark.sql import functions as F

    moved = ids.select(sharding.place(F.col("id"), before).alias("a"), sharding.place(F.col("id"), after).alias("b")).groupBy("a", "b").count().collect()
    share = Counter()
    for r in moved:
        share[r.b] += r["count"] / 40_000
    assert abs(share[5] - 3 / 14) < 0.01 and all(abs(share[s] - 1 / 14) < 0.01 for s in range(12) if s != 5)
    for r in moved:
        if r.a != r.b:
            assert r.b < 6  # only into the subtree that gained weight
            assert r.a // 3 != r.b // 3 or r.b == 5  # in the changed rack only into the changed shard


def test_a_new_shard_takes_rows_only_into_itself(spark):
    from pyspark.sql import functions as F

    ids = spark.range(20_000).selectExpr("cast(id as string) as id")
    a, b = sharding.PLANNED, sharding.add_shard(sharding.PLANNED)
    c = sharding.add_shard(b)
    rows = ids.select(*[sharding.place(F.col("id"), t).alias(n) for t, n in ((a, "a"), (b, "b"), (c, "c"))]).collect()
    assert all(r.b in (r.a, 40) and r.c in (r.b, 41) for r in rows)
    assert abs(sum(r.b == 40 for r in rows) / 20_000 - 1 / 41) < 0.005


def test_equal_and_unnamed_rows(spark):
    """A third of the rows without an id, a third equal ones: slots stay gapless, numbered in steps."""
    rows = [(None, f"text {i}", None, None, 1, "", "") for i in range(300)] + [(7, "the same", None, None, 1, "", "")] * 300 + [(1000 + i, None, None, None, 1, "", "") for i in range(300)]
    before, sharding.STEP = sharding.STEP, 64
    try:
        got = sharding.shard(frame(spark, rows), sharding.PLANNED, sharding.add_shard(sharding.PLANNED)).collect()
    finally:
        sharding.STEP = before
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 900 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    same = [r.slot for r in got if r.doc_id == 7]
    assert len({r.shard for r in got if r.doc_id == 7}) == 1 and sorted(same) == list(range(min(same), min(same) + 300))
