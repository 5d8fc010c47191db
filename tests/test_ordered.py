"""Block-wise scans against plain loops; small blocks force the carry path."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chatprep.operators.ordered import scan_groups
from chatprep.operators.sampling import contiguous_shards, rank_by_hash, rank_by_key, strided_shards
from chatprep.operators.turns import distinct_turns, misnumbered, valid_turns, walk_turns


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for key in range(6):
        size = 400 if key == 0 else rng.randint(1, 12)  # one key holds most rows
        for turn in sorted(rng.sample(range(600 if key == 0 else 40), size)):
            out.append((key, turn, rng.choice("abc"), rng.randint(0, 5)))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k int, t int, v string, n int").cache()


def groups(rows):
    by = {}
    for r in sorted(rows):
        by.setdefault(r[0], []).append(r)
    return by


@pytest.mark.parametrize("block", [7, 4096])
@pytest.mark.parametrize("inclusive", [False, True])
def test_scan(table, rows, block, inclusive):
    out = scan_groups(table, ["k"], "t", {"prev": "v"}, {"total": F.col("n"), "pos": F.lit(1)}, inclusive, block)
    got = {(r.k, r.t): (r.prev, r.total, r.pos) for r in out.collect()}
    want = {}
    for key, items in groups(rows).items():
        prev, total, pos = None, 0, 0
        for _, t, v, n in items:
            if inclusive:
                want[key, t] = (prev, total + n, pos + 1)
            else:
                want[key, t] = (prev, total, pos)
            prev, total, pos = v, total + n, pos + 1
    assert got == want


@pytest.mark.parametrize("block", [5, 4096])
def test_last_values(table, rows, block):
    marked = table.withColumn("m", F.when(F.col("t") % 7 == 3, F.col("t")))
    out = scan_groups(marked, ["k"], "t", lasts={"seen": "m"}, block=block)
    got = {(r.k, r.t): r.seen for r in out.collect()}
    want = {}
    for key, items in groups(rows).items():
        seen = None
        for _, t, *_ in items:
            want[key, t] = seen
            seen = t if t % 7 == 3 else seen
    assert got == want


def test_repeated_order_values_are_an_error(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b")], "k int, t int, v string")
    with pytest.raises(Exception, match="repeated t"):
        scan_groups(df, ["k"], "t", sums={"n": F.lit(1)}).collect()


def test_a_missing_order_value_is_an_error_without_ties(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, None, "b")], "k int, t int, v string")
    with pytest.raises(Exception, match="null or repeated t"):
        scan_groups(df, ["k"], "t", sums={"n": F.lit(1)}).collect()


def tie(*texts):
    return hashlib.md5("\x01".join("\x02" if x is None else x for x in texts).encode()).hexdigest()


@pytest.mark.parametrize("block", [3, 4096])
def test_scan_of_null_and_repeated_order_values(spark, block):
    rng = random.Random(block)
    rows = [(k, rng.choice([None, *range(-9, 30)]), rng.choice(["a", "b", None]), rng.choice("xy")) for k in (None, 1, 2) for _ in range(90)]
    rows += [(2, 7, "a", "x")] * 50
    df = spark.createDataFrame(rows, "k int, t int, v string, z string")
    out = scan_groups(df, ["k"], "t", {"prev": "v"}, {"pos": F.lit(1)}, block=block, lasts={"seen": "v"}, ties=["v", "z"])
    want = []
    for key in (None, 1, 2):
        prev = seen = None
        items = sorted({r for r in rows if r[0] == key}, key=lambda r: (r[1] is not None, r[1] or 0, tie(*r[2:])))
        for pos, (_, t, v, z) in enumerate(items):
            want.append((key, t, v, z, prev, seen, pos))
            prev, seen = v, seen if v is None else v
    got = [(r.k, r.t, r.v, r.z, r.prev, r.seen, r.pos) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def naive_valid(turns):
    kept, start = [], 0
    if turns and turns[0][1] == "system":
        kept, start = [turns[0]], 1
    for j, (t, role) in enumerate(turns[start:]):
        before = turns[start + j - 1][1] if j else None
        if j == 0 and role != "user":
            break
        if j and role == "tool" and before not in ("assistant", "tool"):
            break
        if j and role == "assistant" and before not in ("user", "tool"):
            break
        kept.append((t, role))
    return kept


@pytest.mark.parametrize("step", [1, 2000])
def test_valid_turns(spark, step):
    """Steps of 2000 spread a conversation over several blocks."""
    rng = random.Random(step)
    rows, want = [], set()
    for key in range(120):
        n = rng.randint(1, 9)
        roles = ["user" if i % 2 == 0 else "assistant" for i in range(n)]
        if rng.random() < 0.3:
            roles.insert(0, "system")
        for i in range(len(roles)):
            if rng.random() < 0.15:
                roles[i] = rng.choice(["user", "assistant", "tool", "system", "other"])
        turns = [(i * step, r) for i, r in enumerate(roles)]
        rows += [(key, t, r, "x") for t, r in turns]
        want |= {(key, t, r) for t, r in naive_valid(turns)}
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert {(r.conv_id, r.turn, r.role) for r in valid_turns(df).collect()} == want


ROLES = ["user", "assistant", "tool", "system", "other", None]


@pytest.mark.parametrize("block", [1, 2, 3, 5, 4096])
def test_walk_over_null_and_repeated_turns(spark, block):
    """Every block border, in conversations of lost, repeated and far numbers."""
    rng = random.Random(block)
    rows = []
    for key in [None, *range(150)]:
        roles = ["system"] * rng.randint(0, 1) + ["user", "assistant"] * rng.randint(0, 6) + rng.choices(ROLES, k=rng.choice([0, 0, 1, 2]))
        rows += [(key, rng.choice([i, i, i, i, i // 2, None, i * 5000]), r, rng.choice(["x", "y", None])) for i, r in enumerate(roles)]
    rows += [(3, 1, "user", "x")] * 20 + [(4, None, "user", "x")] * 20
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(5)
    marks = {"open": F.when(F.col("text") == "x", True).when(F.col("text") == "y", False)}
    out = walk_turns(df, sums={"sum": F.length("text")}, lasts=marks, block=block).collect()
    want = []
    for key in [None, *range(150)]:
        items = sorted({r for r in rows if r[0] == key}, key=lambda r: (r[1] is not None, r[1] or 0, tie(*r[2:])))
        kept = len(naive_valid([(i, r[2]) for i, r in enumerate(items)]))
        total, opened = 0, None
        for i, r in enumerate(items):
            want.append((*r, i, i < kept, items[0][2] == "system", i == kept - 1, total, opened))
            total += r[3] is not None
            opened = {"x": True, "y": False, None: opened}[r[3]]
    got = [(r.conv_id, r.turn, r.role, r.text, r.position, r.kept, r.own_system, r.last, r.sum, r.open) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    numbers = collections.Counter(r[:2] for r in rows)
    assert {(r.conv_id, r.turn): r.n for r in misnumbered(df).collect()} == {k: n for k, n in numbers.items() if n > 1 or k[1] is None}
    assert distinct_turns(df).count() == len(set(rows))


def test_messages_are_read_twice_and_moved_once(spark):
    plan = valid_turns(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange ") == 3 and plan.count("Join") == 0


def test_ranks(table, rows):
    by_key = rank_by_key(table.filter("k = 0"), "t").collect()
    assert [r["rank"] for r in sorted(by_key, key=lambda r: r.t)] == list(range(len(by_key)))
    hashed = rank_by_hash(table, ["k", "t"], within=["k"]).collect()
    for key, items in groups(rows).items():
        assert sorted(r["rank"] for r in hashed if r.k == key) == list(range(len(items)))


def test_ranks_move_keys_only(spark):
    """What is stored between the steps, and so what moved, holds no text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for ranked in (rank_by_hash(docs, ["doc_id"]), strided_shards(docs, ["doc_id"], 3, 4), contiguous_shards(docs, "doc_id", 7)):
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert "text" not in ranked.columns and "documents.parquet" not in plan and "text" not in plan
    empty = docs.limit(0)
    assert rank_by_key(empty, "doc_id").count() == contiguous_shards(empty, "doc_id", 3).count() == 0
