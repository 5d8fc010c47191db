"""Plans of nested array expressions stay far below the passes after which the analyzer gives up (100)."""

import pytest
from pyspark.sql import functions as F

from chatprep.functions.arrays import SUM_CHUNK, SUM_GROUP, SUM_ROUNDS, prefix_sums
from chatprep.operators.templates import get_template
from chatprep.plans.draft_vocabulary import place_messages


@pytest.fixture
def passes(spark):
    """Passes the analyzer may take; its own limit comes back afterwards."""
    name = "spark.sql.analyzer.maxIterations"
    yield lambda most: spark.conf.set(name, str(most))
    spark.conf.unset(name)


# Replies that close, that run on, that are channel-tagged, and a template with texts to ignore.
@pytest.mark.parametrize("name", ["qwen", "longcat", "gpt-oss", "qwen3.5"])
def test_masks_of_messages(spark, passes, name):
    reply = "assistant_final" if name == "gpt-oss" else "assistant"
    rows = [(1, 0, "user", "a b"), (1, 1, reply, "c <think>\n\n</think>\n\n d")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    passes(75)
    placed = place_messages(turns, get_template(name)).orderBy("turn").collect()
    assert [len(r.mask) for r in placed] == [r.n_tokens for r in placed] and len(placed) == 2
    assert sum(placed[0].mask) == 0 < sum(placed[1].mask)


def test_running_sums_across_groups_and_chunks(spark, passes):
    whole = SUM_GROUP**SUM_ROUNDS * SUM_CHUNK  # entries of one chunk of the last round
    sizes = [0, 1, SUM_GROUP - 1, SUM_GROUP + 1, SUM_GROUP**SUM_ROUNDS, whole - 1, whole, whole + 1, 3 * whole + 5]
    passes(30)
    made = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda x: x * x % 7 - 2)
    df = spark.createDataFrame([(n,) for n in sizes], "n long").withColumn("v", F.when(F.col("n") > 0, made).otherwise(F.array().cast("array<int>")))
    for r in df.withColumn("sums", prefix_sums(F.col("v"))).collect():
        assert len(r.v) == r.n and r.sums == [sum(r.v[:i]) for i in range(len(r.v) + 1)]
