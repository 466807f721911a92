"""The query of every participant's view against its SQL, on dialogues of all kinds."""

from __future__ import annotations

import os
import random

import duckdb
import pytest

from eventloom.llm import chat
from tests.compare import differences

SCHEMA = "conv_id long, turn int, role string, text string"


def against_sql(spark, folder):
    con = duckdb.connect()
    path = f"{folder}/conversations.parquet"
    source = f"{path}/*.parquet" if os.path.isdir(path) else path
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{source}'")
    return differences(chat.op7_chat_perspectives(spark, str(folder)), con, chat.OP7_SQL)


def test_long_sparse_and_repeated_turns(spark, tmp_path):
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["ann", "bob", "system", "user"]), f"said {i}") for i in range(600)]
    # One speaks in the first part alone, turn numbers have gaps, ties and repeats.
    rows += [(2, 1000 * (i // 3), "a" if i < 5 else "b", f"x{i % 2} <|im_end|>") for i in range(520)]
    rows += [(3, 0, "a", "twice"), (3, 0, "a", "twice"), (3, 0, "b", "twice"), (3, -4, None, None)]
    rows += [(4, 0, "system", "alone"), (5, None, "a", "loose"), (5, None, "a", "loose")]
    rows += [(5, 1, "a", "in its place"), (None, 1, "a", "no dialogue"), (None, None, None, None)]
    rows += [(6, 7, "<|x", "é" * 5000), (6, 256, "", "")]
    rng.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert against_sql(spark, tmp_path) is None


def test_no_turns(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert against_sql(spark, tmp_path) is None


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/check_l"])
def test_given_tables(spark, folder):
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    assert against_sql(spark, folder) is None
