"""Near-duplicates: whole rows stay where they are, even where no table of keys is small enough for a broadcast of its own."""

from __future__ import annotations

import numpy as np
import pandas as pd

from pulsegrid.llm import simhash


def shuffled(spark) -> int:
    return spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_texts_stay_where_no_key_table_is_broadcast(spark):
    rng = np.random.default_rng(4)
    texts = ["".join(chr(33 + c) if c else " " for c in rng.integers(0, 90, 20_000)) for _ in range(200)]
    docs = pd.DataFrame({"doc_id": range(220), "text": texts + texts[:20]})
    docs = pd.concat([docs, docs.iloc[[5, 5]].assign(source=["b", "a"])], ignore_index=True)
    df = spark.createDataFrame(docs.astype(object).where(docs.notna(), None), "doc_id long, text string, source string").repartition(8).localCheckpoint()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        begin = shuffled(spark)
        got = simhash.one_of_each(df).toPandas()
        moved = shuffled(spark) - begin
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = got.sort_values("doc_id")
    assert got["doc_id"].tolist() == list(range(200)) and got["text"].tolist() == texts
    assert moved < 0.4 * sum(map(len, texts))
