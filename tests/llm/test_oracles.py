"""Queries of the package against their SQL, on the smallest tables."""

import random

import duckdb
import pytest

from strandline.llm import minhash, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_near_copies_against_brute_force(spark):
    rng, texts = random.Random(3), []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for n in (0, 2, 4, 6, 8, 9, 10, 12):
            w = list(base)
            for at in rng.sample(range(300), n):
                w[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    sets, label, near = [set(minhash.shingles(t.encode()).tolist()) for t in texts], list(range(len(texts))), []
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            near.append(both / len(sets[i] | sets[j]))
            if 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert sum(0.75 <= s < 0.95 for s in near) > 50 and sum(0.6 <= s < 0.75 for s in near) > 50
    got = minhash.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(label))
