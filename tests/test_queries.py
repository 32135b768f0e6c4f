"""Every registered query of the library proper against its SQL, on the smallest tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators import merge, segments
from strandline.plans import registry
from strandline.plans import chunk_queries, composition_queries, context_queries, language_queries, layout_queries, naming_queries, normal_queries, placement_queries, reader_queries, record_queries, scalar_queries, stream_queries, text_queries, time_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    got = db.execute(registry.ORACLES[name])
    cols = sorted(df.columns)
    at = [[d[0] for d in got.description].index(c) for c in cols]
    assert len(at) == len(got.description)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert a == sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)


def test_queries_on_all_rows(spark):
    q = registry.QUERIES
    rows = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").collect()
    orders, uses = rows("orders"), {}
    verdict = {k: v for k, v in q["sync_verdicts"](spark, SF).select("o_orderkey", "verdict").collect()}
    assert verdict == {o.o_orderkey: ("upload", "same", "download")[(o.o_orderkey % 5 - 2 > 0) + (o.o_orderkey % 5 - 2 >= 0)] for o in orders}
    merged = q["last_writer_wins"](spark, SF).collect()
    assert sorted(r.o_orderkey for r in merged) == sorted(o.o_orderkey for o in orders if o.o_orderstatus != "P" or o.o_orderkey % 5 <= 2)
    for x in rows("lineitem"):
        uses[x.l_orderkey] = uses.get(x.l_orderkey, 0) + 1
    known = {o.o_orderkey for o in orders}
    state = {k: "unknown" if k not in known else ("unused", "once", "repeated")[min(uses.get(k, 0), 2)] for k in known | set(uses)}
    assert {r.o_orderkey: r.state for r in q["fragment_accounting"](spark, SF).collect()} == state
    e = [(x.user_id, x.event_id, x.ms) for x in time_queries.events(spark, SF).collect()]
    want = {(u, i, j) for u, i, s in e for w, j, t in e if u == w and i < j and abs(s - t) < 7_200_000}
    got = [(r.user_id, r.a_id, r.b_id) for r in q["interval_overlaps"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want and {(i - j) % 2 for _, i, j in got} == {0, 1}


def test_scalars(spark):
    rows = spark.createDataFrame([("PT1H2M3S",), ("P1DT5S",), ("bad",), (None,)], "d string")
    assert [r[0] for r in rows.select(T.iso_duration(F.col("d"))).collect()] == [3723, 86405, 0, 0]
    assert spark.range(1).select(T.fold(F.lit("ÁRBOL Ñandú"))).first()[0] == "arbol nandu"
    assert spark.range(1).select(T.consecutive_distinct(F.array(*map(F.lit, "aabba")))).first()[0] == ["a", "b", "a"]


def test_merge_and_segments_on_empty_tables(spark):
    e = spark.createDataFrame([], "k long, stamp long, deleted boolean")
    assert merge.last_writer(e, e, "k", "stamp", "deleted").count() == 0
    i = spark.createDataFrame([], "user_id long, id long, start long, end long")
    assert segments.interval_overlaps(i, i, "user_id", 10).count() == 0


@pytest.mark.parametrize("name", ["letters_kept", "script_share"])
def test_odd_texts_equal_sql(spark, tmp_path, name):
    """Texts without letters or without a text at all, letters behind the first 4,000 characters, a share on a half of the last place."""
    texts = ["", None, "...", "?!\n--", "", "Año 7\nB", "12 3", "-\n", "." * 4000 + "a", "Ωμέγα Σ\nΣας", "a" * 41 + "λ" * 599, "x\ny", "𝒜 é\n—", None, " \n", "*\n*"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    rows = lambda rs: sorted(([repr(v) for v in r] for r in rs))
    assert rows(df.collect()) == rows(con.execute(registry.ORACLES[name]).fetchall())
