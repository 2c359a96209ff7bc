from __future__ import annotations

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kindred.operators.blocking import identifier_postings
from kindred.operators.catalog import build_records, guess_columns
from kindred.session import drop_stored, forget, lean, prefix_sums, shared_dir, stored
from kindred.sources import files
from kindred.streaming.incremental import match_stream


def test_csv_both_encodings(spark, tmp_path):
    text = 'id,name,price\n1,"Café, ""big""\nline",\n2,plain,$5\n'
    for name, encoding in (("u.csv", "utf-8"), ("l.csv", "latin-1")):
        (tmp_path / name).write_bytes(text.encode(encoding))
        rows = files.read_csv(spark, str(tmp_path / name)).orderBy("id").collect()
        assert [tuple(r) for r in rows] == [("1", 'Café, "big"\nline', ""), ("2", "plain", "$5")]


def test_benchmark_and_hashes(spark, tmp_path):
    spec = files.BENCHMARKS["abt-buy"]
    (tmp_path / spec.left).write_text("id,name,description,price\n1,Sony CDPCE375,x,$10\n")
    (tmp_path / spec.right).write_text("id,name,description,manufacturer,price\n7,Sony CDP-CE375,,Sony,\n")
    (tmp_path / spec.gold).write_text("idAbt,idBuy\n1,7\n1,7\n")
    left, right, gold = files.load_benchmark(spark, str(tmp_path), spec)
    assert left.first().currency == "USD" and right.first().brand_norm == "sony" and gold.count() == 1
    r = files.file_hashes(spark, str(tmp_path / spec.gold)).first()
    assert r.sha256 == hashlib.sha256((tmp_path / spec.gold).read_bytes()).hexdigest()


def test_guess_columns():
    c = guess_columns(["ID", "Name", "Manufacturer", "MPN"])
    assert (c.id, c.title, c.brand, c.model, c.price) == ("ID", "Name", "Manufacturer", "MPN", None) and c.to_dict()["default_currency"] == "USD"


def test_answer_cache_keeps_the_latest(spark, tmp_path):
    cache = files.AnswerCache(spark, str(tmp_path / "cache"))
    for answer in ("old", "new"):
        cache.append(spark.createDataFrame([("k", answer, 0.1, False)], "key string, response string, latency double, cached boolean"))
    assert cache.size() == 1 and cache.read().first().response == "new"


def test_writers(spark, tmp_path):
    files.write_csv(spark.range(3), str(tmp_path / "out"))
    files.write_json({"a": 1}, str(tmp_path / "x.json"))
    assert files.read_csv(spark, str(tmp_path / "out")).count() == 3


def test_prefix_sums(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise("cold").alias("g"), F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("v"))
    got = prefix_sums(df, ["g"], ["k"], "v", "before", parts=5).collect()
    for g in ("hot", "cold"):
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.k):
            assert r.before == total
            total += r.v


def test_stream(spark, tmp_path):
    schema = "source string, rid string, title string, description string, brand string, model string, price string, currency string"
    right = build_records(spark.createDataFrame([("B", "r1", "Sony CDP-CE375", "", "", "", "", None)], schema))
    assert identifier_postings(right).count() == 1
    spark.createDataFrame([("A", "l1", "Sony player CDPCE375", "", "", "", "", None)], schema).write.parquet(str(tmp_path / "in"))
    got = []
    q = match_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), right, lambda df, i: got.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [(r.left_rid, r.right_rid) for r in got] == [("l1", "r1")]


def test_a_replacement_character_is_no_other_encoding(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("id,name\n1,caf\u00e9 \ufffd\n".encode())
    (tmp_path / "l.csv").write_bytes("id,name\n1,caf\u00e9\n".encode("latin-1"))
    assert [files.read_csv(spark, str(tmp_path / f)).first()["name"] for f in ("u.csv", "l.csv")] == ["caf\u00e9 \ufffd", "caf\u00e9"]


def test_stored_tables_can_be_dropped(spark):
    folder = Path(shared_dir(spark).removeprefix("file://")) / "tables" / spark.sparkContext.applicationId
    other = folder.parent / "of-another-application"
    other.mkdir(parents=True, exist_ok=True)
    assert stored(spark.range(3), "x").count() == 3 and list(folder.iterdir())
    drop_stored(spark)
    assert not folder.exists() and other.exists()


def test_functions_that_name_our_modules_can_be_sent():
    """The package goes to the executors by value, so no module of it may hold what cannot be pickled."""
    from pyspark import cloudpickle

    from kindred import session
    from kindred.operators import judge

    assert cloudpickle.dumps(lambda _: (judge.Retry, session.stored))


def test_lean_blocks_forget_their_own_tables_only(spark):
    one = spark.range(3)
    kept = stored(one, "x")
    with lean(spark):
        outer = stored(one, "x")
        with lean(spark):
            inner = stored(one, "x")
            forget(spark, "x")
            assert outer.count() == 3
            with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
                inner.count()
        forget(spark, "x")
        with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
            outer.count()
    forget(spark, "x")
    assert kept.count() == 3
