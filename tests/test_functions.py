"""Scalar functions against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from engram.errors import ValidationError
from engram.functions import clock, embedding, jsons, text, vectors
from engram.schemas import DAY_MS

SAMPLES = ["ZXQ-8842 /var/log/app.log", "tưới CÂY", "Đà Nẵng", "straße", "a_b c", "x²", "?!...", "", "été été", "ñandú 12.5"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_native_tokens_equal_general_ones(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "t string").select("t", text.tokens(F.col("t")).alias("a"), text.tokens_any_script(F.col("t")).alias("b"))
    for r in df.collect():
        assert list(r["a"]) == list(r["b"]) == text.tokenize(r["t"]), r["t"]


def test_terms_keep_first_seen_order(spark):
    assert one(spark, text.terms(F.lit("b a B c a"))) == ["b", "a", "c"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_one_line(spark):
    assert one(spark, text.one_line(F.lit(" a \n\t b "))) == "a b"
    long = one(spark, text.one_line(F.lit("x" * 130)))
    assert len(long) == 120 and long.endswith("...")
    assert one(spark, text.document_payload(F.lit("a-b"), F.lit(" s\n"))) == "a b\ns"
    assert one(spark, text.query_payload(F.lit("  "))) is None


@pytest.mark.parametrize("cos,key", [(0.299998, 299998), (0.3000005, 300000), (0.3000015, 300002), (1.0, 1_000_000), (float("nan"), None)])
def test_micro_key_rounds_half_to_even(spark, cos, key):
    assert one(spark, vectors.micro_key(F.lit(cos))) == key


def test_malformed_vectors(spark):
    rows = [([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), ([math.nan, 1.0],), ([math.inf, 1.0],), (None,), ([None, 1.0],)]
    df = spark.createDataFrame(rows, "v array<float>").select(F.coalesce(vectors.well_formed(F.col("v"), 2), F.lit(False)).alias("ok"))
    assert [r["ok"] for r in df.collect()] == [True] + [False] * 6
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_vector_codec(spark):
    df = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    back = df.select("v", vectors.decode_f4(vectors.encode_f4("v")).alias("w")).collect()
    assert back[0]["v"] == back[0]["w"] and back[1]["w"] is None


@pytest.mark.parametrize("bad", [[0.0, 0.0], [math.nan], [], [1.0, 2.0, 3.0]])
def test_query_vector_is_checked(bad):
    with pytest.raises(ValidationError):
        vectors.check_query_vector(bad, 2)


def test_retention():
    assert [clock.ttl_ms_for(i) // DAY_MS for i in (1, 2, 3, 4, 5)] == [7, 30, 90, 180, 365]
    for bad in (0, 6, True):
        with pytest.raises(ValidationError):
            clock.ttl_ms_for(bad)


def test_days_and_iso(spark):
    for ms in (0, -1, 1_706_745_600_000, 1_706_745_599_999, -86_400_001):
        for tz in ("UTC", "Asia/Ho_Chi_Minh", "America/New_York"):
            assert one(spark, clock.timeline_day(F.lit(ms).cast("long"), tz)) == clock.timeline_day_for(ms, tz)
        assert one(spark, clock.iso_column(F.lit(ms).cast("long"))) == clock.iso(ms)


def test_json_forms(spark):
    assert one(spark, jsons.canonical_json(F.lit('{"b":1e3,"a":"é"}'))) == '{"a":"é","b":1000.0}'
    assert one(spark, jsons.stored_json(F.lit('{"a":"é"}'))) == '{"a":"\\u00e9"}'
    assert one(spark, jsons.canonical_json(F.lit('{"a":NaN}'))) is None
    assert one(spark, jsons.is_object(F.lit("[1]"))) is False and one(spark, jsons.is_object(F.lit("{}"))) is True


def test_forbidden_keys_at_any_depth():
    assert jsons.forbidden_path({"a": [{"content": 1}]}) == "detail.a[0].content"
    assert jsons.forbidden_path({"topics": 1}) is None


def test_embedder_is_deterministic_and_unit():
    model = embedding.HashingEmbedder(16)
    v = embedding.check_output(model(["a b", "", "a b"]), 16)
    assert (v[0] == v[2]).all()
    with pytest.raises(ValidationError):
        embedding.check_output(v * 2, 16)
