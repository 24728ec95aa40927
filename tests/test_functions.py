"""Rules on single values."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.functions import trade


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, value", [("26.080,00", 26080.0), ("18,750.00", 18750.0), ("28.16", 28.16), ("28,16", 28.16), ("26,080", 26080.0), ("26.080", 26.08), (" 1 234,5 ", 1234.5), ("", None), ("x", None), (None, None), (",5", 5.0)])
def test_parse_number(spark, raw, value):
    assert one(spark, trade.parse_number(F.lit(raw))) == value


@pytest.mark.parametrize("raw, value", [("2024-3-5", "2024-03-05"), ("05.03.2024", "2024-03-05"), ("5/3/2024 8:30", "2024-03-05T08:30:00"), ("2024-02-30", None), ("2024-02-28 25:00", None), ("soon", None), (None, None)])
def test_normalize_date(spark, raw, value):
    assert one(spark, trade.normalize_date(F.lit(raw))) == value


@pytest.mark.parametrize("raw, valid", [("CSQU3054383", True), ("CSQU3054384", False), ("csqu 3054383", True), ("CSQ3054383", False), (None, False), ("", False)])
def test_check_digit(spark, raw, valid):
    assert one(spark, trade.iso6346(F.lit(raw))) is valid


def test_container_references(spark):
    assert one(spark, trade.container_references(F.lit("A CSQU3054383, CSQU3054384 and CSQU3054383"))) == ["CSQU3054383"]


@pytest.mark.parametrize("raw, value", [("RTM ROTTERDAM PORT", "ROTTERDAM"), ("NEW YORK", "NEW YORK"), ("ABC NOWHERE", "NOWHERE"), ("izmir", "izmir")])
def test_port_name(spark, raw, value):
    assert one(spark, trade.port_name(F.lit(raw))) == value


def test_reefer_remarks(spark):
    assert one(spark, trade.reefer_remarks(F.lit("TEMP: -18 C and SET POINT 40F"))) == "REEFER SETTINGS: TEMP:-18.0CEL, TEMP:40.0FAH"
    assert one(spark, trade.reefer_remarks(F.lit("none"))) is None


def test_phone_moves(spark):
    name, phone = trade.phone_from_name(F.lit("TEL: 05321234567"), F.lit(None).cast("string"))
    assert one(spark, name) is None and one(spark, phone) == "05321234567"


def test_redaction(spark):
    assert one(spark, tx.redact_secrets(F.lit("Authorization: Bearer abc.def\napi_key=12345 ?token=zz"))) == "Authorization: Bearer [REDACTED] api_key=[REDACTED] ?token=[REDACTED]"


def test_repetition(spark):
    loop = " ".join(["a b c d e f g h"] * 60)
    assert one(spark, tx.repetition_guard(F.lit(loop))) is True
    assert one(spark, tx.repetition_guard(F.lit(" ".join(str(k) for k in range(600))))) is False
    assert one(spark, tx.repetition_guard(F.lit("a a a"))) is False
    assert one(spark, tx.repetition_guard(F.lit(None).cast("string"))) is False


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aB1_ .,-éßÖ\t\n", max_size=30), min_size=1, max_size=20))
def test_normal_form_is_the_plain_rule(spark, texts):
    want = [" ".join(re.sub(r"[^\w]+", " ", unicodedata.normalize("NFKC", t).casefold()).split()) for t in texts]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", tx.normalize_text(F.col("t")).alias("n")).orderBy("k").collect()
    assert [r["n"] for r in rows] == want


def test_jaccard_of_empty_sets(spark):
    empty, some = F.array().cast("array<string>"), F.array(F.lit("a"))
    assert one(spark, tx.jaccard(empty, empty)) == 1.0
    assert one(spark, tx.jaccard(empty, some)) == 0.0
