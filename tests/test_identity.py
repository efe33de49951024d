import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxward.functions.identity import hash_number, is_voip, is_voip_name, validate_number
from voxward.operators import caller

GOLDEN = [
    (" +1 (202) 555-0133 ", "+12025550133"),
    ("\x1c+12345678", "+12345678"),
    ("+٢٠١٢٣٤٥٦٧٨", "+٢٠١٢٣٤٥٦٧٨"),
    ("+12a34567890", None),
    ("+123456", None),
    ("12345678", None),
    ("", None),
    (" +44 20 7946 0958\n", "+442079460958"),
]


def numbers(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.n for r in df.select("i", validate_number(F.col("t")).alias("n")).orderBy("i").collect()]


def test_golden_numbers(spark):
    assert numbers(spark, [t for t, _ in GOLDEN]) == [n for _, n in GOLDEN]


def expected(text):
    bare = text.strip()
    digits = re.sub(r"\D", "", bare)
    ok = bare[:1] == "+" and not re.search("[a-zA-Z]", bare) and len(digits) > 6
    return "+" + digits if ok else None


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="+0123456789 ()-\t\n\x1c\x1f  aZé٣۴", max_size=18), min_size=20, max_size=60))
def test_numbers_equal_python(spark, texts):
    texts = texts + ["+" + t for t in texts]
    assert numbers(spark, texts) == [expected(t) for t in texts]


def test_hash(spark):
    df = spark.createDataFrame([("+12025550133",)], "n string").select(hash_number(F.col("n")))
    assert df.first()[0] == hashlib.sha256(b"+12025550133").hexdigest()
    assert df.first()[0].startswith("c732834faf138b0f")


def test_keywords_match_as_substrings(spark):
    rows = [
        ("WhatsApp.exe", ["explorer.exe", "whatsapp.exe"]),
        ("audio.exe", ["Teams.exe", "audio.exe"]),
        ("audio.exe", ["audio.exe"]),
        ("audio.exe", None),
    ]
    df = spark.createDataFrame(rows, "name string, chain array<string>")
    got = df.select(is_voip(F.col("name"), F.col("chain")), is_voip_name(F.col("name"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, False), (False, False), (False, False)]


def test_first_caller(spark):
    rows = [
        ("a", "Video call", 1, 1, "+4915112345678"),
        ("a", "Voice call", 5, 2, "+12025550133"),
        ("a", "Voice call", 2, 2, "Mum"),
        ("a", "Voice call", 3, 16, "+19999999999"),
        ("b", "Video call", 4, 15, "+4915112345678"),
        ("b", "Video call", 9, 1, "+4915100000000"),
        ("c", "Voice call", 1, 1, "Alice +12345678"),
        ("c", "Video call", 1, 1, "+12345678"),
        ("d", "Settings", 1, 1, "+12345678"),
        ("e", "Video call", 1, 1, None),
        ("e", "Video call", 2, 1, ""),
    ]
    ui = spark.createDataFrame(
        rows, "call_id string, window_name string, walk_ordinal int, depth int, text string"
    )
    found = caller.first_caller_id(ui)
    got = {r.call_id: r.caller_number for r in found.collect()}
    assert got == {"a": "+12025550133", "b": "+4915112345678", "c": None, "e": None}
    hashed = caller.caller_hashes(found)
    assert "caller_number" not in hashed.columns and hashed.count() == 2
