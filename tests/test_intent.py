import pytest
from pyspark.sql import functions as F

from quayside.functions import intent
from quayside.operators import routing

LANGUAGES = [
    ("When does the ferry leave?", "en"), ("Name the three oldest lighthouses.", "en"),
    ("Is the pier open on Sundays?", "en"), ("নৌকা কখন ছাড়বে?", "bn"),
    ("ঘাটে আজ অনেক মানুষ এসেছে", "bn"), ("এই ferry কখন ছাড়বে?", "mixed"),
    ("ticket এর price জানতে চাই", "mixed"), ("Ferry ta kokhon ashbe bolo", "banglish"),
    ("amar ticket kothay?", "banglish"), ("Khulna jete koto taka lagbe?", "banglish"), ("bhai kemon achen", "banglish"),
    ("", "en"), ("77 -- 8 !", "en"),
]

ROUTES = [
    ("Count the sales per month", "SQL"), ("Average rating of each brand this year", "SQL"),
    ("List the top warehouse by stock", "SQL"), ("Total income of last week", "SQL"),
    ("Are sailors entitled to a holiday?", "RAG"), ("Tell me the dress code", "RAG"), ("Which guidelines cover night shifts?", "RAG"),
    ("Explain how tides work.", "GENERAL"), ("Good morning", "GENERAL"),
    ("Which brand has the lowest rating, and what do the guidelines say about eligibility?", "HYBRID"),
    ("মোট কতগুলো লেনদেন হয়েছে?", "SQL"), ("ছুটির শর্ত জানান", "RAG"),
    ("holiday er niyom bolen", "RAG"), ("kotojon grahok kinse last mash?", "SQL"),
]


def test_languages(evaluate):
    assert evaluate(intent.detect_language, [t for t, _ in LANGUAGES]) == [c for _, c in LANGUAGES]


def test_ratio(evaluate):
    assert evaluate(intent.bengali_ratio, ["নদীর ঘাট", "pier", ""]) == [1.0, 0.0, 0.0]


def test_routes(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ROUTES)], "i int, text string")
    rows = intent.with_intent(df, F.col("text")).orderBy("i").collect()
    assert [r["route"] for r in rows] == [r for _, r in ROUTES]
    assert all(0 < r["confidence"] <= 0.9 for r in rows)


def test_hits_respect_word_boundaries(evaluate):
    assert evaluate(lambda c: intent.keyword_hits(c, ["order"]), ["the order book", "reorder", "orders", "<ORDER>"]) == [1, 0, 0, 1]
    assert evaluate(lambda c: intent.keyword_hits(c, ["মজুদ"]), ["আজকের মজুদ দেখি"]) == [1]
    assert evaluate(lambda c: intent.keyword_hits(c, ["can't", "best-selling", "order", "order"]), ["They can't order the best-selling kite"]) == [4]


def test_company_name_is_a_parameter(spark):
    df = spark.createDataFrame([("hear a story of acme",)], "text string")
    assert intent.with_intent(df, F.col("text")).first()["route"] == "GENERAL"
    assert intent.with_intent(df, F.col("text"), ("acme",)).first()["route"] == "RAG"


def decide(spark, text, model, confidence, relevance=0.0, documents=1, asks=False):
    df = spark.createDataFrame([(text, model, confidence, relevance, documents, asks)],
                               "text string, model_route string, model_confidence double, relevance double, documents int, asks_clarification boolean")
    rows = intent.with_intent(df, F.col("text")).withColumnsRenamed({"route": "heuristic_route", "confidence": "heuristic_confidence"})
    return routing.fuse_route(rows).first()


def test_agreement_raises_confidence(spark):
    row = decide(spark, "Count the sales per month", "SQL", 0.8)
    assert row["route"] == "SQL" and row["confidence"] == pytest.approx(0.85) and row["source"] == "llm"


def test_safeguards(spark):
    row = decide(spark, "Which guidelines cover night shifts?", "GENERAL", 0.7)
    assert row["route"] == "RAG" and row["source"] == "llm+safeguard"
    assert decide(spark, "Describe lantern cleaning", "GENERAL", 0.6, 0.8)["route"] == "RAG"
    row = decide(spark, "How long is a warranty on a brand?", "SQL", 0.9, 0.6)
    assert row["route"] == "RAG" and "no data aggregation" in row["overrides"]
    assert decide(spark, "How long is a warranty on a brand?", "SQL", 0.9, 0.1)["route"] == "SQL"
    assert decide(spark, "Average rating of each brand this year", "SQL", 0.9, 0.6)["route"] == "SQL"
    assert decide(spark, "Best brand and its guidelines?", "HYBRID", 0.9, documents=0)["route"] == "SQL"


def test_clarification(spark):
    assert decide(spark, "and the other one", "SQL", 0.2, asks=True)["needs_clarification"]


def test_follow_up_inherits_subject_over_many_messages(spark):
    rows = [(1, 0, "user", "Count the sales per month")] + [(1, i, "assistant", "x") for i in range(1, 40)]
    rows += [(1, 40, "user", "And which of those were late?"), (2, 0, "user", "And which of those were late?")]
    df = spark.createDataFrame(rows, "conv int, turn bigint, role string, text string")
    import quayside.operators.carry as carry

    carried = carry.last_before(df, ["conv"], "turn", F.when(F.col("role") == "user", F.col("text")), "previous", block=8)
    found = {(r["conv"], r["turn"]): r["previous"] for r in carried.collect()}
    assert found[1, 40] == rows[0][3] and found[1, 0] is None and found[2, 0] is None and found[1, 17] == rows[0][3]
    out = {r["conv"]: r["signal_text"] for r in routing.inherit_subject(df, "conv", "turn").filter("turn in (0, 40) and text like '%those%'").collect()}
    assert out[1].startswith("Count the sales") and out[2] == "And which of those were late?"


def test_fallback(evaluate):
    route = evaluate(lambda c: routing.heuristic_fallback(c, F.lit(0.9), F.lit(0.6))[0], ["GENERAL", "SQL"])
    assert route == ["RAG", "SQL"]
