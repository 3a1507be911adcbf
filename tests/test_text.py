import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "brief, want",
    [
        ("papers from 2024 on graphs", "specific"),
        ("papers by Geoffrey Hinton on nets", "specific"),
        ("peer-reviewed work on robots", "general"),
        ("renewable energy", "general"),
        ("newton methods", "general"),
        ("recent surveys on diffusion", "survey"),
        ("diffusion models. Exclude surveys.", "general"),
    ],
)
def test_intent(spark, brief, want):
    assert one(spark, brief, X.intent) == want


@pytest.mark.parametrize("brief, want", [("2023 to 2020 work", (2020, 2023)), ("since 2019", (2019, None)), ("before 2015", (None, 2015)), ("the 2017 paper", (None, None)), ("last 3 years", (2023, None)), ("from 2018 to 2020 until 2022", (2018, 2020))])
def test_years(spark, brief, want):
    row = spark.createDataFrame([(brief,)], "v string").select(*X.year_range(F.col("v"), 2026)).first()
    assert tuple(row) == want


def test_not_terms(spark):
    assert one(spark, "x. Exclude surveys and reviews. More text", X.not_terms) == ["surveys", "reviews"]
    assert one(spark, "a\n\nWHAT I AM NOT LOOKING FOR:\nmedical images; toys, abc", X.not_terms) == ["medical images", "toys"]
    assert one(spark, "no papers on toy data. fine", X.not_terms) == ["toy data"]
    assert one(spark, "", X.not_terms) == []


def test_statement(spark):
    assert one(spark, "RESEARCH BRIEF:\n graphs  and\nnets\n\nWHAT I AM NOT LOOKING FOR:\nx", X.semantic_query) == "graphs and nets"
    long = "word " * 60 + "end. " + "tail " * 200
    assert one(spark, long, X.semantic_query).endswith("end.")
    assert len(one(spark, "w" * 1000, X.semantic_query)) == 512


def test_names_and_literals(spark):
    assert one(spark, "by Hinton and LeCun", X.authors_of) == ["Hinton", "LeCun"]
    assert one(spark, "by 2020", X.authors_of) == [] == one(spark, "by Using LoRA", X.authors_of)
    assert one(spark, "Smith-Jones", X.like_literal) == "Smith-Jones"
    assert one(spark, "a'; DROP -- x", X.like_literal) == "a DROP x"
    assert one(spark, "'''", X.like_literal) == ""


def test_venue_and_flags(spark):
    assert one(spark, "Accepted at NeurIPS 2020", X.venue_of) == "NeurIPS"
    assert one(spark, "submitted to ICML", X.venue_of) is None
    assert one(spark, "  ", X.venue_of) is None
    assert one(spark, "We propose a thing", X.paper_type) == "New Technique"
    assert one(spark, None, X.paper_type) == "Other"
    assert one(spark, "One. This is a long sentence! Short? Another sentence, long enough.", X.sentences) == ["This is a long sentence!", "Another sentence, long enough."]
    assert one(spark, 'x ```json\n[{"a": 1}]\n``` y', X.fenced_json) == '[{"a": 1}]'
    assert one(spark, "no list", X.fenced_json) is None


def test_brief(spark):
    row = spark.createDataFrame([(" a ", " b "), ("a", ""), ("", "b"), (" ", "")], "x string, y string").select(X.brief(F.col("x"), F.col("y"))).collect()
    assert [r[0] for r in row] == ["RESEARCH BRIEF:\na\n\nWHAT I AM NOT LOOKING FOR:\nb", "RESEARCH BRIEF:\na", "WHAT I AM NOT LOOKING FOR:\nb", "The user did not provide any research brief."]
