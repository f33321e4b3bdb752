import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import rules, suggest
from plumbline.operators.rules import Catalogue


def one(df, column, rule):
    return rules.validate(df, [(column, rule)]).first()


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([("a1", "x@y.org", 1), ("a2", "no", 1), (None, None, 2), ("b3", "p@q.de", None)], "c string, m string, n int")


def test_ratios(df):
    r = one(df, "c", rules.completeness())
    assert (r.passed, r.match_count, r.total_count, r.ratio) == (False, 3, 4, 0.75)
    assert one(df, "n", rules.uniqueness()).ratio == 2 / 3
    assert one(df, "m", rules.detection("email", r"@", threshold=0.6)).passed


@pytest.mark.parametrize("match,passed", [("all", False), ("any", True), (0.6, True), ("0.7", False), ("most", False)])
def test_format_match_types(df, match, passed):
    assert one(df, "c", rules.value_format("f", "a", match)).passed is passed


def test_format_is_anchored_and_detection_is_not(df):
    assert one(df, "m", rules.value_format("f", "y", "any")).match_count == 0
    assert one(df, "m", rules.detection("other", "y")).match_count == 1


def test_empty_columns(spark):
    empty = spark.createDataFrame([], "c string")
    for rule, ratio in [(rules.completeness(), 1.0), (rules.uniqueness(), 1.0), (rules.value_format("f", "x"), 1.0), (rules.detection("email", "@"), 0.0)]:
        r = one(empty, "c", rule)
        assert r.ratio == ratio and r.passed == (ratio == 1.0)


def test_python_validator(df):
    @F.pandas_udf("boolean")
    def long_enough(s: pd.Series) -> pd.Series:
        return s.str.len() > 3

    assert one(df, "m", rules.detection("other", predicate=long_enough, threshold=0.5)).match_count == 2


def test_rule_without_method_finds_nothing(df):
    r = one(df, "c", rules.detection("name"))
    assert r.ratio == 0.0 and not r.passed


def test_unicode_digits(spark):
    d = spark.createDataFrame([("٣٤٥",)], "c string")
    check = [("c", rules.value_format("f", r"\d+$"))]
    assert not rules.validate(d, check).first().passed and rules.validate(d, check, unicode=True).first().passed


def test_clamps_and_vocabularies():
    r = rules.completeness(severity=9).with_confidence(3.0)
    assert (r.severity, r.confidence) == (5, 1.0)
    with pytest.raises(ValueError):
        rules.Rule("x", "", "nonsense", "rows")


def test_catalogue(spark):
    cat = Catalogue()
    assert len(cat) == 9 and cat.get("missing") is None
    assert [r.name for r in cat.by_pii_type("ssn")] == ["ssn_detection"] and len(cat.by_category("privacy")) == 7
    assert {r.rule_name: r.severity for r in cat.table(spark).collect()}["credit_card_detection"] == 5


def test_suggestions_are_ordered_and_complete(spark):
    profile = spark.createDataFrame([("a", 0.95), ("b", 0.2)], "column_name string, unique_ratio double")
    scores = spark.createDataFrame([("a", "email", 0.99), ("a", "nonsense", 0.5), ("b", "uniqueness", 7.0), ("z", "email", 1.0)],
                                   "column_name string, label string, confidence double")
    s = suggest.suggest_rules(profile, scores)
    got = {c: [r.rule_name for r in s.where(F.col("column_name") == c).orderBy("position").collect()] for c in "abz"}
    assert got == {"a": ["email_detection", "uniqueness_check", "completeness_check"], "b": ["uniqueness_check", "completeness_check"], "z": []}
    assert s.where("column_name = 'b' and rule_name = 'uniqueness_check'").first().confidence == 1.0
    rec = {r.column_name: r.recommendations for r in suggest.format_recommendations(s).collect()}
    assert [x.rule_name for x in rec["a"]] == got["a"]
    assert '"rule_name":"email_detection"' in suggest.rules_json(s).where("rule_name = 'email_detection'").first().rule_json


@pytest.mark.parametrize("text,scores,regex", [
    ('{"email": 0.9, "name": 0.1}', {"email": 0.9, "name": 0.1}, None),
    ('Sure!\n{"email": 0.9}\nbye', {"email": 0.9}, None),
    ('{"email": 0.9', {}, None), ("nothing", {}, None), (None, {}, None),
    ('{"format": 0.8, "regex_pattern": "^a$"}', {"format": 0.8}, "^a$"),
])
def test_model_text(spark, text, scores, regex):
    r = suggest.parse_scores(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert r.scores == scores and r.regex_pattern == regex


def test_list_form(spark):
    t = '[{"rule_type": "completeness", "confidence": 0.7}, {"rule_type": "magic", "confidence": 1}]'
    parsed = suggest.parse_scores(spark.createDataFrame([("c", t)], "column_name string, t string"), "t")
    rows = suggest.known_recommendations(parsed, ["column_name"], model_id="m1").collect()
    assert [(r.rule_type, r.confidence, r.source, r.model_id) for r in rows] == [("completeness", 0.7, "ml_recommendation", "m1")]
