import pytest
from pyspark.sql import functions as F

from gistmill.functions import text as tx
from gistmill.functions.stemmer import stem


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column("t").alias("v")).first()["v"]


def test_stems():
    words = "Seven sailors carried heavy ladders towards sinking ships".split()
    assert [stem(w) for w in words] == ["seven", "sailor", "carri", "heavi", "ladder", "toward", "sink", "ship"]
    pairs = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre",
        "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
        "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss",
        "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "enjoy": "enjoy",
        "relational": "relat", "conditional": "condit", "digitizer": "digit", "radically": "radic",
        "vietnamization": "vietnam", "operator": "oper", "feudalism": "feudal", "hopefulness": "hope",
        "sensitiviti": "sensit", "triplicate": "triplic", "formalize": "formal", "electrical": "electr",
        "goodness": "good", "revival": "reviv", "allowance": "allow", "adjustable": "adjust", "replacement": "replac",
        "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas",
        "controll": "control", "roll": "roll", "dying": "die", "spied": "spi", "died": "die", "Jackie": "jacki", "is": "is",
    }
    assert {w: stem(w) for w in pairs} == pairs


def test_stem_udf_keeps_rows(spark):
    rows = [(["Running", "dogs", "run"],), ([],), (None,), (["dogs"],)]
    got = spark.createDataFrame(rows, "w array<string>").coalesce(1).select(tx.stems("w").alias("s")).collect()
    assert [r.s for r in got] == [["run", "dog", "run"], [], [], ["dog"]]


@pytest.mark.parametrize("text, expected", [("a\nb", "ab"), ("a\tb c", "ab c"), (None, ""), ("x y​z", "xyz")])
def test_sanitize(spark, text, expected):
    assert value(spark, tx.sanitize, text) == expected


@pytest.mark.parametrize(
    "text, plain, full",
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"], ["One.", "Two!", "Three?"]),
        ("Dr. Who came. Fine", ["Dr.", "Who came.", "Fine"], ["Dr. Who came.", "Fine"]),
        ("He said \"no.\" Then left.", ["He said \"no.\"", "Then left."], ["He said \"no.\"", "Then left."]),
        ("well... maybe. Yes... No", ["well...", "maybe.", "Yes...", "No"], ["well... maybe.", "Yes...", "No"]),
        ("J. Smith is in. Ok?! Yes", ["J.", "Smith is in.", "Ok?!", "Yes"], ["J. Smith is in.", "Ok?!", "Yes"]),
        ("  \n ", [], []),
        ("a.b c", ["a.b c"], ["a.b c"]),
    ],
)
def test_split(spark, text, plain, full):
    assert value(spark, lambda c: tx.split_sentences(c, "plain"), text) == plain
    assert value(spark, tx.split_sentences, text) == full


def test_words(spark):
    sentence = "Her kettle, an old kettle, whistled and Her cats were whistling"
    assert value(spark, tx.count_words, sentence) == 11
    words = value(spark, lambda c: tx.stems(tx.drop_stop_words(tx.split_words(tx.strip_punctuation(c)))), sentence)
    # Stop words are case-sensitive: "Her" stays.
    assert words == ["her", "kettl", "old", "kettl", "whistl", "her", "cat", "whistl"]
    assert value(spark, tx.strip_punctuation, "don't - stop!") == "dont  stop"
    assert value(spark, tx.close_sentence, "so") == "so."
    assert value(spark, tx.close_sentence, "so…") == "so…."
    assert value(spark, tx.close_sentence, "so!") == "so!"


def test_topic_words(spark):
    assert value(spark, tx.topic_words, "The cat's 42nd LIFE, a pneumonoultramicroscopic x") == ["cats", "nd", "life"]


def test_markup(spark):
    assert value(spark, tx.prune_code, "a ```b\nc``` d ```e") == "a  d ```e"
    assert value(spark, tx.prune_titles, "### A\ntext\n  #### B\n## kept") == "\ntext\n\n## kept"
    runs = value(spark, tx.bold_runs, "a **b** c **d")
    assert [(r.text, r.bold) for r in runs] == [("a ", False), ("b", True), (" c **d", False)]
    runs = value(spark, lambda c: tx.bold_runs(c, drop_unbalanced=True), "a **b** c **d")
    assert [(r.text, r.bold) for r in runs] == [("a ", False), ("b", True), (" c ", False)]


def test_bold_runs_match_pattern(spark):
    plain, bold = (lambda t: (t, False)), (lambda t: (t, True))
    runs = {
        "": [], "x": [plain("x")], "**a**": [bold("a")], "a**b**c**d**e": [plain("a"), bold("b"), plain("c"), bold("d"), plain("e")],
        "**": [plain("**")], "a****b": [plain("a"), bold(""), plain("b")], "**a** **b": [bold("a"), plain(" **b")],
        "***a***": [bold("*a"), plain("*")],
    }
    for text, expected in runs.items():
        got = [(r.text, r.bold) for r in value(spark, tx.bold_runs, text)]
        assert got == expected, text


def test_contains_any(spark):
    words = ["ass", "a.b", "x|y", "été", "assess"]
    rows = ["class", "aXb", "a.b", "x", "x|y", "ÉTÉ", "none", None, ""]
    got = [
        r.v for r in spark.createDataFrame([(r,) for r in rows], "t string").coalesce(1)
        .select(tx.contains_any("t", words).alias("v")).collect()
    ]
    assert got == [any(w in (r or "").lower() for w in words) for r in rows]
    assert value(spark, lambda c: tx.contains_any(c, []), "a") is False


def test_kl_of_fixed_vectors(spark):
    import math

    from gistmill.operators.scoring import kl_divergence

    p = [0.5, 0.25, 0.125, 0.125]
    q = [0.25, 0.25, 0.3, 0.2]
    row = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(
        kl_divergence("p", "q").alias("pq"), kl_divergence("p", "p").alias("pp")).first()
    assert row.pq == pytest.approx(sum(a * math.log(a / b) for a, b in zip(p, q)))
    assert row.pp == 0.0


def test_null_words(spark):
    assert spark.range(1).select(F.size(tx.split_words(F.lit("")))).first()[0] == 0
