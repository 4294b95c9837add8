"""Text functions and predicates on the cases that fix their meaning."""

import pytest
from pyspark.sql import functions as F

from linkspan.functions import predicates as P
from linkspan.functions import text as X


def value(spark, column, **cells):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "norm"),
    [
        ("Chronic Kidney Disease (CKD)", "chronic kidney disease"),
        ("Alzheimer’s Disease", "alzheimer's disease"),
        ("Crohn's,  non-small  cell!", "crohn's non-small cell"),
        ("", ""),
        (None, ""),
        ("(only)", ""),
    ],
)
def test_normalize(spark, raw, norm):
    assert value(spark, X.normalize(F.col("x")), x=raw) == norm


def test_split_names(spark):
    three = "Chronic Fatigue Syndrome (CFS) Myalgic Encephalomyelitis (ME) Systemic Exertion Intolerance Disease (SEID)"
    assert value(spark, X.split_names(F.col("x")), x=three) == ["Chronic Fatigue Syndrome", "Myalgic Encephalomyelitis", "Systemic Exertion Intolerance Disease"]
    assert value(spark, X.split_names(F.col("x")), x="Heart Failure (HF)") == []


@pytest.mark.parametrize(
    ("entry", "names"),
    [
        ("DDT COA #000006: Asthma Daytime Symptom Diary (ADSD) and Asthma Nighttime Symptom Diary (ANSD)", ["Asthma Daytime Symptom Diary", "Asthma Nighttime Symptom Diary"]),
        ("Cutaneous Lupus Erythematosus Disease Area and Severity Index (CLASI) in Systemic Lupus Erythematosus (SLE)", ["Cutaneous Lupus Erythematosus Disease Area and Severity Index in Systemic Lupus Erythematosus"]),
        ("Hidradenitis Suppurativa Area and Severity Index (HASI)", ["Hidradenitis Suppurativa Area and Severity Index"]),
        ("Crohn's Disease Patient-Reported Outcomes Signs and Symptoms (CD-PRO/SS)", ["Crohn's Disease Patient-Reported Outcomes Signs and Symptoms"]),
        ("", []),
    ],
)
def test_instrument_names(spark, entry, names):
    assert value(spark, X.instrument_names(F.col("x")), x=entry) == names


def test_keys_and_codes(spark):
    for raw in ("DDT-COA-000112", "DDT COA #000112: Diary"):
        assert value(spark, X.six_digit_key(F.col("x")), x=raw) == "000112"
        assert value(spark, X.digits_key(F.col("x")), x=raw) == "000112"
    assert value(spark, X.six_digit_key(F.col("x")), x="none") is None
    assert value(spark, X.entry_number(F.col("x")), x="0012-34") == "0012-34"
    assert [value(spark, X.dotted_code(F.col("x")), x=c) for c in ("A000", "C441021", "A00")] == ["A00.0", "C44.1021", "A00"]
    assert value(spark, X.iri_to_curie(F.col("x")), x="http://x.org/obo/MONDO_0005148") == "MONDO:0005148"
    assert value(spark, X.last_segment(F.col("x")), x="https://x/codes/123/") == "123"
    assert value(spark, X.safe_name(F.col("x")), x="A b/c-1") == "A_b_c_1"
    assert value(spark, X.instrument_version(F.col("x")), x="ADSD Version 1.0 Test") == "1.0"


def test_drugs_and_measures(spark):
    assert value(spark, X.clean_drug(F.col("x")), x="Dapagliflozin 10mg Tab [Forxiga]") == "Dapagliflozin"
    assert value(spark, X.clean_measure(F.col("x")), x="Change from baseline in NSAA Total Score at week 48") == "NSAA Total Score"
    assert value(spark, X.clean_measure(F.col("x")), x="Mean change in Change in X at 12 weeks of age") == "X"
    (e,) = value(spark, X.drug_entries(F.col("x")), x="1. Brilinta (ticagrelor) July 20, 2011")
    assert tuple(e) == ("Brilinta", "ticagrelor", "July 20, 2011")
    assert value(spark, X.drug_entries(F.col("x")), x="Qualified COA …") == []
    key = X.combination_key(F.col("n"), F.col("i"))
    assert value(spark, key["ids"], n=["valsartan", "Sacubitril"], i=["2", "1"]) == value(spark, key["ids"], n=["Sacubitril", "valsartan"], i=["1", "2"]) == "1/2"
    assert value(spark, X.generics_agree(F.col("a"), F.col("b")), a="ticagrelor", b="TICAGRELOR TABLETS") is True
    assert value(spark, X.generics_agree(F.col("a"), F.col("b")), a="", b="x") is False


@pytest.mark.parametrize(("term", "text", "hit"), [("AR", "arginase 1 deficiency", False), ("hip fracture", "chip fracture of the talus", True), ("AR", "the AR gene", True), ("", "x", False), ("a.b", "axb", False)])
def test_term_matches(spark, term, text, hit):
    assert value(spark, P.term_matches(F.col("t"), F.col("x")), t=term, x=text) is hit


@pytest.mark.parametrize(("phrase", "text", "hit"), [("ess", "assessment", False), ("6mwt", "distance (6mwt) at", True), ("", "x", False)])
def test_phrase_in(spark, phrase, text, hit):
    assert value(spark, P.phrase_in(F.col("p"), F.col("x")), p=phrase, x=text) is hit


def test_other_predicates(spark):
    for item in ("placebo", "Standard of care", "GDMT"):
        assert value(spark, P.plainly_no_drug(F.col("x")), x=item) is True
    assert value(spark, P.control(F.col("x")), x="Matching Placebo tablet") is True
    assert value(spark, P.trial_id(F.col("x")), x="NCT123") is False
    assert value(spark, P.symbol_in_name(F.col("s"), F.col("n")), s="AR", n="Marfan syndrome") is False
    assert value(spark, P.symbol_in_name(F.col("s"), F.col("n")), s="FOXG1", n="FOXG1 syndrome") is True
    assert value(spark, P.typed(F.col("x")), x=["Gene or Genome"]) is False
    assert value(spark, P.typed(F.col("x")), x=["Sign or Symptom"]) is True
    assert value(spark, P.disease_branch(F.col("x")), x=["F03.1", "A01"]) is True


def test_wrapped_names(spark):
    from linkspan.functions import display

    def plain(names, indent, width):
        out, line = [], None
        for i, n in enumerate(names):
            piece = n + ("," if i < len(names) - 1 else "")
            if line is None:
                line = indent + piece
            elif len(line) + 1 + len(piece) > width:
                out.append(line)
                line = " " * len(indent) + piece
            else:
                line += " " + piece
        return "\n".join(out + ([line] if line is not None else []))

    cases = [[], ["one"], ["name" * 30], [f"name{i}" * (1 + i % 4) for i in range(40)], ["a"] * 100]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)] + [(9, None)], "i int, names array<string>")
    got = {r["i"]: r["w"] for r in df.select("i", display.wrapped(F.col("names"), "  12  ", 40).alias("w")).collect()}
    assert got == {i: plain(c, "  12  ", 40) for i, c in enumerate(cases)} | {9: ""}


def test_loose_words(spark):
    texts = ["Don’t (x y) stop—İstanbul's  a-b_c", "", None, "x(y(z)w)v", "(open", " 12 mg/ml ÄÖ ü\u00a0q\u2003r\n", "--'--"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(X.loose_words(F.col("t")).alias("w"), F.filter(F.split(X.normalize_loose(F.col("t")), " "), lambda w: w != "").alias("v")).collect():
        assert r["w"] == r["v"]
