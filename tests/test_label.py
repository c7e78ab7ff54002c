"""Golden replies and their labels."""

import pytest

from evalloom.functions import text as T
from evalloom.functions import values as V
from evalloom.operators.label import capture_tags, label_answers

# Replies with the labels they must get.
NO_ANSWER = [
    ("deposit", [], "The records do not contain information about Cloncler Holdings' lease at Semquoax Place or any security deposit related to such a lease. Therefore, the answer is not in the records.", "refused", False),
    ("monthly_rent", [], "N/A", "refused", False),
    ("floor", ["20"], "NOT FOUND", "refused", False),
    ("end_date", [], "I checked every lease.\n\nFinal answer: Unknown", "refused", False),
    ("start_date", [], "The archive does not have a record for Diendpai Holdings.", "refused", False),
    ("deposit", [], "There is no such lease in the records.", "refused", False),
    ("monthly_rent", [], "**Not in the records.**", "refused", False),
    ("floor", ["20"], "The records do not mention \"Pousquieck Studios.\" The closest match is \"Pousquieck Pharma,\" which leases space on floor 20 of Keartdris Center.\n\nAnswer: Not in the records.", "refused", False),
    ("end_date", ["July 28, 2024"], "The records do not contain information about a 2021 lease between Rernbeart Robotics and Hostdres Court. The lease mentioned starts on July 30, 2022, and ends on July 28, 2024. Therefore, there is no 2021 lease between them, and the expiration date is not in the records.", "refused", False),
    ("monthly_rent", ["$6,700"], "The lease between Skolkem Engineering and Thommis Point started in 2015, not 2014. The monthly rent is $6,700. Therefore, there is no lease between Skolkem Engineering and Thommis Point that started in 2014.", "refused", False),
    ("deposit", [], "There is no information about a deposit for Brietrirt Outfitters' lease.", "refused", False),
    ("monthly_rent", [], "No lease for Gielcam Supply began in 2019, so the rent for that lease is not in the records.", "refused", False),
    ("floor", ["29"], "The space leased by Cainweil Interiors is on floor 29.", "made_up", True),
    ("monthly_rent", ["$6,050"], "The monthly rent on Praindwoux Outfitters' lease is $6,050.", "made_up", True),
    ("end_date", ["April 10, 2024"], "Quoamcheal Brewing's lease ends on April 10, 2024.", "made_up", True),
    ("start_date", ["December 30, 2018"], "Answer: 2018-12-30", "made_up", True),
    ("deposit", ["$12,400"], "12400", "made_up", True),
    ("monthly_rent", ["$5,000"], "About $5k per month.", "made_up", True),
    ("floor", ["12"], "They lease the 12th floor.", "made_up", True),
    ("floor", ["3"], "Third floor.", "made_up", True),
    ("monthly_rent", [], "It is not listed, but maybe 5,000.", "made_up", False),
    ("deposit", ["$9,800"], "The deposit is not stated, but it is probably $9,800.", "made_up", True),
    ("monthly_rent", ["$8,650"], "The records do not mention Laskous Networks. The lease mentioned is for Laskoes Networks, which pays $8,650 per month. Therefore, the monthly rent Laskoes Networks pays under its lease is $8,650.", "made_up", True),
    ("end_date", ["January 28, 2027"], "This exact lease is not listed. The closest is the 2022 lease.\nAnswer: January 28, 2027", "made_up", True),
    ("monthly_rent", ["$7,900"], "The monthly rent is $3,200.", "made_up", False),
    ("deposit", [], "I cannot find it; my best guess is $10,000.", "made_up", False),
    ("monthly_rent", [], "", "other", False),
    ("monthly_rent", ["$4,000"], "The lease is on floor 12 of Keartdris Center.", "other", False),
    ("floor", [], "Could you tell me which company you mean?", "other", False),
    ("deposit", [], "The lease began in 2019.", "other", False),
]
WITH_ANSWER = [
    ("monthly_rent", ["$20,200", "20,200", "20200"], "Toxlund Ventures pays $20,200 per month.", "correct"),
    ("deposit", ["$58,950"], "The deposit was 58950 dollars.", "correct"),
    ("end_date", ["February 9, 2025", "2025-02-09"], "It ends 2025-02-09.", "correct"),
    ("start_date", ["May 19, 2022"], "The lease began on 19 May 2022.", "correct"),
    ("floor", ["16"], "The floor number on Wiertdrex Holdings' lease is 16.", "correct"),
    ("floor", ["19"], "Bendtom Foods leases the 19th floor.", "correct"),
    ("deposit", ["$38,400"], "The security deposit on that lease is not in the records.", "wrong_refusal"),
    ("floor", ["27"], "The records do not specify which floor. The lease information states floor 27, but this is from a different lease record. Therefore, the answer is not in the records.", "wrong_refusal"),
    ("monthly_rent", ["$4,550"], "The monthly rent is $4,500.", "wrong"),
    ("end_date", ["March 20, 2027"], "It ends on March 21, 2027.", "wrong"),
    ("floor", ["4"], "Tiemfoan Printworks has a lease at Keartdris Center.", "other"),
]
COLUMNS = "n int, field string, answerable boolean, gold_aliases array<string>, lookalike_values array<string>, response string, document string"


def test_labels(spark):
    rows = [(k, f, False, [], la, r, None) for k, (f, la, r, _, _) in enumerate(NO_ANSWER)] + [(100 + k, f, True, g, [], r, None) for k, (f, g, r, _) in enumerate(WITH_ANSWER)]
    got = {r.n: r for r in capture_tags(label_answers(spark.createDataFrame(rows, COLUMNS))).collect()}
    assert [(got[k].label, got[k].captured) for k in range(len(NO_ANSWER))] == [x[3:] for x in NO_ANSWER]
    assert [got[100 + k].label for k in range(len(WITH_ANSWER))] == [x[3] for x in WITH_ANSWER]


def test_sources_and_mentions(spark):
    document = "Lease A: rent $7,900 per month. Lease B: rent $3,200 per month."
    rows = [
        (1, "monthly_rent", False, None, ["$7,900"], "It is $3,200.", document),
        (2, "monthly_rent", False, None, ["$7,900"], "It is $1,111.", document),
        (3, "floor", False, None, ["18"], "The records do not mention Suxtrend Interiors. Suxtrend Logistics is on floor 18 of Sieckthi Hall.\n\nAnswer: Not in the records.", None),
        (4, "nq_answer", True, ["The Beatles"], None, "It was Beatles.", None),
        (5, "nq_answer", False, None, None, None, None),
    ]
    got = {r.n: r for r in capture_tags(label_answers(spark.createDataFrame(rows, COLUMNS)), "document").collect()}
    assert [got[1].value_source, got[2].value_source] == ["other_record", "not_in_document"]
    assert got[3].label == "refused" and got[3].mentions_lookalike and not got[3].captured
    assert got[4].label == "correct" and got[5].label == "other"


@pytest.mark.parametrize(
    ("parse", "text", "want"),
    [
        (V.parse_money, "$5,000 and 1,250.50 and $3k, year 2021", [5000.0, 1250.5, 3000.0]),
        (V.parse_dates, "Jan 5, 2024; 2024-01-05; 5 January 2024; 1/5/2024", ["2024-01-05"]),
        (V.parse_dates, "February 30, 2024", []),
        (V.parse_floors, "floor 7, the 12th floor, Floor #3", [7, 12, 3]),
    ],
)
def test_values(spark, parse, text, want):
    from pyspark.sql import functions as F

    assert spark.range(1).select(parse(F.lit(text)).alias("x")).first().x == want


def test_answer_part(spark):
    from pyspark.sql import functions as F

    texts = ["Blah.\nFinal answer: N/A", "Not here. Therefore, it is $5.", "The rent is $5. It was a good lease.", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.answer_part("t")["source"].alias("s"), T.is_abstain_token(F.lit("Unknown")).alias("a"))
    assert [r.s for r in rows.collect()] == ["final_line", "conclusion", "first_sentence", "empty"]


def test_prelabels(spark):
    from evalloom.operators.label import prelabel_match, prelabel_unanswerable

    rows = [
        ("It is not in the records.", ["$5,000"], "R", "high"),
        ("The rent is $5,000.", ["$5,000"], "U", "high"),
        ("However, the closest lease pays $5,000.", ["$5,000"], "W", "medium"),
        ("It is not listed, though one pays 5000 dollars.", ["$5,000"], "W", "medium"),
        ("Floor 9.", ["$5,000"], "U", "medium"),
        ("One could ask the owner of that place about all of these things.", [], "O", "low"),
    ]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, t string, v array<string>")
    got = df.select("i", prelabel_unanswerable("t", "v").alias("x")).orderBy("i").collect()
    assert [(r.x.label, r.x.confidence) for r in got] == [r[2:] for r in rows]
    rows = [("born 1867 marie curie", ["marie curie"], "yes"), ("in 1867", ["november 1867"], "yes"), ("number 42", ["42 apples"], "yes"), ("marie smith", ["marie curie"], "unsure"), ("nobody", ["marie curie"], "no"), ("x", [], "no")]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, t string, v array<string>")
    assert [r.x.label for r in df.select("i", prelabel_match("t", "v").alias("x")).orderBy("i").collect()] == [r[2] for r in rows]


def test_batch_and_same_answers(spark):
    from pyspark.sql import functions as F

    text = "intro\n1. one\nmore\n**2)** two\n1. again\n14. late\n(3) three"
    got = spark.range(1).select(T.batch_answers(F.lit(text), 12).alias("x"), *[T.same_answer(F.lit(a), F.lit(b)).alias(f"s{i}") for i, (a, b) in enumerate([("$1,000", "1000.4"), ("Ann Lee", "ann-lee."), ("abc", "abcd"), ("abcd", "xabcdx"), ("", "a"), (None, None)])]).first()
    assert got.x == {1: "one more", 2: "two 1. again 14. late", 3: "three"}
    assert [got[f"s{i}"] for i in range(6)] == [True, True, False, True, False, False]
