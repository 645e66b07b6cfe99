"""Passages that must be found whatever their letter case, placeholders, parameters and share of the item."""

from eventrate.llm.templates import FORMS, contaminated
from llm.test_templates import ITEM, MIXED_UP, found

TITLE = "Who Wrote The Famous Novel About Captain Ahab And The White Whale"
NUMBERS = "3 1 4 1 5 9 2 6 5 3 5 8 9 7 9 3"


def leaks(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    return found(contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string"), forms=FORMS))


def test_copies_are_found_whatever_their_words(spark):
    docs = [
        (1, f"so {ITEM.lower()} end"), (2, ITEM.upper()), (3, f"asked: {TITLE}?"), (4, TITLE.lower()), (5, f"pi is {NUMBERS} and on"),
        (6, MIXED_UP), (7, "Who Wrote The Famous Song And Sang It To The Whole Town"), (8, NUMBERS[:15]),
    ]
    got = leaks(spark, docs, [(70, ITEM), (71, TITLE), (72, NUMBERS)])
    assert set(got) == {(1, 70), (2, 70), (3, 71), (4, 71), (5, 72)}
    assert got[(1, 70)] == got[(2, 70)] == got[(3, 71)] == (100.0, True) and got[(5, 72)] == (0.0, True)


def test_long_runs_are_found_whatever_their_share(spark):
    item = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)) + f" {ITEM}"
    words = item.split(" ")
    docs = [
        (1, " ".join(words[50:150])), (2, " ".join(words[50:63])), (3, " ".join(words[50:62])),
        (4, "if Peter boards in Denver and pays 22 dollars, how many km does Peter travel in 5 hours"),
    ]
    got = leaks(spark, docs, [(70, item)])
    assert set(got) == {(1, 70), (2, 70), (4, 70)} and got[(1, 70)][1] and not got[(4, 70)][1]
    assert all(percent < 40 for percent, _ in got.values())


def test_names_at_sentence_starts_are_parameters(spark):
    asked = "{0} has {1} red apples in a bag. {0} buys {2} more apples at the shop. {0} gives {3} apples away. How many apples does {0} have now?"
    item = asked.format("Tom", 3, 5, 2)
    mixed = item.replace("Tom buys", "Anna buys").replace("Tom gives", "Eva gives")
    docs = [(1, asked.format("Anna", 4, 7, 6)), (2, item), (3, mixed)]
    got = leaks(spark, docs, [(70, item)])
    assert {(1, 70), (2, 70)} <= set(got)
    assert got[(1, 70)] == (100.0, False) and got[(2, 70)] == (100.0, True) and (3, 70) not in got
