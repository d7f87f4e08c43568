import random

from test_suffixes import check


def test_a_crowd_around_a_passage_hides_no_match(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    passage = [word() for _ in range(60)]
    many = []
    for _ in range(200):  # one document has it over and over, between differing words
        many += [word() for _ in range(30)] + passage
    rows = [(1, " ".join(many)), (2, " ".join([*(word() for _ in range(40)), *passage, *(word() for _ in range(40))]))]
    boiler, lead = [word() for _ in range(40)], [word() for _ in range(10)]
    for i in range(100):  # many have the boilerplate, two of them the words before it too
        rows.append((10 + i, " ".join([*(word() for _ in range(30)), *(lead if i in (20, 70) else ()), *boiler, *(word() for _ in range(60))])))
    check(spark, rows)
