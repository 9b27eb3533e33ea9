"""Numbering plans: what the expression made of a trie accepts is what the plan says."""

import re

import pytest
from pyspark.sql import functions as F

from veilmark.operators import detect, phones


def plain(number, regions, national):
    """Whether some prefix of some plan fits, digit by digit."""
    for r in regions:
        plan = phones.PLANS[r]
        head = plan.trunk if national else plan.code
        if national and not plan.trunk or not number.startswith(head):
            continue
        own = number[len(head) :]
        if any(len(own) in lengths and re.match(prefix, own) for prefix, lengths in plan.prefixes.items()):
            return True
    return False


@pytest.mark.parametrize("regions", [tuple(phones.PLANS), ("DE",), ("RU", "GB"), ("US", "PL")])
def test_tries_say_what_plans_say(regions):
    import random

    r = random.Random(len(regions))
    heads = ["", "7", "8", "0", "380", "1", "44", "49", "4915", "48", "015", "05", "44 5"]
    numbers = {(r.choice(heads).replace(" ", "") + "".join(r.choice("0123456789") for _ in range(r.randint(5, 12)))) for _ in range(4000)}
    for national in (False, True):
        test = re.compile(phones.valid(regions, national).replace(r"\z", r"\Z"))
        assert [n for n in numbers if bool(test.match(n)) != plain(n, regions, national)] == []
        assert national or any(test.match(n) for n in numbers)


@pytest.mark.parametrize(
    "text, found",
    [
        ("ring 8 (916) 123-45-67 today", ["8 (916) 123-45-67"]), ("ring +7 916 123 45 67.", ["+7 916 123 45 67"]), ("Tel. 030 1234567, or 0151 12345678", ["030 1234567", "0151 12345678"]),
        ("call (212) 555-0100 or 212-555-0100", ["(212) 555-0100", "212-555-0100"]), ("no 2125550100", []), ("on 03.04.2023 and 3/4/2023", []), ("at 10.0.0.12:8080", []), ("id 4111 1111 1111 1111", []),
        ("+999 123456789", []), ("x0301234567", []), ("zadzwoń 512 345 678", ["512 345 678"]), ("suma 123 456 789", []), ("+1 (692) 555-7565", []), ("+1 (017) 555-7713", []), ("+44 (0)20 7123 4567", []), ("(030) 1234567", ["(030) 1234567"]),
    ],
)
def test_national_forms(spark, text, found):
    spans = spark.createDataFrame([(text,)], "t string").select(detect.find_phones(F.col("t"), {"min_digits": 9}, "p").alias("s")).first()["s"]
    assert [text[s["start"] : s["end"]] for s in spans] == found
