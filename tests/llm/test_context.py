"""Context words count by their distance, whatever other matches lie between."""

import random
import re

from siltmark.llm import pii


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["pii"]] for r in pii.find_pii(df).collect()}


def test_lists_after_one_context_word(spark):
    got = found(spark, [
        "phone 555-123-4567, 555-123-4568", "Social security: 123-45-6789 and 123-45-6780", "ssn 123-45-6789, 123-45-6780, 123-45-6781, 123-45-6782, 123-45-6783",
        "123-45-6789, 123-45-6780 (ssn)", "x" * 60 + " 123-45-6789 123-45-6780", "born 12/10/1980 31/12/1981",
    ])
    assert [len(got[k]) for k in range(6)] == [2, 2, 4, 2, 0, 2]
    assert got[0] == [("local_phone", "555-123-4567"), ("local_phone", "555-123-4568")]


def test_context_is_that_of_the_text_by_place(spark):
    """Of every candidate by a plain search: the words before and after it within reach decide."""
    rng = random.Random(9)
    words = ["ssn", "phone", "tel", "code", "123-45-6789", "234-56-7890", "555-123-4567", "(555) 123-4567", "a", "lorem", "12/10/1980", "born"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    got = found(spark, texts)
    base = {k.name for k in pii.BASE}
    for k, text in enumerate(texts):
        # an added span that overlaps a base span goes
        taken = [m for kind, value in got[k] if kind in base for m in re.finditer(re.escape(value), text)]
        for kind in pii.ADDED:
            if kind.name not in ("ssn", "local_phone"):
                continue
            pattern = kind.pattern.replace("(?iu)", "")
            expected = []
            for m in re.finditer(pattern, text):
                before, after = text[max(0, m.start() - pii.BEFORE) : m.start()], text[m.end() : m.end() + pii.AFTER]
                context = re.compile(kind.context.replace("(?iu)", ""), re.I)
                free = all(m.end() <= t.start() or m.start() >= t.end() for t in taken)
                if free and kind.score + (kind.bonus if context.search(before) or context.search(after) else 0) >= pii.THRESHOLD:
                    expected.append((kind.name, m[0]))
            assert [s for s in got[k] if s[0] == kind.name] == expected, text
