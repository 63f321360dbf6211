"""Rows for the tests of the corpus operators."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, digest string, label int, key long, doc long, n int"


def prose(seed: int, words: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(("ba", "ke", "li", "mo", "nu", "sté", "tor")) for _ in range(r.randint(1, 4))) for _ in range(words))


def awkward_rows() -> list[tuple]:
    """Nulls in any column, empty, short and very long texts, copies, near copies, repeated rows and ids, clashing columns."""
    base = prose(1, 120)
    texts = [(1, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, " \t\n\x0b "), (7, "one"), (7, "one"), (8, "One two three"),
             (None, base), (None, None), (9, prose(2, 30_000)), (10, prose(3, 60)), (11, prose(3, 60).upper()), (12, prose(4, 200) + "\n" + prose(1, 120)),
             (13, "x" * 5000), (14, "ab " * 400), (15, prose(5, 90)), (15, prose(6, 90)), (16, "### $$$ |||" * 30), (17, " nbsp em " + prose(7, 40))]
    return [(i, t, ["en", "de", None][k % 3], ["s1", "s2", "s3", None][k % 4], len(t or ""), k, k, "x", 1, 0, -1, 5) for k, (i, t) in enumerate(texts)]
