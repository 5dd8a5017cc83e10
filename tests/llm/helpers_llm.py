"""Small documents that hold every awkward case at once."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, size int, shard string, `_size` int, `a b` int"


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(words))


def documents(spark, rows):
    """Rows (doc_id, text, lang, source) with extra columns whose names clash with the operators' own."""
    full = [(d, t, lang, s, None if t is None else len(t), "x", 1, "y", 2, 3) for d, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(seed: int = 7):
    """Clean texts, copies, near copies, nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(seed)
    rows = [(i, sentence(rng, rng.randint(30, 120)), "en", f"s{i % 3}") for i in range(40)]
    base = rows[0][1].split()
    for i in range(40, 52):
        near = list(base)
        near[rng.randrange(len(near))] = f"w{i}"
        rows.append((i, " ".join(near), "en", "s0"))
    rows += [(i, rows[1][1], "en", "s1") for i in range(52, 60)]
    rows += [
        (60, None, None, None), (61, "", "en", "s1"), (62, "  \n\t ", "en", None), (63, "one two", "de", "s2"), (64, "one two", "de", "s2"),
        (None, "null id " + sentence(rng, 40), "en", "s0"), (None, None, None, None), (65, rows[2][1], "en", "s0"), (65, rows[2][1], "en", "s0"),
        (66, " ".join(sentence(rng, 50) for _ in range(400)), "fr", "s2"), (67, "x" * 300_000, "fr", "s2"), (68, "Ünïcödé ñandú ß " * 9, "es", "s1"),
        (63, "same id, other text " + sentence(rng, 20), "de", "s2"),
    ]
    return rows
