import hashlib
import random
import re

from helpers_llm import sentence
from pyspark.sql import functions as F

from panelyard.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, tokens int, window string"
NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "<\\s>", "<\\\\|im_end|>", "a<<SYS>>b<</SYS>>", "<<s>", "\\<s>\\", "<", "$1\\$2", "<|im_end|", "line\nbreaks\n", "ünï ñ 😀", ""]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "w") for r in rows], SCHEMA)


def awkward():
    rng = random.Random(9)
    rows = [(1, k, ("user", "assistant")[k % 2], text) for k, text in enumerate(NASTY)]
    rows += [(2, 0, "system", "be kind " * 20)] + [(2, k, ("assistant", "user")[k % 2], sentence(rng, rng.randint(1, 120))) for k in range(1, 60)]
    rows += [(3, 0, "system", "alone"), (4, 0, "user", sentence(rng, 3000)), (4, 1, "assistant", sentence(rng, 900)), (4, 2, "user", "thanks")]
    rows += [(5, 0, None, None), (5, None, "assistant", "first"), (5, 7, "to ol\n+%", "x"), (None, 0, "user", "null conversation"), (None, 1, "assistant", None)]
    rows += [(6, 1, "assistant", "twice"), (6, 1, "assistant", "twice"), (6, 1, "assistant", "other"), (6, 3, "system", "late system")]
    rows += [(7, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(700)]
    rng.shuffle(rows)
    return rows


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [(r, t) for _, _, r, t in sorted(turns, key=lambda x: x[:3])] for conv, turns in by.items()}


def tokens(text):
    return len(re.findall(r"[^\W_]+|[^\s\w]|_", text)) + C.TURN_OVERHEAD


def pieces(window):
    """(role, text) of every turn of a window."""
    return [tuple(p.split("\n", 1)) for p in window.text.removesuffix(C.CLOSE)[len(C.OPEN) :].split(C.CLOSE + C.OPEN)] if window.text else []


def test_escapes_are_reversible(spark):
    alphabet = ["<", "[", "\\", "s>", "/s>", "INST]", "<|im_end|>", "<s>", "<SYS>>", "|im_start|>", "x"]
    rng = random.Random(1)
    texts = NASTY + ["".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", C.escaped(F.col("t"))).withColumn("back", C.unescaped(F.col("e")))
    for r in df.collect():
        assert r.back == r.t
        assert not any(mark in r.e for mark in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>"))


def test_digests_equal_the_conversations(spark):
    rows = awkward()
    want = expected(rows)
    for budget in (C.Budget(), C.Budget(window=200, history=60, least=40)):
        windows = C.format_windows(conversations(spark, rows), budget)
        got = {r.conv_id: r for r in C.digests(windows).collect()}
        assert set(got) == set(want)
        for conv, turns in want.items():
            r = got[conv]
            if conv != 6:  # equal turn numbers and roles leave the order to a hash
                assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
                learned = "".join(b for a, b in turns if a == "assistant")
                assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
            assert r.n_turns == len(turns) and r.loss_chars == sum(len(b) for a, b in turns if a == "assistant")


def test_windows_hold_system_history_and_new_turns_within_the_budget(spark):
    rows = awkward()
    budget = C.Budget(window=200, history=60, least=40)
    windows = C.format_windows(conversations(spark, rows), budget).collect()
    assert sum(w.turns for w in windows) == len(rows)
    first = {2: tokens("be kind " * 20), 3: tokens("alone")}
    for w in windows:
        assert w.text.count("<|im_start|>") == w.text.count("<|im_end|>") == w.context + w.turns
        system = first.get(w.conv_id, 0)
        fresh = [t for t in pieces(w)[w.context :]]
        assert w.over_budget == (w.tokens > 200)
        # only one turn that does not fit beside the system turn exceeds the budget
        assert not w.over_budget or (len([t for t in fresh if t[0] != "system"]) == 1 and w.tokens == max(tokens(t) for _, t in fresh if _ != "system") + (system if len(pieces(w)) > 1 else 0) > 200)
        for span in w.loss:
            head = w.text[: span.start].rsplit("<|im_start|>", 1)[1]
            assert head == "assistant\n" and w.text[span.start + span.length :].startswith("<|im_end|>\n")
    second = [w for w in windows if w.conv_id == 2]
    assert len(second) > 3 and all(w.text.startswith("<|im_start|>system\nbe kind") for w in second)
    assert sum(w.context > 1 for w in second) >= 2


def test_order_of_equal_turns_is_fixed_and_an_empty_table_is_empty(spark):
    rows = awkward()
    one = {r.conv_id: r.turns_sha256 for r in C.digests(C.format_windows(conversations(spark, rows))).collect()}
    two = {r.conv_id: r.turns_sha256 for r in C.digests(C.format_windows(conversations(spark, rows[::-1]).repartition(5))).collect()}
    assert one == two
    assert C.digests(C.format_windows(conversations(spark, []))).count() == 0


def test_history_and_long_system_turns_stay_within_the_budget(spark):
    word = lambda n: "w " * (n - C.TURN_OVERHEAD)
    rows = [(1, k, "user", word(127)) for k in range(2)] + [(1, 2, "assistant", word(904)), (1, 3, "user", word(50))]
    rows += [(2, 0, "system", word(904))] + [(2, k, ("user", "assistant")[k % 2], word(25)) for k in range(1, 60)]
    rows += [(3, 0, "system", word(1100)), (3, 1, "user", word(10)), (3, 2, "assistant", word(10))]
    windows = C.format_windows(conversations(spark, rows)).collect()
    assert sum(w.turns for w in windows) == len(rows)
    assert all(w.tokens <= 1024 for w in windows if w.conv_id != 3) and all(w.over_budget for w in windows if w.conv_id == 3)
    # what the system turn and the new turns leave is filled with history
    assert sum(w.context > 1 for w in windows if w.conv_id == 2) > 5
    twice = C.format_windows(conversations(spark, rows), count=lambda c: C.token_estimate(c) * 2).collect()
    assert sum(w.turns for w in twice) == len(rows) and len(twice) > len(windows)
