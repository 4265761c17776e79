"""Documents with every odd case, and columns whose names operators use inside."""

from __future__ import annotations

import random

EXTRA = ("id", "key", "h", "n", "kept", "size", "target", "copies", "shard", "fail_bits", "n_words", "tk", "class", "text_b", "__known", "__key", "rep")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edited(text, every, seed=1):
    w = text.split(" ")
    for i in range(every, len(w), every):
        w[i] = f"edit{seed}x{i}"
    return " ".join(w)


A, B = prose(1, 200), prose(2, 80)
ITEM = prose(3, 20)
LONG = prose(4, 30_000, 5_000)

ROWS = [
    (1, A, "a"), (1, A, "a"), (2, A.upper().replace("W", "w"), "a"), (3, edited(A, 90), "b"), (4, edited(A, 4), "b"),
    (5, None, "b"), (6, "", None), (7, " \t\n ", None), (8, "three short words", "a"), (9, "Three short WORDS", "c"),
    (None, B, "c"), (None, None, "c"), (10, B + " tail", None), (11, LONG, "a"), (12, edited(LONG, 100), "a"),
    (13, "x " * 300, "b"), (14, "line one here\n" * 40 + B, "b"), (15, prose(5, 60) + " " + ITEM + " " + prose(6, 60), "c"),
    (16, prose(5, 30) + " " + edited(ITEM, 6) + " " + prose(7, 30), "c"), (17, ITEM, "a"),
    (18, prose(8, 60) + " ### $$$ %%% " * 20, "a"), (19, prose(9, 70).upper(), "a"), (19, prose(10, 70), "a"),
]


def table(spark, rows=ROWS):
    plain = [(i, t, "en", s, len(t or ""), *range(len(EXTRA))) for i, t, s in rows]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in EXTRA)
    return spark.createDataFrame(plain, kinds)
