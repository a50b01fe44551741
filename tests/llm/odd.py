"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows and ids, extra columns."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _doc string, _tag string, name string, "
          "score string, n string, piece string, key string, cls string, label string")


def words(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 7))) for _ in range(n)]


def texts() -> list[tuple[int | None, str | None]]:
    base = words(120, 1)
    near = [*base[:60], "changed", *base[61:]]
    far = [*base[:30], *words(90, 2)]
    passage = " ".join(words(40, 3))
    rows: list[tuple[int | None, str | None]] = [
        (5, " ".join(base)), (3, " ".join(near)), (9, " ".join(far)), (11, " ".join(base)), (12, "\t".join(base)),
        (13, " ".join(base).upper()), (20, None), (21, ""), (22, "   \n\t "), (23, "a"), (24, "A b c"), (25, "a b c"),
        (26, "a b c d e"), (27, "é" * 400), (28, "é" * 99 + "x"), (30, "one " + passage + " two"), (31, "three\n" + passage + "\nfour"),
        (40, " ".join(words(9000, 4))), (41, " ".join(words(9000, 4)[:-1] + ["end"])), (42, "ab" * 3000), (43, "b" + "ab" * 2999),
        (50, "same row here"), (50, "same row here"), (50, "other text of this id"), (None, "no id, once"), (None, "no id, twice"),
        (None, "no id, twice"), (None, None), (None, " ".join(base)), (60, "x y   z\u0085 <|endoftext|> w  v \U0001f600"),
        (61, "Licensed under the Apache License, Version 2.0"), (-7, "negative. Really! " * 40),
    ]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame(
        [(i, t, None if k % 5 == 0 else ("en", "de")[k % 2], None if k % 7 == 0 else f"src{k % 6}", None, *["x"] * 9)
         for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)
