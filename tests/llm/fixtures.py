"""Small tables that hold every odd case: nulls in any column, empty and very long texts,
ties, repeated rows, and extra columns whose names operators use themselves."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, th string, size int, "
          "`_row` string, language string, h double, `key` string")
WORDS = [a + b for a in "ba be bi bo da de di do ga ge gi go".split() for b in "l m n r s t".split()]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    passage = sentence(rng, 60)
    lines = [sentence(rng, 6) for _ in range(5)]
    base = sentence(rng, 80)
    near = base.split()
    near[40] = "changed"
    texts = [None, "", "   ", "\n\n", ".", "a", "a b c", base, base, " ".join(near), "x " * 3000 + base,
             f"{sentence(rng, 9)}\n{passage}\n{sentence(rng, 7)}", f"{sentence(rng, 8)}\n{passage}",
             "\n".join([sentence(rng, 5), *lines, sentence(rng, 5)]), "\n".join([*lines[:4], "end"]),
             "\n".join(lines[:2]), "ééé ñññ 日本語 \U0001f600 " * 30, "aaaa" * 200, "\t\x0b\x0c\r mixed \r\n space",
             sentence(rng, 30_000), passage, "<|endoftext|> it's ▁ two  spaces"]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "s0", ""][i % 5], None if i % 4 else 1,
                     -i, "clash", 7, "r", "l", 0.5, None))
    rows.append(rows[7])           # a repeated row
    rows.append(rows[0])
    rows.append((None, base, None, None, None, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None, None, None, None))
    return rows


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
