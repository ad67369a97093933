"""Small inputs that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

#: Names that the operators use inside.
CLASHING = ["key", "mark", "id", "cls", "n", "kind", "blob", "_key", "_text", "_mark", "h", "part", "row", "text_", "_both", "_url", "keys", "hits"]


def odd_rows() -> list[tuple[int | None, str | None]]:
    rnd = random.Random(7)
    words = [f"wort{i}" for i in range(60)]
    plain = " ".join(rnd.choices(words, k=40))
    return [
        (1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, plain), (6, plain), (6, plain), (None, plain), (None, None),
        (7, "Ünï¢ödé ß ΣΑΣ 日本語 😀 " * 30), (8, "x" * 5000), (9, " ".join(rnd.choices(words, k=4000))),
        (10, "don't we'll <|endoftext|> I'VE 12345"), (11, "a\x00b\x1c\x85 c"), (-3, plain.upper()), (12, "aa " * 400),
    ]


def prose(n: int, seed: int = 1, copies: float = 0.3) -> list[tuple[int, str]]:
    """Texts with exact and near copies and shared passages."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passages = [" ".join(rnd.choices(words, k=k)) for k in (15, 25, 40, 80)]
    rows: list[tuple[int, str]] = []
    for i in range(n):
        text = rnd.choices(words, k=rnd.choice([3, 6, 20, 60, 120]))
        if rows and rnd.random() < copies:
            text = rnd.choice(rows)[1].split()
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                text[rnd.randrange(len(text))] = rnd.choice(words)
        if rnd.random() < 0.2:
            p = rnd.choice(passages)
            cut = rnd.randrange(len(text) + 1)
            text = [*text[:cut], *p[rnd.randrange(len(p) // 2) :].split(), *text[cut:]]
        rows.append((i, " ".join(text)))
    rnd.shuffle(rows)
    return rows


def frame(spark, rows, schema="doc_id long, text string", clash: bool = True):
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", *[f"'c' AS `{c}`" for c in CLASHING if c not in df.columns]) if clash else df


def got(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
