"""Small tables for the operators of linkfold.llm: every odd case, and random ones."""

from __future__ import annotations

import random

#: columns whose names the operators use inside; none may clash
CLASHING = ("_row", "_d", "_sha", "_text", "_key", "_h", "fp", "rep", "component", "h", "run", "data", "part", "block", "token",
            "piece_row", "rows", "lens", "slot", "size", "taken", "kept", "keep_id", "lang_pred", "score", "_mix_row", "_keep")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "lorem ipsum dolor sit amet consectetur " * 6000 + "\n" + "x" * 5000

EDGE_TEXTS = [
    None, "", " ", "\n\t ", "a", "a", "A", "!!!", "é È ß", "the same text", "the same text", "The same text", "the same  text",
    "one two three", "one two three four", "one two three four five", "日本語 のテキスト", "emoji 😀 text", "tab\tand\x0bvertical\x0c feed\r\n",
    "non-breaking space and   line separator", "special <|endoftext|> inside <|startoftext|> a text", "nul \x00 char \x1c",
    "It's we're I'll don't 'S", "İstanbul ΣΑΣ ſ", "Released under the MIT License.", "x under the mit license y UNDER THE MIT LICENSE",
    LONG, LONG, LONG + " tail",
]


def edge_rows():
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s1"][i % 4], None if t is None else len(t))
            for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[9], rows[9], (9, "another text under the same id", "en", "s1", 3), (None, "a null id", "en", "s2", 9),
             (None, "a null id", "en", "s2", 9), (None, None, None, None, None)]
    return rows


def table(spark, rows, clash: bool = True, partitions: int = 3):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING]) if clash else df


def random_rows(n: int, seed: int = 1, words: int = 40, vocabulary: int = 60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(vocabulary)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.25:
            text = rng.choice(rows)[1]
            if rng.random() < 0.6:
                parts = text.split(" ")
                parts[rng.randrange(len(parts))] = rng.choice(vocab)
                text = " ".join(parts)
        else:
            text = " ".join(rng.choices(vocab, k=rng.randint(1, words))).replace(" a", "\na")
        rows.append((i, text, "en", f"s{rng.randrange(5)}", len(text)))
    return rows


def by_rows(df):
    """Sorted rows as tuples; nulls sort first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))
