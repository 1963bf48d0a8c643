"""Small tables of awkward rows that every operator must take."""

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))

#: doc_id, text: null, empty, blank, repeated rows, ties, very long, odd white space, marks.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog"),
    (2, "the quick  brown fox\njumps over\tthe lazy dog"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, LONG),
    (7, LONG + " tail"),
    (8, "one"),
    (8, "one"),
    (9, "Ça va ? naïve café 日本語 🙂 é"),
    (10, "a  b   c \n d e  f \x1c g's don't I'LL  "),
    (11, "The quick brown fox jumps over the lazy dog"),
    (None, "no id"),
    (12, "mail me at a.b+c@ex-ample.co.uk or 10.0.0.255, +1 (555) 123-4567; card 4111 1111 1111 1111."),
    (13, "<|endoftext|> is ordinary text <|startoftext|>"),
]


def frame(spark, rows=None):
    """A table with extra columns whose names clash with what operators return."""
    rows = ROWS if rows is None else rows
    return spark.createDataFrame(
        [(d, t, None if i % 3 else "en", "s", i, 0, 1.0, 7) for i, (d, t) in enumerate(rows)],
        "doc_id bigint, text string, lang string, source string, size int, shard int, score double, component_id int",
    )
