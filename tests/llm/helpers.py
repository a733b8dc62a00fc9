"""Small tables with everything that operators must stand: nulls, empty and long
texts, ties and repeated rows, and further columns of clashing names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, sha string, size long, mix long, uid long, component string, bin int, _k int, _page string, _text long, _i int, _m string, _stays int, c1 string, _block string, maybe int"


def rows():
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    texts = [
        (1, "One two three four five six seven eight nine ten eleven twelve.", "en", "b"), (2, "One two three four five six seven eight nine ten eleven twelve.", "en", "b"),
        (2, "One two three four five six seven eight nine ten eleven twelve.", "en", "b"), (3, None, "en", "a"), (4, "", None, None), (5, " \t\n", "de", "a"),
        (6, long, "en", None), (7, long + " end", "en", "c"), (None, "no id", "en", "a"), (None, None, None, None), (8, "é ß 漢字 \U0001f600 end", "fr", "é"),
        (9, "<|endoftext|> ### x </turn> \\h", "xx", "b"), (10, "a\nb\na\n\n \nb", "en", "b"), (11, "x" * 5000, "en", "a"), (12, "ONE two THREE", "en", "a"), (13, "one two three", "en", "a"),
    ]
    return [(i, t, g, s, len(t or ""), 0, "", 1, 2, 3, "", 4, 5, "", 6, 7, "", 8, "c", "", 9) for i, t, g, s in texts]


def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


def none(spark):
    return spark.createDataFrame([], DOCS)
