"""Hand-made tables with every awkward row, and plain versions of what operators compute."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"w{i * 7919 % 1013}" for i in range(120))


def awkward(spark, more=()):
    """Nulls in any column, empty and blank texts, a very long text, ties and repeated rows, clashing names."""
    rows = [
        (1, PROSE, "en", "a", 10), (2, PROSE, "en", "a", 10), (3, None, "en", "b", None), (4, "", None, "b", 0), (5, " \t\n ", "en", None, 3),
        (6, "one", "en", "a", 3), (7, PROSE.replace("w5 ", "w5 x "), "en", "c", 1), (None, "nameless text of some words", "en", "a", 5),
        (8, "Ünï cödé wörds\nare 漢字 too 😀 <|endoftext|> end", "xx", "b", 2), (9, "long " * 30_000 + PROSE, "en", "a", 1), *more]
    rows += [rows[0], rows[4]]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "'clash' AS row", "7 AS h", "1.5 AS score", "'x' AS part", "0 AS fp", "1 AS size")


def empty(spark):
    return spark.createDataFrame([], DOCS)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def components(items, linked):
    """item -> least item that links reach, all pairs tried."""
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    items = list(items)
    for n, a in enumerate(items):
        for b in items[n + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in items}
