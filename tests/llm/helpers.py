"""Small inputs with every edge case, and brute-force versions shared by the tests."""

import re

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def edge_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and extra columns with names the operators use inside."""
    long = " ".join(f"w{i % 977} of{i % 13}" for i in range(30_000))
    rows = [
        (1, "the cat sat on the mat with the MIT License", "en", "a", 10),
        (1, "the cat sat on the mat with the MIT License", "en", "a", 10),  # a repeated row
        (1, "another text under the same id", "en", "a", 10),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \t\n\x0b\x0c\r ", "de", "b", 7),
        (None, "a row without an id", "en", "c", 1),
        (None, None, None, None, None),
        (5, long, "en", "a", len(long)),
        (6, long, "de", "b", len(long)),
        (7, "x", "fr", "b", 1),
        (8, "Ünïcödé ÄÖ 日本語 words é", "de", "b", 5),
        (-9, "x", None, "b", 1),
        (20, "123 456 !!", "es", "b", 1),
    ]
    names = ["digest", "part", "_text", "key", "set", "n", "label", "shard_", "_group", "_size", "id", "cls", "_digest", "_kept"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows], schema)


def all_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
