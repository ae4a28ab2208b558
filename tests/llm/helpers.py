import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int, rid int"


def documents(spark, texts, source=lambda i: f"s{i % 3}"):
    """Documents with extra columns whose names also occur inside the operators."""
    rows = [(i, t, "en", source(i), len(t or ""), "x", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \t\n", "a", "a b", "A  B", "x " * 30_000, "Ünï çødé…  \x0b words\r\nnext", "same text here again", "same text here again"]


def bucket(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod
