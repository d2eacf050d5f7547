"""Documents with every odd case, and the driver's small tables."""

from __future__ import annotations

from collections import Counter

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Names that operators use inside; as columns of the input they must do no harm.
CLASHING = ["id", "key", "token", "bucket", "slot", "shard", "score", "component", "component_id", "n_tokens", "start", "packed", "train", "rank", "ids"]
LONG = " ".join(f"word{k % 997} it's {k} x" for k in range(60_000))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "src1"),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "src1"),
    (3, "THE Quick brown fox jumps over\tthe lazy dog and runs away", "en", "src2"),
    (4, None, "en", "src1"),
    (5, "", None, None),
    (6, " \t\n \x0b\x0c ", "de", "src3"),
    (7, "naïve Übergröße — été 東京タワー 한국어 \U0001f600\U0001f468‍\U0001f469 ß", "de", "src3"),
    (8, LONG, "en", "src1"),
    (9, "short one", "fr", "src9"),
    (9, "short one", "fr", "src9"),
    (10, "12345 !!! ... '' 'll I'll they've   x\r\n\r\n y", "fr", None),
    (11, "<|endoftext|> <|startoftext|> <unk> \x00\x01 a\x01b", "es", "web"),
    (None, "a row without an id has text like others do", "en", "src1"),
    (-7, "▁▁ marks ▁ inside▁words", "en", ""),
]


def frame(spark, rows):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), *(["x"] * len(CLASHING))) for i, t, lang, source in rows], schema)


def rows_by(rows) -> Counter:
    return Counter(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in rows)
