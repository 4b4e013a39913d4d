import random

import public_tokenizers
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return; as columns of the input they must do no harm.
CLASHING = (
    "id, rest, anchor, at, found, marks, mask, windows, salts, slot, h1, h2, batch, dropped, print, bands, key, a, b,"
    " n_words, n_removed, kept_text, n_lines, n_dropped, n_bytes, n_tokens, over_limit, ids, decoded, kept, class_id,"
    " keep_id, group_size, best, whole, salt, p_toxic, rejected, doc, row, fold, features, fail_bits, words, bits"
).split(", ")


def sentence(rng, n):
    return " ".join(rng.choice("abcdefgh") + rng.choice("xyz") * rng.randint(0, 2) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and long texts, copies, repeated rows and ties."""
    rng = random.Random(7)
    base = sentence(rng, 60)
    long = sentence(rng, 40_000)
    texts = [
        None, "", " \t\r\n", "word", base, base, base + " tail", base.replace("a", "á", 1), long, long + " end",
        "x" * 300_000, "a b\n\nTitle Of Line\nc", "  title of line\t\nd", "<|endoftext|> ▁ \x00 日本語 ﬁ",
        " ".join(["echo"] * 200), "stupid idiot scum " * 9,
    ]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(4, base, "en", "s0", 1), (4, base, "en", "s0", 1), (4, "another text of this id", None, None, None)]
    rows += [(None, base, "en", None, None), (None, None, None, None, None), (None, "loner of no number " * 8, "de", "s1", 2)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def byte_bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def piece_bpe():
    return public_tokenizers.path("piece_bpe_32k.model")
