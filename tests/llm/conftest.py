import public_tokenizers
import pytest

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

#: Texts that tokenizers, scanners and splitters trip over.
ODD_TEXTS = (
    None, "", " ", "\n", "a", "Hello wörld, it's 2024!", "<|endoftext|>", "x<|startoftext|>y <|end", "İΣ ΣΑΣ straße ﬁ", "é é",
    "aaaa" * 300, "don't've 'll''s", "日本語 텍스트 🙂🙂 a‍b", "\x1c\x1d a\x1fb \x85 \xa0 　c", "tab\tand\r\nbreaks\x0b\x0c", "ꟋᲉ\U00010d50 x", "###$$$ !!!! </w> a</w>b",
    " ".join(f"word{i}" for i in range(5000)), "z" * 30_000,
)


@pytest.fixture(scope="session")
def vocabulary():
    return VOCABULARY


def documents(spark, texts, **more):
    """Rows with ids from 0, as the table has them; further columns have clashing names."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as length", "1 as pos", "2 as id", "3 as first", "4 as rank", "5 as key", "6 as node", "7 as n")
