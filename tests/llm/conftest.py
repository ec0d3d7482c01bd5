import pytest

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "one",
    "One two THREE four five six seven eight nine ten eleven",
    "a  b \n c\n \nfoo\t\tbar ",
    "<|endoftext|> and <|endoftext|>\n <|endoftext|>x",
    "naïve café 中文字 日本語 😀 é ½ ² Ⅳ   x \x1c y \x00 z",
    "don't we'll I'M ''s 's",
    "aaaa " * 3000,
    "x" * 20000,
    "▁ ▁▁a <0x41> <s> </s>",
    "=" * 700 + "՘౜",
]

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, n_tokens string, ids int, part int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, long texts, repeated rows, a null id, and columns whose names clash with results."""
    rows = [(i, t, None if i % 3 == 0 else "en", "s", None, 7, "x", 1, 1) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[6], (None, "no id at all but some words in here that are enough for ten", "de", None, 1, 1, "", 2, 2)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def texts_by_id(df):
    """Rows of (doc_id, text), null text as empty."""
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def same_rows(found, wanted):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, wanted), key=key)
