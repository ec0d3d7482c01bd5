"""Token counters: words, or the ids of a public tokenizer's file. A counter is called with a text; `many` counts a list at once.

A counter travels to the workers as a path; the model is read once in each worker process. The file must be
readable there under the same path."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

Counter = Callable[[str], int]


class Words:
    """What stands between white space."""

    def __call__(self, text: str) -> int:
        return len(text.split())

    def many(self, texts: Sequence[str]) -> list[int]:
        return [len(t.split()) for t in texts]


@cache
def _model(path: str):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


class Subwords:
    """Ids without any that mark begin or end: a .json file of the tokenizers library, or a .model file of sentencepiece."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: str) -> int:
        return self.many([text])[0]

    def many(self, texts: Sequence[str]) -> list[int]:
        model = _model(self.path)
        if self.path.endswith(".json"):
            return [len(e.ids) for e in model.encode_batch_fast(list(texts), add_special_tokens=False)]
        return list(map(len, model.encode(list(texts))))


def counted(counter: Counter, texts: Sequence[str]) -> list[int]:
    """The tokens of each text, at once if the counter can."""
    many = getattr(counter, "many", None)
    return list(many(texts)) if many else list(map(counter, texts))


def column(counter: Counter) -> Callable[[Column], Column]:
    """The counter as a column function; a null text has no tokens."""

    @pandas_udf("int")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(counted(counter, texts.fillna("").tolist()), dtype="int32")

    return tokens
