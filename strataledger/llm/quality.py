"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame

from strataledger.llm import ftrl

DIM = 1 << 20
MAX_LABELLED = 4_000

_WORDS = re.compile(r"\w+|[^\w\s]+")
_AGAIN = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


@cache
def _hashes() -> ftrl.Hashes:
    return ftrl.Hashes()


def features(text: str) -> ftrl.Features:
    """Hashed word uni- and bigrams by their share of the text's, the whole of unit length.

    Words are runs of letters and digits, and runs of other marks; a word that repeats the one before is hashed as
    such, whatever it is, so that stutter is learnt as one word.
    """
    words = _WORDS.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32)
    known = _hashes()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    again = h[1:] == h[:-1]
    h[1:][again] = np.uint64(_AGAIN)
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * _MIX) ^ (h[1:] >> np.uint64(7)) ^ h[1:]
    index, n = ftrl.counted(np.concatenate([h, pairs]) % np.uint64(DIM))
    return index, n / np.float32(np.sqrt(float(n @ n)))


def _with_none(text: str) -> tuple[ftrl.Features, None]:
    return features(text), None


def train_quality(docs: DataFrame, labels: DataFrame, allowed: Column, max_labelled: int = MAX_LABELLED, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> ftrl.Linear:
    """A model fitted on at most max_labelled labelled documents for which allowed (on labels' doc_id) holds; it sees the text only."""
    sample = ftrl.labelled_sample(labels, label, allowed, max_labelled, doc_id)
    rows, _, y = ftrl.collect_examples(docs, sample, _with_none, doc_id, text)
    return ftrl.train(rows, y, DIM, alpha=1.0, l1=0.1, l2=0.01, epochs=5, balanced=False)


def score_quality(docs: DataFrame, model: ftrl.Linear, text: str = "text") -> DataFrame:
    """docs packed as (row, score): 0 to 1, higher where the whole text is likelier of good quality.

    Null and empty texts get the score of a text without words. Repeated rows score alike; other columns stay inside
    ``row`` and cannot clash; empty tables give no rows; without usable labels every score is 0.5.
    """
    return ftrl.scored(docs, model, features, text)
