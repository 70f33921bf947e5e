"""Toxicity: a linear classifier whose scores may not depend on which group a sentence names."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame

from strataledger.llm import ftrl

DIM = 1 << 20
MAX_LABELLED = 16_000
#: Lengths of word beginnings: inflected and compound insults share one.
STEMS = (4,)

#: Neutral words for groups of people, by kind and language; a swap stays within its line.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("deaf", "blind", "disabled", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
)
_WORDS = re.compile(r"\w+")


@cache
def _swaps(shift: int, terms: tuple = IDENTITY_TERMS) -> dict[str, str]:
    return {w: line[(k + 1 + shift % (len(line) - 1)) % len(line)] for line in terms for k, w in enumerate(line)}


@cache
def _hashes() -> ftrl.Hashes:
    return ftrl.Hashes()


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def _features(words: list[str]) -> ftrl.Features:
    """Which words and word beginnings a text holds: one insult counts the same in a short and a long text."""
    known = _hashes()
    distinct = set(words)
    for n in STEMS:
        distinct |= {w[:n] + "-" for w in distinct if len(w) > n and w[-1] != "-"}
    found = np.unique(np.fromiter((known[w] % DIM for w in distinct), np.uint32))
    return found, np.ones(len(found), np.float32)


def features(text: str) -> ftrl.Features:
    return _features(words_of(text))


def features_and_twin(text: str) -> tuple[ftrl.Features, ftrl.Features | None]:
    """A text's features, and those of its counterfactual: every identity term swapped for another of its line."""
    words = words_of(text)
    swaps = _swaps(len(words))
    twin = [swaps.get(w, w) for w in words]
    return _features(words), _features(twin) if twin != words else None


def with_mentions(rows: list[ftrl.Features], twins: list[ftrl.Features | None], seed: int = 0, terms: tuple = IDENTITY_TERMS) -> list[tuple[ftrl.Features, ftrl.Features]]:
    """For each row the two sentences whose scores may not differ.

    A sentence that names a group is paired with its twin. One that names none is given a neutral mention: two
    terms of one line, drawn by the seed, each added to the sentence's words.
    """
    rng = np.random.default_rng(seed)
    of_term = {w: _features([w])[0] for line in terms for w in line}

    def named(x: ftrl.Features, term: str) -> ftrl.Features:
        found = np.union1d(x[0], of_term[term]).astype(np.uint32)
        return found, np.ones(len(found), np.float32)

    out = []
    for x, twin in zip(rows, twins, strict=True):
        line = terms[rng.integers(len(terms))]
        one, other = rng.permutation(len(line))[:2]
        out.append((x, twin) if twin is not None else (named(x, line[one]), named(x, line[other])))
    return out


def train_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column, max_labelled: int = MAX_LABELLED, invariance: float = 4.0, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> ftrl.Linear:
    """A model fitted on at most max_labelled labelled documents for which allowed (on labels' doc_id) holds.

    It sees the words of the text only. Every labelled sentence is paired with its counterfactual (see with_mentions),
    and the difference in score of the two is penalised by invariance. Repeated ids count as one row.
    """
    sample = ftrl.labelled_sample(labels, label, allowed, max_labelled, doc_id)
    rows, twins, y = ftrl.collect_examples(docs, sample, features_and_twin, doc_id, text)
    return ftrl.train(rows, y, DIM, with_mentions(rows, twins), invariance, alpha=1.0, l1=9.0, l2=0.05, epochs=10)


def score_toxicity(docs: DataFrame, model: ftrl.Linear, text: str = "text") -> DataFrame:
    """docs packed as (row, score): 0 to 1, higher where the whole text is likelier toxic.

    Null and empty texts get the score of a text without words. Repeated rows score alike; other columns stay inside
    ``row`` and cannot clash; empty tables give no rows; without usable labels every score is 0.5.
    """
    return ftrl.scored(docs, model, features, text)
