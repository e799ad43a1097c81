"""Small fixtures and a brute-force view of documents."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Rows (doc_id, text, lang, source) as documents."""
    return spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], DOCS)


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    syllables = "ka lo mi ru ta ne so vi pe du".split()
    lexicon = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    return " ".join(rng.choice(lexicon) for _ in range(n))


#: Nulls, nothing, white space, code points beyond the BMP, ties and one long text.
ODD = [(1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n ", "en", None), (4, "one", "en", "b"), (5, "naïve 🙂 日本語 x", None, None), (6, "same text here now again", "en", "a"), (7, "same text here now again", "en", "b"), (7, "same text here now again", "en", "b"), (None, "no id at all but some words", "en", "b")]
