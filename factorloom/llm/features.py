"""Numbers that describe a whole text, for quality models. No label, language, source or id goes in."""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batches_of, few_rows

NAMES = [
    "log_words", "word_bytes", "upper", "digits", "symbols", "stops", "other_punctuation", "non_ascii",
    "words_a_line", "repeated_lines", "distinct_words", "same_word_twice", "top_word", "two_apart",
]

UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
SYMBOLS, STOPS = b"#*$%&|<>", b".!?"
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in SYMBOLS + STOPS)
HIGH = bytes(range(128, 256))


def describe(text: str | None) -> list[float]:
    """Null and white-space texts give zeros."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    size = len(raw)
    share = lambda kinds: (size - len(raw.translate(None, kinds))) / size
    lines = [line for line in raw.split(b"\n") if not line.isspace() and line]
    distinct = set(words)
    counts = {w: 0 for w in distinct}
    for w in words:
        counts[w] += 1
    return [
        math.log(n), sum(map(len, words)) / n, share(UPPER), share(DIGITS), share(SYMBOLS), share(STOPS), share(PUNCTUATION), share(HIGH),
        n / len(lines), 1 - len(set(lines)) / len(lines), len(distinct) / n, sum(map(eq, words, words[1:])) / n, max(counts.values()) / n, sum(map(eq, words, words[2:])) / n,
    ]


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row its key and `x`, the numbers of NAMES. One pass over the texts, no shuffle."""
    schema = T.StructType([docs.schema[key], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for ids, texts in batches_of([batch], [key, text]):
                flat = np.array([describe(t) for t in texts], dtype=np.float64)
                starts = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(NAMES))
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(key).type), pa.ListArray.from_arrays(starts, pa.array(flat.ravel()))], names=[key, "x"])

    return docs.select(key, text).transform(few_rows).mapInArrow(run, schema)
