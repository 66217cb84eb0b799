"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams (two and three bytes of the lower-cased text, runs of non-letters as one space),
weighted by log term frequency and inverse document frequency, of length 1. Each language has several centroids, from
spherical k-means over a sample of its documents. A text gets the language of the centroid with the largest cosine; it is
marked rejected if that cosine is below what nearly all sampled documents of the centroid reach.

Document frequencies count all training documents. The sample for k-means takes `sample` expected documents a language by
a hash of the id. Texts that are null or have no letter get `und`, score 0 and are marked rejected. Ties go to the first
language by name. Models hold up to `shard` languages each, so what is broadcast is bounded. Rows without an id are
learned from. With nothing to learn from, each text gets `und`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, few_rows, remainder, table

DIMENSIONS = 4096
#: Lower-case ASCII letters and all bytes of other characters stay; the rest is white space.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LETTER = regex.compile(r"\p{L}")


def term_counts(text: str | None) -> np.ndarray | None:
    """Counts by hashed n-gram; None if there is no letter."""
    if not text or not LETTER.search(text):
        return None
    raw = b" " + b" ".join(text.lower().encode().translate(LETTERS).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    hashes = [(two * np.uint32(2654435761)) >> np.uint32(20)]
    if len(b) > 2:
        hashes.append(((two[:-1] * np.uint32(65599) + b[2:]) * np.uint32(2246822519)) >> np.uint32(20))
    return np.bincount(np.concatenate(hashes), minlength=DIMENSIONS)


def vectors(texts: list, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors by row, and which rows have a letter."""
    out, has = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), bool)
    for k, text in enumerate(texts):
        counts = term_counts(text)
        if counts is not None:
            has[k] = True
            out[k] = np.log1p(counts) * idf
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0), has


def document_frequencies(train: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Over all rows: by n-gram how many hold it, and how many rows there are. A partition sends its sums only."""

    def run(batches):
        sums, n = np.zeros(DIMENSIONS, np.int64), 0
        for (texts,) in batches_of(batches, [text]):
            for t in texts:
                counts = term_counts(t)
                if counts is not None:
                    sums += counts > 0
                    n += 1
        yield pa.RecordBatch.from_pydict({"term": np.arange(-1, DIMENSIONS), "n": np.concatenate([[n], sums])})

    rows = train.select(text).transform(few_rows).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(DIMENSIONS + 1, np.int64)
    for r in rows:
        found[r["term"] + 1] = r["n"]
    return found[1:], int(found[0])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; starts are the rows least like those chosen before."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    while len(chosen) < min(k, len(x)):
        nearest = (x @ x[chosen].T).max(1)
        if nearest.min() > 0.999:
            break
        chosen.append(int(np.argmin(nearest)))
    centres = x[chosen].copy()
    for _ in range(rounds):
        owner = (x @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (owner == c).any():
                centres[c] = x[owner == c].mean(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass
class Languages:
    names: list[str]
    of: np.ndarray  # a language's place in names, by centroid
    centres: np.ndarray
    least: np.ndarray  # the least cosine that isn't rejected, by centroid
    idf: np.ndarray

    def predict(self, texts: list) -> tuple[list, np.ndarray, np.ndarray]:
        x, has = vectors(texts, self.idf)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosines = x @ self.centres.T
        best = cosines.argmax(1)
        top = np.where(has, cosines[np.arange(len(texts)), best], 0)
        return [self.names[self.of[b]] if h else "und" for b, h in zip(best, has, strict=True)], np.clip(top, 0, 1).astype(float), ~has | (top < self.least[best])


def learn(train: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *, sample: int = 400, centroids: int = 4, shard: int = 500) -> list[Languages]:
    train = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    df, n = document_frequencies(train, "text")
    idf = np.log((1 + n) / (1 + df)) + 1
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [Languages([], np.empty(0, int), np.empty((0, DIMENSIONS)), np.empty(0), idf)]
    share = F.create_map(*[F.lit(v) for name, size in sizes.items() for v in (name, int(1_000_000 * min(1.0, sample / size)) + 1)])
    picked = train.where(F.pmod(F.xxhash64("key", "text", F.lit(9)), F.lit(1_000_000)) < share[F.col("lang")])

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        x, has = vectors(group.sort_values("key")["text"].tolist(), idf)
        x = x[has]
        if not len(x):
            return pd.DataFrame({"lang": [], "least": [], "centre": []}, dtype=object)
        centres = spherical_kmeans(x, centroids)
        cosines = x @ centres.T
        owner = cosines.argmax(1)
        least = [float(np.quantile(cosines[owner == c, c], 0.005)) * 0.9 if (owner == c).any() else 0.0 for c in range(len(centres))]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "least": least, "centre": [c.astype(float) for c in centres]})

    rows = sorted(picked.groupBy("lang").applyInPandas(cluster, "lang string, least double, centre array<double>").collect(), key=lambda r: (r["lang"], list(r["centre"])))
    names, models = sorted({r["lang"] for r in rows}), []
    for k in range(0, max(len(names), 1), shard):
        some = names[k : k + shard]
        own = [r for r in rows if r["lang"] in set(some)]
        models.append(Languages(some, np.array([some.index(r["lang"]) for r in own], int), np.array([r["centre"] for r in own], np.float32).reshape(-1, DIMENSIONS), np.array([r["least"] for r in own]), idf))
    return models


def identify(docs: DataFrame, models: list[Languages], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, rejected) of each row: the best of all models, one pass over the texts for each model."""
    rows, kind = docs.select(key, text), docs.schema[key].dataType.simpleString()
    for k, model in enumerate(models):
        rows = judged(rows, model, key, kind, text, first=k == 0)
    return rows.drop(text)


def judged(rows: DataFrame, model: Languages, key: str, kind: str, text: str, first: bool) -> DataFrame:
    """rows with what model says, or what they say already where that is at least as sure."""

    def run(batches):
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            for k in range(0, batch.num_rows, 512):
                part = slice(k, k + 512)
                names, top, rejected = model.predict(column(text)[part].to_pylist())
                if not first:
                    better = top > column("score")[part].to_numpy()
                    names = [a if b else c for a, b, c in zip(names, better, column("lang_pred")[part].to_pylist(), strict=True)]
                    rejected = np.where(better, rejected, column("rejected")[part].to_numpy(zero_copy_only=False))
                    top = np.where(better, top, column("score")[part].to_numpy())
                yield pa.RecordBatch.from_pydict({key: column(key)[part], text: column(text)[part], "lang_pred": pa.array(names, pa.string()), "score": top, "rejected": rejected})

    return rows.transform(few_rows).mapInArrow(run, f"`{key}` {kind}, `{text}` string, lang_pred string, score double, rejected boolean")


def op9_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = learn(docs.where(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
