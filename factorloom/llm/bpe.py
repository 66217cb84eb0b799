"""BPE encoding and decoding.

Encoding is by backtracking, not by replaying merges: an Aho-Corasick automaton over the vocabulary gives the longest
token at each place of a word; the encoder pushes it if it is compatible with the token before, else tries the next
shorter token there, else takes back the token before. A place that was given up is never tried again, so a word takes
linear time. Two tokens are compatible if byte-pair merging of their joined text leaves the border between them alone,
and a sequence is what merging gives exactly if all its neighbours are compatible.

Decoding reads each id's text out of one string by a table of offsets.

Cases: null and empty texts give no ids and the empty text. The strings of special tokens in a text become their ids, as
the tokenizers library does by default. Extra columns of the input are kept; `ids` and `decoded` of the input are replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few_rows, others

#: Words kept with their encoding by each Python worker.
CACHED_WORDS = 500_000


def byte_characters() -> list[str]:
    """Byte-level BPE's printable stand-in for each byte: itself where printable in Latin-1, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A BPE vocabulary with an end-of-word mark, loaded from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] is not None:
            raise ValueError("a BPE vocabulary with an end-of-word mark and no decoder is expected")
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        # The same pattern for texts of ASCII and Latin letters, without property tables.
        letters, numbers = r"A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
        self.latin = re.compile(r"[\x09-\x0d\x20-\x7e\u00a1-\u024f]*").fullmatch
        self.latin_pieces = re.compile(pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers)).findall
        mark = model["end_of_word_suffix"]

        # A word is a string of symbols: one for each byte, and another for each byte that ends a word.
        characters = byte_characters()
        self.inner = {c: chr(i) for i, c in enumerate(characters)}
        self.final = {c: chr(256 + i) for i, c in enumerate(characters)}

        def symbols(token: str) -> str:
            body, last = (token[: -len(mark)], True) if token.endswith(mark) and token != mark else (token, False)
            return "".join(self.inner[c] for c in body[:-1]) + (self.final if last else self.inner)[body[-1]]

        vocab = {t: i for t, i in model["vocab"].items() if t not in self.specials}
        by_symbols = {}
        for token, i in vocab.items():
            by_symbols[symbols(token)] = i
        self.symbols_of = {i: s for s, i in by_symbols.items()}
        self.length = {i: len(s) for i, s in self.symbols_of.items()}

        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank = {i: -1 for i, s in self.symbols_of.items() if len(s) == 1}
        for at, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            pair_ids = vocab[a], vocab[b]
            self.merged[pair_ids] = at
            made = vocab[a + b]
            if made not in self.parts and made not in self.rank:
                self.parts[made], self.rank[made] = pair_ids, at
        if any(max(self.rank[a], self.rank[b]) >= self.rank[i] for i, (a, b) in self.parts.items()):
            raise ValueError("a merge comes before the merges that make its parts")

        self.automaton = ahocorasick.Automaton()
        for s, i in by_symbols.items():
            if i in self.rank:
                self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for s, i in by_symbols.items():
            if i in self.rank and len(s) > 1:
                self.shorter[i] = next(t for k in range(len(s) - 1, 0, -1) if (t := by_symbols.get(s[:k])) in self.rank)
        self.compatible_pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[bytes, int]] = {}

        # Decoding: texts end to end, and where each starts.
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.specials.items()}
        texts = [names.get(i, "") for i in range(max(names) + 1)]
        self.all_text = "".join(texts)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).tolist()

    def border_holds(self, left: int, right: int) -> bool:
        """Whether merging never joins across the border of left and right.

        At each rank the pieces that touch at the border are known: the outermost parts of left and right made so far.
        """
        edges_left, edges_right = [left], [right]
        while edges_left[-1] in self.parts:
            edges_left.append(self.parts[edges_left[-1]][1])
        while edges_right[-1] in self.parts:
            edges_right.append(self.parts[edges_right[-1]][0])
        i, j, never = len(edges_left) - 1, len(edges_right) - 1, len(self.merged)
        while True:
            next_left = self.rank[edges_left[i - 1]] if i else never
            next_right = self.rank[edges_right[j - 1]] if j else never
            across = self.merged.get((edges_left[i], edges_right[j]), never + 1)
            # Of equal merges the one further left comes first.
            if across < next_left and across <= next_right:
                return False
            if not i and not j:
                return True
            if next_left <= next_right:
                i -= 1
            if next_right <= next_left:
                j -= 1

    def compatible(self, left: int, right: int) -> bool:
        held = self.compatible_pairs.get((left, right))
        if held is None:
            if len(self.compatible_pairs) >= 1_000_000:
                self.compatible_pairs.clear()
            held = self.compatible_pairs[left, right] = self.border_holds(left, right)
        return held

    def encode_symbols(self, word: str) -> list[int]:
        n = len(word)
        longest: list[int] = [0] * n
        for end, (size, token) in self.automaton.iter(word):
            longest[end - size + 1] = token  # a later match from the same start is longer
        given_up = bytearray(n + 1)
        chosen: list[int] = []
        length, shorter, pairs = self.length, self.shorter, self.compatible_pairs
        at, token, last = 0, longest[0], None
        while True:
            end = at + length[token]
            if not given_up[end]:
                held = last is None or pairs.get((last, token))
                if held is None:
                    held = self.compatible(last, token)
                if held:
                    chosen.append(token)
                    if end == n:
                        return chosen
                    at, last, token = end, token, longest[end]
                    continue
            while (token := shorter.get(token)) is None:
                given_up[at] = 1
                token = chosen.pop()
                last = chosen[-1] if chosen else None
                at -= length[token]

    def encode_word(self, piece: str) -> bytes:
        """Ids of a piece of the split text as little-endian 32-bit integers."""
        raw = piece.encode()
        word = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        return array("i", self.encode_symbols(word)).tobytes()

    def normalise(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Each character is lower-cased by itself: no final sigma. White space is left, as no piece holds any.
        return text.replace("Σ", "σ").lower()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        out = []
        parts = self.special_split.split(text) if self.special_split and "<|" in text else [text]
        words = self.words
        for part in parts:
            if part in self.specials:
                out.append(np.array([self.specials[part]], dtype="<i4").tobytes())
                continue
            plain = self.normalise(part)
            for piece in self.latin_pieces(plain) if self.latin(plain) else self.pieces(plain):
                ids = words.get(piece)
                if ids is None:
                    if len(words) >= CACHED_WORDS:
                        words.clear()
                    ids = words[piece] = self.encode_word(piece)
                out.append(ids)
        return b"".join(out)

    def decode(self, ids) -> str:
        text, offsets = self.all_text, self.offsets
        return " ".join([text[offsets[i] : offsets[i + 1]] for i in ids])


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """docs with `ids` (array of int) and `decoded`, the text that decoding the ids gives. One pass, no shuffle."""
    kept = others(docs, "ids", "decoded")
    if len({c.lower() for c in kept}) != len(kept):
        raise ValueError("columns whose names differ in case only")
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches):
        bpe = load(vocabulary)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                ids = [np.frombuffer(bpe.encode(t), dtype="<i4") for t in part.column(at).to_pylist()]
                starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
                texts = pa.array([bpe.decode(x.tolist()) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(starts), values), texts], names=[*kept, "ids", "decoded"])

    return docs.select(*kept).transform(few_rows).mapInArrow(run, schema)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(encode(docs, vocabulary_path()))


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
