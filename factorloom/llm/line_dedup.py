"""Line deduplication by a log-template tree.

Lines are parsed down a tree of fixed depth: by their number of tokens, then by their leading tokens; tokens with digits
are variable and stand as `<*>`. The distinct lines of a leaf are grouped into templates: a line joins the most similar
template of the leaf (the share of equal tokens, place by place) or starts one, and tokens that differ become `<*>`.
Templates found in at least `least_docs` documents recur, and their lines are dropped.

Recurring lines are dropped in every document, whatever share of it they are. Documents are counted once for each template,
and equal texts once, whatever their ids, so copies of one text don't make its lines recur; texts that differ anywhere are
different, so what `least_docs` near copies share is dropped in all of them.

At scale only hashes travel: of each line its leaf and itself; leaves of fewer documents than `least_docs` end there, and
each distinct line of the others is read once. The leaf is the unit of templates at every size. One with more than `most`
distinct lines is dealt out to blocks of about `most`, so a group that meets in one task has a bound; each block's templates
are then taken as lines, equal ones as one, and dealt out again, until the leaf holds at most `most` and they meet in one
group. Blocks are of hashes in the first round and of templates that share a token and its place in further ones. A leaf
that still holds more after `ROUNDS` of these (lines that differ in earnest) keeps its templates as they are, and two of
them that are alike but never met stay apart. Counts combine before shuffles.

Null, empty and blank texts have no lines and stay as they are. Blank lines stay. Ties go to the template that was first,
lines in order of frequency and then of hash. Rows of one id with different texts are told apart by a hash of the text.
Columns of the input stay, but for n_lines and n_dropped.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, checkpointed, few_rows, others, table, text_key, with_lists

VARIABLE = b"<*>"
DIGIT = re.compile(rb"[0-9]")
#: Leading tokens that the tree looks at.
LEADING = 3
#: Rounds in which templates of an overfull leaf meet those that share a token.
ROUNDS = 8


def masked(line: bytes) -> list[bytes]:
    tokens = line.split()
    return [VARIABLE if DIGIT.search(t) else t for t in tokens] if DIGIT.search(line) else tokens


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def node(tokens: list[bytes], leading: int) -> int:
    return signed(xxhash.xxh3_64_intdigest(b" ".join(tokens[:leading]), seed=len(tokens)))


def parsed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, of, leaf, line, at): of each distinct line of a document that isn't blank the hashes of its leaf and of itself, and where it is first."""

    def run(batches):
        for ids, ofs, texts in batches_of(batches, ["id", "of", text]):
            out = []
            for i, o, t in zip(ids, ofs, texts, strict=True):
                seen = {}
                for at, line in enumerate((t or "").encode().split(b"\n")):
                    tokens = masked(line)
                    if tokens:
                        seen.setdefault((node(tokens, LEADING), node(tokens, len(tokens))), at)
                out += [(i, o, leaf, own, at) for (leaf, own), at in seen.items()]
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.int32())], names=["id", "of", "leaf", "line", "at"])

    return docs.select(*text_key(key, text), text).transform(few_rows).mapInArrow(run, "id long, of long, leaf long, line long, at int")


def read_lines(docs: DataFrame, where: DataFrame, key: str, text: str) -> DataFrame:
    """(leaf, line, n, tokens) of where (leaf, line, n, spot): the tokens of each distinct line."""
    lists = where.groupBy(F.col("spot.id").alias("id"), F.col("spot.of").alias("of")).agg(F.collect_list(F.struct("leaf", "line", "n", F.col("spot.at").alias("at"))).alias("wanted"))

    def run(batches):
        for texts, wanted in batches_of(batches, [text, "wanted"]):
            out = []
            for t, some in zip(texts, wanted, strict=True):
                lines = t.encode().split(b"\n")
                for w in some:
                    tokens = masked(lines[w["at"]])
                    out.append((w["leaf"], w["line"], w["n"], b" ".join(tokens).decode()))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["leaf", "line", "n", "tokens"])

    found = with_lists(docs.select(*text_key(key, text), text), lists, where.count(), "inner").select(text, "wanted")
    return found.transform(few_rows).mapInArrow(run, "leaf long, line long, n long, tokens string").dropDuplicates(["leaf", "line"])


def templates_of(lines: list[tuple], alike: float) -> tuple[list[int], list[list]]:
    """By line (hash, frequency, tokens) the number of its template, and the templates; lines are taken by frequency."""
    templates: list[list] = []
    chosen = [0] * len(lines)
    for k in sorted(range(len(lines)), key=lambda i: (-lines[i][1], lines[i][0])):
        tokens = lines[k][2]
        best, most = -1, 0.0
        for number, template in enumerate(templates):
            share = sum(a == b for a, b in zip(template, tokens, strict=True)) / len(tokens) if len(template) == len(tokens) else 0.0
            if share > most:
                best, most = number, share
        if best >= 0 and most >= alike:
            templates[best] = [a if a == b else "<*>" for a, b in zip(templates[best], tokens, strict=True)]
            chosen[k] = best
        else:
            chosen[k] = len(templates)
            templates.append(list(tokens))
    return chosen, templates


def anchor(tokens: str, salt: int) -> int:
    """The least hash of a token behind the leading ones with its place; templates that share many have often the same."""
    places = [xxhash.xxh3_64_intdigest(t.encode(), seed=(salt << 32) + k) for k, t in enumerate(tokens.split(" ")) if k >= LEADING and t != "<*>"]
    return signed(min(places, default=0))


def dealt(lines: DataFrame, most: int, salt: int) -> DataFrame:
    """(block, whole, leaf, line, n, tokens): a leaf of at most `most` lines is one block and whole, others are split."""
    sizes = lines.groupBy("leaf").agg(F.count("*").alias("size")).where(F.col("size") > most).withColumnRenamed("leaf", "_leaf")
    rows = lines.join(F.broadcast(sizes), F.col("leaf") == F.col("_leaf"), "left")

    def anchored(batches):
        for leaf, line, n, tokens, size in batches_of(batches, ["leaf", "line", "n", "tokens", "size"]):
            at = [None if z is None else anchor(t, salt) for t, z in zip(tokens, size, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (leaf, line, n)), pa.array(tokens, pa.string()), pa.array(size, pa.int64()), pa.array(at, pa.int64())], names=["leaf", "line", "n", "tokens", "size", "anchor"])

    if salt:
        rows = checkpointed(rows.select("leaf", "line", "n", "tokens", "size").transform(few_rows).mapInArrow(anchored, "leaf long, line long, n long, tokens string, size long, anchor long"))
        full = rows.where("size is not null").groupBy("leaf", "anchor").agg(F.count("*").alias("size")).where(F.col("size") > most).withColumnsRenamed({"leaf": "_leaf", "anchor": "_anchor"})
        whole = F.col("size").isNull()
        rows = rows.select("leaf", "line", "n", "tokens", whole.alias("whole"), "anchor").join(F.broadcast(full), (F.col("leaf") == F.col("_leaf")) & (F.col("anchor") == F.col("_anchor")), "left")
    else:
        rows = rows.withColumns({"whole": F.col("size").isNull(), "anchor": F.lit(None).cast("long")})
    part = F.when(F.col("size").isNotNull(), F.pmod(F.xxhash64("line", F.lit(salt)), F.ceil(F.col("size") / most)))
    return rows.select(F.xxhash64("leaf", "anchor", part).alias("block"), "whole", "leaf", "line", "n", "tokens")


def learned(blocks: DataFrame, alike: float) -> DataFrame:
    """(leaf, line, whole, template, n, tokens) of blocks; tokens, those of the template, and n stand with its first line only."""

    def run(batches):
        def settled(group):
            chosen, templates = templates_of([(line, n, tokens.split(" ")) for _, _, _, line, n, tokens in group], alike)
            names, total, shown = [signed(xxhash.xxh3_64_intdigest(" ".join(t).encode())) for t in templates], [0] * len(templates), set()
            for row, c in zip(group, chosen, strict=True):
                total[c] += row[4]
            rows = []
            for (_, whole, leaf, line, _, _), c in zip(group, chosen, strict=True):
                first = not whole and c not in shown
                shown.add(c)
                rows.append((leaf, line, whole, names[c], total[c] if first else None, " ".join(templates[c]) if first else None))
            return rows

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["leaf", "line", "whole", "template", "n", "tokens"])

        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
        group, out = [], []
        for columns in batches_of(batches, ["block", "whole", "leaf", "line", "n", "tokens"]):
            for row in zip(*columns, strict=True):
                if group and group[0][0] != row[0]:
                    out += settled(group)
                    group = []
                group.append(row)
            if len(out) > 5000:
                yield batch(out)
                out = []
        if group:
            out += settled(group)
        if out:
            yield batch(out)

    placed = blocks.repartition("block").sortWithinPartitions("block", "line")
    return placed.transform(few_rows).mapInArrow(run, "leaf long, line long, whole boolean, template long, n long, tokens string")


def grouped(lines: DataFrame, most: int, alike: float) -> DataFrame:
    """(leaf, line, template): each line's template within its leaf."""
    steps = []
    for salt in range(ROUNDS + 1):
        steps.append(checkpointed(learned(dealt(lines, most, salt), alike)))
        lines = checkpointed(steps[-1].where("tokens is not null").groupBy("leaf", F.col("template").alias("line")).agg(F.sum("n").alias("n"), F.first("tokens").alias("tokens")))
        if lines.isEmpty():
            break
    # From the last round back to the first, templates take the names of those that they became.
    named = None
    for step in reversed(steps):
        step = step.select("leaf", "line", "template")
        if named is not None:
            later = named.select(F.col("leaf").alias("_leaf"), F.col("line").alias("_line"), F.col("template").alias("_later"))
            step = step.join(later, (F.col("leaf") == F.col("_leaf")) & (F.col("template") == F.col("_line")), "left").select("leaf", "line", F.coalesce("_later", "template").alias("template"))
        named = step
    return named


def recurring(docs: DataFrame, key: str, text: str, *, least_docs: int, most: int, alike: float) -> DataFrame:
    """(id, of, drop): of each document the hashes of its lines that recur."""
    found = checkpointed(parsed(docs, key, text))
    often = checkpointed(found.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).select("leaf"))
    lines = checkpointed(found.join(often, "leaf"))
    distinct = checkpointed(lines.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.min(F.struct("id", "of", "at")).alias("spot")))
    template = checkpointed(grouped(checkpointed(read_lines(docs, distinct, key, text)), most, alike))
    named = lines.join(template, ["leaf", "line"])
    widely = checkpointed(named.select("leaf", "template", "of").distinct().groupBy("leaf", "template").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs).select("leaf", "template"))
    return named.join(widely, ["leaf", "template"]).groupBy("id", "of").agg(F.collect_set("line").alias("drop"))


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", *, least_docs: int = 10, most: int = 256, alike: float = 0.6) -> DataFrame:
    """docs with recurring lines taken out of the text, n_lines (not blank, before) and n_dropped."""
    kept = others(docs, "n_lines", "n_dropped")
    docs = docs.select(*kept)
    lists = checkpointed(recurring(docs, key, text, least_docs=least_docs, most=most, alike=alike))
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    rows = docs.select(F.struct(*kept).alias("row"), *text_key(key, text))
    # The lists grow with the documents: texts are dealt out to them at every size, and the lists, the smaller side, are hashed.
    lists = lists.withColumnsRenamed({"id": "_id", "of": "_of"}).hint("shuffle_hash")
    rows = rows.join(lists, F.col("id").eqNullSafe(F.col("_id")) & (F.col("of") == F.col("_of")), "left").select("row.*", F.col("drop").alias("_drop"))

    def rewritten(t: str | None, drop: list | None) -> tuple:
        raw = (t or "").encode().split(b"\n")
        lines = [masked(x) for x in raw]
        total = sum(map(bool, lines))
        if not drop:
            return t, total, 0
        gone = set(drop)
        recurs = [bool(x) and node(x, len(x)) in gone for x in lines]
        return b"\n".join(x for x, r in zip(raw, recurs, strict=True) if not r).decode(), total, sum(recurs)

    def run(batches):
        for batch in batches:
            drops = batch.column(batch.num_columns - 1).to_pylist()
            out = [rewritten(t, d) for t, d in zip(batch.column(kept.index(text)).to_pylist(), drops, strict=True)]
            columns = list(batch.columns[:-1])
            columns[kept.index(text)] = pa.array([x[0] for x in out], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], names=[*kept, "n_lines", "n_dropped"])

    return rows.transform(few_rows).mapInArrow(run, schema)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    rows = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
