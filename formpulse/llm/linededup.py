"""Line dedup by a log-template tree.

A line is a sequence of words in which words with a digit are variable from the start. The tree has
fixed depth: the first level is the number of words, the next ones the leading words; what is left
is a leaf. Within a leaf lines join the group whose template agrees with them in enough places, and
the template gets a wildcard where they differ. A template found in enough documents is recurring:
its first line (by document key and line number) stays, the others are dropped.

Equal lines are reduced to one before they meet, so a line that millions of documents hold is one
entry with a count. Lines alone in their leaf need no comparison and their text is never moved.
Larger leaves are parsed in blocks of bounded size. The blocks' templates then look for partners among
all of their leaf by equal segments of places, which no pair that agrees well enough can lack, and join
them round by round until no template has a partner left. So a family of lines is found whatever the
size of its leaf and the place of its variable words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, stored, table

#: Leading words that make the path to a leaf.
DEPTH = 3
#: Share of places in which a line must agree with a template to join its group.
SIMILAR = 0.8
#: Lines with fewer words that are no wildcard are never judged.
LEAST_WORDS = 5
#: Documents from which a template is recurring.
DOCUMENTS = 3
#: Entries of a leaf that one task compares.
BLOCK = 2000

WILD = b"<*>"
_DIGIT = re.compile(rb"[0-9]")


def masked(line: bytes) -> list[bytes]:
    """The words of a line, with a wildcard for each that holds a digit."""
    words = line.split()
    if _DIGIT.search(line):
        return [WILD if _DIGIT.search(w) else w for w in words]
    return words


def leaf(words: list[bytes], depth: int) -> int:
    return xxhash.xxh3_64_intdigest(b"%d\x00" % len(words) + b"\x00".join(words[:depth])) - (1 << 63)


def _row() -> Column:
    """Names a row by its content: equal rows are treated alike."""
    return F.xxhash64("__key", "text")


def _lines(docs: DataFrame, depth: int, least: int) -> DataFrame:
    """row, key, line (0 based), leaf, entry for each judged line of a text."""
    kind = docs.schema["__key"].dataType.simpleString()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            of, line_, leaf_, entry_ = [], [], [], []
            for place, text in enumerate(batch.column(2)):
                for number, line in enumerate((text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    words = masked(line)
                    if len(words) >= least and len(words) - words.count(WILD) >= least:
                        of.append(place)
                        line_.append(number)
                        leaf_.append(leaf(words, depth))
                        entry_.append(xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63))
            taken = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(line_, pa.int32()),
                 pa.array(leaf_, pa.int64()), pa.array(entry_, pa.int64())], ["row", "key", "line", "leaf", "entry"])

    return docs.select(_row().alias("row"), "__key", "text").mapInArrow(
        batches, f"row bigint, key {kind}, line int, leaf bigint, entry bigint")


def _texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """leaf, entry, words for the wanted (row, line, leaf, entry)."""
    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct("line", "leaf", "entry")).alias("wanted"))
    found = by_row.join(docs.select(_row().alias("row"), "text"), "row").select("wanted", F.split("text", "\n").alias("lines"))
    return found.select(F.explode(F.expr("transform(wanted, w -> named_struct("
                                         "'leaf', w.leaf, 'entry', w.entry, 'words', lines[w.line]))")).alias("w")).select("w.*").dropDuplicates(["leaf", "entry"])  # of repeated rows


def parse(entries: list[list[bytes]], similar: float) -> tuple[list[int], list[list[bytes]]]:
    """The group of each entry of a leaf, and the groups' templates, in order of entry.

    An entry joins the first of the most similar templates that agrees with it in the wanted share
    of places; a wildcard agrees with a wildcard only.
    """
    n = len(entries[0])
    code: dict[bytes, int] = {WILD: 0}
    coded = np.array([[code.setdefault(w, len(code)) for w in e] for e in entries], np.int32).reshape(len(entries), n)
    templates = np.empty_like(coded)
    groups: list[int] = []
    made = 0
    for line in coded:
        if made:
            agree = (templates[:made] == line).sum(axis=1)
            best = int(agree.argmax())
            if agree[best] >= similar * n:
                templates[best][templates[best] != line] = 0
                groups.append(best)
                continue
        templates[made] = line
        groups.append(made)
        made += 1
    words = list(code)
    return groups, [[words[c] for c in t] for t in templates[:made]]


def _parsed(entries: DataFrame, similar: float) -> DataFrame:
    """leaf, entry, group, words (the template): entries (task, leaf, entry, words) by task.

    A group's number is a hash of its template.
    """
    def one(leaf_: int, ids: list[int], lines: list[list[bytes]]) -> pa.RecordBatch:
        groups, templates = parse(lines, similar)
        joined = [b" ".join(t) for t in templates]
        names = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in joined]
        return pa.RecordBatch.from_arrays(
            [pa.array([leaf_] * len(ids), pa.int64()), pa.array(ids, pa.int64()),
             pa.array([names[g] for g in groups], pa.int64()),
             pa.array([joined[g].decode("utf-8", "replace") for g in groups], pa.string())],
            ["leaf", "entry", "group", "words"])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, lines = None, [], []
        for batch in rows:
            for task, leaf_, entry, words in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (task, leaf_) != now:
                    if ids:
                        yield one(now[1], ids, lines)
                    now, ids, lines = (task, leaf_), [], []
                ids.append(entry)
                lines.append(masked(words.encode("utf-8", "surrogatepass")))
        if ids:
            yield one(now[1], ids, lines)

    n = spread(entries)
    return entries.select("task", "leaf", "entry", "words").repartition(n, "task").sortWithinPartitions(
        "task", "leaf", "entry").mapInArrow(batches, "leaf bigint, entry bigint, group bigint, words string")


def templates(lines: DataFrame, docs: DataFrame, similar: float = SIMILAR, block: int = BLOCK,
              depth: int = DEPTH) -> DataFrame:
    """leaf, entry, template: the entries whose template is not their own words alone."""
    entries = stored(lines.groupBy("leaf", "entry").agg(F.min(F.struct("key", "row", "line")).alias("first")), "entries")
    shared = entries.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1")
    wanted = entries.join(shared, "leaf").select("first.row", "first.line", "leaf", "entry", F.ceil(F.col("n") / block).alias("blocks"))
    wanted = stored(wanted, "shared-leaves")
    texts = _texts(wanted, docs)
    sized = texts.join(wanted.select("leaf", "entry", "blocks"), ["leaf", "entry"])
    dealt = sized.withColumn("task", F.xxhash64("leaf", F.pmod(F.xxhash64("entry"), "blocks")))
    first = stored(_parsed(dealt, similar), "templates")
    # Templates of leaves of several blocks meet those of other blocks.
    many = wanted.where("blocks > 1").select("leaf").distinct()
    again = first.join(many, "leaf", "left_semi").select("leaf", F.col("group").alias("name"), "words").distinct()
    joined = _met(stored(again, "block-templates"), similar, block, depth)
    return first.join(joined.withColumnRenamed("name", "group"), ["leaf", "group"], "left").select(
        "leaf", "entry", F.coalesce("joined", "group").alias("template")).where("template <> entry")


def _buckets(met: DataFrame, similar: float, block: int, depth: int) -> DataFrame:
    """task, leaf, name, words: templates that may agree in the wanted share of places share a bucket.

    Templates of n words that differ in d places at most, cut into d + 1 segments behind the words that
    all of a leaf have in common, are equal in one segment. A bucket of a segment that holds more than
    ``block`` templates is cut again in the same way by the places that are left, and so on. Where no
    more than d places are left all templates of a bucket agree well enough, and it may be dealt out at
    will: there are fewer parts than templates, so some of them meet, and the rest in later rounds.
    """
    block = max(block, 2)
    n = F.size(F.split("words", " "))
    cut = met.select(
        "leaf", "name", "words", (n - F.ceil(n * similar - 1e-9) + 1).cast("int").alias("s"),
        F.xxhash64("leaf").alias("bucket"), F.slice(F.split("words", " "), depth + 1, F.greatest(n - depth, F.lit(1))).alias("rest"))
    done = None
    while True:
        # Each level a table of its own, since the sizes of its buckets decide on the next.
        size = F.size("rest")
        segment = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda i: F.struct(
            F.floor(i * size / F.col("s")).cast("int").alias("a"), F.floor((i + 1) * size / F.col("s")).cast("int").alias("b"))))
        parts = cut.select("leaf", "name", "words", "s", "bucket", "rest", segment.alias("i", "at"))
        a, b = F.col("at.a"), F.col("at.b")
        cut = parts.select(
            "leaf", "name", "words", "s", F.xxhash64("bucket", "i", F.slice("rest", a + 1, b - a)).alias("bucket"),
            F.concat(F.slice("rest", F.lit(1), a), F.slice("rest", b + 1, F.size("rest"))).alias("rest"))
        sizes = cut.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        cut = stored(cut.join(sizes, "bucket"), "segments")
        again = (F.col("n") > block) & (F.size("rest") >= F.col("s"))
        part = F.pmod(F.xxhash64("name"), F.ceil(F.col("n") / block))
        ready = cut.where(~again).select(F.xxhash64("bucket", part).alias("task"), "leaf", "name", "words")
        done = ready if done is None else done.unionAll(ready)
        cut = cut.where(again).drop("n")
        if cut.isEmpty():
            return done


def _leaders(dealt: DataFrame, similar: float) -> DataFrame:
    """leaf, name, leader: in each bucket, templates that join the group of one with a smaller name."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(leaf_: int, names: list[int], lines: list[list[bytes]]) -> pa.RecordBatch:
            groups, _ = parse(lines, similar)
            leader: dict[int, int] = {}
            for name, group in zip(names, groups, strict=True):
                leader.setdefault(group, name)
            pairs = [(name, leader[group]) for name, group in zip(names, groups, strict=True) if leader[group] != name]
            return pa.RecordBatch.from_arrays(
                [pa.array([leaf_] * len(pairs), pa.int64()), pa.array([x for x, _ in pairs], pa.int64()),
                 pa.array([y for _, y in pairs], pa.int64())], ["leaf", "name", "leader"])

        now, names, lines = None, [], []
        for batch in rows:
            for task, leaf_, name, words in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (task, leaf_) != now:
                    if names:
                        yield one(now[1], names, lines)
                    now, names, lines = (task, leaf_), [], []
                names.append(name)
                lines.append(words.encode("utf-8", "surrogatepass").split(b" "))
        if names:
            yield one(now[1], names, lines)

    return dealt.repartition(spread(dealt), "task").sortWithinPartitions("task", "leaf", "name").mapInArrow(
        batches, "leaf bigint, name bigint, leader bigint")


def _met(met: DataFrame, similar: float, block: int, depth: int) -> DataFrame:
    """leaf, name, joined: what template each of the blocks' templates ends up in.

    Round by round each template joins the one with the smallest name that a bucket offers, if that does
    not itself join another in this round; joined templates keep the words that all of them have. It ends
    when no bucket offers anything; the smallest name of every offer joins nobody, so each round has
    fewer templates.
    """
    joined = met.select("leaf", "name", F.col("name").alias("joined"))
    while True:
        offers = _leaders(_buckets(met, similar, block, depth), similar)
        chosen = stored(offers.groupBy("leaf", "name").agg(F.min("leader").alias("leader")), "offers")
        if chosen.isEmpty():
            return joined
        busy = chosen.select("leaf", F.col("name").alias("leader"))
        moves = chosen.join(busy, ["leaf", "leader"], "left_anti")
        places = met.join(moves, ["leaf", "name"], "left").withColumn("to", F.coalesce("leader", "name"))
        moved = stored(places.select("leaf", "name", "to", "words"), "moves")
        # Words that all have, place by place, so that no task holds all templates of a large group.
        grown = moved.where(F.col("name") != F.col("to")).select("leaf", "to").distinct()
        words = moved.join(grown, ["leaf", "to"], "left_semi").select(
            "leaf", "to", F.posexplode(F.split("words", " ")).alias("place", "word"))
        common = words.groupBy("leaf", "to", "place").agg(F.min("word").alias("one"), F.max("word").alias("other")).select(
            "leaf", "to", F.struct("place", F.when(F.col("one") == F.col("other"), F.col("one")).otherwise(
                F.lit(WILD.decode())).alias("word")).alias("at"))
        merged = common.groupBy("leaf", "to").agg(F.array_join(F.transform(
            F.sort_array(F.collect_list("at")), lambda x: x["word"]), " ").alias("words"))
        same = moved.join(grown, ["leaf", "to"], "left_anti").select("leaf", "name", "words")
        met = stored(same.unionAll(merged.select("leaf", F.col("to").alias("name"), "words")), "block-templates")
        steps = moved.where(F.col("name") != F.col("to")).select("leaf", F.col("name").alias("joined"), "to")
        joined = stored(joined.join(steps, ["leaf", "joined"], "left").select(
            "leaf", "name", F.coalesce("to", "joined").alias("joined")), "joined")


def dedup_lines(docs: DataFrame, key: str = "doc_id", depth: int = DEPTH, similar: float = SIMILAR,
                least: int = LEAST_WORDS, documents: int = DOCUMENTS, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` with __dropped, the sorted numbers (0 based) of the lines to leave out.

    Only lines with ``least`` words without a digit are judged. A line that is repeated within one
    text counts once there; rows that are equal in key and text are one document and are treated
    alike. Null and empty texts have no lines to drop; null keys are the first in order; texts are
    read whole. An empty frame gives an empty frame. Other columns are carried along unchanged, but
    for columns named __key, __row and __dropped.
    """
    rows = docs.withColumn("__key", F.col(key))
    lines = stored(_lines(rows, depth, least), "lines")
    own = lines.withColumn("template", F.col("entry"))
    found = templates(lines, rows, similar, block, depth)
    named = stored(own.drop("template").join(found, ["leaf", "entry"], "left").select(
        "row", "key", "line", "leaf", F.coalesce("template", "entry").alias("template")), "line-templates")
    per_row = named.groupBy("leaf", "template", "row").agg(F.min(F.struct("key", "row", "line")).alias("at"))
    recurring = per_row.groupBy("leaf", "template").agg(F.count("*").alias("n"), F.min("at").alias("keep")).where(
        F.col("n") >= documents).select("leaf", "template", "keep")
    dropped = named.join(recurring, ["leaf", "template"]).where(
        ~((F.col("row") == F.col("keep.row")) & (F.col("line") == F.col("keep.line"))))
    by_row = dropped.groupBy("row").agg(F.sort_array(F.collect_set("line")).alias("__dropped"))
    return rows.withColumn("__row", _row()).join(by_row.withColumnRenamed("row", "__row"), "__row", "left").drop("__key", "__row")


def without_lines(text: Column, dropped: Column) -> Column:
    """A text without the lines of the given numbers."""
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(dropped, i))
    return F.when(dropped.isNotNull(), F.array_join(kept, "\n")).otherwise(text)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: lines, lines dropped, and a digest of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = dedup_lines(docs)
    kept = without_lines(F.col("text"), F.col("__dropped"))
    return judged.select(
        "doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(F.col("__dropped").cast("array<string>"), ","), F.lit("")).alias("dropped_lines"),
        F.sha1(F.coalesce(kept, F.lit("")).cast("binary")).alias("text_sha1"))
