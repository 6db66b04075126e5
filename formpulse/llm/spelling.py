"""Spelling variants: words one edit apart, found by a frontier of states that walks down two tries.

**Words.** Maximal runs of letters of whole texts, counted over all of them.

**Tries.** One of the words as written, one of the words reversed, both path-compressed: a node is a
prefix, an edge its continuation up to the next prefix where words part or end. The edges below a level's
nodes are one aggregate over the words that are there (least and greatest word of each next letter, whose
common prefix is the edge), so a node that holds a third of all words is folded map-side.

**Frontier.** States (word, node, edits, shift) join the edges of their nodes level by level; the position
in the word is the node's length, and one more after a deletion (shift). Without an edit a word follows its
own edge; from its siblings' edges it takes one edit: its next letter is replaced by the edge's (only by a
greater one, the other word sees it the other way) or deleted (the shorter word needs no insertion then).
With one edit it must follow exactly. A state whose edge leads to a single word compares what is left with
that word, which becomes a neighbour. Words part at nodes only, so an edit is always taken at a node.

**Halves.** An edit in the second half of a word is taken in the first trie, one in the first half in the
other. Edits are so taken deep in a trie, where few edges leave a node, and the frontier stays a small
multiple of the words. A node has as many edges as the alphabet has letters at most, so joins cannot grow
beyond that, and the state side of a hot node may be split. The walk begins below the first two letters,
where no edit is due yet. There are as many rounds as nodes on the longest path; each is written down.

Null texts have no words, and a null id counts as an empty one. Repeated rows count each. Words of any
length are taken whole. Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Letters of a run, as the inside of a character class.
LETTERS = "A-Za-zÀ-ÿ"
#: Words shorter than this, in code points, or rarer are left out.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One in so many pairs of document and run loses a code point.
EVERY = 97
#: Different words a task counts before it hands its counts on, and the code points they may have.
HELD, HELD_LENGTH = 400_000, 20_000_000
#: Depth of the first nodes; edits are due at half a word's length, at this depth at the earliest.
START = LEAST_LENGTH // 2

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _spelt(doc_id: int | None, run: str, every: int) -> str:
    """The run, or what is left of it where the pair of document and run is drawn."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    cut = h % len(run)
    return run[:cut] + run[cut + 1:]


def word_counts(docs: DataFrame, *, text: str = "text", key: str = "doc_id", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """Words of enough letters and occurrences, and their number n over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        # A match of this many letters or more is a whole run, and no shorter run can give a word.
        find = regex.compile(f"[{LETTERS}]{{{least_length},}}").findall
        counts: Counter[str] = Counter()
        length = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs = Counter(find((body.as_py() or "").translate(_LOWER)))
                for run, n in runs.items():
                    word = _spelt(doc_id, run, every)
                    if len(word) >= least_length:
                        counts[word] += n
                        length += len(word)
                if len(counts) >= HELD or length >= HELD_LENGTH:
                    yield out()
                    counts.clear()
                    length = 0
        yield out()

    counted = docs.select(key, text).mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _common(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, bit by bit."""
    bits = F.array(*(F.lit(1 << i) for i in range(30, -1, -1)))

    def longer(found: Column, bit: Column) -> Column:
        upto = found + bit
        fits = (upto <= F.length(a)) & (upto <= F.length(b))
        return F.when(fits & (F.substring(a, F.lit(1), upto) == F.substring(b, F.lit(1), upto)), upto).otherwise(found)

    return F.aggregate(bits, F.lit(0), longer)


def _edges(states: DataFrame) -> DataFrame:
    """Edges below the nodes at which words stand without an edit: (way, at, first, label, leaf, other, m).

    ``label`` continues the node up to the child; a leaf's child is the single word ``other`` of count m.
    """
    words = states.where("shift IS NULL")
    first = F.substring(F.col("word"), F.length("node") + 1, F.lit(1))
    groups = words.groupBy("way", F.col("node").alias("at"), first.alias("first")).agg(
        F.min("word").alias("other"), F.max("word").alias("last"), F.max("n").alias("m"))
    leaf = F.col("other") == F.col("last")
    end = F.when(leaf, F.length("other")).otherwise(_common(F.col("other"), F.col("last")))
    label = F.substring(F.col("other"), F.length("at") + 1, end - F.length("at"))
    return groups.select("way", "at", "first", label.alias("label"), leaf.alias("leaf"), "other", "m")


def _step(states: DataFrame) -> DataFrame:
    """The frontier one level below, and the neighbours that were reached (``other`` is not null)."""
    edges = _edges(states).withColumnRenamed("way", "of")
    word, node, shift, label, leaf = (F.col(c) for c in ("word", "node", "shift", "label", "leaf"))
    depth, long, size = F.length(node), F.length(word), F.length(label)
    rest = F.substring(word, depth + 1 + F.coalesce(shift, F.lit(0)), long)

    def follows(left: Column) -> Column:
        """What is left of the word follows the edge, to its very end at a leaf."""
        return F.when(leaf, left == label).otherwise(left.startswith(label))

    head, tail = F.substring(rest, F.lit(1), F.lit(1)), F.substring(rest, F.lit(2), long)
    due = depth >= F.when(F.col("way") == 0, F.floor(long / 2)).otherwise(long - F.floor(long / 2))
    own = head == F.col("first")
    sibling = shift.isNull() & due & ~own & (rest != "")
    replaced = sibling & (F.col("first") > head) & F.when(leaf, tail == F.substring(label, F.lit(2), long)).otherwise(
        tail.startswith(F.substring(label, F.lit(2), long)))
    deleted = sibling & follows(tail)
    # A word without an edit goes on along its own edge while others share it.
    onward = shift.isNull() & own & ~leaf
    exact = shift.isNotNull() & own & follows(rest)
    shifts = F.array_compact(F.array(
        F.when(onward, F.lit(-1)), F.when(exact, shift), F.when(replaced, F.lit(0)), F.when(deleted, F.lit(1))))
    joined = states.select("way", "word", "n", "node", "shift").join(edges, (F.col("way") == F.col("of")) & (node == F.col("at")) & (
        onward | exact | replaced | deleted))
    moved = joined.withColumn("moved", F.explode(shifts))
    return moved.select(
        "way", "word", "n", F.when(~leaf, F.concat(node, label)).alias("node"),
        F.when(F.col("moved") >= 0, F.col("moved")).alias("shift"),
        F.when(leaf, F.col("other")).alias("other"), F.when(leaf, F.col("m")).alias("m"))


def near_words(words: DataFrame, *, start: int = START) -> DataFrame:
    """Unordered pairs (word, n, other, m) of words that differ by exactly one inserted, deleted or
    replaced code point, each once.

    ``words`` (word, n) are different words of more than ``start`` code points, whose half length,
    rounded down, is no less than ``start``.
    """
    ways = words.select(F.lit(0).alias("way"), "word", "n").union(
        words.select(F.lit(1), F.reverse("word"), "n"))
    states = stored(ways.select(
        "way", "word", "n", F.substring("word", 1, start).alias("node"), F.lit(None).cast("int").alias("shift"),
        F.lit(None).cast("string").alias("other"), F.lit(None).cast("bigint").alias("m")), "frontier")
    rounds = []
    while not (open_ := states.where("other IS NULL")).isEmpty():
        states = stored(_step(open_), "frontier")
        rounds.append(states.where("other IS NOT NULL").select("way", "word", "n", "other", "m"))
    found = rounds[0] if rounds else states.select("way", "word", "n", "other", "m").limit(0)
    for more in rounds[1:]:
        found = found.unionAll(more)
    turned = found.select(
        "way", *(F.when(F.col("way") == 0, F.col(c)).otherwise(F.reverse(c)).alias(c) for c in ("word", "other")), "n", "m")
    # A letter out of a run of equal ones may go at several places, of which each trie knows one.
    half = F.floor(F.length("word") / 2).cast("int")
    same = F.substring(F.col("word"), F.lit(1), half) == F.substring(F.col("other"), F.lit(1), half)
    return turned.where(same == (F.col("way") == 0)).select("word", "n", "other", "m")


def forms(words: DataFrame, near: DataFrame) -> DataFrame:
    """For each word its form (the most frequent near word, the smallest among equals, if at least twice
    as frequent), and the number of its near words."""
    both = near.unionAll(near.select(
        F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("rank"), "other")).alias("best"))
    much = -F.col("best.rank") >= 2 * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(much, F.col("best.other")).alias("form"), F.when(much, -F.col("best.rank")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """The last of each word's forms, for the words that have one: (word, root).

    Counts at least double from form to form, so no chain is longer than the counts have bits, and
    each round of pointer doubling halves it.
    """
    links = stored(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def group_spellings(docs: DataFrame, **options) -> DataFrame:
    """Every word with its form, its root, its count and how many words are near it."""
    words = stored(word_counts(docs, **options), "words")
    found = stored(forms(words, near_words(words)), "forms")
    return found.join(roots(found), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling groups of the words of all documents."""
    return group_spellings(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
