"""Audit of filters that are applied one after another: what each removes in every order.

Rows become masks of the filters they fail, and Spark counts rows per part and mask, so a part comes to
at most 2^filters rows whatever its size. These counts are put into a decision diagram whose levels are
the filters in their order: a node stands for the masks that agree on the filters above it and weighs as
many rows, its low edge is passing its filter, its high edge failing it. Equal sub-diagrams are one node.
Going down the low edges from the root, the all-pass path, the weight of each node is what the filters so
far have kept and that of its high child what the filter there removes.

Every other order is reached by swapping adjacent levels, which rebuilds the nodes of one level only.
All orders are walked in plain changes, one swap each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from emberlog.llm.common import only, saved
from emberlog.session import ship

#: What a word is parted by: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


class Diagram:
    """A count-weighted decision diagram over failure masks.

    `counts` maps masks (bit i is the i-th letter of `order`) to tuples of counts, such as all rows and
    marked ones. Nodes are numbers; `weight` has the summed tuple of each.
    """

    def __init__(self, order: str, counts: dict[int, tuple[int, ...]]) -> None:
        self.order = list(order)
        self.bit = {letter: i for i, letter in enumerate(order)}
        width = len(next(iter(counts.values()), (0,)))
        self.weight: list[tuple[int, ...]] = []
        self.children: list[tuple[int, int] | None] = []
        self.numbers: dict[tuple, int] = {}
        zero = (0,) * width

        def build(level: int, mask: int) -> int:
            if level == len(self.order):
                return self._node(None, counts.get(mask, zero))
            bit = 1 << self.bit[self.order[level]]
            return self._inner(level, build(level + 1, mask), build(level + 1, mask | bit))

        self.root = build(0, 0)

    def _node(self, edges: tuple[int, int] | None, weight: tuple[int, ...], level: int | None = None) -> int:
        key = (level, edges if edges is not None else weight)
        if key not in self.numbers:
            self.numbers[key] = len(self.weight)
            self.weight.append(weight)
            self.children.append(edges)
        return self.numbers[key]

    def _inner(self, level: int, low: int, high: int) -> int:
        weight = tuple(a + b for a, b in zip(self.weight[low], self.weight[high]))
        # a node belongs to the filter of its level, so equal edges under another filter are another node
        return self._node((low, high), weight, self.bit[self.order[level]])

    def swap(self, level: int) -> None:
        """Exchange the filters of a level and the one below; only nodes of these two levels are rebuilt."""
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        moved: dict[int, int] = {}

        def rebuilt(node: int, depth: int) -> int:
            if node in moved:
                return moved[node]
            low, high = self.children[node]
            if depth == level:
                (ll, lh), (hl, hh) = self.children[low], self.children[high]
                new = self._inner(level, self._inner(level + 1, ll, hl), self._inner(level + 1, lh, hh))
            else:
                new = self._inner(depth, rebuilt(low, depth + 1), rebuilt(high, depth + 1))
            moved[node] = new
            return new

        self.root = rebuilt(self.root, 0)

    def to(self, order: str) -> None:
        """Bring the levels into this order by adjacent swaps."""
        for level, letter in enumerate(order):
            for at in range(self.order.index(letter), level, -1):
                self.swap(at - 1)

    def steps(self) -> Iterator[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """For each filter in order: its letter, what is kept after it and what it removes."""
        node = self.root
        for letter in self.order:
            node, high = self.children[node]
            yield letter, self.weight[node], self.weight[high]


def plain_changes(letters: str) -> Iterator[str]:
    """All orders of the letters, each one adjacent swap away from the one before."""
    if len(letters) < 2:
        yield letters
        return
    for i, rest in enumerate(plain_changes(letters[:-1])):
        places = range(len(rest), -1, -1) if i % 2 == 0 else range(len(rest) + 1)
        for at in places:
            yield rest[:at] + letters[-1] + rest[at:]


def audit_of(letters: str, counts: dict[int, tuple[int, ...]], marks: list[str]) -> pd.DataFrame:
    """All orders and steps of one part."""
    diagram, found = Diagram(letters, counts), []
    for order in plain_changes(letters):
        diagram.to(order)
        for step, (letter, kept, removed) in enumerate(diagram.steps(), 1):
            found.append((order, step, letter, kept[0], removed[0], *removed[1:]))
    table = pd.DataFrame(found, columns=["filter_order", "step", "letter", "kept", "removed", *marks])
    first = table[table["step"] == 1].groupby("letter")["removed"].first()
    last = table[table["step"] == len(letters)].groupby("letter")["removed"].first()
    table["redundant"] = table["letter"].map(first) - table["removed"]
    table["unique_fails"] = table["letter"].map(last)
    table["shapley"] = table["letter"].map(table.groupby("letter")["removed"].sum())
    return table.drop(columns="letter")


def mask_of(failures: dict[str, Column]) -> Column:
    """The filters a row fails as bits, in the order given; an unknown condition counts as passed."""
    mask = F.lit(0)
    for i, condition in enumerate(failures.values()):
        mask = mask + F.when(condition, F.lit(1 << i)).otherwise(F.lit(0))
    return mask


def audited(masks: DataFrame, letters: str, marks: list[str], most: int = 7) -> DataFrame:
    """One row per part, order and step, from rows of part, mask, n and a count per mark.

    Columns: part, filter_order, step (from 1), kept, removed, redundant (failing the step's filter but
    removed before), unique_fails (failing only that filter), one column per mark (of the removed rows)
    and shapley (what the filter removes, summed over all orders). Zeros are included. Parts are what
    `part` holds, null being the empty one; an empty table gives no rows. `letters` name the bits, lowest
    first; there are n! orders, so more than `most` letters are refused.
    """
    if len(set(letters)) != len(letters) or not 0 < len(letters) <= most:
        raise ValueError(f"give 1 to {most} different letters")
    if set(marks) & {"part", "mask", "n", "filter_order", "step", "kept", "removed", "shapley"}:
        raise ValueError("marks need names of their own")
    ship(masks.sparkSession)
    sums = masks.groupBy(F.coalesce("part", F.lit("")).alias("part"), "mask").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in ("n", *marks)])

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): tuple(map(int, c)) for m, *c in rows[["mask", "n", *marks]].itertuples(index=False)}
        out = audit_of(letters, counts, marks)
        out.insert(0, "part", key[0])
        return out[["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                    *marks, "shapley"]]

    numbers = ", ".join(f"`{c}` bigint" for c in ("kept", "removed", "redundant", "unique_fails", *marks, "shapley"))
    return sums.groupBy("part").applyInPandas(work, f"part string, filter_order string, step int, {numbers}")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of quality filters on one text.

    A: under 200 words; B: less than half of the words are different; C: over 3 % capitals A-Z; D: holds
    one of # $ % & * |. Words are what white space parts.
    """
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, different = F.size(words).cast("bigint"), F.size(F.array_distinct(words)).cast("bigint")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint")
    return {"A": n < 200, "B": different * 100 < n * 50,
            "C": capitals * 100 > F.length(text).cast("bigint") * 3, "D": text.rlike("[#$%&*|]")}


def document_masks(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text",
                   part: str = "lang") -> DataFrame:
    """part, mask, n, good_lost, toxic_lost: counted failure masks of the five filters A to E of documents.

    E fails a row whose text is identical to that of any row with a smaller id, in any part; null texts
    are empty texts. Of rows with equal ids and texts none is the smaller one, and a row without an id is
    no copy and has none. A row is good (toxic) if any label of its id has quality (toxic) 1. Copies fail
    the same filters but E, so they are counted before their ids are compared.
    """
    content = F.coalesce(F.col("text"), F.lit(""))
    masks = only(docs, id, text, part).toDF("id", "text", "part").select(
        "id", F.coalesce("part", F.lit("")).alias("part"), F.sha2(content, 256).alias("digest"),
        mask_of(text_failures(content)).alias("mask"))
    marked = only(labels, id, "quality", "toxic").toDF("id", "quality", "toxic").filter(
        "quality = 1 OR toxic = 1").groupBy("id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    rows = saved(masks.join(marked, "id", "left").select(
        "id", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("bad", F.lit(0)).alias("bad")), "masks")
    kind = ["digest", "part", "mask", "good", "bad"]
    # first per id, so repeated ids count together; then per kind, of which a text has few
    kinds = rows.groupBy(*kind, "id").agg(F.count("*").alias("n")).groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min("id").alias("least"),
        F.min_by(F.col("n"), F.struct(F.col("id").isNull(), F.col("id"))).alias("firsts"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    first = F.col("least") == F.min("least").over(W.partitionBy("digest"))
    passing = F.col("nameless") + F.when(first, F.col("firsts")).otherwise(F.lit(0))
    split = kinds.withColumn("passing", passing).select(
        "part", "good", "bad", F.explode(F.array(
            F.struct(F.col("mask"), F.col("passing").alias("n")),
            F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))).alias("m"))
    return split.groupBy("part", F.col("m.mask").alias("mask")).agg(
        F.sum("m.n").alias("n"), F.sum(F.col("m.n") * F.col("good")).alias("good_lost"),
        F.sum(F.col("m.n") * F.col("bad")).alias("toxic_lost")).filter("n > 0")


def document_audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """The audit of the five filters of `document_masks` over documents, per part."""
    return audited(document_masks(docs, labels, **columns), "ABCDE", ["good_lost", "toxic_lost"])
