"""How filters interact: what each removes alone, after others, and on average over all orders.

A document is reduced to the set of filters it fails. Documents of one part that
fail the same set form a cell, so a part is 2^k counts whatever its size. A
Gray-code walk over the subsets of filters toggles one filter at a time: each
cell keeps the number of switched-on filters it fails, and a cell that goes from
none to one, or back, leaves or joins the running survivors. The states of all
subsets are stored; every order of the filters is read off them by differences.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import stored

#: More filters have too many orders to list; the states alone would still be small.
MOST_FILTERS = 6


def gray_states(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters, by subset mask.

    ``cells[mask]`` holds the measures of the rows that fail exactly the filters of ``mask``.
    """
    masks = np.arange(len(cells))
    failures = np.zeros(len(cells), np.int64)
    running = cells.sum(axis=0)
    states = np.empty_like(cells)
    states[0] = running
    subset = 0
    for step in range(1, len(cells)):
        bit = step & -step
        hit = (masks & bit) != 0
        subset ^= bit
        if subset & bit:
            failures[hit] += 1
            running = running - cells[hit & (failures == 1)].sum(axis=0)
        else:
            failures[hit] -= 1
            running = running + cells[hit & (failures == 0)].sum(axis=0)
        states[subset] = running
    return states


def removed_over_orders(kept: np.ndarray, n_filters: int) -> list[int]:
    """For each filter, what it removes summed over all orders, at any step."""
    totals = []
    for f in range(n_filters):
        total = 0
        for subset in range(len(kept)):
            if not subset >> f & 1:
                before = subset.bit_count()
                orders = factorial(before) * factorial(n_filters - 1 - before)
                total += orders * int(kept[subset] - kept[subset | 1 << f])
        totals.append(total)
    return totals


def _walk(n_filters: int, measures: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(len(measures) + 1)]
            for cell_list in batch.column("cells").to_pylist():
                cells = np.zeros((2**n_filters, len(measures)), np.int64)
                for cell in cell_list:
                    cells[cell["mask"]] = [cell[m] for m in measures]
                states = gray_states(cells)
                for values, kept in zip(columns, states.T, strict=False):
                    values.append(kept.tolist())
                columns[-1].append(removed_over_orders(states[:, 0], n_filters))
            arrays = [pa.array(c, pa.list_(pa.int64())) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column("part"), *arrays], names=["part", *measures, "shapley"])

    return run


def filter_states(
    rows: DataFrame, failures: Mapping[str, Column], part: Column, losses: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per part: arrays, by subset mask, of the rows that survive that subset of filters.

    ``failures`` maps a filter's letter to the condition that a row fails it (null: passes);
    bit i of a mask is the i-th letter. ``losses`` adds arrays that count only the rows
    where a condition holds. Columns: ``part``, ``kept``, one per loss, and ``shapley``
    (by filter: rows removed, summed over all orders). An empty table has no parts.
    """
    if not 1 <= len(failures) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters")
    losses = dict(losses or {})
    mask = F.lit(0)
    for i, fails in enumerate(failures.values()):
        mask = mask + F.when(fails, F.lit(1 << i)).otherwise(F.lit(0))
    measures = ["kept", *losses]
    counted = rows.select(
        part.alias("part"), mask.alias("mask"), *[F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in losses.items()]
    )
    # At most 2^k rows per part and task leave the map side.
    cells = counted.groupBy("part", "mask").agg(F.count("*").alias("kept"), *[F.sum(n).alias(n) for n in losses])
    gathered = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *measures)).alias("cells"))
    shape = ", ".join(f"`{m}` array<bigint>" for m in [*measures, "shapley"])
    return gathered.mapInArrow(_walk(len(failures), measures), f"part string, {shape}")


def filter_steps(states: DataFrame, letters: Sequence[str], losses: Sequence[str] = ()) -> DataFrame:
    """Every order of the filters, step by step, as differences of stored states.

    One row per part, ``filter_order`` and ``step`` (1-based): ``kept`` rows after the
    step, ``removed`` by it, ``redundant`` (fail its filter but were removed earlier),
    ``unique_fails`` (fail no other filter), ``<loss>_lost`` and ``shapley``.
    """
    everything = (1 << len(letters)) - 1
    plan = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, f in enumerate(order, 1):
            plan.append(("".join(letters[i] for i in order), step, f, before, before | 1 << f))
            before |= 1 << f
    # A list fixed by the number of filters, sent with the plan.
    fields = "array<struct<filter_order:string,step:int,f:int,before:int,after:int>>"
    keys = ("filter_order", "step", "f", "before", "after")
    steps = F.from_json(F.lit(json.dumps([dict(zip(keys, p, strict=True)) for p in plan])), fields)
    exploded = states.withColumn("__s", F.explode(steps)).select(
        *states.columns, "__s.filter_order", "__s.step", *[F.col(f"__s.{k}").alias(f"__{k}") for k in keys[2:]]
    )
    at = lambda array, index: F.get(F.col(array), index)
    before, after, alone = F.col("__before"), F.col("__after"), F.expr("shiftleft(1, __f)")
    removed = at("kept", before) - at("kept", after)
    failing = at("kept", F.lit(0)) - at("kept", alone)
    return exploded.select(
        "part", "filter_order", "step",
        at("kept", after).alias("kept"),
        removed.alias("removed"),
        (failing - removed).alias("redundant"),
        (at("kept", F.lit(everything) - alone) - at("kept", F.lit(everything))).alias("unique_fails"),
        *[(at(name, before) - at(name, after)).alias(f"{name}_lost") for name in losses],
        at("shapley", F.col("__f")).alias("shapley"),
    )


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions on a whole text (null: empty) that need no other row, by filter letter.

    A: under 200 words; B: fewer than half of the words distinct; C: capitals above 3 %
    of the code points; D: holds one of ``#$%&*|``. Words are runs of characters other
    than ASCII white space, compared as written.
    """
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(50) * F.size(words),
        "C": F.lit(100) * capitals > F.lit(3) * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def audited_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One narrow row per document: part, fails_a .. fails_e, good, toxic.

    ``fails_e``: the text equals that of a row with a smaller doc_id, anywhere in the
    table; rows that share the smallest id of a text all pass, and a null doc_id is
    neither smaller nor larger than any. Copies are met by (id, digest of the text),
    so a text that very many rows share is no join key of its own. A document is
    good (toxic) if any label row of its id says so; documents without labels, or
    without an id, are neither. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    fails = text_failures(F.col("t"))
    narrow = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("t")).select(
        "doc_id", "part", F.unhex(F.sha2("t", 256)).alias("print"), *[c.alias(f"fails_{n.lower()}") for n, c in fails.items()]
    )
    narrow = stored(narrow, "audit-rows")
    first = narrow.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("doc_id"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic")
    )
    joined = narrow.join(marks, "doc_id", "left").join(
        first.withColumn("__first", F.lit(True)), ["doc_id", "print"], "left"
    )
    return joined.select(
        "part", "fails_a", "fails_b", "fails_c", "fails_d",
        (F.col("doc_id").isNotNull() & F.col("__first").isNull()).alias("fails_e"), "good", "toxic",
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E over ``documents(doc_id, text, lang)``, by language (null: empty string)."""
    rows = audited_rows(docs, labels)
    failures = {letter: F.col(f"fails_{letter.lower()}") for letter in "ABCDE"}
    losses = {"good": F.col("good"), "toxic": F.col("toxic")}
    states = stored(filter_states(rows, failures, F.col("part"), losses), "filter-states")
    return filter_steps(states, "ABCDE", list(losses))
