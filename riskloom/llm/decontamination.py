"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template tokens: numbers, units and names turn into
typed placeholders, everything else into its lower-case letters. Windows of eight
template tokens of benchmark items and documents meet in a hash join; hits that
lie on one alignment form an occurrence, and its placeholders must be filled by
one consistent renaming. That finds verbatim passages and re-parameterised ones.
Windows that are mostly placeholders say too little as templates; they meet by
their values as well, so verbatim copies of tables and lists are found too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import stored
from riskloom.llm.text import WORD, digests, windows

_NUMBER = re.compile(r"[(\[$€£+-]*\d[\d.,:/]*(%|[a-zA-Zµ°]{0,4})[)\].,;:!?]*")
_UNITS = frozenset(
    "mm cm m km mg g kg t ml l s ms min h hr hrs hour hours minute minutes second seconds day days week weeks month months"
    " year years inch inches foot feet yard yards mile miles ounce ounces pound pounds dollar dollars euro euros cent cents"
    " percent meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres mph kmh"
    " km/h watt watts volt volts joule joules degree degrees".split()
)
_NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    " eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
)
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
_ENDS = (".", "!", "?", ":", '."', '.)')
_SPLIT = re.compile(WORD)
#: Keeps windows of values apart from windows of template tokens.
_BY_VALUE = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class TemplateParams:
    """``width`` tokens make a window, of which ``literals`` at least are no placeholders; others must agree in every value.

    An occurrence needs ``share`` of its item's windows or ``enough`` windows,
    whichever is fewer. Items below ``least_words`` words are too general to
    match. ``block`` windows of the benchmark are held against all documents at a
    time (8 bytes each); a larger benchmark takes several passes.
    """

    width: int = 8
    literals: int = 4
    share: float = 0.5
    enough: int = 5
    least_words: int = 5
    block: int = 4_000_000


def _token(word: str) -> tuple[str, str]:
    """Template token of a word inside a sentence, and the core that fills its slot."""
    core = _EDGE.sub("", word)
    if not core:
        return "", ""
    low = core.lower()
    if _NUMBER.fullmatch(word) or low in _NUMBER_WORDS:
        return "<num>", low
    if low in _UNITS:
        return "<unit>", low
    if core[0].isupper() and len(core) > 1 and core[1:].islower():
        return "<name>", core
    return low, ""


def template(text: str | None, known: dict[str, tuple[str, str]] | None = None) -> tuple[list[str], list[str]]:
    """Template tokens and slot values; a capital that opens a sentence is no name.

    ``known`` remembers words, up to a bound.
    """
    tokens, slots, opening = [], [], True
    known = {} if known is None else known
    if len(known) > 200_000:
        known.clear()
    for word in _SPLIT.findall(text or ""):
        if word not in known:
            known[word] = _token(word)
        token, slot = known[word]
        if token:
            if token == "<name>" and opening:
                token, slot = slot.lower(), ""
            tokens.append(token)
            slots.append(slot)
        opening = word.endswith(_ENDS)
    return tokens, slots


def _literal_runs(slots: list[str], width: int) -> np.ndarray:
    """Number of literal tokens in each window."""
    plain = np.concatenate([[0], np.cumsum([not s for s in slots])])
    return plain[width:] - plain[:-width]


def template_windows(
    tokens: list[str], slots: list[str], width: int, literals: int, whole: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and digests of the windows, and which of them go by their values.

    The first word of an item (``whole``) may be a name inside a document, so its
    window goes both ways if that makes the difference.
    """
    if len(tokens) < width:
        return np.empty(0, int), np.empty(0, np.uint64), np.empty(0, bool)
    plain = _literal_runs(slots, width)
    least = min(literals, width)
    own = windows(digests([t.encode("utf-8", "surrogatepass") for t in tokens]), width)
    at, by_value = np.flatnonzero(plain >= least), plain < least
    if whole and plain[0] == least:
        by_value[0] = True
    exact = np.flatnonzero(by_value)
    if not len(exact):
        return at, own[at], np.zeros(len(at), bool)
    places = np.unique(exact[:, None] + np.arange(width))
    values = np.zeros(len(tokens), np.uint64)
    values[places] = digests([(slots[i] or tokens[i]).lower().encode("utf-8", "surrogatepass") for i in places.tolist()])
    return (
        np.concatenate([at, exact]),
        np.concatenate([own[at], windows(values, width)[exact] ^ _BY_VALUE]),
        np.repeat([False, True], [len(at), len(exact)]),
    )


def _window_rows(params: TemplateParams, wanted: np.ndarray | None, widths: list[int]):
    """Rows (id, width, pos, window, exact, slots) of the wanted windows of each text; without ``wanted``, of each item's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, str]] = {}
        for batch in batches:
            out: dict[str, list] = {"row": [], "width": [], "pos": [], "window": [], "exact": [], "slots": []}
            for i, text in enumerate(batch.column("text")):
                tokens, slots = template(text.as_py(), known)
                short = len(tokens) < params.least_words
                for width in widths or [params.width if short else min(params.width, len(tokens))]:
                    at, own, exact = template_windows(tokens, slots, width, params.literals, wanted is None)
                    if wanted is not None and len(own):
                        near = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                        hit = wanted[near] == own
                        at, own, exact = at[hit], own[hit], exact[hit]
                    for p, w, e in zip(at.tolist(), own.view(np.int64).tolist(), exact.tolist(), strict=True):
                        out["row"].append(i)
                        out["width"].append(width)
                        out["pos"].append(p)
                        out["window"].append(w)
                        out["exact"].append(e)
                        out["slots"].append(slots[p : p + width])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(out["row"], pa.int64())), pa.array(out["width"], pa.int32()),
                 pa.array(out["pos"], pa.int64()), pa.array(out["window"], pa.int64()),
                 pa.array(out["exact"], pa.bool_()), pa.array(out["slots"], pa.list_(pa.string()))],
                names=["id", "width", "pos", "window", "exact", "slots"],
            )

    return run


_ROWS = "id {}, width int, pos bigint, window bigint, exact boolean, slots array<string>"


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    params: TemplateParams | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, windows, n_slots, n_changed), one row per document and item found in it.

    ``windows`` counts the item's windows in the best occurrence, ``n_slots`` its
    placeholders, ``n_changed`` those filled by another value than in the item
    (0: verbatim). An occurrence counts if its slots agree with a one-to-one
    renaming of values. Null and blank texts on either side match nothing; an
    empty benchmark gives no rows. Rows with a null id are never reported, as
    nothing could name them. Repeated rows report the same pair once.
    """
    params = params or TemplateParams()
    doc_kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    items = stored(
        benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))
        .where("id is not null and text is not null")
        .mapInArrow(_window_rows(params, None, []), _ROWS.format(item_kind))
        .select(F.col("id").alias("item"), "width", F.col("pos").alias("item_pos"), "window", "exact", F.col("slots").alias("item_slots")),
        "items",
    )
    sizes = items.groupBy("item").agg(
        F.count_distinct("item_pos").alias("item_windows"), F.count_if(~F.col("exact")).alias("item_templates")
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    # Each block of benchmark windows is held against all documents.
    blocks = max(1, -(-items.select("window").distinct().count() // params.block))
    found = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).select("window", "width").distinct()
        table = mine.toPandas()
        if not len(table):
            continue
        wanted = np.unique(table["window"].to_numpy(np.int64).view(np.uint64))
        widths = sorted({int(w) for w in table["width"]})
        hits = texts.mapInArrow(_window_rows(params, wanted, widths), _ROWS.format(doc_kind))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame(
            [], f"`{id_col}` {doc_kind}, `{item_id}` {item_kind}, windows bigint, n_slots bigint, n_changed bigint"
        )
    found = stored(found, "hits")
    met = found.drop("exact").join(items, ["window", "width"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
    place = ["id", "item", "shift"]
    runs = met.groupBy(*place).agg(
        F.count_distinct("item_pos").alias("windows"), F.count_distinct(F.expr("if(exact, null, item_pos)")).alias("templates")
    )
    pairs = (
        met.select(*place, F.posexplode(F.arrays_zip("slots", "item_slots")).alias("k", "v"), "item_pos", "exact")
        .where("v.item_slots <> ''")
        .select(*place, (F.col("item_pos") + F.col("k")).alias("at"), F.col("v.slots").alias("ours"), F.col("v.item_slots").alias("theirs"), "exact")
        .groupBy(*place, "at", "ours", "theirs")
        .agg(F.bool_and("exact").alias("exact"))
    )

    def slot_counts(cond: Column) -> Column:
        """The slots of an occurrence, those changed, and whether one renaming explains them."""
        ours, theirs = F.when(cond, F.col("ours")), F.when(cond, F.col("theirs"))
        both = F.size(F.collect_set(F.when(cond, F.struct("ours", "theirs"))))
        alike = (both == F.size(F.collect_set(ours))) & (both == F.size(F.collect_set(theirs)))
        return F.struct(
            F.count_if(cond).alias("n_slots"), F.count_if(cond & F.expr("ours <> theirs")).alias("n_changed"), alike.alias("alike")
        )

    slots = pairs.groupBy(*place).agg(slot_counts(F.lit(True)).alias("all"), slot_counts(~F.col("exact")).alias("own"))
    joined = runs.join(slots, place, "left").join(sizes, "item")

    def good(windows: str, whole: str, counts: str) -> Column:
        """(windows, -n_changed, n_slots) of an occurrence that counts, else null."""
        need = F.least(F.ceil(F.col(whole) * params.share), F.lit(params.enough))
        right = (F.col(windows) > 0) & (F.col(windows) >= need) & F.coalesce(F.col(f"{counts}.alike"), F.lit(True))
        changed, n = (F.coalesce(f"{counts}.{c}", F.lit(0)) for c in ("n_changed", "n_slots"))
        return F.when(right, F.struct(F.col(windows).alias("windows"), (-changed).alias("unchanged"), n.alias("n")))

    # Template windows alone decide, or all windows together.
    best = (
        joined.select("id", "item", F.coalesce(good("windows", "item_windows", "all"), good("templates", "item_templates", "own")).alias("b"))
        .where("b is not null")
        .groupBy("id", "item")
        .agg(F.max("b").alias("b"))
    )
    return best.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_id),
        F.col("b.windows").alias("windows"),
        F.col("b.n").alias("n_slots"),
        (-F.col("b.unchanged")).alias("n_changed"),
    )
