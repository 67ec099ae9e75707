"""Source divergence audit: how far the terms of each source stray from its language and from the other sources.

Tasks count terms into partial sums, and a language keeps the terms that enough of its documents hold. For the terms
that mark a source most, a partition retains only a skyband: terms that fewer than k others dominate by a higher count
in the source, a lower count in the language and an earlier place in UTF-8 order. A dominated term can't rank before
those that dominate it, so the k best of a group are in the merged skybands, where they are ranked exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visitlens.llm.shared import stage

#: Documents of a language that must hold a term, terms listed for a source, and what is added to each count.
LEAST_DOCS, BEST, ADDED = 30, 50, 5
#: Counted entries that a task holds; rows of a group, and of all groups, that a skyband task holds.
HELD, NEW_ROWS, ALL_ROWS = 400_000, 4096, 200_000
#: Sources in a tile, and terms in a block, of the matrices that sources are compared in.
TILE, BLOCK = 256, 4096

# Terms are runs of letters of ASCII, in lower case, and of all characters beyond it, whose bytes are over 127.
_TERMS = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else ord(" ") for c in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame) -> DataFrame:
    """Partial sums of occurrences and documents by (lang, source, term), and a row with a null term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = {}
        docs_with: dict[tuple[str, str], Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            names = [x.split()[0] for x in COUNTS.split(", ")]
            for (lang, source), found in n.items():
                size, terms = len(found) + 1, list(found)
                columns = [pa.array([lang] * size), pa.array([source] * size), pa.array([None, *terms], pa.binary()).cast(pa.string())]
                columns += [pa.array([0, *map(count.__getitem__, terms)], pa.int64()) for count in (found, docs_with[lang, source])]
                yield pa.RecordBatch.from_arrays(columns, names)

        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                group = (lang, source)
                if group not in n:
                    n[group], docs_with[group] = Counter(), Counter()
                    held += 1
                terms = text.as_py().encode().translate(_TERMS).split()
                before = len(n[group])
                n[group].update(terms)
                docs_with[group].update(set(terms))
                held += len(n[group]) - before
                if held >= HELD:
                    yield from flush()
                    n, docs_with, held = {}, {}, 0
        yield from flush()

    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]).mapInArrow(run, COUNTS)


def parts_of(n: Column, all_n: Column, kept: Column) -> Column:
    """The smoothed share of a term in parts of 1,000,000,000, plus one; exact for any count."""
    part = (n + ADDED).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", part, (all_n + ADDED * kept).cast("decimal(20,0)")) + 1


def skyband(n: np.ndarray, lang_n: np.ndarray, terms: list[str], k: int = BEST) -> np.ndarray:
    """Places of the rows that fewer than ``k`` others dominate; terms must differ."""
    utf8 = np.array([t.encode() for t in terms], object)
    place = np.empty(len(terms), np.int64)
    place[np.argsort(utf8, kind="stable")] = np.arange(len(terms))
    # In this order every dominating row comes before those that it dominates.
    order = np.lexsort((place, lang_n, -n))
    kept = np.empty(0, np.int64)
    for at in range(0, len(order), 512):
        new = order[at : at + 512]
        by = np.concatenate([kept, new])
        over = (lang_n[by][None, :] <= lang_n[new][:, None]) & (place[by][None, :] < place[new][:, None])
        # Rows of this block dominate only later ones of it.
        over[:, len(kept) :] &= np.tri(len(new), k=-1, dtype=bool)
        kept = np.concatenate([kept, new[over.sum(1) < k]])
    return kept


BAND = "lang string, source string, term string, n long, lang_n long, value long"


def skybands(rows: DataFrame, k: int = BEST) -> DataFrame:
    """Of rows (lang, source, term, n, lang_n, value) what each partition can't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], pd.DataFrame] = {}
        new: dict[tuple[str, str], list[pd.DataFrame]] = {}

        def reduced(group: tuple[str, str]) -> pd.DataFrame:
            all_ = pd.concat([*([held[group]] if group in held else []), *new.pop(group, [])], ignore_index=True)
            return all_.iloc[skyband(all_["n"].to_numpy(), all_["lang_n"].to_numpy(), all_["term"].tolist(), k)]

        def flush() -> Iterator[pa.RecordBatch]:
            for group in {*held, *new}:
                yield pa.RecordBatch.from_pandas(reduced(group), preserve_index=False)

        for batch in batches:
            for group, part in batch.to_pandas().groupby(["lang", "source"], sort=False):
                new.setdefault(group, []).append(part)
                if sum(map(len, new[group])) >= NEW_ROWS:
                    held[group] = reduced(group)
            if sum(len(x) for parts in new.values() for x in parts) + sum(map(len, held.values())) >= ALL_ROWS:
                yield from flush()
                held, new = {}, {}
        yield from flush()

    return rows.mapInArrow(run, BAND)


def ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Ranks items of each group by value, the largest first, then by UTF-8."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = rows.withColumn("rank", F.row_number().over(order))
    return found if most is None else found.filter(F.col("rank") <= most)


def distances(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: sums of differences between any two sources of a language, both ways.

    ``cells`` has lang, source, term and p where a source has the term, ``groups`` lang, source, kept (terms) and zero
    (p of a term that the source lacks). Sources are compared tile by tile over blocks of terms; the output has a row
    for each pair in any case.
    """
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    placed = groups.withColumn("tile", F.floor(place / TILE).cast("int"))
    tiles = Window.partitionBy("lang")
    placed = stage(
        placed.withColumn("tiles", F.max("tile").over(tiles) + 1).withColumn("blocks", F.ceil(F.greatest(F.col("kept"), F.lit(1)) / BLOCK).cast("int")),
        "sources",
    )
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    own = cells.join(placed.select("lang", "source", "tile", "tiles", "blocks"), ["lang", "source"]).select(
        "lang", "source", "tile", "tiles", block.alias("block"), "term", "p"
    )
    # A row without term gives every block the sources' values for terms that they lack.
    blank = placed.select(
        "lang", "source", "tile", "tiles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), F.col("zero").alias("p")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = own.unionByName(blank).withColumn("other", other)
    dealt = dealt.select("*", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"))

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, first, second = key[:3]
        blank = rows[rows["term"].isna()]
        a, b = (blank[blank["tile"] == t].sort_values("source") for t in (first, second))
        have = rows[rows["term"].notna()]
        codes, terms = pd.factorize(have["term"])

        def matrix(side: pd.DataFrame, tile: int) -> np.ndarray:
            m = np.repeat(side["p"].to_numpy(np.int64)[:, None], len(terms), axis=1)
            mine = (have["tile"] == tile).to_numpy()
            m[np.searchsorted(side["source"].to_numpy(), have["source"].to_numpy()[mine]), codes[mine]] = have["p"].to_numpy(np.int64)[mine]
            return m

        left, right = matrix(a, first), matrix(b, second)
        sums = [np.abs(right - row).sum(1) for row in left]
        out = pd.DataFrame({"source": np.repeat(a["source"].to_numpy(), len(b)), "item": np.tile(b["source"].to_numpy(), len(a)), "value": np.concatenate(sums)})
        out.insert(0, "lang", lang)
        out["gap"] = np.abs(a["p"].to_numpy(np.int64)[:, None] - b["p"].to_numpy(np.int64)[None, :]).reshape(-1)
        out["seen"] = len(terms)
        out = out[out["source"] != out["item"]]
        return out if first == second else pd.concat([out, out.rename(columns={"source": "item", "item": "source"})[out.columns]])

    sums = dealt.groupBy("lang", "first", "second", "block").applyInPandas(compare, "lang string, source string, item string, value long, gap long, seen long")
    whole = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.max("gap").alias("gap"), F.sum("seen").alias("seen"))
    kept = groups.select("lang", "source", "kept")
    # Terms that neither tile has differ by the same amount each.
    return whole.join(kept, ["lang", "source"]).select("lang", "source", "item", (F.col("value") + (F.col("kept") - F.col("seen")) * F.col("gap")).alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, best: int = BEST) -> DataFrame:
    """Part ``pair``: distances between the sources of a language; part ``term``: the ``best`` terms that mark a source.

    Null text, lang and source are empty strings; every row is a document, also one that repeats; other columns are
    ignored. A (lang, source) group without terms is compared like any other. Ties go by UTF-8 order of the item. A
    language with one source has no pairs, an empty table gives no rows.
    """
    sums = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = stage(sums, "term-counts")
    terms = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    terms = stage(terms.filter(F.col("docs") >= least_docs).drop("docs"), "kept-terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_all"))
    cells = stage(counts.select("lang", "source", "term", "n").join(terms, ["lang", "term"]), "term-cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("all_n"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stage(groups.na.fill(0, ["all_n", "kept", "lang_all"]), "term-groups")
    valued = cells.join(groups, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        "n",
        "lang_n",
        parts_of(F.col("n"), F.col("all_n"), F.col("kept")).alias("p"),
        parts_of(F.col("lang_n"), F.col("lang_all"), F.col("kept")).alias("q"),
    )
    valued = stage(valued, "term-parts")
    zero = F.when(F.col("kept") > 0, parts_of(F.lit(0).cast("long"), F.col("all_n"), F.greatest(F.col("kept"), F.lit(1)))).otherwise(F.lit(0))
    pairs = ranked(distances(valued.select("lang", "source", "term", "p"), groups.select("lang", "source", "kept", zero.alias("zero"))))
    marks = valued.filter("p > q").select("lang", "source", "term", "n", "lang_n", (F.col("p") - F.col("q")).alias("value"))
    band = skybands(marks, best).select("lang", "source", F.col("term").alias("item"), "value")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(ranked(band, best).withColumn("part", F.lit("term")).select(columns))
