"""Line dedup by winnowing over line hashes; DataFrame functions only.

A document is the sequence of its non-blank lines. Of the hashes of every `run` lines in a row (a window) the least
is a fingerprint, so any two runs of that length which are equal share one at the same place. Only the selected
positions are kept, some half of the lines, with the lines about them; fingerprints that are selected once only are
dropped (counted before the shuffle). The positions of a recurring fingerprint are joined with the earlier ones and
the match is extended to both sides, as far as the position's windows reach: at most run - 1 lines to the left and to
the right, where the next position takes over. Of equal windows the first in corpus order stays, later ones are
repeats. Repeated windows that touch or overlap are one repeated run, however long, and are deleted.

A line is thus deleted if and only if it lies in `run` equal lines in a row that also start earlier (in an earlier
document, or earlier in this one), judged on the input. A document with fewer lines is one window of its own length.
With `enough`, fewer than `run` lines in a row that hold that many words are windows too, so that a long passage is
found however few lines it is set in.

Cases: null text stays null and has no lines. Blank lines (nothing but spaces) are no part of the sequence; those
inside a deleted run go with it. Very long texts are read whole; the work for a text is linear in its lines. Equal or
null doc_ids are told apart by text (common.keyed). Repeated rows are repeats of the first. No rows: no rows. Extra
columns stay, whatever their names; one named like a result (n_lines, n_removed, n_runs) is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keyed, stage

RUN = 3
#: Words that make a window of fewer lines than RUN.
ENOUGH = 50


def fingerprints(docs: DataFrame, run: int = RUN, enough: int | None = None) -> DataFrame:
    """docs: key, text. The selected positions, one row each: key, print (the line hash that is the least of its windows), j (first line, counted from 1, of the first window that chose it),
    hs and is (hashes and line numbers of all lines of those windows), wide (lines of a window), windows (how many chose it)."""
    lines = docs.select("key", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).where(F.length(F.trim("line")) > 0)
    n_words = F.lit(0) if enough is None else F.regexp_count("line", F.lit(WORD))
    lines = lines.select("key", "i", F.xxhash64("line").alias("h"), n_words.alias("n"))
    order = Window.partitionBy("key").orderBy("i")
    ahead = lambda c, k: F.lead(c, k).over(order) if k else F.col(c)
    # a window's lines, and those of the windows after it that can choose the same position
    columns = {f"{c}{k}": ahead(c, k) for c in ("h", "i") for k in range(2 * run - 1)} | {f"n{k}": ahead("n", k) for k in range(run)}
    lines = lines.withColumns({"j": F.row_number().over(order)} | columns)
    hashes = [F.col(f"h{k}") for k in range(run)]
    least = F.least(*hashes) if run > 1 else hashes[0]
    whole = F.col(f"h{run - 1}").isNotNull()
    lines = lines.withColumn("at", F.coalesce(*[F.when(h == least, F.col("j") + k) for k, h in enumerate(hashes)]))
    lines = lines.withColumns({"before": F.lag("at").over(order), **{f"at{k}": F.when(F.col(f"h{run - 1 + k}").isNotNull(), F.lead("at", k).over(order)) for k in range(1, run)}})
    windows = F.lit(1) + sum((F.coalesce((F.col(f"at{k}") == F.col("at")).cast("int"), F.lit(0)) for k in range(1, run)), F.lit(0))

    def position(print_: Column, wide: Column, windows: Column) -> Column:
        row = lambda c: F.slice(F.array(*[F.col(f"{c}{k}") for k in range(2 * run - 1)]), F.lit(1), wide + windows - 1)
        return F.struct(print_.alias("print"), row("h").alias("hs"), row("i").alias("is"), wide.alias("wide"), windows.alias("windows"))

    width = sum((h.isNotNull().cast("int") for h in hashes[1:]), F.lit(1))
    # whole windows, the first of those that choose a position; and the only window of a shorter document
    made = [F.when(whole & ~F.col("at").eqNullSafe(F.col("before")), position(least, F.lit(run), windows)).when(~whole & (F.col("j") == 1), position(least, width, F.lit(1)))]
    if enough is not None:  # fewer lines that hold enough words; they meet by their whole content
        words = lambda k: sum((F.col(f"n{i}") for i in range(k)), F.lit(0))
        made += [F.when(F.col(f"h{k - 1}").isNotNull() & (words(k) >= enough), position(F.xxhash64(*hashes[:k], F.lit(k)), F.lit(k), F.lit(1))) for k in range(1, run)]
    return lines.select("key", "j", F.explode(F.array_compact(F.array(*made))).alias("x")).select("key", "j", "x.*")


def repeated_runs(docs: DataFrame, run: int = RUN, enough: int | None = None) -> DataFrame:
    """docs: key, text. Maximal runs (key, first, last: line numbers from 0, lines: non-blank ones) to delete."""
    chosen = stage(fingerprints(docs, run, enough), "prints")
    # written tables on both sides of a join let adaptive execution split a fingerprint that many positions have
    prints = stage(chosen.groupBy("print").agg(F.count("*").alias("c")).where("c > 1").select("print"), "recurring")
    shared = chosen.join(prints, "print", "left_semi")
    # a position and the lines about it meet earlier ones: to the left and to the right as far as its windows go
    t = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("windows") - 1), lambda t: F.slice("hs", t + 1, F.col("wide")))).alias("t", "w")
    reached = shared.select("key", F.col("j").alias("j0"), "is", "wide", t)
    line = lambda k: F.element_at("is", k)
    reached = reached.select("key", (F.col("j0") + F.col("t")).alias("j"), (F.col("j0") + F.col("t") + F.col("wide") - 1).alias("j_last"), line(F.col("t") + 1).alias("first"), line(F.col("t") + F.col("wide")).alias("last"), F.xxhash64("w").alias("w"), F.xxhash64("w", F.lit(1)).alias("w2"))
    reached = stage(reached, "windows")
    earliest = stage(reached.groupBy("w", "w2").agg(F.min(F.struct("key", "j")).alias("e"), F.count("*").alias("c")).where("c > 1").drop("c"), "earliest")
    again = reached.join(earliest, ["w", "w2"]).where("struct(key, j) <> e").select("key", "j", "j_last", "first", "last")
    # matches on either side of a position, and of the positions next to it, that touch or overlap are one run
    order = Window.partitionBy("key").orderBy("j")
    reach = F.max("j_last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    again = again.withColumn("new", (F.coalesce(reach, F.lit(-2)) < F.col("j") - 1).cast("int"))
    again = again.withColumn("number", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = again.groupBy("key", "number").agg(F.min("first").alias("first"), F.max("last").alias("last"), (F.max("j_last") - F.min("j") + 1).alias("lines"))
    return runs.drop("number")


def dedup(docs: DataFrame, run: int = RUN, enough: int | None = None) -> DataFrame:
    """docs with its repeated runs cut from text, and n_lines, n_removed (non-blank lines) and n_runs."""
    d, _ = keyed(docs)
    # the columns of docs travel as one, so that none clashes with those used here
    d = d.select(F.col("_key").alias("key"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"))
    runs = repeated_runs(d.select("key", "text"), run, enough)
    runs = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"), F.sum("lines").alias("lines")).withColumnRenamed("key", "r_key")
    d = d.join(runs, F.col("key") == F.col("r_key"), "left")

    def kept(lines: Column) -> Column:  # what lies before the k-th run, and after the last one
        start = lambda k: F.when(k == 0, 0).otherwise(F.get("runs", k - 1)["last"] + 1)
        stop = lambda k: F.coalesce(F.get("runs", k)["first"], F.size(lines))
        pieces = F.transform(F.sequence(F.lit(0), F.size("runs")), lambda k: F.slice(lines, start(k) + 1, stop(k) - start(k)))
        return F.array_join(F.flatten(pieces), "\n")

    lines = F.split("text", "\n", -1)
    n_lines = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) > 0))
    cut = F.get(F.transform(F.array(lines), kept), F.lit(0))  # the lines are one variable of the function: split once
    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(cut)
    columns = [text.alias("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed", "n_runs")]
    counts = {"n_lines": F.when(F.col("text").isNull(), 0).otherwise(n_lines), "n_removed": F.coalesce("lines", F.lit(0)), "n_runs": F.when(F.col("runs").isNull(), 0).otherwise(F.size("runs"))}
    return d.select(*columns, *[v.cast("long").alias(k) for k, v in counts.items()])
