"""Three-way merge of snapshots: by hash where that settles a path, by line hunks elsewhere."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["vault_id", "path"]


def merge_three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(vault_id, path, base_hash, our_hash, their_hash, outcome).

    outcome: same, ours, theirs (the side to take; a null hash there is a
    deletion) or both, for the line merge. A deletion against a change is both.
    """
    side = lambda df, name: df.select(*KEY, F.col("hash").alias(name))
    rows = side(base, "base_hash").join(side(ours, "our_hash"), KEY, "full_outer").join(side(theirs, "their_hash"), KEY, "full_outer")
    b, o, t = F.col("base_hash"), F.col("our_hash"), F.col("their_hash")
    outcome = F.when(o.eqNullSafe(t), "same").when(b.eqNullSafe(o), "theirs").when(b.eqNullSafe(t), "ours").otherwise("both")
    return rows.withColumn("outcome", outcome)


def _same(x: Column, y: Column) -> Column:
    """How many lines two arrays share from the first on."""
    at = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False)).cast("int")
    return F.when(at == 0, F.size(x)).otherwise(at - 1)


#: Changed lines of a gap up to which its hunks are the fewest lines possible.
EDITS = 1_500

Run = tuple[int, int, int]  # lines i .. i + n of one text are k .. k + n of the other


def _shortest(a: np.ndarray, b: np.ndarray, most: int) -> list[Run] | None:
    """The runs of equal lines that leave the fewest changed, or None if more than ``most`` are.

    A round allows one more changed line and keeps the furthest place on each
    diagonal; from the end, the rounds' places lead back along the runs.
    """
    n, m = len(a), len(b)
    zero, far, rounds = m + 1, np.full(n + m + 3, -1, np.int64), []
    for d in range(min(most, n + m) + 1):
        low = -d if d <= m else -m + (d - m) % 2
        diagonal = np.arange(low, (d if d <= n else n - (d - n) % 2) + 1, 2)
        at = diagonal + zero
        right = np.where((far[at - 1] >= 0) & (far[at - 1] < n), far[at - 1] + 1, -1)
        down = np.where(far[at + 1] - diagonal <= m, far[at + 1], -1)
        x = np.maximum(right, down) if d else np.zeros(1, np.int64)
        begun, going = x.copy(), np.flatnonzero(x >= 0)
        while len(going):
            i, k = x[going], x[going] - diagonal[going]
            inside = (i < n) & (k < m)
            going, i, k = going[inside], i[inside], k[inside]
            going = going[a[i] == b[k]]
            x[going] += 1
        rounds.append((low, begun, x, right >= down))
        far[at] = x
        if far[n - m + zero] == n and (n - m - d) % 2 == 0:
            break
    else:
        return None
    runs, k = [], n - m
    for low, begun, x, by_right in reversed(rounds):
        place = (k - low) // 2
        i, end = int(begun[place]), int(x[place])
        if end > i:
            runs.append((i, i - k, end - i))
        k += -1 if by_right[place] else 1
    return runs[::-1]


def _anchors(a: np.ndarray, b: np.ndarray) -> list[Run]:
    """The longest chain, in order on both sides, of lines that occur once on either."""
    once = lambda x: {v: i for v, i, n in zip(*np.unique(x, return_index=True, return_counts=True), strict=True) if n == 1}
    in_a, in_b = once(a), once(b)
    pairs = sorted((i, in_b[v]) for v, i in in_a.items() if v in in_b)
    tails, ends, before = [], [], []
    for p, (_, k) in enumerate(pairs):
        place = bisect.bisect_left(tails, k)
        tails[place:], ends[place:] = [k, *tails[place + 1 :]], [p, *ends[place + 1 :]]
        before.append(ends[place - 1] if place else -1)
    chain, p = [], ends[-1] if ends else -1
    while p >= 0:
        chain.append((int(pairs[p][0]), int(pairs[p][1]), 1))
        p = before[p]
    return chain[::-1]


def text_hunks(a: list[str], b: list[str], most: int = EDITS) -> list[tuple[int, int, int, int]]:
    """(start, end, first, last): lines [start, end) of ``a`` become lines [first, last) of ``b``.

    As few lines as can be where at most ``most`` of a gap change; a gap with
    more is cut at lines that occur once on either side, or else one hunk.
    """
    code: dict[str, int] = {}
    x, y = (np.array([code.setdefault(line, len(code)) for line in side], np.int64) for side in (a, b))
    gaps, out = [(0, len(a), 0, len(b))], []
    while gaps:
        i, j, k, l = gaps.pop()
        if i == j or k == l:
            out += [(i, j, k, l)] if i < j or k < l else []
            continue
        runs = _shortest(x[i:j], y[k:l], most)
        final = runs is not None
        runs = runs if final else _anchors(x[i:j], y[k:l])
        if not runs and j > i:
            out.append((i, j, k, l))
            continue
        begins = [(i, k), *((i + r + n, k + s + n) for r, s, n in runs)]
        ends = [*((i + r, k + s) for r, s, _ in runs), (j, l)]
        new = [(p, q, r, s) for (p, r), (q, s) in zip(begins, ends, strict=True) if p < q or r < s]
        if final:
            out += new
        else:
            gaps += new
    return sorted(out)


def _hunks(texts: DataFrame, base: str, other: str) -> DataFrame:
    """``texts`` without its two texts, with start, end, lines: a row for each hunk.

    Equal lines at both ends go first. A middle that one side does not have is
    a hunk; the others are compared line by line.
    """
    keep = [c for c in texts.columns if c not in (base, other)]
    lines = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), "\n")
    cut = texts.filter(~F.col(base).eqNullSafe(F.col(other))).select(*keep, lines(base).alias("a"), lines(other).alias("b")).withColumn("head", _same(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("head") + 1, F.size(c) - F.col("head"))
    cut = cut.select(*keep, "head", rest("a").alias("a"), rest("b").alias("b")).withColumn("tail", _same(F.reverse("a"), F.reverse("b")))
    front = lambda c: F.slice(c, F.lit(1), F.size(c) - F.col("tail"))
    cut = cut.select(*keep, F.col("head").alias("start"), (F.col("head") + F.size("a") - F.col("tail")).alias("end"), front("a").alias("a"), front("b").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, starts, ends, new = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("start", "end", "a", "b"))
            for row, (start, end, a, b) in enumerate(zip(*columns, strict=True)):
                found = text_hunks(a, b) if a and b else [(0, end - start, 0, len(b))] if a or b else []
                for i, j, k, l in found:
                    of.append(row)
                    starts.append(start + i)
                    ends.append(start + j)
                    new.append(b[k:l])
            kept = batch.select(keep).take(pa.array(of, pa.int64()))
            hunks = [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(new, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *hunks], [*keep, "start", "end", "lines"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cut.schema if f.name in keep)
    return cut.mapInArrow(run, f"{kinds}start int, end int, lines array<string>")


def line_hunks(rows: DataFrame, base: str, other: str, side: str) -> DataFrame:
    """``rows`` (vault_id, path, ...) with hunks: (..., side, start, end, lines): base lines [start, end) become ``lines``.

    The fewest lines change, but in gaps of more than ``EDITS`` changed ones.
    Null texts are empty, rows with equal texts have no hunk.
    """
    keep = [c for c in rows.columns if c not in (base, other)]
    return _hunks(rows.select(*keep, F.lit(side).alias("side"), base, other), base, other)


def _overlap(s: Column, e: Column, t: Column, f: Column) -> Column:
    """Whether base lines [s, e) and [t, f) overlap.

    Two insertions do at the same place; an insertion and a range do where it
    is strictly inside, not at an edge.
    """
    strictly = lambda x, low, high: (x > low) & (x < high)
    return F.when((s == e) & (t == f), s == t).when(s == e, strictly(s, t, f)).when(t == f, strictly(t, s, e)).otherwise((s < f) & (t < e))


def hunk_overlaps(hunks: DataFrame) -> DataFrame:
    """(vault_id, path, our_start, their_start): pairs of hunks of both sides that touch the same base lines.

    Equality on the path and a range condition.
    """
    a = hunks.filter("side = 'ours'").select(*KEY, F.col("start").alias("our_start"), F.col("end").alias("our_end"))
    b = hunks.filter("side = 'theirs'").select(*KEY, F.col("start").alias("their_start"), F.col("end").alias("their_end"))
    touch = _overlap(*(F.col(c) for c in ("our_start", "our_end", "their_start", "their_end")))
    return a.join(b, KEY).filter(touch).select(*KEY, "our_start", "their_start")


def conflict_regions(hunks: DataFrame) -> DataFrame:
    """(vault_id, path, region, start, end, ours, theirs): hunks that overlap directly or through others, as one region.

    ours and theirs are the hunks of the region by side; a region of one side
    is no conflict. Same edits on both sides are no conflict either. In order
    of start and end, a hunk goes on with a region that reaches beyond its
    start; an insertion also with one that stands at the same place.
    """
    w = Window.partitionBy(*KEY).orderBy("start", "end", "side")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    empty = F.col("start") == F.col("end")
    beside = empty & (F.lag("start").over(w) == F.col("start")) & (F.lag("end").over(w) == F.col("start"))
    apart = reach.isNull() | ((F.col("start") >= reach) & ~F.coalesce(beside, F.lit(False)))
    marked = hunks.withColumn("__new", apart.cast("int")).withColumn("region", F.sum("__new").over(w))
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("start", "end", "lines"))))
    return marked.groupBy(*KEY, "region").agg(F.min("start").alias("start"), F.max("end").alias("end"), of("ours").alias("ours"), of("theirs").alias("theirs"))


def assemble_merge(rows: DataFrame, regions: DataFrame, base: str = "base_text", ours: str = "ours", theirs: str = "theirs") -> DataFrame:
    """(vault_id, path, merged, conflicts): base lines with the regions put in; conflicts as marker blocks.

    Insertions at the edge of a replacement go before or behind it.
    """
    lines = F.col("__lines")

    def applied(hunks: Column, start: Column, end: Column) -> Column:
        """Base lines [start, end) with hunks put in."""
        begin = F.struct(start.alias("at"), F.array().cast("array<string>").alias("out"))
        step = lambda acc, h: F.struct(h["end"].alias("at"), F.concat(acc["out"], F.slice(lines, acc["at"] + 1, h["start"] - acc["at"]), h["lines"]).alias("out"))
        return F.aggregate(hunks, begin, step, lambda acc: F.concat(acc["out"], F.slice(lines, acc["at"] + 1, F.greatest(end - acc["at"], F.lit(0)))))

    def settled(r: Column) -> Column:
        """A region's lines, and whether they are a conflict."""
        sides = F.struct(applied(r["ours"], r["start"], r["end"]).alias("o"), applied(r["theirs"], r["start"], r["end"]).alias("t"))

        def chosen(x: Column) -> Column:
            conflict = (F.size(r["ours"]) > 0) & (F.size(r["theirs"]) > 0) & (x["o"] != x["t"])
            block = F.concat(F.array(F.lit(f"<<<<<<< {ours}")), x["o"], F.array(F.lit("=======")), x["t"], F.array(F.lit(f">>>>>>> {theirs}")))
            new = F.when(conflict, block).when(F.size(r["ours"]) == 0, x["t"]).otherwise(x["o"])
            return F.struct(r["start"].alias("start"), r["end"].alias("end"), new.alias("lines"), conflict.alias("conflict"))

        return F.get(F.transform(F.array(sides), chosen), 0)

    per_path = regions.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end", "ours", "theirs"))).alias("__regions"))
    done = rows.select(*KEY, base).join(per_path, KEY, "left").withColumn("__lines", F.split(base, "\n"))
    done = done.withColumn("__put", F.transform("__regions", settled))
    whole = applied(F.col("__put"), F.lit(0), F.size("__lines"))
    conflicts = F.size(F.filter("__put", lambda r: r["conflict"])).cast("long")
    return done.select(*KEY, F.when(F.col("__put").isNull(), F.col(base)).otherwise(F.array_join(whole, "\n")).alias("merged"), F.coalesce(conflicts, F.lit(0)).alias("conflicts"))


def merge_texts(rows: DataFrame) -> DataFrame:
    """(vault_id, path, merged, conflicts) of rows with base_text, our_text, their_text that both sides changed.

    Both sides' hunks come from one pass over the rows.
    """
    rows = rows.withColumn("base_text", F.coalesce("base_text", F.lit("")))
    side = lambda name, text: F.struct(F.lit(name).alias("side"), F.col(text).alias("text"))
    both = rows.select(*KEY, "base_text", F.explode(F.array(side("ours", "our_text"), side("theirs", "their_text"))).alias("s"))
    return assemble_merge(rows, conflict_regions(_hunks(both.select(*KEY, "base_text", "s.side", "s.text"), "base_text", "text")))
