"""Overlap joins of line spans, however different their lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spans up to 2 ** BASE lines long share the lowest level.
BASE = 4


def _level(start: str, end: str) -> Column:
    """The smallest level whose buckets are at least as long as the span."""
    length = (F.col(end) - F.col(start) + 1).cast("bigint")
    return F.greatest(F.lit(BASE), F.length(F.bin(length - 1))).cast("int")


def _buckets(start: str, end: str) -> Column:
    """The buckets of level ``_at`` that the span touches: two at most from its own level on."""
    return F.sequence(_bucket(start), _bucket(end))


def _bucket(line: str) -> Column:
    return F.expr(f"shiftright(cast({line} as bigint), _at)")


def overlapping(
    left: DataFrame, right: DataFrame, on: str, left_span: tuple[str, str], right_span: tuple[str, str]
) -> DataFrame:
    """Pairs of rows of the same ``on`` whose spans (both ends included, not negative) overlap, each pair once.

    A span lives at the level of its length, in buckets that are a power of two long, so it touches at most two. Of a
    pair the shorter span visits the level of the longer one, where it touches at most two buckets as well. So a span
    over a whole file is two rows, and a short one is two rows for each level at which the other side has spans; the
    number of rows grows with the logarithm of the longest span. A pair counts in the first bucket that both touch.

    Sides made by parsing or exploding a narrow table look small to the planner, whatever they hold, so neither is ever
    broadcast. Each side is read three times; keep it with ``durable`` where it is costly.
    """
    sides = []
    for frame, (start, end) in ((left, left_span), (right, right_span)):
        usable = frame.filter((F.col(start) <= F.col(end)) & F.col(on).isNotNull())
        sides.append((usable.withColumn("_level", _level(start, end)), start, end))
    overlap = (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(left_span[1]) >= F.col(right_span[0]))
    first = F.greatest(_bucket(left_span[0]), _bucket(right_span[0]))

    def living(side: int) -> DataFrame:
        frame, start, end = sides[side]
        return frame.withColumn("_at", F.col("_level")).withColumn("_bucket", F.explode(_buckets(start, end)))

    def visiting(side: int, strictly: bool) -> DataFrame:
        """At the levels of the other side's spans, its own level left out where the other side visits there."""
        frame, start, end = sides[side]
        # As many levels as the longest span has binary digits: a bounded list.
        levels = sorted(row[0] for row in sides[1 - side][0].select("_level").distinct().collect())
        above = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda n: (n > F.col("_level")) if strictly else (n >= F.col("_level")))
        return frame.withColumn("_at", F.explode(above)).withColumn("_bucket", F.explode(_buckets(start, end)))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = a.drop("_level").join(b.drop("_level").hint("merge"), [on, "_at", "_bucket"])
        return pairs.filter(overlap & (F.col("_bucket") == first)).drop("_at", "_bucket")

    short_left = met(visiting(0, False), living(1))
    short_right = met(living(0), visiting(1, True))
    return short_left.unionByName(short_right)


def _nodes(start: Column, past: Column, levels: int) -> Column:
    """The fewest aligned buckets that make up the lines from ``start`` to before ``past``: two of each level at most."""
    found = []
    for n in range(levels):
        low, high = F.shiftright(start + ((1 << n) - 1), n), F.shiftright(past, n)
        for odd, bucket in ((low, low), (high, high - 1)):
            taken = (low < high) & (odd.bitwiseAND(1) == 1)
            found.append(F.when(taken, F.struct(F.lit(n).alias("_at"), bucket.alias("_bucket"))))
    return F.filter(F.array(*found), lambda node: node.isNotNull())


def _above(line: Column, levels: int) -> Column:
    """The bucket of each level that holds a line."""
    return F.array(*[F.struct(F.lit(n).alias("_at"), F.shiftright(line, n).alias("_bucket")) for n in range(levels)])


def overlap_summary(
    left: DataFrame, right: DataFrame, on: str, left_span: tuple[str, str], right_span: tuple[str, str], value: str
) -> DataFrame:
    """Rows of ``left`` that overlap any of ``right``, with ``met`` (how many), and the least and greatest ``value`` of these.

    Nothing is paired: where spans are many, pairs grow with the square of the tables. A span overlaps those that begin within
    it, and those that began before it and hold its first line. Counts of beginnings are kept for aligned buckets of all
    lengths, and a span adds up the few that make up its lines; spans are counted at the few buckets that make up
    their lines after the first, and a first line looks at the bucket of each length around it. Rows grow with the logarithm
    of the longest span. Columns ``on``, spans and ``value`` may be null; null and turned spans overlap nothing.
    """
    (ls, le), (rs, re) = left_span, right_span
    first, last, begin, end = (F.col(c).cast("bigint") for c in (ls, le, "_s", "_e"))
    usable = left.filter((F.col(ls) <= F.col(le)) & F.col(on).isNotNull())
    given = right.filter((F.col(rs) <= F.col(re)) & F.col(on).isNotNull()).select(on, F.col(rs).alias("_s"), F.col(re).alias("_e"), value)
    # One row: how many levels the longest span of each side needs.
    width = lambda rows, length: int(rows.agg(F.coalesce(F.max(length), F.lit(0))).first()[0]).bit_length() + 1
    held, crossed = width(usable, last - first + 1), width(given, end - begin)
    met = [F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high")]
    some = [F.count("*").alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high")]
    at = [on, "_at", "_bucket"]

    begun = given.groupBy(on, "_s").agg(*some).select(on, "_n", "_low", "_high", F.inline(_above(begin, held))).groupBy(*at).agg(*met)
    spans = usable.select(on, ls, le).distinct()
    within = spans.select(on, ls, le, F.inline(_nodes(first, last + 1, held))).join(begun.hint("merge"), at).groupBy(on, ls, le).agg(*met)
    holding = given.groupBy(on, "_s", "_e").agg(*some).select(on, "_n", "_low", "_high", F.inline(_nodes(begin + 1, end + 1, crossed))).groupBy(*at).agg(*met)
    lines = usable.select(on, ls).distinct().select(on, ls, F.inline(_above(first, crossed)))
    around = lines.join(holding.hint("merge"), at).groupBy(on, ls).agg(*met)
    after = spans.join(around.hint("merge"), [on, ls]).select(on, ls, le, "_n", "_low", "_high")
    found = within.unionByName(after).groupBy(on, ls, le).agg(F.sum("_n").alias("met"), F.min("_low").alias("low"), F.max("_high").alias("high"))
    return usable.join(found.hint("merge"), [on, ls, le])
