"""Secrets in texts: three base patterns, and strings that a pair of Markov models holds to be random. Column functions only.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained from labelled
samples over all documents: what the base patterns match is random; runs of identifier characters too short to be judged,
and long ones of words joined by separators, are ordinary. Other long runs train neither, since some are the secrets sought.
Keys of an alphabet that the base patterns hardly match are random by a uniform model over their alphabet. A long run
outside all base matches is a secret too if the log-likelihood ratio of the likelier random model to the ordinary one,
summed over its transitions, is at least ``MIN_RATIO`` in total and ``MIN_MEAN`` per transition.

Spans are code points, end exclusive. Null and empty texts have none; repeated rows are each scanned; without samples of
both kinds the models add nothing; an empty table gives an empty result. Columns beside the text pass under whatever names;
their own working columns start with ``_``.

The time grows with the text, however many matches it holds: a match's position is the sum of what lies before it, summed
in chunks (``_before``), and no match cuts its string out of the whole text. Working columns are used twice where they
are used at all, or outside lambdas, since a column that a lambda alone uses is computed again for each element.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")

# Fixed by the contract. The length of hexadecimal and access runs can be asked in the pattern, since a run that is too
# short holds no longer one; the length of an assigned value can't, since a short one still takes its characters.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGNED = 12

#: Runs that the models judge.
RUN = r"[A-Za-z0-9+/_-]{16,}"
#: Characters between runs, and long runs that are ordinary by their own form: words of three letters at least, joined.
BETWEEN = r"[^A-Za-z0-9+/_-]+"
JOINED = r"^[A-Za-z][a-z]{2,}(?:[+/_-][A-Za-z][a-z]{2,}){1,40}$"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
SIDE = len(ALPHABET) + 1

#: Upper case, lower case, digits, and the rest (also what is outside the alphabet): how many characters each has.
CLASSES = (26, 26, 10, 5)
_CLASS = [3] + [0] * 26 + [1] * 26 + [2] * 10 + [3] * 4
#: Alphabets of uniform random strings with their sizes, smallest first: a run counts as of the first that holds it.
ALPHABETS = ((r"^[0-9A-F]+$", 16), (r"^[0-9A-Z]+$", 36), (r"^[0-9a-z]+$", 36), (r"^[A-Za-z]+$", 52), (r"^[0-9A-Za-z]+$", 62), (r"", 66))
#: Weight of the classes' transitions, in samples.
PRIOR = 20.0

MIN_RATIO = 12.0
MIN_MEAN = 0.7

#: All that bars a run besides runs: base matches, and words that end in the key of an assignment.
BARRED = rf"(?:{ASSIGN}|{ACCESS}|{HEX}|(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]+?{ASSIGN}|({RUN}))"
RUN_GROUP = 5
#: A run that holds one of these is matched by a base pattern in part.
HOLDS = rf"{ACCESS}|{HEX}"

_SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"
#: Elements whose sums are taken together; an array grows by copying, so chunks keep that linear.
CHUNK = 256


def _chunks(column: str) -> Column:
    """The elements of an array column in chunks."""
    parts = F.sequence(F.lit(0), F.floor((F.size(column) - 1) / CHUNK).cast("int"))
    return F.when(F.size(column) > 0, F.transform(parts, lambda k: F.slice(F.col(column), k * CHUNK + 1, CHUNK)))


def _before(docs: DataFrame, column: str, value, combine, name: str) -> DataFrame:
    """``docs`` with ``name``: for each element of ``column`` the combined ``value`` of all elements before it, 0 at first."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("list"))
    grow = lambda own: lambda state, x: F.struct(combine(state["at"], own(x)).alias("at"), F.concat(state["list"], F.array(state["at"])).alias("list"))
    sums = docs.withColumn("_sums", F.transform(_chunks(column), lambda chunk: F.aggregate(chunk, start, grow(value))))
    tops = F.aggregate("_sums", start, grow(lambda chunk: chunk["at"]), lambda state: state["list"])
    lists = F.zip_with("_sums", tops, lambda chunk, top: F.transform(chunk["list"], lambda b: combine(top, b)))
    return sums.withColumn(name, F.coalesce(F.flatten(lists), F.array().cast("array<int>"))).drop("_sums")


def _with_matches(docs: DataFrame, name: str, present: Column, pattern: str, kind: int, group: int, least: int) -> DataFrame:
    """``docs`` with ``name``: the spans of ``pattern``'s matches whose ``group`` has ``least`` characters, with that group."""
    text = F.coalesce(F.col("text"), F.lit(""))
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.col("_found")
    found_ = docs.withColumns({"_gaps": F.when(present, gaps), "_found": F.when(present, found)})
    found_ = found_.withColumn("_bodies", F.when(F.size("_found") > 0, bodies))
    zipped = F.arrays_zip(F.transform("_gaps", F.length).alias("gap"), F.transform("_found", F.length).alias("size"), F.col("_bodies").alias("value"))
    parts = found_.withColumn("_parts", F.when(F.size("_found") > 0, F.slice(zipped, 1, F.size("_found")))).drop("_gaps", "_found", "_bodies")
    placed = _before(parts, "_parts", lambda p: p["gap"] + p["size"], lambda a, b: a + b, "_at")

    def span(part: Column, at: Column) -> Column:
        start = at + part["gap"]
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + part["size"]).alias("stop"), part["value"].alias("value"))

    spans = F.filter(F.zip_with("_parts", "_at", span), lambda s: F.length(s["value"]) >= least)
    return placed.withColumn(name, F.coalesce(spans.cast(_SPAN), F.array().cast(_SPAN))).drop("_parts", "_at")


def _bare(spans: Column | str) -> Column:
    """Spans without the matched strings."""
    return F.transform(spans, lambda s: s.dropFields("value"))


def with_base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_assign``, ``_access``, ``_hex`` spans and their strings, ``_base`` (all these spans, by start) and
    ``_runs``, the long runs that overlap none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    based = docs
    for name, pattern, kind, group, least in (
        ("_assign", ASSIGN, 0, 2, MIN_ASSIGNED), ("_access", ACCESS, 1, 0, 1), ("_hex", HEX, 2, 0, 1), ("_runs", BARRED, 3, RUN_GROUP, 1)
    ):
        based = _with_matches(based, name, text.rlike(RUN if name == "_runs" else pattern), pattern, kind, group, least)
    runs = F.filter("_runs", lambda s: ~s["value"].rlike(HOLDS))
    return based.withColumns({"_base": F.array_sort(_bare(F.concat("_assign", "_access", "_hex"))), "_runs": runs})


def _symbols(string: Column) -> Column:
    """Numbers of the characters, 0 for those outside the alphabet."""
    return F.transform(F.split(string, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))


def _transitions(string: Column) -> Column:
    symbols = _symbols(string)
    return F.zip_with(symbols, F.slice(symbols, 2, F.greatest(F.size(symbols) - 1, F.lit(0))), lambda a, b: a * SIDE + b)


def samples(based: DataFrame) -> DataFrame:
    """(label, sample, n): distinct strings matched by the base patterns are 1 (of an assignment its value); short runs
    outside assignments, and long ones of joined words, are 0. ``n`` is how often they occur."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = F.when(text.rlike(ASSIGN), F.regexp_replace(text, ASSIGN, " ")).otherwise(text)
    words = based.select(F.lit(0).alias("label"), F.explode(F.split(rest, BETWEEN)).alias("sample"))
    long = (F.length("sample") > 15) & F.col("sample").rlike(JOINED) & ~F.col("sample").rlike(HOLDS)
    matched = based.where(F.size("_base") > 0).select(F.lit(1).alias("label"), F.explode(F.concat("_assign", "_access", "_hex")).alias("span"))
    each = words.where(F.length("sample").between(2, 15) | long).unionByName(matched.select("label", F.col("span.value").alias("sample")))
    return each.groupBy("label", "sample").agg(F.count("*").alias("n"))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of each transition, random over ordinary, then its log-likelihood as ordinary, from
    (label, sample, n) rows; all 0 without samples of both kinds.

    Counts are summed on Spark; ``2 * SIDE ** 2`` rows at most reach the driver.
    """
    counts = [[0] * SIDE**2, [0] * SIDE**2]
    found = labelled.where("label in (0, 1)").select("label", "n", F.explode(_transitions(F.col("sample"))).alias("t")).where("t is not null")
    for row in found.groupBy("label", "t").agg(F.sum("n").alias("n")).collect():
        counts[row["label"]][row["t"]] = row["n"]
    if not all(map(sum, counts)):
        return [0.0] * (2 * SIDE**2)
    logs = []
    for own in counts:
        # A transition that is rare in the samples is as likely as its classes of characters make it.
        classes = [[1] * len(CLASSES) for _ in CLASSES]
        for i, n in enumerate(own):
            classes[_CLASS[i // SIDE]][_CLASS[i % SIDE]] += n
        sums = [sum(own[a * SIDE : (a + 1) * SIDE]) for a in range(SIDE)]
        for i, n in enumerate(own):
            row, to = classes[_CLASS[i // SIDE]], _CLASS[i % SIDE]
            prior = row[to] / sum(row) / CLASSES[to]
            logs.append(log((n + PRIOR * prior) / (sums[i // SIDE] + PRIOR)))
    # Ordinary identifiers change case, and hold digits and separators, also where the given words don't.
    ordinary = [log((exp(o) + p) / 2) for o, p in zip(logs, _styles(counts[0]))]
    return [r - o for r, o in zip(logs[SIDE**2 :], ordinary)] + ordinary


def _styles(own: list[int]) -> list[float]:
    """Probability of each transition where half of the characters are followed by their own class, the rest by the others
    equally often, and letters follow letters as counted, whatever their case."""
    pairs = [[1] * 26 for _ in range(26)]
    letter = lambda s: (s - 1) % 26 if 1 <= s <= 52 else None
    for i, n in enumerate(own):
        a, b = letter(i // SIDE), letter(i % SIDE)
        if a is not None and b is not None:
            pairs[a][b] += n
    single = [sum(row[b] for row in pairs) for b in range(26)]
    out = []
    for i in range(SIDE**2):
        a, b = letter(i // SIDE), letter(i % SIDE)
        row = single if a is None else pairs[a]
        share = 1 / 2 if _CLASS[i // SIDE] == _CLASS[i % SIDE] else 1 / 2 / (len(CLASSES) - 1)
        out.append(share * (1 / CLASSES[_CLASS[i % SIDE]] if b is None else row[b] / sum(row)))
    return out


def with_secrets(docs: DataFrame, model: list[float]) -> DataFrame:
    """``docs`` with the base spans and ``_spans``: base spans and the model's, by start and kind."""
    table = F.split(F.lit(",".join(f"{v:.6f}" for v in model)), ",").cast("array<double>")

    def random(span: Column) -> Column:
        string = span["value"]
        steps = F.filter(_transitions(string), lambda t: t.isNotNull())
        sizes = F.lit(log(ALPHABETS[-1][1]))
        for pattern, size in ALPHABETS[-2::-1]:
            sizes = F.when(string.rlike(pattern), log(size)).otherwise(sizes)
        learnt = F.aggregate(steps, F.lit(0.0), lambda s, t: s + F.get(table, t))
        uniform = F.aggregate(steps, F.lit(0.0), lambda s, t: s - F.get(table, t + SIDE**2)) - sizes * F.size(steps)
        total = F.greatest(learnt, uniform)
        return (total >= MIN_RATIO) & (total >= MIN_MEAN * F.size(steps))

    based = with_base_spans(docs)
    added = F.when((F.size("_runs") > 0) & F.lit(any(model)), F.filter("_runs", random)).otherwise(F.array().cast(_SPAN))
    added = _bare(added)
    return based.withColumn("_spans", F.array_sort(F.concat("_base", added)))


def listed(spans: str) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def redacted(docs: DataFrame, model: list[float], mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret replaced by ``mark``; overlapping spans are replaced as one. Other columns pass as they are."""
    carried = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    found = with_secrets(carried, model).select("row", "text", "_spans")
    found = _before(found, "_spans", lambda s: s["stop"], lambda a, b: F.greatest(a, b), "_reach")
    # A span that starts before an earlier one's end belongs to it.
    first = F.filter(
        F.zip_with("_spans", "_reach", lambda s, b: F.struct(b.alias("before"), s["start"].alias("start"))), lambda i: i["start"] >= i["before"]
    )
    found = found.withColumns({"_items": first, "_end": F.array_max(F.transform("_spans", lambda s: s["stop"]))})
    text = F.col("text")

    # The text between secrets is cut out of a chunk's own stretch, never out of the whole text.
    def stretch(chunk: Column) -> Column:
        low, high = F.get(chunk, F.lit(0))["before"], F.element_at(chunk, -1)["start"]
        return F.struct(chunk.alias("items"), low.alias("low"), F.substring(text, low + 1, high - low).alias("part"))

    def pieces(s: Column) -> Column:
        return F.transform(s["items"], lambda i: F.concat(F.substring(s["part"], i["before"] - s["low"] + 1, i["start"] - i["before"]), F.lit(mark)))

    body = F.array_join(F.flatten(F.transform(F.transform(_chunks("_items"), stretch), pieces)), "")
    whole = F.concat(body, F.substring(text, F.col("_end") + 1, F.length(text)))
    return found.withColumn("text", F.when(F.size("_spans") > 0, whole).otherwise(text)).select(
        F.col("row").withField("text", F.col("text")).alias("row")
    ).select("row.*")
