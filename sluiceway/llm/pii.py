"""Personal data: identifiers by form, and more of them by bootstrapped context.

Emails, network addresses, card and phone numbers have a form of their own and are found by
pattern. They are the seeds, with the values that a label and their shape tell, like
``token = "24be64439e..."``: the words before them induce lexical patterns, and other words,
or runs of words, that look like identifiers are instances of the patterns they follow. Spark scores the graph
of patterns and instances in rounds. A pattern is worth the mean of its distinct
instances, each instance as much as the best pattern it follows; seeds are worth 1.
Patterns with enough different known instances and a high worth make their instances
known for the next round, but for single words that mostly stand before something else. No worth ever falls from round
to round, and the rounds go on until all worths together rise by less than a thousandth, so it does not matter how many
patterns lie between a seed and an instance. In the end all occurrences of known instances are spans. A short
instance is one of its own for each pattern, so it is a span only where it follows a good one.

All of this is DataFrame work on columns, without Python on the executors. Offsets count code
points. Patterns are written so that a long run of digits or letters is read once:
they give the matches of the plain forms in ``FORMS``, the leftmost and longest, without overlap.

Null text holds nothing, like empty text. Repeated rows, and rows of equal or null ids, have
spans of their own each, though an identifier that repeats counts once for a pattern. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.arrays import exclusive_sums
from sluiceway.llm.common import saved

# The kinds in their order, and the forms that tests compare with.
FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*FORMS, "id"]

# The same matches, each run read once. Cards leave out runs that are too short or too long.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": FORMS["phone"],
}
# Something each match holds; texts without it are not searched.
SIGNS = {"email": "@", "ip": ".", "phone": "+"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

SPACE = r"\x20\x09-\x0D"
# What may be an identifier; it starts and ends with a letter or digit. A run of up to ten groups, the first
# of them short, like +44 2079460958 or GB82 WEST 1234 5698; a word with a digit; or a word without one that
# holds @ or _, or is joined or long capitals, or changes between small letters and capitals twice.
OPEN = rf"(?<![^{SPACE}])"
OVER = rf"(?=[{SPACE},;:!?.'\"\]]|\Z)"
FIRST = r"(?:(?=[+(]{0,2}[A-Z0-9]{1,5}\)?\x20)[+(]{0,2}[A-Z]{0,4}[0-9][A-Z0-9]*+\)?|[A-Z]{2}(?=\x20[0-9]{2}\x20[0-9]))"
GROUP = rf"\x20(?:\(?[0-9](?:[A-Z0-9()-]|\.(?=[0-9]))*+|[A-Z]{{4}}(?=\x20[0-9])|[A-Z]){OVER}"
MARK = rf"[^{SPACE}A-Za-z0-9]*+"
SHAPES = [
    rf"[^{SPACE}]*[A-Za-z][@_]+[A-Za-z]",
    rf"{MARK}(?:[A-Z]++[-./:](?=[A-Z]))++[A-Z]++{MARK}(?![^{SPACE}])",
    rf"{MARK}[A-Z]{{6,}}+{MARK}(?![^{SPACE}])",
    rf"{MARK}[A-Za-z]*[a-z][A-Z][A-Za-z]*[a-z][A-Z]",
]
CANDIDATE = (
    rf"{OPEN}(?:{FIRST}(?:{GROUP}){{1,9}}+[^{SPACE}]*+|[^{SPACE}]*[0-9][^{SPACE}]*+"
    rf"|(?:{'|'.join(f'(?={shape})' for shape in SHAPES)})[^{SPACE}]++)"
)
CORE = r"[A-Za-z0-9](?:.*[A-Za-z0-9])?"
# Shorter instances are known per pattern.
LEAST_LENGTH = 6
# Context of an identifier: words before it, out of so many characters.
CONTEXT = 64
CONTEXT_WORDS = (1, 2)
# Matches before a match that hold so many words, whatever text is between.
BACK = max(CONTEXT_WORDS) + 1

# A value that is a seed by its label and shape: a long run of hexadecimal digits and letters behind a name and a
# sign, unless the name is that of a checksum.
LABEL = r"(?:^|[\s\"'{,(<])(?!(?:sha|md5|crc|commit|checksum|hash|digest|rev)[0-9a-z_-]*[\"']?\s?:?[=:]$)[\p{L}_][\p{L}0-9_.-]*[\"']?\s?:?[=:]$"
SECRET = r"^(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{16,}$"

# The rounds end when all worths together rise by less.
LEAST_RISE = 1e-3
# A pattern counts with so many different known instances and this worth.
SUPPORT = 5
WORTH = 0.8
# A pattern of one word stands before an instance at least so often.
SHARE = 0.1

SPAN = "struct<kind:string,start:int,end:int>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a number is right."""
    place = F.sequence(F.lit(1), F.length(digits))

    def worth(at: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - at + 1, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(at % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

    return F.aggregate(place, F.lit(0), lambda total, at: total + worth(at)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return luhn(_digits(value))
    return F.length(_digits(value)).between(9, 15)


def _found(text: Column, pattern: str) -> Column:
    """``value``, ``start`` and the text ``before`` (since the last match) of every match.

    What lies between the matches gives their places.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(values.alias("value"), F.slice(gaps, 1, F.size(values)).alias("before"))
    sums = exclusive_sums(
        F.transform(pairs, lambda p: (F.length(p["value"]) + F.length(p["before"])).cast("bigint"))
    )
    return F.zip_with(
        pairs,
        sums,
        lambda p, done: F.struct(
            p["value"].alias("value"),
            (done + F.length(p["before"])).cast("int").alias("start"),
            F.right(p["before"], F.lit(CONTEXT)).alias("before"),
        ),
    )


def _some(text: Column, pattern: str, sign: Column | None = None) -> Column:
    """``_found``, but an empty list at once where there is no match."""
    has = text.rlike(pattern) if sign is None else sign & text.rlike(pattern)
    none = F.lit(None).cast("array<struct<value:string,start:int,before:string>>")
    return F.coalesce(F.when(has, _found(text, pattern)).otherwise(none), F.array())


def spans_of(matches: Column, kind: str) -> Column:
    """The valid matches of a kind as spans."""
    valid = F.filter(matches, lambda m: _valid(kind, m["value"]))
    return F.transform(
        valid,
        lambda m: F.struct(
            F.lit(kind).alias("kind"),
            m["start"].alias("start"),
            (m["start"] + F.length(m["value"])).alias("end"),
        ),
    )


def _context(matches: Column, at: Column, before: Column) -> Column:
    """The words of the whole text before match ``at``: what is since the last match, and the matches before."""
    parts = []
    for back in range(BACK, 0, -1):
        match = F.get(matches, at - back)
        parts += [F.coalesce(match["before"], F.lit("")), F.coalesce(match["value"], F.lit(""))]
    whole = F.when(F.length(before) < CONTEXT, F.right(F.concat(*parts, before), F.lit(CONTEXT))).otherwise(before)
    opened = F.regexp_replace(whole, r"[(\[{<'\"]+$", "")
    return F.lower(F.trim(F.regexp_replace(opened, rf"[{SPACE}]+", " ")))


def _seeds(matches: Column, kind: str) -> Column:
    """The valid matches of a kind as instances with the words before them."""
    placed = F.transform(
        matches, lambda m, i: F.struct(m["value"].alias("value"), m["before"].alias("before"), i.alias("at"))
    )
    return F.transform(
        F.filter(placed, lambda m: _valid(kind, m["value"])),
        lambda m: F.struct(m["value"].alias("instance"), _context(matches, m["at"], m["before"]).alias("before")),
    )


def identifiers(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """By form alone: ``key``, ``spans`` by kind and start, and ``seeds`` and ``candidates`` for the contexts.

    A seed is the ``instance`` of a span and the words ``before`` it. A candidate, which overlaps no span, has
    these and its ``start`` and ``end``. With ``carry`` the whole row goes along as ``doc``.
    """
    kept = ["key", "doc"] if carry else ["key"]
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []
    docs = docs.select(
        F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *row
    )
    own = F.col("text")
    matches = {
        kind: _some(own, pattern, F.contains(own, F.lit(SIGNS[kind])) if kind in SIGNS else None)
        for kind, pattern in PATTERNS.items()
    }
    docs = docs.select(
        *kept, *[m.alias(kind) for kind, m in matches.items()], _some(own, CANDIDATE).alias("words")
    )
    spans = F.concat(*[spans_of(F.col(kind), kind) for kind in FORMS])
    seeds = F.concat(*[_seeds(F.col(kind), kind) for kind in FORMS])
    words = F.transform(
        "words",
        lambda w, i: F.struct(
            w["start"].alias("start"),
            w["value"].alias("value"),
            F.regexp_extract(w["value"], CORE, 0).alias("instance"),
            _context(F.col("words"), i, w["before"]).alias("before"),
        ),
    )
    words = F.filter(words, lambda w: w["instance"] != "")
    docs = docs.select(*kept, spans.alias("spans"), seeds.alias("seeds"), words.alias("words"))

    def placed(w: Column) -> Column:
        start = w["start"] + F.position(w["instance"], w["value"]) - 1
        end = start + F.length(w["instance"])
        return F.struct(
            start.cast("int").alias("start"),
            end.cast("int").alias("end"),
            w["instance"].alias("instance"),
            w["before"].alias("before"),
        )

    free = F.filter(
        F.transform("words", placed),
        lambda c: ~F.exists("spans", lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"])),
    )
    return docs.select(*kept, "spans", "seeds", free.alias("candidates"))


def _nodes(c: Column) -> Column:
    """The patterns that ``c`` follows, each with the instance that ``c`` is there."""
    words = F.split(c["before"], " ")
    patterns = F.array(
        *[F.when(F.size(words) >= n, F.array_join(F.slice(words, -n, n), " ")) for n in CONTEXT_WORDS]
    )
    # Signs alone are no context.
    patterns = F.filter(patterns, lambda p: p.isNotNull() & p.rlike(r"\p{L}"))
    short = F.length(c["instance"]) < LEAST_LENGTH
    return F.transform(
        patterns,
        lambda p: F.struct(
            p.alias("pattern"), F.when(short, F.concat(p, F.lit("\n"), c["instance"])).otherwise(c["instance"]).alias("instance")
        ),
    )


def labelled(c: Column) -> Column:
    """Whether a candidate is known by its label and shape alone."""
    return c["instance"].rlike(SECRET) & c["before"].rlike(LABEL)


def graph(found: DataFrame) -> DataFrame:
    """Edges between ``pattern`` (the words before) and ``instance``, and whether that is a ``seed``."""

    def all_of(column: str, seed: Callable[[Column], Column]) -> Column:
        return F.transform(
            column, lambda c: F.struct(c["instance"].alias("instance"), c["before"].alias("before"), seed(c).alias("seed"))
        )

    edges = found.select(
        F.explode(F.concat(all_of("seeds", lambda c: F.lit(True)), all_of("candidates", labelled))).alias("c")
    )
    edges = edges.select("c.seed", F.explode(_nodes(F.col("c"))).alias("node")).select("node.*", "seed")
    return edges.groupBy("pattern", "instance").agg(
        F.max(F.col("seed").cast("double")).alias("seed"), F.count("*").alias("times")
    )


def common_words(
    docs: DataFrame, edges: DataFrame, text: str = "text", support: int = SUPPORT, share: float = SHARE
) -> DataFrame:
    """Each ``pattern`` of one word that mostly stands before something else: no context, though cards may follow it."""
    used = edges.filter(~F.contains("pattern", F.lit(" "))).groupBy("pattern")
    used = used.agg(F.count("*").alias("instances"), F.sum("times").alias("times")).filter(F.col("instances") >= support)
    words = docs.select(F.explode(F.split(F.lower(F.col(f"`{text}`")), rf"[{SPACE}]+")).alias("pattern"))
    words = words.groupBy("pattern").agg(F.count("*").alias("everywhere"))
    return used.join(words, "pattern").filter(F.col("times") < share * F.col("everywhere")).select("pattern")


def bootstrap(
    edges: DataFrame,
    rounds: int | None = None,
    support: int = SUPPORT,
    worth: float = WORTH,
    common: DataFrame | None = None,
) -> DataFrame:
    """The known instances with their ``worth``, seeds with 1. Patterns in ``common`` make nothing known.

    Without ``rounds`` there are as many as it takes until the worths rise no more.
    """
    known = edges.groupBy("instance").agg(F.max("seed").alias("worth"))
    turn, before = 0, 0.0
    while rounds is None or turn < rounds:
        scores = edges.join(known, "instance").groupBy("pattern").agg(
            F.avg("worth").alias("score"), F.count_if(F.col("worth") > 0).alias("known")
        )
        good = scores.filter((F.col("known") >= support) & (F.col("score") >= worth)).select("pattern", "score")
        if common is not None:
            good = good.join(common, "pattern", "left_anti")
        known = edges.join(good, "pattern", "left").groupBy("instance").agg(
            F.greatest(F.max("seed"), F.coalesce(F.max("score"), F.lit(0.0))).alias("worth")
        )
        known = saved(known, f"instances-{turn}")
        total = known.agg(F.sum("worth")).first()[0] or 0.0
        if total - before < LEAST_RISE:
            break
        turn, before = turn + 1, total
    return known.filter("worth > 0")


def _all_spans(docs: DataFrame, key: str, text: str, carry: bool) -> DataFrame:
    """``identifiers`` with ``all``: the base spans and the discovered."""
    found = identifiers(docs, key, text, carry).withColumn("row", F.monotonically_increasing_id())
    found = saved(found, "identifiers")
    edges = saved(graph(found), "graph")
    known = bootstrap(edges, common=saved(common_words(docs, edges, text), "common-words"))
    # Long instances are known wherever they are, short ones by the patterns that they follow.
    new = found.select("row", F.explode("candidates").alias("c"))
    own = F.when(F.length("c.instance") < LEAST_LENGTH, F.transform(_nodes(F.col("c")), lambda node: node["instance"]))
    new = new.select("row", "c.start", "c.end", F.explode(own.otherwise(F.array("c.instance"))).alias("instance"))
    new = new.join(known, "instance")
    span = F.struct(F.lit("id").alias("kind"), "start", "end")
    # Written first: discoveries are few, and where Spark sees their size it need not move all rows to join them.
    new = saved(new.groupBy("row").agg(F.sort_array(F.collect_set(span)).alias("new")), "discovered")
    spans = F.concat("spans", F.coalesce("new", F.array().cast(f"array<{SPAN}>")))
    return found.join(new, "row", "left").withColumn("all", spans)


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its ``key``, the ``base`` spans found by form, and all ``spans``: these and the discovered."""
    found = _all_spans(docs, key, text, carry=False)
    return found.select(F.col("key").alias(key), F.col("spans").alias("base"), F.col("all").alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; spans that overlap give one."""
    by_start = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    nothing = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("parts"))

    def put(done: Column, span: Column) -> Column:
        gap = F.substr(text, done["end"] + 1, F.greatest(span["start"] - done["end"], F.lit(0)))
        parts = F.concat(done["parts"], F.array(gap, F.concat(F.lit("<"), span["kind"], F.lit(">"))))
        return F.struct(
            F.greatest(done["end"], span["end"]).alias("end"),
            F.when(span["start"] >= done["end"], parts).otherwise(done["parts"]).alias("parts"),
        )

    def joined(done: Column) -> Column:
        return F.concat(F.array_join(done["parts"], ""), F.substr(text, done["end"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(by_start, nothing, put, joined)).otherwise(text)


def masked(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with all spans masked, and the column ``length`` counted again where that changes a text."""
    found = _all_spans(docs, key, text, carry=True).select("doc", "all")
    found = found.withColumn("masked", mask(F.col(f"doc.`{text}`"), F.col("all")))
    columns = []
    for name in docs.columns:
        value = F.col(f"doc.`{name}`")
        if name == text:
            value = F.col("masked")
        elif name == length:
            counted = F.length("masked").cast(docs.schema[name].dataType)
            value = F.when(F.size("all") > 0, counted).otherwise(value)
        columns.append(value.alias(name))
    return found.select(*columns)


def listed(spans: Column) -> Column:
    """Spans as text: ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
