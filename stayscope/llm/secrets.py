"""Secret scans with DataFrame functions only.

Base spans follow three patterns (assignments of passwords and keys, access keys, long hexadecimal runs). A
randomness battery adds spans of kind ``random``: runs of ``LEAST`` or more token characters with a digit and a letter. An
equals sign ends a run, unless it is padding. From its characters a run's encoding is inferred; a run that fits no alphabet
is replaced by its longest parts in each alphabet (``fitted``). Three statistics are tested against uniform draws
from that alphabet: chi-squared over the symbols, runs above and below the middle of the
alphabet, and lag-one serial correlation. A run that fails one of them (level ``REJECT``) is ordinary.

Passing is weak evidence for a short run, so passing is itself tested: ordinary tokens use their alphabet unevenly, with
``UNEVEN`` times the collisions of uniform draws, and the probability that such a token of this length looks as even
as the run does is its p-value (non-central chi-squared). Over all runs of the corpus, in bands of length, the
Benjamini-Hochberg rule bounds the share of ordinary ones among those reported by ``SHARE``. The rule needs only
counts of p-values in fixed bins, a table of constant size.

Positions are code points; ends are exclusive. They come from the lengths of matches and of the gaps between them, summed
in a window over one text's matches.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window, functions as F

from stayscope.session import materialise

# fixed values: the base patterns and their least lengths
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

LEAST = 16


def _runs(characters: str) -> str:
    """Pattern of the longest runs of these characters, with a digit and a letter, and the padding that ends the token.

    With the padding a run has ``LEAST`` characters or more; equals signs between two runs belong to neither.
    """
    one, any_ = f"[{characters}]", f"[={characters}]"
    return (
        rf"(?<!{one})(?={one}*[0-9])(?={one}*[A-Za-z])"
        rf"(?:{one}{{{LEAST},}}(?:=+(?!{any_}))?|(?={any_}{{{LEAST}}}){one}+=+(?!{any_}))"
    )


RANDOM = _runs("A-Za-z0-9+/_-")
KINDS = ("assign", "access", "hex", "random")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# encoding: pattern, alphabet, collisions of ordinary tokens over those of uniform draws
ENCODINGS = {
    "hex": ("^[0-9a-f]+$", DIGITS + "abcdef", 2.0),
    "upper_hex": ("^[0-9A-F]+$", DIGITS + "ABCDEF", 2.0),
    "base32": ("^[A-Z2-7]+$", UPPER + "234567", 2.0),
    "lower36": ("^[0-9a-z]+$", DIGITS + LOWER, 2.2),
    "upper36": ("^[0-9A-Z]+$", DIGITS + UPPER, 2.2),
    "base64": ("^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 2.6),
    "base64url": ("^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", 2.6),
}
REJECT = 0.001
SHARE = 0.01
BANDS = (20, 24, 32, 48, 96)
BINS = 400
BIN_WIDTH = 0.05


def _pieces(text: Column, pattern: str) -> Column:
    """Matches with the number of characters between each and the one before."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    zipped = F.arrays_zip(F.transform(gaps, lambda g: F.length(g)).alias("gap"), hits.alias("hit"))
    return F.when(F.size(hits) > 0, F.transform(zipped, lambda z: F.struct(z["gap"].alias("gap"), z["hit"].alias("hit"))))


def _placed(parts: DataFrame, *keys: str) -> DataFrame:
    """The ``keys`` columns, start, end and hit of ``parts`` (``keys``, place, piece), whose texts the keys tell apart."""
    before = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("piece.gap") + F.length("piece.hit")).over(before)
    return parts.withColumn("end", end.cast("bigint")).select(
        *keys, (F.col("end") - F.length("piece.hit")).cast("bigint").alias("start"), "end", F.col("piece.hit").alias("hit")
    )


def matches(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end, hit) of all matches in ``rows`` (row, pieces_<kind>...), kind as a number."""
    parts = None
    for number, kind in enumerate(KINDS):
        part = rows.select("row", F.lit(number).alias("kind"), F.posexplode(f"pieces_{kind}").alias("place", "piece"))
        parts = part if parts is None else parts.unionByName(part)
    found = _placed(parts, "row", "kind")
    value = F.length(F.regexp_extract("hit", ASSIGN, 2))
    return found.filter((F.col("kind") != 0) | (value >= ASSIGN_LEAST))


def _encoding(token: Column) -> Column:
    """The first encoding whose alphabet has all characters of ``token`` before its padding; null if none has."""
    found = F.lit(None).cast("string")
    for name, (pattern, _, _) in reversed(ENCODINGS.items()):
        found = F.when(F.regexp_replace(token, "=+$", "").rlike(pattern), F.lit(name)).otherwise(found)
    return found


def fitted(found: DataFrame) -> DataFrame:
    """``found`` (row, kind, start, end, hit) with each hit that fits no alphabet replaced by its longest runs in each alphabet.

    A part that is the longest run of several alphabets comes once.
    """
    known = found.withColumn("fits", _encoding(F.col("hit")).isNotNull())
    mixed, parts = known.filter(~F.col("fits")), None
    for number, (pattern, _, _) in enumerate(ENCODINGS.values()):
        pieces = _pieces(F.col("hit"), _runs(pattern[2:-3]))
        part = mixed.select("row", "kind", F.col("start").alias("from"), F.lit(number).alias("alphabet"), F.posexplode(pieces).alias("place", "piece"))
        parts = part if parts is None else parts.unionByName(part)
    inner = _placed(parts, "row", "kind", "from", "alphabet")
    inner = inner.select("row", "kind", (F.col("from") + F.col("start")).alias("start"), (F.col("from") + F.col("end")).alias("end"), "hit")
    return known.filter("fits").drop("fits").unionByName(inner.dropDuplicates(["row", "kind", "start", "end"]))


def _normal(z: Column) -> Column:
    """The normal distribution function, to about 1e-4."""
    bounded = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(-(1.5976 * bounded + 0.07056 * bounded * bounded * bounded)))


def _two_sided(z: Column) -> Column:
    return 2 * (1 - _normal(F.abs(z)))


def battery(tokens: DataFrame, token: str = "hit") -> DataFrame:
    """``tokens`` plus ``encoding``, ``p_even``, ``p_runs``, ``p_serial`` (against uniform draws) and ``p_ordinary``.

    The encoding is null, and so are all p-values, for a token that fits no alphabet.
    """
    body = F.regexp_replace(F.col(token), "=+$", "")

    def fixed(pick):
        return F.create_map(*chain.from_iterable((F.lit(n), F.lit(pick(v))) for n, v in ENCODINGS.items()))[F.col("encoding")]

    rows = tokens.withColumn("body", body).withColumn("encoding", _encoding(F.col(token)))
    rows = rows.withColumns({
        "alphabet": fixed(lambda v: v[1]), "halves": fixed(lambda v: "a" * (len(v[1]) // 2) + "b" * (len(v[1]) - len(v[1]) // 2)),
        "k": fixed(lambda v: float(len(v[1]))), "uneven": fixed(lambda v: v[2]), "n": F.length("body").cast("double"),
    })
    squares = F.aggregate(
        F.split("alphabet", ""), F.lit(0.0),
        lambda s, c: s + F.pow(F.when(c != "", F.length("body") - F.length(F.replace("body", c, F.lit("")))).otherwise(0), F.lit(2.0)),
    )
    rows = rows.withColumn("x", squares * F.col("k") / F.col("n") - F.col("n"))
    rows = rows.withColumn("sides", F.call_function("translate", F.col("body"), F.col("alphabet"), F.col("halves")))
    places = F.transform(F.split("body", ""), lambda c: F.call_function("locate", c, F.col("alphabet")) - 1)
    rows = rows.withColumn("places", F.filter(places, lambda p: p >= 0))
    n, k, x = F.col("n"), F.col("k"), F.col("x")

    def cube_root_normal(value, freedom):
        return (F.pow(value / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))

    low = n - F.length(F.replace(F.col("sides"), F.lit("a"), F.lit("")))
    turns = (2 * F.length("sides") - F.length(F.replace(F.col("sides"), F.lit("ab"), F.lit(""))) - F.length(F.replace(F.col("sides"), F.lit("ba"), F.lit("")))) / 2
    mean = 1 + 2 * low * (n - low) / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    middle = (k - 1) / 2
    products = F.aggregate(
        F.zip_with(F.slice("places", F.lit(1), F.size("places") - 1), F.slice("places", F.lit(2), F.size("places") - 1), lambda a, b: (a - middle) * (b - middle)),
        F.lit(0.0), lambda s, v: s + v,
    )
    shift = n * (F.col("uneven") - 1)
    scale, freedom = (k - 1 + 2 * shift) / (k - 1 + shift), F.pow(k - 1 + shift, F.lit(2.0)) / (k - 1 + 2 * shift)
    rows = rows.withColumns({
        "p_even": 1 - _normal(cube_root_normal(F.greatest(x, F.lit(0.0)), k - 1)),
        "p_runs": F.when(spread > 0, _two_sided((1 + turns - mean) / F.sqrt(spread))).otherwise(0.0),
        "p_serial": _two_sided(products / ((n - 1) * (k * k - 1) / 12) * F.sqrt(n - 1)),
        "p_ordinary": _normal(cube_root_normal(F.greatest(x, F.lit(0.0)) / scale, freedom)),
    })
    return rows.drop("body", "alphabet", "halves", "k", "uneven", "n", "x", "sides", "places")


def _band(size: Column) -> Column:
    return sum(((size >= edge).cast("int") for edge in BANDS), F.lit(0))


def thresholds(tested: DataFrame, share: float = SHARE) -> dict[int, float]:
    """The largest p-value that each length band reports, by the step-up rule over binned counts of all runs."""
    bin_number = F.least(F.floor(-F.log10("p_ordinary") / BIN_WIDTH), F.lit(BINS)).cast("int")
    counts: dict[int, dict[int, int]] = {}
    for r in tested.groupBy("band", bin_number.alias("bin")).count().collect():  # at most bands x bins rows
        counts.setdefault(r["band"], {})[r["bin"]] = r["count"]
    out = {}
    for band, bins in counts.items():
        total, below, best = sum(bins.values()), 0, 0.0
        for number in sorted(bins, reverse=True):
            below += bins[number]
            upper = 10 ** (-number * BIN_WIDTH)
            if upper <= share * below / total:
                best = upper
        out[band] = best
    return out


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): ``rows`` has ``row`` and the ``keep`` columns of every text, ``spans`` (row, kind, start, end).

    A null text is an empty one, and has no spans. Repeated rows are scanned each. An empty table gives no rows.
    Both results are written tables, so that the numbers of the rows hold.
    """
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, RANDOM)))
    rows = materialise(docs.select(
        F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`") for c in keep],
        *[_pieces(value, pattern).alias(f"pieces_{kind}") for kind, pattern in patterns.items()],
    ), "secret-scan")
    found = materialise(matches(rows), "secret-matches")
    base = found.filter(F.col("kind") < 3)
    tested = battery(fitted(found.filter(F.col("kind") == 3)))
    even = (F.col("p_even") >= REJECT) & (F.col("p_runs") >= REJECT) & (F.col("p_serial") >= REJECT)
    # a run that fails counts among the tested with p = 1
    tested = tested.withColumn("p_ordinary", F.when(even, F.col("p_ordinary")).otherwise(1.0))
    tested = materialise(tested.withColumn("band", _band(F.length("hit"))).select("row", "kind", "start", "end", "band", "p_ordinary"), "secret-tests")
    limits = thresholds(tested)
    limit = F.lit(0.0)
    for band, value in limits.items():
        limit = F.when(F.col("band") == band, value).otherwise(limit)
    # parts of one run in different alphabets may hold each other: the outer one is reported
    wider = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    passed = tested.filter(F.col("p_ordinary") <= limit).select("row", "kind", "start", "end", F.max("end").over(wider).alias("reach"))
    passed = passed.filter(F.col("end") > F.coalesce("reach", F.lit(0))).drop("reach")
    # a run that meets a base span is reported already
    both = base.select("row", "kind", "start", "end").unionByName(passed)
    ordered = Window.partitionBy("row").orderBy("start", "end", "kind")
    before = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("kind") < 3, F.col("start"))).over(ordered.rowsBetween(1, Window.unboundedFollowing))
    kept = both.withColumns({"before": before, "after": after}).filter(
        (F.col("kind") < 3) | ((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end")))
    )
    return rows.select("row", *[F.col(f"`{c}`") for c in keep]), kept.select("row", "kind", "start", "end")


def span_table(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row the id, the number of spans of each base kind, ``base`` and ``spans`` (kind:start:end, comma-joined)."""
    rows, spans = scan(docs, text, (id_column,))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    written = F.concat_ws(":", name, "start", "end")
    entry = F.struct("start", "kind", "end", written.alias("written"))
    grouped = spans.groupBy("row").agg(
        *[F.sum((F.col("kind") == number).cast("bigint")).alias(f"n_{kind}") for number, kind in enumerate(KINDS)],
        F.sort_array(F.collect_list(entry)).alias("entries"),
    )
    joined = rows.join(grouped, "row", "left")
    base = F.filter("entries", lambda e: e["kind"] < 3)
    return joined.select(
        F.col(f"`{id_column}`"), *[F.coalesce(f"n_{kind}", F.lit(0)).cast("bigint").alias(f"n_{kind}") for kind in KINDS],
        F.coalesce(F.array_join(F.transform(base, lambda e: e["written"]), ","), F.lit("")).alias("base"),
        F.coalesce(F.array_join(F.transform("entries", lambda e: e["written"]), ","), F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", length_column: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans are replaced together. All rows stay.

    ``length_column``, if given, gets the new number of characters where a text changed. Texts without spans,
    null texts included, stay as they are.
    """
    number, given = "_scan_row", docs.columns
    numbered = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "secret-rows")
    rows, spans = scan(numbered, text, (number,))
    ordered = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("island", F.sum((F.col("start") >= F.coalesce(reach, F.lit(0))).cast("int")).over(ordered))
    merged = islands.groupBy("row", "island").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    cuts = merged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_cuts"))
    cuts = rows.join(cuts, "row").select(number, "_cuts")
    joined = numbered.join(cuts.hint("merge"), number, "left")  # the same join at every size
    value, spots = F.col(f"`{text}`"), F.col("_cuts")
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spots, lambda c: c["b"]))
    ends = F.concat(F.transform(spots, lambda c: c["a"]), F.array(F.length(value).cast("bigint")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substr(value, (a + 1).cast("int"), (b - a).cast("int")))
    new = F.when(spots.isNull(), value).otherwise(F.array_join(pieces, mark))
    gone = F.aggregate(spots, F.lit(0).cast("bigint"), lambda total, c: total + c["b"] - c["a"])
    size = F.length(value) - gone + F.size(spots) * len(mark)
    columns = []
    for name in given:
        column = F.col(f"`{name}`")
        if name == text:
            column = new
        elif name == length_column:
            column = F.when(spots.isNull(), column).otherwise(size).cast(docs.schema[name].dataType)
        columns.append(column.alias(name))
    return joined.select(*columns)
