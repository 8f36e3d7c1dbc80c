"""Secret scans: named patterns, and entropy windows over candidate strings.

The patterns give the base spans. The method adds `entropy` spans: a candidate is a run of at least 20 characters of
keys and encodings. It is tested whole, and so is each of its parts between = / _ - + against its own class, so that a name or
path beside a secret does not change the secret's class; the parts are named where the whole is not. A window of 20 characters slides over it with one count per character; a step
raises the count of the character that enters, lowers that of the one that leaves, and moves the running sum of
c * log2(c) by these two changes only. The largest entropy of a window, log2(20) - sum / 20, is held against the
threshold of the text's character class. Base spans and allow-listed pieces take only what they cover out of a candidate;
what is left on both sides is tested by itself.

Everything is a projection of built-in functions: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferryload.llm.common import whole
from ferryload.llm.spans import no_places, places

# The given kinds in their order (kind, pattern, fewest characters, group that is counted).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = [("assign", ASSIGN, 6, 2), ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]{24,}", 24, 0)]

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# Character classes, tried in order (name, whole-string pattern, least entropy of a window in bits).
CLASSES = [("hex", r"^[0-9a-fA-F]+$", 3.0), ("alphanumeric", r"^[A-Za-z0-9]+$", 3.6), ("encoded", r"^[A-Za-z0-9+/_=-]+$", 3.8)]
# Shapes that are no secrets: without a digit or without a letter. Paths and dashed words have no long part.
ALLOWED = [r"^[^0-9]*$", r"^[^A-Za-z]*$"]
# Pieces that are taken out of a candidate: identifiers of the 8-4-4-4-12 form; dates; the alphabet or the digits in order;
# one character eight times or more.
PIECES = (r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])|(?<![0-9])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9])"
          r"|(?i:abcdefgh(?:ijklmnop(?:qrstuvwxyz)?)?)|0?12345678(?:90?)?|01234567|([A-Za-z0-9+/_=-])\1{7,}")
PURE = r"[A-Za-z0-9]{20,}"
LONG_PART = r"[A-Za-z0-9]{13}"


def _weight(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(text: Column, size: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits per character) of a window of ``size`` ASCII characters; 0 for shorter texts."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    steps = F.transform(codes, lambda c, i: F.struct(c.alias("into"), F.when(i >= size, F.get(codes, i - size)).otherwise(-1).alias("out"), i.alias("i")))
    counts = F.array_repeat(F.lit(0), 128)
    begin = F.struct(counts.alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))

    def step(state, s):
        same = s["into"] == s["out"]
        up = F.get(state["counts"], s["into"])
        down = F.when(s["out"] >= 0, F.get(state["counts"], s["out"])).otherwise(0)
        change = F.when(same, F.lit(0.0)).otherwise(_weight(up + 1) - _weight(up) + F.when(s["out"] >= 0, _weight(down - 1) - _weight(down)).otherwise(0.0))
        total = state["total"] + change
        moved = F.transform(state["counts"], lambda c, at: c + F.when(at == s["into"], 1).otherwise(0) - F.when(at == s["out"], 1).otherwise(0))
        entropy = F.when(s["i"] >= size - 1, F.log2(F.lit(float(size))) - total / size).otherwise(0.0)
        return F.struct(moved.alias("counts"), total.alias("total"), F.greatest(state["best"], entropy).alias("best"))

    return F.aggregate(steps, begin, step, lambda state: state["best"])


def suspicious(text: Column) -> Column:
    """Whether a candidate has a window over the threshold of its class and no allow-listed shape."""
    allowed = ~text.rlike(LONG_PART)
    for pattern in ALLOWED:
        allowed = allowed | text.rlike(pattern)
    least = F.lit(99.0)
    for _, pattern, bits in reversed(CLASSES):
        least = F.when(text.rlike(pattern), F.lit(bits)).otherwise(least)
    return F.when(allowed, F.lit(False)).otherwise(window_entropy(text) >= least)


def _moved(text: Column, pattern: str, by: Column) -> Column:
    """Places of a pattern in a piece of the text, as struct (start, end, body) in the whole text."""
    return F.zip_with(places(text, F.lit(pattern)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                      lambda p, body: F.struct((p["start"] + by).alias("start"), (p["end"] + by).alias("end"), body.alias("body")))


def _masked(text: Column, taken: Column) -> Column:
    """The text with blanks where places, ordered by start, are taken."""
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(state, p):
        start = F.greatest(p["start"], state["at"])
        end = F.greatest(p["end"], state["at"])
        between = F.substring(text, (state["at"] + 1).cast("int"), (start - state["at"]).cast("int"))
        return F.struct(end.alias("at"), F.concat(state["out"], between, F.repeat(F.lit(" "), (end - start).cast("int"))).alias("out"))

    return F.aggregate(taken, begin, step, lambda state: F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text))))


def base_places(text: Column, pattern: str, fewest: int, group: int) -> Column:
    """Matches of one kind whose counted group is long enough."""
    found = places(text, pattern)
    if group:
        sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda g: F.length(g))
        found = F.filter(F.zip_with(found, sizes, lambda p, n: F.when(n >= fewest, p)), lambda p: p.isNotNull())
    else:
        found = F.filter(found, lambda p: p["end"] - p["start"] >= fewest)
    return F.when(text.rlike(pattern), found).otherwise(no_places())


def _joined(marks: Column) -> Column:
    """kind:start:end by start, then by the order of the kinds."""
    ordered = F.array_sort(F.flatten(marks))
    return F.array_join(F.transform(ordered, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def _marked(found: Column, order: int, kind: str) -> Column:
    return F.transform(found, lambda p: F.struct(p["start"].alias("start"), F.lit(order).alias("rank"), p["end"].alias("end"), F.lit(kind).alias("kind")))


def secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    Null texts count as empty: no spans, the digest of the empty text. Repeated rows and null ids are carried; other
    columns are not looked at.
    """
    rows = docs.select("doc_id", whole("text").alias("text"))
    rows = rows.withColumns({kind: base_places(F.col("text"), pattern, fewest, group) for kind, pattern, fewest, group in KINDS})
    base = F.array_sort(F.concat(*[F.col(kind) for kind, *_ in KINDS]))
    rows = rows.withColumn("rest", F.when(F.col("text").rlike(CANDIDATE), F.when(F.size(base) > 0, _masked(F.col("text"), base)).otherwise(F.col("text"))))
    taken = F.when(F.col("rest").rlike(PIECES), _masked(F.col("rest"), places(F.col("rest"), PIECES))).otherwise(F.col("rest"))
    rows = rows.withColumn("rest", taken)
    rows = rows.withColumn("runs", F.when(F.col("rest").rlike(CANDIDATE), _moved(F.col("rest"), CANDIDATE, F.lit(0).cast("bigint"))))
    digit = lambda r: r["body"].rlike("[0-9]") & r["body"].rlike("[A-Za-z]")
    pure = lambda r: F.filter(_moved(r["body"], PURE, r["start"]), lambda p: digit(p) & suspicious(p["body"]))

    def named(r):
        return F.when(suspicious(r["body"]), F.array(r)).otherwise(pure(r))

    rows = rows.withColumn("found", F.flatten(F.transform(F.filter("runs", digit), named)))
    found = F.col("found")
    rows = rows.withColumn("entropy", F.coalesce(F.transform(found, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))), no_places()))
    marks = [_marked(F.col(kind), order, kind) for order, kind in enumerate([kind for kind, *_ in KINDS] + ["entropy"])]
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.array(*marks[:3])).cast("binary"), 256).alias("base_sha256"),
                       _joined(F.array(*marks)).alias("spans"), F.size("entropy").cast("long").alias("n_entropy"))
