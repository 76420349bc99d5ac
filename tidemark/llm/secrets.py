"""Operator 12: secrets in texts, by patterns and by the entropy of character windows. Built-in functions only.

Patterns give the base spans. Besides, every run of the characters of a class (`Entropy`) is a candidate: a window of fixed
width slides over it, and where the Shannon entropy of its characters reaches the class's threshold, the window is
reported; overlapping windows make one span. Candidates that an allow-list covers whole (words, numbers, UUIDs, checksums of
packages, alphabets) are left out; base spans never are.

Regular-expression functions tell matches but not places, so a text is taken apart into the gaps before its matches and
the matches themselves, and places are running sums of their lengths. A candidate's characters become rows. When a
character enters or leaves the window, the sum of c * log2(c) over the counts c changes by a difference that depends
on the one count that changes; a running sum of these differences gives the entropy of every window. It is taken in whole
numbers, so it is exact and independent of the order of work. All steps of a text are partitioned by its row: one
shuffle of matches and candidates, none of texts.

Rows: places are code points, end exclusive; a null text is empty and has no spans; a null id stays one; repeated rows are
scanned one by one; an empty table gives no rows. Other columns are left behind. Work grows with the text and with
the candidates' characters, whatever their length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """Matches of `regex`; if `group` is set, only those whose group has at least `least` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


@dataclass(frozen=True)
class Entropy:
    """Windows of characters of a class, written as in brackets, with at least `bits` of entropy a character."""

    kind: str
    characters: str
    bits: float

    def regex(self, width: int) -> str:
        return f"[{self.characters}]{{{width},}}"

    def most(self, width: int) -> int:
        """The largest sum of c * log2(c), in UNITs, that a window of enough entropy can have."""
        return math.floor(width * (math.log2(width) - self.bits) * UNIT)


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# The three kinds of base spans. A run of letters and digits that is too short fails as a whole, so the
# least length of the last two stands in the pattern; a failed assignment uses its text up, so that of the first does not.
ASSIGN = Pattern("assign", f"({either_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12)
ACCESS = Pattern("access", "AKIA[A-Z0-9]{14,}")
HEX = Pattern("hex", "[0-9a-f]{16,}")
PATTERNS = (ASSIGN, ACCESS, HEX)

#: One bit of c * log2(c) as a whole number.
UNIT = 1 << 20
CLASSES = (Entropy("entropy_hex", "0-9A-Fa-f", 3.0), Entropy("entropy_base64", "A-Za-z0-9+/_=-", 4.0))
#: Characters of a window.
WIDTH = 24
#: What a candidate may be as a whole without being a secret.
ALLOWED = (
    "[A-Za-z]+",
    "[0-9]+",
    "[a-z+/_=-]+",
    "[A-Z+/_=-]+",
    "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    "sha(1|256|384|512)-[A-Za-z0-9+/]+=*",
    "[A-Za-z0-9+/_=-]*(abcdefghijklm|ABCDEFGHIJKLM|0123456789)[A-Za-z0-9+/_=-]*",
)


def count_weights(width: int) -> list[int]:
    """c * log2(c) for the counts 0..width, in UNITs."""
    return [round(c * math.log2(c) * UNIT) if c else 0 for c in range(width + 1)]


def _found(text: Column, regex: str, number: int, p: Pattern | None) -> Column:
    """Array of (kind, k, gap, size, hit, told): the k-th match and the length of the gap before it; nothing where none occurs."""
    pattern = F.lit(regex)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    told = F.regexp_extract_all(text, pattern, F.lit(p.group)) if p is not None and p.group else hits
    zipped = F.arrays_zip(F.slice(F.split(text, regex, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), told.alias("told"))
    # the text of a match is needed only of candidates
    entry = lambda x, k: F.struct(
        F.lit(number).alias("kind"),
        k.alias("k"),
        F.length(x["gap"]).alias("gap"),
        F.length(x["hit"]).alias("size"),
        (F.lit(None).cast("string") if p is not None else x["hit"]).alias("hit"),
        (F.length(x["told"]) >= (p.least if p is not None else 0)).alias("ok"),
    )
    empty = F.from_json(F.lit("[]"), "array<struct<kind:int,k:int,gap:int,size:int,hit:string,ok:boolean>>")
    return F.when(text.rlike(regex), F.transform(zipped, entry)).otherwise(empty)


def _added(count: Column, width: int) -> Column:
    """What the count-th of equal characters adds to the sum of c * log2(c)."""
    w = count_weights(width)
    return F.element_at(F.array(*(F.lit(b - a).cast("long") for a, b in zip(w, w[1:], strict=False))), count.cast("int"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", patterns: tuple[Pattern, ...] = PATTERNS, classes: tuple[Entropy, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, width: int = WIDTH) -> DataFrame:
    """(doc_id, spans) of every row; spans: array of (start, kind, end) by start, then kind; kinds are numbered, patterns first."""
    base, number = len(patterns), dict(enumerate(classes, len(patterns)))
    found = [_found(F.col("text"), p.regex, k, p) for k, p in enumerate(patterns)] + [_found(F.col("text"), c.regex(width), k, None) for k, c in number.items()]
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hits = texts.select("row", "doc_id", F.explode_outer(F.concat(*found)).alias("h")).select("row", "doc_id", "h.*").repartition("row")

    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("k"))
    harmless = F.lit(False)
    for regex in allowed:
        harmless = harmless | F.col("hit").rlike(f"^({regex})$")
    kept = F.coalesce(F.when(F.col("kind") < base, F.col("ok")).otherwise(~harmless), F.lit(False))
    letters = F.when(kept & (F.col("kind") >= base), F.split("hit", ""))
    placed = hits.select("row", "doc_id", "kind", "size", end.alias("end"), kept.alias("kept"), letters.alias("letters"))
    chars = placed.select("row", "doc_id", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "kept", F.posexplode_outer("letters").alias("pos", "char"))

    equal = Window.partitionBy("row", "kind", "start", "char").orderBy("pos")
    along = Window.partitionBy("row", "kind", "start").orderBy("pos")
    chars = chars.select("*", F.count("*").over(equal.rangeBetween(1 - width, 0)).alias("in"), F.count("*").over(equal.rangeBetween(0, width - 1)).alias("out"))
    change = _added(F.col("in"), width) - F.coalesce(F.lag(_added(F.col("out"), width), width).over(along), F.lit(0))
    chars = chars.withColumn("change", F.when(F.col("char").isNotNull(), change))
    most = F.lit(None).cast("long")
    for k, c in number.items():
        most = F.when(F.col("kind") == k, F.lit(c.most(width))).otherwise(most)
    rich = (F.col("pos") >= width - 1) & (F.sum("change").over(along.rowsBetween(Window.unboundedPreceding, 0)) <= most)
    told = F.when(F.col("kind") < base, F.col("kept")).otherwise(F.coalesce(rich, F.lit(False)))
    marked = chars.select("row", "doc_id", "kind", "start", "end", "pos", told.alias("told"))

    # windows that overlap or touch are one span
    told_pos = F.when(F.col("told"), F.col("pos"))
    before = F.last(told_pos, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("told") & (before.isNull() | (F.col("pos") - before > width)), 1).otherwise(0)
    islands = marked.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.min(told_pos), F.max(told_pos)
    is_base = F.col("kind") < base
    each = islands.groupBy("row", "doc_id", "kind", "start", "end", "island").agg(F.max("told").alias("told"), first.alias("first"), last.alias("last"))
    span = F.struct(
        F.when(is_base, F.col("start")).otherwise(F.col("start") + F.col("first") - width + 1).cast("long").alias("start"),
        "kind",
        F.when(is_base, F.col("end")).otherwise(F.col("start") + F.col("last") + 1).cast("long").alias("end"),
    )
    return each.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("told"), span))).alias("spans")).drop("row")


def _line(spans_: Column, kinds: list[str]) -> Column:
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_digests(docs: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS, classes: tuple[Entropy, ...] = CLASSES, **options) -> DataFrame:
    """(doc_id, n_ of each pattern, base_sha256, spans): counts, a digest of the patterns' spans, and all spans as kind:start:end."""
    kinds = [p.kind for p in (*patterns, *classes)]
    found = spans(docs, patterns=patterns, classes=classes, **options)
    of = lambda number: F.size(F.filter("spans", lambda x: x["kind"] == number)).cast("long")
    counts = (of(k).alias(f"n_{p.kind}") for k, p in enumerate(patterns))
    base = F.filter("spans", lambda x: x["kind"] < len(patterns))
    return found.select("doc_id", *counts, F.sha2(_line(base, kinds), 256).alias("base_sha256"), _line(F.col("spans"), kinds).alias("spans"))
