"""Secret scans with multipart credential linking, in DataFrame operations only.

Base kinds (assign, access, hex) are reported wherever they match. Weak candidates are identifiers, secrets and
endpoints that alone are often harmless; one is reported only where complementary parts stand within SCOPE characters
of it in the same text: a weak identifier beside a secret, a weak secret beside an identifier, an endpoint beside both.
Base access spans count as identifiers, base assign and hex spans as secrets.

All matches of a pattern are placed by splitting the text at it: a match starts where the pieces and matches before it
end, so positions are code points and need no Python. The linking is an interval join on cells of SCOPE characters,
in which the parts of a role are first reduced to the least start and the greatest end of each cell; so no pairs of a
crowded text are made, and the answer is exact.

Cases: a null text counts as empty; an empty text has no spans; repeated rows give repeated results (texts are scanned
once for each row, and spans are placed once for each distinct doc_id and text); a null doc_id is kept; other columns
are not read by scan() and passed through by redact().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.session import cut

SCOPE = 200
#: The base patterns, with the least length of what they match (assign: of its second group).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGN = 12
#: Patterns of weak candidates.
IDENTIFIER = r"""\b(?:ASIA|AIDA|AROA|ABIA|ACCA)[A-Z0-9]{12,}|(?i:\b(?:client_id|access_key_id|account_id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,})"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""[a-z][a-z0-9+.]{1,15}://[^\s"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.])"""
#: name, pattern, role
KINDS = (
    ("assign", ASSIGN, "secret"),
    ("access", ACCESS, "identifier"),
    ("hex", HEX, "secret"),
    ("identifier", IDENTIFIER, "identifier"),
    ("secret", WEAK_SECRET, "secret"),
    ("endpoint", ENDPOINT, "endpoint"),
)
BASE = 3
MASK = "[SECRET]"
KEY = ["k1", "k2"]


def _key(df: DataFrame) -> DataFrame:
    """Two 64-bit hashes of doc_id and text; rows that agree in both get the same spans."""
    return df.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(7), "text", "doc_id")})


def _matches(text: Column, pattern: str) -> Column:
    """Lengths of the pieces between matches, and the matches; null where there are none."""
    found = F.struct(
        F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("texts"),
    )
    return F.when(text.rlike(pattern), found)


def _parts(found: DataFrame) -> DataFrame:
    """A row for each match: key, kind, start, end."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(name).alias("found")) for k, (name, _, _) in enumerate(KINDS)))
    rows = found.dropDuplicates(KEY).select(*KEY, F.explode(kinds).alias("x")).where("x.found IS NOT NULL")
    rows = rows.select(*KEY, "x.kind", F.posexplode(F.arrays_zip("x.found.texts", F.slice("x.found.gaps", F.lit(1), F.size("x.found.texts")).alias("gaps"))).alias("at", "m"))
    rows = rows.select(*KEY, "kind", "at", F.col("m.texts").alias("match"), F.col("m.gaps").cast("long").alias("gap"), F.length("m.texts").cast("long").alias("n"))
    until = Window.partitionBy(*KEY, "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(until))
    value = F.length(F.regexp_extract("match", f"^{ASSIGN}", 2))
    return rows.where((F.col("kind") != 0) | (value >= LEAST_ASSIGN)).select(*KEY, "kind", (F.col("end") - F.col("n")).alias("start"), "end")


def _linked(parts: DataFrame) -> DataFrame:
    """The weak candidates that stand beside complementary parts."""
    base = F.col("kind") < BASE
    # Both frames grow row by row, forwards and backwards: a frame up to the end would be read anew for every row.
    so_far = Window.partitionBy(*KEY).orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*KEY).orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    clear = parts.withColumns({"last": F.max(F.when(base, F.col("end"))).over(so_far), "next": F.min(F.when(base, F.col("start"))).over(ahead)})
    # A weak candidate that overlaps a base span is that span.
    clear = clear.where(base | (F.coalesce(F.col("last") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))))
    role = F.element_at(F.array(*(F.lit(r) for _, _, r in KINDS)), F.col("kind") + 1)
    clear = clear.select(*KEY, "kind", "start", "end", role.alias("role"))
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / SCOPE), F.floor(high / SCOPE)))
    by_cell = (
        clear.withColumn("cell", cells(F.col("start"), F.col("end")))
        .groupBy(*KEY, "cell")
        .agg(*(f(F.when(F.col("role") == r, F.col(c))).alias(f"{r}_{c}") for r in ("identifier", "secret", "endpoint") for f, c in ((F.min, "start"), (F.max, "end"))))
    )
    weak = clear.where(~base).withColumn("cell", cells(F.greatest(F.col("start") - SCOPE, F.lit(0)), F.col("end") + SCOPE))
    near = lambda r: F.coalesce((F.col(f"{r}_end") >= F.col("start") - SCOPE) & (F.col(f"{r}_start") <= F.col("end") + SCOPE), F.lit(False))
    beside = weak.join(by_cell, [*KEY, "cell"]).groupBy(*KEY, "kind", "start", "end", "role").agg(*(F.max(near(r)).alias(f"by_{r}") for r in ("identifier", "secret")))
    needs = F.when(F.col("role") == "identifier", F.col("by_secret")).when(F.col("role") == "secret", F.col("by_identifier")).otherwise(F.col("by_secret") & F.col("by_identifier"))
    return beside.where(needs).select(*KEY, "kind", "start", "end")


def scan(documents: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """(a row for each document: the carried columns, k1, k2, hit; a row for each span of distinct documents: k1, k2, kind, start, end).

    Each text is scanned once: the matches, and what the caller carries along, are written and read again. hit says
    whether the text has any match, reported or not. documents must have no columns but doc_id, text and the carried.
    """
    text = F.coalesce("text", F.lit(""))
    found = cut(_key(documents).select(*carried, *KEY, *(_matches(text, p).alias(name) for name, p, _ in KINDS)))
    hit = reduce(lambda a, b: a | b, (F.col(name).isNotNull() for name, _, _ in KINDS))
    parts = cut(_parts(found.where(hit)))
    return found.select(*carried, *KEY, hit.alias("hit")), parts.where(F.col("kind") < BASE).unionByName(_linked(parts))


def op9_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans as one string."""
    rows, spans = scan(documents.select("doc_id", "text"), ["doc_id"])
    name = F.element_at(F.array(*(F.lit(k) for k, _, _ in KINDS)), F.col("kind") + 1)
    spans = spans.select(*KEY, "kind", F.struct("start", "kind", F.concat_ws(":", name, F.col("start"), F.col("end")).alias("s")).alias("x"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(c), lambda x: x["s"]), ",")
    of = spans.groupBy(*KEY).agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k][0]}") for k in range(BASE)),
        joined(F.collect_list(F.when(F.col("kind") < BASE, F.col("x")))).alias("base"),
        joined(F.collect_list("x")).alias("spans"),
    )
    out = rows.where("hit").join(of, KEY, "left").unionByName(rows.where("NOT hit"), allowMissingColumns=True)
    return out.select(
        "doc_id",
        *(F.coalesce(f"n_{KINDS[k][0]}", F.lit(0)).cast("long").alias(f"n_{KINDS[k][0]}") for k in range(BASE)),
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(documents: DataFrame) -> DataFrame:
    """The documents with each reported span, or run of overlapping spans, replaced by MASK; no row goes."""
    own = documents.columns
    # The caller's columns travel in one struct, so none of their names can clash with those used here.
    rows, spans = scan(documents.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), "doc_id", "text"), ["row"])
    order = Window.partitionBy(*KEY).orderBy("start", "end")
    islands = spans.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(order)).groupBy(*KEY, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = islands.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    text = F.col("row.text")
    end, start = (lambda k: F.coalesce(F.get("cuts", k)["end"], F.lit(0)).cast("int")), (lambda k: F.coalesce(F.get("cuts", k)["start"], F.length(text).cast("long")).cast("int"))
    clean = F.array_join(F.transform(F.sequence(F.lit(0), F.size("cuts")), lambda k: F.substring(text, end(k - 1) + 1, start(k) - end(k - 1))), MASK)
    # Only texts with matches meet the spans: clean ones are not shuffled.
    hit = rows.where("hit").join(cuts, KEY, "left").select("row", F.when(F.col("cuts").isNotNull(), clean).otherwise(text).alias("text"))
    out = hit.unionByName(rows.where("NOT hit").select("row", text.alias("text")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*((new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in own))
