"""Secrets in texts: strong patterns, and weak candidates linked with their complementary parts.

Base kinds are found by pattern alone. Weak parts (a user or client name, a random-looking token,
an endpoint) say little by themselves; they are reported only when the parts that complete them
start within `scope` code points in the same document: a name needs a secret, a token needs an
identifier, an endpoint needs both. Access identifiers and base secrets count as such parts. The
parts meet in an interval join on (document, stretch of `scope` code points, role), so that no
document's parts are paired beyond one stretch and its neighbours. The matches, few beside the texts,
are written to the shared folder, so that the patterns run over the texts once.

Spans are code-point offsets, end exclusive. They come from the lengths of the matches and of the
gaps between them, summed by a window over the document's matches.

Defined cases: a null text is empty and has no spans (spans is ''); weak parts that overlap a base
span are dropped; `redact` passes other columns on, whatever their names; repeated rows (same doc_id and text) each get the same result; rows that share a
doc_id but not the text are told apart by a digest of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SCOPE = 200
#: kind: (pattern, group whose length counts, least length, role); fixed values of the contract for the base kinds.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "secret"),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20, "identifier"),
    "hex": (r"[0-9a-f]{24,}", 0, 24, "secret"),
    "user": (r"""(?i)\b(user(?:name)?|login|client_?id|account_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)""", 2, 2, "identifier"),
    "weak": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}", 0, 16, "secret"),
    "endpoint": (r"(?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!&*+,;=%-]+", 0, 8, "endpoint"),
}
BASE = ("assign", "access", "hex")
#: The characters of which the kinds without hints (access, hex, weak) have 16 in a row at least.
RUN = "[A-Za-z0-9+/_-]"
#: Literals of which a text must hold one, in lower case, for the pattern to match at all.
_HINTS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "user": ("user", "login", "client", "account"),
    "endpoint": ("://",),
}
NEEDS = {"user": ("secret",), "weak": ("identifier",), "endpoint": ("identifier", "secret")}
_ORDER = list(KINDS)


def _matches(kind: str) -> Column:
    """Array of (kind, i, gap before, length, ok) of the leftmost non-overlapping matches in text."""
    pattern, group, least, _ = KINDS[kind]
    text, like = F.col("text"), F.lit(pattern)
    gate = F.col("text").rlike(pattern)
    if kind in _HINTS:
        hints = [F.contains(F.col("small"), F.lit(h)) for h in _HINTS[kind]]
        gate = F.when(sum((h.cast("int") for h in hints), F.lit(0)) > 0, gate).otherwise(F.lit(False))
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, like, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, like, F.lit(group)).alias("value"),
    )
    rows = F.transform(
        F.filter(zipped, lambda x: x["hit"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(_ORDER.index(kind)).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"),
            F.length(x["hit"]).alias("len"), (F.length(x["value"]) >= least).alias("ok"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>")
    return F.when(gate, rows).otherwise(none)


def _keyed(docs: DataFrame, *keep: Column) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text), 256)
    return docs.select("doc_id", text.alias("text"), key.alias("key"), *keep)


def parts(docs: DataFrame) -> DataFrame:
    """(key, kind, start, end) of every match that is long enough, base and weak alike."""
    found = _keyed(docs).withColumn("small", F.lower("text"))
    each = found.select("key", F.explode(F.concat(*[_matches(k) for k in KINDS])).alias("m")).select("key", "m.*")
    once = each.groupBy("key", "kind", "i").agg(*[F.first(c).alias(c) for c in ("gap", "len", "ok")])
    so_far = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(so_far)
    return once.select("key", "kind", "len", "ok", end.alias("end")).where("ok").select(
        "key", "kind", (F.col("end") - F.col("len")).alias("start"), "end"
    )


def _stretches(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / SCOPE), F.floor(last / SCOPE)))


def _role(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(KINDS[k][3]) for k in KINDS]), kind + 1)


def linked(found: DataFrame) -> DataFrame:
    """The weak parts of found whose complementary parts co-occur and that overlap no base span."""
    base = found.where(F.col("kind") < len(BASE))
    weak = found.where(F.col("kind") >= len(BASE))
    spans = base.select(
        "key", F.col("start").alias("s"), F.col("end").alias("e"), _stretches(F.col("start"), F.col("end") - 1).alias("at")
    )
    inside = (
        weak.withColumn("at", _stretches(F.col("start"), F.col("end") - 1)).alias("w")
        .join(spans.alias("b"), (F.col("w.key") == F.col("b.key")) & (F.col("w.at") == F.col("b.at")) & (F.col("b.s") < F.col("w.end")) & (F.col("w.start") < F.col("b.e")), "left_semi")
        .select("key", "kind", "start").distinct()
    )
    free = weak.join(inside, ["key", "kind", "start"], "left_anti")
    need = F.explode(F.element_at(F.array(*[F.array(*[F.lit(r) for r in NEEDS[k]]) for k in _ORDER[len(BASE) :]]), F.col("kind") - len(BASE) + 1))
    wants = free.select("key", "kind", "start", "end", need.alias("role"), F.floor(F.col("start") / SCOPE).alias("at"))
    gives = (base.unionByName(free)).select(
        "key", F.col("start").alias("s"), _role(F.col("kind")).alias("role"),
        _stretches(F.greatest(F.lit(0), F.col("start") - SCOPE), F.col("start") + SCOPE).alias("at"),
    )
    met = wants.alias("w").join(
        gives.alias("g"),
        (F.col("w.key") == F.col("g.key")) & (F.col("w.at") == F.col("g.at")) & (F.col("w.role") == F.col("g.role"))
        & (F.abs(F.col("g.s") - F.col("w.start")) <= SCOPE),
        "left_semi",
    )
    needed = F.element_at(F.array(*[F.lit(len(NEEDS[k])) for k in _ORDER[len(BASE) :]]), F.col("kind") - len(BASE) + 1)
    return met.groupBy("key", "kind", "start", "end").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == needed).drop("n")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in _ORDER])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, key, base_spans and spans (arrays of start, kind, end), in order."""
    found = materialise(parts(docs), "secret-parts")
    all_spans = found.where(F.col("kind") < len(BASE)).unionByName(linked(found))
    span = F.struct("start", "kind", "end")
    by_doc = all_spans.groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    spans = F.coalesce("spans", none)
    return _keyed(docs).select("doc_id", "key").join(by_doc, "key", "left").select(
        "doc_id", "key", F.filter(spans, lambda x: x["kind"] < len(BASE)).alias("base_spans"), spans.alias("spans")
    )


def secrets_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    n = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == k)).cast("long")
    return scan_secrets(docs).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


def _may_match() -> Column:
    """Whether the column text may hold a match of any kind: a hint, or a run that the patterns without hints need."""
    out = F.col("text").rlike(f"{RUN}{{16}}")
    for hint in dict.fromkeys(h for hints in _HINTS.values() for h in hints):
        out = out | F.contains(F.lower("text"), F.lit(hint))
    return F.coalesce(out, F.lit(False))


def redact(docs: DataFrame, mark: str = "<SECRET>") -> DataFrame:
    """docs with every reported span replaced by mark; n_chars, if there, follows. All rows stay.

    Rows that cannot hold a match go through as they are; only the others meet the spans, in a join of
    the same kind at every size.
    """
    some = docs.where(_may_match())
    found = materialise(parts(some), "secret-parts")
    spans = found.where(F.col("kind") < len(BASE)).unionByName(linked(found))
    by_doc = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    # the spans grow with the documents, so they are never broadcast, however few there are here
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _keyed(some, row).join(by_doc.hint("shuffle_hash"), "key", "left")
    bounds = "array<struct<start:bigint,end:bigint>>"
    merged = F.aggregate(
        "spans",
        F.array().cast(bounds),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= x["start"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)),
                F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    text = F.col("text")
    # the one-element array binds the merged spans to a name, so that they are built once
    pieces = F.transform(
        F.array(merged),
        lambda m: F.concat(
            F.transform(m, lambda x, i: F.concat(text.substr(_after(m, i) + 1, (x["start"] - _after(m, i)).cast("int")), F.lit(mark))),
            F.array(text.substr(_after(m, F.size(m)) + 1, F.length(text))),
        ),
    )[0]
    clean = rows.select("row", F.when(F.col("spans").isNotNull(), F.array_join(pieces, "")).alias("clean"))
    changed = F.col("clean").isNotNull()
    fields = {c: F.col(f"row.`{c}`") for c in docs.columns}
    fields["text"] = F.coalesce("clean", fields["text"])
    if "n_chars" in fields:
        fields["n_chars"] = F.when(changed, F.length("clean")).otherwise(fields["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return docs.where(~_may_match()).unionByName(clean.select(*[x.alias(c) for c, x in fields.items()]))


def _after(spans: Column, i: Column) -> Column:
    return F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)).cast("int")
