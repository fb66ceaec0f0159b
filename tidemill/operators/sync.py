"""Planning of upserts into an external table: payloads and actions, without any effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedupe import last_wins
from .scoring import breakdown_text

#: Remote field kinds whose values take a form of their own; the rest pass as they are.
URL, SINGLE, MULTI, ATTACHMENT, CREATED = "Url", "SingleSelect", "MultiSelect", "Attachment", "CreatedTime"


def cell_text(cell: Column) -> Column:
    """The address in a remote cell: a text, or in an object or a list's first one a link before a text.

    cell: JSON; one that is null, no JSON, or of another kind has none.
    """

    def inside(v: Column, path: str) -> Column:
        link, text = (F.try_variant_get(v, f"${path}.{name}", "string") for name in ("link", "text"))
        return F.coalesce(F.nullif(link, F.lit("")), text, F.lit(""))

    def pick(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        return (
            F.when(kind == "STRING", F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))
            .when(kind.startswith("OBJECT"), inside(v, ""))
            .when(kind.startswith("ARRAY"), inside(v, "[0]"))
            .otherwise("")
        )

    # the one-element array binds the parsed cell to a name, so that it is parsed once
    return F.trim(F.transform(F.array(F.try_parse_json(cell)), pick)[0])


def _json(text: Column) -> Column:
    """A text as a JSON string."""
    return F.to_json(text.cast("variant"))


def remote_lookup(records: DataFrame, url_cell: str, seq: str) -> DataFrame:
    """(url, record_id): the last record of each address; records without one are left out."""
    rows = records.select(cell_text(F.col(url_cell)).alias("url"), "record_id", seq).where("url <> ''")
    return last_wins(rows, ["url"], seq).select("url", "record_id")


def plan_upserts(scored: DataFrame, remote: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """scored with the manifest's columns, record_id and action ('create' or 'update').

    manifest: (company, position, seq, ...), the last row of a pair counts.
    """
    out = scored
    if manifest is not None:
        latest = last_wins(manifest, ["company", "position"], "seq").drop("seq")
        out = out.join(latest, ["company", "position"], "left")
    out = out.join(remote, "url", "left")
    return out.withColumn("action", F.when(F.col("record_id").isNotNull(), "update").otherwise("create"))


def action_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


#: Values of a new record where the settings give none: fixed values.
DEFAULTS = {"status": "Need Review", "progress": ""}


def assemble(rows: DataFrame, fields: dict[str, str], defaults: dict[str, str] | None = None, paths: bool = True, key: str = "seq") -> DataFrame:
    """(key, field, value, number) of every value to be written for a scored row.

    fields: our name -> the remote field; company, position, url, status, progress and matching_score are
    always written, score_breakdown, resume_draft and cover_letter if they have a field. paths: write the
    documents' local paths where a row has documents. number: whether the value is a JSON number.
    """
    given = DEFAULTS | (defaults or {})
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    entry = lambda name, value, when=None, number=False: F.when(F.lit(True) if when is None else when, F.struct(
        F.lit(fields[name]).alias("field"), value.cast("string").alias("value"), F.lit(number).alias("number")))
    entries = [entry(n, text(n)) for n in ("company", "position", "url")]
    entries += [entry(n, F.lit(given[n])) for n in ("status", "progress")]
    entries.append(entry("matching_score", F.coalesce("matching_score", F.lit(0)), number=True))
    if fields.get("score_breakdown"):
        entries.append(entry("score_breakdown", breakdown_text()))
    if paths and "resume_path" in rows.columns:
        made = {"resume_draft": "resume_path", "cover_letter": "coverletter_path"}
        entries += [entry(n, F.col(c), F.col(c).isNotNull()) for n, c in made.items() if fields.get(n)]
    each = rows.select(key, F.explode(F.array_compact(F.array(*entries))).alias("e"))
    return each.select(key, "e.*")


def payload(values: DataFrame, fields: DataFrame, breakdown_field: str = "score_breakdown") -> DataFrame:
    """(row id columns, field, json) from values (..., field, value, and optionally number) by the kind of each remote field.

    fields: (field, ui_type). A field without definition passes as it is, but the breakdown is left
    out; an empty value is dropped for the kinds that need one; a created time is never written.
    """
    kinds = F.broadcast(fields) if fields.limit(1001).count() <= 1000 else fields
    joined = values.join(kinds, "field", "left")
    number = F.col("number") if "number" in values.columns else F.lit(False)
    kind = F.col("ui_type")
    shaped = (
        F.when(kind == URL, F.to_json(F.struct(F.col("value").alias("text"), F.col("value").alias("link"))))
        .when(kind == MULTI, F.to_json(F.array("value")))
        .when(number & ~F.coalesce(kind == SINGLE, F.lit(False)), F.to_json(F.try_parse_json("value")))
        .otherwise(_json(F.col("value")))
    )
    empty = (F.coalesce("value", F.lit("")) == "") | (number & (F.col("value") == "0"))
    wanted = F.when(kind.isNull(), F.col("field") != breakdown_field).otherwise(
        (kind != CREATED) & (~kind.isin(URL, SINGLE, MULTI, ATTACHMENT) | ~empty)
    )
    return joined.where(wanted).withColumn("json", shaped).drop("value", "ui_type", "number")


def records(shaped: DataFrame, key: str = "seq") -> DataFrame:
    """(key, payload): the shaped fields of each row as one JSON object, fields in order of name."""
    pair = F.struct("field", F.concat(_json(F.col("field")), F.lit(":"), "json").alias("text"))  # a handful per row
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["text"]), ",")
    return shaped.groupBy(key).agg(F.concat(F.lit("{"), joined, F.lit("}")).alias("payload"))
