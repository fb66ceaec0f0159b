"""Record types. Text is never null after ingest; dates stay ISO text."""

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


POSTING = T.StructType(
    [
        *_strings("company", "position", "url", "date", "location", "source", "description"),
        T.StructField("easy_apply", T.BooleanType()),
        *_strings("search_keyword", "job_id"),
    ]
)
_TEXTS = T.ArrayType(T.StringType())
BREAKDOWN = T.StructType(
    [
        T.StructField("role_track_fit", T.IntegerType()),
        T.StructField("best_track", T.StringType()),
        T.StructField("evidence_skill_fit", T.IntegerType()),
        T.StructField("evidence_groups", _TEXTS),
        T.StructField("seniority_training_fit", T.IntegerType()),
        T.StructField("delivery_workflow_fit", T.IntegerType()),
        T.StructField("visa_work_auth_fit", T.IntegerType()),
        T.StructField("visa_bucket", T.StringType()),
        T.StructField("application_effort_bonus", T.IntegerType()),
        T.StructField("unsupported_stack_penalty", T.IntegerType()),
        T.StructField("unsupported_stack_flags", _TEXTS),
        T.StructField("experience_penalty", T.IntegerType()),
        T.StructField("risk_penalty", T.IntegerType()),
        T.StructField("risk_flags", _TEXTS),
    ]
)
MANIFEST = T.StructType(
    [
        *_strings("company", "position", "resume_path", "coverletter_path", "resume_pdf_path", "coverletter_pdf_path"),
        T.StructField("matching_score", T.IntegerType()),
        T.StructField("selected_projects", _TEXTS),
    ]
)
#: A line of experience or a project, for tailoring documents.
MATERIAL = T.StructType(
    [
        *_strings("kind", "id", "name", "title", "location", "date_range", "repo_url"),
        T.StructField("tags", _TEXTS),
        T.StructField("bullets", _TEXTS),
        T.StructField("bullet_variants", T.MapType(T.StringType(), _TEXTS)),
        T.StructField("role_targets", _TEXTS),
        T.StructField("ord", T.IntegerType()),
    ]
)
