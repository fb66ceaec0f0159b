"""Matching of postings with material: role family, signals, ranked items, bullets and skills."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any, hits, matching, sentences, token
from ..sources.scratch import materialise, new_path, opened
from .matching import phrase_matches

#: Families with their keywords, and the other word lists of ranking: fixed values.
FAMILIES = {
    "ai_engineer": ("ai", "machine learning", "llm", "nlp", "rag", "artificial intelligence", "prompt"),
    "software_engineer": ("software", "backend", "api", "python", "django", "fastapi", "testing"),
    "data_scientist": ("data", "analytics", "sql", "scientist", "metrics", "dashboard"),
    "robotics_engineer": ("robotics", "ros2", "vision", "perception", "autonomous", "sensor"),
}
TITLE_BOOST = {
    "ai_engineer": ("ai", "machine learning", "artificial intelligence", "llm", "nlp"),
    "robotics_engineer": ("robotics", "ros2", "perception", "vision"),
}
FOCUS = {
    "production": "with a focus on reliable delivery",
    "testing": "with an emphasis on testing and debugging",
    "stakeholder": "to support stakeholder-facing decisions",
    "scale": "with attention to maintainability and scale",
    "workflow": "to support reproducible engineering workflows",
}
FOCUS_GUARDS = {
    "production": ("backend", "api", "workflow", "docker"),
    "testing": ("testing", "debug", "evaluation", "checks"),
    "stakeholder": ("dashboard", "report", "stakeholder", "analysis"),
    "scale": ("backend", "workflow", "module"),
    "workflow": ("workflow", "docker", "testing", "reproducibility"),
}
CONTEXT = (
    "team", "product", "workflow", "production", "reliability", "stakeholder", "internal", "tool", "engineering", "delivery",
    "maintain", "scale",
)
HIGH_VALUE = (
    "production", "reliability", "workflow", "internal", "tool", "engineering", "product", "delivery", "maintain", "scale",
)
BANNED = (
    "grow to their full potential", "all-time great companies", "that’s our promise", "competitive pay", "benefits include",
)
DEFAULT_FAMILY = "software_engineer"


def role_family(title: Column, body: Column, families: dict | None = None) -> Column:
    """The first family with the most points: 1 for a keyword in the body, 2 in the title, 6 for a boosted title.

    title and body are normalised already, and columns, as they are read once per keyword.
    """
    families = families or FAMILIES
    total = []
    for name, words in families.items():
        boost = F.when(contains_any(title, list(TITLE_BOOST.get(name, ()))), 6).otherwise(0)
        total.append(hits(body, list(words)) + 2 * hits(title, list(words)) + boost)
    names = F.array(*[F.lit(n) for n in families])
    # the one-element array binds the points to a name, so that they are computed once
    return F.transform(
        F.array(F.array(*total)),
        lambda s: F.when(F.array_max(s) > 0, F.element_at(names, F.array_position(s, F.array_max(s)).cast("int"))).otherwise(DEFAULT_FAMILY),
    )[0]


def context_sentences(description: Column | str, context=CONTEXT, high=HIGH_VALUE, banned=BANNED) -> Column:
    """Up to four of the first eight telling sentences, best first, ties in order of the text."""
    lowered = F.transform(sentences(description), lambda s: F.struct(s.alias("s"), F.lower(s).alias("low")))
    eligible = F.filter(
        lowered,
        lambda x: F.length(x["s"]).between(40, 240) & contains_any(x["low"], list(context)) & ~contains_any(x["low"], list(banned)),
    )
    scored = F.transform(
        F.slice(eligible, 1, 8),
        lambda x, i: F.struct((-(2 * hits(x["low"], list(high)) + hits(x["low"], list(context)))).alias("a"), i.alias("i"), x["s"].alias("s")),
    )
    return F.transform(F.slice(F.sort_array(scored), 1, 4), lambda x: x["s"])


def with_signals(jobs: DataFrame, families: dict | None = None) -> DataFrame:
    """Adds role_family, norm_body, matched_keywords (8 at most), focus_terms (4 at most) and company_focus.

    The normalised texts come out of a generator of one row, so that each is made once, not once per phrase.
    """
    families = families or FAMILIES
    body = token(F.concat_ws(" ", F.coalesce("position", F.lit("")), F.coalesce("description", F.lit(""))))
    texts = F.struct(token("position").alias("norm_title"), body.alias("norm_body"))
    base = jobs.drop("norm_title", "norm_body").select("*", F.inline(F.array(texts)))
    base = base.withColumn("role_family", role_family(F.col("norm_title"), F.col("norm_body"), families)).drop("norm_title")
    words = F.lit(None).cast("array<string>")
    for name, keys in families.items():
        words = F.when(F.col("role_family") == name, matching(F.col("norm_body"), list(keys))).otherwise(words)
    return base.withColumns(
        {
            "matched_keywords": F.slice(words, 1, 8),
            "focus_terms": F.slice(matching(F.col("norm_body"), list(FOCUS)), 1, 4),
            "company_focus": context_sentences("description"),
        }
    )


_BULLETS = "array<struct<text:string,norm:string>>"


def _texts(x: str) -> Column:
    return F.coalesce(F.col(x), F.array().cast("array<string>"))


def with_norms(materials: DataFrame) -> DataFrame:
    """materials with their tags and bullets normalised: norm_tags, norm_bullets and norm_variants (by family)."""
    both = lambda b: F.struct(b.alias("text"), token(b).alias("norm"))
    none = F.create_map().cast("map<string,array<string>>")
    return materials.withColumns(
        {
            "norm_tags": F.transform(_texts("tags"), lambda t: token(t)),
            "norm_bullets": F.transform(_texts("bullets"), both),
            "norm_variants": F.transform_values(F.coalesce("bullet_variants", none), lambda _, v: F.transform(v, both)),
        }
    )


def candidate_bullets(family: Column) -> Column:
    """A material item's bullets (text and norm) for a family, those written for it first."""
    own = F.coalesce(F.element_at("norm_variants", family), F.array().cast(_BULLETS))
    return F.concat(own, F.col("norm_bullets"))


def item_score() -> Column:
    """5 per tag in the body, 8 for a targeted role, 2 per bullet and matched keyword in it."""
    tags = F.size(F.filter("norm_tags", lambda t: F.contains(F.col("norm_body"), t)))
    target = F.when(F.array_contains(_texts("role_targets"), F.col("role_family")), 8).otherwise(0)
    pairs = F.aggregate(
        candidate_bullets(F.col("role_family")), F.lit(0),
        lambda acc, b: acc + F.size(F.filter("matched_keywords", lambda k: F.contains(b["norm"], k))),
    )
    return 5 * tags + target + 2 * pairs


def _per_kind(counts: dict[str, int]) -> Column:
    return F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in counts.items()], F.lit(0))


_ITEM = ("kind", "ord")


#: Entries of an index block: a task holds one block at a time, some twenty bytes an entry beside its distinct terms.
BLOCK_ENTRIES = 1 << 20


def _entries(jobs: DataFrame, materials: DataFrame) -> DataFrame:
    """(term, kind, ord, points): what an item gets from a posting that has the term.

    Terms are 't' and a tag, 'k' and a family's keyword, 'r' and a family. Every posting has the term '',
    and every item an entry for it, with its tags without letters, which are in every body.
    """
    words = jobs.select("role_family", F.explode("matched_keywords").alias("keyword")).distinct()  # of the word lists
    families = F.array(*[F.lit(r.role_family) for r in jobs.select("role_family").distinct().collect()], F.lit(""))  # those of the word lists
    tags = materials.select(F.explode("norm_tags").alias("tag"), *_ITEM).where("tag <> ''")
    by_tag = tags.select(F.concat(F.lit("t"), "tag").alias("term"), *_ITEM, F.lit(5).alias("points"))
    of_family = F.transform(families, lambda f: F.struct(f.alias("role_family"), candidate_bullets(f).alias("own")))
    held = materials.select(*_ITEM, F.inline(of_family)).join(F.broadcast(words), "role_family")
    n = F.size(F.filter("own", lambda b: F.contains(b["norm"], F.col("keyword"))))
    by_word = held.select(_keyword_term(F.col("role_family"), F.col("keyword")).alias("term"), *_ITEM, (2 * n).alias("points")).where("points > 0")
    targets = F.array_intersect(families, _texts("role_targets"))
    by_role = materials.select(F.explode(targets).alias("family"), *_ITEM).select(F.concat(F.lit("r"), "family").alias("term"), *_ITEM, F.lit(8).alias("points"))
    blank = F.size(F.filter("norm_tags", lambda t: t == ""))
    return by_tag.unionByName(by_word).unionByName(by_role).unionByName(materials.select(F.lit("").alias("term"), *_ITEM, (5 * blank).alias("points")))


def _first_of_equals(entries: DataFrame, keep: dict[str, int]) -> DataFrame:
    """The entries of the first `keep` items, by ord, of each kind among those that have the same entries."""
    pair = F.struct("term", "points")
    items = entries.groupBy(*_ITEM).agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    known = items.select(*_ITEM, "pairs", F.sha2(F.to_json("pairs"), 256).alias("same"))
    # partial lists of the first ones come before the shuffle, so that a set that all items share is no large group
    part = known.withColumn("part", F.spark_partition_id())
    for keys in (["kind", "same", "part"], ["kind", "same"]):
        part = part.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where(F.col("n") <= _per_kind(keep)).drop("n")
    return part.select(*_ITEM, F.inline("pairs"))


def _keyword_term(family: Column, keyword: Column) -> Column:
    return F.concat(F.lit("k"), family, F.lit("|"), keyword)


class _Block:
    """One block of the index: per term the items that have it, and their points."""

    def __init__(self, path: str):
        system, where = opened(path)
        there = system.get_file_info(where).type != fs.FileType.NotFound
        found = pq.read_table(where, filesystem=system, partitioning=None).to_pandas() if there else None
        self.kinds, self.ords, self.spans = np.empty(0, object), np.empty(0, np.int32), {}
        if there:
            item, items = pd.MultiIndex.from_frame(found[[*_ITEM]]).factorize(sort=True)
            self.kinds, self.ords = (items.get_level_values(k).to_numpy() for k in range(2))
            code, terms = pd.factorize(found["term"])
            order = np.argsort(code, kind="stable")
            bounds = np.searchsorted(code[order], np.arange(len(terms) + 1)).tolist()
            self.items, self.points = item[order], found["points"].to_numpy()[order]
            self.spans = dict(zip(terms, map(slice, bounds, bounds[1:])))

    def best(self, terms: list[str], keep: dict[str, int]) -> Iterator[tuple[str, int, int]]:
        """(kind, ord, score) of the block's best items of each kind, ties to the lower ord."""
        spans = [self.spans[t] for t in terms if t in self.spans]
        if not spans:
            return
        score = np.bincount(np.concatenate([self.items[s] for s in spans]), np.concatenate([self.points[s] for s in spans]), len(self.ords))
        for kind, n in keep.items():
            first, end = np.searchsorted(self.kinds, kind, "left"), np.searchsorted(self.kinds, kind, "right")
            size = int(end - first)
            if n and size:
                # one number per item: its score, then how early it stands
                rank = score[first:end].astype(np.int64) * size - np.arange(size)
                for k in np.argpartition(rank, max(size - n, 0))[max(size - n, 0) :]:
                    yield kind, self.ords[first + k], int(score[first + k])


@lru_cache(maxsize=1)
def _block(path: str) -> _Block:
    return _Block(path)


def sparse_scores(jobs: DataFrame, materials: DataFrame, keep: dict[str, int], key: str) -> DataFrame:
    """(key, kind, ord, item_score) of at least the best `keep` items of each kind for each job.

    A score is a sum over what a job and an item share: tags in the body, matched keywords, the role. The
    items are an index by these terms, in blocks of about BLOCK_ENTRIES entries in the shared folder, a pass
    of the jobs for each. A task adds up the entries of a job's terms and sends on the best of the block
    only, so that a tag of all items costs additions, never a row per job and item. Items of one kind with the
    same entries have the same score for every job, so that the index needs the first `keep` of them only; jobs
    with the same terms have the same best items, which are found once. materials: as `with_norms` gives them;
    (kind, ord) tells the items apart.
    """
    spark = jobs.sparkSession
    entries = materialise(_first_of_equals(_entries(jobs, materials), keep), "entries")
    blocks = entries.count() // BLOCK_ENTRIES + 1
    path = new_path(spark, "entry-blocks")
    of_item = F.pmod(F.xxhash64(*_ITEM), F.lit(blocks)).cast("int")
    entries.withColumn("block", of_item).repartition("block").write.partitionBy("block").parquet(path)
    tags = materials.select(F.explode("norm_tags").alias("phrase")).distinct()
    found = phrase_matches(jobs, tags, key, "norm_body").groupBy(key).agg(F.collect_list(F.concat(F.lit("t"), "phrase")).alias("found"))
    none = F.array().cast("array<string>")
    words = F.transform(F.coalesce("matched_keywords", none), lambda k: _keyword_term(F.col("role_family"), k))
    terms = F.concat(F.array(F.lit(""), F.concat(F.lit("r"), "role_family")), words, F.sort_array(F.coalesce("found", none)))
    of_job = materialise(jobs.join(found, key, "left").select(key, terms.alias("terms"), F.sha2(F.array_join(terms, "\x00"), 256).alias("terms_id")), "job-terms")
    asked = materialise(of_job.groupBy("terms_id").agg(F.first("terms").alias("terms")), "terms")

    def scored_by(block: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(k, *x) for k, terms in enumerate(b.column(1).to_pylist()) for x in _block(block).best(terms, keep)]
                at, kind, place, score = zip(*rows) if rows else [()] * 4
                columns = [b.column(0).take(pa.array(at, pa.int64())), pa.array(kind, pa.string()), pa.array(place, pa.int32()), pa.array(score, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["terms_id", *_ITEM, "item_score"])

        return run

    schema = "terms_id string, kind string, ord int, item_score int"
    found = reduce(DataFrame.unionByName, [asked.mapInArrow(scored_by(f"{path}/block={k}"), schema) for k in range(blocks)])
    order = Window.partitionBy("terms_id", "kind").orderBy(F.desc("item_score"), "ord")
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= _per_kind(keep)).drop("n")
    return of_job.select(key, "terms_id").join(best, "terms_id").drop("terms_id")


def bullet_score(norm: Column) -> Column:
    return 3 * F.size(F.filter("matched_keywords", lambda k: F.contains(norm, k))) + 2 * F.size(F.filter("focus_terms", lambda k: F.contains(norm, k)))


def rewrite_bullet(bullet: Column) -> Column:
    """The text of a bullet (text and norm) with the phrase of the first focus term that its words support."""
    text = F.trim(bullet["text"])
    fits = [F.when(contains_any(bullet["norm"], list(FOCUS_GUARDS[t])), F.lit(t)) for t in FOCUS]
    supported = F.array_compact(F.array(*fits))
    term = F.get(F.filter("focus_terms", lambda t: F.array_contains(supported, t)), F.lit(0))
    phrase = F.element_at(F.create_map(*[F.lit(x) for kv in FOCUS.items() for x in kv]), term)
    return F.when(phrase.isNull(), text).otherwise(F.concat(F.regexp_replace(text, r"\.+$", ""), F.lit(", "), phrase, F.lit(".")))


#: Materials up to which every job meets every item, by a broadcast; more meet by `sparse_scores`.
FEW_MATERIALS = 1_000


def rank_materials(jobs: DataFrame, materials: DataFrame, items: dict[str, int], bullets: dict[str, int], key: str = "seq") -> DataFrame:
    """The best material items per posting and kind, each with its best bullets rewritten.

    items, bullets: how many per kind. jobs: as `with_signals` gives them, with a unique key.
    """
    needed = jobs.select(key, "role_family", "norm_body", "matched_keywords", "focus_terms")
    normal = with_norms(materials)
    if materials.limit(FEW_MATERIALS + 1).count() <= FEW_MATERIALS:
        scored = needed.crossJoin(F.broadcast(normal)).withColumn("item_score", item_score())
    else:
        needed, normal = materialise(needed, "signals"), materialise(normal, "materials")
        scored = sparse_scores(needed, normal, items, key)
    order = Window.partitionBy(key, "kind").orderBy(F.desc("item_score"), "ord")
    best = scored.withColumn("item_rank", F.row_number().over(order)).where(F.col("item_rank") <= _per_kind(items))
    if "norm_body" not in best.columns:
        best = best.join(normal, [*_ITEM]).join(needed, key)
    ranked = F.sort_array(
        F.transform(candidate_bullets(F.col("role_family")), lambda b, i: F.struct((-bullet_score(b["norm"])).alias("a"), i.alias("i"), b.alias("b")))
    )
    chosen = F.transform(F.slice(ranked, 1, _per_kind(bullets)), lambda x: rewrite_bullet(x["b"]))
    return best.withColumn("selected_bullets", chosen).drop("norm_tags", "norm_bullets", "norm_variants")


def ordered_skills(skills: dict[str, list[str]], limit: int = 12) -> Column:
    """Array of (group, skills): the posting's family first; within a group those in the body first, then by name."""
    rows = []
    for i, (group, names) in enumerate((g, n) for g, n in skills.items() if n):
        keyed = F.array(*[F.struct(F.when(F.contains(F.col("norm_body"), token(F.lit(s))), 0).otherwise(1).alias("a"), F.lit(s.lower()).alias("l"), F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(names)])
        text = F.array_join(F.transform(F.slice(F.sort_array(keyed), 1, limit), lambda x: x["s"]), ", ")
        rows.append(F.struct(F.when(F.col("role_family") == group, -1).otherwise(i).alias("o"), F.lit(group).alias("group"), text.alias("skills")))
    return F.transform(F.sort_array(F.array(*rows)), lambda x: F.struct(x["group"].alias("group"), x["skills"].alias("skills")))


