"""Upserts as joins: a batch of rows is folded to one row a key, then merged with the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAST_LIMIT, LEAST_VOTES = 10, 20


def has_credits(raw: Column) -> Column:
    """The payload has the key, whatever its value."""
    return F.coalesce(F.array_contains(F.json_object_keys(raw), "credits"), F.lit(False))


def upsert_films(table: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    """Titles are overwritten by the last row of the batch; facts keep their last non-null value; a payload with credits is not replaced by one without."""
    titles, facts = ["title", "original_title"], ["year", "vote_average", "vote_count", "country"]
    all_rows = table.select("film_id", *titles, *facts, "raw", F.lit(None).cast("long").alias("_at")).unionByName(batch.select("film_id", *titles, *facts, "raw", F.col(order).cast("long").alias("_at")))
    at = F.coalesce("_at", F.lit(-1))
    last = [F.max_by(c, at).alias(c) for c in titles]
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in facts]
    raw = F.max_by("raw", F.when(F.col("raw").isNotNull(), F.struct(has_credits(F.col("raw")), at))).alias("raw")
    return all_rows.groupBy("film_id").agg(*last, *kept, raw)


def upsert_last(table: DataFrame, batch: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Last writer wins by key: people's names, resolutions (failures included)."""
    columns = [c for c in table.columns if c != key]
    rows = table.withColumn("_at", F.lit(-1).cast("long")).unionByName(batch.select(key, *columns, F.col(order).cast("long").alias("_at")))
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "_at").alias("r")).select(key, "r.*")


def insert_new(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch whose key the table lacks, one a key (the least row), added to the table."""
    rest = [c for c in table.columns if c not in keys]
    one = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else batch.select(*keys).distinct()
    return table.unionByName(one.join(table.select(*keys), keys, "left_anti").select(*table.columns))


def crew_credits(payloads: DataFrame) -> DataFrame:
    """film_id, person_id, name, department, job from payloads (film_id, p): whole entries only, one a (film, person, job), the first in the list."""
    rows = payloads.select("film_id", F.posexplode("p.credits.crew").alias("pos", "m")).select("film_id", "pos", F.col("m.id").alias("person_id"), F.col("m.name").alias("name"), F.col("m.department").alias("department"), F.col("m.job").alias("job"))
    whole = rows.dropna(subset=["person_id", "name", "department", "job"])
    return whole.groupBy("film_id", "person_id", "job").agg(F.min(F.struct("pos", "name", "department")).alias("f")).select("film_id", "person_id", F.col("f.name").alias("name"), F.col("f.department").alias("department"), "job")


def cast_credits(payloads: DataFrame, limit: int = CAST_LIMIT) -> DataFrame:
    """The top-billed cast as (Acting, Actor) credits, once a person."""
    rows = payloads.select("film_id", F.explode("p.credits.cast").alias("m")).select("film_id", F.col("m.id").alias("person_id"), F.col("m.name").alias("name"), F.col("m.order").alias("billing"))
    kept = rows.dropna(subset=["person_id", "name", "billing"]).filter(F.col("billing") < limit)
    return kept.groupBy("film_id", "person_id").agg(F.min("name").alias("name")).select("film_id", "person_id", "name", F.lit("Acting").alias("department"), F.lit("Actor").alias("job"))


def store_payload_credits(credits: DataFrame, people: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with a batch of payloads added: known people keep their names, known credits their rows."""
    new = crew_credits(payloads).unionByName(cast_credits(payloads))
    return insert_new(credits, new.select("film_id", "person_id", "department", "job"), ["film_id", "person_id", "job"]), insert_new(people, new.select("person_id", "name"), ["person_id"])


def placeholders(people: DataFrame, credits: DataFrame) -> DataFrame:
    """People with a made-up name for every credited person who is missing."""
    missing = credits.select("person_id").distinct().join(people, "person_id", "left_anti")
    return people.unionByName(missing.withColumn("name", F.concat(F.lit("person "), F.col("person_id").cast("string"))))


def delete_upload(table: DataFrame, upload_ids: DataFrame) -> DataFrame:
    """What stays of an upload-keyed table when uploads go: the cascade is this on every such table."""
    return table.join(upload_ids, "upload_id", "left_anti")


def genre_names(raw: Column) -> Column:
    """Names of ``genres`` in a JSON payload, in order, whatever else it holds."""
    parsed = F.from_json(raw, "genres array<struct<name:string>>")["genres"]
    return F.coalesce(F.transform(F.filter(parsed, lambda g: g["name"].isNotNull()), lambda g: g["name"]), F.array().cast("array<string>"))


def genre_ids_to_names(ids: Column, names: Column) -> Column:
    """Genre ids through a map of names; unknown ids go."""
    return F.filter(F.transform(ids, lambda i: F.try_element_at(names, i)), lambda n: n.isNotNull())


def person_filmography(person_credits: DataFrame, films: DataFrame, least_votes: int = LEAST_VOTES) -> tuple[DataFrame, DataFrame]:
    """New films and credits of people's filmographies: below-the-line roles, films with votes enough.

    ``person_credits``: person_id, film_id, title, original_title, release_date, vote_average, vote_count, department, job.
    """
    from tasteplane.functions.scalar import release_year
    from tasteplane.operators.roles import with_roles

    kept = with_roles(person_credits).filter(F.col("below_the_line") & (F.coalesce("vote_count", F.lit(0)) >= least_votes))
    facts = kept.groupBy("film_id").agg(F.min(F.struct("title", "original_title", release_year(F.col("release_date")).alias("year"), "vote_average", "vote_count")).alias("f")).select("film_id", "f.*")
    return facts.join(films.select("film_id"), "film_id", "left_anti"), kept.select("film_id", "person_id", "department", "job").distinct()
