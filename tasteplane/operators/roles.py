"""The role dimension: which (department, job) credits are modelled, as a small table to join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: role, department, jobs
ROLE_JOBS = (
    ("director", "Directing", ("Director",)),
    ("editor", "Editing", ("Editor",)),
    ("cinematographer", "Camera", ("Director of Photography", "Cinematography")),
    ("composer", "Sound", ("Original Music Composer", "Music", "Composer")),
    ("production_designer", "Art", ("Production Design", "Production Designer")),
    ("writer", "Writing", ("Screenplay", "Writer", "Screenwriter")),
    ("casting", "Production", ("Casting",)),
    ("playback_singer", "Sound", ("Playback Singer",)),
    ("sound_editor", "Sound", ("Supervising Sound Editor",)),
    ("sound_designer", "Sound", ("Sound Designer",)),
    ("costume_designer", "Costume & Make-Up", ("Costume Design",)),
    ("choreographer", "Crew", ("Choreographer",)),
    ("actor", "Acting", ("Actor",)),
)
CORE = ("editor", "cinematographer", "composer", "production_designer", "writer")
BELOW_THE_LINE = (*CORE, "casting", "playback_singer", "sound_editor", "sound_designer", "costume_designer", "choreographer")
ALL_ROLES = ("director", *BELOW_THE_LINE)
PRODUCT_ROLES = ("actor", *ALL_ROLES)


def role_dimension(spark: SparkSession) -> DataFrame:
    """department, job, role, ord, below_the_line: 19 rows by construction, so it is always broadcast."""
    order = {r: i for i, r in enumerate(PRODUCT_ROLES)}
    rows = [(d, j, r, order[r], r in BELOW_THE_LINE) for r, d, jobs in ROLE_JOBS for j in jobs]
    return F.broadcast(spark.createDataFrame(rows, "department string, job string, role string, ord int, below_the_line boolean"))


def with_roles(credits: DataFrame, keep_unmodelled: bool = False) -> DataFrame:
    """Credits with their role; unmodelled ones are dropped, or kept with a null role."""
    return credits.join(role_dimension(credits.sparkSession), ["department", "job"], "left" if keep_unmodelled else "inner")


def roles_present(credits: DataFrame) -> DataFrame:
    return with_roles(credits).groupBy("film_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
