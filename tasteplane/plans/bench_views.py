"""The driver's star schema seen as a taste domain, in Spark and (same definitions) as SQL text.

Parts are films, line items credit suppliers on parts and rate them for the market segment of
the order's customer, view events are the diary. Every segment is an upload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasteplane.operators import library
from tasteplane.operators.layout import PARTITIONS, set_partitions
from tasteplane.operators.roles import with_roles

CUT = "1999-01-01"
#: line items a partition: what a task holds is the same at any size of the tables
LINES_A_PARTITION = 1_000_000
# fixed values: line number -> department, job
LINE_JOBS = (
    (1, "Directing", "Director"), (2, "Editing", "Editor"), (3, "Camera", "Director of Photography"), (4, "Sound", "Original Music Composer"),
    (5, "Art", "Production Design"), (6, "Writing", "Screenplay"), (7, "Acting", "Actor"),
)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._held: dict[str, DataFrame] = {}
        self._partitions = 0

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def films(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("film_id"), F.col("p_name").alias("title"), (F.lit(1950) + F.col("p_size")).alias("year"),
            F.round((F.col("p_retailprice") - 900) / 10, 2).alias("vote_average"), F.pow(F.lit(10.0), F.col("p_partkey") % 5).cast("int").alias("vote_count"),
            F.col("p_brand").alias("country"), F.split("p_name", " ").alias("genres"),
        )

    def credits(self) -> DataFrame:
        jobs = F.broadcast(self.spark.createDataFrame(LINE_JOBS, "l_linenumber int, department string, job string"))
        # dealt by film, so neither this nor later steps by film deal credits again
        lines = self.table("lineitem").select("l_partkey", "l_suppkey", "l_linenumber").repartition(self._spread(), "l_partkey").distinct()
        return lines.join(jobs, "l_linenumber").select(F.col("l_partkey").alias("film_id"), F.col("l_suppkey").alias("person_id"), "department", "job")

    def ratings(self) -> DataFrame:
        """upload_id, film_id, rating, logged_date: each segment's first line item of a part. Built once for all its uses in a query."""
        return self._once("ratings", self._ratings)

    def library(self) -> DataFrame:
        return self._once("library", lambda: library.build_library(self.ratings(), self.films(), self.diary(), ["film_id"]))

    def film_credits(self) -> DataFrame:
        return self._once("film_credits", lambda: library.film_credits(self.ratings().select("film_id"), self.credits()))

    def all_credits(self) -> DataFrame:
        """film_id, role, person_id of every film, rated or not."""
        return self._once("all_credits", lambda: with_roles(self.credits()).select("film_id", "role", "person_id").distinct())

    def _spread(self) -> int:
        if not self._partitions:
            self._partitions = set_partitions(self.spark, self.table("lineitem").count() // LINES_A_PARTITION)
        return self._partitions

    def _once(self, name: str, make) -> DataFrame:
        """Kept, in partitions by film: as many as the line items ask for, known to the steps that read them."""
        if name not in self._held:
            made, conf = make(), self.spark.conf
            fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "false", PARTITIONS: str(self._spread())}
            before = {k: conf.get(k) for k in fixed}
            try:
                for k, x in fixed.items():
                    conf.set(k, x)
                self._held[name] = made.persist()
                self._held[name]._jdf.queryExecution().executedPlan()  # planned now, with these settings
            finally:
                for k, x in before.items():
                    conf.set(k, x)
        return self._held[name]

    def _ratings(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey").join(self.table("customer").select("c_custkey", F.col("c_mktsegment").alias("upload_id")), F.col("o_custkey") == F.col("c_custkey"))
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate", F.col("l_partkey").alias("film_id"))
        first = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).repartition("film_id").groupBy("upload_id", "film_id").agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate")).alias("f"))
        return first.select("upload_id", "film_id", (F.ceil(F.col("f.l_quantity") / 5) / 2).cast("double").alias("rating"), F.col("f.l_shipdate").cast("date").alias("logged_date"))

    def diary(self) -> DataFrame:
        """film_id, is_rewatch: of the views of a film all but the first."""
        views = self.table("events").filter("event_type = 'view'").select(F.get_json_object("props", "$.k").cast("long").alias("film_id"), "ts", "event_id")
        firsts = views.groupBy("film_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
        return views.join(firsts, "film_id").select("film_id", (F.struct("ts", "event_id") != F.col("first")).alias("is_rewatch"))

    def entries(self) -> DataFrame:
        """Ratings with a made-up resolution: film_id modulo 20 spreads the match methods."""
        m = F.col("film_id") % 20
        method = F.when(m == 0, "unresolved").when(m == 1, "television").when(m < 4, "trigram").when(m < 6, "dominant").otherwise("exact")
        rows = self.ratings().withColumn("match_method", method).withColumn("claimed", F.when(method.isin("unresolved", "television"), F.lit(None).cast("long")).otherwise(F.col("film_id") - F.when(m == 19, 1).otherwise(0)))
        titles = self.films().select("film_id", F.col("title").alias("name"))
        return rows.join(titles, "film_id").select("upload_id", F.col("film_id").alias("entry_id"), F.col("claimed").alias("film_id"), "name", "match_method", "rating", "logged_date")


FILM = """film AS (
  SELECT p_partkey AS film_id, p_name AS title, 1950 + p_size AS year, round((p_retailprice - 900) / 10, 2) AS vote_average,
    CAST(power(10, p_partkey % 5) AS INT) AS vote_count, p_brand AS country, string_split(p_name, ' ') AS genres FROM part)"""
CREDIT = """job AS (SELECT * FROM (VALUES (1, 'Directing', 'Director', 'director'), (2, 'Editing', 'Editor', 'editor'),
    (3, 'Camera', 'Director of Photography', 'cinematographer'), (4, 'Sound', 'Original Music Composer', 'composer'),
    (5, 'Art', 'Production Design', 'production_designer'), (6, 'Writing', 'Screenplay', 'writer'), (7, 'Acting', 'Actor', 'actor')) t(line, department, job, role)),
credit AS (SELECT DISTINCT l_partkey AS film_id, l_suppkey AS person_id, department, job, role FROM lineitem JOIN job ON l_linenumber = line)"""
RATING = """rating AS (
  SELECT upload_id, film_id, ceil(q / 5) / 2 AS rating, CAST(d AS DATE) AS logged_date FROM (
    SELECT c_mktsegment AS upload_id, l_partkey AS film_id, l_quantity AS q, l_shipdate AS d,
      row_number() OVER (PARTITION BY c_mktsegment, l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_shipdate) AS rn
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) WHERE rn = 1)"""
DIARY = """diary AS (
  SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS film_id,
    row_number() OVER (PARTITION BY json_extract_string(props, '$.k') ORDER BY ts, event_id) > 1 AS is_rewatch FROM events WHERE event_type = 'view')"""
LIBRARY = f"""{FILM}, {RATING}, {DIARY}, seen AS (
  SELECT film_id, CAST(count_if(is_rewatch) AS INT) AS rewatches FROM diary GROUP BY film_id),
library AS (
  SELECT r.upload_id, f.*, r.rating, r.logged_date, s.film_id IS NOT NULL AS in_diary, coalesce(s.rewatches, 0) AS rewatches,
    CASE WHEN s.film_id IS NOT NULL THEN r.rating + 0.25 * least(s.rewatches, 3) ELSE r.rating END::DOUBLE AS preference
  FROM rating r JOIN film f USING (film_id) LEFT JOIN seen s USING (film_id))"""
BASE = f"{LIBRARY}, {CREDIT}, lib_credit AS (SELECT upload_id, library.film_id, role, person_id FROM library JOIN credit USING (film_id))"
SIMPLE = """fit AS (
  SELECT upload_id, CASE WHEN count(vote_average) >= 2 AND min(vote_average) < max(vote_average) THEN regr_slope({y}, vote_average) ELSE 0 END AS slope,
    CASE WHEN count(vote_average) >= 2 AND min(vote_average) < max(vote_average) THEN regr_intercept({y}, vote_average) ELSE avg({y}) END AS intercept,
    avg({y}) AS fallback FROM {train} GROUP BY upload_id),
expected AS (SELECT l.*, CASE WHEN l.vote_average IS NULL THEN fallback ELSE intercept + slope * l.vote_average END AS expected FROM {rows} l JOIN fit USING (upload_id))"""


def simple(y: str = "rating", train: str = "library", rows: str = "library") -> str:
    return SIMPLE.format(y=y, train=train, rows=rows)


def effects(key: str = "role, person_id", family: str = "role", source: str = "lib_credit", name: str = "effect", expected: str = "expected") -> str:
    """CTEs that end in ``name``: shrunken effects of the groups ``key`` within ``family``."""
    on = " AND ".join(f"g.{c.strip()} = k.{c.strip()}" for c in ("upload_id, " + family).split(","))
    return f"""g_{name} AS (
  SELECT s.upload_id, {key}, count(*) AS n, avg(rating - expected) AS raw, var_pop(rating - expected) * count(*) AS ssw
  FROM {source} s JOIN {expected} e ON s.upload_id = e.upload_id AND s.film_id = e.film_id GROUP BY s.upload_id, {key}),
p_{name} AS (SELECT *, sum(n * raw) OVER (PARTITION BY upload_id, {family}) / sum(n) OVER (PARTITION BY upload_id, {family}) AS grand FROM g_{name}),
a_{name} AS (
  SELECT upload_id, {family}, sum(n)::DOUBLE AS total, count(*)::DOUBLE AS groups, sum(n * n)::DOUBLE AS squares, sum(ssw) AS ssw, sum(n * power(raw - grand, 2)) AS ssb
  FROM p_{name} GROUP BY upload_id, {family}),
k_{name} AS (
  SELECT *, CASE WHEN groups < 2 OR total <= groups OR (total - squares / total) / nullif(groups - 1, 0) <= 0 THEN 'inf'::DOUBLE
    WHEN ssw / (total - groups) <= 0 THEN 0
    ELSE (ssw / (total - groups)) / greatest((ssb / (groups - 1) - ssw / (total - groups)) / ((total - squares / total) / (groups - 1)), 1e-9) END AS k,
    CASE WHEN total > 1 THEN (ssw + ssb) / (total - 1) ELSE 0 END AS within FROM a_{name}),
{name} AS (
  SELECT g.upload_id, {", ".join(f"g.{c.strip()}" for c in key.split(","))}, g.n, g.raw, k.k, CASE WHEN isinf(k.k) THEN 0 ELSE g.raw * (g.n / (g.n + k.k)) END AS effect,
    CASE WHEN k.within > 0 THEN sqrt(k.within / g.n) ELSE 0 END AS stderr
  FROM g_{name} g JOIN k_{name} k ON {on})"""
