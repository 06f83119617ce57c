"""A workspace of tables in one folder, and a command for every step from an export to recommendations.

    python -m tasteplane.app FOLDER COMMAND [arguments]

Each command is a method that returns DataFrames; the command line shows them.
"""

from __future__ import annotations

import argparse
import inspect
import sys
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasteplane import schema
from tasteplane.functions import text
from tasteplane.operators import crew, expectation, inference, library, merge, portrait, quality, recommend, resolve, ridge_crew, splits
from tasteplane.operators.roles import BELOW_THE_LINE, PRODUCT_ROLES, with_roles
from tasteplane.plans import ladder
from tasteplane.sources import catalog, export, golden, sinks

TABLES = {"films": schema.FILMS, "people": schema.PEOPLE, "credits": schema.CREDITS, "resolutions": schema.RESOLUTIONS, "ratings": schema.RATINGS, "diary": schema.DIARY, "likes": schema.LIKES, "uploads": schema.UPLOADS}


class Workspace:
    def __init__(self, spark: SparkSession, folder: str, client: catalog.CatalogClient | None = None) -> None:
        """``folder`` is one that executors share; ``client`` is asked for what no table holds (None: nothing is asked)."""
        self.spark, self.folder, self.client = spark, folder.rstrip("/"), client

    def table(self, name: str) -> DataFrame:
        """The newest version of a table; empty if it was never written."""
        fs, at = self._files(name)
        if not fs.exists(at):
            return self.spark.createDataFrame([], TABLES[name])
        newest = max(s.getPath().getName() for s in fs.listStatus(at))
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}/{newest}")

    def save(self, name: str, df: DataFrame) -> None:
        """A new version beside the one that ``df`` may read; the one before that goes."""
        names = [f.name for f in self.spark.createDataFrame([], TABLES[name]).schema]
        fs, at = self._files(name)
        held = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        number = int(held[-1].split("-")[0][1:]) + 1 if held else 0
        out = df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(self.spark.createDataFrame([], TABLES[name]).schema[c].dataType).alias(c) for c in names])
        out.write.parquet(f"{self.folder}/{name}/v{number:09d}-{uuid.uuid4().hex}")
        for old in held[:-1]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/{old}"), True)

    def _files(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _fetched(self, kind: str, keys, ask, name=str) -> catalog.Fetched:
        return catalog.fetch(self.spark, f"{self.folder}/fetched/{kind}-{uuid.uuid4().hex}", keys, ask, name)

    # sources
    def ingest(self, path: str, upload_id: str = "") -> DataFrame:
        upload_id = upload_id or export.new_token()
        new = export.ingest(self.spark, path, upload_id)
        for name in ("ratings", "diary", "likes"):
            rest = self.table(name).filter(F.col("upload_id") != upload_id)
            self.save(name, rest.unionByName(new[name], allowMissingColumns=True))
        stats = export.ingest_stats(new).withColumn("upload_id", F.lit(upload_id))
        record = stats.select("upload_id", F.lit(export.new_token()).alias("token"), F.lit("pending").alias("status"), F.col("ratings").cast("int").alias("film_count"), F.current_timestamp().alias("uploaded_at"))
        self.save("uploads", self.table("uploads").filter(F.col("upload_id") != upload_id).unionByName(record, allowMissingColumns=True))
        return stats

    def _mark(self, status: str, error: str | None = None, upload_id: str = "") -> None:
        """Set the status of an upload (of all, without one); complete and failed ones have their time."""
        own = F.lit(True) if not upload_id else F.col("upload_id") == upload_id
        done = F.current_timestamp() if status in ("complete", "failed") else F.lit(None)
        changed = {"status": F.lit(status), "error": F.lit(error), "completed_at": done}
        self.save("uploads", self.table("uploads").withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in changed.items()}))

    def load_payloads(self, pattern: str) -> DataFrame:
        """Recorded film payloads into films, people and credits."""
        payloads = catalog.replay_films(self.spark, pattern)
        rows = catalog.film_rows(payloads).withColumn("seq", F.lit(1))
        self.save("films", merge.upsert_films(self.table("films"), rows).withColumn("normalized_title", text.normalize(F.coalesce("title", "original_title", F.lit("")))))
        credits, people = merge.store_payload_credits(self.table("credits"), self.table("people"), payloads)
        self.save("credits", credits)
        self.save("people", people)
        return self.table("films").agg(F.count("*").alias("films"))

    def backfill_cast(self) -> DataFrame:
        """Cast credits of every film whose payload is held."""
        held = self.table("films").filter(merge.has_credits(F.col("raw"))).select("film_id", F.from_json("raw", schema.PAYLOAD).alias("p"))
        credits, people = merge.store_payload_credits(self.table("credits"), self.table("people"), held)
        self.save("credits", credits)
        self.save("people", people)
        return held.agg(F.count("*").alias("films"))

    def _resolved(self, upload_id: str = "") -> DataFrame:
        """Distinct films that an upload's ratings resolve to (any upload's, without one)."""
        rated = self.table("ratings").filter(F.lit(not upload_id) | (F.col("upload_id") == upload_id))
        return rated.join(self.table("resolutions").filter("film_id is not null"), "source_uri").select("film_id").distinct()

    def credits(self, upload_id: str = "", refresh: bool = False, limit: int = 0) -> DataFrame:
        """Crew and cast of every resolved film: from the payload held, else asked of the catalog. One row of counters."""
        wanted, films = self._resolved(upload_id), self.table("films")
        wanted = wanted.orderBy("film_id").limit(limit) if limit else wanted
        asked = catalog.needed(wanted, films, refresh)
        got = catalog.Fetched("")
        if self.client:
            got = self._fetched("films", (r.film_id for r in asked.toLocalIterator()), lambda i: self.client.film(i, append="credits"))
        new = catalog.payload_rows(got.rows(self.spark))
        held = films.join(wanted.join(asked, "film_id", "left_anti"), "film_id", "left_semi").select("film_id", F.from_json("raw", schema.PAYLOAD).alias("p"), "raw")
        both = held.unionByName(new)
        counts = [wanted.agg(F.count("*").alias("films")), held.agg(F.count("*").alias("skipped_cached"))]
        crew_rows, cast_rows = merge.crew_credits(both), merge.cast_credits(both)
        counts.append(crew_rows.agg(F.count("*").alias("crew_stored"), F.count_distinct("film_id", "person_id").alias("crew_people")))
        counts.append(cast_rows.agg(F.count("*").alias("cast_stored")))
        counts.append(new.agg(F.coalesce(F.percentile(F.coalesce(F.size("p.credits.crew"), F.lit(0)), F.lit(0.5)), F.lit(0.0)).alias("median_crew")))
        departments = new.select(F.explode("p.credits.crew").alias("m")).filter("m.department is not null").groupBy("m.department").agg(F.count("*").alias("n"))
        counts.append(departments.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("department", "n")))).alias("departments")))
        out = counts[0]
        for c in counts[1:]:
            out = out.join(c, how="cross")  # one row each
        out = out.select("films", F.lit(got.fetched).alias("fetched"), "skipped_cached", F.lit(got.missing).alias("missing"), F.lit(len(got.failed)).alias("errors"), (F.col("crew_stored") + F.col("cast_stored")).alias("credits_stored"), (F.col("crew_people") + F.col("cast_stored")).alias("people_stored"), "median_crew", "departments")
        out = self.spark.createDataFrame(out.collect(), out.schema)  # before the tables change
        self._store(new, both)
        return out

    def _store(self, new: DataFrame, payloads: DataFrame) -> None:
        """New payloads into films, the credits and people of all ``payloads`` into theirs."""
        credits, people = merge.store_payload_credits(self.table("credits"), self.table("people"), payloads)
        self.save("credits", credits)
        self.save("people", people)
        self._upsert(catalog.film_rows(new))

    def _upsert(self, rows: DataFrame) -> None:
        merged = merge.upsert_films(self.table("films"), rows.withColumn("seq", F.lit(1)))
        self.save("films", merged.withColumn("normalized_title", text.normalize(F.coalesce("title", "original_title", F.lit("")))))

    def film(self, film_id: int) -> DataFrame:
        """Ask for one film with its credits and keep both; its row of the catalog."""
        if not self.client:
            raise catalog.CatalogError("a film needs a catalog to ask")
        new = catalog.payload_rows(self._fetched("films", [film_id], lambda i: self.client.film(i, append="credits")).rows(self.spark))
        self._store(new, new)
        return self.table("films").filter(F.col("film_id") == film_id)

    def record(self, folder: str) -> DataFrame:
        """Record the golden searches and films from the catalog, for ``regression``."""
        n = catalog.capture(self.client, folder, [(t, y) for t, y, *_ in golden.SEARCHES], list(golden.FILMS))
        return self.spark.createDataFrame([(n,)], "recorded long")

    def regression(self, searches: str) -> DataFrame:
        """Golden searches, resolved from recordings, whose answer is not the known one; no rows is a pass."""
        asked = self.spark.createDataFrame(golden.SEARCHES, "query_title string, query_year int, want_film_id long, want_method string")
        asked = asked.withColumn("query_id", F.concat("query_title", F.lit("::"), F.col("query_year").cast("string")))
        got = resolve.choose(asked, resolve.candidates(catalog.replay_searches(self.spark, searches)))
        wrong = ~(F.col("film_id").eqNullSafe(F.col("want_film_id")) & (F.col("match_method") == F.col("want_method")))
        return asked.join(got, "query_id").filter(wrong).select("query_title", "query_year", "want_film_id", "want_method", "film_id", "match_method", "reason")

    def filmographies(self, upload_id: str = "", least_films: int = 3) -> DataFrame:
        """What else the people worth traversing made: films and credits below the line. One row of counters."""
        if not self.client:
            raise catalog.CatalogError("filmographies need a catalog to ask")
        rated = self._resolved(upload_id).withColumn("upload_id", F.lit(upload_id))
        people = quality.worth_traversing(rated, with_roles(self.table("credits")), least_films).select("person_id").distinct().orderBy("person_id")
        ids = people.count()
        got = self._fetched("people", (r.person_id for r in people.toLocalIterator()), self.client.person_credits)
        names = F.create_map(*[F.lit(x) for pair in self.client.genres().items() for x in pair]) if got.fetched else F.create_map().cast("map<int,string>")
        rows = with_roles(catalog.person_credit_rows(got.rows(self.spark))).filter("below_the_line")
        enough = F.coalesce("vote_count", F.lit(0)) >= merge.LEAST_VOTES
        kept = rows.filter(enough)
        held = self.table("credits").select("film_id").distinct()
        new = kept.join(held, "film_id", "left_anti").withColumn("genres", F.transform(merge.genre_ids_to_names(F.coalesce("genre_ids", F.array().cast("array<int>")), names), lambda n: F.struct(n.alias("name"))))
        facts = F.struct(F.col("film_id").alias("id"), "title", "original_title", "release_date", "vote_average", "vote_count", "genres")
        new = new.groupBy("film_id").agg(F.min_by(F.struct("*"), "person_id").alias("f")).select("f.*").withColumn("raw", F.to_json(facts))
        films = new.select("film_id", "title", "original_title", F.year(F.try_to_date("release_date", "yyyy-MM-dd")).alias("year"), "vote_average", "vote_count", F.lit(None).cast("string").alias("country"), "raw")
        roles = kept.groupBy("role").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("by_role"))
        seen = rows.agg(F.count("*").alias("films_seen"), F.count_if(~enough).alias("skipped_low_votes"), F.count_if(enough).alias("credits_stored"))
        out = seen.join(films.agg(F.count("*").alias("films_stored")), how="cross").join(roles, how="cross")  # one row each
        out = out.select(F.lit(ids).alias("people"), F.lit(got.fetched).alias("fetched"), F.lit(got.missing).alias("missing"), F.lit(len(got.failed)).alias("errors"), "films_seen", "films_stored", "credits_stored", "skipped_low_votes", "by_role")
        out = self.spark.createDataFrame(out.collect(), out.schema)
        self._upsert(films)
        self.save("people", merge.placeholders(self.table("people"), kept.select("person_id")))
        credits = kept.select("film_id", "person_id", "department", "job").distinct()
        self.save("credits", merge.insert_new(self.table("credits"), credits, ["film_id", "person_id", "job"]))
        return out

    # resolution and its quality
    def resolve(self, searches: str = "", overrides: str = "", retry_failed: bool = False) -> DataFrame:
        """Overrides (a CSV of source_uri, film_id), known answers, the local catalog, recorded searches or else the catalog asked, then television."""
        titles = self.table("ratings").groupBy("source_uri").agg(F.min(F.struct("name", "year")).alias("t"))
        queries = titles.select(F.col("source_uri").alias("query_id"), F.col("t.name").alias("query_title"), F.col("t.year").alias("query_year"))
        table = self.table("resolutions")
        known = table.select(F.col("source_uri").alias("query_id"), F.col("film_id").cast("long").alias("film_id"), "match_method", "confidence", F.lit(False).alias("no_film_candidate"), "reason")
        films = self.table("films").select(F.col("film_id").cast("long").alias("film_id"), "title", "original_title", "year", "vote_count")
        manual = self.spark.read.schema("source_uri string, film_id long").csv(overrides, header=True).withColumnRenamed("source_uri", "query_id") if overrides else None
        self._mark("resolving")
        try:
            found, shows, failed = self._searched(queries, known, films, manual, searches, retry_failed)
            out = resolve.waterfall(queries, known, films, found, shows, manual, retry_failed)
            if failed:  # what was not answered is not recorded, and asked again next time
                out = out.join(self.spark.createDataFrame([(k,) for k in failed], "query_id string"), "query_id", "left_anti")
            out = out.persist()
            stats = resolve.resolve_stats(out).withColumns({"errors": F.lit(len(failed)), "total": F.col("total") + len(failed)})
            stats = self.spark.createDataFrame(stats.collect(), stats.schema)
            if found is not None and "raw" in found.columns:  # the next title can be answered locally
                matched = out.filter("stage = 'search' and film_id is not null").select("query_id", "film_id").join(found, ["query_id", "film_id"])
                self._upsert(matched.dropDuplicates(["film_id"]).select(F.col("film_id").cast("int").alias("film_id"), "title", "original_title", "year", "vote_average", "vote_count", F.lit(None).cast("string").alias("country"), "raw"))
            named = out.filter("stage <> 'cache'").join(queries, "query_id").select(F.col("query_id").alias("source_uri"), F.col("query_title").alias("name"), F.col("query_year").alias("year"), F.col("film_id").cast("int").alias("film_id"), "match_method", "confidence", "reason", F.current_timestamp().alias("resolved_at"))
            self.save("resolutions", table.join(named.select("source_uri"), "source_uri", "left_anti").unionByName(named))
        except Exception as e:
            self._mark("failed", str(e)[:500])
            raise
        out.unpersist()
        self._mark("complete")
        return stats

    def _searched(self, queries: DataFrame, known: DataFrame, films: DataFrame, manual: DataFrame | None, searches: str, retry_failed: bool) -> tuple[DataFrame | None, DataFrame | None, list[str]]:
        """Candidates and shows for the titles that the local catalog leaves open, and the titles whose request failed."""
        if searches:
            answers = catalog.replay_searches(self.spark, searches).drop("query_id").withColumnRenamed("query_year", "_asked")
            return queries.join(answers, "query_title").filter(F.col("query_year").eqNullSafe(F.col("_asked"))).drop("_asked"), None, []
        if not self.client:
            return None, None, []
        local = resolve.waterfall(queries, known, films, overrides=manual, retry_failed=retry_failed)
        open_ = local.filter("stage = 'local' and film_id is null").select("query_id").join(queries, "query_id").orderBy("query_id")
        got = self._fetched("searches", open_.toLocalIterator(), lambda r: {"results": self.client.search_films(r.query_title, r.query_year)}, lambda r: r.query_id)
        found = queries.join(catalog.search_rows(got.rows(self.spark)), "query_id")
        again = resolve.waterfall(queries, known, films, found, overrides=manual, retry_failed=retry_failed)
        lost = again.filter("stage = 'search' and film_id is null and no_film_candidate").select("query_id").join(queries, "query_id").orderBy("query_id")
        failed = {*got.failed}
        tv = self._fetched("shows", (r for r in lost.toLocalIterator() if r.query_id not in failed), lambda r: {"results": self.client.search_shows(r.query_title, r.query_year)}, lambda r: r.query_id)
        return found, catalog.show_rows(tv.rows(self.spark)), [*got.failed, *tv.failed]

    def entries(self) -> DataFrame:
        r = self.table("resolutions").select("source_uri", "film_id", "match_method", "confidence", "reason")
        return self.table("ratings").join(r, "source_uri")

    def metrics(self) -> DataFrame:
        return quality.resolution_report(self.entries())

    def audit_sample(self, path: str) -> DataFrame:
        cases = quality.stratified_sample(self.entries()).withColumnRenamed("year", "query_year")
        cases = cases.join(self.table("films").select("film_id", "title", "original_title", "year", "vote_count"), "film_id", "left")
        sinks.write_review(quality.auto_verdict(cases), path)
        return cases.groupBy("match_method").count()

    def audit_report(self, path: str) -> DataFrame:
        return quality.tally(sinks.read_review(self.spark, path))

    def coverage(self) -> DataFrame:
        held = self.table("films").join(self.entries().select("film_id").distinct(), "film_id", "left_semi")
        return quality.role_coverage(held, with_roles(self.table("credits")))

    # the library and its models
    def library(self) -> DataFrame:
        rated = library.resolved_ratings(self.table("ratings"), self.table("resolutions"))
        from tasteplane.functions.scalar import film_key

        rated = rated.withColumn("film_key", film_key(F.col("name"), F.col("year"))).drop("name", "year")
        films = self.table("films").select("film_id", "title", "year", "vote_average", "vote_count", "country", merge.genre_names(F.col("raw")).alias("genres"))
        out = library.build_library(rated, films, self.table("diary"), ["upload_id", "film_key"]).drop("film_key")
        # of a film rated under several titles the last rating counts: a model has one row a film
        held = [c for c in out.columns if c not in ("upload_id", "film_id", "source_uri")]
        last = F.max_by(F.struct(*held), F.struct("logged_date", "source_uri")).alias("r")
        return out.groupBy("upload_id", "film_id").agg(last).select("upload_id", "film_id", "r.*")

    def people_of(self, roles: tuple[str, ...] = PRODUCT_ROLES) -> DataFrame:
        return with_roles(self.table("credits")).filter(F.col("role").isin(*roles)).select("film_id", "role", "person_id").distinct()

    def _residuals(self) -> DataFrame:
        lib = self.library()
        return expectation.fit_predict(lib, lib).withColumn("residual", F.col("rating") - F.col("expected"))

    def fit(self, save: bool = False) -> DataFrame:
        residuals, credits = self._residuals(), self.people_of(BELOW_THE_LINE)
        effects = crew.effects(residuals, credits)
        if save:
            sinks.append_effects(effects, crew.inseparability(residuals, self.people_of()), f"{self.folder}/crew_effects", uuid.uuid4().hex)
        return crew.ranked(effects).join(self.table("people"), "person_id", "left")

    def evaluate(self, cut: str = schema.TEMPORAL_CUT, save: bool = False) -> DataFrame:
        """Every rung on both splits; saved, each upload's figures are a row of the run log."""
        lib, credits = self.library(), self.people_of()
        scored = [ladder.evaluate(s, credits, ladder.FULL_LADDER).withColumn("split", F.lit(n)) for n, s in (("temporal", splits.temporal_split(lib, cut)), ("random", splits.random_split(lib)))]
        out = scored[0].unionByName(scored[1])
        if save:
            out = out.persist()
            for r in lib.groupBy("upload_id").agg(F.count("*").alias("films")).toLocalIterator():
                config = self.spark.createDataFrame([(schema.SEED, cut, r.films)], "seed long, cut string, films long")
                sinks.append_run(self.spark, f"{self.folder}/runs", r.upload_id, schema.MODEL_VERSION, config, sinks.payload(out.filter(F.col("upload_id") == r.upload_id)))
        return out

    def variants(self, cut: str = schema.TEMPORAL_CUT) -> DataFrame:
        rungs = {"_".join(x): (lambda a, b, c, x=x: ladder.people(a, b, c, x[0], x[1], "mean", x[2])) for x in ladder.VARIANTS}
        return ladder.evaluate(splits.temporal_split(self.library(), cut), self.people_of(BELOW_THE_LINE), rungs)

    def gate(self, cut: str = schema.TEMPORAL_CUT, resamples: int = inference.RESAMPLES) -> DataFrame:
        rows = ladder.predictions(splits.temporal_split(self.library(), cut), self.people_of(), ladder.FULL_LADDER).persist()
        return ladder.gate_pairs(rows, resamples=resamples)

    def decompose(self, cut: str = schema.TEMPORAL_CUT, resamples: int = 1_000) -> DataFrame:
        return inference.decomposition(splits.temporal_split(self.library(), cut), self.people_of(), resamples)

    def attribution(self) -> DataFrame:
        residuals, credits, everyone = self._residuals(), self.people_of(BELOW_THE_LINE), self.people_of(("director", *BELOW_THE_LINE))
        return ridge_crew.attribution(crew.effects(residuals, credits), ridge_crew.fit(residuals, credits), ridge_crew.fit(residuals, everyone))

    def significance(self, permutations: int = inference.PERMUTATIONS) -> DataFrame:
        return inference.significance(self.library(), self.people_of(BELOW_THE_LINE), permutations, "rich")

    def controls(self, role: str = "editor", trials: int = 12) -> DataFrame:
        return inference.synthetic_sweep(self.library(), self.people_of(), role, trials=trials)

    def shuffle_test(self) -> DataFrame:
        return inference.shuffle_test(self.library(), self.people_of(BELOW_THE_LINE), kind="rich")

    def portrait(self) -> dict[str, DataFrame]:
        lib = self.library()
        return portrait.portrait(lib, self.people_of(), expectation.fit_predict(lib, lib))

    def recommend(self, top: int = 20, save: bool = False) -> DataFrame:
        lib, credits = self.library(), self.people_of(("director", *BELOW_THE_LINE))
        fit = expectation.ridge_fit(lib)
        residuals = expectation.ridge_predict(lib, fit).withColumn("residual", F.col("rating") - F.col("expected"))
        films = self.table("films").select("film_id", "title", "year", "vote_average", "vote_count", "country", merge.genre_names(F.col("raw")).alias("genres"))
        effects = crew.effects(residuals, credits.filter(F.col("role") != "director"))
        out = recommend.top(recommend.recommendations(films, lib, credits, effects, lambda rows: expectation.ridge_predict(rows, fit)), top)
        if save:
            sinks.append_recommendations(out, f"{self.folder}/recommendations", uuid.uuid4().hex)
        return out

    def months(self) -> DataFrame:
        from tasteplane.functions.scalar import month

        return self.table("ratings").groupBy("upload_id", month(F.col("logged_date")).alias("month")).count()

    def analyze(self, path: str, searches: str = "") -> dict[str, DataFrame]:
        """From an export to its portrait, with the months to choose a cut from."""
        self.ingest(path)
        self.resolve(searches)
        if self.client:
            self.credits()
        return self.portrait() | {"months": self.months()}

    def check(self) -> DataFrame:
        return self.spark.createDataFrame([(n, self.table(n).count()) for n in TABLES], "table string, rows long")


COMMANDS = [n for n, f in vars(Workspace).items() if inspect.isfunction(f) and not n.startswith("_") and n not in ("table", "save", "people_of")]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tasteplane")
    parser.add_argument("folder")
    parser.add_argument("--catalog", default="", help="address of the catalog to ask")
    parser.add_argument("--token-file", default="", help="file that holds the catalog's token")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        command = sub.add_parser(name.replace("_", "-"))
        for p in list(inspect.signature(getattr(Workspace, name)).parameters.values())[1:]:
            if p.default is inspect.Parameter.empty:
                command.add_argument(p.name)
            elif isinstance(p.default, bool):
                command.add_argument(f"--{p.name.replace('_', '-')}", dest=p.name, action="store_true")
            else:
                command.add_argument(f"--{p.name.replace('_', '-')}", dest=p.name, type=type(p.default), default=p.default)
    args = vars(parser.parse_args(argv))
    spark = SparkSession.builder.appName("tasteplane").getOrCreate()
    url, token = args.pop("catalog"), args.pop("token_file")
    client = catalog.CatalogClient(url, Path(token).read_text().strip() if token else "") if url else None
    out = getattr(Workspace(spark, args.pop("folder"), client), args.pop("command").replace("-", "_"))(**args)
    for title, df in out.items() if isinstance(out, dict) else [("", out)]:
        if title:
            print(title)
        df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
