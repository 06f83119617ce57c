"""The film catalog as a source: a polite HTTP client on the driver, and recorded payloads as DataFrames.

The client never runs on executors: one rate limit holds for one process.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasteplane.functions.scalar import country_of, release_year
from tasteplane.schema import PAYLOAD

# fixed values of the service's contract
ATTEMPTS, RETRIED, TIMEOUT = 4, frozenset({429, 500, 502, 503, 504}), 15
FIRST_WAIT, LONGEST_WAIT, RATE = 0.5, 30.0, 10.0


class CatalogError(RuntimeError):
    pass


class CatalogAuthError(CatalogError):
    pass


class CatalogNotFound(CatalogError):
    pass


def wait_seconds(attempt: int, retry_after: str | None) -> float:
    """What the server asks for, at most LONGEST_WAIT; else doubling from FIRST_WAIT."""
    try:
        return min(LONGEST_WAIT, max(0.0, float(retry_after))) if retry_after else FIRST_WAIT * 2**attempt
    except ValueError:
        return FIRST_WAIT * 2**attempt


@dataclass
class RateLimiter:
    per_second: float = RATE
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _next: float = field(default=0.0, repr=False)

    def wait(self) -> None:
        now = self.clock()
        if now < self._next:
            self.sleep(self._next - now)
        self._next = max(now, self._next) + 1 / self.per_second


@dataclass
class CatalogClient:
    base_url: str
    token: str
    limiter: RateLimiter = field(default_factory=RateLimiter)
    open: Callable[..., Any] = urlopen
    sleep: Callable[[float], None] = time.sleep

    def search_films(self, title: str, year: int | None = None) -> list[dict]:
        return self._get("search/movie", {"query": title} | ({"year": year} if year else {})).get("results", [])

    def search_shows(self, title: str, year: int | None = None) -> list[dict]:
        return self._get("search/tv", {"query": title} | ({"first_air_date_year": year} if year else {})).get("results", [])

    def film(self, film_id: int, append: str | None = None) -> dict:
        return self._get(f"movie/{film_id}", {"append_to_response": append} if append else {})

    def film_credits(self, film_id: int) -> dict:
        return self._get(f"movie/{film_id}/credits", {})

    def person_credits(self, person_id: int) -> dict:
        return self._get(f"person/{person_id}/movie_credits", {})

    def genres(self) -> dict[int, str]:
        return {g["id"]: g["name"] for g in self._get("genre/movie/list", {}).get("genres", [])}

    def _get(self, path: str, query: dict) -> dict:
        url = f"{self.base_url.rstrip('/')}/{path}" + (f"?{urlencode(query)}" if query else "")
        for attempt in range(ATTEMPTS):
            self.limiter.wait()
            asked = None
            try:
                with self.open(Request(url, headers={"Authorization": f"Bearer {self.token}", "Accept": "application/json"}), timeout=TIMEOUT) as reply:
                    return json.loads(reply.read())
            except HTTPError as e:
                if e.code in (401, 403):
                    raise CatalogAuthError(f"{path}: not allowed ({e.code})") from e
                if e.code == 404:
                    raise CatalogNotFound(path) from e
                if e.code not in RETRIED:
                    raise CatalogError(f"{path}: status {e.code}") from e
                asked, last = (e.headers or {}).get("Retry-After"), e
            except (URLError, TimeoutError) as e:
                last = e
            if attempt + 1 < ATTEMPTS:
                self.sleep(wait_seconds(attempt, asked))
        raise CatalogError(f"{path}: gave up after {ATTEMPTS} attempts") from last


def recording_name(title: str, year: int | None) -> str:
    plain = re.sub(r"[^a-z0-9]+", "_", title.lower()).strip("_")
    return f"search_{plain}_{year}.json" if year else f"search_{plain}.json"


def record(folder: str, name: str, payload: dict) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, name).write_text(json.dumps(payload, ensure_ascii=False, indent=1, sort_keys=True), encoding="utf-8")


def capture(client: CatalogClient, folder: str, searches: list[tuple[str, int | None]], films: list[int]) -> int:
    """Record the answers to searches and film requests for replay; returns how many."""
    for title, year in searches:
        record(folder, recording_name(title, year), {"query": title, "year": year, "results": client.search_films(title, year)})
    for film_id in films:
        record(folder, f"film_{film_id}.json", client.film(film_id, append="credits"))
    return len(searches) + len(films)


@dataclass
class Fetched:
    """What a run of requests came to; the answers are rows (key, raw) in ``path``."""

    path: str
    fetched: int = 0
    missing: int = 0
    #: keys whose request failed
    failed: list[str] = field(default_factory=list)

    def rows(self, spark: SparkSession) -> DataFrame:
        """key, raw; one row a key."""
        return spark.read.schema("key string, raw string").parquet(self.path) if self.fetched else spark.createDataFrame([], "key string, raw string")


def fetch(spark: SparkSession, path: str, keys: Iterable, ask: Callable[[Any], dict], name: Callable[[Any], str] = str, at_once: int = 200) -> Fetched:
    """Ask for each key in turn, in this process under one rate limit; answers are appended to ``path`` some at a time, so the driver holds few."""
    out, held = Fetched(path), []

    def write() -> None:
        if held:
            spark.createDataFrame(held, "key string, raw string").coalesce(1).write.mode("append").parquet(path)
            held.clear()

    for key in keys:
        try:
            held.append((name(key), json.dumps(ask(key), ensure_ascii=False)))
            out.fetched += 1
        except CatalogNotFound:
            out.missing += 1
        except CatalogError:
            out.failed.append(name(key))
        if len(held) >= at_once:
            write()
    write()
    return out


_HIT = "id:long,title:string,original_title:string,release_date:string,vote_average:double,vote_count:int"


def search_rows(answers: DataFrame) -> DataFrame:
    """query_id and the films of fetched searches, with what the catalog keeps of a hit."""
    hits = answers.select(F.col("key").alias("query_id"), F.explode(F.from_json("raw", f"results array<struct<{_HIT}>>")["results"]).alias("x"))
    return hits.select("query_id", F.col("x.id").alias("film_id"), "x.title", "x.original_title", release_year(F.col("x.release_date")).alias("year"), "x.vote_average", "x.vote_count", F.to_json("x").alias("raw"))


def show_rows(answers: DataFrame) -> DataFrame:
    """query_id, show_name, show_original_name, show_year of fetched television searches."""
    hits = answers.select(F.col("key").alias("query_id"), F.explode(F.from_json("raw", "results array<struct<name:string,original_name:string,first_air_date:string>>")["results"]).alias("x"))
    return hits.select("query_id", F.col("x.name").alias("show_name"), F.col("x.original_name").alias("show_original_name"), release_year(F.col("x.first_air_date")).alias("show_year"))


def payload_rows(answers: DataFrame) -> DataFrame:
    """film_id, p, raw of fetched films."""
    return answers.select(F.col("key").cast("int").alias("film_id"), F.from_json("raw", PAYLOAD).alias("p"), "raw")


def person_credit_rows(answers: DataFrame) -> DataFrame:
    """person_id and the crew entries of fetched filmographies that name a film, a department and a job."""
    entry = f"{_HIT},genre_ids:array<int>,department:string,job:string"
    rows = answers.select(F.col("key").cast("int").alias("person_id"), F.explode(F.from_json("raw", f"crew array<struct<{entry}>>")["crew"]).alias("x"))
    rows = rows.select("person_id", F.col("x.id").cast("int").alias("film_id"), "x.title", "x.original_title", "x.release_date", "x.vote_average", "x.vote_count", "x.genre_ids", "x.department", "x.job")
    return rows.dropna(subset=["film_id", "department", "job"])


def replay_searches(spark: SparkSession, pattern: str) -> DataFrame:
    """Recorded searches as rows for resolution: query_id (title::year), query_title, query_year, film_id, title, original_title, year, vote_count."""
    schema = "query string, year int, results array<struct<id:long,title:string,original_title:string,release_date:string,vote_count:int>>"
    r = spark.read.schema(schema).json(pattern, multiLine=True)
    key = F.concat("query", F.lit("::"), F.coalesce(F.col("year").cast("string"), F.lit("")))
    rows = r.select(key.alias("query_id"), F.col("query").alias("query_title"), F.col("year").alias("query_year"), F.explode_outer("results").alias("x"))
    return rows.select("query_id", "query_title", "query_year", F.col("x.id").alias("film_id"), "x.title", "x.original_title", release_year(F.col("x.release_date")).alias("year"), "x.vote_count")


def replay_films(spark: SparkSession, pattern: str) -> DataFrame:
    """Recorded film payloads: film_id, p (parsed parts), raw."""
    lines = spark.read.text(pattern, wholetext=True)
    return lines.select(F.from_json("value", PAYLOAD).alias("p"), F.col("value").alias("raw")).select(F.col("p.id").alias("film_id"), "p", "raw")


def film_rows(payloads: DataFrame) -> DataFrame:
    """Catalog columns of payloads: the latest facts, with year and country read from them."""
    p = F.col("p")
    return payloads.select("film_id", p["title"].alias("title"), p["original_title"].alias("original_title"), release_year(p["release_date"]).alias("year"), p["vote_average"].alias("vote_average"), p["vote_count"].alias("vote_count"), country_of(p["origin_country"]).alias("country"), "raw")


def needed(resolved: DataFrame, held: DataFrame, refresh: bool = False) -> DataFrame:
    """Distinct resolved film_ids whose payload with credits is not held (all, when refreshing); in order."""
    ids = resolved.filter(F.col("film_id").isNotNull()).select("film_id").distinct()
    if refresh:
        return ids.orderBy("film_id")
    from tasteplane.operators.merge import has_credits

    return ids.join(held.filter(has_credits(F.col("raw"))).select("film_id"), "film_id", "left_anti").orderBy("film_id")
