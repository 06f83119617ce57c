"""Exports, the catalog client, recordings, sinks and the upload stream."""

import io
import json
import zipfile
from urllib.error import HTTPError, URLError

import pytest

from tasteplane.operators import merge
from tasteplane.sources import catalog, export, sinks
from tasteplane.streaming import uploads

RATINGS = "Date,Name,Year,Letterboxd URI,Rating\n2023-01-02,\"Wall, The\",1999,u1,4.5\n2023-02-30,Sea – Side,,u2,3\nbad,No Stars,2001,u3,4.25\n2023-01-05,,2001,u4,4\n2023-01-06,Low,2001,u5,0\n"
DIARY = "Date,Name,Year,Letterboxd URI,Rating,Rewatch,Tags,Watched Date\n2023-01-02,\"Wall, The\",1999,e1,4.5,Yes,,2023-01-01\n2023-01-02,Other,2000,e2,,,,2023-01-03\n"
LIKES = "Date,Name,Year,Letterboxd URI\n2023-01-01,Liked,2000,u9\n"


def write(path, nested="", zipped=False, bom=False):
    files = {"ratings.csv": RATINGS, "diary.csv": DIARY, "likes/films.csv": LIKES, "profile.csv": "Email\nx@y.z\n", "deleted/diary.csv": "Name\nnever\n"}
    files = {f"{nested}{k}": ("﻿" if bom else "") + v for k, v in files.items()}
    if zipped:
        target = path / "export.zip"
        with zipfile.ZipFile(target, "w") as z:
            for k, v in files.items():
                z.writestr(k, v)
        return str(target)
    for k, v in files.items():
        (path / k).parent.mkdir(parents=True, exist_ok=True)
        (path / k).write_text(v, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("how", [{}, {"zipped": True}, {"nested": "me-2023/"}, {"nested": "me-2023/", "zipped": True}, {"bom": True}])
def test_every_layout_reads_the_same(spark, tmp_path, how):
    t = export.ingest(spark, write(tmp_path, **how), "up")
    rows = {r.source_uri: r for r in t["ratings"].collect()}
    assert {k: (float(r.rating), r.year, r.logged_date and str(r.logged_date), r.name) for k, r in rows.items()} == {"u1": (4.5, 1999, "2023-01-02", "Wall, The"), "u2": (3.0, None, None, "Sea – Side")}
    assert {r.skip: r.n for r in t["skips"].collect()} == {"ratings:unusable_rating": 2, "ratings:missing_uri_or_name": 1}
    assert {(r.film_key, r.is_rewatch) for r in t["diary"].collect()} == {("wall, the::1999", True), ("other::2000", False)}
    s = export.ingest_stats(t).first()
    assert (s.ratings, s.diary_entries, s.rewatches, s.diary_films, s.diary_films_rated, s.likes) == (2, 2, 1, 2, 1, 1)


def test_private_files_stay_closed(tmp_path):
    with export.Export(write(tmp_path)) as e:
        for name in ("profile.csv", "deleted/diary.csv", "../ratings.csv"):
            with pytest.raises(PermissionError):
                e.read_text(name)
    assert len(export.new_token()) == 43


def test_missing_ratings(spark, tmp_path):
    (tmp_path / "diary.csv").write_text(DIARY)
    with pytest.raises(FileNotFoundError):
        export.ingest(spark, str(tmp_path), "up")


class Reply(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *a):
        return None


def client(answers, slept):
    def opened(request, timeout):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return Reply(json.dumps(a).encode())

    return catalog.CatalogClient("http://x/3", "t", catalog.RateLimiter(sleep=lambda s: None), opened, slept.append)


def status(code, after=None):
    return HTTPError("http://x", code, "", {"Retry-After": after} if after else {}, None)


def test_retries_and_refusals():
    slept = []
    assert client([status(500), URLError("down"), status(429, "99"), {"results": [{"id": 1}]}], slept).search_films("a", 2000) == [{"id": 1}]
    assert slept == [0.5, 1.0, 30.0]
    with pytest.raises(catalog.CatalogAuthError):
        client([status(401)], []).film(1)
    with pytest.raises(catalog.CatalogNotFound):
        client([status(404)], []).film(1)
    with pytest.raises(catalog.CatalogError):
        client([status(418)], []).film(1)
    with pytest.raises(catalog.CatalogError):
        client([status(503)] * 4, []).film(1)


def test_rate_limit():
    now, waits = [0.0], []
    limiter = catalog.RateLimiter(10, lambda: now[0], waits.append)
    for _ in range(3):
        limiter.wait()
    assert waits == pytest.approx([0.1, 0.2])


def test_record_and_replay(spark, tmp_path):
    film = {"id": 9, "title": "Wall", "original_title": "Mauer", "release_date": "1999-05-01", "vote_average": 7.5, "vote_count": 30, "origin_country": ["DE"], "genres": [{"id": 1, "name": "Drama"}],
            "credits": {"crew": [{"id": 1, "name": "A", "department": "Editing", "job": "Editor"}] * 2 + [{"id": 2, "name": None, "department": "Editing", "job": "Editor"}], "cast": [{"id": i % 12, "name": f"c{i % 12}", "order": i} for i in range(21)]}}
    hits = {"results": [{"id": 9, "title": "Wall", "original_title": "Mauer", "release_date": "1999-05-01", "vote_count": 30}]}
    assert catalog.capture(client([hits, film], []), str(tmp_path), [("The Wall!", 1999)], [9]) == 2
    assert (tmp_path / "search_the_wall_1999.json").exists()
    row = catalog.replay_searches(spark, f"{tmp_path}/search_*.json").first()
    assert (row.query_id, row.film_id, row.year) == ("The Wall!::1999", 9, 1999)
    payloads = catalog.replay_films(spark, f"{tmp_path}/film_*.json")
    facts = catalog.film_rows(payloads).first()
    assert (facts.film_id, facts.country, facts.year) == (9, "DE", 1999)
    credits, people = merge.store_payload_credits(spark.createDataFrame([(9, 1, "Editing", "Editor")], "film_id int, person_id int, department string, job string"), spark.createDataFrame([(1, "Old Name")], "person_id int, name string"), payloads)
    assert credits.filter("job = 'Editor'").count() == 1 and credits.filter("job = 'Actor'").count() == 10
    assert people.filter("person_id = 1").first().name == "Old Name"
    held = payloads.select("film_id", "raw")
    resolved = spark.createDataFrame([(9,), (10,), (None,)], "film_id int")
    assert [r.film_id for r in catalog.needed(resolved, held).collect()] == [10]


def test_sinks_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "upload_id string, x int")
    for _ in range(2):
        sinks.replace_upload(df, f"{tmp_path}/t")
    sinks.replace_upload(df.filter("upload_id = 'a'").withColumn("x", df.x + 10), f"{tmp_path}/t")
    assert {(r.upload_id, r.x) for r in spark.read.parquet(f"{tmp_path}/t").collect()} == {("a", 11), ("b", 2)}
    run = sinks.append_run(spark, f"{tmp_path}/runs", "a", "v1", df.limit(1), df)
    assert spark.read.parquet(f"{tmp_path}/runs").first().run_id == run
    cases = spark.createDataFrame([("exact", 1.0, "N, \"q\"", None)], "match_method string, confidence double, name string, reason string")
    sinks.write_review(cases, f"{tmp_path}/review")
    back = sinks.read_review(spark, f"{tmp_path}/review")
    assert back.columns == list(sinks.REVIEW_COLUMNS) and back.first().confidence == "1.00" and back.first().name == 'N, "q"'


def test_archives_are_unpacked_where_executors_read(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("top/ratings.csv", "\ufeffDate,Name,Year,Letterboxd URI,Rating\n2023-01-01,Ünder,1999,u1,4.5\n")
        z.writestr("top/profile.csv", "secret\n")
    folder = export.unpacked(spark, str(tmp_path / "e.zip"), f"file://{tmp_path}/shared")
    assert [tuple(r) for r in export.scan(spark, f"{folder}/ratings.csv", "ratings.csv").select("uri", "name", "rating").collect()] == [("u1", "Ünder", "4.5")]
    assert sorted(p.name for p in (tmp_path / "shared").rglob("*.csv")) == ["ratings.csv"]


def test_run_payloads_are_finite_and_rounded(spark):
    rows = spark.createDataFrame([("u", 0.123456, float("nan"), 3)], "upload_id string, a double, b double, n int")
    assert tuple(sinks.payload(rows).first()) == ("u", 0.1235, 0.0, 3)


def test_stream_merges_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"upload_id": "a", "uri": "u1", "name": "N", "year": "1999", "rating": "4.5", "date": "2023-01-01", "arrived": "2023-01-01T00:00:00"}, {"upload_id": "a", "uri": "u2", "name": "N", "year": "", "rating": "x", "date": "", "arrived": "2023-01-01T00:00:00"}]
    (tmp_path / "in" / "one.json").write_text("\n".join(map(json.dumps, rows)))
    for _ in range(2):  # the second run finds nothing new
        uploads.merge_batches(uploads.incoming(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert uploads.merged(spark, f"{tmp_path}/out").count() == 1
    later = [rows[0] | {"uri": "u3"}, rows[0] | {"rating": "2.5", "arrived": "2023-01-02T00:00:00"}, rows[0] | {"upload_id": "b"}]
    (tmp_path / "in" / "two.json").write_text("\n".join(map(json.dumps, later)))
    uploads.merge_batches(uploads.incoming(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    held = {(r.upload_id, r.source_uri): float(r.rating) for r in uploads.merged(spark, f"{tmp_path}/out").collect()}
    assert held == {("a", "u1"): 2.5, ("a", "u3"): 4.5, ("b", "u1"): 4.5}  # an upload in two batches keeps both
    assert spark.read.parquet(f"{tmp_path}/out/skips").filter("skip is not null").first().skip == "ratings:unusable_rating"
    assert uploads.daily_counts(uploads.incoming(spark, f"{tmp_path}/in")).isStreaming
