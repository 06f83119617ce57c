"""Table schemas and constants of the taste model."""

from __future__ import annotations

SEED = 20260726
MODEL_VERSION = "1"
TEMPORAL_CUT = "2024-01-01"
LOWEST_RATING, HIGHEST_RATING, RATING_STEP = 0.5, 5.0, 0.5

FILMS = "film_id int, title string, original_title string, normalized_title string, year int, vote_average double, vote_count int, country string, raw string, fetched_at timestamp"
PEOPLE = "person_id int, name string"
CREDITS = "film_id int, person_id int, department string, job string"
RESOLUTIONS = "source_uri string, name string, year int, film_id int, match_method string, confidence double, reason string, resolved_at timestamp"
UPLOADS = "upload_id string, token string, status string, film_count int, error string, uploaded_at timestamp, completed_at timestamp"
RATINGS = "upload_id string, source_uri string, name string, year int, rating decimal(2,1), logged_date date"
DIARY = "upload_id string, film_key string, watched_date date, is_rewatch boolean"
LIKES = "upload_id string, source_uri string"
RUNS = "run_id string, upload_id string, model_version string, config string, metrics string, created_at timestamp"
CREW_EFFECTS = "run_id string, person_id int, role string, effect double, stderr double, n_films int, inseparable_from_person_id int"
RECOMMENDATIONS = "run_id string, film_id int, score double, primary_reason_person_id int, novelty_pct double"

MATCH_METHODS = ("exact", "trigram", "dominant", "manual", "television", "unresolved")
UPLOAD_STATUSES = ("pending", "resolving", "complete", "failed")

#: parts of a catalog payload that plans read
PAYLOAD = (
    "id int, title string, original_title string, release_date string, vote_average double, vote_count int, origin_country array<string>, "
    "genres array<struct<id:int,name:string>>, genre_ids array<int>, "
    "credits struct<crew:array<struct<id:int,name:string,department:string,job:string>>,cast:array<struct<id:int,name:string,order:int>>>"
)
