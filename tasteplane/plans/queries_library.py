"""Library building, scalar functions, quality, portrait."""

from __future__ import annotations

from pyspark.sql import functions as F

from tasteplane.functions import scalar
from tasteplane.operators import expectation, library, portrait, quality, splits
from tasteplane.operators.roles import with_roles
from tasteplane.plans import bench_views as v
from tasteplane.plans._register import Registry, rounded

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
ENTRY = """entry AS (
  SELECT r.upload_id, r.film_id AS entry_id, CASE WHEN r.film_id % 20 < 2 THEN NULL ELSE r.film_id - (CASE WHEN r.film_id % 20 = 19 THEN 1 ELSE 0 END) END AS film_id, f.title AS name,
    CASE WHEN r.film_id % 20 = 0 THEN 'unresolved' WHEN r.film_id % 20 = 1 THEN 'television' WHEN r.film_id % 20 < 4 THEN 'trigram' WHEN r.film_id % 20 < 6 THEN 'dominant' ELSE 'exact' END AS match_method,
    r.rating, r.logged_date FROM rating r JOIN film f USING (film_id))"""
ENTRIES = f"WITH {v.FILM}, {v.RATING}, {ENTRY}"


@query("library_build", f"WITH {v.LIBRARY} SELECT upload_id, film_id, title, year, round(vote_average, 6) AS vote_average, vote_count, country, round(rating, 6) AS rating, logged_date, in_diary, rewatches, round(preference, 6) AS preference FROM library")
def _(d):
    return rounded(d.library().drop("genres"))


@query("library_credit", f"WITH {v.BASE} SELECT DISTINCT upload_id, film_id, role, person_id FROM lib_credit")
def _(d):
    return library.library_credits(d.ratings(), d.credits())


@query("crew_map", f"WITH {v.CREDIT} SELECT film_id, role, list_sort(list(DISTINCT person_id))::VARCHAR AS people FROM credit GROUP BY film_id, role")
def _(d):
    m = library.crew_map(with_roles(d.credits()).select("film_id", "role", "person_id"))
    rows = m.select("film_id", F.explode("crew").alias("role", "people"))
    return rows.select("film_id", "role", F.concat(F.lit("["), F.array_join(F.col("people").cast("array<string>"), ", "), F.lit("]")).alias("people"))


@query("diary_rewatch_join", f"WITH {v.DIARY} SELECT film_id, CAST(count_if(is_rewatch) AS INT) AS rewatches, true AS in_diary FROM diary GROUP BY film_id")
def _(d):
    return library.diary_counts(d.diary(), ["film_id"])


@query("film_key_norm", f"WITH {v.FILM} SELECT film_id, CASE WHEN film_id % 4 = 0 THEN 'strasse ' ELSE '' END || lower(trim(title)) || '::' || year AS film_key FROM film")
def _(d):
    name = F.when(F.col("film_id") % 4 == 0, F.concat(F.lit(" Straße "), F.upper("title"), F.lit("\u2003"))).otherwise(F.col("title"))
    return d.films().select("film_id", scalar.film_key(name, F.col("year")).alias("film_key"))


@query("half_star_validate", "SELECT l_linenumber, CASE WHEN v % 0.5 = 0 AND v BETWEEN 0.5 AND 5 THEN v END::DOUBLE AS rating, count(*)::BIGINT AS n FROM (SELECT l_linenumber, CAST(l_quantity / 8 AS DECIMAL(10,4)) AS v FROM lineitem) GROUP BY 1, 2")
def _(d):
    text = F.format_string("%.4f", F.col("l_quantity") / 8)
    return d.table("lineitem").groupBy("l_linenumber", scalar.parse_rating(text).cast("double").alias("rating")).agg(F.count("*").alias("n"))


@query("quantise", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0.5, least(5.0, round_even(l_quantity / 8 * 2, 0) / 2))::DOUBLE AS stars FROM lineitem")
def _(d):
    return d.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", scalar.quantise(F.col("l_quantity") / 8).alias("stars"))


@query("month_histogram", f"WITH {v.RATING}, m AS (SELECT upload_id, strftime(logged_date, '%Y-%m') AS month, count(*)::BIGINT AS n FROM rating GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY month DESC) AS p FROM m) SELECT upload_id, month, n FROM r WHERE p <= 8")
def _(d):
    from pyspark.sql import Window as W

    n = d.ratings().groupBy("upload_id", scalar.month(F.col("logged_date")).alias("month")).agg(F.count("*").alias("n"))
    return n.withColumn("p", F.row_number().over(W.partitionBy("upload_id").orderBy(F.desc("month")))).filter("p <= 8").drop("p")


@query("confidence_buckets", "SELECT CASE WHEN c IS NULL OR c >= 1 THEN '1.00' ELSE printf('%.2f', c) END AS bucket, count(*)::BIGINT AS n FROM (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE (l_quantity + 50) / 100 END AS c FROM lineitem) GROUP BY 1")
def _(d):
    c = F.when(F.col("l_linenumber") != 7, (F.col("l_quantity") + 50) / 100)
    return d.table("lineitem").groupBy(scalar.confidence_bucket(c).alias("bucket")).agg(F.count("*").alias("n"))


@query("level1_quality", f"""{ENTRIES}, a AS (SELECT upload_id, count(*)::BIGINT AS entries, count(film_id)::BIGINT AS resolved, count_if(match_method = 'television')::BIGINT AS television,
  count_if(match_method = 'unresolved')::BIGINT AS unresolved, count_if(match_method IN ('trigram', 'dominant'))::BIGINT AS fuzzy FROM entry GROUP BY upload_id)
SELECT *, round(resolved / entries, 6) AS resolution_rate, round(coalesce(resolved / nullif(entries - television, 0), 0), 6) AS resolution_rate_excluding_television, round(coalesce(fuzzy / nullif(resolved, 0), 0), 6) AS fuzzy_rate FROM a""")
def _(d):
    return rounded(quality.resolution_report(d.entries()))


@query("method_counts", f"{ENTRIES} SELECT upload_id, match_method, count(*)::BIGINT AS n FROM entry GROUP BY 1, 2")
def _(d):
    return quality.counts_by(d.entries(), "match_method")


@query("decade_counts", f"WITH {v.LIBRARY} SELECT upload_id, (year // 10 * 10)::INT AS decade, count(*)::BIGINT AS n FROM library GROUP BY 1, 2")
def _(d):
    return quality.counts_by(d.library().withColumn("decade", scalar.decade(F.col("year"))), "decade")


@query("catalog_gaps", f"WITH {v.FILM} SELECT count(*)::BIGINT AS films, count_if(year IS NULL)::BIGINT AS no_year, count_if(vote_average IS NULL)::BIGINT AS no_vote_average, count_if(vote_count IS NULL)::BIGINT AS no_vote_count, count_if(country IS NULL)::BIGINT AS no_country FROM film")
def _(d):
    return quality.catalog_gaps(d.films())


@query("collisions", f"{ENTRIES} SELECT upload_id, film_id, count(*)::BIGINT AS claims, array_to_string(list_sort(list(name)), '; ') AS names FROM entry WHERE film_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def _(d):
    return quality.collisions(d.entries()).withColumn("names", F.array_join("names", "; "))


@query("diary_join_rate", f"WITH {v.RATING}, {v.DIARY}, u AS (SELECT DISTINCT upload_id FROM rating), k AS (SELECT DISTINCT upload_id, film_id FROM u CROSS JOIN diary) SELECT upload_id, count(*)::BIGINT AS diary_films, count(r.film_id)::BIGINT AS matched, (count(*) - count(r.film_id))::BIGINT AS unmatched, round(count(r.film_id) / count(*), 6) AS join_rate FROM k LEFT JOIN rating r USING (upload_id, film_id) GROUP BY upload_id")
def _(d):
    diary = d.diary().select("film_id").distinct().join(d.ratings().select("upload_id").distinct(), how="cross")
    return rounded(quality.diary_join_rate(d.ratings(), diary, "film_id"))


@query("role_mapping", f"WITH {v.CREDIT} SELECT department, job, role, count(*)::BIGINT AS n FROM credit GROUP BY 1, 2, 3")
def _(d):
    return with_roles(d.credits()).groupBy("department", "job", "role").agg(F.count("*").alias("n"))


@query("roles_present", f"WITH {v.CREDIT} SELECT film_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM credit GROUP BY film_id")
def _(d):
    from tasteplane.operators.roles import roles_present

    return roles_present(d.credits()).withColumn("roles", F.array_join("roles", ","))


def _coverage(group: str, select: str) -> str:
    g = f"{group}, " if group else ""
    on = f"USING ({group})" if group else "ON true"
    return f"WITH {v.FILM}, {v.CREDIT}, h AS (SELECT film_id{', ' + select if select else ''} FROM film), t AS (SELECT {g}count(*)::BIGINT AS films FROM h {'GROUP BY ' + group if group else ''}), c AS (SELECT {g}role, count(DISTINCT film_id)::BIGINT AS with_role, count(DISTINCT person_id)::BIGINT AS people FROM h JOIN credit USING (film_id) GROUP BY {g}role) SELECT c.*, t.films, round(with_role / films, 6) AS rate FROM c JOIN t {on}"


@query("role_coverage", _coverage("", ""))
def _(d):
    return rounded(quality.role_coverage(d.films(), with_roles(d.credits())))


@query("coverage_by_decade", _coverage("decade", "(year // 10 * 10)::INT AS decade"))
def _(d):
    return rounded(quality.role_coverage(d.films().withColumn("decade", scalar.decade(F.col("year"))), with_roles(d.credits()), "decade"))


@query("coverage_by_region", _coverage("region", "coalesce(country, '??') AS region"))
def _(d):
    return rounded(quality.role_coverage(d.films().withColumn("region", F.coalesce("country", F.lit("??"))), with_roles(d.credits()), "region"))


@query("crew_sizes", f"WITH {v.CREDIT}, n AS (SELECT film_id, count(*) AS n FROM credit GROUP BY film_id), m AS (SELECT count(DISTINCT film_id)::BIGINT AS multi_credit_films FROM (SELECT film_id, role FROM credit GROUP BY 1, 2 HAVING count(DISTINCT person_id) > 1)) SELECT sum(n)::BIGINT AS credits, quantile_cont(n::DOUBLE, 0.5) AS median_crew, count(*)::BIGINT AS films, any_value(multi_credit_films) AS multi_credit_films FROM n, m")
def _(d):
    return quality.crew_sizes(d.films(), with_roles(d.credits()))


@query("pooled_regions", f"WITH {v.FILM}, n AS (SELECT coalesce(country, '??') AS region, count(*) AS films FROM film GROUP BY 1) SELECT CASE WHEN films >= 80 THEN region ELSE 'other' END AS region, sum(films)::BIGINT AS films FROM n GROUP BY 1")
def _(d):
    return quality.pooled_regions(d.films(), 80)


@query("people_worth_traversing", f"WITH {v.BASE} SELECT upload_id, person_id, count(*)::BIGINT AS credit_rows FROM lib_credit WHERE role NOT IN ('director', 'actor') GROUP BY 1, 2 HAVING count(*) >= 3")
def _(d):
    return quality.worth_traversing(d.ratings(), with_roles(d.credits()))


SAMPLE = f"{ENTRIES}, s AS (SELECT *, row_number() OVER (PARTITION BY upload_id, match_method ORDER BY md5('20260726|' || entry_id), entry_id) AS p FROM entry)"


@query("stratified_sample", f"{SAMPLE} SELECT upload_id, entry_id, match_method FROM s WHERE match_method <> 'exact' OR p <= 50")
def _(d):
    e = d.entries()
    rows = quality.stratified_sample(e.select("upload_id", F.col("entry_id").alias("film_id"), "match_method"))
    return rows.select("upload_id", F.col("film_id").alias("entry_id"), "match_method")


@query("audit_tally", f"""{ENTRIES}, x AS (SELECT match_method, CASE entry_id % 7 WHEN 0 THEN 'wrong' WHEN 1 THEN 'unsure' WHEN 2 THEN '' ELSE 'correct' END AS verdict FROM entry),
m AS (SELECT match_method AS method, verdict FROM x UNION ALL SELECT CASE WHEN match_method IN ('exact', 'trigram', 'dominant') THEN 'resolved' ELSE 'refusals' END, verdict FROM x),
t AS (SELECT method, count_if(verdict = 'correct')::BIGINT AS correct, count_if(verdict = 'wrong')::BIGINT AS wrong, count_if(verdict = 'unsure')::BIGINT AS unsure, count_if(verdict = '')::BIGINT AS unfilled FROM m GROUP BY method)
SELECT *, correct + wrong AS judged, correct + wrong + unsure + unfilled AS total, round(coalesce(correct / nullif(correct + wrong, 0), 0), 6) AS accuracy FROM t""")
def _(d):
    m = F.col("entry_id") % 7
    verdict = F.when(m == 0, " Wrong ").when(m == 1, "unsure").when(m == 2, F.lit(None)).otherwise("correct")
    return rounded(quality.tally(d.entries().select("match_method", verdict.alias("verdict"))))


@query("auto_verdict", f"{ENTRIES} SELECT e.upload_id, CASE WHEN match_method = 'exact' AND lower(e.name) = lower(f.title) AND fe.year = f.year THEN 'correct' ELSE 'review' END AS verdict, count(*)::BIGINT AS n FROM entry e LEFT JOIN film f USING (film_id) JOIN film fe ON fe.film_id = e.entry_id GROUP BY 1, 2")
def _(d):
    own = d.films().select(F.col("film_id").alias("entry_id"), F.col("year").alias("query_year"))
    rows = d.entries().join(d.films().select("film_id", "title", "year"), "film_id", "left").join(own, "entry_id")
    # written in two ways that fold to the same title
    odd = F.col("entry_id") % 3 == 0
    rows = rows.withColumns({"name": F.when(odd, F.concat(F.lit("STRASSE ³ "), F.upper("name"))).otherwise(F.upper("name")), "title": F.when(odd, F.concat(F.lit("Straße  3 "), F.col("title"))).otherwise(F.col("title"))})
    return quality.auto_verdict(rows).groupBy("upload_id", "verdict").agg(F.count("*").alias("n"))


@query("rating_style", f"WITH {v.LIBRARY} SELECT upload_id, round(avg((rating = floor(rating))::INT), 6) AS whole_star_share, count(DISTINCT rating)::BIGINT AS levels_used, 10 AS levels_available, round(avg(rating), 6) AS mean, round(coalesce(stddev_samp(rating), 0), 6) AS sd, round(avg((rating >= 5)::INT), 6) AS top_rating_share, avg((rating = floor(rating))::INT) >= 0.6 AS is_decisive FROM library GROUP BY upload_id")
def _(d):
    return rounded(portrait.rating_style(d.library()))


@query("loyalties", f"WITH {v.BASE}, n AS (SELECT upload_id, role, person_id, count(*)::BIGINT AS films FROM lib_credit GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY films DESC, role, person_id)::INT AS place FROM n) SELECT * FROM r WHERE place <= 8")
def _(d):
    return portrait.loyalties(d.ratings(), d.film_credits())


@query("blind_spots", f"""WITH {v.LIBRARY}, m AS (SELECT upload_id, avg(rating) AS library_mean FROM library GROUP BY 1),
s AS (SELECT upload_id, rating, 'decade ' || (year // 10 * 10) || 's' AS label FROM library WHERE year <> 0 UNION ALL SELECT upload_id, rating, 'country ' || country FROM library UNION ALL SELECT upload_id, rating, 'genre ' || unnest(genres) FROM library),
g AS (SELECT upload_id, label, count(*)::BIGINT AS films, avg(rating) AS mean_rating FROM s GROUP BY 1, 2 HAVING count(*) BETWEEN 5 AND 400),
r AS (SELECT *, mean_rating - library_mean AS lift, row_number() OVER (PARTITION BY upload_id ORDER BY round(mean_rating - library_mean, 9) DESC, label)::INT AS place FROM g JOIN m USING (upload_id) WHERE mean_rating > library_mean)
SELECT upload_id, label, films, round(mean_rating, 6) AS mean_rating, round(library_mean, 6) AS library_mean, round(lift, 6) AS lift, place FROM r WHERE place <= 8""")
def _(d):
    return rounded(portrait.blind_spots(d.library(), most=400))


@query("disagreements", f"""WITH {v.LIBRARY}, {v.simple()}, x AS (SELECT *, rating - expected AS residual, coalesce(vote_count, 0) >= 50 AS ok, count_if(coalesce(vote_count, 0) < 50) OVER (PARTITION BY upload_id)::BIGINT AS excluded FROM expected),
r AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY round(residual, 9) DESC, film_id)::INT AS top, row_number() OVER (PARTITION BY upload_id ORDER BY round(residual, 9), film_id DESC)::INT AS bottom FROM x WHERE ok),
z AS (SELECT *, CASE WHEN top <= 8 AND residual > 0 THEN 'above' WHEN bottom <= 8 AND residual < 0 THEN 'below' END AS direction FROM r)
SELECT upload_id, direction, CASE WHEN direction = 'above' THEN top ELSE bottom END AS place, film_id, round(residual, 6) AS residual, excluded FROM z WHERE direction IS NOT NULL""")
def _(d):
    lib = d.library()
    e = expectation.fit_predict(lib, lib, "simple").withColumn("expected", F.col("rating") - F.round(F.col("rating") - F.col("expected"), 9))
    return rounded(portrait.disagreements(e))


@query("rewatched", f"WITH {v.LIBRARY}, r AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY rewatches DESC, rating DESC, film_id)::INT AS place FROM library WHERE rewatches > 0) SELECT upload_id, place, film_id, rewatches, rating::DOUBLE AS rating FROM r WHERE place <= 8")
def _(d):
    return portrait.rewatched(d.library())


@query("revealed_preference", f"WITH {v.LIBRARY}, a AS (SELECT upload_id, count_if(rating >= 5)::BIGINT AS top_rated_total, count_if(rating >= 5 AND in_diary)::BIGINT AS top_rated_in_diary, count_if(rating >= 5 AND in_diary AND rewatches = 0)::BIGINT AS top_rated_never_revisited FROM library GROUP BY 1) SELECT *, round(CASE WHEN top_rated_in_diary > 0 THEN 1 - top_rated_never_revisited / top_rated_in_diary ELSE 0 END, 6) AS revisit_rate FROM a")
def _(d):
    return rounded(portrait.revealed_preference(d.library()))


SPLIT = f"split AS (SELECT *, CASE WHEN logged_date < DATE '{v.CUT}' THEN 'train' ELSE 'test' END AS block FROM library WHERE logged_date IS NOT NULL)"


@query("temporal_split_drift", f"""WITH {v.LIBRARY}, {SPLIT}, s AS (SELECT upload_id, block, count(*)::BIGINT AS n, avg(rating) AS mean, coalesce(stddev_samp(rating), 0) AS sd, avg((rating = floor(rating))::INT) AS whole, avg((rating >= 5)::INT) AS top FROM split GROUP BY 1, 2)
SELECT a.upload_id, a.n AS train_n, round(a.mean, 6) AS train_mean, round(a.sd, 6) AS train_sd, round(a.whole, 6) AS train_whole_star_share, round(a.top, 6) AS train_top_rating_share,
b.n AS test_n, round(b.mean, 6) AS test_mean, round(b.sd, 6) AS test_sd, round(b.whole, 6) AS test_whole_star_share, round(b.top, 6) AS test_top_rating_share, round(b.mean - a.mean, 6) AS mean_shift, round(b.top - a.top, 6) AS top_rating_share_shift
FROM s a JOIN s b USING (upload_id) WHERE a.block = 'train' AND b.block = 'test'""")
def _(d):
    return rounded(splits.drift(splits.temporal_split(d.library(), v.CUT)))


@query("random_split", f"WITH {v.LIBRARY}, r AS (SELECT upload_id, film_id, row_number() OVER (PARTITION BY upload_id ORDER BY md5('20260726|' || film_id), film_id) AS p, count(*) OVER (PARTITION BY upload_id) AS n FROM library) SELECT upload_id, film_id, CASE WHEN p <= floor(0.7::DOUBLE * n) THEN 'train' ELSE 'test' END AS block FROM r")
def _(d):
    return splits.random_split(d.library()).select("upload_id", "film_id", "block")


@query("shuffled_ratings", f"WITH {v.LIBRARY}, a AS (SELECT upload_id, film_id, row_number() OVER (PARTITION BY upload_id ORDER BY film_id) AS p FROM library), b AS (SELECT upload_id, rating, row_number() OVER (PARTITION BY upload_id ORDER BY md5('20260726|' || film_id), film_id) AS p FROM library) SELECT upload_id, film_id, rating::DOUBLE AS rating FROM a JOIN b USING (upload_id, p)")
def _(d):
    return splits.shuffled_ratings(d.library()).select("upload_id", "film_id", "rating")
