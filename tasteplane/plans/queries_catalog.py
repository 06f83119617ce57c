"""Titles, resolution, upserts and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tasteplane.functions import scalar, text
from tasteplane.operators import merge, resolve
from tasteplane.plans import bench_views as v
from tasteplane.plans._register import Registry, rounded

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

TITLE = """title AS (
  SELECT p_partkey AS id, p_name AS plain, CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'The ' || p_name WHEN 2 THEN p_name || ': Part II' WHEN 3 THEN '  ' || p_name || ' 2'
    WHEN 4 THEN p_name || ' – Dark  Tale' ELSE split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) END AS title FROM part)"""
NORM = "trim(regexp_replace(lower(translate({t}, '–', '-')), '\\s+', ' ', 'g'))"
GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i::INT, 3)))))"


def _titles(d):
    m, name = F.col("p_partkey") % 6, F.col("p_name")
    swapped = F.concat_ws(" ", F.split_part(name, F.lit(" "), F.lit(2)), F.split_part(name, F.lit(" "), F.lit(1)))
    title = F.when(m == 0, F.upper(name)).when(m == 1, F.concat(F.lit("The "), name)).when(m == 2, F.concat(name, F.lit(": Part II"))).when(m == 3, F.concat(F.lit("  "), name, F.lit(" 2"))).when(m == 4, F.concat(name, F.lit(" – Dark  Tale"))).otherwise(swapped)
    return d.table("part").select(F.col("p_partkey").alias("id"), name.alias("plain"), title.alias("title"))


@query("normalize_title", f"WITH {TITLE} SELECT id, {NORM.format(t='title')} AS normal FROM title")
def _(d):
    return _titles(d).select("id", text.normalize(F.col("title")).alias("normal"))


@query("title_forms", f"""WITH {TITLE}, n AS (SELECT id, {NORM.format(t='title')} AS n FROM title), l AS (SELECT id, n, trim(regexp_replace(regexp_replace(n, '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS l FROM n),
a AS (SELECT id, n, l, regexp_replace(n, '^(the|a|an) ', '') AS x, regexp_replace(l, '^(the|a|an) ', '') AS y FROM l)
SELECT id, n || CASE WHEN l NOT IN (n, '') THEN '|' || l ELSE '' END || CASE WHEN x NOT IN (n, l, '') THEN '|' || x ELSE '' END || CASE WHEN y NOT IN (n, l, x, '') THEN '|' || y ELSE '' END AS forms FROM a""")
def _(d):
    return _titles(d).select("id", F.array_join(text.comparison_forms(text.normalize_ascii(F.col("title"))), "|").alias("forms"))


@query("sequence_markers", f"""WITH {TITLE}, t AS (SELECT id, regexp_extract_all({NORM.format(t='title')}, '[\\p{{L}}\\p{{N}}]+') AS w FROM title)
SELECT id, array_to_string(list_sort(list_distinct(list_transform(list_filter(w, lambda x: regexp_full_match(x, '[0-9]+') OR x IN ('i','ii','iii','iv','v','vi','vii','viii','ix','x','one','two','three','four','five','six','seven','eight','nine','ten')), lambda x: CASE x WHEN 'ii' THEN '2' ELSE x END))), ',') AS markers FROM t""")
def _(d):
    return _titles(d).select("id", F.array_join(text.markers(text.tokens(text.normalize_ascii(F.col("title")))), ",").alias("markers"))


@query("trigram_similarity", f"WITH {TITLE}, g AS (SELECT id, {GRAMS.format(t='title')} AS a, {GRAMS.format(t='plain')} AS b FROM title) SELECT id, len(a)::INT AS n_grams, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6) AS similarity FROM g")
def _(d):
    return rounded(_titles(d).select("id", F.size(text.trigrams(F.col("title"))).alias("n_grams"), text.similarity(F.col("title"), F.col("plain")).alias("similarity")))


WORD_GRAMS = "list_distinct(list_transform(range(1, length({w}) + 2), lambda {i}: substring('  ' || {w} || ' ', {i}::INT, 3)))"
_W, _O = WORD_GRAMS.format(w="w", i="i"), WORD_GRAMS.format(w="o", i="j")
NUMERALS = "MAP {" + ", ".join(f"'{k}': '{n}'" for k, n in text.NUMERALS.items()) + "}"
IS_NUMERAL = f"(regexp_full_match(x, '[0-9]+') OR map_contains({NUMERALS}, x))"
MARKERS = f"list_sort(list_distinct(list_transform(list_filter(WORDS, lambda x: {IS_NUMERAL}), lambda x: coalesce(map_extract({NUMERALS}, x)[1], x))))"
HEAVY = f"list_distinct(list_filter(WORDS, lambda x: NOT {IS_NUMERAL} AND x NOT IN ({', '.join(map(repr, text.LIGHT_WORDS))})))"


def distinct_sql(source: str) -> str:
    """CTEs that end in judged (id and the columns of ``source``, which has normal titles q and c, and distinct_titles): the rules for titles that name other films."""
    return f"""toks AS (SELECT *, regexp_extract_all(q, '[\\p{{L}}\\p{{N}}]+') AS qt, regexp_extract_all(c, '[\\p{{L}}\\p{{N}}]+') AS ct FROM {source}),
parts AS (SELECT *, {MARKERS.replace('WORDS', 'qt')} AS qm, {MARKERS.replace('WORDS', 'ct')} AS cm, {HEAVY.replace('WORDS', 'qt')} AS qh, {HEAVY.replace('WORDS', 'ct')} AS ch FROM toks),
judged AS (SELECT *, len(list_filter(qm, lambda x: NOT list_contains(cm, x))) > 0 OR (len(qm) > 0 AND len(cm) > 0 AND qm <> cm) OR (qt <> ct AND list_sort(qt) = list_sort(ct))
  OR len(list_filter(qh, lambda w: NOT list_contains(ch, w) AND len(list_filter(ch, lambda o: len(list_intersect({_W}, {_O})) / len(list_distinct(list_concat({_W}, {_O}))) >= {text.SPELLING_VARIANT})) = 0)) > 0 AS distinct_titles FROM parts)"""


@query("titles_distinct", f"WITH {TITLE}, n AS (SELECT id, {NORM.format(t='title')} AS q, {NORM.format(t='plain')} AS c FROM title), {distinct_sql('n')} SELECT id, distinct_titles FROM judged")
def _(d):
    n = text.normalize_ascii
    return _titles(d).select("id", text.titles_distinct(n(F.col("title")), n(F.col("plain"))).alias("distinct_titles"))


@query("trigram_gram_join", f"""WITH {v.FILM}, q AS (SELECT film_id AS query_id, lower(title) AS n, year FROM film), t AS (SELECT DISTINCT title, {GRAMS.format(t='title')} AS g FROM film), u AS (SELECT a.title AS a, b.title AS b, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS s FROM t a, t b),
r AS (SELECT query_id, film_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, film_id) AS p FROM q JOIN film f USING (year) JOIN u ON u.a = q.n AND u.b = f.title WHERE s >= 0.3)
SELECT query_id, film_id, round(s, 6) AS similarity FROM r WHERE p <= 20""")
def _(d):
    films = d.films().select("film_id", text.normalize_ascii(F.col("title")).alias("normal"), "year")
    return rounded(resolve.gram_join(films.withColumnRenamed("film_id", "query_id"), films))


@query("dominant_candidate", f"""WITH {v.FILM}, r AS (SELECT title, year, film_id, vote_count, row_number() OVER w AS p, lead(vote_count) OVER w AS runner_up FROM film WINDOW w AS (PARTITION BY title, year ORDER BY vote_count DESC, film_id))
SELECT title, year, film_id AS leader_id, vote_count AS leader_votes, runner_up, coalesce(vote_count >= 50 AND runner_up IS NOT NULL AND vote_count >= 10 * greatest(runner_up, 1), false) AS is_dominant FROM r WHERE p = 1""")
def _(d):
    return resolve.dominant(d.films(), ["title", "year"])


def _search(d):
    """Every film's title asked, whole, misspelt or shortened by the film's remainder, with its year moved by -1, 0 or 1, against films of the same title two years around.

    Queries that ask alike for one title are one, and so are films of one title and year: asked, candidates of representatives, members.
    """
    films = d.films().select("film_id", "title", F.lit(None).cast("string").alias("original_title"), "year", "vote_count")
    title, m = F.col("title"), F.col("film_id") % 5
    written = F.when(m == 3, F.concat(title, F.lit("x"))).when(m == 4, F.substring(title, 1, 9)).otherwise(F.upper(title))
    asked = d.films().select(F.col("film_id").alias("query_id"), written.alias("query_title"), (F.col("year") + F.col("film_id") % 3 - 1).cast("int").alias("query_year"), title.alias("t"))
    asked = asked.withColumn("query_year", F.when(F.col("query_id") % 50 != 7, F.col("query_year")))
    members = resolve.alike(asked, ["query_title", "query_year", "t"])
    reps = asked.join(members.select(F.col("rep").alias("query_id")).distinct(), "query_id", "left_semi")
    near = resolve.titles(films).join(reps, (F.col("title") == F.col("t")) & F.coalesce(F.abs(F.col("year") - F.col("query_year")) <= 2, F.col("year") == 1975))
    return asked.drop("t"), near.drop("t"), members


def choose_sql(asked: str, near: str) -> str:
    """CTEs that end in ruled: each title of ``asked`` (query_id, y) with its rule and the pools of its candidates ``near`` (query_id, film_id, vote_count, gap, year, q, c)."""
    return f"""asked AS ({asked}), near AS ({near}),
{distinct_sql('near')}, grams AS (SELECT query_id, film_id, vote_count, gap, year, distinct_titles, {GRAMS.format(t='q')} AS a, {GRAMS.format(t='c')} AS b FROM judged),
compared AS (SELECT *, CASE WHEN distinct_titles THEN 0 ELSE coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0) END AS s FROM grams),
flags AS (SELECT *, s >= 0.3 AS plausible, s >= 0.999 AS exact, s >= 0.3 AND gap <= 1 AS win, gap = 0 AS same FROM compared),
pools AS (SELECT query_id, count_if(plausible) AS n, count_if(win) AS nw, list_sort(list((-vote_count, film_id, s)) FILTER (exact)) AS any_exact, list_sort(list((-vote_count, film_id, s)) FILTER (exact AND win)) AS e,
  list_sort(list((-vote_count, film_id, s)) FILTER (exact AND win AND same)) AS ey, list_sort(list((-vote_count, film_id, s)) FILTER (win AND s >= 0.75)) AS f, list_sort(list((-vote_count, film_id, s)) FILTER (win AND s >= 0.75 AND same)) AS fy,
  max(s) FILTER (win) AS best, max((vote_count, -film_id, year)) FILTER (exact AND win AND NOT same) AS other FROM flags GROUP BY 1),
lists AS (SELECT asked.query_id, y, coalesce(n, 0) AS n, coalesce(nw, 0) AS nw, coalesce(any_exact, []) AS x, coalesce(e, []) AS e, coalesce(ey, []) AS ey, CASE WHEN len(coalesce(fy, [])) > 0 THEN fy ELSE coalesce(f, []) END AS f, len(coalesce(fy, [])) > 0 AS own_year, best, other FROM asked LEFT JOIN pools USING (query_id)),
ruled AS (SELECT *, CASE WHEN n = 0 THEN 1 WHEN y IS NULL AND len(x) = 1 THEN 2 WHEN y IS NULL THEN 3 WHEN nw = 0 THEN 4 WHEN len(ey) = 1 THEN 5 WHEN len(ey) > 1 AND -ey[1][1] >= 50 AND -ey[1][1] >= 10 * greatest(-ey[2][1], 1) THEN 6 WHEN len(ey) > 1 THEN 7
  WHEN len(e) = 1 THEN 8 WHEN len(e) > 1 AND -e[1][1] >= 50 AND -e[1][1] >= 10 * greatest(-e[2][1], 1) THEN 9 WHEN len(e) > 1 THEN 10 WHEN len(f) = 0 THEN 11 WHEN len(f) = 1 THEN 12 WHEN -f[1][1] >= 50 AND -f[1][1] >= 10 * greatest(-f[2][1], 1) THEN 13 ELSE 14 END AS rule FROM lists)"""


WRITTEN = "CASE film_id % 5 WHEN 3 THEN title || 'x' WHEN 4 THEN substring(title, 1, 9) ELSE upper(title) END"
ASKED = f"SELECT film_id AS query_id, title AS t, {WRITTEN} AS w, CASE WHEN film_id % 50 <> 7 THEN (year + film_id % 3 - 1)::INT END AS y FROM film"
NEAR = f"SELECT query_id, y, film_id, vote_count, abs(year - y) AS gap, year, {NORM.format(t='w')} AS q, {NORM.format(t='title')} AS c FROM asked JOIN film ON title = t AND coalesce(abs(year - y) <= 2, year = 1975)"
CHOOSE = f"WITH {v.FILM}, {choose_sql(ASKED, NEAR)}"
CHOSEN = """SELECT query_id, CASE WHEN rule = 2 THEN x[1][2] WHEN rule IN (5, 6) THEN ey[1][2] WHEN rule IN (8, 9) THEN e[1][2] WHEN rule IN (12, 13) THEN f[1][2] END AS film_id,
  CASE WHEN rule IN (2, 5) THEN 'exact' WHEN rule IN (6, 9, 13) THEN 'dominant' WHEN rule IN (8, 12) THEN 'trigram' ELSE 'unresolved' END AS match_method,
  round(CASE WHEN rule IN (2, 5) THEN 1.0 WHEN rule = 6 THEN ey[1][3] WHEN rule IN (8, 9) THEN 0.9 WHEN rule IN (12, 13) THEN f[1][3] END::DOUBLE, 6) AS confidence, rule IN (1, 3, 4, 11) AS no_film_candidate,
  CASE rule WHEN 1 THEN 'no candidate above threshold' WHEN 2 THEN 'exact title, no year available' WHEN 3 THEN 'no year, and title is not uniquely exact' WHEN 4 THEN 'no candidate within 1 year(s)' WHEN 5 THEN 'exact title and year'
    WHEN 6 THEN len(ey) || ' share title and year; ' || -ey[1][1] || ' votes dominate'
    WHEN 7 THEN len(ey) || ' candidates share title and year, none dominant' || CASE WHEN other[1] >= -10 * ey[1][1] THEN '; but ' || -other[2] || ' (' || other[3] || ', ' || other[1] || ' votes) is far more popular and one year off' ELSE '' END
    WHEN 8 THEN 'exact title, year off by 1' WHEN 9 THEN len(e) || ' exact titles near the year; ' || -e[1][1] || ' votes dominate' WHEN 10 THEN len(e) || ' exact titles near the year'
    WHEN 11 THEN 'best title similarity ' || printf('%.2f', best) || ' below 0.75' WHEN 12 THEN 'fuzzy title ' || printf('%.2f', f[1][3]) || ', year off by ' || CASE WHEN own_year THEN 0 ELSE 1 END
    WHEN 13 THEN len(f) || ' fuzzy candidates; ' || -f[1][1] || ' votes dominate' ELSE len(f) || ' fuzzy candidates, none dominant' END AS reason FROM ruled"""


@query("resolve_choose", f"{CHOOSE} {CHOSEN}")
def _(d):
    asked, near, members = _search(d)
    return rounded(resolve.choose_alike(asked, members, resolve.candidates(near, ascii_only=True)))


#: the local catalog's candidates: titles of the asked year by shared grams, the best 20
LOCAL = f"""SELECT a.query_id, a.y, f.film_id, f.vote_count, abs(f.year - a.y) AS gap, f.year, a.q, a.c FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, film_id) AS p FROM (
  SELECT o.query_id, o.y, f.film_id, o.q, f.c, len(list_intersect(o.g, f.g)) / len(list_distinct(list_concat(o.g, f.g))) AS sim
  FROM (SELECT *, {GRAMS.format(t='q')} AS g FROM (SELECT *, {NORM.format(t='w')} AS q FROM asked)) o JOIN (SELECT *, {GRAMS.format(t='c')} AS g FROM (SELECT *, {NORM.format(t='title')} AS c FROM film)) f ON f.year = o.y) WHERE sim >= 0.3) a JOIN film f USING (film_id) WHERE p <= 20"""
WATERFALL = f"""WITH {v.FILM}, all_asked AS ({ASKED}), known AS (SELECT * FROM all_asked WHERE query_id % 9 = 0), open AS (SELECT * FROM all_asked WHERE query_id % 9 <> 0),
local AS (SELECT * FROM (WITH {choose_sql('SELECT * FROM open', LOCAL)} {CHOSEN})), search AS (SELECT * FROM (WITH {choose_sql('SELECT o.* FROM open o JOIN local l USING (query_id) WHERE l.film_id IS NULL', NEAR)} {CHOSEN}))
SELECT query_id, query_id AS film_id, 'exact' AS match_method, 1.0::DOUBLE AS confidence, false AS no_film_candidate, '' AS reason, 'cache' AS stage FROM known
UNION ALL SELECT *, 'local' FROM local WHERE film_id IS NOT NULL
UNION ALL SELECT * REPLACE (CASE WHEN film_id IS NULL AND no_film_candidate AND query_id % 4 = 0 THEN 'television' ELSE match_method END AS match_method), 'search' FROM search"""


@query("resolve_waterfall", WATERFALL)
def _(d):
    asked, near, members = _search(d)
    known = asked.filter("query_id % 9 = 0").select("query_id", F.col("query_id").alias("film_id"), F.lit("exact").alias("match_method"), F.lit(1.0).alias("confidence"), F.lit(False).alias("no_film_candidate"), F.lit("").alias("reason"))
    films = d.films().select("film_id", "title", F.lit(None).cast("string").alias("original_title"), "year", "vote_count")
    shows = asked.select("query_id", F.col("query_title").alias("show_name"), F.lit(None).cast("string").alias("show_original_name"), F.col("query_year").alias("show_year")).filter("query_id % 4 = 0")
    return rounded(resolve.waterfall(asked, known, films, near, shows, members=members))


@query("upsert_coalesce", f"""WITH {v.FILM}, old AS (SELECT film_id, title, year, vote_average FROM film WHERE film_id % 3 <> 0), new AS (SELECT film_id, upper(title) AS title, CASE WHEN film_id % 2 = 0 THEN year + 1 END AS year, CASE WHEN film_id % 5 = 0 THEN 1.0 END AS vote_average FROM film WHERE film_id % 4 <> 0)
SELECT film_id, coalesce(n.title, o.title) AS title, coalesce(n.year, o.year) AS year, round(coalesce(n.vote_average, o.vote_average)::DOUBLE, 6) AS vote_average,
  CASE WHEN n.film_id IS NULL THEN '{{"id":1,"credits":{{}}}}' WHEN film_id % 7 = 0 THEN '{{"id":2,"credits":{{}}}}' WHEN o.film_id IS NULL THEN '{{"id":2}}' ELSE '{{"id":1,"credits":{{}}}}' END AS raw FROM old o FULL JOIN new n USING (film_id)""")
def _(d):
    films = d.films()
    blank = lambda t: F.lit(None).cast(t)
    old = films.filter("film_id % 3 <> 0").select("film_id", "title", blank("string").alias("original_title"), "year", "vote_average", blank("int").alias("vote_count"), blank("string").alias("country"), F.lit('{"id":1,"credits":{}}').alias("raw"))
    i = F.col("film_id")
    raw = F.when(i % 7 == 0, '{"id":2,"credits":{}}').otherwise('{"id":2}')
    new = films.filter("film_id % 4 <> 0").select("film_id", F.upper("title").alias("title"), blank("string").alias("original_title"), F.when(i % 2 == 0, F.col("year") + 1).alias("year"), F.when(i % 5 == 0, 1.0).alias("vote_average"), blank("int").alias("vote_count"), blank("string").alias("country"), raw.alias("raw"), F.lit(1).alias("seq"))
    return rounded(merge.upsert_films(old, new).select("film_id", "title", "year", "vote_average", "raw"))


@query("upsert_last", f"WITH {v.FILM} SELECT film_id, CASE WHEN film_id % 4 = 0 THEN upper(title) || ' b' ELSE title END AS title FROM film")
def _(d):
    table = d.films().select("film_id", "title")
    new = table.filter("film_id % 4 = 0")
    batch = new.withColumns({"title": F.concat(F.upper("title"), F.lit(" a")), "seq": F.lit(1)}).unionByName(new.withColumns({"title": F.concat(F.upper("title"), F.lit(" b")), "seq": F.lit(2)}))
    return merge.upsert_last(table, batch, "film_id")


@query("insert_new_people", "SELECT s_suppkey AS person_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'new ' || s_name END AS name FROM supplier")
def _(d):
    all_people = d.table("supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"))
    return merge.insert_new(all_people.filter("person_id % 2 = 0"), all_people.withColumn("name", F.concat(F.lit("new "), F.col("name"))), ["person_id"])


@query("placeholder_people", f"WITH {v.CREDIT} SELECT DISTINCT person_id, CASE WHEN person_id % 3 = 0 THEN 'held' ELSE 'person ' || person_id END AS name FROM credit")
def _(d):
    held = d.credits().select("person_id").distinct().filter("person_id % 3 = 0").withColumn("name", F.lit("held"))
    return merge.placeholders(held, d.credits())


def _payloads(d):
    """Payloads made of line items: crew in line order with repeats, cast with billing orders and a repeated person."""
    lines = d.table("lineitem").groupBy(F.col("l_partkey").alias("film_id")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey"))).alias("x"))
    crew = F.transform("x", lambda e: F.struct(e["l_suppkey"].cast("int").alias("id"), F.when(e["l_orderkey"] % 11 != 0, F.concat(F.lit("p"), e["l_suppkey"].cast("string"))).alias("name"), F.lit("Editing").alias("department"), F.when(e["l_linenumber"] < 4, "Editor").otherwise("Assistant").alias("job")))
    cast = F.transform("x", lambda e, i: F.struct(e["l_suppkey"].cast("int").alias("id"), F.concat(F.lit("p"), e["l_suppkey"].cast("string")).alias("name"), i.alias("order")))
    return lines.select("film_id", F.struct(F.struct(crew.alias("crew"), cast.alias("cast")).alias("credits")).alias("p"))


@query("credits_dedupe", "SELECT DISTINCT l_partkey AS film_id, l_suppkey::INT AS person_id, 'p' || l_suppkey AS name, 'Editing' AS department, CASE WHEN l_linenumber < 4 THEN 'Editor' ELSE 'Assistant' END AS job FROM lineitem WHERE l_orderkey % 11 <> 0")
def _(d):
    return merge.crew_credits(_payloads(d))


@query("cast_top_billed", "WITH r AS (SELECT l_partkey AS film_id, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS p FROM lineitem) SELECT DISTINCT film_id, l_suppkey::INT AS person_id, 'p' || l_suppkey AS name, 'Acting' AS department, 'Actor' AS job FROM r WHERE p <= 10")
def _(d):
    return merge.cast_credits(_payloads(d))


@query("json_genres", f"WITH {v.FILM} SELECT film_id, array_to_string(genres, ',') AS genres FROM film")
def _(d):
    made = F.to_json(F.struct(F.transform("genres", lambda g: F.struct(F.lit(1).alias("id"), g.alias("name"))).alias("genres")))
    return d.films().select("film_id", F.array_join(merge.genre_names(made), ",").alias("genres"))


@query("genre_ids", f"WITH {v.FILM} SELECT film_id, array_to_string(list_transform(list_filter([film_id % 3, film_id % 5, 9], lambda x: x < 3), lambda x: 'g' || x), ',') AS genres FROM film")
def _(d):
    names = F.create_map(*[F.lit(x) for i in range(3) for x in (i, f"g{i}")])
    ids = F.array((F.col("film_id") % 3).cast("int"), (F.col("film_id") % 5).cast("int"), F.lit(9))
    return d.films().select("film_id", F.array_join(merge.genre_ids_to_names(ids, names), ",").alias("genres"))


def _filmography(d):
    """Everyone's credits walked while the films before 1975 are held: new films, and credits."""
    films = d.films().select("film_id", "title", F.lit(None).cast("string").alias("original_title"), F.concat(F.col("year").cast("string"), F.lit("-01-01")).alias("release_date"), "vote_average", "vote_count")
    return merge.person_filmography(d.credits().join(films, "film_id"), d.films().filter("year < 1975"))


@query("person_filmography", f"WITH {v.FILM}, {v.CREDIT} SELECT DISTINCT film_id, person_id, department, job FROM credit JOIN film USING (film_id) WHERE role NOT IN ('director', 'actor') AND vote_count >= 20")
def _(d):
    return _filmography(d)[1]


@query("filmography_new_films", f"WITH {v.FILM}, {v.CREDIT} SELECT DISTINCT film_id, title, year::INT AS year, round(vote_average, 6) AS vote_average, vote_count FROM film JOIN credit USING (film_id) WHERE role NOT IN ('director', 'actor') AND vote_count >= 20 AND year >= 1975")
def _(d):
    return rounded(_filmography(d)[0].select("film_id", "title", "year", "vote_average", "vote_count"))


@query("stored_credits", "WITH c AS (SELECT DISTINCT l_partkey AS film_id, l_suppkey AS person_id, 'Editing' AS department, CASE WHEN l_linenumber < 4 THEN 'Editor' ELSE 'Assistant' END AS job FROM lineitem WHERE l_orderkey % 11 <> 0), r AS (SELECT l_partkey AS film_id, l_suppkey AS person_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS p FROM lineitem), a AS (SELECT * FROM c UNION ALL SELECT DISTINCT film_id, person_id, 'Acting', 'Actor' FROM r WHERE p <= 10) SELECT department, job, count(*)::BIGINT AS credits, count(DISTINCT film_id)::BIGINT AS films, (SELECT count(DISTINCT person_id) FROM a)::BIGINT AS people FROM a GROUP BY 1, 2")
def _(d):
    payloads = _payloads(d)
    held = merge.crew_credits(payloads).filter("person_id % 2 = 0")
    credits, people = merge.store_payload_credits(held.select("film_id", "person_id", "department", "job"), held.select("person_id", "name").distinct(), payloads)
    return credits.groupBy("department", "job").agg(F.count("*").alias("credits"), F.count_distinct("film_id").alias("films")).crossJoin(people.agg(F.count("*").alias("people")))


@query("release_facts", "SELECT l_returnflag AS kind, CASE WHEN l_linenumber < 5 THEN year(l_shipdate)::INT END AS year, CASE WHEN l_linenumber IN (1, 2) THEN l_returnflag || l_linestatus END AS country, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def _(d):
    day, n = F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_linenumber")
    date = F.when(n < 4, day).when(n == 4, F.substring(day, 1, 4)).when(n == 5, F.concat(F.lit("c."), day)).when(n == 6, F.lit(""))
    code = F.concat("l_returnflag", "l_linestatus")
    countries = F.when(n == 1, F.array(code, F.lit("XX"))).when(n == 2, F.array(code)).when(n == 3, F.array(F.lit("USA"))).when(n == 4, F.array().cast("array<string>"))
    return d.table("lineitem").groupBy(F.col("l_returnflag").alias("kind"), scalar.release_year(date).alias("year"), scalar.country_of(countries).alias("country")).agg(F.count("*").alias("n"))


@query("parse_years", "SELECT CASE WHEN l_linenumber IN (1, 2) THEN year(l_shipdate)::INT WHEN l_linenumber = 3 THEN 7 END AS year, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def _(d):
    day, n = F.date_format("l_shipdate", "yyyy"), F.col("l_linenumber")
    written = F.when(n == 1, day).when(n == 2, F.concat(F.lit("  "), day, F.lit(" "))).when(n == 3, F.lit("007")).when(n == 4, F.concat(day, F.lit("?"))).when(n == 5, F.lit("-5")).when(n == 6, F.lit("99999999999999"))
    return d.table("lineitem").groupBy(scalar.parse_year(written).alias("year")).agg(F.count("*").alias("n"))


@query("films_needed", f"WITH {v.FILM} SELECT film_id FROM film WHERE film_id % 3 <> 0 AND NOT (year < 1975 AND film_id % 4 <> 0)")
def _(d):
    from tasteplane.sources.catalog import needed

    films = d.films()
    resolved = films.select(F.when(F.col("film_id") % 3 != 0, F.col("film_id")).alias("film_id"))
    raw = F.when(F.col("film_id") % 4 != 0, '{"id":1,"credits":null}').otherwise('{"id":1,"other":"credits"}')
    return needed(resolved.union(resolved), films.filter("year < 1975").select("film_id", raw.alias("raw")))


@query("person_names", f"WITH {v.RATING}, {v.CREDIT} SELECT DISTINCT s_suppkey AS person_id, s_name AS name FROM supplier JOIN credit ON person_id = s_suppkey JOIN rating USING (film_id) WHERE role = 'editor'")
def _(d):
    from tasteplane.operators import library

    people = d.table("supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"))
    return library.person_names(d.film_credits().filter("role = 'editor'"), people)


@query("unmodelled_credits", f"WITH {v.CREDIT} SELECT CASE WHEN person_id % 5 = 0 THEN NULL ELSE role END AS role, count(*)::BIGINT AS n FROM credit GROUP BY 1")
def _(d):
    from tasteplane.operators.roles import with_roles

    odd = d.credits().withColumn("job", F.when(F.col("person_id") % 5 == 0, F.concat(F.lit("Assistant "), F.col("job"))).otherwise(F.col("job")))
    return with_roles(odd, keep_unmodelled=True).groupBy("role").agg(F.count("*").alias("n"))


@query("delete_upload", f"WITH {v.RATING} SELECT upload_id, count(*)::BIGINT AS n FROM rating WHERE upload_id NOT LIKE 'B%' GROUP BY 1")
def _(d):
    r = d.ratings()
    return merge.delete_upload(r, r.select("upload_id").distinct().filter("upload_id LIKE 'B%'")).groupBy("upload_id").agg(F.count("*").alias("n"))


@query("parse_ratings_skips", """SELECT CASE WHEN l_linenumber = 1 THEN 'ratings:missing_uri_or_name' WHEN l_quantity::INT % 7 = 0 OR l_quantity > 40 OR l_quantity < 4 OR (l_quantity / 8) % 0.5 <> 0 THEN 'ratings:unusable_rating' END AS skip, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""")
def _(d):
    from tasteplane.sources.export import parse_ratings

    q = F.col("l_quantity")
    rows = d.table("lineitem").select(
        F.when(F.col("l_linenumber") != 1, F.concat(F.lit("u"), F.col("l_orderkey").cast("string"))).alias("uri"), F.lit(" name ").alias("name"), F.lit("1999").alias("year"),
        F.when(q.cast("int") % 7 == 0, "n/a").otherwise((q / 8).cast("string")).alias("rating"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
    )
    return parse_ratings(rows).groupBy("skip").agg(F.count("*").alias("n"))


@query("parse_dates", "SELECT l_shipmonth AS month, count(*)::BIGINT AS n FROM (SELECT CASE WHEN l_linenumber = 2 THEN NULL ELSE strftime(l_shipdate, '%Y-%m') END AS l_shipmonth FROM lineitem) GROUP BY 1")
def _(d):
    written = F.when(F.col("l_linenumber") == 2, F.date_format("l_shipdate", "dd/MM/yyyy")).otherwise(F.date_format("l_shipdate", " yyyy-MM-dd "))
    return d.table("lineitem").groupBy(scalar.month(scalar.parse_date(written)).alias("month")).agg(F.count("*").alias("n"))
