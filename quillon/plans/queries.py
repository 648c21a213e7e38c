"""Queries over the stand-in tables, each with the SQL that it equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillon.functions import classify, email, rules, text, web
from quillon.operators import crawl, match, merge, upsert
from quillon.plans import views
from quillon.plans.views import schools, staff, table, with_views
from quillon.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, and its SQL where it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staff with their schools."""
    s = schools(spark, sf_dir).select(F.col("id").alias("sid"), "school_name", "city", "state", "district_name", "website_url", "directory_url")
    return staff(spark, sf_dir).join(s, F.col("school_id") == F.col("sid")).drop("sid")


def like(term: str, *columns: str) -> Column:
    """Any of the columns holds the term, in either case; the term's % and _ are wildcards."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False))
    return out


JOIN = "staff t JOIN schools s ON t.school_id = s.id"
#: The SQL of the merged contact list.
GROUPED = f"""
j AS (SELECT t.id, teacher_name, title, email, resolution_method, school_name, city, state, district_name, website_url, directory_url,
  row_number() OVER (PARTITION BY teacher_name, district_name, state ORDER BY CASE WHEN coalesce(email, '') = '' THEN 1 ELSE 0 END, school_name, t.id) AS best
  FROM {JOIN}),
g AS (SELECT teacher_name, district_name, state, string_agg(DISTINCT school_name, ', ' ORDER BY school_name) AS school_name, string_agg(DISTINCT city, ', ' ORDER BY city) AS city,
  max(CASE WHEN best = 1 THEN title END) AS title, max(CASE WHEN best = 1 THEN email END) AS email, max(CASE WHEN best = 1 THEN resolution_method END) AS resolution_method,
  max(CASE WHEN best = 1 THEN website_url END) AS website_url, max(CASE WHEN best = 1 THEN directory_url END) AS directory_url, string_agg(CAST(id AS STRING), ',' ORDER BY school_name, id) AS ids, min(school_name) AS first_school
  FROM j GROUP BY teacher_name, district_name, state)"""


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.group_contacts(joined(spark, sf_dir), ["school_name", "id"])


@query(with_views("SELECT state, district_name, school_name, city, teacher_name, title, CASE WHEN resolution_method IN ('send_message_button', 'contact_form') OR email LIKE 'http%' THEN 'contact on website' ELSE coalesce(email, '') END AS contact, resolution_method, coalesce(directory_url, website_url) AS url FROM g", GROUPED))
def export_contacts(spark, sf_dir):
    """The merged contact list, labelled and sorted for export."""
    g = grouped(spark, sf_dir)
    out = g.select("state", "district_name", "school_name", "city", "teacher_name", "title", email.contact_label(F.col("resolution_method"), F.col("email")).alias("contact"), "resolution_method", F.coalesce("directory_url", "website_url").alias("url"))
    return out.orderBy("state", "district_name", "school_name", "teacher_name")


@query(with_views("SELECT (SELECT count(*) FROM schools) AS schools, (SELECT count(*) FROM schools WHERE scraped = 1) AS scraped, (SELECT count(*) FROM schools WHERE is_arts_school = 1) AS arts, (SELECT count(*) FROM staff) AS teachers, (SELECT count(*) FROM staff WHERE email IS NOT NULL AND email <> '') AS with_email"))
def stats_counters(spark, sf_dir):
    s = schools(spark, sf_dir).agg(F.count("*").alias("schools"), F.count_if(F.col("scraped") == 1).alias("scraped"), F.count_if(F.col("is_arts_school") == 1).alias("arts"))
    t = staff(spark, sf_dir).agg(F.count("*").alias("teachers"), F.count_if(F.col("email") != "").alias("with_email"))
    return s.crossJoin(t)  # one row each


@query(with_views("SELECT id, school_name, city, state, count(*) OVER () AS total FROM schools WHERE school_name ILIKE '%high%' OR city ILIKE '%high%' OR district_name ILIKE '%high%' ORDER BY school_name, id LIMIT 50"))
def schools_search_page(spark, sf_dir):
    hit = schools(spark, sf_dir).filter(like("high", "school_name", "city", "district_name"))
    total = hit.agg(F.count("*").alias("total"))
    return merge.page(hit.select("id", "school_name", "city", "state"), ["school_name", "id"], 1).crossJoin(F.broadcast(total))  # one row


@query(with_views("SELECT id, school_name, website_url FROM schools WHERE website_url IS NOT NULL AND website_url <> '' AND state IN ('NATION_1', 'NATION_4', 'NATION_9', 'NATION_12')"))
def schools_only_url(spark, sf_dir):
    return schools(spark, sf_dir).filter((F.col("website_url") != "") & F.col("state").isin("NATION_1", "NATION_4", "NATION_9", "NATION_12")).select("id", "school_name", "website_url")


@query(with_views(f"SELECT t.id, teacher_name, title, email, school_name, state FROM {JOIN} WHERE coalesce(email, '') <> ''"))
def teachers_join(spark, sf_dir):
    return joined(spark, sf_dir).filter("email <> ''").select("id", "teacher_name", "title", "email", "school_name", "state")


@query(with_views("SELECT teacher_name, district_name, state, school_name, city, title, email, resolution_method, website_url, directory_url, ids FROM g", GROUPED))
def teachers_grouped(spark, sf_dir):
    return grouped(spark, sf_dir).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).drop("first_seen")


@query(with_views("SELECT teacher_name, district_name, state, school_name FROM g ORDER BY state, first_school, teacher_name, district_name LIMIT 50 OFFSET 50", GROUPED))
def teachers_grouped_page(spark, sf_dir):
    g = grouped(spark, sf_dir).withColumn("first_school", F.col("first_seen.school_name"))
    return merge.page(g, ["state", "first_school", "teacher_name", "district_name"], 2).select("teacher_name", "district_name", "state", "school_name")


@query(with_views("SELECT s.id, school_name, scraped, count(t.id) AS teacher_count FROM schools s LEFT JOIN staff t ON t.school_id = s.id WHERE is_arts_school = 1 GROUP BY s.id, school_name, scraped"))
def art_schools_count(spark, sf_dir):
    n = staff(spark, sf_dir).groupBy("school_id").agg(F.count("*").alias("n"))
    s = schools(spark, sf_dir).filter("is_arts_school = 1")
    return s.join(n, s["id"] == n["school_id"], "left").select("id", "school_name", "scraped", F.coalesce("n", F.lit(0)).alias("teacher_count")).orderBy(F.desc("scraped"), "school_name")


@query(with_views("SELECT id, teacher_name, added_at FROM staff WHERE added_at >= '2024-07-25'"))
def added_since(spark, sf_dir):
    """Rows of the month before a given day, by their text time."""
    return staff(spark, sf_dir).filter(F.to_timestamp("added_at") >= F.to_timestamp(F.lit("2024-07-25"))).select("id", "teacher_name", "added_at")


_MISSED = ", ".join(f"'{s}'" for s in rules.MISSED + rules.LEGACY_MISSED)


@query(with_views(f"SELECT id, CAST(CASE WHEN scrape_status IN ({_MISSED}) OR scrape_status LIKE 'error:%' THEN 0 ELSE scraped END AS INT) AS scraped, scrape_status FROM schools"))
def rescrape_reset(spark, sf_dir):
    missed = F.col("scrape_status").isin(rules.MISSED + rules.LEGACY_MISSED) | F.col("scrape_status").startswith("error:")
    return upsert.update_where(schools(spark, sf_dir).select("id", "scraped", "scrape_status"), missed, scraped=F.lit(0))[0]


@query(with_views(f"SELECT count(*) AS changed FROM schools WHERE scrape_status IN ({_MISSED}) OR scrape_status LIKE 'error:%'"))
def rescrape_reset_count(spark, sf_dir):
    missed = F.col("scrape_status").isin(rules.MISSED + rules.LEGACY_MISSED) | F.col("scrape_status").startswith("error:")
    return upsert.update_where(schools(spark, sf_dir), missed, scraped=F.lit(0))[1]


@query(with_views("SELECT id, school_name, is_arts_school FROM schools WHERE scraped = 0 ORDER BY is_arts_school DESC, school_name, id LIMIT 20"))
def scrape_queue_topk(spark, sf_dir):
    return schools(spark, sf_dir).filter("scraped = 0").orderBy(F.desc("is_arts_school"), "school_name", "id").limit(20).select("id", "school_name", "is_arts_school")


_MIDDLE = """CASE WHEN trim(level) IN ('2', '3') THEN true WHEN trim(level) = '1' THEN false WHEN regexp_matches(lower(level), 'middle|high|secondary') THEN true WHEN regexp_matches(lower(level), 'elementary|primary|prekindergarten') THEN false
 WHEN high_grade <> '' AND coalesce(TRY_CAST(high_grade AS INT), CASE WHEN high_grade IN ('KG', 'K') THEN 0 ELSE -1 END) >= 6 THEN true WHEN high_grade <> '' AND coalesce(TRY_CAST(high_grade AS INT), CASE WHEN high_grade IN ('KG', 'K') THEN 0 ELSE -1 END) >= 0 THEN false
 ELSE NOT regexp_matches(lower(school_name), '\\b(elementary|primary|elem\\b|primaria|pre.?k)\\b') END"""


@query(with_views(f"SELECT id, school_name, level, high_grade FROM schools WHERE {_MIDDLE} AND trim(open_status) IN ('Open', 'New', '1', '3', '')"))
def ingest_filter(spark, sf_dir):
    s = schools(spark, sf_dir)
    return s.filter(classify.middle_or_high(F.col("level"), F.col("high_grade"), F.col("school_name")) & F.trim("open_status").isin(rules.OPEN_STATUSES)).select("id", "school_name", "level", "high_grade")


@query(with_views(f"SELECT nces_id, school_name, state FROM (SELECT nces_id, school_name, state, row_number() OVER (PARTITION BY nces_id ORDER BY id) AS n FROM schools WHERE {_MIDDLE} AND trim(open_status) IN ('Open', 'New', '1', '3', '')) WHERE n = 1 AND nces_id NOT IN (SELECT nces_id FROM schools WHERE id % 4 = 0)"))
def ingest_dedupe_insert(spark, sf_dir):
    s = schools(spark, sf_dir)
    rows = s.select(F.col("nces_id").alias("NCESSCH"), F.col("school_name").alias("SCH_NAME"), F.col("city").alias("LCITY"), F.col("state").alias("ST"), F.col("district_name").alias("LEA_NAME"), F.col("level").alias("SCHOOL_LEVEL"), F.col("high_grade").alias("GSHI"), F.col("open_status").alias("SY_STATUS_TEXT"), "id")
    return readers.ingest(rows.unionAll(rows), "id", have=s.filter("id % 4 = 0")).select("nces_id", "school_name", "state")


@query(with_views("SELECT id, CASE WHEN id % 3 = 0 THEN 'OK' ELSE scrape_status END AS scrape_status, CASE WHEN id % 3 = 0 THEN 'https://new.example.org' ELSE directory_url END AS directory_url FROM schools"))
def upsert_update(spark, sf_dir):
    s = schools(spark, sf_dir).select("id", "scrape_status", "directory_url")
    new = s.filter("id % 3 = 0").select("id", F.lit("OK").alias("scrape_status"), F.lit("https://new.example.org").alias("directory_url"))
    return upsert.update(s, new, "id", ["scrape_status", "directory_url"])


@query(with_views("SELECT id, school_id, teacher_name FROM staff WHERE school_id NOT IN (3, 5, 8)"))
def delete_cascade(spark, sf_dir):
    ids = spark.range(1).select(F.explode(F.array(*map(F.lit, upsert.parse_ids("3, x, 5,8")))).alias("id"))
    return upsert.delete_cascade(schools(spark, sf_dir), staff(spark, sf_dir), F.broadcast(ids))[1].select("id", "school_id", "teacher_name")


_RECASED = "CASE teacher_name WHEN 'ANNA LINDQVIST' THEN 'Anna Lindqvist' WHEN 'carla mcdowell' THEN 'Carla McDowell' WHEN 'FELIX VAN DOREN III' THEN 'Felix Van Doren III' ELSE teacher_name END"
_UPPER = "CASE WHEN id % 2 = 0 THEN upper(teacher_name) ELSE teacher_name END"


@query(with_views(f"SELECT id, teacher_name FROM (SELECT id, {_RECASED.replace('CASE teacher_name', 'CASE teacher_name')} AS teacher_name, row_number() OVER (PARTITION BY school_id % 7, {_RECASED} ORDER BY CASE WHEN teacher_name = {_RECASED} THEN 0 ELSE 1 END, id) AS n FROM staff) WHERE n = 1"))
def collision_cleanup(spark, sf_dir):
    s = staff(spark, sf_dir).withColumn("grp", F.col("school_id") % 7)
    return upsert.recase(s, "teacher_name", ["grp"], text.person_name, drop=True).select("id", "teacher_name")


@query(with_views(f"SELECT id, {_RECASED} AS name FROM staff"))
def person_recase(spark, sf_dir):
    return staff(spark, sf_dir).select("id", text.person_name(F.col("teacher_name")).alias("name"))


@query("SELECT p_partkey, list_aggregate(list_transform(string_split(upper(p_name), ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS name FROM part")
def title_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.title_case(F.upper("p_name")).alias("name"))


@query(with_views("SELECT id, trim(regexp_replace(regexp_replace(replace(replace(lower(school_name || ' Elem & Jr'), '&', ' and '), '+', ' and '), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')).replace(' elem ', ' elementary ').replace(' jr', ' junior') AS norm FROM schools"))
def normalize_name(spark, sf_dir):
    return schools(spark, sf_dir).select("id", text.normalize_name(F.concat("school_name", F.lit(" Elem & Jr"))).alias("norm"))


@query(with_views("SELECT id, list_aggregate(list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(school_name), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')), ' '), lambda w: w NOT IN ('the', 'of', 'at', 'and', 'a', 'an', 'for')), lambda w: w[1]), 'string_agg', '') AS acronym FROM schools"))
def acronym(spark, sf_dir):
    return schools(spark, sf_dir).select("id", text.acronym(text.normalize_name(F.col("school_name"))).alias("acronym"))


_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
_WORD = "^[A-Z][A-Za-z]*([''-][A-Z][A-Za-z]*)*[.]?$"
_NAV = ", ".join(f"'{w}'" for w in rules.NAV_WORDS)
_ART = "|".join(p.replace("\\b", "") for p, _ in rules.DISCIPLINES)


def _valid_name(c: str) -> str:
    w = f"list_filter(string_split(regexp_replace({c}, '\\s+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"""(len({w}) BETWEEN 2 AND 5 AND length({c}) <= 60 AND NOT regexp_matches({c}, '[0-9&/:@|]') AND NOT regexp_matches({c}, '(?i)\\b({_ART})\\b')
 AND (len(list_filter({w}, lambda x: length(trim(x, '.,')) >= 2 AND x = upper(x) AND x <> lower(x))) IN (0, len({w})))
 AND NOT list_has_any(list_transform({w}, lambda x: lower(trim(x, '.,'))), [{_NAV}]) AND NOT list_has_any(list_transform({w}, lambda x: regexp_replace(lower(trim(x, '.,')), 's$', '')), [{_NAV}])
 AND len(list_filter({w}, lambda x: NOT regexp_matches(x, '{_WORD}'))) = 0)"""


def lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query()
def name_valid(spark, sf_dir):
    """Lines that are names.  Its Unicode rules are tested against brute force."""
    return lines(spark, sf_dir).filter(text.valid_name(F.col("line"))).select("doc_id", "pos", F.col("line").alias("name"))


@query()
def title_valid(spark, sf_dir):
    """Lines that may be titles.  Its Unicode rules are tested against brute force."""
    return lines(spark, sf_dir).filter(text.valid_title(F.col("line"))).select("doc_id", "pos", "line")


@query(with_views(f"SELECT id, name, title FROM (SELECT id, {_RECASED} AS name, title FROM staff) WHERE title <> '' AND {_valid_name('name')}"))
def split_name_title(spark, sf_dir):
    line = F.concat(text.person_name(F.col("teacher_name")), F.when(F.col("id") % 3 == 0, ", ").when(F.col("id") % 3 == 1, " : ").otherwise(" – "), F.col("title"))
    return staff(spark, sf_dir).select("id", text.split_name_title(line).alias("p")).filter("p IS NOT NULL").select("id", "p.name", "p.title")


@query(with_views("SELECT id, CASE WHEN id % 2 = 0 THEN teacher_name || ' Vale' ELSE teacher_name END AS name FROM staff"))
def last_first(spark, sf_dir):
    return staff(spark, sf_dir).select("id", text.last_first(F.when(F.col("id") % 2 == 0, F.concat(F.lit("Vale, "), F.col("teacher_name"))).otherwise(F.col("teacher_name"))).alias("name"))


@query(with_views("SELECT CAST(id AS BIGINT) AS id, CAST(2 AS INT) AS n, 'Bruno Ashford' AS first_name, CASE WHEN title = 'Art Teacher. Send a Message' THEN 'Art Teacher.' ELSE title END AS first_title FROM staff"))
def table_rows(spark, sf_dir):
    rows = F.array(F.lit("Name\tTitle"), F.concat(F.lit("Ashford, Bruno\t"), F.col("title"), F.lit("\tEmail")), F.lit("Holm, Greta\tCounselor\tEmail"))
    t = text.table_rows(rows)
    return staff(spark, sf_dir).select("id", F.size(t).alias("n"), t[0]["name"].alias("first_name"), t[0]["title"].alias("first_title"))


def _terms() -> str:
    whens = lambda out: " ".join(f"WHEN regexp_matches(t, '(?i)\\b({p})\\b') THEN {out(p, d)}" for p, d in rules.DISCIPLINES)
    return f"coalesce(CASE {whens(lambda p, d: repr(d))} END, 'unknown') AS discipline, CASE {whens(lambda p, d: f'regexp_extract(t, {chr(39)}(?i){chr(92)}b({p}){chr(92)}b{chr(39)}, 1)')} END AS matched_term"


_STRIPPED = "regexp_replace(title, '(?i)" + "|".join(rules.EXCLUDE_PHRASES) + "', ' ', 'g')"


@query(with_views(f"SELECT id, matched_term IS NOT NULL AS is_art, discipline, matched_term FROM (SELECT id, {_terms()} FROM (SELECT id, {_STRIPPED} AS t FROM staff))"))
def classify_discipline(spark, sf_dir):
    return staff(spark, sf_dir).select("id", classify.classify(F.col("title")).alias("c")).select("id", "c.*")


@query(with_views(f"SELECT id, regexp_matches(title, '(?i){rules.EXCLUDED_ROLE}') AS excluded FROM staff"))
def excluded_role(spark, sf_dir):
    return staff(spark, sf_dir).select("id", classify.excluded_role(F.col("title")).alias("excluded"))


@query(with_views("SELECT id, CASE WHEN title = 'Landry - Art' THEN 'Landry' WHEN title = 'Art Teacher - FJH' THEN 'FJH' END AS tag FROM staff"))
def campus_tag(spark, sf_dir):
    return staff(spark, sf_dir).select("id", text.campus_tag(F.col("title")).alias("tag"))


@query(with_views("SELECT id, page_id FROM (SELECT id, school_id AS page_id, title, count(DISTINCT CASE WHEN title = 'Landry - Art' THEN 'Landry' WHEN title = 'Art Teacher - FJH' THEN 'FJH' END) OVER (PARTITION BY school_id) AS n FROM staff) WHERE n < 2 OR title NOT IN ('Art Teacher - FJH')"))
def campus_filter(spark, sf_dir):
    rows = staff(spark, sf_dir).select("id", F.col("school_id").alias("page_id"), "title", F.lit("Landry Elementary School").alias("school_name"))
    return crawl.drop_other_campus(rows).select("id", "page_id")


@query(f"WITH e AS (SELECT doc_id, regexp_extract_all(text, '{rules.EMAIL}') AS x FROM documents) SELECT doc_id, len(x)::INT AS n, x[1] AS first_email FROM e WHERE len(x) > 0")
def email_extract(spark, sf_dir):
    x = F.regexp_extract_all("text", F.lit(f"({rules.EMAIL})"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", x.alias("x")).filter("size(x) > 0").select("doc_id", F.size("x").alias("n"), F.col("x")[0].alias("first_email"))


@query(with_views("SELECT id, concat('person', id, '@example.org') AS email, CASE WHEN id % 3 = 2 THEN 'MAILTO' ELSE 'JS_DECODED' END AS source FROM staff"))
def munge_decode(spark, sf_dir):
    p = F.concat(F.lit("person"), F.col("id").cast("string"))
    t = F.when(F.col("id") % 3 == 0, F.concat(p, F.lit(" [at] example [dot] org"))).when(F.col("id") % 3 == 1, F.concat(p, F.lit("(at)example.org"))).otherwise(F.concat(p, F.lit("@exam​ple.org")))
    return staff(spark, sf_dir).select("id", email.munge_decode(t).alias("d")).select("id", "d.*")


@query(with_views("SELECT id, CASE WHEN id % 4 <> 0 THEN concat('person', id, '@example.org') END AS email FROM staff"))
def cf_decode(spark, sf_dir):
    plain = F.concat(F.lit("person"), F.col("id").cast("string"), F.lit("@example.org"))
    coded = F.concat(F.lit("2a"), F.array_join(F.transform(F.split(plain, ""), lambda c: F.lpad(F.lower(F.hex(F.ascii(c).bitwiseXOR(F.lit(42)))), 2, "0")), ""))
    return staff(spark, sf_dir).select("id", email.cf_decode(F.when(F.col("id") % 4 == 0, "zz11").otherwise(coded)).alias("email"))


@query(with_views("SELECT id, coalesce(email LIKE 'alindqvist%' AND teacher_name = 'ANNA LINDQVIST', false) AS ok FROM staff"))
def email_name_match(spark, sf_dir):
    return staff(spark, sf_dir).select("id", text.email_matches_name(F.when(~F.col("email").startswith("http"), F.col("email")), F.col("teacher_name")).alias("ok"))


@query(with_views("SELECT id, CASE WHEN coalesce(email, '') = '' THEN concat('person', id, '@example.org') ELSE email END AS email, CASE WHEN email LIKE 'http%' THEN NULL WHEN coalesce(email, '') = '' THEN 'JS_DECODED' ELSE 'MAILTO' END AS source FROM staff"))
def resolve_email(spark, sf_dir):
    link = F.when(F.col("email").contains("@"), F.concat(F.lit("mailto:"), F.col("email"), F.lit("?subject=x"))).otherwise(F.col("email"))
    txt = F.when(F.coalesce(F.col("email"), F.lit("")) == "", F.concat(F.lit("person"), F.col("id").cast("string"), F.lit(" (at) example (dot) org")))
    return staff(spark, sf_dir).select("id", email.resolve_email(link, F.lit(None).cast("string"), txt).alias("d")).select("id", "d.*")


@query(with_views("SELECT id, CASE WHEN coalesce(email, '') = '' THEN 'unresolved' WHEN email LIKE 'http%' THEN 'send_message_button' ELSE 'scraped' END AS method FROM staff"))
def resolution_method(spark, sf_dir):
    return staff(spark, sf_dir).select("id", email.resolution_method(F.col("email")).alias("method"))


_PARTS = f"parts AS (SELECT id, lower(string_split({_RECASED}, ' ')[1]) AS f, lower(string_split({_RECASED}, ' ')[-1]) AS l FROM staff)"


@query(with_views("SELECT id, pos, candidate FROM (SELECT id, unnest([0, 1, 2, 3, 4, 5, 6]) AS pos, unnest([f || '.' || l, f[1] || l, f || l, f || l[1], l || f[1], f, l]) || '@example.org' AS candidate FROM parts)", _PARTS))
def email_candidates(spark, sf_dir):
    f, last = email.name_parts(F.col("teacher_name"))
    return staff(spark, sf_dir).select("id", F.posexplode(email.candidates(f, last, F.lit("example.org"))).alias("pos", "candidate"))


@query(with_views("SELECT domain, min(p) AS pattern FROM (SELECT concat('d', CAST(id % 6 AS STRING)) AS domain, CASE WHEN id % 6 >= 4 AND id % 12 < 6 THEN 'flast' WHEN id % 6 = 2 THEN 'flast' ELSE 'first.last' END AS p FROM parts) GROUP BY domain HAVING count(DISTINCT p) = 1", _PARTS))
def pattern_consensus(spark, sf_dir):
    f, last = email.name_parts(F.col("teacher_name"))
    i = F.col("id")
    local = F.when(((i % 6 >= 4) & (i % 12 < 6)) | (i % 6 == 2), F.concat(F.substring("first", 1, 1), F.col("last"))).otherwise(F.concat("first", F.lit("."), "last"))
    rows = staff(spark, sf_dir).select(i, f.alias("first"), last.alias("last"), F.concat(F.lit("d"), (i % 6).cast("string")).alias("domain"))
    return match.consensus(rows.withColumn("email", F.concat(local, F.lit("@x.org"))))


@query("SELECT domain, arg_min(exchange, preference) AS exchange FROM (SELECT concat('d', CAST(s_nationkey AS STRING)) AS domain, concat('mx', CAST(s_suppkey AS STRING), '.example.org') AS exchange, s_suppkey * 37 % 1009 AS preference FROM supplier) GROUP BY domain")
def mx_top1(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return crawl.mx_top(s.select(F.concat(F.lit("d"), F.col("s_nationkey").cast("string")).alias("domain"), F.concat(F.lit("mx"), F.col("s_suppkey").cast("string"), F.lit(".example.org.")).alias("exchange"), (F.col("s_suppkey") * 37 % 1009).alias("preference"), F.col("s_suppkey").alias("ord")))


@query(with_views("SELECT id, CASE WHEN website_url IS NULL THEN NULL WHEN website_url LIKE 'http%' THEN website_url ELSE 'https://' || website_url END AS url FROM schools"))
def url_normalize(spark, sf_dir):
    return schools(spark, sf_dir).select("id", web.normalize_url(F.coalesce("website_url", F.lit("†"))).alias("url"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), '^www\\.', '') AS host FROM pages")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", web.domain(F.col("url")).alias("host"))


_HREFS = "[regexp_extract(url, '^[^?]*', 0) || '?page=' || (page_id % 7), regexp_extract(url, '^[^?]*', 0) || '?x=1&p=' || (page_id % 5), '/about']"


@query("WITH h AS (SELECT page_id, regexp_extract(url, '^[^?]*', 0) AS u, CAST(page_id % 7 AS INT) AS a, CAST(page_id % 5 AS INT) AS b FROM pages) SELECT page_id, CASE WHEN greatest(a, b) <= 1 THEN NULL WHEN a >= b THEN 'page' ELSE 'p' END AS param, greatest(a, b, 1) AS max_page, CASE WHEN greatest(a, b) <= 1 THEN NULL WHEN a >= b THEN u ELSE u || '?x=1' END AS base FROM h")
def pagination(spark, sf_dir):
    u = F.regexp_extract("url", "^[^?]*", 0)
    h = F.array(F.concat(u, F.lit("?page="), (F.col("page_id") % 7).cast("string")), F.concat(u, F.lit("?x=1&p="), (F.col("page_id") % 5).cast("string")), F.lit("/about"))
    return table(spark, sf_dir, "pages").select("page_id", web.find_pagination(h).alias("p")).select("page_id", "p.*")


@query("SELECT page_id, CAST(i - 2 AS INT) AS pos, regexp_extract(url, '^[^?]*', 0) || '?page=' || i AS next_url FROM (SELECT page_id, url, unnest(generate_series(2, page_id % 5)) AS i FROM pages)")
def paginated_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(web.paginated_urls(F.lit("page"), (F.col("page_id") % 5).cast("int"), F.regexp_extract("url", "^[^?]*", 0))).alias("pos", "next_url"))


def titled_pages(spark, sf_dir) -> DataFrame:
    """Page snapshots with links and forms that the test pages lack."""
    i = F.col("page_id")
    extra = F.concat(F.lit('<a href="/staff-'), i.cast("string"), F.lit('"><b>Staff</b> Directory</a><a href="#">Faculty</a><a href="/lunch">Lunch</a>'), F.when(i % 3 == 0, '<link href="/wp-content/x.css">').when(i % 3 == 1, '<script src="https://cdn.finalsite.net"></script>').otherwise(""), F.when(i % 2 == 0, '<form action="/find"><input type="search"></form>').otherwise(""), F.lit("<a>"), F.char(65 + (i % 26).cast("int")), F.lit("</a> <a> b </a>"))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", extra).alias("html"))


@query("SELECT page_id, '/staff-' || page_id AS href, 'Staff Directory' AS text FROM pages")
def nav_links(spark, sf_dir):
    return titled_pages(spark, sf_dir).select("page_id", F.explode(web.nav_links(F.col("html"))).alias("l")).select("page_id", "l.*")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'wordpress' WHEN 1 THEN 'finalsite' END AS cms, CAST(CASE page_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 0 END AS INT) AS paths FROM pages")
def cms_detect(spark, sf_dir):
    c = web.detect_cms(F.col("html"))
    return titled_pages(spark, sf_dir).select("page_id", c.alias("cms"), F.size(web.cms_paths(c)).alias("paths"))


@query("SELECT page_id, page_id % 2 = 0 AS has_search, CASE WHEN page_id % 2 = 0 THEN 'https://x.example.org/find?q=staff%20directory' END AS search_url FROM pages")
def internal_search(spark, sf_dir):
    return titled_pages(spark, sf_dir).select("page_id", web.has_search(F.col("html")).alias("has_search"), web.search_url(F.col("html"), F.lit("https://x.example.org/a/"), "staff directory").alias("search_url"))


@query("WITH l AS (SELECT page_id, list_distinct(list_transform(regexp_extract_all(html || '<a>' || chr(65 + CAST(page_id % 26 AS INT)) || '</a> <a> b </a>', '>\\s*([A-Za-z])\\s*<', 1), lambda x: upper(x))) AS x FROM pages) SELECT page_id, list_aggregate(list_sort(x), 'string_agg', '') AS letters FROM l")
def letter_anchors(spark, sf_dir):
    return titled_pages(spark, sf_dir).select("page_id", F.array_join(F.sort_array(web.letter_anchors(F.col("html"))), "").alias("letters"))


@query("SELECT page_id, page_id % 3 = 0 OR page_id % 4 = 3 AS is_directory FROM pages")
def directory_score(spark, sf_dir):
    i = F.col("page_id")
    html = F.concat(F.repeat(F.lit('<a href="mailto:x@example.org">mail</a>'), F.when(i % 3 == 0, 3).otherwise(1)), F.repeat(F.lit(" staff"), (i % 4).cast("int")), F.lit(""))
    html = F.when((i % 3 != 0) & (i % 4 == 2), F.lit("<p>staff staff</p>")).otherwise(html)
    return table(spark, sf_dir, "pages").select("page_id", web.looks_like_directory(html).alias("is_directory"))


_CAND = "c AS (SELECT page_id // 10 AS site, url, CASE WHEN page_id // 10 % 3 = 0 THEN 403 ELSE 200 END AS status, page_id % 10 >= 4 + page_id // 10 % 8 AS ok, page_id % 3 AS priority, page_id AS ord FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY priority, ord) AS n FROM c), h AS (SELECT *, min(CASE WHEN ok THEN n END) OVER (PARTITION BY site) AS hit FROM n)"


def candidates(spark, sf_dir) -> DataFrame:
    i, site = F.col("page_id"), F.expr("page_id div 10")
    return table(spark, sf_dir, "pages").select(site.alias("site"), "url", F.when(site % 3 == 0, 403).otherwise(200).alias("status"), (i % 10 >= 4 + site % 8).alias("ok"), (i % 3).alias("priority"), i.alias("ord"))


@query(f"WITH {_CAND} SELECT site, max(CASE WHEN n = hit THEN url END) AS directory_url, count(*) AS tried FROM h WHERE hit IS NULL OR n <= hit GROUP BY site")
def first_match_probe(spark, sf_dir):
    return crawl.first_match(candidates(spark, sf_dir)).select("site", "directory_url", "tried")


@query(f"WITH {_CAND} SELECT site, bool_and(status IN (403, 429, 503)) AS all_blocked FROM h WHERE hit IS NULL OR n <= hit GROUP BY site")
def all_blocked(spark, sf_dir):
    return crawl.first_match(candidates(spark, sf_dir)).select("site", "all_blocked")


@query(f"""WITH {_CAND} SELECT site, '[' || string_agg('{{"url":"' || url || '","status":' || status || ',"rejected_because":' || CASE WHEN ok THEN 'null' ELSE '"no match"' END || '}}', ',' ORDER BY n) || ']' AS paths_attempted FROM h WHERE hit IS NULL OR n <= hit GROUP BY site""")
def attempts_json(spark, sf_dir):
    return crawl.first_match(candidates(spark, sf_dir)).select("site", "paths_attempted")


@query(f"WITH {_LINES} SELECT doc_id, CAST(pos AS INT) AS pos, concat_ws(chr(10), lag(line) OVER w, line, lead(line) OVER w) AS context FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)")
def context_window(spark, sf_dir):
    return merge.context(lines(spark, sf_dir), ["doc_id"], "pos", 1, 1).select("doc_id", "pos", "context")


@query()
def prev_line_name(spark, sf_dir):
    """For each line, the nearest name on the two lines before it.  Tested against brute force."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    name = F.when(text.valid_name(F.col("line")), F.col("line"))
    return lines(spark, sf_dir).withColumn("name", name).select("doc_id", "pos", F.coalesce(F.lag("name", 1).over(w), F.lag("name", 2).over(w)).alias("near_name"))


@query(with_views("SELECT id, school_id, teacher_name FROM (SELECT *, row_number() OVER (PARTITION BY school_id, lower(teacher_name) ORDER BY id) AS n FROM staff) WHERE n = 1"))
def first_wins_dedupe(spark, sf_dir):
    return merge.first_wins(staff(spark, sf_dir), ["school_id", F.lower("teacher_name")], ["id"]).select("id", "school_id", "teacher_name")


def blocks(spark, sf_dir) -> DataFrame:
    """Captured blocks of four kinds: cards, lists, text around mail links, and text; what a page has tells its best strategy."""
    s = staff(spark, sf_dir).withColumn("name", text.person_name(F.col("teacher_name")))
    p, i = F.col("school_id") % 4, F.col("id") % 3
    kind = F.when((p == 0) & (i == 0), "card").when((p == 1) & (i < 2), "block").when((p == 2) & (i != 1), "mailto").otherwise("body")
    packed = F.concat("name", F.lit(", "), "title")
    lines = F.when(kind == "block", F.when(i == 0, F.array(F.lit("1 Year"), packed)).otherwise(F.array(F.col("name"), F.lit("Room 12"), F.col("title")))).when(kind == "body", F.array(F.col("name"), F.lit("Room 12"), F.col("title"), F.col("email"))).otherwise(F.array("name", "title"))
    return s.select(F.col("school_id").alias("page_id"), F.col("id").alias("pos"), kind.alias("kind"), F.filter(lines, lambda x: x.isNotNull()).alias("lines"), F.when(F.col("email").contains("@"), F.col("email")).alias("mailto"))


_CLEAN = "CASE WHEN title = 'Art Teacher. Send a Message' THEN 'Art Teacher.' ELSE title END"
_ROWS = f"""r AS (SELECT school_id AS page_id, id AS pos, {_RECASED} AS name, title AS raw, {_CLEAN} AS clean, CASE WHEN email LIKE '%@%' THEN email END AS email, id % 3 AS i,
 CASE WHEN school_id % 4 = 0 AND id % 3 = 0 THEN 1 WHEN school_id % 4 = 1 AND id % 3 < 2 THEN 2 WHEN school_id % 4 = 2 AND id % 3 <> 1 THEN 3 ELSE 4 END AS rk FROM staff WHERE teacher_name <> 'FELIX VAN DOREN III' AND regexp_matches({_STRIPPED}, '(?i)\\b({_ART})\\b')),
 b AS (SELECT *, min(rk) OVER (PARTITION BY page_id) AS best FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(name) ORDER BY pos) AS n FROM b WHERE rk = best AND NOT regexp_matches(raw, '(?i){rules.EXCLUDED_ROLE}'))"""
_MAIL = "CASE WHEN rk < 4 OR name = 'Anna Lindqvist' AND email LIKE 'alindqvist%' THEN email END"


@query(with_views(f"SELECT page_id, pos, name, CASE WHEN rk = 1 OR rk = 2 AND i = 1 THEN clean ELSE raw END AS title, {_MAIL} AS email, CASE WHEN {_MAIL} IS NOT NULL THEN 'MAILTO' END AS email_source, CASE rk WHEN 1 THEN 'semantic_card' WHEN 2 THEN CASE i WHEN 0 THEN 'name_title_line' ELSE 'generic_block' END WHEN 3 THEN 'mailto_context' ELSE 'text_scan' END AS strategy FROM k WHERE n = 1", _ROWS))
def strategy_rank(spark, sf_dir):
    return crawl.extract_staff(blocks(spark, sf_dir)).select("page_id", "pos", "name", "title", "email", "email_source", "strategy")


@query(with_views(f"SELECT DISTINCT ON (page_id, name) page_id, name, title, email FROM (SELECT school_id AS page_id, id, {_RECASED} AS name, {_CLEAN} AS title, CASE WHEN email LIKE '%@%' THEN email END AS email FROM staff WHERE school_id % 2 = 0 AND teacher_name <> 'FELIX VAN DOREN III') WHERE email IS NOT NULL AND NOT regexp_matches(title, '(?i){rules.EXCLUDED_ROLE}') ORDER BY page_id, name, id"))
def table_strategy(spark, sf_dir):
    """Tables of all staff on permissive pages: a linked address for each row, or a row is left out."""
    s = staff(spark, sf_dir).filter("school_id % 2 = 0 AND teacher_name <> 'FELIX VAN DOREN III' AND email LIKE '%@%'")
    row = F.struct("id", F.concat(text.person_name(F.col("teacher_name")), F.lit("\t"), F.col("title")).alias("line"), "email")
    pages = s.unionAll(s).groupBy("school_id").agg(F.sort_array(F.collect_list(row)).alias("r"))  # twice, as a table needs two rows
    b = pages.select(F.col("school_id").alias("page_id"), F.lit(0).alias("pos"), F.lit("block").alias("kind"), F.transform("r", lambda x: x["line"]).alias("lines"), F.transform("r", lambda x: x["email"]).alias("emails"))
    return crawl.extract_staff(b, permissive=True).select("page_id", "name", "title", "email")


@query(with_views("SELECT id FROM staff WHERE lower(trim(title)) <> 'band director'"))
def title_is_school(spark, sf_dir):
    """Rows whose title isn't the school's name."""
    rows = staff(spark, sf_dir).select("id", "title", F.when(F.col("title") == "Band Director", " BAND DIRECTOR ").when(F.col("id") % 2 == 0, "Art").alias("school_name"))
    return crawl.drop_school_titles(rows).select("id")


@query(with_views("SELECT s.id, CASE WHEN hit THEN 'found' || s.id || '@example.org' ELSE email END AS email, CASE WHEN hit THEN 'hunter' ELSE resolution_method END AS resolution_method FROM (SELECT t.*, resolution_method = 'unresolved' AND website_url IS NOT NULL AND t.id % 3 = 0 AS hit FROM staff t JOIN schools c ON t.school_id = c.id) s"))
def enrich_unresolved(spark, sf_dir):
    """Addresses for unresolved rows of schools with a domain, written back."""
    s = staff(spark, sf_dir)
    finder = s.filter("id % 3 = 0").select("id", F.concat(F.lit("found"), F.col("id").cast("string"), F.lit("@example.org")).alias("found"))
    none = s.limit(0).select("id", F.lit(0).alias("pos"), F.lit("").alias("candidate"), F.lit(True).alias("ok"))
    return crawl.enrich_staff(s, schools(spark, sf_dir), finder, none).select("id", "email", "resolution_method")


@query(with_views("SELECT DISTINCT state FROM schools WHERE state NOT IN (SELECT state FROM schools WHERE is_arts_school = 1 AND scraped = 1)"))
def states_to_top_up(spark, sf_dir):
    s = schools(spark, sf_dir)
    return crawl.topped_up(s, s.filter("is_arts_school = 1 AND scraped = 1"))


@query("WITH c AS (SELECT page_id // 10 AS site, url, page_id % 10 >= 4 + page_id // 10 % 8 AS ok, page_id % 3 AS priority, page_id AS ord FROM pages UNION ALL SELECT page_id // 10, url, page_id // 10 % 4 = 1, -1, 0 FROM pages WHERE page_id % 10 = 9), u AS (SELECT *, row_number() OVER (PARTITION BY site, url ORDER BY priority, ord) AS k FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY priority, ord) AS n FROM u WHERE k = 1), h AS (SELECT *, min(CASE WHEN ok THEN n END) OVER (PARTITION BY site) AS hit FROM n) SELECT site, max(CASE WHEN n = hit THEN url END) AS directory_url, count(*) AS tried FROM h WHERE hit IS NULL OR n <= hit GROUP BY site")
def cached_first(spark, sf_dir):
    """The address that worked before is tried first."""
    c = candidates(spark, sf_dir)
    old = table(spark, sf_dir, "pages").filter("page_id % 10 = 9").select(F.expr("page_id div 10").alias("site"), "url", F.lit(200).alias("status"), (F.expr("page_id div 10") % 4 == 1).alias("ok"))
    return crawl.first_match(crawl.with_cached(c.withColumn("priority", F.col("priority") + 1), old)).select("site", "directory_url", "tried")


@query(with_views("SELECT id, reverse(teacher_name) AS turned FROM staff"))
def reversed_text(spark, sf_dir):
    return staff(spark, sf_dir).select("id", email.reverse_text(F.col("teacher_name")).alias("turned"))


@query(with_views("SELECT id, pos, candidate FROM (SELECT id, unnest([0, 1, 2, 3, 4]) AS pos, unnest([f || '.' || l, f[1] || l, f || l, f || l[1], l || f[1]]) || '@example.org' AS candidate FROM parts)", _PARTS))
def five_email_candidates(spark, sf_dir):
    f, last = email.name_parts(F.col("teacher_name"))
    return staff(spark, sf_dir).select("id", F.posexplode(email.five_candidates(f, last, F.lit("example.org"))).alias("pos", "candidate"))


def index(spark, sf_dir) -> DataFrame:
    return schools(spark, sf_dir).select(text.normalize_name(F.col("school_name")).alias("norm"), "state", "nces_id", "school_name")


def inputs(spark, sf_dir, norm: Column) -> DataFrame:
    s = schools(spark, sf_dir)
    return s.select(F.col("id").alias("iid"), norm.alias("norm"), F.when(F.col("id") % 2 == 0, F.col("state")).when(F.col("id") % 4 == 1, "ATLANTIS").alias("hint"))


_NORM = "trim(regexp_replace(regexp_replace(lower(school_name), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g'))"


@query(with_views(f"SELECT a.id AS iid, b.nces_id FROM schools a JOIN schools b ON {_NORM.replace('school_name', 'a.school_name')} = {_NORM.replace('school_name', 'b.school_name')}"))
def lookup_exact(spark, sf_dir):
    return match.exact(inputs(spark, sf_dir, text.normalize_name(F.col("school_name"))), index(spark, sf_dir)).select("iid", "nces_id")


@query(with_views(f"SELECT a.id AS iid, b.nces_id FROM (SELECT id, state, regexp_extract({_NORM}, '^(\\S+ \\S+)', 1) AS p FROM schools) a JOIN schools b ON {_NORM.replace('school_name', 'b.school_name')} LIKE a.p || ' %' WHERE a.id % 2 = 0 AND a.state = b.state OR a.id % 4 = 3"))
def lookup_prefix(spark, sf_dir):
    short = F.regexp_extract(text.normalize_name(F.col("school_name")), r"^(\S+ \S+)", 1)
    return match.in_state(match.prefix(inputs(spark, sf_dir, short), index(spark, sf_dir))).select("iid", "nces_id")


@query()
def lookup_fuzzy(spark, sf_dir):
    """Names with two letters changed; its scores are SequenceMatcher's, which SQL lacks."""
    mangled = F.translate(text.normalize_name(F.col("school_name")), "pg", "bq")
    return match.fuzzy(inputs(spark, sf_dir, mangled), index(spark, sf_dir)).select("iid", "nces_id", "score")


@query(with_views(f"SELECT a.id AS iid, b.nces_id FROM (SELECT id, state, acr FROM (SELECT id, state, list_aggregate(list_transform(list_filter(string_split({_NORM}, ' '), lambda w: w NOT IN ('the', 'of', 'at', 'and', 'a', 'an', 'for')), lambda w: w[1]), 'string_agg', '') AS acr FROM (SELECT id, state, substr(school_name, instr(school_name, ' ') + 1) AS school_name FROM schools))) a JOIN (SELECT first_value(state) OVER (PARTITION BY {_NORM} ORDER BY nces_id) AS state, nces_id, list_aggregate(list_transform(list_filter(string_split({_NORM}, ' '), lambda w: w NOT IN ('the', 'of', 'at', 'and', 'a', 'an', 'for')), lambda w: w[1]), 'string_agg', '') AS acr FROM (SELECT state, nces_id, substr(school_name, instr(school_name, ' ') + 1) AS school_name FROM schools)) b ON a.acr = b.acr WHERE length(a.acr) BETWEEN 2 AND 8 AND regexp_matches(a.acr, '^[a-z]+$') AND (a.id % 2 = 0 AND a.state = b.state OR a.id % 4 = 3)"))
def lookup_acronym(spark, sf_dir):
    rest = text.normalize_name(F.regexp_replace("school_name", r"^\S* ", ""))
    idx = schools(spark, sf_dir).select(rest.alias("norm"), "state", "nces_id")
    return match.by_acronym(inputs(spark, sf_dir, text.acronym(rest)), idx).select("iid", "nces_id")


@query()
def resolve_entity(spark, sf_dir):
    """All tiers and the decision among them; fuzzy scores keep it out of SQL."""
    s = schools(spark, sf_dir)
    reg = s.select("nces_id", text.normalize_name(F.col("school_name")).alias("norm"), "school_name", text.normalize_name(F.col("district_name")).alias("district_norm"), "district_name", F.col("district_name").alias("lea_id"), "state")
    asked = s.select(F.col("id").alias("iid"), F.when(F.col("id") % 10 == 0, text.normalize_name(F.col("district_name"))).when(F.col("id") % 10 == 3, "the harbour lights charter netwrk").when(F.col("id") % 10 == 7, "evening studio programme of arts").otherwise(text.normalize_name(F.col("school_name"))).alias("norm"), F.when(F.col("id") % 2 == 0, F.col("state")).alias("hint"))
    curated = lambda norm, name, domain: spark.range(1).select(F.lit(norm).alias("norm"), F.lit(name).alias("name"), F.lit(domain).alias("domain"))
    parents = curated("harbor lights charter network", "Harbor Lights Charter Network", "harborlights.example")
    programs = curated("evening studio program of the arts", "Evening Studio Program of the Arts", "studio.example")
    return match.resolve(asked, reg, parents, programs).drop("children")


@query(with_views("SELECT id, CASE WHEN scraped = 1 AND is_arts_school = 1 THEN 'org:' || lower(regexp_replace(school_name, '[^A-Za-z0-9_ ]', ' ', 'g')) WHEN level = 'High' THEN 'org:' || lower(district_name) WHEN open_status <> 'Closed' THEN 'nces:' || nces_id ELSE 'unresolved:' || lower(regexp_replace(school_name, '[^A-Za-z0-9_ ]', ' ', 'g')) END AS key FROM schools"))
def containment_key(spark, sf_dir):
    """Organisations, schools of an organisation, schools with an id, and the rest."""
    kind = F.when((F.col("scraped") == 1) & (F.col("is_arts_school") == 1), "PARENT_ORG").otherwise("SCHOOL")
    above = F.when(F.col("level") == "High", "PARENT_ORG").otherwise("DISTRICT")
    found = F.when((F.col("open_status") != "Closed") | (F.col("level") == "High"), F.col("nces_id"))
    return schools(spark, sf_dir).select("id", match.containment_key(kind, F.col("school_name"), found, F.col("district_name"), above, F.col("school_name")).alias("key"))


@query(with_views("SELECT id AS tid, CASE WHEN id % 2 = 0 THEN 'exact' ELSE 'tokens' END AS how FROM staff"))
def contact_token_match(spark, sf_dir):
    s = staff(spark, sf_dir)
    t = s.select(F.col("id").alias("tid"), F.col("id").alias("school_id"), F.col("teacher_name").alias("name"))
    c = s.select(F.col("id").alias("cid"), F.col("id").alias("school_id"), F.when(F.col("id") % 2 == 0, F.lower("teacher_name")).otherwise(F.concat("teacher_name", F.lit(" Jr"))).alias("name"))
    return match.match_contacts(t, c).select("tid", "how")


@query(with_views("SELECT id, CASE WHEN id % 4 = 0 THEN 'found' || id || '@example.org' WHEN id % 4 = 1 THEN f[1] || l || '@example.org' END AS email, CASE id % 4 WHEN 0 THEN 'hunter' WHEN 1 THEN 'smtp_verified' ELSE 'unresolved' END AS resolution_method FROM parts", _PARTS))
def enrich_cascade(spark, sf_dir):
    s = staff(spark, sf_dir)
    f, last = email.name_parts(F.col("teacher_name"))
    finder = s.filter("id % 4 = 0").select("id", F.concat(F.lit("found"), F.col("id").cast("string"), F.lit("@example.org")).alias("found"))
    tried = s.select("id", F.posexplode(email.candidates(f, last, F.lit("example.org"))).alias("pos", "candidate")).withColumn("ok", (F.col("id") % 4 == 1) & (F.col("pos") >= 1))
    return crawl.enrich(s.select("id"), finder, tried)


@query(with_views("SELECT id, CASE WHEN id % 11 = 0 THEN 'error: boom' WHEN id % 13 = 0 THEN 'NOT_A_SCHOOL' WHEN website_url IS NULL THEN 'NO_DIRECTORY_FOUND' WHEN id % 17 = 0 THEN 'BLOCKED' WHEN directory_url IS NULL AND id % 2 = 0 THEN 'BLOCKED_BY_SITE' WHEN directory_url IS NULL THEN 'NO_DIRECTORY_FOUND' WHEN id % 19 = 0 THEN 'AUTH_REQUIRED' WHEN id % 5 = 0 THEN 'NO_TEACHERS_LISTED' ELSE 'OK' END AS status FROM schools"))
def status_machine(spark, sf_dir):
    i = F.col("id")
    page = F.when(i % 19 == 0, "Staff  Login here").otherwise("welcome")
    facts = {"error": F.when(i % 11 == 0, "boom"), "entity_type": F.when(i % 13 == 0, "PARENT_ORG").otherwise("SCHOOL"), "url": F.col("website_url"), "robots_deny": i % 17 == 0, "directory": F.col("directory_url"), "all_blocked": i % 2 == 0, "timeout": F.lit(False), "challenge": web.bot_challenge(F.lit(200), page), "auth": web.auth_wall(page, F.lit(False)), "teachers": F.when(i % 5 == 0, 0).otherwise(3)}
    return schools(spark, sf_dir).select("id", crawl.status(facts).alias("status"))


@query("WITH e AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS done, count(*) OVER (PARTITION BY user_id) AS total FROM events) SELECT event_id, done, total - done AS left_over, round(CAST(done AS DOUBLE) / total, 6) AS share FROM e")
def progress_eta(spark, sf_dir):
    w = Window.partitionBy("user_id")
    done, total = F.count("*").over(w.orderBy("event_id")), F.count("*").over(w)
    return table(spark, sf_dir, "events").select("event_id", done.alias("done"), (total - done).alias("left_over"), F.round(done.cast("double") / total, 6).alias("share"))


@query("SELECT page_id, 'https://a.example.org/dir/x/' || page_id AS url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'https://a.example.org/top' || page_id FROM pages WHERE page_id % 2 = 1")
def href_resolve(spark, sf_dir):
    i = F.col("page_id").cast("string")
    href = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("x/"), i)).otherwise(F.concat(F.lit("../top"), i))
    return table(spark, sf_dir, "pages").select("page_id", web.resolve_href(href, F.lit("https://a.example.org/dir/page.html")).alias("url"))


@query("SELECT page_id, pos, CASE pos WHEN 0 THEN 'https://s.example.org/staff/' || page_id ELSE 'https://s.example.org/team' END AS loc FROM (SELECT page_id, unnest([0, 1]) AS pos FROM pages)")
def sitemap_scan(spark, sf_dir):
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://s.example.org/staff/'), F.col("page_id").cast("string"), F.lit("</loc></url><url><loc>https://s.example.org/lunch</loc></url><url><loc>https://s.example.org/team</loc></url></urlset>"))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.filter(web.sitemap_urls(xml), web.directory_like)).alias("pos", "loc"))


@query("SELECT page_id, 'https://s.example.org/map' || page_id || '.xml' AS sitemap FROM pages")
def robots_sitemaps(spark, sf_dir):
    txt = F.concat(F.lit("User-agent: *\nSITEMAP: https://s.example.org/map"), F.col("page_id").cast("string"), F.lit(".xml\nDisallow: /x"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(web.robots_sitemaps(txt)).alias("sitemap"))


@query("SELECT page_id, page_id % 4 <> 1 AND (page_id % 4 <> 0 OR page_id % 3 <> 0) AS allowed FROM pages")
def robots_allowed(spark, sf_dir):
    i = F.col("page_id")
    p = table(spark, sf_dir, "pages").select(i, F.concat(F.lit("h"), (i % 4).cast("string")).alias("host"), F.concat(F.lit("https://h.example.org"), F.when(i % 3 == 0, "/private/a").otherwise("/b")).alias("url"))
    robots = spark.range(3).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"), F.when(F.col("id") == 0, 200).when(F.col("id") == 1, 403).otherwise(404).alias("status"), F.lit("User-agent: *\nDisallow: /private").alias("body"))
    return crawl.robots_allowed(p, robots).select("page_id", "allowed")


@query("SELECT page_id, page_id % 3 = 0 OR page_id % 3 = 1 AS is_staff FROM pages")
def staff_json(spark, sf_dir):
    i = F.col("page_id")
    doc = F.when(i % 3 == 0, '[{"firstName2": 1, "first_name": "A"}]').when(i % 3 == 1, '{"results": [{"title": "x"}]}').otherwise("[]")
    return table(spark, sf_dir, "pages").select("page_id", readers.staff_json(doc).alias("is_staff"))


@query("SELECT event_id, 2.5 * (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS start_s FROM events")
def throttle_plan(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("host"), F.col("event_id").alias("ord"), F.lit(None).cast("double").alias("crawl_delay"))
    return crawl.planned_starts(e).select("event_id", "start_s")


@query("WITH e AS (SELECT event_id, user_id, event_id % 5 = 0 AS ok, sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events), n AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, run ORDER BY event_id) AS n FROM e) SELECT event_id, CASE WHEN ok THEN 0.0 ELSE least(120.0, 2.0 * pow(2.0, n - 1)) END::DOUBLE AS wait_s FROM n")
def backoff_schedule(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("host"), F.col("event_id").alias("ord"), (F.col("event_id") % 5 == 0).alias("ok"))
    return crawl.backoff(e).select("event_id", "wait_s")


@query(with_views("SELECT id, CASE WHEN id % 2 = 0 THEN concat('a', id, '@example.org') ELSE concat('b', id, '@example.org') END AS email FROM staff"))
def onclick_decode(spark, sf_dir):
    i = F.col("id").cast("string")
    js = F.when(F.col("id") % 2 == 0, F.concat(F.lit("location.href='mailto:a"), i, F.lit("@example.org'"))).otherwise(F.concat(F.lit("go('b"), i, F.lit("' + '@' + 'example.org')")))
    return staff(spark, sf_dir).select("id", email.onclick_decode(js).alias("email"))


@query()
def discover_candidates(spark, sf_dir):
    """Directory candidates of six sources; relative addresses keep it out of SQL."""
    p = titled_pages(spark, sf_dir)
    sites = p.select(F.col("page_id").alias("site"), F.concat(F.lit("https://"), web.domain(F.col("url")), F.lit("/")).alias("base"))
    maps = p.select(F.col("page_id").alias("site"), F.lit("sitemap").alias("kind"), F.lit("<urlset><url><loc>https://x.example.org/faculty</loc></url></urlset>").alias("body"))
    return crawl.discover(sites, p.select(F.col("page_id").alias("site"), F.lit("home").alias("kind"), F.col("html").alias("body")).unionByName(maps))
