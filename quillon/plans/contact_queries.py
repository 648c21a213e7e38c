"""Queries of contact pages, shared directories, casing and exports, each with the SQL that it equals."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import blocks, email, rules, text, web
from quillon.operators import contacts, crawl, merge, reads, upsert
from quillon.plans.queries import _RECASED, GROUPED, query
from quillon.plans.views import schools, staff, table, with_views
from quillon.sources import sinks
from quillon.streaming import ingest


def people(spark, sf_dir) -> DataFrame:
    """Staff under numbered names; some names have a word more than their pages."""
    i = F.col("id").cast("string")
    return staff(spark, sf_dir).withColumn("teacher_name", F.concat(F.lit("Person "), i, F.when(F.col("id") % 11 == 0, " Jr").otherwise("")))


def elements(spark, sf_dir) -> DataFrame:
    """Captured elements in all five forms; every seventh person is on a second page too."""
    n, i = F.col("id") % 5, F.col("id").cast("string")
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    near = say("Person  ", i, "\nArt")
    page = F.lit("https://s.example.org/staff")
    one = staff(spark, sf_dir).select(
        "id", "school_id", F.lit(0).alias("page_ord"), page.alias("page_url"), F.col("id").alias("pos"),
        F.when(n == 0, "mailto").when(n == 1, "button").when(n == 2, "link").when(n == 3, "data").otherwise("body").alias("kind"),
        F.when(n == 0, say("mailto:person", i, "@example.org?subject=x")).when(n == 2, say("https://s.example.org/c/", i)).alias("href"),
        F.when(n == 1, say("Send Messageto  Person ", i)).when(n == 2, "Contact me").alias("label"),
        F.when(n == 3, say(" person", i, "@example.org")).alias("email"),
        F.when(n == 4, say("Intro\nPerson ", i, " \nperson", i, " [at] example [dot] org\nend")).when(n != 1, near).alias("container"),
    )
    two = one.filter("id % 7 = 0").select("id", "school_id", F.lit(1).alias("page_ord"), "page_url", "pos", F.lit("data").alias("kind"), F.lit(None).cast("string").alias("href"), F.lit(None).cast("string").alias("label"), say("new", i, "@example.org").alias("email"), near.alias("container"))
    return one.unionByName(two).drop("id")


_VALUE = "CASE WHEN id % 7 = 0 THEN concat('new', id, '@example.org') WHEN id % 5 = 1 THEN 'https://s.example.org/staff' WHEN id % 5 = 2 THEN concat('https://s.example.org/c/', id) ELSE concat('person', id, '@example.org') END"
_METHOD = "CASE WHEN id % 7 <> 0 AND id % 5 IN (1, 2) THEN 'send_message_button' ELSE 'email' END"


@query(with_views(f"SELECT id, {_VALUE} AS email, {_METHOD} AS resolution_method, CASE WHEN id % 11 = 0 THEN 'tokens' ELSE 'exact' END AS how FROM staff"))
def contact_pages(spark, sf_dir):
    return contacts.contact_updates(people(spark, sf_dir), elements(spark, sf_dir))


_TODO = "school_id IN (SELECT id FROM schools WHERE state IN ('NATION_1', 'NATION_4', 'NATION_9')) AND coalesce(email, '') = ''"


@query(with_views(f"SELECT id, CASE WHEN {_TODO} THEN {_VALUE} ELSE email END AS email, CASE WHEN {_TODO} THEN {_METHOD} ELSE resolution_method END AS resolution_method FROM staff"))
def contact_check(spark, sf_dir):
    s = people(spark, sf_dir)
    return contacts.check_contacts(s, schools(spark, sf_dir), elements(spark, sf_dir), ["NATION_1", "NATION_4", "NATION_9"]).select("id", "email", "resolution_method")


_VISITS = """v AS (SELECT id, district_name AS district, concat('https://d.example.org/', id // 4) AS url, CASE WHEN id % 4 = 2 THEN 'nav' ELSE 'sitemap' END AS source, id % 3 AS records FROM schools),
p AS (SELECT *, CASE WHEN records > 0 AND source = 'sitemap' THEN url END AS good FROM v),
l AS (SELECT *, last_value(good IGNORE NULLS) OVER (PARTITION BY district ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM p),
e AS (SELECT *, CASE WHEN good IS NOT NULL THEN good WHEN records = 0 AND url = last THEN '' END AS says FROM l)"""


@query(with_views("SELECT id, nullif(last_value(says IGNORE NULLS) OVER (PARTITION BY district ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS shared_url FROM e", _VISITS))
def district_cache(spark, sf_dir):
    i = F.col("id")
    visits = schools(spark, sf_dir).select("id", F.col("district_name").alias("district"), i.alias("ord"), F.concat(F.lit("https://d.example.org/"), F.expr("id div 4").cast("string")).alias("directory_url"), F.when(i % 4 == 2, "nav").otherwise("sitemap").alias("source"), (i % 3).alias("records"))
    return crawl.district_directories(visits).select("id", "shared_url")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://s.example.org/' WHEN page_id % 3 = 1 THEN 'http://s.example.org/' ELSE 'https://t.example.org' END AS url FROM pages")
def preferred_base(spark, sf_dir):
    i = F.col("page_id")
    url = F.when(i % 3 == 2, "https://t.example.org").otherwise("http://s.example.org/")
    return table(spark, sf_dir, "pages").select("page_id", web.preferred_base(url, F.when(i % 3 == 0, 301).when(i % 2 == 0, 404)).alias("url"))


@query(f"SELECT doc_id, coalesce(regexp_matches(text, '(?i){rules.ARTS_WORD}') AND (regexp_matches(text, '{rules.EMAIL}') OR regexp_matches(text, '(?i){rules.STAFF_WORD}')), false) AS arts FROM (SELECT doc_id, text || CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN ' Fine Arts staff' WHEN 1 THEN ' art' WHEN 2 THEN ' partly staffed' ELSE '' END AS text FROM documents)")
def arts_page(spark, sf_dir):
    i = F.col("doc_id")
    t = F.concat("text", F.when(i % 4 == 0, " Fine Arts staff").when(i % 4 == 1, " art").when(i % 4 == 2, " partly staffed").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", web.arts_page(t).alias("arts"))


@query(with_views("SELECT id, pos, CASE WHEN id % 2 = 0 THEN concat('p', id, '.', pos, '@example.org') END AS email FROM (SELECT id, unnest([0, 1]) AS pos FROM staff)"))
def aligned_emails(spark, sf_dir):
    i = F.col("id").cast("string")
    mails = F.transform(F.sequence(F.lit(0), F.when(F.col("id") % 2 == 0, 1).otherwise(2)), lambda k: F.concat(F.lit("p"), i, F.lit("."), k.cast("string"), F.lit("@example.org")))
    return staff(spark, sf_dir).select("id", F.posexplode(email.align(mails, F.array("teacher_name", "title"))).alias("pos", "email"))


@query(with_views(f"SELECT id, CASE WHEN n = 1 THEN fixed ELSE teacher_name END AS teacher_name FROM (SELECT id, teacher_name, {_RECASED} AS fixed, row_number() OVER (PARTITION BY school_id % 7, {_RECASED} ORDER BY CASE WHEN teacher_name = {_RECASED} THEN 0 ELSE 1 END, id) AS n FROM staff)"))
def casing_keep(spark, sf_dir):
    """Recasing where a clash leaves the later row as it was."""
    s = staff(spark, sf_dir).withColumn("grp", F.col("school_id") % 7)
    return upsert.recase(s, "teacher_name", ["grp"], text.person_name, drop=False).select("id", "teacher_name")


@query(with_views("""SELECT school_name AS "School", city AS "City", state AS "State", district_name AS "District", coalesce(website_url, '') AS "Website", CASE WHEN scraped = 1 THEN 'Yes' ELSE 'No' END AS "Scraped", coalesce(scrape_status, '') AS "Status" FROM schools"""))
def schools_sheet(spark, sf_dir):
    return sinks.schools_sheet(schools(spark, sf_dir))


@query(with_views("SELECT id, teacher_name, added_at FROM staff WHERE added_at >= '2024-07-25T09:30:00'"))
def added_last_month(spark, sf_dir):
    cutoff = merge.added_cutoff("month", datetime(2024, 8, 24, 9, 30, tzinfo=UTC))
    return merge.since(staff(spark, sf_dir), cutoff).select("id", "teacher_name", "added_at")


@query(with_views("""SELECT nces_id, '{"school":{"nces_id":"' || nces_id || '","school_name":"' || school_name || '","city":"' || city || '","state":"' || state || '","district_name":"' || district_name || '","website_url":' || coalesce('"' || website_url || '"', 'null') || ',"school_level":null,"is_arts_school":' || is_arts_school || '},"status":' || coalesce('"' || scrape_status || '"', 'null') || ',"directory_url":' || coalesce('"' || directory_url || '"', 'null') || ',"paths_attempted":null,"resolution":null,"records":[' || coalesce(r, '') || ']}' AS payload
FROM schools LEFT JOIN (SELECT school_id, string_agg('{"name":"' || teacher_name || '","title":"' || title || '"}', ',' ORDER BY id) AS r FROM staff WHERE id % 3 = 0 GROUP BY school_id) ON school_id = id"""))
def push_payloads(spark, sf_dir):
    s = schools(spark, sf_dir)
    r = staff(spark, sf_dir).filter("id % 3 = 0").join(s.select(F.col("id").alias("school_id"), "nces_id"), "school_id").select("nces_id", F.col("id").alias("pos"), F.col("teacher_name").alias("name"), "title")
    return sinks.payloads(s.withColumnRenamed("scrape_status", "status"), r)


def payloads_of(rows: DataFrame, ord: int) -> DataFrame:
    """Payloads of rows with ``nces_id``, ``school_name``, ``state``, ``status``, ``directory_url`` and ``records``."""
    doc = F.struct(F.struct("nces_id", "school_name", F.lower("state").alias("state")).alias("school"), "status", "directory_url", F.struct(F.lit("SCHOOL").alias("entity_type"), (F.col("status") != "OK").alias("needs_human_review")).alias("resolution"), "records")
    return rows.select(F.from_json(F.to_json(doc), ingest.PAYLOAD).alias("p"), F.col("nces_id").alias("n")).select("p.*", F.struct(F.lit(ord).alias("batch"), "n").alias("ord"))


def batches(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two batches of payloads: of every second school, and of every third under another name."""
    s = schools(spark, sf_dir)
    people = staff(spark, sf_dir).groupBy("school_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.col("teacher_name").alias("name"), "title", "email"))), lambda x: x.dropFields("id")).alias("records"))
    s = s.join(people, s["id"] == people["school_id"], "left")
    one = s.filter("id % 2 = 0").select("nces_id", "school_name", "state", F.lit("OK").alias("status"), F.col("website_url").alias("directory_url"), "records")
    two = s.filter("id % 3 = 0").select(F.concat(F.lit(" "), "nces_id", F.lit(" ")).alias("nces_id"), F.concat("school_name", F.lit(" X")).alias("school_name"), "state", F.lit("TIMEOUT").alias("status"), F.lit("https://two.example.org").alias("directory_url"), "records")
    return payloads_of(one, 1), payloads_of(two, 2)


@query(with_views("SELECT nces_id, CASE WHEN id % 2 = 0 THEN school_name ELSE school_name || ' X' END AS school_name, upper(state) AS state, CASE WHEN id % 3 = 0 THEN 'TIMEOUT' ELSE 'OK' END AS status, CASE WHEN id % 3 = 0 THEN 'https://two.example.org' ELSE website_url END AS directory_url, CAST(1 AS INT) AS scraped, CASE WHEN id % 3 = 0 THEN 'TIMEOUT' ELSE 'OK' END AS scrape_status, CAST(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS needs_human_review, '[]' AS paths_attempted FROM schools WHERE id % 2 = 0 OR id % 3 = 0"))
def school_upsert(spark, sf_dir):
    """Schools after two batches: names are those of the first payload, the state of the crawl that of the last."""
    one, two = batches(spark, sf_dir)
    have = ingest.merge_schools(spark.createDataFrame([], "nces_id string"), one)
    return ingest.merge_schools(have, two).select("nces_id", "school_name", "state", "status", "directory_url", "scraped", "scrape_status", "needs_human_review", "paths_attempted")


@query(with_views(f"SELECT nces_id, teacher_name, title, resolution_method FROM (SELECT nces_id, {_RECASED} AS teacher_name, title, CASE WHEN coalesce(email, '') = '' THEN 'unresolved' WHEN email LIKE 'http%' THEN 'send_message_button' ELSE 'scraped' END AS resolution_method, row_number() OVER (PARTITION BY school_id, {_RECASED} ORDER BY t.id) AS n FROM staff t JOIN schools s ON t.school_id = s.id WHERE s.id % 2 = 0 OR s.id % 3 = 0) WHERE n = 1"))
def staff_upsert(spark, sf_dir):
    """Staff after two batches: the first of each school and name."""
    one, two = batches(spark, sf_dir)
    now = F.lit("2024-05-01T00:00:00+00:00")
    have = ingest.merge_staff(spark.createDataFrame([], "nces_id string"), one, now)[0]
    return ingest.merge_staff(have, two, now)[0].select("nces_id", "teacher_name", "title", "resolution_method")


@query(with_views(f"SELECT nces_id, count(*) AS saved FROM (SELECT DISTINCT nces_id, {_RECASED} AS teacher_name FROM staff t JOIN schools s ON t.school_id = s.id WHERE s.id % 2 <> 0 AND s.id % 3 = 0) GROUP BY nces_id"))
def staff_saved(spark, sf_dir):
    """How many rows the second batch adds."""
    one, two = batches(spark, sf_dir)
    now = F.lit("2024-05-01T00:00:00+00:00")
    have = ingest.merge_staff(spark.createDataFrame([], "nces_id string"), one, now)[0]
    return ingest.merge_staff(have, two, now)[1]


@query(with_views("SELECT id, school_name, count(*) OVER () AS total FROM schools WHERE state = 'NATION_4' AND (school_name ILIKE '%s%' OR city ILIKE '%s%' OR district_name ILIKE '%s%') AND website_url IS NOT NULL ORDER BY school_name, id LIMIT 50"))
def schools_read(spark, sf_dir):
    rows, total = reads.schools_page(schools(spark, sf_dir), 0, "nation_4", " s ", True)
    return rows.select("id", "school_name").crossJoin(F.broadcast(total))  # one row


@query(with_views("SELECT teacher_name, district_name, state, school_name, total FROM (SELECT *, count(*) OVER () AS total FROM g) ORDER BY state, first_school, teacher_name, district_name LIMIT 50 OFFSET 50", GROUPED.replace("FROM staff t JOIN schools s ON t.school_id = s.id)", "FROM staff t JOIN schools s ON t.school_id = s.id WHERE email <> '' AND added_at >= '2024-03-01' AND (teacher_name ILIKE '%an%' OR school_name ILIKE '%an%' OR city ILIKE '%an%'))", 1)))
def teachers_read(spark, sf_dir):
    rows, total = reads.teachers_page(staff(spark, sf_dir), schools(spark, sf_dir), 2, search="an", only_email=True, added="2024-03-01")
    return rows.select("teacher_name", "district_name", "state", "school_name").crossJoin(F.broadcast(total))  # one row


@query(with_views("SELECT teacher_name AS \"Teacher Name\", title AS \"Title\", CASE WHEN resolution_method IN ('send_message_button', 'contact_form') OR email LIKE 'http%' THEN 'contact on website' ELSE coalesce(email, '') END AS \"Email\", coalesce(resolution_method, '') AS \"Contact Method\", school_name AS \"School\", city AS \"City\", state AS \"State\", district_name AS \"District\", coalesce(nullif(directory_url, ''), nullif(website_url, ''), '') AS \"School Website\" FROM g", GROUPED))
def teachers_sheet(spark, sf_dir):
    return reads.teachers_sheet(staff(spark, sf_dir), schools(spark, sf_dir))


def school_pages(spark, sf_dir) -> DataFrame:
    """A page of each school: cards with mail links, contact links or encoded addresses, or rows of a list, after the menu of a test page."""
    s = staff(spark, sf_dir).filter("teacher_name <> 'FELIX VAN DOREN III'").withColumn("name", text.person_name(F.col("teacher_name")))
    link = F.when(F.col("email").startswith("http"), F.format_string('<a href="%s">Send a Message</a>', "email")).when(F.col("email").contains("@"), F.format_string('<a href="mailto:%s">mail</a>', "email")).otherwise("")
    card = F.format_string('<div class="staff-card"><div><h3 class="person-name">%s</h3><p class="job-title">%s</p></div>%s</div>', "name", "title", link)
    row = F.format_string("<li>%s, %s %s</li>", "name", "title", link)
    parts = s.groupBy("school_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", F.when(F.col("school_id") % 2 == 0, card).otherwise(row).alias("x")))), lambda y: y["x"]), "").alias("body"))
    return parts.select(F.col("school_id").alias("page_id"), F.lit("https://s.example.org/staff").alias("url"), F.concat(F.lit("<html><head><title>T</title><script>var a = 'Art Teacher';</script></head><body><nav><a href=/>Home</a></nav><div id=list>"), "body", F.lit("</div></body></html>")).alias("html"))


@query(with_views(f"""SELECT page_id, name, title, CASE WHEN email = '' THEN NULL ELSE email END AS email, strategy FROM (SELECT *, row_number() OVER (PARTITION BY page_id, name ORDER BY id) AS n FROM (SELECT school_id AS page_id, id, {_RECASED} AS name,
 CASE WHEN title = 'Art Teacher. Send a Message' THEN 'Art Teacher.' ELSE title END AS title, email, 'semantic_card' AS strategy FROM staff WHERE school_id % 2 = 0 AND teacher_name <> 'FELIX VAN DOREN III' AND title NOT IN ('Language Arts Teacher', 'Special Education Teacher', 'Math Teacher') AND NOT regexp_matches(title, '(?i){rules.EXCLUDED_ROLE}'))) WHERE n = 1"""))
def staff_from_pages(spark, sf_dir):
    """From captured pages to staff rows: cards with their addresses."""
    found = crawl.extract_staff(blocks.page_blocks(school_pages(spark, sf_dir).filter("page_id % 2 = 0")))
    return found.select("page_id", "name", "title", "email", "strategy")


@query()
def page_blocks(spark, sf_dir):
    """The blocks of all test pages; what is shown of a page is no SQL.  Tested by made pages."""
    return blocks.page_blocks(table(spark, sf_dir, "pages")).select("page_id", "pos", "kind", F.size("lines").alias("n_lines"))
