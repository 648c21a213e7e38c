"""Captured pages: candidates, first matches, extraction by ranked strategies, and a school's status."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import classify, email, rules, text, web
from quillon.operators.merge import first_wins
from quillon.operators.upsert import update


def discover(sites: DataFrame, pages: DataFrame, searched: DataFrame | None = None) -> DataFrame:
    """Ranked directory candidates of each site: ``site``, ``url``, ``source``, ``priority``, ``ord``.

    ``sites``: ``site``, ``base``; ``pages``: ``site``, ``kind`` (sitemap, home) and ``body``;
    ``searched``: results of an outside search, ``site``, ``url``, ``ord``.
    Of an address found twice, the better source counts.
    """
    home = sites.join(pages.filter("kind = 'home'").select("site", "body"), "site")
    maps = sites.join(pages.filter("kind = 'sitemap'").select("site", "body"), "site")

    def rows(df: DataFrame, urls: Column, source: str, priority: int) -> DataFrame:
        return df.select("site", "base", F.posexplode(urls).alias("ord", "href")).select("site", web.resolve_href(F.col("href"), F.col("base")).alias("url"), F.lit(source).alias("source"), F.lit(priority).alias("priority"), "ord")

    found = [
        rows(maps, F.filter(web.sitemap_urls(F.col("body")), web.directory_like), "sitemap", 1),
        rows(home, web.cms_paths(web.detect_cms(F.col("body"))), "cms", 2),
        rows(home, F.transform(web.nav_links(F.col("body")), lambda x: x["href"]), "nav", 3),
        rows(home, F.filter(F.array(web.search_url(F.col("body"), F.col("base"), "staff directory")), lambda x: x.isNotNull()), "internal_search", 5),
        rows(sites, F.array(*map(F.lit, rules.DEPARTMENT_PATHS)), "department", 6),
        rows(sites, F.array(F.col("base")), "homepage", 7),
    ]
    if searched is not None:
        found.append(searched.select("site", "url", F.lit("site_search").alias("source"), F.lit(4).alias("priority"), F.col("ord").cast("int").alias("ord")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return first_wins(out, ["site", "url"], ["priority", "ord"])


def district_directories(visits: DataFrame) -> DataFrame:
    """``visits`` with ``shared_url``: the directory that a school may take over from the schools of its district before it.

    ``visits``: ``district``, ``ord``, ``directory_url``, ``source``, ``records``.  Only an
    address that gave records and came from a source worth sharing is passed on.  If the
    same address gives a later school nothing, it is passed on no more, until it or
    another one is proven again.  A null district shares nothing.
    """
    w = Window.partitionBy("district").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    proven = (F.col("records") > 0) & F.col("source").isin(rules.SHARED_SOURCES)
    # The last visit that says something: a proof, or a failure of the address proven last.
    last = F.last(F.when(proven, F.col("directory_url")), ignorenulls=True).over(w)
    out = visits.withColumn("_last", last).withColumn("_says", F.when(proven, F.struct(F.lit(True).alias("ok"), F.col("directory_url").alias("url"))).when((F.col("records") == 0) & (F.col("directory_url") == F.col("_last")), F.struct(F.lit(False).alias("ok"), F.col("directory_url").alias("url"))))
    out = out.withColumn("_says", F.last("_says", ignorenulls=True).over(w))
    return out.withColumn("shared_url", F.when(F.col("district").isNotNull() & F.col("_says.ok"), F.col("_says.url"))).drop("_last", "_says")


def first_match(candidates: DataFrame) -> DataFrame:
    """Each site's first candidate that matches (``ok``), and the JSON log of the attempts up to it.

    ``candidates``: ``site``, ``url``, ``status``, ``ok``, ``priority``, ``ord``.
    """
    w = Window.partitionBy("site").orderBy("priority", "ord", "url")
    n = candidates.withColumn("n", F.row_number().over(w))
    hit = F.min(F.when(F.col("ok"), F.col("n"))).over(Window.partitionBy("site"))
    tried = n.withColumn("hit", hit).filter(F.col("hit").isNull() | (F.col("n") <= F.col("hit")))
    entry = F.struct("n", "url", "status", F.when(F.col("ok"), F.lit(None).cast("string")).otherwise("no match").alias("rejected_because"))
    g = tried.groupBy("site").agg(F.max(F.when(F.col("n") == F.col("hit"), F.col("url"))).alias("directory_url"), F.count("*").alias("tried"), F.sort_array(F.collect_list(entry)).alias("a"), all_blocked(F.col("status")).alias("all_blocked"))
    return g.select("site", "directory_url", "tried", "all_blocked", F.to_json(F.transform("a", lambda x: x.dropFields("n")), {"ignoreNullFields": "false"}).alias("paths_attempted"))


def all_blocked(status: Column) -> Column:
    """Aggregate: there are statuses, and each one is a refusal."""
    return (F.count(status) > 0) & F.coalesce(F.bool_and(status.isin(list(rules.REFUSED))), F.lit(False))


_RECORD = "struct<k:int,name:string,title:string,email:string,source:string,strategy:string>"


def extract_staff(blocks: DataFrame, permissive: bool = False) -> DataFrame:
    """Staff rows of captured blocks: ``page_id``, ``pos``, ``name``, ``title``, ``email``, ``email_source``, ``evidence_url``, ``discipline``, ``strategy``.

    ``blocks``: ``page_id``, ``pos``, ``kind`` (card, block, mailto, body), ``lines`` (array); and
    where known ``mailto`` or ``emails`` (addresses linked in the block), ``cfemail`` (an
    encoded one), ``link`` (a contact link) and ``evidence_url``.  Strategies are ranked: a page's rows come from the first
    kind that yields any.  In a block, a line with name and title comes before rows of a
    table, and those before a name with its title on one of the next two lines; what a block
    yields first is all it yields.  Roles out of scope go, and of one name the first row stays.

    ``permissive`` is for pages of an arts department: cards, table rows and names with a
    title below needn't be of the arts, but all rows of a block need an address.
    """
    given = lambda c, t: (F.col(c) if c in blocks.columns else F.lit(None)).cast(t)
    first = F.nullif(given("mailto", "string"), F.lit(""))
    emails = F.coalesce(given("emails", "array<string>"), F.when(first.isNotNull(), F.array(first)), F.array().cast("array<string>"))
    tidy = F.filter(F.transform("lines", text.trim_ws), lambda x: x != "")
    b = blocks.select("page_id", "pos", "kind", tidy.alias("lines"), emails.alias("emails"), given("cfemail", "string").alias("cfemail"), given("link", "string").alias("link"), given("evidence_url", "string").alias("evidence_url"))
    # Columns, one after the other: as expressions they would be written out wherever they are used.
    b = b.withColumn("cells", F.when(F.col("kind") == "block", text.table_rows(F.col("lines")))).withColumn("l", F.transform("lines", lambda x: F.struct(x.alias("t"), text.valid_name(x).alias("is_name"), text.split_name_title(x).alias("s"), text.clean_title(x).alias("clean"), (classify.is_art(x) & text.valid_title(x)).alias("is_title"))))
    b = b.withColumn("l", F.transform("l", lambda x: F.struct(x["t"].alias("t"), x["is_name"].alias("is_name"), x["s"].alias("s"), x["clean"].alias("clean"), x["is_title"].alias("is_title"), classify.is_art(x["s"]["title"]).alias("s_art"), text.valid_title(x["s"]["title"]).alias("s_title"), (text.valid_title(x["clean"]) & (F.lit(True) if permissive else classify.is_art(x["clean"]))).alias("below"))))
    linked = F.get("emails", F.lit(0))
    b = b.withColumn("mail", F.coalesce(email.resolve_email(linked, F.col("cfemail"), F.array_join("lines", "\n")), F.when(F.nullif("link", F.lit("")).isNotNull(), F.struct(F.col("link").alias("email"), F.lit(None).cast("string").alias("source")))))
    b = b.withColumn("split", F.get(F.filter("l", lambda x: x["s"].isNotNull() & x["s_art"]), F.lit(0))).withColumn("under", F.get(F.filter(F.slice("l", 2, 2), lambda x: x["below"]), F.lit(0))).withColumn("top", F.get("l", F.lit(0)))
    lines, mail, split, top, none = F.col("l"), F.col("mail"), F.col("split"), F.col("top"), F.array().cast(f"array<{_RECORD}>")
    record = lambda k, name, title, mail, source, strategy: F.struct(k.cast("int").alias("k"), name.alias("name"), title.alias("title"), mail.alias("email"), source.alias("source"), F.lit(strategy).alias("strategy")).cast(_RECORD)
    maybe = lambda ok, x: F.when(F.coalesce(ok, F.lit(False)), F.array(x)).otherwise(none)
    one = lambda name, title, strategy: record(F.lit(0), name, title, mail["email"], mail["source"], strategy)
    reached = mail.isNotNull() if permissive else F.lit(True)

    second = F.get(lines, F.lit(1))
    card = maybe(top["is_name"] & second["below"], one(top["t"], second["clean"], "semantic_card"))

    aligned = F.size("emails") == F.size("cells")
    own = lambda i: F.when(aligned, F.get("emails", i))
    table = F.transform("cells", lambda x, i: record(i, x["name"], x["title"], own(i), F.when(own(i).isNotNull(), "MAILTO"), "table_row"))
    table = F.filter(table, lambda x: x["email"].isNotNull() if permissive else classify.is_art(x["title"]))
    generic = maybe(F.col("under").isNotNull() & top["is_name"] & reached, one(top["t"], F.col("under.clean"), "generic_block"))
    packed = maybe(split["s_title"] & reached, one(split["s"]["name"], split["s"]["title"], "name_title_line"))
    block = F.when(split.isNotNull(), packed).when(F.size(lines) < 2, none).when(F.size("cells") > 0, table).otherwise(generic)

    def scan(strategy: str, back: int, pick) -> Column:
        """Each line that holds a name and a title, or else a title whose name stands on one of the ``back`` lines before it."""

        def at(x: Column, i: Column) -> Column:
            whole = F.coalesce(x["s_art"] & x["s_title"], F.lit(False))
            before = F.get(F.filter(F.reverse(F.slice(lines, F.greatest(i - back, F.lit(0)) + 1, F.least(i, F.lit(back)))), lambda y: y["is_name"]), F.lit(0))["t"]
            name = F.when(whole, x["s"]["name"]).when(x["is_title"], before)
            around = F.when(whole, 1).otherwise(2)
            return F.struct(i.cast("int").alias("k"), name.alias("name"), F.when(whole, x["s"]["title"]).otherwise(x["t"]).alias("title"), F.slice("lines", F.greatest(i - around, F.lit(0)) + 1, F.least(i, around) + 1 + around).alias("near"))

        found = F.filter(F.transform(lines, at), lambda x: x["name"].isNotNull())
        return F.transform(found, lambda x: record(x["k"], x["name"], x["title"], *pick(x), strategy))

    context = scan("mailto_context", 1, lambda _: (linked, F.when(linked.isNotNull(), "MAILTO")))
    # The addresses of the lines around are looked at once a row stands for itself.
    body = scan("text_scan", 2, lambda x: (F.array_join(x["near"], " "), F.lit("NEAR")))
    kind = F.col("kind")
    rank = F.when(kind == "card", 1).when(kind == "block", 2).when(kind == "mailto", 3).when(kind == "body", 4)
    found = F.when(kind == "card", card).when(kind == "block", block).when(kind == "mailto", context).when(kind == "body", body)
    out = b.select("page_id", "pos", "evidence_url", rank.alias("rank"), F.explode(found).alias("r")).select("page_id", "pos", "evidence_url", "rank", "r.*")
    fit = F.when(F.col("source") == "NEAR", email.first_of_name(F.regexp_extract_all("email", F.lit(f"({rules.EMAIL})"), F.lit(1)), F.col("name"))).otherwise(F.col("email"))
    out = out.withColumn("email", fit).withColumn("source", F.when((F.col("source") != "NEAR") | F.col("email").isNotNull(), F.when(F.col("source") == "NEAR", "MAILTO").otherwise(F.col("source"))))
    best = F.min("rank").over(Window.partitionBy("page_id"))
    out = out.withColumn("_best", best).filter("rank = _best").filter(~classify.excluded_role(F.col("title")))
    out = first_wins(out, ["page_id", F.lower("name")], ["pos", "k"])
    return out.select("page_id", "pos", "name", "title", "email", F.col("source").alias("email_source"), "evidence_url", classify.classify(F.col("title"))["discipline"].alias("discipline"), "strategy")


def drop_school_titles(rows: DataFrame) -> DataFrame:
    """Rows (``title``, ``school_name``) without those whose title is the school's name; no name, no change."""
    same = F.lower(text.trim_ws(F.col("title"))) == F.lower(text.trim_ws(F.col("school_name")))
    return rows.filter(~F.coalesce(same & (F.coalesce("school_name", F.lit("")) != ""), F.lit(False)))


def with_cached(candidates: DataFrame, cached: DataFrame) -> DataFrame:
    """``candidates`` with each site's address that worked before (``site``, ``url``, ``status``, ``ok``) in front of all others; found twice, it counts there."""
    front = cached.filter(F.coalesce("url", F.lit("")) != "").withColumn("priority", F.lit(0)).withColumn("ord", F.lit(0))
    return first_wins(front.unionByName(candidates, allowMissingColumns=True), ["site", "url"], ["priority", "ord"])


def topped_up(states: DataFrame, known: DataFrame) -> DataFrame:
    """The states that still need topping up: those that ``known`` lacks, each once."""
    return states.select("state").distinct().join(known.select("state"), "state", "left_anti")


def enrich_staff(staff: DataFrame, schools: DataFrame, finder: DataFrame, candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """``staff`` with the addresses found for its unresolved rows, the first ``limit`` of them by id.

    Rows of schools without a domain stay as they are, and so do those for which nothing is found.
    """
    todo = staff.filter("resolution_method = 'unresolved'")
    todo = todo.orderBy("id").limit(limit) if limit else todo
    host = schools.select(F.col("id").alias("school_id"), web.domain(F.col("website_url")).alias("domain")).filter("domain IS NOT NULL")
    todo = todo.join(host.select("school_id"), "school_id", "left_semi").select("id")
    found = enrich(todo, finder, candidates).filter("email IS NOT NULL")
    return update(staff, found, "id", ["email", "resolution_method"])


def email_ok(name: Column, address: Column) -> Column:
    return address.isNotNull() & text.email_matches_name(address, name)


def drop_other_campus(rows: DataFrame, page: str = "page_id") -> DataFrame:
    """Rows of pages with two or more campus tags without those whose tag isn't the school's."""
    tag = text.campus_tag(F.col("title"))
    n = F.size(F.collect_set("_tag").over(Window.partitionBy(page)))
    out = rows.withColumn("_tag", tag).withColumn("_n", n)
    return out.filter((F.col("_n") < 2) | F.col("_tag").isNull() | text.tag_matches(F.col("_tag"), F.col("school_name"))).drop("_tag", "_n")


def status(f: dict[str, Column]) -> Column:
    """A school's status from its facts; the first that holds decides."""
    return (
        F.when(f["error"].isNotNull(), F.concat(F.lit("error: "), f["error"]))
        .when(f["entity_type"].isin("PARENT_ORG", "NOT_A_K12"), "NOT_A_SCHOOL").when(f["entity_type"] == "AMBIGUOUS", "AMBIGUOUS_ENTITY").when(f["url"].isNull(), "NO_DIRECTORY_FOUND").when(f["robots_deny"], "BLOCKED")
        .when(f["directory"].isNull() & f["all_blocked"], "BLOCKED_BY_SITE").when(f["directory"].isNull(), "NO_DIRECTORY_FOUND").when(f["timeout"], "TIMEOUT").when(f["challenge"], "BLOCKED_BY_SITE").when(f["auth"], "AUTH_REQUIRED")
        .when(f["teachers"] == 0, "NO_TEACHERS_LISTED").when(f["entity_type"] == "PROGRAM", "PROGRAM_REDIRECTED").otherwise("OK")
    )


def enrich(staff: DataFrame, finder: DataFrame, candidates: DataFrame) -> DataFrame:
    """``id``, ``email``, ``resolution_method``: the finder's address, else the first candidate that was verified.

    ``finder``: ``id``, ``found``; ``candidates``: ``id``, ``pos``, ``candidate``, ``ok``.
    """
    good = candidates.filter("ok").groupBy("id").agg(F.min_by("candidate", "pos").alias("candidate"))
    out = staff.join(finder, "id", "left").join(good, "id", "left")
    return out.select("id", F.coalesce("found", "candidate").alias("email"), F.when(F.col("found").isNotNull(), "hunter").when(F.col("candidate").isNotNull(), "smtp_verified").otherwise("unresolved").alias("resolution_method"))


def mx_top(records: DataFrame) -> DataFrame:
    """``domain`` and ``exchange`` with the lowest preference, of equals the first by ``ord``, without its final dot; records without an exchange or a preference don't count."""
    rank = F.when(F.col("exchange").isNotNull() & F.col("preference").isNotNull(), F.struct("preference", "ord"))
    return records.groupBy("domain").agg(F.regexp_replace(F.min_by("exchange", rank), r"\.$", "").alias("exchange"))


def planned_starts(fetches: DataFrame, delay: float = 2.5) -> DataFrame:
    """``start_s`` of each fetch of a host: its place among the host's fetches, ``delay`` seconds apart."""
    n = F.row_number().over(Window.partitionBy("host").orderBy("ord"))
    return fetches.withColumn("start_s", (n - 1) * F.coalesce(F.col("crawl_delay"), F.lit(delay)))


def backoff(events: DataFrame, base: float = 2.0, most: float = 120.0) -> DataFrame:
    """``wait_s`` after each event: base doubled for each failure since the last success; 0 after a success."""
    w = Window.partitionBy("host").orderBy("ord")
    run = F.sum(F.col("ok").cast("int")).over(w)
    n = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("host", "_run").orderBy("ord"))
    return events.withColumn("_run", run).withColumn("_n", n).withColumn("wait_s", F.when(F.col("ok"), 0.0).otherwise(F.least(F.lit(most), base * F.pow(F.lit(2.0), F.col("_n") - 1)))).drop("_run", "_n")


def robots_allowed(fetches: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """``allowed`` for each fetch (host, url) by the captured robots table (host, status, body).

    200: its rules; 401 and 403: nothing; any other status, or none: everything.  A host's
    rules travel once: they meet its fetches in the task that has the host, and are parsed there once.
    """
    schema = T.StructType([*fetches.schema.fields, T.StructField("allowed", T.BooleanType())])

    def decide(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        from urllib.robotparser import RobotFileParser

        parsed = None
        status = None if right.empty else right["_s"].iloc[0]
        if status == 200:
            parsed = RobotFileParser()
            parsed.parse((right["_b"].iloc[0] or "").splitlines())
        return left.assign(allowed=[parsed.can_fetch(agent, u) if parsed else status not in (401, 403) for u in left["url"]])

    def salted(df: DataFrame) -> DataFrame:
        return df.withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(16)))

    # A host's fetches go to sixteen tasks, and its rules to each of them.
    rules_of = robots.select(F.col("host").alias("_h"), F.col("status").alias("_s"), F.col("body").alias("_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("_salt"))
    return salted(fetches).groupBy("host", "_salt").cogroup(rules_of.groupBy("_h", "_salt")).applyInPandas(lambda x, y: decide(x.drop(columns="_salt"), y), schema)
