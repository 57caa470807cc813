"""Pagination, run ledger, templates in storage, outputs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import urls as U
from ..operators import extract as E
from ..operators import paginate as P
from ..operators import runs as R
from ..session import scratch_path
from ..sources import sinks
from ..sources import templates as TS
from ..sources.ledger import Ledger
from ..sources.pages import stream_pages, streamable
from ..streaming import records as SR
from ..streaming import status as SS
from .record_queries import domain_templates
from .registry import DOMAIN, FOOTER, LINKS, SITE, pages, query, table, tidied


# --- pagination -----------------------------------------------------------------------------------


def _linked_pages(spark, folder):
    """The pages as one site: each links to the one after it, and ten further on."""
    number = F.col("page_id")
    links = F.concat(
        F.lit('<a rel="next" href="/n/'), number + 1, F.lit('">Next</a><a rel="skip" href="'), number + 10,
        F.lit('#top">Further</a><footer>'),
    )
    return pages(spark, folder).select(
        "page_id", F.concat(F.lit("https://site.example/n/"), number).alias("url"),
        F.replace(F.col("html"), F.lit("<footer>"), links).alias("html"),
    )


@query("""SELECT a.page_id AS seed_id, (b.page_id - a.page_id + 1)::BIGINT AS page_seq, b.page_id FROM pages a
  JOIN pages b ON b.page_id // 25 = a.page_id // 25 AND b.page_id >= a.page_id""")
def relative_chains(spark, folder):
    """G1: chains of 25 pages over links with dots in them, against a base element, without a page limit."""
    number = F.col("page_id")
    last = number % 25 == 24
    link = F.when(last, F.lit("")).otherwise(F.concat(F.lit('<a rel="next" href="./x/../../n/./'), number + 1, F.lit('#here">Next</a><footer>')))
    based = F.when(number % 2 == 0, F.lit('<base href="https://site.example/b/c/d"><title>')).otherwise(F.lit('<base href="../c/"><title>'))
    html = F.replace(F.replace(F.col("html"), F.lit("<footer>"), F.when(last, F.lit("<footer>")).otherwise(link)), F.lit("<title>"), based)
    site = pages(spark, folder).select("page_id", F.concat(F.lit("https://site.example/b/n/"), number).alias("url"), html.alias("html"))
    visits = P.page_chain(site, site.select("page_id"), '//a[@rel="next"]')
    return visits.select("seed_id", F.col("page_seq").cast("long").alias("page_seq"), "page_id")


@query("""SELECT a.page_id AS seed_id, s.seq::BIGINT AS page_seq, b.page_id FROM pages a, (VALUES (1), (2), (3), (4)) s(seq), pages b
  WHERE b.page_id = a.page_id + s.seq - 1""")
def page_chain_depth(spark, folder):
    """Up to four pages from every page on."""
    site = _linked_pages(spark, folder)
    visits = P.page_chain(site, site.select("page_id"), '//a[@rel="next"]', max_pages=4)
    return visits.select("seed_id", F.col("page_seq").cast("long").alias("page_seq"), "page_id")


@query("""WITH one AS (SELECT a.page_id AS seed_id, a.page_id AS p1, b.page_id AS p2 FROM pages a LEFT JOIN pages b ON b.page_id = a.page_id + 1),
  two AS (SELECT o.*, c.page_id AS p3 FROM one o LEFT JOIN pages c ON c.page_id = coalesce(o.p2, o.p1) + 10)
  SELECT seed_id, 1::BIGINT AS page_seq, p1 AS page_id FROM two
  UNION ALL SELECT seed_id, 2, p2 FROM two WHERE p2 IS NOT NULL
  UNION ALL SELECT seed_id, CASE WHEN p2 IS NULL THEN 2 ELSE 3 END, p3 FROM two WHERE p3 IS NOT NULL""")
def page_list(spark, folder):
    """One selector per round, a missing link is skipped."""
    site = _linked_pages(spark, folder)
    visits = P.page_chain(site, site.select("page_id"), '//a[@rel="next"]\n\n//a[text()="Further"]')
    return visits.select("seed_id", F.col("page_seq").cast("long").alias("page_seq"), "page_id")


@query("""WITH RECURSIVE walk AS (
    SELECT page_id AS seed_id, 0 AS k, 1::BIGINT AS page_seq, page_id, true AS moved FROM pages
    UNION ALL
    SELECT w.seed_id, k + 1, w.page_seq + CASE WHEN p.page_id IS NULL THEN 0 ELSE 1 END, coalesce(p.page_id, w.page_id), p.page_id IS NOT NULL
    FROM walk w LEFT JOIN pages p ON p.page_id = w.page_id + CASE WHEN k % 2 = 0 THEN 1 ELSE 10 END WHERE k < 8)
  SELECT seed_id, page_seq, page_id FROM walk WHERE moved""")
def page_list_of_eight(spark, folder):
    """Eight selectors, one per round, by composition."""
    site = _linked_pages(spark, folder)
    visits = P.page_chain(site, site.select("page_id"), "\n".join(['//a[@rel="next"]', '//a[text()="Further"]'] * 4))
    return visits.select("seed_id", F.col("page_seq").cast("long").alias("page_seq"), "page_id")


@query(f"""WITH sited AS (SELECT page_id, {DOMAIN} AS domain FROM pages),
  placed AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS rn, count(*) OVER (PARTITION BY domain) AS n FROM sited),
  one AS (SELECT domain, n, CASE WHEN n >= 2 THEN 2 ELSE 1 END AS p1 FROM placed WHERE rn = 1),
  two AS (SELECT *, CASE WHEN p1 + 2 <= n THEN p1 + 2 ELSE p1 END AS p2 FROM one),
  three AS (SELECT *, CASE WHEN p2 + 1 <= n THEN p2 + 1 ELSE p2 END AS p3 FROM two),
  visits AS (SELECT domain, unnest(list_distinct([1, p1, p2, p3])) AS rn FROM three)
  SELECT domain || ':all' AS template_id, rn::BIGINT AS page_seq, page_id FROM placed
  UNION ALL SELECT domain || ':few', rn, page_id FROM placed WHERE rn <= 3
  UNION ALL SELECT v.domain || ':list', row_number() OVER (PARTITION BY v.domain ORDER BY v.rn), p.page_id FROM visits v JOIN placed p ON p.domain = v.domain AND p.rn = v.rn
  UNION ALL SELECT domain || ':page', 1, page_id FROM placed WHERE rn = 1""")
def template_pagination(spark, folder):
    """E13 with G1-G3: the runs of four templates per domain by their own pagination, of all domains at once."""
    sited = pages(spark, folder).withColumn("domain", U.domain(F.col("url")))
    order = W.partitionBy("domain").orderBy("page_id")

    def address(page):
        return F.concat(F.lit("https://"), F.col("domain"), F.lit("/p/"), page)

    def link(ahead: int, name: str):
        return F.coalesce(F.concat(F.lit('<a href="'), address(F.lead("page_id", ahead).over(order)), F.lit(f'">{name}</a>')), F.lit(""))

    linked = F.replace(F.col("html"), F.lit("<footer>"), F.concat(link(1, "Next"), link(2, "Further"), F.lit("<footer>")))
    site = sited.select("page_id", "domain", address(F.col("page_id")).alias("url"), linked.alias("html"))
    step, skip = '//body/a[text()="Next"]', '//a[text()="Further"]'
    kinds = {"all": step, "few": step, "list": f"{step}\n{skip}\n{step}", "page": "fake"}
    named = F.explode(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])).alias("kind", "pagination_xpath")
    starts = site.groupBy("domain").agg(F.min_by("url", "page_id").alias("url")).select("domain", "url", named)
    templates = starts.select(F.concat_ws(":", "domain", "kind").alias("id"), "url", "pagination_xpath")
    budgets = templates.filter(F.endswith("id", F.lit(":few"))).select(F.col("id").alias("template_id"), F.lit(3).alias("max_pages"))
    visits = P.template_visits(site.drop("domain"), templates, budgets)
    return visits.select("template_id", F.col("page_seq").cast("long").alias("page_seq"), "page_id")


@query(f"""SELECT a.page_id AS seed_id, (b.page_id - a.page_id + 1)::BIGINT AS page_seq, {tidied(FOOTER.replace('html', 'b.html'))} AS footer
  FROM pages a JOIN pages b ON b.page_id BETWEEN a.page_id AND a.page_id + 1""")
def records_in_visit_order(spark, folder):
    """Records of paginated runs of two pages."""
    site = _linked_pages(spark, folder)
    visits = P.page_chain(site, site.select("page_id"), '//a[@rel="next"]', max_pages=2)
    records = E.extract(site, {"footer": "//body//footer"})
    placed = E.in_visit_order(records, visits)
    return placed.select("seed_id", F.col("page_seq").cast("long").alias("page_seq"), "footer")


# --- ledger ---------------------------------------------------------------------------------------

_CODES = {"view": "37%", "click": "2", "error": "", "signup": "5", "purchase": "3"}


def _run_events(events):
    """Site events as run events: the user is the run."""
    codes = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    return events.select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"), codes[F.col("event_type")].alias("status"),
        F.concat(F.lit("out-"), F.col("event_id"), F.lit(".csv")).alias("file_name"),
    )


_NEWEST = """newest AS (SELECT user_id::VARCHAR AS run_id, event_id, event_type FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn = 1)"""
_STATUS = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 4 WHEN 'signup' THEN 5 ELSE 3 END::BIGINT"
_AFTER = "CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 ELSE 7 END::BIGINT"


@query(f"""WITH {_NEWEST} SELECT run_id, {_STATUS} AS status, {_AFTER} AS after_restart, 'out-' || event_id || '.csv' AS file_name FROM newest""")
def latest_status(spark, folder):
    """R1, R2"""
    latest = R.latest_status(_run_events(table(spark, folder, "events")))
    return latest.select(
        "run_id", F.col("status").cast("long").alias("status"),
        R.after_restart(F.col("status")).cast("long").alias("after_restart"), "file_name",
    )


def _open_customers(spark, folder, ledger):
    """A run per customer."""
    opened = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("run_id"), F.col("c_name").alias("url"), F.lit("").alias("file_name"),
        F.col("c_mktsegment").alias("titles"), F.lit(1).alias("status"), F.lit("").alias("date"), F.lit("").alias("time"),
    )
    opened.write.parquet(ledger.runs_path)


def _customer_ledger(spark, folder):
    """A run per customer, with the site's events; events of others belong to no known run."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    _open_customers(spark, folder, ledger)
    ledger.record(_run_events(table(spark, folder, "events")))
    return ledger


_LEDGER = f"""SELECT c_custkey::VARCHAR AS run_id, coalesce({_AFTER}, 7) AS status,
  coalesce('out-' || event_id || '.csv', '') AS file_name, c_name AS url FROM customer LEFT JOIN newest ON c_custkey::VARCHAR = run_id"""


@query(f"WITH {_NEWEST} {_LEDGER.replace(_AFTER, 'CASE WHEN event_type IS NOT NULL THEN ' + _AFTER + ' END')}")
def ledger_after_restart(spark, folder):
    """Runs under way are stopped, those without an event as well."""
    current = _customer_ledger(spark, folder).runs(restarted=True)
    return current.select("run_id", F.col("status").cast("long").alias("status"), "file_name", "url")


@query(f"WITH {_NEWEST} {_LEDGER.replace(_AFTER, 'CASE WHEN event_type IS NOT NULL THEN ' + _AFTER + ' END')}")
def ledger_compacted(spark, folder):
    """The newer events are folded into a snapshot; the older ones come late, behind it."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    events = _run_events(table(spark, folder, "events"))
    _open_customers(spark, folder, ledger)
    late = F.col("seq") % 3 == 0
    ledger.record(events.filter(~late))
    ledger.compact()
    ledger.record(events.filter(late))
    current = ledger.runs(restarted=True)
    return current.select("run_id", F.col("status").cast("long").alias("status"), "file_name", "url")


@query("""SELECT 'open' AS step, c_custkey::VARCHAR AS name, 1::BIGINT AS status FROM customer WHERE c_custkey <> (SELECT min(c_custkey) FROM customer)
  UNION ALL SELECT 'open', 'new run', 1
  UNION ALL SELECT 'cleared', 'next run', 1""")
def ledger_changes(spark, folder):
    """One run is removed and one opened; then all are dropped and another is opened."""
    ledger = Ledger(spark, scratch_path(spark, "ledger"))
    keys = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("run_id"))
    blank = [F.lit("").alias(c) for c in ("file_name", "titles")]
    opened = keys.select("run_id", F.col("run_id").alias("url"), *blank, F.lit(1).alias("status"), F.lit("").alias("date"), F.lit("").alias("time"))
    opened.write.parquet(ledger.runs_path)
    first = keys.agg(F.min(F.col("run_id").cast("long"))).first()[0]
    ledger.remove(str(first))
    ledger.open(R.open_run(spark, "new run", "a.csv", ["one", "two"]))
    path = scratch_path(spark, "ledger-state")
    ledger.runs().select(F.lit("open").alias("step"), F.col("url").alias("name"), F.col("status").cast("long").alias("status")).write.parquet(path)
    ledger.clear()
    ledger.open(R.open_run(spark, "next run", "b.csv", ["one"]))
    after = ledger.runs().select(F.lit("cleared").alias("step"), F.col("url").alias("name"), F.col("status").cast("long").alias("status"))
    return spark.read.parquet(path).unionByName(after)


@query("""SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NOT NULL AS removed FROM orders""")
def superseded_runs(spark, folder):
    """The customer is the output file."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return R.superseded(orders, file="o_custkey", order=("o_orderdate", "o_orderkey")).select("o_orderkey", "removed")


_SITES = f"sites AS (SELECT {SITE} AS site, min(url) AS url, url LIKE 'https:%' AS secure FROM pages GROUP BY ALL)"


@query(f"""WITH {_SITES} SELECT site AS domain, coalesce(max(CASE WHEN secure THEN url END), max(url)) AS url FROM sites GROUP BY site""")
def registry_upsert(spark, folder):
    """Templates of https sites replace those of http."""
    secure = F.startswith(F.col("url"), F.lit("https:"))
    sites = pages(spark, folder).groupBy(U.registrable(F.col("url")).alias("domain"), secure.alias("secure")).agg(
        F.min("url").alias("url")
    )
    old, new = sites.filter(~F.col("secure")), sites.filter("secure")
    return R.upsert_by_domain(old, new).select("domain", "url")


@query(f"""SELECT p.page_id, f.url AS template_url FROM pages p JOIN (
    SELECT {SITE} AS site, min(url) AS url FROM pages GROUP BY ALL) f ON f.site = {SITE.replace('url', 'p.url')}""")
def registry_lookup(spark, folder):
    """R5"""
    source = pages(spark, folder)
    registry = source.select("url").withColumn("id", F.col("url"))
    found = R.lookup_by_domain(source.select("page_id", "url"), registry)
    return found.select("page_id", F.col("entry.url").alias("template_url"))


# --- templates in storage -------------------------------------------------------------------------


@query(f"""SELECT {DOMAIN} AS id, min(url) AS url, '//html//body//div[1][contains(@class, "ad")] ; //html//body//footer[1]' AS xpaths
  FROM pages GROUP BY {DOMAIN} HAVING {DOMAIN} <> (SELECT min({DOMAIN}) FROM pages)""")
def template_store(spark, folder):
    """Save, delete one, list."""
    source = pages(spark, folder)
    store = TS.TemplateStore(spark, scratch_path(spark, "templates"))
    store.save(domain_templates(source))
    store.delete(source.agg(F.min(U.domain(F.col("url")))).first()[0])
    values = TS.column_values(store.templates(), "xpath")
    return store.templates().join(values, "id").select("id", "url", F.array_join("values", " ; ").alias("xpaths"))


@query(f"""SELECT {DOMAIN} AS id, max(url) AS url FROM pages GROUP BY {DOMAIN} HAVING {DOMAIN} <> (SELECT min({DOMAIN}) FROM pages)""")
def template_store_compacted(spark, folder):
    """Templates are saved and folded, then saved anew under other addresses and one deleted, and folded again."""
    source = pages(spark, folder)
    store = TS.TemplateStore(spark, scratch_path(spark, "templates"))
    store.save(domain_templates(source))
    store.compact()
    newer = source.groupBy(U.domain(F.col("url")).alias("id")).agg(F.max("url").alias("newer"))
    store.save(store.templates().join(newer, "id").withColumn("url", F.col("newer")))
    store.delete(source.agg(F.min(U.domain(F.col("url")))).first()[0])
    store.compact()
    return store.templates().select("id", "url")


# --- outputs --------------------------------------------------------------------------------------

_OUTPUT_SQL = f"""WITH {LINKS} SELECT page_id::VARCHAR AS page_id, 'link' AS kind, {tidied('raw')} AS text FROM links
  UNION ALL SELECT page_id::VARCHAR, 'footer', {tidied(FOOTER)} FROM pages"""


def _written(spark, folder, fmt):
    """Links saved, footers appended with the columns in another order; the path of the output."""
    source = pages(spark, folder)
    path = sinks.output_name(scratch_path(spark, "output"), fmt)
    links = E.extract_fields(source, "//nav//li", {"1 text": "//a//text()"})
    footers = E.extract_fields(source, "//footer", {"1 text": "//text()"})
    number = F.col("page_id").cast("string").alias("page id")
    sinks.save(links.select(number, F.lit("link").alias("kind"), "1 text"), path, fmt)
    sinks.save(footers.select("1 text", number, F.lit("footer").alias("kind")), path, fmt, append=True)
    return path


def _read_back(spark, folder, fmt):
    path = _written(spark, folder, fmt)
    names = sinks.written_names(["page id", "kind", "1 text"], fmt)
    stored = sinks.load(spark, path, fmt)
    return stored.select(*[F.col(f"`{n}`") for n in names]).toDF("page_id", "kind", "text")


@query(_OUTPUT_SQL)
def csv_output(spark, folder):
    """S2, S3, S9"""
    return _read_back(spark, folder, "csv")


@query(_OUTPUT_SQL)
def json_output(spark, folder):
    """S4, S5, S9"""
    return _read_back(spark, folder, "json")


@query(_OUTPUT_SQL)
def xml_output(spark, folder):
    """S6-S9"""
    return _read_back(spark, folder, "xml")


@query(_OUTPUT_SQL)
def parquet_output(spark, folder):
    """S9"""
    return _read_back(spark, folder, "parquet")


@query(f"""WITH {LINKS} SELECT fmt, ((SELECT count(*) FROM links) + (SELECT count(*) FROM pages))::BIGINT AS n_rows
  FROM (VALUES ('csv'), ('json'), ('xml'), ('parquet')) f(fmt)""")
def output_row_counts(spark, folder):
    """S10"""
    counts = [(fmt, sinks.count_rows(spark, _written(spark, folder, fmt))) for fmt in sinks.FORMATS]
    return spark.createDataFrame(counts, "fmt string, n_rows long")


# --- streams --------------------------------------------------------------------------------------


@query(f"WITH {LINKS} SELECT page_id, {tidied('raw')} AS link FROM links")
def streamed_records(spark, folder):
    """X1, X2, Q5"""
    path = scratch_path(spark, "stream")

    def job(batch):
        return E.extract_fields(batch, "//nav//li", {"link": "//a//text()"})

    stream = stream_pages(spark, f"{folder}/pages.parquet", pattern="*")
    SR.stream_records(stream, job, f"{path}/out", "parquet", f"{path}/checkpoint").awaitTermination()
    return SR.load_stream_output(spark, f"{path}/out", "parquet").select("page_id", "link")


@query(f"""WITH {_NEWEST} SELECT run_id, {_STATUS} AS status, 'out-' || event_id || '.csv' AS file_name FROM newest""")
def streamed_status(spark, folder):
    """X3, R1"""
    path = scratch_path(spark, "status")
    given = table(spark, folder, "events").schema
    events = spark.readStream.schema(given).parquet(streamable(spark, f"{folder}/events.parquet"))
    SS.stream_status(_run_events(events), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    current = SS.current_status(spark, f"{path}/out")
    return current.select("run_id", F.col("status").cast("long").alias("status"), "file_name")
