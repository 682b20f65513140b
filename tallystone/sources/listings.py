"""Publisher listings -> document references. Every function maps rows, none shuffles.

A document reference has: source, doc_id, filing_date, form_type, title, url, entity, meta.
Payload columns hold one listing page each.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone import schemas
from tallystone import vocabulary as V
from tallystone.functions.columns import accession_number, compact_date, date_prefix
from tallystone.session import materialize

# Publisher addresses and the shape of an index row.
SEC_ARCHIVES = "https://www.sec.gov/Archives"
ESEF_SITE = "https://filings.xbrl.org"
EDINET_API = "https://api.edinet-fsa.go.jp/api/v2/"
OPENDART_API = "https://opendart.fss.or.kr/api/"
UK_BULK = "http://download.companieshouse.gov.uk"
INDEX_ROW = (
    r"^(\S(?:.*\S)?)\s{2,}(\S(?:.*\S)?)\s{2,}(\d{1,10})\s{2,}"
    r"(\d{4}-?\d{2}-?\d{2})\s{2,}(\S+)\s*$"
)
INDEX_HEADER = "Form Type"
RULE_DISTANCE = 5


def _map(**entries: Column) -> Column:
    """MAP<STRING,STRING> of the entries that have a value."""
    pairs = [
        F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")))
        for k, v in entries.items()
    ]
    empty = F.create_map().cast("map<string,string>")
    return F.map_from_entries(F.array_compact(F.array(*pairs))) if pairs else empty


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


# ------------------------------------------------------------------ daily index of EDGAR
def index_lines(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Body lines of each index file, parsed, with the parse error of the file, if any.

    The header may wrap; the dashed rule must follow within five lines. ``row`` is NULL for a file
    without lines. Lines are parsed before they become rows: a filter on a field of an exploded line
    would repeat the parsing for each of its terms.
    """
    lines = F.split(F.col(text), r"\r\n|\r|\n")
    numbered = F.transform(
        "lines", lambda line, i: F.struct((i + 1).alias("n"), line.alias("line"))
    )
    first = lambda array: F.get(array, 0)["n"]
    with_header = files.select(*keys, lines.alias("lines")).withColumn(
        "header", first(F.filter(numbered, lambda x: x["line"].startswith(INDEX_HEADER)))
    )
    near = F.filter(
        numbered,
        lambda x: x["n"].between(F.col("header") + 1, F.col("header") + RULE_DISTANCE)
        & F.ltrim(x["line"]).startswith("---"),
    )
    with_rule = with_header.withColumn("rule", first(near))
    error = (
        F.when(F.col("header").isNull(), F.lit("no recognizable header"))
        .when(F.col("rule").isNull(), F.lit("header without a dashed rule"))
    )
    body = F.filter(
        F.slice("lines", F.col("rule") + 1, F.greatest(F.size("lines") - F.col("rule"), F.lit(0))),
        lambda x: F.trim(x) != "",
    )
    return with_rule.select(
        *keys,
        error.alias("error"),
        F.explode_outer(F.when(F.col("rule").isNotNull(), F.transform(F.transform(body, _row_fields), _row))).alias("row"),
    )


def _row_fields(line: Column) -> Column:
    """The five fields of an index row, NULL for another line."""
    marked = F.regexp_replace(line, INDEX_ROW, "$1\u0001$2\u0001$3\u0001$4\u0001$5")
    return F.split(F.when(line.rlike(INDEX_ROW), marked), "\u0001")


def _row(f: Column) -> Column:
    return F.struct(
        f[0].alias("form_type"),
        f[1].alias("company"),
        f[2].alias("cik"),
        compact_date(F.regexp_replace(f[3], "-", "")).alias("filed"),
        f[4].alias("file_name"),
    )


def parse_index(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Index rows: form_type, company, cik, filed, file_name; ok is false for skipped lines."""
    return index_lines(files, keys, text).select(
        *keys, "error", "row.*", F.when(F.col("row").isNotNull(), F.col("row.filed").isNotNull()).alias("ok")
    )


def edgar_refs(rows: DataFrame, forms: tuple[str, ...] = V.INDEX_FORMS) -> DataFrame:
    """References of the wanted form types; rows without an accession number are dropped."""
    base = F.regexp_replace(F.substring_index("file_name", "/", -1), r"\.txt$", "")
    return (
        rows.where(F.col("ok") & F.col("form_type").isin(*forms))
        .withColumn("doc_id", accession_number(base))
        .where(F.col("doc_id").isNotNull())
        .select(
            F.lit("sec").alias("source"),
            "doc_id",
            F.col("filed").alias("filing_date"),
            "form_type",
            F.col("company").alias("title"),
            F.concat(F.lit(SEC_ARCHIVES + "/"), "file_name").alias("url"),
            _map(cik=F.col("cik").cast("long")).alias("entity"),
            _map().alias("meta"),
        )
    )


def company_tickers(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Flatten an object keyed by running numbers into rows."""
    parsed = payloads.select(F.explode(F.from_json(payload, schemas.TICKER_MAP)).alias("i", "r"))
    return parsed.select(_blank(F.col("r.cik_str")).alias("cik"), "r.ticker", "r.title")


# ------------------------------------------------------------------ ESEF
# Download kinds in order of preference.
DOWNLOADS = (("json_url", "xbrl-json"), ("package_url", "zip"), ("report_url", "report_html"))


def esef_refs(payloads: DataFrame, day: Column | None = None, payload: str = "payload") -> DataFrame:
    """Filings of a page joined to the entities included in the same page."""
    page = payloads.select(F.from_json(payload, schemas.ESEF_LISTING).alias("page"), *(
        [day.alias("day")] if day is not None else []
    ))
    item = page.select(
        F.explode("page.data").alias("d"),
        F.col("page.included").alias("included"),
        *(["day"] if day is not None else []),
    )
    owner = F.get(
        F.filter(
            "included",
            lambda e: (e["type"] == "entity")
            & (e["id"] == F.col("d.relationships.entity.data.id")),
        ),
        0,
    )["attributes"]
    a = F.col("d.attributes")
    present = [(F.nullif(a[name], F.lit("")), kind) for name, kind in DOWNLOADS]
    link = F.coalesce(*[c for c, _ in present])
    kind = reduce(
        lambda chain, x: chain.when(x[0].isNotNull(), F.lit(x[1])),
        present[1:],
        F.when(present[0][0].isNotNull(), F.lit(present[0][1])),
    )
    stamp = F.coalesce(F.nullif(a["processed"], F.lit("")), F.nullif(a["date_added"], F.lit("")))
    listed = F.when(F.length(stamp) >= 10, F.substring(stamp, 1, 10))
    refs = (
        item.withColumn("owner", owner)
        .where(F.col("d.id").isNotNull() & (F.col("d.id") != "") & listed.isNotNull())
        .select(
            *(["day"] if day is not None else []),
            listed.alias("listed_day"),
            F.lit("esef").alias("source"),
            F.col("d.id").alias("doc_id"),
            date_prefix(a["period_end"]).alias("filing_date"),
            F.lit(None).cast("string").alias("form_type"),
            F.col("owner.name").alias("title"),
            F.when(link.startswith("http"), link)
            .otherwise(F.concat(F.lit(ESEF_SITE), link))
            .alias("url"),
            _map(
                lei=F.nullif(F.col("owner.identifier"), F.lit("")),
                country=F.nullif(a["country"], F.lit("")),
            ).alias("entity"),
            _map(
                download_kind=kind,
                date_added=F.nullif(a["date_added"], F.lit("")),
                fxo_id=F.nullif(a["fxo_id"], F.lit("")),
                error_count=a["error_count"],
            ).alias("meta"),
        )
    )
    if day is not None:
        refs = refs.where(F.col("listed_day") == F.col("day").cast("string")).drop("day")
    return refs.drop("listed_day")


# ------------------------------------------------------------------ EDINET and OpenDART
def edinet_errors(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    page = payloads.select(F.from_json(payload, schemas.EDINET_LISTING).alias("p"))
    return page.where(F.col("p.metadata.status") != "200").select(
        F.lit("edinet").alias("source"), "p.metadata.status", "p.metadata.message"
    )


def edinet_refs(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows that are not withdrawn and offer XBRL or CSV; error pages contribute none."""
    page = payloads.select(F.from_json(payload, schemas.EDINET_LISTING).alias("p")).where(
        F.coalesce(F.col("p.metadata.status"), F.lit("200")) == "200"
    )
    r = F.col("r")
    usable = (r["xbrlFlag"] == "1") | (r["csvFlag"] == "1")
    return (
        page.select(F.explode("p.results").alias("r"))
        .where(
            (r["docID"] != "")
            & (F.coalesce(r["withdrawalStatus"], F.lit("0")) == "0")
            & F.coalesce(usable, F.lit(False))
        )
        .select(
            F.lit("edinet").alias("source"),
            r["docID"].alias("doc_id"),
            date_prefix(r["submitDateTime"]).alias("filing_date"),
            r["docTypeCode"].alias("form_type"),
            r["docDescription"].alias("title"),
            F.concat(F.lit(EDINET_API + "documents/"), r["docID"]).alias("url"),
            _map(
                edinet_code=_blank(r["edinetCode"]),
                sec_code=_blank(r["secCode"]),
                jcn=_blank(r["JCN"]),
            ).alias("entity"),
            _map(
                xbrl_flag=F.coalesce(r["xbrlFlag"], F.lit("0")),
                csv_flag=F.coalesce(r["csvFlag"], F.lit("0")),
                filer_name=_blank(r["filerName"]),
            ).alias("meta"),
        )
    )


def opendart_errors(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Pages whose status is neither fine (000) nor an empty day (013)."""
    page = payloads.select(F.from_json(payload, schemas.OPENDART_LISTING).alias("p"))
    return page.where(~F.coalesce(F.col("p.status").isin("000", "013"), F.lit(False))).select(
        F.lit("opendart").alias("source"), "p.status", "p.message"
    )


def opendart_refs(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    page = payloads.select(F.from_json(payload, schemas.OPENDART_LISTING).alias("p"))
    r = F.col("r")
    return (
        page.where(F.col("p.status") == "000")
        .select(F.explode("p.list").alias("r"))
        .where(r["rcept_no"] != "")
        .select(
            F.lit("opendart").alias("source"),
            r["rcept_no"].alias("doc_id"),
            compact_date(r["rcept_dt"]).alias("filing_date"),
            r["report_nm"].alias("form_type"),
            r["report_nm"].alias("title"),
            F.concat(F.lit(OPENDART_API + "document.xml?rcept_no="), r["rcept_no"]).alias("url"),
            _map(
                corp_code=_blank(r["corp_code"]),
                stock_code=_blank(r["stock_code"]),
                corp_cls=_blank(r["corp_cls"]),
            ).alias("entity"),
            _map(
                corp_name=_blank(r["corp_name"]), flr_nm=_blank(r["flr_nm"]), rm=_blank(r["rm"])
            ).alias("meta"),
        )
    )


# ------------------------------------------------------------------ UK bulk accounts
def companies_house_refs(files: DataFrame, path: str = "path") -> DataFrame:
    """One synthetic document per published bulk file, the day taken from its name."""
    day = F.regexp_extract(path, r"Accounts_Bulk_Data-(\d{4}-\d{2}-\d{2})\.zip$", 1)
    return (
        files.withColumn("day", day)
        .where(F.col("day") != "")
        .select(
            F.lit("companies_house").alias("source"),
            F.concat(F.lit("accounts-bulk-"), "day").alias("doc_id"),
            date_prefix("day").alias("filing_date"),
            F.lit("accounts_bulk").alias("form_type"),
            F.concat(F.lit("Companies House daily accounts bulk data for "), "day").alias("title"),
            F.concat(F.lit(UK_BULK + "/Accounts_Bulk_Data-"), "day", F.lit(".zip")).alias("url"),
            _map().alias("entity"),
            _map(
                filename=F.concat(F.lit("Accounts_Bulk_Data-"), "day", F.lit(".zip"))
            ).alias("meta"),
        )
    )


# ------------------------------------------------------------------ registry
LISTINGS: dict[str, Callable[..., DataFrame]] = {
    "sec": edgar_refs,
    "esef": esef_refs,
    "edinet": edinet_refs,
    "opendart": opendart_refs,
    "companies_house": companies_house_refs,
}


def build_sources(names: list[str] | None = None) -> dict[str, Callable[..., DataFrame]]:
    """Listing functions by source; a name that is not known is an error."""
    wanted = list(names or V.SOURCES)
    unknown = sorted(set(wanted) - set(V.SOURCES))
    if unknown:
        raise ValueError(f"Unknown source(s): {', '.join(unknown)}. Known: {', '.join(V.SOURCES)}")
    return {n: LISTINGS[n] for n in wanted}


def harvest_refs(listed: list[DataFrame]) -> DataFrame:
    """All references of one harvest."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), listed)


def harvest_pages(pages: DataFrame, forms: tuple[str, ...] = V.INDEX_FORMS) -> tuple[DataFrame, DataFrame]:
    """References and errors of one landed table of pages from any mix of sources.

    ``pages``: source (a slug), payload, day. The table is stored by source, so each source's rules
    open its own folder and every page is parsed once. Errors are rows (source, status, message,
    pages): pages that the publisher refused, index files without a readable header, and pages of a
    slug that no rule knows (NULL is such a slug).
    """
    known = F.coalesce(F.col("source").isin(*LISTINGS), F.lit(False))
    slugged = pages.select("source", "payload", "day", F.when(known, F.col("source")).otherwise(F.lit("unknown")).alias("slug"))
    stored = materialize(slugged, "pages", partition_by=("slug",))
    of = lambda slug: stored.where(F.col("slug") == slug)
    index = materialize(parse_index(of("sec"), ["day"], "payload"), "index_rows")
    refs = harvest_refs([
        edgar_refs(index, forms),
        esef_refs(of("esef"), F.to_date("day")),
        edinet_refs(of("edinet")),
        opendart_refs(of("opendart")),
        companies_house_refs(of("companies_house"), "payload"),
    ])
    unread = index.where(F.col("error").isNotNull()).select(
        F.lit("sec").alias("source"), F.lit("unreadable").alias("status"), F.col("error").alias("message")
    )
    strange = of("unknown").select("source", F.lit("unknown").alias("status"), F.lit(f"known: {', '.join(LISTINGS)}").alias("message"))
    errors = harvest_refs([unread, edinet_errors(of("edinet")), opendart_errors(of("opendart")), strange])
    return refs, errors.groupBy("source", "status", "message").agg(F.count(F.lit(1)).alias("pages"))


# ------------------------------------------------------------------ full-text search
def search_hits(
    payloads: DataFrame,
    limit: int | None = None,
    forms: list[str] | None = None,
    payload: str = "payload",
    keys: list[str] | None = None,
) -> DataFrame:
    """Hits of search result pages; array fields give their first element.

    ``limit`` is the number of hits kept per page, in page order.
    """
    keys = keys or []
    hits = F.col("p.hits.hits")
    if limit is not None:
        hits = F.slice(hits, 1, limit)
    page = payloads.select(*keys, F.from_json(payload, schemas.SEARCH_RESULT).alias("p")).where(
        F.coalesce(F.col("p.hits.total.value"), F.lit(1)) != 0
    )
    h, first = F.col("h"), lambda c: _blank(F.get(c, 0))
    out = (
        page.select(*keys, F.explode(hits).alias("h"))
        .where(h.isNotNull())
        .select(
            *keys,
            F.substring_index(_blank(h["_id"]), ":", 1).alias("accession"),
            first(h["_source"]["ciks"]).alias("cik"),
            first(h["_source"]["display_names"]).alias("company"),
            first(h["_source"]["root_forms"]).alias("form"),
            _blank(h["_source"]["file_date"]).alias("filed"),
            F.regexp_extract(_blank(h["_id"]), r"^[^:]*:(.*)$", 1).alias("doc"),
        )
    )
    return out.where(F.col("form").isin(*forms)) if forms else out
