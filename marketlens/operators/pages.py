"""Mining of page tables: metadata, links, classification, facts and fingerprints. Built-in expressions only, but for one parser."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import text, urls

TAG = r"(?s)<[^>]*>"
BLOCKS = r"(?is)<(script|style|nav|footer|header)\b[^>]*>.*?</\1\s*>"

# URL patterns, title words and base scores that the classification is defined by.
URL_RULES = (
    ("product_url", "product", 1.0, r"/(products?|solutions?|hardware|catalog|specs?|items?|models?|series|range|equipment|devices?|machines?|systems?|technology)(?:/|$)"),
    ("docs_url", "datasheet", 0.9, r"/(docs?|documentation|datasheet|downloads?)(?:/|$)|\.pdf$"),
    ("pricing_url", "pricing", 0.7, r"/pricing|/plans"),
    ("releases_url", "releases", 0.7, r"/(releases?|updates?|changelog|firmware|versions?)(?:/|$)"),
    ("news_url", "news", 0.4, r"/(news|blog|press)(?:/|$)"),
)
PRODUCT_WORDS = "product solution hardware specification model series equipment device machine system robot technology mt1 kehrroboter cleaning autonomous".split()
WORD_RULES = (
    ("product_title", "product", 1.0, "title", PRODUCT_WORDS), ("product_h1", "product", 1.0, "h1", PRODUCT_WORDS), ("docs_title", "docs", 0.9, "title", "documentation datasheet manual guide".split()),
    ("pricing_title", "pricing", 0.7, "title", "pricing plans cost".split()), ("releases_title", "releases", 0.7, "title", "release update changelog version".split()), ("news_title", "news", 0.4, "title", "news blog press announcement".split()),
)
PRIORITY = {"product": 6, "datasheet": 5, "docs": 4, "releases": 3, "pricing": 2, "news": 1, "other": 0}
# Patterns of prices, specifications, names, releases, changelog entries and kinds of document.
PRICE_PATTERNS = (
    ("currency_amount", r"[\$€£¥]\s*(\d+(?:,\d{3})*(?:\.\d{2})?)", 0.9),
    ("per_month_pricing", r"(?i)(\d+(?:\.\d{2})?)\s*(?:per|/)\s*month", 0.85),
    ("pricing_table", r"(?i)(?:plan|tier|package).*?(\$\d+)", 0.8),
)
SPEC_PATTERNS = (
    ("memory", r"(?i)(\d+(?:\.\d+)?\s*(?:GB|MB|TB))\s*(?:RAM|memory)", 0.9),
    ("storage", r"(?i)(\d+(?:\.\d+)?\s*(?:GB|TB|PB))\s*(?:storage|disk)", 0.9),
    ("cpu_cores", r"(?i)(\d+)\s*(?:core|CPU|processor)", 0.85),
)
NAME_PATTERNS = (
    (r"(?im)(?:PUDU\s+)?([A-Z]{2,3}\d+(?:-[A-Z]+)?|[A-Z][a-z]+[Bb]ot\d*(?:\s+[A-Z][a-z]+)*)", 0.9),
    (r"(?im)(?:^|\n)([A-Z][A-Za-z0-9\s\-]+(?:Robot|Bot|Service|Cleaner|Vacuum))", 0.85),
    (r"(?im)(?:^|\s)([A-Z][a-zA-Z0-9\s]+(?:API|SDK|Service))", 0.8),
)
#: Forms of the patterns above that find the same values in one pass over a text: a run of characters that a search has been
#: through without success is not searched again from each of its characters or words. In names, a run in which nothing is
#: found, and the rest of one behind a name, are matches of their own without a group. With each go the words (in small
#: letters) of which a text must contain one, and a simpler form for texts without any.
ONE_PASS = dict(zip([p for p, *_ in NAME_PATTERNS] + [p for _, p, _ in (*PRICE_PATTERNS, *SPEC_PATTERNS)], (
    (r"(?im)(?:PUDU\s+)?([A-Z]{2,3}\d+(?:-[A-Z]+)?|(?<![A-Z])[A-Z][a-z]+[Bb]ot\d*(?:\s++[A-Z][a-z]++)*+)", "bot", r"([A-Za-z]{2,3}\d++(?:-[A-Za-z]++)?)"),
    (r"(?im)(?:^|\n)(?=[A-Z])([A-Z][A-Za-z0-9\s\-]+(?:Robot|Bot|Service|Cleaner|Vacuum))?+[A-Za-z0-9\s\-]*+", "bot service cleaner vacuum", None),
    (r"(?im)(?:^|\s)(?=[A-Z])([A-Z][a-zA-Z0-9\s]+(?:API|SDK|Service))?+[a-zA-Z0-9\s]*+", "api sdk service", None),
    (r"[\$€£¥]\s*+(\d++(?:,\d{3})*+(?:\.\d{2})?)", "$ € £ ¥", None),
    (r"(?i)(\d(?<!\d\d)\d*+(?:\.\d{2})?)\s*+(?:per|/)\s*month", "month", None),
    (r"(?im)^(?>.*?(?:plan|tier|package)).*?(\$\d+)", "plan tier package", None),
    (r"(?i)(\d(?<!\d\d)\d*+(?:\.\d++)?\s*+(?:GB|MB|TB))\s*+(?:RAM|memory)", "ram memory", None),
    (r"(?i)(\d(?<!\d\d)\d*+(?:\.\d++)?\s*+(?:GB|TB|PB))\s*+(?:storage|disk)", "storage disk", None),
    (r"(?i)(\d(?<!\d\d)\d*+)\s*+(?:core|CPU|processor)", "core cpu processor", None),
), strict=True))
RELEASE_VERSION = r"(?i)(?:released?|launched?)\s+(?:version\s+)?(\d+\.\d+(?:\.\d+)?)"
RELEASE_DATE = r"(?i)(?:released?|launched?|available)\s+(?:on\s+)?(\w+\s+\d{1,2},?\s+\d{4})"
CHANGELOG = r"(?is)##?\s*(?:version\s+)?(\d+\.\d+(?:\.\d+)?)\s*(?:-\s*)?(.+?)(?=##?|\z)"
DOC_TYPES = (("api", "api reference"), ("whitepaper", "whitepaper white-paper"), ("datasheet", "datasheet spec"), ("manual", "manual guide"), ("blog", "blog news"))


def tag_text(html: Column, tag: str) -> Column:
    """Texts of all elements of a kind, tags stripped, joined by blanks."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))
    return F.array_join(F.transform(found, lambda t: F.trim(F.regexp_replace(t, TAG, ""))), " ")


def page_metadata(pages):
    html = F.col("html")
    out = pages.withColumn("title", F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1), TAG, "")))
    out = out.withColumns({h: tag_text(html, h) for h in ("h1", "h2", "h3")})
    out = out.withColumn("content_length", F.length(F.trim(F.regexp_replace(html, TAG, ""))))
    has = reduce(Column.__or__, [F.trim(c) != "" for c in ("title", "h1", "h2", "h3")])
    return out.withColumn("has_minimal_content", has | (F.col("content_length") > 100))


def extract_links(pages, url: str = "url"):
    """(page_id, url, link, priority): distinct links to the same site, resolved and without fragment."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)(?:<a\b[^>]*?\shref|data-href|data-url)\s*=\s*["']([^"']+)["']"""), F.lit(1))
    raw = pages.select("page_id", F.col(url).alias("url"), F.explode(F.array_distinct(found)).alias("raw")).where(~F.col("raw").rlike("^(#|mailto:|tel:|javascript:)"))
    full = raw.withColumn("full", urls.resolve_link(F.trim("raw"), F.col("url")))
    full = full.withColumns({"host": urls.bare_host(F.col("full")), "own": urls.bare_host(F.col("url"))})
    same = full.where((urls.registrable_domain(F.col("host")) == urls.registrable_domain(F.col("own"))) & F.lower(urls.part(F.col("full"), 1)).isin("http", "https"))
    path = F.regexp_replace(urls.part(F.col("full"), 3), "/+$", "")
    query = urls.part(F.col("full"), 4)
    link = F.concat(F.lower(urls.part(F.col("full"), 1)), F.lit("://"), F.col("host"), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return same.select("page_id", "url", link.alias("link")).distinct().withColumn("priority", urls.priority(F.col("link"), urls.LINK_FIRST))


def clean_text(pages, parser: bool = False):
    """Adds clean: the text without scripts, styles and page furniture. parser: by an HTML parser, for malformed markup."""
    if not parser:
        plain = F.regexp_replace(F.regexp_replace("html", BLOCKS, " "), TAG, " ")
        return pages.withColumn("clean", F.trim(F.regexp_replace(plain, r"\s+", " ")))

    @F.pandas_udf("string")
    def parsed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from html.parser import HTMLParser

        class Text(HTMLParser):
            def __init__(self):
                super().__init__()
                self.out, self.depth = [], 0

            def handle_starttag(self, tag, attrs):
                self.depth += tag in ("script", "style", "nav", "footer", "header")

            def handle_endtag(self, tag):
                self.depth = max(0, self.depth - (tag in ("script", "style", "nav", "footer", "header")))

            def handle_data(self, data):
                if not self.depth:
                    self.out.append(data)

        def one(html):
            t = Text()
            t.feed(html or "")
            return " ".join(" ".join(t.out).split())

        for part in parts:
            yield part.map(one)

    return pages.withColumn("clean", parsed("html"))


def key_urls(pages):
    canonical = F.regexp_extract("html", r"""(?is)<link\b[^>]*rel\s*=\s*["']?canonical["']?[^>]*?href\s*=\s*["']([^"']+)["']""", 1)
    return pages.withColumn("key_url", urls.canonical_url(F.coalesce(F.nullif(canonical, F.lit("")), F.col("url"))))


def classify_pages(pages):
    """Adds category, base_score and signals from url, title and h1."""
    u = F.lower("url")
    hits = [(name, category, score, u.rlike(pattern)) for name, category, score, pattern in URL_RULES]
    hits += [(name, category, score, urls.has_any(F.lower(column), words)) for name, category, score, column, words in WORD_RULES]
    order = ["product_url", "product_title", "product_h1", "docs_url", "docs_title", "pricing_url", "pricing_title", "releases_url", "releases_title", "news_url", "news_title"]
    hits.sort(key=lambda h: order.index(h[0]))
    signals = F.array_compact(F.array(*[F.when(on, F.lit(name)) for name, _, _, on in hits]))
    best = F.array_max(F.array_compact(F.array(*[F.when(on, F.struct(F.lit(PRIORITY[c]).alias("p"), F.lit(s).alias("s"), F.lit(c).alias("c"))) for _, c, s, on in hits])))
    out = pages.withColumns({"signals": signals, "best": best})
    some = F.size("signals") > 0
    return out.withColumns({
        "category": F.when(some, F.col("best.c")).otherwise("other"),
        "base_score": F.when(some, F.least(F.lit(1.0), F.col("best.s") + F.size("signals") * 0.05)).otherwise(0.1),
        "signals": F.when(some, F.col("signals")).otherwise(F.array(F.lit("no_classification"))),
    }).drop("best")


def penalised(score: Column, url: Column, depth: Column) -> Column:
    s = score * F.pow(F.lit(0.9), depth)
    s = F.when(urls.has_any(F.lower(url), urls.NOISE), F.least(s, F.lit(0.05))).otherwise(s)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def score_pages(pages):
    """category, score, signals, content_hash of pages (url, html, status, depth)."""
    df = classify_pages(page_metadata(pages))
    bad = (F.col("status") != 200) | (F.coalesce(F.col("html"), F.lit("")) == "")
    pdf = F.contains(F.lower("url"), F.lit("pdf"))
    return df.withColumns({
        "category": F.when(bad, "other").when(pdf, "datasheet").otherwise(F.col("category")),
        "score": F.when(bad, 0.0).when(pdf, 0.9).otherwise(penalised(F.col("base_score"), F.col("url"), F.col("depth"))),
        "signals": F.when(bad, F.array().cast("array<string>")).when(pdf, F.array(F.lit("pdf_url"))).otherwise(F.col("signals")),
        "content_hash": F.when(~bad & ~pdf, F.sha2("html", 256)),
    }).drop("base_score")


def longest(found: Column) -> Column:
    """The first of the longest strings."""
    best = F.aggregate(found, F.lit(None).cast("string"), lambda b, x: F.when(b.isNull() | (F.length(x) > F.length(b)), x).otherwise(b))
    return F.trim(best)


def _all(t: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(t, F.lit(pattern), F.lit(group))


def _in_one_pass(find, t: Column, low: Column, pattern: str) -> Column:
    """find(text, pattern), by the form of the pattern that is kept for it; null or nothing found where no match can be."""
    if pattern not in ONE_PASS:
        return find(t, pattern)
    form, words, rest = ONE_PASS[pattern]
    value = F.when(reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words.split()]), find(t, form))
    return value.otherwise(find(t, rest)) if rest else value


def product_facts(docs, names=NAME_PATTERNS):
    """name, prices and specs of texts, with the mean confidence of what was found."""
    t, low, numbers = F.coalesce(F.col("text"), F.lit("")), F.col("__low"), (*PRICE_PATTERNS, *SPEC_PATTERNS)
    df = docs.withColumn("__low", F.lower(t))
    found = {f"name{i}": longest(_in_one_pass(_all, t, low, p)) for i, (p, _) in enumerate(names)}
    df = df.withColumns(found | {n: _in_one_pass(lambda x, p: F.regexp_extract(x, p, 1), t, low, p) for n, p, _ in numbers})
    fit = [F.length(f"name{i}") > 3 for i in range(len(names))]
    df = df.withColumn("name", F.coalesce(*[F.when(ok, F.col(f"name{i}")) for i, ok in enumerate(fit)])).withColumn("c_name", F.coalesce(*[F.when(ok, F.lit(names[i][1])) for i, ok in enumerate(fit)]))
    df = df.withColumns({n: F.when(F.col(n) != "", F.col(n)) for n, _, _ in numbers})
    sure = F.array_compact(F.array("c_name", *[F.when(F.col(n).isNotNull(), F.lit(c)) for n, _, c in numbers]))
    # sum and number in one go: the array, with all the patterns in it, stands in the plan once
    nothing = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"))
    mean = F.aggregate(sure, nothing, lambda a, x: F.struct((a["total"] + x).alias("total"), (a["n"] + 1).alias("n")), lambda a: F.when(a["n"] > 0, a["total"] / a["n"]).otherwise(0.0))
    return df.withColumn("confidence", mean).drop("__low", "c_name", *[f"name{i}" for i in range(len(names))])


def release_facts(docs):
    """version, date, notes and the mean confidence of what was found; a changelog entry overrides the version."""
    t = F.coalesce(F.col("text"), F.lit(""))
    some = lambda c: F.nullif(c, F.lit(""))
    df = docs.withColumns({"v": some(F.regexp_extract(t, RELEASE_VERSION, 1)), "date": some(F.regexp_extract(t, RELEASE_DATE, 1)), "cv": some(F.regexp_extract(t, CHANGELOG, 1)), "notes": F.trim(some(F.regexp_extract(t, CHANGELOG, 2)))})
    df = df.withColumns({"version": F.coalesce("cv", "v"), "release_name": F.when(F.col("v").isNotNull(), F.concat(F.lit("Version "), "v")).when(F.coalesce("cv", "date").isNotNull(), F.concat(F.lit("Release "), F.coalesce("cv", F.lit("Unknown"))))})
    sure = F.array_compact(F.array(F.when(F.col("v").isNotNull(), F.lit(0.9)), F.when(F.col("date").isNotNull(), F.lit(0.85)), F.when(F.col("cv").isNotNull(), F.lit(0.8))))
    mean = F.aggregate(sure, F.lit(0.0), lambda a, x: a + x, lambda a: F.when(F.size(sure) > 0, a / F.size(sure)).otherwise(0.0))
    return df.withColumn("confidence", mean).drop("v", "cv")


def company_from_url(df):
    host = F.regexp_extract("url", r"https?://(?:www\.)?([^/]+)", 1)
    name = F.initcap(F.replace(F.split_part(host, F.lit("."), F.lit(1)), F.lit("-"), F.lit(" ")))
    return df.where(host != "").withColumns({"company_name": name, "alias": host, "website": F.concat(F.lit("https://"), host), "confidence": F.lit(0.7)})


def document_facts(docs):
    """title (first heading, else h1, else the last part of the URL) and type of documents (url, text)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    last = F.initcap(F.translate(F.element_at(F.split("url", "/"), -1), "-_", "  "))
    some = lambda p: F.nullif(F.trim(F.regexp_extract(t, p, 1)), F.lit(""))
    kind = F.lit("unknown")
    for name, words in reversed(DOC_TYPES):
        kind = F.when(urls.has_any(F.lower("url"), words.split()), name).otherwise(kind)
    return docs.withColumns({"doc_title": F.coalesce(some(r"(?m)^#\s*(.+)$"), some(r"(?i)<h1[^>]*>([^<]+)</h1>"), last), "doc_type": kind, "confidence": F.lit(0.8)})


def extract_entities(docs):
    """Tables of facts by page type: company for all, product for product and pricing, release, document; and sources."""
    kind = F.col("page_type")
    out = {
        "company": company_from_url(docs),
        "product": product_facts(docs.where(kind.isin("product", "pricing"))).where("confidence > 0"),
        "release": release_facts(docs.where(kind.isin("release", "changelog"))).where("version is not null or date is not null"),
        "document": document_facts(docs.where(kind.isin("docs", "documentation"))),
    }
    rows = [df.select("id", F.lit(name).alias("entity_type"), "url", "confidence") for name, df in out.items()]
    return out | {"source": reduce(DataFrame.unionByName, rows)}


def extraction_results(docs, least: float = 0.6):
    """One row a document: how many kinds of entity were found, their mean confidence, and whether that is enough."""
    found = extract_entities(docs)["source"].groupBy("id").agg(F.count_distinct("entity_type").alias("kinds"), F.round(F.avg("confidence"), 9).alias("confidence"))
    out = docs.select("id", "page_type").join(found, "id", "left").na.fill({"kinds": 0, "confidence": 0.0})
    return out.withColumn("success", (F.col("kinds") > 0) & (F.col("confidence") >= least))


def fingerprint(df, text_col="extracted_text", raw_col="raw", type_col="content_type"):
    """Adds content_hash, normalized_text_len, low_text_pdf and needs_render."""
    kind, raw, t = content_family(F.col(type_col)), F.col(raw_col), F.trim(F.coalesce(F.col(text_col), F.lit("")))
    flat = F.regexp_replace(F.lower(t), r"\s+", " ")
    empty = F.coalesce(raw, F.lit("")) == ""
    least = F.when(kind == "pdf", 100).otherwise(50)
    textual = kind.isin("html", "pdf")
    enough = textual & (F.length(t) >= least)
    return df.withColumns({
        "content_hash": F.when(empty, "empty").when(enough, F.sha2(flat, 256)).otherwise(F.sha2(raw, 256)),
        "normalized_text_len": F.when(~empty & enough, F.length(flat)).otherwise(0),
        "low_text_pdf": ~empty & (kind == "pdf") & ~enough,
        "needs_render": empty | ((kind == "html") & ~enough),
    })


def content_family(kind: Column) -> Column:
    mime = F.lower(F.trim(F.split_part(kind, F.lit(";"), F.lit(1))))
    return F.when(F.contains(mime, F.lit("pdf")), "pdf").when(mime.startswith("text/") | F.contains(mime, F.lit("html")), "html").otherwise("binary")


def size_note(length: Column, most: int = 15_000_000) -> Column:
    return F.when(length > most, F.lit("over size limit"))


# Artifacts of extracted text and what stands for them.
CLEANING = (
    (r"\n\s*\n\s*\n+", "\n\n"), (r"[ \t]+", " "), (r"\n ", "\n"), (r" \n", "\n"), (r"(?i)(Cookie|Cookies?)\s+(Policy|Einstellungen|Settings)", ""),
    (r"(?i)(Alle\s+)?Cookies?\s+(akzeptieren|erlauben)", ""), (r"(?i)Browser\s+not\s+compatible", ""), (r"(Return\s+)?Produkte\s+Branchenlösungen\s+Fallstudien\s+Ressourcen\s+News\s+Blogs", "Navigation:"),
)


def clean_extracted_text(t: Column) -> Column:
    for pattern, new in CLEANING:
        t = F.regexp_replace(t, pattern, new)
    return F.trim(t)


def duplicate_content(fps):
    return fps.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def split_unchanged(fps, history, keys=("competitor", "url", "content_hash")):
    """fps with unchanged: whether history holds the same content of the page already."""
    known = history.select(*keys).distinct().withColumn("unchanged", F.lit(True))
    return fps.join(known, list(keys), "left").withColumn("unchanged", F.coalesce("unchanged", F.lit(False)))


def fingerprint_totals(fps):
    return fps.groupBy("fingerprint_session_id").agg(F.count("*").alias("processed"), F.count_if(F.col("content_hash") == "error").alias("errors"))


def token_budget(df, most_chars: int = 450_000, warn: int = 300_000):
    n = F.length(F.coalesce(F.col("text"), F.lit("")))
    return df.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), (n > most_chars).alias("too_long"), (n > warn).alias("warned"))
