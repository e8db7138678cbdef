"""URL rules as column expressions. Nulls give null unless said otherwise; malformed URLs never raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Component pattern of RFC 3986, appendix B: 1 scheme, 2 authority, 3 path, 4 query, 5 fragment.
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# They must equal the lists of the site filter for the same pages to be kept.
TRACKING_KEYS = "utm_source utm_medium utm_campaign utm_content utm_term gclid fbclid msclkid _ga _gl gad_source gad_campaignid gbraid".split()
LOW_VALUE = (
    "privacy privacy-policy privacy_policy terms terms-of-service terms_of_service terms-of-use terms_of_use legal legal-notice legal_notice "
    "cookies cookie-policy cookie_policy accessibility-statement accessibility_statement robots.txt contact contact-us contact_us support help faq "
    "careers jobs hiring login signin register signup admin dashboard account search search? 404 error not-found test testing staging preview demo "
    "api/ api/v api/v1 api/v2 feed rss atom sitemap sitemap.xml sitemap_index.xml"
).split()
SKIP_SUFFIXES = (
    ".pdf .doc .docx .xls .xlsx .ppt .pptx .zip .rar .tar .gz .jpg .jpeg .png .gif .svg .webp .mp4 .avi .mov .wmv .mp3 .wav .flac "
    ".css .js .json .xml .txt .ico .woff .woff2 .ttf .eot"
).split()
SKIP_QUERY = (
    "utm_ utm_source utm_medium utm_campaign ref= referrer= source= fbclid= gclid= msclkid= sessionid= sid= debug= test= preview= print= printable= "
    "share= lang= language= currency= country= sort= order= filter= page= p= offset= limit= per_page= format= output= callback= jsonp="
).split()
# Path segments of other languages.
LANGUAGE_SEGMENTS = (
    "/de/ /german/ /deutsch/ /es/ /spanish/ /espanol/ /fr/ /french/ /francais/ /it/ /italian/ /italiano/ /pt/ /portuguese/ /portugues/ /ru/ /russian/ "
    "/russkiy/ /nl/ /dutch/ /nederlands/ /sv/ /swedish/ /svenska/ /no/ /norwegian/ /norsk/ /da/ /danish/ /dansk/ /fi/ /finnish/ /suomi/ /pl/ /polish/ "
    "/polski/ /cs/ /czech/ /cesky/ /hu/ /hungarian/ /magyar/ /ro/ /romanian/ /romana/ /bg/ /bulgarian/ /bulgarski/ /hr/ /croatian/ /hrvatski/ /sk/ "
    "/slovak/ /slovensky/ /sl/ /slovenian/ /slovenski/ /et/ /estonian/ /eesti/ /lv/ /latvian/ /latviesu/ /lt/ /lithuanian/ /lietuviu/ /el/ /greek/ "
    "/ellinika/ /tr/ /turkish/ /turkce/ /he/ /hebrew/ /ivrit/ /uk/ /ukrainian/ /ukrayinska/ /be/ /belarusian/ /belaruski/ /zh/ /chinese/ /zhongwen/ /ja/ "
    "/japanese/ /nihongo/ /ko/ /korean/ /hangugeo/ /th/ /thai/ /vi/ /vietnamese/ /tieng-viet/ /id/ /indonesian/ /bahasa-indonesia/ /ms/ /malay/ "
    "/bahasa-melayu/ /tl/ /filipino/ /tagalog/ /hi/ /hindi/ /hindustani/ /bn/ /bengali/ /bangla/ /ta/ /tamil/ /te/ /telugu/ /ml/ /malayalam/ /kn/ "
    "/kannada/ /gu/ /gujarati/ /pa/ /punjabi/ /or/ /odia/ /as/ /assamese/ /mr/ /marathi/ /ur/ /urdu/ /fa/ /persian/ /farsi/ /ar/ /arabic/ /arabiya/ /af/ "
    "/afrikaans/ /sw/ /swahili/ /kiswahili/ /am/ /amharic/ /so/ /somali/ /soomaali/ /ka/ /georgian/ /kartuli/ /hy/ /armenian/ /hayeren/ /az/ /azerbaijani/ "
    "/azerbaycan/ /kk/ /kazakh/ /qazaq/ /ky/ /kyrgyz/ /kyrgyzcha/ /uz/ /uzbek/ /o'zbek/ /tg/ /tajik/ /tojiki/ /mn/ /mongolian/ /mongol/ /my/ /burmese/ "
    "/myanmar/ /km/ /khmer/ /lo/ /lao/ /si/ /sinhala/ /ne/ /nepali/ /bo/ /tibetan/ /bod-skad/ /dz/ /dzongkha/ /ti/ /tigrinya/ /om/ /oromo/ /ps/ /pashto/ "
    "/sd/ /sindhi/ /sa/ /sanskrit/ /zu/ /zulu/ /xh/ /xhosa/ /st/ /sesotho/ /tn/ /setswana/ /ss/ /swati/ /ve/ /venda/ /ts/ /tsonga/ /nr/ /ndebele/ /nso/ "
    "/northern-sotho/ /sesotho-sa-leboa/ "
).split()
#: Whatever may skip a URL.
SKIPPED = "|".join([*(rf"\Q{x}\E" for x in [*LOW_VALUE, *LANGUAGE_SEGMENTS, *SKIP_QUERY]), "(?:" + "|".join(rf"\Q{x}\E" for x in SKIP_SUFFIXES) + ")$", "#"])
FRAGMENTS = "section chapter part tab panel".split()
TWO_PART_SUFFIXES = "co.uk com.au co.jp co.kr co.za co.in com.br com.mx com.ar com.sg com.hk org.uk net.uk ac.uk gov.uk com.cn net.cn org.cn gov.cn".split()
PLACEHOLDERS = "example.org example.net test.com test.org test.net localhost local".split()
PRIVATE = r"^127\.|^10\.|^192\.168\.|^172\.(1[6-9]|2[0-9]|3[0-1])\.|^::1$|^localhost$|^0\.0\.0\.0$"
NOISE = "careers privacy terms cookies legal".split()
NOISE_SCORING = "careers privacy terms cookies legal accessibility contact support help faq sitemap".split()
SEED_FIRST, SEED_NEXT = "/product /solution /item /model".split(), "/docs /download /news /blog".split()
LINK_FIRST = "/product /solution /item /category".split()
CLUES = {
    "product": "product products robot robots", "pricing": "pricing price cost plan subscription", "news": "news blog press announcement", "documentation": "docs documentation manual guide",
    "company": "about company team mission", "careers": "careers jobs hiring", "legal": "privacy terms legal cookies",
}


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def literals(values) -> Column:
    return F.array(*map(F.lit, values))


def first_in(text: Column, values) -> Column:
    """The first listed value that the text contains, else null."""
    return F.get(F.filter(literals(values), lambda p: F.contains(text, p)), F.lit(0))


def has_any(text: Column, values) -> Column:
    return F.exists(literals(values), lambda p: F.contains(text, p))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(part(url, 2)), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """Lower scheme and host, no www., no trailing slash, no fragment, no tracking or valueless parameters; '' for ''."""
    path = F.regexp_replace(part(url, 3), "/+$", "")
    keep = F.filter(F.split(part(url, 4), "&"), lambda p: F.contains(p, F.lit("=")) & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(TRACKING_KEYS))
    query = F.array_join(keep, "&")
    scheme = F.lower(part(url, 1))
    built = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(bare_host(url) != "", F.concat(F.lit("//"), bare_host(url))).otherwise(""), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url == "", "").otherwise(built)


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three where the last two are a known suffix."""
    labels = F.split(F.lower(host), r"\.")
    n = F.size(labels)
    tail = lambda k: F.array_join(F.slice(labels, n - k + 1, F.lit(k)), ".")
    return F.when(n <= 1, F.lower(host)).when((n >= 3) & tail(2).isin(TWO_PART_SUFFIXES), F.when(n >= 3, tail(3))).when(n >= 2, tail(2))


def resolve_link(link: Column, base: Column) -> Column:
    """An absolute link as it is, a root-relative one on the host of base, any other in the folder of base; ./ and ../ resolved."""
    origin = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(part(base, 3), "[^/]*$", "")
    joined = F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(part(base, 1), F.lit(":"), link))
    joined = joined.when(link.startswith("/"), F.concat(origin, link)).otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), link))
    # the segments of the path are folded into one list, from which .. takes the last
    path, start = part(joined, 3), F.length(part(joined, 1)) + F.length(part(joined, 2)) + 3
    segments = F.split(path, "/")
    fold = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.array_append(a, x))
    kept = F.aggregate(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), F.array(F.lit("")), fold)
    kept = F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    resolved = F.concat(F.substring(joined, 1, start), F.when(F.size(kept) == 1, "/").otherwise(F.array_join(kept, "/")), F.substring(joined, start + F.length(path) + 1, F.length(joined)))
    return F.when(joined.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^?#]*/[.]"), resolved).otherwise(joined)


def skip_reason(url: Column) -> Column:
    """The first reason for which the site filter skips a URL, else null.

    One compiled pattern passes over the many URLs that hold none of the values; only the others are searched in order.
    """
    u = F.lower(url)
    suffix = F.get(F.filter(literals(SKIP_SUFFIXES), lambda s: F.endswith(u, s)), F.lit(0))
    fragment = F.split_part(u, F.lit("#"), F.lit(2))
    reason = F.coalesce(
        F.concat(F.lit("URL contains low-value pattern: "), first_in(u, LOW_VALUE)),
        F.concat(F.lit("URL has skip extension: "), suffix),
        F.concat(F.lit("URL contains non-English language path: "), first_in(u, LANGUAGE_SEGMENTS)),
        F.concat(F.lit("URL has skip query parameter: "), first_in(u, SKIP_QUERY)),
        F.when(has_any(fragment, FRAGMENTS), F.concat(F.lit("URL has skip fragment: "), fragment)),
    )
    return F.when(u.rlike(SKIPPED), reason)


def priority(url: Column, first=SEED_FIRST, second=SEED_NEXT) -> Column:
    u = F.lower(url)
    return F.when(has_any(u, first), 0).when(has_any(u, second), 1).otherwise(2)


def validated(text: Column) -> Column:
    """struct(ok, reason, origin, path, domain) of a typed-in URL; reason is null when it is accepted."""
    t = F.trim(text)
    url = F.when(F.contains(t, F.lit("://")), t).otherwise(F.concat(F.lit("https://"), t))
    scheme, authority = F.lower(part(url, 1)), F.regexp_replace(F.lower(part(url, 2)), "^.*@", "")
    host, port = F.regexp_replace(authority, ":[0-9]*$", ""), F.regexp_extract(authority, ":([0-9]+)$", 1)
    placeholder = F.exists(literals(PLACEHOLDERS), lambda p: (host == p) | F.endswith(host, F.concat(F.lit("."), p)))
    reason = (
        F.when(F.length(t) > 2000, "URL is too long (max 2000 characters)")
        .when(F.contains(t, F.lit(" ")), "URL cannot contain spaces")
        .when(host == "", "Invalid URL format")
        .when(~scheme.isin("http", "https"), "Only HTTP and HTTPS URLs are supported")
        .when(host.rlike(PRIVATE), "Private IP addresses and localhost are not allowed")
        .when(placeholder, "Placeholder domains are not allowed")
        .when(~F.contains(host, F.lit(".")), "Invalid domain name")
    )
    path = F.concat(part(url, 3), F.when(part(url, 4) != "", F.concat(F.lit("?"), part(url, 4))).otherwise(""), F.when(part(url, 5) != "", F.concat(F.lit("#"), part(url, 5))).otherwise(""))
    origin = F.concat(scheme, F.lit("://"), host, F.when((port != "") & ~port.isin("80", "443"), F.concat(F.lit(":"), port)).otherwise(""), F.lit("/"))
    ok = reason.isNull()
    return F.struct(ok.alias("ok"), reason.alias("reason"), F.when(ok, origin).alias("origin"), F.when(ok & ~path.isin("", "/"), path).alias("path"), F.when(ok, registrable_domain(host)).alias("domain"))


def with_scheme(website: Column) -> Column:
    return F.when(website.startswith("http://") | website.startswith("https://"), website).otherwise(F.concat(F.lit("https://"), website))


def label_from_url(url: Column) -> Column:
    """The first host label without www, www2 or www3, capitalised; Unknown without a host."""
    host = F.regexp_replace(F.lower(part(url, 2)), r"^www[23]?\.", "")
    return F.when(host == "", "Unknown").otherwise(F.initcap(F.split_part(host, F.lit("."), F.lit(1))))


def clues(url: Column) -> Column:
    u = F.lower(url)
    return F.array_compact(F.array(*[F.when(has_any(u, words.split()), F.lit(name)) for name, words in CLUES.items()]))


def path_segments(url: Column) -> Column:
    return F.filter(F.split(part(url, 3), "/"), lambda s: ~s.isin("", "index", "home"))
