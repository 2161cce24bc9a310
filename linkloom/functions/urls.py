"""URL functions (URL-1 to URL-20): keys, classes, suggestions and paths, all built-in expressions.

``normalized`` and ``classified`` work on frames, in stages, so that no long expression is evaluated twice; the others are
functions of columns. Null and "" are "none" and give null or "" as stated.

Not covered of the web's URL rules: internationalised host names stay as written.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.keys import LEGACY_HOST, TENANT_HOST, ascii_lower, col

ORIGIN = f"https://{TENANT_HOST}"
# Shapes of tenant urls.
VIEWER = r"(?i)^/:[wxpo]:(/[rs])?/"
DOC_VIEWER = r"(?i)/_layouts/15/doc\.aspx$"
LIST_FORM = r"(?i)/forms/(allitems|dispform)\.aspx$"
OPAQUE_SHARE = r"(?i)^/:u:/g/"
WRAPPER = r"(?i)^(https?://[^/]+)?/:[a-z]:/[a-z]/"
PAGE_EXTENSION = r"(?i)\.(aspx|asmx|asp|html|htm|php|jsp|master|mht|mhtml)$"
SITE = r"(?i)^(/(?:sites|teams)/[^/]+)/"
KEYED_CLASSES = ("spo-internal", "onprem", "relative", "office-online", "malformed-spo-link")
SITE_PATH = r"^/sites/[a-z0-9-]+$|^/$"


def trim(c: Column | str) -> Column:
    """White space of any kind at both ends."""
    return F.regexp_replace(col(c), r"(?U)^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", "")


def component_decode(c: Column | str) -> Column:
    """All escapes decoded, or none of them if one is malformed; ``+`` stays."""
    c = col(c)
    decoded = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    broken = F.contains(decoded, F.lit("\ufffd")) & ~F.contains(c, F.lit("\ufffd")) & ~ascii_lower(c).contains("%ef%bf%bd")
    return F.when(~F.contains(c, F.lit("%")) | decoded.isNull() | broken, c).otherwise(decoded)


def form_decode(c: Column) -> Column:
    """A query parameter's value: ``+`` is a blank, malformed escapes stay."""
    whole = F.regexp_replace(F.replace(c, F.lit("+"), F.lit(" ")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(F.contains(c, F.lit("%")) | F.contains(c, F.lit("+")), F.coalesce(F.try_url_decode(F.replace(whole, F.lit(" "), F.lit("+"))), c)).otherwise(c)


def component_encode(c: Column) -> Column:
    """Percent-encoded as a path segment or parameter; ``!'()*~`` stay."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for plain, escaped in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return out


def without_dots(path: Column) -> Column:
    """``.`` and ``..`` segments resolved."""
    parts = F.split(path, "/")
    dot, up = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, s: F.when(s.rlike(up), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(s.rlike(dot), acc).otherwise(F.array_append(acc, s)),
    )
    ends = F.element_at(parts, -1).rlike(r"(?i)^(\.|%2e){1,2}$")
    joined = F.concat(F.array_join(kept, "/"), F.when(ends, F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"(?i)/(\.|%2e)"), F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))).otherwise(path)


def _parsed(df: DataFrame, url: str, p: str) -> DataFrame:
    """Adds {p}host ("" where the url has none), {p}path (as written) and {p}query."""
    t = F.regexp_replace(trim(F.coalesce(col(url), F.lit(""))), "[\t\n\r]", "")
    df = df.withColumn(f"{p}t", t)
    absolute = F.col(f"{p}t").rlike("(?i)^https?://")
    rest = F.when(absolute, F.regexp_replace(f"{p}t", "(?i)^https?:/+", "//")).when(F.col(f"{p}t").rlike(r"^[/\\]"), F.col(f"{p}t")).otherwise(F.concat(F.lit("/"), F.col(f"{p}t")))
    df = df.withColumn(f"{p}r", rest)
    before = F.regexp_extract(f"{p}r", r"^([^?#]*)", 1)
    df = df.withColumns({f"{p}b": F.translate(before, "\\", "/"), f"{p}query": F.regexp_extract(f"{p}r", r"^[^?#]*\?([^#]*)", 1)})
    authority = F.regexp_extract(f"{p}b", "^//([^/]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), "^.*@", ""), r":\d*$", "")
    path = F.regexp_replace(f"{p}b", "^//[^/]*", "")
    df = df.withColumns({f"{p}host": F.when(absolute, host).otherwise(F.lit("")), f"{p}path": without_dots(F.when(path == "", F.lit("/")).otherwise(path))})
    return df.drop(f"{p}r", f"{p}b")


def normalized(df: DataFrame, url: str, out: str, depth: int = 2) -> DataFrame:
    """URL-1: adds ``out``, the key ``host/path`` or ``/path``; "" where there is none. ``depth``: list forms inside of list forms."""
    p = f"_{out}{depth}_"
    df = _parsed(df, url, p)
    df = df.withColumn(f"{p}path", component_decode(ascii_lower(f"{p}path")))
    df = df.withColumn(f"{p}path", F.regexp_replace(f"{p}path", VIEWER, "/"))
    host, path, t = F.col(f"{p}host"), F.col(f"{p}path"), F.col(f"{p}t")
    cut = F.when((F.length(path) > 1) & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    key = F.concat(host, cut)
    none = (t == "") | t.rlike(OPAQUE_SHARE) | (t.rlike("(?i)^https?://") & (host == "")) | F.regexp_like(path, F.lit(DOC_VIEWER))
    form = path.rlike(LIST_FORM)
    temporary = [f"{p}{x}" for x in ("t", "host", "path", "query")]
    if depth:
        inner = f"{out}i"
        df = df.withColumn(f"{p}id", form_decode(F.regexp_extract(f"{p}query", r"(?:^|&)id=([^&]*)", 1)))
        df = normalized(df, f"{p}id", inner, depth - 1)
        found = F.when(F.col(inner) == "", F.lit("")).when(F.col(inner).startswith("/"), F.concat(host, inner)).otherwise(F.col(inner))
        temporary += [f"{p}id", inner]
    else:
        found = F.lit("")
    # Out of a generator, as conditions on a key are not pushed below one: pushed, the stages become one expression that fits no driver.
    return df.withColumn(out, F.explode(F.array(F.when(none, F.lit("")).when(form, found).otherwise(key)))).drop(*temporary)


def has_search_fragment(url: Column | str) -> Column:
    """URL-3: a list form with a ``search=`` left in its fragment."""
    u = col(url)
    return u.rlike(r"(?i)/forms/allitems\.aspx\?") & u.rlike(r"(?is)^[^#]*#(?:.*&)?search=")


def link_class(url: Column | str, tenant: str = TENANT_HOST, legacy: tuple[str, ...] = (LEGACY_HOST,)) -> Column:
    """URL-2: one of 13 classes."""
    t = trim(F.coalesce(col(url), F.lit("")))
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(t, r"(?i)^https?:/+([^/\\?#]*)", 1)), "^.*@", ""), r":\d*$", "")
    inside = F.when(has_search_fragment(t), F.lit("malformed-spo-link"))
    absolute = F.when(host == "", F.lit("unknown")).when(host == tenant, inside.otherwise(F.lit("spo-internal"))).when(host.isin(*legacy), F.lit("onprem")).otherwise(F.lit("external"))
    return (
        F.when(t == "", F.lit("unknown"))
        .when(t.startswith("#"), F.lit("anchor-only"))
        .when(t.rlike("(?i)^mailto:"), F.lit("mailto"))
        .when(t.rlike("(?i)^tel:"), F.lit("tel"))
        .when(t.rlike("(?i)^javascript:"), F.lit("javascript"))
        .when(t.rlike(WRAPPER), F.when(t.rlike("(?i)/:[wxpo]:"), F.lit("office-online")).otherwise(F.lit("sharing-link")))
        .when(t.rlike(r"(?i)/_layouts/15/doc\.aspx"), F.lit("doc-aspx"))
        .when(t.rlike("(?i)^https?://"), absolute)
        .when(t.startswith("/"), inside.otherwise(F.lit("relative")))
        .otherwise(F.lit("unknown"))
    )


def all_items_url(path: Column | str, origin: str = ORIGIN) -> Column:
    """URL-4: the library view that shows the file of a path; "" where the path is no document in a library."""
    p = F.regexp_extract(F.coalesce(col(path), F.lit("")), r"^([^?#]*)", 1)
    parts = F.filter(F.split(p, "/"), lambda s: s != "")
    last = F.element_at(parts, -1)
    usable = (
        p.startswith("/") & ~p.rlike(LIST_FORM) & (F.size(parts) >= 3) & ~F.exists(parts, lambda s: s.startswith("_"))
        & last.rlike(r"(?i)\.[a-z0-9]{1,8}$") & ~last.rlike(PAGE_EXTENSION)
    )
    joined = lambda a: F.concat(F.lit("/"), F.array_join(F.transform(a, component_encode), "/"))
    library = joined(F.slice(parts, 1, 3))
    return F.when(usable, F.concat(F.lit(origin), library, F.lit("/Forms/AllItems.aspx?id="), joined(parts), F.lit("&parent="), library)).otherwise(F.lit(""))


def suggestion(url: Column | str, cls: Column | str, include_internal: bool = False) -> Column:
    """URL-5 (URL-6 with ``include_internal``): a canonical url in place of a wrapped, shared or malformed one, or ""."""
    u, c = F.coalesce(col(url), F.lit("")), col(cls)
    path = F.regexp_replace(u, "(?i)^https?://[^/]+", "")
    letters = F.when(c == "office-online", F.lit("wxpo")).when(c == "sharing-link", F.lit("b"))
    tail = F.when(c == "office-online", F.regexp_extract(path, "(?i)^/:[wxpo]:/[rs]/(.+)$", 1)).otherwise(F.regexp_extract(path, "(?i)^/:b:/[rs]/(.+)$", 1))
    whole = F.concat(F.lit("/"), tail)
    strict = F.try_url_decode(F.replace(whole, F.lit("+"), F.lit("%2B")))
    wrapped = F.when((tail == "") | strict.isNull(), F.lit("")).otherwise(all_items_url(strict))
    out = F.when(letters.isNotNull(), wrapped).when((c == "malformed-spo-link") & (F.instr(u, "#") > 1), F.regexp_extract(u, r"(?s)^([^#]*)", 1))
    if include_internal:
        out = out.when(c == "spo-internal", all_items_url(component_decode(path)))
    return out.otherwise(F.lit(""))


def classified(df: DataFrame, url: str = "url") -> DataFrame:
    """URL-7: adds link_class, normalized_key, suggestion, canonical_key and malformed_reason."""
    df = df.withColumn("link_class", link_class(url))
    df = normalized(df, url, "_key")
    df = df.withColumn("normalized_key", F.when(F.col("link_class").isin(*KEYED_CLASSES), F.col("_key")).otherwise(F.lit(""))).drop("_key")
    df = normalized(df.withColumn("suggestion", suggestion(url, "link_class")), "suggestion", "_suggested")
    df = df.withColumn("canonical_key", F.when(F.col("normalized_key") != "", F.col("normalized_key")).otherwise(F.col("_suggested"))).drop("_suggested")
    return df.withColumn("malformed_reason", F.when(F.col("link_class") == "malformed-spo-link", F.lit("search-fragment")))


def classified_document_links(df: DataFrame, url: str = "url", keys: bool = False) -> DataFrame:
    """URL-8: class and reason of document links; without keys unless ``keys`` asks for them."""
    if keys:
        return classified(df, url)
    out = df.withColumn("link_class", link_class(url))
    reason = F.when(F.col("link_class") == "malformed-spo-link", F.lit("search-fragment"))
    return out.withColumns({"normalized_key": F.lit(""), "malformed_reason": reason})


def backfilled(df: DataFrame) -> DataFrame:
    """URL-9: older rows brought up to date: a missed malformed class first, then the suggestion, then the key; nothing known is overwritten."""
    missed = F.col("link_class").isin("spo-internal", "relative") & has_search_fragment("url")
    df = df.withColumns({"upgraded": F.coalesce(missed, F.lit(False)), "link_class": F.when(missed, F.lit("malformed-spo-link")).otherwise(F.col("link_class"))})
    none = lambda c: F.nullif(F.col(c), F.lit(""))
    df = df.withColumn("suggestion", F.coalesce(none("suggestion"), suggestion("url", "link_class", include_internal=True)))
    df = normalized(normalized(df, "url", "_own"), "suggestion", "_suggested")
    own = F.when(F.col("link_class").isin(*KEYED_CLASSES), none("_own"))
    return df.withColumn("canonical_key", F.coalesce(none("canonical_key"), none("normalized_key"), own, F.col("_suggested"))).drop("_own", "_suggested")


def path_only(key: Column | str, tenant: str = TENANT_HOST) -> Column:
    """URL-10: the tenant host taken off a key."""
    k = F.coalesce(col(key), F.lit(""))
    return F.when(k.startswith(f"{tenant}/"), F.substring(k, len(tenant) + 1, 1 << 30)).otherwise(k)


def file_key(df: DataFrame, ref: str, out: str) -> DataFrame:
    """URL-11: adds the canonical key of a file's path."""
    df = normalized(df.withColumn(f"_abs_{out}", absolute_url(ref)), f"_abs_{out}", out)
    return df.withColumn(out, path_only(out)).drop(f"_abs_{out}")


def absolute_url(ref: Column | str, origin: str = ORIGIN) -> Column:
    """URL-12: "" stays, http(s) stays, else below the tenant's origin."""
    r = F.coalesce(col(ref), F.lit(""))
    return F.when((r == "") | r.rlike("(?i)^https?://"), r).when(r.startswith("/"), F.concat(F.lit(origin), r)).otherwise(F.concat(F.lit(f"{origin}/"), r))


def site_label(path: Column | str) -> Column:
    """URL-13: the name in /sites/name or /teams/name, ``root`` for the root, else the last segment."""
    p = F.coalesce(col(path), F.lit(""))
    name = F.regexp_extract(p, "(?i)/(?:sites|teams)/([^/]+)", 1)
    last = F.element_at(F.filter(F.split(p, "/"), lambda s: s != ""), -1)
    return F.when(name != "", name).otherwise(F.when(F.regexp_replace(p, "/", "") == "", F.lit("root")).otherwise(last))


def site_slug(path: Column | str) -> Column:
    """URL-14: a name for files; different sites may have the same."""
    p = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(path), F.lit(""))), "^/sites/", ""), "^/", "")
    p = F.regexp_replace(F.regexp_replace(p, "[^a-z0-9-]", "-"), "-+", "-")
    p = F.substring(F.regexp_replace(p, "^-|-$", ""), 1, 200)
    return F.when(p == "", F.lit("root")).otherwise(p)


def page_folder(url: Column | str) -> Column:
    """URL-15: the first folder below the page assets' root, or ""."""
    return F.regexp_extract(F.coalesce(col(url), F.lit("")), "(?i)/SiteAssets/SitePages/([^/]+)", 1)


def site_of_file(ref: Column | str) -> Column:
    """URL-16: /sites/name or /teams/name of a file, or ""."""
    return F.regexp_extract(F.coalesce(col(ref), F.lit("")), SITE, 1)


def list_form_target(df: DataFrame, url: str, out: str) -> DataFrame:
    """URL-17: adds the file's path in the ``id`` of a list form, or null; its site is site_of_file of it. In stages, so that nothing is decoded twice."""
    u = F.coalesce(F.col(url), F.lit(""))
    before = F.regexp_extract(F.regexp_replace(u, "(?i)^https?://[^/]+", ""), r"^([^#]*)", 1)
    df = df.withColumn(out, F.replace(F.regexp_extract(before, r"(?s)^[^?]*\?(.*)$", 1), F.lit("&amp;"), F.lit("&")))
    df = df.withColumn(out, form_decode(F.regexp_extract(out, r"(?:^|&)id=([^&]*)", 1)))
    df = df.withColumn(out, component_decode(out))
    return df.withColumn(out, F.when(u.rlike(r"(?i)/forms/allitems\.aspx\?") & F.col(out).rlike(SITE), F.col(out)))


def library_url(ref: Column | str) -> Column:
    """URL-18: the library's address, by the first segment below the site, or "" without one."""
    r = F.coalesce(col(ref), F.lit(""))
    found = F.regexp_extract(r, "(?i)^(/(?:sites|teams)/[^/]+/[^/]+)/", 1)
    root = F.regexp_extract(r, "^(/[^/]+)/", 1)
    return F.when(found != "", found).when(r.rlike("(?i)^/(?:sites|teams)/"), F.lit("")).otherwise(root)


def site_paths_checked(df: DataFrame, path: str) -> DataFrame:
    """URL-19: adds checked_path (with a leading slash) and is_valid."""
    p = trim(F.coalesce(col(path), F.lit("")))
    return df.withColumn("checked_path", F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))).withColumn("is_valid", F.col("checked_path").rlike(SITE_PATH))


def glob_pattern(glob: str) -> str:
    """URL-20: ``**`` any text, ``*`` text without a slash, ``?`` one such character; whole value, any case. The same for Java and RE2."""
    tokens = re.findall(r"\*\*|\*|\?|[^*?]+", glob, re.S)
    fixed = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "(?i)^" + "".join(fixed.get(t) or re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", t) for t in tokens) + "$"


def matches_any(value: Column | str, globs: list[str]) -> Column:
    tests = [F.coalesce(col(value), F.lit("")).rlike(glob_pattern(g)) for g in globs]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def encoded_path(path: Column | str) -> Column:
    """SRC-11: each segment percent-encoded, quotes doubled."""
    p = F.coalesce(col(path), F.lit(""))
    return F.replace(F.array_join(F.transform(F.split(p, "/"), component_encode), "/"), F.lit("'"), F.lit("''"))


#: Functions of one column that ``register`` offers to SQL.
SCALARS = {
    "ll_link_class": link_class, "ll_has_search_fragment": has_search_fragment, "ll_all_items_url": all_items_url, "ll_path_only": path_only, "ll_absolute_url": absolute_url,
    "ll_site_label": site_label, "ll_site_slug": site_slug, "ll_page_folder": page_folder, "ll_site_of_file": site_of_file,
    "ll_library_url": library_url, "ll_encoded_path": encoded_path,
}
