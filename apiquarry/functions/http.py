"""HTTP expressions: statuses, headers, methods, URLs, credentials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ports a scheme implies.
DEFAULT_PORTS = {"http": 80, "ws": 80, "https": 443, "wss": 443, "ftp": 21}


def is_success(status: Column) -> Column:
    return status.between(200, 299)


def is_redirect(status: Column) -> Column:
    return status.between(300, 399)


def is_error(status: Column) -> Column:
    return status >= 400


def succeeded(status: Column) -> Column:
    """History's own notion: an answer below 400; no answer is not a success."""
    return F.coalesce(status.between(200, 399), F.lit(False))


def header_value(headers: Column, name: Column | str) -> Column:
    """First header by case-insensitive name."""
    wanted = F.lower(name if isinstance(name, Column) else F.lit(name))
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == wanted), F.lit(0))["value"]


def header_names(headers: Column) -> Column:
    """Distinct lower-cased header names, sorted."""
    return F.array_sort(F.array_distinct(F.transform(headers, lambda h: F.lower(h["name"]))))


def enabled_rows(rows: Column) -> Column:
    return F.filter(rows, lambda r: r["enabled"])


def is_safe(method: Column) -> Column:
    return method.isin("GET", "HEAD", "OPTIONS", "TRACE")


def is_idempotent(method: Column) -> Column:
    return is_safe(method) | method.isin("PUT", "DELETE")


def conventionally_has_body(method: Column) -> Column:
    return method.isin("POST", "PUT", "PATCH")


def url_scheme(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit("")))


def _authority(url: Column) -> Column:
    """Host and port as written, without credentials."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^.*@", "")


def url_host(url: Column) -> Column:
    """Lower-case host; an IPv6 host keeps its brackets, as in URL text."""
    a = F.lower(_authority(url))
    return F.nullif(F.regexp_extract(a, r"^(\[[^\]]*\]|[^:]*)", 1), F.lit(""))


def url_port(url: Column) -> Column:
    """The port when stated and not the scheme's own."""
    stated = F.nullif(F.regexp_extract(_authority(url), r":(\d+)$", 1), F.lit("")).cast("int")
    return F.nullif(stated, default_port(url))


def default_port(url: Column) -> Column:
    s = url_scheme(url)
    out = F.lit(None).cast("int")
    for scheme, port in DEFAULT_PORTS.items():
        out = F.when(s == scheme, port).otherwise(out)
    return out


def effective_port(url: Column) -> Column:
    return F.coalesce(url_port(url), default_port(url))


def display_host(url: Column) -> Column:
    return F.coalesce(F.concat_ws(":", url_host(url), url_port(url).cast("string")), url)


def is_loopback(url: Column) -> Column:
    """localhost and its sub-domains, 127/8, ``::1``, mapped 127/8 and the unspecified hosts."""
    h = F.regexp_replace(url_host(url), r"\.+$", "")
    v4 = h.rlike(r"^127\.\d{1,3}\.\d{1,3}\.\d{1,3}$") | (h == "0.0.0.0")
    v6 = h.isin("[::1]", "[::]", "[0:0:0:0:0:0:0:1]", "[0:0:0:0:0:0:0:0]")
    mapped = h.rlike(r"^\[::ffff:(127\.\d{1,3}\.\d{1,3}\.\d{1,3}|7f[0-9a-f]{2}:[0-9a-f]{1,4})\]$")
    named = (h == "localhost") | h.endswith(".localhost")
    return F.coalesce(named | v4 | v6 | mapped, F.lit(False))


def same_origin(a: Column, b: Column) -> Column:
    """Scheme, host and effective port equal."""
    return (
        url_scheme(a).eqNullSafe(url_scheme(b))
        & url_host(a).eqNullSafe(url_host(b))
        & effective_port(a).eqNullSafe(effective_port(b))
    )


def decode_form(c: Column) -> Column:
    """One form-encoded piece as text; a broken escape stays as written."""
    return F.coalesce(F.try_url_decode(c), c)


def query_rows(query: Column) -> Column:
    """``a=1&b`` to decoded (key, value) rows in order; empty pieces are dropped."""
    pieces = F.filter(F.split(query, "&", -1), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            decode_form(F.substring_index(p, "=", 1)).alias("key"),
            F.when(F.contains(p, F.lit("=")), decode_form(F.regexp_replace(p, r"^[^=]*=", "")))
            .otherwise("")
            .alias("value"),
        ),
    )


def url_query(url: Column) -> Column:
    """Query text without ``?`` and fragment; NULL when there is none."""
    bare = F.regexp_replace(url, r"#[\s\S]*$", "")
    return F.when(F.contains(bare, F.lit("?")), F.regexp_replace(bare, r"^[^?]*\?", ""))


def url_without_query(url: Column) -> Column:
    """The URL with its query cut out. A host without a path gets ``/``, as URL parsers do."""
    fragment = F.regexp_extract(url, r"(#[\s\S]*)$", 1)
    bare = F.regexp_replace(F.regexp_replace(url, r"#[\s\S]*$", ""), r"\?[\s\S]*$", "")
    rooted = F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$"), F.concat(bare, F.lit("/"))).otherwise(bare)
    return F.concat(rooted, fragment)


def split_url_query(url: Column) -> Column:
    """Base URL plus decoded query rows; a text without a scheme keeps no rows."""
    parsed = url_scheme(url).isNotNull()
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.struct(
        F.when(parsed, url_without_query(url)).otherwise(url).alias("base"),
        F.when(parsed, F.coalesce(query_rows(url_query(url)), none)).otherwise(none).alias("query"),
    )


def path_of_url(url: Column) -> Column:
    """The part of a URL worth showing: no leading ``{{variable}}``, no origin."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^\{\{[^}]*\}\}", ""), r"(?i)^[a-z][a-z0-9+.-]*://[^/]*", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.nullif(url, F.lit("")), F.lit("/"))


def fill_path_values(url: Column, values: Column) -> Column:
    """Replace ``{name}`` by each non-empty value, in name order."""
    entries = F.array_sort(F.map_entries(values))
    return F.aggregate(
        F.filter(entries, lambda e: e["value"] != ""),
        url,
        lambda a, e: F.replace(a, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]),
    )


def unfilled_placeholder(url: Column) -> Column:
    """The first ``{…}`` still there, or NULL."""
    return F.nullif(F.regexp_extract(url, r"(\{[^}]*\})", 1), F.lit(""))


def form_encode(c: Column) -> Column:
    """``application/x-www-form-urlencoded`` bytes; ``*`` stays, blanks become ``+``."""
    return F.url_encode(c)


def form_pairs(rows: Column) -> Column:
    return F.array_join(
        F.transform(rows, lambda r: F.concat(form_encode(r["key"]), F.lit("="), form_encode(r["value"]))), "&"
    )


def _auth(type_: str, format_=None, name=None, location=None, hint=None) -> Column:
    def of(v):
        return (v if isinstance(v, Column) else F.lit(v)).cast("string")

    return F.struct(
        F.lit(type_).alias("type"),
        of(format_).alias("format"),
        of(name).alias("name"),
        of(location).alias("location"),
        F.array().cast("array<string>").alias("scopes"),
        of(hint).alias("hint"),
    )


def _any_of(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


# Name parts that mark authentication, per language family.
PYTHON_AUTH_WORDS = ["auth", "current_", "require", "logged", "login", "token", "security", "permission"]
MIDDLEWARE_AUTH_WORDS = [
    "auth", "protect", "guard", "jwt", "token", "verify", "loggedin", "logged_in", "ensure",
    "session", "passport", "requireuser", "require_user", "permission",
]


def auth_from_name(name: Column) -> Column:
    """Guess a dependency's authentication scheme from its name."""
    n = F.lower(name)
    return (
        F.when(_any_of(n, ["oauth", "bearer", "jwt"]), _auth("bearer"))
        .when(_any_of(n, ["basic"]), _auth("basic"))
        .when(_any_of(n, ["api_key", "apikey"]), _auth("api_key", name=name, location="header"))
        .when(_any_of(n, PYTHON_AUTH_WORDS), _auth("unknown", hint=name))
    )


def auth_from_middleware(name: Column) -> Column:
    """The same guess for a middleware; names that end like a router's do not count."""
    n = F.lower(name)
    jwt = F.contains(n, F.lit("jwt"))
    counts = ~n.rlike("(router|routes|route)$") & _any_of(n, MIDDLEWARE_AUTH_WORDS)
    return (
        F.when(~counts, None)
        .when(jwt | F.contains(n, F.lit("bearer")), _auth("bearer", format_=F.when(jwt, F.lit("JWT"))))
        .when(F.contains(n, F.lit("basic")), _auth("basic"))
        .otherwise(_auth("unknown", hint=name))
    )


def language_of(path: Column) -> Column:
    """Language by file extension; NULL when the extension means nothing here."""
    ext = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    return (
        F.when(ext.isin("py", "pyi"), "python")
        .when(ext.isin("js", "jsx", "mjs", "cjs"), "javascript")
        .when(ext.isin("ts", "tsx", "mts", "cts"), "typescript")
        .when(ext == "go", "go")
    )
