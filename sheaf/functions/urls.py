"""URLs as keys: normal forms, checks and types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that say how a visitor came and not what the page is.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "_ga"]
#: Resource types by extension and by MIME type.
TYPES = {
    "pdf": ["pdf"], "document": ["doc", "docx", "rtf", "odt", "ppt", "pptx"], "spreadsheet": ["xls", "xlsx", "xlsm", "csv", "ods"], "archive": ["zip", "rar", "7z", "gz"],
    "image": ["jpg", "jpeg", "png", "gif", "webp", "svg", "bmp", "tif", "tiff"], "web": ["htm", "html"],
}
MIME = {
    "pdf": ["application/pdf"], "document": ["application/msword", "application/rtf", "application/vnd.openxmlformats-officedocument.wordprocessingml", "application/vnd.openxmlformats-officedocument.presentationml", "application/vnd.ms-powerpoint"],
    "spreadsheet": ["application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml", "application/vnd.oasis.opendocument.spreadsheet", "text/csv"], "archive": ["application/zip", "application/x-rar"], "image": ["image/"], "web": ["text/html"],
}


def _part(c: Column, part: str) -> Column:
    return F.try_parse_url(c, F.lit(part))


def host(c: Column) -> Column:
    return F.lower(_part(c, "HOST"))


def _port(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(_part(c, "AUTHORITY"), F.lit("")), r":(\d+)$", 1)


def normalize_url(c: Column) -> Column:
    """Lower-case scheme and host, no default port, no tracking parameters, no fragment; path and order as they are."""
    scheme, port = F.lower(_part(c, "PROTOCOL")), _port(c)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    query = F.filter(F.split(F.coalesce(_part(c, "QUERY"), F.lit("")), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(TRACKING))
    asked = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit(""))
    return F.concat(scheme, F.lit("://"), host(c), F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)), F.coalesce(_part(c, "PATH"), F.lit("")), asked)


def comparison_key(c: Column) -> Column:
    """Host, decoded path and query, without port, user and fragment; a plus sign stays one."""
    path = F.try_url_decode(F.replace(F.coalesce(_part(c, "PATH"), F.lit("")), F.lit("+"), F.lit("%2B")))
    query = _part(c, "QUERY")
    return F.concat(F.lower(_part(c, "PROTOCOL")), F.lit("://"), host(c), path, F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def page_key(c: Column) -> Column:
    return F.regexp_replace(comparison_key(c), "/+$", "")


def refusal(c: Column, https_only: bool = False) -> Column:
    """Why a URL isn't fetched, or null."""
    scheme = F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    reason = F.when(~scheme.isin("http", "https"), "scheme")
    if https_only:
        reason = reason.when(scheme != "https", "not https")
    return reason.when(F.coalesce(_part(c, "USERINFO"), F.lit("")) != "", "user info").when(F.coalesce(_part(c, "HOST"), F.lit("")) == "", "no host")


def extension(c: Column) -> Column:
    """Of the decoded path, up to five letters and digits, lower case; null without one."""
    path = F.try_url_decode(F.replace(F.coalesce(_part(c, "PATH"), F.lit("")), F.lit("+"), F.lit("%2B")))
    found = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})/*$", 1))
    return F.when(found != "", found)


def resource_type(c: Column, mime: Column) -> Column:
    """The beginning of the MIME type decides if there is one, or else the extension."""
    given = F.lower(F.trim(mime))
    by_mime, by_extension = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for kind, starts in MIME.items():
        for start in starts:
            by_mime = by_mime.when(given.startswith(start), kind)
    for kind, names in TYPES.items():
        by_extension = by_extension.when(extension(c).isin(names), kind)
    return F.when(F.coalesce(mime, F.lit("")) != "", by_mime.otherwise("unknown")).otherwise(by_extension.otherwise("unknown"))
