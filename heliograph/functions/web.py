"""URLs, HTTP request targets and the remote end of a span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions.values import first_attribute, first_of

HTTP_STATUS_KEYS = ("http.status_code", "http.response.status_code")


# Generic URI syntax (RFC 3986, appendix B).
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?\[?((?<=\[)[^\]/?#]*|(?<!\[)[^:/?#]*)"


def url_path(url: Column) -> Column:
    """Path of a URL without its ``;parameters``, ``/`` when it has none; NULL stays NULL."""
    path = F.regexp_replace(F.regexp_extract(url, _PATH, 1), ";[^/]*$", "")
    return F.when(path == "", "/").otherwise(path)


def url_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def http_status(df: DataFrame) -> Column:
    return first_attribute(df, *HTTP_STATUS_KEYS).try_cast("int")


def request_target(df: DataFrame) -> Column:
    """URL path, else route, else the raw target."""
    return F.coalesce(
        url_path(first_attribute(df, "http.url", "url.full")),
        first_attribute(df, "http.route", "http.target", "url.path"),
    )


def client_database(df: DataFrame) -> Column:
    """Database a CLIENT span talks to: needs both the system and the name."""
    return F.when(first_attribute(df, "db.system").isNotNull(), first_attribute(df, "db.name"))


def client_target(df: DataFrame) -> Column:
    """Remote end of a CLIENT span: database, peer service, address without port, URL host."""
    address = first_attribute(df, "server.address", "net.peer.name")
    return first_of(
        client_database(df),
        first_attribute(df, "peer.service"),
        F.split_part(address, F.lit(":"), F.lit(1)),
        url_host(first_attribute(df, "http.url", "url.full")),
    )


def message_destination(df: DataFrame) -> Column:
    return F.when(
        first_attribute(df, "messaging.system").isNotNull(),
        first_attribute(df, "messaging.destination.name", "messaging.destination"),
    )


def message_source(df: DataFrame) -> Column:
    """Where a CONSUMER span read from."""
    return F.when(
        first_attribute(df, "messaging.system").isNotNull(),
        first_attribute(df, "messaging.source.name", "messaging.destination.name", "messaging.destination"),
    )
