"""URL extraction as a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What may stand in a link, and what does not end one.
LINK = r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s\x{00}-\x{20}\x{7F}-\x{A0}\x{2028}\x{2029}<>\"`{}|\\^]+"
TRAILING = r"[.,:;!?'*]+\z"
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)(.*)\z"


def _trimmed(url: Column) -> Column:
    return F.regexp_replace(url, F.lit(TRAILING), F.lit(""))


def _closer_remover(opening: str, closing: str) -> Callable[[Column], Column]:
    """Takes a closing bracket that was not opened inside the link from its end."""

    def run(url: Column) -> Column:
        count = lambda c: F.length(url) - F.length(F.replace(url, F.lit(c), F.lit("")))
        return F.when(url.endswith(closing) & (count(closing) > count(opening)), F.substring(url, F.lit(1), F.length(url) - 1)).otherwise(url)

    return run


def _parts(url: Column) -> Column:
    place = F.regexp_extract(url, r"(?s)" + PARTS, 2)
    return F.struct(
        F.lower(F.regexp_extract(url, r"(?s)" + PARTS, 1)).alias("scheme"),
        F.regexp_extract(place, r"^(.*@)?", 1).alias("user"),
        F.lower(F.regexp_replace(place, r"^.*@", "")).alias("host"),
        F.regexp_extract(url, r"(?s)" + PARTS, 3).alias("rest"),
    )


def _normalised(p: Column) -> Column:
    port = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv)), p["scheme"]), F.lit("-"))
    host = F.regexp_replace(p["host"], F.concat(F.lit(":"), port, F.lit("$|:$")), F.lit(""))
    path = F.when((p["rest"] == "") | F.substring(p["rest"], 1, 1).isin("?", "#"), F.concat(F.lit("/"), p["rest"])).otherwise(p["rest"])
    return F.when((host != "") & ~host.rlike(r"^:|[\[\]]|:.*[^0-9]"), F.concat(p["scheme"], F.lit("://"), p["user"], host, path))


def extract_urls(text: Column) -> Column:
    """The text's links with a scheme and a host, normalised and distinct, in their first order; null stays null.

    Scheme and host are lower-cased, a default port is dropped, and an empty path becomes "/".
    """
    links = F.regexp_extract_all(text, F.lit(f"({LINK})"), F.lit(1))
    # One step at a time, so that each mentions its link as a variable.
    for _ in range(3):
        links = F.transform(links, _trimmed)
        for opening, closing in (("(", ")"), ("[", "]")):
            links = F.transform(links, _closer_remover(opening, closing))
    parts = F.transform(F.transform(links, _trimmed), _parts)
    return F.array_distinct(F.filter(F.transform(parts, _normalised), lambda u: u.isNotNull()))
