"""Hashes, stable ids, canonical links and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalloom.functions import text as T

# Fixed value: parts of an absolute link (scheme, authority, path, query).
URL_PATTERN = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def content_hash(platform: Column, module_run_id: Column, external_id: Column) -> Column:
    """Key that makes a second delivery of the same item visible."""
    return F.sha2(
        F.concat_ws(":", platform.cast("string"), module_run_id.cast("string"), external_id.cast("string")), 256
    )


def url_part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.regexp_replace(T.strip(url), r"[\t\r\n]", ""), URL_PATTERN, group)


def canonical_url(url: Column) -> Column:
    """Web link in canonical form; NULL for other schemes and for no host."""
    scheme = F.lower(url_part(url, 1))
    host = F.lower(url_part(url, 2))
    path = F.coalesce(F.nullif(url_part(url, 3), F.lit("")), F.lit("/"))
    query = url_part(url, 4)
    link = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (host != ""), link)


def url_owner(url: Column, hosts: tuple[str, ...] = ("github.com", "www.github.com")) -> Column:
    """First path element of a link to one of ``hosts``; NULL otherwise."""
    host = F.regexp_replace(F.lower(url_part(url, 2)), r"^.*@|:\d*$", "")
    owner = F.regexp_extract(url_part(url, 3), r"^/*([^/]+)", 1)
    return F.when(host.isin(*hosts), F.nullif(owner, F.lit("")))


def search_result_id(query: Column, engine: Column, canonical: Column) -> Column:
    """Stable id of one search hit, independent of its position."""
    parts = F.concat_ws("\0", T.casefold(T.collapse(query)), T.casefold(engine), canonical)
    return F.when(canonical.isNotNull(), F.concat(F.lit("serpex:"), F.sha2(parts, 256)))


def cache_key(
    *,
    keyword: Column,
    text: Column,
    language: Column,
    provider: str,
    model: str,
    prompt_hash: str,
    prompt_version: str,
    response_schema_version: str,
) -> Column:
    """Key of one inference: hash over a JSON object with sorted field names."""
    identity = F.struct(
        F.sha2(T.strip(text), 256).alias("input_hash"),
        F.sha2(keyword, 256).alias("keyword_hash"),
        F.coalesce(language, F.lit("")).alias("language"),
        F.lit(model).alias("model"),
        F.lit(prompt_hash).alias("prompt_hash"),
        F.lit(prompt_version).alias("prompt_version"),
        F.lit(provider).alias("provider"),
        F.lit(response_schema_version).alias("response_schema_version"),
    )
    return F.sha2(F.to_json(identity), 256)


def parse_timestamp(col: Column) -> Column:
    """ISO timestamp; without an offset it is UTC. NULL when it cannot be read."""
    return F.try_to_timestamp(T.strip(col))


def published_or(col: Column, as_of: Column, *, keep_missing: bool) -> Column:
    """Publication time with ``as_of`` for unreadable values.

    ``keep_missing`` leaves an absent time NULL instead of using ``as_of``.
    """
    parsed = F.coalesce(parse_timestamp(col), as_of)
    if keep_missing:
        return F.when(col.isNotNull() & (col != ""), parsed)
    return parsed


def country_code(col: Column) -> Column:
    code = F.upper(T.strip(col))
    return F.when(F.length(code) >= 2, code)
