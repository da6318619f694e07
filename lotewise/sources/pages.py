"""Captured pages: reading with the right charset, block pages, embedded JSON, JSON-LD."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

_CHARSET = re.compile(rb"<meta[^>]+charset=[\"']?([\w-]+)", re.IGNORECASE)
_LATIN = re.compile("iso-8859-1|latin-?1|windows-1252|cp1252")


#: What an anti-bot page says (fixed value).
BLOCK_PAGE = r"(?i)Attention Required! \| Cloudflare|Just a moment\.\.\.|cf-chl-|captcha"


def decode_bytes(body: bytes, content_type: str | None) -> str:
    """Text of a page: charset of the header, else of a meta tag near the top; Latin-1 kinds are Windows-1252."""
    m = re.search(r"charset=[\"']?([\w-]+)", content_type or "", re.IGNORECASE)
    found = m[1] if m else (m2[1].decode() if (m2 := _CHARSET.search(body[:4096])) else "utf-8")
    return body.decode("cp1252" if _LATIN.search(found.lower()) else "utf-8", "replace")


@F.pandas_udf(StringType())
def decode_body(body: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else decode_bytes(b, t) for b, t in zip(body, content_type, strict=True)])


def read_pages(spark: SparkSession, path: str, content_type: str | None = None) -> DataFrame:
    """(path, html) of page files, in the charset of a content type if one is given; .gz files are unpacked."""
    import gzip

    @F.pandas_udf(BinaryType())
    def unpack(body: pd.Series) -> pd.Series:
        return body.map(lambda b: gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decode_body(unpack("content"), F.lit(content_type).cast("string")).alias("html"))


def looks_blocked(status: Column, html: Column) -> Column:
    """An anti-bot page: refused, with a challenge in its first 20 000 characters."""
    return status.isin(403, 503) & F.substring(html, 1, 20000).rlike(BLOCK_PAGE)


def next_data(html: Column) -> Column:
    """The framework's embedded page state, as a variant, or null."""
    body = F.regexp_extract(html, r"(?s)<script[^>]+id=[\"']?__NEXT_DATA__[\"']?[^>]*>(.*?)</script>", 1)
    return F.try_parse_json(F.nullif(body, F.lit("")))


def json_ld(html: Column) -> Column:
    """All JSON-LD items of a page as an array of variants: arrays and graphs flattened, bad blocks left out."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script>"), F.lit(1))
    parsed = F.transform(blocks, lambda b: F.coalesce(F.try_parse_json(F.trim(b)), F.try_parse_json(F.regexp_replace(F.trim(b), r"[\r\n\t]+", " "))))

    def items(v: Column) -> Column:
        many = lambda x, at: F.try_variant_get(x, at, "array<variant>")
        top = F.coalesce(many(v, "$"), F.array(v))
        return F.flatten(F.transform(top, lambda x: F.coalesce(many(x, '$["@graph"]'), F.array(x))))

    return F.flatten(F.transform(F.filter(parsed, lambda v: v.isNotNull()), items))


def widget_state(html: Column, widget: str) -> Column:
    """The JSON that a page assigns to a widget's variable, as a variant, or null."""
    body = F.regexp_extract(html, rf"(?s)window\.markoVars\['{widget}-[a-z0-9]+'\] = (\{{.*?\}});\n\s*\}}\)\(\);", 1)
    return F.try_parse_json(F.nullif(body, F.lit("")))


def payload_field(text: Column, name: str) -> Column:
    """A field of an unescaped script payload as text; undefined and empty are null."""
    raw = F.nullif(F.regexp_extract(text, rf'"{name}":("(?:[^"\\]|\\.)*"|-?[\d.]+|true|false|null)', 1), F.lit(""))
    bare = F.when(raw.startswith('"'), F.regexp_replace(raw, '^"|"$', "")).otherwise(raw)
    return F.when(~bare.isin("$undefined", ""), bare)


def payload_count(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf'"{name}":\{{"count":(\d+)', 1).try_cast("int")
