"""Links in page canvases (EXT-1 to EXT-6): anchors, controls and web part payloads.

Everything but the walk through nested JSON is built from expressions; the walk runs in Arrow batches over the payloads only.

Defined cases: null and empty canvases hold no links; malformed JSON is an empty payload; hrefs without quotes are no links;
numeric references that are no character stay as text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.keys import col

ANCHOR = r"""(?is)<a\s+[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
RICH_TEXT = r"""(?is)<div[^>]*\bdata-sp-rte=["'][^"']*["'][^>]*>(.*?)</div>"""
LINK = "struct<raw_url:string,url:string,text:string>"
# Keys of payloads that hold urls, dictionaries of urls, and web part types.
URL_KEYS = ("url", "href", "linkUrl", "fileUrl", "imageSource", "imageUrl", "siteUrl", "webUrl", "navigateUri", "src")
URL_DICTIONARIES = ("imageSources", "links", "audienceTargetLinks")
TEXT_KEYS = ("title", "text", "displayText")
WEB_PARTS = {
    "c70391ea-0b10-4ee9-b2b4-006d3fcad0cd": "quickLinks",
    "daf0b71c-6de8-4ef7-b511-faae7c388708": "hero",
    "d1d91016-032f-456d-98a4-721247c305e8": "image",
    "8c88f208-6c77-4bdb-86a0-0c47b4316588": "fileViewer",
    "490d7c76-1824-45b2-9de3-676421c997fa": "embed",
    "af8be689-990e-492a-81f7-ba3e4cd3ed9c": "imageGallery",
    "df8e44e7-edd5-46d5-90da-aca1539313b8": "callToAction",
    "8654b779-4886-46d4-8ffb-b5ed960ee986": "button",
}


def _references(c: Column, pattern: str, base: int) -> Column:
    """Numeric character references of one base replaced by their characters."""
    pieces, codes = F.split(c, pattern), F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    point = lambda x: F.conv(x, base, 10).cast("decimal(20,0)")
    valid = lambda n: (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    spelt = lambda x: F.concat(F.lit("&#x" if base == 16 else "&#"), x, F.lit(";"))
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32")
    text = F.transform(codes, lambda x: F.when(valid(point(x)), char(F.when(valid(point(x)), point(x)).otherwise(F.lit(32)))).otherwise(spelt(x)))
    joined = F.array_join(F.flatten(F.transform(F.arrays_zip(pieces.alias("p"), text.alias("t")), lambda z: F.array(z["p"], F.coalesce(z["t"], F.lit(""))))), "")
    return F.when(F.contains(c, F.lit("&#")), joined).otherwise(c)


def decoded_entities(c: Column | str) -> Column:
    """EXT-2: hex, then decimal references, then named ones with ``&amp;`` first, so that what it uncovers is decoded too."""
    out = _references(_references(col(c), "&#x([0-9a-fA-F]+);", 16), "&#([0-9]+);", 10)
    for name, char in (("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def anchors(c: Column | str) -> Column:
    """EXT-1: array of (raw_url, url, text) of an html text's anchors, in order."""
    h = F.coalesce(col(c), F.lit(""))
    both = F.arrays_zip(F.regexp_extract_all(h, F.lit(ANCHOR), F.lit(1)).alias("u"), F.regexp_extract_all(h, F.lit(ANCHOR), F.lit(2)).alias("t"))
    plain = lambda t: F.regexp_replace(decoded_entities(F.regexp_replace(t, "<[^>]+>", "")), r"(?U)^[\s ]+|[\s ]+$", "")
    return F.transform(both, lambda z: F.struct(z["u"].alias("raw_url"), decoded_entities(z["u"]).alias("url"), F.nullif(plain(z["t"]), F.lit("")).alias("text")))


def attribute_values(c: Column, name: str) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"""(?i)\b{name}=["']([^"']+)["']"""), F.lit(1))


def controls(c: Column | str) -> Column:
    """EXT-3: array of (control, payload, rich_text), paired by place; rich texts beyond the controls and payloads are dropped."""
    h = F.coalesce(col(c), F.lit(""))
    a, b, r = attribute_values(h, "data-sp-controldata"), attribute_values(h, "data-sp-webpartdata"), F.regexp_extract_all(h, F.lit(RICH_TEXT), F.lit(1))
    zipped = F.arrays_zip(a.alias("control"), b.alias("payload"), r.alias("rich_text"))
    return F.slice(zipped, F.lit(1), F.greatest(F.size(a), F.size(b)))


def walk(node: object, hint: str | None = None) -> Iterator[tuple[str, str | None]]:
    """EXT-4: (url, text) of a parsed payload, in order; the text of an object reaches its nested objects, not its lists."""
    if isinstance(node, list):
        for x in node:
            yield from walk(x)
    elif isinstance(node, dict):
        own = next((node[k] for k in TEXT_KEYS if isinstance(node.get(k), str) and node[k]), hint)
        for key, value in node.items():
            if isinstance(value, str):
                if key in URL_KEYS and value and not value.startswith("data:"):
                    yield value, own
            elif key in URL_DICTIONARIES and isinstance(value, dict):
                yield from ((v, k) for k, v in value.items() if isinstance(v, str) and v and not v.startswith("data:"))
            else:
                yield from walk(value, own)


def payload_links(df: DataFrame, payload: str, out: str) -> DataFrame:
    """EXT-4: adds ``out``, the array of (raw_url, url, text) in a JSON column; malformed JSON holds none."""
    schema = f"array<{LINK}>"

    @F.pandas_udf(schema)
    def walked(values):
        import pandas as pd

        def one(text: str | None) -> list[dict]:
            try:
                return [{"raw_url": u, "url": u, "text": t} for u, t in walk(json.loads(text))] if text else []
            except (ValueError, RecursionError):
                return []

        return pd.Series([one(v) for v in values])

    return df.withColumn(out, F.when(F.coalesce(F.length(payload), F.lit(0)) > 0, walked(payload)).otherwise(F.array().cast(schema)))


def canvas_links(df: DataFrame, canvas: str, keep: list[str]) -> DataFrame:
    """EXT-5: one row per link of a canvas: keep..., link_idx, raw_url, url, text, source, instance_id. Per control anchors come first."""
    each = df.select(*keep, F.posexplode(controls(canvas)).alias("_c", "_x"))
    each = each.select(*keep, "_c", decoded_entities("_x.control").alias("_meta"), decoded_entities("_x.payload").alias("_payload"), F.col("_x.rich_text").alias("_rich"))
    field = lambda c, k: F.get_json_object(F.col(c), f"$.{k}")
    part = F.lower(F.coalesce(field("_meta", "webPartId"), field("_payload", "id")))
    known = F.create_map(*(F.lit(x) for pair in WEB_PARTS.items() for x in pair))
    each = each.withColumns({"instance_id": F.coalesce(field("_meta", "id"), field("_payload", "instanceId"), field("_payload", "id")), "_part": F.coalesce(F.element_at(known, F.coalesce(part, F.lit(""))), F.lit("unknown"))})
    each = payload_links(each, "_payload", "_walked")
    tagged = lambda a, source: F.transform(a, lambda x: F.struct(x["raw_url"].alias("raw_url"), x["url"].alias("url"), x["text"].alias("text"), source.alias("source")))
    every = F.concat(tagged(anchors("_rich"), F.lit("anchor")), tagged(F.col("_walked"), F.col("_part")))
    return each.select(*keep, "instance_id", "_c", F.posexplode(every).alias("_i", "_l")).select(*keep, "_c", "_i", "_l.*", "instance_id")


def banner_url(c: Column | str) -> Column:
    """SRC-5: a text, or the ``Url`` of a JSON object; empty is null."""
    b = col(c)
    found = F.when(F.ltrim(b).startswith("{"), F.get_json_object(b, "$.Url")).otherwise(b)
    return F.nullif(found, F.lit(""))


def page_links(pages: DataFrame) -> DataFrame:
    """EXT-6: site, page_id, page_url, title, link_idx, raw_url, url, text, source, instance_id: canvas, then layout, then the banner."""
    title = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("title", "leaf") if c in pages.columns), F.concat(F.lit("#"), F.col("page_id").cast("string")))
    keep = ["site", "page_id", "page_url", "title", "_row"]
    base = pages.withColumn("title", title).withColumn("_row", F.monotonically_increasing_id())
    parts = [canvas_links(base, c, keep).withColumn("_part", F.lit(k)) for k, c in enumerate(("canvas", "layout"))]
    banner = base.withColumn("_b", banner_url("banner_url")).filter("_b is not null")
    none = F.lit(None).cast("string")
    parts.append(banner.select(*keep, F.lit(0).alias("_c"), F.lit(0).alias("_i"), F.col("_b").alias("raw_url"), F.col("_b").alias("url"), none.alias("text"), F.lit("banner").alias("source"), none.alias("instance_id"), F.lit(2).alias("_part")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # Pages are the unit: their links are few, so one page is one sort group.
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("_row").orderBy("_part", "_c", "_i")) - 1
    return every.withColumn("link_idx", place).drop("_row", "_part", "_c", "_i")
