"""Captions for the images of documents, each distinct image captioned once for the whole corpus.

Images stand in texts as Markdown: ``![alt](https://…)`` for linked ones, ``![alt](image:<sha-256 of the content>)`` for those that a parser
took out of an office file. Their spans are exploded with the place of each, the distinct links and contents are captioned, and the captions are
spliced back in order: narrow rows (text's number, place, link) meet the captions, never the texts.

Defined cases: a text without images, or null, stays as it is; the same image at many places, in one text or in many, is captioned once and
stands at each; an image whose caption is null leaves its alt text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.runtime import broadcast_if_small, staged

IMAGE = r"!\[([^\]]*)\]\((https?://[^)]*|image:[0-9a-f]{64})\)"
PLACEHOLDER = "<image>"
BROADCAST_LINKS = 1_000_000  # captions that are broadcast; more are joined by a shuffle


def mark_of(content: bytes, alt: str = "") -> str:
    """The mark of an embedded image; ``caption_images`` finds its content by the hash."""
    return f"![{alt.replace(']', ' ')}](image:{hashlib.sha256(content).hexdigest()})"


def captions_of(links: DataFrame, contents: DataFrame | None, caption: Callable[[Column], Column] | None, caption_content: Callable[[Column], Column] | None) -> DataFrame:
    """(link, caption) of distinct links: linked images by ``caption(link)``, embedded ones by ``caption_content(content)``."""
    linked = links.filter(~F.startswith("link", F.lit("image:")))
    out = linked.select("link", (caption(F.col("link")) if caption else F.lit(None).cast("string")).alias("caption"))
    if contents is not None and caption_content is not None:
        once = contents.dropDuplicates(["id"]).select(F.concat(F.lit("image:"), "id").alias("link"), "content")
        embedded = once.join(links, "link", "left_semi").select("link", caption_content(F.col("content")).alias("caption"))
        out = out.unionByName(embedded)
    return out


def caption_images(docs: DataFrame, *, caption: Callable[[Column], Column] | None = None, caption_content: Callable[[Column], Column] | None = None, contents: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the images of the column ``text`` replaced by blocks with their captions.

    ``contents`` (id, content) are embedded images by their hash, repeats allowed. Embedded images nobody captions leave
    ``<image>``, linked ones their alt text.
    """
    whole = F.col(text)
    rows = docs.withColumn("_images", F.size(F.coalesce(F.regexp_extract_all(whole, F.lit(IMAGE), F.lit(0)), F.array())))
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "with-images")
    some = rows.filter("_images > 0")
    zipped = F.arrays_zip(F.regexp_extract_all(whole, F.lit(IMAGE), F.lit(1)).alias("alt"), F.regexp_extract_all(whole, F.lit(IMAGE), F.lit(2)).alias("link"))
    found = staged(some.select("_row", F.posexplode(zipped).alias("place", "x")).select("_row", "place", "x.alt", "x.link"), "images")
    known = staged(captions_of(found.select("link").distinct(), contents, caption, caption_content), "captions")
    said = found.join(broadcast_if_small(known, BROADCAST_LINKS), "link", "left")
    bare = F.when(F.startswith("link", F.lit("image:")), F.when(F.col("alt") == "", PLACEHOLDER).otherwise(F.col("alt"))).otherwise(F.col("alt"))
    said = said.withColumn("said", F.when(F.col("caption").isNotNull(), T.caption_block(F.col("caption"))).otherwise(bare))
    spliced = said.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("place", "said"))).alias("_said"))
    between = F.split(whole, IMAGE, -1)
    joined = F.array_join(F.flatten(F.zip_with(between, F.concat(F.col("_said.said"), F.array(F.lit(""))), lambda piece, s: F.array(piece, s))), "")
    done = some.join(spliced, "_row").withColumn(text, joined).select(*docs.columns)
    return rows.filter("_images = 0").select(*docs.columns).unionByName(done)
